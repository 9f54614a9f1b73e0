"""Secret scan over an incremental ledger of text blobs, native Spark only.

Every version of a text is addressed by its SHA-256. The ledger holds one row
per scanned (blob, rule, rule version). A run scans only pairs that the ledger
does not hold, each distinct blob once however many paths hold it, and joins the
findings back to all paths. Copies meet in a map-side aggregate, so a text that
a third of all rows share moves once per map task.

Spans are code point offsets, end exclusive. Spark has no function for the
places of all matches; they follow from the lengths of the pieces that ``split``
leaves between the matches that ``regexp_extract_all`` returns.

Defined results: a null text counts as empty; a text without findings has no
spans; rows that repeat, or that share a path, each get their findings; null
paths are kept; an empty table gives an empty result and an empty ledger.
Columns other than the key and the text are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kantar.llm.shared import cut, table


@dataclass(frozen=True)
class Rule:
    """``group``: the group whose length must reach ``least``, 0 for the whole match."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    version: int = 1

    @property
    def address(self) -> str:
        return f"{self.kind}@{self.version}"


#: The base rules, in the order in which equal starts are listed.
ASSIGN = Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6)
#: A maximal run with its least length is the same match set as a run filtered by length.
ACCESS = Rule("access", r"AKIA[A-Z0-9]{16,}")
HEX = Rule("hex", r"[0-9a-f]{24,}")
#: Kinds that the ledger scan adds; the base kinds stay as they are.
PEM = Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----")
JWT = Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")
HOSTED = Rule("hosted", r"gh[opsru]_[A-Za-z0-9]{36,}")
BASE = (ASSIGN, ACCESS, HEX)
RULES = (*BASE, PEM, JWT, HOSTED)

SPANS = "array<struct<start:int,kind_no:int,kind:string,stop:int>>"
#: Matches that are gathered at a time.
SHELF = 128


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _spans(text: Column, rule: Rule, number: int) -> Column:
    """The spans of one rule in ``text``: pieces and matches alternate.

    Places are sums over what comes before, so a fold gathers the spans: shelf by shelf, and
    the shelves as wholes, as an array that grows by one costs its whole length each time.
    """
    matches = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    both = F.arrays_zip(F.split(text, rule.pattern, -1).alias("piece"), matches.alias("match"))
    empty = F.array().cast(SPANS)
    def step(acc: Column, z: Column) -> Column:
        opens = acc["at"] + F.length(z["piece"])
        closes = opens + F.coalesce(F.length(z["match"]), F.lit(0))
        held = z["match"] if rule.group == 0 else F.regexp_extract(z["match"], rule.pattern, rule.group)
        span = F.struct(
            opens.alias("start"), F.lit(number).alias("kind_no"), F.lit(rule.kind).alias("kind"), closes.alias("stop")
        )
        keep = z["match"].isNotNull() & (F.length(held) >= rule.least)
        return F.struct(
            closes.alias("at"),
            F.when(keep, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"),
        )

    def shelf(acc: Column, some: Column) -> Column:
        held = F.aggregate(some, F.struct(acc["at"].alias("at"), empty.alias("spans")), step)
        return let(held, lambda h: F.struct(h["at"].alias("at"), F.concat(acc["shelves"], F.array(h["spans"])).alias("shelves")))

    shelves = F.transform(F.sequence(F.lit(0), F.floor((F.size(both) - 1) / SHELF).cast("int")), lambda k: F.slice(both, k * SHELF + 1, SHELF))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPANS}>").alias("shelves"))
    found = F.aggregate(shelves, start, shelf, lambda acc: F.flatten(acc["shelves"]))
    return F.when(F.regexp_like(text, F.lit(rule.pattern)), found).otherwise(empty)


def scan_ledger(
    docs: DataFrame,
    path: str = "doc_id",
    text: str = "text",
    rules: tuple[Rule, ...] = RULES,
    ledger: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(findings, ledger): findings has ``path``, ``blob`` and ``spans`` for every row of ``docs``.

    ``ledger`` (``blob``, ``rule``, ``spans``) is what earlier runs left; the one
    returned also holds this run's blobs and may be stored for the next.
    """
    full = F.coalesce(F.col(text), F.lit(""))
    paths = docs.select(F.col(path).alias("path"), F.sha2(full, 256).alias("blob"))
    blobs = (
        docs.select(F.sha2(full, 256).alias("blob"), full.alias("text"))
        .groupBy("blob")
        .agg(F.first("text").alias("text"))
    )
    if ledger is None:
        todo = blobs.withColumn("held", F.array().cast("array<string>"))
    else:
        held = ledger.groupBy("blob").agg(F.collect_set("rule").alias("held"))
        todo = blobs.join(held, "blob", "left").withColumn("held", F.coalesce("held", F.array().cast("array<string>")))
        todo = todo.where(F.size(F.array_except(F.array(*[F.lit(r.address) for r in rules]), "held")) > 0)
    scanned = todo.select(
        "blob",
        F.filter(
            F.array(
                *[
                    F.struct(
                        F.lit(r.address).alias("rule"),
                        F.when(~F.array_contains("held", r.address), _spans(F.col("text"), r, k)).alias("spans"),
                    )
                    for k, r in enumerate(rules)
                ]
            ),
            lambda x: x["spans"].isNotNull(),
        ).alias("told"),
    )
    fresh = cut(scanned, "secret-ledger").select("blob", F.explode("told").alias("x")).select("blob", "x.rule", "x.spans")
    book = fresh if ledger is None else ledger.select("blob", "rule", "spans").unionByName(fresh)
    wanted = [r.address for r in rules]
    per_blob = (
        book.where(F.col("rule").isin(wanted) & (F.size("spans") > 0))
        .groupBy("blob")
        .agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))
    )
    findings = paths.join(per_blob, "blob", "left").select(
        F.col("path").alias(path), "blob", F.coalesce("spans", F.array().cast(SPANS)).alias("spans")
    )
    return findings, book


def told(spans: Column) -> Column:
    """``kind:start:end`` by start, then kind, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ","
    )


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    findings, _ = scan_ledger(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind_no"] < len(BASE))

    def count(kind: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind_no"] == kind)).cast("long")

    return findings.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(told(base), 256).alias("base_sha256"),
        told(F.col("spans")).alias("spans"),
    )


def _sql_kind(rule: Rule, number: int) -> str:
    pattern = rule.pattern.replace("'", "''")
    held = "m" if rule.group == 0 else f"regexp_extract(m, '{pattern}', {rule.group})"
    return f"""
  SELECT doc_id, row_no, {number} AS kind_no, '{rule.kind}' AS kind, m,
    length({held}) >= {rule.least} AS good,
    list_sum(list_transform(pieces[1:i], lambda x: length(x)))
      + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS start
  FROM (SELECT doc_id, row_no, pieces, ms, unnest(ms) AS m, generate_subscripts(ms, 1) AS i
    FROM (SELECT doc_id, row_no, regexp_split_to_array(t, '{pattern}') AS pieces,
            regexp_extract_all(t, '{pattern}') AS ms
          FROM d WHERE regexp_matches(t, '{pattern}')))"""


OP1_SQL = (
    "WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS row_no FROM documents), f AS ("
    + "\n UNION ALL ".join(_sql_kind(r, k) for k, r in enumerate(RULES))
    + """
), g AS (SELECT row_no, kind_no, start, kind || ':' || CAST(start AS BIGINT) || ':' || CAST(start + length(m) AS BIGINT) AS said
    FROM f WHERE good),
a AS (SELECT row_no, count(*) FILTER (kind_no = 0) AS n_assign, count(*) FILTER (kind_no = 1) AS n_access,
    count(*) FILTER (kind_no = 2) AS n_hex,
    string_agg(said, ',' ORDER BY start, kind_no) FILTER (kind_no < 3) AS base,
    string_agg(said, ',' ORDER BY start, kind_no) AS spans FROM g GROUP BY row_no)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (row_no)
"""
)
