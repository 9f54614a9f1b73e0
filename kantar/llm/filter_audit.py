"""Filter interaction audit: what each filter does in every order of the filters.

A document's failures are a mask with a bit for each filter; documents are counted
by part and mask, which combines before the shuffle. These cells are unpivoted
against the steps of all orders (a fixed list, so no join makes them). Along the
steps of a cell a running bit-or of the failures before tells whether the documents
of the cell are removed already; conditional sums over the cells of a step give the
counts, and totals over all rows of a filter its Shapley sum.

The last filter asks whether a smaller id has the same text anywhere in the table.
The least id of each text is found with map-side combining by the text's digest, and
only texts that repeat meet their rows again, in a join that adaptive execution
can split; so a text that a third of all rows share is no task of its own.

Defined results: a null text is empty, a null source is the part of the empty
string; a null id has no smaller one and is smaller than none; rows that share the
least id of a text are all first; labels of a null id count for none, and a document
labelled several times is good (toxic) if one label says so. Empty input gives no
rows. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kantar.llm.shared import cut, table, text_id

#: What divides words.
GAP = r"[\x20\x09-\x0D]+"
LEAST_WORDS = 50
#: Copies of a text are looked for by filter E, which comes last among the bits.
FILTERS = "ABCDE"


def conditions(text: Column) -> dict[str, Column]:
    """What fails the filters that look at a text alone; ``text`` is not null."""
    words = F.filter(F.split(text, GAP, -1), lambda w: w != "")
    upper = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {
        "A": F.size(words) < LEAST_WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < 65 * F.size(words),
        "C": 100 * upper.cast("long") > 5 * F.length(text).cast("long"),
        "D": text.rlike(r"[#$%&*|]"),
    }


def masks(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(key, part, mask, good, toxic) for every row of ``docs``."""
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{part}`"), F.lit("")).alias("part"), whole.alias("text"))
    told = rows.select("key", "part", text_id(F.col("text")).alias("tid"), *[c.alias(k) for k, c in conditions(F.col("text")).items()])
    bits = sum((F.when(F.col(k), 1 << b).otherwise(0) for b, k in enumerate(FILTERS[:-1])), F.lit(0))
    # Written, so that the texts are read once.
    each = cut(told.select("key", "part", "tid", bits.alias("own")), "audit-rows")
    first = each.groupBy("tid").agg(F.min("key").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    copies = each.join(first, "tid", "left")
    late = F.coalesce(F.col("key") > F.col("first"), F.lit(False))
    flags = labels.where(F.col(f"`{key}`").isNotNull()).groupBy(F.col(f"`{key}`").alias("lk")).agg(
        F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")
    )
    return copies.join(flags, F.col("key") == F.col("lk"), "left").select(
        "key",
        "part",
        (F.col("own") + F.when(late, 1 << (len(FILTERS) - 1)).otherwise(0)).alias("mask"),
        F.coalesce("good", F.lit(False)).alias("good"),
        F.coalesce("toxic", F.lit(False)).alias("toxic"),
    )


def orders(filters: str = FILTERS) -> list[str]:
    return ["".join(p) for p in itertools.permutations(filters)]


def audit(rows: DataFrame, filters: str = FILTERS) -> DataFrame:
    """The report on rows of ``masks``: one row per part, order and step."""
    cells = rows.groupBy("part", "mask").agg(
        F.count("*").alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic")
    )
    # A part has a cell for every mask that occurs, and all its steps through any of them.
    steps = cells.select("*", F.explode(F.array(*[F.lit(o) for o in orders(filters)])).alias("filter_order")).select(
        "*", F.posexplode(F.split("filter_order", "")).alias("k", "filter")
    )
    bit = F.element_at(F.create_map(*[x for b, f in enumerate(filters) for x in (F.lit(f), F.lit(1 << b))]), F.col("filter"))
    failing = steps.withColumn("failed", F.col("mask").bitwiseAND(bit))
    along = Window.partitionBy("part", "mask", "filter_order").orderBy("k")
    seen = failing.withColumn("upto", F.bit_or("failed").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    told = seen.withColumn("before", F.col("upto").bitwiseXOR(F.col("failed")))
    fails, gone = F.col("failed") != 0, F.col("before") != 0
    total = lambda when, what="n": F.sum(F.when(when, F.col(what)).otherwise(F.lit(0))).cast("long")
    report = told.groupBy("part", "filter_order", "k", "filter").agg(
        total(F.col("upto") == 0).alias("kept"),
        total(fails & ~gone).alias("removed"),
        total(fails & gone).alias("redundant"),
        total(fails & (F.col("mask") == F.col("failed"))).alias("unique_fails"),
        total(fails & ~gone, "good").alias("good_lost"),
        total(fails & ~gone, "toxic").alias("toxic_lost"),
    )
    shapley = F.sum("removed").over(Window.partitionBy("part", "filter")).cast("long")
    return report.select(
        "part", "filter_order", (F.col("k") + 1).alias("step"), "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", shapley.alias("shapley")
    )


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return audit(masks(docs, table(spark, sf_dir, "labels")))


OP12_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM t
), l AS (
  SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id
), f AS (
  SELECT w.part, [len(words) < 50, 100 * len(list_distinct(words)) < 65 * len(words),
      100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text),
      regexp_matches(text, '[#$%&*|]'),
      coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY text), false)] AS fails,
    coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM w LEFT JOIN l ON w.doc_id = l.doc_id
), cells AS (
  SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails
), one AS (SELECT unnest([1, 2, 3, 4, 5]) AS i),
orders AS (
  SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM one a, one b, one c, one d, one e
  WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5
), steps AS (
  SELECT part, array_to_string(list_transform(o, lambda i: 'ABCDE'[i]), '') AS filter_order, s.i AS step, o[s.i] AS filter,
    fails[o[s.i]] AS fails, list_bool_or(list_transform(o[1:s.i - 1], lambda i: fails[i])) IS TRUE AS gone,
    len(list_filter(fails, lambda x: x)) = 1 AS alone, n, good, toxic
  FROM cells, orders, one s
), report AS (
  SELECT part, filter_order, step, filter,
    coalesce(sum(n) FILTER (NOT fails AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (fails AND NOT gone), 0) AS removed,
    coalesce(sum(n) FILTER (fails AND gone), 0) AS redundant, coalesce(sum(n) FILTER (fails AND alone), 0) AS unique_fails,
    coalesce(sum(good) FILTER (fails AND NOT gone), 0) AS good_lost, coalesce(sum(toxic) FILTER (fails AND NOT gone), 0) AS toxic_lost
  FROM steps GROUP BY ALL
)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley
FROM report
"""
