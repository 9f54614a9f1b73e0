"""Fill-in-middle: documents cut into units and put out as prefix, suffix and middle.

A unit grammar says which neighbouring characters stay together. It is translated
into one regular expression without width that holds between any two others, so
``split`` at it gives the units and loses no character. A text of no characters has
no units; it is kept apart, as a split gives one empty piece for it.

Both cuts and the form come from SHA-256 of the seed and the document's id, so they
stay the same whatever the partitioning and on every retry. All is Spark's own
expressions, a row at a time: nothing is shuffled.

Defined results: a null text is empty; a null id counts as an empty string in the
hash; repeated rows give the same output each; texts that hold one of the marks are
left plain, so that the exact text can be read back from every output. Empty input
gives no rows. Columns of the input are kept whatever their names; where one of the
added names is taken, the added column gets an underscore more.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kantar.llm.shared import fresh, table

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Percent of the texts that are transformed, and of these in the order suffix first.
RATE, SPM_RATE = 90, 20
SEED = 1


@dataclass(frozen=True)
class Grammar:
    """Pairs of classes (as between the brackets of a regular expression) of neighbours that stay together.

    Each pair is (the character before, the character after); an empty class means any.
    """

    together: tuple[tuple[str, str], ...] = ()

    def boundary(self) -> str:
        """Holds between two neighbours that no pair keeps together; never at an edge of the text."""
        one = lambda c: f"[{c}]" if c else r"[\s\S]"
        inner = "".join(f"(?!(?<={one(a)})(?={one(b)}))" for a, b in self.together)
        return rf"(?<=[\s\S])(?=[\s\S]){inner}"


GRAMMARS = {
    # [A-Za-z]+|[^A-Za-z]
    "letters": Grammar((("A-Za-z", "A-Za-z"),)),
    # every character
    "characters": Grammar(),
    # a word with the white space after it
    "words": Grammar((("", r"\s"), (r"^\s", r"^\s"))),
    # a line with its line feed
    "lines": Grammar((("^\n", ""),)),
}


def units(text: Column, grammar: Grammar) -> Column:
    """The units of a text in order; together they are the text."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, grammar.boundary(), -1))


def draws(key: Column, seed: int, n: int = 4) -> list[Column]:
    """``n`` unsigned numbers of 32 bits from the hash of the seed and the key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(n)]


def _joined(pieces: Column, start, end) -> Column:
    """The text of units ``start`` to ``end``, from 0, end exclusive."""
    return F.array_join(F.slice(pieces, start + 1, end - start), "")


def fill_in_middle(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    grammar: Grammar = GRAMMARS["letters"],
    rate: int = RATE,
    spm_rate: int = SPM_RATE,
    seed: int = SEED,
) -> DataFrame:
    """``docs`` with ``n_units``, ``form`` (plain, psm or spm), ``prefix_chars``, ``middle_chars`` and ``output``."""
    name = lambda n: fresh(n, docs.columns)
    own = [F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns)]
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(*own, whole.alias("whole"), *[h.alias(f"h{k + 1}") for k, h in enumerate(draws(F.col(f"`{key}`"), seed))])
    cut = rows.withColumn("pieces", units(F.col("whole"), grammar)).withColumn("n", F.size("pieces").cast("long"))
    places = cut.withColumns({"x": F.col("h1") % (F.col("n") + 1), "y": F.col("h2") % (F.col("n") + 1)})
    low, high = F.least("x", "y").cast("int"), F.greatest("x", "y").cast("int")
    marked = F.lit(False)
    for m in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains("whole", F.lit(m))
    plain = (F.col("whole") == "") | marked | (F.col("h3") % 100 >= rate)
    parts = places.select(
        *[f"c{k}" for k in range(len(own))],
        "n",
        "whole",
        F.when(plain, "plain").when(F.col("h4") % 100 < spm_rate, "spm").otherwise("psm").alias("form"),
        F.when(~plain, _joined(F.col("pieces"), F.lit(0), low)).alias("p"),
        F.when(~plain, _joined(F.col("pieces"), low, high)).alias("m"),
        F.when(~plain, _joined(F.col("pieces"), high, F.size("pieces"))).alias("s"),
    )
    psm = F.concat(F.lit(PREFIX), "p", F.lit(SUFFIX), "s", F.lit(MIDDLE), "m")
    spm = F.concat(F.lit(SUFFIX), "s", F.lit(PREFIX), "p", F.lit(MIDDLE), "m")
    return parts.select(
        *[F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)],
        F.col("n").alias(name("n_units")),
        F.col("form").alias(name("form")),
        F.length("p").cast("long").alias(name("prefix_chars")),
        F.length("m").cast("long").alias(name("middle_chars")),
        F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("whole")).alias(name("output")),
    )


def restore(output: Column, form: Column) -> Column:
    """The exact text, from an output and its form alone."""
    after = lambda mark: F.substring_index(output, mark, -1)
    between = lambda a, b: F.substring_index(F.substring_index(output, b, 1), a, -1)
    psm = F.concat(between(PREFIX, SUFFIX), after(MIDDLE), between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), after(MIDDLE), between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id",
        F.col("n_units").alias("n"),
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


OP13_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents
), u AS (
  SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS pieces,
    CAST('0x' || substr(d, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(d, 9, 8) AS BIGINT) AS h2,
    CAST('0x' || substr(d, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(d, 25, 8) AS BIGINT) AS h4
  FROM t
), c AS (
  SELECT *, len(pieces) AS n,
    least(h1 % (len(pieces) + 1), h2 % (len(pieces) + 1)) AS low,
    greatest(h1 % (len(pieces) + 1), h2 % (len(pieces) + 1)) AS high,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
      WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM u
), p AS (
  SELECT *, array_to_string(pieces[1:low], '') AS prefix, array_to_string(pieces[low + 1:high], '') AS middle,
    array_to_string(pieces[high + 1:n], '') AS suffix
  FROM c
)
SELECT doc_id, n, form,
  CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE text END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""
