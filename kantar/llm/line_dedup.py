"""Line dedup by content-defined chunks of lines, extended line by line.

A text is taken as its lines that are not blank, each with the blank lines after
it. A rolling hash over the hashes of ``LEAST_LINES`` adjacent lines slides along
the text; where it is divisible by ``DIVISOR``, a chunk begins. An edge depends on the
lines beside it alone, so whatever stands before a passage, its chunks are the same.

- Chunks of two lines or more are grouped by digest over all documents; groups that
  repeat are confirmed by their bytes. Of each group the first occurrence (least
  document id, nulls last, then text id, then place) stays whole; all lines of the
  others are repeats.
- The rolling hashes at every line are counted too, and windows whose hash repeats are
  confirmed by their bytes as well. So confirmed chunks are extended line by line both
  ways as far as lines agree, and repeated runs that no edge meets are found too,
  up to their very ends.

Of every repeated window the first occurrence stays whole, and so does the first one of
every repeated chunk, unless the chunk stands whole where its windows stay. Lines of all
other occurrences are removed, if no line beside them needs them to stay whole.

Counts combine before the shuffle. Repeated pieces return to the documents by
joins, which adaptive execution may split where one piece occurs in very many documents.

Defined results: a null text is empty and stays null; texts without a repeated
window stay as they are, byte for byte; a text whose last line goes ends without
a line feed. Windows are equal where the blank lines between their lines are, too;
blank lines after a line go with it, those that begin a text with its first line.
Windows of one text may overlap: of three equal lines in a row two stay. Rows
that repeat in id and text count as one document, so each keeps what the other
keeps. Empty input gives no rows. Columns are those of the input, whatever their
names.
"""

from __future__ import annotations

import hashlib

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kantar.llm.shared import cut, table, text_id

LEAST_LINES = 2
#: One edge in so many lines begins a chunk.
DIVISOR = 4
#: Repeated hashes up to which they are broadcast; beyond, a shuffled join.
BROADCAST_HASHES = 500_000
BASE, MODULUS = 0x9E3779B97F4A7C15, 1 << 64


def _full(lines: list[str]) -> list[int]:
    """The lines that are not blank."""
    return [k for k, line in enumerate(lines) if line.strip()]


def pieces(text: str | None) -> list[str]:
    """Each line that is not blank with the blank ones after it (the first one's with those before it too); together they are the text."""
    lines = (text or "").split("\n")
    edges = [0, *_full(lines)[1:], len(lines)]
    return ["\n".join(lines[a:b]) + ("\n" if b < len(lines) else "") for a, b in zip(edges, edges[1:])]


def _parts(text: str | None) -> list[str]:
    """The lines that are not blank as they are compared: each with the blank lines before the next one."""
    lines = (text or "").split("\n")
    full = _full(lines)
    return ["\n".join(lines[a:b]) for a, b in zip(full, [*full[1:], len(lines)])]


def rolling(parts: list[str]) -> list[int]:
    """A hash of the ``LEAST_LINES`` lines from each line on; blank lines after the last of them don't count."""
    hashed = lambda s: xxhash.xxh3_64_intdigest(s.encode("utf-8", "replace"))
    inner, before = [hashed(p) for p in parts], LEAST_LINES - 1
    leaves, rolled, out = pow(BASE, before - 1, MODULUS), 0, []
    for k, p in enumerate(parts):
        if k >= before:
            out.append((rolled * BASE + hashed(p.partition("\n")[0])) % MODULUS)
            rolled -= inner[k - before] * leaves
        rolled = (rolled * BASE + inner[k]) % MODULUS
    return out


def edges(hashes: list[int], lines: int) -> list[int]:
    """Where chunks begin and the last one ends; the hash that begins on the line before an edge decides on it."""
    mixed = ((h ^ (h >> 31)) * BASE % MODULUS >> 33 for h in hashes)
    return [0, *(k + 1 for k, m in enumerate(mixed) if m % DIVISOR == 0 and k + 1 < lines), lines] if lines else [0, 0]


def chunks(text: str | None) -> list[tuple[int, int, str]]:
    """(first line, lines, the lines with their line feeds) of each chunk; together they are the text."""
    whole, parts = pieces(text), _parts(text)
    at = edges(rolling(parts), len(parts))
    return [(a, b - a, "".join(whole[a:b])) for a, b in zip(at, at[1:])] if parts else [(0, 0, "".join(whole))]


def _compared(text: str | None) -> list[tuple[int, str]]:
    """(number, chunk as it is compared) of the chunks of two lines or more."""
    parts = _parts(text)
    return [(k, "\n".join([*parts[a : a + n - 1], parts[a + n - 1].partition("\n")[0]])) for k, (a, n, _) in enumerate(chunks(text)) if n >= LEAST_LINES]


def _rest(texts: pd.Series, gone: pd.Series) -> pd.Series:
    out = []
    for text, places in zip(texts, gone):
        if places is None or not len(places):
            out.append(text)
            continue
        removed = set(places)
        rest = "".join(c for k, c in enumerate(pieces(text)) if k not in removed)
        out.append(rest.removesuffix("\n") if not text.endswith("\n") else rest)
    return pd.Series(out, dtype=object)


CHUNK = "array<struct<k:int,n:int,digest:binary,hashes:array<bigint>,parts:array<string>>>"


def _chunk_rows(texts: pd.Series) -> pd.Series:
    """Of each chunk: its digest, the hashes that begin on its lines, and its lines with as many after them as the last hash needs."""
    signed = lambda h: h - MODULUS if h >= MODULUS >> 1 else h
    out = []
    for text in texts:
        parts = _parts(text)
        hashes = rolling(parts)
        at, rows = edges(hashes, len(parts)), []
        for a, b in zip(at, at[1:]):
            same = "\n".join([*parts[a : b - 1], parts[b - 1].partition("\n")[0]]) if b - a >= LEAST_LINES else None
            digest = hashlib.blake2b(same.encode("utf-8", "replace"), digest_size=16).digest() if same is not None else None
            rows.append({"k": a, "n": b - a, "digest": digest, "hashes": [signed(h) for h in hashes[a:b]], "parts": parts[a : b + LEAST_LINES - 1]})
        out.append(rows)
    return pd.Series(out)


def _content(parts: Column, at, n) -> Column:
    """Lines ``at`` (from 0) to ``at`` + ``n``, the last without its blank ones."""
    inner = F.array_join(F.slice(parts, at + 1, n - 1), "\n")
    return F.concat_ws("\n", inner, F.substring_index(F.get(parts, at + n - 1), "\n", 1))


def _place(k: Column) -> Column:
    return F.struct(F.col("id").isNull().alias("none"), "id", "tid", k.alias("k")).alias("place")


def _repeated(rows: DataFrame, key: str, content: Column, name: str) -> DataFrame:
    """The rows whose ``content`` other places have too, with the ``first`` of them.

    ``rows`` is written, has ``key``, a hash of the content, and ``place``. Keys are counted
    first; only what repeats is grouped by its bytes. First places are written before the
    join, so that adaptive execution can split the rows of a hot one.
    """
    again = cut(rows.groupBy(key).count().where("count > 1").select(key), f"line-{name}-again")
    again = F.broadcast(again) if again.count() <= BROADCAST_HASHES else again
    found = cut(rows.join(again, key, "left_semi").withColumn("content", content).drop("parts"), f"line-{name}-found")
    first = found.groupBy(key, "content").agg(F.min("place").alias("first"), F.max("place").alias("last")).where("first <> last").drop("last")
    return found.join(cut(first, f"line-{name}-first"), [key, "content"]).drop("content")


def removals(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, tid, gone): for each document that loses lines, their numbers."""
    rows = docs.where(F.col(text).contains("\n")).select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    told = F.pandas_udf(_chunk_rows, CHUNK)
    # Written, so that texts pass through Python once.
    each = cut(rows.select("id", text_id(F.col("text")).alias("tid"), F.explode(told("text")).alias("x")).select("id", "tid", "x.*"), "line-each")
    whole = each.where(F.col("n") >= LEAST_LINES).select("digest", _place(F.col("k")), "n", "parts")
    same_chunks = cut(_repeated(whole, "digest", _content(F.col("parts"), F.lit(0), F.col("n")), "chunks"), "line-chunks")
    lines = each.select("id", "tid", "k", "n", "parts", F.posexplode("hashes").alias("i", "hash"))
    windows = lines.select("hash", _place(F.col("k") + F.col("i")), "k", F.when(F.col("i") + LEAST_LINES <= F.col("n"), F.col("n")).alias("inside"), "i", "parts")
    same_windows = cut(_repeated(windows, "hash", _content(F.col("parts"), F.col("i"), F.lit(LEAST_LINES)), "windows").drop("i", "hash"), "line-windows")
    # Where the windows of a chunk that stays have their first places: side by side, the chunk is whole there.
    keepers = same_chunks.where("place = first").select("place", "n").dropDuplicates(["place"])
    owner = F.struct("place.none", "place.id", "place.tid", "k").alias("place")
    offset = F.struct("first.none", "first.id", "first.tid", (F.col("first.k") - F.col("place.k")).alias("by"))
    lined = same_windows.where("inside IS NOT NULL").groupBy(owner).agg((F.min(offset) == F.max(offset)).alias("lined"))
    torn = keepers.join(lined, "place", "left").where(~F.coalesce("lined", F.lit(False)))
    span = lambda n: F.struct(F.col("place.k").alias("a"), (F.col("place.k") + n).alias("b"))
    marks = (
        same_windows.select("place", span(F.lit(LEAST_LINES)).alias("span"), (F.col("place") == F.col("first")).alias("stays"))
        .unionByName(same_chunks.where("place <> first").select("place", span(F.col("n")).alias("span"), F.lit(False).alias("stays")))
        .unionByName(torn.select("place", span(F.col("n")).alias("span"), F.lit(True).alias("stays")))
    )
    gathered = marks.groupBy("place.id", "place.tid").agg(*[F.collect_set(F.when(F.col("stays") == kept, F.col("span"))).alias(name) for kept, name in ((True, "safe"), (False, "late"))])
    over = lambda spans: F.flatten(F.transform(spans, lambda s: F.sequence(s["a"], s["b"] - 1)))
    return gathered.select("id", "tid", F.array_except(over("late"), over("safe")).alias("gone")).where(F.size("gone") > 0)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", count: str | None = None) -> DataFrame:
    """``docs`` without repeated lines; ``count`` names a column to add with the lines removed (blank ones not counted)."""
    lost = removals(docs, id_col, text).select(F.col("id").alias("_id"), F.col("tid").alias("_tid"), F.col("gone").alias("_gone"))
    here = docs.alias("d").join(
        lost.alias("l"), F.col(f"d.`{id_col}`").eqNullSafe(F.col("l._id")) & (text_id(F.col(f"d.`{text}`")) == F.col("l._tid")), "left"
    )
    rest = F.pandas_udf(_rest, "string")
    # Only texts that lose something go through Python.
    kept = F.col("l._gone").isNull()
    columns = [
        F.when(kept, F.col(f"d.`{c}`")).otherwise(rest(F.when(~kept, F.col(f"d.`{c}`")), F.col("l._gone"))).alias(c)
        if c == text
        else F.col(f"d.`{c}`").alias(c)
        for c in docs.columns
    ]
    extra = [F.coalesce(F.size("l._gone"), F.lit(0)).alias(count)] if count else []
    return here.select(*columns, *extra)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = dedup_lines(docs, count="n_removed")
    return out.select("doc_id", "text", F.col("n_removed").cast("long").alias("n_removed"))
