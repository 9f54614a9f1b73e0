"""Benchmark decontamination by the q-gram lemma.

An item of m characters that a document holds with at most k edits shares with it
at least ``m + 1 - q * (k + 1)`` of its q-grams, and all of these lie on
diagonals (document place less item place) at most k apart. So the shared q-grams
of each document are counted in diagonal bands of width ``2 * (k + 1)`` that
overlap by half; bands that reach the bound are kept, and in each the item is
aligned with the document by a dynamic programme over the diagonals of the band
alone. The diagonals of a match differ by k at most, so one of the bands holds all
of them. What remains is exact: the operator reports an item for a document if and
only if some stretch of the text is within k edits of it.

``k`` is ``ERROR_RATE`` of the item's length, lowered for short items until the
bound is at least one. Texts are compared lower-cased, with white space runs as
one space and none at the ends. Items shorter than q have no q-grams; they allow
no edits and are looked up as whole words.

Documents are neither shuffled nor collected. The benchmark goes to the tasks in
parts of about ``PART_CHARS`` characters of item text, and each worker builds the
index of a part. ``PASS_PARTS`` parts are searched in one pass over the texts; a
larger benchmark takes more passes, each of which is written to the shared folder.
So neither the driver nor a worker holds more than that many parts, however large
the benchmark.

Defined results: null texts are empty and hold nothing; items that are null or
empty when normalised are not searched; items with equal normalised texts are
searched once and all reported; an item id that repeats with different texts is
found if any of them is. Null item ids are reported as null. Repeated rows and
null document ids are kept; empty input gives no rows. All columns of the
documents are kept, whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kantar.llm.shared import cut, fresh, table

GRAM = 10
ERROR_RATE = 0.08
PART_CHARS = 2_000_000
PASS_PARTS = 4
_SLOTS = 22

_BASE = np.uint64(0x9E3779B97F4A7C15)


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def _grams(text: str, q: int) -> np.ndarray:
    """A hash of each q-gram of characters."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(codes) < q:
        return np.zeros(0, np.uint64)
    h = np.zeros(len(codes) - q + 1, np.uint64)
    for k in range(q):
        h *= _BASE
        h += codes[k : len(codes) - q + 1 + k]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h


def budget(m: int, q: int = GRAM, rate: float = ERROR_RATE) -> int:
    return max(0, min(int(rate * m), m // q - 1))


#: Stands outside the text; no character of an item equals it.
OUTSIDE = np.uint32(0xFFFFFFFF)


def align(item: np.ndarray, text: np.ndarray, first: int, width: int, k: int) -> tuple[int, int] | None:
    """The least edits of ``item`` against a stretch of ``text`` in a diagonal band, and where that ends, or None beyond k.

    The band has the diagonals ``first`` to ``first + width - 1``. A row holds, for
    each diagonal, the edits of the item's first r characters against a stretch
    that ends at that diagonal. What the band has outside the text equals nothing.
    """
    m = len(item)
    stretch = np.full(m + width - 1, OUTSIDE, np.uint32)
    lo, hi = max(0, first), min(len(text), first + len(stretch))
    if hi > lo:
        stretch[lo - first : hi - first] = text[lo:hi]
    step = np.arange(width)
    row = np.zeros(width, np.int64)
    for r in range(m):
        here = row + (stretch[r : r + width] != item[r])
        here[:-1] = np.minimum(here[:-1], row[1:] + 1)
        row = np.minimum.accumulate(here - step) + step
        if row.min() > k:
            return None
    at = int(row.argmin())
    return int(row[at]), min(len(text), first + m + at)


@dataclass
class Index:
    """Postings of the q-grams of some items, sorted by hash."""

    texts: list[str]
    codes: list[np.ndarray]
    sizes: np.ndarray
    edits: np.ndarray
    hashes: np.ndarray
    first: np.ndarray
    item: np.ndarray
    place: np.ndarray
    slots: np.ndarray
    q: int
    #: Items without q-grams, and the most words that any of them has.
    short: dict[str, int]
    words: int


def build(texts: list[str], q: int = GRAM, rate: float = ERROR_RATE) -> Index:
    grams = [_grams(t, q) for t in texts]
    h = np.concatenate([*grams, np.zeros(0, np.uint64)])
    item = np.repeat(np.arange(len(texts)), [len(g) for g in grams]).astype(np.int64)
    place = np.concatenate([*(np.arange(len(g)) for g in grams), np.zeros(0, np.int64)]).astype(np.int64)
    order = np.argsort(h, kind="stable")
    hashes, first = np.unique(h[order], return_index=True)
    slots = np.zeros(1 << _SLOTS, bool)
    slots[(hashes >> np.uint64(64 - _SLOTS)).astype(np.int64)] = True
    sizes = np.array([len(t) for t in texts], np.int64)
    codes = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    edits = np.array([budget(m, q, rate) for m in sizes], np.int64)
    short = {t: i for i, t in enumerate(texts) if 0 < len(t) < q}
    words = max((t.count(" ") + 1 for t in short), default=0)
    return Index(texts, codes, sizes, edits, hashes, np.append(first, len(h)), item[order], place[order], slots, q, short, words)


def _find_short(text: str, index: Index) -> dict[int, tuple[int, int]]:
    """Short items that stand in a text as whole words."""
    found: dict[int, tuple[int, int]] = {}
    spaces = [-1, *(i for i, c in enumerate(text) if c == " "), len(text)] if index.words else []
    for n in range(1, index.words + 1):
        for a, b in zip(spaces, spaces[n:]):
            i = index.short.get(text[a + 1 : b]) if b - a <= index.q else None
            if i is not None:
                found.setdefault(i, (0, b))
    return found


def find(text: str, index: Index) -> list[tuple[int, int, int]]:
    """(item, edits, end) for each item in a normalised text; the end is in the normalised text."""
    found = _find_short(text, index)
    for i, told in _find_long(text, index).items():
        found[i] = told
    return [(i, e, end) for i, (e, end) in sorted(found.items())]


def _find_long(text: str, index: Index) -> dict[int, tuple[int, int]]:
    h = _grams(text, index.q)
    if not len(h) or not len(index.hashes):
        return {}
    at = np.flatnonzero(index.slots[(h >> np.uint64(64 - _SLOTS)).astype(np.int64)])
    k = np.searchsorted(index.hashes, h[at])
    k[k == len(index.hashes)] = 0
    real = index.hashes[k] == h[at]
    at, k = at[real], k[real]
    if not len(at):
        return {}
    found: dict[int, tuple[int, int]] = {}
    bands: list[np.ndarray] = []
    # In pieces, so that a long text that repeats a common q-gram stays bounded in memory.
    n = index.first[k + 1] - index.first[k]
    ends = np.cumsum(n)
    begin = 0
    while begin < len(at):
        stop = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + (1 << 21), "right")))
        some = n[begin:stop]
        post = np.repeat(index.first[k[begin:stop]], some) + np.arange(some.sum()) - np.repeat(np.cumsum(some) - some, some)
        item = index.item[post]
        diagonal = np.repeat(at[begin:stop], some) - index.place[post]
        band = np.floor_divide(diagonal, index.edits[item] + 1)
        for b in (band, band - 1):
            bands.append(np.stack(np.unique(item << 40 | (b + (1 << 38)), return_counts=True)))
        begin = stop
    keys = np.concatenate([b[0] for b in bands])
    unique, back = np.unique(keys, return_inverse=True)
    shared = np.bincount(back, np.concatenate([b[1] for b in bands]).astype(np.float64))
    item = unique >> 40
    least = np.maximum(1, index.sizes[item] + 1 - index.q * (index.edits[item] + 1))
    codes = None
    for key in unique[shared >= least].tolist():
        i, b = key >> 40, (key & ((1 << 40) - 1)) - (1 << 38)
        m, e = int(index.sizes[i]), int(index.edits[i])
        if i in found and found[i][0] == 0:
            continue
        first, width = b * (e + 1), 2 * (e + 1)
        exact = text.find(index.texts[i], max(0, first), max(0, first + width - 1 + m))
        if exact >= 0:
            found[i] = (0, exact + m)
            continue
        if codes is None:
            codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        told = align(index.codes[i], codes, first, width, e)
        if told and (i not in found or told[0] < found[i][0]):
            found[i] = told
    return found


@lru_cache(maxsize=PASS_PARTS)
def _index(texts: tuple[str, ...]) -> Index:
    return build(list(texts))


def _search(docs: DataFrame, text: str, by_text: dict[str, list], kind: str, name: str) -> DataFrame:
    items, ids = tuple(by_text), list(by_text.values())

    @F.pandas_udf(f"array<struct<item_id:{kind},edits:int,stop:int>>")
    def hits(texts: pd.Series) -> pd.Series:
        index = _index(items)
        return pd.Series([[{"item_id": x, "edits": e, "stop": s} for i, e, s in find(normal(t), index) for x in ids[i]] for t in texts], dtype=object)

    return docs.withColumn(name, hits(F.col(text)))


def contaminated(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", hits: str = "hits", part_chars: int = PART_CHARS
) -> DataFrame:
    """``docs`` and last ``hits``: the items that a document holds, their edits and where in the normalised text they end.

    Where that name is taken, the column gets an underscore more.
    """
    hits = fresh(hits, docs.columns)
    items = benchmark.select(F.col(item_id).alias("id"), F.col(item_text).alias("t")).where("t IS NOT NULL")
    chars = items.agg(F.sum(F.length("t").cast("long"))).first()[0] or 0
    parts = max(1, math.ceil(chars / part_chars))
    kind = benchmark.schema[item_id].dataType.simpleString()
    empty = F.array().cast(f"array<struct<item_id:{kind},edits:int,stop:int>>")
    out, names = docs.withColumn(hits, empty), []
    for p in range(parts):
        some = items.where(F.pmod(F.xxhash64("t"), F.lit(parts)) == p).distinct().orderBy("id", "t").collect()
        by_text: dict[str, list] = {}
        for r in some:
            if (t := normal(r.t)) and r.id not in (known := by_text.setdefault(t, [])):
                known.append(r.id)
        if by_text:
            names.append(fresh(f"_{hits}_{p}", out.columns))
            out = _search(out, text, by_text, kind, names[-1])
        if len(names) == PASS_PARTS or p == parts - 1:
            out = out.withColumn(hits, F.concat(hits, *names)).drop(*names)
            names = []
            if p < parts - 1:
                out = cut(out, "decontaminate-pass")
    return out


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document, the benchmark items that it holds."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = contaminated(docs, table(spark, sf_dir, "benchmark"))
    ids = F.array_sort(F.array_distinct(F.transform("hits", lambda x: x["item_id"])))
    return out.select(
        "doc_id",
        F.size(ids).cast("long").alias("n_items"),
        F.array_join(F.transform(ids, lambda i: i.cast("string")), ",").alias("items"),
        (F.size("hits") > 0).alias("contaminated"),
    )
