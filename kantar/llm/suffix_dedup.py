"""Exact removal of repeated byte strings by external induced suffix sorting.

Every string of ``WIDTH`` bytes that starts at two places at least is covered
wherever it occurs. The suffixes of a corpus are far too many to sort one by
one; as in induced sorting, few are sorted and the others follow from them:

1. *Sample.* The leftmost least k-gram hash of a string's first ``FLOOR`` bytes is
   its anchor. Equal strings have equal anchors at equal places, so strings are
   compared only with strings of their anchor. Strings that start in one run
   [lo, hi] and share an anchor form a segment. Segments are named by a digest of
   their bytes.
2. *Reduce.* Names are counted with map-side combining. An anchor that occurs
   once repeats nothing; a name that occurs twice repeats all of its strings.
   Only anchors with different names (the edges of repeats) go on to sorting.
3. *Recurse.* An anchor with more than ``MOST_NAMES`` names is divided: offsets
   from the anchor are halved, and within a half all strings share a longer core,
   which takes the place of the anchor. Cells that occur once drop out, large
   ones are halved again. In a cell of one offset the core is the string itself.
4. *Sort and induce.* The suffixes at anchors are sorted by Spark's external
   sorter, which spills to disk; the common prefix of neighbours is taken from the
   bytes. Then the order moves left one byte at a time: suffixes that agree on
   the preceding byte keep their order, and the common prefix of new neighbours is
   the least over the range between them, plus one. A string repeats where the
   prefix shared with a neighbour reaches ``WIDTH``.

So no task holds more than ``MOST_NAMES`` suffixes of an anchor, however often it
occurs, and the result does not depend on that bound.

Since anchors are taken from the first ``FLOOR`` bytes, shorter repeats (of
``FLOOR`` bytes or more) are met on the way. They are not removed; a text that
has any is marked as one that repeats.

Texts are addressed by digest, so copies (and repeated rows, and null ids) share
one result; a text of two rows or more is repeated as a whole.

Defined results: a null text is empty; texts shorter than ``WIDTH`` bytes keep
all bytes; empty input gives no rows; columns other than the id and text are not
read. Texts of any length are walked in pieces of ``PIECE`` starts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kantar.llm.shared import among, cut, table, text_id

WIDTH = 400
FLOOR = 256
GRAM = 32
PIECE = 1 << 20
#: Suffixes of one anchor that are sorted and induced together.
MOST_NAMES = 20_000
#: Rows that the induction holds at once, but for a single larger anchor.
SORT_ROWS = 20_000

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _BACK)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def _grams(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the k-gram at each place."""
    powers, back = _tables(len(data))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers, dtype=np.uint64)))
    h = (sums[GRAM:] - sums[:-GRAM]) * back[: len(data) - GRAM + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def segments(data: bytes, floor: int = FLOOR) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Piece by piece: lo, hi, anchor place and anchor hash of the segments of ``floor``-byte windows."""
    whole = np.frombuffer(data, np.uint8)
    for base in range(0, len(whole) - floor + 1, PIECE):
        some = whole[base : base + PIECE + floor - 1]
        h = _grams(some)
        least = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
        span, size = floor - GRAM + 1, 1
        while size * 2 <= span:  # the least over twice as many places each time
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        if span > size:
            least = np.minimum(least[: len(least) - (span - size)], least[span - size :])
        place = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
        lo = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        hi = np.append(lo[1:], len(place)) - 1
        at = place[lo]
        yield lo + base, hi + base, at + base, h[at].view(np.int64)


def _raw(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


SEGMENT = "tid binary, lo int, hi int, at int, stop int, anchor long, name long"


def _find_segments(width: int, floor: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        digest = hashlib.blake2b
        for batch in batches:
            for tid, text in zip(batch["tid"], batch["text"]):
                data = _raw(text)
                for lo, hi, at, anchor in segments(data, floor):
                    stop = np.minimum(hi + width, len(data))
                    # The place of the anchor is named too: contexts cut short by the text's end may be alike but for it.
                    # With the anchor's own 64 bits a name is as good as one of 128.
                    named = b"".join(digest(data[a:b], digest_size=8, salt=k.to_bytes(2, "big")).digest() for a, b, k in zip(lo.tolist(), stop.tolist(), (at - lo).tolist()))
                    names = np.frombuffer(named, np.int64)
                    yield pd.DataFrame(
                        {
                            "tid": [tid] * len(lo), "lo": lo.astype(np.int32), "hi": hi.astype(np.int32), "at": at.astype(np.int32),
                            "stop": stop.astype(np.int32), "anchor": anchor, "name": names,
                        }
                    )

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, rows = [], 0
        for part in run(batches):
            held.append(part)
            rows += len(part)
            if rows >= 20_000:
                yield pd.concat(held, ignore_index=True)
                held, rows = [], 0
        if held:
            yield pd.concat(held, ignore_index=True)

    return packed


SUFFIX = "tid binary, lo int, hi int, at int, anchor long, before binary, suffix binary"


def _cut_suffixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for tid, text, wanted in zip(batch["tid"], batch["text"], batch["wanted"]):
            data = _raw(text)
            for w in wanted:
                lo, at = w["lo"], w["at"]
                out.append((tid, lo, w["hi"], at, w["anchor"], data[lo:at], data[at : w["stop"]]))
        yield pd.DataFrame(out, columns=["tid", "lo", "hi", "at", "anchor", "before", "suffix"])


def _halves(size: int, width: int, floor: int):
    """Suffix tuples dealt to cells of ``size`` offsets; the core that a cell's strings share becomes the anchor.

    Offset i is the string that starts i bytes before the anchor. Its window covers
    the core of its cell, so equal strings are in cells of equal cores.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for tid, lo, hi, at, anchor, before, suffix in zip(*(batch[c] for c in ("tid", "lo", "hi", "at", "anchor", "before", "suffix"))):
                data, zero = before + suffix, at - lo
                for cell in range((at - hi) // size, zero // size + 1):
                    near, far = cell * size, cell * size + size - 1
                    core = data[zero - near : zero - far + floor]
                    key = hashlib.blake2b(anchor.to_bytes(8, "big", signed=True) + near.to_bytes(2, "big") + core, digest_size=8)
                    first, last = max(lo, at - far), min(hi, at - near)
                    out.append((tid, first, last, at, int.from_bytes(key.digest(), "big", signed=True), data[first - lo : zero], suffix[: last + width - at]))
            yield pd.DataFrame(out, columns=["tid", "lo", "hi", "at", "anchor", "before", "suffix"])

    return run


def _matrix(rows: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter((min(len(r), width) for r in rows), np.int64, len(rows))
    flat = np.frombuffer(b"".join(r[:width].ljust(width, b"\0") for r in rows), np.uint8)
    return flat.reshape(len(rows), width), sizes


def _least_between(values: np.ndarray, after: np.ndarray, upto: np.ndarray) -> np.ndarray:
    """min(values[after + 1 .. upto]) for each pair, by a table over powers of two."""
    size = upto - after
    level = np.frexp(size.astype(np.float64))[1] - 1
    out = np.empty(len(size), values.dtype)
    now = values
    for k in range(int(level.max(initial=0)) + 1):
        here = level == k
        if here.any():
            out[here] = np.minimum(now[after[here] + 1], now[upto[here] - (1 << k) + 1])
        if len(now) > (1 << k):
            now = np.minimum(now[: -(1 << k)], now[1 << k :])
    return out


def induce(anchor: np.ndarray, before: list[bytes], suffix: list[bytes], free: np.ndarray, width: int = WIDTH, floor: int = FLOOR) -> tuple[np.ndarray, np.ndarray]:
    """(marks, repeats): marks[r, i] says whether the ``width`` bytes that start i bytes before anchor r
    start elsewhere too, repeats[r] whether ``floor`` bytes from any such start do.

    Rows are sorted by anchor, then suffix. ``free``: the least i that belongs to
    the segment of the row.
    """
    reach = floor - GRAM
    right, right_size = _matrix(suffix, width)
    left, left_size = _matrix([b[::-1] for b in before], reach)
    marks, repeats = np.zeros((len(anchor), reach + 1), bool), np.zeros(len(anchor), bool)
    differ = right[1:] != right[:-1]
    first = np.where(differ.any(1), differ.argmax(1), width)
    lcp = np.concatenate(([-1], np.minimum(first, np.minimum(right_size[1:], right_size[:-1]))))
    lcp[1:][anchor[1:] != anchor[:-1]] = -1
    live = np.arange(len(anchor))
    for i in range(reach + 1):
        best = np.maximum(lcp, np.append(lcp[1:], -1))
        own = free[live] <= i
        marks[live[own & (best >= width - i)], i] = True
        repeats[live[own & (best >= floor - i)]] = True
        room = left_size[live]
        keep = np.flatnonzero((room > i) & (best + room >= floor))
        if len(keep) < 2:
            break
        if len(keep) < len(live):
            lcp = np.minimum.reduceat(lcp[: keep[-1] + 1], np.concatenate(([0], keep[:-1] + 1)))
            lcp[0] = -1
            live = live[keep]
        # Prepend a byte: stable within a class, so the order of the suffixes holds.
        group = np.cumsum(lcp < 0) * 256 + left[live, i]
        order = np.argsort(group, kind="stable")
        group = group[order]
        same = np.flatnonzero(group[1:] == group[:-1])
        moved = np.full(len(live), -1, lcp.dtype)
        if len(same):
            moved[same + 1] = _least_between(lcp, order[same], order[same + 1])
        lcp, live = moved, live[order]
    return marks, repeats


#: An empty range stands for a repeat of less than the width.
SPAN = "tid binary, start int, stop int"


def _induced_spans(width: int, floor: int):
    def solve(part: pd.DataFrame) -> pd.DataFrame:
        at, lo = part["at"].to_numpy(np.int64), part["lo"].to_numpy(np.int64)
        marks, repeats = induce(
            part["anchor"].to_numpy(np.int64), part["before"].tolist(), part["suffix"].tolist(), at - part["hi"].to_numpy(np.int64), width, floor
        )
        edge = np.diff(np.pad(marks, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        row, begin = np.nonzero(edge == 1)
        _, end = np.nonzero(edge == -1)
        # i counts leftwards: the run begin..end-1 starts at at-end+1 and its last string at at-begin.
        tid, only = part["tid"].to_numpy(), np.flatnonzero(repeats & ~marks.any(1))
        none = np.zeros(len(only), np.int64)
        return pd.DataFrame(
            {
                "tid": np.concatenate((tid[row], tid[only])),
                "start": np.concatenate((at[row] - end + 1, none)).astype(np.int32),
                "stop": np.concatenate((at[row] - begin + width, none)).astype(np.int32),
            }
        )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for batch in batches:
            held = batch if held is None else pd.concat([held, batch], ignore_index=True)
            anchor = held["anchor"].to_numpy()
            edge = np.flatnonzero(anchor != anchor[-1])
            whole = int(edge[-1]) + 1 if len(edge) else 0
            if whole >= SORT_ROWS:
                yield solve(held.iloc[:whole].reset_index(drop=True))
                held = held.iloc[whole:].reset_index(drop=True)
        if held is not None and len(held):
            yield solve(held)

    return run


def _divided(hot: DataFrame, width: int, floor: int, most: int) -> tuple[list[DataFrame], DataFrame | None]:
    """Suffix tuples of crowded anchors in cells of at most ``most`` tuples, and spans of those that no cell divides."""
    small, size = [], 1 << (floor - GRAM).bit_length() - 1
    while size:
        cells = cut(hot.mapInPandas(_halves(size, width, floor), SUFFIX), f"suffix-cells-{size}")
        count = cut(cells.groupBy("anchor").count().where(F.col("count") > 1), "suffix-cell-sizes")
        small.append(among(cells, count.where(F.col("count") <= most), ["anchor"], "count"))
        if count.where(F.col("count") > most).limit(1).count() == 0:
            return small, None
        hot, size = among(cells, count.where(F.col("count") > most), ["anchor"], "count"), size // 2
    # Cells of one offset: all strings of a cell have the same first bytes, and what follows tells them apart.
    string = F.substring(F.concat("before", "suffix"), 1, width)
    named = cut(hot.select("tid", F.col("lo").alias("start"), "anchor", F.octet_length(string).alias("size"), F.sha2(string, 256).alias("name")), "suffix-same")
    again = cut(named.where(F.col("size") == width).groupBy("anchor", "name").count().where(F.col("count") > 1), "suffix-again")
    found = among(named.where(F.col("size") == width), again, ["anchor", "name"], "count").select("tid", "start", (F.col("start") + width).alias("stop"))
    return small, found.unionByName(named.select("tid", F.lit(0).alias("start"), F.lit(0).alias("stop")))


def _once(docs: DataFrame, text: str, floor: int) -> DataFrame:
    """(tid, text): each text of ``floor`` bytes or more once, dealt by tid. Wherever a query needs it, it is shuffled once."""
    texts = docs.select(text_id(F.col(text)).alias("tid"), F.col(text).alias("text"))
    return texts.where(F.octet_length("text") >= floor).groupBy("tid").agg(F.min("text").alias("text"))


def repeated_spans(docs: DataFrame, text: str = "text", width: int = WIDTH, floor: int = FLOOR, most: int = MOST_NAMES) -> DataFrame:
    """(tid, spans): for each text that repeats ``floor`` bytes, its covered [start, stop) byte ranges.

    Ranges are of strings of ``width`` bytes; they may overlap, and there may be
    none. ``tid`` is ``text_id`` of the text.
    """
    if not GRAM <= floor <= width:
        raise ValueError("the floor lies between the length of a gram and the width")
    texts = docs.select(text_id(F.col(text)).alias("tid"), F.col(text).alias("text"))
    copied = (
        texts.select("tid", F.octet_length("text").alias("size"))
        .groupBy("tid")
        .agg(F.count("*").alias("n"), F.first("size").alias("size"))
        .where((F.col("n") > 1) & (F.col("size") >= floor))
        .select("tid", F.lit(0).alias("start"), F.when(F.col("size") >= width, F.col("size")).otherwise(0).alias("stop"))
    )
    long = texts.where(F.octet_length("text") >= floor)
    found = cut(long.mapInPandas(_find_segments(width, floor), SEGMENT), "suffix-segments")
    # Counts are written before they are joined, so that adaptive execution can split the rows of a hot key.
    busy = cut(found.groupBy("anchor").count().where(F.col("count") > 1), "suffix-busy")
    shared = cut(among(found, busy, ["anchor"], "count"), "suffix-shared")
    named = cut(
        shared.groupBy("anchor", "name").agg(F.count("*").alias("n"), F.min(F.struct("tid", "lo", "hi", "at", "stop")).alias("one")),
        "suffix-names",
    )
    whole = among(shared, named.where("n > 1").select("anchor", "name", "n"), ["anchor", "name"], "n")
    whole = whole.select("tid", F.col("lo").alias("start"), F.when(F.col("stop") - F.col("lo") >= width, F.col("stop")).otherwise(F.col("lo")).alias("stop"))
    kinds = cut(named.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1"), "suffix-kinds")
    once = _once(docs, text, floor)
    edges = named.join(kinds, "anchor").select(
        "one.tid", F.struct("one.lo", "one.hi", "one.at", "one.stop", "anchor").alias("w"), (F.col("kinds") > most).alias("crowded")
    )

    def tuples(of: DataFrame) -> DataFrame:
        return once.join(of.groupBy("tid").agg(F.collect_list("w").alias("wanted")), "tid").mapInPandas(_cut_suffixes, SUFFIX)

    sorting, spans = tuples(edges.where("not crowded")), copied.union(whole)
    if kinds.where(F.col("kinds") > most).limit(1).count():
        small, same = _divided(cut(tuples(edges.where("crowded")), "suffix-tuples"), width, floor, most)
        for part in small:
            sorting = sorting.unionByName(part)
        spans = spans if same is None else spans.union(same)
    induced = sorting.repartition("anchor").sortWithinPartitions("anchor", "suffix").mapInPandas(_induced_spans(width, floor), SPAN)
    return spans.union(induced).groupBy("tid").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))


def merged(spans: np.ndarray) -> np.ndarray:
    """Sorted, disjoint and not even touching ranges that cover the same places."""
    if not len(spans):
        return spans.reshape(0, 2)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    far = np.maximum.accumulate(spans[:, 1])
    first = np.flatnonzero(np.concatenate(([True], spans[1:, 0] > far[:-1])))
    return np.stack([spans[first, 0], far[np.append(first[1:], len(spans)) - 1]], 1)


APPLIED = "n_bytes long, n_removed long, kept binary, removed array<struct<start:int,stop:int>>, repeats boolean"


def _apply(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
    out = []
    for text, found in zip(texts, spans):
        data = _raw(text)
        places = [] if found is None else [(s["start"], s["stop"]) for s in found if s["start"] < s["stop"]]
        runs = merged(np.array(places, np.int64).reshape(-1, 2))
        kept, at = [], 0
        for start, stop in runs.tolist():
            kept.append(data[at:start])
            at = stop
        kept.append(data[at:])
        gone = [{"start": a, "stop": b} for a, b in runs.tolist()]
        out.append((len(data), int((runs[:, 1] - runs[:, 0]).sum()), b"".join(kept), gone, found is not None))
    return pd.DataFrame(out, columns=["n_bytes", "n_removed", "kept", "removed", "repeats"])


def dedup_substrings(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = WIDTH, floor: int = FLOOR, most: int = MOST_NAMES
) -> DataFrame:
    """(id_col, n_bytes, n_removed, kept, removed, repeats) for every row.

    ``kept`` holds the remaining bytes, ``removed`` the removed ranges in order;
    ``repeats`` says whether ``floor`` bytes of the text start elsewhere too, even
    if they are too few to be removed.
    """
    applied = F.pandas_udf(_apply, APPLIED)
    short = F.coalesce(F.octet_length(F.col(text)), F.lit(0)) < floor
    none = F.lit(None).cast("array<struct<start:int,stop:int>>")
    kept = docs.where(short).select(F.col(id_col).alias("id"), applied(F.col(text), none).alias("x"))
    # The ids of the rows come to the texts and their spans, which lie by tid already, so texts don't move again.
    held = _once(docs, text, floor).join(repeated_spans(docs, text, width, floor, most), "tid", "left")
    rows = docs.where(~short).select(F.col(id_col).alias("id"), text_id(F.col(text)).alias("tid"))
    cut_out = rows.join(held, "tid").select("id", applied("text", "spans").alias("x"))
    return kept.unionByName(cut_out).select(F.col("id").alias(id_col), "x.*")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_substrings(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id",
        "n_bytes",
        "n_removed",
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
        (F.col("n_removed") > 0).alias("touched"),
        "repeats",
    )
