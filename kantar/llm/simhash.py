"""SimHash near-duplicates by a self-join of binary tries.

A fingerprint has a bit set where over half of the document's shingle hashes
(XXH64, seed 42) have it set. Fingerprints that differ in at most ``BUDGET``
bits are linked.

Equal fingerprints collapse to one first. The 64 bits are four blocks of 16; two
fingerprints within three bits agree on a block at least. So four tries are
walked, each over the bits rotated to let one block lead, and only node pairs
that agree on the leading block are opened. From there the pair of nodes
descends together, bit by bit; the bits in which the two paths differ add up and
a pair beyond the budget is dropped with all below it. Node pairs are dealt to
tasks by key; one that holds more than ``NODE_ROWS`` fingerprints is opened
into pairs of its children eight bits deeper, as often as needed, so no task
gathers an unbounded node.

Links leave a node pair as stars to the least fingerprint of each local
component, never as all pairs; the components over all nodes follow in Spark.

Defined results: a null text counts as empty; a text without words has the
fingerprint zero and is linked like any other; one of fewer words than a shingle
has its whole sequence as the one shingle. Repeated rows and rows that share a
document id each give a row. A null document id is kept, and takes part; a
component all of whose ids are null has a null id. Empty input gives no rows.
Columns other than the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kantar.llm.components import components
from kantar.llm.shared import cut, table, text_id

SEED = 42
BUDGET = 3
BLOCK = 16
TRIES = 4
#: Fingerprints of one node pair that a task walks at once.
NODE_ROWS = 50_000
#: Node pairs with at most so many fingerprint pairs are compared directly.
LEAF_PAIRS = 1024
#: Fingerprint pairs that are laid out at once.
BLOCK_PAIRS = 1 << 21


def fingerprint(text: str | None, words: int = 3) -> int:
    """The 64-bit fingerprint of one text."""
    # bytes.lower and bytes.split know ASCII only: A-Z, and space with 09-0D.
    parts = (text or "").encode("utf-8", "replace").lower().split()
    if not parts:
        return 0
    if len(parts) < words:
        starts, ends = [0], [sum(map(len, parts)) + len(parts) - 1]
    else:
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        begin = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
        starts = begin[: len(parts) - words + 1].tolist()
        ends = (begin + sizes)[words - 1 :].tolist()
    joined = b" ".join(parts)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts, ends)), np.uint64, len(starts))
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        octets = hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(octets, axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str, text: str, words: int) -> DataFrame:
    """(id, fp): fp is the fingerprint as a signed long."""

    @F.pandas_udf("long")
    def printed(texts: pd.Series) -> pd.Series:
        return pd.Series(np.fromiter((fingerprint(t, words) for t in texts), np.uint64, len(texts)).view(np.int64))

    return docs.select(F.col(id_col).alias("id"), printed(F.col(text)).alias("fp"))


def _merge(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the components of i and j; a label ends as the least index of its component."""
    while True:
        a, b = labels[i], labels[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels[:] = up


def _spread(keys: np.ndarray, labels: np.ndarray, pair: np.ndarray, budget: int, rest: np.ndarray | None, whole: int) -> None:
    """Compare what one node pair holds, a fingerprint at a time with those not reached yet.

    The components are those of all pairs; rows of a node of near copies are
    reached in few rounds, and the memory is that of the node.
    """
    a, b = np.arange(pair[0], pair[1]), np.arange(pair[2], pair[3])
    own = pair[0] == pair[2]
    # By side: rows not reached yet. A node paired with itself has one side.
    left = [a] if own else [a, b]
    while len(left[0]) and len(left[-1]):
        queue = [(0, left[0][:1])]
        left[0] = left[0][1:]
        while queue:
            side, found = queue.pop()
            other = 0 if own else 1 - side
            for u in found:
                to = left[other]
                if not len(to):
                    break
                bits = np.bitwise_count(keys[to] ^ keys[u])
                near = bits <= budget
                if rest is not None:
                    fits = np.zeros(len(to), np.int64)
                    for word in range(rest.shape[1]):
                        fits += np.bitwise_count(rest[to, word] ^ rest[u, word])
                    near &= bits + fits <= whole
                if near.any():
                    left[other] = to[~near]
                    _merge(labels, np.full(int(near.sum()), u), to[near])
                    queue.append((other, to[near]))


def _compare(keys: np.ndarray, labels: np.ndarray, pairs: np.ndarray, budget: int, rest: np.ndarray | None, whole: int) -> None:
    """Compare directly what node pairs (a_lo, a_hi, b_lo, b_hi) hold.

    ``rest``: further words of each fingerprint; all bits may differ in ``whole`` places.
    """
    sizes = (pairs[:, 1] - pairs[:, 0]) * (pairs[:, 3] - pairs[:, 2])
    for pair in pairs[sizes > BLOCK_PAIRS]:
        _spread(keys, labels, pair, budget, rest, whole)
    pairs, sizes = pairs[sizes <= BLOCK_PAIRS], sizes[sizes <= BLOCK_PAIRS]
    total = np.cumsum(sizes)
    at = 0
    while at < len(pairs):
        done = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, done + BLOCK_PAIRS, "right")))
        some, n = pairs[at:to], sizes[at:to]
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        width = np.repeat(some[:, 3] - some[:, 2], n)
        i, j = np.repeat(some[:, 0], n) + k // width, np.repeat(some[:, 2], n) + k % width
        bits = np.bitwise_count(keys[i] ^ keys[j])
        near = (bits <= budget) & (i != j)
        i, j = i[near], j[near]
        if rest is not None:
            fits = bits[near] + np.bitwise_count(rest[i] ^ rest[j]).sum(1, dtype=np.int64) <= whole
            i, j = i[fits], j[fits]
        _merge(labels, i, j)
        at = to


def walk(
    keys: np.ndarray, nodes: np.ndarray, depth: int, budget: int = BUDGET, rest: np.ndarray | None = None, whole: int = 0
) -> np.ndarray:
    """Labels of the local components over node pairs.

    ``keys``: fingerprints, sorted within each node. ``nodes``: rows of a_lo,
    a_hi, b_lo, b_hi, bits that differ so far; a node paired with itself has
    equal ranges. All nodes are ``depth`` bits deep.
    """
    labels = np.arange(len(keys))
    front = nodes
    while len(front):
        sizes = (front[:, 1] - front[:, 0]) * (front[:, 3] - front[:, 2])
        own = front[:, 0] == front[:, 2]
        front, sizes = front[~(own & (sizes <= 1))], sizes[~(own & (sizes <= 1))]
        small = (sizes <= LEAF_PAIRS) | (depth == 64)
        if small.any():
            _compare(keys, labels, front[small, :4], budget, rest, whole)
        front = front[~small]
        if not len(front):
            break
        ones = np.concatenate(([0], np.cumsum((keys >> np.uint64(63 - depth)) & np.uint64(1)).astype(np.int64)))
        a_lo, a_hi, b_lo, b_hi, bits = front.T
        a_mid = a_hi - (ones[a_hi] - ones[a_lo])
        b_mid = b_hi - (ones[b_hi] - ones[b_lo])
        other = a_lo != b_lo
        front = np.concatenate(
            [
                np.stack([a_lo, a_mid, b_lo, b_mid, bits], 1),
                np.stack([a_mid, a_hi, b_mid, b_hi, bits], 1),
                np.stack([a_lo, a_mid, b_mid, b_hi, bits + 1], 1),
                np.stack([a_mid, a_hi, b_lo, b_mid, bits + 1], 1)[other],
            ]
        )
        front = front[(front[:, 0] < front[:, 1]) & (front[:, 2] < front[:, 3]) & (front[:, 4] <= budget)]
        depth += 1
    return labels


def _turn(keys: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Rotate left; ``left`` is a number of bits for each key."""
    left = left.astype(np.uint64)
    return np.where(left == 0, keys, (keys << left) | (keys >> ((np.uint64(64) - left) % np.uint64(64))))


def _local_links(depth: int, budget: int):
    def solve(part: pd.DataFrame) -> pd.DataFrame:
        trie = part["trie"].to_numpy(np.int64)
        keys = part["key"].to_numpy(np.int64).view(np.uint64)
        side = part["side"].to_numpy(np.int64)
        ids = part[["trie", "u", "v"]].to_numpy(np.int64)
        first = np.flatnonzero(np.concatenate(([True], (ids[1:] != ids[:-1]).any(1))))
        last = np.append(first[1:], len(part))
        # Sorted by node pair and side: side 0 comes first.
        mid = last - np.add.reduceat(side, first)
        own = ids[first, 1] == ids[first, 2]
        bits = np.bitwise_count((ids[first, 1] ^ ids[first, 2]).view(np.uint64)).astype(np.int64)
        nodes = np.stack([first, np.where(own, last, mid), np.where(own, first, mid), last, bits], 1)
        nodes = nodes[(nodes[:, 0] < nodes[:, 1]) & (nodes[:, 2] < nodes[:, 3])]
        labels = walk(keys, nodes, depth, budget)
        linked = np.flatnonzero(labels != np.arange(len(labels)))
        back = (64 - BLOCK * trie) % 64
        plain = _turn(keys, back).view(np.int64)
        return pd.DataFrame({"a": plain[linked], "b": plain[labels[linked]]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for batch in batches:
            held = batch if held is None else pd.concat([held, batch], ignore_index=True)
            ids = held[["trie", "u", "v"]].to_numpy(np.int64)
            edge = np.flatnonzero((ids != ids[-1]).any(1))
            cut_at = int(edge[-1]) + 1 if len(edge) else 0
            if cut_at >= NODE_ROWS:  # whole node pairs only; the last may go on in the next batch
                yield solve(held.iloc[:cut_at].reset_index(drop=True))
                held = held.iloc[cut_at:].reset_index(drop=True)
        if held is not None and len(held):
            yield solve(held)

    return run


STEP = 8


def _open(nodes: DataFrame, depth: int, budget: int) -> DataFrame:
    """Pairs of children, eight bits deeper, within the budget."""
    masks = F.array(*[F.lit(m).cast("long") for m in sorted(range(1 << STEP), key=int.bit_count) if m.bit_count() <= budget])
    child = F.shiftrightunsigned("key", 64 - depth - STEP).bitwiseAND(F.lit((1 << STEP) - 1))
    stepped = nodes.select(
        "trie", "key", "side", "u", "v", child.alias("child"), F.explode(masks).alias("mask")
    ).where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) + F.bit_count("mask") <= budget)
    mine = F.shiftleft(F.when(F.col("side") == 0, F.col("u")).otherwise(F.col("v")), STEP).bitwiseOR(F.col("child"))
    theirs = F.shiftleft(F.when(F.col("side") == 0, F.col("v")).otherwise(F.col("u")), STEP).bitwiseOR(
        F.col("child").bitwiseXOR(F.col("mask"))
    )
    same = F.col("u") == F.col("v")
    side = F.when(~same, F.col("side")).otherwise((mine > theirs).cast("int"))
    return stepped.select(
        "trie",
        "key",
        side.alias("side"),
        F.when(side == 0, mine).otherwise(theirs).alias("u"),
        F.when(side == 0, theirs).otherwise(mine).alias("v"),
    )


def trie_links(distinct: DataFrame, budget: int = BUDGET, node_rows: int = NODE_ROWS) -> DataFrame:
    """Star links (a, b) that join exactly the components of ``fp`` within ``budget`` bits.

    ``distinct`` has each fingerprint once in ``fp``. ``budget`` is 3 at most:
    beyond it, two fingerprints may agree on none of the four blocks.
    """
    if budget >= TRIES:
        raise ValueError("four leading blocks serve a budget of three bits")
    turned = [
        F.struct(
            F.lit(t).alias("trie"),
            (
                F.shiftleft("fp", BLOCK * t).bitwiseOR(F.shiftrightunsigned("fp", 64 - BLOCK * t)) if t else F.col("fp")
            ).alias("key"),
        )
        for t in range(TRIES)
    ]
    lead = F.shiftrightunsigned("key", 64 - BLOCK)
    nodes = (
        distinct.select(F.explode(F.array(*turned)).alias("x"))
        .select("x.trie", "x.key")
        .select("trie", "key", F.lit(0).alias("side"), lead.alias("u"), lead.alias("v"))
    )
    found, depth = None, BLOCK
    while True:
        large = nodes.groupBy("trie", "u", "v").count().where(F.col("count") > node_rows).select("trie", "u", "v")
        more = depth + STEP <= 64 and large.limit(1).count() > 0
        small = nodes.join(large, ["trie", "u", "v"], "left_anti") if more else nodes
        # The keys of one side share their leading bits, so signed order is bit order.
        ordered = small.repartition("trie", "u", "v").sortWithinPartitions("trie", "u", "v", "side", "key")
        links = ordered.mapInPandas(_local_links(depth, budget), "a long, b long")
        found = links if found is None else found.union(links)
        if not more:
            return found
        nodes = cut(_open(nodes.join(large, ["trie", "u", "v"], "left_semi"), depth, budget), "simhash-nodes")
        depth += STEP


def simhash_groups(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = 3, budget: int = BUDGET
) -> DataFrame:
    """(id_col, fp, component_id) for every row of ``docs``."""
    prints = cut(fingerprints(docs, id_col, text, words), "simhash-prints")
    distinct = prints.groupBy("fp").agg(F.min("id").alias("least"))
    roots = components(trie_links(distinct, budget), "simhash-links").select(F.col("a").alias("fp"), F.col("b").alias("root"))
    placed = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lowest = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = placed.join(lowest, "root").select("fp", "component_id")
    return prints.join(named, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


#: Words of a wide fingerprint: 512 bits estimate a similarity closely enough to decide by.
WIDE = 8
#: Bits that lead a trie of wide fingerprints, at least; more as there are more texts.
LEAST_LEAD = 12
#: Share of the pairs at the least similarity that must meet in a trie.
MEET = 0.99
#: Bytes of shingle sets that a task holds for one side of a candidate group.
SET_BYTES = 32 << 20


def shingles(text: str | None, words: int = 5) -> np.ndarray:
    """The set of shingle hashes in order; a text without words has the empty one alone."""
    parts = (text or "").encode("utf-8", "replace").lower().split()
    joined = b" ".join(parts)
    digest = xxhash.xxh64_intdigest
    if len(parts) < words:
        return np.array([digest(joined, SEED)], np.uint64)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    begin = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    starts, ends = begin[: len(parts) - words + 1].tolist(), (begin + sizes)[words - 1 :].tolist()
    return np.unique(np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts, ends)), np.uint64, len(starts)))


def wide_fingerprint(text: str | None, words: int = 5) -> np.ndarray:
    """The fingerprint of ``WIDE`` words: further hashes are derived from each shingle's XXH64."""
    if not (text or "").encode("utf-8", "replace").split():
        return np.zeros(WIDE, np.uint64)
    hashes = shingles(text, words)
    step = np.arange(WIDE, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    counts = np.zeros(64 * WIDE, np.int64)
    for at in range(0, len(hashes), 1 << 13):
        x = hashes[at : at + (1 << 13), None] + step
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        # uint8 sums of at most 255 rows are exact and quick.
        bits = np.unpackbits(x.view(np.uint8), axis=1)
        edges = np.arange(0, len(bits), 255)
        counts += np.add.reduceat(bits, edges, axis=0, dtype=np.uint8).sum(0, dtype=np.int64)
    return np.packbits(counts * 2 > len(hashes)).view(np.uint64)


def _differing(similarity: float) -> float:
    """The share of bits that differ between texts of this Jaccard similarity."""
    cosine = 2 * similarity / (1 + similarity)
    return float(np.arccos(cosine) / np.pi)


def _near_links(budget: int, whole: int):
    def solve(part: pd.DataFrame) -> pd.DataFrame:
        prints = np.frombuffer(b"".join(part["print"]), np.uint64).reshape(-1, WIDE)
        ids = part[["trie", "u", "v"]].to_numpy(np.int64)
        first = np.flatnonzero(np.concatenate(([True], (ids[1:] != ids[:-1]).any(1))))
        last = np.append(first[1:], len(part))
        mid = last - np.add.reduceat(part["side"].to_numpy(np.int64), first)
        own = mid == last
        nodes = np.stack([first, np.where(own, last, mid), np.where(own, first, mid), last, np.zeros(len(first), np.int64)], 1)
        nodes = nodes[(nodes[:, 0] < nodes[:, 1]) & (nodes[:, 2] < nodes[:, 3])]
        # The walk needs the first words in order within each side.
        key = prints[:, 0].byteswap()
        order = np.lexsort((key, part["side"].to_numpy(), np.repeat(np.arange(len(first)), last - first)))
        labels = walk(key[order], nodes, 0, budget, prints[order, 1:], whole)
        linked = np.flatnonzero(labels != np.arange(len(labels)))
        tids = part["tid"].to_numpy()[order]
        return pd.DataFrame({"a": tids[linked], "b": tids[labels[linked]]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for batch in batches:
            held = batch if held is None else pd.concat([held, batch], ignore_index=True)
            ids = held[["trie", "u", "v"]].to_numpy(np.int64)
            edge = np.flatnonzero((ids != ids[-1]).any(1))
            whole_rows = int(edge[-1]) + 1 if len(edge) else 0
            if whole_rows >= NODE_ROWS:
                yield solve(held.iloc[:whole_rows].reset_index(drop=True))
                held = held.iloc[whole_rows:].reset_index(drop=True)
        if held is not None and len(held):
            yield solve(held)

    return run


def similar(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """Labels of the components of texts linked by an exact Jaccard similarity of ``similarity`` at least.

    A text of the given size shares one of its rarest shingles with each text so
    similar (the prefix filter), so only those are counted through. Texts already
    reached are not compared again: a group of near copies takes few rounds.
    """
    labels, sizes = np.arange(len(sets)), np.array([len(x) for x in sets])
    least = np.ceil(similarity * sizes - 1e-9).astype(np.int64)
    _, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(counts), np.int64)
    rank[np.argsort(counts, kind="stable")] = np.arange(len(counts))
    ranked = [np.sort(x) for x in np.split(rank[inverse], np.cumsum(sizes)[:-1])]
    prefix = [x[: n - m + 1] for x, n, m in zip(ranked, sizes, least)]
    owners = np.repeat(np.arange(len(sets)), [len(x) for x in prefix])
    tokens = np.concatenate(prefix)
    order = np.argsort(tokens, kind="stable")
    held, edge = np.unique(tokens[order], return_index=True)
    postings = dict(zip(held.tolist(), np.split(owners[order], edge[1:])))
    open_ = np.ones(len(sets), bool)
    for start in range(len(sets)):
        if not open_[start]:
            continue
        open_[start] = False
        queue = [start]
        while queue:
            u = queue.pop()
            lists = []
            for t in prefix[u].tolist():
                postings[t] = left = postings[t][open_[postings[t]]]
                lists.append(left)
            for v in np.unique(np.concatenate(lists)).tolist():
                if min(sizes[u], sizes[v]) < similarity * max(sizes[u], sizes[v]) - 1e-9:
                    continue
                both = len(np.intersect1d(ranked[u], ranked[v], assume_unique=True))
                if both >= similarity * (sizes[u] + sizes[v] - both) - 1e-9:
                    open_[v], labels[v] = False, start
                    queue.append(v)
    return labels


def _similar_links(similarity: float):
    def solve(tids: list[bytes], sets: list[bytes]) -> tuple[list[bytes], list[bytes]]:
        labels = similar([np.frombuffer(x, np.uint64) for x in sets], similarity)
        linked = np.flatnonzero(labels != np.arange(len(labels))).tolist()
        return [tids[k] for k in linked], [tids[labels[k]] for k in linked]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, tids, sets = None, [], []
        for batch in batches:
            a, b = [], []
            for *now, tid, held in zip(batch["root"], batch["lo"], batch["hi"], batch["tid"], batch["held"]):
                if now != key and tids:
                    for out, more in zip((a, b), solve(tids, sets)):
                        out += more
                    tids, sets = [], []
                key = now
                tids.append(tid)
                sets.append(held)
            yield pd.DataFrame({"a": a, "b": b})
        if tids:
            yield pd.DataFrame(dict(zip("ab", solve(tids, sets))))

    return run


def _verify(texts: DataFrame, roots: DataFrame, words: int, similarity: float, set_bytes: int) -> DataFrame:
    """(tid, root): the groups that hold by exact similarity, within the candidate groups ``roots``."""

    @F.pandas_udf("binary")
    def held(rows: pd.Series) -> pd.Series:
        return pd.Series([shingles(t, words).tobytes() for t in rows], dtype=object)

    members = roots.unionByName(roots.select(F.col("root").alias("tid"), "root").distinct())
    found = texts.join(members, "tid").groupBy("tid").agg(F.first("text").alias("text"), F.first("root").alias("root"))
    found = cut(found.select("tid", "root", held("text").alias("held")), "near-sets")
    large = cut(found.groupBy("root").agg(F.sum(F.length("held")).alias("bytes")).where(F.col("bytes") > set_bytes), "near-large-sets")
    more = large.limit(1).count() > 0
    if more:  # pairs of slices, each pair in a task
        found = found.join(large, "root", "left").withColumn("n", F.coalesce(F.ceil(F.col("bytes") / set_bytes), F.lit(1)))
        mine = F.pmod(F.xxhash64("tid"), F.col("n"))
        found = found.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
        found = found.select("tid", "root", "held", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"))
    else:
        found = found.select("tid", "root", "held", F.lit(0).cast("long").alias("lo"), F.lit(0).cast("long").alias("hi"))
    met = found.repartition("root", "lo", "hi").sortWithinPartitions("root", "lo", "hi", "tid")
    links = met.mapInPandas(_similar_links(similarity), "a binary, b binary")
    # Rows are sorted, so each label is the least text of its component.
    links = components(links, "near-true-links") if more else cut(links, "near-true-links")
    return links.select(F.col("a").alias("tid"), F.col("b").alias("root"))


def near_groups(
    docs: DataFrame, text: str = "text", words: int = 5, similarity: float = 0.8, node_rows: int = NODE_ROWS, set_bytes: int = SET_BYTES
) -> DataFrame:
    """(tid, root): for every text that has near duplicates, its group. ``tid`` is ``text_id`` of the text.

    Three of 64 bits are far less than what texts of a Jaccard similarity of 0.8
    differ in, so this form has 512 bits. Each trie is led by bits drawn from all
    of them, in numbers that let a pair at the least similarity meet in one trie
    at least with the probability ``MEET``; node pairs then descend the first
    64 bits, and what the budget leaves is compared over all bits. The budgets
    lie three standard deviations above what the least similarity makes differ. A
    node of more than ``node_rows`` texts is dealt out as pairs of slices.

    That gives candidates only. Within each group of them the texts are linked by
    the exact Jaccard similarity of their shingle sets (64-bit hashes), and only
    those links make the groups. A group of over ``set_bytes`` of shingles is dealt
    out as pairs of slices.
    """
    texts = docs.select(text_id(F.col(text)).alias("tid"), F.col(text).alias("text"))

    @F.pandas_udf("binary")
    def printed(rows: pd.Series) -> pd.Series:
        return pd.Series([wide_fingerprint(t, words).tobytes() for t in rows], dtype=object)

    prints = cut(texts.select("tid", printed("text").alias("print")).groupBy("tid").agg(F.first("print").alias("print")), "near-prints")
    p, n = _differing(similarity), prints.count()
    lead = max(LEAST_LEAD, int(np.ceil(np.log2(max(1, n) / 64))))
    tries = int(np.ceil(np.log(1 - MEET) / np.log(1 - (1 - p) ** lead)))
    budget = int(64 * p + 3 * np.sqrt(64 * p * (1 - p)))
    whole = int(64 * WIDE * p + 3 * np.sqrt(64 * WIDE * p * (1 - p)))
    rng = np.random.default_rng(SEED)
    picks = np.stack([rng.choice(64 * WIDE, lead, replace=False) for _ in range(tries)])
    weights = (1 << np.arange(lead, dtype=np.int64))[::-1]

    @F.pandas_udf("array<long>")
    def leads(rows: pd.Series) -> pd.Series:
        bits = np.unpackbits(np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -1), axis=1)
        return pd.Series(list((bits[:, picks].astype(np.int64) * weights).sum(2)))

    nodes = prints.select("tid", "print", F.posexplode(leads("print")).alias("trie", "lead"))
    large = cut(nodes.groupBy("trie", "lead").count().where(F.col("count") > node_rows), "near-large")
    if large.limit(1).count():
        slices = F.ceil(F.col("count") / node_rows)
        dealt = nodes.join(large, ["trie", "lead"], "left").withColumn("n", F.coalesce(slices, F.lit(1)))
        mine = F.pmod(F.xxhash64("tid"), F.col("n"))
        dealt = dealt.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
        u = F.struct("lead", F.least("mine", "other").alias("s"))
        nodes = dealt.select(
            "tid", "print", "trie", F.xxhash64(u).alias("u"), F.greatest("mine", "other").alias("v"), (F.col("mine") > F.col("other")).cast("int").alias("side")
        )
    else:
        nodes = nodes.select("tid", "print", "trie", F.col("lead").alias("u"), F.lit(0).cast("long").alias("v"), F.lit(0).alias("side"))
    met = nodes.repartition("trie", "u", "v").sortWithinPartitions("trie", "u", "v", "side")
    links = met.mapInPandas(_near_links(budget, whole), "a binary, b binary")
    roots = components(links, "near-links").select(F.col("a").alias("tid"), F.col("b").alias("root"))
    roots = _verify(texts, roots, words, similarity, set_bytes)
    return roots.unionByName(roots.select(F.col("root").alias("tid"), "root").distinct())


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of each group of near duplicates, copies and repeated rows: the one of least id, nulls last.

    Ties of the id go to the least text id. The columns are those of ``docs``.
    """
    groups = near_groups(docs, text, words, similarity)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(row.alias("row"), F.col(id_col).alias("id"), text_id(F.col(text)).alias("tid"))
    placed = rows.join(groups, "tid", "left").withColumn("root", F.coalesce("root", "tid"))
    kept = placed.groupBy("root").agg(F.min_by("row", F.struct(F.col("id").isNull(), "id", "tid")).alias("row"))
    return kept.select("row.*")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_groups(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
