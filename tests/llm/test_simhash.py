from __future__ import annotations

import random
import tracemalloc

import numpy as np
import pytest
import xxhash

from kantar.llm import simhash
from kantar.llm.components import components


def brute_print(text, words=3):
    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    grams = [b" ".join(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_groups(prints):
    """Least index reachable, for each."""
    label = list(range(len(prints)))
    todo = True
    while todo:
        todo = False
        for i in range(len(prints)):
            for j in range(i):
                if (prints[i] ^ prints[j]).bit_count() <= 3 and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    todo = True
    return label


def test_fingerprint_equals_the_definition():
    for text in [None, "", " \t\n", "One", "one two", "a b c", "a b c a b c a b c", "ÄÖ ü ß x é\x0b\x0cT  q", "x " * 500]:
        assert simhash.fingerprint(text) == brute_print(text)
        assert simhash.fingerprint(text, 5) == brute_print(text, 5)


def _near(rng, n_groups, members, flips):
    out = []
    for _ in range(n_groups):
        base = rng.getrandbits(64)
        for _ in range(members):
            x = base
            for _ in range(rng.randint(0, flips)):
                x ^= 1 << rng.randrange(64)
            out.append(x)
    return out


@pytest.mark.parametrize("node_rows", [simhash.NODE_ROWS, 3])
def test_trie_links_equal_brute_force(spark, node_rows):
    rng = random.Random(5)
    prints = sorted(set(_near(rng, 25, 6, 4) + [rng.getrandbits(64) for _ in range(100)] + [0, 1, 2**63, 2**64 - 1]))
    prints += [p ^ 0b111 for p in prints[:10] if p ^ 0b111 not in prints]
    signed = [int(np.uint64(p).astype(np.int64)) for p in prints]
    df = spark.createDataFrame([(s,) for s in signed], "fp long")
    got = {r.a: r.b for r in components(simhash.trie_links(df, node_rows=node_rows)).collect()}
    label = brute_groups(prints)
    groups = {}
    for s, g in zip(signed, label):
        groups.setdefault(g, set()).add(s)
    found = {}
    for s in signed:
        found.setdefault(got.get(s, s), set()).add(s)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, found.values()))


def test_edge_rows(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, "same words here now", None), (3, "same words here now", None), (None, "same words here now", "x")]
    df = spark.createDataFrame([(*r, 7, 8) for r in rows], "doc_id long, text string, source string, fp long, component_id int")
    out = sorted((str(r.doc_id), r.fp, r.component_id) for r in simhash.simhash_groups(df).collect())
    assert [(d, c) for d, _, c in out] == [("1", 1), ("2", 1), ("3", 3), ("3", 3), ("None", 3)]
    assert simhash.simhash_groups(df.limit(0)).count() == 0


def test_long_text_and_hot_groups(spark):
    long = " ".join(f"w{i % 977}" for i in range(150_000))
    df = spark.createDataFrame([(i, long if i % 5 == 0 else "copy of one text") for i in range(60)], "doc_id long, text string")
    out = {r.doc_id: r.component_id for r in simhash.simhash_groups(df).collect()}
    assert {out[i] for i in range(0, 60, 5)} == {0} and {out[i] for i in range(60) if i % 5} == {1}


def test_query_against_brute_force_on_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op3_simhash(spark, "/root/testdata/sf0.001").collect()}
    docs.sort(key=lambda r: r.doc_id)
    prints = [brute_print(r.text) for r in docs]
    label = brute_groups(prints)
    assert got == {r.doc_id: (f"{p:016x}", docs[g].doc_id) for r, p, g in zip(docs, prints, label)}


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(60)] + [(1000, k) for k in range(1001, 1400)] + [(5, 5)]
    df = spark.createDataFrame(chain, "a long, b long")
    got = {r.a: r.b for r in components(df).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, **{k: 1000 for k in range(1001, 1400)}}


def _edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**6)}"
    return out


def _jaccard(a, b):
    grams = lambda t: {tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))}
    x, y = grams(a.lower()), grams(b.lower())
    return len(x & y) / len(x | y)


@pytest.mark.parametrize("node_rows", [simhash.NODE_ROWS, 5])
def test_near_groups_find_similar_texts_and_leave_others(spark, node_rows):
    rng = random.Random(8)
    texts = []
    for g in range(40):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(60, 400))]
        texts.append((g, " ".join(base)))
        for k in (1, 2):
            texts.append((g, " ".join(_edited(rng, base, max(1, len(base) * k // 150)))))
    texts += [(100 + i, " ".join(f"w{rng.randrange(3000)}" for _ in range(rng.randint(1, 200)))) for i in range(150)]
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id long, text string")
    ids = df.withColumn("tid", simhash.text_id(df.text))
    got = {r.doc_id: r.root for r in ids.join(simhash.near_groups(df, node_rows=node_rows), "tid", "left").collect()}
    pairs = [(i, j) for i in range(120) for j in range(i) if texts[i][0] == texts[j][0] and _jaccard(texts[i][1], texts[j][1]) >= 0.8]
    assert len(pairs) > 60 and np.mean([got[i] is not None and got[i] == got[j] for i, j in pairs]) >= 0.97
    named = {}
    for i, root in got.items():
        if root is not None:
            named.setdefault(bytes(root), set()).add(texts[i][0])
    assert all(len(g) == 1 for g in named.values())


def test_keep_one(spark):
    long = " ".join(f"word{i}" for i in range(200))
    rows = [(5, long, 1, "x"), (3, long + " end", 2, "y"), (None, long, 3, "z"), (7, "", 4, None), (6, None, 5, None), (8, "unlike the rest", 6, None), (8, "unlike the rest", 6, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, tid int, root string")
    out = simhash.keep_one(df)
    assert out.columns == df.columns
    assert sorted((r.doc_id, r.tid) for r in out.collect()) == [(3, 2), (6, 5), (8, 6)]
    assert simhash.keep_one(df.limit(0)).count() == 0


@pytest.mark.parametrize("set_bytes", [simhash.SET_BYTES, 2000])
def test_near_groups_decide_by_exact_similarity(spark, set_bytes):
    """Pairs on both sides of 0.8, each pair by itself."""
    rng = random.Random(5)
    texts, pairs = [], []
    for k in range(240):
        base = [f"p{k}w{rng.randrange(10**6)}" for _ in range(rng.randint(80, 300))]
        pairs.append((len(texts), len(texts) + 1))
        texts += [" ".join(base), " ".join(_edited(rng, base, 1 + int(len(base) * (0.005 + 0.045 * rng.random()))))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ids = df.withColumn("tid", simhash.text_id(df.text))
    got = {r.doc_id: r.root for r in ids.join(simhash.near_groups(df, set_bytes=set_bytes), "tid", "left").collect()}
    alike = {(i, j): _jaccard(texts[i], texts[j]) for i, j in pairs}
    linked = {x for x in pairs if got[x[0]] is not None and got[x[0]] == got[x[1]]}
    true = {x for x, j in alike.items() if j >= 0.8}
    assert 40 < len(true) < 200 and linked <= true
    assert len(linked) >= 0.97 * len(true)


def test_similar_equals_all_pairs():
    rng = np.random.default_rng(3)
    sets = []
    for _ in range(12):
        base = rng.integers(0, 2**40, rng.integers(1, 60)).astype(np.uint64)
        for _ in range(6):
            part = base[rng.random(len(base)) > 0.12]
            sets.append(np.unique(np.concatenate([part, rng.integers(0, 2**40, 2).astype(np.uint64)])))
    want = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            a, b = set(sets[i].tolist()), set(sets[j].tolist())
            if len(a & b) >= 0.8 * len(a | b):
                x, y = sorted((want[i], want[j]))
                want = [x if w == y else w for w in want]
    assert simhash.similar(sets, 0.8).tolist() == want


@pytest.mark.parametrize("own", [True, False])
def test_large_node_of_near_copies_is_not_laid_out_as_all_pairs(own):
    rng = np.random.default_rng(1)
    n = 8000
    keys = np.zeros(n, np.uint64)
    rest = np.zeros((n, 7), np.uint64)
    rest[np.arange(n), rng.integers(0, 7, n)] = np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)
    nodes = np.array([[0, n, 0, n, 0]] if own else [[0, n // 2, n // 2, n, 0]])
    tracemalloc.start()
    labels = simhash.walk(keys, nodes, 0, 10, rest, 20)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (labels == 0).all() and peak < 100 << 20


@pytest.mark.parametrize("own", [True, False])
def test_spread_equals_all_pairs(monkeypatch, own):
    rng = np.random.default_rng(2)
    n = 120
    keys = np.repeat(np.uint64(7), n)
    rest = np.zeros((n, 7), np.uint64)
    for k in range(n):
        for _ in range(rng.integers(0, 4)):
            rest[k, rng.integers(0, 4)] ^= np.uint64(1) << np.uint64(rng.integers(0, 16))
    nodes = np.array([[0, n, 0, n, 0]] if own else [[0, 50, 50, n, 0]])
    want = simhash.walk(keys, nodes, 0, 10, rest, 2)
    monkeypatch.setattr(simhash, "BLOCK_PAIRS", 1)
    got = simhash.walk(keys, nodes, 0, 10, rest, 2)
    assert got.tolist() == want.tolist() and len(set(want.tolist())) > 1
