from __future__ import annotations

import math
from collections import Counter, defaultdict

import pytest

from kantar.llm import mixing as M


def _weights(n, max_repeats, target):
    """By plain scanning of exponents."""
    h = lambda a: (w := [x**a for x in n], z := sum(w), -sum(x / z * math.log(x / z) for x in w))[-1]
    ok = lambda a: (max(n) / min(n)) ** (1 - a) <= max_repeats * (1 + 1e-9)
    grid = [k / 100_000 for k in range(100_001)]
    low = next(a for a in grid if ok(a))
    if target is None:
        return low
    return max(low, max((a for a in grid if h(a) >= target * math.log(len(n))), default=0))


@pytest.mark.parametrize(("repeats", "target"), [(4.0, None), (2.0, None), (50.0, 0.9), (1.5, 0.99), (50.0, 0.2)])
def test_exponent(spark, repeats, target):
    n = [1000, 400, 60, 7, 7]
    df = spark.createDataFrame([(x,) for x in n], "n long")
    assert abs(M.exponent(df, repeats, target) - _weights(n, repeats, target)) < 1e-4


def _docs(spark):
    rows = [(i, "hot", "w " * (i % 9 + 1)) for i in range(600)] + [(1000 + i, "mid", "x y z") for i in range(40)]
    rows += [(2000 + i, None, "one two") for i in range(9)] + [(3000, "empty", ""), (3001, "empty", None), (None, "mid", "n"), (5, "mid", None), (7, "hot", "w"), (7, "hot", "w")]
    return spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, source string, text string, block int, n int")


@pytest.mark.parametrize("small", [False, True])
def test_budgets_and_permutations(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(M, "BLOCK_TOKENS", 20)
        monkeypatch.setattr(M, "BROADCAST_SOURCES", 0)
    docs = _docs(spark)
    n = Counter()
    for r in docs.collect():
        n[r.source] += len((r.text or "").split())
    out = M.mix(docs).collect()
    a = _weights([x for x in n.values() if x], 4.0, None)
    most = max(n.values())
    read, epochs = Counter(), defaultdict(Counter)
    for r in out:
        read[r.source] += r.tokens
        epochs[r.source][r.epoch] += r.tokens
        assert 0 <= r.place < 1 or r.tokens == 0
    for s, x in n.items():
        budget = x * min(4.0, (most / x) ** (1 - a)) if x else 0
        assert budget - 10 <= read[s] <= budget + 1
        assert all(epochs[s][e] == x for e in range(int(budget // x) if x else 0))
    assert Counter(r.doc_id for r in out if r.source == "hot") == Counter(r.doc_id for r in docs.collect() if r.source == "hot")
    assert sorted(r.doc_id for r in out if r.source == "empty") == [3000, 3001]
    by_epoch = defaultdict(list)
    for r in sorted((r for r in out if r.source == "mid" and r.tokens == 3), key=lambda r: r.place):
        by_epoch[r.epoch].append(r.doc_id)
    assert len(set(map(tuple, by_epoch.values()))) == len(by_epoch) > 1
    assert out[0].__fields__[:5] == docs.columns


def test_empty_and_alike(spark):
    assert M.mix(_docs(spark).limit(0)).count() == 0
    same = spark.createDataFrame([(i, f"s{i % 3}", "a b") for i in range(30)], "doc_id long, source string, text string")
    assert sorted(r.doc_id for r in M.mix(same).collect()) == list(range(30))


def _hash(*values, seed=42):
    """As Spark's: 64-bit xxHash of one value after another; nulls are passed over. A tuple is (number, bytes)."""
    import xxhash

    for v in values:
        if v is not None:
            data = v.encode() if isinstance(v, str) else v[0].to_bytes(v[1], "little", signed=True)
            seed = xxhash.xxh64_intdigest(data, seed)
    return seed - (1 << 64) if seed >= 1 << 63 else seed


@pytest.mark.parametrize("small", [False, True])
def test_query_against_brute_force_on_the_whole_table(spark, monkeypatch, small):
    """Every reading with its epoch and place, worked out plainly from the sources' totals and the hashes."""
    if small:
        monkeypatch.setattr(M, "BLOCK_TOKENS", 500)
    where, seed = "/root/testdata/sf0.01", M.SEED
    docs = [(r.doc_id, r.source, r.text) for r in spark.read.parquet(f"{where}/documents.parquet").collect()]
    import re

    rows = {}
    for d, s, t in docs:
        h, h2 = (_hash((k, 4), (d, 8), s, t) for k in (seed, seed + 1))
        rows[h, h2] = (d, s, len(re.findall(r"[^ \t\n\x0b\f\r]+", t or "")))
    totals, count = Counter(), Counter()
    for d, s, n in rows.values():
        totals[s] += n
        count[s] += 1
    a, most = _weights([x for x in totals.values() if x], M.MAX_REPEATS, None), max(totals.values())
    exact = M.exponent(spark.createDataFrame([(x,) for x in totals.values()], "n long"))
    assert abs(a - exact) < 1e-4
    want = []
    for s, n in totals.items():
        budget = math.floor(min(M.MAX_REPEATS, (most / n) ** (1 - exact)) * n + 1e-6)
        epochs, part = divmod(budget, n)
        blocks = max(-(-n // M.BLOCK_TOKENS), -(-count[s] // M.BLOCK_DOCS))
        held = defaultdict(list)
        for (h, h2), (d, source, tokens) in rows.items():
            if source == s:
                held[h % blocks].append((h, h2, d, tokens))
        for e in range(epochs + (part > 0)):
            at = 0
            for b in sorted(held, key=lambda b: (_hash((seed, 4), s, (e, 4), (b, 8)), b)):
                if e == epochs and at >= part:
                    break
                for h, h2, d, tokens in sorted(held[b], key=lambda x: (_hash((seed, 4), (x[0], 8), (e, 4)), x[0], x[1])):
                    at += tokens
                    if e < epochs or (at <= part and tokens):
                        want.append((d, s, tokens, e, (e * n + at - tokens) / max(budget, 1)))
    got = [(r.doc_id, r.source, r.tokens, r.epoch, r.place) for r in M.op5_mixing(spark, where).collect()]
    assert sorted(got) == sorted(want) and len(got) > len(docs)


def test_columns_that_have_no_hash(spark):
    """Rows that differ in a map alone are read together; the map is kept."""
    df = spark.createDataFrame([(i, "s", f"a b {i}", {"k": i}) for i in range(20)], "doc_id long, source string, text string, extra map<string,int>")
    out = M.mix(df).collect()
    assert sorted((r.doc_id, r.extra["k"]) for r in out) == [(i, i) for i in range(20)]
