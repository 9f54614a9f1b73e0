from __future__ import annotations

import random

import pytest

from kantar.llm import line_dedup as L


def brute(rows):
    """Texts after removal, in the order of rows: chunks and windows of lines by their bytes, first places stay whole."""
    import hashlib

    tid = lambda t: hashlib.sha256((t or "").encode()).digest()[:16]
    docs = sorted({(r[0], r[1]) for r in rows}, key=lambda r: (r[0] is None, r[0] or 0, tid(r[1])))
    lines = {r: [x.split("\n") for x in L._parts(r[1])] if r[1] and "\n" in r[1] else [] for r in docs}
    content = lambda r, a, n: ("\n".join("\n".join(x) for x in lines[r][a : a + n - 1]), lines[r][a + n - 1][0])
    windows, wholes = {}, {}
    for r in docs:
        for k in range(len(lines[r]) - 1):
            windows.setdefault(content(r, k, 2), []).append((r, k))
        for a, n, _ in L.chunks(r[1]) if lines[r] else []:
            if n >= 2:
                wholes.setdefault(content(r, a, n), []).append((r, a, n))
    safe, late = {r: set() for r in docs}, {r: set() for r in docs}
    for places in windows.values():
        for p, (r, k) in enumerate(places if len(places) > 1 else []):
            (late if p else safe)[r] |= {k, k + 1}
    for places in wholes.values():
        for p, (r, a, n) in enumerate(places if len(places) > 1 else []):
            if p:
                late[r] |= set(range(a, a + n))
                continue
            firsts = [windows[content(r, k, 2)][0] for k in range(a, a + n - 1)]
            if len({(x, k - j) for j, (x, k) in enumerate(firsts)}) > 1:
                safe[r] |= set(range(a, a + n))
    out = []
    for r in rows:
        text, gone = r[1], late[r[0], r[1]] - safe[r[0], r[1]]
        if gone:
            rest = "".join(c for k, c in enumerate(L.pieces(text)) if k not in gone)
            text = rest if text.endswith("\n") else rest.removesuffix("\n")
        out.append(text)
    return out


def _texts(seed, n):
    rng = random.Random(seed)
    line = lambda: " ".join(f"w{rng.randrange(40)}" for _ in range(rng.randint(0, 6)))
    passages = [[line() for _ in range(rng.randint(2, 12))] for _ in range(5)]
    out = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(0, 4)):
            parts += rng.choice(passages) if rng.random() < 0.6 else [line() for _ in range(rng.randint(1, 5))]
        out.append("\n".join(parts) + rng.choice(["", "\n"]))
    return out


def test_chunks_are_the_text_and_resist_shifts():
    for t in [*_texts(1, 50), "", "\n", "\n\n\n", "a", "a\nb\n"]:
        assert "".join(c for _, _, c in L.chunks(t)) == t
    passage = [f"line {i} of the passage" for i in range(40)]
    one = {c for _, c in L._compared("\n".join(["x", *passage, "y"]))}
    two = {c for _, c in L._compared("\n".join(["q", "r", "s", *passage, "t"]))}
    assert len(one & two) >= len(one) - 3


@pytest.mark.parametrize("limit", [L.BROADCAST_HASHES, 0])
def test_against_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(L, "BROADCAST_HASHES", limit)
    rows = list(enumerate(_texts(2, 80)))
    rows += [(200, rows[0][1]), (201, rows[0][1]), (None, rows[3][1]), (0, rows[0][1]), (0, rows[5][1]), (300, None), (301, ""), (302, "a\nb\na\nb\na\nb")]
    df = spark.createDataFrame([(*r, i, "x", 1) for i, r in enumerate(rows)], "doc_id long, text string, row int, hash string, chunk int")
    out = L.dedup_lines(df)
    assert out.columns == df.columns
    assert [r.text for r in sorted(out.collect(), key=lambda r: r.row)] == brute(rows)
    assert L.dedup_lines(df.limit(0)).count() == 0


def test_query_against_brute_force_on_whole_table(spark):
    where = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{where}/documents.parquet").collect()]
    got = {r.doc_id: r.text for r in L.op4_line_dedup(spark, where).collect()}
    assert got == dict(zip([r[0] for r in rows], brute(rows)))
    assert sum(a != b for (_, a), b in zip(rows, brute(rows))) > 20


def test_every_repeated_run_goes_whatever_stands_around_it(spark):
    """Against maximal repeated runs of lines, found without the module's own pieces."""
    rng = random.Random(11)
    fresh = iter(range(10**6))
    own = lambda n: [f"own line {next(fresh)}" for _ in range(n)]
    rows, want = [], []
    for p, size in enumerate([2, 2, 2, 3, 3, 4, 5, 9] * 4):
        passage = [f"passage {p} line {i}" for i in range(size)]
        for copy in range(3):
            before, after = own(rng.randint(0, 4)), own(rng.randint(0, 4))
            rows.append((len(rows), "\n".join([*before, *passage, *after])))
            want.append("\n".join([*before, *(passage if not copy else []), *after]))
    rows += [(1000, "one line\nown tail a"), (1001, "one line\nown tail b"), (1002, "\n\nq\n\nr\nend"), (1003, "start\nq\n\nr\n\n\nlast")]
    want += ["one line\nown tail a", "one line\nown tail b", "\n\nq\n\nr\nend", "start\nlast"]
    out = L.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), count="n").collect()
    assert [r.text for r in sorted(out, key=lambda r: r.doc_id)] == want
    assert {r.doc_id: r.n for r in out}[1003] == 2


def test_one_whole_copy_of_each_passage_stays(spark):
    """A passage whose lines are repeats of others' too is left whole somewhere."""
    A, B, C, X = "first line of all", "second line here", "third line there", "a line of its own"
    rows = [(1, f"{B}\n{C}"), (2, f"{A}\n{B}\n{C}"), (3, f"{A}\n{B}\n{X}")]
    got = {r.doc_id: r.text for r in L.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: f"{B}\n{C}", 2: f"{A}\n{B}", 3: X}
    rng, many = random.Random(8), []
    pool = [f"pool line {i}" for i in range(12)]
    for i in range(60):
        at = [rng.randrange(9) for _ in range(rng.randint(1, 3))]
        many.append((i, "\n".join(x for a in at for x in [*pool[a : a + rng.randint(2, 4)], f"own {i} {a}"])))
    left = {r.doc_id: r.text for r in L.dedup_lines(spark.createDataFrame(many, "doc_id long, text string")).collect()}
    assert [left[i] for i, _ in many] == brute(many)
    from collections import Counter

    windows = lambda t: list(zip(t.split("\n"), t.split("\n")[1:]))
    again = {w for w, n in Counter(w for _, t in many for w in windows(t)).items() if n > 1}
    assert len(again) > 10 and again <= {w for t in left.values() for w in windows(t)}
    again = {c for c, n in Counter(c for _, t in many for _, c in L._compared(t)).items() if n > 1}
    assert len(again) > 5 and all(any(c in t for t in left.values()) for c in again)
    assert sum(map(len, left.values())) < 0.7 * sum(len(t) for _, t in many)


def test_hashes_are_confirmed_by_bytes(spark):
    """Of rows whose hash is the same, only those of the same lines are repeats."""
    from pyspark.sql import functions as F

    rows = [(7, (False, k, b"", 0), parts) for k, parts in enumerate([["a", "b"], ["a", "c"], ["a", "b\n\n"], ["x", "y"]])]
    df = spark.createDataFrame(rows, "hash long, place struct<none:boolean,id:long,tid:binary,k:int>, parts array<string>")
    out = L._repeated(df, "hash", L._content(F.col("parts"), F.lit(0), F.lit(2)), "test").collect()
    assert sorted((r.place.id, r.first.id) for r in out) == [(0, 0), (2, 0)]


def test_rolling_hash_equals_a_plain_one(monkeypatch):
    import xxhash

    h = lambda s: xxhash.xxh3_64_intdigest(s.encode())
    parts = [f"line {i}" + "\n" * (i % 3) for i in range(30)]
    for n in (2, 3, 5):
        monkeypatch.setattr(L, "LEAST_LINES", n)
        want = []
        for k in range(len(parts) - n + 1):
            x = 0
            for p in parts[k : k + n - 1]:
                x = (x * L.BASE + h(p)) % L.MODULUS
            want.append((x * L.BASE + h(parts[k + n - 1].split("\n")[0])) % L.MODULUS)
        assert L.rolling(parts) == want
