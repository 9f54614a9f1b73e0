from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest

from kantar.llm import suffix_dedup


def brute(texts, width):
    """For each text: bytes, removed bytes, runs, digest of what is left."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(hash(d[i : i + width]) for d in data for i in range(len(d) - width + 1))
    exact = Counter(w for d in data for i in range(len(d) - width + 1) if seen[hash(w := d[i : i + width])] > 1)
    out = []
    for d in data:
        end, gone = 0, bytearray(len(d))
        for i in range(len(d)):
            if i + width <= len(d) and seen[hash(d[i : i + width])] > 1 and exact[d[i : i + width]] > 1:
                end = i + width
            gone[i] = i < end
        runs = sum(1 for i in range(len(d)) if gone[i] and not (i and gone[i - 1]))
        kept = bytes(b for b, g in zip(d, gone) if not g)
        out.append((len(d), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def told(df):
    return [
        (r.n_bytes, r.n_removed, len(r.removed), hashlib.sha256(bytes(r.kept)).hexdigest())
        for r in sorted(df.collect(), key=lambda r: r.doc_id)
    ]


def _made(rng, n):
    word = lambda: "".join(rng.choice("abcé") for _ in range(rng.randint(1, 7)))
    passages = [" ".join(word() for _ in range(rng.randint(60, 200))) for _ in range(6)]
    out = []
    for _ in range(n):
        parts = [" ".join(word() for _ in range(rng.randint(0, 80)))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randrange(len(p) // 2)
            parts += [p[a : a + rng.randint(100, 900)], " ".join(word() for _ in range(rng.randint(0, 60)))]
        out.append(rng.choice(["", " ", "x"]).join(parts))
    return out


@pytest.mark.parametrize(("most", "seed"), [(suffix_dedup.MOST_NAMES, 1), (1, 2), (4, 3)])
def test_against_brute_force(spark, most, seed):
    rng = random.Random(seed)
    texts = _made(rng, 60)
    texts += [texts[0], texts[3], "a" * 1500, "ab" * 500, "", None, "z" * 399, "q" * 400, texts[5][:-1] + "!", "r" * 255, "s" * 256, "t" * 257]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = suffix_dedup.dedup_substrings(df, most=most)
    assert told(out) == brute(texts, 400)
    assert [r.repeats for r in sorted(out.collect(), key=lambda r: r.doc_id)] == [gone > 0 for _, gone, _, _ in brute(texts, suffix_dedup.FLOOR)]


def test_hot_keys_meet_by_broadcast(spark, monkeypatch):
    from kantar.llm import shared

    monkeypatch.setattr(shared, "HOT_ROWS", 2)
    test_against_brute_force(spark, 3, 4)
    monkeypatch.setattr(shared, "HOT_KEYS", 0)
    test_against_brute_force(spark, 3, 5)


def test_a_passage_between_unlike_neighbours_in_many_texts(spark):
    """Passages of over 50 words are found wherever they stand, and clean texts are left alone."""
    rng = random.Random(6)
    passage = " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(70))
    short = " ".join("".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(55))
    word = lambda n: " ".join("".join(rng.choice("ijklmnop") for _ in range(5)) for _ in range(n))
    texts = [f"{word(k % 9)} {passage if k % 2 else short} {word(k % 7)}" for k in range(60)] + [word(90) for _ in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(suffix_dedup.dedup_substrings(df, most=16).collect(), key=lambda r: r.doc_id)
    assert [r.repeats for r in got] == [k < 60 for k in range(80)]
    assert all((r.n_removed >= len(passage)) == (k < 60 and k % 2 == 1) for k, r in enumerate(got))


def test_pieces_of_long_texts(spark, monkeypatch):
    rng = random.Random(9)
    texts = _made(rng, 12)
    monkeypatch.setattr(suffix_dedup, "PIECE", 333)
    data = " ".join(texts).encode()
    starts = [s for lo, hi, _, _ in suffix_dedup.segments(data) for a, b in zip(lo, hi) for s in range(a, b + 1)]
    assert starts == list(range(len(data) - suffix_dedup.FLOOR + 1))


def test_edge_rows(spark):
    same = "repeated row " * 60
    rows = [(None, same, 1, "x"), (7, same, 2, None), (7, same, 3, "y"), (8, None, None, None), (9, "", 4, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans int, tid string")
    out = sorted((str(r.doc_id), r.n_bytes, r.n_removed) for r in suffix_dedup.dedup_substrings(df).collect())
    n = len(same)
    assert out == [("7", n, n), ("7", n, n), ("8", 0, 0), ("9", 0, 0), ("None", n, n)]
    assert suffix_dedup.dedup_substrings(df.limit(0)).count() == 0


def test_query_against_brute_force_on_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.op6_suffix_dedup(spark, "/root/testdata/sf0.001").collect()}
    assert got == dict(zip([r.doc_id for r in docs], brute([r.text for r in docs], 400)))
