from __future__ import annotations

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from kantar.llm import knn_join


def brute(rows, k=5):
    """As OP2_SQL: repeated rows are as many candidates, and each query row ranks by itself."""
    ok = [(i, tuple(math.floor(256 * float(x)) for x in v)) for i, v in rows]
    long = lambda n: max(-(2**63) + 1, min(2**63 - 1, n))
    out = Counter()
    for q, a in ok:
        if q % 50 == 0:
            scored = sorted((-long(sum(x * y for x, y in zip(a, b))), i) for i, b in ok if i != q and len(a) == len(b))[:k]
            out.update((q, r + 1, i, -s) for r, (s, i) in enumerate(scored))
    return out


@pytest.mark.parametrize("small", [False, True])
def test_against_brute_force(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(knn_join, "SLICE_ROWS", 40)
        monkeypatch.setattr(knn_join, "BLOCK_QUERIES", 2)
    rng = random.Random(3)
    centres = [[rng.uniform(-1, 1) for _ in range(8)] for _ in range(9)]
    rows = [(i, [c + rng.gauss(0, 0.1) for c in centres[i % 9]]) for i in range(400)]
    rows += [(i, rows[0][1]) for i in range(400, 700)]  # one hot vector, all ties
    rows += [rows[50], rows[50], (5000, [0.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    exact = [(r.vec_id, r.embedding) for r in df.collect()]
    got = Counter(tuple(r) for r in knn_join.top_k(df, F.col("id") % 50 == 0).collect())
    assert got == brute(exact)


def test_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, [0.5, 0.5]), (2, None), (3, [1.0, None]), (4, [nan, 1.0]), (50, [inf, 1.0]), (None, [9.0, 9.0]), (100, [1.0]), (150, [])]
    df = spark.createDataFrame([(*r, "v", 3) for r in rows], "vec_id long, embedding array<float>, id string, cell int")
    got = [tuple(r) for r in knn_join.top_k(df, F.col("id") % 50 == 0).collect()]
    assert got == [(0, 1, 1, 256 * 128 + 512 * 128)]
    assert knn_join.top_k(df.limit(0), F.col("id") % 50 == 0).collect() == []
    assert knn_join.top_k(df.where("vec_id = 0"), F.col("id") % 50 == 0).collect() == []


def test_large_components_are_exact(spark):
    rng = random.Random(4)
    rows = [(i, [float(rng.choice([1, -1]) * rng.randint(1, 2 ** rng.randint(1, 44))) for _ in range(4)]) for i in range(150)]
    rows += [(200, [1e300, -1e300, 0.0, 3.0]), (201, [1e300, 1e300, 1.0, 1.0]), (150, [0.0] * 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    clip = lambda x: max(-(2.0**63), min(2.0**63 - 1024, math.floor(256 * x))) / 256
    got = Counter(tuple(r) for r in knn_join.top_k(df, F.col("id") % 50 == 0).collect())
    assert got == brute([(i, [clip(x) for x in v]) for i, v in rows])


def test_clustered_vectors_are_hardly_replicated(spark, monkeypatch):
    """Of 16 directions far apart a query needs about its own; rows are sent once a block, not once a group."""
    sent = []
    kept = knn_join.replication
    monkeypatch.setattr(knn_join, "replication", lambda asked, cells: sent.append([(r.blocks, cells.n[r.to_cell]) for r in kept(asked, cells).collect()]) or kept(asked, cells))
    rng = random.Random(7)
    centres = [[rng.gauss(0, 1) for _ in range(32)] for _ in range(16)]
    rows = [(i, [c + rng.gauss(0, 0.05) for c in centres[i % 16]]) for i in range(3200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = Counter(tuple(r) for r in knn_join.top_k(df, F.col("id") % 50 == 0).collect())
    assert got == brute([(r.vec_id, r.embedding) for r in df.collect()])
    own, further = (sum(b * n for b, n in x) for x in sent)
    assert own <= 3200 and further <= 0.5 * 3200


def test_each_length_is_a_space_of_its_own(spark, tmp_path):
    from tests.oracle import differences

    rng = random.Random(9)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(3 if i % 4 else 5)]) for i in range(260)] + [(50, [0.5, 0.25, 1.0]), (50, [0.5, 0.25, 1.0]), (300, [2.0]), (350, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    df.repartition(1).write.parquet(str(tmp_path / "raw"))
    next((tmp_path / "raw").glob("*.parquet")).rename(tmp_path / "embeddings.parquet")
    got = Counter(tuple(r) for r in knn_join.op2_voronoi_knn(spark, str(tmp_path)).collect())
    assert got == brute([(r.vec_id, r.embedding) for r in df.collect()])
    assert differences(spark, knn_join.op2_voronoi_knn, knn_join.OP2_SQL, str(tmp_path)) == []
