"""Exact top-k by integer inner product: a Voronoi join in two phases.

Rows go to the cell of their nearest pivot. A summary of each cell (its size, its
radius, its widest angle to the pivot, its norms and its ``k + 1`` least distances
to the pivot) bounds the product of a query with every member: it lies within
``|q| * r`` of the product with the pivot, and it is at most ``|q|`` times a norm
times the cosine of the least angle that a member can have to the query.

First each query is solved in its own cell. Its k-th score there, or what the
summaries promise if that is more, is what an answer has to reach. Then each query
goes to the further cells whose upper bound reaches that, and to no other. A cell's
rows are replicated once for each block of ``BLOCK_QUERIES`` queries that need the
cell, and not at all if none does. Large cells are sliced, so a task holds at most
about ``SLICE_ROWS`` data rows and ``BLOCK_QUERIES`` queries; each task answers with
k rows a query at most, and the best k of those are the result.

Pivots come from ``SAMPLE_ROWS`` rows at most (those of least hashed id), which
bounds what the driver gathers; there are about half the root of the number of
rows, ``MOST_PIVOTS`` at most, and the summaries hold as many rows. They only steer
the work: whatever the pivots, the answers are exact. In directions that are
random in many dimensions hardly any cell can be ruled out, and the work is that
of all queries against all rows, in blocks.

Defined results: components become ``floor(256 * x)``, clipped to the range of a
long, as is a score beyond it. Rows take no part if the id or vector is null or if a
component is null or not finite. Only vectors of one length have a product, so each
length that occurs is a space of its own, solved by itself (tables normally have one).
Repeated rows are as many candidates, and each repeated query row has its own ranks,
so its rows repeat as well. A row is no answer to a query with its own id. Ties go to the smaller id; queries with fewer candidates than k return all.
Empty input gives no rows. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kantar.llm.shared import cut, table

SCALE = 256
LEAST_PIVOTS, MOST_PIVOTS = 16, 512
SAMPLE_ROWS = 2000
SLICE_ROWS = 16_384
BLOCK_QUERIES = 2_048


def _whole(vectors: pd.Series, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(vectors), np.int64).reshape(-1, dim)


def _stack(vectors: pd.Series, dim: int) -> np.ndarray:
    return _whole(vectors, dim).astype(np.float64)


def _quantised(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        # The largest double under 2**63 is 1024 less.
        scaled = [np.clip(np.floor(np.asarray(v, np.float64) * SCALE), -(2.0**63), 2.0**63 - 1024) for v in batch["v"]]
        yield pd.DataFrame({"id": batch["id"], "v": [s.astype(np.int64).tobytes() for s in scaled]})


def _usable(rows: DataFrame, id_col: str, vec: str) -> DataFrame:
    v = F.col(vec)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    good = rows.where(F.col(id_col).isNotNull() & v.isNotNull()).where(fine)
    return good.select(F.col(id_col).cast("long").alias("id"), v.alias("v"))


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first: each next pivot is the sampled vector farthest from those chosen."""
    if not len(sample):
        return np.zeros((1, sample.shape[1]))
    chosen = [0]
    gap = ((sample - sample[0]) ** 2).sum(1)
    while len(chosen) < n and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


PLACED = "id long, v binary, row long, cell int, dist double, angle double, norm double"


def _cosines(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Cosines to every pivot; 1 where a vector or a pivot is zero (its angle says nothing)."""
    sizes = np.sqrt((x**2).sum(1))[:, None] * np.sqrt((pivots**2).sum(1))
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(sizes > 0, np.clip(x @ pivots.T / sizes, -1, 1), 1.0)


def _assign(pivots: np.ndarray):
    dim = pivots.shape[1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        norms = (pivots**2).sum(1)
        for batch in batches:
            x = _stack(batch["v"], dim)
            square = np.maximum((x**2).sum(1)[:, None] - 2 * (x @ pivots.T) + norms, 0)
            cell = square.argmin(1)
            own = np.arange(len(x)), cell
            # Not from ``square``, which is the difference of large numbers.
            dist = np.sqrt(((x - pivots[cell]) ** 2).sum(1))
            yield batch.assign(cell=cell.astype(np.int32), dist=dist, angle=np.arccos(_cosines(x, pivots)[own]), norm=np.sqrt((x**2).sum(1)))

    return run


class Cells:
    """The summaries of all cells, by number of the pivot."""

    def __init__(self, pivots: np.ndarray, placed: DataFrame, k: int):
        totals = placed.groupBy("cell").agg(
            F.count("*").alias("n"), F.max("dist").alias("far"), F.max("angle").alias("wide"), F.min("norm").alias("least"), F.max("norm").alias("most")
        )
        heads = placed.select("cell", "dist", F.row_number().over(Window.partitionBy("cell").orderBy("dist")).alias("r")).where(F.col("r") <= k + 1)
        self.pivots, self.k = pivots, k
        self.n, self.far, self.wide, self.least, self.most = np.zeros((5, len(pivots)))
        for t in totals.collect():
            self.n[t.cell], self.far[t.cell], self.wide[t.cell], self.least[t.cell], self.most[t.cell] = t.n, t.far, t.wide, t.least, t.most
        near = heads.collect()
        self.owner, self.near = np.array([h.cell for h in near], np.int64), np.array([h.dist for h in near])

    def most_of(self, q: np.ndarray) -> np.ndarray:
        """No member of a cell has a greater product with the query."""
        size = np.sqrt((q**2).sum(1))[:, None]
        angle = np.maximum(np.arccos(_cosines(q, self.pivots)) - self.wide - 1e-7, 0)
        cosine = np.cos(angle)
        by_angle = size * np.where(cosine > 0, self.most, self.least) * cosine
        by_angle = np.where((self.pivots**2).sum(1) > 0, by_angle, np.inf)
        bound = np.minimum(q @ self.pivots.T + size * self.far, by_angle)
        return bound + 1e-6 * (1 + size * self.most)

    def sure(self, q: np.ndarray) -> np.ndarray:
        """The k-th answer reaches this. One row more than k counts, as the query's own may be among them."""
        size = np.sqrt((q**2).sum(1))[:, None]
        low = (q @ self.pivots.T)[:, self.owner] - size * self.near
        if low.shape[1] <= self.k:
            return np.full(len(q), -np.inf)
        return np.partition(low, -(self.k + 1), 1)[:, -(self.k + 1)] - 1e-6 * (1 + size[:, 0] * self.most.max())


def _further(cells: Cells):
    """For each query, the cells beside its own that can hold one of its answers."""
    dim = cells.pivots.shape[1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            q = _stack(batch["v"], dim)
            reached = np.maximum(cells.sure(q), batch["reached"].fillna(-np.inf).to_numpy(np.float64))
            # Scores are clipped to the range of a long, so no bound may claim more.
            wanted = (np.maximum(cells.most_of(q), -(2.0**63)) >= np.minimum(reached, 2.0**63 * (1 - 1e-9))[:, None]) & (cells.n > 0)
            wanted[np.arange(len(q)), batch["cell"].to_numpy()] = False
            yield pd.DataFrame({"key": batch["key"], "id": batch["id"], "v": batch["v"], "cells": [np.flatnonzero(w).astype(np.int32) for w in wanted]})

    return run


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact products of whole numbers, clipped to the range of a long."""
    largest = float(np.abs(q.astype(np.float64)).max(initial=0)) * float(np.abs(x.astype(np.float64)).max(initial=0)) * q.shape[1]
    if largest < 2.0**53:
        return (q.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64)
    if largest < 2.0**62:
        return q @ x.T
    exact = q.astype(object) @ x.T.astype(object)
    return np.minimum(np.maximum(exact, -(2**63) + 1), 2**63 - 1).astype(np.int64)


ANSWER = "key long, vec_id long, score long"


def _solve(dim: int, k: int):
    def run(_, queries: pd.DataFrame, data: pd.DataFrame) -> pd.DataFrame:
        keys, found, scored = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if len(queries) and len(data):
            data = data.sort_values("id", kind="stable")
            ids = data["id"].to_numpy(np.int64)
            x, q = _whole(data["v"], dim), _whole(queries["v"], dim)
            asks, key = queries["id"].to_numpy(np.int64), queries["key"].to_numpy(np.int64)
            step = max(1, (1 << 20) // len(ids))
            for at in range(0, len(q), step):
                scores = _scores(q[at : at + step], x)
                own = asks[at : at + step, None] == ids
                # No score is the least long, so it stands for the query's own rows.
                scores[own] = np.iinfo(np.int64).min
                least = np.partition(scores, -k, 1)[:, -k] if len(ids) > k else np.full(len(scores), np.iinfo(np.int64).min)
                for r, row in enumerate(scores):
                    over = np.flatnonzero(row > least[r])
                    # Ids ascend, so the first rows at the bound are the ones that ties prefer.
                    even = np.flatnonzero(row == least[r])[: k - len(over)] if least[r] > np.iinfo(np.int64).min else over[:0]
                    best = np.concatenate((over, even))
                    keys.append(np.full(len(best), key[at + r]))
                    found.append(ids[best])
                    scored.append(row[best])
        return pd.DataFrame({"key": np.concatenate(keys), "vec_id": np.concatenate(found), "score": np.concatenate(scored)})

    return run


def replication(asked: DataFrame, cells: Cells) -> DataFrame:
    """(to_cell, blocks, slices): how often each needed cell is sent, and in how many pieces; a row a pivot at most."""
    need = asked.groupBy("cell").count().collect()
    rows = [(r["cell"], -(-r["count"] // BLOCK_QUERIES), max(1, -(-int(cells.n[r["cell"]]) // SLICE_ROWS))) for r in need]
    return asked.sparkSession.createDataFrame(rows, "to_cell int, blocks int, slices int")


def _meet(asked: DataFrame, placed: DataFrame, cells: Cells) -> DataFrame:
    """Answers of queries (key, id, v, cell) among the rows of their cell."""
    plan = F.broadcast(replication(asked, cells))
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    mixed = lambda *c: F.xxhash64(*c)
    queries = asked.join(plan, F.col("cell") == F.col("to_cell")).withColumn("block", F.pmod(mixed("key"), F.col("blocks")).cast("int")).withColumn("slice", upto("slices"))
    # Other names on the data side, since both sides descend from one table.
    data = placed.select("id", "v", "row", "cell").join(plan, F.col("cell") == F.col("to_cell")).withColumn("to_slice", F.pmod(mixed("row"), F.col("slices")).cast("int")).withColumn("to_block", upto("blocks"))
    return (
        queries.select("key", "id", "v", "cell", "block", "slice").groupBy("cell", "block", "slice")
        .cogroup(data.select("id", "v", "to_cell", "to_block", "to_slice").groupBy("to_cell", "to_block", "to_slice"))
        .applyInPandas(_solve(cells.pivots.shape[1], cells.k), ANSWER)
    )


def top_k(rows: DataFrame, is_query: Column, id_col: str = "vec_id", vec: str = "embedding", k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows for each row that ``is_query`` marks.

    ``is_query`` is a condition on the column ``id``.
    """
    good = _usable(rows, id_col, vec)
    lengths = [r["dim"] for r in good.groupBy(F.size("v").alias("dim")).count().collect() if r["dim"] > 0]
    out = rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    for dim in sorted(lengths):
        found = _top_k(good.where(F.size("v") == dim), dim, is_query, k)
        out = found if dim == min(lengths) else out.unionByName(found)
    return out


def _top_k(good: DataFrame, dim: int, is_query: Column, k: int) -> DataFrame:
    """``top_k`` for vectors of one length."""
    # Numbered, so that repeated rows are dealt to slices like others.
    exact = cut(good.mapInPandas(_quantised, "id long, v binary").withColumn("row", F.monotonically_increasing_id()), "knn-vectors")
    sample = exact.orderBy(F.xxhash64("id"), "id", "v").limit(SAMPLE_ROWS).toPandas()
    pivots = choose_pivots(_stack(sample["v"], dim), min(MOST_PIVOTS, max(LEAST_PIVOTS, math.isqrt(exact.count()) // 2)))
    placed = cut(exact.mapInPandas(_assign(pivots), PLACED), "knn-placed")
    cells = Cells(pivots, placed, k)
    asked = placed.where(is_query).groupBy("id", "v", "cell").agg(F.count("*").alias("times"))
    asked = cut(asked.withColumn("key", F.monotonically_increasing_id()), "knn-queries")
    first = cut(_meet(asked.select("key", "id", "v", "cell"), placed, cells), "knn-own")
    best = Window.partitionBy("key").orderBy(F.desc("score"), "vec_id")
    kth = first.withColumn("r", F.row_number().over(best)).where(F.col("r") == k).select("key", F.col("score").alias("reached"))
    further = asked.join(kth, "key", "left").select("key", "id", "v", "cell", F.col("reached").cast("double").alias("reached"))
    further = cut(further.mapInPandas(_further(cells), "key long, id long, v binary, cells array<int>"), "knn-further")
    rest = _meet(further.select("key", "id", "v", F.explode("cells").alias("cell")), placed, cells)
    pairs = first.unionByName(rest).withColumn("r", F.row_number().over(best)).where(F.col("r") <= k)
    each = pairs.join(asked.select("key", F.col("id").alias("query_id"), "times"), "key").withColumn("time", F.explode(F.sequence(F.lit(1).cast("long"), "times")))
    return each.select("query_id", F.col("r").alias("rank"), "vec_id", "score")


def op2_voronoi_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


OP2_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.row, q.vec_id AS query_id, d.vec_id, CAST(list_dot_product(q.e, d.e) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id <> d.vec_id AND len(q.e) = len(d.e) WHERE q.vec_id % 50 = 0 AND len(q.e) > 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
