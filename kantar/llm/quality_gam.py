"""Quality classifier: a generalised additive model with pairwise interactions.

Each text becomes a few figures of form (shares of character kinds, word and line
statistics, repetition), each figure a bin. The score is the logistic function of
a sum of looked-up values, one table per figure and one per chosen pair of
figures. Training boosts shallow trees on one figure at a time, in turns, with a
small step, and adds each tree to that figure's table; then pairs, the ones that
explain most of what is left, get tables the same way. Scoring is binning and
additions of arrays.

Training takes at most ``SAMPLE_ROWS`` labelled rows (those of least hashed id)
and runs on the driver over their binned figures, a bounded matrix; the figures
themselves, and all scores, are computed by Spark over whole texts.

Defined results: a null text is empty, and an empty text has figures and a score
like any other. Labels other than 0 and 1 and labels of a null id are not learnt
from; several labels of one id count as their least, and of several texts of an id the
least is learnt from; rows that repeat, or share an id, each get a score. A null id is never held out. Without labels of both kinds
the score is the share of label 1, or 0.5 without any. Empty input gives no rows.
Label, language, source and id are no inputs of a score; extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kantar.llm.shared import fresh, table

SAMPLE_ROWS = 20_000
BINS = 32
PAIR_BINS = 8
PAIRS = 6
ROUNDS = 120
PAIR_ROUNDS = 60
STEP = 0.1
LEAST_WEIGHT = 1.0

FIGURES = (
    "log_bytes", "log_words", "log_lines", "word_length", "long_words", "distinct_words", "distinct_pairs", "same_next",
    "distinct_lines", "line_words", "upper", "digits", "space", "beyond_ascii", "stops", "commas", "bangs", "bars",
    "marks", "other_signs", "capital_words", "top_byte",
)

_KINDS = np.zeros((256, 9))
for _k, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\n\x0b\x0c", bytes(range(128, 256)), b".?", b",;:", b"!", b"|", b"#$%&*@^~_+=<>/\\")):
    _KINDS[list(_chars), _k] = 1
_SIGNS = np.zeros(256)
_SIGNS[list(b"\"'`()[]{}-")] = 1


def figures(text: str | None) -> list[float]:
    """The figures of one whole text, in the order of ``FIGURES``."""
    data = (text or "").encode("utf-8", "replace")
    n = max(1, len(data))
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    upper, digits, space, beyond, stops, commas, bangs, bars, marks = (counts @ _KINDS).tolist()
    words = data.split()
    w = max(1, len(words))
    lines = data.split(b"\n")
    pairs = len(set(zip(words, words[1:])))
    return [
        float(np.log1p(len(data))),
        float(np.log1p(len(words))),
        float(np.log1p(len(lines))),
        (len(data) - space) / w,
        sum(len(x) > 20 for x in words) / w,
        # Vocabulary grows slower than the text: exponents compare texts of any length.
        float(np.log1p(len(set(words))) / np.log1p(w)),
        float(np.log1p(pairs) / np.log1p(max(1, len(words) - 1))),
        sum(a == b for a, b in zip(words, words[1:])) / w,
        len(set(lines)) / max(1, len(lines)),
        len(words) / max(1, len(lines)),
        upper / n,
        digits / n,
        space / n,
        beyond / n,
        stops / w,
        commas / w,
        bangs / w,
        bars / w,
        marks / w,
        float(counts @ _SIGNS) / w,
        sum(x[:1].isupper() for x in words) / w,
        float(counts.max()) / n,
    ]


@dataclass
class Gam:
    """Cut points per figure, a table per figure and a table per pair."""

    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    single: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    double: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], "right") for f, e in enumerate(self.edges)], 1) if self.edges else np.zeros((len(x), 0), int)

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        total = np.full(len(x), self.base)
        for f, values in enumerate(self.single):
            total += values[b[:, f]]
        for (f, g), values in zip(self.pairs, self.double):
            total += values[self.coarse[f][b[:, f]], self.coarse[g][b[:, g]]]
        return 1 / (1 + np.exp(-total))


def _leaves(grad: np.ndarray, hess: np.ndarray, depth: int = 2) -> np.ndarray:
    """A shallow tree on one binned figure: the value of each bin."""
    out = np.full(len(grad), grad.sum() / (hess.sum() + LEAST_WEIGHT))
    if depth == 0 or len(grad) < 2:
        return out
    g, h = np.cumsum(grad)[:-1], np.cumsum(hess)[:-1]
    gain = g**2 / (h + LEAST_WEIGHT) + (grad.sum() - g) ** 2 / (hess.sum() - h + LEAST_WEIGHT)
    k = int(gain.argmax()) + 1
    return np.concatenate((_leaves(grad[:k], hess[:k], depth - 1), _leaves(grad[k:], hess[k:], depth - 1)))


def _quadrants(grad: np.ndarray, hess: np.ndarray) -> tuple[float, np.ndarray]:
    """The best cut of a pair's bins into four, its gain and the value of each bin."""
    g = np.pad(grad.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    h = np.pad(hess.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    parts = lambda s: (s[:-1, :-1], s[:-1, -1:] - s[:-1, :-1], s[-1:, :-1] - s[:-1, :-1], s[-1, -1] - s[:-1, -1:] - s[-1:, :-1] + s[:-1, :-1])
    gains = sum(a**2 / (b + LEAST_WEIGHT) for a, b in zip(parts(g), parts(h)))
    i, j = np.unravel_index(gains.argmax(), gains.shape)
    values = [a[i, j] / (b[i, j] + LEAST_WEIGHT) for a, b in zip(parts(g), parts(h))]
    out = np.empty(grad.shape)
    out[:i, :j], out[:i, j:], out[i:, :j], out[i:, j:] = values
    return float(gains[i, j]), out


def train(x: np.ndarray, y: np.ndarray) -> Gam:
    if not len(y):
        return Gam()
    share = float(np.clip(y.mean(), 1e-6, 1 - 1e-6))
    model = Gam(base=float(np.log(share / (1 - share))))
    if y.min() == y.max():
        return model
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        cuts = (values[1:] + values[:-1]) / 2 if len(values) <= BINS else np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1]))
        model.edges.append(cuts)
    b = model.bins(x)
    size = [len(e) + 1 for e in model.edges]
    model.single = [np.zeros(n) for n in size]
    model.coarse = [np.arange(n) * min(n, PAIR_BINS) // n for n in size]
    total = np.full(len(y), model.base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for f, n in enumerate(size):
            r, w = slopes()
            tree = STEP * _leaves(np.bincount(b[:, f], r, n), np.bincount(b[:, f], w, n))
            model.single[f] += tree
            total += tree[b[:, f]]
    rough = np.stack([c[b[:, f]] for f, c in enumerate(model.coarse)], 1)
    wide = [int(c.max()) + 1 for c in model.coarse]

    def grid(f: int, g: int, values: np.ndarray) -> np.ndarray:
        return np.bincount(rough[:, f] * wide[g] + rough[:, g], values, wide[f] * wide[g]).reshape(wide[f], wide[g])

    r, w = slopes()
    ranked = sorted(
        ((-_quadrants(grid(f, g, r), grid(f, g, w))[0], f, g) for f in range(len(size)) for g in range(f) if wide[f] > 1 and wide[g] > 1)
    )
    model.pairs = [(f, g) for _, f, g in ranked[:PAIRS]]
    model.double = [np.zeros((wide[f], wide[g])) for f, g in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for k, (f, g) in enumerate(model.pairs):
            r, w = slopes()
            _, tree = _quadrants(grid(f, g, r), grid(f, g, w))
            model.double[k] += STEP * tree
            total += STEP * tree[rough[:, f], rough[:, g]]
    return model


def _matrix(texts: pd.Series) -> np.ndarray:
    return np.array([figures(t) for t in texts], np.float64).reshape(-1, len(FIGURES))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality", learn: Column | None = None) -> Gam:
    """Train on labelled rows; ``learn`` is a condition on the id column ``id``."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("y")).where("id IS NOT NULL AND y IN (0, 1)")
    known = known if learn is None else known.where(learn)
    known = known.groupBy("id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))

    @F.pandas_udf("array<double>")
    def measured(texts: pd.Series) -> pd.Series:
        return pd.Series(list(_matrix(texts)))

    # At most SAMPLE_ROWS ids, so the broadcast is bounded.
    told = rows.join(F.broadcast(known), "id").groupBy("id", "y").agg(F.min("text").alias("text")).select("id", "y", measured("text").alias("x"))
    got = told.toPandas().sort_values("id")
    x = np.array(got["x"].tolist(), np.float64).reshape(-1, len(FIGURES))
    return train(x, got["y"].to_numpy(np.float64))


def score(docs: DataFrame, model: Gam, text: str = "text") -> DataFrame:
    """All columns of ``docs``, and last ``quality_score``, a double from 0 to 1.

    Where that name is taken, the score's column gets an underscore more.
    """

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(_matrix(texts)))

    return docs.withColumn(fresh("quality_score", docs.columns), scored(F.col(text)))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"), learn=~held_out(F.col("id")))
    out = score(docs.select("doc_id", "text"), model)
    return out.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        F.col("quality_score").alias("score"),
        (F.col("quality_score") >= 0.5).cast("int").alias("predicted"),
    )
