"""Mixing sources to target weights: temperature, budgets, block permutations.

Weights are the token shares of the sources raised to an exponent between one (as
the corpus is) and zero (all alike), and normalised. The exponent is bisected:
it is the largest that reaches a target entropy (a share of the entropy of equal
weights), but never so small that a source would be repeated more than
``max_repeats`` times. Each pass over the source totals evaluates the 63 midpoints
of six bisections at once.

The largest repetition follows from the weights when the source repeated least is
read once, so no document is lost. A source's budget is read as so many whole
epochs and a part. Its documents are dealt into blocks of about ``BLOCK_TOKENS``
tokens or ``BLOCK_DOCS`` documents; each epoch orders the blocks, and the documents
in each block, by hashes of its own. The part takes whole blocks in that order,
and of the last block documents as long as the budget lasts.

Every document occurs once per epoch that takes it, with the epoch and its
``place`` in [0, 1) within its source's stream; the mix is the order by place. Sums run
along documents of a block, blocks of a shelf and shelves of a source, of which there are
4,096; so a source with a third of all rows is spread over many tasks in each step.

Tokens are runs of characters that are not white space. Defined results: a null
text has none; documents without tokens use no budget and come in whole epochs
only; a source without tokens is read once; a null source is a source; rows with
shared or null ids each occur by themselves, but rows repeated in all columns are
read together, at one place. Empty input gives no rows.
Columns of the input are kept whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kantar.llm.shared import cut, fresh, table

MAX_REPEATS = 4.0
BLOCK_TOKENS = 1 << 20
BLOCK_DOCS = 10_000
#: Shelves into which a source's blocks are divided by the order of an epoch, as a power of two.
SHELVES_LOG = 12
#: Sources up to which their budgets are broadcast; beyond, a shuffled join.
BROADCAST_SOURCES = 100_000
SEED = 17


def token_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"\S+")).cast("long")


def _bisect(totals: DataFrame, holds) -> float:
    """The largest exponent in [0, 1] for which ``holds(entropy, exponent)``, which holds below and not above; 0 if none."""
    lo, hi, passes, points = 0.0, 1.0, 5, 63
    for _ in range(passes):
        grid = [lo + (hi - lo) * (k + 1) / (points + 1) for k in range(points)]
        log = F.log("share")
        sums = totals.agg(
            F.array(*[F.sum(F.exp(log * a)) for a in [*grid, hi]]).alias("z"), F.array(*[F.sum(F.exp(log * a) * log) for a in [*grid, hi]]).alias("l")
        ).first()
        good = [holds(math.log(z) - a * x / z, a) for a, z, x in zip([*grid, hi], sums["z"], sums["l"])]
        if good[-1]:
            return hi
        k = sum(good)
        lo, hi = ([lo, *grid][k], [*grid, hi][k])
    return lo


def exponent(totals: DataFrame, max_repeats: float = MAX_REPEATS, target_entropy: float | None = None) -> float:
    """``totals`` has a row per source with tokens, ``n``."""
    ends = totals.agg(F.count("*").alias("s"), F.min("n").alias("least"), F.max("n").alias("most")).first()
    if not ends["s"] or ends["s"] == 1 or ends["least"] == ends["most"]:
        return 1.0
    spread = math.log(ends["most"] / ends["least"])
    shares = totals.select((F.col("n") / F.lit(ends["most"])).alias("share"))
    # Repeats fall as the exponent grows: bisect for the last exponent that repeats too often.
    floor = _bisect(shares, lambda _, a: (1 - a) * spread > math.log(max_repeats))
    if target_entropy is None:
        return floor
    wanted = _bisect(shares, lambda h, _: h >= target_entropy * math.log(ends["s"]))
    return max(floor, wanted)


def budgets(docs: DataFrame, source: str, tokens: str, max_repeats: float, target_entropy: float | None) -> DataFrame:
    """(source, n, weight, budget, epochs, part, blocks) for every source."""
    totals = cut(docs.groupBy(F.col(source).alias("source")).agg(F.sum(tokens).alias("n"), F.count("*").alias("docs")), "mix-totals")
    told = totals.where("n > 0")
    a = exponent(told, max_repeats, target_entropy)
    most = told.agg(F.max("n")).first()[0] or 1
    repeats = F.when(F.col("n") > 0, F.least(F.lit(float(max_repeats)), F.pow(F.lit(float(most)) / F.col("n"), F.lit(1 - a)))).otherwise(F.lit(1.0))
    budget = F.floor(repeats * F.col("n") + F.lit(1e-6)).cast("long")
    z = told.agg(F.sum(F.pow(F.col("n").cast("double"), F.lit(a)))).first()[0] or 1.0
    return totals.select(
        "source",
        "n",
        F.when(F.col("n") > 0, F.pow(F.col("n").cast("double"), F.lit(a)) / F.lit(z)).otherwise(F.lit(0.0)).alias("weight"),
        budget.alias("budget"),
        F.when(F.col("n") > 0, F.floor(budget / F.col("n"))).otherwise(F.lit(1)).cast("int").alias("epochs"),
        F.when(F.col("n") > 0, budget % F.col("n")).otherwise(F.lit(0)).alias("part"),
        F.greatest(F.ceil(F.col("n") / BLOCK_TOKENS), F.ceil(F.col("docs") / BLOCK_DOCS)).alias("blocks"),
    )


def mix(
    docs: DataFrame,
    source: str = "source",
    text: str = "text",
    max_repeats: float = MAX_REPEATS,
    target_entropy: float | None = None,
    seed: int = SEED,
) -> DataFrame:
    """The columns of ``docs`` with ``tokens``, ``epoch`` (from 0), ``place`` and ``weight``, a row for each reading.

    Where one of these names is taken, the added column gets an underscore more.
    """
    at = lambda name: F.col(f"c{docs.columns.index(name)}")
    hashed = [F.col(f"`{c}`") for c in docs.columns if not _hashless(docs, c)]
    rows = docs.select(
        # Numbered names cannot clash, and what is not asked for in the end is pruned.
        *[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns)],
        # 128 bits, so that rows that differ never share a key in practice.
        F.xxhash64(F.lit(seed), *hashed).alias("h"),
        F.xxhash64(F.lit(seed + 1), *hashed).alias("h2"),
    )
    # Places are found without the texts, which join them in the end, once.
    narrow = cut(
        rows.select("h", "h2", at(source).alias("s"), token_count(at(text)).alias("own"))
        .groupBy("h", "h2")
        .agg(F.first("s").alias("s"), F.first("own").alias("own"), F.sum("own").alias("tokens")),
        "mix-rows",
    )
    plan = cut(budgets(narrow, "s", "tokens", max_repeats, target_entropy), "mix-plan")
    held = F.broadcast(plan) if plan.count() <= BROADCAST_SOURCES else plan
    dealt = narrow.join(held, F.col("s").eqNullSafe(F.col("source"))).withColumn("block", F.pmod("h", "blocks"))
    read = F.explode(F.sequence(F.lit(0), F.col("epochs") - F.when(F.col("part") > 0, 0).otherwise(1)))
    blocks = dealt.groupBy("s", "block", "n", "epochs", "part").agg(F.sum("tokens").alias("size"))
    along = lambda by, order: Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    turn = F.xxhash64(F.lit(seed), "s", "epoch", "block")
    turned = cut(blocks.withColumn("epoch", read).withColumn("turn", turn).withColumn("shelf", F.shiftright("turn", 64 - SHELVES_LOG)), "mix-blocks")
    shelves = turned.groupBy("s", "epoch", "shelf").agg(F.sum("size").alias("held"))
    shelves = shelves.withColumn("ahead", F.coalesce(F.sum("held").over(along(("s", "epoch"), ("shelf",))), F.lit(0)))
    shelves = shelves.select(F.col("s").alias("ss"), F.col("epoch").alias("se"), F.col("shelf").alias("sh"), "ahead")
    before = (
        turned.join(shelves, F.col("s").eqNullSafe(F.col("ss")) & (F.col("epoch") == F.col("se")) & (F.col("shelf") == F.col("sh")))
        .withColumn("before", F.col("ahead") + F.coalesce(F.sum("size").over(along(("s", "epoch", "shelf"), ("turn", "block"))), F.lit(0)))
        # Blocks that start beyond the part are not read in the last epoch.
        .where((F.col("epoch") < F.col("epochs")) | (F.col("before") < F.col("part")))
        .select(F.col("s").alias("bs"), F.col("epoch").alias("be"), F.col("block").alias("bb"), "before")
    )
    every = dealt.withColumn("epoch", read)
    placed = every.join(before, F.col("s").eqNullSafe(F.col("bs")) & (F.col("epoch") == F.col("be")) & (F.col("block") == F.col("bb")))
    inside = Window.partitionBy("s", "epoch", "block").orderBy(F.xxhash64(F.lit(seed), "h", "epoch"), "h", "h2").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    told = placed.withColumn("upto", F.col("before") + F.sum("tokens").over(inside))
    kept = told.where((F.col("epoch") < F.col("epochs")) | ((F.col("upto") <= F.col("part")) & (F.col("tokens") > 0)))
    place = (F.col("epoch") * F.col("n") + F.col("upto") - F.col("tokens")) / F.greatest("budget", F.lit(1)).cast("double")
    # A document has at most max_repeats readings and one, so this list is bounded.
    readings = kept.groupBy("h", "h2", "weight", "own").agg(F.collect_list(F.struct(F.col("epoch").cast("int").alias("epoch"), place.alias("place"))).alias("readings"))
    out = rows.join(readings, ["h", "h2"]).withColumn("x", F.explode("readings"))
    added = {"tokens": F.col("own"), "epoch": F.col("x.epoch"), "place": F.col("x.place"), "weight": F.col("weight")}
    return out.select(*[at(c).alias(c) for c in docs.columns], *[value.alias(fresh(name, docs.columns)) for name, value in added.items()])


def _hashless(docs: DataFrame, name: str) -> bool:
    """Maps have no hash in Spark."""
    return "map<" in docs.schema[name].dataType.simpleString()


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "source", "tokens", "epoch", "place", "weight")
