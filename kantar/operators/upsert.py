"""Upserts as joins, rules as columns, logs as appends. Each returns a new DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kantar.operators.pricing import first_by


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: list, row_id: str | None = None, keep_first: tuple[str, ...] = (), fixed: tuple[str, ...] = ()) -> DataFrame:
    """``old`` with ``new`` written over it by ``keys``; nulls in keys are equal.

    Of several new rows with a key the first by ``order`` counts. ``row_id`` and the
    columns in ``fixed`` keep the old value of a row that exists; those in
    ``keep_first`` take the new value only where the old one is null; all others
    take the new value.
    """
    last = first_by(new, keys, order)
    o, n = old.alias("o"), last.alias("n")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}"))
    both = o.withColumn("_old", F.lit(True)).alias("o").join(n.withColumn("_new", F.lit(True)).alias("n"), same, "full_outer")
    had, got = F.col("o._old").isNotNull(), F.col("n._new").isNotNull()

    def value(c: str) -> Column:
        a, b = F.col(f"o.{c}"), F.col(f"n.{c}")
        if c in keys:
            return F.when(had, a).otherwise(b)
        if c == row_id or c in fixed:
            return F.when(had, a).otherwise(b)
        if c in keep_first:
            return F.coalesce(a, b)
        return F.when(got, b).otherwise(a)

    return both.select(*[value(c).alias(c) for c in old.columns])


def keep_geocoding(old: DataFrame, new: DataFrame, keys: list[str], geocoding: list[str]) -> DataFrame:
    """Store rows without coordinates over stored ones: geocoding stays only while address and city do.

    A null on either side counts as a change, as in SQL comparisons.
    """
    o, n = old.alias("o"), new.alias("n")
    same_key = F.lit(True)
    for k in keys:
        same_key = same_key & F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}"))
    both = o.withColumn("_old", F.lit(True)).alias("o").join(n.withColumn("_new", F.lit(True)).alias("n"), same_key, "full_outer")
    had, got = F.col("o._old").isNotNull(), F.col("n._new").isNotNull()
    stays = F.coalesce((F.trim("o.address") == F.trim("n.address")) & (F.trim("o.city") == F.trim("n.city")), F.lit(False))

    def value(c: str) -> Column:
        if c in keys:
            return F.when(had, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}"))
        if c in geocoding:
            return F.when(~got | stays, F.col(f"o.{c}"))
        return F.when(got, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))

    return both.select(*[value(c).alias(c) for c in old.columns])


def split_by_rules(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejects with ``broken``: the names of the rules that fail). A rule that is null holds, as a SQL CHECK does."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(rule, F.lit(True)), name) for name, rule in rules.items()]))
    told = df.withColumn("broken", broken)
    return told.where(F.size("broken") == 0).drop("broken"), told.where(F.size("broken") > 0)
