"""What the operators of this subpackage share: table access and lineage cuts."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables, read by Spark (the path may be remote)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the cluster's ``spark.checkpoint.dir``. Only where that is unset, as
    in a plain local session, a folder under the warehouse is used.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    return root.rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Later stages then read a file that every executor can open, so a lost
    executor costs only its running tasks and nothing upstream runs twice.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: A key of more rows than this counts as hot; so many hot keys at most are broadcast (under 10 MB).
HOT_ROWS, HOT_KEYS = 500, 200_000


def among(rows: DataFrame, keys: DataFrame, on: list[str], n: str) -> DataFrame:
    """The rows whose ``on`` is in ``keys``; ``n`` of a key is the number of its rows.

    Rows of hot keys stay where they are and meet the hot keys by broadcast, so that
    no task gets all rows of one. With too many hot keys for that, none holds
    much of the data, and adaptive execution splits what is uneven. Both
    inputs are read more than once and should be written tables.
    """
    hot = keys.where(F.col(n) > HOT_ROWS).select(*on)
    if not 0 < hot.count() <= HOT_KEYS:
        return rows.join(keys.select(*on), on, "left_semi").select(*rows.columns)
    rest = rows.join(F.broadcast(hot), on, "left_anti").join(keys.where(F.col(n) <= HOT_ROWS).select(*on), on, "left_semi")
    return rows.join(F.broadcast(hot), on, "left_semi").unionByName(rest).select(*rows.columns)


def text_id(text: Column) -> Column:
    """The address of a text: 16 bytes of its SHA-256; null counts as empty."""
    return F.substring(F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256)), 1, 16)


def fresh(name: str, taken: list[str]) -> str:
    """``name``, with underscores appended while a column of that name exists (in either case)."""
    lower = {t.lower() for t in taken}
    while name.lower() in lower:
        name += "_"
    return name
