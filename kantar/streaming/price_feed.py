"""Price deliveries as a stream of files: an extension of the batch import.

New CSV files of a landing folder are parsed as in a batch, and each micro-batch is
imported over the tables of the version before. Offsets are in the checkpoint, so
a delivery is imported once; a batch that is tried again writes the same version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kantar.sources.csv_files import PRICE_COLUMNS, parse_prices


def price_stream(spark: SparkSession, landing: str) -> DataFrame:
    """Price rows of all files that arrive, as text columns."""
    schema = ", ".join(f"`{c}` string" for c in PRICE_COLUMNS)
    options = {"sep": ";", "header": "true", "escape": '"', "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"}
    return spark.readStream.schema(schema).options(**options).csv(landing)


def newest_prices(spark: SparkSession, landing: str, late: str = "7 days") -> DataFrame:
    """The running newest price per product and format; days older than the watermark are dropped."""
    good, _, _ = parse_prices(price_stream(spark, landing))
    timed = good.withColumn("day", F.col("price_date").cast("timestamp")).withWatermark("day", late)
    return timed.groupBy("source_product_key", "format_name").agg(
        F.max_by(F.struct("regular_price", "discounted_price"), "price_date").alias("price"), F.max("price_date").alias("price_date")
    )


def daily_averages(spark: SparkSession, landing: str, late: str = "7 days") -> DataFrame:
    """Average regular price per product group and day, given out once a day is closed."""
    good, _, _ = parse_prices(price_stream(spark, landing))
    timed = good.withColumn("day", F.col("price_date").cast("timestamp")).withWatermark("day", late)
    return timed.groupBy(F.window("day", "1 day"), "category_code").agg(F.avg("regular_price").alias("average_price"), F.count("*").alias("prices"))


def import_stream(spark: SparkSession, landing: str, checkpoint: str, save) -> StreamingQuery:
    """Hand each micro-batch of raw rows and its number to ``save``; ends when all files that are there are done."""
    return (
        price_stream(spark, landing).writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
