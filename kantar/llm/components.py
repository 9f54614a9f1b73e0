"""Connected components of a link table, by alternating large and small stars.

Links move as rows; nothing of the graph is collected. In each step a node's
neighbours learn the least node of the neighbourhood: least values come from an
aggregate with map-side combining and return by a join, which adaptive
execution may split where one node has very many links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kantar.llm.shared import cut


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    return (
        both.join(least, "a")
        .where(F.col("b") > F.col("a"))
        .select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
        .where("a <> b")
    )


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    across = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return across.union(least.select("a", F.col("m").alias("b")))


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(a, b): every linked node but the least of its component, and that least node.

    ``links`` has the columns a and b of one orderable type, in any direction,
    repeats allowed. Rows with a null end, or whose ends are equal, link nothing.
    """
    now = cut(links.where("a <> b").select("a", "b").distinct(), name)
    mark = None
    while True:
        told = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if told[0] == 0 or told == mark:
            return now
        mark = told
        now = cut(_small_star(_large_star(now).distinct()).distinct(), name)
