"""A training corpus from raw documents, in five stages.

Every stage takes the documents that the one before kept, read from Parquet, and
decides on them alone. All but the last return the columns of ``documents``.

Each stage takes nulls in any column, empty tables and further columns of any
name; what becomes of odd rows is stated in the operator that the stage calls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kantar.llm import decontaminate, line_dedup, mixing, quality_gam, simhash
from kantar.llm.shared import cut, fresh, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores under 0.5 go."""
    model = quality_gam.fit(docs, table(spark, sf_dir, "labels"), learn=~quality_gam.held_out(F.col("id")))
    scored = quality_gam.score(docs, model)
    name = scored.columns[-1]
    return scored.where(F.col(name) >= 0.5).drop(name)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated multi-line chunks go; so do documents of which no text is left.

    ``n_chars`` follows the text where chunks were removed.
    """
    count = fresh("n_removed", docs.columns)
    out = line_dedup.dedup_lines(docs, count=count)
    lost = F.col(count) > 0
    out = out.where(~(lost & (F.trim(F.regexp_replace("text", r"\s+", " ")) == "")))
    return out.withColumn("n_chars", F.when(lost, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)).drop(count)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: five-word shingles, similarity 0.8."""
    return simhash.keep_one(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    out = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark"))
    name = out.columns[-1]
    return out.where(F.size(name) == 0).drop(name)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each reading of a document in the mix, with its epoch and place."""
    return mixing.mix(docs)


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", benchmark_leaks),
    ("mixing", mixed),
]

#: The classifier and the fingerprints have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
