"""A corpus pipeline: five stages over ``documents``, each written as Parquet before the next one reads it.

Toxic documents go, then documents of low quality, then all but one of each class of near duplicates, then documents that hold a
benchmark item; the last stage packs what is left. The filtering stages return the columns that they were given, the last one packed pieces.
Null texts count as empty ones: they are neither toxic nor benchmark items, and one text without words is kept as the one of its class
if the quality stage keeps it. Every row is judged by itself, whatever its id. Texts are read whole in each stage and shuffled in none, but for the few that are compared with others.
As executors live through all stages, each stage lets Arrow batches hold 1,000 rows where the session has Spark's default of 10,000.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecatlas.llm import decontaminate, near_dup, packing, quality, toxicity
from vecatlas.llm.common import folder, in_small_batches, table
from vecatlas.llm.queries import QUALITY_AT_LEAST, tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    in_small_batches(spark)
    return toxicity.without_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"), F.lit(True)))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    in_small_batches(spark)
    return quality.of_quality(docs, quality.fit(docs, table(spark, sf_dir, "labels")), QUALITY_AT_LEAST)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    in_small_batches(spark)
    return near_dup.without_copies(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    in_small_batches(spark)
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    in_small_batches(spark)
    return packing.pack(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("quality classifier", keep_quality),
    ("MinHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what each returns is a table in the shared folder, the last one too."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        place = folder(spark, "stage-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(place)
        docs = spark.read.parquet(place)
    return docs


#: SQL can express neither trained classifiers nor signatures; the tests hold each stage against brute force.
ORACLE_SQL = None

QUERIES = {"pipeline": run}
ORACLE = {"pipeline": ORACLE_SQL}
