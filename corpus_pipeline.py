"""The corpus pipeline: classify, join near copies, decontaminate, mix, shard."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calgraph.llm.common import discard, made, small, table, written
from calgraph.llm.decontaminate import clean
from calgraph.llm.jaccard_join import near_duplicates
from calgraph.llm.mixing import copies
from calgraph.llm.quality_classifier import accepted, learnable
from calgraph.llm.sharding import shard


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the classifier scores 0.5 or more."""
    return accepted(docs, learnable(table(spark, sf_dir, "labels")))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies: the one with the smallest id, or any if none has an id."""
    columns = docs.columns
    # Ids may be null or repeated, so rows are known by a key that is written with them.
    docs = written(docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"), F.monotonically_increasing_id().alias("key")))
    rows = near_duplicates(docs.select("key", "row.text"), id_col="key").join(docs.select("key", "row.doc_id"), "key")
    first = F.struct(F.col("doc_id").isNull(), "doc_id", "key")
    stay = rows.groupBy("component_id").agg(F.min_by("key", first).alias("key")).select("key")
    return docs.join(small(written(stay)), "key", "left_semi").select(*(F.col(f"row.`{c}`").alias(c) for c in columns))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as its source's target asks for."""
    return copies(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deals the mix to shards, copies together."""
    return shard(docs)


#: Each stage takes (spark, docs, sf_dir); all but the last return the columns of documents.
STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", one_of_each),
    ("benchmark decontamination", decontaminate),
    ("mixing sources to target weights", mix),
    ("sharding", shards),
]

#: The classifier and the joins cannot be put in SQL; tests hold each stage against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, older = table(spark, sf_dir, "documents"), made()
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
        discard(spark, docs, older)
    return docs


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"pipeline": run}
ORACLES: dict[str, str] = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
