"""Ingest state: seen ids and feed states as versions that a manifest publishes.

A version is written in full beside the others and becomes current by one appended
manifest row, so readers never see half of it and a failed write changes nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEEN = "doc_id string"
FEEDS = "src_id string, next_run timestamp, last_checked timestamp, fail_count int"
MANIFEST = "version int, saved_at timestamp"


@dataclass(frozen=True)
class IngestState:
    seen: DataFrame
    feeds: DataFrame
    version: int


def load_state(spark: SparkSession, path: str) -> IngestState:
    """The current version; empty where nothing was saved yet."""
    try:
        version = spark.read.schema(MANIFEST).parquet(f"{path}/manifest").agg(F.max("version")).first()[0]
    except AnalysisException:
        version = None
    if version is None:
        return IngestState(spark.createDataFrame([], SEEN), spark.createDataFrame([], FEEDS), 0)
    read = lambda name, schema: spark.read.schema(schema).json(f"{path}/v{version:08d}/{name}")
    return IngestState(read("seen", SEEN), read("feeds", FEEDS), version)


def save_state(state: IngestState, path: str) -> IngestState:
    """Write ``state`` as the next version, seen ids in order, and publish it."""
    spark, version = state.seen.sparkSession, state.version + 1
    state.seen.select("doc_id").distinct().orderBy("doc_id").write.mode("overwrite").json(f"{path}/v{version:08d}/seen")
    state.feeds.select("src_id", "next_run", "last_checked", "fail_count").write.mode("overwrite").json(f"{path}/v{version:08d}/feeds")
    row = spark.range(1).select(F.lit(version).cast("int").alias("version"), F.current_timestamp().alias("saved_at"))
    row.coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    return load_state(spark, path)
