"""One poll of all feeds: due check, documents, dedup, ingest, new state, history.

A poll is a batch, so a one-shot runner calls it once and a continuous one from
``foreachBatch`` of a ticking stream.  A feed that failed backs off and does not
keep the others from going on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.ingest import backoff_seconds, due, latest_state, merged_seen, resolved_interval, resolved_limit, unseen
from tessera.sources.landed import feed_documents
from tessera.sources.state import IngestState, load_state, save_state

HISTORY = ("ts", "src_id", "url", "ok", "err", "interval_s", "limit", "fetched", "new", "fail_count", "next_run")

#: (due sources) -> (src_id, xml, err): what fetching gave; xml is null where it failed.
Fetch = Callable[[DataFrame], DataFrame]


def poll(engine, sources: DataFrame, fetch: Fetch, state_path: str, history_path: str | None, now: str) -> IngestState:
    """Run the feeds that are due at ``now`` and return the state after it."""
    spark = sources.sparkSession
    state, at = load_state(spark, state_path), F.to_timestamp(F.lit(now))
    known = sources.withColumnRenamed("id", "src_id").join(state.feeds, "src_id", "left")
    ready = due(known, at).select(
        "src_id",
        "url",
        "lang",
        "title_prefix",
        resolved_limit(F.col("limit"), F.col("default_limit")).alias("limit"),
        resolved_interval(F.col("interval_s"), F.col("default_interval_s")).alias("interval_s"),
        F.coalesce("fail_count", F.lit(0)).alias("before"),
    )
    # What fetching gave is written once: it may differ when asked again.
    landed = f"{state_path}/fetched/v{state.version + 1:08d}"
    fetch(ready).select("src_id", "xml", "err").write.mode("overwrite").parquet(landed)
    got = ready.join(spark.read.schema("src_id string, xml string, err string").parquet(landed), "src_id", "left")
    docs = feed_documents(got.where(F.col("xml").isNotNull()))
    fresh = unseen(docs, state.seen).dropDuplicates(["doc_id"])
    fresh.write.mode("overwrite").parquet(f"{landed}-new")
    fresh = spark.read.schema(fresh.schema).parquet(f"{landed}-new")
    engine.ingest(fresh.select("doc_id", "title", "body", "url", "timestamp", "lang"))

    counted = lambda df, name: df.groupBy("src_id").agg(F.count("*").alias(name))
    fails = F.when(F.col("ok"), 0).otherwise(F.col("before") + 1)
    runs = (
        got.withColumn("ok", F.col("xml").isNotNull())
        .join(counted(docs, "fetched"), "src_id", "left")
        .join(counted(fresh, "new"), "src_id", "left")
        .withColumn("fail_count", fails.cast("int"))
        .withColumn("wait", F.when(F.col("ok"), F.col("interval_s")).otherwise(backoff_seconds(F.col("interval_s"), F.col("fail_count"))))
        .select(
            at.alias("ts"), "src_id", "url", "ok", "err", "interval_s", "limit",
            F.coalesce("fetched", F.lit(0)).alias("fetched"), F.coalesce("new", F.lit(0)).alias("new"), "fail_count",
            F.timestamp_seconds(F.unix_seconds(at) + F.col("wait")).alias("next_run"),
        )
    )
    if history_path:
        runs.select(*HISTORY).withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").json(history_path)
    news = runs.select("src_id", "next_run", F.col("ts").alias("last_checked"), "fail_count")
    feeds = latest_state(state.feeds.unionByName(news), "src_id", "last_checked")
    return save_state(IngestState(merged_seen(state.seen, fresh), feeds, state.version), state_path)


def drop_old_history(spark: SparkSession, path: str, today: str, days: int = 14) -> list[str]:
    """Delete history folders of days before the limit; returns their names."""
    files = spark._jvm.org.apache.hadoop.fs
    root = files.Path(f"{path}/day=*")
    store = root.getFileSystem(spark._jsc.hadoopConfiguration())
    first = spark.range(1).select(F.date_sub(F.lit(today).cast("date"), days).cast("string")).first()[0]
    gone = []
    for status in store.globStatus(root) or []:
        name = status.getPath().getName()
        if name.removeprefix("day=") < first:
            store.delete(status.getPath(), True)
            gone.append(name)
    return sorted(gone)
