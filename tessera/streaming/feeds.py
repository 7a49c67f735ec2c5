"""Structured Streaming: continuous ingest and the feed scheduler's keyed state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.operators.ingest import DEFAULT_INTERVAL_S, MOST_BACKOFF_S

DOCS = "doc_id string, title string, body string, url string, timestamp string, lang string, ingest_seq long"
OUTCOMES = "src_id string, ts timestamp, ok boolean, interval_s int"
STATES = "src_id string, fail_count int, last_checked timestamp, next_run timestamp"


def document_stream(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """Landed document files as a stream."""
    return spark.readStream.schema(DOCS).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def deduplicated(stream: DataFrame, by: str = "doc_id", late: str | None = None, time: str = "ts") -> DataFrame:
    """First arrivals only; with ``late`` the ids that are remembered are bounded by event time."""
    if late is None:
        return stream.dropDuplicates([by])
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([by])


def ingest_stream(stream: DataFrame, ingest: Callable[[DataFrame], object], checkpoint: str, continuous: bool = False):
    """Feed every micro-batch to ``ingest`` (as :meth:`SearchEngine.ingest`), which is idempotent by doc_id."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: ingest(batch))
    writer = writer.trigger(processingTime="10 seconds") if continuous else writer.trigger(availableNow=True)
    return writer.start()


def next_state(failures: int, ok: bool, interval: int | None) -> tuple[int, int]:
    """(failures in a row, seconds to the next run) after an outcome."""
    interval = interval or DEFAULT_INTERVAL_S
    failures = 0 if ok else failures + 1
    return failures, int(min(interval * 2**failures, MOST_BACKOFF_S)) if failures else interval


def feed_states(outcomes: DataFrame) -> DataFrame:
    """Keyed state of every feed from a stream of fetch outcomes; one row an update."""

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(batches).sort_values("ts")
        failures = state.get[0] if state.exists else 0
        wait, last = DEFAULT_INTERVAL_S, None
        for row in rows.itertuples():
            failures, wait = next_state(failures, bool(row.ok), None if pd.isna(row.interval_s) else int(row.interval_s))
            last = row.ts
        state.update((failures,))
        yield pd.DataFrame(
            {"src_id": [key[0]], "fail_count": [failures], "last_checked": [last], "next_run": [last + pd.Timedelta(seconds=wait)]}
        )

    return outcomes.groupBy("src_id").applyInPandasWithState(
        advance, STATES, "failures int", "update", GroupStateTimeout.NoTimeout
    )


def write_history(runs: DataFrame, path: str, checkpoint: str):
    """Append a stream of run records as JSON, one folder a UTC day."""
    return (
        runs.withColumn("day", F.to_date("ts"))
        .writeStream.partitionBy("day")
        .format("json")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
