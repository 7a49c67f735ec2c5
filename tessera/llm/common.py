"""Helpers that the corpus operators share: tables, shared folders, sizes."""

from __future__ import annotations

import gc
import math
import pickle
import time
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.kernels import released

#: Used only where a session of one machine names no shared folder, as in local tests.
FALLBACK_SHARED_DIR = "/tmp/checkpoints"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read by Spark so that any store Spark knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session or its context names it.

    Fails on a cluster that names none: a local folder would lose tables.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = held.get() if held.isDefined() else None
    if not named:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = FALLBACK_SHARED_DIR
    return named.rstrip("/")


def _own_prefix(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tessera-{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, label: str, release: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back; ``release`` frees its shuffle files at once.

    Cuts the lineage at a table that survives lost executors.  The folder is
    named ``tessera-<application>-<label>-<uuid>``; whoever owns the shared folder may
    drop such folders once the result that was built on them has been written.
    """
    spark = df.sparkSession
    path = f"{_own_prefix(spark)}-{label}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    if release:
        # The write's own plan is garbage now; collecting it lets Spark's cleaner drop its
        # shuffle files.  The second turn catches what the first one only let go of.
        for _ in range(2):
            gc.collect()
            spark.sparkContext._jvm.System.gc()
            time.sleep(0.5)
    return spark.read.schema(schema).parquet(path)


def drop_intermediates(spark: SparkSession) -> int:
    """Remove the folders that :func:`materialize` left in this application; only when no result that builds on them is still wanted."""
    paths = spark._jvm.org.apache.hadoop.fs.Path
    pattern = paths(f"{_own_prefix(spark)}-*")
    files = pattern.getFileSystem(spark._jsc.hadoopConfiguration())
    found = files.globStatus(pattern) or []
    for status in found:
        files.delete(status.getPath(), True)
    return len(found)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def blocks_for(rows: int, rows_per_block: int, least: int) -> int:
    """How many hash blocks hold ``rows``: grows with the input, never below ``least``."""
    return max(least, math.ceil(rows / max(1, rows_per_block)))


def prime(least: int) -> int:
    """The least odd prime from ``least`` on: a number of buckets that no stride of keys favours."""
    n = least | 1
    while any(n % k == 0 for k in range(3, int(n**0.5) + 1, 2)):
        n += 2
    return n


def ascii_lower(col):
    """Lower-case A-Z only.

    ``lower`` is the fast path; it is exact where a text holds no other capital,
    which the code-point and byte counts show for pure ASCII.
    """
    return F.when(F.octet_length(col) == F.char_length(col), F.lower(col)).otherwise(
        F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    )


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Keep Arrow batches near a few MB of text: Python workers then need little memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def fit_on_worker(sample: DataFrame, fit: Callable[[pa.Table], dict | None]) -> dict | None:
    """``fit`` over a bounded sample by doc_id, in one task; only the fitted values reach the driver.

    The sample's size is a parameter of whoever calls, so the task is as small at
    any corpus size.  None when the sample is empty.
    """

    def run(batches):
        held = list(batches)
        if held:
            found = fit(pa.Table.from_batches(held).combine_chunks())
            yield pa.record_batch([pa.array([pickle.dumps(found)], pa.large_binary()).cast(pa.binary())], names=["fitted"])

    row = sample.repartition(1).sortWithinPartitions("doc_id").mapInArrow(released(run), "fitted binary").first()
    return None if row is None else pickle.loads(bytes(row["fitted"]))
