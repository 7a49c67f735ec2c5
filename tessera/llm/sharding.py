"""Sharding: a uniform shuffle with exact shard sizes.

Rows fall into blocks by a content hash, so a task that is run again finds the
same rows.  The block-to-shard matrix has the law of the counts under a uniform random
permutation.  It is drawn by halving: the blocks are the leaves of a binary tree, and
each node deals its shard counts to its halves by a multivariate hypergeometric draw
that only the node's place seeds.  A task draws the path from the root to its
subtree, then the subtree; nobody holds the matrix.  Each block permutes its rows and
deals them out by its matrix row, the rows are exchanged, and each shard permutes again.

Law ``rows``: shard sizes differ by one row at most.

Defined results: a null text has size 16 and CRC 0; a null ``doc_id`` is a value
like any other; repeated rows are separate rows and get separate slots; an empty
table gives an empty result; other columns are ignored by the query.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import blocks_for, materialize

#: Rows that one permutation block may hold on average, and the least number of blocks.
ROWS_PER_BLOCK = 65_536
LEAST_BLOCKS = 1024
#: Blocks (a power of two) whose matrix rows one task draws.
BLOCKS_PER_TASK = 1024
#: Bytes counted for each row besides its text.
ROW_OVERHEAD = 16
#: The generator's own draws take populations below this.
_LIBRARY_MOST = 10**9


def draw_hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """One exact hypergeometric draw at any population size.

    Inverts the distribution over the values within many standard deviations of
    the mode; what lies outside has no weight in double precision.
    """
    low, high = max(0, n - bad), min(n, good)
    if low == high:
        return low
    total = good + bad
    mode = min(high, max(low, ((n + 1) * (good + 1)) // (total + 2)))
    var = n * (good / total) * (bad / total) * ((total - n) / max(1, total - 1))
    reach = int(40 * var**0.5) + 40
    k = np.arange(max(low, mode - reach), min(high, mode + reach) + 1, dtype=np.float64)
    up = np.log(good - k[:-1]) + np.log(n - k[:-1]) - np.log(k[:-1] + 1) - np.log(bad - n + k[:-1] + 1)
    weight = np.concatenate([[0.0], np.cumsum(up)])
    weight = np.exp(weight - weight.max()).cumsum()
    return int(k[0]) + int(np.searchsorted(weight, rng.random() * weight[-1], side="right"))


def draw_counts(rng: np.random.Generator, room: np.ndarray, n: int) -> np.ndarray:
    """How many of each kind are among ``n`` drawn from ``room`` without putting back."""
    total = int(room.sum())
    if n in (0, total):
        return room * (n > 0)
    if total < _LIBRARY_MOST:
        return rng.multivariate_hypergeometric(room, n, method="marginals")
    out, rest = np.zeros(len(room), dtype=np.int64), total
    for s, free in enumerate(room.tolist()):
        rest -= free
        out[s] = draw_hypergeometric(rng, free, rest, n)
        n -= int(out[s])
    return out


def _left_share(room: np.ndarray, rows: int, seed: int, depth: int, index: int) -> np.ndarray:
    """What a node gives its left half of ``rows`` rows; the node's place is all that seeds it."""
    return draw_counts(np.random.default_rng([seed, depth, index]), room, rows)


def room_at(totals: np.ndarray, room: np.ndarray, leaf: int, seed: int) -> np.ndarray:
    """Shard counts that reach ``leaf`` of the tree over ``totals`` (a power of two of them)."""
    low, high, depth = 0, len(totals), 0
    while high - low > 1:
        mid = (low + high) // 2
        left = _left_share(room, int(totals[low:mid].sum()), seed, depth, low // (high - low))
        low, high, room = (low, mid, left) if leaf < mid else (mid, high, room - left)
        depth += 1
    return room


def halved(counts: np.ndarray, room: np.ndarray, seed: int, depth: int, index: int) -> np.ndarray:
    """Matrix rows of the subtree over ``counts`` (a power of two of them) that starts at a node's place."""
    if len(counts) == 1:
        return room[None, :]
    half = len(counts) // 2
    left = _left_share(room, int(counts[:half].sum()), seed, depth, index)
    return np.vstack([halved(counts[:half], left, seed, depth + 1, 2 * index), halved(counts[half:], room - left, seed, depth + 1, 2 * index + 1)])


def power_of_two(n: int) -> int:
    return 1 << max(0, math.ceil(math.log2(max(1, n))))


def communication_matrix(block_rows: list[int], shard_rows: list[int], seed: int, per_task: int = BLOCKS_PER_TASK) -> np.ndarray:
    """Counts (block, shard) with the given margins, part by part as tasks draw them."""
    counts = np.zeros(max(per_task, power_of_two(len(block_rows))), dtype=np.int64)
    counts[: len(block_rows)] = block_rows
    parts = counts.reshape(-1, per_task)
    totals, depth = parts.sum(axis=1), int(math.log2(len(parts)))
    room = np.array(shard_rows, dtype=np.int64)
    drawn = [halved(part, room_at(totals, room, k, seed), seed, depth, k) for k, part in enumerate(parts)]
    return np.vstack(drawn)[: len(block_rows)]


def even_sizes(rows: int, shards: int) -> list[int]:
    """Shard sizes that differ by one at most."""
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def dealt_blocks(sizes: DataFrame, blocks: int, shards: int, rows: int, seed: int) -> DataFrame:
    """(block, ends): the matrix row of each block of ``sizes`` (block, count), summed up."""
    tasks = max(1, blocks // BLOCKS_PER_TASK)
    part = (F.col("block") / F.lit(BLOCKS_PER_TASK)).cast("int")
    # One number for each task's subtree: a thousandth of the blocks.
    totals = np.zeros(tasks, dtype=np.int64)
    for r in sizes.groupBy(part.alias("part")).agg(F.sum("count").alias("n")).collect():
        totals[r["part"]] = r["n"]
    room, depth = np.array(even_sizes(rows, shards), dtype=np.int64), int(math.log2(tasks))

    def draw(table: pa.Table) -> pa.Table:
        block, count = (table.column(c).to_numpy() for c in ("block", "count"))
        k = int(block[0]) // BLOCKS_PER_TASK
        counts = np.zeros(min(blocks, BLOCKS_PER_TASK), dtype=np.int64)
        counts[block - k * BLOCKS_PER_TASK] = count
        matrix = halved(counts, room_at(totals, room, k, seed), seed, depth, k)
        ends = matrix[block - k * BLOCKS_PER_TASK].cumsum(axis=1)
        starts = pa.array(np.arange(len(block) + 1) * shards, pa.int32())
        return pa.table({"block": block, "ends": pa.ListArray.from_arrays(starts, pa.array(ends.ravel()))})

    return sizes.withColumn("part", part).groupBy("part").applyInArrow(draw, "block int, ends array<bigint>")


def shard_rows(df: DataFrame, shards: int, key: list[Column], seed: int = 7) -> DataFrame:
    """Add ``shard`` and ``slot`` (gapless from 0 within a shard) to every row of ``df``.

    ``key`` are the columns whose hash orders the rows; rows that agree in all of
    them are interchangeable.
    """
    one, two = (F.xxhash64(F.lit(f"{word}-{seed}"), *key) for word in ("deal", "settle"))
    # The caller's columns travel in one struct, so none clashes with the working ones.
    keyed = df.select(F.struct("*").alias("row"), one.alias("one"), two.alias("two"))
    rows = keyed.count()
    n = power_of_two(blocks_for(rows, ROWS_PER_BLOCK, LEAST_BLOCKS))
    blocked = keyed.withColumn("block", F.pmod("one", F.lit(n)).cast("int"))
    sizes = materialize(blocked.groupBy("block").count(), "blocks")
    deal = dealt_blocks(sizes, n, shards, rows, seed).withColumnRenamed("block", "to")
    permuted = Window.partitionBy("block").orderBy("one", "two")
    dealt = (
        blocked.withColumn("rank", F.row_number().over(permuted))
        .join(deal, F.col("block") == F.col("to"))
        .select("row", "two", F.expr("size(filter(ends, e -> e < rank))").cast("int").alias("shard"))
    )
    # The second permutation orders a shard by a fresh hash.  The hash's leading 31
    # bits, scaled to the number of runs, cut the shard: no task holds a whole one.
    runs = max(1, n // shards)
    cut = F.shiftright(F.shiftrightunsigned("two", 33) * F.lit(runs).cast("long"), 31).cast("int")
    cells = dealt.withColumn("run", cut)
    counts = cells.groupBy("shard", "run").count()
    before = Window.partitionBy("shard").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        F.col("shard").alias("s"), F.col("run").alias("r"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start")
    )
    settled = Window.partitionBy("shard", "run").orderBy("two")
    placed = cells.withColumn("at", F.row_number().over(settled)).join(
        starts, (F.col("shard") == F.col("s")) & (F.col("run") == F.col("r"))
    )
    kept = [F.col("row")[c].alias(c) for c in df.columns if c.lower() not in ("shard", "slot")]
    return placed.select(*kept, "shard", (F.col("start") + F.col("at") - 1).cast("long").alias("slot"))


def shard_documents(docs: DataFrame, shards: int = 40, seed: int = 7) -> DataFrame:
    """The digest report: size, CRC, shard and slot of every document."""
    text = F.coalesce("text", F.lit(""))
    light = materialize(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(text) + F.lit(ROW_OVERHEAD)).cast("long").alias("size"),
            F.crc32(F.encode(text, "utf-8")).alias("text_crc32"),
        ),
        "sizes",
    )
    placed = shard_rows(light, shards, [F.col("doc_id"), F.col("size"), F.col("text_crc32")], seed)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
