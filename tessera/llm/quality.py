"""Quality classifier: supervised hashed word and character n-gram embeddings.

Features of a text: its words (lower-cased), whether each word repeats the one
before, and its cased byte n-grams with punctuation.  Each kind is averaged over
the whole text, and a softmax over the two labels gives the score.

Defined results: a null or empty text is scored from the learned bias alone; a
null ``doc_id`` is not held out and is not learned from; of several labels for one
id the highest counts; without labels of both kinds every score is 0.5; repeated
rows keep one row each; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import embedding, kernels
from tessera.llm.common import small_batches

SETTINGS = embedding.Settings(sample_rows=4000, epochs=5)
THRESHOLD = 0.3
GRAMS = (2, 3)


def extract(data: np.ndarray, offsets: np.ndarray):
    tokens = kernels.Tokens(data, offsets, kernels.SOLID_BYTES)
    names = tokens.hashes()
    size = 64 - SETTINGS.bits
    same = np.zeros(len(names), dtype=np.int64)
    if len(names):
        same[1:] = names[1:] == names[:-1]
        heads = tokens.first[:-1]
        same[heads[heads < len(names)]] = 0
    groups = [
        ((names >> np.uint64(size)).astype(np.int64), tokens.first[:-1], tokens.first[1:]),
        (same, tokens.first[:-1], tokens.first[1:]),
    ]
    for n in GRAMS:
        groups.append(
            (kernels.grams(data, n, SETTINGS.bits), offsets[:-1], np.maximum(offsets[1:] - n + 1, offsets[:-1]))
        )
    return groups


def learn(docs: DataFrame, labels: DataFrame, settings: embedding.Settings = SETTINGS) -> embedding.Model | None:
    """Fit on a bounded sample of labelled rows outside the held-out fold."""
    marks = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
        .where(~embedding.held_out(F.col("doc_id"), 5, 0))
        .groupBy(F.col("doc_id").alias("_id"))
        .agg(F.max("quality").cast("int").alias("label"))
    )
    chosen = embedding.training_sample(marks, F.col("_id"), settings.sample_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    return embedding.fit_sample(rows, [0, 1], extract, settings)


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The digest report: quality score of every whole text."""
    small_batches(docs.sparkSession)
    model = learn(docs, labels)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), embedding.held_out(F.col("doc_id"), 5, 0).alias("held_out"), "text"
    )

    def score(batches):
        for batch in batches:
            for part, data, offsets in kernels.chunks(batch):
                p = model.probabilities(embedding.logits_of(data, offsets, model, extract))[:, 1]
                yield pa.record_batch(
                    [part.column("doc_id"), part.column("held_out"), pa.array(p)], names=["doc_id", "held_out", "score"]
                )

    if model is None:
        scored = rows.select("doc_id", "held_out", F.lit(0.5).alias("score"))
    else:
        scored = rows.mapInArrow(kernels.released(score), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
