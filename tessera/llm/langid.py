"""Language identification: averaged hashed subword embeddings, linear softmax.

Subwords are byte n-grams of the lower-cased text in which everything but letters
is a word border.  Probabilities are temperature-calibrated on held-back rows of
the sample, which also set the score under which an answer counts as rejected.

Defined results: a null text or one without a letter is ``und`` with score 0; a
null ``doc_id`` is not held out and is not learned from; repeated rows keep one
row each; without labelled rows every answer is ``und``; other columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import embedding, kernels
from tessera.llm.common import small_batches

UND = "und"
SETTINGS = embedding.Settings(sample_rows=3000, epochs=4)
GRAMS = (2, 3, 4)
_LETTER = kernels.LOWER.copy()
_LETTER[:65] = 32
_LETTER[91:97] = 32
_LETTER[123:128] = 32


def extract(data: np.ndarray, offsets: np.ndarray):
    """Byte n-grams that lie within one document."""
    plain = _LETTER[data]
    return [
        (kernels.grams(plain, n, SETTINGS.bits), offsets[:-1], np.maximum(offsets[1:] - n + 1, offsets[:-1]))
        for n in GRAMS
    ]


def learn(docs: DataFrame, settings: embedding.Settings = SETTINGS) -> embedding.Model | None:
    """Fit on a bounded sample of labelled rows outside the held-out fold."""
    rows = docs.where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~embedding.held_out(F.col("doc_id"), 3, 1)
    )
    sample = embedding.training_sample(rows.select("doc_id", "text", "lang"), F.col("doc_id"), settings.sample_rows)
    return embedding.fit_sample(sample.withColumnRenamed("lang", "label"), None, extract, settings)


def identify(docs: DataFrame, model: embedding.Model | None) -> DataFrame:
    """Add lang_pred, score and rejected to (doc_id, held_out, has_letter, text)."""

    def score(batches):
        for batch in batches:
            for rows, data, offsets in kernels.chunks(batch):
                p = model.probabilities(embedding.logits_of(data, offsets, model, extract))
                best, top = p.argmax(axis=1), p.max(axis=1)
                lettered = np.asarray(rows.column("has_letter"), dtype=bool)
                named = [model.classes[b] if ok else UND for b, ok in zip(best, lettered, strict=True)]
                yield pa.record_batch(
                    [
                        rows.column("doc_id"),
                        rows.column("held_out"),
                        pa.array(named, pa.string()),
                        pa.array(np.where(lettered, top, 0.0)),
                        pa.array(~lettered | (top < model.reject_below)),
                    ],
                    names=["doc_id", "held_out", "lang_pred", "score", "rejected"],
                )

    if model is None:
        return docs.select(
            "doc_id", "held_out", F.lit(UND).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected")
        )
    return docs.mapInArrow(kernels.released(score), "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def language_report(docs: DataFrame) -> DataFrame:
    """The digest report: predicted language of every whole text."""
    small_batches(docs.sparkSession)
    model = learn(docs)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        embedding.held_out(F.col("doc_id"), 3, 1).alias("held_out"),
        F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("has_letter"),
        "text",
    )
    return identify(rows, model)
