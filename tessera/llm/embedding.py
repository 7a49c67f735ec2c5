"""Averaged hashed embeddings with a linear softmax, trained by SGD in numpy.

A document is the weighted mean of the vectors of its hashed features; logits are
linear in that mean.  Training touches embeddings and output weights alike; for
scoring the two linear maps fold into one table (bucket -> logits).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import kernels
from tessera.llm.common import fit_on_worker

#: A document's features: (buckets, counts), both 1-d.
Features = tuple[np.ndarray, np.ndarray]
#: chunk (bytes, offsets) -> [(bucket of each item, first item of each document, end)].
Extractor = Callable[[np.ndarray, np.ndarray], list[tuple[np.ndarray, np.ndarray, np.ndarray]]]


@dataclass(frozen=True)
class Settings:
    """Training parameters.

    ``sample_rows`` bounds the labelled rows that a fit reads; ``rate`` is the step
    of the output weights, ``move`` that of a document's mean vector.
    """

    bits: int = 16
    dim: int = 12
    epochs: int = 6
    rate: float = 0.5
    move: float = 0.2
    seed: int = 11
    sample_rows: int = 4000
    held_for_calibration: float = 0.25


@dataclass
class Model:
    """``table`` has the logits of each bucket, ``bias`` of no feature; ``heat`` calibrates."""

    classes: list
    table: np.ndarray
    bias: np.ndarray
    heat: float = 1.0
    reject_below: float = 0.0

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        z = logits / self.heat
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """The contract's fold: crc32 of the id as text."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "utf-8")) % modulus == remainder, F.lit(False))


def training_sample(rows: DataFrame, key: Column, most: int) -> DataFrame:
    """About ``most`` of ``rows``, picked by a hash of ``key``; all when there are fewer."""
    n = rows.count()
    if n <= most:
        return rows
    share = int(most / n * (1 << 30))
    return rows.where(F.pmod(F.xxhash64(F.lit("sample"), key), F.lit(1 << 30)) < share)


def features(column: pa.Array, extract: Extractor, bits: int) -> list[Features]:
    """Feature counts of each text; every group of features weighs the same."""
    out = []
    batch = pa.record_batch([column], names=["text"])
    for _, data, offsets in kernels.chunks(batch):
        groups = extract(data, offsets)
        for d in range(len(offsets) - 1):
            ids, weights = [], []
            for buckets, first, end in groups:
                got, count = np.unique(buckets[first[d] : end[d]], return_counts=True)
                if len(got):
                    ids.append(got)
                    weights.append(count / count.sum() / len(groups))
            out.append((np.concatenate(ids), np.concatenate(weights)) if ids else (np.zeros(0, np.int64), np.zeros(0)))
    return out


def fit(samples: list[Features], labels: np.ndarray, classes: list, cfg: Settings) -> Model:
    """Plain SGD over shuffled documents with a linearly falling rate."""
    rng = np.random.default_rng(cfg.seed)
    k = len(classes)
    vectors = rng.uniform(-1, 1, (1 << cfg.bits, cfg.dim)) / np.sqrt(cfg.dim)
    out = np.zeros((cfg.dim, k))
    bias = np.log(np.bincount(labels, minlength=k) + 1.0)
    bias -= bias.max()
    order = rng.permutation(len(samples))
    held = order[: int(len(order) * cfg.held_for_calibration)] if len(order) >= 40 else order[:0]
    train = order[len(held) :]
    steps, done = max(1, cfg.epochs * len(train)), 0
    for _ in range(cfg.epochs):
        for i in rng.permutation(train):
            left = 1 - done / steps
            done += 1
            ids, w = samples[i]
            if not len(ids):
                continue
            own = vectors[ids]
            mean = w @ own
            z = mean @ out + bias
            z = np.exp(z - z.max())
            grad = z / z.sum()
            grad[labels[i]] -= 1
            back = out @ grad
            out -= cfg.rate * left * np.outer(mean, grad)
            bias -= 0.05 * cfg.rate * left * grad
            # Scaled by the weights' norm, so the mean moves as far for few features as for many.
            vectors[ids] = own - np.outer(w * (cfg.move * left / (w @ w)), back)
    model = Model(classes, vectors @ out, bias)
    _calibrate(model, [samples[i] for i in (held if len(held) else train)], labels[held if len(held) else train])
    return model


def _calibrate(model: Model, samples: list[Features], labels: np.ndarray) -> None:
    """Temperature by held-out likelihood; rejection where accepted rows would err over 1 in 100."""
    if not len(samples):
        return
    logits = np.array([w @ model.table[ids] + model.bias if len(ids) else model.bias for ids, w in samples])
    best = np.inf
    for heat in np.geomspace(0.2, 5, 41):
        model_at = Model(model.classes, model.table, model.bias, heat)
        p = model_at.probabilities(logits)[np.arange(len(labels)), labels]
        loss = -np.log(np.maximum(p, 1e-12)).mean()
        if loss < best:
            best, model.heat = loss, float(heat)
    p = model.probabilities(logits)
    top, right = p.max(axis=1), p.argmax(axis=1) == labels
    order = np.argsort(-top)
    errors = np.cumsum(~right[order]) / np.arange(1, len(order) + 1)
    good = np.flatnonzero(errors <= 0.01)
    model.reject_below = float(top[order][good[-1]]) if len(good) else 1.0


def logits_of(data: np.ndarray, offsets: np.ndarray, model: Model, extract: Extractor) -> np.ndarray:
    """(documents, classes) logits of a chunk of whole texts."""
    groups = extract(data, offsets)
    total = np.tile(model.bias, (len(offsets) - 1, 1))
    slim = model.table.astype(np.float32)
    for buckets, first, end in groups:
        n = np.maximum(end - first, 0)
        sums = kernels.segment_sums(slim[buckets], first, end)
        total += sums / np.maximum(n, 1)[:, None] / len(groups)
    return total


def fit_sample(sample: DataFrame, classes: list | None, extract: Extractor, cfg: Settings) -> Model | None:
    """Fit on (text, label) rows of a bounded sample; ``classes`` default to the labels found.

    None unless there are two of the given classes, or any class where none are given.
    """

    def run(table: pa.Table) -> dict | None:
        found = table.column("label").to_pylist()
        names = classes or sorted(set(found))
        if classes and len(set(found)) < 2:
            return None
        text = table.column("text")
        text = text.combine_chunks() if isinstance(text, pa.ChunkedArray) else text
        labels = np.array([names.index(x) for x in found])
        return vars(fit(features(text, extract, cfg.bits), labels, names, cfg))

    values = fit_on_worker(sample.select("doc_id", "text", "label"), run)
    return None if values is None else Model(**values)
