"""Toxicity by maximum-scoring segments of token log-odds.

Learning counts words in labelled texts and gives each word a log-odds score with
a Dirichlet prior: the prior mean of a word is the class rate of its leading
letters, whose own prior is the class rate of all words.  Words that were never
seen fall back to their leading letters, then to a fixed negative score.

Scoring cuts each text into all maximal scoring segments in one linear scan (the
disjoint passages none of which can be extended or shortened to score more).
Extreme-value calibration turns a segment score into an expected number of such
segments in clean text of that length, E = K n exp(-lambda S): lambda solves the
unit equation under clean word frequencies and K is fitted to the best segments
of clean sample texts.  Segments with a small E are the significant passages; a
logistic fit over their evidence gives the document's score.

Defined results: a null or wordless text has no passage and takes the lowest
score; a null ``doc_id`` is not held out and is not learned from; of several
labels for one id the highest counts; without labels of both kinds every score is
0; repeated rows keep one row each; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import embedding, kernels
from tessera.llm.common import fit_on_worker, small_batches

#: Labelled texts of each class that a fit may read, about.
SAMPLE_TOXIC, SAMPLE_CLEAN = 3000, 3000
THRESHOLD = 0.5
#: Bytes of a word that its prior looks at.
LEAD_BYTES = 5
#: Pseudo-counts behind a word's lead and behind all words.
PRIOR_WORD, PRIOR_LEAD = 2.0, 4.0
#: Scores are clipped to this range, and words score this much less than their log-odds.
CLIP, DRIFT = 9.0, 0.6
#: A passage counts when fewer than this many as good are expected in clean text.
SIGNIFICANT = 0.01


@dataclass
class Lexicon:
    """Sorted word and lead hashes with their scores, and the calibration."""

    words: np.ndarray
    word_scores: np.ndarray
    leads: np.ndarray
    lead_scores: np.ndarray
    unseen: float
    decay: float = 1.0
    log_k: float = 0.0
    weights: tuple[float, ...] = (-6.0, 1.0, 0.0, 0.0)

    def scores(self, tokens: kernels.Tokens) -> np.ndarray:
        """The score of each word of a chunk."""
        names = tokens.hashes()
        out = _lookup(self.leads, self.lead_scores, tokens.hashes(LEAD_BYTES), self.unseen)
        known = _lookup(self.words, self.word_scores, names, np.nan)
        out = np.where(np.isnan(known), out, known)
        # A word said over and over is evidence once.
        again = np.zeros(len(out), dtype=bool)
        again[1:] = (names[1:] == names[:-1]) & (tokens.doc[1:] == tokens.doc[:-1])
        return np.where(again, np.minimum(out, 0.0), out)


def _lookup(keys: np.ndarray, values: np.ndarray, sought: np.ndarray, default: float) -> np.ndarray:
    if not len(keys):
        return np.full(len(sought), default)
    at = np.minimum(np.searchsorted(keys, sought), len(keys) - 1)
    return np.where(keys[at] == sought, values[at], default)


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of one document, in order.

    Only positive positions open candidates; the runs between them enter through
    prefix sums, so the scan is linear in the positives after one vector pass.
    """
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    open_: list[list] = []  # [start, end, sum before, sum after]
    for i in np.flatnonzero(scores > 0):
        new = [int(i), int(i) + 1, sums[i], sums[i + 1]]
        while True:
            # The nearest candidate that begins lower; what lies between never reaches over it.
            j = len(open_) - 1
            while j >= 0 and open_[j][2] >= new[2]:
                j = open_[j][4]
            if j < 0 or open_[j][3] >= new[3]:
                open_.append([*new, j])
                break
            new = [open_[j][0], new[1], open_[j][2], new[3]]
            del open_[j:]
    return [(s, e, float(after - before)) for s, e, before, after, _ in open_]


#: Range of -ln E that the document score looks at.
LEAST_EVIDENCE, MOST_EVIDENCE = -15.0, 40.0


def _evidence(scores: np.ndarray, first: np.ndarray, lexicon: Lexicon) -> tuple[np.ndarray, list]:
    """Per document (-ln E of the best segment, sum over significant ones, ln words); the passages."""
    length = np.log(np.maximum(1, np.diff(first)))
    out = np.column_stack([np.full(len(length), LEAST_EVIDENCE), np.zeros(len(length)), length])
    found: list[list] = [[] for _ in length]
    hot = np.flatnonzero(scores > 0)
    for d in np.unique(np.searchsorted(first, hot, side="right") - 1):
        limit = lexicon.log_k + length[d]
        told = [(a, b, lexicon.decay * s - limit) for a, b, s in maximal_segments(scores[first[d] : first[d + 1]])]
        found[d] = [x for x in told if x[2] >= -np.log(SIGNIFICANT)]
        out[d, 0] = np.clip(max(x[2] for x in told), LEAST_EVIDENCE, MOST_EVIDENCE)
        out[d, 1] = sum(x[2] for x in found[d])
    return out, found


def _design(evidence: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(evidence)), evidence[:, 0], np.log1p(evidence[:, 1]), evidence[:, 2]])


def _probability(evidence: np.ndarray, lexicon: Lexicon) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(_design(evidence) @ np.array(lexicon.weights), -40, 40)))


@dataclass
class DocWords:
    """One entry for each distinct word of each labelled text."""

    toxic: np.ndarray
    word: np.ndarray
    lead: np.ndarray

    def of(self, keep: np.ndarray) -> DocWords:
        return DocWords(self.toxic[keep], self.word[keep], self.lead[keep])


def _doc_words(texts: pa.Array, toxic: np.ndarray) -> tuple[DocWords, np.ndarray]:
    """The words of the sample, and which text each entry comes from."""
    parts, at = [], 0
    for _, data, offsets in kernels.chunks(pa.record_batch([texts], names=["text"])):
        tokens = kernels.Tokens(data, offsets)
        word, lead = tokens.hashes(), tokens.hashes(LEAD_BYTES)
        order = np.lexsort((word, tokens.doc))
        doc, word, lead = tokens.doc[order], word[order], lead[order]
        new = np.ones(len(order), dtype=bool)
        new[1:] = (doc[1:] != doc[:-1]) | (word[1:] != word[:-1])
        parts.append((at + doc[new], word[new], lead[new]))
        at += len(offsets) - 1
    doc, word, lead = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in range(3))
    return DocWords(toxic[doc] if len(doc) else np.zeros(0, np.int64), word, lead), doc


def _class_counts(keys: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys, first entry of each, counts by class)."""
    names, first, where = np.unique(keys, return_index=True, return_inverse=True)
    counts = np.stack([np.bincount(where, weights=toxic == c, minlength=len(names)) for c in (0, 1)], axis=1)
    return names, first, counts


def _lexicon(entries: DocWords) -> Lexicon:
    """Log-odds of every word and lead under the nested Dirichlet priors."""
    words, first, by_word = _class_counts(entries.word, entries.toxic)
    leads, _, by_lead = _class_counts(entries.lead, entries.toxic)
    base = by_lead.sum(axis=0) + 1.0
    base /= base.sum()
    lead_rate = (by_lead + PRIOR_LEAD * base) / (by_lead.sum(axis=1, keepdims=True) + PRIOR_LEAD)
    own = lead_rate[np.searchsorted(leads, entries.lead[first])] if len(words) else lead_rate[:0]
    word_rate = (by_word + PRIOR_WORD * own) / (by_word.sum(axis=1, keepdims=True) + PRIOR_WORD)

    def scores(rate: np.ndarray) -> np.ndarray:
        odds = np.log(np.maximum(rate, 1e-9) / base)
        return np.clip(odds[:, 1] - odds[:, 0] - DRIFT, -CLIP, CLIP)

    return Lexicon(words, scores(word_rate), leads, scores(lead_rate), -DRIFT)


def _decay(lexicon: Lexicon, entries: DocWords) -> float:
    """The lambda with E[exp(lambda s)] = 1 over the words of clean texts."""
    clean = entries.word[entries.toxic == 0]
    s = _lookup(lexicon.words, lexicon.word_scores, clean, lexicon.unseen)
    if not len(s) or s.max() <= 0 or s.mean() >= 0:
        return 1.0
    low, high = 1e-3, 20.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if np.mean(np.exp(np.minimum(mid * s, 700))) < 1 else (low, mid)
    return low


def _scored_chunks(texts: pa.Array, lexicon: Lexicon):
    for _, data, offsets in kernels.chunks(pa.record_batch([texts], names=["text"])):
        tokens = kernels.Tokens(data, offsets)
        yield lexicon.scores(tokens), tokens.first


def _fit_k(texts: pa.Array, toxic: np.ndarray, lexicon: Lexicon) -> float:
    """ln K of the Gumbel law, from the best segments of clean texts."""
    seen = []
    for scores, first in _scored_chunks(texts.filter(pa.array(toxic == 0)), lexicon):
        for a, b in zip(first[:-1], first[1:], strict=True):
            best = max((s for _, _, s in maximal_segments(scores[a:b])), default=0.0)
            seen.append(-lexicon.decay * best + np.log(max(1, b - a)))
    return float(-np.log(np.mean(np.exp(seen)))) if seen else 0.0


def _logistic(evidence: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Ridge logistic regression by Newton steps."""
    design = _design(evidence)
    w = np.zeros(design.shape[1])
    ridge = np.diag([1e-3, 0.01, 0.01, 0.1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + ridge, design.T @ (y - p) - ridge @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(x) for x in w)


def learn_lexicon(texts: pa.Array, toxic: np.ndarray) -> Lexicon:
    """Word scores from labelled texts, calibrated on the same sample by halves.

    Each half is scored with the lexicon of the other, so that rare words do not
    vouch for the text they were counted in.
    """
    entries, doc = _doc_words(texts, toxic)
    half = np.arange(len(toxic)) % 2
    whole = _lexicon(entries)
    evidence, decays, ks = np.zeros((len(toxic), 3)), [], []
    for h in (0, 1):
        other = _lexicon(entries.of(half[doc] != h))
        other.decay = _decay(other, entries.of(half[doc] == h))
        own = texts.filter(pa.array(half == h))
        other.log_k = _fit_k(own, toxic[half == h], other)
        rows = [_evidence(scores, first, other)[0] for scores, first in _scored_chunks(own, other)]
        evidence[half == h] = np.concatenate(rows) if rows else np.zeros((0, 3))
        decays.append(other.decay)
        ks.append(other.log_k)
    whole.decay, whole.log_k = float(np.mean(decays)), float(np.mean(ks))
    whole.weights = _logistic(evidence, toxic)
    return whole


def learn(docs: DataFrame, labels: DataFrame) -> Lexicon | None:
    """Fit on a bounded sample of each class outside the held-out fold."""
    marks = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
        .where(~embedding.held_out(F.col("doc_id"), 5, 0))
        .groupBy(F.col("doc_id").alias("_id"))
        .agg(F.max("toxic").cast("int").alias("label"))
    )
    chosen = [
        embedding.training_sample(marks.where(F.col("label") == mark), F.col("_id"), most)
        for mark, most in ((1, SAMPLE_TOXIC), (0, SAMPLE_CLEAN))
    ]
    sample = F.broadcast(chosen[0].unionByName(chosen[1]))  # bounded by the two parameters
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(sample, F.col("doc_id") == F.col("_id"))

    def fit(table: pa.Table) -> dict | None:
        found = np.array(table.column("label").to_pylist())
        if len(set(found.tolist())) < 2:
            return None
        texts = table.column("text")
        return vars(learn_lexicon(texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts, found))

    values = fit_on_worker(rows.select("doc_id", "text", "label"), fit)
    return None if values is None else Lexicon(**values)


def score_documents(docs: DataFrame, lexicon: Lexicon | None, schema: str = "doc_id long, held_out boolean") -> DataFrame:
    """Add ``score`` to the columns that ``schema`` names; ``docs`` also has ``text``."""
    names = [part.split()[0] for part in schema.split(", ")]

    def score(batches):
        for batch in batches:
            for rows, data, offsets in kernels.chunks(batch):
                tokens = kernels.Tokens(data, offsets)
                evidence, _ = _evidence(lexicon.scores(tokens), tokens.first, lexicon)
                p = pa.array(_probability(evidence, lexicon))
                yield pa.record_batch([*(rows.column(n) for n in names), p], names=[*names, "score"])

    if lexicon is None:
        return docs.select(*names, F.lit(0.0).alias("score"))
    return docs.select(*names, "text").mapInArrow(kernels.released(score), f"{schema}, score double")


def toxic_passages(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(doc_id, start, end, evidence): byte ranges of every significant passage."""

    def find(batches):
        for batch in batches:
            for rows, data, offsets in kernels.chunks(batch):
                tokens = kernels.Tokens(data, offsets)
                _, found = _evidence(lexicon.scores(tokens), tokens.first, lexicon)
                ids, starts, ends, bits = [], [], [], []
                for d, (name, spans) in enumerate(zip(rows.column("doc_id").to_pylist(), found, strict=True)):
                    for a, b, evidence in spans:
                        ids.append(name)
                        starts.append(int(tokens.starts[tokens.first[d] + a] - offsets[d]))
                        ends.append(int(tokens.ends[tokens.first[d] + b - 1] - offsets[d]))
                        bits.append(float(evidence))
                yield pa.record_batch(
                    [pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), pa.array(bits, pa.float64())],
                    names=["doc_id", "start", "end", "evidence"],
                )

    return docs.select("doc_id", "text").mapInArrow(kernels.released(find), "doc_id long, start long, end long, evidence double")


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The digest report: toxicity score of every whole text."""
    small_batches(docs.sparkSession)
    lexicon = learn(docs, labels)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), embedding.held_out(F.col("doc_id"), 5, 0).alias("held_out"), "text"
    )
    return score_documents(rows, lexicon).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_clean(docs: DataFrame, lexicon: Lexicon | None) -> DataFrame:
    """The rows of ``docs`` whose score is under the threshold, with all their columns."""

    def keep(batches):
        for batch in batches:
            for rows, data, offsets in kernels.chunks(batch):
                tokens = kernels.Tokens(data, offsets)
                evidence, _ = _evidence(lexicon.scores(tokens), tokens.first, lexicon)
                yield rows.filter(pa.array(_probability(evidence, lexicon) < THRESHOLD))

    return docs if lexicon is None else docs.mapInArrow(kernels.released(keep), docs.schema)
