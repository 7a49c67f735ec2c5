"""Ranking: BM25, feedback terms, filters, freshness, keyset paging, top-k.

Order of results is always score descending, then doc_id ascending.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.porter import stem_vocabulary
from tessera.operators.index import Index, analyzed
from tessera.plans.compile import predicate
from tessera.plans.lang import Node, leaf_terms

# The constants of the ranking formula.
K1, B = 1.2, 0.75
# Words that feedback never adds (18).
FEEDBACK_STOP = (
    "the", "a", "an", "and", "or", "to", "of", "in", "on", "for", "with", "is", "are", "was", "were", "be", "as", "by",
)
FEEDBACK_DOCS, FEEDBACK_TERMS = 5, 5
#: Freshness: up to this share on top, falling by e in this many hours.  E is the constant as the formula has it.
FRESH_SHARE, FRESH_HOURS, E = 0.2, 72.0, 2.718281828


def idf(index: Index, terms: list[str] | None) -> DataFrame:
    """(term, df, idf, avgdl) of the terms that occur, or of all; ``index.stats`` is one row."""
    freq = index.doc_freq(terms).crossJoin(F.broadcast(index.stats))
    return freq.select(
        "term", "df", F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"), "avgdl"
    )


def _weight() -> Column:
    length = F.greatest(F.col("dl"), F.lit(1))
    return F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * length / F.col("avgdl")))


def bm25(index: Index, terms: list[str], targets: DataFrame | None = None) -> DataFrame:
    """(doc_id, score) over ``terms``; restricted to ``targets`` (doc_id) when given; scores above 0 only."""
    rows = index.postings.where(F.col("term").isin(*terms) if terms else F.lit(False))
    if targets is not None:
        rows = rows.join(targets.select("doc_id"), "doc_id", "left_semi")
    scored = rows.join(F.broadcast(idf(index, terms)), "term")  # one row for each query word
    return scored.groupBy("doc_id").agg(F.sum(_weight()).alias("score")).where(F.col("score") > 0)


def ranked_matches(index: Index, node: Node, terms: list[str]) -> DataFrame:
    """(doc_id, score) of matching documents by the fused plan: one aggregation by document.

    Scores count ``terms``; a document with none of them scores 0 and is out.
    """
    words = list(dict.fromkeys(leaf_terms(node) + terms))
    rows = index.postings.where(F.col("term").isin(*words) if words else F.lit(False))
    scored = rows.join(F.broadcast(idf(index, words)), "term")
    positions = F.col("positions") if index.positional else F.lit(None).cast("array<int>")
    gathered = scored.groupBy("doc_id").agg(
        F.map_from_entries(F.collect_list(F.struct("term", positions.alias("positions")))).alias("lists"),
        F.sum(F.when(F.col("term").isin(*terms), _weight()).otherwise(0.0) if terms else F.lit(0.0)).alias("score"),
    )
    return gathered.where(predicate(node, F.col("lists"), index.positional) & (F.col("score") > 0)).select("doc_id", "score")


def top(scored: DataFrame, k: int) -> DataFrame:
    """The best k rows; planned as one bounded top-k, not a sort."""
    if k < 1:
        raise ValueError("top_k must be at least 1")
    return scored.orderBy(F.col("score").desc(), F.col("doc_id").asc()).limit(k)


def feedback_terms(docs: DataFrame, best: DataFrame, query_terms: list[str], analyzer: str = "standard", n: int = FEEDBACK_TERMS) -> DataFrame:
    """(term, n, first): the most frequent new words of the ``best`` documents (doc_id, rank)."""
    ranks = F.broadcast(best.select("doc_id", "rank"))  # a fixed handful
    words = analyzed(docs.join(ranks, "doc_id", "left_semi"), analyzer).join(ranks, "doc_id")
    each = words.select("rank", F.posexplode("tokens").alias("pos", "term"))
    if analyzer == "english":
        stems = stem_vocabulary(each.select(F.col("term").alias("word")).distinct())
        each = each.join(stems, F.col("term") == F.col("word")).select("rank", "pos", F.col("stem").alias("term"))
    barred = list(dict.fromkeys([*FEEDBACK_STOP, *query_terms]))
    kept = each.where(~F.col("term").isin(*barred) & (F.length("term") > 2))
    counted = kept.groupBy("term").agg(F.count("*").alias("n"), F.min(F.struct("rank", "pos")).alias("first"))
    return counted.orderBy(F.col("n").desc(), F.col("first").asc(), F.col("term").asc()).limit(n)


def language_filter(lang: str | None) -> Column:
    return F.col("lang") == lang if lang else F.lit(True)


def has_zone(stamp: Column) -> Column:
    return stamp.rlike(r"(Z|[+-]\d\d:?\d\d(:?\d\d)?)$")


def instant(stamp: Column) -> Column:
    """The time of an ISO text, null where it is none."""
    return F.try_to_timestamp(F.when(stamp.rlike(r"^\d{4}-\d\d-\d\d"), stamp))


def time_filter(stamp: Column, start: str | None, end: str | None) -> Column:
    """Inclusive bounds.  What cannot be compared passes.

    A document without a time, or with one that is no time, passes.  A bad start
    switches both bounds off, a bad end only itself.  Times with and without a
    zone do not compare, so such a bound passes as well.
    """
    if not start and not end:
        return F.lit(True)
    ts = instant(stamp)
    from_, to = (F.lit(x).cast("string") for x in (start, end))
    comparable = lambda bound: instant(bound).isNotNull() & (has_zone(bound) == has_zone(stamp))
    early = comparable(from_) & (ts < instant(from_)) if start else F.lit(False)
    late = comparable(to) & (ts > instant(to)) if end else F.lit(False)
    start_ok = comparable(from_) if start else F.lit(True)
    return ~F.coalesce(ts.isNotNull() & (early | (start_ok & late)), F.lit(False))


def fresh_score(score: Column, stamp: Column, now: str) -> Column:
    """``score`` with the recency boost at the time ``now``; unzoned and bad times change nothing."""
    hours = F.greatest((F.unix_micros(F.to_timestamp(F.lit(now))) - F.unix_micros(instant(stamp))) / 3.6e9, F.lit(0.0))
    boosted = score * (1 + FRESH_SHARE * F.pow(F.lit(E), -hours / FRESH_HOURS))
    return F.coalesce(F.when(has_zone(stamp), boosted), score)


def after_cursor(last_score: float | None, last_id) -> Column:
    """Rows behind the last row of the page before; both parts of the cursor, or none."""
    if last_score is None or last_id is None:
        return F.lit(True)
    return (F.col("score") < last_score) | ((F.col("score") == last_score) & (F.col("doc_id") > F.lit(last_id)))
