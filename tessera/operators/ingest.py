"""Ingest operators: dedup, quotas, feed scheduling, histories, backfill."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import html, urls

#: Seconds: default interval, longest backoff; default entries of a feed.
DEFAULT_INTERVAL_S, MOST_BACKOFF_S, DEFAULT_LIMIT = 180, 3600, 10
HISTORY_DAYS = 14
#: Seconds: first penalty of a host and the longest.
FIRST_PENALTY_S, MOST_PENALTY_S = 10, 1800
# Statuses of a page fetch that reject it, and the bytes that are kept.
REJECTED_STATUS = (401, 403, 406, 429, 451)
MOST_PAGE_BYTES = 2_000_000
# Fixed values: (least delay, jitter) in seconds of the slow, middle and fast hosts.
HOST_DELAYS = {"slow": (2.8, 1.6), "middle": (2.0, 1.2), "fast": (1.5, 1.0)}


def store_dedup(batch: DataFrame, known: DataFrame, seq: str) -> DataFrame:
    """What a batch adds to a store: the first row of each doc_id that the store lacks.

    The anti-join comes first, so known documents do not reach the window.
    """
    fresh = batch.join(known.select("doc_id").distinct(), "doc_id", "left_anti")
    turn = Window.partitionBy("doc_id").orderBy(seq)
    return fresh.withColumn("_turn", F.row_number().over(turn)).where("_turn = 1").drop("_turn")


def unseen(batch: DataFrame, seen: DataFrame) -> DataFrame:
    """Documents of a batch whose id is not in ``seen``."""
    return batch.join(seen.select("doc_id"), "doc_id", "left_anti")


def due(feeds: DataFrame, now: Column) -> DataFrame:
    """Enabled feeds whose next run has come, or that never ran."""
    return feeds.where(F.col("enabled") & (F.col("next_run").isNull() | (F.col("next_run") <= now)))


def resolved_interval(own: Column, default: Column) -> Column:
    return F.coalesce(own, default, F.lit(DEFAULT_INTERVAL_S))


def resolved_limit(own: Column, default: Column) -> Column:
    return F.coalesce(own, default, F.lit(DEFAULT_LIMIT))


def backoff_seconds(interval: Column, failures: Column) -> Column:
    """Seconds to the next try after ``failures`` in a row; the plain interval after none."""
    return F.least(interval * F.pow(F.lit(2.0), failures), F.lit(float(MOST_BACKOFF_S))).cast("long")


def penalty_seconds(failures: Column) -> Column:
    """Seconds that a host is left alone after its ``failures``-th failure in a row."""
    return F.when(failures < 1, 0).otherwise(
        F.least(FIRST_PENALTY_S * F.pow(F.lit(2.0), failures - 1), F.lit(float(MOST_PENALTY_S)))
    ).cast("long")


def failure_runs(runs: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``runs`` (key, order, ok) with fail_count: failures in a row up to and with each run."""
    turn = Window.partitionBy(key).orderBy(*order)
    marked = runs.withColumn("_wins", F.sum(F.col("ok").cast("int")).over(turn))
    inside = Window.partitionBy(key, "_wins").orderBy(*order)
    return marked.withColumn("fail_count", F.sum((~F.col("ok")).cast("int")).over(inside)).drop("_wins")


def latest_state(states: DataFrame, key: str, order: str) -> DataFrame:
    """The newest row of each key: how feed states of two writers merge."""
    rest = [c for c in states.columns if c != key]
    newest = states.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_row"))
    return newest.select(key, "_row.*")


def merged_seen(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.select("doc_id").union(new.select("doc_id")).distinct()


def history_by_day(runs: DataFrame) -> DataFrame:
    """Runs of each source and UTC day: how many, how many failed, documents, time."""
    return runs.groupBy(F.to_date("ts").alias("day"), "src_id").agg(
        F.count("*").alias("runs"),
        F.sum((~F.col("ok")).cast("long")).alias("failed"),
        F.sum("new").alias("new_docs"),
        F.round(F.avg("duration_ms"), 6).alias("avg_ms"),
    )


def retained(history: DataFrame, today: Column, days: int = HISTORY_DAYS) -> DataFrame:
    """History that is not older than ``days``; a partition filter where day is the partition."""
    return history.where(F.col("day") >= F.date_sub(today, days))


def with_quota(rows: DataFrame, site: str, quota: Column, seq: list[Column], most: int | None = None) -> DataFrame:
    """The first ``quota`` rows of each site, and no more than ``most`` in all, sites taking turns."""
    turn = Window.partitionBy(site).orderBy(*seq)
    kept = rows.withColumn("turn", F.row_number().over(turn)).where(F.col("turn") <= quota)
    return kept if most is None else kept.orderBy("turn", site).limit(most)


def round_robin(rows: DataFrame, site: str, seq: list[Column]) -> DataFrame:
    """Rows with ``turn``: sites take turns, one row each; order by (turn, site)."""
    return rows.withColumn("turn", F.row_number().over(Window.partitionBy(site).orderBy(*seq)))


def host_schedule(rows: DataFrame, host: str, seq: list[Column], delay: Column) -> DataFrame:
    """``rows`` with start_s: when each fetch of a host may begin, in seconds after the first."""
    turn = Window.partitionBy(host).orderBy(*seq).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("start_s", F.coalesce(F.sum(delay).over(turn), F.lit(0.0)))


def drop_reasons(rows: DataFrame, site: str, reason: str, most: int = 8) -> DataFrame:
    """The ``most`` frequent reasons of each site."""
    counted = rows.groupBy(site, reason).agg(F.count("*").alias("n"))
    turn = Window.partitionBy(site).orderBy(F.col("n").desc(), F.col(reason).asc())
    return counted.withColumn("place", F.row_number().over(turn)).where(F.col("place") <= most)


def fetched_ok(status: Column, mime: Column) -> Column:
    """Whether a landed page counts as fetched."""
    return ~status.isin(*REJECTED_STATUS) & (status < 400) & F.lower(F.coalesce(mime, F.lit(""))).contains("html")


def page_text(content: Column) -> Column:
    """Text of page bytes: cut to the size limit, bytes that are no UTF-8 dropped."""
    cut = F.substring(content, 1, MOST_PAGE_BYTES).cast("string")
    return F.replace(F.make_valid_utf8(cut), F.lit("\ufffd"), F.lit(""))


def append_audit(docs: DataFrame, path: str) -> None:
    """Add the ids of prepared documents to an audit log of JSON lines."""
    docs.select("doc_id").write.mode("append").json(path)


def backfilled(pages: DataFrame, seen: DataFrame, quota: int | None = None, most: int | None = None) -> DataFrame:
    """Documents from landed pages (site, url, html, seq): the whole backfill as one plan.

    URL filter, id of the canonical URL, one row an id, anti-join with what was
    seen, text and title, length filter, quota of each site.
    """
    wanted = pages.where(urls.is_article_url(F.col("url"), F.col("site")))
    named = wanted.withColumn("url", urls.canonical_url(urls.strip_tracking(F.trim("url")))).withColumn("doc_id", urls.url_doc_id(F.col("url")))
    fresh = store_dedup(named, seen, "seq")
    docs = fresh.select(
        "doc_id",
        html.html_title(F.col("html"), F.col("site"), F.col("url")).alias("title"),
        html.html_text(F.col("html")).alias("body"),
        "url",
        F.lit(None).cast("string").alias("timestamp"),
        F.lit("en").alias("lang"),
        "site",
        "seq",
    ).where(html.long_enough(F.col("body")))
    if quota is None:
        return docs
    return with_quota(docs, "site", F.lit(quota), [F.col("seq")], most).drop("turn")
