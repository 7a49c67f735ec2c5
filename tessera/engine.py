"""The search engine: a corpus and its index as tables in one folder.

Each ingest appends one batch folder to every table and then publishes it by one
row in ``manifest``; readers take the batches that the manifest names, so they see
whole batches only.  Nothing is rewritten when documents arrive.  A writer claims the
version after the one it has read by creating a file that must not exist yet; if
another writer was first, it deduplicates against the new state and tries again.
Compaction publishes one batch for all before it (``floor``).
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.analyze import analyze_query_text, tokens
from tessera.operators import index as ix
from tessera.operators import present, rank
from tessera.operators.ingest import store_dedup
from tessera.plans import lang
from tessera.plans.compile import match

DOCS = "doc_id string, title string, body string, url string, timestamp string, lang string, ingest_seq long"
RESULT = "doc_id string, title string, snippet string, score double, url string, timestamp string, lang string"
MANIFEST = "batch string, version int, docs long, tokens long, floor int"
#: Seconds that a writer waits for the batch of another that was first.
CLAIM_WAIT_S = 60
#: Words of a query log, query by query, up to which words and queries are broadcast.
MOST_BROADCAST_WORDS = 200_000
POSTINGS = "term string, doc_id string, tf int, positions array<int>, dl int"
STATS = "doc_id string, doc_len int"

Feedback = Callable[[DataFrame, DataFrame, list[str]], list[str]]


@dataclass(frozen=True)
class Request:
    """One search.  ``sort`` "freshness" boosts recent documents; ``now`` fixes the time that they are measured from."""

    query: str
    top_k: int = 10
    use_prf: bool = False
    lang: str | None = None
    time_from: str | None = None
    time_to: str | None = None
    field: str | None = None
    sort: str = "relevance"
    last_score: float | None = None
    last_id: str | None = None
    now: str | None = None

    def __post_init__(self):
        if not self.query:
            raise ValueError("the query is empty")
        if self.top_k < 1:
            raise ValueError("top_k must be at least 1")


@dataclass
class Response:
    query: str
    took_ms: int
    total_hits: int
    results: list = field(default_factory=list)


@dataclass(frozen=True)
class Ingested:
    ingested: int
    updated_index: bool
    index_version: str


class SearchEngine:
    """Ingest, rebuild, search, match, analyze and health over the tables below ``path``."""

    def __init__(self, spark: SparkSession, path: str, analyzer: str = "english", feedback: Feedback | None = None):
        self.spark, self.path, self.analyzer, self.feedback = spark, path.rstrip("/"), analyzer, feedback

    # Tables.

    def _manifest(self) -> DataFrame:
        """Rows of the visible batches: those that no compaction has replaced."""
        try:
            rows = self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest")
        except AnalysisException:
            return self.spark.createDataFrame([], MANIFEST)
        floor = rows.agg(F.coalesce(F.max("floor"), F.lit(0))).first()[0]  # one row a batch
        return rows.where(F.col("version") > floor)

    def _table(self, name: str, schema: str) -> DataFrame:
        batches = [r["batch"] for r in self._manifest().select("batch").collect()]
        if not batches:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{name}/{b}" for b in batches])

    @property
    def docs(self) -> DataFrame:
        return self._table("docs", DOCS)

    @property
    def index(self) -> ix.Index:
        totals = self._manifest().select("docs", "tokens")
        return ix.Index(self._table("postings", POSTINGS), self._table("doc_stats", STATS), self.analyzer, totals)

    def _version(self) -> int:
        return self._manifest().agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]

    def _claim(self, version: int) -> bool:
        """Whether this writer is the first to want ``version``; the file system decides."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/claims/v{version:08d}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).createNewFile(path)

    def _publish(self, docs: DataFrame, version: int, floor: int = 0) -> int | None:
        """Write one batch of new documents and make it visible; returns how many there were.

        None when another writer has published ``version`` meanwhile.
        """
        batch = f"v{version:08d}-{time.time_ns()}"
        docs.select(*[c.split()[0] for c in DOCS.split(", ")]).write.parquet(f"{self.path}/docs/{batch}")
        stored = self.spark.read.schema(DOCS).parquet(f"{self.path}/docs/{batch}")
        built = ix.build_index(stored, self.analyzer)
        built.doc_stats.write.parquet(f"{self.path}/doc_stats/{batch}")
        sums = self.spark.read.schema(STATS).parquet(f"{self.path}/doc_stats/{batch}").agg(
            F.count("*").alias("n"), F.coalesce(F.sum("doc_len"), F.lit(0)).alias("t")
        ).first()
        ix.clustered(built.postings, sums["t"]).write.parquet(f"{self.path}/postings/{batch}")
        if not self._claim(version):
            return None
        row = self.spark.createDataFrame([(batch, version, sums["n"], sums["t"], floor)], MANIFEST)
        row.coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")
        return sums["n"]

    # Writes.

    def ingest(self, batch: DataFrame) -> Ingested:
        """Add documents whose id is new; the first of a batch wins."""
        rows = batch if "ingest_seq" in batch.columns else batch.withColumn("ingest_seq", F.monotonically_increasing_id())
        while True:
            version = self._version()
            fresh = store_dedup(rows, self.docs, "ingest_seq")
            if fresh.isEmpty():
                return Ingested(0, False, str(version or 1))
            n = self._publish(fresh, version + 1)
            if n is not None:
                return Ingested(n, True, str(version + 1))
            self._await(version + 1)

    def _await(self, version: int) -> None:
        """Wait until another writer's ``version`` can be read."""
        for _ in range(CLAIM_WAIT_S):
            if self._version() >= version:
                return
            time.sleep(1)
        raise RuntimeError(f"version {version} is claimed but was never published")

    def compact(self) -> int:
        """One batch for all; readers see the same documents.  Returns how many there are.

        Folders of replaced batches stay for readers that began before; :meth:`vacuum` drops them.
        """
        while True:
            version = self._version()
            if self._manifest().count() < 2:
                return self._manifest().agg(F.coalesce(F.sum("docs"), F.lit(0))).first()[0]
            n = self._publish(self.docs, version + 1, floor=version)
            if n is not None:
                return n
            self._await(version + 1)

    def vacuum(self) -> int:
        """Remove the folders of batches that no reader of the present state needs; returns how many."""
        paths, kept, gone = self.spark._jvm.org.apache.hadoop.fs.Path, {r["batch"] for r in self._manifest().select("batch").collect()}, 0
        for name in ("docs", "postings", "doc_stats"):
            folder = paths(f"{self.path}/{name}")
            files = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
            for status in files.listStatus(folder) if files.exists(folder) else []:
                if status.getPath().getName() not in kept:
                    gone += files.delete(status.getPath(), True)
        return gone

    def rebuild(self, path: str) -> SearchEngine:
        """A fresh engine over all documents at ``path``; versions begin at 1 again."""
        other = SearchEngine(self.spark, path, self.analyzer, self.feedback)
        other._publish(self.docs, 1)
        return other

    # Reads.

    def _analyze(self, text: str) -> list[str]:
        return analyze_query_text(text, self.analyzer)

    def match(self, query: str) -> DataFrame:
        """(doc_id) of matching documents; a query without a tree matches none."""
        try:
            node = lang.simplify(lang.parse(query, self._analyze))
        except lang.QueryError:
            node = lang.Nothing()
        return match(self.index, node)

    def analyze_query(self, query: str) -> dict:
        return lang.analyze_query(query, self._analyze)

    def health(self) -> DataFrame:
        """One row: status, index_version, docs_count."""
        sums = self._manifest().agg(
            F.lit("ok").alias("status"),
            F.greatest(F.coalesce(F.max("version"), F.lit(0)), F.lit(1)).cast("string").alias("index_version"),
            F.coalesce(F.sum("docs"), F.lit(0)).cast("long").alias("docs_count"),
        )
        return sums

    def scored(self, request: Request) -> DataFrame:
        """(doc_id, score) of all hits, before filters; one row of feedback words is all the driver sees."""
        return scored_hits(self.index, self.docs, request, self.feedback)

    def search(self, request: Request) -> Response:
        began = time.monotonic()
        scored = self.scored(request).cache()
        try:
            total = scored.count()
            rows = result_page(scored, self.docs, request, self.analyzer).collect() if total else []
        finally:
            scored.unpersist()
        return Response(request.query, int((time.monotonic() - began) * 1000), total, rows)

    def register(self) -> None:
        """Offer the standard analyzer to SQL as a function."""
        register_functions(self.spark)


def register_functions(spark: SparkSession) -> None:
    """SQL function ``analyze_text(text)``; a SQL UDF, so it stays in the JVM."""
    from tessera.functions.analyze import STOP_WORDS

    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION analyze_text(s STRING) RETURNS ARRAY<STRING> RETURN "
        f"filter(split(lower(coalesce(s, '')), '[^a-z0-9]+'), t -> length(t) > 1 AND t NOT IN ({stop}))"
    )


def scored_hits(index: ix.Index, docs: DataFrame, request: Request, feedback: Feedback | None = None) -> DataFrame:
    """(doc_id, score) of the documents that match and hold a scoring term."""
    analyze = lambda text: analyze_query_text(text, index.analyzer)
    try:
        node = lang.simplify(lang.parse(request.query, analyze))
    except lang.QueryError:
        return index.doc_stats.select("doc_id", F.lit(0.0).alias("score")).where(F.lit(False))
    terms = lang.scoring_terms(request.query, analyze)
    hits = rank.ranked_matches(index, node, terms)
    if not (request.use_prf and lang.is_simple(request.query)):
        return hits
    best = rank.top(hits, rank.FEEDBACK_DOCS).collect()
    ranks = docs.sparkSession.createDataFrame(
        [(r["doc_id"], i) for i, r in enumerate(best)],
        docs.select("doc_id", F.lit(0).alias("rank")).schema,
    )
    expand = feedback or (lambda d, b, t: [r["term"] for r in rank.feedback_terms(d, b, t, index.analyzer).collect()])
    extra = [t for t in expand(docs, ranks, terms) if t not in terms] if best else []
    return rank.ranked_matches(index, node, terms + extra)


def result_page(scored: DataFrame, docs: DataFrame, request: Request, analyzer: str = "standard") -> DataFrame:
    """The k results of a request.  Texts are joined to the k best rows only."""
    fresh = request.sort == "freshness"
    filtered = request.lang or request.time_from or request.time_to or fresh
    rows = scored
    if filtered:
        meta = docs.select("doc_id", "lang", "timestamp")
        rows = rows.join(meta, "doc_id").where(
            rank.language_filter(request.lang) & rank.time_filter(F.col("timestamp"), request.time_from, request.time_to)
        )
        if fresh:
            now = request.now or time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())
            rows = rows.withColumn("score", rank.fresh_score(F.col("score"), F.col("timestamp"), now))
        rows = rows.select("doc_id", "score")
    best = rank.top(rows.where(rank.after_cursor(request.last_score, request.last_id)), request.top_k)
    terms = lang.scoring_terms(request.query, lambda text: analyze_query_text(text, analyzer))
    joined = docs.join(F.broadcast(best), "doc_id")  # top_k rows
    shown = joined.select(
        "doc_id", "title", present.snippet(F.col("body"), terms).alias("snippet"), "score", "url", "timestamp", "lang"
    )
    return shown.orderBy(F.col("score").desc(), F.col("doc_id").asc())


def search_many(index: ix.Index, queries: DataFrame, k: int) -> DataFrame:
    """Top k of many plain queries at once: (query_id, doc_id, score, rank).

    ``queries`` has (query_id, text); documents that hold all words of a query
    match.  Only documents on the list of a query's rarest word are looked at, so a frequent
    word costs its list once and not once a query; queries with a word that no document holds are out.
    """
    from pyspark.sql import Window

    words = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("text"), "standard"))).alias("term"))
    distinct = words.select("term").distinct()
    sized = lambda df: F.broadcast(df) if few else df
    few = words.limit(MOST_BROADCAST_WORDS + 1).count() <= MOST_BROADCAST_WORDS  # no fewer than queries
    lists = index.postings.select("term", "doc_id", "tf", "dl").join(sized(distinct), "term", "left_semi")
    freq = lists.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(index.stats))
    weight = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    told = words.join(freq.select("term", "df", weight.alias("idf"), "avgdl"), "term", "left")
    wanted = told.groupBy("query_id").agg(F.count("*").alias("need"), F.count("df").alias("known"), F.min(F.struct("df", "term"))["term"].alias("term"))
    rarest = wanted.where("need = known").select("query_id", "need", "term")
    near = lists.select("term", "doc_id").join(sized(rarest), "term").select("query_id", "need", "doc_id")
    # What is asked of each candidate: all words of its query.  Few, so they are hashed and the lists are not sorted.
    asked = near.join(told.select("query_id", "term", "idf", "avgdl"), "query_id").hint("shuffle_hash")
    hits = lists.join(asked, ["term", "doc_id"]).groupBy("query_id", "doc_id", "need").agg(F.count("*").alias("have"), F.sum(rank._weight()).alias("score"))
    turn = Window.partitionBy("query_id").orderBy(F.round("score", 6).desc(), F.col("doc_id").asc())
    return hits.where("have = need").withColumn("rank", F.row_number().over(turn)).where(F.col("rank") <= k).select("query_id", "doc_id", "score", "rank")


def next_page(request: Request, response: Response) -> Request | None:
    """The request for the rows behind ``response``; none when it was empty."""
    if not response.results:
        return None
    last = response.results[-1]
    return replace(request, last_score=last["score"], last_id=last["doc_id"])
