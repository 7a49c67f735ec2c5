"""Catalogue of the search-engine queries, each with the DuckDB SQL of the same result.

``documents`` serves as corpus (title empty, body the text, time from the event
with the same id), ``pages`` as landed web pages, ``benchmark`` as query log and
``events`` as run history.  Scores are rounded to six places before they order
anything, so both engines order alike.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.engine import Request, result_page, scored_hits, search_many
from tessera.functions import html, urls
from tessera.functions.analyze import STOP_WORDS, analyze_query_text
from tessera.functions.porter import stem_layers, stem_vocabulary
from tessera.operators import index as ix
from tessera.operators import ingest, present, rank
from tessera.plans import lang
from tessera.plans.compile import match
from tessera.sources.landed import file_entries, sitemap_urls

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
NOW = "2024-02-01T00:00:00Z"
#: URLs of one sitemap; the protocol allows 50,000.
SITEMAP_URLS = 10_000


def _entry(sql: str | None = None):
    """Register a query under its function name, with its oracle."""

    def add(make):
        _QUERIES[make.__name__] = make
        if sql is not None:
            _SQL[make.__name__] = sql
        return make

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# Inputs.


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str, timed: bool = False) -> DataFrame:
    """The documents of the engine; times are joined only where they are wanted."""
    docs = _table(spark, sf_dir, "documents").select(
        "doc_id", F.lit("").alias("title"), F.col("text").alias("body"), F.lit(None).cast("string").alias("url"), "lang"
    )
    if not timed:
        return docs.withColumn("timestamp", F.lit(None).cast("string"))
    times = _table(spark, sf_dir, "events").select(
        F.col("event_id").alias("doc_id"), F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp")
    )
    return docs.join(times, "doc_id", "left")


#: Stored indexes of this process, by application, corpus and analyzer.
_STORED: dict[tuple, str] = {}


def _shared(spark: SparkSession) -> str:
    """The folder for stored tables, which driver and executors share."""
    return (spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def corpus_index(spark: SparkSession, sf_dir: str, analyzer: str = "standard") -> ix.Index:
    """The index of a corpus, built once an application and stored by term, so that queries read their words' lists only."""
    key = (spark.sparkContext.applicationId, sf_dir, analyzer)
    folder = _shared(spark)
    files = spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    done = lambda path: files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/postings/_SUCCESS"))
    read = lambda path, name: spark.read.parquet(f"{path}/{name}")
    if key not in _STORED or not done(_STORED[key]):
        path = f"{folder}/tessera-index-{uuid.uuid4().hex}"
        docs = corpus(spark, sf_dir)
        # Texts are analyzed once; ranges and postings are taken from the stored rows.
        ix.forward(docs, analyzer).write.parquet(f"{path}/forward")
        rows = read(path, "forward")
        words = rows.agg(F.coalesce(F.sum("dl"), F.lit(0))).first()[0]
        ix.clustered(ix.forward_postings(rows, not ix.ids_repeat(docs)), words).write.parquet(f"{path}/postings")
        _STORED[key] = path
    path = _STORED[key]
    return ix.Index(read(path, "postings"), read(path, "forward").select("doc_id", F.col("dl").alias("doc_len")), analyzer)


def fresh_index(spark: SparkSession, sf_dir: str, analyzer: str = "standard") -> ix.Index:
    docs = corpus(spark, sf_dir)
    return ix.build_index(docs, analyzer, not ix.ids_repeat(docs))


def _node(query: str, analyzer: str = "standard") -> lang.Node:
    try:
        return lang.parse(query, lambda t: analyze_query_text(t, analyzer))
    except lang.QueryError:
        return lang.Nothing()


def _matches(query: str):
    return lambda spark, sf_dir: match(corpus_index(spark, sf_dir), lang.simplify(_node(query)))


def _hits(spark: SparkSession, sf_dir: str, request: Request) -> DataFrame:
    hits = scored_hits(corpus_index(spark, sf_dir), corpus(spark, sf_dir), request)
    return hits.withColumn("score", F.round("score", 6))


def _ranked(results: DataFrame, *columns: str) -> DataFrame:
    """Result rows with their rank; results are a page, so one window is small."""
    turn = Window.orderBy(F.col("score").desc(), F.col("doc_id").asc())
    return results.withColumn("rank", F.row_number().over(turn)).select("rank", "doc_id", "score", *columns)


# SQL parts.

_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
_BASE = f"""WITH toks AS (
  SELECT doc_id, list_filter(regexp_extract_all(lower(' ' || coalesce(text, '')), '[a-z0-9]+'),
    lambda t: length(t) > 1 AND t NOT IN ({_STOP})) AS toks FROM documents),
ds AS (SELECT doc_id, CAST(len(toks) AS INTEGER) AS doc_len FROM toks),
pos AS (SELECT doc_id, CAST(generate_subscripts(toks, 1) - 1 AS INTEGER) AS pos, unnest(toks) AS term FROM toks),
post AS (SELECT term, doc_id, CAST(count(*) AS INTEGER) AS tf FROM pos GROUP BY term, doc_id),
st AS (SELECT greatest(count(*), 1) AS n, sum(doc_len) / greatest(count(*), 1) AS avgdl FROM ds),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
idf AS (SELECT term, df, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf FROM df, st),
w AS (SELECT post.term, post.doc_id, idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * greatest(doc_len, 1) / avgdl)) AS w
  FROM post JOIN idf USING (term) JOIN ds USING (doc_id), st)"""
_TIMED = """, docs AS (SELECT d.doc_id, '' AS title, text AS body, lang, strftime(e.ts, '%Y-%m-%dT%H:%M:%SZ') AS timestamp, e.ts
  FROM documents d LEFT JOIN events e ON e.event_id = d.doc_id)"""


def _has(word: str) -> str:
    return f"(SELECT doc_id FROM post WHERE term = '{word}')"


def _scored(terms: list[str], where: str) -> str:
    """CTE text: hits (doc_id, score) over ``terms`` of the documents that ``where`` keeps."""
    names = ", ".join(f"'{t}'" for t in terms)
    return f"hits AS (SELECT doc_id, round(sum(w), 6) AS score FROM w WHERE term IN ({names}) AND {where} GROUP BY doc_id HAVING sum(w) > 0)"


_TWO = f"doc_id IN {_has('tion')} AND doc_id IN {_has('ing')}"
_BEST = "CAST(row_number() OVER (ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score"


# Index.


@_entry(f"{_BASE} SELECT doc_id, array_to_string(toks, ' ') AS tokens FROM toks")
def tokenize_docs(spark, sf_dir):
    return ix.analyzed(corpus(spark, sf_dir)).select("doc_id", F.array_join("tokens", " ").alias("tokens"))


@_entry(f"{_BASE} SELECT doc_id, pos, term FROM pos")
def token_positions(spark, sf_dir):
    return ix.token_positions(corpus(spark, sf_dir)).select("doc_id", "pos", "term")


@_entry(f"{_BASE} SELECT term, doc_id, tf FROM post")
def term_freq(spark, sf_dir):
    return fresh_index(spark, sf_dir).postings.select("term", "doc_id", "tf")


@_entry(f"{_BASE} SELECT term, doc_id, array_to_string(list(pos ORDER BY pos), ',') AS positions FROM pos GROUP BY term, doc_id")
def position_lists(spark, sf_dir):
    return fresh_index(spark, sf_dir).postings.select("term", "doc_id", F.array_join("positions", ",").alias("positions"))


@_entry(f"{_BASE} SELECT doc_id, doc_len FROM ds")
def doc_lengths(spark, sf_dir):
    return fresh_index(spark, sf_dir).doc_stats


@_entry(f"{_BASE} SELECT term, df FROM df")
def doc_freq(spark, sf_dir):
    return corpus_index(spark, sf_dir).doc_freq()


@_entry(f"{_BASE} SELECT n AS n_docs, round(avgdl, 6) AS avgdl FROM st")
def corpus_stats(spark, sf_dir):
    return corpus_index(spark, sf_dir).stats.select("n_docs", F.round("avgdl", 6).alias("avgdl"))


@_entry(f"{_BASE} SELECT term, df, round(idf, 6) AS idf FROM idf")
def idf_table(spark, sf_dir):
    index = corpus_index(spark, sf_dir)
    return rank.idf(index, None).select("term", "df", F.round("idf", 6).alias("idf"))


@_entry(
    "SELECT term, count(*) AS n, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, "
    "unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents) GROUP BY term"
)
def raw_terms(spark, sf_dir):
    return (
        ix.token_positions(corpus(spark, sf_dir), "raw")
        .groupBy("term")
        .agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("df"))
    )


@_entry(
    f"{_BASE}, words AS (SELECT DISTINCT term AS word FROM pos) SELECT word, stem FROM ("
    + stem_layers("words", "regexp_matches")
    + ") s"
)
def porter_vocab(spark, sf_dir):
    words = ix.token_positions(corpus(spark, sf_dir)).select(F.col("term").alias("word")).distinct()
    return stem_vocabulary(words)


@_entry(
    f"{_BASE}, words AS (SELECT DISTINCT term AS word FROM pos), stems AS ("
    + stem_layers("words", "regexp_matches")
    + ") SELECT stem AS term, count(*) AS n, count(DISTINCT doc_id) AS df FROM pos JOIN stems ON term = word GROUP BY stem"
)
def english_terms(spark, sf_dir):
    postings = corpus_index(spark, sf_dir, "english").postings
    return postings.groupBy("term").agg(F.sum(F.col("tf").cast("long")).alias("n"), F.count("*").alias("df"))


@_entry(f"{_BASE} SELECT term, df FROM df")
def incremental_equals_rebuild(spark, sf_dir):
    docs = corpus(spark, sf_dir)
    unique = not ix.ids_repeat(docs)
    first = ix.build_index(docs.where("doc_id % 3 <> 0"), unique=unique)
    return ix.updated_index(first, docs, unique).doc_freq()


# Matching.

_MATCH = {
    "match_term": ("tion", f"SELECT DISTINCT doc_id FROM post WHERE doc_id IN {_has('tion')}"),
    "match_and": ("tion AND ing", f"SELECT DISTINCT doc_id FROM post WHERE {_TWO}"),
    "match_implicit_and": ("tion ing", f"SELECT DISTINCT doc_id FROM post WHERE {_TWO}"),
    "match_or": ("tion or ing", "SELECT DISTINCT doc_id FROM post WHERE term IN ('tion', 'ing')"),
    "match_not": ("NOT tion", f"SELECT doc_id FROM ds WHERE doc_id NOT IN {_has('tion')}"),
    "match_and_not": (
        "tion AND NOT ing",
        f"SELECT DISTINCT doc_id FROM post WHERE doc_id IN {_has('tion')} AND doc_id NOT IN {_has('ing')}",
    ),
    "match_phrase2": (
        '"er re"',
        "SELECT DISTINCT a.doc_id FROM pos a JOIN pos b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE a.term = 'er' AND b.term = 're'",
    ),
    "match_phrase3": (
        '"er of ntre onbleea"',
        "SELECT DISTINCT a.doc_id FROM pos a JOIN pos b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 "
        "JOIN pos c ON a.doc_id = c.doc_id AND c.pos = a.pos + 2 WHERE a.term = 'er' AND b.term = 'ntre' AND c.term = 'onbleea'",
    ),
    "match_proximity": (
        "#3(tion,ing)",
        "SELECT DISTINCT a.doc_id FROM pos a JOIN pos b ON a.doc_id = b.doc_id AND abs(a.pos - b.pos) <= 3 "
        "WHERE a.term = 'tion' AND b.term = 'ing'",
    ),
    "match_nested": (
        '(tion OR ing) AND NOT (ble "er re")',
        "SELECT DISTINCT doc_id FROM post WHERE term IN ('tion', 'ing') AND NOT (doc_id IN "
        f"{_has('ble')} AND doc_id IN (SELECT a.doc_id FROM pos a JOIN pos b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 "
        "WHERE a.term = 'er' AND b.term = 're'))",
    ),
    "match_stopword_empty": ("the tion", "SELECT doc_id FROM ds WHERE false"),
}
for _name, (_query, _sql) in _MATCH.items():
    _QUERIES[_name] = _matches(_query)
    _SQL[_name] = f"{_BASE} {_sql}"


# Ranking.


@_entry(f"{_BASE} SELECT doc_id, round(sum(w), 6) AS score FROM w WHERE term IN ('tion', 'ing') GROUP BY doc_id")
def bm25_all(spark, sf_dir):
    scored = rank.bm25(corpus_index(spark, sf_dir), ["tion", "ing"])
    return scored.select("doc_id", F.round("score", 6).alias("score"))


@_entry(f"{_BASE}, {_scored(['tion', 'ing'], _TWO)} SELECT * FROM hits")
def bm25_and(spark, sf_dir):
    index = corpus_index(spark, sf_dir)
    scored = rank.bm25(index, ["tion", "ing"], match(index, _node("tion AND ing")))
    return scored.select("doc_id", F.round("score", 6).alias("score"))


@_entry(f"{_BASE}, {_scored(['tion', 'ing'], 'true')} SELECT * FROM hits")
def bm25_or(spark, sf_dir):
    return _hits(spark, sf_dir, Request("tion OR ing"))


@_entry(f"{_BASE} SELECT doc_id, 0.0::DOUBLE AS score FROM ds WHERE false")
def bm25_pure_not_empty(spark, sf_dir):
    return _hits(spark, sf_dir, Request("NOT (tion)"))


@_entry(
    f"{_BASE}, {_scored(['not', 'tion'], f'doc_id NOT IN {_has("tion")}')} SELECT * FROM hits"
)
def bm25_leading_not(spark, sf_dir):
    return _hits(spark, sf_dir, Request("NOT tion"))


@_entry(f"{_BASE}, {_scored(['tion', 'ing'], 'doc_id = 25')} SELECT * FROM hits")
def single_doc_score(spark, sf_dir):
    one = fresh_index(spark, sf_dir)
    scored = rank.bm25(one, ["tion", "ing"]).where("doc_id = 25")
    return scored.select("doc_id", F.round("score", 6).alias("score"))


@_entry(f"{_BASE}, {_scored(['tion', 'ing'], _TWO)} SELECT {_BEST} FROM hits QUALIFY rank <= 10")
def search_top10(spark, sf_dir):
    hits = _hits(spark, sf_dir, Request("tion AND ing"))
    return _ranked(rank.top(hits, 10))


@_entry(
    f"{_BASE}, {_scored(['tion', 'ing'], _TWO)} SELECT {_BEST} FROM hits WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en') QUALIFY rank <= 10"
)
def search_lang(spark, sf_dir):
    request = Request("tion ing", lang="en")
    return _ranked(result_page(_hits(spark, sf_dir, request), corpus(spark, sf_dir), request))


_SPAN = ("2024-01-01T12:00:00Z", "2024-01-02T23:59:59Z")


@_entry(
    f"{_BASE}{_TIMED}, {_scored(['tion', 'ing'], 'true')} SELECT {_BEST} FROM hits JOIN docs USING (doc_id) "
    f"WHERE timestamp IS NULL OR timestamp BETWEEN '{_SPAN[0]}' AND '{_SPAN[1]}' QUALIFY rank <= 10"
)
def search_time_range(spark, sf_dir):
    request = Request("tion OR ing", time_from=_SPAN[0], time_to=_SPAN[1])
    return _ranked(result_page(_hits(spark, sf_dir, request), corpus(spark, sf_dir, timed=True), request))


_FRESH = (
    "fresh AS (SELECT doc_id, round(CASE WHEN ts IS NULL THEN score ELSE score * (1 + 0.2 * pow(2.718281828, "
    "-greatest(0, epoch(TIMESTAMP '2024-02-01 00:00:00') - epoch(date_trunc('second', ts))) / 3600.0 / 72.0)) END, 6) AS score "
    "FROM hits JOIN docs USING (doc_id))"
)


def _fresh_hits(spark, sf_dir) -> DataFrame:
    hits = _hits(spark, sf_dir, Request("tion OR ing"))
    timed = hits.join(corpus(spark, sf_dir, timed=True).select("doc_id", "timestamp"), "doc_id")
    return timed.select("doc_id", F.round(rank.fresh_score(F.col("score"), F.col("timestamp"), NOW), 6).alias("score"))


@_entry(f"{_BASE}{_TIMED}, {_scored(['tion', 'ing'], 'true')}, {_FRESH} SELECT {_BEST} FROM fresh QUALIFY rank <= 10")
def search_freshness(spark, sf_dir):
    return _ranked(rank.top(_fresh_hits(spark, sf_dir), 10))


@_entry(
    f"{_BASE}, {_scored(['tion', 'ing'], _TWO)}, r AS (SELECT {_BEST} FROM hits), "
    "page AS (SELECT doc_id, score FROM r WHERE rank > 10) "
    f"SELECT {_BEST} FROM page QUALIFY rank <= 10"
)
def search_page2(spark, sf_dir):
    hits = _hits(spark, sf_dir, Request("tion AND ing"))
    last = rank.top(hits, 10).agg(F.max_by(F.struct("score", "doc_id"), F.struct(-F.col("score"), "doc_id")).alias("c")).first()["c"]
    if last is None:
        return _ranked(hits.limit(0))
    return _ranked(rank.top(hits.where(rank.after_cursor(last["score"], last["doc_id"])), 10))


@_entry(f"{_BASE}, {_scored(['tion', 'ing'], _TWO)} SELECT count(*) AS total_hits FROM hits")
def total_hits(spark, sf_dir):
    return _hits(spark, sf_dir, Request("tion AND ing")).agg(F.count("*").alias("total_hits"))


_SNIPPET = """SELECT rank, doc_id, score, trim(replace(body[s + 1 : e2], chr(10), ' '), ' ' || chr(9) || chr(13)) AS snippet FROM (
  SELECT *, least(length(body), e + CASE WHEN regexp_matches(body[e : e], '[\\p{L}\\p{N}]')
    THEN length(regexp_extract(body[e + 1 :], '(?s)^[\\p{L}\\p{N}]*.?')) ELSE 0 END) AS e2 FROM (
    SELECT *, greatest(0, s0 - length(regexp_extract(body[1 : s0 + 1], '[\\p{L}\\p{N}]*$'))) AS s, least(length(body), s0 + 180) AS e FROM (
      SELECT *, CASE WHEN p = 0 THEN 0 ELSE greatest(0, p - 61) END AS s0 FROM (
        SELECT rank, doc_id, score, text AS body, CASE WHEN position('tion' IN lower(text)) > 0 THEN position('tion' IN lower(text))
          ELSE position('ing' IN lower(text)) END AS p FROM best JOIN documents USING (doc_id)))))"""


@_entry(f"{_BASE}, {_scored(['tion', 'ing'], _TWO)}, best AS (SELECT {_BEST} FROM hits QUALIFY rank <= 10) {_SNIPPET}")
def search_snippet(spark, sf_dir):
    request = Request("tion ing")
    return _ranked(result_page(_hits(spark, sf_dir, request), corpus(spark, sf_dir), request), "snippet")


@_entry(
    "SELECT item_id, regexp_replace(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), "
    "'\"', '&quot;'), '''', '&#39;'), '(?i)(er re|tion|ing)', '<strong>\\1</strong>', 'g') AS marked FROM benchmark"
)
def highlight(spark, sf_dir):
    items = _table(spark, sf_dir, "benchmark")
    return items.select("item_id", present.highlight(F.col("text"), 'tion AND ing "er re"').alias("marked"))


@_entry(
    f"{_BASE}, {_scored(['tion', 'ing'], 'true')} SELECT {_BEST}, CAST(ceil(row_number() OVER (ORDER BY score DESC, doc_id) / 10.0) AS INTEGER) AS page "
    "FROM hits QUALIFY rank <= 50"
)
def paged_rows(spark, sf_dir):
    return present.paged(_hits(spark, sf_dir, Request("tion OR ing")), 10, 5).select("rank", "doc_id", "score", "page")


_PRF_STOP = ", ".join(f"'{w}'" for w in [*rank.FEEDBACK_STOP, "tion"])
_PRF = (
    f"{_BASE}, {_scored(['tion'], 'true')}, best AS (SELECT {_BEST} FROM hits QUALIFY rank <= 5), "
    "fb AS (SELECT term, count(*) AS n, min(CAST(rank AS BIGINT) * 1000000000 + pos) AS f FROM pos JOIN best USING (doc_id) "
    f"WHERE length(term) > 2 AND term NOT IN ({_PRF_STOP}) GROUP BY term ORDER BY n DESC, f, term LIMIT 5)"
)


def _best_five(spark, sf_dir) -> DataFrame:
    return _ranked(rank.top(_hits(spark, sf_dir, Request("tion")), 5)).select("doc_id", "rank")


@_entry(f"{_PRF} SELECT term, n FROM fb")
def prf_terms(spark, sf_dir):
    return rank.feedback_terms(corpus(spark, sf_dir), _best_five(spark, sf_dir), ["tion"]).select("term", "n")


@_entry(
    f"{_PRF}, again AS (SELECT doc_id, round(sum(w), 6) AS score FROM w WHERE (term = 'tion' OR term IN (SELECT term FROM fb)) "
    f"AND doc_id IN {_has('tion')} GROUP BY doc_id) SELECT {_BEST} FROM again QUALIFY rank <= 10"
)
def prf_search(spark, sf_dir):
    extra = [r["term"] for r in prf_terms(spark, sf_dir).collect()]  # five words
    hits = rank.ranked_matches(corpus_index(spark, sf_dir), _node("tion"), ["tion", *extra])
    return _ranked(rank.top(hits.withColumn("score", F.round("score", 6)), 10))


@_entry(
    f"""{_BASE}, q AS (SELECT item_id AS query_id, unnest(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda t: length(t) > 1 AND t NOT IN ({_STOP})))) AS term FROM benchmark),
need AS (SELECT query_id, count(*) AS need FROM q GROUP BY query_id),
h AS (SELECT query_id, doc_id, count(*) AS have, sum(w) AS score FROM q JOIN w USING (term) GROUP BY query_id, doc_id)
SELECT query_id, doc_id, round(score, 6) AS score,
  CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS INTEGER) AS rank
FROM h JOIN need USING (query_id) WHERE have = need QUALIFY rank <= 3"""
)
def search_batch(spark, sf_dir):
    """Every benchmark text, whole, as a query."""
    log = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    found = search_many(corpus_index(spark, sf_dir), log, 3)
    return found.select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@_entry()
def query_shapes(spark, sf_dir):
    """A fixture: the shapes of eight query forms.  It reads no table; parsing is driver-side work on short strings."""
    log = ["tion", "tion ing", '"er re"', "#3(tion,ing)", "NOT (tion OR ing)", "the tion", "(tion", '(a "er re") OR tion']
    keys = ("valid", "node_type", "term_count", "operator_count", "has_phrases", "has_proximity", "max_depth", "complexity")
    rows = []
    for query in log:
        shape = lang.analyze_query(query, analyze_query_text)
        rows.append((query, *[shape.get(k) for k in keys], shape.get("distance")))
    schema = "query string, valid boolean, node_type string, term_count int, operator_count int, has_phrases boolean, has_proximity boolean, max_depth int, complexity string, distance int"
    return spark.createDataFrame(rows, schema)


# URLs and pages.

_U = """SELECT page_id, url, html, coalesce(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1), '') AS s,
  lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS h,
  regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS p,
  regexp_extract(url, '\\?([^#]*)', 1) AS q FROM pages"""
_NORMAL = (
    "lower(s) || '://' || h || CASE WHEN p IN ('', '/') THEN '/' ELSE regexp_replace(p, '/$', '') END || CASE WHEN q = '' THEN '' "
    "ELSE '?' || array_to_string(list_sort(list_transform(string_split(q, '&'), lambda x: CASE WHEN contains(x, '=') THEN x ELSE x || '=' END)), '&') END"
)


def _pages(spark, sf_dir) -> DataFrame:
    return _table(spark, sf_dir, "pages")


@_entry(f"SELECT page_id, {_NORMAL} AS url FROM ({_U})")
def url_normalize(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", urls.normalize_url(F.col("url")).alias("url"))


@_entry(f"SELECT page_id, 'u-' || sha1({_NORMAL})[1:16] AS doc_id FROM ({_U})")
def url_doc_id(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", urls.url_doc_id(F.col("url")).alias("doc_id"))


@_entry("SELECT page_id, regexp_replace(url, '[?#].*$', '') AS url FROM pages")
def url_canonical(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", urls.canonical_url(F.col("url")).alias("url"))


@_entry(
    f"SELECT page_id, CASE WHEN regexp_matches(lower(q), 'utm_|fbclid|gclid|mc_cid|mc_eid|ref|share') "
    f"THEN regexp_replace(url, '\\?[^#]*', '') ELSE url END AS url FROM ({_U})"
)
def url_strip_tracking(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", urls.strip_tracking(F.col("url")).alias("url"))


@_entry(f"SELECT page_id, h AS host FROM ({_U})")
def url_host(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", urls.host(F.col("url")).alias("host"))


_BAD = "|".join(urls.BAD_ROUTES)


_ARTICLE = f"""starts_with(url, 'http') AND NOT regexp_matches(p, '\\.(jpg|jpeg|png|gif|svg|pdf|zip|mp4|mp3|webm|css|js|ico|woff|woff2)$')
  AND NOT regexp_matches(lower(p), '{_BAD}') AND len(seg) > 0
  AND CASE WHEN len(seg) = 1 THEN lower(seg[1]) NOT IN ('home', 'index', 'search', 'login', 'signup', 'admin') ELSE length(p) >= 8 END"""
_SEGMENTS = f"(SELECT *, list_filter(string_split(p, '/'), lambda x: x <> '') AS seg FROM ({_U}))"


@_entry(f"SELECT page_id, {_ARTICLE} AS article FROM {_SEGMENTS}")
def url_is_article(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", urls.is_article_url(F.col("url"), F.lit("other")).alias("article"))


_SPACES = "[\\s\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{b}\\x{1c}-\\x{1f}]"


def _run_sql(run: str) -> str:
    """SQL of a text run: the references that the pages have decoded, ends stripped."""
    for name, char in (("nbsp", "chr(160)"), ("lt", "'<'"), ("gt", "'>'"), ("quot", "'\"'"), ("#39", "chr(39)"), ("middot", "chr(183)"), ("copy", "chr(169)"), ("amp", "'&'")):
        run = f"replace({run}, '&{name};', {char})"
    return f"regexp_replace({run}, '^{_SPACES}+|{_SPACES}+$', '', 'g')"


_TEXT = (
    "array_to_string(list_filter(list_transform(regexp_split_to_array(html, '(?is)<!--.*?-->|<script\\b[^>]*>.*?</script\\s*>|"
    f"<style\\b[^>]*>.*?</style\\s*>|<[^>]*>'), lambda r: {_run_sql('r')}), lambda r: r <> ''), ' ')"
)


@_entry(f"SELECT page_id, {_TEXT} AS body FROM pages")
def html_text(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", html.html_text(F.col("html")).alias("body"))


@_entry("SELECT page_id, " + _run_sql("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)") + " AS title FROM pages")
def html_title(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", html.html_title(F.col("html")).alias("title"))


@_entry(f"SELECT page_id FROM pages WHERE length({_TEXT}) >= 200")
def short_body(spark, sf_dir):
    return _pages(spark, sf_dir).where(html.long_enough(html.html_text(F.col("html")))).select("page_id")


# Ingest.


@_entry("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def store_dedup(spark, sf_dir):
    """Every document comes twice, the second time in another language; labelled ones are in the store."""
    docs = _table(spark, sf_dir, "documents")
    batch = docs.select("doc_id", "lang", F.lit(1).alias("seq")).unionByName(docs.select("doc_id", F.lit("xx").alias("lang"), F.lit(2).alias("seq")))
    return ingest.store_dedup(batch, _table(spark, sf_dir, "labels").select("doc_id"), "seq").select("doc_id", "lang")


@_entry("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def seen_antijoin(spark, sf_dir):
    return ingest.unseen(_table(spark, sf_dir, "documents").select("doc_id"), _table(spark, sf_dir, "labels"))


@_entry("SELECT source, doc_id, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS INTEGER) AS turn FROM documents QUALIFY turn <= 20")
def site_quota(spark, sf_dir):
    rows = _table(spark, sf_dir, "documents").select("source", "doc_id")
    return ingest.with_quota(rows, "source", F.lit(20), [F.col("doc_id")])


@_entry(
    "SELECT source, doc_id, turn FROM (SELECT source, doc_id, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS INTEGER) AS turn "
    "FROM documents) WHERE turn <= 50 ORDER BY turn, source LIMIT 150"
)
def round_robin(spark, sf_dir):
    rows = _table(spark, sf_dir, "documents").select("source", "doc_id")
    return ingest.with_quota(rows, "source", F.lit(50), [F.col("doc_id")], 150)


_RUNS = "SELECT user_id AS src_id, event_id, ts, event_id % 3 = 0 AS ok, event_id % 7 AS new, event_id % 500 AS duration_ms FROM events"


def _runs(spark, sf_dir) -> DataFrame:
    e = F.col("event_id")
    return _table(spark, sf_dir, "events").select(
        F.col("user_id").alias("src_id"), "event_id", "ts", (e % 3 == 0).alias("ok"), (e % 7).alias("new"), (e % 500).alias("duration_ms")
    )


@_entry(
    f"""WITH r AS ({_RUNS}), g AS (SELECT *, sum(CAST(ok AS INTEGER)) OVER (PARTITION BY src_id ORDER BY ts, event_id) AS g FROM r),
f AS (SELECT *, sum(CAST(NOT ok AS INTEGER)) OVER (PARTITION BY src_id, g ORDER BY ts, event_id) AS n FROM g)
SELECT src_id, event_id, CAST(n AS BIGINT) AS fail_count, CAST(least(180 * pow(2, n), 3600) AS BIGINT) AS wait_s FROM f"""
)
def backoff_schedule(spark, sf_dir):
    runs = ingest.failure_runs(_runs(spark, sf_dir), "src_id", ["ts", "event_id"])
    return runs.select(
        "src_id", "event_id", "fail_count", ingest.backoff_seconds(F.lit(180), F.col("fail_count")).alias("wait_s")
    )


@_entry(
    f"WITH r AS ({_RUNS}), l AS (SELECT src_id, max(ts) AS last FROM r GROUP BY src_id) "
    "SELECT src_id FROM l WHERE src_id % 2 = 0 AND last + INTERVAL 6 HOUR <= TIMESTAMP '2024-01-30 00:00:00'"
)
def feed_due(spark, sf_dir):
    last = ingest.latest_state(_runs(spark, sf_dir).select("src_id", "ts"), "src_id", "ts")
    feeds = last.select(
        "src_id", (F.col("src_id") % 2 == 0).alias("enabled"), (F.col("ts") + F.expr("INTERVAL 6 HOURS")).alias("next_run")
    )
    return ingest.due(feeds, F.lit("2024-01-30 00:00:00").cast("timestamp_ntz")).select("src_id")


@_entry(
    f"SELECT page_id, h AS host, round(coalesce(sum(1.5 + page_id % 10 / 10.0) OVER (PARTITION BY h ORDER BY page_id ROWS BETWEEN "
    f"UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 3)::DOUBLE AS start_s FROM ({_U})"
)
def host_schedule(spark, sf_dir):
    rows = _pages(spark, sf_dir).select("page_id", urls.host(F.col("url")).alias("host"))
    least, _ = ingest.HOST_DELAYS["fast"]
    timed = ingest.host_schedule(rows, "host", [F.col("page_id")], F.lit(least) + F.col("page_id") % 10 / 10.0)
    return timed.select("page_id", "host", F.round("start_s", 3).alias("start_s"))


@_entry(
    f"SELECT CAST(ts AS DATE) AS day, src_id, count(*) AS runs, CAST(sum(CAST(NOT ok AS INTEGER)) AS BIGINT) AS failed, "
    f"CAST(sum(new) AS BIGINT) AS new_docs, round(avg(duration_ms), 6) AS avg_ms FROM ({_RUNS}) GROUP BY 1, 2"
)
def history_daily(spark, sf_dir):
    return ingest.history_by_day(_runs(spark, sf_dir))


@_entry(f"SELECT event_id, CAST(ts AS DATE) AS day FROM ({_RUNS}) WHERE CAST(ts AS DATE) >= DATE '2024-01-30' - 14")
def history_retention(spark, sf_dir):
    history = _runs(spark, sf_dir).select("event_id", F.to_date("ts").alias("day"))
    return ingest.retained(history, F.lit("2024-01-30").cast("date"))


@_entry(
    "SELECT source AS site, reason, n, place FROM (SELECT source, reason, count(*) AS n, CAST(row_number() OVER (PARTITION BY source "
    "ORDER BY count(*) DESC, reason) AS INTEGER) AS place FROM (SELECT source, lang || '-' || (n_chars % 5) AS reason FROM documents) GROUP BY 1, 2) WHERE place <= 8"
)
def drop_reasons(spark, sf_dir):
    reason = F.concat_ws("-", "lang", (F.col("n_chars") % 5).cast("string"))
    rows = _table(spark, sf_dir, "documents").select(F.col("source").alias("site"), reason.alias("reason"))
    return ingest.drop_reasons(rows, "site", "reason").select("site", "reason", "n", "place")


_TITLE = _run_sql("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")


@_entry(
    f"""WITH k AS (
  SELECT page_id, html, h AS site, regexp_replace(url, '[?#].*$', '') AS url,
    'u-' || sha1(lower(s) || '://' || h || CASE WHEN p IN ('', '/') THEN '/' ELSE regexp_replace(p, '/$', '') END)[1:16] AS doc_id
  FROM {_SEGMENTS} WHERE {_ARTICLE}),
t AS (SELECT doc_id, site, url, {_TITLE} AS title, length({_TEXT}) AS chars FROM k
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY page_id) = 1)
SELECT doc_id, site, url, CASE WHEN title = '' THEN '[' || upper(site) || '] ' || url ELSE title END AS title,
  CAST(chars AS INTEGER) AS body_chars FROM t WHERE chars >= 200"""
)
def backfill(spark, sf_dir):
    """The whole backfill of the landed pages."""
    pages = _pages(spark, sf_dir).select(urls.host(F.col("url")).alias("site"), "url", "html", F.col("page_id").alias("seq"))
    seen = spark.createDataFrame([], "doc_id string")
    docs = ingest.backfilled(pages, seen)
    return docs.select("doc_id", "site", "url", "title", F.length("body").alias("body_chars"))


@_entry()
def sitemap_pages(spark, sf_dir):
    """All page URLs, read back through sitemaps that name them, by recursion from an index."""
    pages = _pages(spark, sf_dir).where("url IS NOT NULL")
    n_maps = max(4, -(-pages.count() // SITEMAP_URLS))
    pages = pages.select("url", F.pmod(F.monotonically_increasing_id(), F.lit(n_maps)).alias("part"))
    loc = F.concat(F.lit("<url><loc>"), F.replace(F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("</loc></url>"))
    maps = pages.groupBy("part").agg(F.concat_ws("", F.collect_list(loc)).alias("x")).select(
        F.concat(F.lit("part"), "part", F.lit(".xml")).alias("file"), F.concat(F.lit("<urlset>"), "x", F.lit("</urlset>")).alias("text")
    )
    names = "".join(f"<sitemap><loc>https://example.org/part{i}.xml</loc></sitemap>" for i in range(n_maps))
    root = spark.createDataFrame([("root.xml", f"<sitemapindex>{names}</sitemapindex>")], "file string, text string")
    path = f"{_shared(spark)}/tessera-sitemaps-{uuid.uuid4().hex}"
    file_entries(maps.unionByName(root)).write.parquet(path)
    return sitemap_urls(spark.read.parquet(path), "root.xml").select("loc")


_SQL["sitemap_pages"] = "SELECT url AS loc FROM pages WHERE url IS NOT NULL"
