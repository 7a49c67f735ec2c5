"""Ingest functions, sources and streaming."""

from __future__ import annotations

import datetime
import gzip
import json
from html import unescape
from urllib.parse import parse_qsl, urlencode, urlsplit, urlunsplit

import pytest
from pyspark.sql import functions as F

from tessera import engine as en
from tessera.functions import html, times, urls
from tessera.operators import ingest
from tessera.sources import connectors, landed, state
from tessera.streaming import feeds, scheduler


def _one(spark, column, **values):
    frame = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return frame.select(column.alias("v")).first()["v"]


URLS = [
    "HTTP://Example.COM:80/a/", "https://example.com:443", "https://example.com:8443/", "http://e.com/a/?b=2&a=1&a=&c#f", "",
    "  http://e.com/x//  ", "http://e.com/?q=a b*~%41é&x", "http://e.com/?=&a=%zz", "http://e.com/?a=1+2",
    "mailto:a@b", "example.com/x", "/a/b/", "//e.com/x/", "urn:x:y", "http:///x", "ab:/", "ab:", "?b=1&a", "ab://h/x", "http:x/y", "ab:///x//",
]


@pytest.mark.parametrize("url", URLS)
def test_normalize_url(spark, url):
    def model(text):
        parts = urlsplit(text.strip())
        if not text.strip():
            return ""
        scheme, host = (parts.scheme or "http").lower(), parts.netloc.lower()
        host = host.removesuffix(":80") if scheme == "http" else host.removesuffix(":443")
        path = parts.path or "/"
        path = path[:-1] if path != "/" and path.endswith("/") else path
        return urlunsplit((scheme, host, path, urlencode(sorted(parse_qsl(parts.query, keep_blank_values=True))), ""))

    assert _one(spark, urls.normalize_url(F.col("u")), u=url) == model(url)


def test_url_ids(spark):
    assert _one(spark, urls.normalize_url(F.col("u")), u=None) == ""
    a = _one(spark, urls.url_doc_id(F.col("u")), u="http://e.com/a/?b=1#x")
    assert a == _one(spark, urls.url_doc_id(F.col("u")), u="HTTP://E.com:80/a?b=1") and len(a) == 18
    assert _one(spark, urls.strip_tracking(F.col("u")), u="http://e.com/a?UTM_x=1#f") == "http://e.com/a#f"
    assert _one(spark, urls.canonical_url(F.col("u")), u="http://e.com/a?x=1#f") == "http://e.com/a"


ARTICLES = [
    ("wikipedia", "https://en.wikipedia.org/wiki/Cat", True), ("wikipedia", "https://en.wikipedia.org/wiki/File:Cat", False),
    ("bbc", "https://bbc.com/news/x", True), ("bbc", "https://bbc.com/news/live/x", False),
    ("nasa", "https://www.nasa.gov/missions/x", True), ("nasa", "https://nasa.com/missions/x", False),
    ("govuk", "https://gov.uk/guidance/x", True), ("govuk", "https://gov.uk/other/x", False),
    ("python_docs", "https://docs.python.org/3/x.html", True), ("python_docs", "https://docs.python.org/_static/x", False),
    ("howstuffworks", "https://www.howstuffworks.com/x", True), ("howstuffworks", "https://howstuffworks.com/x", False),
    ("natgeo", "https://www.nationalgeographic.com/x", True), ("natgeo", "https://www.nationalgeographic.com/photos/x", False),
    ("smithsonian", "https://www.smithsonianmag.com/", True), ("smithsonian", "https://x.com/", False),
    ("guardian", "https://www.theguardian.com/x", True), ("guardian", "https://www.theguardian.com/sudoku", False),
    ("mit_news", "https://news.mit.edu/2024/x", True), ("mit_news", "https://news.mit.edu/x.xml", False),
    ("techcrunch", "https://techcrunch.com/2024/01/02/events/", True), ("techcrunch", "https://techcrunch.com/events/x", False),
    ("techcrunch", "https://techcrunch.com/newsletters/a/b", True), ("techcrunch", "https://techcrunch.com/newsletters/a", False),
    ("world_bank", "https://www.worldbank.org/en/news/x", True), ("world_bank", "https://www.worldbank.org/fr/x", False),
    ("django_docs", "https://docs.djangoproject.com/en/5/x", True), ("django_docs", "https://docs.djangoproject.com/en/_static/x", False),
    ("other", "https://x.com/about", True), ("other", "https://x.com/Index", False), ("other", "https://x.com/a/b", False),
    ("other", "https://x.com/abcdef/defg", True), ("other", "https://x.com/api/abcdef", False), ("other", "https://x.com/a/photo.png", False),
    ("OTHER", "ftp://x.com/abcdef/defg", False), (None, None, False),
]


def test_articles(spark):
    frame = spark.createDataFrame([(i, s, u) for i, (s, u, _) in enumerate(ARTICLES)], "i int, s string, u string")
    got = {r["i"]: r["v"] for r in frame.select("i", urls.is_article_url(F.col("u"), F.col("s")).alias("v")).collect()}
    assert [got[i] for i in range(len(ARTICLES))] == [a[2] for a in ARTICLES]


def test_html(spark):
    page = "<html><title> A &amp; B </title><!-- no --><script>var x='</p>';</script><style>p{}</style><p>One <b>two</b>\n three&nbsp;&lt;4</p></html>"
    assert _one(spark, html.html_text(F.col("h")), h=page) == "A & B One two three\u00a0<4"
    refs = "a&#8217;b &mdash; &#x41;&#150;&copy;&nosuch; & &amp;lt; &#0;&NotEqualTilde;&;"
    assert _one(spark, html.html_text(F.col("h")), h=f"<i>{refs}</i>") == unescape(refs.replace("&nosuch;", "&amp;nosuch;"))
    assert _one(spark, html.html_text(F.col("h")), h="<p> a  b\n c&nbsp;</p>&nbsp;<p>d<!-- x -->e") == "a  b\n c d e"
    assert _one(spark, html.html_title(F.col("h")), h=page) == "A & B"
    assert _one(spark, html.html_title(F.col("h"), F.lit("bbc"), F.lit("u")), h="<p>") == "[BBC] u"
    assert _one(spark, html.html_text(F.col("h")), h=None) == ""
    assert _one(spark, html.prefixed_title(F.col("t"), F.col("p")), t=" x ", p="[P]") == "[P] x"
    assert [_one(spark, html.long_enough(F.col("b")), b="x" * n) for n in (199, 200)] == [False, True]


@pytest.mark.parametrize(
    "raw, iso",
    [
        ("Tue, 02 Jan 2024 03:04:05 +0200", "2024-01-02T01:04:05Z"), ("Tue, 02 Jan 2024 03:04:05 GMT", "2024-01-02T03:04:05Z"),
        ("2024-01-02T03:04:05Z", "2024-01-02T03:04:05Z"), ("2024-01-02 03:04:05", "2024-01-02T03:04:05Z"), ("soon", None), (None, None),
    ],
)
def test_times(spark, raw, iso):
    assert _one(spark, times.iso_utc(F.col("t")), t=raw) == iso


def test_backoff(spark):
    frame = spark.range(0, 8).select(
        ingest.backoff_seconds(F.lit(180), F.col("id")).alias("b"), ingest.penalty_seconds(F.col("id")).alias("p")
    )
    rows = frame.collect()
    assert [r["b"] for r in rows] == [180, 360, 720, 1440, 2880, 3600, 3600, 3600]
    assert [r["p"] for r in rows][:4] == [0, 10, 20, 40]
    assert [feeds.next_state(n, False, 180)[1] for n in range(3)] == [360, 720, 1440] and feeds.next_state(5, True, None) == (0, 180)


def test_backfill(spark):
    body = "word " * 60
    pages = [("s", f"https://x.com/abcdef/{i}?utm_source=z", f"<title>T{i}</title><p>{body}</p>", i) for i in (1, 2, 3)]
    pages += [("s", "https://x.com/abcdef/1#again", f"<p>{body}</p>", 9), ("s", "https://x.com/abcdef/short", "<p>x</p>", 10)]
    frame = spark.createDataFrame(pages, "site string, url string, html string, seq long")
    none = spark.createDataFrame([], "doc_id string")
    docs = ingest.backfilled(frame, none).collect()
    assert {d["url"] for d in docs} == {f"https://x.com/abcdef/{i}" for i in (1, 2, 3)}
    seen = spark.createDataFrame([(docs[0]["doc_id"],)], "doc_id string")
    assert ingest.backfilled(frame, seen, quota=1).count() == 1


def test_states_and_history(spark):
    states = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "k string, t int, v string")
    assert {tuple(r) for r in ingest.latest_state(states, "k", "t").collect()} == {("a", 2, "y"), ("b", 1, "z")}
    a, b = spark.createDataFrame([("1",)], "doc_id string"), spark.createDataFrame([("1",), ("2",)], "doc_id string")
    assert ingest.merged_seen(a, b).count() == 2
    row = spark.range(1).select(
        ingest.resolved_interval(F.lit(None), F.lit(None)).alias("i"), ingest.resolved_limit(F.lit(None), F.lit(7)).alias("l"),
        ingest.fetched_ok(F.lit(200), F.lit("text/html; x")).alias("ok"), ingest.fetched_ok(F.lit(403), F.lit("text/html")).alias("no"),
    ).first()
    assert tuple(row) == (180, 7, True, False)


SITEMAP = '<?xml version="1.0"?><urlset xmlns="x"><url><loc> https://x.com/{}?a=1&amp;b=2 </loc><lastmod>2024</lastmod></url><url><loc></loc></url></urlset>'


def test_sitemaps(spark, tmp_path):
    (tmp_path / "root.xml").write_text("<sitemapindex><sitemap><loc>https://x.com/a.xml</loc></sitemap><sitemap><loc>https://x.com/b.xml.gz</loc></sitemap></sitemapindex>")
    (tmp_path / "a.xml").write_text(SITEMAP.format("a"))
    (tmp_path / "b.xml.gz").write_bytes(gzip.compress(SITEMAP.format("b").encode()))
    (tmp_path / "bad.xml").write_text("<other/>")
    (tmp_path / "broken.gz").write_bytes(b"\x1f\x8bjunk")
    entries = landed.read_sitemap_files(spark, str(tmp_path))
    got = {tuple(r) for r in landed.sitemap_urls(entries, "root.xml").collect()}
    assert got == {("https://x.com/a?a=1&b=2", "2024"), ("https://x.com/b?a=1&b=2", "2024")}
    assert landed.sitemap_urls(entries, "root.xml", 1).count() == 1
    connectors.register(spark)
    source = spark.read.format("sitemaps").load(str(tmp_path)).where("kind = 'page'")
    assert source.count() == 2


def test_cdx_and_config(spark, tmp_path):
    lines = [
        {"url": "https://a.x.com/1", "timestamp": "2024", "status": "200", "mime": "text/html", "urlkey": "k1"},
        {"url": "https://a.x.com/1", "timestamp": "2023", "status": "200", "mime": "text/html", "urlkey": "k1"},
        {"url": "https://x.com/2", "timestamp": "2024", "status": "404", "mime": "text/html", "urlkey": "k2"},
        {"url": "https://y.org/3", "timestamp": "2024", "status": "200", "mime": "text/html", "urlkey": "k3"},
    ]
    (tmp_path / "cdx.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\nbroken")
    read = lambda *a, **k: {(r["url"], r["timestamp"]) for r in landed.read_cdx(spark, str(tmp_path / "cdx.jsonl"), *a, **k).collect()}
    assert read() == {("https://a.x.com/1", "2023"), ("https://y.org/3", "2024")}
    assert read("domain", "x.com") == {("https://a.x.com/1", "2023")} == read("prefix", "https://a.x")
    assert read("tld", "*.org") == {("https://y.org/3", "2024")} and read(start="2024", end="2024") == {("https://a.x.com/1", "2024"), ("https://y.org/3", "2024")}
    config = {"default_limit": 20, "sources": [{"id": "s", "url": "u", "lang": "en", "enabled": True, "doc_prefix": "p", "title_prefix": "[S]"}]}
    (tmp_path / "sources.json").write_text(json.dumps(config, indent=1))
    row = landed.read_sources(spark, str(tmp_path / "sources.json")).first()
    assert (row["id"], row["default_limit"], row["limit"], row["enabled"]) == ("s", 20, None, True)


RSS = """<rss><channel><title>no</title><item><title><![CDATA[A &amp; B]]></title><link>https://x.com/1</link>
<description>&lt;p&gt;Hello&lt;/p&gt;</description><pubDate>Tue, 02 Jan 2024 03:04:05 GMT</pubDate></item>
<item><title>C</title><link>https://x.com/2</link></item></channel></rss>"""


def test_feeds(spark, tmp_path):
    folder = tmp_path / "feeds"
    folder.mkdir()
    (folder / "s.xml").write_text(RSS)
    connectors.register(spark)
    raw = spark.read.format("feeds").load(str(folder)).select("src_id", "xml", F.lit(1).alias("limit"), F.lit("en").alias("lang"), F.lit("[S]").alias("title_prefix"))
    rows = landed.feed_documents(raw).collect()
    assert [(r["title"], r["body"], r["url"], r["timestamp"]) for r in rows] == [("[S] A & B", "Hello", "https://x.com/1", "2024-01-02T03:04:05Z")]


def test_stream_ingest(spark, tmp_path):
    inbox = tmp_path / "in"
    row = lambda i: json.dumps({"doc_id": f"d{i}", "title": "", "body": "cat dog", "lang": "en", "ingest_seq": i})
    inbox.mkdir()
    (inbox / "1.json").write_text("\n".join(row(i) for i in (1, 2, 2)))
    engine = en.SearchEngine(spark, str(tmp_path / "engine"), analyzer="standard")
    stream = lambda: feeds.ingest_stream(feeds.document_stream(spark, str(inbox)), engine.ingest, str(tmp_path / "cp"))
    stream().awaitTermination()
    (inbox / "2.json").write_text("\n".join(row(i) for i in (2, 3)))
    stream().awaitTermination()
    assert engine.health().first()["docs_count"] == 3 and engine.search(en.Request("cat")).total_hits == 3


def test_feed_state_stream(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1)
    rows = [("a", at, False, 100), ("a", at + datetime.timedelta(seconds=5), False, 100), ("b", at, True, None)]
    spark.createDataFrame(rows, feeds.OUTCOMES).coalesce(1).write.parquet(str(tmp_path / "o"))
    stream = spark.readStream.schema(feeds.OUTCOMES).parquet(str(tmp_path / "o"))
    query = feeds.feed_states(stream).writeStream.format("memory").queryName("states").outputMode("update").trigger(availableNow=True).start()
    query.awaitTermination()
    got = {r["src_id"]: (r["fail_count"], r["next_run"]) for r in spark.sql("SELECT * FROM states").collect()}
    assert got == {"a": (2, at + datetime.timedelta(seconds=405)), "b": (0, at + datetime.timedelta(seconds=180))}


def test_stream_dedup_and_history(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1)
    spark.createDataFrame([("x", at), ("x", at), ("y", at)], "doc_id string, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "s"))
    stream = spark.readStream.schema("doc_id string, ts timestamp").parquet(str(tmp_path / "s"))
    for late in (None, "1 hour"):
        query = feeds.deduplicated(stream, late=late).writeStream.format("memory").queryName(f"d{len(late or '')}").trigger(availableNow=True).start()
        query.awaitTermination()
        assert spark.sql(f"SELECT * FROM d{len(late or '')}").count() == 2
    feeds.write_history(stream, str(tmp_path / "h"), str(tmp_path / "c")).awaitTermination()
    assert spark.read.json(str(tmp_path / "h")).where("day = '2024-01-01'").count() == 3


def test_poll(spark, tmp_path):
    columns = "id string, url string, lang string, enabled boolean, title_prefix string, limit int, interval_s int, default_limit int, default_interval_s int"
    rows = [("a", "u1", "en", True, "[A]", None, 60, 20, None), ("b", "u2", "en", True, "", 5, None, 20, None), ("c", "u3", "en", False, "", None, None, 20, None)]
    sources = spark.createDataFrame(rows, columns)
    fetch = lambda ready: ready.select("src_id", F.when(F.col("src_id") == "a", RSS).alias("xml"), F.when(F.col("src_id") == "b", "timeout").alias("err"))
    engine = en.SearchEngine(spark, str(tmp_path / "e"), analyzer="standard")
    run = lambda now: scheduler.poll(engine, sources, fetch, str(tmp_path / "s"), str(tmp_path / "h"), now)
    first = run("2024-01-01T00:00:00Z")
    assert {r["src_id"]: (r["fail_count"], str(r["next_run"])) for r in first.feeds.collect()} == {
        "a": (0, "2024-01-01 00:01:00"), "b": (1, "2024-01-01 00:06:00"),
    }
    assert engine.health().first()["docs_count"] == 2 and first.seen.count() == 2
    second = run("2024-01-01T00:02:00Z")
    assert {r["src_id"]: r["fail_count"] for r in second.feeds.collect()} == {"a": 0, "b": 1} and second.version == 2
    third = run("2024-01-20T00:00:00Z")
    assert {r["src_id"]: r["fail_count"] for r in third.feeds.collect()} == {"a": 0, "b": 2}
    history = spark.read.json(str(tmp_path / "h"))
    assert history.count() == 5 and history.where("src_id = 'a'").agg(F.sum("new")).first()[0] == 2
    assert scheduler.drop_old_history(spark, str(tmp_path / "h"), "2024-01-20") == ["day=2024-01-01"]
    assert state.load_state(spark, str(tmp_path / "none")).version == 0


def test_page_bytes_and_audit(spark, tmp_path):
    frame = spark.createDataFrame([(b"ok \xff\xc3\xa9",)], "content binary")
    assert frame.select(ingest.page_text(F.col("content"))).first()[0] == "ok é"
    ingest.append_audit(spark.createDataFrame([("d1",)], "doc_id string"), str(tmp_path / "a"))
    assert spark.read.json(str(tmp_path / "a")).first()["doc_id"] == "d1"


def test_sitemaps_of_one_name_do_not_clash(spark, tmp_path):
    for place, loc in (("a.org/x/1.xml", "https://a.org/p"), ("a.org/y/1.xml", "https://a.org/q")):
        (tmp_path / place).parent.mkdir(parents=True)
        (tmp_path / place).write_text(f"<urlset><url><loc>{loc}</loc></url></urlset>")
    (tmp_path / "root.xml").write_text("<sitemapindex><sitemap><loc>https://a.org/y/1.xml</loc></sitemap></sitemapindex>")
    found = landed.sitemap_urls(landed.read_sitemap_files(spark, str(tmp_path)), "root.xml")
    assert [r["loc"] for r in found.collect()] == ["https://a.org/q"]


def test_long_sitemaps_are_read_once(spark, tmp_path, monkeypatch):
    import time

    from tessera.plans import catalog

    # One text of 60,000 entries; searched whole for every entry this would not end within minutes.
    entry = "'<url><loc>https://example.org/a-longer-path/of-some-page</loc></url>'"
    texts = spark.range(1).selectExpr("'p.xml' AS file", f"concat('<urlset>', repeat({entry}, 60000), '</urlset>') AS text")
    began = time.monotonic()
    assert landed.file_entries(texts).where("kind = 'page'").count() == 60000
    assert time.monotonic() - began < 60
    # The maps grow in number with the pages, and rows without an id or of one URL stay.
    monkeypatch.setattr(catalog, "SITEMAP_URLS", 10)
    rows = [(i if i % 3 else None, f"https://example.org/{i // 2}?a=<&b={i // 2}") for i in range(95)] + [(99, None)]
    spark.createDataFrame(rows, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(r["loc"] for r in catalog.queries()["sitemap_pages"](spark, str(tmp_path)).collect())
    assert got == sorted(u for _, u in rows if u)
