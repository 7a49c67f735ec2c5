"""Readers of landed files: source config, sitemaps, CDX lines, feeds."""

from __future__ import annotations

import gzip

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import html, times, urls

SOURCE = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("enabled", T.BooleanType()),
        T.StructField("doc_prefix", T.StringType()),
        T.StructField("title_prefix", T.StringType()),
        T.StructField("limit", T.IntegerType()),
        T.StructField("interval_s", T.IntegerType()),
    ]
)
CONFIG = T.StructType(
    [
        T.StructField("default_limit", T.IntegerType()),
        T.StructField("default_interval_s", T.IntegerType()),
        T.StructField("sources", T.ArrayType(SOURCE)),
    ]
)
CDX = T.StructType(
    [
        T.StructField("url", T.StringType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("mime", T.StringType()),
        T.StructField("urlkey", T.StringType()),
    ]
)
MOST_SITEMAP_DEPTH = 5


def read_sources(spark: SparkSession, path: str) -> DataFrame:
    """One row for each configured source, with the file's defaults."""
    raw = spark.read.schema(CONFIG).option("multiLine", True).json(path)
    each = raw.select("default_limit", "default_interval_s", F.explode("sources").alias("s"))
    return each.select("default_limit", "default_interval_s", "s.*").withColumn("enabled", F.coalesce("enabled", F.lit(True)))


@F.pandas_udf(T.StringType())
def _xml_text(content: pd.Series) -> pd.Series:
    """Text of XML bytes, unpacked where they begin as gzip does; bad archives give null."""

    def one(raw):
        try:
            return (gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw).decode("utf-8", "replace")
        except (OSError, EOFError):
            return None

    return content.map(one)


def sitemap_entries(text: Column) -> Column:
    """Array of (kind, loc, lastmod): kind is ``page`` or ``map``; anything else is empty.

    Works on the text, so namespaces and broken tails do not matter.
    """
    # The kind is told once a text; inside the lambda the whole text would be searched again for every entry.
    is_map, is_page = (text.rlike(rf"(?is)<(?:\w+:)?{tag}\b") for tag in ("sitemapindex", "urlset"))
    blocks = F.filter(F.split(text, r"(?i)</(?:\w+:)?(?:url|sitemap)\s*>"), lambda b: b.rlike(r"(?i)<(?:\w+:)?loc\b"))
    pick = lambda b, tag: F.trim(html._decoded(F.regexp_extract(b, rf"(?is)<(?:\w+:)?{tag}\b[^>]*>\s*(.*?)\s*</(?:\w+:)?{tag}\s*>", 1)))

    def rows(kind: str) -> Column:
        found = F.transform(
            blocks, lambda b: F.struct(F.lit(kind).alias("kind"), pick(b, "loc").alias("loc"), F.nullif(pick(b, "lastmod"), F.lit("")).alias("lastmod"))
        )
        return F.filter(found, lambda r: r["loc"] != "")

    return F.when(is_map, rows("map")).when(is_page, rows("page")).otherwise(F.array().cast("array<struct<kind:string,loc:string,lastmod:string>>"))


def read_sitemap_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, kind, loc, lastmod) of landed sitemap files, packed or not.

    ``file`` is the place below ``path``: ``name.xml``, or ``host/a/name.xml`` where files
    were landed under host and path, so maps of one name do not clash.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    root = F.lit("/" + path.split("://")[-1].strip("/") + "/")
    below = F.substring("path", F.instr("path", root) + F.length(root), F.length("path"))
    name = F.when(F.contains("path", root), below).otherwise(F.element_at(F.split("path", "/"), -1))
    texts = files.select(name.alias("file"), _xml_text("content").alias("text"))
    return file_entries(texts)


def file_entries(texts: DataFrame) -> DataFrame:
    """(file, kind, loc, lastmod) of sitemap texts (file, text)."""
    # An inner generator would make the optimizer parse every text a second time, to drop empty arrays first.
    each = texts.select("file", F.explode_outer(sitemap_entries(F.coalesce("text", F.lit("")))).alias("e"))
    return each.where(F.col("e").isNotNull()).select("file", "e.*")


def sitemap_urls(entries: DataFrame, root: str, most: int | None = None) -> DataFrame:
    """(loc, lastmod) below ``root``; each of at most six levels is one join of maps, pages are joined once.

    ``entries`` are (file, kind, loc, lastmod), best a stored table: every level reads its maps again.
    A child map is known by its whole address without the scheme, where files were landed under
    host and path, else by its file name.
    """
    names = F.array(F.regexp_replace("loc", "^[A-Za-z][A-Za-z0-9+.-]*://", ""), F.element_at(F.split("loc", "/"), -1))
    children = entries.where("kind = 'map'").select("file", F.explode(names).alias("child")).distinct()
    level = entries.sparkSession.createDataFrame([(root,)], "file string")
    reached = level
    for _ in range(MOST_SITEMAP_DEPTH):
        level = children.join(level, "file").select(F.col("child").alias("file")).distinct()
        reached = reached.unionByName(level)
    found = entries.where("kind = 'page'").join(reached, "file").select("loc", "lastmod")
    return found if most is None else found.limit(most)


def read_cdx(spark: SparkSession, path: str, match: str = "domain", value: str | None = None, most: int | None = None,
             start: str | None = None, end: str | None = None) -> DataFrame:
    """Captures that were fine HTML pages, one for each urlkey.

    ``match``: ``domain`` (host or a subdomain), ``prefix`` (of the URL) or
    ``tld`` (any host under it).
    """
    rows = spark.read.schema(CDX).json(path).where("url IS NOT NULL")
    host = F.regexp_replace(urls.host(F.col("url")), r":\d+$", "")
    fits = {
        "domain": lambda v: (host == v) | host.endswith(f".{v}"),
        "prefix": lambda v: F.col("url").startswith(v),
        "tld": lambda v: host.endswith(f".{v.lstrip('*.')}"),
    }
    kept = rows.where((F.col("status") == "200") & (F.col("mime") == "text/html"))
    kept = kept if value is None else kept.where(fits[match](value))
    kept = kept if start is None else kept.where(F.col("timestamp") >= start)
    kept = kept if end is None else kept.where(F.col("timestamp") <= end)
    once = kept.withColumn("urlkey", F.coalesce("urlkey", "url")).groupBy("urlkey").agg(
        F.min(F.struct("timestamp", "url", "status", "mime")).alias("r")
    )
    out = once.select("r.url", "r.timestamp", F.col("r.status").cast("int").alias("status"), "r.mime")
    return out if most is None else out.limit(most)


def feed_documents(feeds: DataFrame) -> DataFrame:
    """Documents of landed feeds (src_id, xml, limit, lang, title_prefix), RSS or Atom."""
    tag = lambda b, names: F.regexp_extract(b, rf"(?is)<(?:{names})\b[^>]*>(.*?)</(?:{names})\s*>", 1)
    plain = lambda c: F.trim(F.regexp_replace(c, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1"))
    first = lambda b, *names: F.coalesce(*[F.nullif(plain(tag(b, n)), F.lit("")) for n in names], F.lit(""))
    entries = F.filter(F.regexp_extract_all("xml", F.lit(r"(?is)<(?:item|entry)\b[^>]*>.*?</(?:item|entry)\s*>"), F.lit(0)), lambda e: e != "")
    each = feeds.select("src_id", "lang", "title_prefix", F.posexplode(F.slice(entries, F.lit(1), F.col("limit"))).alias("seq", "e"))
    e = F.col("e")
    link = F.coalesce(F.nullif(plain(tag(e, "link")), F.lit("")), F.regexp_extract(e, r"(?is)<link\b[^>]*\bhref=[\"']([^\"']*)", 1))
    body = first(e, "content:encoded", "content", "description", "summary")
    return each.select(
        urls.url_doc_id(html._decoded(link)).alias("doc_id"),
        html.prefixed_title(html.html_text(html._decoded(first(e, "title"))), F.col("title_prefix")).alias("title"),
        html.html_text(html._decoded(body)).alias("body"),
        html._decoded(link).alias("url"),
        times.iso_utc(first(e, "pubDate", "published", "dc:date", "updated")).alias("timestamp"),
        F.coalesce("lang", F.lit("en")).alias("lang"),
        "src_id",
        "seq",
    )
