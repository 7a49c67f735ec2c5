"""Benchmark decontamination over a distributed positional inverted index.

The index holds one row (term, key, pos) for each occurrence of the terms it was
asked to store; ``key`` is a 64-bit hash of the document's id and text.  A phrase is looked up from its rarest terms: the list of the
rarest term gives candidate starts (pos minus the term's offset in the phrase),
the offset-adjusted list of the next rarest thins them, and what is left is
compared with the document's words.  A proximity query joins two lists within a
document by blocks of positions.

Defined results: a null or wordless text has no words and no hits; an item with
fewer words than a window is one window; a null ``doc_id`` is a document like any
other; rows that share a ``doc_id`` are judged each by its own words; repeated
items count once for each ``item_id``; an empty benchmark hits nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import ascii_lower, materialize

#: What separates words after A-Z are lowered.
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
#: Offset-adjusted lists that are intersected before words are compared.
LISTS = 2
#: Test terms and phrases are broadcast up to this many rows, else joined by shuffle.
MOST_BROADCAST_ROWS = 200_000


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BREAK), "")


def windows(items: DataFrame, width: int = WINDOW) -> DataFrame:
    """(item_id, win, terms): the distinct windows of each item; ``win`` names a word sequence."""
    split = items.select("item_id", words(F.col("text")).alias("_w")).where(F.size("_w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("_w") - F.lit(width), F.lit(0)))
    each = split.select("item_id", "_w", F.explode(starts).alias("_i"))
    terms = F.slice(F.col("_w"), F.col("_i") + 1, F.lit(width))
    return each.select("item_id", terms.alias("terms")).withColumn("win", F.concat_ws(" ", "terms")).distinct()


def sized(df: DataFrame, rows: int) -> DataFrame:
    """``df`` for the small side of a join: broadcast only while ``rows`` is within the bound."""
    return F.broadcast(df) if rows <= MOST_BROADCAST_ROWS else df


def occurrences(docs: DataFrame) -> DataFrame:
    """(key, pos, term) of every word of every document; a null term for a document without any.

    An inner generator would make the optimizer split every text a second time, to
    drop empty arrays first; joins on the term drop the nulls.
    """
    return docs.select("key", F.posexplode_outer(words(F.col("text"))).alias("pos", "term"))


def build_index(docs: DataFrame, terms: DataFrame, n_terms: int) -> DataFrame:
    """The stored postings of ``terms``, one row for each occurrence."""
    kept = occurrences(docs).join(sized(terms.select("term"), n_terms), "term", "left_semi")
    return materialize(kept, "postings")


def term_counts(docs: DataFrame, terms: DataFrame, n_terms: int) -> DataFrame:
    """(term, n): occurrences in the corpus of each of ``terms``; 0 where there are none."""
    found = occurrences(docs).join(sized(terms.select("term"), n_terms), "term", "left_semi").groupBy("term").count()
    out = terms.select("term").join(found, "term", "left").select("term", F.coalesce("count", F.lit(0)).alias("n"))
    return materialize(out, "counts")


def phrase_starts(index: DataFrame, lists: DataFrame, n_lists: int) -> DataFrame:
    """(win, key, start) where the rarest terms of a phrase stand as the phrase has them.

    ``lists`` has (win, role, term, offset), role 1 the rarest.
    """
    side = lambda k: sized(lists.where(F.col("role") == k).select("win", "term", "offset"), n_lists)
    at = lambda k: index.join(side(k), "term").select("win", "key", (F.col("pos") - F.col("offset")).alias("start"))
    out = at(1).where(F.col("start") >= 0)
    for k in range(2, LISTS + 1):
        short = lists.groupBy("win").agg(F.max("role").alias("most")).where(F.col("most") < k).select("win")
        whole = out.join(sized(short, n_lists), "win", "left_semi")
        out = out.join(at(k), ["win", "key", "start"], "left_semi").unionByName(whole)
    return out.distinct()


def proximity_matches(index: DataFrame, pairs: DataFrame, distance: int) -> DataFrame:
    """(pair, key, pos_a, pos_b): occurrences of ``term_a`` and ``term_b`` within ``distance`` words.

    Positions fall into blocks of ``distance + 1``; a match lies in one block or
    in neighbours, so the join is on equality throughout.
    """
    wide = distance + 1
    block = F.floor(F.col("pos") / wide)
    left = index.join(pairs.select("pair", F.col("term_a").alias("term")), "term").select(
        "pair", "key", F.col("pos").alias("pos_a"), block.alias("block")
    )
    right = index.join(pairs.select("pair", F.col("term_b").alias("term")), "term").select(
        "pair", "key", F.col("pos").alias("pos_b"), F.explode(F.array(block - 1, block, block + 1)).alias("block")
    )
    near = F.abs(F.col("pos_a") - F.col("pos_b")) <= distance
    return left.join(right, ["pair", "key", "block"]).where(near).select("pair", "key", "pos_a", "pos_b")


def _rarest(wins: DataFrame, counts: DataFrame) -> DataFrame:
    """(win, role, term, offset): the ``LISTS`` rarest positions of each window."""
    each = wins.select("win", F.posexplode("terms").alias("offset", "term")).join(counts, "term")
    order = F.sort_array(F.collect_list(F.struct("n", "offset", "term")))
    best = each.groupBy("win").agg(F.slice(order, 1, LISTS).alias("best"))
    return best.select("win", F.posexplode("best").alias("_k", "_b")).select(
        "win", (F.col("_k") + 1).alias("role"), F.col("_b.term").alias("term"), F.col("_b.offset").alias("offset")
    )


def _covered(hits: str) -> Column:
    """How many positions a sorted array of (start, size) covers."""
    return F.expr(
        f"aggregate({hits}, named_struct('total', 0L, 'upto', 0), (acc, h) -> named_struct("
        "'total', acc.total + cast(greatest(0, h.start + h.size - greatest(acc.upto, h.start)) as bigint), "
        "'upto', greatest(acc.upto, h.start + h.size)), acc -> acc.total)"
    )


def _keyed(docs: DataFrame) -> DataFrame:
    """(row, doc_id, text, key): the caller's columns in one struct, so that none clashes."""
    return docs.select(F.struct("*").alias("row"), "doc_id", "text", F.xxhash64("doc_id", "text").alias("key"))


@dataclass(frozen=True)
class Found:
    """hits (doc_id, key, hits), and the index and lists that they came from."""

    hits: DataFrame
    index: DataFrame
    lists: DataFrame


def window_hits(docs: DataFrame, found: DataFrame) -> Found:
    """The true occurrences in each document that has any.

    ``docs`` has (doc_id, text, key), ``found`` the windows; hits are structs
    (start, size, win) in order.
    """
    wins = materialize(found.select("win", "terms").distinct(), "wins")
    vocabulary = materialize(wins.select(F.explode("terms").alias("term")).distinct(), "terms")
    n_terms = vocabulary.count()
    counts = term_counts(docs, vocabulary, n_terms)
    # A window with a word that the corpus lacks occurs nowhere.
    lists = materialize(_rarest(wins, counts), "lists")
    absent = counts.where(F.col("n") == 0).select("term")
    dead = wins.select("win", F.explode("terms").alias("term")).join(absent, "term", "left_semi").select("win").distinct()
    lists = materialize(lists.join(dead, "win", "left_anti"), "lists")
    n_lists = lists.count()
    index = build_index(docs, lists.select("term").distinct(), min(n_terms, n_lists))
    starts = materialize(phrase_starts(index, lists, n_lists), "starts")
    # A window's name is its words with blanks between, and no word holds a blank.
    named = starts.join(sized(wins, n_lists), "win").groupBy("key").agg(
        F.collect_list(F.struct("start", F.size("terms").alias("size"), "win")).alias("_cand")
    )
    named = materialize(named, "candidates")
    # Words are compared here: each candidate against its own document.
    # Keys alone are broadcast, so only the candidates' texts are exchanged.
    near = docs.join(sized(named.select("key"), named.count()), "key", "left_semi")
    # Words are made below the join, so once a document and not once a candidate.
    own = near.select("doc_id", "key", words(F.col("text")).alias("_words")).join(named, "key")
    true = F.filter("_cand", lambda c: F.array_join(F.slice(F.col("_words"), c["start"] + 1, c["size"]), " ") == c["win"])
    hits = own.select("doc_id", "key", F.sort_array(true).alias("hits")).where(F.size("hits") > 0)
    return Found(materialize(hits.dropDuplicates(["doc_id", "key"]), "hits"), index, lists)


def near_terms(found: Found, width: int = WINDOW) -> DataFrame:
    """(key, n_near): how many windows' pairs of rarest terms stand within a window's width of each other."""
    term = lambda k: found.lists.where(F.col("role") == k).select("win", F.col("term").alias(f"t{k}"))
    both = term(1).join(term(2), "win").where("t1 <> t2").select(F.least("t1", "t2").alias("term_a"), F.greatest("t1", "t2").alias("term_b")).distinct()
    pairs = materialize(both.withColumn("pair", F.concat_ws(" ", "term_a", "term_b")), "near")
    met = proximity_matches(found.index, sized(pairs, pairs.count()), width - 1)
    return materialize(met.select("pair", "key").distinct().groupBy("key").agg(F.count("*").alias("n_near")), "near")


#: What :func:`contamination` adds, in place of columns of these names.
TOLD = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated", "n_near")


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """``docs`` with n_words, n_hit, n_items, items_sha256, contaminated and n_near.

    A document word is hit when it lies in any occurrence of any window.  ``n_near`` counts
    proximity matches: pairs of the two rarest terms of a window that stand within a
    window's width of each other, in either order.
    """
    keyed = _keyed(docs)
    found = materialize(windows(benchmark, width), "windows")
    told = window_hits(keyed.select("doc_id", "text", "key"), found)
    hits, near = told.hits, near_terms(told, width)
    items = found.groupBy("win").agg(F.collect_set("item_id").alias("items"))
    per_doc = (
        hits.select("doc_id", "key", F.explode(F.array_distinct(F.transform("hits", lambda h: h["win"]))).alias("win"))
        .join(sized(items, found.count()), "win")
        .groupBy("doc_id", "key")
        .agg(F.array_distinct(F.flatten(F.collect_set("items"))).alias("_ids"))
    )
    same = lambda x: (F.col("h.key") == F.col(f"{x}.key")) & F.col("h.doc_id").eqNullSafe(F.col(f"{x}.doc_id"))
    told = hits.alias("h").join(per_doc.alias("p"), same("p")).select(
        F.col("h.doc_id").alias("doc_id"),
        F.col("h.key").alias("key"),
        _covered("hits").alias("n_hit"),
        F.size("_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.sort_array(F.transform("_ids", lambda i: i.cast("string"))), ","), 256).alias("items_sha256"),
    )
    told = materialize(told, "told")
    all_docs = keyed.withColumn("n_words", F.size(words(F.col("text"))).cast("long"))
    out = all_docs.alias("d").join(sized(told, told.count()).alias("h"), same("d"), "left")
    out = out.join(sized(near, near.count()).alias("n"), F.col("d.key") == F.col("n.key"), "left")
    return out.select(
        *[F.col("d.row")[c].alias(c) for c in docs.columns if c not in TOLD],
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        F.col("h.key").isNotNull().alias("contaminated"),
        F.coalesce("n.n_near", F.lit(0).cast("long")).alias("n_near"),
    )


def contaminated_keys(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """(doc_id, key) of the documents with any true occurrence."""
    found = materialize(windows(benchmark, width), "windows")
    return window_hits(_keyed(docs.select("doc_id", "text")), found).hits.select("doc_id", "key")


def without(docs: DataFrame, hits: DataFrame) -> DataFrame:
    """``docs`` but for the rows that ``hits`` (doc_id, key) names."""
    bad = sized(hits.select("doc_id", "key"), hits.count()).alias("bad")
    same = (F.col("d.key") == F.col("bad.key")) & F.col("d.doc_id").eqNullSafe(F.col("bad.doc_id"))
    kept = _keyed(docs).alias("d").join(bad, same, "left_anti")
    return kept.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def decontamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The digest report: one row for each document."""
    told = contamination(docs.select("doc_id", "text"), benchmark.select("item_id", "text"))
    return told.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "n_near")


ORACLE = """
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i + 1 : i + 10], ' ') AS win
  FROM (SELECT item_id, w, unnest(generate_series(0, greatest(len(w) - 10, 0))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (
  SELECT doc_id, i, size, array_to_string(w[i + 1 : i + size], ' ') AS win
  FROM (SELECT doc_id, w, size, unnest(generate_series(0, len(w) - size)) AS i FROM d, sizes WHERE len(w) >= size)),
hits AS (SELECT doc_id, i, dw.size, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.size = bw.size),
n_hit AS (
  SELECT doc_id, count(*) AS n_hit FROM (
    SELECT DISTINCT doc_id, unnest(generate_series(i, i + size - 1)) AS p FROM (SELECT DISTINCT doc_id, i, size FROM hits)) GROUP BY doc_id),
found AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS sha
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id),
tc AS (SELECT term, count(*) AS n FROM (SELECT unnest(w) AS term FROM d) GROUP BY term),
wt AS (
  SELECT win, CAST(generate_subscripts(t, 1) - 1 AS INTEGER) AS o, unnest(t) AS term
  FROM (SELECT DISTINCT win, string_split(win, ' ') AS t FROM bw)),
live AS (SELECT win FROM wt LEFT JOIN tc USING (term) GROUP BY win HAVING bool_and(n IS NOT NULL)),
rare AS (
  SELECT win, term, row_number() OVER (PARTITION BY win ORDER BY n, o, term) AS k
  FROM wt JOIN tc USING (term) SEMI JOIN live USING (win) QUALIFY k <= 2),
near_pairs AS (
  SELECT DISTINCT least(a.term, b.term) AS ta, greatest(a.term, b.term) AS tb
  FROM rare a JOIN rare b ON a.win = b.win AND a.k = 1 AND b.k = 2 WHERE a.term <> b.term),
places AS (
  SELECT doc_id, p, term FROM (SELECT doc_id, CAST(generate_subscripts(w, 1) AS INTEGER) AS p, unnest(w) AS term FROM d)
  WHERE term IN (SELECT term FROM rare)),
near AS (
  SELECT doc_id, count(*) AS n_near FROM (
    SELECT DISTINCT x.doc_id, ta, tb FROM near_pairs JOIN places x ON x.term = ta
    JOIN places y ON y.doc_id = x.doc_id AND y.term = tb AND abs(x.p - y.p) <= 9) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(sha, sha256('')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near
FROM d LEFT JOIN n_hit USING (doc_id) LEFT JOIN found USING (doc_id) LEFT JOIN near USING (doc_id)
"""
