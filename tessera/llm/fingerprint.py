"""Document fingerprints: canonical exact digests with byte comparison.

Canonical form: NFKC normalisation and full case folding (both by the ICU
library on the Spark class path), then every run of white space becomes one
blank and outer blanks go.  The digest is two xxhash64 values with different
seeds, 128 bits in hex.  Documents are grouped by digest and the canonical bytes
inside each bucket of several are compared; edited texts, which are no documents,
are held against all others of their digest by the SHA-256 of the canonical text.
Where a bucket holds different texts, the digest of each is extended by that
SHA-256, so equal fingerprints mean equal canonical texts.

Defined results: a null text counts as empty; empty texts share one digest;
repeated rows keep one row each; rows of one ``doc_id`` follow each other by a hash of
the text, then by the text; a null ``doc_id`` sorts first; columns other than
``doc_id`` and ``text`` are ignored by the query.
"""

from __future__ import annotations

import bisect

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialize, shuffle_partitions

_SEED_WORD = "tessera-fingerprint"
#: Range buckets per shuffle partition when neighbours in doc_id order are paired.
BUCKETS_PER_PARTITION = 8
#: Ids of documents that share a digest are broadcast up to this many, else joined by shuffle.
MOST_BROADCAST_IDS = 300_000
#: Collided digests are broadcast up to this many (32 bytes each), else joined by shuffle.
MOST_BROADCAST_DIGESTS = 100_000


def canonical(text: Column) -> Column:
    """NFKC, case-folded, white space folded.  ASCII texts skip the ICU calls."""
    text = F.coalesce(text, F.lit(""))
    plain = F.octet_length(text) == F.char_length(text)
    composed = F.reflect(
        F.lit("com.ibm.icu.lang.UCharacter"),
        F.lit("foldCase"),
        F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(True)),
        F.lit(True),
    )
    # Folding can leave sequences that compose again; a second pass makes it stable.
    folded = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), composed, F.lit(True))
    cased = F.when(plain, F.lower(text)).otherwise(folded)
    return F.trim(F.regexp_replace(cased, r"[\s\p{Z}]+", " "))


def digest(canon: Column) -> Column:
    """128-bit digest of a canonical text, as 32 hex digits."""
    wide = lambda c: F.lpad(F.lower(F.hex(c)), 16, "0")
    return F.concat(wide(F.xxhash64(canon)), wide(F.xxhash64(F.lit(_SEED_WORD), canon)))


def collided_digests(canon: DataFrame) -> DataFrame:
    """Digests whose bucket holds different bytes; ``canon`` has (digest, canon).

    Equal rows fold before the exchange, so a bucket of many copies costs one row
    per task.
    """
    seen = canon.groupBy("digest").agg(F.min("canon").alias("least"), F.max("canon").alias("most"))
    return seen.where(F.col("least") != F.col("most")).select("digest")


def fingerprint_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``fingerprint`` to ``docs``; equal canonical texts, and only they, share one."""
    # Canonical text stands in a projection of its own: ICU calls are not deterministic to
    # the optimizer, so they are neither merged nor repeated there.
    held = docs.select(F.struct("*").alias("_row"), canonical(F.col(text)).alias("_canon"))
    held = held.select("_row", "_canon", digest(F.col("_canon")).alias("_digest"))
    bad = _bad_table(held.select(F.col("_digest").alias("digest"), F.col("_canon").alias("canon")))
    told = _resolve(held.withColumn("_sha", F.unhex(F.sha2("_canon", 256))), bad, {"_digest": ("fingerprint", "_sha")})
    return told.select(*[F.col("_row")[c].alias(c) for c in docs.columns if c != "fingerprint"], "fingerprint")


def _bad_table(canon: DataFrame) -> tuple[DataFrame, int]:
    """The collided digests, written once, and how many there are (none, in practice)."""
    bad = materialize(collided_digests(canon), "collided")
    return bad, bad.count()


def _resolve(df: DataFrame, bad: tuple[DataFrame, int], names: dict[str, tuple[str, str]]) -> DataFrame:
    """Turn digest columns into fingerprints: {digest column: (fingerprint, SHA column)}."""
    found, n = bad
    for name, (out, sha) in names.items():
        if not n:
            df = df.withColumnRenamed(name, out)
            continue
        side = found.select(F.col("digest").alias("_bad"))
        side = F.broadcast(side) if n <= MOST_BROADCAST_DIGESTS else side
        df = df.join(side, F.col(name) == F.col("_bad"), "left")
        told = F.when(F.col("_bad").isNull(), F.col(name)).otherwise(F.concat_ws("-", name, F.lower(F.hex(sha))))
        df = df.withColumn(out, told).drop("_bad", name)
    return df


def _bucketed(rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """``rows`` (doc_id, text) with ``_bucket``, in document order, and the first row of each bucket for the one before.

    Borders are doc_ids that a range exchange of the ids alone finds.  An id, null included,
    that would fill a bucket by itself gets buckets of its own, by ranges of the hash
    that orders its rows.  Borders are compared as doubles, which keeps the order of
    longs and only puts neighbours together; first rows are found by exact ids.
    """
    spark = rows.sparkSession
    n = BUCKETS_PER_PARTITION * shuffle_partitions(spark)
    ids = rows.select("doc_id")
    cuts = ids.where(F.col("doc_id").isNotNull()).repartitionByRange(n, "doc_id").groupBy(F.spark_partition_id().alias("p"))
    # One row for each range: at most n rows on the driver, whatever the input.
    told = cuts.agg(F.min("doc_id").alias("low"), F.count("*").alias("rows")).collect()
    total = sum(r["rows"] for r in told)
    most = max(1, total // n) * 4
    # Ids with so many rows are n / 4 at most, and the null one.
    hot = {r["doc_id"]: r["count"] for r in ids.groupBy("doc_id").count().where(F.col("count") > most).collect()}
    inner = sorted({float(r["low"]) for r in told})[1:]
    splits = [float("-inf"), *inner, float("inf")] if inner else [float("-inf"), 0.0, float("inf")]
    keyed = rows.withColumn("_h", F.xxhash64("text")).withColumn("_key", F.coalesce(F.col("doc_id").cast("double"), F.lit(float("-inf"))))
    cut = Bucketizer(splits=splits, inputCol="_key", outputCol="_cut").transform(keyed)
    part = F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(F.col("_cut").cast("int"))
    cut = cut.withColumn("_part", part)
    # Rows of a range fall before, into or behind its hot ids.
    by_cut: dict[int, list] = {}
    for one in sorted(k for k in hot if k is not None):
        by_cut.setdefault(bisect.bisect_right(splits, float(one)) - 1, []).append((one, max(1, hot[one] // most)))
    held = spark.createDataFrame(list(by_cut.items()), "_at int, _hot array<struct<id: long, width: long>>")
    cut = cut.join(F.broadcast(held), F.col("_part") == F.col("_at"), "left").drop("_at")  # n / 4 ids at most
    upto = lambda fits: F.coalesce(F.size(F.filter("_hot", fits)), F.lit(0))
    place = F.when(F.col("_hot").isNull(), 0).otherwise(upto(lambda h: h["id"] <= F.col("doc_id")) + upto(lambda h: h["id"] < F.col("doc_id")))
    wide = F.try_element_at(F.filter("_hot", lambda h: h["id"] == F.col("doc_id")), F.lit(1))["width"]
    if None in hot:
        wide = F.when(F.col("doc_id").isNull(), F.lit(max(1, hot[None] // most))).otherwise(wide)
    own = wide.isNotNull()
    leading = F.shiftrightunsigned(F.col("_h"), 33).bitwiseXOR(F.lit(1 << 30))
    piece = F.floor(leading * F.coalesce(wide, F.lit(1)) / (1 << 31))
    part = F.col("_part")
    out = cut.withColumn("_bucket", F.struct(part.alias("cut"), place.cast("long").alias("place"), piece.cast("long").alias("piece"))).withColumn("_own", own)
    # Without hot ids no text is read here.
    least = F.min(F.when(F.col("_own"), F.col("_h"))) if hot else F.lit(None).cast("long")
    firsts = out.groupBy("_bucket").agg(F.min("doc_id").alias("id"), least.alias("h")).collect()
    heads = sorted((tuple(r["_bucket"]), r["id"], r["h"]) for r in firsts)
    slim = out.select("doc_id", "text", "_h", "_bucket")
    if not heads:
        return slim, None
    turn = spark.createDataFrame(
        [(b, i, h, heads[k - 1][0]) for k, (b, i, h) in enumerate(heads)],
        "_at struct<cut int, place long, piece long>, _id long, _least long, _to struct<cut int, place long, piece long>",
    )
    same = (F.col("_bucket") == F.col("_at")) & F.col("doc_id").eqNullSafe(F.col("_id")) & ((F.col("_h") == F.col("_least")) | F.col("_least").isNull())
    first = F.min_by("text", F.struct("_h", "text"))
    return slim, slim.join(F.broadcast(turn), same).groupBy("_to").agg(first.alias("text"))


def with_next_text(docs: DataFrame, marks=()) -> DataFrame:
    """(doc_id, text, next_text) with the neighbour in ascending doc_id, cyclic.

    Every bucket carries its texts once and gets a copy of the first row of the bucket
    that follows, so the window never spans the whole table.  ``marks`` are functions
    that add columns to a (text) row; each comes with a ``next_`` twin.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    slim, guests = _bucketed(rows)
    held = slim.select("doc_id", "text", "_h", "_bucket", F.lit(0).alias("_guest"))
    if guests is not None:
        none = F.lit(None).cast("long")
        held = held.unionByName(guests.select(none.alias("doc_id"), "text", none.alias("_h"), F.col("_to").alias("_bucket"), F.lit(1).alias("_guest")))
    for mark in marks:
        held = mark(held)
    told = [c for c in held.columns if c not in ("doc_id", "_h", "_bucket", "_guest")]
    order = Window.partitionBy("_bucket").orderBy("_guest", F.col("doc_id").asc_nulls_first(), "_h", "text")
    out = held.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in told])
    return out.where(F.col("_guest") == 0).select("doc_id", *told, *[f"next_{c}" for c in told])


def _marked(rows: DataFrame) -> DataFrame:
    """Digest and SHA-256 of each canonical text, which is made once."""
    canon = rows.select("*", canonical(F.col("text")).alias("_canon"))
    return canon.select(*rows.columns, digest(F.col("_canon")).alias("own"), F.unhex(F.sha2("_canon", 256)).alias("own_sha"))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """The digest report: fingerprints of each text, of its edited text, and their likeness.

    An exact digest is either equal or not, so likeness is 1.0 or 0.0.
    """
    half = F.floor(F.col("n_chars") / 2).cast("int")
    paired = with_next_text(docs, (_marked,)).withColumn("n_chars", F.char_length("text").cast("long"))
    text = F.concat(
        F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - half).cast("int")),
        F.substring(F.col("next_text"), F.lit(1), half),
    )
    edited = paired.select("doc_id", "n_chars", "own", "own_sha", "next_own", "next_own_sha", text.alias("_edited"))
    edited = edited.select("*", canonical(F.col("_edited")).alias("_canon"))
    slim = edited.select(
        "doc_id", "n_chars", F.sha2("_edited", 256).alias("edited_sha256"), "own", "own_sha",
        digest(F.col("_canon")).alias("new"), F.unhex(F.sha2("_canon", 256)).alias("new_sha"),
        ((F.col("own") == F.col("next_own")) & (F.col("own_sha") == F.col("next_own_sha"))).cast("double").alias("near_next"),
    )
    slim = materialize(slim, "digests")
    # By SHA-256 over all texts, and by the bytes of the documents whose digest is not alone.
    every = slim.select(F.col("own").alias("digest"), F.col("own_sha").alias("canon")).unionByName(
        slim.select(F.col("new").alias("digest"), F.col("new_sha").alias("canon"))
    )
    several = slim.groupBy(F.col("own").alias("digest")).count().where(F.col("count") > 1).select("digest")
    named = materialize(slim.join(several, F.col("own") == F.col("digest"), "left_semi").select("doc_id").distinct(), "several")
    few = F.broadcast(named) if named.count() <= MOST_BROADCAST_IDS else named
    again = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").alias("d").join(
        few.alias("s"), F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")), "left_semi"
    )
    canon = again.select(canonical(F.col("text")).alias("canon"))
    found = collided_digests(every).unionByName(collided_digests(canon.select(digest(F.col("canon")).alias("digest"), "canon")))
    bad = materialize(found.distinct(), "collided")
    near = ((F.col("own") == F.col("new")) & (F.col("own_sha") == F.col("new_sha"))).cast("double")
    told = _resolve(slim.withColumn("near_edited", near), (bad, bad.count()), {"own": ("fingerprint", "own_sha"), "new": ("edited_fingerprint", "new_sha")})
    return told.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"
    )
