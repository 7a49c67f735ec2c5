"""The positional inverted index as tables: postings, document stats, meta.

``postings`` has one row for each (term, document): tf, ascending positions and
the document's length, so ranking needs no second join.  Stored postings are
range-partitioned and sorted by (term, doc_id): a term filter then skips row
groups, and a frequent term spreads over files.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.analyze import document_text, tokens
from tessera.functions.porter import stem_vocabulary, stems

#: Columns of a document, in the order of results.
DOC_COLUMNS = ("doc_id", "title", "body", "url", "timestamp", "lang")
#: Words of documents for one range of stored postings: about 100 MB in the memory of a sort.
WORDS_A_RANGE = 1_500_000


@dataclass(frozen=True)
class Index:
    """postings(term, doc_id, tf, positions, dl), doc_stats(doc_id, doc_len).

    ``totals`` (docs, tokens) may hold sums that are already known, by batch.
    """

    postings: DataFrame
    doc_stats: DataFrame
    analyzer: str = "standard"
    totals: DataFrame | None = None

    @property
    def positional(self) -> bool:
        """Whether postings hold positions."""
        return "positions" in self.postings.columns

    @property
    def stats(self) -> DataFrame:
        """One row: n_docs (at least 1) and avgdl."""
        rows = self.totals
        if rows is None:
            rows = self.doc_stats.agg(F.count("*").alias("docs"), F.sum("doc_len").alias("tokens"))
        docs, words = F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))
        return rows.agg(
            F.greatest(docs, F.lit(1)).alias("n_docs"), (words / F.greatest(docs, F.lit(1))).cast("double").alias("avgdl")
        )

    def doc_freq(self, terms: list[str] | None = None) -> DataFrame:
        """(term, df): postings hold one row a document, so rows are counted."""
        rows = self.postings if terms is None else self.postings.where(F.col("term").isin(*terms) if terms else F.lit(False))
        return rows.groupBy("term").agg(F.count("*").alias("df"))


def analyzed(docs: DataFrame, analyzer: str = "standard") -> DataFrame:
    """(doc_id, tokens) of documents with title and body."""
    base = "standard" if analyzer == "english" else analyzer
    return docs.select("doc_id", tokens(document_text(F.col("title"), F.col("body")), base).alias("tokens"))


def token_positions(docs: DataFrame, analyzer: str = "standard") -> DataFrame:
    """(doc_id, pos, term, dl): one row for each kept token; positions ignore what was dropped."""
    each = _exploded(docs, "standard" if analyzer == "english" else analyzer)
    if analyzer != "english":
        return each
    # Each distinct word is stemmed once, whatever its number of occurrences.
    stems = stem_vocabulary(each.select(F.col("term").alias("word")).distinct())
    return each.join(stems, F.col("term") == F.col("word")).select("doc_id", "dl", "pos", F.col("stem").alias("term"))


def _exploded(docs: DataFrame, analyzer: str) -> DataFrame:
    # An inner generator would make the optimizer analyze every text a second time, to drop empty arrays first.
    each = analyzed(docs, analyzer).select("doc_id", F.size("tokens").alias("dl"), F.posexplode_outer("tokens").alias("pos", "term"))
    return each.where(F.col("term").isNotNull())


def build_index(docs: DataFrame, analyzer: str = "standard", unique: bool = True) -> Index:
    """Index documents; ``unique`` tells that no two of them share an id (see :func:`first_of_each`, :func:`ids_repeat`)."""
    return Index(build_postings(docs, analyzer, unique), build_doc_stats(docs, analyzer), analyzer)


def ids_repeat(docs: DataFrame) -> bool:
    """Whether two documents share an id; only ids are read."""
    return docs.groupBy("doc_id").count().where(F.col("count") > 1).limit(1).count() > 0


def forward(docs: DataFrame, analyzer: str = "standard") -> DataFrame:
    """(doc_id, dl, words): one row a document, words an array of (term, positions) by term.

    A document is taken apart and its words grouped inside its own row: its tokens are sorted with
    their positions, and each run of one word is cut out.  No token crosses the network, and a task
    holds one document at a time, whatever the size of its partition.  Texts are dealt once, so that
    a file that cannot be split does not bind one task.
    """
    dealt = docs.select("doc_id", "title", "body").repartition("doc_id")
    own = analyzed(dealt, analyzer)
    if analyzer == "english":
        own = own.select("doc_id", stems(F.col("tokens")).alias("tokens"))
    # Each step is a column of its own: inside a lambda an expression would be evaluated again for every element.
    pairs = F.transform("tokens", lambda t, i: F.struct(t.alias("term"), i.alias("pos")))
    each = own.select("doc_id", F.size("tokens").alias("dl"), F.sort_array(pairs).alias("each"))
    upto = lambda first, end: F.when(first < end, F.sequence(first, end - 1)).otherwise(F.array().cast("array<int>"))
    begins = lambda i: (i == 0) | (F.get("each", i)["term"] != F.get("each", i - 1)["term"])
    runs = each.select("doc_id", "dl", "each", F.filter(upto(F.lit(0), F.col("dl")), begins).alias("starts"))
    # By places: slice would copy the whole array for every run.
    run = lambda s, k: F.transform(upto(s, F.coalesce(F.get("starts", k + 1), F.col("dl"))), lambda i: F.get("each", i)["pos"])
    words = F.transform("starts", lambda s, k: F.struct(F.get("each", s)["term"].alias("term"), run(s, k).alias("positions")))
    return runs.select("doc_id", "dl", words.alias("words"))


def forward_postings(rows: DataFrame, unique: bool = True) -> DataFrame:
    """The postings of :func:`forward` rows; those of one id are merged where ids are not ``unique``."""
    # An inner generator would make the optimizer build every row a second time, to drop empty arrays first.
    each = rows.select("doc_id", "dl", F.explode_outer("words").alias("w")).where(F.col("w").isNotNull())
    each = each.select("w.term", "doc_id", F.size("w.positions").alias("tf"), "w.positions", "dl")
    if unique:
        return each
    merged = each.groupBy("term", "doc_id").agg(
        F.sum("tf").cast("int").alias("tf"), F.sort_array(F.flatten(F.collect_list("positions"))).alias("positions"), F.max("dl").alias("dl")
    )
    return merged.select("term", "doc_id", "tf", "positions", "dl")


def build_postings(docs: DataFrame, analyzer: str = "standard", unique: bool = True) -> DataFrame:
    """One row for each (term, document)."""
    return forward_postings(forward(docs, analyzer), unique)


def build_doc_stats(docs: DataFrame, analyzer: str = "standard") -> DataFrame:
    """Lengths of all documents; those without a token count as well."""
    return analyzed(docs, analyzer).select("doc_id", F.size("tokens").alias("doc_len"))


def first_of_each(docs: DataFrame, seq: str = "ingest_seq") -> DataFrame:
    """The first document of each doc_id by arrival order."""
    turn = Window.partitionBy("doc_id").orderBy(seq)
    return docs.withColumn("_turn", F.row_number().over(turn)).where("_turn = 1").drop("_turn")


def fresh_only(docs: DataFrame, known: DataFrame) -> DataFrame:
    """Documents whose doc_id is not in ``known`` yet.

    Known ids are hashed, so that no task sorts the texts of its partition.
    """
    return docs.join(known.select("doc_id").distinct().hint("shuffle_hash"), "doc_id", "left_anti")


def updated_index(index: Index, batch: DataFrame, unique: bool = True) -> Index:
    """``index`` and what ``batch`` adds to it; equal to building both at once."""
    fresh = fresh_only(batch, index.doc_stats)
    return Index(
        index.postings.unionByName(build_postings(fresh, index.analyzer, unique)),
        index.doc_stats.unionByName(build_doc_stats(fresh, index.analyzer)),
        index.analyzer,
    )


def clustered(postings: DataFrame, words: int) -> DataFrame:
    """Postings laid out for storage: ranges of (term, doc_id), sorted.

    ``words`` is the length of all documents together: ranges are as many as it asks for, so a
    range is sorted in memory at any size of the corpus.
    """
    ranges = -(-words // WORDS_A_RANGE) or 1
    return postings.repartitionByRange(ranges, "term", "doc_id").sortWithinPartitions("term", "doc_id")
