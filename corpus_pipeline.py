"""Corpus pipeline: toxicity, near duplicates, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each
result as Parquet to the shared folder and reads it back as the next stage's
``docs``.  All stages but the last return the columns they got.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, mixing, setjoin, sharding, toxicity
from tessera.llm.common import materialize, small_batches, table

#: Number of shards that the last stage deals the corpus into.
SHARDS = 40
#: Share of the greatest entropy over sources that the mix is to reach.
MIX_ENTROPY = 0.9


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under the threshold, whole."""
    small_batches(spark)
    lexicon = toxicity.learn(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, lexicon)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that the n-gram Jaccard join links: the least doc_id.

    The rule is the general one of five words and 0.8; three words and 0.9 bind op10 only.
    Documents without words, and rows without doc_id, link with nothing and stay.  Where
    rows share a doc_id, a row is judged by its id and text: different texts of one id
    are different documents, and of equal rows one stays.
    """
    named = docs.where(F.col("doc_id").isNotNull())
    if named.groupBy("doc_id").count().where(F.col("count") > 1).limit(1).count():
        rows = named.select(F.struct("*").alias("row"), "doc_id", "text").dropDuplicates(["doc_id", "text"])
        turn = rows.orderBy("doc_id", F.xxhash64("text"), "text").select("row", F.monotonically_increasing_id().alias("rid"))
        rows = materialize(turn, "rows")
        kept = _first_of_groups(rows.select(F.col("rid").alias("doc_id"), F.col("row.text").alias("text")))
        held = rows.join(kept.withColumnRenamed("doc_id", "rid"), "rid", "left_semi")
        held = held.select(*[F.col("row")[c].alias(c) for c in docs.columns])
    else:
        held = named.join(_first_of_groups(named), "doc_id", "left_semi").select(*docs.columns)
    return held.unionByName(docs.where(F.col("doc_id").isNull()))


def _first_of_groups(docs: DataFrame) -> DataFrame:
    """(doc_id) of the least document of each linked group."""
    found = setjoin.jaccard_components(docs, setjoin.GENERAL)
    return materialize(found.where(F.col("component_id") == F.col("doc_id")).select("doc_id").distinct(), "kept")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs."""
    hits = decontaminate.contaminated_keys(docs, table(spark, sf_dir, "benchmark"))
    return decontaminate.without(docs, hits)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the tempered mix of sources, each as often as it takes a turn.

    The budget is the least that keeps every document: the fullest source is
    passed over once, and thin ones repeat until the weights are met.
    """
    return mixing.mixed_copies(docs, budget=mixing.WHOLE, target=MIX_ENTROPY)


def deal_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its shard and its slot in it."""
    return sharding.shard_rows(docs, SHARDS, [F.col("doc_id"), F.col("text")])


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard_join", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", deal_shards),
]

#: The learned scores and the drawn permutations have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over the whole ``documents`` table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
