"""Registered queries of the corpus operators, and their DuckDB SQL."""

from __future__ import annotations

import corpus_pipeline
from tessera.llm import decontaminate, fingerprint, langid, mixing, quality, repeats, setjoin, sharding, toxicity, urlrules
from tessera.llm.common import table


def op1_url_rules(spark, sf_dir):
    return urlrules.judge_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op2_decontaminate(spark, sf_dir):
    return decontaminate.decontamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_language(spark, sf_dir):
    return langid.language_report(table(spark, sf_dir, "documents"))


def op4_repeats(spark, sf_dir):
    return repeats.repeated_bytes(table(spark, sf_dir, "documents"))


def op5_toxicity(spark, sf_dir):
    return toxicity.toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_fingerprint(spark, sf_dir):
    return fingerprint.edited_fingerprints(table(spark, sf_dir, "documents"))


def op7_shard(spark, sf_dir):
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op8_mixing(spark, sf_dir):
    return mixing.mixing_report(table(spark, sf_dir, "documents"))


def op9_quality(spark, sf_dir):
    return quality.quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_jaccard_join(spark, sf_dir):
    return setjoin.jaccard_components(table(spark, sf_dir, "documents"))


_QUERIES = (
    op1_url_rules,
    op2_decontaminate,
    op3_language,
    op4_repeats,
    op5_toxicity,
    op6_fingerprint,
    op7_shard,
    op8_mixing,
    op9_quality,
    op10_jaccard_join,
)


def queries() -> dict:
    return {f.__name__: f for f in _QUERIES} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict:
    return {"op2_decontaminate": decontaminate.ORACLE}
