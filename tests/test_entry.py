"""The driver contract: registered queries agree with their DuckDB SQL on the smallest tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

import __spark_entry__
from tessera.plans import catalog

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{name}'")
    return con


def _plain(value):
    return float(f"{value:.9g}") if isinstance(value, float) and not math.isnan(value) else value


def _rows(columns, rows):
    at = [columns.index(c) for c in sorted(columns)]
    return sorted((tuple(_plain(r[i]) for i in at) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_sql(spark, tables, name):
    frame = __spark_entry__.queries()[name](spark, FOLDER)
    told = tables.sql(__spark_entry__.oracle_sql()[name])
    assert sorted(frame.columns) == sorted(told.columns)
    assert _rows(frame.columns, frame.collect()) == _rows(told.columns, told.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["rank", "doc_id", "score"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_whole_batch_reads_past_two_words(spark, tmp_path):
    docs = [(1, "alpha beta gamma delta", "en"), (2, "alpha beta", "en"), (3, "delta gamma beta alpha omega", "en")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    log = [(7, "alpha beta gamma delta"), (8, "alpha beta nowhere"), (9, None)]
    spark.createDataFrame(log, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = catalog.queries()["search_batch"](spark, str(tmp_path)).collect()
    assert sorted((r["query_id"], r["doc_id"]) for r in found) == [(7, 1), (7, 3)]


def test_backfill_keeps_every_page_of_a_host(spark, tmp_path):
    html = f"<title>t</title><p>{'some words of a page ' * 20}</p>"
    pages = [(i, f"https://hot.example.org/stories/page-{i}", html) for i in range(60)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert catalog.queries()["backfill"](spark, str(tmp_path)).count() == 60


def test_batch_looks_at_lists_of_rare_words_only(spark):
    """A frequent word of many queries: joined rows follow the rarest words, not queries times documents."""
    from tessera.engine import search_many
    from tessera.operators import index as ix

    docs = spark.range(300).selectExpr("id AS doc_id", "'' AS title", "concat('often w', id) AS body")
    log = spark.range(200).selectExpr("id AS query_id", "concat('often w', id, if(id % 2 = 0, '', ' nowhere')) AS text")
    found = search_many(ix.build_index(docs), log.unionByName(spark.createDataFrame([(900, "often")], log.schema)), 3)
    rows = found.collect()
    assert sorted((r["query_id"], r["doc_id"]) for r in rows) == sorted([(i, i) for i in range(0, 200, 2)] + [(900, i) for i in range(3)])

    def joined(plan):
        """Largest row number of a join in the plan that ran."""
        name = plan.nodeName()
        below = [plan.executedPlan()] if name == "AdaptiveSparkPlan" else [plan.plan()] if name.endswith("QueryStage") else [plan.child()] if name == "ReusedExchange" else []
        below += [plan.children().apply(i) for i in range(plan.children().size())]
        metric = plan.metrics().get("numOutputRows")
        own = metric.get().value() if "Join" in name and metric.isDefined() else 0
        return max([own, *map(joined, below)])

    # Before: 300 documents on the list of "often" for each of 201 queries, 60,600 rows.
    assert 0 < joined(found._jdf.queryExecution().executedPlan()) < 3000
