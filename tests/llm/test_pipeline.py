"""The pipeline's stages and the whole run on a small corpus."""

from __future__ import annotations

import corpus_pipeline
from tests.llm import brute
from tests.llm.test_operators import FULL, prose


def _tables(spark, folder):
    every = prose(21, 161)
    texts = every[:120]
    docs = [(i, t, "en", f"s{min(2, i % 7)}", len(t)) for i, t in enumerate(texts)]
    docs += [(200 + i, f"{t} vilefoo nastybar vilefoo grimbaz", "en", "s0", 0) for i, t in enumerate(every[120:160])]
    near = every[160] + " " + " ".join(every[:3])[::-1] * 2
    docs += [(300, near, "en", "s1", 0), (301, near, "en", "s2", 0), (302, near + " tail", "en", None, 0)]
    item = "k1 k2 k3 k4 k5 k6 k7 k8 k9 k10 k11"
    docs += [(400, f"{texts[0]} {item} {texts[1]}", "en", "s0", 0), (500, None, None, None, None), (501, "", "en", "s0", 0)]
    labels = [(i, 1, 0) for i in range(120)] + [(200 + i, 1, 1) for i in range(40)]
    spark.createDataFrame(docs, FULL).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return docs


def test_stages(spark, tmp_path):
    folder = str(tmp_path)
    docs = _tables(spark, folder)
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, folder)
        frame.write.parquet(f"{folder}/{name}.out")
        frame = spark.read.parquet(f"{folder}/{name}.out")
        seen.append({r["doc_id"] for r in frame.collect()})
        if name != "sharding":
            assert frame.columns == [c.split()[0] for c in FULL.split(", ")]
    clean, single, held, mixed, sharded = seen
    assert not clean & set(range(200, 240)) and clean >= set(range(120)) | {300, 400, 500, 501}
    want = brute.jaccard([(d[0], d[1]) for d in docs if d[0] in clean])
    assert single == {d for d, (_, c) in want.items() if c == d}
    assert held == single - {400}
    assert mixed == held and sharded == held
    rows = frame.collect()
    sizes = [sum(r["shard"] == s for r in rows) for s in range(corpus_pipeline.SHARDS)]
    assert max(sizes) - min(sizes) <= 1


def test_run(spark, tmp_path):
    _tables(spark, str(tmp_path))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {"shard", "slot"} <= set(out.columns) and out.count() > 100


def test_near_duplicates_by_five_words_and_08(spark):
    base = [f"w{i}" for i in range(300)]
    near = [f"edit{i}" if i % 50 == 20 else w for i, w in enumerate(base)]  # 5 words: 0.816, 3 words: 0.886
    far = [f"edit{i}" if i % 40 == 20 else w for i, w in enumerate(base)]  # 5 words: 0.787 or less to either
    rows = [(1, " ".join(base), "en", "s", 0), (2, " ".join(near), "en", "s", 0), (3, " ".join(far), "en", "s", 0)]
    kept = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, FULL), "")
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3]


def test_near_duplicates_of_shared_ids(spark):
    """Different texts of one id stay; of equal rows and linked texts one stays."""
    a, b, c = prose(33, 3)
    rows = [(1, a), (1, b), (2, b), (3, a), (3, a), (4, c), (4, None), (None, c), (5, "")]
    frame = spark.createDataFrame([(i, t, "en", "s", k) for k, (i, t) in enumerate(rows)], FULL)
    kept = corpus_pipeline.drop_near_duplicates(spark, frame, "")
    assert kept.columns == frame.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted([(1, a), (1, b), (4, c), (4, None), (None, c), (5, "")], key=str)
