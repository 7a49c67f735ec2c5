"""Connected components over a table of links, by label propagation with pointer jumps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of ``links`` (a, b) reaches.

    Each round takes the least label among the neighbours and then follows labels
    once, so a chain shrinks by a constant factor a round.  Every round ends in a
    written table; nothing but a counter reaches the driver.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    edges = materialize(both, "edges")
    labels = materialize(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), "labels")
    while True:
        of = lambda name: labels.select(F.col("node").alias(name), F.col("label").alias(f"{name}_label"))
        near = edges.join(of("b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("b_label").alias("near"))
        met = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("met"))
        jump = met.join(of("_hop"), F.col("met") == F.col("_hop"), "left")
        told = jump.select("node", F.col("label").alias("old"), F.least("met", F.coalesce("_hop_label", "met")).alias("label"))
        fresh = materialize(told, "labels")
        changed = fresh.where(F.col("old") != F.col("label")).limit(1).count()
        labels = fresh.select("node", "label")
        if not changed:
            return labels.withColumnRenamed("label", "component")
