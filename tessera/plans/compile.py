"""From syntax tree to plan.

Two back ends.  ``match`` is relational: one join or set operation a node, and the
only one that can return documents without any query word.  ``predicate`` is
fused: after one aggregation that gathers the position lists of the query's words
by document, the whole tree is one boolean Column.  Over an index without positions,
phrases and proximity ask for all their words only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.index import Index
from tessera.plans.lang import And, Near, Node, Not, Nothing, Or, Phrase, Term


def match(index: Index, node: Node) -> DataFrame:
    """(doc_id) of the documents that match, each once."""
    lists = lambda word: index.postings.where(F.col("term") == word)
    everything = index.doc_stats.select("doc_id")
    if isinstance(node, Phrase | Near) and not index.positional:
        words = node.words if isinstance(node, Phrase) else (node.first, node.second)
        return reduce(lambda a, b: a.join(b, "doc_id", "left_semi"), [lists(w).select("doc_id") for w in words]) if words else everything.where(F.lit(False))
    if isinstance(node, Term):
        return lists(node.word).select("doc_id")
    if isinstance(node, Phrase):
        if not node.words:
            return everything.where(F.lit(False))
        # Offset-adjusted starts of every word; a phrase stands where all agree.
        starts = [
            lists(word).select("doc_id", F.explode("positions").alias("p")).select("doc_id", (F.col("p") - i).alias("start"))
            for i, word in enumerate(node.words)
        ]
        return reduce(lambda a, b: a.join(b, ["doc_id", "start"], "left_semi"), starts).select("doc_id").distinct()
    if isinstance(node, Near):
        if node.first == node.second:
            return lists(node.first).select("doc_id")
        # Positions fall into blocks; near ones lie in one block or in neighbours.
        block = lambda p: F.floor(F.col(p) / (node.distance + 1))
        a, b = (lists(w).select("doc_id", F.explode("positions").alias(p)) for w, p in ((node.first, "p"), (node.second, "q")))
        a = a.withColumn("block", block("p"))
        b = b.select("doc_id", "q", F.explode(F.array(block("q") - 1, block("q"), block("q") + 1)).alias("block"))
        near = F.abs(F.col("p") - F.col("q")) <= node.distance
        return a.join(b, ["doc_id", "block"]).where(near).select("doc_id").distinct()
    if isinstance(node, Not):
        return everything.join(match(index, node.operand), "doc_id", "left_anti")
    if isinstance(node, And):
        return match(index, node.left).join(match(index, node.right), "doc_id", "left_semi")
    if isinstance(node, Or):
        return match(index, node.left).unionByName(match(index, node.right)).distinct()
    return everything.where(F.lit(False))


def predicate(node: Node, lists: Column, positional: bool = True) -> Column:
    """The tree as a Column over ``lists``, a map from word to positions; never null."""
    at = lambda word: F.element_at(lists, F.lit(word))
    has = lambda word: F.coalesce(F.map_contains_key(lists, word), F.lit(False))
    if isinstance(node, Term):
        return has(node.word)
    if isinstance(node, Phrase):
        if not node.words:
            return F.lit(False)
        all_there = reduce(Column.__and__, [has(w) for w in node.words])
        if not positional:
            return all_there

        def follows(p: Column) -> Column:
            later = [F.array_contains(at(w), p + i) for i, w in enumerate(node.words) if i]
            return reduce(Column.__and__, later, F.lit(True))

        return all_there & F.coalesce(F.exists(at(node.words[0]), follows), F.lit(False))
    if isinstance(node, Near):
        if not positional:
            return has(node.first) & has(node.second)
        close = F.exists(at(node.first), lambda p: F.exists(at(node.second), lambda q: F.abs(p - q) <= node.distance))
        return has(node.first) & has(node.second) & F.coalesce(close, F.lit(False))
    if isinstance(node, Not):
        return ~predicate(node.operand, lists, positional)
    if isinstance(node, And):
        return predicate(node.left, lists, positional) & predicate(node.right, lists, positional)
    if isinstance(node, Or):
        return predicate(node.left, lists, positional) | predicate(node.right, lists, positional)
    assert isinstance(node, Nothing)
    return F.lit(False)
