"""Mixing sources to target weights by a temperature.

Source token shares p are raised to an exponent and normalised: w ~ p**alpha.
At 1 the mix is the corpus, at 0 all sources weigh the same.  Bisection finds the
largest exponent whose weights reach the target entropy (a share of the maximum),
unless some source would then repeat more than the limit allows: in that case the
smallest exponent that keeps to the limit.  Shares stay a table: a turn of the search
tries many exponents by one aggregate over it, so sources may be any number.

The token budget is then dealt out by the weights.  A source with a budget above
its size gives whole passes over itself, and what is left comes from a random
permutation in two levels: its hash blocks in random order up to the block where
the budget ends, and inside that block rows in random order.  Blocks hold a
bounded number of rows, so no source, however large, is sorted in one task.

Each source misses its budget by less than its largest document.  The budget is a
number of tokens, by default the size of the corpus; ``WHOLE`` stands for the least
budget under which every source is passed over at least once, so that weights are
met by repeating thin sources and no document is left out.

Defined results: tokens are runs of non-blanks, so a null or empty text has none;
such rows belong to their source's passes and, in the partial pass, go with their
place in the permutation; a null source is a source of its own; repeated rows are
separate rows that may take separate turns; an empty table gives an empty result;
extra columns of any name are kept as they are (``mixed_rows`` replaces ``n_tokens`` and
``copies``, which it adds).
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialize

#: Share of the greatest possible entropy that the mix is to reach.
TARGET_ENTROPY = 0.98
#: No source is passed over more often than this.
MOST_REPEATS = 4.0
#: The budget that leaves no document out.
WHOLE = "whole"
#: Average rows in a permutation block, and blocks whose sums one task runs up.
ROWS_PER_BLOCK = 2048
BLOCKS_PER_CELL = 4096
#: Exponents that one aggregate tries, and how often the search narrows.
TRIED, TURNS = 32, 8
#: Sources and blocks are broadcast up to this many, else joined by shuffle.
MOST_BROADCAST_ROWS = 200_000


@dataclass(frozen=True)
class Shares:
    """Token counts of the sources that have any: their sum, least, most and number.

    ``moments`` gives, for each exponent a, the sums of p**a and of p**a ln p over the shares p.
    """

    total: int
    least: int
    most: int
    live: int
    moments: Callable[[list[float]], list[tuple[float, float]]]


@dataclass(frozen=True)
class Mix:
    """Exponent, normaliser of the weights and token budget."""

    alpha: float
    norm: float
    budget: float


def listed_shares(tokens: list[int]) -> Shares:
    live = [t for t in tokens if t]
    total = sum(live)

    def moments(alphas):
        p = [t / total for t in live]
        return [(sum(x**a for x in p), sum(x**a * math.log(x) for x in p)) for a in alphas]

    return Shares(total, min(live, default=0), max(live, default=0), len(live), moments)


def table_shares(stats: DataFrame) -> Shares:
    """Shares of a (source, tokens, rows) table."""
    live = stats.where("tokens > 0")
    told = live.agg(F.sum("tokens"), F.min("tokens"), F.max("tokens"), F.count("*")).first()
    total = told[0] or 0

    def moments(alphas):
        p = F.col("tokens") / F.lit(float(total))
        tried = F.explode(F.array(*[F.lit(a) for a in alphas])).alias("a")
        each = live.select(p.alias("p"), tried).groupBy("a").agg(F.sum(F.pow("p", "a")).alias("z"), F.sum(F.pow("p", "a") * F.log("p")).alias("s"))
        found = {r["a"]: (r["z"], r["s"]) for r in each.collect()}
        return [found[a] for a in alphas]

    return Shares(total, told[1] or 0, told[2] or 0, told[3], moments)


def entropy(alpha: float, moments: tuple[float, float]) -> float:
    """Entropy of the weights p**alpha / norm."""
    norm, logs = moments
    return math.log(norm) - alpha * logs / norm


def budget_at(shares: Shares, alpha: float, norm: float, budget: int | str) -> float:
    """The token budget at an exponent; up to 1, the fullest source asks for the most."""
    return budget if budget != WHOLE else shares.most * norm / (shares.most / shares.total) ** alpha


def most_repeats(shares: Shares, alpha: float, norm: float, budget: int | str) -> float:
    """How often the thinnest source, which repeats most, is passed over."""
    return (shares.least / shares.total) ** alpha / norm * budget_at(shares, alpha, norm, budget) / shares.least


def _search(good: Callable[[list[float]], list[bool]], low: float, high: float) -> float:
    """The border in [low, high] of a predicate that holds at ``low``; stays where it holds."""
    for _ in range(TURNS):
        step = (high - low) / (TRIED + 1)
        tried = [low + step * (k + 1) for k in range(TRIED)]
        held = next((k for k, ok in enumerate(good(tried)) if not ok), TRIED)
        low, high = (tried[held - 1] if held else low), (tried[held] if held < TRIED else high)
    return low


def plan_mix(shares: Shares, budget: int | str, target=TARGET_ENTROPY, repeats=MOST_REPEATS) -> Mix:
    """Find the exponent for the target entropy within the repetition limit."""
    if not shares.live or (budget != WHOLE and budget <= 0):
        return Mix(1.0, 1.0, 0.0)
    enough = target * math.log(shares.live)
    reaches = lambda tried: [entropy(a, m) >= enough - 1e-12 for a, m in zip(tried, shares.moments(tried), strict=True)]
    keeps = lambda tried: [
        most_repeats(shares, a, m[0], budget) <= repeats + 1e-12 for a, m in zip(tried, shares.moments(tried), strict=True)
    ]
    alpha = 1.0 if reaches([1.0])[0] else _search(reaches, 0.0, 1.0)
    if not keeps([alpha])[0]:
        # Nearer 1 every source repeats as often as the budget exceeds the corpus.
        alpha = 1.0 if not keeps([1.0])[0] else 1.0 - _search(lambda xs: keeps([1.0 - x for x in xs]), 0.0, 1.0 - alpha)
    norm = shares.moments([alpha])[0][0]
    return Mix(alpha, norm, budget_at(shares, alpha, norm, budget))


def source_budgets(stats: DataFrame, shares: Shares, mix: Mix, whole: bool) -> DataFrame:
    """(to, blocks, passes, rest) of each source: whole passes and the tokens of the partial one."""
    weight = F.pow(F.col("tokens") / F.lit(float(max(1, shares.total))), F.lit(mix.alpha)) / F.lit(mix.norm)
    raw = F.bround(weight * F.lit(float(mix.budget))).cast("long")
    told = stats.withColumn("budget", F.greatest(raw, "tokens") if whole else raw)
    some = F.col("tokens") > 0
    return told.select(
        F.col("source").alias("to"),
        F.ceil(F.col("rows") / ROWS_PER_BLOCK).cast("int").alias("blocks"),
        F.when(some, F.expr("budget div tokens")).otherwise(F.lit(int(whole))).cast("long").alias("passes"),
        F.when(some, F.expr("budget % tokens")).otherwise(F.lit(0)).cast("long").alias("rest"),
    )


def n_tokens(text: Column) -> Column:
    """Runs of non-blanks."""
    parts = F.split(F.coalesce(text, F.lit("")), r"[ \t\n\x0B\f\r]+")
    edges = (F.element_at(parts, 1) == "").cast("long") + ((F.element_at(parts, -1) == "") & (F.size(parts) > 1)).cast("long")
    return (F.size(parts) - edges).cast("long")


def source_tokens(light: DataFrame) -> DataFrame:
    """(source, tokens, rows) of ``light`` (source, tokens)."""
    return light.groupBy("source").agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.count("*").alias("rows"))


def keyed_rows(docs: DataFrame, seed: int, source: str = "source", text: str = "text") -> DataFrame:
    """(row, source, tokens, turn): the caller's columns in one struct, and the hash that orders permutations."""
    key = [F.col(c) for c in ("doc_id", text) if c in docs.columns]
    return docs.select(
        F.struct("*").alias("row"),
        F.col(source).cast("string").alias("source"),
        n_tokens(F.col(text)).alias("tokens"),
        F.xxhash64(F.lit(f"mix-{seed}"), *key).alias("turn"),
    )


def _sized(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= MOST_BROADCAST_ROWS else df


def block_begins(sums: DataFrame, seed: int) -> DataFrame:
    """(s, b, begin, size): where in its source's partial pass each block of ``sums`` (to, block, blocks, size) begins.

    Blocks stand in the order of a hash.  Leading bits of the hash cut a source into
    cells; sums run up inside cells, and cells run up inside the source.
    """
    hashed = sums.withColumn("h", F.xxhash64(F.lit(f"blocks-{seed}"), "to", "block"))
    leading = F.shiftrightunsigned("h", 33).bitwiseXOR(F.lit(1 << 30))
    cells = F.ceil(F.col("blocks") / BLOCKS_PER_CELL).cast("long")
    placed = hashed.withColumn("cell", F.shiftright(leading * cells, 31))
    before = Window.partitionBy("to").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("to", "cell").agg(F.sum("size").alias("_size")).select(
        F.col("to").alias("_to"), F.col("cell").alias("_cell"), F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start")
    )
    inside = Window.partitionBy("to", "cell").orderBy("h", "block").rowsBetween(Window.unboundedPreceding, -1)
    run = placed.withColumn("_at", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    met = run.join(starts, F.col("to").eqNullSafe(F.col("_to")) & (F.col("cell") == F.col("_cell")))
    return met.select(F.col("to").alias("s"), F.col("block").alias("b"), (F.col("_start") + F.col("_at")).alias("begin"), "size")


def _dealt(keyed: DataFrame, light: DataFrame, budget: int | str | None, target: float, seed: int) -> DataFrame:
    """``keyed`` rows that take a turn, with ``copies``; ``light`` has what the plan needs of them."""
    stats = materialize(source_tokens(light), "sources")
    shares = table_shares(stats)
    mix = plan_mix(shares, shares.total if budget is None else budget, target)
    plan = _sized(source_budgets(stats, shares, mix, budget == WHOLE), stats.count())

    def place(rows: DataFrame) -> DataFrame:
        return rows.join(plan, F.col("source").eqNullSafe(F.col("to"))).withColumn("block", F.pmod("turn", F.col("blocks")).cast("int"))

    sums = place(light).groupBy("to", "block", "blocks").agg(F.sum("tokens").alias("size"))
    begins = materialize(block_begins(sums, seed), "blocks")
    met = place(keyed).join(_sized(begins, begins.count()), F.col("to").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")))
    inside = (F.col("begin") < F.col("rest")) & (F.col("begin") + F.col("size") > F.col("rest"))
    extra = ((F.col("begin") + F.col("size") <= F.col("rest")) & (F.col("rest") > 0)).cast("long")
    whole = met.where(~inside).withColumn("extra", extra)
    # The block where a budget ends, one a source: its rows in random order.
    rows = Window.partitionBy("to", "block").orderBy(F.xxhash64(F.lit(seed), "turn"), "turn").rowsBetween(Window.unboundedPreceding, -1)
    at = F.col("begin") + F.coalesce(F.sum("tokens").over(rows), F.lit(0))
    cut = met.where(inside).withColumn("extra", (at < F.col("rest")).cast("long"))
    out = whole.unionByName(cut).withColumn("copies", F.col("passes") + F.col("extra"))
    return out.where(F.col("copies") > 0)


def mixed_rows(docs: DataFrame, budget: int | str | None = None, target: float = TARGET_ENTROPY, seed: int = 5,
               source: str = "source", text: str = "text") -> DataFrame:
    """Rows of the mix: ``docs`` with n_tokens and copies (at least 1), the turns each row takes.

    ``budget`` defaults to the corpus size.
    """
    keyed = keyed_rows(docs, seed, source, text)
    light = materialize(keyed.select("source", "tokens", "turn"), "turns")
    kept = [F.col("row")[c].alias(c) for c in docs.columns if c.lower() not in ("n_tokens", "copies")]
    return _dealt(keyed, light, budget, target, seed).select(*kept, F.col("tokens").alias("n_tokens"), "copies")


def mixed_copies(docs: DataFrame, budget: int | str | None = None, target: float = TARGET_ENTROPY, seed: int = 5,
                 source: str = "source", text: str = "text") -> DataFrame:
    """The rows of the mix, each as often as it takes a turn; the columns of ``docs``."""
    keyed = keyed_rows(docs, seed, source, text)
    light = materialize(keyed.select("source", "tokens", "turn"), "turns")
    rows = _dealt(keyed, light, budget, target, seed).select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return rows.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def mixing_report(docs: DataFrame) -> DataFrame:
    """One row for each turn of a document: doc_id, source, n_tokens, copy."""
    seed = 5
    keyed = keyed_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text"), seed)
    light = materialize(keyed.select(F.col("row.doc_id").alias("doc_id"), "source", "tokens", "turn"), "turns")
    return _dealt(light, light, None, TARGET_ENTROPY, seed).select(
        "doc_id", "source", F.col("tokens").alias("n_tokens"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")
    )
