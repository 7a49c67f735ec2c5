"""URL filters: listed rules first, mined association rules for the rest.

Listed rules name a host (with all its subdomains) and a path prefix; the longest
that fits wins.  Elsewhere a URL is blocked when an association rule
{URL tokens} -> block fits it.  Rules are mined from labelled URLs and have at most
``MAX_RULE_TOKENS`` tokens: this bound is part of what a rule is, not a cut of a longer
list.  Tokens that stand in exactly the same labelled URLs are one item, so a fixed
part of deep paths does not multiply.  Spark's FP-growth finds the frequent item
sets where no URL holds more than ``MOST_ITEMS`` frequent items; it has no bound on
the size of a set, so longer URLs would make exponentially many.  There the sets of
bounded size are found by Spark's PrefixSpan over the items in order, which has such a
bound and the same sets as result.  Rules below the support and confidence limits go,
and so does a rule that a more general one matches in confidence.  The rest form an
inverted index under their rarest item, so a URL meets only rules it shares that with.

Defined results: a null URL or one without ``://`` has empty host and path and is
allowed; repeated rows keep one row each; an empty table gives an empty result;
without labels nothing is mined and every other URL is allowed; other columns are
ignored by the query.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth, PrefixSpan
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import ascii_lower, materialize

BLOCK, ALLOW = "block", "allow"
_LABEL = "label=block"


@dataclass(frozen=True)
class ListedRule:
    """``verdict`` for ``host`` and its subdomains where the path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The contract's rules.
LISTED = (
    ListedRule(BLOCK, "com", "/en/"),
    ListedRule(ALLOW, "example.com", "/en/7"),
    ListedRule(ALLOW, "net", "/de/"),
    ListedRule(BLOCK, "example.net", "/de/8"),
    ListedRule(BLOCK, "org", "/es/"),
)
#: A mined rule holds for at least this share of labelled URLs, this surely, and
#: with this many times the base rate; it has at most this many tokens.
MIN_SUPPORT = 0.001
MIN_CONFIDENCE = 0.6
MIN_LIFT = 1.5
MAX_RULE_TOKENS = 3
#: Frequent items of a URL up to which all item sets are enumerated.
MOST_ITEMS = 12
#: Mined rules and their tokens are broadcast up to this many rows, else joined by shuffle.
MOST_BROADCAST_RULES = 50_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path of ``scheme://host/path?query#fragment``."""
    mark = F.instr(url, "://")
    rest = F.when(mark > 0, F.substring(url, mark + F.lit(3), F.length(url)))
    rest = F.coalesce(rest, F.lit(""))
    host = ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def listed_rule(host: Column, path: Column, rules: tuple[ListedRule, ...] = LISTED) -> tuple[Column, Column]:
    """(rule name, verdict) of the longest listed rule that fits, else nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.name)):
        under = (host == rule.host) | host.endswith("." + rule.host)
        fits = under & path.startswith(rule.path)
        name = F.when(fits, F.lit(rule.name)).otherwise(name)
        verdict = F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return name, verdict


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens of a URL: scheme, words of the host, whole hyphenated labels, path segments, query keys.

    Runs of digits become one token, so page numbers do not count as words.
    """
    url = F.coalesce(url, F.lit(""))
    tagged = lambda tag, words: F.transform(words, lambda w: F.concat(F.lit(tag), w))
    segments = F.transform(F.split(F.lower(path), "/"), lambda s: F.regexp_replace(s, r"\d+", "9"))
    keys = F.regexp_extract_all(F.regexp_extract(url, r"\?([^#]*)", 1), F.lit(r"(?:^|&)([^=&]+)"), F.lit(1))
    parts = F.concat(
        tagged("scheme=", F.array(F.lower(F.substring_index(url, "://", 1)))),
        tagged("host=", F.filter(F.split(host, r"[.\-]"), lambda w: w != "")),
        tagged("domain=", F.filter(F.split(host, r"\."), lambda w: w.contains("-"))),
        tagged("path=", F.filter(segments, lambda s: s != "")),
        tagged("key=", keys),
    )
    return F.array_distinct(F.when(F.instr(url, "://") > 0, parts).otherwise(F.array().cast("array<string>")))


@dataclass
class MinedRules:
    """rules (rule, anchor, items, confidence, support), members (token, item) and their numbers."""

    rules: DataFrame
    members: DataFrame
    n_rules: int
    n_members: int


def token_items(tokens: DataFrame, least: int) -> DataFrame:
    """(token, item, freq) of the tokens that ``least`` rows of ``tokens`` (row, token) have.

    Tokens of the same rows share an item, the least of them.  Rows are told by their
    number and two 64-bit sums over different hashes of their ids.
    """
    one, two = F.xxhash64("row"), F.xxhash64(F.lit("rows"), "row")
    wrapped = lambda h: F.sum(h.cast("decimal(38,0)"))
    seen = tokens.groupBy("token").agg(F.count("*").alias("freq"), wrapped(one).alias("one"), wrapped(two).alias("two"))
    often = seen.where(F.col("freq") >= least)
    named = often.groupBy("freq", "one", "two").agg(F.min("token").alias("item"))
    return often.join(named, ["freq", "one", "two"]).select("token", "item", "freq")


def frequent_sets(baskets: DataFrame, support: float, size: int) -> DataFrame:
    """(items, freq): the item sets of ``size`` items at most that this share of ``baskets`` (items) holds, items sorted."""
    longest = baskets.agg(F.max(F.size("items"))).first()[0] or 0
    if longest <= MOST_ITEMS:
        sets = FPGrowth(itemsCol="items", minSupport=support).fit(baskets).freqItemsets
        return sets.where(F.size("items") <= size).select(F.sort_array("items").alias("items"), "freq")
    spans = PrefixSpan(minSupport=support, maxPatternLength=size, maxLocalProjDBSize=2_000_000)
    ordered = baskets.select(F.transform(F.sort_array("items"), lambda i: F.array(i)).alias("sequence"))
    return spans.findFrequentSequentialPatterns(ordered).select(F.flatten("sequence").alias("items"), "freq")


def mine_rules(labelled: DataFrame, support=MIN_SUPPORT, confidence=MIN_CONFIDENCE, lift=MIN_LIFT, size=MAX_RULE_TOKENS) -> MinedRules:
    """Mine {tokens} -> block from ``labelled`` (tokens, blocked)."""
    spark = labelled.sparkSession
    rows = materialize(labelled.select("tokens", "blocked").withColumn("row", F.monotonically_increasing_id()), "labelled")
    told = rows.agg(F.count("*").alias("n"), F.count(F.when(F.col("blocked"), 1)).alias("bad")).first()
    none = MinedRules(
        spark.createDataFrame([], "rule string, anchor string, items array<string>, confidence double, support double"),
        spark.createDataFrame([], "token string, item string"), 0, 0,
    )
    if not told["bad"]:
        return none
    n, least = told["n"], max(1, math.ceil(support * told["n"]))
    each = rows.select("row", F.explode("tokens").alias("token"))
    items = materialize(token_items(each, least), "items")
    held = each.join(_sized(items, items.count()), "token").groupBy("row").agg(F.collect_set("item").alias("items"))
    baskets = rows.select("row", "blocked").join(held, "row").select(
        F.when(F.col("blocked"), F.array_append("items", _LABEL)).otherwise(F.col("items")).alias("items")
    )
    baskets = materialize(baskets, "baskets")
    # Half a row below the least number, so that rounding does not matter.
    found = materialize(frequent_sets(baskets, (least - 0.5) / max(1, baskets.count()), size + 1), "sets")
    bare = found.where(~F.array_contains("items", _LABEL))
    both = found.where(F.array_contains("items", _LABEL) & (F.size("items") > 1)).select(F.array_remove("items", _LABEL).alias("items"), F.col("freq").alias("hits"))
    sure = F.col("hits") / F.col("freq")
    rules = bare.join(both, "items").select("items", sure.alias("confidence"), (F.col("hits") / n).alias("support"), F.explode("items").alias("item"), (sure / (told["bad"] / n)).alias("lift"))
    rules = rules.where((F.col("confidence") >= confidence) & (F.col("lift") >= lift))
    # Under its rarest item; the rest of a rule is looked at where that is met.
    single = items.select("item", "freq").distinct()
    rules = rules.join(single, "item").groupBy("items", "confidence", "support").agg(F.min(F.struct("freq", "item"))["item"].alias("anchor"))
    rules = materialize(rules, "rules")
    shorter = rules.where(F.size("items") > 1).select("items", "confidence", F.explode("items").alias("gone")).select(
        "items", "confidence", F.array_remove("items", F.col("gone")).alias("part")
    )
    beaten = shorter.join(rules.select(F.col("items").alias("part"), F.col("confidence").alias("_sure")), "part").where("_sure >= confidence")
    general = rules.join(beaten.select("items").distinct(), "items", "left_anti")
    general = materialize(general.select(F.array_join("items", " & ").alias("rule"), "anchor", "items", "confidence", "support"), "rules")
    wanted = general.select(F.explode("items").alias("item")).distinct()
    members = materialize(items.join(wanted, "item").select("token", "item"), "members")
    return MinedRules(general, members, general.count(), members.count())


def _sized(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= MOST_BROADCAST_RULES else df


def matched_urls(urls: DataFrame, mined: MinedRules) -> DataFrame:
    """(url, mined_rule, confidence): the surest mined rule of each distinct URL that has one."""
    each = urls.select("url", "tokens").distinct().select("url", F.explode("tokens").alias("token"))
    held = each.join(_sized(mined.members, mined.n_members), "token").groupBy("url").agg(F.collect_set("item").alias("own"))
    met = held.select("url", "own", F.explode("own").alias("anchor")).join(_sized(mined.rules, mined.n_rules), "anchor")
    fits = met.where(F.size(F.array_except("items", "own")) == 0)
    best = F.max(F.struct("confidence", F.col("rule")))
    return fits.groupBy("url").agg(best.alias("best")).select(
        F.col("url").alias("_url"), F.col("best.rule").alias("mined_rule"), F.col("best.confidence").alias("confidence")
    )


def judge_urls(pages: DataFrame, labels: DataFrame, rules: tuple[ListedRule, ...] = LISTED) -> DataFrame:
    """The digest report: every page's host, path, listed rule and verdict.

    Assumed: the label row with a page's id is about that page.  It is a block example
    when it is marked toxic or of low quality.
    """
    host, path = host_and_path(F.col("url"))
    split = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host.alias("host"), path.alias("path"))
    token = url_tokens(F.col("url"), F.col("host"), F.col("path"))
    marked = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.max((F.coalesce("toxic", F.lit(0)) == 1) | (F.coalesce("quality", F.lit(1)) == 0)).alias("blocked")
    )
    tokens = split.select("page_id", "url", token.alias("tokens"))
    mined = mine_rules(tokens.join(marked, F.col("page_id") == F.col("doc_id")).select("tokens", "blocked"))
    name, verdict = listed_rule(F.col("host"), F.col("path"), rules)
    told = split.withColumn("rule", name).withColumn("_listed", verdict)
    if not mined.n_rules:
        told = told.withColumn("mined_rule", F.lit(None).cast("string"))
    else:
        told = told.join(matched_urls(tokens, mined), F.col("url") == F.col("_url"), "left")
    learned = F.when(F.col("mined_rule").isNotNull(), F.lit(BLOCK)).otherwise(F.lit(ALLOW))
    return told.select(
        "page_id", "host", "path", "rule", F.coalesce("_listed", learned).alias("verdict"), "mined_rule"
    )
