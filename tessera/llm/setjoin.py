"""N-gram Jaccard join: size-aware, light sets by subsets, heavy sets by inverted lists.

Two sets link when intersection / union reaches the threshold of a :class:`Rule`.
Documents of one word sequence fold into one representative first.  What is left is
joined on keys that every linking pair must share:

* light sets (few elements) list their subsets of each size that an intersection
  with a partner can require; a linking pair of light sets shares one of them;
* heavy sets scan inverted lists.  A set of n elements shares t = ceil(num / den * n)
  of them with any partner, so the i-th least element that a linking pair shares is
  among the first n - t + i of either set.  Each set posts its first n - t + 1 + s
  elements, so a linking pair meets on s + 1 elements at least, s the smaller spare
  of the two; pairs that meet on fewer are dropped.

The size at which a set becomes heavy is where its subsets would cost more than its
list entries; light sets that may have a heavy partner post as heavy ones do, too.

Keys travel packed, six bytes each, to buckets by key; only keys of two documents or
more come back.  A key that many documents of one task hold goes there once, so no
bucket gathers a frequent passage.

Lists do not pair all members.  Every document is first compared with the pivot (the
least member) that most of its lists have; documents that are then connected need no
further pair.  Short lists pair their members.  Long lists matter while they are open,
with members in several components.  A document with no more entries in them than the
spare of its least partner is settled: of the s + 1 elements that it meets a partner on,
one is in a short list.  The others post again, among themselves only and with the
elements that are frequent among them put last: any common order of elements serves, and
this one has frequent elements posted only by sets that have little else (counts come from
a bounded sample, as they decide about nothing but the order).  That is repeated while it
settles at least half.  Of the few documents that are left, each may pass over as many
entries in open long lists as half the spare of its least partner: of the s + 1 elements
that a linking pair meets on, one is then left that is in a short list, or that neither
passes over.  It passes over those of the pivots that it shares least with, as a frequent
passage.  In what is left, documents are described by how they differ from the set P that
stands for the list's pivot.  If X does not link
with P and links with Y, then X and Y share (|dX| + |dY| - most apart) / 2 of their
differences at least, and that is more than none: otherwise |dX| + |dY| were within
reach of |Y|, which exceeds |P| by |dY| at most.  Differences are ordered, those last
that many of a few documents around P have (which ones is only a matter of order, so
the few decide about no result).  The first one that X and Y share is then among the
first most / 2 + 1 of the one that has fewer, where it probes, and among the first
most + 1 of the other.  So what a whole template has in common pairs nobody.  Where
many documents probe one difference, the least member is the next P: what all of a
list share is then no difference any more.  Groups whose members are all just short of
the threshold from each other gain little by that, so what counts as a long list grows
by ``LONGER`` with each turn: few turns are made, and smaller lists pair their members.

Candidates meet a parity sketch, whose Hamming distance never exceeds the symmetric
difference, before their texts are compared; there, words of equal hash are compared
byte by byte, and so are shingles word by word.

Elements are 64-bit hashes of word n-grams.  Folding goes by a 128-bit BLAKE2 digest of
the word sequence.

Defined results: null or wordless texts have an empty set and link with nothing; a
text with fewer words than a shingle is one shingle; rows that share a ``doc_id``
count as one document with several texts, so their components join; a row without
``doc_id`` links with nothing and has a null component; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import kernels
from tessera.llm.common import materialize, prime, small_batches
from tessera.llm.components import components

#: The contract: link when 100 * intersection >= 90 * union, over 3-word shingles.
NUM, DEN = 90, 100
SHINGLE = 3


@dataclass(frozen=True)
class Rule:
    """When two sets link: ``den`` * intersection >= ``num`` * union, over shingles of ``shingle`` words."""

    shingle: int
    num: int
    den: int


#: What op10 is bound to.
CONTRACT = Rule(SHINGLE, NUM, DEN)
#: Near duplicates in general: five words, 0.8.
GENERAL = Rule(5, 80, 100)
#: What a list entry costs beside a subset: it is met by more sets.
ENTRY_COST = 4
#: Longs in a set's parity sketch.
PARITY_WORDS = 16
#: Longs in the parity sketch of a set's differences from a pivot.
_SKETCH = tuple(f"s{k}" for k in range(1, 9))
#: Light sets never have more elements than this, whatever the cost estimate says.
MOST_LIGHT = 24
#: Members of lists above this length meet by their differences from the pivot.
LONG_LIST = 24
#: How much longer lists of differences may be with each turn before they get a pivot.
LONGER = 4
#: Documents whose elements are counted before they post again, and the most elements that are put last: a matter of order only.
SAMPLED, MOST_LATE = 20_000, 500_000
#: Small sides of joins are broadcast up to this many rows (17 bytes each), else joined by shuffle.
MOST_BROADCAST_IDS = 300_000
#: Text bytes of either side that are compared at once.
JUDGED_BYTES = 1 << 18
#: Keys that a task gathers before it sends them on.
GATHER = 250_000
#: Members of one key in a task from which on it is sent once.
LOCAL_LIST = 8
#: Text bytes whose keys meet in one bucket, on average, and the least number of buckets.
BUCKET_BYTES, LEAST_BUCKETS = 8 << 20, 17
#: Documents around a pivot that show which differences are common there: those of so many of them.
FEW, OFTEN = 16, 4
#: Comparisons with one document that share a task.
PER_HEAD = 256

_SETS = "doc_id long, n int, k1 long, k2 long, parity array<long>"
_PACKED = "bucket int, asked binary, known binary"
_MEMBERS = "g long, doc long, scope long, pos int"


def required(n: int, m: int, rule: Rule = CONTRACT) -> int:
    """The least intersection with which sets of ``n`` and ``m`` elements link."""
    return -(-rule.num * (n + m) // (rule.num + rule.den))


def least_partner(n: int, rule: Rule = CONTRACT) -> int:
    """The least size, and the least intersection, that a partner of a set of ``n`` has."""
    return -(-rule.num * n // rule.den)


def most_partner(n: int, rule: Rule = CONTRACT) -> int:
    return rule.den * n // rule.num


def spare(n: int, rule: Rule = CONTRACT) -> int:
    """Elements that a set of ``n`` posts beyond what a link needs."""
    return (n - least_partner(n, rule)) // 2


def entries(n: int, rule: Rule = CONTRACT) -> int:
    """How many of its elements a set of ``n`` posts."""
    return n - least_partner(n, rule) + 1 + spare(n, rule)


def subset_sizes(n: int, rule: Rule = CONTRACT) -> list[int]:
    """Sizes of the subsets that a light set of ``n`` lists: what its partners can require."""
    sizes = {required(n, m, rule) for m in range(least_partner(n, rule), most_partner(n, rule) + 1)}
    return sorted(c for c in sizes if c <= n)


def subset_cost(n: int, rule: Rule = CONTRACT) -> int:
    return sum(math.comb(n, c) for c in subset_sizes(n, rule))


def most_apart(total: int, rule: Rule = CONTRACT) -> int:
    """The largest symmetric difference of linking sets with ``total`` elements in all."""
    return total * (rule.den - rule.num) // (rule.den + rule.num)


def light_bound(rule: Rule = CONTRACT) -> int:
    """The largest size whose subsets cost no more than its list entries; light sets have no spare."""
    best = 0
    for n in range(1, MOST_LIGHT + 1):
        if spare(n, rule) or subset_cost(n, rule) > ENTRY_COST * entries(n, rule):
            break
        best = n
    return best


def word_shingles(words: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each shingle, first shingle of each document, first word of each shingle), repeats included."""
    counts = np.diff(first)
    n = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    starts = np.concatenate([[0], np.cumsum(n)])
    at = np.arange(starts[-1]) - np.repeat(starts[:-1], n) + np.repeat(first[:-1], n)
    size = np.minimum(np.repeat(counts, n), width)
    out = size.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)
    for k in range(width):
        there = k < size
        word = words[np.minimum(at + k, max(0, len(words) - 1))] if len(words) else np.zeros(len(at), np.uint64)
        out = kernels.mix(out + np.where(there, word, np.uint64(0)) * np.uint64(2 * k + 1) + np.uint64(k))
    return out, starts, at


def _tokens(data: np.ndarray, offsets: np.ndarray) -> kernels.Tokens:
    return kernels.Tokens(data, offsets, kernels.SOLID_BYTES, lower="ascii")


def shingles(data: np.ndarray, offsets: np.ndarray, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each shingle, first shingle of each document), repeats included."""
    tokens = _tokens(data, offsets)
    return word_shingles(tokens.hashes(), tokens.first, width)[:2]


def distinct_sets(data: np.ndarray, offsets: np.ndarray, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(elements, first element of each document): distinct and sorted by hash."""
    keys, starts = shingles(data, offsets, width)
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        keys[a:b].sort()
    new = np.ones(len(keys), dtype=bool)
    new[1:] = keys[1:] != keys[:-1]
    new[starts[:-1][starts[:-1] < len(keys)]] = True
    return keys[new], np.concatenate([[0], np.cumsum(new)])[starts]


def _parities(keys: np.ndarray, first: np.ndarray, words: int = PARITY_WORDS) -> np.ndarray:
    """Per document ``words`` longs; each element flips one bit."""
    n, bits = len(first) - 1, words * 64
    spot = (kernels.mix(keys) % np.uint64(bits)).astype(np.int64)
    flips = np.bincount(np.repeat(np.arange(n), np.diff(first)) * bits + spot, minlength=n * bits) & 1
    return np.packbits(flips.astype(np.uint8).reshape(n, bits), axis=1).view(np.int64).reshape(n, words)


def _lists(rows: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    ends = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.astype(np.int64)))


def _subset_keys(elements: np.ndarray, rule: Rule) -> np.ndarray:
    """A key for each subset of each listed size: size and sum of element hashes."""
    n = len(elements)
    each = kernels.mix(elements + np.uint64(0x5851F42D4C957F2D))
    out = []
    for c in subset_sizes(n, rule):
        salt = np.uint64(c * 0x2545F4914F6CDD1D & (2**64 - 1))
        gone = np.array(list(combinations(range(n), n - c)), dtype=np.int64).reshape(math.comb(n, c), n - c)
        out.append(kernels.mix(each.sum(dtype=np.uint64) - each[gone].sum(axis=1, dtype=np.uint64) + salt))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def join_keys(elements: np.ndarray, rule: Rule, bound: int, late=None) -> np.ndarray:
    """The keys that a set posts: subsets of a light set, least elements where a heavy set is or may be met.

    ``late(keys)`` ranks elements that come last in the order; the others have 0.
    """
    n = len(elements)
    if not n:
        return elements
    least = elements[:0]
    if most_partner(n, rule) > bound:
        least = kernels.mix(elements)
        least = (least if late is None else least[np.argsort(late(least), kind="stable")])[: entries(n, rule)]
    return np.concatenate([_subset_keys(elements, rule), least]) if n <= bound else least


def build_sets(docs: DataFrame, rule: Rule = CONTRACT) -> DataFrame:
    """One row for each document: size, digest of the word sequence, parity sketch."""

    def build(batches):
        for batch in batches:
            for rows, data, offsets in kernels.chunks(batch):
                elements, first = distinct_sets(data, offsets, rule.shingle)
                raw = data.tobytes()
                digests = [
                    hashlib.blake2b(b" ".join(raw[a:b].lower().split()), digest_size=16).digest()
                    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)
                ]
                named = np.frombuffer(b"".join(digests), dtype=np.int64).reshape(-1, 2)
                yield pa.record_batch(
                    [
                        rows.column("doc_id"),
                        pa.array(np.diff(first).astype(np.int32)),
                        pa.array(np.ascontiguousarray(named[:, 0])),
                        pa.array(np.ascontiguousarray(named[:, 1])),
                        _lists(list(_parities(elements, first))),
                    ],
                    names=["doc_id", "n", "k1", "k2", "parity"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(kernels.released(build), _SETS)


# Packed exchange of keys.

_ENTRY = np.dtype([("key", "u8"), ("doc", "i8"), ("scope", "i8"), ("pos", "i4"), ("sent", "u1")])


def _pack(rows: np.ndarray, buckets: int) -> bytes:
    """Six bytes of what the bucket leaves open of a key; the rest as differences, byte planes compressed."""
    rows = rows[np.lexsort((rows["doc"], rows["scope"]))]
    rest = (rows["key"] // np.uint64(buckets)) & np.uint64((1 << 48) - 1)
    raw = np.ascontiguousarray(rest).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()
    planes = [np.diff(rows[c].astype(np.int64), prepend=0).view(np.uint8).reshape(-1, 8).T.tobytes() for c in ("doc", "scope", "pos")]
    return len(rows).to_bytes(4, "little") + raw + zlib.compress(b"".join([*planes, rows["sent"].tobytes()]), 1)


def key_names(keys: np.ndarray, buckets: int) -> np.ndarray:
    """What is left of keys once they were packed: the ``g`` of their lists."""
    keys = keys.astype(np.uint64)
    return (((keys // np.uint64(buckets)) & np.uint64((1 << 48) - 1)) * np.uint64(buckets) + keys % np.uint64(buckets)).view(np.int64)


def _unpack(raw: bytes, bucket: int, buckets: int) -> np.ndarray:
    n = int.from_bytes(raw[:4], "little")
    out = np.zeros(n, dtype=_ENTRY)
    rest = np.zeros((n, 8), dtype=np.uint8)
    rest[:, :6] = np.frombuffer(raw, dtype=np.uint8, count=6 * n, offset=4).reshape(-1, 6)
    out["key"] = rest.view(np.uint64).ravel() * np.uint64(buckets) + np.uint64(bucket)
    flat = np.frombuffer(zlib.decompress(raw[4 + 6 * n :]), dtype=np.uint8)
    for k, c in enumerate(("doc", "scope", "pos")):
        planes = np.ascontiguousarray(flat[8 * n * k : 8 * n * (k + 1)].reshape(8, n).T)
        out[c] = np.cumsum(planes.view(np.int64).ravel())
    out["sent"] = flat[24 * n :]
    return out


def _runs(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows sorted by key and document, length of the run that each row's key has)."""
    rows = rows[np.lexsort((rows["doc"], rows["key"]))]
    start = np.flatnonzero(np.concatenate([[True], rows["key"][1:] != rows["key"][:-1]])) if len(rows) else np.zeros(0, np.int64)
    size = np.diff(np.append(start, len(rows)))
    return rows, np.repeat(size, size)


def _by_bucket(rows: np.ndarray, bucket: np.ndarray):
    order = np.argsort(bucket, kind="stable")
    rows, bucket = rows[order], bucket[order]
    cut = np.flatnonzero(np.diff(bucket)) + 1
    for part, b in zip(np.split(rows, cut), bucket[np.concatenate([[0], cut])] if len(bucket) else (), strict=False):
        if len(part):
            yield int(b), part


def _send(rows: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Keys to their buckets.  Of many rows of one key, one is sent; all of them are known to be members."""
    rows, run = _runs(rows)
    hot = run > LOCAL_LIST
    lead = hot & np.concatenate([[True], rows["key"][1:] != rows["key"][:-1]]) if len(rows) else hot
    known, asked = rows[hot], rows[~hot | lead]
    asked["sent"] = hot[~hot | lead]
    out = [(b, _pack(part, buckets), None) for b, part in _by_bucket(asked, (asked["key"] % np.uint64(buckets)).astype(np.int64))]
    for b, part in _by_bucket(known, (known["key"] % np.uint64(buckets)).astype(np.int64)):
        # A member that is known need not go to its key's bucket: name it whole, send it anywhere.
        out.append((int(part["doc"][0]) % buckets, None, b.to_bytes(4, "little") + _pack(part, buckets)))
    cols = list(zip(*out, strict=True)) or [(), (), ()]
    return pa.record_batch([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.binary())], names=["bucket", "asked", "known"])


def _meet(buckets: int):
    """Reducer: the members of keys that two or more rows have."""

    def run(table: pa.Table) -> pa.Table:
        out = [np.zeros(0, dtype=_ENTRY)]
        asked = [_unpack(x, b, buckets) for b, x in zip(table.column("bucket").to_pylist(), table.column("asked").to_pylist(), strict=True) if x is not None]
        if asked:
            rows, size = _runs(np.concatenate(asked))
            out.append(rows[(size > 1) & (rows["sent"] == 0)])
        out += [_unpack(x[4:], int.from_bytes(x[:4], "little"), buckets) for x in table.column("known").to_pylist() if x is not None]
        rows = np.concatenate(out)
        kernels.give_back()
        return pa.table({"g": rows["key"].view(np.int64) if len(rows) else pa.array([], pa.int64()), "doc": rows["doc"], "scope": rows["scope"], "pos": rows["pos"]})

    return run


def shared_keys(rows: DataFrame, keys_of, buckets: int, label: str) -> DataFrame:
    """(g, doc, scope, pos): the entries whose key another row has too.

    ``keys_of(batch)`` yields (keys, doc, scope, pos) arrays of a record batch.
    """

    def post(batches):
        held, n = [], 0
        for batch in batches:
            for keys, doc, scope, pos in keys_of(batch):
                own = np.zeros(len(keys), dtype=_ENTRY)
                own["key"], own["doc"], own["scope"], own["pos"] = keys, doc, scope, pos
                held.append(own)
                n += len(own)
                if n >= GATHER:
                    yield _send(np.concatenate(held), buckets)
                    held, n = [], 0
        if n:
            yield _send(np.concatenate(held), buckets)

    met = rows.mapInArrow(kernels.released(post), _PACKED).groupBy("bucket").applyInArrow(_meet(buckets), _MEMBERS)
    return materialize(met, label, release=label == "members")


def frequent_elements(docs: DataFrame, n: int, rule: Rule, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(names, ranks) of elements that some of the ``n`` ``docs`` have, by name; the rank grows with how many."""

    def count(batches):
        for batch in batches:
            for _, data, offsets in kernels.chunks(batch):
                names, often = np.unique(key_names(kernels.mix(distinct_sets(data, offsets, rule.shingle)[0]), buckets), return_counts=True)
                yield pa.record_batch([pa.array(names), pa.array(often.astype(np.int64))], names=["g", "often"])

    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(-(-n // SAMPLED))) == 0)
    met = some.mapInArrow(kernels.released(count), "g long, often long").groupBy("g").agg(F.sum("often").alias("often"))
    most = met.where(F.col("often") >= OFTEN).orderBy(F.desc("often"), "g").limit(MOST_LATE).toArrow()
    names, often = (most.column(c).to_numpy() for c in ("g", "often"))
    order = np.argsort(names)
    return names[order], np.log2(often[order]).astype(np.int8)


def set_members(docs: DataFrame, rule: Rule, buckets: int, last: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """Members of the lists of ``docs`` (doc_id, text); elements of ``last`` (names, ranks) are posted last."""
    bound = light_bound(rule)

    def late(keys):
        names, ranks = last
        if not len(names):
            return np.zeros(len(keys), np.int8)
        own = key_names(keys, buckets)
        at = np.minimum(np.searchsorted(names, own), len(names) - 1)
        return np.where(names[at] == own, ranks[at], 0)

    def keys_of(batch):
        for rows, data, offsets in kernels.chunks(batch):
            elements, first = distinct_sets(data, offsets, rule.shingle)
            keys = [join_keys(elements[a:b], rule, bound, None if last is None else late) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
            doc = np.repeat(rows.column("doc_id").to_numpy(zero_copy_only=False), [len(k) for k in keys])
            yield np.concatenate(keys) if keys else elements, doc, 0, 0

    return shared_keys(docs, keys_of, buckets, "members" if last is None else "again")


def difference_members(told: DataFrame, buckets: int) -> DataFrame:
    """Members of the lists of early differences; ``scope`` is the document that they differ from.

    ``probe`` tells whether a set with no more differences than its partner meets it here.
    """

    def keys_of(batch):
        # A few rows at a time: each may have thousands of differences.
        for at in range(0, batch.num_rows, 50):
            rows = batch.slice(at, 50)
            apart = rows.column(rows.schema.get_field_index("early"))
            size = np.asarray(apart.value_lengths().fill_null(0), dtype=np.int64)
            flat = apart.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            a, b = (np.repeat(rows.column(rows.schema.get_field_index(c)).to_numpy(zero_copy_only=False), size) for c in ("a", "b"))
            pos = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
            probe = pos <= np.repeat(rows.column(rows.schema.get_field_index("most")).to_numpy(zero_copy_only=False), size) // 2
            # The probe travels as the last bit of the place.
            yield kernels.mix(flat + kernels.mix(a.view(np.uint64) + np.uint64(0x94D049BB133111EB))), b, a, 2 * pos + probe

    met = shared_keys(told.select("a", "b", "most", "early"), keys_of, buckets, "differences")
    return met.select("g", "doc", "scope", F.expr("pos div 2").cast("int").alias("pos"), F.expr("pos % 2").alias("probe"))


def sized(df: DataFrame, rows: int) -> DataFrame:
    """``df`` for the small side of a join: broadcast only while ``rows`` is within the bound."""
    return F.broadcast(df) if rows <= MOST_BROADCAST_IDS else df


def split_lists(members: DataFrame, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(long, short): members with their list's ``size`` and ``pivot``; lists above ``most`` (LONG_LIST) are long.

    Where members have ``probe``, lists without a probe are dropped and the probes are
    counted.  Long lists are few beside their members and are met by broadcast, as far
    as their number allows; what is left for an exchange by list has short lists only.
    """
    most = LONG_LIST if most is None else most
    probes = F.sum("probe") if "probe" in members.columns else F.count("*")
    lists = members.groupBy("g").agg(F.count("*").alias("size"), F.min("doc").alias("pivot"), probes.alias("probes"))
    lists = materialize(lists.where("size > 1 and probes > 0"), "lists")
    large = lists.where(F.col("probes") > most).select("g", "size", "pivot")
    n = large.count()
    long = members.join(sized(large, n), "g")
    small = lists.where(F.col("probes") <= most).select("g", "size", "pivot")
    short = members.join(sized(large.select("g"), n), "g", "left_anti").join(small, "g")
    return materialize(long, "long"), materialize(short, "short")


def pivot_pairs(members: DataFrame) -> DataFrame:
    """(a, b): each document b with the pivot of most of its lists."""
    met = members.where(F.col("pivot") != F.col("doc")).groupBy("doc", "pivot").agg(F.count("*").alias("often"))
    best = F.max_by("pivot", F.struct("often", -F.col("pivot")))
    return met.groupBy(F.col("doc").alias("b")).agg(best.alias("a")).select("a", "b")


def labelled(members: DataFrame, labels: DataFrame, column: str = "doc", name: str = "label") -> DataFrame:
    """``members`` with the component of a document, or the document itself."""
    found = labels.select(F.col("node").alias("_node"), F.col("component").alias("_component"))
    return members.join(found, F.col(column) == F.col("_node"), "left").withColumn(name, F.coalesce("_component", column)).drop("_node", "_component")


def open_lists(told: DataFrame) -> DataFrame:
    """(g) of the lists whose members, (g, label), are in several components."""
    return told.groupBy("g").agg(F.min("label").alias("_low"), F.max("label").alias("_high")).where("_low <> _high").select("g")


def open_entries(long: DataFrame, labels: DataFrame) -> DataFrame:
    """(g, doc, a, pivot): members of open long lists; ``a`` stands for the pivot's component."""
    told = labelled(long, labels)
    left = materialize(open_lists(told), "open")
    met = told.join(sized(left, left.count()), "g")
    return labelled(met, labels, "pivot", "a").select("g", "doc", "a", "pivot")


def first_pairs(entries: DataFrame, load: DataFrame) -> DataFrame:
    """(a, b): the unsettled documents b that are described by a, but for what b may pass over."""
    each = entries.groupBy("doc", "a").count()
    upto = F.sum("count").over(Window.partitionBy("doc").orderBy("count", "a"))
    kept = each.join(load.where("hot > slack").select("doc", "allowance"), "doc").withColumn("upto", upto).where(F.col("upto") > F.col("allowance"))
    return kept.select("a", F.col("doc").alias("b"))


def next_pairs(long: DataFrame, labels: DataFrame) -> DataFrame:
    """(a, b): members b of open long lists of differences with the list's least member a."""
    met = open_entries(long, labels)
    return met.where(F.col("pivot") != F.col("doc")).select(F.col("pivot").alias("a"), F.col("doc").alias("b")).distinct()


def short_pairs(short: DataFrame, columns: tuple[str, ...], labels: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """(g, a, b, a_*, b_*): pairs of one short list that are in different components.

    ``facts`` (scope, doc, *) are met by the members of open lists only.
    """
    told = labelled(short, labels)
    left = told.join(open_lists(told), "g")
    left = (left if facts is None else left.join(facts, ["scope", "doc"])).select("g", "doc", "label", *columns)
    named = lambda x: left.select("g", *[F.col(c).alias(f"{x}_{c}") for c in ("doc", "label", *columns)])
    cross = (F.col("a_doc") < F.col("b_doc")) & (F.col("a_label") != F.col("b_label"))
    return named("a").join(named("b"), "g").where(cross).withColumnRenamed("a_doc", "a").withColumnRenamed("b_doc", "b")


def _sql_spare(n: str, rule: Rule) -> Column:
    """:func:`spare` of a column."""
    return F.expr(f"({n} - ({rule.num} * {n} + {rule.den - 1}) div {rule.den}) div 2")


def loads(entries: DataFrame, short: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """(doc, hot, spare, slack, allowance) of documents in short or open long lists.

    ``hot`` counts a document's ``entries`` in open long lists.  Up to ``slack`` of them it
    is settled by its short lists; beyond, it may pass over ``allowance`` of them.
    """
    seen = entries.select("doc", F.lit(1).alias("hot")).unionByName(short.select("doc", F.lit(0).alias("hot")))
    hot = seen.groupBy("doc").agg(F.sum("hot").alias("hot"))
    size = sets.groupBy(F.col("doc_id").alias("doc")).agg(F.min("n").alias("n"))
    told = hot.join(size, "doc").withColumn("least", F.expr(f"({rule.num} * n + {rule.den - 1}) div {rule.den}"))
    told = told.withColumn("slack", _sql_spare("least", rule))
    return told.select("doc", "hot", _sql_spare("n", rule).alias("spare"), "slack", F.floor(F.col("slack") / 2).alias("allowance"))


def post_again(entries: DataFrame, load: DataFrame, docs: DataFrame, sets: DataFrame, labels: DataFrame, rule: Rule, buckets: int):
    """(entries, load, lists): what is left of open long lists, and each level's (short, load).

    Unsettled documents post among themselves, frequent elements last.  A linking pair
    meets in short lists at the level where either is settled.
    """
    levels, before, live = [], None, docs
    while True:
        open_ = materialize(load.where("hot > slack").select(F.col("doc").alias("doc_id")), "unsettled")
        n = open_.count()
        if not n or (before is not None and 2 * n > before):
            return entries, load, levels
        before, live = n, materialize(live.join(sized(open_, n), "doc_id", "left_semi"), "live")
        long, short = split_lists(set_members(live, rule, buckets, frequent_elements(live, n, rule, buckets)))
        entries = materialize(open_entries(long, labels), "entries")
        load = materialize(loads(entries, short, sets, rule), "loads")
        levels.append((short, load))


def element_pairs(short: DataFrame, load: DataFrame, labels: DataFrame) -> DataFrame:
    """(a, b) that meet often enough in short lists to link."""
    often = short_pairs(short, (), labels).groupBy("a", "b").agg(F.count("*").alias("often"))
    side = lambda x: load.select(F.col("doc").alias(x), F.col("hot").alias(f"{x}_hot"), F.col("spare").alias(f"{x}_spare"))
    met = often.join(side("a"), "a").join(side("b"), "b")
    least = F.least("a_spare", "b_spare") + 1 - F.least("a_hot", "b_hot")
    return met.where(F.col("often") >= least).select("a", "b")


def difference_pairs(short: DataFrame, told: DataFrame, labels: DataFrame, rule: Rule) -> DataFrame:
    """(a, b) that share an early difference and whose differences leave room for a link.

    ``pos`` counts the differences before the shared one, ``apart`` all of a set's
    differences; a linking pair passes at the first difference it shares, where the
    set with fewer differences probes.  Parity sketches of the differences bound how
    far the sets are apart.
    """
    facts = told.select(F.col("a").alias("scope"), F.col("b").alias("doc"), "n", "apart", *_SKETCH)
    met = short_pairs(short, ("n", "apart", "pos", "probe", *_SKETCH), labels, facts)
    n, m, d, e = (F.col(c) for c in ("a_n", "b_n", "a_apart", "b_apart"))
    most = F.floor((n + m) * (rule.den - rule.num) / (rule.den + rule.num))
    far = reduce(Column.__add__, [F.bit_count(F.col(f"a_{c}").bitwiseXOR(F.col(f"b_{c}"))) for c in _SKETCH])
    probing = ((F.col("a_probe") == 1) & (d <= e)) | ((F.col("b_probe") == 1) & (e <= d))
    fits = probing & (n * rule.den >= m * rule.num) & (m * rule.den >= n * rule.num) & (far <= most)
    return met.where(fits & (2 * F.least(d - F.col("a_pos"), e - F.col("b_pos")) >= d + e - most)).select("a", "b").distinct()


def close_pairs(pairs: DataFrame, sets: DataFrame, rule: Rule = CONTRACT) -> DataFrame:
    """The (a, b) whose parity sketches leave a link possible; no linking pair is lost."""
    side = lambda x: sets.select(F.col("doc_id").alias(x), F.col("n").alias(f"{x}_n"), F.col("parity").alias(f"{x}_par"))
    far = F.aggregate(
        F.zip_with("a_par", "b_par", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda acc, d: acc + d
    )
    met = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    return met.where(far * (rule.num + rule.den) <= (F.col("a_n") + F.col("b_n")) * (rule.den - rule.num)).select("a", "b").distinct()


# Comparison of texts.


def hashes_hold(sides: list[kernels.Tokens], words: list[np.ndarray], found: list[tuple], width: int) -> bool:
    """Whether equal hashes mean equal bytes, for all words and shingles of ``sides``."""
    data = np.concatenate([t.data for t in sides])
    base = np.cumsum([0] + [len(t.data) for t in sides])
    starts, ends = (np.concatenate([getattr(t, c) + o for t, o in zip(sides, base[:-1], strict=True)]) for c in ("starts", "ends"))
    flat = np.concatenate(words)
    order = np.argsort(flat, kind="stable")
    i = np.flatnonzero(flat[order][1:] == flat[order][:-1])
    if not kernels.same_bytes(data, starts, ends, order[i], order[i + 1]).all():
        return False
    # Words are told apart by their hashes now; shingles by their words.
    ahead = np.cumsum([0] + [len(w) for w in words])
    at = np.concatenate([s[2] + o for s, o in zip(found, ahead[:-1], strict=True)])
    size = np.concatenate([np.minimum(np.repeat(np.diff(t.first), np.diff(s[1])), width) for t, s in zip(sides, found, strict=True)])
    keys = np.concatenate([s[0] for s in found])
    order = np.argsort(keys, kind="stable")
    i = np.flatnonzero(keys[order][1:] == keys[order][:-1])
    x, y = order[i], order[i + 1]
    same = size[x] == size[y]
    for k in range(width):
        there = same & (k < size[x])
        same[there] = flat[at[x[there]] + k] == flat[at[y[there]] + k]
    return bool(same.all())


def exact_set(text: bytes, width: int) -> set:
    """The shingles of a text themselves."""
    words = text.lower().split()
    return {tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else set()


def _judge_rows(rows: pa.RecordBatch, rule: Rule) -> pa.RecordBatch:
    texts = [kernels.flat(rows.column(rows.schema.get_field_index(c))) for c in ("a_text", "b_text")]
    tokens = [_tokens(*t) for t in texts]
    words = [t.hashes() for t in tokens]
    sides = [word_shingles(w, t.first, rule.shingle) for w, t in zip(words, tokens, strict=True)]
    hold = hashes_hold(tokens, words, sides, rule.shingle)
    wanted = rows.column("long").to_pylist()
    ok, sizes, apart, most, early, sketch = [], [], [], [], [], []
    common = rows.column("common").to_pylist()
    for r in range(rows.num_rows):
        x, y = (np.unique(h[s[r] : s[r + 1]]) for h, s, _ in sides)
        shared = np.isin(y, x, assume_unique=True)
        both = int(shared.sum())
        if hold:
            ok.append(both > 0 and rule.den * both >= rule.num * (len(x) + len(y) - both))
        else:
            p, q = (exact_set(d[o[r] : o[r + 1]].tobytes(), rule.shingle) for d, o in texts)
            ok.append(bool(p & q) and rule.den * len(p & q) >= rule.num * len(p | q))
        sizes.append(len(y))
        apart.append(len(x) + len(y) - 2 * both)
        most.append(most_apart(len(y) + most_partner(len(y), rule), rule))
        told = np.concatenate([y[~shared], x[~np.isin(x, y, assume_unique=True)]]) if wanted[r] else y[:0]
        if wanted[r]:
            late = np.isin(told, np.array(common[r] or [], dtype=np.int64).view(np.uint64))
            told = told[np.lexsort((told, late))]
        early.append(told[: len(told) if wanted[r] == 2 else most[-1] + 1].view(np.int64))
        sketch.append(_parities(told, np.array([0, len(told)]), len(_SKETCH))[0] if wanted[r] else [0] * len(_SKETCH))
    whole = [pa.array(x, pa.int32()) for x in (sizes, apart, most)]
    return pa.record_batch(
        [rows.column("a"), rows.column("b"), pa.array(ok, pa.bool_()), *whole, _lists(early)]
        + [pa.array([x[k] for x in sketch], pa.int64()) for k in range(len(_SKETCH))],
        names=["a", "b", "link", "n", "apart", "most", "early", *_SKETCH],
    )


def judged(pairs: DataFrame, docs: DataFrame, rule: Rule = CONTRACT, describe: int = 0, common: DataFrame | None = None) -> DataFrame:
    """(a, b, link, n, apart, most, early, sketch) by the texts themselves.

    ``n`` is the size of b's set, ``apart`` that of the symmetric difference, ``most``
    how far a partner of b can be from it.  ``early``, with ``describe`` 1, has the first
    differences, those of ``common`` (a, common) last; with 2 it has all.
    """

    def judge(batches):
        for batch in batches:
            for some, _, _ in kernels.chunks(batch, "a_text", JUDGED_BYTES):
                for rows, _, _ in kernels.chunks(some, "b_text", JUDGED_BYTES):
                    yield _judge_rows(rows, rule)

    n = pairs.count()
    # A document that very many are compared with goes to several tasks.
    heads = pairs.groupBy("a").agg((F.count("*") / PER_HEAD).cast("int").alias("more"))
    many = materialize(heads.where("more > 0").select(F.col("a").alias("_a"), "more"), "heads")
    n_many = many.count()
    met = pairs.join(sized(many, n_many), F.col("a") == F.col("_a"), "left").withColumn(
        "part", F.pmod(F.xxhash64("b"), F.coalesce("more", F.lit(0)) + 1).cast("int")
    ).select("a", "b", "part")
    parts = heads.select("a", F.explode(F.sequence(F.lit(0), "more")).alias("part"))
    texts = docs.select(F.col("doc_id").cast("long").alias("_doc"), F.coalesce("text", F.lit("")).alias("_text"))
    text = lambda x: texts.select(F.col("_doc").alias(x), F.col("_text").alias(f"{x}_text"))
    # Pairs are carried to b's text, then both to a's: with few pairs only the second moves texts.
    first = text("b").join(sized(met, n), "b")
    second = text("a").join(sized(parts, n), "a")
    late = F.lit(None).cast("array<long>").alias("common")
    if common is not None:
        second, late = second.join(common, "a", "left"), "common"
    full = first.join(second, ["a", "part"]).select("a", "b", F.lit(describe).alias("long"), late, "a_text", "b_text")
    return full.mapInArrow(kernels.released(judge), f"a long, b long, link boolean, n int, apart int, most int, early array<long>, {', '.join(f'{c} long' for c in _SKETCH)}")


def common_differences(pairs: DataFrame, docs: DataFrame, rule: Rule) -> DataFrame:
    """(a, common): the differences that a share of a few documents around ``a`` have.

    They are put last in the order of differences.  Any order serves; this one keeps what
    a template has in common from pairing all its pages.
    """
    place = F.row_number().over(Window.partitionBy("a").orderBy(F.xxhash64("b"), "b"))
    few = pairs.withColumn("_place", place).where(F.col("_place") <= FEW).select("a", "b")
    told = judged(materialize(few, "few"), docs, rule, 2).select("a", F.explode("early").alias("e"))
    often = told.groupBy("a", "e").count().where(F.col("count") >= OFTEN)
    return materialize(often.groupBy("a").agg(F.collect_list("e").alias("common")), "common")


def links_around(round_: DataFrame, labels: DataFrame, links: DataFrame, slim: DataFrame, rule: Rule, buckets: int):
    """(labels, links, candidates): what open long lists add, turn by turn, from the pairs (a, b) on."""
    round_ = materialize(round_, "pairs")
    candidates = []
    while round_.limit(1).count():
        told = materialize(judged(round_, slim, rule, 1, common_differences(round_, slim, rule)), "judged")
        links = links.unionByName(told.where("link and a <> b").select("a", "b"))
        labels = components(materialize(links, "links"))
        members = difference_members(told.where("apart > 0"), buckets)
        most = LONG_LIST * LONGER ** (len(candidates) + 1)
        far, near = split_lists(members, most)
        candidates.append(materialize(difference_pairs(near, told, labels, rule), "pairs"))
        round_ = materialize(next_pairs(far, labels), "pairs")
    return labels, links, candidates


def jaccard_components(docs: DataFrame, rule: Rule = CONTRACT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs``, linked by ``rule``."""
    small_batches(docs.sparkSession)
    slim = docs.select("doc_id", "text")
    size = slim.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets = prime(max(LEAST_BUCKETS, size // BUCKET_BYTES))
    sets = materialize(build_sets(slim, rule), "sets")
    usable = sets.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    classes = materialize(usable.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep")), "classes")
    reps = classes.select(F.col("rep").alias("doc_id")).distinct()
    folded = materialize(usable.select("doc_id").distinct().join(reps, "doc_id", "left_anti"), "folded")
    n_folded = folded.count()
    # Folded documents are left out by the shorter way.
    chosen = slim.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    chosen = chosen.join(F.broadcast(folded), "doc_id", "left_anti") if n_folded <= MOST_BROADCAST_IDS else chosen.join(reps, "doc_id", "left_semi")
    long, short = split_lists(set_members(chosen, rule, buckets))

    # Round one: every document against the pivot it meets most.
    first = materialize(pivot_pairs(long.unionByName(short)), "pairs")
    near = materialize(close_pairs(first, usable, rule), "pairs")
    links = materialize(judged(near, slim, rule), "judged").where("link").select("a", "b")
    labels = components(links)

    # Round two: long lists that are still open.
    entries = materialize(open_entries(long, labels), "entries")
    load = materialize(loads(entries, short, usable, rule), "loads")
    levels = [(short, load)]
    entries, load, again = post_again(entries, load, chosen, usable, labels, rule, buckets)
    levels += again
    labels, links, candidates = links_around(first_pairs(entries, load), labels, links, slim, rule, buckets)

    # Round three: pairs that short lists leave open between components.
    rest = reduce(DataFrame.unionByName, [*candidates, *(element_pairs(*lists, labels) for lists in levels)]).distinct()
    rest = materialize(close_pairs(rest, usable, rule), "pairs")
    more = judged(rest, slim, rule).where("link").select("a", "b")

    # Rows of one doc_id with different texts are one document.
    shared = usable.select("doc_id", "k1", "k2").distinct()
    several = shared.groupBy("doc_id").count().where(F.col("count") > 1).select("doc_id")
    own = shared.join(several, "doc_id", "left_semi").join(classes, ["k1", "k2"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    links = materialize(links.unionByName(more).unionByName(own.where("a <> b")).distinct(), "links")
    labels = components(links).select(F.col("node").alias("_node"), "component")

    placed = sets.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "k1", "k2").join(
        classes.select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), "rep"),
        (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2")) & F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0),
        "left",
    )
    return placed.join(labels, F.col("rep") == F.col("_node"), "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "rep", "doc_id").alias("component_id")
    )
