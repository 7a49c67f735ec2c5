"""Suffix-array dedup by prefix-free parsing: drop every repeated run of bytes.

A byte goes when some ``LENGTH``-byte string that covers it also starts earlier
in the corpus (smaller ``doc_id``, or the same document at an earlier place).
Strings are judged on the input.

1. *Parse.*  Each document is cut into phrases by rolling-hash triggers
   (:mod:`tessera.llm.parse`).  A phrase runs ``LENGTH - 1`` bytes past its last
   window start, so all its windows lie inside it: phrases carry the context that
   the parse's own order would otherwise have to supply.
2. *Dictionary.*  Phrases meet by trigger and content.  Every occurrence of a
   dictionary phrase but the first is repeated as a whole.  First occurrences stay
   in question where another phrase with the same trigger shares enough bytes for
   a common window; four one-byte checks a phrase tell which window ranges can.
3. *Order.*  The windows in question are ranked by the dictionary's suffix array
   cut off at ``LENGTH``: equal ranks are equal strings.  The first of each class
   stays, the rest is repeated.  Classes of different parts of the corpus meet
   under two independent 61-bit hashes of the window.
4. *Cut.*  Documents meet their repeated windows and lose the covered bytes.

Within a task, occurrences that the task itself shows to be repeated are settled
on the spot and travel as facts of their document; what meets by trigger is one
row a phrase, and at most 1,024 phrases a trigger and task.  So a passage in a
third of all documents does not gather anywhere.

Defined results: a null text is empty; texts under ``LENGTH`` bytes keep all; of
rows that share a ``doc_id``, the one whose text's hash is less counts as earlier;
a null ``doc_id`` comes first; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import kernels, parse
from tessera.llm.common import materialize, prime, small_batches

LENGTH = 100
#: Phrases that a task gathers before it settles what it can.
GATHER = 300_000
#: Text bytes that meet in one group, on average, and the least number of groups.
GROUP_BYTES, LEAST_GROUPS = 6 << 20, 61
#: Window offsets before a trigger fall into this many ranges, each with its own check.
RANGES = 4
_WIDTH = -(-(LENGTH - parse.GRAM + 1) // RANGES)

_PHRASE = np.dtype(
    [("key", "u8"), ("content", "u8"), ("again", "u8"), ("doc", "i8"), ("low", "u4"), ("size", "u1"), ("off", "u1"), ("sub", "u4"), ("mask", "u1")]
)
_WINDOW = np.dtype([("hash", "u8"), ("again", "u8"), ("doc", "i8"), ("start", "u4")])
REPEATED = 0x80


def _pack(rows: np.ndarray) -> bytes:
    """Columns one after the other, lightly compressed."""
    return zlib.compress(b"".join(np.ascontiguousarray(rows[name]).tobytes() for name in rows.dtype.names), 1)


def _unpack(raw: bytes, kind: np.dtype) -> np.ndarray:
    flat = zlib.decompress(raw)
    n, at = len(flat) // kind.itemsize, 0
    out = np.zeros(n, dtype=kind)
    for name in kind.names:
        part = kind[name]
        out[name] = np.frombuffer(flat, dtype=part, count=n, offset=at)
        at += n * part.itemsize
    return out


def _facts(rows: np.ndarray, status: np.ndarray) -> np.ndarray:
    """Phrase facts in one long: low, size, off, status."""
    return (rows["low"].astype(np.int64) << 24) | (rows["size"].astype(np.int64) << 16) | (rows["off"].astype(np.int64) << 8) | status


def _range_checks(p: parse.Phrases, rolling: parse.Rolling) -> np.ndarray:
    """One byte for each range of window offsets: a hash of the bytes all its windows hold."""
    out = np.zeros(len(p.low), dtype=np.uint32)
    least, most = p.trigger - p.high, p.trigger - p.low
    for r in range(RANGES):
        low, high = r * _WIDTH, min((r + 1) * _WIDTH, LENGTH - parse.GRAM + 1) - 1
        there = (least <= high) & (most >= low)
        start = np.where(there, p.trigger - low, 0)
        byte = rolling.of(start, np.where(there, LENGTH - high + low, 0)) >> np.uint64(56)
        out |= (np.where(there, byte, 0).astype(np.uint32)) << np.uint32(8 * r)
    return out


def _shared_ranges(rows: np.ndarray) -> np.ndarray:
    """Mask of ranges whose check another content of the same trigger has; ``rows`` sorted by key, one row a content."""
    mask = np.zeros(len(rows), dtype=np.uint8)
    least = rows["off"].astype(np.int64) - rows["size"] + 1
    for r in range(RANGES):
        low, high = r * _WIDTH, (r + 1) * _WIDTH - 1
        there = (least <= high) & (rows["off"] >= low)
        at = np.flatnonzero(there)
        check = (rows["sub"][at] >> np.uint32(8 * r)) & np.uint32(255)
        order = np.lexsort((check, rows["key"][at]))
        k, c = rows["key"][at][order], check[order]
        same = (k[1:] == k[:-1]) & (c[1:] == c[:-1])
        hit = np.zeros(len(at), dtype=bool)
        hit[1:] |= same
        hit[:-1] |= same
        mask[at[order[hit]]] |= np.uint8(1 << r)
    return mask


def _settle(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first occurrence of each phrase, by key; their range masks; the repeated rest)."""
    order = np.lexsort((rows["low"], rows["doc"], rows["again"], rows["content"], rows["key"]))
    rows = rows[order]
    first = np.ones(len(rows), dtype=bool)
    first[1:] = np.logical_or.reduce([rows[c][1:] != rows[c][:-1] for c in ("key", "content", "again")])
    reps = rows[first]
    # What other rows of the phrase knew holds for the first one too.
    known = np.bitwise_or.reduceat(rows["mask"], np.flatnonzero(first)) if len(rows) else rows["mask"]
    return reps, _shared_ranges(reps) | known, rows[~first]


def _spokesmen(reps: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Which phrases must meet those of other tasks.

    A trigger with few phrases sends all.  One with many sends, for each range,
    one phrase of each check value; the others are in question in all ranges
    anyway.
    """
    if not len(reps):
        return np.zeros(0, dtype=bool)
    start = np.ones(len(reps), dtype=bool)
    start[1:] = reps["key"][1:] != reps["key"][:-1]
    group = np.cumsum(start) - 1
    send = np.bincount(group)[group] <= 8
    least = reps["off"].astype(np.int64) - reps["size"] + 1
    for r in range(RANGES):
        check = (reps["sub"] >> np.uint32(8 * r)) & np.uint32(255)
        there = (least <= (r + 1) * _WIDTH - 1) & (reps["off"] >= r * _WIDTH)
        name = np.where(there, check, 256)
        order = np.lexsort((name, group))
        lead = np.ones(len(order), dtype=bool)
        lead[1:] = (group[order][1:] != group[order][:-1]) | (name[order][1:] != name[order][:-1])
        send[order[lead]] = True
    return send


def _rows_of(rows: np.ndarray, bucket: np.ndarray):
    """(bucket, its rows) for each bucket that has any."""
    order = np.argsort(bucket, kind="stable")
    rows, bucket = rows[order], bucket[order]
    cut = np.flatnonzero(np.diff(bucket)) + 1
    for part, b in zip(np.split(rows, cut), bucket[np.concatenate([[0], cut])] if len(bucket) else (), strict=False):
        if len(part):
            yield int(b), part


def _parse_documents(groups: int):
    """Mapper: phrases of whole documents, by trigger bucket; what the task can settle, as facts."""

    def flush(held: list[np.ndarray]):
        reps, mask, rest = _settle(np.concatenate(held))
        send = _spokesmen(reps, mask)
        reps["mask"] = mask
        told = np.concatenate([rest, reps[~send]])
        status = np.concatenate([np.full(len(rest), REPEATED), np.full((~send).sum(), (1 << RANGES) - 1)])
        rows = [(b, _pack(part), None, None) for b, part in _rows_of(reps[send], (reps[send]["key"] % np.uint64(groups)).astype(np.int64))]
        spread = np.arange(len(told)) * groups // max(1, len(told))
        facts = np.zeros(len(told), dtype=[("doc", "i8"), ("fact", "i8")])
        facts["doc"], facts["fact"] = told["doc"], _facts(told, status)
        rows += [(b, None, part["doc"].tobytes(), part["fact"].tobytes()) for b, part in _rows_of(facts, spread)]
        cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
        return pa.record_batch(
            [pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], names=["bucket", "phrases", "docs", "facts"]
        )

    def run(batches):
        held, n = [], 0
        for batch in batches:
            for rows, data, offsets in kernels.chunks(batch):
                rolling = parse.Rolling(data)
                p = parse.phrases(data, offsets, rolling, LENGTH)
                out = np.zeros(len(p.low), dtype=_PHRASE)
                out["key"], out["content"], out["again"] = p.key, p.content, p.again
                out["doc"] = rows.column("rid").to_numpy(zero_copy_only=False)[p.doc]
                out["low"] = p.low - offsets[p.doc]
                out["size"], out["off"] = p.high - p.low + 1, p.trigger - p.low
                out["sub"] = _range_checks(p, rolling)
                held.append(out)
                n += len(out)
                if n >= GATHER:
                    yield flush(held)
                    held, n = [], 0
        if n:
            yield flush(held)

    return run


def _meet_phrases(table: pa.Table) -> pa.Table:
    """Reducer: phrases of one trigger bucket become facts; facts pass."""
    docs, facts = [], []
    packed = [_unpack(x, _PHRASE) for x in table.column("phrases").to_pylist() if x is not None]
    if packed:
        reps, mask, rest = _settle(np.concatenate(packed))
        asked = mask > 0
        docs += [rest["doc"], reps["doc"][asked]]
        facts += [_facts(rest, np.full(len(rest), REPEATED)), _facts(reps[asked], mask[asked].astype(np.int64))]
    for d, f in zip(table.column("docs").to_pylist(), table.column("facts").to_pylist(), strict=True):
        if d is not None:
            docs.append(np.frombuffer(d, dtype=np.int64))
            facts.append(np.frombuffer(f, dtype=np.int64))
    join = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64))
    return pa.table({"rid": join(docs), "fact": join(facts)})


def _covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Boolean mask of the bytes in any of the ranges."""
    step = np.bincount(starts, minlength=n + 1) - np.bincount(ends, minlength=n + 1)
    return np.cumsum(step[:n]) > 0


def _result(rid: int, data: np.ndarray, gone: np.ndarray) -> tuple:
    spans = int(np.count_nonzero(gone[1:] & ~gone[:-1]) + (len(gone) > 0 and bool(gone[0])))
    kept = data[~gone] if spans else data
    return rid, len(data), int(gone.sum()), spans, hashlib.sha256(kept.tobytes()).hexdigest()


_DONE = [("rid", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
_DONE_SQL = "rid long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _results(rows: list[tuple]) -> list[pa.Array]:
    cols = list(zip(*rows, strict=True)) or [()] * len(_DONE)
    return [pa.array(c, kind) for c, (_, kind) in zip(cols, _DONE, strict=True)]


def _by_document(facts: pa.Table, name: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(facts sorted by document, first fact of each of ``ids`` and the end)."""
    rid = facts.column("rid").to_numpy()
    fact = facts.column(name).to_numpy()
    order = np.argsort(rid, kind="stable")
    rid, fact = rid[order], fact[order]
    return fact, np.stack([np.searchsorted(rid, ids), np.searchsorted(rid, ids, side="right")], axis=1)


def _order_windows(groups: int):
    """Reducer: documents with their facts.  Settled ones end here; the windows in question go on."""

    def run(docs: pa.Table, facts: pa.Table) -> pa.Table:
        ids = docs.column("rid").to_numpy()
        found, span = _by_document(facts, "fact", ids)
        done, wait, asked, books = [], [], [], []
        at = 0
        for batch in docs.combine_chunks().to_batches():
            for rows, data, offsets in kernels.chunks(batch):
                rolling = None
                for d in range(rows.num_rows):
                    own = data[offsets[d] : offsets[d + 1]]
                    mine = found[span[at + d, 0] : span[at + d, 1]]
                    low, size, off, status = mine >> 24, (mine >> 16) & 255, (mine >> 8) & 255, mine & 255
                    whole = status == REPEATED
                    gone = _covered(len(own), low[whole], low[whole] + size[whole] - 1 + LENGTH)
                    rid = int(ids[at + d])
                    if whole.all():
                        done.append(_result(rid, own, gone))
                        continue
                    if rolling is None:
                        rolling, second = parse.Rolling(data), parse.Rolling(data, 1)
                    low, size, off, status = (x[~whole] for x in (low, size, off, status))
                    start = np.repeat(low, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                    trigger = np.repeat(low + off, size)
                    keep = (np.repeat(status, size) >> ((trigger - start) // _WIDTH)) & 1 > 0
                    start = start[keep]
                    w = np.zeros(len(start), dtype=_WINDOW)
                    base = int(offsets[d])
                    w["hash"], w["again"] = rolling.of(start + base, LENGTH), second.of(start + base, LENGTH)
                    w["doc"], w["start"] = rid, start
                    asked.append(w)
                    books.append(_dictionary(own, start))
                    wait.append((rid, own, gone))
                at += rows.num_rows
        windows = np.concatenate(asked) if asked else np.zeros(0, dtype=_WINDOW)
        again = _local_repeats(windows, books)
        more = windows[again]
        mine = {rid: more["start"][more["doc"] == rid] for rid in np.unique(more["doc"]).tolist()} if len(more) else {}
        rows = windows[~again]
        out = [(2, None, None, b, _pack(part), None) for b, part in _rows_of(rows, (rows["hash"] % np.uint64(groups)).astype(np.int64))]
        for rid, own, gone in wait:
            s = mine.get(rid, np.zeros(0, np.int64)).astype(np.int64)
            known = gone | _covered(len(own), s, s + LENGTH) if len(s) else gone
            out.append((1, rid, zlib.compress(own.tobytes(), 1), None, zlib.compress(np.packbits(known).tobytes(), 1), None))
        cols = list(zip(*out, strict=True)) or [()] * 6
        tail = pa.table(
            {
                "kind": pa.array(cols[0], pa.int32()),
                "rid": pa.array(cols[1], pa.int64()),
                "text": pa.array(cols[2], pa.binary()),
                "bucket": pa.array(cols[3], pa.int32()),
                "payload": pa.array(cols[4], pa.binary()),
                **{name: pa.nulls(len(out), kind) for name, kind in _DONE[1:]},
            }
        )
        ended = _results(done)
        head = pa.table(
            {
                "kind": pa.array([0] * len(done), pa.int32()),
                "rid": ended[0],
                "text": pa.nulls(len(done), pa.binary()),
                "bucket": pa.nulls(len(done), pa.int32()),
                "payload": pa.nulls(len(done), pa.binary()),
                **{name: col for (name, _), col in zip(_DONE[1:], ended[1:], strict=True)},
            }
        )
        return pa.concat_tables([head, tail])

    return run


def _dictionary(own: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes that the windows at ``start`` cover, and where each window begins in them."""
    need = _covered(len(own), start, start + LENGTH)
    place = np.cumsum(need) - need
    return own[need], place[start]


def _local_repeats(windows: np.ndarray, books: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Which windows occur earlier among ``windows``, by ranks in the dictionary's suffix array."""
    if not len(windows):
        return np.zeros(0, dtype=bool)
    base = np.cumsum([0] + [len(b) for b, _ in books])
    rank = parse.prefix_ranks(np.concatenate([b for b, _ in books]), LENGTH)
    place = np.concatenate([p + o for (_, p), o in zip(books, base[:-1], strict=True)])
    name = rank[place]
    order = np.lexsort((windows["start"], windows["doc"], name))
    again = np.zeros(len(windows), dtype=bool)
    again[order[1:]] = name[order[1:]] == name[order[:-1]]
    return again


def _meet_windows(table: pa.Table) -> pa.Table:
    """Reducer: windows of one hash bucket; all but the first of a class are repeated."""
    rows = np.concatenate([_unpack(x, _WINDOW) for x in table.column("payload").to_pylist()])
    order = np.lexsort((rows["start"], rows["doc"], rows["again"], rows["hash"]))
    rows = rows[order]
    again = np.zeros(len(rows), dtype=bool)
    again[1:] = (rows["hash"][1:] == rows["hash"][:-1]) & (rows["again"][1:] == rows["again"][:-1])
    return pa.table({"rid": pa.array(rows["doc"][again]), "start": pa.array(rows["start"][again].astype(np.int64))})


def _cut_documents(docs: pa.Table, starts: pa.Table) -> pa.Table:
    """Reducer: waiting documents with their repeated windows."""
    ids = docs.column("rid").to_numpy()
    found, span = _by_document(starts, "start", ids)
    out = []
    for d, (text, known) in enumerate(zip(docs.column("text").to_pylist(), docs.column("payload").to_pylist(), strict=True)):
        own = np.frombuffer(zlib.decompress(text), dtype=np.uint8)
        s = found[span[d, 0] : span[d, 1]]
        gone = np.unpackbits(np.frombuffer(zlib.decompress(known), dtype=np.uint8), count=len(own)).astype(bool)
        out.append(_result(int(ids[d]), own, gone | _covered(len(own), s, s + LENGTH)))
    return pa.table(dict(zip([n for n, _ in _DONE], _results(out), strict=True)))


def _ordered(docs: DataFrame) -> tuple[DataFrame, bool]:
    """(rid, doc_id, text) with a unique rid in document order, and whether rid is doc_id itself."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    told = rows.agg(F.count("*").alias("n"), F.count("doc_id").alias("named")).first()
    clash = rows.groupBy("doc_id").count().where(F.col("count") > 1).limit(1).count()
    if told["n"] == told["named"] and not clash:
        return rows.withColumn("rid", F.col("doc_id")), True
    turn = rows.orderBy(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text")
    return materialize(turn.withColumn("rid", F.monotonically_increasing_id()), "ordered"), False


def repeated_bytes(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row of ``docs``."""
    small_batches(docs.sparkSession)
    rows, unique = _ordered(docs)
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    groups = prime(max(LEAST_GROUPS, size // GROUP_BYTES))
    sent = rows.select("rid", "text").mapInArrow(kernels.released(_parse_documents(groups)), "bucket int, phrases binary, docs binary, facts binary")
    # Written tables between the steps: each step's shuffle files go before the next one's come.
    facts = materialize(sent.groupBy("bucket").applyInArrow(_meet_phrases, "rid long, fact long"), "facts", release=True)
    home = lambda df: df.withColumn("home", F.pmod("rid", F.lit(groups)).cast("int"))
    kinds = f"kind int, rid long, text binary, bucket int, payload binary, {_DONE_SQL.split(', ', 1)[1]}"
    order = _order_windows(groups)
    first = (
        home(rows.select("rid", "text"))
        .groupBy("home")
        .cogroup(home(facts).groupBy("home"))
        .applyInArrow(order, kinds)
    )
    first = materialize(first, "ordered-windows", release=True)
    starts = first.where("kind = 2").select("bucket", "payload").groupBy("bucket").applyInArrow(_meet_windows, "rid long, start long")
    wait = home(first.where("kind = 1").select("rid", "text", "payload"))
    last = wait.groupBy("home").cogroup(home(starts).groupBy("home")).applyInArrow(_cut_documents, _DONE_SQL)
    done = first.where("kind = 0").select(*[n for n, _ in _DONE]).unionByName(last)
    told = done.withColumnRenamed("rid", "doc_id") if unique else done.join(rows.select("rid", "doc_id"), "rid")
    return told.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
