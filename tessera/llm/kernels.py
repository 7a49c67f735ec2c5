"""Array kernels over the UTF-8 bytes of whole Arrow text columns.

Everything works on one flat byte array with document offsets, so a batch costs a
few vector passes and no Python loop over characters.  Chunks bound the memory;
a single longer document is a chunk of its own.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Text bytes handled at once.
CHUNK_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_MASK = (1 << 64) - 1
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _byte_values() -> np.ndarray:
    """One fixed pseudo-random odd value for each byte."""
    out, x = [], 0x243F6A8885A308D3
    for _ in range(256):
        x = (x * 6364136223846793005 + 1442695040888963407) & _MASK
        out.append((x ^ (x >> 29)) | 1)
    return np.array(out, dtype=np.uint64)


BYTE_VALUES = _byte_values()
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Words of letters, digits and anything outside ASCII.
WORD_BYTES = np.zeros(256, dtype=bool)
WORD_BYTES[48:58] = WORD_BYTES[65:91] = WORD_BYTES[97:123] = WORD_BYTES[128:] = True
#: Anything but ASCII white space.
SOLID_BYTES = np.ones(256, dtype=bool)
SOLID_BYTES[[32, 9, 10, 11, 12, 13]] = False

_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    held = _powers.get(name)
    if held is None or len(held) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        held = np.full(size, base, dtype=np.uint64)
        held[0] = 1
        held = _powers[name] = np.cumprod(held, dtype=np.uint64)
    return held[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batch: pa.RecordBatch, text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut a batch into row ranges of about ``limit`` text bytes: (rows, bytes, offsets)."""
    data, offsets = flat(batch.column(batch.schema.get_field_index(text)))
    row, n = 0, batch.num_rows
    while row < n:
        upto = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
        upto = min(upto, n)
        yield batch.slice(row, upto - row), data[offsets[row] : offsets[upto]], offsets[row : upto + 1] - offsets[row]
        row = upto


def give_back() -> None:
    """Hand freed memory back to the system, so that waiting workers stay small."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def released(run: Callable) -> Callable:
    """A batch function that gives memory back at the end of its task."""

    def wrapped(batches):
        yield from run(batches)
        give_back()

    return wrapped


def lanes_at(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on as one little-endian number; zeros follow the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), np.dtype("<u8"), padded, strides=(1,))


#: Keeps the first k bytes of a lane.
_LANE_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of the bytes of each range.

    Ranges are read eight bytes at a time and every step is mixed, so no structure
    of the bytes cancels, as it can in polynomials modulo a power of two.
    """
    size = ends - starts
    out = mix(size.astype(np.uint64) * _BASE + np.uint64(seed))
    if not len(size):
        return out
    lanes = lanes_at(data)
    order = np.argsort(-size, kind="stable") if int(size.max()) > 8 else np.arange(len(size))
    falling = -size[order]
    k = 0
    while True:
        left = int(np.searchsorted(falling, -8 * k)) if k else int(np.count_nonzero(size)) if int(size.max()) > 8 else len(size)
        if not left:
            return out
        at = order[:left]
        lane = lanes[starts[at] + 8 * k] & _LANE_MASK[np.clip(size[at] - 8 * k, 0, 8)]
        out[at] = mix((out[at] ^ lane) + np.uint64((k + 1) * 0x9FB21C651E98DF25 & _MASK))
        k += 1
        if 8 * k >= -int(falling[0]):
            return out


def same_bytes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether ranges ``i`` and ``j`` hold the same bytes, pair by pair."""
    size = (ends - starts)[i]
    same = size == (ends - starts)[j]
    lanes = lanes_at(data)
    k, at = 0, np.flatnonzero(same)
    while len(at):
        mask = _LANE_MASK[np.clip(size[at] - 8 * k, 0, 8)]
        equal = (lanes[starts[i[at]] + 8 * k] & mask) == (lanes[starts[j[at]] + 8 * k] & mask)
        same[at[~equal]] = False
        k += 1
        at = at[equal]
        at = at[size[at] > 8 * k]
    return same


class Tokens:
    """The words of a chunk: byte ranges, document numbers and hashes.

    ``lower`` folds A-Z and the Latin-1 capitals; ``"ascii"`` folds A-Z only.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, word: np.ndarray = WORD_BYTES, lower: bool | str = True):
        self.offsets = offsets
        inside = word[data]
        n = len(data)
        first = np.zeros(n + 1, dtype=bool)
        first[offsets] = True
        start = inside.copy()
        if n:
            start[1:] &= ~inside[:-1] | first[1:n]
        stop = inside.copy()
        if n:
            stop[:-1] &= ~inside[1:] | first[1:n]
        self.starts = np.flatnonzero(start)
        self.ends = np.flatnonzero(stop) + 1
        #: Tokens of document d are first[d] to first[d + 1].
        self.first = np.searchsorted(self.starts, offsets)
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        if lower is True and n:
            # Latin-1 capitals (two bytes, 0xC3 first) fold as A-Z do.
            capital = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
            if capital.any():
                data = data.copy()
                data[1:][capital] += 0x20
        self.data = LOWER[data] if lower else data

    def hashes(self, most: int | None = None) -> np.ndarray:
        """A 64-bit hash of each word, or of its first ``most`` bytes."""
        ends = self.ends if most is None else np.minimum(self.ends, self.starts + most)
        return span_hashes(self.data, self.starts, ends)


def grams(data: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Bucket of each byte ``n``-gram (n up to 8): entry i covers bytes i to i + n."""
    count = max(0, len(data) - n + 1)
    packed = np.zeros(count, dtype=np.uint64)
    for k in range(n):
        packed = (packed << np.uint64(8)) | data[k : k + count]
    packed = (packed + np.uint64(n)) * _BASE
    packed ^= packed >> np.uint64(32)
    packed *= np.uint64(0xD6E8FEB86659FD93)
    return (packed >> np.uint64(64 - bits)).astype(np.int64)


def segment_sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of rows starts[i] to ends[i] of a 1-d or 2-d array; empty ranges give 0."""
    sums = np.zeros((len(values) + 1, *values.shape[1:]))
    np.cumsum(values, axis=0, out=sums[1:])
    ends = np.maximum(ends, starts)
    return sums[ends] - sums[starts]
