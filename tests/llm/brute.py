"""Brute-force versions that the operators are held against."""

from __future__ import annotations

import hashlib
import re

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def repeated(docs: list[tuple[int, str | None]], length: int = 100) -> dict:
    """doc_id -> (n_bytes, n_removed, n_spans, kept_sha256)."""
    seen, out = set(), {}
    for name, text in sorted(docs, key=lambda d: d[0]):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - length + 1):
            part = raw[k : k + length]
            if part in seen:
                gone[k : k + length] = b"\1" * length
            seen.add(part)
        kept = bytes(c for c, g in zip(raw, gone, strict=True) if not g)
        spans = sum(1 for k in range(len(raw)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[name] = (len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def shingle_set(text: str | None) -> frozenset:
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if len(words) < 3:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(zip(words, words[1:], words[2:], strict=False))


def jaccard(docs: list[tuple[int, str | None]]) -> dict:
    """doc_id -> (n_shingles, component_id) over all pairs."""
    sets = {d: shingle_set(t) for d, t in docs}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    names = sorted(sets)
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 90 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in names}


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def contamination(docs: list[tuple[int, str | None]], items: list[tuple[int, str | None]], width: int = 10) -> dict:
    """doc_id -> (n_words, n_hit, n_items, items_sha256, contaminated)."""
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(0, len(w) - width) + 1) if w else ():
            windows.setdefault(tuple(w[i : i + width]), set()).add(item)
    out = {}
    for name, text in docs:
        w, hit, found = words(text), set(), set()
        for window, names in windows.items():
            for i in range(len(w) - len(window) + 1):
                if tuple(w[i : i + len(window)]) == window:
                    hit.update(range(i, i + len(window)))
                    found |= names
        told = ",".join(sorted(map(str, found)))
        out[name] = (len(w), len(hit), len(found), hashlib.sha256(told.encode()).hexdigest(), bool(hit))
    return out


def near_terms(docs: list[tuple[int, str | None]], items: list[tuple[int, str | None]], width: int = 10) -> dict:
    """doc_id -> how many pairs of the two rarest terms of a window stand within ``width`` words."""
    counts = {}
    for _, text in docs:
        for w in words(text):
            counts[w] = counts.get(w, 0) + 1
    pairs = set()
    for _, text in items:
        w = words(text)
        for i in range(max(0, len(w) - width) + 1) if w else ():
            part = w[i : i + width]
            if all(t in counts for t in part):
                best = sorted((counts[t], k, t) for k, t in enumerate(part))[:2]
                if len(best) == 2 and best[0][2] != best[1][2]:
                    pairs.add(tuple(sorted((best[0][2], best[1][2]))))
    out = {}
    for name, text in docs:
        at = {}
        for k, t in enumerate(words(text)):
            at.setdefault(t, []).append(k)
        out[name] = sum(any(abs(p - q) < width for p in at.get(a, ()) for q in at.get(b, ())) for a, b in pairs)
    return out
