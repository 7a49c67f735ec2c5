"""Porter's stemmer (1980, with the widely used extensions) from one rule table.

The table drives two evaluators: :func:`stem_word` for a few query words on the
driver and for the tokens of documents (:func:`stems`), and :func:`stem_layers`, SQL
select layers for a whole vocabulary.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Irregular words.
IRREGULAR = {
    "skies": "sky", "sky": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news",
    "innings": "inning", "inning": "inning", "outings": "outing", "outing": "outing",
    "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed",
    "exceed": "exceed", "succeed": "succeed",
}

_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
POSITIVE = f"^({_C})?{_V}{_C}"
ABOVE_ONE = f"^({_C})?{_V}{_C}{_V}{_C}"
EXACTLY_ONE = f"^({_C})?{_V}{_C}({_V})?$"
HAS_VOWEL = "^([^aeiou][^aeiouy]*)?[aeiouy]"
SHORT_END = "([^aeiou][aeiouy][^aeiouwxy]$)|(^[aeiouy][^aeiouy]$)"
DOUBLE = r"(bb|cc|dd|ff|gg|hh|jj|kk|mm|nn|pp|qq|rr|tt|vv|ww|xx|yy)$"

# Suffixes in the order they are tried, and what replaces them.
STEP_2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"),
    ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"),
    ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"),
    ("biliti", "ble"), ("fulli", "ful"), ("logi", "log"),
)
STEP_3 = (
    ("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""),
)
STEP_4 = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate",
    "iti", "ous", "ive", "ize",
)


class _Sql:
    """SQL text over a column; ``regex`` names the dialect's match function."""

    def __init__(self, regex: str):
        self.regex = regex

    def ends(self, w: str, suffix: str) -> str:
        return f"{w} LIKE '%{suffix}'"

    def cut(self, w: str, n: int) -> str:
        return f"substr({w}, 1, length({w}) - {n})" if n else w

    def like(self, x: str, pattern: str) -> str:
        return f"{self.regex}({x}, '{pattern}')"


def _cases(rules: list[tuple[str, str]], otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in rules) + f" ELSE {otherwise} END"


def _steps(sql: _Sql) -> list[str]:
    """One expression over ``w`` for each step, applied in turn."""
    e, cut, like = sql.ends, sql.cut, sql.like
    one_a = _cases(
        [
            (f"length(w) = 4 AND {e('w', 'ies')}", cut("w", 1)),
            (e("w", "sses"), cut("w", 2)),
            (e("w", "ies"), cut("w", 2)),
            (e("w", "ss"), "w"),
            (e("w", "s"), cut("w", 1)),
        ],
        "w",
    )
    # The mark ~ tells that -ed or -ing went, so that the next layer tidies up.
    one_b = _cases(
        [
            (f"{e('w', 'ied')} AND length(w) = 4", cut("w", 1)),
            (e("w", "ied"), cut("w", 2)),
            (e("w", "eed"), f"CASE WHEN {like(cut('w', 3), POSITIVE)} THEN {cut('w', 1)} ELSE w END"),
            (f"{e('w', 'ed')} AND {like(cut('w', 2), HAS_VOWEL)}", f"{cut('w', 2)} || '~'"),
            (f"{e('w', 'ing')} AND {like(cut('w', 3), HAS_VOWEL)}", f"{cut('w', 3)} || '~'"),
        ],
        "w",
    )
    bare = cut("w", 1)
    tidy = _cases(
        [
            ("w NOT LIKE '%~'", "w"),
            (" OR ".join(e("w", f"{x}~") for x in ("at", "bl", "iz")), f"{bare} || 'e'"),
            (like(bare, DOUBLE), cut("w", 2)),
            (f"{like(bare, EXACTLY_ONE)} AND {like(bare, SHORT_END)}", f"{bare} || 'e'"),
        ],
        bare,
    )
    one_c = _cases([(f"{e('w', 'y')} AND length(w) > 2 AND {like(cut('w', 1), '[^aeiou]$')} AND NOT {like(cut('w', 1), '[^aeiou]y$')}", f"{cut('w', 1)} || 'i'")], "w")
    alli = _cases([(f"{e('w', 'alli')} AND {like(cut('w', 4), POSITIVE)}", cut("w", 2))], "w")
    two = _cases(
        [
            (e("w", s), f"CASE WHEN {like(cut('w', 3 if s == 'logi' else len(s)), POSITIVE)} THEN {cut('w', len(s))} || '{r}' ELSE w END")
            for s, r in STEP_2
        ],
        "w",
    )
    three = _cases(
        [(e("w", s), f"CASE WHEN {like(cut('w', len(s)), POSITIVE)} THEN {cut('w', len(s))} || '{r}' ELSE w END") for s, r in STEP_3], "w"
    )
    four = _cases(
        [
            (
                e("w", s),
                f"CASE WHEN {like(cut('w', len(s)), ABOVE_ONE)}"
                + (f" AND {like(cut('w', 3), '[st]$')}" if s == "ion" else "")
                + f" THEN {cut('w', len(s))} ELSE w END",
            )
            for s in STEP_4
        ],
        "w",
    )
    five_a = _cases(
        [
            (f"{e('w', 'e')} AND {like(bare, ABOVE_ONE)}", bare),
            (f"{e('w', 'e')} AND {like(bare, EXACTLY_ONE)} AND NOT {like(bare, SHORT_END)}", bare),
        ],
        "w",
    )
    five_b = _cases([(f"{e('w', 'll')} AND {like(bare, ABOVE_ONE)}", bare)], "w")
    return [one_a, one_b, tidy, one_c, alli, two, three, four, five_a, five_b]


def stem_layers(vocabulary: str, regex: str = "regexp_like") -> str:
    """SQL over a table or subquery with a column ``word``: (word, stem)."""
    query = f"SELECT word, word AS w FROM {vocabulary}"
    for step in _steps(_Sql(regex)):
        query = f"SELECT word, {step} AS w FROM ({query}) t"
    fixed = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in IRREGULAR.items())
    return f"SELECT word, CASE word {fixed} ELSE CASE WHEN length(word) <= 2 THEN word ELSE w END END AS stem FROM ({query}) t"


def stem_vocabulary(words: DataFrame) -> DataFrame:
    """(word, stem) for a DataFrame with a column ``word``."""
    return words.sparkSession.sql(stem_layers("{words}"), words=words)


def stem_word(word: str) -> str:
    """The stem of one lower-case word."""
    if word in IRREGULAR:
        return IRREGULAR[word]
    if len(word) <= 2:
        return word
    has = lambda stem, pattern: re.search(pattern, stem) is not None
    w = word
    if w.endswith("ies"):
        w = w[:-1] if len(w) == 4 else w[:-2]
    elif w.endswith("sses"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    cut = None
    if w.endswith("ied"):
        w = w[:-1] if len(w) == 4 else w[:-2]
    elif w.endswith("eed"):
        w = w[:-1] if has(w[:-3], POSITIVE) else w
    elif w.endswith("ed") and has(w[:-2], HAS_VOWEL):
        cut = w[:-2]
    elif w.endswith("ing") and has(w[:-3], HAS_VOWEL):
        cut = w[:-3]
    if cut is not None:
        if cut.endswith(("at", "bl", "iz")):
            w = cut + "e"
        elif has(cut, DOUBLE):
            w = cut[:-1]
        elif has(cut, EXACTLY_ONE) and has(cut, SHORT_END):
            w = cut + "e"
        else:
            w = cut
    if w.endswith("y") and len(w) > 2 and has(w[:-1], "[^aeiou]$") and not has(w[:-1], "[^aeiou]y$"):
        w = w[:-1] + "i"
    if w.endswith("alli") and has(w[:-4], POSITIVE):
        w = w[:-2]
    for table in (STEP_2, STEP_3):
        for suffix, to in table:
            if w.endswith(suffix):
                if has(w[:-3] if suffix == "logi" else w[: -len(suffix)], POSITIVE):
                    w = w[: -len(suffix)] + to
                break
    for suffix in STEP_4:
        if w.endswith(suffix):
            if has(w[: -len(suffix)], ABOVE_ONE) and (suffix != "ion" or w[:-3].endswith(("s", "t"))):
                w = w[: -len(suffix)]
            break
    if w.endswith("e") and (has(w[:-1], ABOVE_ONE) or (has(w[:-1], EXACTLY_ONE) and not has(w[:-1], SHORT_END))):
        w = w[:-1]
    if w.endswith("ll") and has(w[:-1], ABOVE_ONE):
        w = w[:-1]
    return w


@functools.lru_cache(maxsize=1 << 18)
def known_stem(word: str) -> str:
    """:func:`stem_word`, kept for the frequent words of a worker."""
    return stem_word(word)


@F.arrow_udf(T.ArrayType(T.StringType()))
def stems(tokens: pa.Array) -> pa.Array:
    """The stems of arrays of words, in order: each distinct word of a batch once, so words need no join."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False))
    words = tokens.flatten().dictionary_encode()
    told = pa.array([known_stem(w) for w in words.dictionary.to_pylist()], pa.string())
    return pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), told.take(words.indices))
