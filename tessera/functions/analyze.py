"""Text analysis as Columns, and the same analysis of one query string on the driver.

Analyzers: ``raw`` keeps every run of ``[a-z0-9]``; ``standard`` also drops stop
words and one-character tokens; ``english`` stems what ``standard`` keeps.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.porter import stem_word

# The stop list of the analyzer (30 words).
STOP_WORDS = (
    "the", "a", "an", "and", "or", "to", "of", "in", "on", "for", "with", "is", "are", "was", "were",
    "be", "as", "by", "at", "from", "that", "this", "it", "its", "into", "over", "under", "we", "you", "they",
)
ANALYZERS = ("raw", "standard", "english")


def tokens(text: Column, analyzer: str = "standard", stop: tuple[str, ...] = STOP_WORDS) -> Column:
    """Array of the tokens of ``text``, in order, repeats kept; null text has none.

    ``english`` is not offered here: stemming is a join with the stemmed
    vocabulary (see :func:`tessera.operators.index.build_index`).
    """
    runs = F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+")
    if analyzer == "raw":
        return F.filter(runs, lambda t: t != "")
    return F.filter(runs, lambda t: (F.length(t) > 1) & ~t.isin(*stop))


def document_text(title: Column, body: Column) -> Column:
    """What is indexed: title, blank, body."""
    return F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(body, F.lit("")))


def analyze_query_text(text: str, analyzer: str = "standard", stop: tuple[str, ...] = STOP_WORDS) -> list[str]:
    """Tokens of a query string, on the driver."""
    runs = re.findall("[a-z0-9]+", (text or "").lower())
    if analyzer == "raw":
        return runs
    kept = [t for t in runs if len(t) > 1 and t not in stop]
    return [stem_word(t) for t in kept] if analyzer == "english" else kept
