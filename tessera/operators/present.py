"""Presentation: snippets, highlighting, page numbers, date bounds."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SNIPPET_LEAD, SNIPPET_LENGTH = 60, 180


def snippet(body: Column, terms: list[str]) -> Column:
    """The text around the first of ``terms`` that occurs, widened to word borders.

    Terms are tried in order, as substrings of the lower-cased body; without any,
    the head of the body is shown.
    """
    body = F.coalesce(body, F.lit(""))
    places = [F.nullif(F.locate(t.lower(), F.lower(body)), F.lit(0)) for t in terms]
    hit = F.coalesce(*places, F.lit(0)) - 1
    start = F.when(hit < 0, 0).otherwise(F.greatest(hit - SNIPPET_LEAD, F.lit(0)))
    end = F.least(F.length(body), start + SNIPPET_LENGTH)
    # The run of word characters that a border cuts, on either side of it.
    upto = F.regexp_extract(F.substring(body, F.lit(1), start + 1), r"[\p{L}\p{N}]*\z", 0)
    first = F.greatest(start - F.length(upto), F.lit(0))
    cut = F.when(
        F.substring(body, end, F.lit(1)).rlike(r"[\p{L}\p{N}]"),
        F.length(F.regexp_extract(F.substring(body, end + 1, F.length(body)), r"(?s)^[\p{L}\p{N}]*.?", 0)),
    ).otherwise(0)
    last = F.least(end + cut, F.length(body))
    shown = F.substring(body, first + 1, last - first)
    return F.regexp_replace(F.regexp_replace(shown, "\n", " "), r"^\s+|\s+$", "")


def highlight_terms(query: str) -> list[str]:
    """What highlighting looks for: quoted phrases and other words, longest first."""
    phrases = [p.strip() for p in re.findall(r'"([^"]+)"', query) if p.strip()]
    words = [w for w in re.sub(r'"[^"]+"', " ", query).split() if w.lower() not in ("and", "or", "not")]
    return sorted((t for t in dict.fromkeys(phrases + words) if len(t) >= 2), key=len, reverse=True)


def escaped(text: Column) -> Column:
    """Text made safe for HTML."""
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def highlight(text: Column, query: str) -> Column:
    """Escaped text with every highlighted term in ``<strong>``, whatever its case."""
    safe = escaped(F.coalesce(text, F.lit("")))
    terms = [re.sub(r"([.*+?^${}()|\[\]\\])", r"\\\1", t) for t in highlight_terms(query.strip())]
    return F.regexp_replace(safe, f"(?iu)({'|'.join(terms)})", "<strong>$1</strong>") if terms else safe


def paged(ranked: DataFrame, size: int, pages: int = 5) -> DataFrame:
    """The first ``pages`` pages of ``ranked`` (doc_id, score), with rank and page.

    Ranks are given to the rows of those pages only, so the window stays small.
    """
    order = [F.col("score").desc(), F.col("doc_id").asc()]
    rows = ranked.orderBy(*order).limit(size * pages)
    numbered = rows.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    return numbered.withColumn("page", F.ceil(F.col("rank") / size).cast("int"))


def day_bounds(first: str | None, last: str | None) -> tuple[str | None, str | None]:
    """Dates of a form as time bounds of whole UTC days."""
    return (f"{first}T00:00:00Z" if first else None, f"{last}T23:59:59Z" if last else None)
