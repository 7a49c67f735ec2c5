"""HTML to text as Columns.

Text is what is outside tags, comments, scripts and styles.  Markup cuts it into runs;
character references are decoded in each run, white space at its ends goes, and the runs
that are left are joined by one blank.  White space inside a run stays as it is.
"""

from __future__ import annotations

import html.entities
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

# References that are looked up first.
ENTITIES = (
    ("amp", "&"), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("nbsp", "\u00a0"),
)
#: Every named reference of the HTML standard that ends in a semicolon, from Python's own table.
NAMED = {name[:-1]: char for name, char in html.entities.html5.items() if name.endswith(";")}
#: Code points 128 to 159 stand for Windows-1252 characters.
_WINDOWS = {k: bytes([k]).decode("cp1252", "ignore") for k in range(128, 160)}
MARKUP = r"(?is)<!--.*?-->|<(script|style)\b[^>]*>.*?</\1\s*>|<[^>]*>"
_SPACE = r"[\s\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\x1c-\x1f]"
_MARK = "\u0000"


def _point(number: Column) -> Column:
    """The character of a code point; U+FFFD where there is none."""
    good = (number > 0) & (number < 0x110000) & ~number.between(0xD800, 0xDFFF)
    char = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
    windows = F.lit(None).cast("string")
    for k, mapped in _WINDOWS.items():
        windows = F.when(number == k, F.lit(mapped or chr(k))).otherwise(windows)
    return F.when(number.between(128, 159), windows).otherwise(F.when(good, char).otherwise(F.lit("\ufffd")))


def _decoded(text: Column) -> Column:
    """``text`` with its character references decoded; what is none stays."""
    named = F.from_json(F.lit(json.dumps(NAMED)), "map<string,string>")

    def one(part: Column) -> Column:
        # A part begins behind an ampersand.
        body = F.regexp_extract(part, r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);", 1)
        rest = F.substring(part, F.length(body) + 2, F.length(part))
        number = F.when(
            body.rlike("^#[xX]"), F.conv(F.substring(body, F.lit(3), F.length(body)), 16, 10)
        ).otherwise(F.substring(body, F.lit(2), F.length(body))).cast("int")
        char = F.when(body == "", F.lit(None))
        for name, value in ENTITIES:
            char = char.when(body == name, F.lit(value))
        char = char.when(body.startswith("#"), _point(number)).otherwise(F.try_element_at(named, body))
        return F.coalesce(F.concat(char, rest), F.concat(F.lit("&"), part))

    parts = F.split(text, "&")
    told = F.concat(F.slice(parts, 1, 1), F.transform(F.slice(parts, 2, 100_000_000), one))
    return F.when(F.contains(text, F.lit("&")), F.array_join(told, "")).otherwise(text)


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, f"^{_SPACE}+|{_SPACE}+$", "")


def html_text(html: Column) -> Column:
    """The readable text of a page; empty for null."""
    shown = F.regexp_replace(F.coalesce(html, F.lit("")), MARKUP, _MARK)
    runs = F.transform(F.split(shown, _MARK), lambda run: _stripped(_decoded(run)))
    return F.array_join(F.filter(runs, lambda run: run != ""), " ")


def html_title(html: Column, site: Column | None = None, url: Column | None = None) -> Column:
    """The title of a page; ``[SITE] url`` where it has none and both are given."""
    found = F.regexp_extract(F.coalesce(html, F.lit("")), r"(?is)<title[^>]*>(.*?)</title>", 1)
    title = _stripped(_decoded(found))
    if site is None or url is None:
        return title
    return F.coalesce(F.nullif(title, F.lit("")), F.concat(F.lit("["), F.upper(site), F.lit("] "), url))


def long_enough(body: Column, least: int = 200) -> Column:
    """Whether a body is worth indexing."""
    return F.length(F.coalesce(body, F.lit(""))) >= least


def prefixed_title(title: Column, prefix: Column) -> Column:
    """Title behind a feed's prefix."""
    return F.trim(F.concat_ws(" ", F.nullif(prefix, F.lit("")), F.trim(F.coalesce(title, F.lit("")))))
