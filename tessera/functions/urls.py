"""URL functions as Columns: normal form, identifiers, article filter."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# What marks a tracking query, as substrings.
TRACKING_KEYS = ("utm_", "fbclid", "gclid", "mc_cid", "mc_eid", "ref", "ref_src", "share")
# Path endings of static files.
STATIC_ENDINGS = (
    ".jpg", ".jpeg", ".png", ".gif", ".svg", ".pdf", ".zip", ".mp4", ".mp3", ".webm", ".css", ".js", ".ico", ".woff", ".woff2",
)
# Path parts of pages that are no articles.
BAD_ROUTES = (
    "/login", "/signin", "/sign-in", "/signup", "/register", "/account", "/settings", "/profile", "/cart", "/checkout",
    "/search", "/results", "/static/", "/assets/", "/media/", "/api/", "/graphql", "/admin/",
)
# Last parts, and path beginnings of sites, that decide what an article is.
BAD_SLUGS = ("home", "index", "search", "login", "signup", "admin")
NASA_PATHS = (
    "/news/", "/press-release/", "/feature/", "/history/", "/missions/", "/earth/", "/solar-system/", "/universe/",
    "/science-research/", "/humans-in-space/", "/technology/", "/climate/",
)
GOVUK_PATHS = (
    "/guidance/", "/government/publications/", "/government/news/", "/government/speeches/", "/government/statistics/",
    "/government/world-location-news/", "/government/country/", "/government/consultations/",
)
WORLD_BANK_PATHS = (
    "/en/news/", "/en/blogs/", "/en/publication/", "/en/research/", "/en/topic/", "/en/results/", "/en/country/",
)
TECHCRUNCH_DROPS = ("/events/", "/about/", "/advertising/", "/contact/")

# Schemes whose URLs name an authority, as the standard URL library lists them.
NETLOC_SCHEMES = (
    "ftp", "http", "gopher", "nntp", "telnet", "imap", "wais", "file", "mms", "https", "shttp", "snews", "prospero", "rtsp",
    "rtsps", "rtspu", "rsync", "svn", "svn+ssh", "sftp", "nfs", "git", "git+ssh", "ws", "wss", "itms-services",
)

_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def _part(url: Column, k: int) -> Column:
    return F.regexp_extract(F.trim(F.coalesce(url, F.lit(""))), "(?s)" + _PARTS, k)


def scheme(url: Column) -> Column:
    return F.lower(_part(url, 1))


def host(url: Column) -> Column:
    """Lower-case network location, port kept; empty when there is none."""
    return F.lower(_part(url, 2))


def path(url: Column) -> Column:
    return _part(url, 3)


def query(url: Column) -> Column:
    return _part(url, 4)


def fragment(url: Column) -> Column:
    return _part(url, 5)


def _decode(text: Column) -> Column:
    return F.coalesce(F.try_url_decode(text), text)


def _encode(text: Column) -> Column:
    """Form encoding with ``~`` bare and ``*`` escaped."""
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def sorted_query(text: Column) -> Column:
    """Query pairs decoded, sorted by key and value, encoded again; blanks kept."""
    pairs = F.filter(F.split(text, "&"), lambda p: p != "")
    split = F.transform(
        pairs,
        lambda p: F.struct(
            _decode(F.substring_index(p, "=", 1)).alias("k"),
            _decode(F.when(F.instr(p, "=") > 0, F.substring(p, F.instr(p, "=") + 1, F.length(p))).otherwise("")).alias("v"),
        ),
    )
    return F.array_join(F.transform(F.array_sort(split), lambda s: F.concat(_encode(s["k"]), F.lit("="), _encode(s["v"]))), "&")


def normalize_url(url: Column) -> Column:
    """Normal form for hashing; empty for null and blank.

    Without an authority, two slashes stand only before a path that begins with a slash,
    in schemes that have authorities, or with two.
    """
    s = F.when(scheme(url) == "", "http").otherwise(scheme(url))
    h = F.when((s == "http") & host(url).endswith(":80"), F.regexp_replace(host(url), ":80$", ""))
    h = h.when((s == "https") & host(url).endswith(":443"), F.regexp_replace(host(url), ":443$", "")).otherwise(host(url))
    p = F.when(path(url).isin("", "/"), "/").otherwise(F.regexp_replace(path(url), "/$", ""))
    q = sorted_query(query(url))
    located = F.when(h != "", F.concat(F.lit("//"), h)).when(
        p.startswith("//") | (s.isin(*NETLOC_SCHEMES) & p.startswith("/")), "//"
    ).otherwise("")
    whole = F.concat(s, F.lit(":"), located, p, F.when(q == "", "").otherwise(F.concat(F.lit("?"), q)))
    return F.when(F.trim(F.coalesce(url, F.lit(""))) == "", "").otherwise(whole)


def url_doc_id(url: Column, prefix: str = "u") -> Column:
    """Identifier of a URL: prefix and 16 digits of the SHA-1 of its normal form."""
    return F.concat(F.lit(f"{prefix}-"), F.substring(F.sha1(F.encode(normalize_url(url), "utf-8")), 1, 16))


def entry_doc_id(guid: Column, link: Column, prefix: str) -> Column:
    """Identifier of a feed entry: by its guid, else by its link."""
    base = F.coalesce(F.nullif(guid, F.lit("")), link)
    return F.concat(F.lit(f"{prefix}-"), F.substring(F.sha1(F.encode(base, "utf-8")), 1, 16))


def canonical_url(url: Column) -> Column:
    """Without query and fragment."""
    return F.regexp_replace(F.coalesce(url, F.lit("")), r"[?#][\s\S]*$", "")


def strip_tracking(url: Column) -> Column:
    """Without its query when that names any tracking key; the fragment stays."""
    found = _any(F.lower(query(url)), "contains", TRACKING_KEYS)
    return F.when(found, F.regexp_replace(url, r"\?[^#]*", "")).otherwise(url)


def _any(column: Column, how: str, words: tuple[str, ...]) -> Column:
    return reduce(Column.__or__, [getattr(column, how)(w) for w in words])


def is_article_url(url: Column, site: Column) -> Column:
    """Whether a URL of ``site`` looks like an article; unknown sites use the general rule."""
    url = F.trim(F.coalesce(url, F.lit("")))
    h, p = host(url), path(url)
    inner = (p != "") & (p != "/")
    title = F.substring(p, 7, 10_000)
    segments = F.filter(F.split(p, "/"), lambda s: s != "")
    rules = {
        "wikipedia": p.startswith("/wiki/") & (title != "") & (title != "Main_Page") & ~title.contains(":"),
        "bbc": p.startswith("/news") & ~_any(p, "contains", ("/live", "/av")),
        "nasa": h.endswith("nasa.gov") & _any(p, "startswith", NASA_PATHS),
        "govuk": _any(p, "startswith", GOVUK_PATHS),
        "python_docs": h.endswith("docs.python.org") & inner & ~_any(p, "startswith", ("/assets", "/_static")),
        "howstuffworks": (h == "www.howstuffworks.com") & ~_any(p, "contains", ("/video/", "/videos/")),
        "natgeo": h.contains("nationalgeographic.com") & ~_any(p, "contains", ("/photos/", "/video/", "/videos/")),
        "smithsonian": h.contains("smithsonianmag.com"),
        "guardian": h.contains("theguardian.com") & ~_any(p, "contains", ("/crosswords/", "/sudoku", "/killer-sudoku")) & inner,
        "mit_news": h.contains("news.mit.edu") & inner & ~_any(p, "endswith", (".xml", ".jpg", ".png", ".gif", ".pdf")),
        "techcrunch": h.contains("techcrunch.com")
        & inner
        & (
            p.rlike(r"^/\d{4}/\d{2}/\d{2}/")
            | (~_any(p, "contains", TECHCRUNCH_DROPS) & (~p.contains("/newsletters/") | (F.size(segments) >= 3)))
        ),
        "world_bank": h.contains("worldbank.org") & inner & _any(p, "startswith", WORLD_BANK_PATHS),
        "django_docs": h.contains("docs.djangoproject.com")
        & inner
        & ~(p.startswith("/en/") & _any(p, "contains", ("/_static/", "/_images/"))),
    }
    low = F.lower(p)
    general = (
        ~_any(low, "contains", BAD_ROUTES)
        & (F.size(segments) > 0)
        & F.when(F.size(segments) == 1, ~F.lower(F.element_at(segments, 1)).isin(*BAD_SLUGS)).otherwise(F.length(p) >= 8)
    )
    name = F.lower(F.coalesce(site, F.lit("")))
    kept = F.lit(None).cast("boolean")
    for key, rule in rules.items():
        kept = F.when(name == key, rule).otherwise(kept)
    kept = F.coalesce(kept, general)
    return F.coalesce(url.startswith("http") & ~_any(p, "endswith", STATIC_ENDINGS) & kept, F.lit(False))
