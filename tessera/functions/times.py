"""Free-form times to ISO text in UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns of feed times besides ISO; without a zone they count as UTC.
PATTERNS = (
    "EEE, d MMM yyyy HH:mm:ss Z", "EEE, d MMM yyyy HH:mm:ss zzz", "d MMM yyyy HH:mm:ss Z", "yyyy-MM-dd HH:mm:ss",
    "yyyy/MM/dd HH:mm:ss", "d MMM yyyy",
)


def parsed_time(raw: Column) -> Column:
    """Timestamp of a feed time, null where none of the forms fits."""
    # Day names carry no information that the date lacks.
    bare = F.regexp_replace(F.trim(raw), r"^[A-Za-z]{3},\s*", "")
    iso = F.when(bare.rlike(r"^\d{4}-\d\d-\d\d"), bare)
    forms = [F.try_to_timestamp(bare, F.lit(p.removeprefix("EEE, "))) for p in PATTERNS]
    return F.coalesce(F.try_to_timestamp(iso), *forms)


def iso_utc(raw: Column) -> Column:
    """``yyyy-MM-ddTHH:mm:ssZ`` of a feed time."""
    return F.date_format(parsed_time(raw), "yyyy-MM-dd'T'HH:mm:ss'Z'")
