"""Dates and times kept as text: tolerant parsing to instants, canonical rendering."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions.text import stripped

#: yyyy-MM-dd, then optionally a time with seconds, fraction and offset
ISO_PATTERN = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}([.,]\d+)?)?\s*(Z|z|UTC|[+-]\d{2}(:?\d{2})?)?)?$"


def instant(text: Column) -> Column:
    """The instant an ISO 8601 text names; a missing offset means UTC; text that is no time gives null.

    Needs the session time zone UTC, as all of this library.
    """
    bare = stripped(text)
    tidy = F.regexp_replace(bare, ",", ".")
    tidy = F.regexp_replace(tidy, r"\s*(?:z|UTC)$", "Z")
    tidy = F.regexp_replace(tidy, r"([T ]\d{2}:\d{2}\S*?)\s*([+-]\d{2})(\d{2})$", "$1$2:$3")
    tidy = F.regexp_replace(tidy, r"([T ]\d{2}:\d{2}\S*?)\s+([+-]\d{2}:\d{2})$", "$1$2")
    return F.when(bare.rlike(ISO_PATTERN), tidy.try_cast("timestamp"))


def utc_text(ts: Column) -> Column:
    """``yyyy-MM-ddTHH:mm:ssZ``."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")
