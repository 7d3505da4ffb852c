"""Factors of a fact's rank: age, trust, supersession, bulk dates. The clock is always passed in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions import values as V
from factloom.functions.dates import instant
from factloom.functions.text import stripped


def parse_day(text: Column) -> Column:
    """An ISO time or, failing that, the date its first ten characters spell; else null."""
    t = stripped(F.coalesce(text, F.lit("")))
    day = F.substring(t, 1, 10)
    return F.coalesce(instant(t), F.when(day.rlike(r"^\d{4}-\d{2}-\d{2}$"), day.try_cast("timestamp")))


def recency(kind: Column, at: Column, now: Column) -> Column:
    """Halves every half-life of the kind, at least 0.01; 1 without date and for future ones."""
    lives = F.create_map(*[x for k, h in V.HALF_LIFE_DAYS.items() for x in (F.lit(k), F.lit(h))])
    half = F.coalesce(F.try_element_at(lives, F.lower(F.coalesce(kind, F.lit("")))), F.lit(V.DEFAULT_HALF_LIFE))
    days = (F.unix_micros(now) - F.unix_micros(at)) / F.lit(86400e6)
    return F.when(at.isNull() | (days <= 0), 1.0).otherwise(F.greatest(F.lit(V.MIN_RECENCY), F.pow(F.lit(0.5), days / half)))


def supersession(deprecated: Column, status: Column, superseded_by: Column) -> Column:
    """N10."""
    return (
        F.when(F.coalesce(deprecated, F.lit(False)), 0.4)
        .when((status == "current") & (F.length(F.coalesce(stripped(superseded_by), F.lit(""))) > 0), 0.6)
        .otherwise(1.0)
    )


def trust_factor(trust: Column, provenance: Column, untrusted: float = 0.5) -> Column:
    """Less for what is untrusted, or comes from outside and isn't marked as trusted."""
    marked = F.lower(F.coalesce(trust, F.lit("")))
    outside = F.lower(F.coalesce(provenance, F.lit(""))).isin(*V.EXTERNAL_PROVENANCE)
    return F.when(marked.isin("untrusted", "external") | ((marked != "trusted") & outside), untrusted).otherwise(1.0)


def bulk_date(share: Column, threshold: float = V.BULK_DATE_SHARE, floor: float = V.BULK_DATE_FLOOR) -> Column:
    """N12."""
    if threshold <= 0 or threshold >= 1:
        return F.lit(1.0)
    return F.when(share <= threshold, 1.0).otherwise(F.greatest(F.lit(floor), 1.0 - (share - threshold)))


def valid(valid_at: Column, invalid_at: Column, now: Column) -> Column:
    """now lies in [valid_at, invalid_at); a missing bound is open."""
    return F.coalesce(now >= valid_at, F.lit(True)) & F.coalesce(now < invalid_at, F.lit(True))


def idf(n: Column, df: Column) -> Column:
    """N8."""
    return F.log(1 + (n - df + 0.5) / (df + 0.5))
