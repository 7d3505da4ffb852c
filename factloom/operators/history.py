"""Problem 3: full history of changing attributes, as an event-sourced per-attribute change log.

Snapshots become one event per entity, attribute and time at which the attribute's value changed.
Each attribute has its own intervals; the versions of an entity are those intervals split at the
union of their boundaries, and neighbouring pieces with equal values coalesced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.functions.dates import instant, utc_text
from factloom.functions.text import stripped


def last_loaded(snapshots: DataFrame, keys: list[str], loaded: str, values: list[str]) -> DataFrame:
    """Of rows with equal keys the one loaded last (null = first of all); the greatest values decide ties."""
    newest = F.max(F.struct(F.col(loaded), *values)).alias("newest")
    return snapshots.groupBy(*keys).agg(newest).select(*keys, *[F.col("newest")[v].alias(v) for v in values])


def change_log(states: DataFrame, entity: str, at: str, attributes: list[str]) -> DataFrame:
    """(entity, attribute, at, value): one event per attribute and time at which its value differs from the one before.

    ``states`` has one row per entity and time with text attributes. Null is a value like any other.
    """
    pairs = F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(a).alias("value")) for a in attributes])
    events = states.select(entity, at, F.explode(pairs).alias("e")).select(entity, at, "e.attribute", "e.value")
    line = W.partitionBy(entity, "attribute").orderBy(at)
    before = F.lag(F.struct("value")).over(line)
    return events.withColumn("before", before).filter(F.col("before").isNull() | ~F.col("value").eqNullSafe(F.col("before.value"))).drop("before")


def versions(log: DataFrame, entity: str, at: str, attributes: list[str]) -> DataFrame:
    """(entity, from, to, *attributes): the versions that a change log spells, ``to`` null for the open one.

    Every event is a boundary; an attribute's value between boundaries is that of its last event.
    """
    boundaries = log.groupBy(entity, at).pivot("attribute", attributes).agg(F.first(F.struct("value")))
    line = W.partitionBy(entity).orderBy(at).rowsBetween(W.unboundedPreceding, W.currentRow)
    filled = boundaries.select(entity, at, *[F.last(a, ignorenulls=True).over(line)["value"].alias(a) for a in attributes])
    order = W.partitionBy(entity).orderBy(at)
    state = F.struct(*attributes)
    pieces = filled.withColumn("state", state).withColumn("previous", F.lag("state").over(order))
    kept = pieces.filter(F.col("previous").isNull() | ~F.col("state").eqNullSafe(F.col("previous")))
    return kept.select(entity, F.col(at).alias("from"), F.lead(at).over(order).alias("to"), *attributes)


def fact_states(snapshots: DataFrame) -> DataFrame:
    """(id, snapshot_at, status, valid_at, invalid_at, superseded_at, gone) per fact and snapshot."""

    def as_text(name: str) -> Column:
        return F.unix_micros(instant(F.col(name))).cast("string").alias(name)

    status = F.lower(stripped("status"))
    tidy = snapshots.filter(F.col("snapshot_at").isNotNull() & F.col("fact_id").isNotNull()).select(
        F.lower(stripped("fact_id")).alias("id"),
        "snapshot_at",
        "loaded_at",
        F.when(status.isNull() | (status == ""), "current").otherwise(status).alias("status"),
        as_text("valid_at"),
        as_text("invalid_at"),
        as_text("superseded_at"),
    )
    held = last_loaded(tidy, ["id", "snapshot_at"], "loaded_at", ["status", "valid_at", "invalid_at", "superseded_at"])
    gone = F.col("status") == "purged"
    # what a purged row says besides is of no version
    return held.select("id", "snapshot_at", *[F.when(~gone, F.col(c)).alias(c) for c in ("status", "valid_at", "invalid_at", "superseded_at")], gone.cast("string").alias("gone"))


def fact_versions(snapshots: DataFrame) -> DataFrame:
    """Versions of facts with the period in which each held.

    Columns: id, from_ts, to_ts (empty while open), status, valid_at, invalid_at, superseded_at (as
    instants). Rows without fact_id or snapshot_at are ignored; a missing or blank status is
    ``current``; times that are none are null; ``purged`` ends a version and is none itself.
    """
    attributes = ["status", "valid_at", "invalid_at", "superseded_at", "gone"]
    log = change_log(fact_states(snapshots), "id", "snapshot_at", attributes)
    times = [F.timestamp_micros(F.col(c).cast("long")).alias(c) for c in ("valid_at", "invalid_at", "superseded_at")]
    return (
        versions(log, "id", "snapshot_at", attributes)
        .filter(F.col("gone") == "false")
        .select("id", utc_text(F.col("from")).alias("from_ts"), F.coalesce(utc_text(F.col("to")), F.lit("")).alias("to_ts"), "status", *times)
    )
