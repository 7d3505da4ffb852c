"""The store's facts as operators see them: one row per id, tidied columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import scoring
from factloom.functions.text import stripped
from factloom.functions import values as V
from factloom.functions.dates import instant

COLUMNS = [
    "ord", "id", "kind", "status", "confidence", "content", "source", "source_file", "source_date", "session", "machine", "created_at", "last_seen_at",
    "valid_at", "invalid_at", "superseded_by", "superseded_at", "supersession_reason", "deprecated", "trust", "provenance", "pr_numbers", "evidence", "extra",
]


def latest(facts: DataFrame) -> DataFrame:
    """U3s over the rows of one store: per id the row seen last (null first; then the highest ord).

    Null ids drop, and so do columns that are none of a fact, whose names operators may use for their own.
    """
    rows = facts.filter(F.col("id").isNotNull())
    names = [c for c in COLUMNS if c in facts.columns and c != "id"]
    newest = rows.groupBy("id").agg(F.max_by(F.struct(*names), F.struct("last_seen_at", "ord")).alias("r"))
    return newest.select("id", *[F.col("r")[c].alias(c) for c in names])


def whole(facts: DataFrame) -> DataFrame:
    """Facts with every column that operators use; those that a store lacks are null."""
    kinds = {"ord": "long", "confidence": "double", "created_at": "timestamp", "last_seen_at": "timestamp", "deprecated": "boolean", "pr_numbers": "array<int>", "evidence": "array<struct<event_id:string,path:string,line:int>>"}
    return facts.withColumns({c: F.lit(None).cast(kinds.get(c, "string")) for c in COLUMNS if c not in facts.columns})


def owner(source: Column) -> Column:
    """the owner of a fact; a missing or blank source is the shared one."""
    tidy = stripped(F.coalesce(source, F.lit("")))
    return F.when(tidy == "", V.SHARED_SOURCE).otherwise(tidy)


#: What tidied columns are made of, where that isn't the column of their name
MADE_OF = {"day": "source_date", "date_key": "source_date", "valid_from": "valid_at", "valid_to": "invalid_at"}


def tidy(facts: DataFrame, only: tuple[str, ...] = ()) -> DataFrame:
    """``latest`` with kind and status trimmed and lower-cased, bounds and dates as instants.

    A missing status is ``current``, missing confidence 0, missing content empty. ``day`` is the instant
    of source_date or null, ``date_key`` its text or ``unknown``. With ``only``, these columns besides the id, and no others are shuffled.
    """
    if only:
        kept = {MADE_OF.get(c, c) for c in only} | {"ord", "last_seen_at"}
        facts = facts.select("id", *[c for c in COLUMNS if c in facts.columns and c != "id" and (c in kept or (c == "extra" and "provenance" in only))])
    status = F.lower(stripped(F.coalesce("status", F.lit(""))))
    key = stripped(F.coalesce("source_date", F.lit("")))
    newest = latest(facts)
    if "provenance" not in newest.columns and (not only or "provenance" in only):
        # an open field of a fact rides in its extra JSON
        newest = newest.withColumn("provenance", F.get_json_object("extra", "$.provenance") if "extra" in newest.columns else F.lit(None).cast("string"))
    made = {
        "kind": lambda: F.lower(stripped(F.coalesce("kind", F.lit("")))),
        "status": lambda: F.when(status == "", "current").otherwise(status),
        "confidence": lambda: F.coalesce("confidence", F.lit(0.0)),
        "content": lambda: F.coalesce("content", F.lit("")),
        "source": lambda: owner(F.col("source")),
        "day": lambda: scoring.parse_day(F.col("source_date")),
        "date_key": lambda: F.when(key == "", "unknown").otherwise(key),
        "valid_from": lambda: instant(F.col("valid_at")),
        "valid_to": lambda: instant(F.col("invalid_at")),
    }
    whole_rows = newest.withColumns({name: value() for name, value in made.items() if not only or name in only})
    return whole_rows.select("id", *only) if only else whole_rows


def current(facts: DataFrame, now: Column) -> DataFrame:
    """F11, F12 over tidied facts: not superseded and valid now, of any confidence."""
    return facts.filter((F.col("status") != "superseded") & scoring.valid(F.col("valid_from"), F.col("valid_to"), now))


def live(facts: DataFrame, now: Column, floor: float = V.MIN_CONFIDENCE, include_superseded: bool = False) -> DataFrame:
    """F11 to F13 over tidied facts: not superseded, valid now (unless superseded ones are asked for), of enough confidence."""
    pool = facts if include_superseded else current(facts, now)
    return pool.filter(F.col("confidence") >= floor)


def scoped(facts: DataFrame, sources: str | list[str] | None) -> DataFrame:
    """facts of the given owners; one text counts as one owner, None as all."""
    if sources is None:
        return facts
    return facts.filter(F.col("source").isin([sources] if isinstance(sources, str) else list(sources)))


def agent_scope(agent: str | None) -> list[str] | None:
    """the owners that an agent sees: itself and the shared one; no agent sees all."""
    return [agent.strip(), V.SHARED_SOURCE] if agent and agent.strip() else None
