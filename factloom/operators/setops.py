"""Dedup, unions and set operations on fact stores (survey 2.5)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.functions import text
from factloom.operators.numbering import numbered


def first_by(rows: DataFrame, keys: list, order: list) -> DataFrame:
    """The first row of each key in the given order; a null key is a key."""
    names = [f"_k{i}" for i in range(len(keys))]
    keyed = rows.select("*", *[k.alias(n) for k, n in zip(keys, names)])
    return keyed.withColumn("_n", F.row_number().over(W.partitionBy(*names).orderBy(*order))).filter("_n = 1").drop("_n", *names)


def dedup_text(facts: DataFrame) -> DataFrame:
    """U1s: the first fact (by ord) of each normalised text."""
    key = text.dedup_key(F.col("content"))
    return facts.withColumn("_key", key).groupBy("_key").agg(F.min_by(F.struct(*facts.columns), "ord").alias("_r")).select("_r.*")


def merge_new(existing: DataFrame, new: DataFrame) -> DataFrame:
    """U2s: existing rows and the new ones whose id isn't there (null ids of new rows stay)."""
    return existing.unionByName(new.join(existing.select("id"), "id", "left_anti"))


def keyed_union(live: DataFrame, recent: DataFrame) -> DataFrame:
    """U3s: one row per id (or content hash); the recent side wins, the place is that of the first occurrence.

    Columns that only one side has are null on the other.
    """
    both = live.withColumn("_side", F.lit(0)).unionByName(recent.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    key = F.coalesce("id", F.sha2(F.coalesce("content", F.lit("")), 256))
    names = [c for c in both.columns if c != "_side"]
    merged = both.groupBy(key.alias("_key")).agg(F.max_by(F.struct(*names), F.struct("_side", "ord")).alias("_r"), F.min(F.struct("_side", "ord")).alias("_at"))
    return merged.select("_r.*", "_at").withColumn("place", F.struct("_at._side", "_at.ord")).drop("_at")


def merged_store(live: DataFrame, recent: DataFrame, order: list) -> DataFrame:
    """U3s for a store: a live id keeps its ord, new ones are numbered on from the greatest in the given order."""
    if "ord" not in live.columns:
        live = numbered(live, [F.col("id")], "ord")
    last = live.agg(F.coalesce(F.max("ord").cast("long"), F.lit(0)).alias("_last"))
    fresh = numbered(recent, order, "_nth").crossJoin(F.broadcast(last)).withColumn("ord", F.col("_last") + F.col("_nth")).drop("_last", "_nth")
    merged = keyed_union(live.withColumn("ord", F.col("ord").cast("long")), fresh)
    return merged.withColumn("ord", F.coalesce("place.ord", "ord")).drop("place")


def new_proposals(candidates: DataFrame, live: DataFrame, queued: DataFrame) -> DataFrame:
    """U4s: candidates whose id is neither live nor queued, each once."""
    fresh = candidates.join(live.select("id"), "id", "left_anti").join(queued.select("id"), "id", "left_anti")
    return first_by(fresh, [F.col("id")], [F.col("ord")])


def append_batch(store: DataFrame, batch: DataFrame) -> DataFrame:
    """U5s: adds a batch; raises if any of its ids is taken or repeated."""
    if batch.join(store.select("id"), "id", "left_semi").limit(1).count() or batch.groupBy("id").count().filter("count > 1").limit(1).count():
        raise ValueError("the batch repeats ids; nothing was added")
    return store.unionByName(batch)


def replace_curated(store: DataFrame, curated: DataFrame, prefix: str = "curated-") -> DataFrame:
    """U6s: drops the curated slice and appends the new one."""
    return store.filter(~F.coalesce(F.col("id").startswith(prefix), F.lit(False))).unionByName(curated)


def partition_queue(queue: DataFrame, approved: DataFrame, rejected: DataFrame, live: DataFrame) -> DataFrame:
    """U7s: adds ``outcome``: approved (if not live yet), duplicate, rejected or remaining."""
    a = approved.select("id").distinct().withColumn("_a", F.lit(True))
    r = rejected.select("id").distinct().withColumn("_r", F.lit(True))
    x = live.select("id").distinct().withColumn("_l", F.lit(True))
    outcome = F.when(F.col("_a") & F.col("_l"), "duplicate").when(F.col("_a"), "approved").when(F.col("_r"), "rejected").otherwise("remaining")
    return queue.join(a, "id", "left").join(r, "id", "left").join(x, "id", "left").withColumn("outcome", outcome).drop("_a", "_r", "_l")


def uncovered(facts: DataFrame, sources: DataFrame) -> DataFrame:
    """U8s: facts that no insight has among its sources (id)."""
    return facts.join(sources.select("id").hint("merge"), "id", "left_anti")


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """U9s: equality as multisets."""
    return not a.exceptAll(b).limit(1).count() and not b.exceptAll(a).limit(1).count()


def hash_difference(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """U10s: values that only one side has, with the side."""
    only_a = a.select(column).subtract(b.select(column)).withColumn("only_in", F.lit("left"))
    return only_a.unionByName(b.select(column).subtract(a.select(column)).withColumn("only_in", F.lit("right")))


def last_by_id(rows: DataFrame, order: str) -> DataFrame:
    """U12s and R15: the last row of each id."""
    names = [c for c in rows.columns if c != "id"]
    return rows.groupBy("id").agg(F.max_by(F.struct(*names), order).alias("_r")).select("id", "_r.*")


def fill_source(facts: DataFrame, source: str) -> DataFrame:
    """Stamps an owner where it is missing or blank; running it again changes nothing."""
    if not source.strip():
        raise ValueError("a source is needed")
    return facts.withColumn("source", F.when(text.stripped(F.coalesce("source", F.lit(""))) == "", source).otherwise(F.col("source")))
