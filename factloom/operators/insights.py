"""Insights from clusters of facts (survey A4, A5)."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.functions import scoring, text
from factloom.functions import values as V
from factloom.operators.numbering import numbered
from factloom.session import cut, release


def themes(clusters: DataFrame, facts: DataFrame, top: int = 5) -> DataFrame:
    """A4: (cluster, theme): the terms that most members have; ties in order of the term."""
    return _themes(clusters.select("id", "cluster").join(facts.select("id", "content").hint("merge"), "id"), top)


def _themes(rows: DataFrame, top: int = 5) -> DataFrame:
    terms = rows.select("cluster", F.explode(text.synthesis_tokens(F.col("content"))).alias("term"))
    counts = terms.groupBy("cluster", "term").agg(F.count(F.lit(1)).alias("n"))
    best = counts.withColumn("nth", F.row_number().over(W.partitionBy("cluster").orderBy(F.desc("n"), "term"))).filter(F.col("nth") <= top)
    return best.groupBy("cluster").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "term"))), lambda x: x["term"]), ", ").alias("theme"))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (cluster, at, part), in that order, to (cluster, digest): the SHA-256 of the head (at 0) and of the other parts joined by commas."""
    cluster, sha, listed = None, hashlib.sha256(), 0
    for b in batches:
        done: list[tuple[str, str]] = []
        for name, at, part in zip(*(c.to_pylist() for c in b.columns)):
            if name != cluster:
                if cluster is not None:
                    done.append((cluster, sha.hexdigest()))
                cluster, sha, listed = name, hashlib.sha256(), 0
            sha.update(("," + part if at and listed else part).encode())
            listed += at
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], pa.string()) for k in range(2)], ["cluster", "digest"])
    if cluster is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.string()) for x in (cluster, sha.hexdigest())], ["cluster", "digest"])


def _digests(heads: DataFrame, clusters: DataFrame) -> DataFrame:
    """(cluster, digest): SHA-256 in hex of a cluster's head and the sorted list of its ids. The ids are hashed as they pass by, so a list of any length is held by no task."""
    parts = heads.select("cluster", F.lit(0).alias("at"), F.col("head").alias("part")).unionAll(clusters.select("cluster", F.lit(1).alias("at"), F.col("id").alias("part")))
    return parts.repartition("cluster").sortWithinPartitions("cluster", "at", "part").mapInArrow(_digest, "cluster string, digest string")


def insights(clusters: DataFrame, facts: DataFrame, min_size: int = 2, synthesizer: Callable[[str], str] | None = None) -> DataFrame:
    """A5: one insight per cluster (C2) of at least ``min_size`` members.

    Columns: id, cluster, of_kind, theme, recurrence, first_date, last_date, confidence, content, synthesized_by. The id hashes kind, theme
    and the sorted ids of the facts, which are rows of ``insight_sources``. The content tells kind, recurrence, span of dates, theme and the
    first 160 characters of the latest member (the highest ord on ties); a synthesizer (U1) may replace it with a text that passes the lesson gate.
    Members without date leave the span as it is; an insight without any has empty dates.
    """
    # read twice, so facts are joined once
    rows = cut(clusters.select("id", "cluster").join(facts.select("id", "kind", "source_date", "confidence", "content", "ord").hint("merge"), "id"))
    release(rows.sparkSession)
    date = F.when(text.stripped("source_date") != "", F.col("source_date"))
    grouped = rows.groupBy("cluster").agg(
        F.first("kind").alias("of_kind"), F.count(F.lit(1)).alias("recurrence"), F.coalesce(F.min(date), F.lit("")).alias("first_date"), F.coalesce(F.max(date), F.lit("")).alias("last_date"),
        F.avg("confidence").alias("mean"), F.max_by("content", F.struct(F.coalesce("source_date", F.lit("")), "ord")).alias("latest"),
    ).filter(F.col("recurrence") >= min_size)
    named = grouped.join(_themes(rows).hint("merge"), "cluster", "left").fillna({"theme": ""})
    digests = _digests(named.select("cluster", F.concat("of_kind", F.lit(":"), "theme", F.lit(":")).alias("head")), clusters)
    named = named.join(digests.hint("merge"), "cluster")
    confidence = F.round(F.least(F.lit(0.95), 0.7 + 0.05 * F.col("recurrence"), F.col("mean")), 2)
    span = F.when(F.col("first_date") == F.col("last_date"), F.col("first_date")).otherwise(F.concat("first_date", F.lit(".."), "last_date"))
    told = F.concat(
        F.lit("Recurring "), "of_kind", F.lit(" (seen "), F.col("recurrence").cast("string"), F.lit("x"), F.when(span != "", F.concat(F.lit(", "), span)).otherwise(""), F.lit("): "), "theme",
        F.lit(". Most recent: "), F.substring("latest", 1, 160),
    )
    made = named.select(
        F.concat(F.lit("ins_"), F.substring("digest", 1, 10)).alias("id"), "cluster", "of_kind", "theme", "recurrence", "first_date", "last_date", confidence.alias("confidence"), told.alias("content")
    )
    if synthesizer is None:
        return made.withColumn("synthesized_by", F.lit("heuristic"))

    @F.pandas_udf("string")
    def write(contents: pd.Series) -> pd.Series:
        def one(content: str) -> str | None:
            try:
                return synthesizer(content)
            except Exception:  # noqa: BLE001
                return None

        return contents.map(one)

    better = made.withColumn("told", write("content")).withColumn("good", F.coalesce(text.is_lesson(F.col("told")), F.lit(False)))
    picked = better.withColumn("content", F.when(F.col("good"), text.stripped("told")).otherwise(F.col("content")))
    return picked.withColumn("synthesized_by", F.when(F.col("good"), "llm").otherwise("heuristic")).drop("told", "good")


def insight_facts(made: DataFrame) -> DataFrame:
    """Insights as tidied facts of kind ``insight``, which recall ranks like others; ord is their rank by size."""
    none = F.lit(None).cast("string")
    return ranked_insights(made).select(
        F.col("rank").alias("ord"), "id", F.lit("insight").alias("kind"), F.lit("current").alias("status"), "confidence", "content", F.lit(V.SHARED_SOURCE).alias("source"),
        F.col("last_date").alias("source_date"), F.when(F.col("last_date") == "", "unknown").otherwise(F.col("last_date")).alias("date_key"), scoring.parse_day(F.col("last_date")).alias("day"),
        F.lit(None).cast("timestamp").alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_to"), none.alias("superseded_by"), F.lit(False).alias("deprecated"), none.alias("trust"), none.alias("provenance"),
    )


def covered(clusters: DataFrame, min_size: int = 2) -> DataFrame:
    """(id): the facts of clusters that make insights, which are the sources of ``insight_sources`` without their insights' texts."""
    large = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_size)
    return clusters.select("id", "cluster").join(large.select("cluster").hint("merge"), "cluster", "left_semi").select("id")


def insight_sources(made: DataFrame, clusters: DataFrame) -> DataFrame:
    """(insight_id, id): the facts that an insight covers."""
    return made.select(F.col("id").alias("insight_id"), "cluster").join(clusters.select("cluster", "id").hint("merge"), "cluster").select("insight_id", "id")


def ranked_insights(made: DataFrame) -> DataFrame:
    """By size, then id."""
    return numbered(made, [F.desc("recurrence"), F.asc("id")], "rank")
