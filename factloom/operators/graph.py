"""Concept graph of facts, its expansion, and fusion with vectors (survey J3, J4, J10, J13, X1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.functions import scoring, text
from factloom.functions import values as V
from factloom.operators.numbering import numbered
from factloom.operators.store_view import live


def session_of(facts: DataFrame) -> Column:
    tidy = text.stripped(F.coalesce("session", F.lit("")))
    return F.when(tidy == "", "unknown").otherwise(tidy)


def mentions(facts: DataFrame) -> DataFrame:
    """(id, concept)."""
    return facts.select("id", F.explode(text.concepts(F.col("content"))).alias("concept"))


def graph_nodes(facts: DataFrame) -> DataFrame:
    """(id, type, label), one row per node, of the last label in sort order."""
    parts = [
        facts.select(F.concat(F.lit("fact:"), "id").alias("id"), F.lit("fact").alias("type"), F.substring("content", 1, 80).alias("label")),
        facts.select(F.concat(F.lit("session:"), session_of(facts)).alias("id"), F.lit("session").alias("type"), session_of(facts).alias("label")),
        facts.filter(F.length(text.stripped("source_file")) > 0).select(F.concat(F.lit("source:"), "source_file").alias("id"), F.lit("source").alias("type"), F.col("source_file").alias("label")),
        mentions(facts).select(F.concat(F.lit("concept:"), "concept").alias("id"), F.lit("concept").alias("type"), F.col("concept").alias("label")),
    ]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionAll(p)
    return rows.groupBy("id", "type").agg(F.max("label").alias("label"))


def graph_edges(facts: DataFrame) -> DataFrame:
    """Distinct (source, target, type): fact DERIVED_FROM source, session SUPPORTS fact, fact MENTIONS concept."""
    fact = F.concat(F.lit("fact:"), "id")
    derived = facts.filter(F.length(text.stripped("source_file")) > 0).select(fact.alias("source"), F.concat(F.lit("source:"), "source_file").alias("target"), F.lit("DERIVED_FROM").alias("type"))
    supports = facts.select(F.concat(F.lit("session:"), session_of(facts)).alias("source"), fact.alias("target"), F.lit("SUPPORTS").alias("type"))
    mention = mentions(facts).select(fact.alias("source"), F.concat(F.lit("concept:"), "concept").alias("target"), F.lit("MENTIONS").alias("type"))
    return derived.unionAll(supports).unionAll(mention).distinct()


def expand(facts: DataFrame, seeds: DataFrame, now: Column, top: int = V.EXPANSION_TOP, include_superseded: bool = False) -> DataFrame:
    """(id, graph_score, rank) of the facts two steps from the seeds (id), over shared concepts and sessions.

    A shared concept adds 0.30 divided by the facts that mention it, a shared session 0.15 for each seed in it.
    Candidates pass the gates of recall; ties go by confidence, then ord.
    """
    about = mentions(facts)
    of_seeds = about.join(seeds.select("id").distinct(), "id", "left_semi").groupBy("concept").agg(F.count(F.lit(1)).alias("seeds"))
    members = about.join(of_seeds.select("concept"), "concept", "left_semi").groupBy("concept").agg(F.count(F.lit(1)).alias("members"))
    weight = of_seeds.join(members, "concept").select("concept", (V.CONCEPT_WEIGHT * F.col("seeds") / F.col("members")).alias("w"))
    by_concept = about.join(weight, "concept").groupBy("id").agg(F.sum("w").alias("w"))
    named = facts.select("id", session_of(facts).alias("session_key"))
    in_session = named.join(seeds.select("id").distinct(), "id", "left_semi").groupBy("session_key").agg((V.SESSION_WEIGHT * F.count(F.lit(1))).alias("w"))
    by_session = named.join(in_session, "session_key").select("id", "w")
    raw = by_concept.unionByName(by_session).groupBy("id").agg(F.sum("w").alias("raw")).join(seeds.select("id"), "id", "left_anti")
    gated = live(facts, now, include_superseded=include_superseded).join(raw, "id")
    score = F.col("raw") * F.col("confidence") * scoring.recency(F.col("kind"), F.col("day"), now) * scoring.supersession(F.col("deprecated"), F.col("status"), F.col("superseded_by")) * scoring.trust_factor(F.col("trust"), F.col("provenance"))
    order = [F.round("graph_score", 9).desc(), F.desc("confidence"), F.asc("ord")]
    best = gated.withColumn("graph_score", score).filter(F.col("graph_score") > 0).orderBy(*order).limit(top)
    return best.withColumn("rank", F.row_number().over(W.orderBy(*order))).select("id", "graph_score", "rank")


def cosine_to(vector: Column, query: list[float]) -> Column:
    """Cosine similarity with a literal vector; null for vectors of another length, zero or non-finite ones."""
    q = F.array(*[F.lit(float(x)) for x in query])
    dot = F.aggregate(F.zip_with(vector, q, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(F.aggregate(F.transform(vector, lambda a: a.cast("double") * a.cast("double")), F.lit(0.0), lambda s, x: s + x))
    own = sum(x * x for x in query) ** 0.5
    cosine = F.try_divide(dot, norm * F.lit(own))
    return F.when((F.size(vector) == len(query)) & (norm > 0) & ~F.isnan(cosine) & (F.abs(cosine) <= 1.000001), cosine)


def dense_ranks(facts: DataFrame, vectors: DataFrame, query: list[float], now: Column, model: str, top: int = V.DENSE_TOP, include_superseded: bool = False) -> DataFrame:
    """The dense side of J4: (id, cosine, dense_rank) of live facts by their vector; stale and orphan vectors don't count."""
    own = vectors.filter(F.col("model_id") == model).select(F.col("fact_id").alias("id"), "content_sha256", cosine_to(F.col("vector"), query).alias("cosine"))
    usable = own.filter(F.col("cosine").isNotNull()).groupBy("id", "content_sha256").agg(F.max("cosine").alias("cosine"))
    fresh = live(facts, now, include_superseded=include_superseded).withColumn("hash", text.content_hash(F.col("content"))).join(usable, "id").filter(F.col("hash") == F.col("content_sha256"))
    order = [F.round("cosine", 9).desc(), F.asc("ord")]
    return fresh.orderBy(*order).limit(top).withColumn("dense_rank", F.row_number().over(W.orderBy(*order))).select("id", "cosine", "dense_rank")


def fuse(seeds: DataFrame, dense: DataFrame, k: int = V.RRF_K, reserved: int = V.DENSE_RESERVED) -> DataFrame:
    """(id, rrf, rank, reserved): reciprocal rank fusion of two ranked lists (id, rank) and (id, dense_rank).

    Reserved are the first dense facts that are no seeds. Ties keep the order of the seeds, then of the dense list.
    """
    both = seeds.select("id", F.col("rank").alias("seed_rank")).join(dense.select("id", "dense_rank"), "id", "full_outer")
    rrf = F.coalesce(1.0 / (k + F.col("seed_rank")), F.lit(0.0)) + F.coalesce(1.0 / (k + F.col("dense_rank")), F.lit(0.0))
    order = [F.round("rrf", 12).desc(), F.asc_nulls_last("seed_rank"), F.asc("dense_rank")]
    kept = F.coalesce(F.col("dense_rank") <= reserved, F.lit(False)) & F.col("seed_rank").isNull()
    return numbered(both.withColumn("rrf", rrf), order, "rank").select("id", "rrf", "rank", kept.alias("reserved"))


def sidecar_plan(facts: DataFrame, vectors: DataFrame, model: str) -> DataFrame:
    """(id, action) that brings the vectors in line with the facts: keep, embed (missing or stale) or prune (orphan)."""
    have = vectors.filter((F.col("model_id") == model) & (F.size("vector") > 0)).select(F.col("fact_id").alias("id"), F.col("content_sha256").alias("have")).filter(F.col("id").isNotNull()).distinct()
    per_id = have.groupBy("id").agg(F.collect_set("have").alias("have"))
    want = facts.select("id", text.content_hash(F.col("content")).alias("want"))
    both = want.join(per_id, "id", "full_outer")
    action = F.when(F.col("want").isNull(), "prune").when(F.array_contains("have", F.col("want")), "keep").otherwise("embed")
    return both.select("id", F.coalesce(action, F.lit("embed")).alias("action"))


def concept_index(facts: DataFrame) -> DataFrame:
    """(concept, facts, sessions, kinds) of every concept."""
    rows = facts.withColumn("session_key", session_of(facts)).select("id", "session_key", "kind", F.explode(text.concepts(F.col("content"))).alias("concept"))
    return rows.groupBy("concept").agg(F.count_distinct("id").alias("facts"), F.count_distinct("session_key").alias("sessions"), F.array_join(F.sort_array(F.collect_set("kind")), ",").alias("kinds"))


def concept_links(facts: DataFrame) -> DataFrame:
    """(concept_a, concept_b, facts): how many facts mention both. A fact has at most eight concepts, so pairs grow with the facts only."""
    rows = facts.select("id", F.array_sort(text.concepts(F.col("content"))).alias("c"))
    pairs = F.flatten(F.transform("c", lambda x, i: F.transform(F.slice("c", i + 2, V.CONCEPTS_PER_FACT), lambda y: F.struct(x.alias("concept_a"), y.alias("concept_b")))))
    return rows.select(F.explode(pairs).alias("p")).select("p.*").groupBy("concept_a", "concept_b").agg(F.count(F.lit(1)).alias("facts"))
