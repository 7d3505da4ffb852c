"""One object over a store for callers that want results rather than operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import values as V
from factloom.operators import attest, graph, ingest, insights, rank, reports, setops, similar, store_view
from factloom.session import cut
from factloom.sources.store import FactStore


class RecallEngine:
    """Recall, existence checks and the batch path over one table of facts. The clock is a parameter."""

    def __init__(self, spark: SparkSession, facts: DataFrame, now: str, sources: str | list[str] | None = None):
        self.spark, self.sources = spark, sources
        self.facts, self.now = store_view.tidy(facts), F.to_timestamp(F.lit(now))

    def recall(self, query: str, budget: int = V.DEFAULT_BUDGET, per_date: int = V.MAX_PER_DATE, **more) -> DataFrame:
        """R7; ``more`` is what ``rank.select_recall`` takes besides: verdicts, vectors, graph, insights, superseded facts."""
        return rank.select_recall(self.facts, query, self.now, budget, per_date, self.sources, **more)

    def recall_text(self, query: str, budget: int = V.DEFAULT_BUDGET, **more) -> str:
        return rank.render_recall(self.recall(query, budget, **more), None, budget)

    def hybrid(self, query: str, vectors: DataFrame, query_vector: list[float], model: str) -> DataFrame:
        """J4 with R1 as its lexical side: fused ids with their reserved marks."""
        seeds = rank.ranked(rank.bm25_scores(self.facts, query, self.now, self.sources)).select("id", "rank")
        return graph.fuse(seeds, graph.dense_ranks(self.facts, vectors, query_vector, self.now, model))

    def expanded(self, query: str, seeds: int = 10) -> DataFrame:
        """The best matches, then what the concept graph adds."""
        top = rank.ranked(rank.bm25_scores(self.facts, query, self.now, self.sources).orderBy(*rank.rank_order()).limit(seeds))
        more = graph.expand(self.facts, top.select("id"), self.now)
        return top.select("id", "rank", F.lit("match").alias("via")).unionByName(more.select("id", (F.col("rank") + seeds).alias("rank"), F.lit("graph").alias("via")))

    def existence(self, query: str) -> DataFrame:
        return rank.existence(self.facts, query, self.now)

    def briefing(self, query: str) -> DataFrame:
        return rank.briefing(self.facts, query, self.now)


def rebuild(store: FactStore, lines: DataFrame, now: str = "", min_share: float = 0.5, key: bytes | None = None, key_id: str = "", model: str = "", vectors: DataFrame | None = None) -> dict:
    """C11: session lines to events to facts, merged into a store behind gates; returns what it did.

    The newly made row of an id wins; every other fact stays with all its columns; new facts are numbered on from the greatest ord. Then in
    this order: review queue, contradiction queue (a failure there blocks nothing), health gate (facts, none malformed), shrink gate,
    signatures (with a ``key``), graph export, promotion (the old store becomes a backup first), plan for the vectors, insights. What was
    made lies beside the store: review, contradictions, attestations, graph-nodes, graph-edges, sidecar-plan, insights. A refused rebuild writes none of it.
    """
    clock = F.to_timestamp(F.lit(now)) if now else F.current_timestamp()
    made = ingest.facts_from_events(ingest.sanitised(lines)).withColumns({"status": F.lit("current"), "evidence": F.array("evidence")})
    live = store.load()
    before = live.count()
    merged = cut(setops.merged_store(live, made, [F.col("source_date"), F.col("id")]))
    after = merged.count()
    view = cut(store_view.tidy(store_view.whole(merged)))
    result = {"promoted": False, "before": before, "after": after}
    review = cut(reports.promotion_queue(view))
    result["review"] = review.count()
    try:
        pairs = similar.top_contradictions(view, clock)
        result["contradictions"] = pairs.count()
    except Exception as why:  # noqa: BLE001
        pairs, result["contradictions"] = None, f"not checked: {type(why).__name__}"
    malformed = merged.filter(F.col("id").isNull() | F.col("content").isNull() | F.col("source_date").isNull()).limit(1).count()
    if not after or malformed or after < min_share * before:
        return result
    made_insights = insights.insights(cut(similar.synthesis_clusters(view)), view)
    artifacts = {"review": review, "graph-nodes": graph.graph_nodes(view), "graph-edges": graph.graph_edges(view), "insights": made_insights}
    if pairs is not None:
        artifacts["contradictions"] = pairs
    if key is not None:
        artifacts["attestations"] = attest.sign(view, key, key_id, now)
    if vectors is not None:
        artifacts["sidecar-plan"] = graph.sidecar_plan(view, vectors, model)
    store.replace_all(merged)
    for name, rows in artifacts.items():
        store.write_artifact(rows, name)
    return result | {"promoted": True, "artifacts": sorted(artifacts), "duplicate_pairs": similar.duplicate_pairs(view, clock).count()}
