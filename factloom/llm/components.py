"""Problem 7: consolidating pairwise matches by alternating large-star and small-star rewrites.

Large-star links every larger neighbour of a node to the least id in its neighbourhood, small-star
the node itself and its smaller neighbours. Both keep components and end in stars around the least
id. Each round is two grouped joins; the edge table is cut from its lineage after every rewrite.

A node of very many neighbours is never collected: the least neighbour is a partial aggregate. It goes back to the
edges by broadcast for hubs, of which there can be at most HOT_SHARE, and by a shuffle for all others (``attach_counts``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import stripped
from factloom.llm.common import attach_counts
from factloom.session import cut


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _with_least(rows: DataFrame, least: DataFrame, total: int) -> DataFrame:
    """Rows (u, v) with the m of their u in ``least`` (u, m, n): n rows in all ways have this u, of ``total``."""
    return attach_counts(rows, least, "u", ["m"], "n", total)


def large_star(edges: DataFrame, total: int = 0) -> DataFrame:
    around = _both_ways(edges)
    least = around.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    rewritten = _with_least(around.filter(F.col("v") > F.col("u")), least, 2 * total).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rewritten.filter(F.col("u") != F.col("v")).distinct()


def small_star(edges: DataFrame, total: int = 0) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    rewritten = _with_least(down, least, total).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rewritten.unionAll(least.select("u", F.col("m").alias("v"))).filter(F.col("u") != F.col("v")).distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("v", "u"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (u, v): the least id linked to it directly or indirectly.

    Null ends and links of a node to itself are ignored; repeated links count once. Runs until a
    round of both rewrites leaves the edge table unchanged; the number of rounds grows with the
    logarithm of the longest chain.
    """
    edges = edges.filter(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = cut(edges)
    before = _mark(edges)
    while True:
        # a rewrite never adds edges, so the number before bounds the rows of both
        edges = cut(small_star(cut(large_star(edges, before[0])), before[0]))
        after = _mark(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def supersession_links(facts: DataFrame) -> DataFrame:
    """Links (u, v) between the ids of facts and what they name in superseded_by, if that is an id too.

    Both are stripped of white space of any kind and lower-cased. Every row of a fact counts; null or blank ends make no link.
    """
    tidy = facts.select(F.lower(stripped("id")).alias("u"), F.lower(stripped("superseded_by")).alias("v"))
    known = tidy.filter(F.col("u").isNotNull()).select(F.col("u").alias("v")).distinct()
    links = tidy.filter(F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v"))).distinct()
    return links.join(known, "v", "left_semi").select("u", "v")


def supersession_groups(facts: DataFrame) -> DataFrame:
    """(id, group_id) of every fact that is linked with another one; group_id is the least id of its component."""
    return connected_components(supersession_links(facts)).select(F.col("node").alias("id"), F.col("root").alias("group_id"))
