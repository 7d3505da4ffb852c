"""Similar pairs of facts and their clusters (survey 2.9 J1, J2; 2.10 C1 to C4).

Equal token sets of one part are one class; classes are compared, members follow from them. High similarities come from an exact
prefix join: of two token sets with Jaccard similarity s, the rarest ``size - ceil(s * size) + 1`` tokens of both share one, so classes
meet under those only, and a 256-bit parity sketch drops most false candidates before the sets are compared. Under low similarities
nearly all tokens belong to that prefix; there every class of a part is held against every other, block by block, by exact bitmaps.

Joins of tables that grow with the facts say ``merge``: Spark takes a list of tokens for one token, so by its estimates
such tables would pass through the driver as broadcasts.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.functions import text
from factloom.functions import values as V
from factloom.operators import pair_kernels as K
from factloom.operators.numbering import numbered
from factloom.operators.store_view import current
from factloom.session import cut, discard, release, written

#: Similarities below this are found block by block; it changes the cost only, not the result
BLOCKED_BELOW = 0.5
#: Classes of a block
BLOCK = 32768


def token_classes(rows: DataFrame, tokens: Column, part: Column, more: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Members (id, no, *more) and classes (no, part, sig) of equal token sets of one part. Rows without tokens are in none."""
    sig = F.array_sort(F.transform(tokens, lambda t: F.xxhash64(t)))
    signed = rows.select("id", *more, part.alias("part"), sig.alias("sig")).filter(F.size("sig") > 0)
    signed = cut(signed.withColumn("c1", F.xxhash64("part", "sig")).withColumn("c2", F.xxhash64(F.lit(7), "sig", "part")))
    grouped = signed.groupBy("c1", "c2").agg(F.first("part").alias("part"), F.first("sig").alias("sig"))
    classes = cut(grouped.withColumn("no", F.monotonically_increasing_id()))
    members = cut(signed.select("id", *more, "c1", "c2").join(classes.select("c1", "c2", "no").hint("merge"), ["c1", "c2"]).select("id", "no", *more))
    return members, classes.select("no", "part", "sig")


def _prefix_pairs(classes: DataFrame, low: float) -> DataFrame:
    """(a, b, overlap), a < b: classes of one part with at least this similarity, by the prefix join."""
    release(classes.sparkSession)
    held = classes.select(F.explode("sig").alias("t")).groupBy(F.col("t").bitwiseAND(F.lit(K.BUCKETS - 1)).alias("bucket")).agg(F.count(F.lit(1)).alias("n")).toArrow()
    counts = np.zeros(K.BUCKETS, np.int64)
    counts[held["bucket"].to_numpy()] = held["n"].to_numpy()
    # another part gives other keys, so parts meet by chance only
    masked = classes.select("no", F.xxhash64("part").alias("mask"), "sig")
    posted = masked.mapInArrow(K.postings(low, classes.sparkSession.sparkContext.broadcast(counts)), K.POSTING)
    a, b = (posted.select("key", *[F.col(c).alias(f"{c}_{side}") for c in ("no", "size", "place", "s0", "s1", "s2", "s3")]) for side in "ab")
    need = F.ceil((F.col("size_a") + F.col("size_b")) * F.lit(low / (1 + low)) - F.lit(1e-9))
    most = F.least("place_a", "place_b") + F.least(F.col("size_a") - F.col("place_a"), F.col("size_b") - F.col("place_b"))
    apart = sum((F.bit_count(F.col(f"s{k}_a").bitwiseXOR(F.col(f"s{k}_b"))) for k in range(4)), F.lit(0))
    met = a.join(b.hint("merge"), "key").filter((F.col("no_a") < F.col("no_b")) & (most >= need) & (apart <= F.col("size_a") + F.col("size_b") - 2 * need))
    candidates = cut(met.select(F.col("no_a").alias("a"), F.col("no_b").alias("b")).distinct())
    del posted, a, b, met
    release(classes.sparkSession)
    left, right = (classes.select(F.col("no").alias(side), F.col("part").alias(f"part_{side}"), F.col("sig").alias(f"sig_{side}")) for side in "ab")
    scored = candidates.join(left.hint("merge"), "a").join(right.hint("merge"), "b").filter(F.col("part_a") == F.col("part_b"))
    return scored.select("a", "b", text.jaccard(F.col("sig_a"), F.col("sig_b")).alias("overlap")).filter(F.col("overlap") >= low)


def _block_pairs(classes: DataFrame, low: float, block: int = BLOCK) -> DataFrame:
    """(a, b, overlap), a < b: classes of one part with at least this similarity; each pair of blocks of a part is one cell."""
    large = classes.groupBy("part").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > block).select("part", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    # at most one part in ``block`` classes is split, so this table is small at any size
    cells = large.agg(F.coalesce(F.sum(F.col("blocks") * (F.col("blocks") + 1) / 2), F.lit(0))).first()[0]
    split = classes.join(F.broadcast(large), "part", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    placed = split.withColumn("mine", F.pmod(F.xxhash64("no"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select("part", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "mine", "no", "sig")
    # few rows are much work here, so partitions aren't left to be merged by their bytes
    spread = placed.repartition(min(2000, 32 + 4 * int(cells)), "part", "lo", "hi")
    return spread.groupBy("part", "lo", "hi").applyInArrow(K.block_overlaps(low), K.PAIR)


def class_pairs(classes: DataFrame, low: float) -> DataFrame:
    return _block_pairs(classes, low) if low < BLOCKED_BELOW else _prefix_pairs(classes, low)


def similar_pairs(rows: DataFrame, tokens: Column, part: Column, low: float, high: float | None = None) -> DataFrame:
    """(id_a, id_b, overlap): pairs of ids of one part with low <= Jaccard (< high). Rows without tokens never pair."""
    members, classes = token_classes(rows, tokens, part)
    left, right = members.select(F.col("no").alias("a"), F.col("id").alias("x")), members.select(F.col("no").alias("b"), F.col("id").alias("y"))
    linked = cut(class_pairs(classes, low))
    del classes
    release(rows.sparkSession)
    linked = linked.filter(F.col("overlap") < high) if high is not None else linked
    pairs = linked.join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("x", "y", "overlap")
    if high is None or high > 1:
        copies = left.join(right.withColumnRenamed("b", "a").hint("merge"), "a").filter(F.col("x") < F.col("y"))
        pairs = pairs.unionAll(copies.select("x", "y", F.lit(1.0).alias("overlap")))
    return pairs.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"), "overlap")


def duplicate_pairs(facts: DataFrame, now: Column, similarity: float = V.DEDUP_SIMILARITY) -> DataFrame:
    """Pairs of current facts of one kind."""
    return similar_pairs(current(facts, now), text.content_tokens(F.col("content")), F.col("kind"), similarity)


def contradiction_pairs(facts: DataFrame, now: Column, low: float = V.CONTRADICTION_LOW, high: float = V.CONTRADICTION_HIGH) -> DataFrame:
    """Pairs of current facts across the watched kinds: the later one supersedes; gap in days, 0 if a date is missing."""
    watched = current(facts, now).filter(F.col("kind").isin(*V.WATCHED_KINDS))
    pairs = similar_pairs(watched, text.content_tokens(F.col("content")), F.lit(0), low, high)
    dates = watched.select("id", F.col("day").cast("date").alias("day"))
    both = pairs.join(dates.select(F.col("id").alias("id_a"), F.col("day").alias("day_a")), "id_a").join(dates.select(F.col("id").alias("id_b"), F.col("day").alias("day_b")), "id_b")
    later_b = F.coalesce(F.col("day_b") >= F.col("day_a"), F.lit(True))
    return both.select(
        F.when(later_b, F.col("id_a")).otherwise(F.col("id_b")).alias("earlier"), F.when(later_b, F.col("id_b")).otherwise(F.col("id_a")).alias("later"),
        F.round("overlap", 3).alias("overlap"), F.coalesce(F.abs(F.datediff("day_b", "day_a")), F.lit(0)).alias("gap_days"),
    )


def top_contradictions(facts: DataFrame, now: Column, most: int = V.CONTRADICTION_TOP, low: float = V.CONTRADICTION_LOW, high: float = V.CONTRADICTION_HIGH, bands: tuple[float, ...] = (0.7, 0.55, 0.42)) -> DataFrame:
    """The most overlapping pairs of J2, and how many were left out.

    The number of pairs grows with the square of the facts of one wording, and fast as the overlap falls, so pairs are made down to
    the first of ``bands`` above which there are ``most`` of them (to ``low`` at last), by the exact prefix of that band. ``dropped`` counts
    the pairs left out down to there, which ``counted_from`` tells.
    """
    for floor in [b for b in bands if low < b < high] + [low]:
        pairs = cut(contradiction_pairs(facts, now, floor, high))
        total = pairs.count()
        if total >= most or floor == low:
            break
    return pairs.orderBy(F.desc("overlap"), "earlier", "later").limit(most).withColumns({"dropped": F.lit(max(total - most, 0)).cast("long"), "counted_from": F.lit(floor)})


def _least_reachable(links: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(x, label): for links x -> y the least node reachable from x, itself included.

    Labels spread along the links and jump by labels of labels, until none changes. With ``nodes`` (x, no) those of one ``no`` also
    reach all before them; that is a running minimum, as links from each to the one before would take a round for each.
    """
    spark = links.sparkSession
    links = cut(links.distinct())
    if nodes is None:
        nodes = links.select("x").unionAll(links.select(F.col("y").alias("x"))).distinct().withColumn("no", F.col("x"))
        own = F.col("least")
    else:
        own = F.min("least").over(W.partitionBy("no").orderBy("x").rowsBetween(W.unboundedPreceding, W.currentRow))
    labels, path = written(nodes.select("x", "no", F.col("x").alias("least")).select("x", "no", own.alias("label")))
    while True:
        near = links.join(labels.select(F.col("x").alias("y"), "label").hint("merge"), "y").groupBy("x").agg(F.min("label").alias("near"))
        jump = labels.select(F.col("x").alias("label"), F.col("label").alias("jump"))
        moved = labels.join(near.hint("merge"), "x", "left").join(jump.hint("merge"), "label").select("x", "no", F.least("label", "near", "jump").alias("least"), F.col("label").alias("before"))
        after, next_path = written(moved.select("x", "no", own.alias("label"), "before"))
        changed = after.filter("label < before").limit(1).count()
        labels = after.select("x", "no", "label")
        discard(spark, path)
        path = next_path
        del near, jump, moved, after
        release(spark)
        if not changed:
            return labels.select("x", "label")


def label_components(edges: DataFrame) -> DataFrame:
    """(id, label): the least id connected by edges (id_a, id_b)."""
    both = edges.select(F.col("id_a").alias("x"), F.col("id_b").alias("y")).unionAll(edges.select(F.col("id_b").alias("x"), F.col("id_a").alias("y")))
    return _least_reachable(both).withColumnRenamed("x", "id")


def duplicate_clusters(facts: DataFrame, now: Column, similarity: float = V.DEDUP_SIMILARITY) -> DataFrame:
    """(id, kind, cluster, canonical) of facts in clusters of at least two.

    Canonical is a curated fact first, then the highest confidence, the earliest date, the least id.
    """
    pool = current(facts, now).select("id", "kind", "content", "confidence", "source_date")
    members, classes = token_classes(pool, text.content_tokens(F.col("content")), F.col("kind"), ("kind", "confidence", "source_date"))
    pairs = class_pairs(classes, similarity)
    labels = label_components(pairs.select(F.col("a").alias("id_a"), F.col("b").alias("id_b"))).withColumnRenamed("id", "no")
    named = members.join(labels.hint("merge"), "no", "left").withColumn("group", F.coalesce("label", "no"))
    order = F.struct((~F.col("id").startswith("curated-")).alias("a"), (-F.col("confidence")).alias("b"), F.coalesce("source_date", F.lit("9999-12-31")).alias("c"), "id")
    best = named.groupBy("group").agg(F.min("id").alias("cluster"), F.min(order).alias("best"), F.count(F.lit(1)).alias("n")).filter("n >= 2")
    return named.select("id", "kind", "group").join(best.select("group", "cluster", F.col("best.id").alias("canonical")).hint("merge"), "group").select("id", "kind", "cluster", "canonical")


def apply_duplicates(facts: DataFrame, clusters: DataFrame, now: str) -> DataFrame:
    """Duplicates become superseded by their canonical fact and stop being valid now at the latest."""
    losers = clusters.filter(F.col("id") != F.col("canonical")).select("id", "canonical")
    at = F.to_timestamp(F.lit(now))
    marked = facts.join(losers.hint("merge"), "id", "left")
    hit = F.col("canonical").isNotNull()
    ends = F.coalesce(F.col("valid_to") <= at, F.lit(False))
    return (
        marked.withColumn("status", F.when(hit, "superseded").otherwise(F.col("status")))
        .withColumn("superseded_by", F.when(hit, F.col("canonical")).otherwise(F.col("superseded_by")))
        .withColumn("superseded_at", F.when(hit, now).otherwise(F.col("superseded_at")))
        .withColumn("supersession_reason", F.when(hit, "near-duplicate").otherwise(F.col("supersession_reason")))
        .withColumn("invalid_at", F.when(hit & ~ends, now).otherwise(F.col("invalid_at")))
        .drop("canonical")
    )


def greedy_clusters(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, kind, cluster) by first fit in order of ord: a fact joins the first cluster with a linked member.

    Clusters never merge, so the order counts. A fact joins the cluster of an earlier linked fact, of several the one
    opened first, so its cluster is the first fact that links reach by steps to earlier facts only; that is found
    by spreading labels, without replaying the list. Facts without links are clusters of their own and left out.
    """
    placed = numbered(rows.select("id", "kind", "ord"), [F.asc("ord"), F.asc("id")], "p")
    p, q = placed.select(F.col("id").alias("id_a"), "p"), placed.select(F.col("id").alias("id_b"), F.col("p").alias("q"))
    ends = pairs.join(p.hint("merge"), "id_a").join(q.hint("merge"), "id_b")
    return _first_fit(placed, ends.select(F.greatest("p", "q").alias("x"), F.least("p", "q").alias("y")))


def _first_fit(placed: DataFrame, links: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(id, kind, cluster) of facts (id, kind, p) by links x -> y of places to earlier ones, and from ``nodes`` to those of their ``no`` before them."""
    labels = _least_reachable(links, nodes)
    opened = placed.select(F.col("p").alias("label"), F.col("id").alias("cluster"))
    return labels.join(placed.select(F.col("p").alias("x"), "id", "kind").hint("merge"), "x").join(opened.hint("merge"), "label").select("id", "kind", "cluster")


def clusters_of(pool: DataFrame, tokens: Column, similarity: float) -> DataFrame:
    """C2 over the similar facts (id, kind, ord) of each kind, without making all pairs of facts.

    Facts of one class are linked, so each reaches those before it. Of the members of a linked class before a fact, the last one reaches
    all that the others reach, so the fact is linked to that one only.
    """
    members, classes = token_classes(pool, tokens, F.col("kind"), ("kind", "ord"))
    placed = cut(numbered(members, [F.asc("ord"), F.asc("id")], "p"))
    release(pool.sparkSession)
    linked = cut(class_pairs(classes, similarity).select("a", "b"))
    del classes
    release(pool.sparkSession)
    heads = placed.groupBy("no").agg(F.count(F.lit(1)).alias("n"), F.min("p").alias("p"))
    a, b = (heads.select(F.col("no").alias(s), F.col("n").alias(f"n_{s}"), F.col("p").alias(f"p_{s}")) for s in "ab")
    ends = cut(linked.join(a.hint("merge"), "a").join(b.hint("merge"), "b"))
    single = ends.filter("n_a = 1 and n_b = 1").select(F.greatest("p_a", "p_b").alias("x"), F.least("p_a", "p_b").alias("y"))
    several = ends.filter("n_a > 1 or n_b > 1").select("a", "b")
    both = several.withColumn("no", F.col("a")).unionAll(several.withColumn("no", F.col("b"))).join(placed.select("no", "p").hint("merge"), "no")
    before = W.partitionBy("a", "b").orderBy("p").rowsBetween(W.unboundedPreceding, W.currentRow)
    of_a, of_b = (F.last(F.when(F.col("no") == F.col(s), F.col("p")), ignorenulls=True).over(before) for s in "ab")
    crossed = both.select(F.col("p").alias("x"), F.when(F.col("no") == F.col("a"), of_b).otherwise(of_a).alias("y")).filter("y is not null")
    met = ends.select(F.col("a").alias("no")).unionAll(ends.select(F.col("b").alias("no"))).unionAll(heads.filter("n > 1").select("no")).distinct()
    nodes = placed.select(F.col("p").alias("x"), "no").join(met.hint("merge"), "no", "left_semi").select("x", "no")
    return _first_fit(placed, single.unionAll(crossed), nodes)


def synthesis_clusters(facts: DataFrame, similarity: float = V.SYNTHESIS_SIMILARITY, floor: float = V.SYNTHESIS_CONFIDENCE) -> DataFrame:
    """C2 over current facts of enough confidence, per kind."""
    pool = facts.filter((F.col("status") != "superseded") & (F.col("confidence") >= floor))
    return clusters_of(pool, text.synthesis_tokens(F.col("content")), similarity)


def consolidation_clusters(facts: DataFrame, similarity: float = V.CONSOLIDATION_SIMILARITY, same_date: bool = False) -> DataFrame:
    """(id, kind, cluster, canonical) of current durable facts that restate each other on several dates.

    Facts of fewer than 3 tokens stay out. Canonical is the greatest (confidence, date, id).
    """
    tokens = text.consolidation_tokens(F.col("content"))
    pool = cut(facts.filter((F.col("status") == "current") & F.col("kind").isin(*V.DURABLE_KINDS)).withColumn("tokens", tokens).filter(F.size("tokens") >= 3))
    found = clusters_of(pool, F.col("tokens"), similarity)
    rows = found.join(pool.select("id", "confidence", "date_key").hint("merge"), "id")
    best = rows.groupBy("cluster").agg(
        F.max(F.struct("confidence", "date_key", "id")).alias("best"), F.count(F.lit(1)).alias("n"), F.count_distinct("date_key").alias("dates")
    )
    kept = best.filter((F.col("n") >= 2) & (F.lit(same_date) | (F.col("dates") >= 2)))
    return rows.join(kept.select("cluster", F.col("best.id").alias("canonical")), "cluster").select("id", "kind", "cluster", "canonical")


def apply_consolidation(facts: DataFrame, clusters: DataFrame) -> DataFrame:
    """Losers become superseded; their validity stays open."""
    losers = clusters.filter(F.col("id") != F.col("canonical")).select("id", "canonical")
    hit = F.col("canonical").isNotNull()
    return (
        facts.join(losers, "id", "left").withColumn("status", F.when(hit, "superseded").otherwise(F.col("status")))
        .withColumn("superseded_by", F.when(hit, F.col("canonical")).otherwise(F.col("superseded_by"))).drop("canonical")
    )


def check_manifest(clusters: DataFrame, manifest: DataFrame) -> None:
    """Raises unless the losers and their canonical facts are just those of a reviewed manifest (id, canonical)."""
    mine = clusters.filter(F.col("id") != F.col("canonical")).select("id", "canonical")
    if mine.exceptAll(manifest).limit(1).count() or manifest.exceptAll(mine).limit(1).count():
        raise ValueError("the clusters differ from the reviewed manifest")


def bulk_archive(facts: DataFrame, date: str, noise: tuple[str, ...] = ("status", "dispatch", "merge", "config"), never: tuple[str, ...] = ("correction",)) -> DataFrame:
    """C4: (id, tier) of the facts of one bulk date to archive.

    Tier A: noise kinds. Tier B: of at least three facts of one kind whose first six words agree, all but the one of
    highest confidence (the first by ord on ties).
    """
    rows = facts.filter((F.col("date_key") == date) & ~F.col("kind").isin(*never)).withColumn("key", text.leading_key(F.col("content")))
    a = rows.filter(F.col("kind").isin(*noise)).select("id", F.lit("A").alias("tier"))
    group = W.partitionBy("kind", "key")
    b = (
        rows.filter(F.col("kind").isin("directive", "decision", "bug", "architecture", "content"))
        .withColumn("n", F.count(F.lit(1)).over(group)).withColumn("nth", F.row_number().over(group.orderBy(F.desc("confidence"), "ord")))
        .filter("n >= 3 and nth > 1").select("id", F.lit("B").alias("tier"))
    )
    return a.unionByName(b)


def supersede(facts: DataFrame, ids: list[str], by: str | None, reason: str, now: str) -> DataFrame:
    """Marks facts as superseded by another one."""
    hit = F.col("id").isin(ids)
    return (
        facts.withColumn("status", F.when(hit, "superseded").otherwise(F.col("status"))).withColumn("superseded_at", F.when(hit, now).otherwise(F.col("superseded_at")))
        .withColumn("superseded_by", F.when(hit, F.lit(by)).otherwise(F.col("superseded_by"))).withColumn("supersession_reason", F.when(hit, reason).otherwise(F.col("supersession_reason")))
    )


def find_by_terms(facts: DataFrame, terms: list[str]) -> DataFrame:
    """F16: facts whose content holds all terms."""
    keep = F.lit(True)
    for t in terms:
        keep = keep & F.contains(F.lower("content"), F.lit(t.lower()))
    return facts.filter(keep)
