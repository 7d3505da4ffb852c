"""Ranking and selection: BM25 recall, keyword query, diversity cap, token budget, verdicts (survey 2.8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.functions import scoring, text
from factloom.functions import values as V
from factloom.operators import attest, graph
from factloom.operators.numbering import numbered
from factloom.operators.store_view import live, scoped
from factloom.session import cut


#: More rows than a budget of V.MAX_BUDGET tokens can hold: the shortest line, such as ``[x] [K]`` and one letter, costs 2 tokens
MOST_INCLUDED = V.MAX_BUDGET // 2 + 25


def word_forms(terms: list[str]) -> list[str]:
    """The words of which ``text.stem`` makes these terms."""
    return sorted({form for t in terms for form in (t, t + "s", *([t[:-1] + "ies"] if t.endswith("y") else [])) if text.stem_text(form) == t})


def matched_words(content: Column, terms: list[str]) -> Column:
    """Array of (p, t): place and term of the words of a text that are query terms. Only those are stemmed."""
    forms = word_forms(terms)
    spots = F.filter(F.transform(text.raw_tokens(content), lambda t, i: F.struct(i.alias("p"), t.alias("t"))), lambda x: x["t"].isin(forms))
    return F.transform(spots, lambda x: F.struct(x["p"].alias("p"), text.stem(x["t"]).alias("t")))


def bm25_scores(facts: DataFrame, query: str, now: Column, sources=None, min_matched: int = 1, include_superseded: bool = False) -> DataFrame:
    """Matching live facts with ``score``, ``matched`` and ``pairs``.

    Statistics (A1, A2) cover the facts that pass the filters. The store is read and tokenised once; what goes on is
    a row of numbers for each live fact, and the content of those that match. The query's terms are literals, so scoring shuffles no tokens.
    Facts without content match nothing; equal scores order by pairs, matched, confidence, ord.
    """
    terms = text.query_terms(query)
    pool = scoped(live(facts, now, include_superseded=include_superseded), sources)
    if not terms:
        return pool.limit(0).withColumns({"score": F.lit(0.0), "matched": F.lit(0), "pairs": F.lit(0)})
    sized = pool.withColumn("size", F.size(text.raw_tokens(F.col("content")))).withColumn("own", matched_words(F.col("content"), terms))
    tokens = cut(sized.withColumn("content", F.when(F.size("own") > 0, F.col("content"))))

    def occurrences(term: str) -> Column:
        return F.size(F.filter("own", lambda x: x["t"] == term))

    tokens = tokens.withColumns({f"tf{i}": occurrences(t) for i, t in enumerate(terms)})
    stats = tokens.agg(F.count(F.lit(1)).alias("n"), F.avg("size").alias("avgdl"), *[F.count(F.when(F.col(f"tf{i}") > 0, 1)).alias(f"df{i}") for i in range(len(terms))])
    dates = tokens.groupBy("date_key").agg(F.count(F.lit(1)).alias("on_date"))
    scored = tokens.filter(F.size("own") > 0).crossJoin(F.broadcast(stats)).join(dates, "date_key")
    bm25, matched = F.lit(0.0), F.lit(0)
    for i in range(len(terms)):
        f = F.col(f"tf{i}")
        denominator = f + V.BM25_K1 * (1 - V.BM25_B + V.BM25_B * F.col("size") / F.col("avgdl"))
        bm25 = bm25 + F.when(f > 0, scoring.idf(F.col("n"), F.col(f"df{i}")) * f * (V.BM25_K1 + 1) / denominator).otherwise(0.0)
        matched = matched + F.when(f > 0, 1).otherwise(0)
    factors = (
        F.col("confidence") * scoring.recency(F.col("kind"), F.col("day"), now)
        * scoring.supersession(F.col("deprecated"), F.col("status"), F.col("superseded_by")) * scoring.trust_factor(F.col("trust"), F.col("provenance"))
        * (1.0 + F.greatest(F.lit(0), F.col("matched") - 1) * 3.0) * (1.0 + F.col("pairs") * 4.0) * scoring.bulk_date(F.col("on_date") / F.col("n"))
    )
    return (
        scored.withColumn("bm25", bm25).withColumn("matched", matched).filter((F.col("bm25") > 0) & (F.col("matched") >= min_matched))
        .withColumn("pairs", text.near_pairs(F.col("own"), text.query_pairs(terms)))
        .withColumn("score", F.col("bm25") * factors)
        .filter(F.col("score") > 0)
        .select(*facts.columns, "score", "matched", "pairs")
    )


def rank_order() -> list[Column]:
    # scores are compared at 9 decimals, so that the last bits of floating sums decide nothing
    return [F.round("score", 9).desc(), F.desc("pairs"), F.desc("matched"), F.desc("confidence"), F.asc("ord")]


def ranked(scored: DataFrame) -> DataFrame:
    """Adds ``rank`` from 1."""
    return numbered(scored, rank_order(), "rank")


def keyword_query(facts: DataFrame, terms: list[str], kind: str | None = None, since: str | None = None, limit: int | None = 20) -> DataFrame:
    """Facts by the number of terms their content holds as substrings; the first ``limit``, or all."""
    rows = facts
    if kind:
        rows = rows.filter(F.col("kind") == kind)
    if since:
        rows = rows.filter(F.col("date_key") >= since)
    low = F.lower("content")
    score = F.lit(0)
    for t in terms:
        score = score + F.when(F.contains(low, F.lit(t.lower())), 1).otherwise(0)
    found = rows.withColumn("score", score).filter(F.col("score") > 0)
    return found if limit is None else found.orderBy(F.desc("score"), "ord").limit(limit)


def date_capped(rows: DataFrame, per_date: int = V.MAX_PER_DATE, date: str = "date_key", exempt: Column | None = None) -> DataFrame:
    """Adds ``position``: the first ``per_date`` of each date keep their order, the others follow; 0 turns it off."""
    free = exempt if exempt is not None else F.lit(False)
    if per_date <= 0:
        return rows.withColumn("position", F.col("rank"))
    nth = F.row_number().over(W.partitionBy(date, free).orderBy("rank"))
    late = (~free & (nth > per_date)).cast("int")
    return numbered(rows.withColumn("late", late), [F.col("late"), F.col("rank")], "position").drop("late")


def budget_prefix(rows: DataFrame, budget: int, header: int = 0, cost: str = "cost") -> DataFrame:
    """The rows up to the first one with which header and costs exceed the budget; adds ``used``.

    The running sum is over one list, so hand it the front of the list only (see ``select_recall``).
    """
    used = F.sum(cost).over(W.orderBy("position").rowsBetween(W.unboundedPreceding, W.currentRow)) + F.lit(header)
    return rows.withColumn("used", used).filter(F.col("used") <= budget)


def reserved_budget(rows: DataFrame, budget: int, header: int = 0) -> DataFrame:
    """Rows with ``reserved`` are paid first, the others fill what is left; adds ``final_position`` and ``used``, what all of them cost.

    Both lists stop at their first row that doesn't fit; a reserved row that isn't paid is one of the others. Paid rows behind the
    end of the others follow at the tail. Both running sums are over one list, so hand in a bounded one.
    """
    running = W.orderBy("position").rowsBetween(W.unboundedPreceding, W.currentRow)
    spent_so_far = F.sum(F.when(F.col("reserved"), F.col("cost")).otherwise(0)).over(running) + F.lit(header)
    paid = rows.withColumn("paid", F.col("reserved") & (spent_so_far <= budget))
    spent = F.coalesce(F.sum(F.when(F.col("paid"), F.col("cost"))).over(W.partitionBy()), F.lit(0)) + F.lit(header)
    filled = spent + F.sum(F.when(F.col("paid"), 0).otherwise(F.col("cost"))).over(running)
    fits = paid.withColumn("fits", F.col("paid") | (filled <= budget))
    first_out = F.min(F.when(~F.col("fits"), F.col("position"))).over(W.partitionBy())
    kept = fits.withColumn("tail", F.coalesce((F.col("paid") & (F.col("position") > first_out)).cast("int"), F.lit(0))).filter("fits")
    used = F.sum("cost").over(W.partitionBy()) + F.lit(header)
    return kept.withColumn("used", used).withColumn("final_position", F.row_number().over(W.orderBy("tail", "position"))).drop("paid", "fits", "tail")


def select_recall(
    facts: DataFrame, query: str, now: Column, budget: int = V.DEFAULT_BUDGET, per_date: int = V.MAX_PER_DATE, sources=None, include_superseded: bool = False,
    verdicts: DataFrame | None = None, strict: bool = False, vectors: DataFrame | None = None, query_vector: list[float] | None = None, model: str = "",
    graph_expand: bool = False, insights: DataFrame | None = None, insight_sources: DataFrame | None = None,
) -> DataFrame:
    """The facts that go into an answer, with their rendered text: ranked, fused, expanded, led by insights, date-capped, within the budget.

    In this order: verification (V1, if there are ``verdicts``), BM25 (R1), fusion with the vectors nearest to ``query_vector`` (J4), facts that
    the concept graph adds (J3), insights in front instead of the facts they cover (R6, U8s), the cap per date (R3; reserved vectors' facts
    are exempt) and the budget (R4, or R5 if facts are reserved). ``position`` is the place in the capped list, ``matches`` the length of the whole
    list. Only the front of the list that the largest budget can hold goes on to the windows over one list.
    """
    budget = min(budget, V.MAX_BUDGET)
    terms = text.query_terms(query)
    least = text.min_matches(terms)
    pool = attest.recallable(scoped(facts, sources), verdicts, strict)
    scored = bm25_scores(pool, query, now, None, least, include_superseded)
    listed = scored.select("id", *[F.col(c) for c in ("score", "pairs", "matched", "confidence", "ord", "date_key")])
    semantic = vectors is not None and query_vector is not None
    if semantic or graph_expand:
        found = ranked(listed).select("id", "rank", F.lit(False).alias("reserved"))
        if semantic:
            dense = graph.dense_ranks(pool, vectors, query_vector, now, model, include_superseded=include_superseded)
            found = graph.fuse(found.select("id", "rank"), dense).select("id", "rank", "reserved")
        if graph_expand:
            found = cut(found)
            more = graph.expand(pool, found.select("id"), now, include_superseded=include_superseded)
            last = found.agg(F.coalesce(F.max("rank"), F.lit(0)).alias("last"))
            found = found.unionByName(more.crossJoin(F.broadcast(last)).select("id", (F.col("last") + F.col("rank")).alias("rank"), F.lit(False).alias("reserved")))
        listed = found.join(pool.select("id", "date_key"), "id")
        order = [F.asc("rank")]
    else:
        listed = listed.withColumn("reserved", F.lit(False))
        order = rank_order()
    shown = pool.select("id", "date_key", "kind", "content", "status")
    lead = F.lit(0)
    if insights is not None:
        leading = bm25_scores(scoped(insights, sources), query, now, None, least, include_superseded)
        leading = leading.orderBy(*rank_order()).limit(V.DENSE_LEAD_CAP) if semantic else leading
        leading = cut(ranked(leading).withColumn("reserved", F.lit(False)).select(*listed.columns))
        if insight_sources is not None:
            covered = insight_sources.join(leading.select(F.col("id").alias("insight_id")), "insight_id", "left_semi").select("id")
            listed = listed.join(covered, "id", "left_anti")
        listed = leading.withColumn("follows", F.lit(0)).unionByName(listed.withColumn("follows", F.lit(1)))
        shown = shown.unionByName(insights.select(*shown.columns))
        lead = F.col("follows")
    listed = cut(listed.withColumn("follows", lead))
    matches = listed.count()
    nth = F.row_number().over(W.partitionBy("date_key", "reserved").orderBy("follows", *order))
    late = (~F.col("reserved") & (nth > per_date)).cast("int") if per_date > 0 else F.lit(0)
    front = listed.withColumn("late", late).orderBy("late", "follows", *order).limit(MOST_INCLUDED)
    placed = front.withColumn("position", F.row_number().over(W.orderBy("late", "follows", *order))).select("id", "reserved", "position")
    rows = shown.join(F.broadcast(placed), "id").withColumn("line", render(F.col("date_key"), F.col("kind"), F.col("content"), F.col("status"), terms))
    costed = rows.withColumn("cost", text.token_estimate(F.col("line"))).withColumn("matches", F.lit(matches))
    header = len(recall_header(matches, budget)) // V.CHARS_PER_TOKEN
    if semantic:
        return reserved_budget(costed, budget, header).drop("position").withColumnRenamed("final_position", "position").drop("reserved")
    return budget_prefix(costed.drop("reserved"), budget, header)


def recall_header(matches: int, budget: int) -> str:
    return f"Memory recall ({matches} matches, budget {budget} tokens):"


def render(date: Column, kind: Column, content: Column, status: Column, terms: list[str], excerpt_chars: int = 320) -> Column:
    """One fact as text, with the excerpt of its content that says most about the query's terms."""
    mark = F.when(status == "superseded", "[SUPERSEDED] ").otherwise("")
    return F.concat(F.lit("["), date, F.lit("] ["), F.upper(F.when(kind == "", "fact").otherwise(kind)), F.lit("]\n"), mark, text.excerpt(content, terms, excerpt_chars))


def render_recall(included: DataFrame, matches: int | None, budget: int) -> str:
    """The recalled rows (at most some hundred, by the budget) as one text; ``matches`` is taken from them unless given."""
    rows = included.orderBy("position").select("line", "used", "matches").collect()
    if not rows:
        return ""
    matches, budget = rows[0].matches if matches is None else matches, min(budget, V.MAX_BUDGET)
    left = matches - len(rows)
    parts = [recall_header(matches, budget), *[r.line for r in rows]]
    parts += [f"[...{left} more results truncated by budget]"] if left > 0 else []
    return "\n\n".join([*parts, f"[{len(rows)} item(s), ~{rows[-1].used} tokens]"])


def existence(facts: DataFrame, query: str, now: Column, stale_days: int = V.CHECK_STALE_DAYS, pool_size: int = V.CHECK_POOL) -> DataFrame:
    """One row: does the store know about a query? Verdict, coverage, strong hits, freshness, staleness, advice."""
    terms = text.query_terms(query, V.CHECK_STOPWORDS, 2)
    hits = bm25_scores(facts, query, now)
    wanted = text.strings(terms)
    pool = hits.orderBy(*rank_order()).limit(pool_size).withColumn("covered", F.array_intersect(wanted, text.recall_tokens(F.col("content"))))
    size = max(len(terms), 1)
    top = pool.agg(
        F.array_distinct(F.flatten(F.collect_list("covered"))).alias("found"),
        F.coalesce(F.max(F.size("covered") / size), F.lit(0.0)).alias("overlap"),
        F.count(F.when(F.size("covered") >= 2, 1)).alias("strong_hits"),
    )
    whole = hits.agg(F.count(F.lit(1)).alias("hits"), F.max("day").alias("newest"))
    matched = F.filter(wanted, lambda t: F.array_contains(F.col("found"), t))
    verdict = F.when(F.col("hits") == 0, "unknown").when((F.col("overlap") >= 0.6) | (F.col("strong_hits") >= 2), "exists").when(F.size("found") > 0, "probable").otherwise("unknown")
    stale = F.coalesce(F.floor((F.unix_micros(now) - F.unix_micros("newest")) / F.lit(86400 * 10**6)) > stale_days, F.lit(False))
    return (
        top.crossJoin(whole)
        .select(
            F.lit(query).alias("query"), verdict.alias("verdict"), F.round(F.size("found") / size, 3).alias("term_coverage"),
            F.array_join(matched, " ").alias("matched_terms"), F.array_join(F.array_except(wanted, "found"), " ").alias("missing_terms"),
            "hits", "strong_hits", F.date_format("newest", "yyyy-MM-dd").alias("freshness"), stale.alias("stale"),
        )
        .withColumn("advice", F.when(F.col("verdict") == "exists", "known: cite the evidence").when(F.col("verdict") == "probable", "partly known: verify before denying").otherwise("unknown: verify before denying"))
    )


def briefing(facts: DataFrame, query: str, now: Column, citations: int = 6) -> DataFrame:
    """The best facts with citations, joined to the verdict."""
    top = bm25_scores(facts, query, now).orderBy(*rank_order()).limit(citations)
    rows = ranked(top).select("rank", "id", "kind", "date_key", F.substring("content", 1, 300).alias("citation"))
    return rows.crossJoin(F.broadcast(existence(facts, query, now).select("verdict", "freshness")))
