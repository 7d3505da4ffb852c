import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from factloom.functions import text
from factloom.operators import insights, rank, setops, similar, store_view
from factloom.session import cut


def fact(i, content, kind="bug", **more):
    return {"id": i, "kind": kind, "content": content, "source_date": "2026-06-01", **more}


def random_facts(seed, n=60):
    rnd = random.Random(seed)
    pool = [f"w{i}" for i in range(30)]
    out = []
    for i in range(n):
        base = rnd.sample(pool, rnd.randint(1, 9)) if not out or rnd.random() < 0.4 else list(rnd.choice(out)[1])
        if rnd.random() < 0.5:
            base[rnd.randrange(len(base))] = rnd.choice(pool)
        out.append((f"f{i:03}", base))
    return [fact(i, " ".join(w), rnd.choice(["bug", "config"])) for i, w in out]


def sets(rows):
    return {r["id"]: (r["kind"], frozenset(re.findall("[a-z0-9]+", r["content"]))) for r in rows}


@pytest.mark.parametrize("seed, low", [(1, 0.3), (2, 0.5), (3, 0.85)])
def test_pairs_equal_brute_force(make_facts, seed, low, now):
    rows = random_facts(seed)
    s = sets(rows)
    want = {(a, b) for a in s for b in s if a < b and s[a][0] == s[b][0] and len(s[a][1] & s[b][1]) / len(s[a][1] | s[b][1]) >= low}
    f = store_view.tidy(make_facts(*rows))
    assert {(r.id_a, r.id_b) for r in similar.duplicate_pairs(f, now, low).collect()} == want


def test_no_table_that_grows_is_broadcast(make_facts, now, monkeypatch):
    # with Spark's default threshold tables of sets passed through the driver, as estimates take a list of tokens for one
    plans = []
    monkeypatch.setattr(similar, "cut", lambda df: plans.append(df._jdf.queryExecution().toString()) or cut(df))
    f = store_view.tidy(make_facts(*random_facts(4)))
    for made in (similar.duplicate_pairs(f, now, 0.6), similar.duplicate_clusters(f, now, 0.6), similar.synthesis_clusters(f)):
        plans.append(made._jdf.queryExecution().toString())
    joins = [line for plan in plans for line in plan.split("== Physical Plan ==")[1].splitlines() if "BroadcastHashJoin" in line]
    # one small table may be: the parts that are split into blocks, at most one in BLOCK classes
    assert all("part" in line for line in joins), joins


@pytest.mark.parametrize("seed, low, block", [(5, 0.3, 7), (6, 0.45, 1000), (7, 0.8, 5)])
def test_blocks_equal_prefixes(make_facts, seed, low, block):
    long = [fact(f"long{i}", " ".join(f"v{j}" for j in range(i, 300 + i))) for i in (0, 20, 90)]
    f = store_view.tidy(make_facts(*random_facts(seed, 90), *long))
    _, classes = similar.token_classes(f, text.content_tokens(F.col("content")), F.col("kind"))
    one, other = ({(r.a, r.b): round(r.overlap, 9) for r in made.collect()} for made in (similar._block_pairs(classes, low, block), similar._prefix_pairs(classes, low)))
    assert one and one == other


@pytest.mark.parametrize("seed", range(3))
def test_clusters_of_copies_equal_those_of_all_pairs(make_facts, seed):
    rnd = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta"]
    f = store_view.tidy(make_facts(*[fact(f"f{i:02}", " ".join(rnd.sample(words, rnd.randint(2, 3)))) for i in rnd.sample(range(70), 70)]))
    tokens = text.content_tokens(F.col("content"))
    want = {tuple(r) for r in similar.greedy_clusters(f, similar.similar_pairs(f, tokens, F.col("kind"), 0.5)).collect()}
    assert {tuple(r) for r in similar.clusters_of(f, tokens, 0.5).collect()} == want


def test_components_and_greedy_differ_as_they_should(make_facts, spark):
    rows = store_view.tidy(make_facts(fact("a", "x"), fact("c", "z"), fact("b", "y")))
    pairs = spark.createDataFrame([("a", "b"), ("b", "c")], "id_a string, id_b string")
    assert {r.label for r in similar.label_components(pairs).collect()} == {"a"}
    got = {r.id: r.cluster for r in similar.greedy_clusters(rows, pairs).collect()}
    assert got == {"a": "a", "b": "a", "c": "c"}


@pytest.mark.parametrize("seed", range(4))
def test_greedy_equals_first_fit_replay(make_facts, spark, seed):
    rnd = random.Random(seed)
    names = [f"n{i:02}" for i in rnd.sample(range(30), 30)]
    links = {tuple(sorted(rnd.sample(names, 2))) for _ in range(35)}
    near = {n: {b if a == n else a for a, b in links if n in (a, b)} for n in names}
    clusters: list[list[str]] = []
    for n in names:
        for c in clusters:
            if any(m in near[n] for m in c):
                c.append(n)
                break
        else:
            clusters.append([n])
    want = {n: c[0] for c in clusters for n in c if near[n]}
    rows = store_view.tidy(make_facts(*[fact(n, n) for n in names]))
    pairs = spark.createDataFrame(sorted(links), "id_a string, id_b string")
    assert {r.id: r.cluster for r in similar.greedy_clusters(rows, pairs).collect()} == want


def test_duplicate_lifecycle(make_facts, now):
    text = "alpha beta gamma delta epsilon zeta eta theta"
    f = store_view.tidy(make_facts(
        fact("b", text), fact("curated-1", text + "!", confidence=0.5), fact("c", text, "config"), fact("d", ""), fact("e", None), fact("g", text, invalid_at="2026-01-01T00:00:00Z"), fact("h", text, status=" Superseded\n"),
    ))
    clusters = similar.duplicate_clusters(f, now)
    # what is superseded or no longer valid is in no cluster
    assert {r.id: r.canonical for r in clusters.collect()} == {"b": "curated-1", "curated-1": "curated-1"}
    done = {r.id: r for r in similar.apply_duplicates(f, clusters, "2026-06-13T00:00:00Z").collect()}
    assert done["b"].status == "superseded" and done["b"].invalid_at == "2026-06-13T00:00:00Z" and done["g"].invalid_at == "2026-01-01T00:00:00Z" and done["c"].status == "current"
    with pytest.raises(ValueError):
        similar.check_manifest(clusters, clusters.select("id", "canonical").limit(0))


def test_estimates_stay_small_over_rounds(spark):
    # a checkpoint keeps the estimates of its plan, and those of joins multiply: after some rounds the numbers alone filled the driver
    pairs = spark.createDataFrame([(f"n{i:02}", f"n{i + 1:02}") for i in range(40)], "id_a string, id_b string")
    labels = similar.label_components(pairs)
    assert {r.label for r in labels.collect()} == {"n00"}
    assert int(str(labels._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 10**12


def test_applied_duplicates_are_not_broadcast(make_facts, spark):
    f = store_view.tidy(make_facts(fact("a", "x"), fact("b", "y")))
    clusters = spark.createDataFrame([("a", "bug", "a", "a"), ("b", "bug", "a", "a")], "id string, kind string, cluster string, canonical string")
    done = similar.apply_duplicates(f, clusters, "2026-06-13T00:00:00Z")
    assert "BroadcastHashJoin" not in done._jdf.queryExecution().toString()
    assert {r.id: r.superseded_by for r in done.collect()} == {"a": None, "b": "a"}


def test_copies_make_no_pairs_of_facts(make_facts, monkeypatch):
    # two linked sets of 30 copies each: once 1,770 pairs, now each fact has at most one link to an earlier one of the other set
    seen = []
    first_fit = similar._first_fit
    monkeypatch.setattr(similar, "_first_fit", lambda placed, links, nodes=None: seen.append(links.count()) or first_fit(placed, links, nodes))
    f = store_view.tidy(make_facts(*[fact(f"f{i:02}", "alpha beta gamma" if i % 2 else "alpha beta delta") for i in range(60)]))
    assert {r.cluster for r in similar.synthesis_clusters(f).collect()} == {"f00"}
    assert seen[0] <= 60


def test_versions_never_consolidate(make_facts):
    f = store_view.tidy(make_facts(
        fact("a", "upgrade the database engine to version 14 now", "config", source_date="2026-06-01"), fact("b", "upgrade the database engine to version 15 now", "config", source_date="2026-06-02"),
        fact("c", "PR 12 keeps the ledger of the kernel weekly", "config", source_date="2026-06-01"), fact("d", "PR 13 keeps the ledger of the kernel weekly", "config", source_date="2026-06-02"),
        fact("e", "one two", "config"), fact("f", "one two", "config"),
    ))
    assert {r.id: r.canonical for r in similar.consolidation_clusters(f).collect()} == {"c": "d", "d": "d"}


def test_contradictions_order_by_date(make_facts, now):
    f = store_view.tidy(make_facts(
        fact("a", "the kernel owns the ledger today", "decision", source_date="2026-06-05"), fact("b", "the kernel owns no ledger at all", "correction", source_date="2026-06-01"), fact("c", "the kernel owns a ledger", "bug"), fact("s", "the kernel owns the old ledger", status="superseded"),
    ))
    row = similar.contradiction_pairs(f, now).collect()
    assert [(r.earlier, r.later, r.gap_days) for r in row] == [("b", "a", 4)]
    assert similar.top_contradictions(f, now, 0).count() == 0
    top = similar.top_contradictions(f, now, 1).first()
    assert (top.earlier, top.later, top.dropped, top.counted_from) == ("b", "a", 0, 0.42)


def test_insights_cover_sources(make_facts, now):
    text = "alpha beta gamma delta epsilon zeta eta theta"
    f = store_view.tidy(make_facts(fact("a", text), fact("b", text), fact("z", "other words here")))
    clusters = similar.synthesis_clusters(f)
    made = insights.insights(clusters, f)
    row = made.first()
    assert row.recurrence == 2 and row.confidence == 0.8 and row.theme == "alpha, beta, delta, epsilon, eta"
    assert [r.id for r in setops.uncovered(f, insights.insight_sources(made, clusters)).collect()] == ["z"]
    told = insights.insights(clusters, f, synthesizer=lambda c: "Could you share more?").first()
    assert told.content == row.content == "Recurring bug (seen 2x, 2026-06-01): alpha, beta, delta, epsilon, eta. Most recent: " + text
    assert row.id == "ins_" + hashlib.sha256(b"bug:alpha, beta, delta, epsilon, eta:a,b").hexdigest()[:10]
    better = insights.insights(clusters, f, synthesizer=lambda c: " Keep the list sorted by name. ").first()
    assert (better.content, better.synthesized_by, better.id) == ("Keep the list sorted by name.", "llm", row.id)
    made_facts = insights.insight_facts(made)
    assert [r.id for r in rank.bm25_scores(made_facts, "alpha theta", now).collect()] == [row.id]


def test_insight_ids_hash_every_source(make_facts, spark):
    # more sources than 10,000, of which ids once hashed only number and sum
    names = [f"n{i}" for i in range(10_500)]
    clusters = spark.createDataFrame([(n, "bug", "n0") for n in names] + [("z1", "bug", "z0"), ("z0", "bug", "z0")], "id string, kind string, cluster string")
    f = store_view.tidy(make_facts(*[fact(n, "alpha beta") for n in names], fact("z0", "gamma"), fact("z1", "gamma")))
    got = {r.recurrence: r.id for r in insights.insights(clusters, f).collect()}
    assert got == {n: "ins_" + hashlib.sha256(seed.encode()).hexdigest()[:10] for n, seed in ((10_500, "bug:alpha, beta:" + ",".join(sorted(names))), (2, "bug:gamma:z0,z1"))}


def test_insights_broadcast_no_facts(make_facts):
    f = store_view.tidy(make_facts(fact("a", "alpha beta"), fact("b", "alpha beta")))
    made = insights.insights(similar.synthesis_clusters(f), f)
    assert "BroadcastHashJoin" not in made._jdf.queryExecution().toString()
    assert made.first().recurrence == 2


def test_covered_are_the_sources_of_insights(make_facts, spark):
    f = store_view.tidy(make_facts(*[fact(n, "alpha beta") for n in "abc"], fact("d", "gamma")))
    clusters = spark.createDataFrame([(n, "bug", "a") for n in "abc"] + [("d", "bug", "d")], "id string, kind string, cluster string")
    sources = insights.insight_sources(insights.insights(clusters, f), clusters)
    assert sorted(r.id for r in insights.covered(clusters).collect()) == sorted(r.id for r in sources.collect()) == ["a", "b", "c"]


def test_tidy_shuffles_only_what_is_asked_for(make_facts):
    f = make_facts(fact("a", " x ", " Bug ", invalid_at="2026-01-01"), fact("b", None))
    slim, whole = store_view.tidy(f, ("kind", "content", "day", "valid_to", "provenance")), store_view.tidy(f)
    assert sorted(slim.collect()) == sorted(whole.select(*slim.columns).collect())
    scan = [line for line in slim._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Aggregate" in line]
    assert scan and all("evidence" not in line and "session" not in line for line in scan)


def test_set_operations(make_facts):
    f = store_view.tidy(make_facts(fact("a", "The cat"), fact("b", "cat"), fact("c", "dog")))
    assert sorted(r.id for r in setops.dedup_text(f).collect()) == ["a", "c"]
    with pytest.raises(ValueError):
        setops.append_batch(f, f.limit(1))
    with pytest.raises(ValueError):
        setops.fill_source(f, " ")
    assert setops.same_rows(f.select("id"), f.select("id")) and not setops.same_rows(f.select("id"), f.select("id").limit(1))
    assert setops.replace_curated(f, f.filter("id = 'a'").withColumn("id", F.lit("curated-x"))).count() == 4
