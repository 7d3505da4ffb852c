import random

import pytest
from pyspark.sql import functions as F

from factloom.operators import rank, store_view


def fact(i, content, **more):
    return {"id": i, "kind": "decision", "content": content, "source_date": "2026-06-01", **more}


def ids(df):
    return [r.id for r in rank.ranked(df).orderBy("rank").collect()]


def test_rare_terms_and_short_documents_win(make_facts, now):
    f = store_view.tidy(make_facts(fact("a", "alpha beta"), fact("b", "alpha alpha"), fact("c", "alpha " + "filler " * 40), fact("d", "gamma beta")))
    assert ids(rank.bm25_scores(f, "alpha", now))[-1] == "c"
    assert ids(rank.bm25_scores(f, "gamma alpha", now))[0] == "d"


def test_filters_of_status_validity_confidence_and_source(make_facts, now):
    f = store_view.tidy(make_facts(
        fact("a", "alpha"), fact("b", "alpha", status=" Superseded"), fact("c", "alpha", invalid_at="2026-06-13T00:00:00Z"), fact("d", "alpha", valid_at="2026-07-01T00:00:00Z"),
        fact("e", "alpha", confidence=0.5), fact("f", "alpha", confidence=None), fact("g", None), fact("h", "alpha", source="other"), fact(None, "alpha"),
    ))
    assert sorted(ids(rank.bm25_scores(f, "alpha", now))) == ["a", "h"]
    assert ids(rank.bm25_scores(f, "alpha", now, sources="other")) == ["h"]
    assert ids(rank.bm25_scores(f, "the of", now)) == []


def test_repeated_rows_count_once_and_empty_tables_work(make_facts, now):
    f = store_view.tidy(make_facts(fact("a", "alpha"), fact("a", "alpha")))
    assert f.count() == 1
    none = store_view.tidy(make_facts(fact("a", "alpha")).limit(0))
    assert rank.select_recall(none, "alpha", now).count() == 0
    assert rank.existence(none, "alpha", now).first().verdict == "unknown"


def test_extra_columns_with_clashing_names(make_facts, now):
    rows = make_facts(fact("a", "alpha")).withColumns({"score": F.lit(1), "rank": F.lit(2), "tokens": F.lit("x"), "n": F.lit(3)})
    assert ids(rank.bm25_scores(store_view.tidy(rows), "alpha", now)) == ["a"]


def test_date_cap_example(spark):
    rows = spark.createDataFrame([(i + 1, "A" if i < 6 else "B") for i in range(7)], "rank long, date_key string")
    got = [r.date_key for r in rank.date_capped(rows, 4).orderBy("position").collect()]
    assert got == list("AAAABAA")
    assert [r.position for r in rank.date_capped(rows, 0).orderBy("rank").collect()] == list(range(1, 8))


def test_budget_prefix_stops_at_first_overflow(spark):
    rows = spark.createDataFrame([(1, 10), (2, 10), (3, 10), (4, 1)], "position long, cost long")
    assert [r.position for r in rank.budget_prefix(rows, 26, 5).orderBy("position").collect()] == [1, 2]


def plain_reserved(rows, budget, header):
    used, kept = header, []
    for p, c, r in rows:
        if r:
            if used + c > budget:
                break
            used, kept = used + c, kept + [p]
    out, stopped = [], False
    committed = used
    spent = 0
    for p, c, r in rows:
        if p in kept:
            if not stopped:
                out.append(p)
            continue
        if stopped:
            continue
        if committed + spent + c > budget:
            stopped = True
            continue
        spent += c
        out.append(p)
    return out + [p for p in kept if p not in out]


@pytest.mark.parametrize("seed", range(6))
def test_reserved_budget_against_plain_restatement(spark, seed):
    rnd = random.Random(seed)
    rows = [(i + 1, rnd.randint(1, 9), rnd.random() < 0.3) for i in range(12)]
    df = spark.createDataFrame(rows, "position long, cost long, reserved boolean")
    got = [r.position for r in rank.reserved_budget(df, 30, 4).orderBy("final_position").collect()]
    assert got == plain_reserved(rows, 30, 4)


def test_superseded_on_demand(make_facts, now):
    f = store_view.tidy(make_facts(fact("a", "alpha beta gamma"), fact("b", "alpha beta delta", status="superseded"), fact("c", "alpha beta", invalid_at="2026-01-01"), fact("d", "alpha beta", confidence=0.1)))
    assert {r.id for r in rank.select_recall(f, "alpha beta", now).collect()} == {"a"}
    told = {r.id: r.line for r in rank.select_recall(f, "alpha beta", now, include_superseded=True).collect()}
    assert set(told) == {"a", "b", "c"} and "[SUPERSEDED] alpha" in told["b"] and "SUPERSEDED" not in told["a"]


def test_composed_recall(make_facts, now, spark):
    """Vectors, graph, insights, verification and reserved slots in one list."""
    import hashlib

    names = ["a", "b", "c", "v", "g", "t", "w"]
    texts = ["alpha beta gamma", "alpha beta delta", "alpha beta epsilon", "nothing lexical here", "gamma follows elsewhere", "alpha beta tampered", "alpha beta " + "word " * 900]
    f = store_view.tidy(make_facts(*[fact(i, t, session=f"s{i}") for i, t in zip(names, texts)]))
    verdicts = spark.createDataFrame([("t", "tampered"), ("a", "valid"), ("b", "unsigned")], "id string, verdict string")
    sha = {i: hashlib.sha256(t.strip().encode()).hexdigest() for i, t in zip(names, texts)}
    vectors = spark.createDataFrame([("v", "m", sha["v"], [1.0, 0.0]), ("a", "m", sha["a"], [0.0, 1.0]), ("b", "m", "stale", [1.0, 0.0])], "fact_id string, model_id string, content_sha256 string, vector array<float>")
    base = [r.id for r in rank.select_recall(f, "alpha beta", now, verdicts=verdicts).orderBy("position").collect()]
    assert set(base) == {"a", "b", "c", "w"}
    assert {r.id for r in rank.select_recall(f, "alpha beta", now, verdicts=verdicts, strict=True).collect()} == {"a", "c", "w"}
    fused = rank.select_recall(f, "alpha beta", now, per_date=1, verdicts=verdicts, vectors=vectors, query_vector=[1.0, 0.1], model="m").orderBy("position").collect()
    # v comes by its vector alone and is exempt from the cap
    assert {r.id for r in fused} == {"a", "b", "c", "w", "v"} and [r.id for r in fused].index("v") <= 1 and fused[0].matches == 5
    tight = rank.select_recall(f, "alpha beta", now, 25, verdicts=verdicts, vectors=vectors, query_vector=[1.0, 0.1], model="m").collect()
    assert "v" in {r.id for r in tight} and all(r.used <= 25 for r in tight)
    more = [r.id for r in rank.select_recall(f, "alpha beta", now, verdicts=verdicts, graph_expand=True).orderBy("position").collect()]
    assert "g" in more and set(more) > set(base)
    made = f.filter("id = 'a'").withColumns({"id": F.lit("ins_1"), "kind": F.lit("insight"), "content": F.lit("alpha beta belong together")})
    sources = spark.createDataFrame([("ins_1", "a"), ("ins_1", "b")], "insight_id string, id string")
    led = [r.id for r in rank.select_recall(f, "alpha beta", now, verdicts=verdicts, insights=made, insight_sources=sources).orderBy("position").collect()]
    assert led[0] == "ins_1" and set(led) == {"ins_1", "c", "w"}


def test_render_and_verdicts(make_facts, now):
    f = store_view.tidy(make_facts(fact("a", "alpha beta gamma"), fact("b", "alpha beta delta", source_date="2026-01-01")))
    chosen = rank.select_recall(f, "alpha beta", now)
    told = rank.render_recall(chosen, 2, 1000)
    assert told.startswith("Memory recall (2 matches, budget 1000 tokens):\n\n[2026-06-01] [DECISION]\nalpha beta gamma")
    assert rank.existence(f, "alpha beta", now).first().verdict == "exists"
    row = rank.existence(f, "delta epsilon zeta", now).first()
    assert row.verdict == "probable" and row.missing_terms == "epsilon zeta" and row.stale
    assert rank.briefing(f, "alpha", now).count() == 2
