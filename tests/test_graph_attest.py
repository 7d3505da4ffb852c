import hashlib

import pytest
from pyspark.sql import functions as F

from factloom.functions import text
from factloom.operators import attest, graph, reports, store_view


def fact(i, content, **more):
    return {"id": i, "kind": "decision", "content": content, "source_date": "2026-06-01", **more}


def test_bridge_over_a_rare_concept(make_facts, spark, now):
    f = store_view.tidy(make_facts(fact("a", "kernel ledger", session="s1"), fact("b", "ledger volcano", session="s2"), fact("c", "other words", session="s1"), fact("d", "ledger gone", status="superseded"), fact("e", "unrelated", session="s3")))
    seeds = spark.createDataFrame([("a",)], "id string")
    got = [(r.id, round(r.graph_score, 6)) for r in graph.expand(f, seeds, now).orderBy("rank").collect()]
    assert [g[0] for g in got] == ["c", "b"]
    assert got[1][1] == pytest.approx(0.3 / 3 * 0.9 * 0.5 ** (12 / 180), abs=1e-6)
    assert graph.graph_edges(f).filter("type = 'MENTIONS'").count() == 9


def test_rrf_example(spark):
    seeds = spark.createDataFrame([("s1", 1), ("s2", 2)], "id string, rank long")
    dense = spark.createDataFrame([("d1", 1), ("s1", 2)], "id string, dense_rank long")
    got = {r.id: r for r in graph.fuse(seeds, dense).collect()}
    assert got["s1"].rrf == pytest.approx(1 / 61 + 1 / 62) and got["d1"].rrf == pytest.approx(1 / 61) and got["s2"].rrf == pytest.approx(1 / 62)
    assert [r[0] for r in sorted(((k, v.rank) for k, v in got.items()), key=lambda x: x[1])] == ["s1", "d1", "s2"]
    assert [k for k, v in got.items() if v.reserved] == ["d1"]


def test_dense_skips_stale_orphan_and_bad_vectors(make_facts, spark, now):
    f = store_view.tidy(make_facts(fact("a", "one"), fact("b", "two"), fact("c", "three")))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    v = spark.createDataFrame(
        [("a", "m", sha("one"), [1.0, 0.0]), ("b", "m", sha("old"), [1.0, 0.0]), ("c", "m", sha("three"), [float("nan"), 1.0]), ("c", "m", sha("three"), [0.0, 0.0]), ("x", "m", sha("x"), [1.0, 0.0]), ("c", "m", sha("three"), None), ("c", "m", sha("three"), [1.0])],
        "fact_id string, model_id string, content_sha256 string, vector array<float>",
    )
    assert [(r.id, round(r.cosine, 6)) for r in graph.dense_ranks(f, v, [2.0, 0.0], now, "m").collect()] == [("a", 1.0)]
    plan = {r.id: r.action for r in graph.sidecar_plan(f, v, "m").collect()}
    assert plan == {"a": "keep", "b": "embed", "c": "keep", "x": "prune"}


def test_signatures_and_revocations(make_facts):
    f = store_view.tidy(make_facts(fact("a", "one"), fact("b", "two"), fact("c", "three", status="superseded", superseded_by="a"), fact("d", None)))
    signed = attest.sign(f.filter("id <> 'b'"), b"k", "k1", "now")
    bent = f.withColumn("content", F.when(F.col("id") == "a", "uno").otherwise(F.col("content")))
    assert {r.id: r.verdict for r in attest.verify(bent, signed, b"k").collect()} == {"a": "tampered", "b": "unsigned", "c": "valid", "d": "valid"}
    assert {r.verdict for r in attest.verify(f, signed, b"other").collect()} == {"tampered", "unsigned"}
    verdicts = attest.verify(bent, signed, b"k")
    assert attest.recallable(f, verdicts).count() == 3 and attest.recallable(f, verdicts, strict=True).count() == 2
    events = attest.revocations(f, b"k")
    assert attest.audit(f, events, b"k").count() == 0
    live_again = f.withColumn("status", F.lit("current"))
    assert [r.finding for r in attest.audit(live_again, events, b"k").collect()] == ["resurrected"]
    assert [r.finding for r in attest.audit(f, events.limit(0), b"k").collect()] == ["unattested"]
    assert [attest.exit_code({"tampered": 1}), attest.exit_code({"unsigned": 1}, strict=True), attest.exit_code({}, 1), attest.exit_code({}, 0, 1, strict_revocations=True), attest.exit_code({"valid": 9})] == [2, 3, 4, 5, 0]


def test_parents_and_chain(make_facts, spark):
    f = make_facts(fact("a", "one"), fact("b", "two")).withColumn("parent_fact_ids", F.when(F.col("id") == "b", F.array(F.lit("a"), F.lit("gone"))))
    got = {r.id: r.parents for r in attest.parent_hashes(f, f).collect()}
    want = {hashlib.sha256(b'{"absent_parent_id":"gone"}').hexdigest(), hashlib.sha256(b'{"content":"one","id":"a","kind":"decision"}').hexdigest()}
    assert got["a"] == [] and set(got["b"]) == want and got["b"] == sorted(want)
    b = spark.createDataFrame([(1, "x", None), (2, "y", "x"), (3, "z", "w")], "seq long, digest string, parent_digest string")
    assert [r.seq for r in attest.chain_breaks(b).collect()] == [3]


@pytest.mark.parametrize("content", ['plain', 'q"uote \\ back/slash', "line\nend\ttab", "smart “quotes” ✅ ü", "", None])
def test_hashes_equal_canonical_json(make_facts, content):
    f = make_facts(fact("a", content, evidence=[("e1", "p/q", 3), (None, "x", None)]), fact("b", content, evidence=None))
    rows = {r.id: r for r in attest.hashed(f).collect()}
    assert rows["a"].fact_hash == hashlib.sha256(attest.canonical_bytes({"id": "a", "kind": rows["a"].kind, "content": content})).hexdigest()
    assert rows["a"].source_hash == hashlib.sha256(attest.canonical_bytes([{"event_id": "e1", "path": "p/q", "line": 3}, {"path": "x"}])).hexdigest() and rows["b"].source_hash == hashlib.sha256(b"[]").hexdigest()


def test_retired_keys_still_vouch(make_facts):
    f = make_facts(fact("a", "one", status="superseded", superseded_by="b"), fact("b", "two"))
    old = attest.revocations(f, b"old")
    assert [r.finding for r in attest.audit(f, old, b"new").collect()] == ["invalid", "unattested"]
    assert attest.audit(f, old, b"new", [b"older", b"old"]).count() == 0


def test_envelopes_without_their_fields_are_tampered(make_facts):
    f = make_facts(fact("a", "one"))
    signed = attest.sign(f, b"k", "k1", "now")
    for column in ("signature", "key_id", "signed_at", "alg", "fact_hash", "parent_fact_ids"):
        broken = signed.withColumn(column, F.lit(None).cast(signed.schema[column].dataType))
        assert attest.verify(f, broken, b"k").first().verdict == "tampered"


def test_changed_parent_makes_its_child_suspect(make_facts):
    f = make_facts(fact("a", "one"), fact("b", "two"), fact("c", "three")).withColumn("parent_fact_ids", F.when(F.col("id") == "b", F.array(F.lit("a"))))
    signed = attest.sign(f, b"k", "k1", "now")
    assert {r.verdict for r in attest.verify(f, signed, b"k").collect()} == {"valid"}
    bent = f.withColumn("content", F.when(F.col("id") == "a", "uno").otherwise(F.col("content")))
    verdicts = attest.verify(bent, signed, b"k")
    assert {r.id: r.verdict for r in verdicts.collect()} == {"a": "tampered", "b": "parent-suspect", "c": "valid"}
    assert [sorted(r.id for r in attest.recallable(f, verdicts, strict).collect()) for strict in (False, True)] == [["b", "c"], ["c"]]


def test_contract_json():
    assert attest.contract_text({"b": 1.0, "a": [-0.0, 2.5, None, True]}) == '{"a":[0,2.5,null,true],"b":1}'
    with pytest.raises(ValueError):
        attest.contract_text({"a": float("inf")})


def test_claim_faults(spark):
    good = ("team", 0.5, "2026-01-01T00:00:00.000000Z", "2026-01-02T00:00:00.000000Z")
    rows = [good, ("nobody", 1.5, "2026-01-01", None), (None, None, None, None)]
    got = attest.claim_faults(spark.createDataFrame(rows, "scope string, confidence double, valid_from string, valid_to string")).collect()
    assert [r.faults for r in got] == [[], ["scope", "confidence", "valid_from"], ["scope", "confidence"]]


def test_reports(make_facts, spark):
    f = store_view.tidy(make_facts(fact("a", "[DECISION] use the hook", session="s"), fact("b", "[DIRECTIVE] Use the hook", session="s"), fact("c", "edit AGENTS.md", kind="config"), fact("d", "low", confidence=0.3)))
    got = {r.id: (r.target, r.risk) for r in reports.promotion_queue(f).collect()}
    assert got == {"a": ("hooks/review", "high"), "c": ("AGENTS.md", "medium")}
    gold = spark.createDataFrame([("q", "a")], "query string, id string")
    included = spark.createDataFrame([("q", "a"), ("q", "b")], "query string, id string")
    row = reports.recall_quality(gold, included, f.select("id", graph.session_of(f).alias("session_key"))).first()
    assert (row.recall, row.companionship, row.companion_rate) == (1.0, 1.0, 1.0)
    suite = spark.createDataFrame([("x", "id:b"), ("y", "token:Hook"), ("z", "id:none")], "label string, ground string")
    results = spark.createDataFrame([(q, i + 1, c, t) for q in "xyz" for i, (c, t) in enumerate([("a", "the hook"), ("b", "other")])], "label string, rank int, id string, content string")
    assert {r.label: r.first_hit for r in reports.first_hits(suite, results).collect()} == {"x": 2, "y": 1, "z": None}
    kept, gone = reports.purge(f, ["a"], "agents.MD")
    assert kept.count() == 2 and gone.count() == 2
    assert reports.gate(0.88, 0.97, 0.9) and not reports.gate(0.93, 0.97, 0.9)
    lines = spark.createDataFrame([("p", 1, "x=supersecretvalue"), ("p", 2, "nothing")], "path string, line_no int, value string")
    assert [r.key for r in reports.live_secrets(lines, {"TOKEN": "supersecretvalue", "SHORT": "x"}).collect()] == ["TOKEN"]
    assert [r.last for r in spark.range(1).select(reports.queue_freshness(F.to_timestamp(F.lit("2026-06-12")), F.to_timestamp(F.lit("2026-06-14"))).stale.alias("last")).collect()] == [True]


def test_scrubbed_stub_encoder(spark):
    got = spark.createDataFrame([("x",), (None,), ("x",)], "t string").select(attest.stub_encoder()("t").alias("v")).collect()
    assert got[0].v == got[2].v and len(got[0].v) == 32 and abs(sum(a * a for a in got[1].v) - 1) < 1e-5
    assert text.query_pairs(["a", "b", "c"]) == [("a", "b"), ("b", "c")]
