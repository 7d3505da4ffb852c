import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.functions import text as text_functions
from factloom.operators import attest, extras, similar, store_view


def fact(i, content, kind="decision", **more):
    return {"id": i, "kind": kind, "content": content, "source_date": "2026-06-01", **more}


def test_excerpt_takes_the_densest_window(spark):
    text = "x " * 300 + "alpha " + "y " * 300 + "alpha beta gamma " + "z " * 300
    got = spark.createDataFrame([(text,), ("short alpha",), (None,), ("q" * 500,)], "t string").select(text_functions.excerpt(F.coalesce("t", F.lit("")), ["alpha", "beta", "gamma"], 80).alias("e")).collect()
    assert "alpha beta gamma" in got[0].e and got[0].e.startswith("...") and got[0].e.endswith("...")
    assert got[1].e == "short alpha" and got[2].e == "" and got[3].e == "q" * 80


def test_entities_bind_hyphens(make_facts):
    f = make_facts(fact("a", "The Kernel of big-kernel and ledger"), fact("b", None))
    got = {r.id: r.entities for r in extras.entities(f, ["kernel", "ledger", "big"]).collect()}
    assert got == {"a": ["decision", "kernel", "ledger"], "b": ["decision"]}


def test_judged_pairs(make_facts, now):
    f = store_view.tidy(make_facts(
        fact("a", "the kernel owns the ledger today"), fact("b", "the kernel owns no ledger at all", "correction", source_date="2026-06-09"), fact("c", "the kernel drops the ledger today", "directive", source_date="2026-06-05"),
    ))
    pairs = similar.contradiction_pairs(f, now)
    told = {(r.earlier, r.later): r["class"] for r in extras.judged(pairs, f, lambda a, b: "Verdict: yes" if "no ledger" in b else "verdict: NO").collect()}
    assert told[("a", "b")] == "confirmed" and told[("a", "c")] == "dropped"

    def broken(a, b):
        raise OSError

    assert {r["class"] for r in extras.judged(pairs, f, broken).collect()} == {"borderline"}
    assert {r["class"] for r in extras.judged(pairs, f).collect()} == {"unreviewed"}


def test_signing_extras(make_facts):
    f = store_view.tidy(make_facts(fact("a", "one"), fact("b", "two"), fact("c", "three", status="superseded")))
    signed = attest.sign(f.filter("id <> 'b'"), b"k", "k1", "now")
    verdicts, cache = extras.verify_cached(f, signed, b"k", None)
    again, _ = extras.verify_cached(f, signed, b"k", cache)
    assert {r.id: r.verdict for r in verdicts.collect()} == {r.id: r.verdict for r in again.collect()} == {"a": "valid", "b": "unsigned", "c": "valid"}
    assert {r.id: r.action for r in extras.resign_plan(f, signed.withColumn("signature", F.lit("x")), b"k").collect()} == {"a": "resign", "b": "sign", "c": "resign"}
    receipt = {"schema": 1, "verifier": "v", "checked_at": "now", "counts": {"valid": 2}}
    good = extras.sign_receipt(receipt, b"k")
    assert extras.verify_receipt(good, b"k") and not extras.verify_receipt({**good, "counts": {}}, b"k")
    with pytest.raises(ValueError):
        extras.sign_receipt({"schema": 1}, b"k")
    none = attest.revocations(f, b"k").limit(0)
    assert extras.backfill_revocations(f, none, b"k").count() == 1
    assert extras.sign_insights(f.select("id", "content"), None, "k", "now") is None and extras.sign_insights(f.select("id", "content"), b"k", "k", "now").count() == 3


def test_files(spark, tmp_path):
    body = np.arange(6, dtype=np.float32).reshape(3, 2)
    header = json.dumps({"m": {"dtype": "F32", "shape": [3, 2], "data_offsets": [0, 24]}}).encode()
    raw = len(header).to_bytes(8, "little") + header + body.tobytes()
    (tmp_path / "m").write_bytes(raw)
    matrix = extras.read_matrix(str(tmp_path / "m"), hashlib.sha256(raw).hexdigest())
    assert (matrix == body).all()
    with pytest.raises(ValueError):
        extras.read_matrix(str(tmp_path / "m"), "0" * 64)
    encode = extras.static_encoder(matrix, lambda t: [1, 2] if t else [])
    got = spark.createDataFrame([("x",), ("",)], "t string").select(encode("t").alias("v")).collect()
    assert np.allclose(got[0].v, np.array([3, 4]) / 5) and got[1].v == [0.0, 0.0]
    extras.write_texts(spark.createDataFrame([("a/b.md", "text")], "path string, body string"), str(tmp_path / "out"))
    assert (tmp_path / "out/a/b.md").read_text() == "text"
    (tmp_path / "t.md").write_text("- x")
    assert extras.find_transcripts([str(tmp_path / "none"), str(tmp_path)]) == str(tmp_path)
    assert extras.embedding_query("What did we decide about the Kernel?") == "Kernel" and extras.embedding_query("who") == "who"
    with pytest.raises(ValueError):
        extras.machine_tag("x", {"y"})


def test_queues_and_children(make_facts):
    from factloom.operators import reports

    f = make_facts(fact("a", "one"), fact("b", "two"), fact("c", "three")).withColumn("parent_fact_ids", F.when(F.col("id") != "a", F.array(F.lit("a"))))
    assert sorted(r.id for r in reports.children(f, "a").collect()) == ["b", "c"]
    rows = f.select("id", "ord", "status")
    got = reports.proposal_queue(rows.filter("id = 'a'"), rows, rows.filter("id = 'b'")).collect()
    assert {(r.id, r.status) for r in got} == {("a", "current"), ("c", "proposed")}
    lines = [r.value for r in reports.queue_document(rows.select("id"), "dedup", 2).collect()]
    assert json.loads(lines[0]) == {"queue": "dedup", "rows": 3, "dropped": 2} and len(lines) == 4
    assert reports.rebuild_summary({"promoted": True, "before": 1, "after": 2}).startswith("Rebuild promoted\nfacts before: 1")
