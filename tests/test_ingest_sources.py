import json

import pytest
from pyspark.sql import functions as F

from factloom.operators import ingest, store_view
from factloom.plans.engine import RecallEngine, rebuild
from factloom.sources import jsonl, markdown, store


def line(kind="user", content="hello there", **more):
    return {"type": kind, "sessionId": "s1", "timestamp": "2026-06-01T10:00:00Z", "uuid": "u1", "message": {"role": kind, "content": content}, **more}


@pytest.fixture
def transcript(tmp_path):
    lines = [
        json.dumps(line()), "", json.dumps(line("assistant", [{"type": "text", "text": ""}, {"type": "tool_use", "id": "t1", "name": "Read", "input": {"path": "conf/secret.txt", "deep": {"a": ".env"}}}, {"type": "tool_use", "id": "t2", "name": "Read", "input": {"file_path": "src/a.py"}}])),
        "{broken", json.dumps(line("user", [{"type": "tool_result", "tool_use_id": "t1", "content": "leaked"}, {"type": "tool_result", "tool_use_id": "t2", "content": ""}])),
        json.dumps(line("user", "side", isSidechain=True)), json.dumps({"type": "system", "compactMetadata": {"trigger": "auto"}, "uuid": "u9"}),
        json.dumps({"type": "pr-link", "prNumber": 7, "prRepository": "r", "uuid": "u8"}), json.dumps(line("user", "[DECISION] keep API_KEY=abc123 safe")), json.dumps({"type": "summary"}),
        json.dumps(line("assistant", [{"type": "tool_use", "id": "t3", "name": "diary_write", "input": {}}, {"type": "tool_use", "id": "t4", "name": "Fetch", "input": {"url": "https://h/api/brain/private/x"}}])),
    ]
    (tmp_path / "a.jsonl").write_text("\n".join(lines) + "\n")
    (tmp_path / "b.txt").write_text("not read")
    return str(tmp_path)


def test_lines_keep_numbers_and_malformed_ones_are_marked(spark, transcript):
    rows = jsonl.read_lines(spark, transcript)
    assert [r.line_no for r in rows.orderBy("line_no").collect()] == [1, 3, 4, 5, 6, 7, 8, 9, 10, 11]
    parsed = jsonl.session_lines(rows)
    assert [r.line_no for r in parsed.filter("malformed").collect()] == [4]
    assert jsonl.read_lines(spark, transcript, since_days=1).count() == 10


def test_events_denials_and_facts(spark, transcript):
    lines = jsonl.session_lines(jsonl.read_lines(spark, transcript)).filter("not malformed")
    events = ingest.events(lines)
    assert sorted(r.kind for r in events.collect()) == ["compaction", "message", "message", "provenance", "tool_call", "tool_call", "tool_call", "tool_call", "tool_result", "tool_result"]
    denied = {(r.tool_use_id, r.denied) for r in ingest.with_denials(events).filter("denied is not null").collect()}
    assert denied == {("t1", "path"), ("t1", "result_of_denied"), ("t3", "tool"), ("t4", "endpoint")}
    stats = ingest.ingest_statistics(lines).first()
    assert (stats.denied_paths, stats.denied_tools, stats.denied_endpoints, stats.denied_results, stats.sidechain_excluded, stats.events_written) == (1, 1, 1, 1, 1, 6)
    made = ingest.facts_from_events(ingest.sanitised(lines)).collect()
    assert [(r.kind, r.content, r.source_date) for r in made] == [("decision", "[DECISION] keep API_KEY=[REDACTED_SECRET] safe", "2026-06-01")]


def test_empty_and_null_lines(spark, transcript):
    lines = jsonl.session_lines(jsonl.read_lines(spark, transcript))
    assert ingest.facts_from_events(ingest.sanitised(lines.limit(0))).count() == 0
    nulls = lines.withColumn("message", F.lit(None).cast(lines.schema["message"].dataType)).withColumn("uuid", F.lit(None).cast("string"))
    assert ingest.events(nulls).filter("kind = 'message'").count() == 0


def test_canonical_json(spark):
    rows = spark.createDataFrame([('{"b":1,"a":"é"}',), ("text",), (None,)], "t string")
    assert [r[0] for r in rows.select(ingest.canonical_json("t")).collect()] == ['{"a": "é", "b": 1}', "text", None]


def test_markdown_sources(spark, tmp_path):
    (tmp_path / "2026-06-01.md").write_text("- [DECISION] early\n## Session one\n<!-- session: x -->\n- [BUG] late crash PR #12\n- the bug\n\ntext\n")
    (tmp_path / "2025-01-01.md").write_text("- [BUG] old\n")
    rows = markdown.read_bullets(spark, str(tmp_path), "2026-01-01").orderBy("line_no").collect()
    assert [(r.content, r.session) for r in rows] == [("[DECISION] early", None), ("[BUG] late crash PR #12", "Session one"), ("the bug", "Session one")]
    made = markdown.facts_from_bullets(markdown.read_bullets(spark, str(tmp_path))).collect()
    assert sorted((r.kind, r.pr_numbers) for r in made) == [("bug", []), ("bug", [12])]
    notes = tmp_path / "notes"
    notes.mkdir()
    (notes / "a.md").write_text("---\nname: rule\ndescription: short\nmetadata:\n  type: feedback\n---\nBody")
    (notes / "b.md").write_text("---\nname: rule\n---\nOther")
    (notes / "MEMORY.md").write_text("---\nname: index\n---\n")
    got = markdown.read_curated(spark, str(notes)).collect()
    assert [(r.kind, r.content, r.confidence) for r in got] == [("correction", "short\n\nBody", 0.95)] and got[0].id.startswith("curated-")


@pytest.mark.parametrize("kind", [store.FactStore, store.ParquetStore])
def test_store_contract(spark, make_facts, tmp_path, kind):
    s = kind(spark, str(tmp_path / "s"))
    assert s.load().count() == 0 and not s.data.exists() and len(s.ledger("degradations")) == 1
    rows = make_facts({"id": "a", "content": "old text"}, {"id": "b", "content": None}).select("id", "kind", "status", "confidence", "content", "source_date")
    s.replace_all(rows)
    assert store.fingerprint(s.load().select(*rows.columns)) == store.fingerprint(rows)
    store.edit_fact(s, "a", "old", "new", "me")
    assert s.load().filter("id = 'a'").first().content == "new text"
    with pytest.raises(ValueError):
        store.edit_fact(s, "a", "missing", "x", "me")
    assert store.revert_edit(s, "a", "me") and not store.revert_edit(s, "a", "me")
    assert s.load().filter("id = 'a'").first().content == "old text"
    assert s.snapshot().exists() and s.describe()["exists"]


def test_migration_and_receipt(spark, make_facts, tmp_path):
    a, b = store.FactStore(spark, str(tmp_path / "a")), store.ParquetStore(spark, str(tmp_path / "b"))
    rows = make_facts({"id": "a"}, {"id": "b"}).select("id", "status", "confidence")
    a.replace_all(rows)
    assert not store.migrate(a, b)["applied"] and store.migrate(a, b, apply=True)["applied"]
    assert store.resolve_store(spark, str(tmp_path / "b")).kind == "parquet" and store.resolve_store(spark, str(tmp_path / "b"), "json").kind == "json"
    a.replace_all(rows.unionAll(rows))
    assert not store.migrate(a, b, apply=True)["applied"]
    assert store.write_with_receipt(rows, str(tmp_path / "out"), a)["status"] == "applied"


def test_windows_digests_and_required_fields(spark, tmp_path):
    state = {}
    verdict, nonce = store.open_window(state, "job", "d1")
    assert verdict == "run" and not store.settle(state, "job", "wrong", "ok") and store.settle(state, "job", nonce, "ok")
    assert store.open_window(state, "job", "d1")[0] == "skip" and store.open_window(state, "job", "d2")[0] == "run"
    assert store.inputs_digest([str(tmp_path / "none")]) == store.inputs_digest([str(tmp_path / "none")])
    raw = spark.createDataFrame([('{"id":1,"content":null}',), ('{"id":1}',), ("broken",), (None,)], "value string")
    good, bad = store.load_required(raw, required=("id", "content"))
    assert good.count() == 1 and bad.count() == 3


def test_engine_and_rebuild(spark, transcript, tmp_path, make_facts):
    s = store.ParquetStore(spark, str(tmp_path / "store"))
    lines = jsonl.session_lines(jsonl.read_lines(spark, transcript)).filter("not malformed")
    assert rebuild(s, lines)["promoted"] and rebuild(s, lines)["after"] == 1
    assert not rebuild(store.ParquetStore(spark, str(tmp_path / "none")), lines.limit(0))["promoted"]
    done = rebuild(s, lines, "2026-06-13T00:00:00Z", key=b"k", key_id="k1", model="m", vectors=spark.createDataFrame([], "fact_id string, model_id string, content_sha256 string, vector array<float>"))
    assert done["artifacts"] == ["attestations", "contradictions", "graph-edges", "graph-nodes", "insights", "review", "sidecar-plan"]
    assert spark.read.parquet(str(tmp_path / "store" / "sidecar-plan")).first().action == "embed" and spark.read.parquet(str(tmp_path / "store" / "attestations")).count() == 1
    bad = store.ParquetStore(spark, str(tmp_path / "bad"))
    bad.replace_all(make_facts({"id": "old", "content": None, "source_date": "2026-01-01"}))
    assert not rebuild(bad, lines)["promoted"] and bad.load().count() == 1
    e = RecallEngine(spark, make_facts({"id": "a", "kind": "bug", "content": "kernel ledger", "source_date": "2026-06-01"}, {"id": "b", "kind": "bug", "content": "ledger volcano", "source_date": "2026-06-01"}), "2026-06-13")
    assert "kernel ledger" in e.recall_text("kernel") and e.recall_text("nothing") == ""
    assert {r.via for r in e.expanded("kernel").collect()} == {"match", "graph"}
    assert e.existence("kernel").first().verdict == "exists" and e.briefing("kernel").count() == 1


@pytest.mark.parametrize("kind", [store.FactStore, store.ParquetStore])
def test_rebuild_keeps_old_facts_whole(spark, transcript, tmp_path, make_facts, kind):
    lines = jsonl.session_lines(jsonl.read_lines(spark, transcript)).filter("not malformed")
    made = ingest.facts_from_events(ingest.sanitised(lines)).first()
    old = {"id": "old", "content": "x", "source_date": "2026-01-01", "status": "superseded", "source": "me", "source_file": "f.md", "machine": "m", "valid_at": "2026-01-01", "invalid_at": "2026-02-01", "superseded_by": "b", "superseded_at": "2026-02-01"}
    old |= {"supersession_reason": "newer", "deprecated": True, "trust": "high", "extra": "{}", "evidence": [("e", "p", 3)], "pr_numbers": [5]}
    s = kind(spark, str(tmp_path / "store"))
    s.replace_all(make_facts(old, {"id": made.id, "content": "stale", "kind": "bug", "ord": 4, "source_date": "2026-01-03"}, {"id": "other", "ord": 7, "content": "y", "source_date": "2026-01-02"}))
    assert rebuild(s, lines)["after"] == 3
    got = {r.id: r.asDict(recursive=True) for r in s.load().collect()}
    assert {k: got["old"][k] for k in old if k not in ("evidence", "pr_numbers")} == {k: v for k, v in old.items() if k not in ("evidence", "pr_numbers")}
    assert got["old"]["evidence"] == [{"event_id": "e", "path": "p", "line": 3}] and [int(n) for n in got["old"]["pr_numbers"]] == [5]
    assert (got[made.id]["content"], got[made.id]["kind"], got[made.id]["ord"]) == (made.content, "decision", 4) and got[made.id]["evidence"][0]["line"] == made.evidence.line
    s.replace_all(make_facts(old, {"id": "other", "ord": 7, "content": "y", "source_date": "2026-01-02"}))
    assert rebuild(s, lines)["after"] == 3 and {r.id: r.ord for r in s.load().collect()} == {"old": 0, "other": 7, made.id: 8}


def test_store_view_takes_latest_row(make_facts):
    f = make_facts({"id": "a", "content": "x", "kind": " Bug ", "status": None, "source": " "}, {"id": "a", "content": "x", "kind": "bug", "status": "SUPERSEDED ", "source": "me"})
    row = store_view.tidy(f).first()
    assert (row.kind, row.status, row.source) == ("bug", "superseded", "me")


def test_line_numbers_of_split_files(spark, tmp_path):
    """A file in many blocks, blank lines, all line ends, a folder named twice."""
    lines = [f'{{"n": {i}}}' if i % 7 else "  " for i in range(3000)]
    (tmp_path / "a.jsonl").write_bytes("".join(x + ("\r\n" if i % 3 else "\n") for i, x in enumerate(lines)).encode())
    (tmp_path / "b.jsonl").write_text("\n\nlast")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
        rows = jsonl.read_lines(spark, [str(tmp_path), str(tmp_path / "a.jsonl")])
        assert rows.rdd.getNumPartitions() > 1
        got = {(r.path.rsplit("/", 1)[1], r.line_no): r.value for r in rows.collect()}
        assert rows.count() == len(got)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == {("a.jsonl", i + 1): x for i, x in enumerate(lines) if x.strip()} | {("b.jsonl", 3): "last"}
