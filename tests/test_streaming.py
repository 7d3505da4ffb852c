from pyspark.sql import functions as F

from factloom.operators import ingest
from factloom.sources.store import ParquetStore
from factloom.streaming import ingest as streaming
from factloom.sources import jsonl
from tests.test_ingest_sources import transcript  # noqa: F401


def test_stream_denials_windows_and_upsert(spark, transcript, tmp_path, make_facts):  # noqa: F811
    lines = jsonl.session_lines(jsonl.read_lines(spark, transcript)).filter("not malformed")
    lines.write.parquet(str(tmp_path / "in"))
    stream = streaming.stream_lines(spark, str(tmp_path / "in"), lines.schema)
    q = streaming.denials(ingest.events(stream)).writeStream.format("memory").queryName("denied").option("checkpointLocation", str(tmp_path / "c1")).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert {r.denied for r in spark.table("denied").filter("denied is not null").collect()} == {"path", "result_of_denied", "tool", "endpoint"}
    q = streaming.windowed_counts(streaming.fresh(stream), late=None).writeStream.format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "c2")).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    store = ParquetStore(spark, str(tmp_path / "s"))
    write = streaming.upsert(store)
    rows = make_facts({"id": "a", "content": "x"}, {"id": "b", "content": "y"}).select("id", "ord", "content")
    write(rows, 0)
    write(rows.filter("id = 'a'").withColumn("content", F.lit("new")), 1)
    assert {r.id: r.content for r in store.load().collect()} == {"a": "new", "b": "y"}


def test_upsert_keeps_columns_of_both_sides(spark, tmp_path, make_facts):
    store = ParquetStore(spark, str(tmp_path / "s"))
    write = streaming.upsert(store)
    write(make_facts({"id": "a", "content": "x", "trust": "high"}, {"id": "b", "content": "y", "superseded_by": "a"}), 0)
    write(make_facts({"id": "c", "content": "z"}, {"id": "a", "content": "new"}).select("id", "ord", "content").withColumn("seen", F.lit(1)), 1)
    assert {r.id: (r.ord, r.content, r.superseded_by, r.seen) for r in store.load().collect()} == {"a": (0, "new", None, 1), "b": (1, "y", "a", None), "c": (2, "z", None, 1)}
