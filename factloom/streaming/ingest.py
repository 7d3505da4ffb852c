"""Structured Streaming over session lines; an addition, the batch operators have no streaming counterpart.

``stream_lines`` reads a folder of session line tables, ``denials`` carries denied tool calls of a file
to later results as keyed state, ``windowed_counts`` counts late-tolerant windows, ``upsert`` keeps a store.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from factloom.operators import ingest
from factloom.operators.setops import merged_store
from factloom.sources.store import FactStore


def stream_lines(spark: SparkSession, path: str, schema, files_per_trigger: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def fresh(lines: DataFrame, late: str = "1 hour") -> DataFrame:
    """Lines once each: repeated (path, line_no, uuid) within the watermark drop."""
    return lines.filter(F.col("ts").isNotNull()).withWatermark("ts", late).dropDuplicatesWithinWatermark(["path", "line_no", "uuid"])


def windowed_counts(lines: DataFrame, late: str | None = "1 hour", size: str = "10 minutes") -> DataFrame:
    """Lines per window and type, final once the watermark has passed the window; ``late`` is None for lines that have one."""
    marked = lines.withWatermark("ts", late) if late else lines
    return marked.groupBy(F.window("ts", size), "line_type").agg(F.count(F.lit(1)).alias("lines"))


KEPT = "path string, line_id long, part_idx int, kind string, content string, denied string"


def denials(events: DataFrame) -> DataFrame:
    """F4 as a stream: a result whose tool call was denied earlier in its file is denied too.

    The state of a file is the set of its denied call ids.
    """

    def step(key: tuple[str], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        gone = set(state.get[0]) if state.exists else set()
        rows = pd.concat(list(batches)).sort_values(["line_no", "line_id", "part_idx"])
        out = []
        for r in rows.itertuples(index=False):
            why = r.denied
            if r.kind == "tool_call" and why and r.tool_use_id:
                gone.add(r.tool_use_id)
            elif r.kind == "tool_result" and r.tool_use_id in gone:
                why = "result_of_denied"
            out.append((key[0], r.line_id, r.part_idx, r.kind, r.content, why))
        state.update((sorted(gone),))
        yield pd.DataFrame(out, columns=["path", "line_id", "part_idx", "kind", "content", "denied"])

    marked = ingest.deny_reason(events).select("path", "line_no", "line_id", "part_idx", "kind", "content", "tool_use_id", "denied")
    return marked.groupBy("path").applyInPandasWithState(step, KEPT, "ids array<string>", "append", GroupStateTimeout.NoTimeout)


def upsert(store: FactStore):
    """A foreachBatch function that merges each batch of facts into a store; the newer row of an id wins.

    Columns that only the store or only the batch has stay; new ids are numbered on from the store's greatest ord.
    """

    def write(batch: DataFrame, _: int) -> None:
        live = store.load()
        if not live.columns or not store.data.exists():
            store.replace_all(batch)
            return
        store.replace_all(merged_store(live, batch, [F.col("ord"), F.col("id")] if "ord" in batch.columns else [F.col("id")]))

    return write
