"""Session transcripts as JSON lines (survey S1 to S3, S8)."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.functions.text import stripped

LINE = (
    "type string, sessionId string, timestamp string, uuid string, isSidechain boolean, message struct<role:string,content:string>, "
    "compactMetadata string, prNumber int, prRepository string, _bad string"
)
EVENT = (
    "id string, source struct<adapter:string,path:string,line:int,session_id:string,timestamp:string>, actor string, surface string, kind string, content string, "
    "metadata map<string,string>, privacy struct<scrubbed:boolean,excluded:boolean,policy_version:string>"
)


def read_lines(spark: SparkSession, paths: str | list[str], suffix: str = "*.jsonl", recursive: bool = False, since_days: int | None = None, now: datetime | None = None) -> DataFrame:
    """(path, line_no, value): the non-blank lines of files with their physical numbers.

    A folder stands for its files of the suffix, by name; with ``recursive`` for those below it too. With
    ``since_days`` (above 0) only files changed since then are read. Files without lines have no rows.
    """
    reader = spark.read.option("pathGlobFilter", suffix).option("recursiveFileLookup", recursive)
    if since_days and since_days > 0:
        reader = reader.option("modifiedAfter", ((now or datetime.now(timezone.utc)) - timedelta(days=since_days)).strftime("%Y-%m-%dT%H:%M:%S"))
    if not isinstance(paths, str) and len(paths) > 1:
        # overlapping folders name a file twice
        paths = sorted(set(reader.text(list(paths)).inputFiles()))
        if not paths:
            return spark.createDataFrame([], "path string, line_no int, value string")
        reader = spark.read
    rows = reader.text(paths).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value", F.monotonically_increasing_id().alias("at"))
    # a block is read in order by one task; only the counts of the blocks are aggregated, of which there are few
    blocks = rows.groupBy("path", "block").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = blocks.withColumn("before", F.sum("n").over(W.partitionBy("path").orderBy("block")) - F.col("n")).select("path", "block", "first", "before")
    numbered = rows.join(before, ["path", "block"]).withColumn("line_no", (F.col("before") + F.col("at") - F.col("first") + 1).cast("int"))
    return numbered.filter(stripped("value") != "").select("path", "line_no", "value")


def session_lines(lines: DataFrame) -> DataFrame:
    """Lines parsed to the columns of the session line table, and ``malformed``.

    ``message.content`` is the text itself, or the JSON text of the list of parts.
    """
    parsed = F.from_json("value", LINE, {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"})
    rows = lines.withColumn("j", parsed).withColumn("malformed", F.col("j").isNull() | F.col("j._bad").isNotNull())
    return rows.select(
        F.xxhash64("path", "line_no").alias("line_id"), "path", "line_no", F.col("j.type").alias("line_type"), F.col("j.sessionId").alias("session_id"),
        F.col("j.timestamp").try_cast("timestamp").alias("ts"), F.col("j.uuid").alias("uuid"), F.col("j.isSidechain").alias("is_sidechain"), F.col("j.message").alias("message"),
        F.col("j.compactMetadata").alias("compact_metadata"), F.col("j.prNumber").alias("pr_number"), F.col("j.prRepository").alias("pr_repository"), "malformed",
    )


def read_events(spark: SparkSession, path: str, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """(events, bad lines). ``strict`` fails at the first malformed line once the events are used."""
    if strict:
        rows = spark.read.schema(EVENT).option("mode", "FAILFAST").json(path)
        return rows, spark.createDataFrame([], "value string")
    raw = spark.read.text(path).filter(F.trim("value") != "")
    parsed = raw.withColumn("j", F.from_json("value", EVENT + ", _bad string", {"columnNameOfCorruptRecord": "_bad"}))
    bad = F.col("j").isNull() | F.col("j._bad").isNotNull()
    return parsed.filter(~bad).select("j.*").drop("_bad"), parsed.filter(bad).select("value")
