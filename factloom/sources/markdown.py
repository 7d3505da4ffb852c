"""Facts from Markdown: transcripts of bullets and curated notes (survey S4, S6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.functions import text

# Kinds of curated notes by their type, and their confidence
CURATED_KINDS = {"feedback": "correction", "project": "architecture", "reference": "architecture", "user": "correction"}
CURATED_CONFIDENCE = 0.95


def _stem(path):
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def read_bullets(spark: SparkSession, path: str, since: str | None = None) -> DataFrame:
    """(path, day, line_no, session, session_anchor, content) of the bullets of day files.

    The last session header and anchor above a bullet hold for it. Files whose name is before ``since`` are left out.
    """
    files = spark.read.option("pathGlobFilter", "*.md").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    files = files.withColumn("day", _stem("path"))
    if since:
        files = files.filter(F.col("day") >= since)
    lines = files.select("path", "day", F.posexplode(F.split("value", r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]")).alias("line_no", "line"))
    above = W.partitionBy("path").orderBy("line_no").rowsBetween(W.unboundedPreceding, W.currentRow)
    session = F.when(F.col("line").startswith("## Session"), F.trim(F.regexp_replace("line", "^## ", "")))
    anchor = F.when(F.col("line").startswith("<!-- session:"), F.substring("line", 1, 200))
    carried = lines.withColumn("session", F.last(session, True).over(above)).withColumn("session_anchor", F.last(anchor, True).over(above))
    bullets = carried.filter(F.col("line").startswith("- ")).withColumn("content", F.trim(F.expr("substring(line, 3)")))
    return bullets.select("path", "day", (F.col("line_no") + 1).alias("line_no"), "session", "session_anchor", "content").filter(F.col("content") != "")


def facts_from_bullets(bullets: DataFrame) -> DataFrame:
    """D1c, F10, U1s, D3c, D4c over bullets: classified, authorised facts, the first of equal texts."""
    known = bullets.withColumn("c", text.classify_bullet(F.col("content"))).filter(F.col("c").isNotNull())
    known = known.filter(text.authority_allowed(F.col("c.kind"), F.col("content")))
    made = known.select(
        text.fact_id(F.col("day"), F.col("content")).alias("id"), F.col("c.kind").alias("kind"), F.col("c.confidence").alias("confidence"), F.lit("current").alias("status"), "content",
        F.col("day").alias("source_date"), "session", "session_anchor", text.pr_numbers(F.col("content")).alias("pr_numbers"),
        F.array(F.struct(F.lit(None).cast("string").alias("event_id"), "path", F.col("line_no").alias("line"))).alias("evidence"), F.struct("path", "line_no").alias("_at"), text.dedup_key(F.col("content")).alias("_key"),
    )
    names = [c for c in made.columns if not c.startswith("_")]
    return made.groupBy("_key").agg(F.min_by(F.struct(*names), "_at").alias("r")).select("r.*")


def read_curated(spark: SparkSession, path: str) -> DataFrame:
    """One fact per note with front matter (name, description, type); of equal ids the first by file name."""
    files = spark.read.option("pathGlobFilter", "*.md").text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("changed"), "value"
    )
    head = F.regexp_extract("value", r"(?s)^---\s*\n(.*?)\n---\s*", 1)
    body = F.trim(F.regexp_replace("value", r"(?s)^---\s*\n.*?\n---\s*", ""))
    notes = files.filter(~F.col("path").endswith("/MEMORY.md")).select("path", "changed", head.alias("head"), body.alias("body")).filter(F.col("head") != "")

    def field(name: str):
        return F.trim(F.regexp_replace(F.regexp_extract("head", rf"(?m)^\s*{name}:\s*(.+)$", 1), "^[\"']|[\"']$", ""))

    named = notes.select("path", "changed", "body", field("name").alias("name"), field("description").alias("description"), field("type").alias("type")).filter(F.col("name") != "")
    kinds = F.create_map(*[x for k, v in CURATED_KINDS.items() for x in (F.lit(k), F.lit(v))])
    made = named.select(
        F.concat(F.lit("curated-"), F.substring(F.sha1("name"), 1, 12)).alias("id"), F.coalesce(F.try_element_at(kinds, F.col("type")), F.lit("architecture")).alias("kind"),
        F.lit(CURATED_CONFIDENCE).alias("confidence"), F.lit("current").alias("status"), F.concat_ws("\n\n", F.when(F.col("description") != "", F.col("description")), "body").alias("content"),
        F.date_format("changed", "yyyy-MM-dd").alias("source_date"), "path",
    )
    names = [c for c in made.columns if c != "path"]
    return made.groupBy(F.col("id").alias("_id")).agg(F.min_by(F.struct(*names), "path").alias("r")).select("r.*")
