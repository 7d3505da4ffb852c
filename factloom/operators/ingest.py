"""From raw session lines to events and facts (survey 2.2, 2.3)."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.functions import text
from factloom.functions import values as V
from factloom.functions.dates import utc_text
from factloom.session import cut

PARTS = "array<struct<type:string,text:string,id:string,name:string,input:string,tool_use_id:string,content:string>>"


@F.pandas_udf(T.ArrayType(T.StringType()))
def nested_paths(values: pd.Series) -> pd.Series:
    """candidate paths in JSON text: values of path keys, and paths in every string value (never in keys)."""
    in_text, env, keys = re.compile(V.PATH_IN_TEXT), re.compile(V.ENV_IN_TEXT), {"file_path", "path", "filename"}

    def walk(value, out: list[str]) -> list[str]:
        if isinstance(value, dict):
            for k, v in value.items():
                if k in keys and isinstance(v, str):
                    out.append(v)
                walk(v, out)
        elif isinstance(value, list):
            for v in value:
                walk(v, out)
        elif isinstance(value, str):
            out += in_text.findall(value) + env.findall(value)
        return out

    def paths(raw: str | None) -> list[str]:
        if not raw:
            return []
        try:
            return walk(json.loads(raw), [])
        except ValueError:
            return walk(raw, [])

    return values.map(paths)


@F.pandas_udf(T.StringType())
def canonical_json(values: pd.Series) -> pd.Series:
    """JSON text with sorted keys and default separators; text that is no JSON stays as it is."""

    def tidy(raw: str | None) -> str | None:
        try:
            return json.dumps(json.loads(raw), sort_keys=True, ensure_ascii=False) if raw else raw
        except ValueError:
            return raw

    return values.map(tidy)


def parts(lines: DataFrame) -> DataFrame:
    """The parts of user and assistant lines with their place; sidechain lines are left out.

    Content is plain text or the JSON text of a list of parts; null content is one empty text part.
    """
    content = F.col("message.content")
    as_list = F.when(content.startswith("[{"), F.from_json(content, PARTS))
    one = F.array(F.struct(F.lit("text").alias("type"), F.coalesce(content, F.lit("")).alias("text"), *[F.lit(None).cast("string").alias(c) for c in ("id", "name", "input", "tool_use_id", "content")]))
    own = lines.filter(F.col("line_type").isin("user", "assistant") & ~F.coalesce("is_sidechain", F.lit(False)))
    exploded = own.select("*", F.posexplode(F.coalesce(as_list, one)).alias("part_idx", "part"))
    return exploded.withColumn("seq", F.struct("line_no", "line_id", "part_idx"))


def events(lines: DataFrame) -> DataFrame:
    """Sanitised event rows before the privacy rules: text, tool call, tool result, compaction, provenance.

    Empty texts drop, empty tool results stay. ``event_id`` may repeat within a line; line_id and part_idx are unique.
    """
    p = parts(lines)
    kind = F.when(F.col("part.type") == "text", "message").when(F.col("part.type") == "tool_use", "tool_call").when(F.col("part.type") == "tool_result", "tool_result")
    surface = F.when(kind == "message", "text").when(kind == "tool_call", "tool_use.input").when(kind == "tool_result", "tool_result.content")
    actor = F.when(kind == "message", F.coalesce("message.role", "line_type")).when(kind == "tool_call", "assistant").otherwise("tool")
    content = F.when(kind == "message", F.coalesce("part.text", F.lit(""))).when(kind == "tool_call", F.coalesce("part.input", F.lit("{}"))).otherwise(F.coalesce("part.content", F.lit("")))
    shaped = p.select(
        "line_id", "part_idx", "path", "line_no", "session_id", "ts", "uuid", actor.alias("actor"), surface.alias("surface"), kind.alias("kind"), content.alias("content"),
        F.col("part.name").alias("tool_name"), F.coalesce("part.id", "part.tool_use_id").alias("tool_use_id"),
    ).filter(F.col("kind").isNotNull() & ((F.col("kind") != "message") | (F.col("content") != "")))
    none = F.lit(None).cast("string")
    base = ["line_id", F.lit(0).alias("part_idx"), "path", "line_no", "session_id", "ts", "uuid"]
    visible = lines.filter(~F.coalesce("is_sidechain", F.lit(False)))
    compaction = visible.filter((F.col("line_type") == "system") & F.col("compact_metadata").isNotNull()).select(
        *base, F.lit("system").alias("actor"), F.lit("compactMetadata").alias("surface"), F.lit("compaction").alias("kind"), F.col("compact_metadata").alias("content"), none.alias("tool_name"), none.alias("tool_use_id")
    )
    links = visible.filter(F.col("line_type") == "pr-link").select(
        *base, F.lit("system").alias("actor"), F.lit("pr-link").alias("surface"), F.lit("provenance").alias("kind"),
        F.to_json(F.struct(F.col("pr_number").alias("prNumber"), F.col("pr_repository").alias("prRepository"))).alias("content"), none.alias("tool_name"), none.alias("tool_use_id"),
    )
    every = shaped.unionByName(compaction).unionByName(links)
    return every.withColumn("event_id", F.concat_ws(":", F.coalesce("uuid", F.lit("")), "surface", "kind"))


def deny_reason(rows: DataFrame) -> DataFrame:
    """adds ``denied``: path, tool or endpoint for tool calls (the first that holds), result_path or result_endpoint for results."""
    call, result = F.col("kind") == "tool_call", F.col("kind") == "tool_result"
    checked = rows.withColumn("_paths", F.when(call | result, nested_paths(F.when(call | result, F.col("content")))))
    by_path = F.exists("_paths", lambda p: text.denied(p, V.DENIED_PATHS))
    by_tool = text.denied(F.col("tool_name"), V.DENIED_TOOLS)
    by_endpoint = F.exists(text.endpoints_in_text(F.col("content")), lambda e: text.denied(e, V.DENIED_ENDPOINTS))
    reason = F.when(call & by_path, "path").when(call & by_tool, "tool").when(call & by_endpoint, "endpoint").when(result & by_path, "result_path").when(result & by_endpoint, "result_endpoint")
    return checked.withColumn("denied", reason).drop("_paths")


def with_denials(rows: DataFrame) -> DataFrame:
    """Adds ``denied`` = result_of_denied for results of a tool call denied earlier in the same file."""
    marked = deny_reason(rows)
    calls = marked.filter((F.col("kind") == "tool_call") & F.col("denied").isNotNull() & (F.length("tool_use_id") > 0))
    first = calls.groupBy("path", "tool_use_id").agg(F.min(F.struct("line_no", "line_id", "part_idx")).alias("_first"))
    joined = marked.join(first, ["path", "tool_use_id"], "left")
    late = (F.col("kind") == "tool_result") & F.col("_first").isNotNull() & (F.struct("line_no", "line_id", "part_idx") > F.col("_first"))
    return joined.withColumn("denied", F.when(late, "result_of_denied").otherwise(F.col("denied"))).drop("_first")


def sanitised(lines: DataFrame) -> DataFrame:
    """Events that no rule denies, with secrets scrubbed."""
    kept = with_denials(events(lines)).filter(F.col("denied").isNull()).drop("denied")
    return text.scrubbed(kept, "content").drop("content").withColumnRenamed("content_scrubbed", "content")


def ingest_statistics(lines: DataFrame) -> DataFrame:
    """One row of the eleven counters. Lines that are no JSON count if the reader marked them (``malformed``)."""
    marked = cut(with_denials(events(lines)))
    of = lambda *reasons: F.count(F.when(F.col("denied").isin(*reasons), 1))
    counts = marked.agg(
        F.count(F.when(F.col("denied").isNull(), 1)).alias("events_written"), of("path").alias("denied_paths"), of("tool").alias("denied_tools"), of("endpoint").alias("denied_endpoints"),
        of("result_of_denied", "result_path", "result_endpoint").alias("denied_results"), of("result_path").alias("denied_result_paths"), of("result_endpoint").alias("denied_result_endpoints"),
    )
    kept = text.scrubbed(marked.filter(F.col("denied").isNull()).select("content"), "content")
    secrets = kept.agg(F.coalesce(F.sum("redactions"), F.lit(0)).alias("secrets_redacted"))
    bad = F.count(F.when(F.col("malformed"), 1)) if "malformed" in lines.columns else F.lit(0).cast("long")
    read = lines.agg(F.count(F.lit(1)).alias("lines_read"), F.count(F.when(F.col("is_sidechain"), 1)).alias("sidechain_excluded"), bad.alias("malformed_lines"))
    return read.crossJoin(counts).crossJoin(secrets)


def event_day(rows: DataFrame) -> Column:
    """The day of the time, else the stem of the file."""
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    return F.coalesce(F.substring(utc_text(F.col("ts")), 1, 10), stem)


def facts_from_events(rows: DataFrame) -> DataFrame:
    """(id, kind, confidence, content, source_date, session, evidence, pr_numbers, truncated), the first of equal texts.

    Noise, tool surfaces, unclassified texts and unauthorised kinds make no facts.
    """
    body = rows.withColumn("content", F.regexp_replace("content", r"^\s+|\s+$", ""))
    # classification looks at the text many times: it is written once, as between the steps of the batch path
    body = cut(body).filter(~F.col("surface").isin(*V.NON_FACT_SURFACES) & (F.col("content") != "") & ~text.is_structural_noise(F.col("content")))
    capped = body.withColumn("truncated", F.length("content") > V.CONTENT_CAP).withColumn("content", text.cap_content(F.col("content"))).withColumn("c", text.classify_bullet(F.col("content")))
    known = capped.filter(F.col("c").isNotNull() & text.authority_allowed(F.col("c.kind"), F.col("content"), F.col("actor")))
    day = event_day(known)
    made = known.select(
        text.fact_id(day, F.col("content")).alias("id"), F.col("c.kind").alias("kind"), F.col("c.confidence").alias("confidence"), "content", day.alias("source_date"), F.col("session_id").alias("session"),
        F.struct(F.col("event_id"), F.col("path"), F.col("line_no").alias("line")).alias("evidence"), text.pr_numbers(F.col("content")).alias("pr_numbers"), "truncated",
        F.struct("path", "line_no", "line_id", "part_idx").alias("_at"), text.dedup_key(F.col("content")).alias("_key"),
    )
    names = [c for c in made.columns if c not in ("_at", "_key")]
    return made.groupBy("_key").agg(F.min_by(F.struct(*names), "_at").alias("r")).select("r.*")


NOTE_ROWS = 1000


def session_notes(facts: DataFrame) -> DataFrame:
    """(session, page, name, body): the facts of each session as notes, in order of ord.

    ``ord`` is unique, so a page, which spans NOTE_ROWS values of it, is bounded whatever the size of the session.
    """
    line = F.concat(F.lit("- ["), F.upper("kind"), F.lit("] "), F.substring("content", 1, 240), F.lit("\n  evidence: "), F.coalesce("source_file", F.lit("none")))
    paged = facts.withColumn("page", F.floor(F.col("ord") / NOTE_ROWS))
    notes = paged.groupBy("session", "page").agg(F.array_sort(F.collect_list(F.struct("ord", line.alias("line")))).alias("l"))
    body = F.concat(F.lit("# Session "), F.coalesce("session", F.lit("unknown")), F.lit("\n\n"), F.array_join(F.transform("l", lambda x: x["line"]), "\n"))
    return notes.select("session", "page", text.safe_name(F.col("session")).alias("name"), body.alias("body"))
