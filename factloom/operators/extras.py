"""Smaller operators: excerpts, entities, judged contradictions, insight lead, re-signing, receipts, encoders, text sinks."""

from __future__ import annotations

import hashlib
import hmac
import json
import re
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.functions import text
from factloom.functions import values as V
from factloom.operators import attest
from factloom.operators.numbering import numbered

def find_transcripts(folders: list[str]) -> str | None:
    """The first folder that holds a Markdown file."""
    return next((f for f in folders if Path(f).is_dir() and any(Path(f).glob("*.md"))), None)


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """Promotion batches from JSON files instead of a service, by seq."""
    return spark.read.json(path).orderBy("seq")


def read_matrix(path: str, sha256: str) -> np.ndarray:
    """The first two-dimensional float tensor of a safetensors file whose hash is as pinned."""
    raw = Path(path).read_bytes()
    if hashlib.sha256(raw).hexdigest() != sha256:
        raise ValueError("the file isn't the pinned one")
    size = int.from_bytes(raw[:8], "little")
    header, body = json.loads(raw[8 : 8 + size]), raw[8 + size :]
    kinds = {"F32": np.float32, "F16": np.float16, "F64": np.float64}
    for name, t in header.items():
        if name != "__metadata__" and len(t["shape"]) == 2 and t["dtype"] in kinds:
            begin, end = t["data_offsets"]
            return np.frombuffer(body[begin:end], kinds[t["dtype"]]).reshape(t["shape"]).astype(np.float32)
    raise ValueError("the file has no matrix")


def static_encoder(matrix: np.ndarray, token_ids: Callable[[str], list[int]]):
    """An encoder that averages the rows of a text's tokens and scales to length 1; no tokens give zeros."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def encode(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> list[float]:
            ids = token_ids(t or "")
            v = matrix[ids].mean(axis=0) if ids else np.zeros(matrix.shape[1])
            return (v / (np.linalg.norm(v) or 1.0)).astype("float32").tolist()

        return texts.map(one)

    return encode


def write_texts(notes: DataFrame, root: str) -> None:
    """Writes (path, body) as files below a folder that all executors share."""
    base = Path(root)

    def write(rows: Iterator) -> None:
        for r in rows:
            to = (base / r.path).resolve()
            if base.resolve() not in to.parents:
                raise ValueError("a note must stay in its folder")
            to.parent.mkdir(parents=True, exist_ok=True)
            to.write_text(r.body or "", encoding="utf-8")

    notes.select("path", "body").foreachPartition(write)


def machine_tag(tag: str, known: set[str]) -> Column:
    """The tag of a registered machine as a column; any other raises."""
    if tag not in known:
        raise ValueError(f"{tag!r} is no registered machine")
    return F.lit(tag)


def entities(facts: DataFrame, names: list[str]) -> DataFrame:
    """Adds ``entities``: the fact's kind, then the names that stand in its content as whole words (hyphens bind)."""
    low = F.lower(F.coalesce("content", F.lit("")))
    hits = [F.when(low.rlike(rf"(?<![\w-]){re.escape(n.lower())}(?![\w-])"), F.lit(n)) for n in names]
    return facts.withColumn("entities", F.array_distinct(F.filter(F.array(F.col("kind"), *hits), lambda x: x.isNotNull() & (x != ""))))


def judged(pairs: DataFrame, facts: DataFrame, judge: Callable[[str, str], str] | None = None, top: int = 40, near_days: int = 0) -> DataFrame:
    """Adds ``class`` to contradiction pairs: confirmed, borderline, dropped or unreviewed.

    The judge sees the scrubbed first 300 characters of both facts of the ``top`` pairs by overlap; its ``verdict: yes|no|unclear``
    decides. No verdict, a failure, or facts of the same date (a gap of at most ``near_days``) are borderline at best.
    """
    clip = facts.select("id", F.substring(text.scrub(F.col("content")), 1, 300).alias("clip"))
    rows = numbered(pairs, [F.desc("overlap"), F.asc("earlier"), F.asc("later")], "place")
    both = rows.join(clip.select(F.col("id").alias("earlier"), F.col("clip").alias("old")), "earlier").join(clip.select(F.col("id").alias("later"), F.col("clip").alias("new")), "later")
    if judge is None:
        return both.withColumn("class", F.lit("unreviewed")).drop("old", "new", "place")

    @F.pandas_udf(T.StringType())
    def ask(old: pd.Series, new: pd.Series) -> pd.Series:
        def one(a: str, b: str) -> str:
            try:
                m = re.search(r"verdict:\s*(yes|no|unclear)", judge(a, b) or "", re.IGNORECASE)
                return m.group(1).lower() if m else "unclear"
            except Exception:  # noqa: BLE001
                return "unclear"

        return pd.Series([one(a, b) for a, b in zip(old, new)], dtype=object)

    verdict = ask("old", "new")
    reviewed = both.filter(F.col("place") <= top).withColumn("verdict", verdict)
    named = reviewed.withColumn("class", F.when(F.col("verdict") == "no", "dropped").when((F.col("verdict") == "yes") & (F.col("gap_days") > near_days), "confirmed").otherwise("borderline"))
    rest = both.filter(F.col("place") > top).withColumn("class", F.lit("unreviewed"))
    return named.drop("verdict", "old", "new", "place").unionByName(rest.drop("old", "new", "place"))


def embedding_query(query: str) -> str:
    """A question's words without stopwords and intent words, in their own spelling; the question itself if none is left."""
    kept = [w for w in re.findall(r"[A-Za-z0-9]+", query) if w.lower() not in V.QUERY_STOPWORDS and w.lower() not in V.INTENT_WORDS]
    return " ".join(kept) or query


def purge_counts(**removed: DataFrame) -> dict[str, int]:
    """How many rows of each kind a purge takes."""
    return {name: rows.count() for name, rows in removed.items()}


def verify_cached(facts: DataFrame, envelopes: DataFrame, key: bytes, cache: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """V6: (verdicts, new cache). Hashes are always computed; a signature is checked again unless the cache has its digest under this key.

    The cache (digest) holds valid signatures only; its digests are keyed, so a forged row needs the key.
    """

    @F.pandas_udf(T.StringType())
    def digest(fact: pd.Series, source: pd.Series, signature: pd.Series) -> pd.Series:
        return pd.Series([hmac.new(key, f"{f}|{s}|{g}".encode(), hashlib.sha256).hexdigest() for f, s, g in zip(fact, source, signature)], dtype=object)

    rows = attest.hashed(facts).select("id", F.col("fact_hash").alias("f"), F.col("source_hash").alias("s")).join(envelopes.select(F.col("fact_id").alias("id"), "signature"), "id")
    keyed = rows.withColumn("digest", digest("f", "s", "signature"))
    known = keyed.join(cache, "digest", "left_semi").select("id") if cache is not None else keyed.select("id").limit(0)
    fresh = attest.verify(facts.join(known, "id", "left_anti"), envelopes, key)
    verdicts = known.select("id", F.lit("valid").alias("verdict")).unionByName(fresh)
    return verdicts, keyed.join(verdicts.filter("verdict = 'valid'").select("id"), "id", "left_semi").select("digest").distinct()


def resign_plan(facts: DataFrame, envelopes: DataFrame, key: bytes) -> DataFrame:
    """V8: (id, action): keep valid ones, sign unsigned ones, re-sign those whose hashes hold under another signature, review changed ones."""
    verdicts = attest.verify(facts, envelopes, key)
    now = attest.hashed(facts).select("id", F.col("fact_hash").alias("now"))
    both = verdicts.join(now, "id").join(envelopes.select(F.col("fact_id").alias("id"), "fact_hash"), "id", "left")
    action = F.when(F.col("verdict") == "valid", "keep").when(F.col("verdict") == "unsigned", "sign").when(F.col("now") == F.col("fact_hash"), "resign").otherwise("review")
    return both.select("id", action.alias("action"))


RECEIPT_FIELDS = {"schema", "verifier", "checked_at", "counts"}


def sign_receipt(receipt: dict, key: bytes) -> dict:
    """V9: a verifier's receipt with its signature; other fields than the four known ones are refused."""
    if set(receipt) != RECEIPT_FIELDS:
        raise ValueError("a receipt has just schema, verifier, checked_at and counts")
    return {**receipt, "signature": hmac.new(key, b"receipt-v1\n" + attest.canonical_bytes(receipt), hashlib.sha256).hexdigest()}


def verify_receipt(signed: dict, key: bytes) -> bool:
    """V9."""
    body = {k: v for k, v in signed.items() if k != "signature"}
    return set(body) == RECEIPT_FIELDS and hmac.compare_digest(signed.get("signature", ""), sign_receipt(body, key)["signature"])


def backfill_revocations(facts: DataFrame, events: DataFrame, key: bytes) -> DataFrame:
    """Events for superseded facts without a trusted one; refused while the audit has other findings."""
    findings = attest.audit(facts, events, key)
    if findings.filter("finding <> 'unattested'").limit(1).count():
        raise ValueError("the audit isn't clean")
    return attest.revocations(facts.join(findings.select("id"), "id", "left_semi"), key)


def sign_insights(made: DataFrame, key: bytes | None, key_id: str, signed_at: str) -> DataFrame | None:
    """Envelopes for insights, made as those of facts; none without a key."""
    if key is None:
        return None
    rows = made.select("id", F.lit("insight").alias("kind"), "content", F.lit(None).cast("array<struct<event_id:string,path:string,line:int>>").alias("evidence"))
    return attest.sign(rows, key, key_id, signed_at)
