"""Attestation: canonical bytes, signatures, verification, revocations (survey 2.12, J5 to J7, J11).

Signatures are HMAC-SHA256; hashes of plain columns stay in the JVM, canonical JSON and HMAC run as Arrow UDFs.
"""

from __future__ import annotations

import hashlib
import hmac
import json
import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DOMAIN = b"fact-attestation-v1\n"


def canonical_bytes(value) -> bytes:
    """JSON with sorted keys, compact, without NaN and infinities."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False).encode("utf-8")


def contract_text(value) -> str:
    """Contract JSON: finite numbers, no negative zero, integral floats as integers, no exponents."""

    def tidy(v):
        if isinstance(v, bool) or v is None or isinstance(v, (str, int)):
            return v
        if isinstance(v, float):
            if not math.isfinite(v):
                raise ValueError("only finite numbers can be signed")
            return int(v) if v == int(v) else v
        if isinstance(v, dict):
            return {str(k): tidy(x) for k, x in v.items()}
        return [tidy(x) for x in v]

    out = json.dumps(tidy(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
    return out


def _json(text: Column) -> Column:
    """A text as JSON: quoted, with the escapes of canonical JSON; null as null."""
    return F.coalesce(F.substring(F.to_json(F.array(text)), F.lit(2), F.length(F.to_json(F.array(text))) - 2), F.lit("null"))


def fact_hash(ids: Column | str, kinds: Column | str, contents: Column | str) -> Column:
    """Hash of {content, id, kind} as canonical JSON."""
    c, i, k = (F.col(x) if isinstance(x, str) else x for x in (contents, ids, kinds))
    return F.sha2(F.concat(F.lit('{"content":'), _json(c), F.lit(',"id":'), _json(i), F.lit(',"kind":'), _json(k), F.lit("}")), 256)


def source_hash(evidence: Column) -> Column:
    """Hash of the evidence anchors as canonical JSON: keys sorted, missing ones left out; no evidence is an empty list."""

    def anchor(e: Column) -> Column:
        fields = [F.when(e["event_id"].isNotNull(), F.concat(F.lit('"event_id":'), _json(e["event_id"]))), F.when(e["line"].isNotNull(), F.concat(F.lit('"line":'), e["line"].cast("string")))]
        fields.append(F.when(e["path"].isNotNull(), F.concat(F.lit('"path":'), _json(e["path"]))))
        return F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}"))

    return F.sha2(F.concat(F.lit("["), F.coalesce(F.array_join(F.transform(evidence, anchor), ","), F.lit("")), F.lit("]")), 256)


def absent_parent(parent: Column) -> Column:
    """The hash that stands for a parent that isn't in the store."""
    return F.sha2(F.concat(F.lit('{"absent_parent_id":'), _json(parent), F.lit("}")), 256)


def parent_hashes(children: DataFrame, facts: DataFrame) -> DataFrame:
    """(id, parents): sorted hashes of the parents that children (id, parent_fact_ids) name, as the facts are now."""
    named = children.select("id", F.explode_outer("parent_fact_ids").alias("parent"))
    hashes = facts.select(F.col("id").alias("parent"), fact_hash("id", "kind", "content").alias("hash"))
    found = named.join(hashes, "parent", "left")
    value = F.when(F.col("parent").isNotNull(), F.coalesce("hash", absent_parent(F.col("parent"))))
    return found.groupBy("id").agg(F.sort_array(F.collect_list(value)).alias("parents"))


def signed_text(fact: Column, source: Column, parents: Column) -> Column:
    """The canonical JSON that a signature covers, after the domain."""
    quoted = F.array_join(F.transform(parents, lambda p: F.concat(F.lit('"'), p, F.lit('"'))), ",")
    return F.concat(F.lit('{"canonical_fact_hash":"'), fact, F.lit('","parent_hashes":['), F.coalesce(quoted, F.lit("")), F.lit('],"source_hash":"'), source, F.lit('"}'))


def _signer(key: bytes, domain: bytes = DOMAIN):
    @F.pandas_udf(T.StringType())
    def sign(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else hmac.new(key, domain + t.encode(), hashlib.sha256).hexdigest() for t in texts], dtype=object)

    return sign


def hashed(facts: DataFrame) -> DataFrame:
    """Adds fact_hash and source_hash; all but the signature stays in the JVM."""
    return facts.withColumn("fact_hash", fact_hash("id", "kind", "content")).withColumn("source_hash", source_hash(F.col("evidence")))


def sign(facts: DataFrame, key: bytes, key_id: str, signed_at: str, store: DataFrame | None = None) -> DataFrame:
    """V4: an envelope (fact_id, fact_hash, source_hash, parent_fact_ids, alg, key_id, signature, signed_at) for every fact.

    Parents are those of a column parent_fact_ids, if there is one; their hashes are taken from ``store`` (the facts themselves by default).
    """
    rows = hashed(facts)
    none = F.array().cast("array<string>")
    if "parent_fact_ids" in facts.columns:
        rows = rows.withColumn("parent_fact_ids", F.coalesce("parent_fact_ids", none)).join(parent_hashes(facts, store if store is not None else facts), "id", "left")
    else:
        rows = rows.withColumns({"parent_fact_ids": none, "parents": none})
    signature = _signer(key)(signed_text(F.col("fact_hash"), F.col("source_hash"), F.col("parents")))
    return rows.select(
        F.col("id").alias("fact_id"), "fact_hash", "source_hash", "parent_fact_ids", F.lit("hmac-sha256").alias("alg"), F.lit(key_id).alias("key_id"), signature.alias("signature"), F.lit(signed_at).alias("signed_at")
    )


def verify(facts: DataFrame, envelopes: DataFrame, key: bytes) -> DataFrame:
    """V2: (id, verdict) of envelopes of version 1: unsigned, tampered, parent-suspect or valid.

    A fact without envelope is unsigned; an envelope with a missing field, another algorithm, or hashes other than the fact's own is tampered.
    Where those hold and the signature fails over the parents as they are now, a parent has changed, if the envelope names any.
    """
    own = hashed(facts).select("id", F.col("fact_hash").alias("now_fact"), F.col("source_hash").alias("now_source"))
    held = envelopes.withColumnRenamed("fact_id", "id").withColumn("held", F.lit(True))
    if "parent_fact_ids" not in envelopes.columns:
        held = held.withColumn("parent_fact_ids", F.array().cast("array<string>"))
    both = own.join(held, "id", "left").join(parent_hashes(held, facts), "id", "left")
    both = both.withColumn("expected", _signer(key)(signed_text(F.col("fact_hash"), F.col("source_hash"), F.col("parents"))))
    whole = F.lit(True)
    for field in ("fact_hash", "source_hash", "alg", "key_id", "signature", "signed_at"):
        whole = whole & (F.length(field) > 0)
    own_holds = F.coalesce(whole & F.col("parent_fact_ids").isNotNull() & (F.col("now_fact") == F.col("fact_hash")) & (F.col("now_source") == F.col("source_hash")) & (F.col("alg") == "hmac-sha256"), F.lit(False))
    verdict = F.when(F.col("held").isNull(), "unsigned").when(~own_holds, "tampered").when(F.col("expected") == F.col("signature"), "valid").when(F.size("parent_fact_ids") > 0, "parent-suspect")
    return both.select("id", verdict.otherwise("tampered").alias("verdict"))


def recallable(facts: DataFrame, verdicts: DataFrame | None, strict: bool = False) -> DataFrame:
    """V1: drops tampered facts, under ``strict`` unsigned and parent-suspect ones too; without verdicts everything passes."""
    if verdicts is None:
        return facts
    bad = ["tampered", "unsigned", "parent-suspect"] if strict else ["tampered"]
    return facts.join(verdicts.filter(F.col("verdict").isin(bad)).select("id"), "id", "left_anti")


def verdict_counts(verdicts: DataFrame) -> DataFrame:
    """A10."""
    return verdicts.groupBy("verdict").agg(F.count(F.lit(1)).alias("facts"))


def exit_code(counts: dict[str, int], invalid_revocations: int = 0, unattested: int = 0, strict: bool = False, strict_revocations: bool = False) -> int:
    """2 tampered, 3 unsigned under strict, 4 invalid or resurrected revocations, 5 unattested ones under strict."""
    if counts.get("tampered"):
        return 2
    if strict and counts.get("unsigned"):
        return 3
    if invalid_revocations:
        return 4
    return 5 if strict_revocations and unattested else 0


def revocation_signature(key: bytes):
    @F.pandas_udf(T.StringType())
    def sign_event(old: pd.Series, new: pd.Series, reason: pd.Series, at: pd.Series) -> pd.Series:
        rows = zip(old, new, reason, at)
        return pd.Series([hmac.new(key, b"revocation-v1\n" + canonical_bytes([o, n, r, t]), hashlib.sha256).hexdigest() for o, n, r, t in rows], dtype=object)

    return sign_event


def revocations(facts: DataFrame, key: bytes) -> DataFrame:
    """V7: a signed event for each superseded fact."""
    rows = facts.filter(F.col("status") == "superseded").select(
        F.col("id").alias("superseded_id"), F.col("superseded_by").alias("superseding_id"), F.coalesce("supersession_reason", F.lit("")).alias("reason"), F.coalesce("superseded_at", F.lit("")).alias("superseded_at")
    )
    return rows.withColumn("signature", revocation_signature(key)("superseded_id", "superseding_id", "reason", "superseded_at"))


def audit(facts: DataFrame, events: DataFrame, key: bytes, retired_keys: list[bytes] | tuple[bytes, ...] = ()) -> DataFrame:
    """(id, finding): invalid events, facts that a trusted event revokes but are live again, superseded facts without trusted event.

    An event is trusted if the key, or one of the keyring's retired ones, signed it.
    """
    holds = F.lit(False)
    for k in [key, *retired_keys]:
        holds = holds | F.coalesce(F.col("signature") == revocation_signature(k)("superseded_id", "superseding_id", "reason", "superseded_at"), F.lit(False))
    checked = events.withColumn("ok", holds)
    trusted = checked.filter("ok").select(F.col("superseded_id").alias("id")).distinct()
    invalid = checked.filter(~F.coalesce("ok", F.lit(False))).select(F.col("superseded_id").alias("id"), F.lit("invalid").alias("finding"))
    resurrected = facts.filter(F.col("status") != "superseded").join(trusted, "id", "left_semi").select("id", F.lit("resurrected").alias("finding"))
    unattested = facts.filter(F.col("status") == "superseded").join(trusted, "id", "left_anti").select("id", F.lit("unattested").alias("finding"))
    return invalid.unionAll(resurrected).unionAll(unattested)


def chain_breaks(batches: DataFrame) -> DataFrame:
    """Batches (seq, digest, parent_digest) whose parent isn't the batch before; the first has none to match."""
    from pyspark.sql import Window as W

    before = F.lag("digest").over(W.orderBy("seq"))
    return batches.withColumn("_before", before).filter(F.col("_before").isNotNull() & ~F.col("_before").eqNullSafe(F.col("parent_digest"))).drop("_before")


def stub_encoder(width: int = 32):
    """V3: a deterministic encoder: centred bytes of the text's sha256, scaled to length 1."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def encode(texts: pd.Series) -> pd.Series:
        import numpy as np

        def one(t: str | None):
            x = np.frombuffer(hashlib.sha256((t or "").encode()).digest(), np.uint8).astype(float)[:width]
            x = x - x.mean()
            return (x / (np.linalg.norm(x) or 1.0)).astype("float32").tolist()

        return texts.map(one)

    return encode


CLAIM_RULES = {
    "scope": "scope in ('private', 'team', 'shared', 'public')",
    "confidence": "confidence >= 0 and confidence <= 1",
    "valid_from": r"valid_from is null or valid_from rlike '^\\d{4}-\\d{2}-\\d{2}T\\d{2}:\\d{2}:\\d{2}\\.\\d{6}Z$'",
    "valid_to": r"valid_to is null or (valid_to rlike '^\\d{4}-\\d{2}-\\d{2}T\\d{2}:\\d{2}:\\d{2}\\.\\d{6}Z$' and (valid_from is null or valid_to > valid_from))",
    "content_sha256": "content_sha256 rlike '^sha256:[0-9a-f]{64}$'",
    "claim_id": "claim_id rlike '^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$'",
    "revision_ids": "size(revision_ids) = size(array_distinct(revision_ids)) and forall(revision_ids, r -> r rlike '^sha256:[0-9a-f]{64}$')",
}


def claim_faults(claims: DataFrame) -> DataFrame:
    """V5: adds ``faults``: the fields of a claim payload that break their rule."""
    checks = [F.when(~F.coalesce(F.expr(rule), F.lit(False)), F.lit(field)) for field, rule in CLAIM_RULES.items() if field in claims.columns]
    return claims.withColumn("faults", F.filter(F.array(*checks), lambda x: x.isNotNull()))
