"""Fact stores on disk: one contract over JSON and Parquet folders (survey S7, S9 to S13, S16, C12 to C15)."""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import uuid
from contextlib import contextmanager
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REQUIRED = ("id", "kind", "status", "confidence", "content", "source_date", "evidence")
MARKER = "use-parquet"


def stamp() -> str:
    return datetime.now(timezone.utc).strftime("%Y%m%dT%H%M%S%f")


class FactStore:
    """A store in a local or mounted folder. ``replace_all`` writes beside the store and renames."""

    kind = "json"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, Path(path)

    @property
    def data(self) -> Path:
        return self.path / f"facts.{self.kind}"

    def _read(self, path: str) -> DataFrame:
        return self.spark.read.json(path)

    def _write(self, rows: DataFrame, path: str) -> None:
        rows.write.json(path, ignoreNullFields=False)

    def load(self) -> DataFrame:
        """The facts; a missing or unreadable store reads as empty and is noted in the degradation ledger. A read creates no store."""
        try:
            if not self.data.exists():
                raise FileNotFoundError(str(self.data))
            return self._read(str(self.data))
        except Exception as why:  # noqa: BLE001
            self.note({"reason": type(why).__name__, "store": str(self.data)}, "degradations")
            return self.spark.createDataFrame([], "id string, kind string, status string, confidence double, content string, source_date string")

    def replace_all(self, facts: DataFrame) -> None:
        """The new content replaces the old one by rename, after the old one became a backup; private modes."""
        self.path.mkdir(parents=True, exist_ok=True)
        os.chmod(self.path, 0o700)
        staged = self.path / f".staged-{uuid.uuid4().hex}"
        self._write(facts, str(staged))
        for f in staged.rglob("*"):
            os.chmod(f, 0o600)
        if self.data.exists():
            self.data.rename(self.path / f"backup-{stamp()}.{self.kind}")
        staged.rename(self.data)

    def snapshot(self) -> Path:
        """A copy of the data beside it."""
        to = self.path / f"snapshot-{stamp()}.{self.kind}"
        shutil.copytree(self.data, to)
        return to

    def describe(self) -> dict:
        return {"kind": self.kind, "path": str(self.data), "exists": self.data.exists()}

    def export_json(self, path: str) -> None:
        self.load().write.mode("overwrite").json(path, ignoreNullFields=False)

    def write_artifact(self, rows: DataFrame, name: str) -> None:
        """Writes a table derived from the facts beside them, as Parquet."""
        rows.write.mode("overwrite").parquet(str(self.path / name))

    def note(self, row: dict, ledger: str) -> None:
        """Appends a row to a ledger as one line with its end, in one write."""
        self.path.mkdir(parents=True, exist_ok=True)
        with open(self.path / f"{ledger}.jsonl", "a", encoding="utf-8") as f:
            f.write(json.dumps({"at": datetime.now(timezone.utc).isoformat(), **row}, ensure_ascii=False) + "\n")

    def ledger(self, name: str) -> list[dict]:
        """The whole rows of a ledger; a torn last line and unreadable ones are left out."""
        path = self.path / f"{name}.jsonl"
        rows = []
        for line in path.read_text(encoding="utf-8").split("\n")[:-1] if path.exists() else []:
            try:
                rows.append(json.loads(line))
            except ValueError:
                continue
        return rows

    @contextmanager
    def lock(self):
        """C14: one writer at a time."""
        import fcntl

        self.path.mkdir(parents=True, exist_ok=True)
        with open(self.path / ".lock", "w") as f:
            fcntl.flock(f, fcntl.LOCK_EX)
            yield self


class ParquetStore(FactStore):
    kind = "parquet"

    def _read(self, path: str) -> DataFrame:
        return self.spark.read.parquet(path)

    def _write(self, rows: DataFrame, path: str) -> None:
        rows.write.parquet(path)


def resolve_store(spark: SparkSession, path: str, choice: str = "") -> FactStore:
    """An explicit choice decides; else a marker beside an existing Parquet store; else JSON."""
    if choice == "json":
        return FactStore(spark, path)
    columnar = ParquetStore(spark, path)
    if choice == "parquet" or (columnar.data.exists() and (Path(path) / MARKER).exists()):
        return columnar
    return FactStore(spark, path)


def load_required(raw: DataFrame, value: str = "value", required: tuple[str, ...] = REQUIRED) -> tuple[DataFrame, DataFrame]:
    """(complete, incomplete) of JSON texts: a field that is present as null counts as present."""
    keys = F.coalesce(F.json_object_keys(value), F.array().cast("array<string>"))
    missing = F.array_except(F.array(*[F.lit(r) for r in required]), keys)
    marked = raw.withColumn("missing", missing)
    return marked.filter(F.size("missing") == 0).drop("missing"), marked.filter(F.size("missing") > 0)


def migrate(source: FactStore, target: FactStore, apply: bool = False) -> dict:
    """Copies a store into another one, if every gate holds: ids unique and present, counts and rows equal after re-reading."""
    rows = source.load()
    n = rows.count()
    gates = {
        "ids": rows.filter("id is null").limit(1).count() == 0 and rows.groupBy("id").count().filter("count > 1").limit(1).count() == 0,
    }
    receipt = {"rows": n, "applied": False, "gates": gates}
    if not all(gates.values()) or not apply:
        return receipt
    staged = type(target)(target.spark, str(target.path / f".migration-{uuid.uuid4().hex}"))
    try:
        staged.replace_all(rows)
        again = staged.load().select(*rows.columns)
        gates["count"] = again.count() == n
        gates["rows"] = not rows.exceptAll(again).limit(1).count() and not again.exceptAll(rows).limit(1).count()
        if all(gates.values()):
            target.replace_all(staged.load())
            (target.path / MARKER).touch()
            receipt["applied"] = True
    finally:
        shutil.rmtree(staged.path, ignore_errors=True)
    target.note(receipt, "migrations")
    return receipt


def fingerprint(rows: DataFrame) -> tuple[int, str]:
    """Count and an order-free hash of rows."""
    n, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64(*rows.columns).cast("decimal(38,0)")), F.lit(0))).first()
    return n, str(total)


def write_with_receipt(rows: DataFrame, path: str, ledger: FactStore) -> dict:
    """Writes Parquet, reads it again and compares: applied or ambiguous; the receipt goes to the ledger."""
    before = fingerprint(rows)
    rows.write.mode("overwrite").parquet(path)
    after = fingerprint(rows.sparkSession.read.parquet(path).select(*rows.columns))
    receipt = {"artifact_path": path, "rows": after[0], "hash": after[1], "status": "applied" if before == after else "ambiguous"}
    ledger.note(receipt, "receipts")
    return receipt


def inputs_digest(paths: list[str]) -> str:
    """A digest of files by path and bytes; absent ones leave a mark."""
    h = hashlib.sha256()
    for p in sorted(paths):
        h.update(p.encode() + b"\0")
        h.update(Path(p).read_bytes() if Path(p).is_file() else b"(absent)")
        h.update(b"\0")
    return h.hexdigest()


def open_window(state: dict, job: str, digest: str) -> tuple[str, str | None]:
    """(skip, None) if the job has settled for this digest, else (run, nonce) and the state has the open window."""
    seen = state.get(job)
    if seen and seen.get("settled") and seen.get("digest") == digest:
        return "skip", None
    nonce = uuid.uuid4().hex
    state[job] = {"digest": digest, "nonce": nonce, "settled": False, "opened_at": stamp()}
    return "run", nonce


def settle(state: dict, job: str, nonce: str, result: str) -> bool:
    """Closes the window that the nonce opened; another one's nonce closes nothing."""
    seen = state.get(job)
    if not seen or seen["nonce"] != nonce:
        return False
    seen.update(settled=True, result=result, settled_at=stamp())
    return True


def edit_fact(store: FactStore, fact_id: str, old: str, new: str, actor: str) -> dict:
    """Replaces the one occurrence of a text in a fact; the history row is written before the store."""
    with store.lock():
        rows = store.load()
        found = rows.filter(F.col("id") == fact_id).select("content").limit(2).collect()
        if len(found) != 1 or (found[0].content or "").count(old) != 1 or not old:
            raise ValueError("the fact or the text isn't there exactly once")
        before, after = found[0].content, found[0].content.replace(old, new)
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        row = {"fact_id": fact_id, "actor": actor, "old_sha256": sha(before), "new_sha256": sha(after), "old": old, "new": new}
        store.note(row, "edits")
        store.replace_all(rows.withColumn("content", F.when(F.col("id") == fact_id, F.lit(after)).otherwise(F.col("content"))))
        return row


def revert_edit(store: FactStore, fact_id: str, actor: str) -> bool:
    """Undoes the last edit if the content is still what it left; done before, it does nothing."""
    edits = [e for e in store.ledger("edits") if e["fact_id"] == fact_id]
    if not edits or edits[-1].get("op") == "revert":
        return False
    last = edits[-1]
    with store.lock():
        rows = store.load()
        found = rows.filter(F.col("id") == fact_id).select("content").first()
        if not found or hashlib.sha256(found.content.encode()).hexdigest() != last["new_sha256"]:
            raise ValueError("the fact has changed since")
        content = found.content.replace(last["new"], last["old"]) if last["new"] else found.content
        if hashlib.sha256(content.encode()).hexdigest() != last["old_sha256"]:
            raise ValueError("the edit can't be undone by text")
        store.replace_all(rows.withColumn("content", F.when(F.col("id") == fact_id, F.lit(content)).otherwise(F.col("content"))))
        store.note({"fact_id": fact_id, "actor": actor, "op": "revert", "old_sha256": last["new_sha256"], "new_sha256": last["old_sha256"], "old": last["new"], "new": last["old"]}, "edits")
    return True
