"""Problem 4: most similar vectors by shifted Hilbert orderings.

Vectors are scaled to length 1 and rounded to 16 bits a component (similarities carry an error of
about 1e-5). ``ORDERINGS`` times they are projected with another rotation, shifted and sorted along a
Hilbert curve (a second key orders what shares a coarse cell, so a dense cell is neither one task's nor
in arbitrary order); Spark range-partitions the keys of all orderings at once, and within the sorted
stream every vector is compared with those of its own block of ``BLOCK`` and of both blocks beside it.
The best of each window are merged over the orderings and re-ranked.

Equal vectors form one class, which is compared once; a class hands out its first k + 1 ids, so copies
never make all pairs. Every vector is both indexed and queried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.session import cut

K, ORDERINGS, BLOCK, DIMENSIONS, BITS, FINE, SEED, SALTS, ROWS_A_TASK = 5, 8, 1024, 12, 5, 5, 20250, 16, 250_000


def hilbert_keys(cells: np.ndarray, bits: int, fine: int = 0) -> tuple[np.ndarray, np.ndarray] | np.ndarray:
    """Places along the Hilbert curve of integer points (rows of ``cells``, ``bits`` bits a coordinate).

    With ``fine``, the place of the coarse cell (all but the last ``fine`` bits) and the place within it.
    """
    axes = [c.astype(np.uint32) for c in cells.T]
    one = np.uint32(1)
    top = np.uint32(1 << (bits - 1))
    q = top
    while q > 1:
        low = np.uint32(q - 1)
        for i in range(len(axes)):
            inside = (axes[i] & q) != 0
            swap = np.where(inside, 0, (axes[0] ^ axes[i]) & low).astype(np.uint32)
            axes[0] = np.where(inside, axes[0] ^ low, axes[0] ^ swap)
            if i:
                axes[i] = axes[i] ^ swap
        q = np.uint32(q >> 1)
    for i in range(1, len(axes)):
        axes[i] = axes[i] ^ axes[i - 1]
    flip = np.zeros_like(axes[0])
    q = top
    while q > 1:
        flip = np.where((axes[-1] & q) != 0, flip ^ np.uint32(q - 1), flip)
        q = np.uint32(q >> 1)

    def key(high: int, low: int) -> np.ndarray:
        out = np.zeros(len(cells), np.uint64)
        for b in range(high - 1, low - 1, -1):
            for a in axes:
                out = (out << np.uint64(1)) | (((a ^ flip) >> np.uint32(b)) & one).astype(np.uint64)
        return out.astype(np.int64)

    return (key(bits, fine), key(fine, 0)) if fine else key(bits, 0)


def _binary(rows: np.ndarray) -> pa.Array:
    """Rows of an array as one binary value each."""
    data = np.ascontiguousarray(rows).view(np.uint8)
    width = data.nbytes // max(1, len(rows))
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    parts = [np.frombuffer(c.buffers()[2], np.uint8)[c.offset * width * 2 : (c.offset + len(c)) * width * 2].view(np.int16).reshape(-1, width) if len(c) else np.zeros((0, width), np.int16) for c in chunks]
    return np.concatenate(parts) if parts else np.zeros((0, width), np.int16)


def _unit(rounded: np.ndarray) -> np.ndarray:
    x = rounded.astype(np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def rounded_vectors(vectors: DataFrame, key: str, width: int) -> DataFrame:
    """(id, payload): usable vectors, scaled so that the largest component is 32767. Others drop."""

    def scale(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
            most = np.abs(x).max(axis=1, initial=0)
            fit = np.isfinite(x).all(axis=1) & (most > 0)
            r = np.rint(x[fit] / most[fit, None] * 32767).astype(np.int16)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(fit)), _binary(r)], ["id", "payload"])

    whole = vectors.filter(F.col(key).isNotNull() & (F.size("vector") == width) & ~F.exists("vector", lambda v: v.isNull()))
    return whole.select(F.col(key).alias("id"), F.col("vector").cast("array<double>").alias("vector")).mapInArrow(scale, "id string, payload binary")


def _orderings(width: int, orderings: int):
    rng = np.random.default_rng(SEED)
    turns = [np.linalg.qr(rng.standard_normal((width, width)))[0][:, : min(DIMENSIONS, width)] for _ in range(orderings)]
    shifts = rng.random((orderings, min(DIMENSIONS, width)))
    cells, spread = 1 << (BITS + FINE), 3 / np.sqrt(width)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _unit(_matrix(b.column(1), width))
            for m, (turn, shift) in enumerate(zip(turns, shifts)):
                at = ((x @ turn) / spread + 1) / 2 + (shift - 0.5) / 4
                coarse, fine = hilbert_keys(np.clip(at * cells, 0, cells - 1).astype(np.uint32), BITS + FINE, FINE)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), m, np.int32)), pa.array(coarse), pa.array(fine), b.column(0), b.column(1)], ["m", "place", "within", "cls", "payload"])

    return place


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best columns of each row; ``scores`` is used up."""
    n = len(scores)
    rows = np.arange(n)
    best, who = np.full((n, k), -2, np.float32), np.zeros((n, k), np.int64)
    for j in range(min(k, scores.shape[1])):
        at = scores.argmax(axis=1)
        best[:, j], who[:, j] = scores[rows, at], ids[at]
        scores[rows, at] = -2
    return best, who


def _windows(width: int, k: int, block: int, min_score: float):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None  # ordering, ids, unit vectors, best scores and ids so far of the last block

        def out(best: np.ndarray, who: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
            real = best >= max(min_score, -1.5)
            some = real.any(axis=1)
            best, who, ids, real = best[some], who[some], ids[some], real[some]
            offsets = pa.array(np.append(0, np.cumsum(real.sum(axis=1))).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(v[real])) for v in (who, best)]
            return pa.RecordBatch.from_arrays([pa.array(ids), *lists], ["cls", "near", "score"])

        def step(m: int, ids: np.ndarray, x: np.ndarray) -> Iterator[pa.RecordBatch]:
            nonlocal before
            own = x @ x.T
            np.fill_diagonal(own, -2)
            if before is not None and before[0] == m:
                across = x @ before[2].T
                best, who = _best(across.T.copy(), ids, k)
                merged, names = np.hstack([before[3], best]), np.hstack([before[4], who])
                order = np.argsort(-merged, axis=1, kind="stable")[:, :k]
                yield out(np.take_along_axis(merged, order, 1), np.take_along_axis(names, order, 1), before[1])
                own, others = np.hstack([own, across]), np.append(ids, before[1])
            else:
                if before is not None:
                    yield out(before[3], before[4], before[1])
                others = ids
            best, who = _best(own, others, k)
            before = (m, ids, x, best, who)

        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0
        for b in batches:
            held.append((b.column(0).to_numpy(), b.column(1).to_numpy(), _matrix(b.column(2), width)))
            size += len(held[-1][0])
            if size < 4 * block:
                continue
            ms, ids, r = (np.concatenate(c) for c in zip(*held))
            done = 0
            while len(ms) - done >= 2 * block:
                end = done + min(block, int(np.searchsorted(ms[done:], ms[done], side="right")))
                yield from step(int(ms[done]), ids[done:end], _unit(r[done:end]))
                done = end
            held, size = [(ms[done:], ids[done:], r[done:])], len(ms) - done
        if held:
            ms, ids, r = (np.concatenate(c) for c in zip(*held))
            done = 0
            while done < len(ms):
                end = done + min(block, int(np.searchsorted(ms[done:], ms[done], side="right")))
                yield from step(int(ms[done]), ids[done:end], _unit(r[done:end]))
                done = end
        if before is not None:
            yield out(before[3], before[4], before[1])

    return compare


def class_neighbours(classes: DataFrame, width: int, k: int = K, orderings: int = ORDERINGS, block: int = BLOCK, min_score: float = -1.0) -> DataFrame:
    """(cls, near: array of (score, cls) best first): up to k similar classes of (cls, payload), none below ``min_score``."""
    # a task's share of the keys is bounded, whatever the number of vectors
    tasks = max(int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-classes.count() * orderings // ROWS_A_TASK))
    placed = classes.select("cls", "payload").mapInArrow(_orderings(width, orderings), "m int, place long, within long, cls long, payload binary")
    sorted_keys = placed.repartitionByRange(tasks, "m", "place", "within").sortWithinPartitions("m", "place", "within").select("m", "cls", "payload")
    windows = sorted_keys.mapInArrow(_windows(width, k, block, min_score), "cls long, near array<long>, score array<float>")
    lists = windows.groupBy("cls").agg(F.flatten(F.collect_list(F.arrays_zip("score", "near"))).alias("all"))
    best = F.transform(
        F.array_distinct(F.transform("all", lambda x: x["near"])),
        lambda n: F.struct((-F.array_max(F.transform(F.filter(F.col("all"), lambda x: x["near"] == n), lambda x: x["score"]))).alias("minus"), n.alias("near")),
    )
    top = F.slice(F.array_sort(best), 1, k)
    return lists.select("cls", F.transform(top, lambda x: F.struct((-x["minus"]).alias("score"), x["near"].alias("near"))).alias("near"))


def nearest(vectors: DataFrame, key: str, width: int, k: int = K, min_score: float = -1.0, orderings: int = ORDERINGS, block: int = BLOCK) -> DataFrame:
    """(id, rank, near_id, score): for each id the k ids with the most similar vectors, as far as found.

    ``vectors`` has (key, vector). Null, short, long, all-zero and non-finite vectors and null keys
    drop; a repeated key counts once (of differing vectors the one that hashes lowest). Equal scores rank by class, then
    id. Pairs with a score below ``min_score`` are left out.
    """
    rounded = rounded_vectors(vectors, key, width).withColumn("cls", F.xxhash64("payload"))
    members = cut(rounded.groupBy("id").agg(F.min("cls").alias("cls")))
    held = members.select("cls").distinct()
    classes = cut(rounded.groupBy("cls").agg(F.first("payload").alias("payload")).join(held, "cls", "left_semi"))
    near = cut(class_neighbours(classes, width, k, orderings, block, min_score))
    # the first ids of each class, by salted halves so that a class of very many copies isn't one task's
    salted = members.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    some = salted.withColumn("n", F.row_number().over(W.partitionBy("cls", "salt").orderBy("id"))).filter(F.col("n") <= k + 1)
    firsts = some.groupBy("cls").agg(F.slice(F.array_sort(F.collect_list("id")), 1, k + 1).alias("ids"), F.count(F.lit(1)).alias("n"))
    firsts = cut(firsts.select("cls", "ids"))
    wanted = near.select("cls", F.posexplode("near").alias("at", "x")).select("cls", "at", F.col("x.score").alias("score"), F.col("x.near").alias("near")).filter(F.col("score") >= min_score)
    named = wanted.join(firsts.select(F.col("cls").alias("near"), "ids"), "near").select("cls", "at", "score", F.explode("ids").alias("id"))
    copies = firsts.filter(F.size("ids") > 1).select("cls", F.lit(-1).alias("at"), F.lit(1.0).cast("float").alias("score"), F.explode("ids").alias("id"))
    lists = named.unionByName(copies).groupBy("cls").agg(F.array_sort(F.collect_list(F.struct("at", "id", "score"))).alias("list"))
    own = members.join(lists, "cls").withColumn("list", F.slice(F.filter("list", lambda x: x["id"] != F.col("id")), 1, k))
    return own.select("id", F.posexplode("list").alias("rank", "x")).select("id", (F.col("rank") + 1).alias("rank"), F.col("x.id").alias("near_id"), F.col("x.score").cast("double").alias("score"))


MODEL, WIDTH, ALIKE = "static-64", 64, 0.9
#: For the whole list of neighbours, near or not; near ones are found with fewer
FULL_ORDERINGS, FULL_BLOCK = 8, 5120


def fact_neighbours(vectors: DataFrame, min_score: float = -1.0, orderings: int = FULL_ORDERINGS, block: int = FULL_BLOCK) -> DataFrame:
    """``nearest`` for the usable vectors of one model among fact vectors."""
    return nearest(vectors.filter(F.col("model_id") == MODEL), "fact_id", WIDTH, min_score=min_score, orderings=orderings, block=block)


def similar_fact_pairs(vectors: DataFrame) -> DataFrame:
    """Distinct (id_a, id_b), the smaller id first: one is among the five nearest of the other, at 0.9 or more."""
    near = fact_neighbours(vectors, ALIKE, ORDERINGS, BLOCK)
    return near.select(F.least("id", "near_id").alias("id_a"), F.greatest("id", "near_id").alias("id_b")).distinct()
