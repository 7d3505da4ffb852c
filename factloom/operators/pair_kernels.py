"""Arrow kernels of the similarity join: postings under rare tokens, and exact overlaps of whole blocks of sets."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Buckets of token hashes whose counts order the tokens; a fixed number, so the counts never grow with the rows
BUCKETS = 1 << 18

POSTING = "key long, no long, size int, place int, s0 long, s1 long, s2 long, s3 long"
PAIR = "a long, b long, overlap double"
#: Cells of overlaps that are counted at once, and what share of them a further word of 64 tokens must save
AT_ONCE, WORTH = 1 << 17, 0.08


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes, row of each value, values of a column of lists."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    return sizes, np.repeat(np.arange(len(sizes)), sizes), column.flatten().to_numpy()


def postings(low: float, counts) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From (no, mask, sig) to POSTING: the rarest tokens of each set, by the counts of their buckets, of which similar sets share one."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = counts.value
        for b in batches:
            if not b.num_rows:
                continue
            sizes, row, token = _flat(b.column(2))
            order = np.lexsort((token, seen[token & (BUCKETS - 1)], row))
            row, token = row[order], token[order]
            place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            sketch = np.zeros((b.num_rows, 4), np.int64)
            np.bitwise_xor.at(sketch, (row, (token >> 6) & 3), np.left_shift(np.int64(1), token & 63))
            kept = np.flatnonzero(place <= (sizes - np.ceil(sizes * low - 1e-9))[row])
            r = row[kept]
            columns = [token[kept] ^ b.column(1).to_numpy()[r], b.column(0).to_numpy()[r], sizes[r].astype(np.int32), place[kept].astype(np.int32), *[sketch[r, k] for k in range(4)]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "no", "size", "place", "s0", "s1", "s2", "s3"])

    return post


def _bitmaps(row: np.ndarray, rank: np.ndarray, n: int, words: int) -> np.ndarray:
    """(word, row): bit of each token of rank below 64 * words."""
    at = rank < 64 * words
    maps = np.zeros(words * n, np.uint64)
    np.bitwise_or.at(maps, (rank[at] >> 6) * n + row[at], np.left_shift(np.uint64(1), (rank[at] & 63).astype(np.uint64)))
    return maps.reshape(words, n)


def block_overlaps(low: float) -> Callable[[pa.Table], pa.Table]:
    """From one cell (lo, hi, mine, no, sig) to PAIR: the pairs of sets of block ``lo`` with sets of block ``hi`` with at least this similarity.

    Overlaps are exact: tokens that many pairs share are counted by bitmaps, all others by their lists.
    """

    def pairs(cell: pa.Table) -> pa.Table:
        lo, hi = cell["lo"][0].as_py(), cell["hi"][0].as_py()
        same = lo == hi
        mine, no = cell["mine"].to_numpy(), cell["no"].to_numpy()
        sizes, row, value = _flat(cell["sig"].combine_chunks())
        names, token = np.unique(value, return_inverse=True)
        local = np.empty(len(mine), np.int64)
        side_a, side_b = np.flatnonzero(mine == lo), np.flatnonzero(mine == hi)
        local[side_a], local[side_b] = np.arange(len(side_a)), np.arange(len(side_b))
        na, nb = len(side_a), len(side_b)
        empty = pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], ["a", "b", "overlap"])
        if not na or not nb:
            return empty
        of_a, of_b = mine[row] == lo, mine[row] == hi
        row_a, row_b = local[row[of_a]], local[row[of_b]]
        met = np.bincount(token[of_a], minlength=len(names)) * np.bincount(token[of_b], minlength=len(names))
        order = np.argsort(-met, kind="stable")
        rank = np.empty(len(names), np.int64)
        rank[order] = np.arange(len(names))
        words = 1
        while 64 * words < len(names) and met[order[64 * words : 64 * words + 64]].sum() > WORTH * na * nb:
            words += 1
        rank_a, rank_b = rank[token[of_a]], rank[token[of_b]]
        maps_a, maps_b = _bitmaps(row_a, rank_a, na, words), _bitmaps(row_b, rank_b, nb, words)
        listed = met[token[of_a]] > 0
        listed &= rank_a >= 64 * words
        # rows come in order, so a run of rows is a slice of their listed tokens
        by_row = np.argsort(row_a[listed], kind="stable")
        list_row, list_rank = row_a[listed][by_row], rank_a[listed][by_row]
        from_row = np.searchsorted(list_row, np.arange(na + 1))
        by_rank = np.lexsort((row_b, rank_b))
        spots = row_b[by_rank]
        begin = np.searchsorted(rank_b[by_rank], np.arange(len(names) + 1))
        size_a, size_b = sizes[side_a], sizes[side_b]
        kind = np.uint8 if sizes.max() <= 255 else np.uint32
        kinds, which = np.unique(size_a, return_inverse=True)
        need = np.ceil((kinds[:, None] + size_b[None, :]) * (low / (1 + low)) - 1e-9).astype(kind)
        both, ones, acc = np.empty(AT_ONCE + nb, np.uint64), np.empty(AT_ONCE + nb, np.uint8), np.empty(AT_ONCE + nb, kind)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        i = 0
        while i < na:
            first = i if same else 0
            width = nb - first
            end = min(na, i + max(1, AT_ONCE // width))
            shape, n = (end - i, width), (end - i) * width
            x, c, s = both[:n].reshape(shape), ones[:n].reshape(shape), acc[:n].reshape(shape)
            s[:] = 0
            for k in range(words):
                np.bitwise_and(maps_a[k, i:end, None], maps_b[k, None, first:], out=x)
                np.bitwise_count(x, out=c)
                np.add(s, c, out=s)
            r, t = list_row[from_row[i] : from_row[end]], list_rank[from_row[i] : from_row[end]]
            many = begin[t + 1] - begin[t]
            at = np.arange(many.sum()) + np.repeat(begin[t] - (np.cumsum(many) - many), many)
            j = spots[at] - first
            flat = (np.repeat(r, many) - i) * width + j
            np.add.at(acc, flat[j >= 0], kind(1))
            hit = np.flatnonzero(s >= need[which[i:end], first:])
            p, q = hit // width + i, hit % width + first
            shared = acc[hit].astype(np.int64)
            overlap = shared / (size_a[p] + size_b[q] - shared)
            good = (overlap >= low) & ((p < q) if same else True)
            if good.any():
                u, v = no[side_a[p[good]]], no[side_b[q[good]]]
                found.append((np.minimum(u, v), np.maximum(u, v), overlap[good]))
            i = end
        return pa.table([pa.array(np.concatenate(x)) for x in zip(*found)], ["a", "b", "overlap"]) if found else empty

    return pairs
