"""Shared pieces of the training-data operators: words, copy classes, skew-safe joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD_PATTERN = "[a-z0-9]+"

#: Keys that hold more than 1/HOT_SHARE of all rows count as hot. Fewer than HOT_SHARE keys
#: can exceed that share, so a table of hot keys has a size bound that data can't outgrow.
HOT_SHARE = 1000


def words(text: Column) -> Column:
    """All words (maximal runs of a-z and 0-9) of the lower-cased text; null gives an empty array."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD_PATTERN), F.lit(0))


def distinct_ids(facts: DataFrame, *columns: str) -> DataFrame:
    """One row per id (null ids drop); the first row by value stands for repeated ones."""
    picked = facts.filter(F.col("id").isNotNull()).select("id", F.struct(*columns).alias("row"))
    return picked.groupBy("id").agg(F.min("row").alias("row")).select("id", *[F.col("row")[c].alias(c) for c in columns])


def hot_keys(counts: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """The keys of ``counts`` above total / HOT_SHARE; at most HOT_SHARE of them."""
    return counts.filter(F.col(count) > total / HOT_SHARE).select(key, count)


def attach_counts(rows: DataFrame, counts: DataFrame, key: str, columns: list[str], count: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with per-key figures, without a hot reducer.

    Hot keys (at most HOT_SHARE, see ``hot_keys``) are joined by broadcast where their rows
    lie; only the others, none of which holds more than 1/HOT_SHARE of the rows, are shuffled.
    """
    limit = total / HOT_SHARE
    hot = counts.filter(F.col(count) > limit).select(key, *columns)
    marked = rows.join(F.broadcast(hot), key, "left")
    of_hot = marked.filter(F.col(columns[0]).isNotNull())
    rest = marked.filter(F.col(columns[0]).isNull()).drop(*columns)
    return of_hot.unionByName(rest.join(counts.filter(F.col(count) <= limit).select(key, *columns), key))


def one_cell(block_a: Column, block_b: Column, cell_x: Column, cell_y: Column) -> Column:
    """True in the one cell that has to report a pair of rows in these blocks.

    A long list is cut into blocks; each row goes to the cells of its block with every block, so a join on the
    cell sees each pair of rows in exactly one cell under this condition.
    """
    return (cell_x == cell_y) | (block_a != block_b)


def required_overlap(size_a: Column, size_b: Column, similarity: float) -> Column:
    """Least number of shared words of two sets of these sizes with at least that Jaccard similarity."""
    return F.ceil((size_a + size_b) * F.lit(similarity / (1 + similarity)) - F.lit(1e-9)).cast("int")
