"""Problem 1: near-duplicate records by a signature-coordinate inverted join.

The signature of a record is taken of its canonical text (``windows``): its coordinates are the words,
and the value of a coordinate the two words that follow it there. Two records collide in a coordinate if
both have it with the same value; a small edit changes few values, and similar records of sizes a and b
collide at least ``windows.threshold(a, b)`` times, whatever the data.

Records are posted under their coordinate-value pairs. Prefix merging: of the pairs in order of
frequency only a prefix is posted and merged; the most frequent ones, one less than the record's
least threshold, are skipped, as they are the long lists and can't hold all of a similar pair's collisions.
Merging counts collisions per pair of records; those that reach the match threshold, less what can have
been skipped, are retained and held against each other exactly. Entries whose sizes or parity sketches
rule the similarity out don't count. The result is exact.

Equal word sets are joined once, as a class. Long posting lists are cut into cells. No table that grows with
the records is broadcast, whatever Spark estimates (``similar_sets``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import stripped
from factloom.llm import windows
from factloom.llm.common import one_cell, required_overlap
from factloom.llm.similar_sets import WordSets, verify, word_sets
from factloom.session import cut

MIN_WORDS, SIMILARITY, LONGEST_LIST = 8, 0.75, 4096

POSTING = "key long, cell int, block int, no long, size int, skip int, sketch long"


def _postings(counts, similarity: float, q: int, min_words: int, longest: int):
    """Kernel from (no, mask, sig) to postings under the prefix of each signature; pairs of a hot range go to cells of blocks."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = counts.value
        limit = windows.hot_limit(seen, longest)
        for b in batches:
            row, key, sizes = windows.window_keys(b.column(2), q)
            if not len(key):
                continue
            key = key ^ b.column(1).to_numpy()[row]
            skip = np.maximum(windows.least_threshold(sizes, similarity, q, min_words) - 1, 0)
            at = windows.rarest(row, key, skip, seen)
            row, key = row[at], key[at]
            no, sketch = b.column(0).to_numpy(), windows.parity_sketch(b.column(2))
            blocks = -(-seen[windows.ranges_of(key)] // limit)
            copies = np.maximum(blocks, 1)
            mine = (no[row] * 0x9E3779B1 >> 8) % copies
            which = np.repeat(np.arange(len(row)), copies)
            other = np.arange(len(which)) - np.repeat(np.cumsum(copies) - copies, copies)
            low, high = np.minimum(mine[which], other), np.maximum(mine[which], other)
            r = row[which]
            columns = [key[which], (low * 32768 + high).astype(np.int32), mine[which].astype(np.int32), no[r], sizes[r].astype(np.int32), skip[r].astype(np.int32), sketch[r]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "cell", "block", "no", "size", "skip", "sketch"])

    return post


def class_pairs(classes: DataFrame, similarity: float = SIMILARITY, min_words: int = MIN_WORDS, longest: int = LONGEST_LIST) -> DataFrame:
    """Pairs (a, b), a < b, of classes (no, part, size, sig) of one part with at least this Jaccard similarity.

    Sets of fewer than ``min_words`` words must not be among them. ``longest`` changes the cost only, not the result.
    """
    q = windows.width(similarity, min_words)
    # another part gives other keys, so parts meet in no list
    sets = classes.select("no", F.xxhash64("part").bitwiseAND(F.lit((1 << (3 * windows.SYMBOL_BITS)) - 1)).alias("mask"), "sig")
    counts = classes.sparkSession.sparkContext.broadcast(windows.as_array(windows.range_counts(sets, q, mask=True)))
    posted = sets.mapInArrow(_postings(counts, similarity, q, min_words, longest), POSTING)
    left = posted.select("key", "cell", *[F.col(c).alias(f"{c}_a") for c in ("no", "block", "size", "skip", "sketch")])
    right = posted.select("key", "cell", *[F.col(c).alias(f"{c}_b") for c in ("no", "block", "size", "skip", "sketch")])
    need = required_overlap(F.col("size_a"), F.col("size_b"), similarity)
    differ = F.bit_count(F.col("sketch_a").bitwiseXOR(F.col("sketch_b")))
    once = one_cell(F.col("block_a"), F.col("block_b"), F.shiftright("cell", 15), F.col("cell").bitwiseAND(F.lit(32767)))
    merged = left.join(right.hint("merge"), ["key", "cell"]).filter(
        (F.col("no_a") < F.col("no_b")) & once & (F.least("size_a", "size_b") >= need) & (differ <= F.col("size_a") + F.col("size_b") - 2 * need)
    )
    # of the pair with the shorter prefix at most its skipped collisions can be missing
    least = windows.threshold_column(F.col("size_a"), F.col("size_b"), similarity, q) - F.greatest("skip_a", "skip_b")
    counted = merged.select(F.col("no_a").alias("a"), F.col("no_b").alias("b"), least.alias("least")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("collisions"), F.first("least").alias("least"))
    return verify(counted.filter(F.col("collisions") >= F.col("least")).select("a", "b"), classes, similarity)


def fact_sets(facts: DataFrame) -> WordSets:
    """Word sets of facts, compared within one kind (stripped, lower-cased; null equals nothing)."""
    return word_sets(facts.select("id", F.lower(stripped("kind")).alias("part"), "content"), MIN_WORDS)


def near_duplicate_pairs(facts: DataFrame) -> DataFrame:
    """Pairs (id_a, id_b) of facts of one kind with similarity of at least 0.75, copies included.

    Facts with fewer than 8 distinct words, with null id, kind or content make no pair. Other columns are ignored.
    """
    sets = fact_sets(facts)
    links = cut(class_pairs(sets.classes))
    left = sets.members.select(F.col("no").alias("a"), F.col("id").alias("x"))
    right = sets.members.select(F.col("no").alias("b"), F.col("id").alias("y"))
    across = links.select("a", "b").join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("x", "y")
    within = left.join(right.withColumnRenamed("b", "a").hint("merge"), "a").filter(F.col("x") < F.col("y")).select("x", "y")
    return across.unionByName(within).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def near_duplicate_classes(facts: DataFrame) -> DataFrame:
    """One row per compared fact: its class of equal word sets, the class size and its links to other classes."""
    sets = fact_sets(facts)
    links = cut(class_pairs(sets.classes))
    ends = links.select(F.col("a").alias("no")).unionAll(links.select(F.col("b").alias("no")))
    degree = ends.groupBy("no").agg(F.count(F.lit(1)).alias("links"))
    named = sets.members.groupBy("no").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("copies"))
    return (
        sets.members.select("id", "no").join(named.hint("merge"), "no").join(degree.hint("merge"), "no", "left")
        .select("id", "class_id", "copies", F.coalesce("links", F.lit(0)).alias("links"))
    )
