"""Word sets of records, collapsed to classes of equal sets, and the exact check of candidate pairs.

Spark takes a list of words for one word and a kernel's output for its input, so by its estimates tables that are many times
larger than they seem would pass through the driver as broadcasts. Joins of tables that grow with the records say ``merge``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import words
from factloom.session import cut


@dataclass
class WordSets:
    """members: (id, no, *extra) per record; classes: (no, part, size, sig) per distinct set.

    ``part`` is the partition within which sets are compared (such as the kind). ``sig`` holds the
    64-bit hashes of the words in ascending order; ``no`` numbers the classes.
    """

    members: DataFrame
    classes: DataFrame


def word_sets(records: DataFrame, min_words: int, extra: tuple[str, ...] = ()) -> WordSets:
    """Word sets of (id, part, content, *extra); null ids and parts and rows of fewer than ``min_words`` words drop.

    Null content counts as empty. A repeated id counts once: of differing rows the one with the least values of
    ``extra``, then the one whose set hashes lowest. Equal sets of one part fall into one class (by 128 bits of hash).
    No text is shuffled.
    """
    signed = (
        records.filter(F.col("id").isNotNull() & F.col("part").isNotNull())
        .select("id", "part", *extra, F.array_sort(F.array_distinct(F.transform(words(F.col("content")), lambda w: F.xxhash64(w)))).alias("sig"))
        .filter(F.size("sig") >= min_words)
        .withColumn("c1", F.xxhash64("part", "sig")).withColumn("c2", F.xxhash64(F.lit(7), "sig", "part"))
    )
    signed = cut(signed)
    members = signed.groupBy("id").agg(F.min(F.struct(*extra, "c1", "c2")).alias("r")).select("id", "r.*")
    held = members.select("c1", "c2").distinct()
    classes = signed.groupBy("c1", "c2").agg(F.first("part").alias("part"), F.first("sig").alias("sig")).join(held.hint("merge"), ["c1", "c2"], "left_semi")
    classes = cut(classes.select("c1", "c2", "part", F.size("sig").alias("size"), "sig").withColumn("no", F.monotonically_increasing_id()))
    numbered = members.join(classes.select("c1", "c2", "no").hint("merge"), ["c1", "c2"]).select("id", "no", *extra)
    return WordSets(cut(numbered), classes.select("no", "part", "size", "sig"))


def verify(candidates: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """Keeps the candidate pairs (a, b) of classes of one part whose Jaccard similarity is at least ``similarity``."""
    left = classes.select(F.col("no").alias("a"), F.col("part").alias("part_a"), F.col("sig").alias("sig_a"))
    right = classes.select(F.col("no").alias("b"), F.col("part").alias("part_b"), F.col("sig").alias("sig_b"))
    shared = F.size(F.array_intersect("sig_a", "sig_b"))
    return (
        candidates.join(left.hint("merge"), "a")
        .join(right.hint("merge"), "b")
        .withColumn("shared", shared)
        .filter((F.col("part_a") == F.col("part_b")) & (F.col("shared") / (F.size("sig_a") + F.size("sig_b") - F.col("shared")) >= F.lit(similarity)))
        .select("a", "b", "shared")
    )
