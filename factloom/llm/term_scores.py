"""Problem 5: how distinctive a term is of a record, by residual inverse document frequency.

Per (record, term): occurrences ``tf``; per term: record frequency ``n`` and collection frequency
``cf``; ``idf`` = ln(N / n) is the observed value, ``expected`` = -ln(1 - exp(-cf / N)) what a Poisson
spread of its occurrences over the N records would give; ``residual`` = idf - expected, and
``residual_score`` = residual x n rewards terms that are concentrated in few records but shared.
``score`` = tf x idf is the observed value of the term in its record, which query p5_found ranks by.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import attach_counts, distinct_ids, words
from factloom.session import cut


def term_scores(records: DataFrame) -> DataFrame:
    """Scores of every term of (id, content) that occurs in at least two records.

    N counts the records with at least one word. Null ids drop; null or wordless contents have no
    rows. Repeated rows of an id count once.
    """
    spelled = distinct_ids(records, "content").select("id", words(F.col("content")).alias("w")).filter(F.size("w") > 0)
    tf = cut(spelled.select("id", F.explode("w").alias("term")).groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf")))
    n_all = tf.groupBy("id").agg(F.lit(1).alias("one")).count()
    counts = cut(tf.groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.sum("tf").alias("cf")))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shared = counts.filter(F.col("n") >= 2)
    big = F.lit(float(max(n_all, 1)))
    scored = attach_counts(tf, shared, "term", ["n", "cf"], "n", total)
    idf = F.log(big / F.col("n"))
    expected = -F.log1p(-F.exp(-F.col("cf") / big))
    return (
        scored.withColumn("idf", idf)
        .withColumn("expected", expected)
        .withColumn("residual", F.col("idf") - F.col("expected"))
        .withColumn("residual_score", F.col("residual") * F.col("n"))
        .withColumn("score", F.col("tf") * F.col("idf"))
        .select("id", "term", "tf", "n", "cf", "idf", "expected", "residual", "residual_score", "score")
    )


def top_terms(scores: DataFrame, by: str = "score") -> DataFrame:
    """(id, term): the best term of each record; scores equal at 9 decimals tie, the first word in sort order wins."""
    best = scores.groupBy("id").agg(F.min(F.struct((-F.round(by, 9)).alias("s"), "term")).alias("best"))
    return best.select("id", F.col("best.term").alias("term"))
