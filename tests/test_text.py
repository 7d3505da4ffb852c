import datetime

import pytest
from pyspark.sql import functions as F

from factloom.functions import scoring, text
from factloom.functions.dates import instant


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).first().x


def test_stem_keeps_short_words_and_double_s(spark):
    assert one(spark, text.recall_tokens(F.col("c")), c="Policies classes pass runs") == ["policy", "classe", "pass", "runs"]
    assert text.query_terms("Policies of the classes, policies") == ["policy", "classe"]
    assert one(spark, text.recall_tokens(F.col("c").cast("string")), c=None) == []


@pytest.mark.parametrize("share, factor", [(0.45, 0.8), (0.95, 0.5), (0.2, 1.0)])
def test_bulk_date_factor(spark, share, factor):
    assert one(spark, scoring.bulk_date(F.col("s")), s=share) == pytest.approx(factor)
    assert one(spark, scoring.bulk_date(F.col("s"), threshold=0.0), s=share) == 1.0


@pytest.mark.parametrize("days, factor", [(14, 0.5), (28, 0.25), (-3, 1.0), (0, 1.0)])
def test_recency_halves(spark, days, factor):
    at = datetime.datetime(2026, 6, 13) - datetime.timedelta(days=days)
    value = scoring.recency(F.lit("status"), F.to_timestamp(F.lit(str(at))), F.to_timestamp(F.lit("2026-06-13 00:00:00")))
    assert one(spark, value, x=1) == pytest.approx(factor)


@pytest.mark.parametrize(
    "value, expected",
    [("2025-01-05T13:00:00+02:00", 1736074800), ("2025-01-05 11:00:00", 1736074800), ("2025-01-05T11:00:00.000Z", 1736074800), ("2025-01-05", 1736035200), ("TBD", None), ("", None), (None, None), ("2025-13-05T00:00:00Z", None)],
)
def test_instant_forms(spark, value, expected):
    got = spark.createDataFrame([(value,)], "v string").select(F.unix_seconds(instant(F.col("v"))).alias("x")).first().x
    assert got == expected


def test_minimum_matches_and_pairs(spark):
    assert [text.min_matches(["a"] * n) for n in (2, 3)] == [1, 2]
    words = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(t).alias("t")) for p, t in ((0, "a"), (40, "b"), (91, "c"))])
    assert one(spark, text.near_pairs(words, [("a", "b"), ("b", "c")]), x=1) == 1


@pytest.mark.parametrize(
    "bullet, kind",
    [("[DECISION] keep it", "decision"), ("[MERGE] the architecture was changed", None), ("The user decided on this", "decision"), ("nothing here", None), ("Session started, user decided", None), ("found a bug and the root cause", "bug")],
)
def test_classifier_takes_first_rule_and_never_falls_through(spark, bullet, kind):
    got = spark.createDataFrame([(bullet,)], "b string").select(text.classify_bullet(F.col("b")).alias("c")).first().c
    assert (got.kind if got else None) == kind


def test_recall_gate(spark):
    rows = spark.createDataFrame([("ok!",), ("short",), ("what did we decide about this last week?",), ("merge it into the main branch",), ("write me a poem about it",), (None,)], "p string")
    got = [r.reason for r in rows.select(text.recall_gate(F.col("p")).alias("g")).select("g.reason").collect()]
    assert got == ["skip_pattern", "too_short", "matched:past_reference", "skip_pattern", "no_trigger", "too_short"]


def test_scrub_keeps_key_and_counts(spark):
    rows = spark.createDataFrame([("export API_KEY=abcdef now",), ("ghp_" + "a" * 24 + " and " + "f" * 40,), ("plain text",), (None,)], "t string")
    got = text.scrubbed(rows, "t").collect()
    assert got[0].t_scrubbed == "export API_KEY=[REDACTED_SECRET] now" and got[0].redactions == 1
    assert got[1].t_scrubbed == "[REDACTED_SECRET] and [REDACTED_SECRET]" and got[1].redactions == 2
    assert got[2].redactions == 0 and got[3].redactions == 0


def test_structural_noise_spares_tagged_facts(spark):
    rows = spark.createDataFrame([('{"a": 1}',), ("[DECISION] === x",), ("==== dump",), ("12\tline",), ("prose",), ("  ",)], "t string")
    assert [r[0] for r in rows.select(text.is_structural_noise(F.col("t"))).collect()] == [True, False, True, True, False, False]


def test_denied_spellings(spark):
    from factloom.functions import values as V

    rows = spark.createDataFrame([("/home/x/.ENV",), ("'./.env.local'",), ("agents/a/private/b/c",), ("src/main.py",), ("lib/tokenizer.json",)], "p string")
    assert [r[0] for r in rows.select(text.denied(F.col("p"), V.DENIED_PATHS)).collect()] == [True, True, True, False, True]


def test_cap_and_replace(spark):
    capped = one(spark, text.cap_content(F.col("c"), 5), c="abcd efgh")
    assert capped == "abcd [truncated from 9 chars]"
    assert one(spark, text.replace_once(F.col("c"), "b", "x"), c="abc") == "axc"
    assert one(spark, text.replace_once(F.col("c"), "b", "x"), c="abcb") is None
