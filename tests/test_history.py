import datetime

from pyspark.sql import functions as F

from factloom.operators import history

SNAP = "fact_id string, snapshot_at timestamp, loaded_at timestamp, status string, valid_at string, invalid_at string, superseded_at string, confidence double"


def day(n, h=0):
    return datetime.datetime(2025, 1, n, h)


def run(spark, rows):
    df = spark.createDataFrame(rows, SNAP)
    return sorted((r.id, r.from_ts[8:10], r.to_ts[8:10], r.status) for r in history.fact_versions(df).collect())


def row(i, at, status="current", valid=None, loaded=None, invalid=None):
    return (i, at, loaded or at, status, valid, invalid, None, 0.9)


def test_versions_coalesce_and_purge(spark):
    got = run(spark, [
        row("A ", day(1)), row("a", day(2), " Current "), row("a", day(3), None), row("a", day(4), "superseded"), row("a", day(5), "purged"), row("a", day(6), "superseded"),
    ])
    assert got == [("a", "01", "04", "current"), ("a", "04", "05", "superseded"), ("a", "06", "", "superseded")]


def test_last_loaded_row_holds_and_late_rows_find_their_place(spark):
    got = run(spark, [row("a", day(3)), row("a", day(1), "proposed", loaded=day(9)), row("a", day(1), "current", loaded=day(8)), row("a", day(3), loaded=day(10)), row("a", None, "purged")])
    assert got == [("a", "01", "03", "proposed"), ("a", "03", "", "current")]


def test_times_compare_as_instants(spark):
    got = run(spark, [row("a", day(1), valid="2025-01-05T13:00:00+02:00"), row("a", day(2), valid="2025-01-05 11:00:00"), row("a", day(3), valid="soon"), row("a", day(4), valid=None), row("a", day(5), valid="", invalid="2025-02-30T00:00:00Z")])
    assert got == [("a", "01", "03", "current"), ("a", "03", "", "current")]


def test_nulls_ties_and_empty_tables(spark):
    assert run(spark, []) == []
    tied = [row("a", day(1), "proposed", loaded=day(2)), row("a", day(1), "current", loaded=day(2)), row(None, day(1)), row("a", day(1), "zzz", loaded=None)]
    assert run(spark, tied) == run(spark, tied[::-1])
    only_purged = run(spark, [row("a", day(1), "PURGED")])
    assert only_purged == []


def test_versions_equal_plain_replay(spark):
    import random

    rnd = random.Random(5)
    rows = [row(rnd.choice("abc"), day(rnd.randint(1, 12)), rnd.choice(["current", "superseded", "purged", None]), rnd.choice([None, "2025-01-01", "2025-01-02"]), loaded=day(20, rnd.randint(0, 23))) for _ in range(80)]
    held = {}
    for r in rows:
        k = (r[0], r[1])
        state = ((r[3] or "current"), r[4])
        if k not in held or (r[2], state[0], state[1] or "") > held[k][0]:
            held[k] = ((r[2], state[0], state[1] or ""), state)
    want = []
    for i in "abc":
        open_row = None
        for (_, at), (_, state) in sorted((k, v) for k, v in held.items() if k[0] == i):
            state = None if state[0] == "purged" else state
            if open_row and open_row[1] != state:
                want.append((i, f"{open_row[0].day:02}", f"{at.day:02}", open_row[1][0]))
                open_row = None
            if state and not open_row:
                open_row = (at, state)
        if open_row:
            want.append((i, f"{open_row[0].day:02}", "", open_row[1][0]))
    assert run(spark, rows) == sorted(want)


def test_change_log_has_one_event_per_change(spark):
    df = spark.createDataFrame([("a", day(1), "x", "1"), ("a", day(2), "x", "2"), ("a", day(3), None, "2")], "id string, at timestamp, p string, q string")
    log = history.change_log(df, "id", "at", ["p", "q"])
    assert sorted((r.attribute, r.at.day) for r in log.collect()) == [("p", 1), ("p", 3), ("q", 1), ("q", 2)]
    assert history.versions(log, "id", "at", ["p", "q"]).filter(F.col("to").isNull()).count() == 1
