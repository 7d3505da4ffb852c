import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import neighbours


def frame(spark, rows):
    return spark.createDataFrame(rows, "fact_id string, model_id string, vector array<float>")


def brute(ids, x, k=5):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    np.fill_diagonal(s, -2)
    return {(ids[i], ids[j]) for i in range(len(ids)) for j in np.argsort(-s[i], kind="stable")[:k]}


def test_hilbert_keys_are_a_curve():
    side = 8
    cells = np.array([(x, y, z) for x in range(side) for y in range(side) for z in range(side)])
    keys = neighbours.hilbert_keys(cells, 3)
    assert sorted(keys) == list(range(side**3))
    path = cells[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_fine_keys_refine_the_curve():
    cells = np.random.default_rng(5).integers(0, 1 << 10, (500, 6))
    coarse, fine = neighbours.hilbert_keys(cells, 10, 5)
    whole = [int(c) << 30 | int(f) for c, f in zip(coarse, fine)]
    assert (coarse == neighbours.hilbert_keys(cells >> 5, 5)).all() and (np.argsort(whole) == np.argsort(neighbours.hilbert_keys(cells, 10))).all()


def test_recall_within_one_coarse_cell(spark):
    rng = np.random.default_rng(4)
    groups = rng.standard_normal(64) / 8 + 0.0005 * rng.standard_normal((400, 64))
    x = np.repeat(groups, 6, axis=0) + 0.0001 * rng.standard_normal((2400, 64))
    ids = [f"f{i:05}" for i in range(len(x))]
    got = {(r.id, r.near_id) for r in neighbours.nearest(frame(spark, [(i, "m", v.tolist()) for i, v in zip(ids, x)]), "fact_id", 64, block=64).collect()}
    assert len(got & brute(ids, x)) >= 0.9 * len(brute(ids, x))


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((300, 64))
    x = np.repeat(centres, 8, axis=0) + 0.25 * rng.standard_normal((2400, 64))
    ids = [f"f{i:05}" for i in range(len(x))]
    got = neighbours.fact_neighbours(frame(spark, [(i, "static-64", v.tolist()) for i, v in zip(ids, x)])).collect()
    want = brute(ids, x)
    found = {(r.id, r.near_id) for r in got}
    assert len(got) == len(found) == 5 * len(ids) and len(found & want) >= 0.97 * len(want)
    assert {r.rank for r in got} == {1, 2, 3, 4, 5}


def test_copies_make_no_pairs_of_all(spark):
    rng = np.random.default_rng(2)
    one = rng.standard_normal(64)
    rows = [(f"c{i:03}", "static-64", (one * (1 + i % 3)).tolist()) for i in range(80)] + [(f"x{i}", "static-64", v.tolist()) for i, v in enumerate(rng.standard_normal((20, 64)))]
    got = neighbours.fact_neighbours(frame(spark, rows))
    per = {r.id: sorted(x.near_id for x in got.filter(F.col("id") == r.id).collect()) for r in got.select("id").distinct().filter("id in ('c000', 'c003', 'c079')").collect()}
    assert per == {"c000": ["c001", "c002", "c003", "c004", "c005"], "c003": ["c000", "c001", "c002", "c004", "c005"], "c079": ["c000", "c001", "c002", "c003", "c004"]}
    assert got.groupBy("id").count().filter("count > 5").count() == 0


def test_unusable_vectors_and_repeats(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal(64).tolist()
    near = (np.array(base) + 0.01).tolist()
    bad = [base[:-1] + [float("nan")], base[:-1] + [float("inf")], [0.0] * 64, base[:32], [], None, base[:-1] + [None]]
    rows = [("a", "static-64", base), ("a", "static-64", base), ("b", "static-64", near), ("o", "onnx-64", base), (None, "static-64", base)] + [(f"bad{i}", "static-64", v) for i, v in enumerate(bad)]
    df = frame(spark, rows).withColumns({"cls": F.lit("clash"), "payload": F.lit(1), "id": F.lit("clash")})
    assert [(r.id_a, r.id_b) for r in neighbours.similar_fact_pairs(df).collect()] == [("a", "b")]
    assert neighbours.similar_fact_pairs(df.limit(0)).count() == 0


@pytest.mark.parametrize("block", [16, 64])
def test_windows_see_both_sides(spark, block):
    x = np.array([[np.cos(t), np.sin(t), 0.1] for t in np.linspace(0, 3, 200)])
    ids = [f"{i:03}" for i in range(200)]
    df = frame(spark, [(i, "m", v.tolist()) for i, v in zip(ids, x)])
    got = {(r.id, r.near_id) for r in neighbours.nearest(df, "fact_id", 3, k=2, block=block).collect()}
    assert len(got & brute(ids, x, 2)) >= 0.97 * 400
