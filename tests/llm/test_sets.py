import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from factloom.llm import batch_dedup, common, components, near_dup, similar_sets, term_scores, windows
from factloom.llm.similar_sets import word_sets


def variants(seed, n=70, vocabulary=60):
    """Contents of which many differ by small edits, insertions and order; some are blank, short, null or repeated."""
    rnd = random.Random(seed)
    pool = [f"w{i}" for i in range(vocabulary)]
    out = []
    for _ in range(n):
        words = rnd.sample(pool, rnd.randint(8, 16)) if not out or rnd.random() < 0.3 else re.findall(r"\w+", rnd.choice(out)) or rnd.sample(pool, 9)
        for _ in range(rnd.randint(0, 2)):
            words[rnd.randrange(len(words))] = rnd.choice(pool)
        if rnd.random() < 0.3:
            rnd.shuffle(words)
        out.append(" ".join(words))
    return [None, "", "  ", "too short", *out, out[0], out[1].upper() + "!"]


def make(spark, contents, seed=0):
    rnd = random.Random(seed)
    kinds = ["bug", " Bug ", "CONFIG", "config", None]
    rows = [(f"f{i:03}", rnd.choice(kinds), c, rnd.choice(["2026-01-01", "2026-01-02T10:00:00Z", "2026-01-09", "2026-03-01", "unknown", "", None])) for i, c in enumerate(contents)]
    rows.append((None, "bug", contents[-1], "2026-01-01"))
    rows.append(rows[6])
    return rows, spark.createDataFrame(rows, "id string, kind string, content string, source_date string")


def tokens(text):
    return frozenset(re.findall("[a-z0-9]+", (text or "").lower()))


def alike(a, b, t=0.75):
    return len(a & b) / len(a | b) >= t


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("longest", [1, 3, 4096])
def test_pairs_equal_brute_force(spark, seed, longest, monkeypatch):
    rows, df = make(spark, variants(seed), seed)
    facts = {r[0]: (r[1].strip().lower(), tokens(r[2])) for r in rows if r[0] and r[1] is not None}
    facts = {i: x for i, x in facts.items() if len(x[1]) >= 8}
    want = {(a, b) for a in facts for b in facts if a < b and facts[a][0] == facts[b][0] and alike(facts[a][1], facts[b][1])}
    assert want
    monkeypatch.setattr(near_dup.class_pairs, "__defaults__", (0.75, 8, longest))
    got = [(r.id_a, r.id_b) for r in near_dup.near_duplicate_pairs(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_long_lists_in_cells_lose_no_pair(spark):
    rows = [(f"d{i:03}", 0, " ".join([f"common{k}" for k in range(9)] + [f"own{i}"])) for i in range(60)]
    sets = word_sets(spark.createDataFrame(rows, "id string, part int, content string"), 8)
    got = near_dup.class_pairs(sets.classes, longest=7)
    assert got.count() == got.distinct().count() == 60 * 59 // 2


@pytest.mark.parametrize("run", [near_dup.near_duplicate_pairs, near_dup.near_duplicate_classes])
def test_no_table_of_records_passes_through_the_driver(spark, run, monkeypatch, tmp_path):
    plans = []
    make(spark, variants(1), 1)[1].write.parquet(str(tmp_path / "facts"))  # only files have a size that Spark goes by

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df

    # small tables: Spark would broadcast them, as it does larger ones of which it estimates too little
    cut = similar_sets.cut
    for module in (similar_sets, near_dup):
        monkeypatch.setattr(module, "cut", lambda df: cut(seen(df)))
    seen(run(spark.read.parquet(str(tmp_path / "facts"))))
    assert len(plans) == 5 and sum("SortMergeJoin" in p for p in plans) == 4
    assert not any("Broadcast" in p for p in plans)


@pytest.mark.parametrize("similarity", [0.6, 0.7, 0.75, 0.8, 0.9])
def test_similar_sets_share_windows(similarity):
    """The match threshold holds for random similar sets, and is 1 at least."""
    rnd = np.random.default_rng(3)
    q = windows.width(similarity, 8)
    met = 0
    for _ in range(4000):
        a = rnd.choice(1 << 40, rnd.integers(8, 60), replace=False)
        gone = rnd.integers(0, int(len(a) * (1 - similarity)) + 1)
        b = np.concatenate([a[gone:], rnd.choice(1 << 40, rnd.integers(0, int(len(a) * (1 - similarity)) + 2), replace=False)])
        a, b = np.unique(a), np.unique(b)
        if len(b) < 8 or len(np.intersect1d(a, b)) / len(np.union1d(a, b)) < similarity:
            continue
        met += 1
        grams = [{tuple(x[k : k + q]) for k in range(len(x) - q + 1)} for x in (a, b)]
        least = windows.threshold(len(a), len(b), similarity, q)
        assert len(grams[0] & grams[1]) >= least >= 1
        for x in (a, b):
            assert windows.least_threshold(np.array([len(x)]), similarity, q, 8)[0] <= least
    assert met > 1000


def test_window_keys_sort_as_suffixes():
    sig = pa.array([[5, 9, 11, 12], [1, 2], [3, 4, 7]], pa.list_(pa.int64()))
    row, key, sizes = windows.window_keys(sig, 3)
    assert row.tolist() == [0, 0, 2] and sizes.tolist() == [4, 2, 3]
    assert [key[i] for i in np.argsort(key)] == [key[2], key[0], key[1]]
    assert windows.window_keys(sig.slice(2, 1), 3)[1].tolist() == [key[2]]
    assert windows.window_keys(sig.slice(0, 0), 3)[1].tolist() == []


def test_classes_have_copies_and_links(spark):
    text = "one two three four five six seven eight"
    df = spark.createDataFrame([("b", "k", text), ("a", "k", text.upper()), ("c", "k", text + " nine"), ("d", "other", text)], "id string, kind string, content string")
    got = {r.id: (r.class_id, r.copies, r.links) for r in near_dup.near_duplicate_classes(df).collect()}
    assert got == {"a": ("a", 2, 1), "b": ("a", 2, 1), "c": ("c", 1, 1), "d": ("d", 1, 0)}


@pytest.mark.parametrize("loads, longest", [(1, 1), (3, 65_536)])
@pytest.mark.parametrize("seed", [4, 5])
def test_batches_equal_sequential_replay(spark, seed, loads, longest, monkeypatch):
    monkeypatch.setattr(batch_dedup.BatchIndex.__init__, "__defaults__", (0.75, 2, 8, longest))
    rows, df = make(spark, variants(seed), seed)
    accepted, want = [], set()
    dated = sorted({(m[0], r[0], tokens(r[2])) for r in rows if r[0] and (m := re.match(r"\d{4}-\d\d-\d\d", r[3] or "")) and len(tokens(r[2])) >= 8}, key=lambda x: x[:2])
    for _, i, w in dated:
        if any(alike(w, x) for x in accepted):
            want.add(i)
        else:
            accepted.append(w)
    got = [r.id for r in batch_dedup.rejected_facts(df, fan_out=2, loads=loads).collect()]
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("longest", [1, 65_536])
def test_a_batch_is_searched_in_what_it_searches_for(spark, longest, tmp_path, monkeypatch):
    """No stretch of a batch is sorted twice, and runs of one stretch may lie in many Arrow batches."""
    rows, df = make(spark, variants(7), 7)
    sorted_rows, search = spark.sparkContext.accumulator(0), batch_dedup._search

    def counted(*args):
        work = search(*args)

        def run(batches):
            def tap():
                for b in batches:
                    sorted_rows.add(b.num_rows)
                    yield b

            yield from work(tap())

        return run

    monkeypatch.setattr(batch_dedup, "_search", counted)
    facts = {r[0]: tokens(r[2]) for r in rows if r[0] and len(tokens(r[2])) >= 8}
    half = {i for i in facts if i < "f040"}
    index = batch_dedup.BatchIndex(spark, str(tmp_path / "index"), longest=longest)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = {r.id for r in index.add(df.filter(F.col("id") < "f040")).collect() if r.rejected}
        first = sorted_rows.value
        got |= {r.id for r in index.add(df.filter(F.col("id") >= "f040")).collect() if r.rejected}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    accepted = []
    for i in sorted(facts):
        if not any(alike(facts[i], facts[x]) for x in accepted):
            accepted.append(i)
    assert got == set(facts) - set(accepted)
    stretches = sum(len(w) - index.q + 1 for w in {facts[i] for i in half})
    assert first > 0 and (longest == 1 or first <= stretches)


def test_rejection_depends_on_acceptance(spark):
    # b is like a and rejected; c is like b only, and so accepted
    w = [f"w{i}" for i in range(20)]
    a, b, c = w[:16], w[2:18], w[4:20]
    rows = [("a", " ".join(a), "2026-01-01"), ("b", " ".join(b), "2026-01-02"), ("c", " ".join(c), "2026-01-03")]
    got = batch_dedup.rejected_facts(spark.createDataFrame(rows, "id string, content string, source_date string"))
    assert [r.id for r in got.collect()] == ["b"]


@pytest.mark.parametrize("most", [400, 1_000_000])
def test_long_chains_are_replayed(spark, most, monkeypatch):
    monkeypatch.setattr(batch_dedup, "REPLAYED_LINKS", most)
    # each is like the one before only: every second one is accepted, in a chain far longer than the plain rounds
    links = spark.createDataFrame([(i + 1, i) for i in range(350)] + [(1001 + i, 1000 + i) for i in range(1, 60, 2)], "a long, b long")
    assert {r.seq for r in batch_dedup.resolve(links).collect()} == set(range(1, 351, 2)) | set(range(1002, 1061, 2))


def test_large_groups_go_on_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(batch_dedup, "REPLAYED_LINKS", 3)
    links = spark.createDataFrame([(i + 1, i) for i in range(12)] + [(101, 100), (102, 101)], "a long, b long")
    assert {r.seq for r in batch_dedup.resolve(links).collect()} == set(range(1, 13, 2)) | {101}


def test_components_of_chains_stars_and_rings(spark):
    chain = [(f"c{i:03}", f"c{i + 1:03}") for i in range(200)]
    star = [("hub", f"leaf{i:03}") for i in range(100)]
    ring = [("r1", "r2"), ("r2", "r3"), ("r3", "r1"), ("r1", "r1"), ("r1", None), ("r2", "r1")]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(chain + star + ring, "u string, v string")).collect()}
    assert len(got) == 201 + 101 + 3
    assert {got[f"c{i:03}"] for i in range(201)} == {"c000"} and {got[k] for k in got if k[0] in "hl"} == {"hub"} and {got["r1"], got["r2"], got["r3"]} == {"r1"}
    assert components.connected_components(spark.createDataFrame([], "u string, v string")).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_components_equal_union_find(spark, seed):
    rnd = random.Random(seed)
    edges = [(f"n{rnd.randint(0, 60)}", f"n{rnd.randint(0, 60)}") for _ in range(40)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            root[max(find(a), find(b))] = min(find(a), find(b))
    want = {n: find(n) for e in edges if e[0] != e[1] for n in e}
    assert {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "u string, v string")).collect()} == want


@pytest.mark.parametrize("end", ["\n", "\t", "\r\n", " ", "\u00a0", " \n\t "])
def test_links_survive_white_space_at_the_ends(spark, end):
    df = spark.createDataFrame([("a", end + "B" + end), ("b", None), ("c" + end, "A" + end)], "id string, superseded_by string")
    assert sorted((r.id, r.group_id) for r in components.supersession_groups(df).collect()) == [("a", "a"), ("b", "a"), ("c", "a")]
    facts = spark.createDataFrame([("x", "bug" + end, "one two three four five six seven eight"), ("y", end + "Bug", "eight two three four five six seven one")], "id string, kind string, content string")
    assert near_dup.near_duplicate_pairs(facts).count() == 1


def test_links_need_known_ids(spark):
    df = spark.createDataFrame([("a", " B "), ("b", "gone"), ("c", "C"), ("d", None), ("d", "a"), ("e", " ")], "id string, superseded_by string").withColumn("u", F.lit("x"))
    assert sorted((r.id, r.group_id) for r in components.supersession_groups(df).collect()) == [("a", "a"), ("b", "a"), ("d", "a")]


def test_term_scores_and_ties(spark):
    import math

    rows = [("a", "rare common rare"), ("b", "common rare"), ("c", "common zeta"), ("d", "common alpha zeta alpha"), ("e", None), ("f", "!!"), ("a", "rare common rare"), (None, "rare"), ("g", "alpha")]
    df = spark.createDataFrame(rows, "id string, content string").withColumns({"term": F.lit(1), "n": F.lit(2)})
    s = {(r.id, r.term): r for r in term_scores.term_scores(df).collect()}
    assert s["a", "rare"].tf == 2 and s["a", "rare"].n == 2 and s["a", "rare"].cf == 3
    assert s["a", "rare"].score == pytest.approx(2 * math.log(5 / 2)) and s["a", "rare"].residual == pytest.approx(math.log(5 / 2) + math.log(1 - math.exp(-3 / 5)))
    top = {r.id: r.term for r in term_scores.top_terms(term_scores.term_scores(df)).collect()}
    assert top == {"a": "rare", "b": "rare", "c": "zeta", "d": "alpha", "g": "alpha"}
    assert term_scores.term_scores(df.limit(0)).count() == 0


def test_hot_keys_get_their_counts(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_SHARE", 4)
    rows = spark.createDataFrame([("hot", i) for i in range(50)] + [("cold", 1), ("warm", 2), ("none", 3)], "k string, v long")
    counts = spark.createDataFrame([("hot", 50), ("cold", 1), ("warm", 1)], "k string, n long")
    got = common.attach_counts(rows, counts, "k", ["n"], "n", 53)
    assert {(r.k, r.n): r.c for r in got.groupBy("k", "n").agg(F.count("*").alias("c")).collect()} == {("hot", 50): 50, ("cold", 1): 1, ("warm", 1): 1}


@pytest.mark.parametrize("run", [near_dup.near_duplicate_pairs, near_dup.near_duplicate_classes, batch_dedup.rejected_facts])
def test_empty_tables_very_long_texts_and_extra_columns(spark, run):
    schema = "id string, kind string, content string, source_date string"
    assert run(spark.createDataFrame([], schema)).count() == 0
    long = " ".join(f"x{i}" for i in range(5000))
    rows = spark.createDataFrame([("a", "k", long, "2026-01-01"), ("b", "k", long + " more", "2026-01-02")], schema)
    rows = rows.withColumns({c: F.lit("clash") for c in ("part", "cls", "sig", "size", "seq", "pair", "place", "block", "a", "b", "no", "c1", "c2", "key", "range")})
    assert run(rows).count() in (1, 2)


def test_index_grown_by_batches_equals_all_at_once(spark, tmp_path):
    rows, df = make(spark, variants(6), 6)
    want = {r.id for r in batch_dedup.rejected_facts(df).collect()}
    dated = batch_dedup.dated_facts(df)
    index = batch_dedup.BatchIndex(spark, str(tmp_path / "index"), fan_out=2)
    got, seen = set(), 0
    for (number,) in sorted(tuple(r) for r in dated.select("batch").distinct().collect()):
        out = index.add(dated.filter(F.col("batch") == number)).collect()
        got |= {r.id for r in out if r.rejected}
        seen += len(out)
    assert got == want and seen == len({r[0] for r in rows if r[0] and re.match(r"\d{4}-", r[3] or "") and len(tokens(r[2])) >= 8})
    assert max(t for t, _, _ in index.segments()) >= 1
    covered = [n for _, first, last in index.segments() for n in range(first, last + 1)]
    assert covered == list(range(len(covered)))
    again = index.add(dated.filter(F.col("batch") == number)).collect()
    assert all(r.rejected for r in again)
    assert index.add(dated.limit(0)).count() == 0
