import itertools
import random
from collections import Counter

from pyspark.sql import functions as F

from evalmill.llm import splits, topn

SCHEMA = "line_no long, split string, numbers array<long>, target long, allowed_ops array<string>, metadata struct<source:string>, token string, n int"


def brute(rows):
    out = set()
    ok = [r for r in rows if r[1] is not None and r[2] and r[3] is not None and r[4] is not None]
    for a, b in itertools.combinations(ok, 2):
        ta, tb = (r[1].strip().lower() == "train" for r in (a, b))
        if ta == tb or a[3] != b[3]:
            continue
        ca, cb = Counter(a[2]), Counter(b[2])
        same = ca == cb
        near = len(a[2]) == len(b[2]) and set(a[4]) == set(b[4]) and sum((ca & cb).values()) == len(a[2]) - 1
        if same or near:
            out.add((min(a[0], b[0]), max(a[0], b[0])))
    return out


def test_overlap_against_all_pairs(spark):
    rng = random.Random(5)
    rows = []
    for i in range(500):
        n = rng.choice([1, 2, 3, 3, 4])
        rows.append((i, rng.choice([" Train", "train", "validation", "TEST ", None, " "]), rng.choice([[rng.randint(1, 5) for _ in range(n)]] * 9 + [None, []]), rng.choice([1, 2, None]), rng.choice([["+"], ["+", "+"], ["+", "-"], [], None]), (rng.choice(["s", None]),), "x", 3))
    df = spark.createDataFrame(rows, SCHEMA)
    got = [tuple(r) for r in splits.split_overlap(df).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows) and len(got) > 200


def test_hot_content_and_chunks(spark, monkeypatch):
    monkeypatch.setattr(splits, "CHUNK", 16)
    rows = [(i, "train" if i % 2 else "test", [1, 2], 3, ["+"], None, "x", 0) for i in range(120)]
    got = splits.split_overlap(spark.createDataFrame(rows, SCHEMA))
    assert got.count() == 60 * 60 == got.distinct().count()


def test_empty_and_report(spark):
    assert splits.split_overlap(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(0, "train", [1, 2], 3, ["+"], ("a",), "x", 0), (1, "test", [2, 1], 3, ["-"], None, "x", 0), (2, "test", [2, 5], 3, ["+"], ("b",), "x", 0), (3, "test", [8, 9], 3, ["+"], ("b",), "x", 0)]
    got = {tuple(r) for r in splits.split_overlap_report(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {("test", None, 1, 1, 0), ("test", "b", 1, 0, 1)}


def test_heaps_keep_what_a_window_keeps(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None, "hot", "hot", "hot"]), rng.choice([1.0, 2.0, float("nan"), None]), rng.choice([0, 1, None]), i, "x") for i in range(4000)]
    df = spark.createDataFrame(rows, "id string, s double, candidate_index int, line_no long, g string").repartition(7)
    for n in (1, 3, 10_000):
        got = sorted(map(str, topn.top_n(df, "id", F.col("s"), ["candidate_index", "line_no"], n).collect()))
        assert got == sorted(map(str, topn.top_n_by_window(df, "id", F.col("s"), ["candidate_index", "line_no"], n).collect()))
    assert topn.top_n(df.limit(0), "id", F.col("s"), ["line_no"]).count() == 0
    plan = topn.top_n(df, "id", F.col("s"), ["line_no"])._jdf.queryExecution().executedPlan().toString()
    assert "partial_collect_top_k" in plan and "Window" not in plan


def test_ties_may_be_texts(spark):
    df = spark.createDataFrame([("a", 1.0, t) for t in ("b", "c", "a", None)] + [("a", 2.0, "z"), (None, None, "x")], "id string, s double, name string")
    assert sorted(map(tuple, topn.top_n(df, "id", F.col("s"), ["name"], 3).collect()), key=str) == [("a", "a"), ("a", "b"), ("a", "z"), (None, "x")]


def test_score_counts_missing_as_zero(spark):
    fields = ", ".join(f"{f}:double" for f, _ in topn.WEIGHTS)
    df = spark.createDataFrame([(0, (1.0, 1.0, 1.0, 1.0, 1.0, 1.0)), (1, (None, float("nan"), 1.0, None, None, None)), (2, None)], f"line_no long, metrics struct<{fields}>")
    assert [r[0] for r in df.select(topn.practical_score()).collect()] == [6.5, 1.5, 0.0]
