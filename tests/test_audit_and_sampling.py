import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from evalmill.functions import keys as K
from evalmill.functions.verifier import judge
from evalmill.operators import audit, generate, sampling

SCHEMA = "line_no long, id string, split string, difficulty string, numbers array<long>, target long, allowed_ops array<string>, solution string, `key` string"


def tasks(spark, rows):
    return spark.createDataFrame([(i, *r, "clash") for i, r in enumerate(rows)], SCHEMA)


ROWS = [
    ("a", "Train", "easy", [1, 2], 3, ["+"], "1+2"),
    ("a", "train ", "easy", [2, 1], 3, ["+", "+"], "2+1"),
    ("b", "test", "easy", [1, 2], 3, ["+"], "1+2"),
    ("c", "test", "hard", [4], 4, ["%"], "4"),
    ("d", None, "hard", None, 4, ["+"], None),
    ("e", "test", None, [], 4, [], ""),
]


def test_audits(spark):
    df = tasks(spark, ROWS)
    got = {r.split: tuple(r)[1:] for r in audit.split_audit(df).collect()}
    assert got == {"train": (2, 1, 1, 0, 1), "test": (3, 3, 0, 2, 0), None: (1, 1, 0, 1, 0)}
    dup = {r.split: tuple(r)[1:] for r in audit.duplicate_groups(df.withColumn("split", audit.split_name()), K.semantic_key(), ["split"]).collect()}
    assert dup == {"train": (1, 2, 1)}
    m = [tuple(r) for r in audit.overlap_matrix(df, audit.split_name(), K.semantic_key()).collect()]
    assert m == [("test", "train", 1, 1, 2, 2, 1 / 3)]
    name = audit.split_name()
    assert tuple(audit.overlap_stats(df.where(name == "train"), df.where(name == "test")).first()) == (1, 2, 1, 1, 1, 2, 1.0, 1 / 3)
    assert audit.overlap_matrix(df.limit(0), name, K.semantic_key()).count() == 0


def test_frozen_quota_drift_guard(spark):
    df = tasks(spark, ROWS)
    ids = spark.createDataFrame([("a",), ("a",), ("b",), ("zz",)], "id string")
    assert tuple(audit.frozen_ids(ids, df, audit.split_name() == "test").first()) == (4, 3, 1, 1, 1)
    quotas = spark.createDataFrame([("train", 2), ("validation", 5), ("test", 3)], "split string, quota int")
    assert [tuple(r) for r in audit.quota_check(df.where("split is not null"), [audit.split_name()], quotas, ["split"]).collect()] == [("validation", 0, 5)]
    a = spark.createDataFrame([(1, "x", None), (2, "y", 1), (3, "z", 1)], "k int, v string, w int")
    b = spark.createDataFrame([(1, "x", None), (2, "n", 2), (4, "q", 1)], "k int, v string, w int")
    assert {r.field: r.differing for r in audit.drift(a, b, "k", ["v", "w"]).collect()} == {"(missing)": 1, "(extra)": 1, "v": 1, "w": 1}
    g = {r.key: r.shared for r in audit.guard_intersections(df.where(audit.split_name() == "train"), df.where(audit.split_name() == "test"), {"id": F.col("id"), "semantic": K.semantic_key(), "loose": K.loose_key()}).collect()}
    assert g == {"id": 0, "semantic": 1, "loose": 1}


def test_containment(spark):
    long = spark.createDataFrame([(1, "So the quick brown fox jumps over it."), (2, "nothing of the kind here at all"), (3, None)], "doc int, t string")
    short = spark.createDataFrame([(7, "ick brown fox jumps over it"), (8, "two words"), (9, None)], "item int, s string")
    assert [tuple(r) for r in audit.containment(long, short, "doc", "t", "item", "s").collect()] == [(1, 7)]


def test_keep_first(spark):
    df = spark.createDataFrame([(3, "a"), (1, "b"), (2, "a"), (4, None), (5, None)], "n int, k string")
    assert sorted(r.n for r in audit.keep_first(df, F.col("k"), "n").collect()) == [1, 2, 4, 5]


def test_samples_and_splits(spark):
    df = spark.createDataFrame([(i, "s" if i % 3 else None) for i in range(90)], "id long, g string").repartition(6)
    a = sampling.stratified_sample(df, "g", "id", 10, seed=3)
    b = sampling.stratified_sample(df.repartition(2), "g", "id", 10, seed=3)
    assert sorted(r.id for r in a.collect()) == sorted(r.id for r in b.collect()) and a.count() == 20
    assert sampling.stratified_sample(df, "g", "id", {"s": 4}).count() == 4
    assert sampling.complement(df, a, "id").count() == 70
    parts = sampling.split_by_quota(df, "g", K.stable_order(1, "d", F.col("id")), [("x", 20), ("y", 5)])
    assert Counter((r.g, r.part) for r in parts.collect()) == {(None, "x"): 20, (None, "y"): 5, (None, None): 5, ("s", "x"): 20, ("s", "y"): 5, ("s", None): 35}
    plan = sampling.stratified_sample(df, "g", "id", 10)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    w = spark.createDataFrame([(i, 100.0 if i < 20 else 1.0) for i in range(200)], "id int, w double")
    first = [r.id for r in sampling.weighted_order(w, "id", "w").orderBy("draw").limit(20).collect()]
    assert sum(i < 20 for i in first) >= 10
    assert {tuple(r) for r in sampling.set_difference(df.where("id < 5"), df.where("id between 3 and 6"), "id").collect()} == {("left", 0), ("left", 1), ("left", 2), ("right", 5), ("right", 6)}
    assert [tuple(r) for r in sampling.top_by_count(df, "g", 1).collect()] == [("s", 60)]


def test_generated_tasks(spark):
    pools = [(generate.proposals(spark, "easy", 200, 1), 120), (generate.proposals(spark, "easy", 200, 2), 30), (generate.proposals(spark, "ood_division", 30, 1), 20)]
    rows = generate.accept(pools).collect()
    keys = {(tuple(sorted(r.numbers)), r.target) for r in rows}
    assert len(keys) == len(rows) and all(judge(r.solution, r.numbers, r.target, r.allowed_ops)["correct"] for r in rows)
    per = defaultdict(list)
    for r in rows:
        per[r.pool].append(r.position)
        assert len(r.numbers) == generate.TIERS[r.tier][0]
    assert {k: sorted(v) == list(range(len(v))) for k, v in per.items()} == {0: True, 1: True, 2: True}
    # sequentially the same tasks are accepted
    seen, expected = set(), []
    for k, (tier, seed, count, target) in enumerate((("easy", 1, 200, 120), ("easy", 2, 200, 30))):
        new = []
        for i in range(count):
            n, t, _ = generate.propose(tier, seed, i)
            if (tuple(sorted(n)), t) not in seen:
                seen.add((tuple(sorted(n)), t))
                new.append((k, i))
        expected += new[:target]
    assert sorted((r.pool, r.proposal_index) for r in rows if r.pool < 2) == sorted(expected)
    made = {r.pool: (r.proposals, r.new) for r in generate.rejections(pools).collect()}
    assert made[0][0] == 200 and made[0][1] <= 200
    assert generate.propose("hard", 5, 7) == generate.propose("hard", 5, 7) and random.random() is not None


def test_digests(spark):
    df = spark.createDataFrame([("b",), ("a",)], "v string")
    import hashlib

    assert K.set_digest(df, "v").first().digest == hashlib.sha256(b"a\nb\n").hexdigest()
    assert df.select(K.row_digest(["v"])).first()[0] == hashlib.sha256(b'{"v":"b"}').hexdigest()
    assert df.select(K.stable_order(7, "d", F.col("v"))).first()[0] == hashlib.sha256(b"7\x00d\x00b").hexdigest()


def test_identities_tiers_and_views(spark):
    df = tasks(spark, [("a", "test_ood_long", "ood_long", [1, 2], 3, ["+"], "s"), ("a", "test_ood_long", "easy", [1, 3], 4, ["+"], "s"), ("b", "train", "easy", [3, 1], 4, ["+"], "s"), ("c", "Train", "ood_long", None, 4, ["+"], "s"), (None, None, None, [1], 1, ["+"], "s")])
    got = {(r.kind, r.others) for r in audit.identity_conflicts(df).collect()}
    assert got == {("id", 2), ("task", 2)}
    assert [r[0] for r in df.orderBy("line_no").select(audit.tier_fits_split()).collect()] == [True, False, True, False, None]
    n = spark.range(10)
    assert tuple(audit.view_checks(n, n.where("id < 4"), n.where("id between 3 and 8").union(spark.range(20, 22)), "id").first()) == (1, 1, 2)
