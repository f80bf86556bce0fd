import hashlib
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalmill.operators import inference as I


def test_mcnemar(spark):
    df = spark.createDataFrame([(4, 0), (2, 1), (0, 0), (30, 12), (500, 480)], "b long, c long")
    rows = df.select(I.mcnemar_p(F.col("b"), F.col("c")).alias("p"), I.mcnemar_large("b", "c").alias("q")).collect()
    assert [round(r.p, 12) for r in rows[:3]] == [0.125, 1.0, 1.0] and all(abs(r.p - r.q) < 1e-9 for r in rows)


def test_two_proportions(spark):
    df = spark.createDataFrame([(10, 100, 30, 100), (0, 0, 1, 2), (5, 5, 7, 7)], "a long, n long, b long, m long")
    p = [r[0] for r in df.select(I.two_proportion_p(F.col("a"), F.col("n"), F.col("b"), F.col("m"))).collect()]
    assert abs(p[0] - 0.000407) < 1e-5 and p[1:] == [1.0, 1.0]


def test_holm(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.20), ("d", 0.50)], "name string, p double")
    got = {r.name: (round(r.adjusted, 6), r.reject) for r in I.holm(df).collect()}
    assert got == {"a": (0.04, True), "b": (0.12, False), "c": (0.4, False), "d": (0.5, False)}
    with pytest.raises(Exception, match="p value"):
        I.holm(spark.createDataFrame([("a", 1.5)], "name string, p double")).collect()


def test_sign_flips(spark):
    for effects in ([1.0] * 4, [0.5, -0.2, 0.0, 0.7, 0.1], []):
        df = spark.createDataFrame([(str(i), float(e)) for i, e in enumerate(effects)], "key string, effect double")
        r = I.sign_flips(df, "key", "effect").first()
        x = [e for e in effects if e]
        p = np.mean([abs(np.dot(s, x)) >= abs(sum(x)) - 1e-12 for s in itertools.product((1, -1), repeat=len(x))]) if x else 1.0
        assert (r.nonzero, r.assignments) == (len(x), 2 ** len(x)) and abs(r.p - p) < 1e-12
    with_groups = spark.createDataFrame([("a", f"t{i}", 1.0) for i in range(4)] + [("b", f"t{i:02}", 0.1 + i / 100) for i in range(30)] + [(None, "t", 0.0)], "g string, key string, effect double")
    got = {r.g: (r.nonzero, r.assignments, r.p) for r in I.sign_flips(with_groups, "key", "effect", 300, by=["g"]).collect()}
    assert got == {"a": (4, 16, 0.125), "b": (30, 300, 1 / 301), None: (0, 1, 1.0)}


def weight(*parts):
    u = int(hashlib.md5(":".join(map(str, (17, *parts))).encode()).hexdigest()[:8], 16) / 2**32
    return next((k for k, p in enumerate(I.POISSON) if u < p), len(I.POISSON))


def test_clustered(spark):
    same = spark.createDataFrame([(f"t{i}", i / 10, i / 10) for i in range(10)], "id string, a double, b double")
    r = I.clustered_difference(same, "id", "a", "b", draws=200).first()
    assert (r.estimate, r.low, r.high, r.p, r.nonzero) == (0, 0, 0, 1.0, 0)
    four = spark.createDataFrame([(f"t{i}", 1.0, 0.0) for i in range(4)], "id string, a double, b double")
    r = I.clustered_difference(four, "id", "a", "b", draws=200).first()
    assert r.p == 0.125 and r.assignments == 16
    many = spark.createDataFrame([(f"t{i:02}", 0.5 + i / 100, 0.4) for i in range(30)], "id string, a double, b double")
    r = I.clustered_difference(many.repartition(5), "id", "a", "b", draws=300).first()
    means = [sum(w * (0.1 + i / 100) for i, w in enumerate(ws)) / sum(ws) for d in range(300) for ws in [[weight(d, f"t{i:02}") for i in range(30)]]]
    assert r.p == 1 / 301 and [r.low, r.high] == pytest.approx(list(np.quantile(means, [0.025, 0.975]))) and r.low < r.estimate < r.high
    with pytest.raises(Exception, match="missing or infinite"):
        I.clustered_difference(many.withColumn("a", F.lit(None).cast("double")), "id", "a", "b", draws=5).collect()
    assert I.clustered_difference(many.where("false").withColumn("g", F.lit(1)), "id", "a", "b", draws=5, by=["g"]).count() == 0


def test_bootstrap_spreads_as_it_should(spark):
    df = spark.createDataFrame([(f"t{i}", float(i)) for i in range(400)], "id string, v double")
    means = np.array([r.v / r.weight for r in I.task_bootstrap(df, "id", ["v"], 300).collect()])
    assert len(means) == 300 and abs(means.mean() - 199.5) < 1.5 and abs(means.std() / (np.arange(400).std() / 20) - 1) < 0.15


def test_ratios(spark):
    df = spark.createDataFrame([("x", 1, 1, 0, 1), ("y", 0, 1, 0, 1)] + [(f"z{i}", 1, 2, 1, 2) for i in range(8)], "id string, an int, ad int, bn int, bd int")
    r = I.clustered_ratio_difference(df, "id", ("an", "ad"), ("bn", "bd"), draws=200).first()
    assert r.reason is None and r.estimate == pytest.approx(9 / 18 - 8 / 18) and r.dropped == 0 and r.low <= r.estimate <= r.high
    zero = df.withColumn("ad", F.lit(0)).withColumn("an", F.lit(0))
    r = I.clustered_ratio_difference(zero, "id", ("an", "ad"), ("bn", "bd"), draws=50).first()
    assert r.reason == "an observed denominator is 0" and r.low is None
    thin = df.where("id in ('x', 'y')").withColumn("ad", F.when(F.col("id") == "x", 1).otherwise(0))
    assert I.clustered_ratio_difference(thin, "id", ("an", "ad"), ("bn", "bd"), draws=200).first().reason == "too many draws have an empty denominator"
    with pytest.raises(Exception, match="numerator"):
        I.clustered_ratio_difference(df.withColumn("an", F.lit(5)), "id", ("an", "ad"), ("bn", "bd"), draws=5).collect()


def test_product_bootstrap(spark):
    rows = [(f"t{i}", s, float(i % 3) + s) for i in range(12) for s in range(3)]
    df = spark.createDataFrame(rows, "id string, seed int, e double")
    r = I.product_bootstrap(df, "id", "seed", "e", draws=100).first()
    means = []
    for d in range(100):
        w = [weight(d, t) * weight("run", d, s) for t, s, _ in rows]
        if sum(w):
            means.append(np.average([e for _, _, e in rows], weights=w))
    assert (r.tasks, r.runs, r.estimate) == (12, 3, pytest.approx(2.0)) and [r.low, r.high] == pytest.approx(list(np.quantile(means, [0.025, 0.975])))
    for bad in (df.where("seed < 2"), df.where("id <> 't1' or seed <> 0")):
        with pytest.raises(Exception, match="each task in every run"):
            I.product_bootstrap(bad, "id", "seed", "e", draws=5).collect()


def test_signature(spark):
    df = spark.createDataFrame([(1, "x", None), (1, "y", None)], "a int, b string, c string")
    assert [(r.column, r["values"]) for r in I.same_signature(df, ["a", "b", "c"]).collect()] == [("b", ['{"v":"x"}', '{"v":"y"}'])]
