import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalmill.functions import measures as M
from evalmill.operators import control as C
from evalmill.streaming import controllers as S


def test_projection_keeps_bounds_and_budget():
    rng = np.random.default_rng(1)
    keys = list(C.FLOORS)
    for _ in range(200):
        low = dict(zip(keys, rng.uniform(0, 0.2, 6), strict=True))
        high = {k: v + rng.uniform(0, 0.3) for k, v in low.items()}
        w = C.project(dict(zip(keys, rng.uniform(-0.2, 0.6, 6), strict=True)), low, high, 1.2)
        goal = max(sum(low.values()), min(1.2, sum(high.values())))
        assert all(low[k] - 1e-9 <= w[k] <= high[k] + 1e-9 for k in keys) and abs(sum(w.values()) - goal) < 1e-8


def good(level):
    return dict.fromkeys(M.AUXILIARY, level)


def test_strategies():
    for strategy in C.STRATEGIES:
        c = C.WeightController(C.WeightSettings(strategy=strategy, delay=2))
        records = [c.update(0.1, good(0.3)) for _ in range(12)]
        assert [r["step"] for r in records] == list(range(1, 13)) and all(0 <= w <= 0.5 for r in records for w in r["weights"].values())
        if strategy.startswith(("adaptive_stable", "adaptive_phased")):
            assert records[1]["waiting"] and not records[2]["waiting"] and abs(records[-1]["weight_sum"] - 1.2) < 1e-6
        if strategy == "static":
            assert records[-1]["l1"] == 0
    assert abs(C.WeightController(C.WeightSettings()).update(1.0, {})["ema_primary"] - 0.1) < 1e-12
    with pytest.raises(ValueError, match="strategy"):
        C.WeightSettings(strategy="x")
    with pytest.raises(ValueError, match="unknown keys"):
        C.WeightSettings(starts={"x": 1.0})


def test_phases_have_hysteresis():
    c = C.WeightController(C.WeightSettings(strategy="adaptive_phased", delay=0, dwell=3, beta=0.0))
    phases = [c.update(0.0, good(x))["phase"] for x in [0.9] * 2 + [0.1] + [0.9] * 3 + [0.78] * 5 + [0.1] * 3]
    assert phases == ["A"] * 5 + ["B"] * 8 + ["A"]


def test_replay_is_the_fold_and_ema(spark):
    rows = [(r, b, i, 0.1 * i + 0.01 * b) for r in ("x", "y") for b in range(6) for i in range(4)]
    schema = "run string, b long, line_no long, metrics struct<" + ",".join(f"{k}:double" for k in ("correct", *M.AUXILIARY)) + ">"
    df = spark.createDataFrame([(r, b, i, (v,) * 7) for r, b, i, v in rows], schema).repartition(5)
    batches = C.batch_means(df, ["run"], F.col("b"))
    settings = C.WeightSettings(strategy="adaptive_stable", delay=2)
    got = {(r.run, r.batch): r for r in C.replay_weights(batches, "run", settings).collect()}
    c = C.WeightController(settings)
    for b in range(6):
        mean = sum(0.1 * i + 0.01 * b for i in range(4)) / 4
        r = c.update(mean, good(mean))
        assert abs(got["x", b].ema_primary - r["ema_primary"]) < 1e-12 and abs(got["y", b].weight_sum - r["weight_sum"]) < 1e-9
    e = {r.run: r.ema for r in C.ema(batches, "run", "batch", "primary").collect()}
    assert abs(e["x"] - got["x", 5].ema_primary) < 1e-12


def test_stream_gives_the_replay(spark, tmp_path):
    settings = C.WeightSettings(strategy="adaptive_phased", delay=1)
    rows = [{"run": r, "batch": b, "primary": 0.05 * b, "aux": good(0.1 * b)} for r in "xy" for b in range(8)]
    order = [5, 0, 9, 1, 12, 3, 2, 15, 4, 7, 6, 8, 13, 10, 14, 11]
    (tmp_path / "in").mkdir()
    for k, i in enumerate(order):  # one file for each batch, out of order, some twice
        (tmp_path / "in" / f"{k:02}.json").write_text(json.dumps(rows[i]) + "\n" + (json.dumps(rows[i]) + "\n") * (k % 2))
    schema = "run string, batch long, primary double, aux map<string,double>"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 3).json(str(tmp_path / "in"))
    q = S.stream_weights(stream, "run", settings).writeStream.format("memory").queryName("records").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    streamed = sorted((r.run, r.batch, r.phase, round(r.weight_sum, 9), round(r.l1, 9)) for r in spark.table("records").collect())
    replayed = C.replay_weights(spark.createDataFrame(rows, schema), "run", settings)
    assert streamed == sorted((r.run, r.batch, r.phase, round(r.weight_sum, 9), round(r.l1, 9)) for r in replayed.collect()) and len(streamed) == 16


def test_windows_and_log_of_a_stream(spark, tmp_path):
    src = spark.sql("select timestamp'2026-01-01 00:00:00' + make_interval(0,0,0,0,0,cast(id as int)*10) as logged_at, 'b' as bank, named_struct('exact_correct', double(id % 2), 'valid_expression', 1d) as metrics from range(12)")
    src.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    q = S.stream_bank_rates(stream).writeStream.format("memory").queryName("rates").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert sorted((r["rows"], r.exact, r.legal) for r in spark.table("rates").collect()) == [(3, 1, 3), (3, 1, 3), (3, 2, 3), (3, 2, 3)]
    q = S.append_log(spark.readStream.schema(src.schema).parquet(str(tmp_path / "in")), str(tmp_path / "log"), str(tmp_path / "c2"))
    assert q.awaitTermination(120) and spark.read.json(str(tmp_path / "log")).count() == 12


def test_tiers():
    s = C.TierSettings(mode="adaptive", delay=0)
    seen = {}
    C.observe(seen, {"easy": (2, 1.0, 0.5), "odd": (3, 1.0, 1.0)}, s)
    assert seen == {"easy": (1.0, 0.5)}
    C.observe(seen, {"easy": (3, 0.0, 0.5), "hard": (1, 0.2, 0.0)}, s)
    assert abs(seen["easy"][0] - 0.9**3) < 1e-12 and seen["hard"] == (0.2, 0.0)
    p = C.tier_shares(seen, 1, s)
    assert abs(sum(p.values()) - 1) < 1e-12 and min(p.values()) >= 0.1 and p["medium"] == max(p.values())
    near = math.exp(-((0.5 - 0.175) ** 2) / (2 * 0.15**2))
    assert p["easy"] < p["medium"] and near < 1
    m = C.TierSettings(mode="manual")
    assert [C.tier_shares({}, u, m)[t] for u, t in ((0, "easy"), (100, "easy"), (250, "hard"))] == [0.60, 0.34, 0.60]


def test_ceilings_against_plain_python(spark):
    rng = np.random.default_rng(4)
    x = rng.integers(0, 2, size=(60, 4, 7)).astype(float)
    v = C.candidate_weights(30)
    flags = C.ceiling_flags(x, v)

    def shape(rows, w):
        r = [row[0] + sum(a * b for a, b in zip(row[1:], w, strict=True)) for row in rows]
        mean = sum(r) / len(r)
        return max(range(4), key=lambda i: (round(r[i], 12), -i)), {i for i in range(4) if r[i] > mean + 1e-12}, float(np.std(r)) > 1e-9

    for g, f in zip(x, flags, strict=True):
        shapes = [shape(g, w) for w in v]
        top, pos, alive = shapes[0]
        right = {i for i in range(4) if g[i][0] >= 0.5}
        assert (bool(right), not alive, top in right) == tuple(f[:3])
        assert f[5] == (bool(right) and top not in right and any(t in right for t, _, _ in shapes)) and f[7] == (not alive and any(a for _, _, a in shapes))
    df = spark.createDataFrame([("r", i, 0, g.tolist()) for i, g in enumerate(x)], "run string, batch long, grp long, rows array<array<double>>")
    r = C.ceiling_report(C.ceilings(df, ["run"], v)).first()
    assert r.groups == 60 and r.with_correct == int(flags[:, 0].sum()) and abs(r.top_flips - flags[:, 3].mean()) < 1e-12
    b = C.replay_bandit(df, "run", block=10).first()
    assert b.rounds == 6 and abs(sum(b.weights) - 1.2) < 1e-9 and b == C.replay_bandit(df, "run", block=10).first()


def test_weight_summary(spark):
    c = C.WeightController(C.WeightSettings(strategy="adaptive_stable", delay=0))
    rows = [{"run": "r", **{k: v for k, v in c.update(0.2, good(0.9)).items() if k in ("step", "weights", "at_floor", "at_cap")}} for _ in range(5)]
    df = spark.createDataFrame(rows, "run string, step long, weights map<string,double>, at_floor array<string>, at_cap array<string>")
    got = {r.key: r for r in C_summary(df).collect()}
    for k in M.AUXILIARY:
        w = [r["weights"][k] for r in rows]
        assert (got[k].first, got[k].last, got[k].least, got[k].most) == (w[0], w[-1], min(w), max(w))


def C_summary(df):
    from evalmill.operators.diagnosis import weight_summary

    return weight_summary(df, "run")


def test_reward_steps_over_a_stream(spark, tmp_path):
    from evalmill.streaming import controllers

    schema = "completion string, numbers array<long>, target long, allowed_ops array<string>"
    for k, answer in enumerate(("(4+9)", "nothing", "(9+4)")):
        spark.createDataFrame([(f"<answer>{answer}</answer>", [4, 9], 13, ["+"])] * 4, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        q = controllers.reward_steps(spark.readStream.schema(schema).json(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "c"), C.WeightSettings(strategy="adaptive"))
        q.awaitTermination()
        assert q.exception() is None
    steps = spark.read.json(str(tmp_path / "out" / "steps")).orderBy("batch").collect()
    assert [r.batch for r in steps] == [0, 1, 2] and [r["rows"] for r in steps] == [4, 4, 4]
    want = C.WeightController(C.WeightSettings(strategy="adaptive"))
    for r in steps:
        used = r.used.asDict()
        assert used == pytest.approx(want.state["weights"])
        means = {k: 0.0 for k in used}
        rows = spark.read.json(str(tmp_path / "out" / "rewards")).where(f"batch = {r.batch}").collect()
        means = {k: sum((x.components[k] or 0.0) for x in rows) / 4 for k in used}
        want.update(sum((x.components["correct"] or 0.0) for x in rows) / 4, means)
        assert json.loads(r.state)["weights"] == pytest.approx(want.state["weights"]) and json.loads(r.state)["step"] == r.batch + 1
    assert steps[0].reward > steps[1].reward
