import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from evalmill.functions import measures as M
from evalmill.operators import banks, diagnosis, pairing
from evalmill.sources.files import METRICS

FIELDS = [*METRICS, "reward_hacking_candidate"]
SCHEMA = f"line_no long, bank string, id string, candidate_index int, difficulty string, prompt_field string, completion string, extracted_expression string, completion_token_count int, numbers array<long>, target long, allowed_ops array<string>, metrics struct<{','.join(f'{f}:double' for f in FIELDS)},expression:string,value:string,error:string>, score string"


def make(spark, rng, rows=400):
    data = []
    for i in range(rows):
        m = tuple(rng.choice([0.0, 1.0, None, float("nan")]) if rng.random() < 0.2 else float(rng.random() < 0.4) for _ in FIELDS) + ("1+2", "3", None)
        data.append((i, rng.choice("ab"), f"t{rng.randint(0, 12)}", rng.randint(0, 11), rng.choice(["easy", "medium"]), rng.choice(["prompt_high", "prompt_mid", None]), rng.choice(["<answer>1", "x", None]), rng.choice(["1 + 2", "1+2", "2", "", None]), rng.choice([3, 256, 300, None]), [1, 2], 3, ["+"], None if rng.random() < 0.05 else m, "clash"))
    return spark.createDataFrame(data, SCHEMA).repartition(5), data


def units_of(data):
    once = {}
    for r in sorted(data):
        once.setdefault((r[1], r[2], r[3]), r)
    units = defaultdict(list)
    for k in sorted(once):
        units[k[:2]].append(once[k])
    return units


def val(r, name):
    v = None if r[12] is None else r[12][FIELDS.index(name)]
    return 0.0 if v is None or v != v else v


def score(r):
    return sum(w * val(r, n) for n, w in M.PRACTICAL)


def test_selection_against_plain_python(spark):
    df, data = make(spark, random.Random(1))
    units = units_of(data)
    for oracle in (False, True):
        got = {(r.bank, r.id): r.line_no for r in banks.select_best(df, 4, oracle).collect()}
        key = lambda r: ((val(r, "exact_correct"),) if oracle else ()) + (score(r), -r[3])
        assert got == {u: max(rs[:4], key=key)[0] for u, rs in units.items()}
    report = {r.n: r for r in banks.best_of_n(df, (1, 3), seconds=20.0).collect()}
    full = [rs[:3] for rs in units.values() if len(rs) >= 3]
    chosen = [max(rs, key=lambda r: (score(r), -r[3])) for rs in full]
    assert report[3].units == len(full) and abs(report[3].practical_exact_correct - sum(val(r, "exact_correct") for r in chosen) / len(full)) < 1e-12
    assert report[3].tokens == sum(r[8] or 0 for rs in full for r in rs) and report[1].seconds == 20 / 3
    assert report[3].practical_exact_correct <= report[3].oracle_exact_correct and report[1].oracle_exact_correct <= report[3].oracle_exact_correct + 1e-12 or len(full) != len(units)


def test_headroom_against_plain_python(spark):
    df, data = make(spark, random.Random(2), 900)
    full = {u: rs[:8] for u, rs in units_of(data).items() if len(rs) >= 8}
    u = banks.full_units(df)
    curve = {r.n: (r.newly, r.solved) for r in banks.solve_curve(u).collect()}
    firsts = [next((k for k, r in enumerate(rs) if val(r, "exact_correct") == 1), None) for rs in full.values()]
    assert curve == {n: (firsts.count(n - 1), sum(f is not None and f < n for f in firsts)) for n in range(1, 9)}
    d = banks.diversity(u).first()
    assert abs(d.avg_distinct_all - sum(len({r[7].replace(" ", "") for r in rs if r[7]}) for rs in full.values()) / len(full)) < 1e-12
    c = banks.clip_recovery(u).first()
    none = [rs for rs in full.values() if all(val(r, "exact_correct") != 1 for r in rs)]
    assert (c.units, c.unsolved, c.any_clip) == (len(full), len(none), sum(any((r[8] or 0) >= 256 for r in rs) for rs in none))
    assert c.unclosed == sum(any((r[8] or 0) >= 256 and r[6] == "<answer>1" for r in rs) for rs in none)
    x = {r.n: r.predicted for r in banks.extrapolation(u).collect()}
    k = [sum(val(r, "exact_correct") == 1 for r in rs) for rs in full.values()]
    assert abs(x[16] - sum(1 - (1 - v / 8) ** 16 for v in k) / len(k)) < 1e-12
    levels = {r.level: r for r in banks.headroom(df).where("level = 3").collect()}
    assert levels[3].units == len(full)


def test_integrity_and_empty(spark):
    df, data = make(spark, random.Random(3), 60)
    declared = spark.createDataFrame([("a", 4)], "bank string, n_candidates int")
    got = {r.bank: r for r in banks.integrity(df, declared).collect()}
    units = defaultdict(list)
    for r in data:
        units[r[1:3]].append(r[3])
    mine = [v for (b, _), v in units.items() if b == "a"]
    assert (got["a"].units, got["a"].rows, got["a"].repeated) == (len(mine), sum(map(len, mine)), sum(len(v) - len(set(v)) for v in mine))
    assert got["a"].incomplete == sum(not {0, 1, 2, 3} <= set(v) for v in mine) and got["a"].gaps == sum(len(set(v)) != max(v) + 1 for v in mine)
    none = df.limit(0)
    assert banks.best_of_n(none).count() == 0 and banks.headroom(none).where("level <> 3").count() == 0 and banks.integrity(none).count() == 0


def test_cost_and_seeds(spark):
    df = spark.createDataFrame([(8.0, 0.0), (8.0, 0.25)], "n double, r double")
    assert [r[0] for r in df.select(M.cost_per_exact(F.col("n"), F.col("r"))).collect()] == [8e12, 32.0]
    runs = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", float("inf")), ("b", float("inf")), ("c", 5.0)], "m string, v double")
    got = {r.m: (r.v_mean, r.v_std) for r in banks.seeds_mean_std(runs, ["m"], ["v"]).collect()}
    assert got["a"] == (2.0, 2.0**0.5) and got["b"] == (float("inf"), 0.0) and got["c"] == (5.0, 0.0)


def test_groups_and_changes(spark):
    df = spark.createDataFrame([("r", 0, i, float(v)) for i, v in enumerate([1, 3, 3, 0, 2, 2])], "run string, batch int, line_no int, v double")
    g = diagnosis.positional_groups(df, ["run", "batch"], ["line_no"], 4)
    s = {r.grp: (r.rows, r.top, list(r.positive)) for r in diagnosis.group_structure(g, ["run", "batch", "grp"], ["line_no"], F.col("v")).collect()}
    assert s == {0: (4, 1, [1, 2]), 1: (2, 0, [])}
    c = diagnosis.consecutive_change(df, ["run"], ["line_no"], ["v"]).first()
    assert (c.steps, c.mean_l1, c.max_linf) == (5, (2 + 0 + 3 + 2 + 0) / 5, 3.0)


def test_pairs(spark):
    arm = spark.createDataFrame([("t1", 1), ("t2", 1), ("t3", 0), ("t4", 0)], "id string, outcome int")
    base = spark.createDataFrame([("t1", 1), ("t2", 0), ("t3", 1), ("t4", 0)], "id string, outcome int")
    c = pairing.paired_counts(pairing.paired(arm, base, ["id"], strict=True)).first()
    assert tuple(c) == (4, 1, 1, 1, 1, 0.0)
    with pytest.raises(pairing.GridError):
        pairing.paired(arm, base.limit(3), ["id"], strict=True)
    runs = spark.createDataFrame([("t1", 1, 0.5), ("t1", 2, 0.7), ("t2", 1, 0.1), ("t2", 2, 0.2)], "id string, run int, v double")
    assert {r.id: list(r["values"]) for r in pairing.stacked_panel(runs, "id", "run", "v").collect()} == {"t1": [0.5, 0.7], "t2": [0.1, 0.2]}
    with pytest.raises(pairing.GridError):
        pairing.stacked_panel(runs.where("id <> 't2' or run = 1"), "id", "run", "v").collect()
    ids = spark.createDataFrame([(0, "t2"), (1, "gone"), (2, "t1")], "pos int, id string")
    rows = spark.createDataFrame([("t1", 5, "old"), ("t1", 9, "new"), ("t2", 1, "x")], "id string, line_no int, v string")
    with pytest.raises(Exception, match="no row has the id"):
        pairing.ordered_lookup(ids, rows).collect()
    assert [(r.pos, r.v) for r in pairing.ordered_lookup(ids, rows, strict=False).orderBy("pos").collect()] == [(0, "x"), (1, None), (2, "new")]
    m = {r.id: (r.known, r.different) for r in pairing.matching_payload(rows.where("line_no > 1").select("id", "v"), rows.where("line_no < 9").select("id", "v"), "id", ["v"]).collect()}
    assert m == {"t1": (True, ["v"])}


def test_shift_and_interaction(spark):
    df, _ = make(spark, random.Random(4), 600)
    p = diagnosis.prompt_shift(df, ["bank"])
    assert {r.bank for r in p.collect()} == {"a", "b"}
    shift = spark.createDataFrame([("s", 1, 0.4), ("s", 2, 0.5), ("t", 1, 0.1), ("t", 2, 0.3)], "method string, seed int, legal_loss double")
    r = diagnosis.shift_interaction(shift, "method", ["seed"], "s", "t").first()
    assert (r.pairs, round(r["mean"], 6), round(r.spread, 6), r.consistent) == (2, 0.25, 0.05, True)


def test_health_gate_and_prompts(spark):
    df, data = make(spark, random.Random(6), 120)
    got = {r.bank: r for r in diagnosis.health_gate(df, ["bank"]).collect()}
    mine = [r for r in data if r[1] == "a"]
    assert got["a"]["rows"] == len(mine) and got["a"].exact_differs == sum(val(r, "exact_correct") != val(r, "correct") for r in mine)
    assert got["a"].legal_unparsed == sum(val(r, "valid_expression") >= 1 > val(r, "parse_ok") for r in mine) and got["a"].outside == 0 and got["a"].varies
    tasks = spark.createDataFrame([(0, "t1", "old", "m", "h"), (5, "t1", "low", "mid", None)], "line_no long, id string, prompt_low string, prompt_mid string, prompt_high string")
    c = spark.createDataFrame([(0, "t1", "prompt_low"), (1, "t1", "prompt_high"), (2, "t1", None), (3, "gone", "prompt_mid"), (4, None, "prompt_mid")], "line_no long, id string, prompt_field string")
    assert [r.prompt for r in pairing.shown_prompt(c, tasks).orderBy("line_no").collect()] == ["low", None, None, None, None]


def test_prefixes_are_limited_before_the_shuffle(spark):
    df, _ = make(spark, random.Random(8), 20)
    for plan in (banks.select_best(df, 4), banks.best_of_n(df), banks.full_units(df)):
        assert "WindowGroupLimit" in plan._jdf.queryExecution().executedPlan().toString()


def test_integrity_beyond_64_indices(spark):
    rows = [("a", "x", i) for i in range(64)] + [("a", "y", i) for i in range(128)] + [("b", "x", i) for i in range(130) if i != 100]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "line_no long, bank string, id string, candidate_index int")
    declared = spark.createDataFrame([("a", 128), ("b", 130)], "bank string, n_candidates int")
    assert {r.bank: (r.units, r.incomplete, r.gaps) for r in banks.integrity(df, declared).collect()} == {"a": (2, 1, 0), "b": (1, 1, 1)}
    assert {r.bank: (r.units, r.incomplete, r.gaps) for r in banks.integrity(df).collect()} == {"a": (2, 0, 0), "b": (1, 1, 1)}
