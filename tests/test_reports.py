import json
import math

import pytest
from pyspark.sql import functions as F

from evalmill.functions import keys as K
from evalmill.functions import measures as M
from evalmill.functions import text as X
from evalmill.operators import audit, control, generate, pairing, reports, sampling
from evalmill.plans import identity, scorecard
from evalmill.sources import files

CODE = "line_no long, bank string, id string, candidate_index int, completion_token_count int, metrics struct<" + ",".join(f"{c}:double" for c in reports.CODE_SELECTED) + ">, extra int"


def test_code_candidates_and_the_proxy_gap(spark):
    # the first candidate games the visible tests, the second is right
    rows = [(0, "b", "t", 0, 5, (1.0, 1.0, 1.0, 1.0, 0.25, 0.0), 1), (1, "b", "t", 1, None, (1.0, 1.0, 0.5, 1.0, 1.0, 1.0), 1), (2, "b", "u", 0, 7, None, 1)]
    got = {r.n: r for r in reports.code_best_of_n(spark.createDataFrame(rows, CODE), (1, 2)).collect()}
    assert got[2].units == 1 and (got[2].practical_exact_correct, got[2].oracle_exact_correct, got[2].proxy_gap, got[2].tokens) == (0, 1, 0.75, 5)
    assert got[1].units == 2 and got[1].tokens == 12
    assert reports.code_best_of_n(spark.createDataFrame([], CODE)).count() == 0


def test_task_components_and_their_grid(spark):
    schema = "line_no long, bank string, id string, candidate_index int, numbers array<long>, target long, allowed_ops array<string>, metrics struct<valid_expression:double,exact_correct:double>"
    rows = [(0, "b", "t", 0, [1, 2], 3, ["+"], (1.0, 1.0)), (1, "b", "t", 1, [2, 1], 3, ["+"], (1.0, 0.0)), (2, "b", "t", 1, [2, 1], 3, ["+"], (1.0, 0.0)), (3, "b", "u", 0, [4], 4, ["+"], None), (4, "b", "u", 1, [4], 4, ["+"], (0.0, 1.0)), (5, "b", "v", 0, None, 4, ["+"], None)]
    df = spark.createDataFrame(rows, schema)
    got = {(r.candidates, r.legal, r.exact_legal, r.legality, r.whole) for r in scorecard.strict_task_components(df).collect()}
    assert got == {(2, 2, 1, 1.0, True), (2, 0, 0, 0.0, True)}
    for odd in ((6, "b", "u", 3, [4], 4, ["+"], None), (6, "b", "w", 0, [1, 2], 3, ["+"], None)):
        with pytest.raises(pairing.GridError):
            scorecard.strict_task_components(df.unionByName(spark.createDataFrame([odd], schema)))


def test_quota_parts(spark):
    df = spark.createDataFrame([(i, None if i % 3 == 0 else "ab"[i % 2]) for i in range(60)] + [(100, "few")], "k long, s string")
    got = sampling.split_by_quota(df, "s", K.stable_order(1, "x", F.col("k")), [("one", 4), ("two", 3)])
    assert got.columns == ["k", "s", "part"] and got.count() == 61
    counts = {(r.s, r.part): r["count"] for r in got.groupBy("s", "part").count().collect()}
    assert counts == {(None, "one"): 4, (None, "two"): 3, (None, None): 13, ("a", "one"): 4, ("a", "two"): 3, ("a", None): 13, ("b", "one"): 4, ("b", "two"): 3, ("b", None): 13, ("few", "one"): 1}
    ordered = sorted((K_ := r.o, r.part or "~") for r in got.where("s = 'a'").select(K.stable_order(1, "x", F.col("k")).alias("o"), "part").collect())
    assert [p for _, p in ordered] == ["one"] * 4 + ["two"] * 3 + ["~"] * 13


def test_tier_draws(spark):
    df = spark.createDataFrame([(f"t{i}", "easy" if i < 900 else "hard") for i in range(1000)], "id string, tier string")
    got = sampling.tier_draws(df, "id", "tier", {"easy": 0.5, "hard": 0.5}, 100)
    hard = got.where("tier = 'hard'").count()
    assert got.count() == 100 and 25 < hard < 60 and got.select("id").distinct().count() == 100


def test_reward_groups_are_checked(spark):
    rows = [(i, "r", i // 4, f"t{i // 4}", (1.0,) * 7) for i in range(8)]
    names = ",".join(f"{c}:double" for c in ("correct", *control.M.AUXILIARY))
    schema = f"line_no long, run string, batch long, id string, metrics struct<{names}>"
    df = spark.createDataFrame(rows, schema)
    assert control.reward_groups(df, ["run"], F.col("batch"), ["line_no"]).count() == 2
    for bad in (rows[:7], [*rows[:7], (7, "r", 1, "other", (1.0,) * 7)]):
        odd = spark.createDataFrame(bad, schema)
        with pytest.raises(Exception, match="not full or has several ids"):
            control.reward_groups(odd, ["run"], F.col("batch"), ["line_no"]).collect()
        f = control.group_faults(odd, ["run"], F.col("batch"), ["line_no"]).first()
        assert f.groups == 2 and f.uneven + f.mixed == 1


def test_bandit_without_a_signal_and_simulations(spark):
    rows = [("r", b, 0, [[float((b + i) % 2)] + [float(i == k) for k in range(6)] for i in range(4)]) for b in range(40)]
    df = spark.createDataFrame(rows, "run string, batch long, grp long, rows array<array<double>>")
    a, b = (control.replay_bandit(df, "run", signal=x).first() for x in (True, False))
    assert a.rounds == b.rounds == 4 and a.final_l1 >= 0 and sum(b.weights) == pytest.approx(1.2)
    grid = [control.WeightSettings(strategy=s, delay=5) for s in ("static", "adaptive_stable_v12")]
    got = control.simulate(spark, grid, 30)
    assert got.count() == 60 and got.collect() == control.simulate(spark, grid, 30).collect()
    assert {round(sum(r.weights.values()), 6) for r in got.where("strategy = 'static'").collect()} == {1.2}


def test_built_splits(spark):
    quotas = {"train": {"easy": 12, "hard": 5}, "validation": {"easy": 4}}
    tasks = generate.build_splits(spark, quotas, {"easy": 60, "hard": 20})
    again = generate.build_splits(spark, quotas, {"easy": 60, "hard": 20})
    m = {(r.split, r.difficulty): (r.quota, r.rows, r.digest) for r in generate.manifest(tasks, quotas).collect()}
    assert {k: v[:2] for k, v in m.items()} == {("train", "easy"): (12, 12), ("train", "hard"): (5, 5), ("validation", "easy"): (4, 4)}
    assert m == {(r.split, r.difficulty): (r.quota, r.rows, r.digest) for r in generate.manifest(again, quotas).collect()}
    assert tasks.select(K.loose_key()).distinct().count() == 21
    for q, n, word in (({"train": {"odd": 1}}, {}, "unknown tier"), ({"train": {"easy": 0}}, {"easy": 3}, "quota"), ({"train": {"easy": 4}}, {"easy": 3}, "needs 4")):
        with pytest.raises(generate.RecipeError, match=word):
            generate.check_recipe(q, n)


def test_audit_verdicts(spark):
    schema = "line_no long, id string, split string, difficulty string, numbers array<long>, target long, allowed_ops array<string>, solution string"
    rows = [(0, "a", "train", "easy", [1, 2], 3, ["+"], "(1+2)"), (1, "b", "Test ", "easy", [2, 1], 3, ["+"], "(1+2)"), (2, "c", "test", "ood_long", [5, 2], 3, ["-"], None), (3, "d", None, "easy", [5, 2], 3, ["-"], "(5-2)")]
    got = {r.check: r.failures for r in audit.audit_verdict(spark.createDataFrame(rows, schema)).collect()}
    assert got["evaluation ids whose task is in train"] == 1 and got["rows without a split"] == 1 and got["rows that lack what a task needs"] == 1 and got["tiers that their split may not hold"] == 1 and got["ids that repeat in a split"] == 0
    assert set(audit.audit_verdict(spark.createDataFrame([], schema)).select("failures").distinct().collect()) == {(0,)}


def test_identities(spark):
    configs = ['{"sampling_seed": 3, "temperature": 0.7, "batch_size": 8}', '{"hf_gen_mode": "batched", "batch_size": 8, "prompt_field": "prompt_mid"}', "{}"]
    df = spark.createDataFrame([(c,) for c in configs], "c string").withColumn("v", F.parse_json("c"))
    a, b, c = (r.i for r in df.select(identity.sampling_identity(F.col("v")).alias("i")).collect())
    assert (a.hf_gen_mode, a.sampling_seed, a.temperature, a.prompt_field, a.batch_size) == ('"loop"', "3", "0.7", '"prompt"', None)
    assert (b.batch_size, b.prompt_field) == ("8", '"prompt_mid"') and c.sampling_seed is None
    e = df.select(identity.evaluation_signature(F.parse_json(F.lit('{"seed": 5, "limit": null}')), F.col("v"), F.parse_json(F.lit('{"limit": 9, "split": "x"}')), F.lit("y")).alias("e")).first().e
    assert (e.sampling_seed, e.limit, e.split, e.engine, e.temperature) == ("5", "9", '"y"', '"hf"', "0.7")
    runs = spark.createDataFrame([("a", '{"seed": 1, "x": 2}'), ("a", '{"x": 2, "seed": 2}'), ("b", '{"x": 3}'), ("b", '{"x": 4}')], "m string, c string")
    assert {(r.m, r.versions) for r in identity.drifted(runs, ["m"], "c").collect()} == {("a", 1), ("b", 2)}


def test_chains(spark):
    evaluations = spark.createDataFrame([("e1", "d2"), ("e2", "zz"), ("e3", "d3"), ("e4", None)], "evaluation string, adapter_digest string")
    trainings = spark.createDataFrame([("t1", "d1", None), ("t2", "d2", "d1"), ("t3", "d3", "gone")], "training string, output_digest string, parent_digest string")
    assert sorted(map(tuple, identity.chained(evaluations, trainings).collect())) == [("e1", "t2", "t1", "whole"), ("e2", None, None, "training"), ("e3", "t3", None, "parent"), ("e4", None, None, "training")]


def test_finite_values_and_json(spark):
    schema = "a double, s struct<x:double,t:string>, l array<double>, m map<string,double>"
    rows = [(1.0, (1.0, "x"), [1.0], {"k": 1.0}), (math.nan, None, None, None), (1.0, (math.inf, "x"), [], {}), (1.0, (None, None), [1.0, -math.inf], {}), (None, None, [None], {"k": math.nan})]
    df = spark.createDataFrame(rows, schema)
    ok = [r[0] for r in df.select(M.all_finite(F.struct("*"), df.schema)).collect()]
    assert ok == [True, False, False, False, False]
    safe = [json.loads(r[0]) for r in df.select(F.to_json(M.json_safe(F.struct("*"), df.schema), {"ignoreNullFields": "false"})).collect()]
    assert safe[1]["a"] is None and safe[2]["s"] == {"x": None, "t": "x"} and safe[3]["l"] == [1.0, None] and safe[4]["m"] == {"k": None}
    assert df.select(M.first_known(df, "none", "a")).first()[0] == 1.0 and df.select(M.first_known(df, "none")).first()[0] == 0.0


def test_prompts_and_messages(spark):
    df = spark.createDataFrame([([4, 9], 13, ["+", "-"], "(4+9)")], "n array<long>, t long, o array<string>, s string")
    low, done = df.select(X.prompt(F.col("n"), F.col("t"), F.col("o"), "low"), X.completion(F.col("s"), F.col("t"))).first()
    assert low.startswith("Use the numbers [4, 9] to make 13. Allowed operations: + -.") and done.endswith("<answer>(4+9)</answer>") and "It evaluates to 13" in done
    with pytest.raises(ValueError, match="unknown level"):
        X.prompt(F.col("n"), F.col("t"), F.col("o"), "top")
    texts = ['"plain"', '[{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]', '["x", "y"]', '{"content": "c"}', "[]"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(X.message_text(F.parse_json("t"))).collect()]
    assert got == ["plain", "b", "x\ny", "c", ""]


def test_strict_keys(spark):
    rows = [("[3, 1]", "4", '["+", "+"]'), ("[3.5]", "4", '["+"]'), ("[true]", "4", '["+"]'), ("[1]", '"4"', '["+"]'), ("[1]", "4", "[1]"), (None, "4", "[]")]
    df = spark.createDataFrame(rows, "n string, t string, o string")
    got = [r[0] for r in df.select(K.strict_semantic_key(F.parse_json("n"), F.parse_json("t"), F.parse_json("o"))).collect()]
    assert got == ['{"allowed_ops":["+"],"numbers":[1,3],"target":4}'] + [None] * 5


def test_csv_objects_and_safe_paths(spark, tmp_path):
    (tmp_path / "a.csv").write_text("split,n\nx,1\ny,2\n")
    assert [tuple(r) for r in files.read_csv(spark, str(tmp_path / "a.csv"), "split string, n int", {"split": "y"}).collect()] == [("y", 2)]
    (tmp_path / "b.csv").write_text("split,n\nx,one\n")
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        files.read_csv(spark, str(tmp_path / "b.csv"), "split string, n int").collect()
    (tmp_path / "o").mkdir()
    (tmp_path / "o" / "c.json").write_text('{\n "a": 1\n}\n')
    assert files.json_object(spark, str(tmp_path / "o"), "a int").select("a").first().a == 1
    (tmp_path / "o" / "d.json").write_text("[1]")
    with pytest.raises(files.LineError, match="d.json"):
        files.json_object(spark, str(tmp_path / "o"), "a int")
    (tmp_path / "o" / "empty").write_text("")
    assert [p.rsplit("/", 1)[1] for p in files.nonempty(spark, str(tmp_path / "o"), "json$")] == ["c.json", "d.json"]
    assert files.safe_output(str(tmp_path / "o" / "x"), (str(tmp_path / "o"),)).endswith("/o/x")
    for bad in (tmp_path / "o" / ".." / "x", tmp_path / "o"):
        with pytest.raises(files.OutputError):
            files.safe_output(str(bad), (str(tmp_path / "o"),))


def test_lines_are_numbered_across_splits(spark, tmp_path):
    lines = [f"line {i} " + "x" * (i % 50) if i % 7 else "" for i in range(3000)]
    (tmp_path / "a.txt").write_text("\n".join(lines) + "\n")
    (tmp_path / "b.txt").write_text("one\n\ntwo")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8000")
    try:
        got = {}
        for r in files.ordered_lines(spark, str(tmp_path)).collect():
            got.setdefault(r.file.rsplit("/", 1)[1], []).append((r.line_no, r.line))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted(got["a.txt"]) == list(enumerate(lines, 1)) and sorted(got["b.txt"]) == [(1, "one"), (2, ""), (3, "two")]


def test_set_digests_are_streams(spark):
    import hashlib

    df = spark.createDataFrame([(g, v) for g in ("a", None) for v in ("é", "b", "a", None, "b")] + [("none", None)], "g string, v string").repartition(5)
    want = hashlib.sha256("a\nb\nb\né\n".encode()).hexdigest()
    assert {tuple(r) for r in K.set_digest(df, "v", ["g"]).collect()} == {("a", want, 4), (None, want, 4)}
    assert K.set_digest(df.limit(0), "v").count() == 0


def test_scorers_are_exchanged(spark):
    from evalmill.functions import scoring
    from evalmill.functions.register import register

    df = spark.createDataFrame([("<answer>(4+9)</answer>", [4, 9], 13, ["+"]), (None, [4, 9], 13, ["+"])], "completion string, numbers array<long>, target long, allowed_ops array<string>")
    a, b = scoring.scored(df, weights={"format": 0.5, "unknown": 9.0}, primary_weight=2.0).collect()
    assert (a.reward, b.reward, a.components.correct) == (2.5, 0.0, 1.0)
    tasks = generate.code_tasks(spark, 2, ("running_max", "is_sorted_asc")).withColumn("completion", F.lit("<answer>def running_max(a):\n    out = []\n    for x in a:\n        out.append(max(out + [x]))\n    return out</answer>"))
    got = {r.id: (r.reward, r.components.visible_pass_rate) for r in scoring.scored(tasks, scorer=scoring.programs(True), weights={}).collect()}
    assert got == {"running_max-0": (1.0, 1.0), "running_max-1": (1.0, 1.0), "is_sorted_asc-0": (0.0, 0.0), "is_sorted_asc-1": (0.0, 0.0)}
    register(spark)
    rows = spark.createDataFrame([("a", 1.0)] * 4 + [("b", 0.0), ("b", None)], "g string, e double")
    rows.createOrReplaceTempView("effects")
    assert {tuple(r) for r in spark.sql("select g, flip_p(e) as p from effects group by g").collect()} == {("a", 0.125), ("b", 1.0)}


def test_code_tasks_have_distinct_tests(spark):
    rows = generate.code_tasks(spark, 3).collect()
    assert len(rows) == 3 * len(generate.LIST_TASKS) and rows == generate.code_tasks(spark, 3).collect()
    for r in rows:
        seen, hidden = json.loads(r.visible_tests), json.loads(r.held_out_tests)
        assert len(seen) == 3 and len(hidden) == 5 and len({str(args) for args, _ in seen + hidden}) == 8
        if r.fn_name == "dedupe":
            assert all(out == list(dict.fromkeys(a)) for (a,), out in seen + hidden)
