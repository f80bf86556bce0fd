from pyspark.sql import functions as F

from evalmill.functions.register import register
from evalmill.plans import scorecard
from evalmill.sources.files import METRICS

FIELDS = [*METRICS, "reward_hacking_candidate"]
SCHEMA = f"line_no long, bank string, id string, candidate_index int, difficulty string, completion string, completion_token_count int, numbers array<long>, target long, allowed_ops array<string>, metrics struct<{','.join(f'{f}:double' for f in FIELDS)},expression:string,value:string,error:string>"


def row(i, bank, task, k, exact, legal=1.0, **over):
    m = tuple({"exact_correct": exact, "correct": exact, "valid_expression": legal, "parse_ok": 1.0, "number_multiset_f1": 1.0}.get(f, 0.0) for f in FIELDS) + ("(1+2)", "3", None)
    r = {"line_no": i, "bank": bank, "id": task, "candidate_index": k, "difficulty": "easy", "completion": "<answer>(1+2)</answer>", "completion_token_count": 10, "numbers": [1, 2], "target": 3, "allowed_ops": ["+"], "metrics": m} | over
    return tuple(r.values())


RUNS = [("x_val_s0001", "x", "val", 1, 2), ("base_val_s0002", "base", "val", 2, 2)]


def frames(spark, data):
    runs = spark.createDataFrame(RUNS, "bank string, method string, split string, seed long, n_candidates int")
    tasks = spark.createDataFrame([(0, " Train", [2, 1], 3, ["+"])], "line_no long, split string, numbers array<long>, target long, allowed_ops array<string>")
    return spark.createDataFrame(data, SCHEMA), tasks, runs


def test_scorecard_and_contrasts(spark):
    data = [row(0, "x_val_s0001", "t1", 0, 1.0), row(1, "x_val_s0001", "t1", 0, 0.0), row(2, "x_val_s0001", "t2", 0, 1.0, target=9), row(3, "base_val_s0002", "t1", 0, 0.0), row(4, "base_val_s0002", "t2", 0, 1.0, legal=0.0, target=None)]
    c, t, runs = frames(spark, data)
    got = {(r.method, r.scope, r.difficulty): (r.candidates, r.legality, r.exact_given_legal) for r in scorecard.scorecard(c, t, runs).collect()}
    assert got["x", "all", None] == (2, 1.0, 1.0) and got["x", "overlap", "easy"] == (1, 1.0, 1.0) and got["base", "held_out", None] == (1, 0.0, 0.0)
    m = scorecard.contrasts(c, runs, "base", n=1).collect()
    assert [(r.method, r.n, r.both, r.arm_only, r.base_only, r.p, r.adjusted, r.reject) for r in m] == [("x", 2, 1, 1, 0, 1.0, 1.0, False)]
    o = {r.bank: (r.practical, r.tokens, r.tokens_per_exact) for r in scorecard.macro_outcomes(c, runs, 1).collect()}
    assert o == {"x_val_s0001": (1.0, 20, 10.0), "base_val_s0002": (0.5, 20, 20.0)}
    assert scorecard.scorecard(c.limit(0), t, runs).count() == 0


def test_stored_verdicts(spark):
    good = row(0, "b", "t", 0, 1.0)
    wrong = row(1, "b", "t", 1, 1.0, completion="<answer>(1+1)</answer>")
    r = scorecard.reverified(spark.createDataFrame([good, wrong], SCHEMA)).first()
    assert (r["rows"], r.parse_ok, r.valid_expression, r.correct, r.number_multiset_f1) == (2, 0, 1, 1, 1)


def test_raw_lines_and_names(spark):
    lines = ['{"id": "a", "candidate_index": 1, "metrics": {}}', '{"id": 3, "candidate_index": "1"}', "[]", "{", None]
    raw = spark.createDataFrame([("b", x) for x in lines], "bank string, line string")
    assert tuple(scorecard.raw_line_check(raw).first()) == ("b", 5, 3, 1, 1, 1)
    names = spark.createDataFrame([("adaptive_val_s0012", "adaptive_stable"), ("static_test_in_dist_s3", None), ("odd", None)], "bank string, m string")
    got = [tuple(r[0]) for r in names.select(scorecard.run_identity(F.col("bank"), F.col("m"))).collect()]
    assert got == [("stable", "val", 12), ("static", "test_in_dist", 3), (None, None, None)]


def test_functions_of_sql(spark):
    register(spark)
    r = spark.sql("select verify_expression('(1+2)', array(1L, 2L), 3L, array('+')).correct as a, code_is_legal('import os') as b, code_is_legal('x = 1') as c, code_is_legal('(') as d").first()
    assert tuple(r) == (1.0, False, True, None)
    rows = spark.sql("select * from propose_tasks('easy', 1, 5, 3)").collect()
    assert [x.proposal_index for x in rows] == [5, 6, 7] and all(len(x.numbers) == 3 for x in rows)
