import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evalmill.functions import arrays as A
from evalmill.functions import code, verifier
from evalmill.functions import keys as K
from evalmill.functions import measures as M
from evalmill.functions import text as X

ALL = ["+", "-", "*"]


def test_verdicts():
    j = verifier.judge
    r = j("(7-4)*11", [4, 7, 11], 33, ALL)
    assert r["correct"] == r["number_precision"] == r["number_recall"] == r["number_multiset_f1"] == r["numeric_distance_reward"] == 1
    r = j("(7-4)*11", [4, 7, 11], 36, ALL)
    assert (r["valid_expression"], r["correct"], r["numeric_distance_reward"]) == (1, 0, 0.25)
    r = j("11-4", [4, 6, 11], 7, ALL)  # one number is left over
    assert (r["number_precision"], round(r["number_recall"], 4), round(r["number_multiset_f1"], 4), r["uses_no_extra_numbers"], r["uses_all_required_numbers"]) == (1, 0.6667, 0.8, 1, 0)
    r = j("11-4+5", [4, 6, 11], 12, ALL)  # one number is not given
    assert round(r["number_multiset_f1"], 4) == 0.6667 and r["uses_no_extra_numbers"] == 0
    r = j("21", [4, 6, 11], 21, ALL)
    assert r["number_multiset_f1"] == 0 and r["uses_allowed_ops"] == 0
    r = j("12/4-1", [12, 4, 1], 2, ALL)
    assert r["uses_allowed_ops"] == 0 and r["correct"] == 0
    assert j("5/3*6", [5, 3, 6], 10, ["/", "*"])["correct"] == 1 and j("5/3", [5, 3], 2, ["/"])["value"] == "5/3"


@pytest.mark.parametrize("text", [None, "", " ", "1+", "x", "-1+2", "1.5+2", "True+1", "2**99999", "1/0", "(" * 5000, "9" * 5000, "1+" * 3000 + "1", "f(1)", "'a'", "\x00"])
def test_verifier_never_raises(text):
    r = verifier.judge(text, [1, 2], 3, ["+", "/"])
    assert r["correct"] == 0 and r["valid_expression"] == 0 and (r["error"] is not None or text.startswith("1+1"))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 30), min_size=2, max_size=5), st.data())
def test_verifier_agrees_with_python(numbers, data):
    text = str(numbers[0])
    for n in numbers[1:]:
        text = f"({text}{data.draw(st.sampled_from('+-*'))}{n})"
    r = verifier.judge(text, numbers[::-1], eval(text), ALL)
    assert r["correct"] == 1 and r["value"] == str(eval(text))


def test_answers_and_tags(spark):
    texts = ["<ANSWER>  1+2 \n</answer> x <answer>3</answer>", "  1+2 ", None, "<answer>(1+2)*3"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(X.extract_answer(F.col("t")).alias("a"), X.tag_signals(F.col("t")).alias("s"), M.unclosed_answer(F.col("t")).alias("u")).collect()
    assert [(r.a.expression, r.a.found) for r in rows] == [("1+2", True), ("1+2", False), ("", False), ("<answer>(1+2)*3", False)]
    assert [tuple(r.s) for r in rows] == [(True, True, True), (False,) * 3, (False,) * 3, (True, False, False)] and [r.u for r in rows] == [False, False, False, True]


def test_components_of_completions(spark):
    df = spark.createDataFrame([("<answer>(1+2)*3", [1, 2, 3], 9, ALL), ("(1+2)*3", [1, 2, 3], 9, ALL), ("x", None, 9, ALL)], "c string, n array<long>, t long, o array<string>")
    v = df.withColumn("v", verifier.verify_completion(F.col("c"), F.col("n"), F.col("t"), F.col("o")))
    a, b, c = v.select(verifier.components(F.col("c"), F.col("v")).alias("m")).select("m.*").collect()
    assert abs(a.format - 1 / 3) < 1e-12 and a.correct == 0 and b.exact_correct == 1 and b.format == 0 and c.correct is None and c.error == "the task is incomplete"


def test_failure_classes(spark):
    names = ["exact_correct", "has_extractable_answer_span", "parse_ok", "uses_no_extra_numbers", "uses_all_required_numbers", "uses_allowed_ops", "evaluates_without_exception", "valid_expression"]
    cases = [((1,) + (0,) * 7, "exact_correct"), ((0,) * 8, "no_answer_span"), ((0, 1) + (0,) * 6, "parse_failure"), ((0, 1, 1, 1, 1, 1, 1, 1), "legal_but_wrong_value"), ((0, 1, 1, 1, 1, 1, 1, 0), "repeated_answer_tag"), ((0, 1, 1, 1, 1, 1, None, 0), "evaluation_error")]
    schema = "metrics struct<" + ",".join(f"{n}:double" for n in names) + ">, completion string"
    df = spark.createDataFrame([(tuple(None if x is None else float(x) for x in m), "</answer></answer>") for m, _ in cases], schema)
    assert [r[0] for r in df.select(M.failure_class()).collect()] == [c for _, c in cases]


def test_multisets_and_lists(spark):
    df = spark.createDataFrame([([3, 1, 1, 2], [1, 1, 5]), ([], []), ([2, 2, 2], [2])], "a array<long>, b array<long>")
    m = df.select(A.multiset_scores(F.col("a"), F.col("b")).alias("m")).select("m.*").collect()
    assert (m[0].precision, round(m[0].recall, 4), m[0].no_extra, m[1].f1, m[2].all_required, m[2].no_extra) == (0.5, 0.6667, False, 0.0, True, False)
    f, a, b = A.LIST_FUNCTIONS, F.col("a"), F.col("b")
    one = df.select(*(f[n](a).alias(n) for n in ("last", "first", "running_max", "prefix_sum", "dedupe", "second_max", "pairwise_diff", "run_length", "sum_positive", "is_sorted_asc", "group_parity", "group_by_sign", "running_min", "sum_pos_even", "is_palindrome_list")), f["zip_sum"](a, b).alias("z"), f["merge_sorted"](a, b).alias("m"), f["two_sum_exists"](a, F.lit(5)).alias("s5"), f["two_sum_exists"](a, F.lit(6)).alias("s6"), f["count_greater"](a, F.lit(1)).alias("g"), f["count_in_range"](a, F.lit(1), F.lit(2)).alias("r")).collect()
    x, y = one[0], one[1]
    assert (x.last, x.first, x.running_max, x.prefix_sum, x.dedupe, x.second_max, x.pairwise_diff) == (2, 3, [3, 3, 3, 3], [3, 4, 5, 7], [3, 1, 2], 2, [-2, 0, 1])
    assert [tuple(r) for r in x.run_length] == [(3, 1), (1, 2), (2, 1)] and x.z == [4, 2, 6] and x.m == [1, 1, 1, 1, 2, 3, 5] and x.s5 and not x.s6 and (x.g, x.r) == (2, 3)
    assert (y.last, y.running_max, y.pairwise_diff, y.run_length, y.sum_positive, y.z, y.s5) == (None, [], [], [], 0, [], False)
    pad = spark.createDataFrame([([5, 0, 6, 0, 0],), ([0],), ([],)], "t array<int>").select(A.strip_padding(F.col("t"), F.lit(0))).collect()
    assert [r[0] for r in pad] == [[5, 0, 6], [], []]


def test_keys(spark):
    df = spark.createDataFrame([([3, 1, 2], 6, ["*", "+", "+"]), ([2, 3, 1], 6, ["+", "*"]), ([2, 3, 1], 6, ["+"]), (None, 6, ["+"])], "numbers array<long>, target long, allowed_ops array<string>")
    k = [r[0] for r in df.select(K.semantic_key()).collect()]
    assert k[0] == k[1] != k[2] and k[3] is None and json.loads(k[0]) == {"allowed_ops": ["*", "+"], "numbers": [1, 2, 3], "target": 6}
    assert len({r[0] for r in df.select(K.loose_key()).collect()}) == 2
    counts = spark.createDataFrame([("8, 1 4 4 x",), ("",), (None,)], "t string").select(X.parse_counts(F.col("t"))).collect()
    assert [r[0] for r in counts] == [[1, 4, 8], [], []]


VISIBLE, HIDDEN = [[[2], 4], [[3], 6]], [[[5], 10]]


@pytest.mark.parametrize(
    ("source", "held_out", "legal"),
    [("def f(x):\n    return x*2", 1, 1), ("def f(x):\n    return 4", 0, 1), ("import os\ndef f(x):\n    return x*2", None, 0), ("def f(x):\n    return ().__class__", None, 0), ("def g(x):\n    return x", None, 0), ("def f(x):\n    while True: pass", 0, 1), ("def f(x", None, 0)],
)
def test_code(source, held_out, legal, monkeypatch):
    monkeypatch.setattr(code.run_cases, "__defaults__", (640, code.LINES, 5))
    r = code.judge_code(source, "f", VISIBLE, HIDDEN, execute=True)
    assert r["valid_expression"] == legal and (held_out is None or r["held_out_pass_rate"] == held_out)


def test_code_runs_in_one_child_with_a_budget_of_lines():
    child = code.Child(lines=1000, seconds=5)
    few, many = "def f(n):\n    for i in range(n):\n        pass\n    return n", [[[10], 10], [[5000], 5000], [[20], 20]]
    assert child.run(few, "f", many) == [(True, True), (False, False), (True, True)]
    first = child.process.pid
    assert child.run("def f(n):\n    print('noise')\n    return n", "f", [[[1], 1], [[1], 2]]) == [(True, True), (True, False)] and child.process.pid == first
    assert child.run("def f():\n    import os\n    os._exit(3)", "f", [[[], 1]]) == [(False, False)]
    assert child.run("def f(n):\n    return [n, str(n)]", "f", [[[4], [4, "4"]]]) == [(True, True)] and child.process.pid != first
    child.stop()


def test_code_surveys():
    s = code.surveyed("import io, os.path\nfrom socket import x\ndef f(a):\n    if a == [1, 2] or a != 3:\n        return [4]\n    return a.__class__")
    assert s.modules == {"io", "os", "socket"} and (s.imports_safe, s.names_safe) == (False, False) and s.literal_comparisons == 1 and s.returned == ["[4]"]
    assert code.legality("import io\nx = 1") == (True, True) and code.legality("def f(") is None and code.legality("os.listdir()") == (True, False)
    assert code.no_hardcoding("def f(a):\n    return sorted(a)", [[[1], [1]]]) == 1.0 and code.no_hardcoding("def f(a):\n    return [4]", [[[1], [4]]]) == 0.5


def test_code_components(spark):
    df = spark.createDataFrame([("<answer>def f(x):\n    return x*2</answer>",), ("def g(x): return x",)], "c string")
    v = df.withColumn("v", code.verify_code(F.col("c"), F.lit("f"), F.lit(json.dumps(VISIBLE)), F.lit(json.dumps(HIDDEN)), True)).withColumn("m", code.code_components(F.col("c"), F.col("v")))
    a, b = v.select("m.*", code.code_score(F.col("m"), {"format": 0.5, "brevity": 0.25}).alias("score")).collect()
    assert (a.correct, a.format, a.score, b.correct, b.format, b.valid_expression, b.score) == (1, 1, 1.75, 0, 0, 0, 0.25)


def test_code_is_not_run_unless_asked(spark):
    assert code.judge_code("def f(x):\n    return x*2", "f", VISIBLE, HIDDEN)["correct"] is None
    assert code.no_hardcoding("def f(x):\n    if x == 2: return 4\n    return 6", VISIBLE) == 0.0
    df = spark.createDataFrame([("<answer>def f(x):\n    return x*2</answer>", "f", json.dumps(VISIBLE), json.dumps(HIDDEN)), (None, None, None, None)], "c string, n string, v string, h string")
    rows = df.select(code.verify_code(F.col("c"), F.col("n"), F.col("v"), F.col("h"), True).alias("r")).select("r.*").collect()
    assert rows[0].correct == 1 and rows[1].error == "no such function"


def test_word_counts_of_every_completion(spark, tmp_path):
    from evalmill import queries

    texts = {0: "two words", 1: "a\ttab", 2: "un café “noisette” ✓", 3: " \n ", 4: "", 5: None, 6: "no\u00a0break\u2003em\u3000wide", 7: "\x85next\u2028line ", 8: "每个数字"}
    spark.createDataFrame(list(texts.items()), "line_no long, completion string").write.parquet(str(tmp_path / "candidates.parquet"))
    got = {r.line_no: r.words for r in queries.QUERIES["word_counts"](spark, str(tmp_path)).collect()}
    assert got == {k: len(t.split()) for k, t in texts.items() if t is not None}
