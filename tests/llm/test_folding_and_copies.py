import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from evalmill.llm import copies, folding

ALPHABET = "aB1.2 \t\n ​\"'`$,;:!?(+*)-=/“”Éé中"


def brute(text):
    text = re.sub(r"(?<![0-9])\.|\.(?![0-9])", "", text)
    return "".join(c for c in text.lower() if not c.isspace() and unicodedata.category(c) not in ("Cf", "Cc", "Zs") and c not in "\"'`$,;:!?“”")


@settings(max_examples=300, deadline=None)
@given(st.text(ALPHABET, max_size=30), st.text(ALPHABET, max_size=30))
def test_hash_and_comparison_agree_with_canonical_strings(a, b):
    assert folding.same(a, b) == (brute(a) == brute(b))
    assert folding.folded(a) == brute(a)
    if brute(a) == brute(b):
        assert folding.fold_hash(a) == folding.fold_hash(b)


def test_equal_with_formatting_equal_hash():
    for a, b in [("(1 + 2)", "(1+2)"), ("“ABC”,", "abc"), ("x = 0.5.", "x=0.5"), ("a b", "ab"), ("É", "é")]:
        assert folding.same(a, b) and folding.fold_hash(a) == folding.fold_hash(b)
    for a, b in [("0.5", "05"), ("1+2", "1-2"), ("ab", "ba")]:
        assert not folding.same(a, b) and folding.fold_hash(a) != folding.fold_hash(b)


def test_batches_hash_as_single_strings_do():
    texts = ["", None, "x" * 5000, "é", "(1+2)", " . ", "1.5", ".", "5.", ".5", "1.", "2"]
    got = folding.fold_hashes(pa.array(texts))
    assert [int(x) for x in got] == [0 if t is None else folding.fold_hash(t) for t in texts]
    sliced = folding.fold_hashes(pa.array(texts).slice(3, 5))
    assert [int(x) for x in sliced] == [folding.fold_hash(t) for t in texts[3:8]]
    assert len(folding.fold_hashes(pa.array([], pa.string()))) == 0


def test_pieces_are_cut_by_size(monkeypatch):
    from evalmill.llm import batches

    assert batches.cuts(np.array([3, 3, 10, 0, 1, 7]), 8) == [(0, 2), (2, 1), (3, 3)] and batches.cuts(np.array([]), 8) == []
    table = pa.RecordBatch.from_pydict({"t": ["ab", None, "c" * 20, "", "d"], "k": [1, 2, 3, 4, 5]})
    assert [p.column("k").to_pylist() for p in batches.pieces([table, table.slice(0, 0)], "t", 8)] == [[1, 2], [3], [4, 5]]
    texts = pa.array(["(1+2)", None, "x" * 3000, "é", ""] * 7)
    whole = folding.fold_hashes(texts)
    monkeypatch.setattr(folding, "cuts", lambda lengths: batches.cuts(lengths, 64))
    assert (folding.fold_hashes(texts) == whole).all()


def test_json_by_content():
    a = '{"id": "T 1", "m": {"x": 1, "y": [1, 2]}}'
    b = '{"M": {"Y": [1.0, 2], "X": 1.0},\n"Id": "t1."}'
    assert folding.same_json(a, b) and folding.json_hashes([a]) == folding.json_hashes([b])
    for other in ['{"id": "T 1", "m": {"x": true, "y": [1, 2]}}', '{"id": "T 1", "m": {"x": 1, "y": [2, 1]}}', '{"id": "T 1", "m": {"x": "1", "y": [1, 2]}}', '{"id": "T 1"}']:
        assert not folding.same_json(a, other) and folding.json_hashes([a]) != folding.json_hashes([other])
    assert folding.json_hashes(["{", None, "", '{"a": NaN}', '{"a": 1} x']) == [None] * 5
    assert folding.folded_json(folding.parse_json(a)[1]) == folding.folded_json(folding.parse_json(b)[1])


SCHEMA = "line_no long, bank string, id string, metrics struct<f:double,expression:string,value:string>, k long, `first` string"


def rows(spark, data):
    return spark.createDataFrame([(i, b, t, m, 1, "x") for i, (b, t, m) in enumerate(data)], SCHEMA)


def test_candidates_nulls_nan_and_clashing_columns(spark):
    nan = float("nan")
    df = rows(spark, [("b", "t", (nan, "(1+2)", None)), ("b", "t", (nan, "( 1 + 2 ).", None)), ("b", "t", (None, "(1+2)", None)), ("b", "t", (0.0, "(1+2)", None)), ("b", "t", (-0.0, "(1+2)", None)), ("b", "t", None), ("b", "t", None), ("b", "t", (1.0, None, "3")), ("c", "t", (nan, "(1+2)", None)), (None, None, (1.0, "z", "")), (None, None, (1.0, "Z", " "))])
    got = {tuple(r) for r in copies.candidate_copies(df).collect()}
    assert got == {(0, 1), (3, 4), (9, 10)}


def test_a_full_stop_at_the_end_of_a_text_is_no_decimal_point(spark):
    df = rows(spark, [("b", "t", (1.0, "3+4*5.", "23")), ("b", "t", (1.0, "3+4*5", "23")), ("b", "t", (1.0, "3+4*5", ".23")), ("b", "t", (1.0, "3+4*52", "3"))])
    assert {tuple(r) for r in copies.candidate_copies(df).collect()} == {(0, 1), (0, 2)}


def test_tasks_and_raw(spark):
    tasks = spark.createDataFrame(
        [(0, [1, 2], 3, ["+", "+"], "(1+2)"), (1, [2, 1], 3, ["+"], "( 1+2 );"), (2, [2, 1], 3, ["-"], "(1+2)"), (3, None, 3, ["+"], "(1+2)"), (4, [], 3, [], ""), (5, [], 3, [], "  ")],
        "line_no long, numbers array<long>, target long, allowed_ops array<string>, solution string",
    )
    assert {tuple(r) for r in copies.task_copies(tasks).collect()} == {(0, 1), (4, 5)}
    line = {"id": "a", "solution": "(1+2)", "metrics": {"correct": 1}}
    raw = spark.createDataFrame(
        [(7, "b", json.dumps(line)), (3, "b", '{"Metrics":{"correct":1.0},"solution":" (1+2) ","ID":"A"}'), (4, "c", json.dumps(line)), (5, "b", json.dumps(line)[:-3]), (6, "b", None), (8, "b", json.dumps(line)[:-3])],
        "line_no long, bank string, line string",
    )
    assert {tuple(r) for r in copies.raw_copies(raw).collect()} == {(3, 7)}


def test_collisions_are_told_apart(spark, monkeypatch):
    """Rows with one key but different contents are grouped by content."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(0, "a"), (1, "b"), (2, "B"), (3, "A "), (4, "b."), (5, "c")], "line_no long, t string")
    monkeypatch.setattr(copies, "_key", lambda c, is_json: F.lit(1).cast("long"))
    got = {tuple(r) for r in copies.formatting_copies(df, "line_no", [], [F.col("t")]).collect()}
    assert got == {(0, 3), (1, 2), (1, 4)}


def test_collisions_in_a_hot_key(spark, monkeypatch):
    """The same where a key is split: parts begin with rows of either content."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(copies, "HOT", 5)
    texts = [("a", "A ", "b", "b.", "c", "B", "a.")[i % 7] for i in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "line_no long, t string")
    monkeypatch.setattr(copies, "_key", lambda c, is_json: F.lit(1).cast("long"))
    firsts, expected = {}, set()
    for i, t in enumerate(texts):
        f = firsts.setdefault(folding.folded(t), i)
        expected |= {(f, i)} if f != i else set()
    assert {tuple(r) for r in copies.formatting_copies(df, "line_no", [], [F.col("t")]).collect()} == expected


def test_empty_tables_and_hot_group(spark, monkeypatch):
    monkeypatch.setattr(copies, "HOT", 100)
    df = rows(spark, [])
    assert copies.candidate_copies(df).count() == 0
    hot = rows(spark, [("b", "t", (1.0, "x" + " " * (i % 5), None)) for i in range(3000)])
    got = copies.candidate_copies(hot)
    assert got.count() == 2999 and {r[0] for r in got.select("first_line").distinct().collect()} == {0}
