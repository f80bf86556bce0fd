import hashlib
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from evalmill.session import checkpoint_dir
from evalmill.sources import files

ROOT = Path(__file__).resolve().parents[1]


def test_json_lines_keep_their_order(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"id": "x", "n": 1}\n\n{"id": "y"}\n[1]\nnot json\n{"id": "z w", "n": null}')
    rows = files.json_lines(spark, str(p), "id string, n int").orderBy("line_no").collect()
    assert [(r.line_no, r.id, r.n, r._bad) for r in rows] == [(1, "x", 1, None), (3, "y", None, None), (4, None, None, "[1]"), (5, None, None, "not json"), (6, "z w", None, None)]
    with pytest.raises(files.LineError, match=":4 "):
        files.json_lines(spark, str(p), "id string, n int", strict=True)
    p.write_text('{"id": "x"}\n')
    assert files.json_lines(spark, str(p), "id string", strict=True).columns == ["file", "line_no", "id"]


def test_id_lists(spark, tmp_path):
    p = tmp_path / "ids.txt"
    p.write_text(" b \n\na\n")
    assert [(r.pos, r.id) for r in files.id_list(spark, str(p)).orderBy("pos").collect()] == [(1, "b"), (3, "a")]
    p.write_text("a\nb\na\n")
    with pytest.raises(files.LineError, match="2 times"):
        files.id_list(spark, str(p))
    p.write_text("\n")
    assert files.id_list(spark, str(p)).count() == 0
    with pytest.raises(files.LineError, match="no ids"):
        files.id_list(spark, str(p), allow_empty=False)


def test_digests_and_write_once(spark, tmp_path):
    (tmp_path / "d").mkdir()
    for name, text in (("a", "x\ny"), ("b", "x\n"), ("c", "")):
        (tmp_path / "d" / name).write_text(text)
    d = files.digests(spark, str(tmp_path / "d"))
    got = {Path(r.path).name: (r.sha256, r.size, r.lines) for r in d.collect()}
    assert got == {n: (hashlib.sha256(t.encode()).hexdigest(), len(t), k) for n, t, k in (("a", "x\ny", 2), ("b", "x\n", 1), ("c", "", 0))}
    t = files.tree_digest(d, str(tmp_path / "d"), ["a", "b"]).first()
    assert t.files == 2 and t == files.tree_digest(d, str(tmp_path / "d"), ["b", "a"]).first()
    df = spark.createDataFrame([(1, None), (2, "x,y")], "a int, b string")
    files.write_once(df, str(tmp_path / "out"))
    assert files.published(spark, str(tmp_path / "out")) and not files.published(spark, str(tmp_path / "none"))
    with pytest.raises(Exception, match="exists"):
        files.write_once(df, str(tmp_path / "out"))
    files.write_json_lines(df, str(tmp_path / "j"), ["a"])
    assert "".join(p.read_text() for p in sorted((tmp_path / "j").glob("part*"))) == '{"a":1,"b":null}\n{"a":2,"b":"x,y"}\n'
    files.write_csv(df, str(tmp_path / "v"))
    assert spark.read.csv(str(tmp_path / "v"), header=True).count() == 2
    assert files.report_markdown(df) == "| a | b |\n|---|---|\n| 1 |  |\n| 2 | x,y |\n"
    assert files.report_json(df) == '[{"a": 1, "b": null},\n {"a": 2, "b": "x,y"}]\n'


def test_flatten(spark):
    df = spark.createDataFrame([(1, (2, 3))], "a int, metrics struct<a:int,b:int>")
    assert files.flatten(df).columns == ["a", "metrics_a", "b"] and files.flatten(df.drop("metrics")).columns == ["a"]
    assert spark.range(1).select(F.lit(1)).count() == 1


def test_checkpoint_folder_is_one_of_our_own_only_where_none_is_given(spark):
    assert Path(checkpoint_dir(spark).removeprefix("file:")).exists()


def test_entry_contract(spark, tmp_path):
    import __spark_entry__ as e

    queries, sql = e.queries(), e.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 60
    df = e.entry(spark)
    assert df.count() == 3 and df.columns[0] == "n"


def test_the_rest_does_not_need_the_llm_subpackage():
    code = "import sys; sys.modules['evalmill.llm'] = None\nimport __spark_entry__ as e, pkgutil, importlib, evalmill\n[importlib.import_module(m.name) for m in pkgutil.walk_packages(evalmill.__path__, 'evalmill.') if '.llm' not in m.name]\nassert e.queries() and not any(q.startswith('p1_') for q in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
    assert not [p for p in (ROOT / "evalmill").rglob("*.py") if "llm" not in p.parts and "evalmill.llm" in p.read_text()]
