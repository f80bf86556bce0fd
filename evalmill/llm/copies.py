"""Records that are the same but for formatting, in groups with their number of copies.

1. Every row gets a 64-bit key: the engine's hash of the columns compared by value, joined with a polynomial hash
   of the texts, streamed through a skip-and-fold table. Keyed rows are written once; nothing is hashed again.
2. Keys are counted with partial aggregation, so that a key of any frequency shrinks before the shuffle.
3. Rows of keys that occur more than once meet by key, very frequent keys in parts. Rows are compared with the first of
   their part: values by equality, texts with two pointers that skip what does not count. The firsts of the parts of a
   key are compared with the first of the key in the same way.
4. Rows that share a key with a row they differ from (a collision) are grouped by their folded content instead.

Rows of several tables go through one plan; ``tab`` keeps them apart.
"""

from __future__ import annotations

import hashlib
import json as jsonlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalmill.llm import folding
from evalmill.session import written

#: Rows of one key that one task compares, about; keys with more are split. No more than MOST_HOT keys are: beyond
#: that many rows, tasks take more of one key each.
HOT, MOST_HOT = 100_000, 4096


@F.pandas_udf(T.LongType())
def _key(texts: pd.Series, is_json: pd.Series) -> pd.Series:
    """Hashes of the texts of a row, joined; of JSON its content, null where it is not whole."""
    out = folding.fold_hashes(pa.array(texts, pa.large_string())).view(np.int64).tolist()
    lines = np.flatnonzero(is_json.to_numpy(dtype=bool))
    for i, h in zip(lines, folding.json_hashes([texts.iat[i] for i in lines]), strict=True):
        out[i] = None if h is None else h - (1 << 64) if h >= 1 << 63 else h
    return pd.Series(out, dtype="Int64")


@F.pandas_udf(T.StringType())
def _difference(same_values: pd.Series, texts: pd.Series, first: pd.Series, is_json: pd.Series) -> pd.Series:
    """Null if a row is the same as the first of its key, else a digest of its folded texts."""

    def one(ok, a, b, line):
        if ok and all(map(folding.same_json if line else folding.same, a, b)):
            return None
        content = [None if t is None else folding.folded_json(folding.parse_json(t)[1]) if line else folding.folded(t) for t in a]
        return hashlib.sha256(jsonlib.dumps(content).encode()).hexdigest()

    return pd.Series([one(*x) for x in zip(same_values, texts, first, is_json, strict=True)], dtype=object)


def _value(c: Column, kind: T.DataType) -> Column:
    """A value as text that is equal for equal values: null for null, NaN for NaN, one zero."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        c = c + F.lit(0.0)
    return F.coalesce((F.to_json(c) if isinstance(kind, (T.ArrayType, T.StructType, T.MapType)) else c.cast("string")), F.lit("\u0001"))


def prepared(df: DataFrame, tab: str, line: str, values: list[Column], texts: list[Column], json: Column | None = None) -> DataFrame:
    """(tab, line, vals, texts, is_json): the rows of a table as ``find_copies`` takes them."""
    v = df.select(*(c.alias(f"v{i}") for i, c in enumerate(values))).schema.fields
    vals = F.concat_ws("\u0002", *(_value(c, f.dataType) for c, f in zip(values, v, strict=True))) if values else F.lit("")
    return df.select(F.lit(tab).alias("tab"), F.col(line).cast("long").alias("line"), vals.alias("vals"), F.array(*([json] if json is not None else texts)).alias("texts"), F.lit(json is not None).alias("is_json"))


def _compared(df: DataFrame, other: str) -> DataFrame:
    """Adds ``differs``: null if a row is the same as the row in the struct ``other``, else a digest of its content."""
    same_values = (F.col("vals") == F.col(f"{other}.vals")) & (F.col("tab") == F.col(f"{other}.tab"))
    return df.withColumn("differs", F.when(F.col("line") != F.col(f"{other}.line"), _difference(same_values, F.col("texts"), F.col(f"{other}.texts"), F.col("is_json"))))


def find_copies(rows: DataFrame) -> DataFrame:
    """(tab, first_line, copy_line) of all rows that are the same up to formatting, of ``prepared`` rows.

    Writes the keyed rows when it is called (see ``session.written``).
    """
    # between two texts stands a sign that counts, so that no full stop comes between digits of both
    joined = F.when(F.size("texts") == 1, F.col("texts")[0]).otherwise(F.array_join("texts", "="))
    hashed = rows.withColumn("h", _key(joined, F.col("is_json"))).where("h is not null or not is_json")
    keyed = written(hashed.withColumn("key", F.xxhash64("tab", "vals", "h")).drop("h"), "copies")
    hot_from = max(HOT, -(-keyed.count() // MOST_HOT))
    groups = keyed.groupBy("key").agg(F.min("line").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    groups = groups.select("key", "first", F.ceil(F.col("n") / hot_from).cast("int").alias("parts"))
    hot = F.broadcast(groups.where("parts > 1").select("key", F.col("parts").alias("cut")))  # MOST_HOT rows at most
    salted = keyed.join(hot, "key", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("line"), F.col("cut")).cast("int"), F.lit(0))).drop("cut")
    spread = groups.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    members = salted.join(spread, ["key", "part"])
    row = F.struct("line", "tab", "vals", "texts")
    in_part = Window.partitionBy("key", "part").orderBy("line")  # of one part at most; the join has sorted it nearly so
    seen = _compared(members.withColumn("lead", F.first(row).over(in_part)), "lead")
    content = lambda digest: F.when(digest.isNotNull(), F.concat_ws("\u0002", digest, F.col("tab"), F.col("vals")))
    light = seen.select("key", "part", "tab", "line", "first", content(F.col("differs")).alias("own"))
    # the leads of the parts of a hot key against the first row of the key: MOST_HOT keys with MOST_HOT parts at most
    leads = members.where("parts > 1").groupBy("key", "part").agg(F.min_by(F.struct("line", "tab", "vals", "texts", "is_json"), "line").alias("l"), F.min("first").alias("first")).select("key", "part", "first", "l.*")
    digest = _difference(F.lit(False), F.col("texts"), F.col("texts"), F.col("is_json"))
    origin = leads.where("line = first").select("key", row.alias("origin"), content(digest).alias("origin_content"))
    settled = _compared(leads.join(origin, "key"), "origin").select("key", "part", content(F.col("differs")).alias("of_lead"), "origin_content")
    placed = light.join(settled, ["key", "part"], "left").withColumn("content", F.nullif(F.coalesce("own", "of_lead"), F.col("origin_content")))
    # rows that are the same as the first of their key stand alone here; those that differ from it meet their likes
    apart = F.when(F.col("content").isNull(), F.concat_ws("\u0002", "tab", F.col("line").cast("string"))).otherwise(F.col("content"))
    likes = Window.partitionBy("key", "apart")
    found = placed.withColumn("apart", F.sha2(apart, 256)).withColumn("first", F.when(F.col("content").isNull(), F.col("first")).otherwise(F.min("line").over(likes)))
    return found.where("line <> first").select("tab", F.col("first").alias("first_line"), F.col("line").alias("copy_line"))


def formatting_copies(df: DataFrame, line: str, values: list[Column], texts: list[Column], json: Column | None = None) -> DataFrame:
    """(first_line, copy_line) of all rows of one table that are the same up to formatting.

    ``values`` are compared by value (null equals null, NaN equals NaN), ``texts`` up to white space, invisible
    characters, letter case and decorative punctuation (null equals null), ``json`` (instead of texts) as JSON content
    up to formatting and field order. ``line`` is a unique integer column.

    Defined cases: lines that are not whole JSON, or null, are no case; empty and blank texts are equal to each
    other; in JSON a name that occurs twice in an object counts twice; an empty table gives no rows; columns are
    used only as given, other columns and their names play no role. Filter rows that are no case beforehand.
    """
    return find_copies(prepared(df, "", line, values, texts, json)).drop("tab")


def _tasks(tasks: DataFrame) -> DataFrame:
    whole = tasks.where("numbers is not null and target is not null and allowed_ops is not null and solution is not null")
    return prepared(whole, "tasks", "line_no", [F.array_sort("numbers"), F.col("target"), F.array_sort(F.array_distinct("allowed_ops"))], [F.col("solution")])


def _candidates(candidates: DataFrame) -> DataFrame:
    whole = candidates.where("metrics is not null and metrics.expression is not null")
    fields = whole.schema["metrics"].dataType.fields
    text = [f.name for f in fields if isinstance(f.dataType, T.StringType)]
    values = [F.col("bank"), F.col("id"), *(F.col(f"metrics.{f.name}") for f in fields if f.name not in text)]
    return prepared(whole, "candidates", "line_no", values, [F.col(f"metrics.{x}") for x in text])


def _raw(raw: DataFrame) -> DataFrame:
    return prepared(raw.where("line is not null"), "raw_records", "line_no", [F.col("bank")], [], F.col("line"))


def task_copies(tasks: DataFrame) -> DataFrame:
    """Copies among tasks: the same multiset of numbers, target, set of operators and solution up to formatting."""
    return find_copies(_tasks(tasks)).drop("tab")


def candidate_copies(candidates: DataFrame) -> DataFrame:
    """Copies among candidates: the same bank, id and all fields of metrics, strings up to formatting."""
    return find_copies(_candidates(candidates)).drop("tab")


def raw_copies(raw: DataFrame) -> DataFrame:
    """Copies among raw lines: the same bank and the same JSON content up to formatting."""
    return find_copies(_raw(raw)).drop("tab")


def hidden_copies(tasks: DataFrame, candidates: DataFrame, raw: DataFrame) -> DataFrame:
    """(tab, first_line, copy_line) over the three tables."""
    return find_copies(_tasks(tasks).unionByName(_candidates(candidates)).unionByName(_raw(raw)))


def copy_counts(tasks: DataFrame, candidates: DataFrame, raw: DataFrame) -> DataFrame:
    """(tab, first_line, copies) of every record that has copies; copies counts the record itself."""
    return hidden_copies(tasks, candidates, raw).groupBy("tab", "first_line").agg((F.count(F.lit(1)) + 1).alias("copies"))
