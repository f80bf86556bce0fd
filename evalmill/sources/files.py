"""Files in and out: JSON lines with their order, id lists, digests, and results that are written once."""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterator
from pathlib import Path, PurePosixPath
from typing import NamedTuple

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The DDL of the entities that files hold.
TASKS = "id string, split string, difficulty string, numbers array<bigint>, target bigint, allowed_ops array<string>, solution string, prompt_low string, prompt_mid string, prompt_high string, prompt string, completion string, metadata struct<dataset_protocol:string,generator_version:string,n_numbers:int,source:string,proposal_seed:bigint,proposal_index:bigint,allocation_seed:bigint>"
REWARD_LOG = "id string, difficulty string, reward_batch_index int, reward double, primary_reward double, primary_reward_weighted double, aux_reward_weighted double, total_reward double, weights map<string,double>, components map<string,double>, expression string, value string, correct boolean, error string"
METRICS = ("contains_open_answer_tag", "contains_close_answer_tag", "has_extractable_answer_span", "format", "parse_ok", "expression_parseable", "uses_numbers", "uses_allowed_numbers", "number_precision", "number_recall", "number_multiset_f1", "uses_no_extra_numbers", "uses_all_required_numbers", "allowed_ops", "uses_allowed_ops", "operator_precision", "operator_recall", "evaluates_without_exception", "numeric_distance_reward", "valid_expression", "brevity", "correct", "exact_correct")


class LineError(ValueError):
    """A line is not what its file should hold."""


def ordered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line) of text files, numbered from 1 within each file; blank lines keep their number.

    Files are read in splits by many tasks. A first pass counts the lines of each split; the splits before it give each
    split its first number, and the place of a line in its split the rest.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("place"), F.col("value").alias("line"))
    splits = lines.groupBy("file", "at").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = splits.select("file", "at", "first", before.alias("before"))  # one row for each split
    return lines.join(starts, ["file", "at"]).select("file", (F.col("before") + F.col("place") - F.col("first") + 1).alias("line_no"), "line")


def json_lines(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """Rows of JSON lines with file and line_no; blank lines are skipped.

    Lines that are no JSON object give null rows with the line in ``_bad``; ``strict`` raises LineError at the first
    (an action). Without a need for the order, ``spark.read.schema(...).json`` scans in parallel.
    """
    lines = ordered_lines(spark, path).where("trim(line) <> ''")
    parsed = lines.select("file", "line_no", "line", F.from_json("line", f"{schema}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}).alias("row"))
    bad = F.when(F.col("row").isNull() | F.col("row._corrupt").isNotNull() | ~F.ltrim(F.col("line")).startswith("{"), F.col("line"))
    rows = parsed.select("file", "line_no", "row.*", bad.alias("_bad")).drop("_corrupt")
    if strict:
        odd = rows.where("_bad is not null").orderBy("file", "line_no").select("file", "line_no").first()
        if odd is not None:
            raise LineError(f"{odd['file']}:{odd['line_no']} is not a JSON object")
        rows = rows.drop("_bad")
    return rows


def id_list(spark: SparkSession, path: str, allow_empty: bool = True) -> DataFrame:
    """(pos, id) of a file with one id a line; blanks are dropped, a repeated id raises (an action over a small file)."""
    rows = ordered_lines(spark, path).select("line_no", F.trim("line").alias("id")).where("id <> ''")
    twice = rows.groupBy("id").count().where("count > 1").first()
    if twice is not None:
        raise LineError(f"{path}: {twice['id']!r} occurs {twice['count']} times")
    if not allow_empty and rows.isEmpty():
        raise LineError(f"{path} holds no ids")
    return rows.select(F.col("line_no").alias("pos"), "id")


def from_path(pattern: str, group: int = 1) -> Column:
    """A part of the path of the file that a row came from."""
    return F.regexp_extract(F.col("_metadata.file_path"), pattern, group)


def flatten(df: DataFrame, column: str = "metrics") -> DataFrame:
    """The fields of a struct column as columns; the table itself where there is none. Names that clash get a prefix."""
    if column not in df.columns:
        return df
    others = [c for c in df.columns if c != column]
    return df.select(*others, *(F.col(f"{column}.{f}").alias(f if f not in others else f"{column}_{f}") for f in df.schema[column].dataType.names))


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256, size, lines) of files; a last line without an end counts, an empty file has none.

    Paths are listed once and spread over the cluster; each file is read in pieces of 1 MiB, whatever its size.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for uri in b["path"]:
                fs, name = pafs.FileSystem.from_uri(uri if "://" in uri else "file://" + re.sub("^file:/*", "/", uri))
                digest, size, ends, last = hashlib.sha256(), 0, 0, b"\n"
                with fs.open_input_stream(name) as f:
                    while piece := f.read(1 << 20):
                        digest.update(piece)
                        size, ends, last = size + len(piece), ends + piece.count(b"\n"), piece[-1:]
                rows.append((re.sub("^file:/+", "/", uri), digest.hexdigest(), size, ends + (last != b"\n")))
            yield pd.DataFrame(rows, columns=["path", "sha256", "size", "lines"])

    paths = [f.path for f in file_sizes(spark, path)]
    listed = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, min(len(paths), 10_000)))
    return listed.mapInPandas(run, "path string, sha256 string, size long, lines long")


def nonempty(spark: SparkSession, path: str, pattern: str | None = None) -> list[str]:
    """The files that a path or pattern names and that hold anything, sorted; with a pattern, only those whose path it finds."""
    sized = [r.path for r in file_sizes(spark, path) if r.size]
    return sorted(p for p in sized if pattern is None or re.search(pattern, p))


def file_sizes(spark: SparkSession, path: str) -> list:
    """(path, size) of the files, from the file system alone."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [FileSize(re.sub("^file:/+", "/", x.getPath().toString()), x.getLen()) for m in fs.globStatus(at) or [] for x in fs.listStatus(m.getPath()) if x.isFile()]


class FileSize(NamedTuple):
    path: str
    size: int


def tree_digest(files: DataFrame, root: str, names: list[str] | None = None) -> DataFrame:
    """One digest of a folder: of its sorted (relative path, sha256), of the named files only where given."""
    rel = files.select(F.substring(F.col("path"), len(root.rstrip("/")) + 2, 1 << 20).alias("path"), "sha256")
    if names is not None:
        rel = rel.where(F.col("path").isin(*names))
    return rel.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "path", "sha256"))), "\n"), 256).alias("digest"), F.count(F.lit(1)).alias("files"))


def write_once(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Writes a folder that must not exist, whole or not at all: beside it first, then renamed, so a failed job leaves nothing in the way."""
    spark = df.sparkSession
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(target):
        raise FileExistsError(f"{path} exists")
    staged = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}.staged-{uuid.uuid4().hex}")
    try:
        df.write.format(kind).save(str(staged))
        if fs.exists(target) or not fs.rename(staged, target):
            raise FileExistsError(f"{path} exists")
    finally:
        fs.delete(staged, True)


def safe_output(path: str, allowed: tuple[str, ...]) -> str:
    """The path, whole, if it lies in one of the allowed folders; else OutputError. Links and .. are followed first."""
    whole = Path(path).resolve()
    roots = [Path(a).resolve() for a in allowed]
    if not any(root in whole.parents for root in roots):
        raise OutputError(f"{whole} is in none of {', '.join(map(str, roots))}")
    return str(whole)


class OutputError(ValueError):
    """A result would be written to a place that is not for results."""


def read_csv(spark: SparkSession, path: str, schema: str, where: dict[str, object] | None = None) -> DataFrame:
    """Rows of CSV files with a header, of the given schema, with the given values; a line that does not fit raises."""
    df = spark.read.schema(schema).option("header", "true").option("mode", "FAILFAST").option("enforceSchema", "false").csv(path)
    for column, value in (where or {}).items():
        df = df.where(F.col(column) == F.lit(value))
    return df


def json_object(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row for each file, which holds one JSON object, also over many lines; LineError names a file that does not (an action)."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    parsed = whole.select("file", F.schema_of_variant(F.try_parse_json("value")).startswith("OBJECT").alias("ok"), F.from_json("value", schema).alias("row"))
    odd = parsed.where("not coalesce(ok, false)").select("file").first()
    if odd is not None:
        raise LineError(f"{odd['file']} is not a JSON object")
    return parsed.select("file", "row.*")


def published(spark: SparkSession, path: str) -> bool:
    """Whether a folder was written whole."""
    jvm = spark.sparkContext._jvm
    marker = jvm.org.apache.hadoop.fs.Path(str(PurePosixPath(path) / "_SUCCESS") if "://" not in path else f"{path}/_SUCCESS")
    return marker.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(marker)


def write_json_lines(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """JSON lines with nulls kept; with ``order`` in one sorted sequence of files."""
    (df.orderBy(*order) if order else df).write.mode("errorifexists").option("ignoreNullFields", "false").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("header", "true").csv(path)


def report_json(df: DataFrame, most: int = 10_000) -> str:
    """A small report as JSON with sorted names and rows; more than ``most`` rows raise."""
    rows = [r.asDict(recursive=True) for r in df.limit(most + 1).collect()]
    if len(rows) > most:
        raise ValueError(f"a report has more than {most} rows")
    lines = sorted(json.dumps(r, sort_keys=True, ensure_ascii=False, default=str) for r in rows)
    return "[" + ",\n ".join(lines) + "]\n"


def report_markdown(df: DataFrame, most: int = 10_000) -> str:
    """A small report as a Markdown table."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report has more than {most} rows")
    show = lambda x: f"{x:.4g}" if isinstance(x, float) else "" if x is None else str(x)
    return "\n".join(["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns), *("| " + " | ".join(map(show, r)) + " |" for r in rows)]) + "\n"
