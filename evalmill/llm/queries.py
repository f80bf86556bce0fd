"""The queries p1 to p8 and, where SQL can say the same on whole tables, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from evalmill.llm import copies, garbling, leaks, pairs, splits, tokens, topn, truncation
from evalmill.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncated(table(spark, d, "candidates"), "line_no", "bank", "completion", "completion_token_count").select("line_no")


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncation_report(table(spark, d, "candidates"), "line_no", "bank", "completion", "completion_token_count")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return copies.hidden_copies(*(table(spark, d, t) for t in ("tasks", "candidates", "raw_records")))


def p2_counts(spark: SparkSession, d: str) -> DataFrame:
    return copies.copy_counts(*(table(spark, d, t) for t in ("tasks", "candidates", "raw_records")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return splits.split_overlap(table(spark, d, "tasks"))


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    return splits.split_overlap_report(table(spark, d, "tasks"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return topn.top_n(table(spark, d, "candidates"), "id", topn.practical_score(), ["candidate_index", "line_no"], 3)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.broken_pairs(table(spark, d, "tasks"), table(spark, d, "candidates"))


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    return pairs.defect_report(table(spark, d, "tasks"), table(spark, d, "candidates"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.token_ids(table(spark, d, "documents"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leak_report(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return garbling.garbled(table(spark, d, "documents")).select("doc_id")


def p8_restored(spark: SparkSession, d: str) -> DataFrame:
    return garbling.garbled(table(spark, d, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_report, p2_found, p2_counts, p3_found, p3_report, p4_found, p5_found, p5_report, p6_ids, p7_found, p7_report, p8_found, p8_restored)
}

_TASKS = """
WITH r AS (
  SELECT line_no, trim(lower(split), E' \\t\\n\\r') AS split, metadata.source AS source, target, list_sort(numbers) AS nums, list_sort(list_distinct(allowed_ops)) AS ops
  FROM tasks WHERE split IS NOT NULL AND target IS NOT NULL AND allowed_ops IS NOT NULL AND len(numbers) > 0
), t AS (
  SELECT line_no, x, count(*) AS c FROM (SELECT line_no, unnest(nums) AS x FROM r) GROUP BY ALL
), common AS (
  SELECT a.line_no AS a, b.line_no AS b, sum(least(ta.c, tb.c)) AS shared
  FROM r a JOIN r b ON a.target = b.target AND len(a.nums) = len(b.nums) AND a.split = 'train' AND b.split <> 'train'
  JOIN t ta ON ta.line_no = a.line_no JOIN t tb ON tb.line_no = b.line_no AND ta.x = tb.x GROUP BY ALL
), pairs AS (
  SELECT a.line_no AS train_line, b.line_no AS other_line, b.split, b.source, a.nums = b.nums AS exact
  FROM r a JOIN r b ON a.target = b.target AND len(a.nums) = len(b.nums) AND a.split = 'train' AND b.split <> 'train'
  LEFT JOIN common c ON c.a = a.line_no AND c.b = b.line_no
  WHERE a.nums = b.nums OR (a.ops = b.ops AND coalesce(c.shared, 0) = len(a.nums) - 1)
)"""

SQL: dict[str, str] = {
    "p3_found": _TASKS + " SELECT least(train_line, other_line) AS line_a, greatest(train_line, other_line) AS line_b FROM pairs",
    "p3_report": _TASKS
    + """ SELECT split, source, count(*) AS overlapping, count(*) FILTER (exact) AS exact, count(*) FILTER (NOT exact) AS almost
    FROM (SELECT other_line, split, source, bool_or(exact) AS exact FROM pairs GROUP BY ALL) GROUP BY split, source""",
    "p4_found": """
SELECT id, line_no FROM (
  SELECT id, line_no, row_number() OVER (PARTITION BY id ORDER BY
    3 * v(metrics.valid_expression) + 2 * v(metrics.uses_allowed_numbers) + 1.5 * v(metrics.number_multiset_f1) + v(metrics.uses_allowed_ops)
      + v(metrics.numeric_distance_reward) - 2 * v(metrics.reward_hacking_candidate) DESC, candidate_index ASC NULLS LAST, line_no ASC) AS r
  FROM candidates) WHERE r <= 3""",
}
for _f in ("valid_expression", "uses_allowed_numbers", "number_multiset_f1", "uses_allowed_ops", "numeric_distance_reward", "reward_hacking_candidate"):
    # by way of text, since file statistics may claim that there is no NaN
    SQL["p4_found"] = SQL["p4_found"].replace(f"v(metrics.{_f})", f"coalesce(try_cast(nullif(metrics.{_f}::VARCHAR, 'nan') AS DOUBLE), 0.0::DOUBLE)")
