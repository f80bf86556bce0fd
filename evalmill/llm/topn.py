"""The N best rows of every group, by bounded heaps that are merged across tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.internal import InternalFunction

#: The weights of the practical score, added in this order.
WEIGHTS = (
    ("valid_expression", 3.0),
    ("uses_allowed_numbers", 2.0),
    ("number_multiset_f1", 1.5),
    ("uses_allowed_ops", 1.0),
    ("numeric_distance_reward", 1.0),
    ("reward_hacking_candidate", -2.0),
)


def practical_score(metrics: str = "metrics") -> Column:
    """Weighted sum over a metrics struct; null, NaN and a null struct count as 0.

    >>> # df.withColumn("score", practical_score())
    """
    total = None
    for field, weight in WEIGHTS:
        term = F.coalesce(F.nanvl(F.col(f"{metrics}.{field}"), F.lit(0.0)), F.lit(0.0)) * F.lit(weight)
        total = term if total is None else total + term
    return total


def _heap(entry: Column, n: int) -> Column:
    """Spark's own bounded priority queue, of the n lowest entries: partial heaps before the shuffle, merged after it."""
    return InternalFunction._invoke_internal_function_over_columns("collect_top_k", entry, F.lit(n), F.lit(True))


def top_n(df: DataFrame, group: str, score: Column, ties: list[str], n: int = 3, keep: list[str] | None = None) -> DataFrame:
    """The ``n`` rows of each ``group`` with the highest ``score``; ties go to the lower ``ties`` columns, in order.

    A heap holds at most n entries for a group and task, so a group of any size, also one with a third of all
    rows, sends n entries from each task; nothing is windowed over whole groups. Ties may be of any type that can be
    ordered, texts too; the last of them must be unique for the result to be determined. A task with more groups than
    ``spark.sql.objectHashAggregate.sortBased.fallbackThreshold`` goes on with sorted groups, which spill.

    Defined cases: a null score or NaN counts as the lowest; a null in a tie column loses to every value; a null
    group is a group of its own; groups with fewer than n rows come out whole; an empty table gives no rows;
    other columns of ``df``, whatever their names, are not read. ``keep`` names the columns returned beside the
    group (by default the last of ``ties``); they must be among ``ties``.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    keep = keep if keep is not None else ties[-1:]
    if unknown := set(keep) - set(ties):
        raise ValueError(f"keep must be among ties: {sorted(unknown)}")
    entry = F.struct(
        (-F.coalesce(F.nanvl(score.cast("double"), F.lit(None)), F.lit(float("-inf")))).alias("s"),
        *(x for i, c in enumerate(ties) for x in (F.col(c).isNull().alias(f"n{i}"), F.col(c).alias(f"t{i}"))),
    )
    heaps = df.select(F.col(group).alias("g"), entry.alias("e")).groupBy("g").agg(_heap(F.col("e"), n).alias("top"))
    best = heaps.select("g", F.explode("top").alias("e"))
    at = {c: i for i, c in enumerate(ties)}
    return best.select(F.col("g").alias(group), *(F.col(f"e.t{at[c]}").alias(c) for c in keep))


def top_n_by_window(df: DataFrame, group: str, score: Column, ties: list[str], n: int = 3) -> DataFrame:
    """The same rows by a ranking window, for comparison in tests; it sorts whole groups."""
    s = F.coalesce(F.nanvl(score.cast("double"), F.lit(None)), F.lit(float("-inf")))
    w = Window.partitionBy(group).orderBy(s.desc(), *(F.col(c).asc_nulls_last() for c in ties))
    return df.withColumn("_rank", F.row_number().over(w)).where(f"_rank <= {int(n)}").select(group, ties[-1])
