"""Paired and clustered tests as Spark plans.

Resampling takes whole tasks, by numbers that are hashed from seed, draw and task: draws spread over the cluster, are
added up where the tasks are, and come out the same anywhere.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

def mcnemar_p(b: Column, c: Column) -> Column:
    """Exact two-sided McNemar p of the discordant counts; 1 without any. For more than 1000 see ``mcnemar_large``."""
    n, k = (b + c).cast("long"), F.least(b, c).cast("int")
    start = F.struct(F.pow(F.lit(0.5), n.cast("double")).alias("p"), F.lit(0.0).alias("s"))
    folded = F.aggregate(F.sequence(F.lit(0), k), start, lambda a, i: F.struct((a.p * (n - i) / (i + 1)).alias("p"), (a.s + a.p).alias("s")))
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * folded.s))


@F.pandas_udf(T.DoubleType())
def mcnemar_large(b: pd.Series, c: pd.Series) -> pd.Series:
    """The same by log-gamma, for counts of any size."""

    def p(x: int, y: int) -> float:
        n = x + y
        logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2) for i in range(min(x, y) + 1)]
        return min(1.0, 2 * math.fsum(map(math.exp, logs)))

    return pd.Series([p(int(x), int(y)) for x, y in zip(b, c, strict=True)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def _erfc(x: pd.Series) -> pd.Series:
    return x.map(math.erfc)


def two_proportion_p(k1: Column, n1: Column, k2: Column, n2: Column) -> Column:
    """Pooled two-sided z-test; 1 where a side is empty or nothing varies."""
    pooled = F.try_divide(k1 + k2, n1 + n2)
    se = F.sqrt(pooled * (1 - pooled) * (F.try_divide(F.lit(1), n1) + F.try_divide(F.lit(1), n2)))
    z = F.try_divide(F.try_divide(k1, n1) - F.try_divide(k2, n2), se)
    return F.coalesce(F.when((F.least(n1, n2) > 0) & (se > 0), _erfc(F.coalesce(F.abs(z), F.lit(0.0)) / math.sqrt(2))), F.lit(1.0))


def holm(df: DataFrame, p: str = "p", name: str = "name", level: float = 0.05, by: list[str] | None = None) -> DataFrame:
    """Adds ``adjusted`` and ``reject``: step-down by (p, name); a p outside [0, 1] raises. Families are small."""
    by = by or []
    order = Window.partitionBy(*by).orderBy(p, name) if by else Window.orderBy(p, name)
    every = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    checked = F.when(F.col(p).between(0, 1), F.col(p)).otherwise(F.raise_error(F.lit("a p value is missing or outside [0, 1]")))
    step = F.least(F.lit(1.0), (F.count(F.lit(1)).over(every) - F.row_number().over(order) + 1) * checked)
    ranked = df.withColumn("_step", step)
    return ranked.withColumn("adjusted", F.max("_step").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("reject", F.col("adjusted") < level).drop("_step")


def percentile_interval(df: DataFrame, value: str, by: list[str] | None = None, confidence: float = 0.95) -> DataFrame:
    """Linear percentiles at both ends of the central ``confidence``; exact, by merging value counts."""
    a = (1 - confidence) / 2
    ends = F.percentile(value, F.array(F.lit(a), F.lit(1 - a)))
    return df.groupBy(*(by or [])).agg(ends.alias("e")).select(*(by or []), F.col("e")[0].alias("low"), F.col("e")[1].alias("high"))


def _uniform(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) that depends on the seed and the parts only: the first 32 bits of an MD5."""
    text = F.concat_ws(":", F.lit(str(seed)), *(p.cast("string") for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / float(1 << 32)


#: Distribution function of the Poisson distribution with mean 1, at 0, 1, 2, ...; less than 2^-32 is left above it.
POISSON = tuple(sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(12))


def _poisson(u: Column) -> Column:
    """How often a unit is drawn, for a uniform number."""
    out = F.when(u < POISSON[0], 0)
    for k, p in enumerate(POISSON[1:], 1):
        out = out.when(u < p, k)
    return out.otherwise(len(POISSON)).cast("double")


def _draws(rows: DataFrame, draws: int) -> DataFrame:
    return rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))


def task_bootstrap(panel: DataFrame, key: str, values: list[str], draws: int = 2000, seed: int = 17, by: list[str] | None = None) -> DataFrame:
    """(by, draw, weight, one column for each value): weighted sums of whole-task resamples.

    In each draw a task counts as often as a Poisson number with mean 1, hashed from seed, draw and task, says; the
    same task counts alike in all groups, so that groups stay comparable. Draws are added up where the tasks are and
    only one row for each group and draw leaves a task of the cluster; no panel is ever gathered. Null values are no
    observation of their task.
    """
    by = by or []
    w = _poisson(_uniform(seed, F.col("draw"), F.col(key)))
    rows = _draws(panel.select(*by, key, *(F.col(v).cast("double").alias(v) for v in values)), draws).withColumn("_w", w)
    return rows.groupBy(*by, "draw").agg(F.sum("_w").alias("weight"), *(F.sum(F.col("_w") * F.col(v)).alias(v) for v in values))


def _interval(values: DataFrame, value: str, by: list[str], confidence: float) -> DataFrame:
    return percentile_interval(values.where(F.col(value).isNotNull()), value, by, confidence)


def _joined(df: DataFrame, others: list[DataFrame], by: list[str]) -> DataFrame:
    """Small tables of one row a group, joined on groups that may be null; without groups all have one row."""
    for i, other in enumerate(others):
        if not by:
            df = df.crossJoin(F.broadcast(other))  # one row each
            continue
        renamed = other.select(*(F.col(c).alias(f"_{i}_{c}") for c in by), *[c for c in other.columns if c not in by])
        on = [df[c].eqNullSafe(F.col(f"_{i}_{c}")) for c in by]
        df = df.join(renamed, on, "left").drop(*(f"_{i}_{c}" for c in by))
    return df


def sign_flips(panel: DataFrame, key: str, effect: str, draws: int = 2000, seed: int = 17, by: list[str] | None = None, exact_most: int = 20) -> DataFrame:
    """(by, nonzero, assignments, p): how often random signs of the tasks' effects give a sum as far from 0 as observed.

    Effects of at most 1e-15 are left out; without any p is 1. Groups of up to ``exact_most`` effects try every
    assignment (p is their share), larger ones ``draws`` hashed ones, p being (extreme + 1) / (draws + 1).
    """
    by, e = by or [], F.col(effect).cast("double")
    rows = panel.select(*by, key, e.alias("_e"))
    sizes = rows.groupBy(*by).agg(F.count_if(F.abs("_e") > 1e-15).cast("int").alias("nonzero"), F.abs(F.sum(F.when(F.abs("_e") > 1e-15, F.col("_e")).otherwise(0.0))).alias("_seen"))
    known = _joined(rows.where(F.abs("_e") > 1e-15), [sizes], by)
    extreme = F.count_if(F.abs("_total") >= F.col("_seen") - 1e-12)
    few = known.where(F.col("nonzero") <= exact_most).groupBy(*by, "_seen").agg(F.array_sort(F.collect_list("_e")).alias("_all"))  # at most exact_most
    codes = few.select(*by, "_seen", "_all", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("shiftleft(1L, size(_all)) - 1"))).alias("_code"))
    total = F.aggregate(F.transform("_all", lambda x, i: x * (1 - 2 * F.getbit(F.col("_code"), i).cast("int"))), F.lit(0.0), lambda a, x: a + x)
    exact = codes.withColumn("_total", total).groupBy(*by).agg(F.count(F.lit(1)).alias("assignments"), (extreme / F.count(F.lit(1))).alias("p"))
    sign = F.when(_uniform(seed, F.lit("sign"), F.col("draw"), F.col(key)) < 0.5, -1.0).otherwise(1.0)
    drawn = _draws(known.where(F.col("nonzero") > exact_most), draws).groupBy(*by, "_seen", "draw").agg(F.sum(F.col("_e") * sign).alias("_total"))
    many = drawn.groupBy(*by).agg(F.count(F.lit(1)).alias("assignments"), ((extreme + 1) / (F.count(F.lit(1)) + 1)).alias("p"))
    out = _joined(sizes, [exact.unionByName(many)] if by else [exact.where("assignments > 0").unionByName(many.where("assignments > 0")).groupBy().agg(F.max("assignments").alias("assignments"), F.max("p").alias("p"))], by)
    return out.select(*by, "nonzero", F.coalesce("assignments", F.lit(1)).alias("assignments"), F.coalesce("p", F.lit(1.0)).alias("p"))


def clustered_difference(panel: DataFrame, key: str, arm: str, base: str, draws: int = 2000, seed: int = 17, by: list[str] | None = None, confidence: float = 0.95) -> DataFrame:
    """(by, tasks, estimate, low, high, nonzero, assignments, p): difference of task means, with whole tasks resampled and flipped.

    ``panel`` has one row for each task (and group) with both values; a missing or infinite one raises.
    """
    by, bad = by or [], "a value of the panel is missing or infinite"
    ok = lambda c: F.when(F.abs(F.col(c).cast("double")) < float("inf"), F.col(c).cast("double")).otherwise(F.raise_error(F.lit(bad)).cast("double"))
    e = panel.select(*by, key, (ok(arm) - ok(base)).alias("effect"))
    means = task_bootstrap(e, key, ["effect"], draws, seed, by).select(*by, F.try_divide("effect", "weight").alias("mean"))
    point = e.groupBy(*by).agg(F.count(F.lit(1)).alias("tasks"), F.avg("effect").alias("estimate"))
    return _joined(point, [_interval(means, "mean", by, confidence), sign_flips(e, key, "effect", draws, seed, by)], by)


def clustered_ratio_difference(panel: DataFrame, key: str, arm: tuple[str, str], base: tuple[str, str], draws: int = 2000, seed: int = 17, by: list[str] | None = None, confidence: float = 0.95, most_dropped: float = 0.01) -> DataFrame:
    """(by, tasks, estimate, low, high, dropped, reason): difference of pooled ratios (numerator, denominator) of both sides.

    Draws in which a denominator is 0 are dropped; more than ``most_dropped`` of them withhold the interval, and an
    observed denominator of 0 everything (``reason`` says so, else null). A numerator below 0 or above its denominator raises.
    """
    by, names = by or [], [*arm, *base]
    bad = F.raise_error(F.lit("a numerator is negative or larger than its denominator")).cast("double")
    checked = [x for n, d in (arm, base) for x in (F.when(F.col(n).between(0, F.col(d)), F.col(n)).otherwise(bad).alias(n), F.col(d).alias(d))]
    rows = panel.select(*by, key, *checked)
    ratio = lambda n, d: F.when(F.col(d) > 0, F.try_divide(F.col(n).cast("double"), F.col(d)))
    difference = ratio(*arm) - ratio(*base)
    drawn = task_bootstrap(rows, key, names, draws, seed, by).select(*by, difference.alias("value"))
    point = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("tasks"), *(F.sum(c).alias(c) for c in names)).select(*by, "tasks", difference.alias("estimate"))
    lost = drawn.groupBy(*by).agg(F.count_if(F.col("value").isNull()).alias("dropped"))
    out = _joined(point, [_interval(drawn, "value", by, confidence), lost], by)
    reason = F.when(F.col("estimate").isNull(), "an observed denominator is 0").when(F.col("dropped") > most_dropped * draws, "too many draws have an empty denominator")
    kept = lambda c: F.when(F.col("reason").isNull(), F.col(c)).alias(c)
    return out.withColumn("reason", reason).select(*by, "tasks", "estimate", kept("low"), kept("high"), "dropped", "reason")


def product_bootstrap(panel: DataFrame, key: str, run: str, effect: str, draws: int = 2000, seed: int = 17, by: list[str] | None = None, confidence: float = 0.95, least_runs: int = 3) -> DataFrame:
    """(by, tasks, runs, estimate, low, high) of the mean effect over tasks and runs, both resampled in each draw; no p value.

    ``panel`` has one row for each task and run. Fewer than ``least_runs`` runs, or a task without one of them, raise.
    """
    by = by or []
    e = panel.select(*by, key, run, F.col(effect).cast("double").alias("effect"))
    size = e.groupBy(*by).agg(F.count_distinct(key).alias("tasks"), F.count_distinct(run).alias("runs"), F.count(F.lit(1)).alias("_n"), F.avg("effect").alias("estimate"))
    fits = (F.col("runs") >= least_runs) & (F.col("_n") == F.col("tasks") * F.col("runs"))
    checked = F.when(fits, F.col("estimate")).otherwise(F.raise_error(F.lit(f"a panel needs {least_runs} runs or more and each task in every run")).cast("double"))
    w = _poisson(_uniform(seed, F.col("draw"), F.col(key))) * _poisson(_uniform(seed, F.lit("run"), F.col("draw"), F.col(run)))
    drawn = _draws(e, draws).withColumn("_w", w).groupBy(*by, "draw").agg(F.try_divide(F.sum(F.col("_w") * F.col("effect")), F.sum("_w")).alias("mean"))
    return _joined(size.select(*by, "tasks", "runs", checked.alias("estimate")), [_interval(drawn, "mean", by, confidence)], by)


def same_signature(runs: DataFrame, columns: list[str]) -> DataFrame:
    """(column, values): the columns in which runs differ, with their distinct values; empty if all agree."""
    long = runs.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.to_json(F.struct(F.col(c).alias("v"))).alias("value")) for c in columns))).alias("x")).select("x.*")
    return long.groupBy("column").agg(F.count_distinct("value").alias("n"), F.array_sort(F.collect_set("value")).alias("values")).where("n > 1").select("column", "values")
