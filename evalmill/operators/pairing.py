"""Comparisons of an arm with a baseline on the tasks that both have."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class GridError(ValueError):
    """Two sides that should have the same tasks do not."""


def outcomes(selected: DataFrame, runs: DataFrame, keys: list[str]) -> DataFrame:
    """One 0/1 outcome for each task of a group of runs: whether any selected row is exact, and how many are."""
    j = selected.join(runs, "bank")
    return j.groupBy(*keys, "id").agg(F.max((F.col("exact_correct") > 0).cast("int")).alias("outcome"), F.avg("exact_correct").alias("rate"), F.count(F.lit(1)).alias("runs"))


def paired(arm: DataFrame, base: DataFrame, keys: list[str], value: str = "outcome", strict: bool = False) -> DataFrame:
    """(keys, arm, base) of tasks in both; ``strict`` raises if a task is on one side only (an action)."""
    a, b = arm.select(*keys, F.col(value).alias("arm")), base.select(*keys, F.col(value).alias("base"))
    if strict:
        odd = a.join(b, keys, "full_outer").where("arm is null or base is null").select(*keys).first()
        if odd is not None:
            raise GridError(f"only one side has {odd.asDict()}")
    return a.join(b, keys)


def paired_counts(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The four cells of paired outcomes, and the difference of the shares."""
    a, b = F.col("arm") > 0, F.col("base") > 0
    return pairs.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(a & b).alias("both"), F.count_if(a & ~b).alias("arm_only"), F.count_if(~a & b).alias("base_only"), F.count_if(~a & ~b).alias("neither"),
        ((F.count_if(a) - F.count_if(b)) / F.count(F.lit(1))).alias("delta"),
    )


#: The nested subsets of tiers that comparisons report.
SUBSETS = {"easy": ("easy",), "easy_medium": ("easy", "medium"), "all": None}


def in_subsets(df: DataFrame, tier: str = "difficulty") -> DataFrame:
    """Each row once for each subset of tiers that it is in."""
    names = F.filter(F.array(*(F.when(F.lit(True) if tiers is None else F.col(tier).isin(*tiers), F.lit(name)) for name, tiers in SUBSETS.items())), lambda x: x.isNotNull())
    return df.select("*", F.explode(names).alias("subset"))


def dilution(counts: DataFrame) -> DataFrame:
    """The difference in the easy subset over that in all (null where the latter is 0), and the tasks of both."""
    of = lambda name, c: F.max(F.when(F.col("subset") == name, F.col(c)))
    one = counts.agg(of("easy", "delta").alias("easy"), of("all", "delta").alias("all"), of("easy", "n").alias("easy_tasks"), of("all", "n").alias("all_tasks"))
    return one.select("easy", "all", F.when(F.col("all") != 0, F.try_divide("easy", "all")).alias("ratio"), "easy_tasks", "all_tasks")


def tier_rates(df: DataFrame, keys: list[str], fine: list[str], tier: str, value: str) -> DataFrame:
    """Mean of a 0/1 column by keys, fine keys and tier, and pooled over the fine keys, in one pass."""
    sets = [[*keys, *fine, tier], [*keys, tier]]
    return df.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in (*keys, *fine, tier)]).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(value).cast("double")).alias("rate"))


def matching_payload(left: DataFrame, right: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Per key of the left side: whether the right side knows it and which fields differ (null equals null)."""
    r = right.select(key, F.struct(*fields).alias("r"))
    differ = F.filter(F.array(*(F.when(~F.col(f).eqNullSafe(F.col(f"r.{f}")), F.lit(f)) for f in fields)), lambda x: x.isNotNull())
    return left.join(r, key, "left").select(key, F.col("r").isNotNull().alias("known"), F.when(F.col("r").isNotNull(), differ).alias("different"))


def ordered_lookup(ids: DataFrame, rows: DataFrame, key: str = "id", position: str = "pos", last: str = "line_no", strict: bool = True) -> DataFrame:
    """Rows of an ordered list of ids, the last row of each id; an id without a row raises (else it comes out with nulls)."""
    kept = rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), last).alias("row"))
    found = F.col("row")
    if strict:
        found = F.when(F.col("row").isNotNull(), F.col("row")).otherwise(F.raise_error(F.concat(F.lit("no row has the id "), F.coalesce(F.col(key).cast("string"), F.lit("null")))))
    return ids.join(kept, key, "left").select(position, key, found.alias("row")).select(position, key, "row.*")


def stacked_panel(runs: DataFrame, key: str, run: str, value: str) -> DataFrame:
    """(key, values): the values of all runs by run, for tasks that every run has; raises if the grid is incomplete."""
    n = runs.select(run).distinct().count()
    panel = runs.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(run, value))).alias("v"), F.count(F.lit(1)).alias("c"), F.count_distinct(run).alias("d"))
    odd = panel.where((F.col("c") != n) | (F.col("d") != n)).first()
    if odd is not None:
        raise GridError(f"{key} {odd[key]!r} has {odd['c']} values of {odd['d']} runs; there are {n} runs")
    return panel.select(key, F.transform("v", lambda x: x[value]).alias("values"))


def shown_prompt(candidates: DataFrame, tasks: DataFrame, fields: tuple[str, ...] = ("prompt_low", "prompt_mid", "prompt_high")) -> DataFrame:
    """(line_no, id, prompt) of every candidate: the prompt that prompt_field names, of the last row of its task.

    Null where the field is null, names no prompt, or the task is absent.
    """
    last = tasks.where("id is not null").groupBy("id").agg(F.max_by(F.struct(*fields), "line_no").alias("p"))
    prompts = last.select("id", F.explode(F.array(*(F.struct(F.lit(f).alias("prompt_field"), F.col(f"p.{f}").alias("prompt")) for f in fields))).alias("x")).select("id", "x.*")
    return candidates.select("line_no", "id", "prompt_field").join(prompts, ["id", "prompt_field"], "left").select("line_no", "id", "prompt")
