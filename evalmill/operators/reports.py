"""Reports over banks and runs beyond the best of N: code candidates, costs, probes, paired runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalmill.functions import measures as M
from evalmill.operators import banks, pairing

#: The metrics that the report over code candidates averages.
CODE_SELECTED = ("valid_expression", "runs_without_error", "visible_pass_rate", "no_hardcoding_heuristic", "held_out_pass_rate", "exact_correct")


def code_best_of_n(df: DataFrame, n_values: tuple[int, ...] = (1, 4, 8), by: list[str] | None = None) -> DataFrame:
    """The report of both selectors over code candidates, with the gap between what the practical one sees and the truth.

    The practical selector never reads held-out results; a large ``proxy_gap`` (visible less held-out rate of what it
    selects) says that visible tests were gamed. Units with fewer than n rows do not count for that n.
    """
    by, top = by or [], max(n_values)
    rows = banks.once(df.select("line_no", *banks.UNIT, "candidate_index", "completion_token_count", *by, M.code_practical_score().alias("score"), *(M.metric(c).alias(c) for c in CODE_SELECTED)))
    rows = banks.prefix(rows, top).select("*", F.explode(F.array(*map(F.lit, n_values))).alias("n")).where("pos < n")
    best = lambda *first: F.max_by(F.struct(*CODE_SELECTED), F.struct(*first, F.col("score"), -F.col("candidate_index"), -F.col("line_no")))
    units = rows.groupBy(*banks.UNIT, *by, "n").agg(F.count(F.lit(1)).alias("have"), F.sum(F.coalesce("completion_token_count", F.lit(0))).alias("tokens"), best().alias("p"), best(F.col("exact_correct")).alias("o"))
    rate = lambda c: F.avg(f"{c}.exact_correct")
    return units.where("have = n").groupBy(*by, "n").agg(
        F.count(F.lit(1)).alias("units"), F.sum("tokens").alias("tokens"), *(F.avg(f"{s}.{c}").alias(f"{name}_{c}") for s, name in (("p", "practical"), ("o", "oracle")) for c in CODE_SELECTED),
        (F.avg("p.visible_pass_rate") - F.avg("p.held_out_pass_rate")).alias("proxy_gap"), M.cost_per_exact(F.col("n"), rate("p")).alias("cost_practical"), M.cost_per_exact(F.col("n"), rate("o")).alias("cost_oracle"),
    )


def base_probe(df: DataFrame, value: Column, keep: list[str] | None = None) -> DataFrame:
    """(keep, units, candidates, legal, exact, oracle, value, spread, varying): rates of a bank before training, and how
    much a dense value varies within units (population deviation; more than 1e-9 counts)."""
    keep = keep or []
    rows = banks.once(df.select("line_no", *banks.UNIT, "candidate_index", *[k for k in keep if k not in banks.UNIT], M.is_legal().alias("legal"), M.is_exact().alias("exact"), value.alias("v")))
    units = rows.groupBy(*banks.UNIT, *[k for k in keep if k not in banks.UNIT]).agg(F.count(F.lit(1)).alias("n"), F.count_if("legal").alias("legal"), F.count_if("exact").alias("exact"), F.sum("v").alias("v"), F.stddev_pop("v").alias("s"))
    n = F.sum("n")
    return units.groupBy(*keep).agg(
        F.count(F.lit(1)).alias("units"), n.alias("candidates"), (F.sum("legal") / n).alias("legal"), (F.sum("exact") / n).alias("exact"), (F.count_if(F.col("exact") > 0) / F.count(F.lit(1))).alias("oracle"),
        (F.sum("v") / n).alias("value"), F.avg("s").alias("spread"), F.avg((F.col("s") > 1e-9).cast("double")).alias("varying"),
    )


def cost_claim(df: DataFrame, runs: DataFrame, arm: str, base: str, by: list[str], method: str = "method") -> DataFrame:
    """(by, arm, base, ratio, gap, noise, gap_over_noise): mean tokens of two methods as means over their runs, and their
    difference against the deviation between runs (population, both added in squares; null where there is none)."""
    per = df.groupBy("bank").agg(F.avg(F.coalesce("completion_token_count", F.lit(0))).alias("t")).join(runs.select("bank", method, *by), "bank")
    of = lambda name: F.when(F.col(method) == name, F.col("t"))
    both = per.groupBy(*by).agg(F.avg(of(arm)).alias("arm"), F.avg(of(base)).alias("base"), F.sqrt(F.pow(F.stddev_pop(of(arm)), 2) + F.pow(F.stddev_pop(of(base)), 2)).alias("noise")).where("arm is not null and base is not null")
    gap = F.col("base") - F.col("arm")
    return both.select(*by, "arm", "base", F.try_divide("arm", "base").alias("ratio"), gap.alias("gap"), "noise", F.try_divide(gap, F.nullif(F.col("noise"), F.lit(0.0))).alias("gap_over_noise"))


def outcomes_by_run(df: DataFrame, runs: DataFrame, n: int = 8) -> DataFrame:
    """(method, split, seed, units, oracle, reranked): exact units of each run by both selectors."""
    return banks.saturation(df, n).join(runs.select("bank", "method", "split", "seed"), "bank").select("method", "split", "seed", "units", "oracle", "reranked")


def paired_over_runs(df: DataFrame, runs: DataFrame, base: str, pair: list[str], n: int = 8) -> DataFrame:
    """Per method against the base: the paired cells over all pairs of runs with the same ``pair`` columns, and the mean
    and sample deviation of the differences of the pairs (0 for a single pair).

    Runs without a partner are left out. The cells are pooled for description: pairs of one task in several runs are
    not independent, so no p value belongs to them.
    """
    chosen = banks.select_best(df, n).select("bank", "id", (F.col("exact_correct") > 0).cast("int").alias("v")).join(runs.select("bank", "method", *pair), "bank")
    a = chosen.where(F.col("method") != base).select("method", F.col("bank").alias("arm_bank"), *pair, "id", F.col("v").alias("arm"))
    b = chosen.where(F.col("method") == base).select(F.col("bank").alias("base_bank"), *pair, "id", F.col("v").alias("base"))
    per = pairing.paired_counts(a.join(b, [*pair, "id"]), ["method", "arm_bank", "base_bank"])
    return per.groupBy("method").agg(F.count(F.lit(1)).alias("pairs"), *(F.sum(c).alias(c) for c in ("n", "both", "arm_only", "base_only", "neither")), F.avg("delta").alias("delta_mean"), F.coalesce(F.stddev_samp("delta"), F.lit(0.0)).alias("delta_std"))


def outcome_by_task(df: DataFrame, n: int = 8) -> DataFrame:
    """(bank, task, outcome, ids): one 0/1 outcome of the practical selector for each semantic task of each bank; a task
    with several ids counts as solved if one of them is, and says how many it has. Rows of incomplete tasks are left out."""
    from evalmill.functions import keys as K

    best = banks.select_best(df, n).select("bank", "id", (F.col("exact_correct") > 0).cast("int").alias("v"))
    keys = df.select("bank", "id", K.semantic_key().alias("task")).where("task is not null").groupBy("bank", "id").agg(F.min("task").alias("task"))
    return best.join(keys, ["bank", "id"]).groupBy("bank", "task").agg(F.max("v").alias("outcome"), F.count_distinct("id").alias("ids"))


def last_tier(tasks: DataFrame) -> DataFrame:
    """(id, difficulty): the tier of each task, of its last row."""
    return tasks.where("id is not null").groupBy("id").agg(F.max_by("difficulty", "line_no").alias("difficulty"))


def family_means(per_run: DataFrame, runs: DataFrame, values: list[str], families: tuple[str, ...] = ("stable", "static")) -> DataFrame:
    """(family, streams, means): over runs of each family of methods, told by what the method's name contains, the first that fits."""
    family = F.coalesce(*(F.when(F.contains("method", F.lit(f)), F.lit(f)) for f in families), F.lit("other"))
    return per_run.join(runs.select("bank", "method"), "bank").groupBy(family.alias("family")).agg(F.count(F.lit(1)).alias("streams"), *(F.avg(v).alias(v) for v in values))


def movers(records: DataFrame, run: str, most: int = 3) -> DataFrame:
    """(run, rank, key, change): the keys of a controller whose weight changed most from its first record to its last."""
    long = records.select(run, "step", F.explode("weights").alias("key", "w")).groupBy(run, "key").agg((F.max_by("w", "step") - F.min_by("w", "step")).alias("change"))
    ranked = long.withColumn("rank", F.row_number().over(Window.partitionBy(run).orderBy(F.abs("change").desc(), "key"))).where(F.col("rank") <= most)  # one row for each key of a run
    return ranked.select(run, "rank", "key", "change")


def weight_health(records: DataFrame, run: str, strategy: str, delay: int, budget: float = 1.2, start: float = 0.2) -> DataFrame:
    """(run, records, drifted, off_budget): records of a static controller whose weights moved (1e-9), and of a stable
    one whose weights do not add up to the budget after the delay (1e-6)."""
    moved = F.exists(F.map_values("weights"), lambda w: F.abs(w - start) > 1e-9)
    off = (F.col("step") > delay) & (F.abs(F.col("weight_sum") - budget) > 1e-6)
    no = F.lit(False)
    return records.groupBy(run).agg(F.count(F.lit(1)).alias("records"), F.count_if(moved if strategy == "static" else no).alias("drifted"), F.count_if(off if strategy.startswith("adaptive_stable") else no).alias("off_budget"))
