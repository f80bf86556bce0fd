"""Diagnostics over candidates and reward streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalmill.functions import measures as M
from evalmill.operators import banks


def taxonomy(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, label, rows, share) of the failure class of every row."""
    by = by or []
    counted = df.select(*by, M.failure_class().alias("label")).groupBy(*by, "label").agg(F.count(F.lit(1)).alias("rows"))
    total = counted.groupBy(*by).agg(F.sum("rows").alias("all_rows"))
    joined = counted.join(total, by) if by else counted.crossJoin(F.broadcast(total))  # one row
    return joined.select(*by, "label", "rows", (F.col("rows") / F.col("all_rows")).alias("share"))


def taxonomy_examples(df: DataFrame) -> DataFrame:
    """The first row of each class by line_no, with its whole completion."""
    row = F.struct("line_no", "id", "target", "completion", F.col("metrics.expression").alias("expression"), F.col("metrics.error").alias("error"))
    return df.select(M.failure_class().alias("label"), row.alias("row"), "line_no").groupBy("label").agg(F.min_by("row", "line_no").alias("row")).select("label", "row.*")


def metric_means(df: DataFrame, names: tuple[str, ...], by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("rows"), *(F.avg(M.metric(n)).alias(n) for n in names))


def rollup_means(df: DataFrame, names: tuple[str, ...], key: str = "difficulty") -> DataFrame:
    """Means of metrics over all rows and by a key, in one pass; ``level`` is 1 for the total."""
    return df.rollup(key).agg(F.count(F.lit(1)).alias("rows"), *(F.avg(M.metric(n)).alias(n) for n in names), F.grouping_id().alias("level"))


def reward_health(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Means, sample deviations, nonzero shares and the ratios between them, of a stream of scored rows."""
    by = by or []
    m = M.metric
    e = df.select(*by, M.primary_reward().alias("primary"), M.auxiliary_reward().alias("auxiliary"), M.total_reward().alias("total"), *(m(x).alias(x) for x in ("contains_open_answer_tag", "contains_close_answer_tag", "has_extractable_answer_span", "parse_ok", "uses_allowed_numbers", "uses_allowed_ops", "exact_correct", "format")))
    parse, span, exact = F.avg("parse_ok"), F.avg("has_extractable_answer_span"), F.avg("exact_correct")
    return e.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"), *(x for c in ("primary", "auxiliary", "total") for x in (F.avg(c).alias(f"{c}_mean"), F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias(f"{c}_std"))),
        F.avg("contains_open_answer_tag").alias("open_tag"), F.avg("contains_close_answer_tag").alias("close_tag"), span.alias("span"), parse.alias("parseable"), F.avg("uses_allowed_numbers").alias("numbers"), F.avg("uses_allowed_ops").alias("operators"), exact.alias("exact"),
        (span - parse).alias("tag_only"), F.avg(((F.col("has_extractable_answer_span") > 0) & (F.col("parse_ok") == 0)).cast("double")).alias("tag_only_observed"), (parse - exact).alias("parseable_but_wrong"), (exact / F.greatest(parse, F.lit(1e-12))).alias("correct_given_parseable"),
        F.avg((F.col("format") > 0).cast("double")).alias("format_nonzero"), (F.coalesce(F.stddev_samp("format"), F.lit(0.0)) > 1e-9).alias("format_varies"),
    )


def batch_variance(df: DataFrame, batch: list[str], value: Column) -> DataFrame:
    """(batches, varying): batches whose rewards vary, by the sample deviation."""
    per = df.select(*batch, value.alias("v")).groupBy(*batch).agg(F.coalesce(F.stddev_samp("v"), F.lit(0.0)).alias("s"))
    return per.agg(F.count(F.lit(1)).alias("batches"), F.avg((F.col("s") > 1e-9).cast("double")).alias("varying"))


def positional_groups(df: DataFrame, batch: list[str], order: list[str], size: int) -> DataFrame:
    """Adds ``grp``: consecutive rows of a batch in groups of ``size``; a batch is one reward batch, bounded in size."""
    w = Window.partitionBy(*batch).orderBy(*order)
    return df.withColumn("grp", F.floor((F.row_number().over(w) - 1) / size).cast("long"))


def group_structure(df: DataFrame, keys: list[str], order: list[str], reward: Column) -> DataFrame:
    """(keys, rows, top, spread, positive): index of the highest reward (first on ties), population deviation, and the
    indices above the mean by more than 1e-12, of groups that are bounded in size."""
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = df.select(*keys, (F.row_number().over(w) - 1).alias("i"), reward.alias("r"))
    g = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.max_by("i", F.struct("r", -F.col("i"))).alias("top"), F.stddev_pop("r").alias("spread"), F.avg("r").alias("mean"), F.array_sort(F.collect_list(F.struct("i", "r"))).alias("all"))
    positive = F.transform(F.filter("all", lambda x: x.r > F.col("mean") + 1e-12), lambda x: x.i)
    return g.select(*keys, "rows", "top", "spread", positive.alias("positive"))


def consecutive_change(df: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """(keys, steps, mean_l1, max_linf): change from row to row of a vector of columns; keys are runs of bounded length."""
    w = Window.partitionBy(*keys).orderBy(*order)
    d = [F.abs(F.col(v) - F.lag(v).over(w)) for v in values]
    l1 = d[0]
    for x in d[1:]:
        l1 = l1 + x
    steps = df.select(*keys, l1.alias("l1"), (F.greatest(*d) if len(d) > 1 else d[0]).alias("linf")).where("l1 is not null")
    return steps.groupBy(*keys).agg(F.count(F.lit(1)).alias("steps"), F.avg("l1").alias("mean_l1"), F.max("linf").alias("max_linf"))


def first_last(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.min_by(value, order).alias("first"), F.max_by(value, order).alias("last"))


def out_of_distribution(df: DataFrame, arm: str, n: int = 8, base: str = "base") -> DataFrame:
    """Per arm: legality, f1, exactness, solved units, division, truncation, tokens; and the difference to the base arm."""
    rows = banks.once(banks.measured(df, [arm, "completion_token_count", "extracted_expression"]))
    one = F.count(F.lit(1))
    legal, exact = F.count_if(F.col("valid_expression") > 0), F.count_if(F.col("exact_correct") > 0)
    stats = rows.groupBy(arm).agg(
        one.alias("candidates"), (legal / one).alias("legal_rate"), F.avg("number_multiset_f1").alias("f1_mean"), F.coalesce(F.try_divide(exact, legal), F.lit(0.0)).alias("exact_given_legal"), (exact / one).alias("exact_rate"),
        F.avg(M.uses_division(F.col("extracted_expression")).cast("double")).alias("division_rate"), F.avg(M.is_clipped().cast("double")).alias("truncation_rate"), F.avg(F.coalesce("completion_token_count", F.lit(0))).alias("mean_tokens"),
    )
    solved = banks.prefix(rows, n).groupBy(arm, *banks.UNIT).agg(F.max("exact_correct").alias("e")).groupBy(arm).agg(F.count(F.lit(1)).alias("units"), F.count_if(F.col("e") > 0).alias("oracle"))
    arms = stats.join(solved, arm)
    reference = arms.where(F.col(arm) == base).select(*(F.col(c).alias(f"base_{c}") for c in ("legal_rate", "division_rate", "oracle")))
    joined = arms.crossJoin(F.broadcast(reference))  # one row
    return joined.select(arm, "candidates", "units", "legal_rate", "f1_mean", "exact_given_legal", "exact_rate", "oracle", "division_rate", "truncation_rate", "mean_tokens", (F.col("legal_rate") - F.col("base_legal_rate")).alias("legal_vs_base"), (F.col("division_rate") - F.col("base_division_rate")).alias("division_vs_base"), (F.col("oracle") - F.col("base_oracle")).alias("oracle_vs_base"))


def prompt_shift(df: DataFrame, keys: list[str], field: str = "prompt_field", strong: str = "prompt_high", weak: str = "prompt_mid") -> DataFrame:
    """Per key: legality and f1 of parseable rows under both prompts, and what is lost from the strong to the weak."""
    rows = banks.once(df.select("line_no", *banks.UNIT, "candidate_index", field, *[k for k in keys if k not in banks.UNIT], (M.metric("valid_expression") > 0).alias("legal"), F.when(M.parseable(), M.metric("number_multiset_f1")).alias("f1")))
    p = rows.groupBy(*keys).pivot(field, [strong, weak]).agg(F.avg(F.col("legal").cast("double")).alias("legal"), F.coalesce(F.avg("f1"), F.lit(0.0)).alias("f1"))
    s, w = strong, weak
    return p.where(F.col(f"{s}_legal").isNotNull() & F.col(f"{w}_legal").isNotNull()).select(
        *keys, F.col(f"{s}_legal").alias("legal_strong"), F.col(f"{w}_legal").alias("legal_weak"), (F.col(f"{s}_legal") - F.col(f"{w}_legal")).alias("legal_loss"), F.col(f"{s}_f1").alias("f1_strong"), F.col(f"{w}_f1").alias("f1_weak"), (F.col(f"{s}_f1") - F.col(f"{w}_f1")).alias("f1_loss")
    )


def shift_interaction(shift: DataFrame, method: str, pair: list[str], first: str, second: str) -> DataFrame:
    """Mean, population deviation and sign of the advantage of the second method over the first, over paired runs."""
    side = lambda name, alias: shift.where(F.col(method) == name).select(*pair, F.col("legal_loss").alias(alias))
    a = side(first, "a").join(side(second, "b"), pair).select((F.col("a") - F.col("b")).alias("advantage"))
    return a.agg(F.count(F.lit(1)).alias("pairs"), F.avg("advantage").alias("mean"), F.stddev_pop("advantage").alias("spread"), (F.coalesce(F.bool_and(F.col("advantage") > 0), F.lit(False)) | F.coalesce(F.bool_and(F.col("advantage") < 0), F.lit(False))).alias("consistent"))


def prune_components(df: DataFrame, group: list[str], names: tuple[str, ...], reference: str = "valid_expression", least: float = 0.01) -> DataFrame:
    """(name, mean_spread, varying, mean, same_as_reference, kept): which components carry signal within groups."""
    long = df.select(*group, M.metric(reference).alias("ref"), F.explode(F.array(*(F.struct(F.lit(n).alias("name"), M.metric(n).alias("v")) for n in names))).alias("x")).select(*group, "ref", "x.name", "x.v")
    per = long.groupBy(*group, "name").agg(F.stddev_pop("v").alias("s"), F.sum("v").alias("sum"), F.count(F.lit(1)).alias("rows"), F.bool_and(F.col("v") == F.col("ref")).alias("same"))
    same = F.bool_and("same") & (F.col("name") != reference)
    return per.groupBy("name").agg(F.avg("s").alias("mean_spread"), F.avg((F.col("s") > 1e-9).cast("double")).alias("varying"), (F.sum("sum") / F.sum("rows")).alias("mean"), same.alias("same_as_reference"), ((F.avg("s") > least) & ~same).alias("kept"))


def verbatim_and_novel(df: DataFrame, tasks: DataFrame) -> DataFrame:
    """Exact candidates of tasks that train knows too: how many repeat a train solution but for blanks."""
    key = F.struct(F.array_sort("numbers").alias("n"), F.col("target").alias("t"), F.array_sort(F.array_distinct("allowed_ops")).alias("o"))
    known = tasks.where(F.lower(F.trim("split")) == "train").where("solution is not null and numbers is not null and target is not null and allowed_ops is not null")
    gold = known.select(key.alias("k"), F.replace("solution", F.lit(" "), F.lit("")).alias("s")).distinct()
    exact = df.where(M.is_exact()).select("line_no", key.alias("k"), F.replace(F.col("metrics.expression"), F.lit(" "), F.lit("")).alias("s"))
    on = exact.join(gold.select("k").distinct(), "k", "left_semi")
    return on.join(gold.withColumn("hit", F.lit(True)), ["k", "s"], "left").agg(F.count(F.lit(1)).alias("exact_on_known"), F.count_if("hit").alias("verbatim"), F.count_if(F.col("hit").isNull()).alias("novel"))


def length_stats(df: DataFrame, by: list[str], cap: int = 256) -> DataFrame:
    """Mean, exact median and capped share of token counts; unknown counts are left out."""
    known = df.where("completion_token_count is not null")
    return known.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.avg("completion_token_count").alias("mean"), F.median("completion_token_count").alias("median"), F.avg((F.col("completion_token_count") >= cap).cast("double")).alias("capped"))


def health_gate(df: DataFrame, by: list[str]) -> DataFrame:
    """Counts of rows that break what scored rows keep: equal exactness fields, shares within [0, 1], tag flags that fit
    the format, a legal row that parses; and whether rewards vary at all."""
    m, c = M.metric, F.count_if
    unit = [m(n) for n in ("number_precision", "number_recall", "number_multiset_f1", "numeric_distance_reward", "format")]
    outside = unit[0].between(0, 1)
    for u in unit[1:]:
        outside = outside & u.between(0, 1)
    tags = (m("contains_open_answer_tag") + m("contains_close_answer_tag") + m("has_extractable_answer_span")) / 3
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"), c(m("exact_correct") != m("correct")).alias("exact_differs"), c(~outside).alias("outside"), c(F.abs(tags - m("format")) > 1e-6).alias("format_differs"),
        c((m("valid_expression") >= 1) & (m("parse_ok") < 1)).alias("legal_unparsed"), c((m("correct") >= 1) & (m("valid_expression") < 1)).alias("correct_illegal"), (F.coalesce(F.stddev_samp(M.total_reward()), F.lit(0.0)) > 1e-9).alias("varies"),
    )


def weight_summary(records: DataFrame, run: str) -> DataFrame:
    """Per run and key of a controller's records: first, last, least, most and mean weight, and shares at floor and cap."""
    long = records.select(run, "step", "at_floor", "at_cap", F.explode("weights").alias("key", "w"))
    return long.groupBy(run, "key").agg(
        F.min_by("w", "step").alias("first"), F.max_by("w", "step").alias("last"), F.min("w").alias("least"), F.max("w").alias("most"), F.avg("w").alias("mean"),
        F.avg(F.array_contains("at_floor", F.col("key")).cast("double")).alias("at_floor"), F.avg(F.array_contains("at_cap", F.col("key")).cast("double")).alias("at_cap"),
    )


def phase_shares(records: DataFrame, run: str) -> DataFrame:
    """(run, phase, records, share, flips): how long a controller was in each phase, and how often it changed by its end."""
    n = F.count(F.lit(1))
    per = records.groupBy(run, "phase").agg(n.alias("records"), F.max("flips").alias("_f"))
    every = records.groupBy(F.col(run).alias("_run")).agg(n.alias("_all"), F.max("flips").alias("flips"))
    return per.join(every, F.col(run).eqNullSafe(F.col("_run"))).select(run, "phase", "records", (F.col("records") / F.col("_all")).alias("share"), "flips")
