"""Reports that combine several operators: scorecards of arms, matrices of contrasts, checks of stored verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalmill.functions import keys as K
from evalmill.functions import measures as M
from evalmill.functions import verifier as V
from evalmill.operators import audit, banks, inference, pairing

#: Names that mean the same method in older runs.
ALIASES = {"adaptive_stable": "stable", "stable_teacher": "stable", "fixed": "static", "static_weights": "static"}


def run_identity(bank: Column, method: Column | None = None, split: Column | None = None, seed: Column | None = None) -> Column:
    """Struct of method, split and seed of a run: from its configuration, else from its name method_split_s0001."""
    given = lambda c, kind: F.lit(None).cast(kind) if c is None else c
    known = F.coalesce(given(method, "string"), F.nullif(F.regexp_extract(bank, r"^([a-z]+)_", 1), F.lit("")))
    renamed = known
    for old, new in ALIASES.items():
        renamed = F.when(known == old, new).otherwise(renamed)
    number = F.nullif(F.regexp_extract(bank, r"_s(\d+)$", 1), F.lit("")).cast("long")
    part = F.nullif(F.regexp_extract(bank, r"^[a-z]+_(.+)_s\d+$", 1), F.lit(""))
    return F.struct(renamed.alias("method"), F.coalesce(given(split, "string"), part).alias("split"), F.coalesce(given(seed, "long"), number).alias("seed"))


def scopes(candidates: DataFrame, tasks: DataFrame) -> DataFrame:
    """Each row once for each scope that it is in: all, and overlap or held_out by whether train has its task."""
    key = K.semantic_key()
    train = tasks.where(audit.split_name() == "train").select(key.alias("k")).where("k is not null").distinct().withColumn("in_train", F.lit(True))
    j = candidates.withColumn("k", key).join(train, "k", "left").drop("k")
    return j.select("*", F.explode(F.array(F.lit("all"), F.when(F.col("in_train"), F.lit("overlap")).otherwise(F.lit("held_out")))).alias("scope")).drop("in_train")


def scorecard(candidates: DataFrame, tasks: DataFrame, runs: DataFrame, arm: str = "method") -> DataFrame:
    """Per arm, scope and tier (null: all tiers): candidates, legality, exactness among the legal, tokens, clip rate."""
    once = banks.once(candidates.select("line_no", *banks.UNIT, "candidate_index", "difficulty", "numbers", "target", "allowed_ops", "completion_token_count", M.is_legal().alias("legal"), (M.metric("exact_correct") >= 1).alias("exact")))
    rows = scopes(once.join(runs.select("bank", arm), "bank"), tasks)
    n, both = F.count(F.lit(1)), F.count_if(F.col("legal") & F.col("exact"))
    c = F.col
    return rows.groupingSets([[c(arm), c("scope"), c("difficulty")], [c(arm), c("scope")]], c(arm), c("scope"), c("difficulty")).agg(
        n.alias("candidates"), F.avg(c("legal").cast("double")).alias("legality"), F.coalesce(F.try_divide(both, F.count_if("legal")), F.lit(0.0)).alias("exact_given_legal"),
        F.avg(F.coalesce("completion_token_count", F.lit(0))).alias("tokens"), F.avg(M.is_clipped().cast("double")).alias("clip_rate"), F.grouping("difficulty").alias("total"),
    )


def contrasts(candidates: DataFrame, runs: DataFrame, base: str, n: int = 8, arm: str = "method") -> DataFrame:
    """Per arm against the base on shared tasks: the paired cells, McNemar's p and its Holm adjustment over all arms."""
    chosen = banks.select_best(candidates, n).join(runs.select("bank", arm), "bank")
    outcome = chosen.groupBy(arm, "id").agg(F.max((F.col("exact_correct") > 0).cast("int")).alias("v"))
    a = outcome.where(F.col(arm) != base).select(arm, "id", F.col("v").alias("arm"))
    b = outcome.where(F.col(arm) == base).select("id", F.col("v").alias("base"))
    cells = pairing.paired_counts(a.join(b, "id"), [arm])
    x, y = F.col("arm_only"), F.col("base_only")
    p = F.when(x + y <= 1000, inference.mcnemar_p(x, y)).otherwise(inference.mcnemar_large("arm_only", "base_only"))
    return inference.holm(cells.withColumn("p", p), "p", arm)


def macro_outcomes(candidates: DataFrame, runs: DataFrame, n: int = 8) -> DataFrame:
    """Per bank: exact share of both selectors as the mean over tiers of their means, tokens, tokens for an exact task, share of candidates at the cap."""
    r = banks.best_of_n(candidates, (n,), ["bank", "difficulty"])
    capped = banks.candidate_stats(candidates, ["bank"]).select("bank", F.col("clip_rate").alias("cap_share"))
    return r.groupBy("bank").agg(
        F.avg("practical_exact_correct").alias("practical"), F.avg("oracle_exact_correct").alias("oracle"), F.sum("tokens").alias("tokens"), F.try_divide(F.sum("tokens").cast("double"), F.sum(F.round(F.col("practical_exact_correct") * F.col("units")))).alias("tokens_per_exact")
    ).join(capped, "bank").join(runs.select("bank", "method", "split", "seed"), "bank")


def reverified(candidates: DataFrame) -> DataFrame:
    """Per bank: rows, and how many stored verdicts differ from what the verifier finds for the completion."""
    v = candidates.where("metrics is not null").select("bank", "metrics", V.verify_completion(F.col("completion"), F.col("numbers"), F.col("target"), F.col("allowed_ops")).alias("v"))
    differs = lambda c: F.count_if(F.round(M.metric(c), 6) != F.round(F.coalesce(F.col(f"v.{c}"), F.lit(0.0)), 6)).alias(c)
    return v.groupBy("bank").agg(F.count(F.lit(1)).alias("rows"), *(differs(c) for c in ("parse_ok", "valid_expression", "correct", "number_multiset_f1")))


def raw_line_check(raw: DataFrame) -> DataFrame:
    """(bank, lines, broken, no_id, no_metrics, odd_index): what raw JSON lines lack, by the types of their fields.

    A line is broken if it is no JSON object. Field names count as written; an index that is no integer is odd.
    """
    v = raw.select("bank", F.try_parse_json("line").alias("v"))
    kind = lambda path: F.coalesce(F.schema_of_variant(F.try_variant_get("v", path, "variant")), F.lit("VOID"))
    ok = F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False))
    return v.groupBy("bank").agg(
        F.count(F.lit(1)).alias("lines"), F.count_if(~ok).alias("broken"), F.count_if(ok & (kind("$.id") != "STRING")).alias("no_id"), F.count_if(ok & ~kind("$.metrics").startswith("OBJECT")).alias("no_metrics"), F.count_if(ok & (kind("$.candidate_index") != "BIGINT")).alias("odd_index")
    )


def task_components(candidates: DataFrame) -> DataFrame:
    """(bank, task, candidates, legal, exact_legal, legality, whole) of each semantic task of each bank.

    Rows delivered twice count once. ``whole``: the task has one id and the indices 0 up to its largest. Rows whose
    task is incomplete are left out.
    """
    rows = banks.once(candidates.select("line_no", *banks.UNIT, "candidate_index", K.semantic_key().alias("task"), M.is_legal().alias("legal"), (M.metric("exact_correct") >= 1).alias("exact")))
    n, legal = F.count(F.lit(1)), F.count_if("legal")
    return rows.where("task is not null").groupBy("bank", "task").agg(
        n.alias("candidates"), legal.alias("legal"), F.count_if(F.col("legal") & F.col("exact")).alias("exact_legal"), (legal / n).alias("legality"), ((F.count_distinct("id") == 1) & (F.max("candidate_index") + 1 == n)).alias("whole")
    )


def strict_task_components(candidates: DataFrame) -> DataFrame:
    """``task_components`` whose grid is checked: raises where a task is not whole or banks differ in candidates for each task."""
    c = task_components(candidates)
    sizes = c.groupBy("bank").agg(F.bool_and("whole").alias("whole"), F.min("candidates").alias("least"), F.max("candidates").alias("most"))
    odd = sizes.where("not whole or least <> most").first()
    if odd is not None:
        raise pairing.GridError(f"bank {odd['bank']!r} has tasks that are not whole, or {odd['least']} to {odd['most']} candidates for a task")
    return c


def clustered_scopes(candidates: DataFrame, tasks: DataFrame, runs: DataFrame, base: str, draws: int = 2000, arm: str = "method") -> DataFrame:
    """Per arm and scope (all, overlap with train, held_out) against the base, on the semantic tasks that both have: the
    difference of legality and of exactness among the legal, each with a whole-task interval, and p of the first.

    A scope without tasks on both sides has no row. Runs of an arm are pooled: legality is averaged over them, counts add up.
    """
    per = task_components(candidates).join(runs.select("bank", arm), "bank").groupBy(arm, "task").agg(F.avg("legality").alias("legality"), F.sum("exact_legal").alias("exact"), F.sum("legal").alias("legal"))
    train = tasks.where(audit.split_name() == "train").select(K.semantic_key().alias("task")).where("task is not null").distinct().withColumn("in_train", F.lit(True))
    b = per.where(F.col(arm) == base).select("task", F.col("legality").alias("b_legality"), F.col("exact").alias("b_exact"), F.col("legal").alias("b_legal"))
    pairs = per.where(F.col(arm) != base).join(b, "task").join(train, "task", "left")
    scope = F.explode(F.array(F.lit("all"), F.when(F.col("in_train"), F.lit("overlap")).otherwise(F.lit("held_out"))))
    panel = pairs.select(arm, "task", "legality", "exact", "legal", "b_legality", "b_exact", "b_legal", scope.alias("scope"))
    by = [arm, "scope"]
    legality = inference.clustered_difference(panel, "task", "legality", "b_legality", draws, by=by).select(*by, "tasks", F.col("estimate").alias("legality"), F.col("low").alias("legality_low"), F.col("high").alias("legality_high"), F.col("p").alias("legality_p"))
    exact = inference.clustered_ratio_difference(panel, "task", ("exact", "legal"), ("b_exact", "b_legal"), draws, by=by).select(*by, F.col("estimate").alias("exact"), F.col("low").alias("exact_low"), F.col("high").alias("exact_high"), "dropped", "reason")
    return legality.join(exact, by)
