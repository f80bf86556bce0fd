"""Candidate banks: integrity, prefixes, selection and what more samples would bring.

A unit is a task in a bank. Rows delivered twice (same bank, id and candidate_index) count once, the lowest line_no;
positions count the remaining rows of a unit by candidate_index, from 0. Operators over the first n positions rank with
a limit, which Spark applies in each task before the shuffle, so a unit of any size sends n rows from each task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalmill.functions import measures as M
from evalmill.functions import text as X

UNIT = ["bank", "id"]
#: What exactness, legality and the reports read.
KEPT = tuple(dict.fromkeys([*(f for f, _ in M.PRACTICAL), *M.SELECTED, "has_extractable_answer_span"]))


def once(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Each (bank, id, candidate_index) once, with the named further columns; partial aggregation, no window."""
    columns = columns or [c for c in df.columns if c not in (*UNIT, "candidate_index")]
    row = F.struct("line_no", *(c for c in columns if c != "line_no"))
    kept = df.groupBy(*UNIT, "candidate_index").agg(F.min_by(row, "line_no").alias("row"))
    return kept.select(*UNIT, "candidate_index", *(F.col(f"row.{c}").alias(c) for c in dict.fromkeys(["line_no", *columns])))


def measured(df: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Rows with the score, exactness and the metrics that reports read as columns of their own."""
    return df.select(
        "line_no", *UNIT, "candidate_index", *(extra or []), M.practical_score().alias("score"), *(M.metric(c).alias(c) for c in KEPT)
    )


def prefix(df: DataFrame, n: int) -> DataFrame:
    """The first n positions of each unit, with ``pos``."""
    w = Window.partitionBy(*UNIT).orderBy("candidate_index", "line_no")
    ranked = df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n)  # in this form Spark limits before the shuffle
    return ranked.withColumn("pos", F.col("_n") - 1).drop("_n")


def integrity(df: DataFrame, declared: DataFrame | None = None) -> DataFrame:
    """(bank, units, rows, repeated, incomplete, gaps): how far each bank is from the grid 0..N-1 of its units.

    N is n_candidates of ``declared`` where given, else the unit's own largest index plus one. A unit is incomplete if
    it has fewer than N distinct indices below N, and has gaps if its indices are not 0 up to its largest.
    """
    per = df.groupBy(*UNIT, "candidate_index").agg(F.count(F.lit(1)).alias("c"))
    if declared is not None:
        per = per.join(declared.select("bank", F.col("n_candidates").alias("n")), "bank", "left")
        n, below = F.max("n"), F.count_if(F.col("candidate_index") < F.col("n"))
    else:
        n, below = F.max("candidate_index") + 1, F.count("candidate_index")
    units = per.groupBy(*UNIT).agg(F.sum("c").alias("rows"), (F.sum("c") - F.count(F.lit(1))).alias("repeated"), F.max("candidate_index").alias("top"), F.count("candidate_index").alias("distinct"), n.alias("n"), below.alias("below"))
    short = F.col("below") < F.col("n")
    return units.groupBy("bank").agg(
        F.count(F.lit(1)).alias("units"), F.sum("rows").alias("rows"), F.sum("repeated").alias("repeated"), F.count_if(short).alias("incomplete"), F.count_if(F.col("distinct") != F.col("top") + 1).alias("gaps")
    )


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def select_best(df: DataFrame, n: int, oracle: bool = False) -> DataFrame:
    """The selected row of each unit among its first n: by score (``oracle``: by exactness, then score), then index."""
    order = [F.col("score").desc(), F.col("candidate_index"), F.col("line_no")]
    if oracle:
        order = [F.col("exact_correct").desc(), *order]
    return first_by(prefix(once(measured(df)), n), UNIT, order)


def best_of_n(df: DataFrame, n_values: tuple[int, ...] = (1, 4, 8), by: list[str] | None = None, seconds: float = 0.0) -> DataFrame:
    """The report of both selectors for each n over the units that have n rows, with tokens and cost.

    One exchange serves all n: a row carries its position, and each n aggregates the rows below it.
    ``by`` groups units further by columns that are constant in a bank or unit.
    """
    by, top = by or [], max(n_values)
    rows = prefix(once(measured(df, ["completion_token_count", *by])), top)
    rows = rows.select("*", F.explode(F.array(*map(F.lit, n_values))).alias("n")).where("pos < n")
    best = lambda oracle: F.max_by(F.struct(*M.SELECTED), F.struct(*([F.col("exact_correct")] if oracle else []), F.col("score"), -F.col("candidate_index"), -F.col("line_no")))
    units = rows.groupBy(*UNIT, *by, "n").agg(F.count(F.lit(1)).alias("have"), F.sum(F.coalesce("completion_token_count", F.lit(0))).alias("tokens"), best(False).alias("p"), best(True).alias("o"))
    full = units.where("have = n")
    rate = lambda c: F.avg(f"{c}.exact_correct")
    return full.groupBy(*by, "n").agg(
        F.count(F.lit(1)).alias("units"),
        F.sum("tokens").alias("tokens"),
        (F.lit(seconds) * F.col("n") / top).alias("seconds"),
        *(F.avg(f"p.{c}").alias(f"practical_{c}") for c in M.SELECTED),
        *(F.avg(f"o.{c}").alias(f"oracle_{c}") for c in M.SELECTED),
        M.cost_per_exact(F.col("n"), rate("p")).alias("cost_practical"),
        M.cost_per_exact(F.col("n"), rate("o")).alias("cost_oracle"),
    )


def full_units(df: DataFrame, n: int = 8) -> DataFrame:
    """One row for each unit with at least n rows, over its first n: the facts that the headroom reports share."""
    texts = ["difficulty", "completion_token_count", "completion", "extracted_expression"]
    rows = prefix(once(measured(df, texts)), n)
    clipped, f1 = M.is_clipped(), F.col("number_multiset_f1")
    expression = F.nullif(X.without_space(F.col("extracted_expression")), F.lit(""))
    exact, legal = F.col("exact_correct") == 1, F.col("valid_expression") == 1
    unclosed = M.unclosed_answer(F.col("completion"))
    distinct = lambda keep: F.size(F.collect_set(F.when(keep, expression)))
    return (
        rows.groupBy(*UNIT)
        .agg(
            F.count(F.lit(1)).alias("have"),
            F.min_by("difficulty", "pos").alias("difficulty"),
            F.min(F.when(exact, F.col("pos"))).alias("first_exact"),
            F.count_if(exact).alias("exact"),
            F.count_if(legal).alias("legal"),
            F.max("numeric_distance_reward").alias("best_distance"),
            F.coalesce(F.bool_or(clipped), F.lit(False)).alias("clipped"),
            F.coalesce(F.bool_or(clipped & (f1 >= 0.9)), F.lit(False)).alias("clipped_legalish"),
            F.coalesce(F.bool_or(clipped & unclosed), F.lit(False)).alias("clipped_unclosed"),
            distinct(F.lit(True)).alias("distinct_all"),
            distinct(F.col("has_extractable_answer_span") == 1).alias("distinct_span"),
            distinct(legal).alias("distinct_legal"),
        )
        .where(F.col("have") == n)
    )


def solve_curve(units: DataFrame, by: list[str] | None = None, n: int = 8) -> DataFrame:
    """(by, n, newly, solved, rate): units whose first exact row is at position n-1, and at n-1 or before."""
    by = by or []
    spread = units.select(*by, F.explode(F.sequence(F.lit(1), F.lit(n))).alias("n"), "first_exact")
    at = F.coalesce(F.col("first_exact"), F.lit(n)) + 1
    return spread.groupBy(*by, "n").agg(F.count_if(at == F.col("n")).alias("newly"), F.count_if(at <= F.col("n")).alias("solved"), (F.count_if(at <= F.col("n")) / F.count(F.lit(1))).alias("rate"))


def clip_recovery(units: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Among units without an exact row, how many a larger budget of tokens could solve at most, by four bounds."""
    none = F.col("first_exact").isNull()
    either = none & (F.col("clipped_legalish") | F.col("clipped_unclosed"))
    return units.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("units"), F.count_if(none).alias("unsolved"), F.count_if(none & F.col("clipped")).alias("any_clip"), F.count_if(none & F.col("clipped_legalish")).alias("legalish"),
        F.count_if(none & F.col("clipped_unclosed")).alias("unclosed"), F.count_if(either).alias("either"), F.coalesce(F.try_divide(F.count_if(either), F.count_if(none)), F.lit(0.0)).alias("share"),
    )


def diversity(units: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Means over units of distinct expressions without white space: all, with a span, legal; and of legal rows."""
    return units.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("units"), *(F.avg(c).alias(f"avg_{c}") for c in ("distinct_all", "distinct_span", "distinct_legal", "legal")))


def extrapolation(units: DataFrame, by: list[str] | None = None, n: int = 8, targets: tuple[int, ...] = (8, 16, 32, 64, 256, 1024)) -> DataFrame:
    """(by, n, predicted, asymptote): mean of 1-(1-k/n)^N for N more samples from the same distribution."""
    by = by or []
    spread = units.select(*by, "exact", F.explode(F.array(*map(F.lit, targets))).alias("n"))
    return spread.groupBy(*by, "n").agg(F.avg(1 - F.pow(1 - F.col("exact") / n, F.col("n"))).alias("predicted"), F.avg((F.col("exact") > 0).cast("double")).alias("asymptote"))


def near_mass(units: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Among units without an exact row: any legal row, best distance of 0.5 or more, mean best distance."""
    none = units.where("first_exact is null")
    return none.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("unsolved"), F.count_if(F.col("legal") > 0).alias("any_legal"), F.count_if(F.col("best_distance") >= 0.5).alias("near"), F.avg("best_distance").alias("avg_best_distance")
    )


def headroom(df: DataFrame, n: int = 8, target: int = 64) -> DataFrame:
    """What more samples or tokens could bring, over all units, by tier and by bank, in one pass: solved and unsolved
    units, the bound of clipped ones, near and legal unsolved ones, diversity, and the share that ``target`` samples would solve."""
    u = full_units(df, n)
    none = F.col("first_exact").isNull()
    return u.groupingSets([[], [F.col("difficulty")], [F.col("bank")]], F.col("difficulty"), F.col("bank")).agg(
        F.count(F.lit(1)).alias("units"), F.count_if(~none).alias("solved"), F.count_if(none & (F.col("clipped_legalish") | F.col("clipped_unclosed"))).alias("clip_bound"), F.count_if(none & (F.col("legal") > 0)).alias("any_legal"), F.count_if(none & (F.col("best_distance") >= 0.5)).alias("near"),
        F.avg("distinct_legal").alias("avg_distinct_legal"), F.avg("distinct_all").alias("avg_distinct_all"), F.avg(1 - F.pow(1 - F.col("exact") / n, F.lit(target))).alias("predicted"), F.grouping_id().alias("level"),
    )


def candidate_stats(df: DataFrame, by: list[str], cap: int = 256) -> DataFrame:
    """Per group: candidates, legality, exactness among the legal, tokens and clip rate, of rows delivered once."""
    rows = once(measured(df, ["completion_token_count", *[c for c in by if c not in UNIT]]))
    legal, exact = F.col("valid_expression") >= 1, F.col("exact_correct") >= 1
    n = F.count(F.lit(1))
    return rows.groupBy(*by).agg(
        n.alias("candidates"), F.count_if(legal).alias("legal"), (F.count_if(legal) / n).alias("legality"), F.count_if(legal & exact).alias("exact_legal"),
        F.coalesce(F.try_divide(F.count_if(legal & exact), F.count_if(legal)), F.lit(0.0)).alias("exact_given_legal"), F.avg(F.coalesce("completion_token_count", F.lit(0))).alias("tokens"), F.avg(M.is_clipped(cap).cast("double")).alias("clip_rate"),
    )


def seeds_mean_std(per_run: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """Mean and sample deviation over runs; infinite values are left out, all infinite gives infinity, one run 0."""
    out = []
    for v in values:
        finite = F.when(F.abs(F.col(v)) < float("inf"), F.col(v))
        out += [F.coalesce(F.avg(finite), F.lit(float("inf"))).alias(f"{v}_mean"), F.coalesce(F.stddev_samp(finite), F.lit(0.0)).alias(f"{v}_std")]
    return per_run.groupBy(*by).agg(F.count(F.lit(1)).alias("runs"), *out)


def saturation(df: DataFrame, n: int = 8) -> DataFrame:
    """(bank, units, oracle, reranked, gap): exact units by the oracle and by the practical selector."""
    r = best_of_n(df, (n,), ["bank"])
    o, p = F.round(F.col("oracle_exact_correct") * F.col("units")).cast("long"), F.round(F.col("practical_exact_correct") * F.col("units")).cast("long")
    return r.select("bank", "units", o.alias("oracle"), p.alias("reranked"), (o - p).alias("gap"))
