"""The queries of the engine's own operators and, where SQL can say the same, their SQL.

Averages and ratios are rounded to nine digits on both sides, since engines add in different orders.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalmill.functions import arrays as A
from evalmill.functions import keys as K
from evalmill.functions import measures as M
from evalmill.functions import scoring
from evalmill.functions import text as X
from evalmill.functions import verifier as V
from evalmill.operators import audit, banks, control, diagnosis, generate, inference, pairing, reports, sampling
from evalmill.plans import identity, scorecard
from evalmill.session import table
from evalmill.sources import files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL where there is one."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    return df.select(*(F.round(c.name, digits).alias(c.name) if isinstance(c.dataType, (T.DoubleType, T.FloatType)) else F.col(c.name) for c in df.schema))


def _m(x: str) -> str:
    """A metric, with 0 for null and NaN; by way of text, since file statistics may claim that there is no NaN."""
    return f"coalesce(try_cast(nullif(metrics.{x}::VARCHAR, 'nan') AS DOUBLE), 0.0::DOUBLE)"


_SCORE = f"3.0*{_m('valid_expression')} + 2.0*{_m('uses_allowed_numbers')} + 1.5*{_m('number_multiset_f1')} + {_m('uses_allowed_ops')} + {_m('numeric_distance_reward')} - 2.0*{_m('reward_hacking_candidate')}"
_AUX = " + ".join(f"0.2*{_m(k)}" for k in M.AUXILIARY)
#: c: every candidate with the metrics as columns; b: those delivered once; u: with positions.
_BASE = f"""WITH c AS (SELECT * EXCLUDE (metrics, allowed_ops), allowed_ops AS task_ops, metrics IS NULL AS no_metrics, metrics.expression AS m_expression, metrics.error AS m_error, {_SCORE} AS score, {', '.join(f'{_m(x)} AS {x}' for x in (*files.METRICS, 'reward_hacking_candidate'))} FROM candidates),
b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY bank, id, candidate_index ORDER BY line_no) = 1),
u AS (SELECT *, row_number() OVER (PARTITION BY bank, id ORDER BY candidate_index, line_no) - 1 AS pos FROM b)"""
_UNITS = (
    _BASE
    + """, f AS (SELECT bank, id, min_by(difficulty, pos) AS difficulty, min(CASE WHEN exact_correct = 1 THEN pos END) AS first_exact, count(*) FILTER (exact_correct = 1) AS exact, count(*) FILTER (valid_expression = 1) AS legal,
  max(numeric_distance_reward) AS best_distance, coalesce(bool_or(clipped), false) AS clipped, coalesce(bool_or(clipped AND number_multiset_f1 >= 0.9), false) AS clipped_legalish, coalesce(bool_or(clipped AND unclosed), false) AS clipped_unclosed,
  count(DISTINCT e) AS distinct_all, count(DISTINCT e) FILTER (has_extractable_answer_span = 1) AS distinct_span, count(DISTINCT e) FILTER (valid_expression = 1) AS distinct_legal
 FROM (SELECT *, coalesce(completion_token_count >= 256, false) AS clipped, nullif(regexp_replace(extracted_expression, '[\\s\\x{a0}\\x{2000}-\\x{200a}\\x{202f}\\x{3000}]+', '', 'g'), '') AS e,
   regexp_matches(lower(coalesce(completion, '')), '<answer(?:[^<]|<[^/]|</[^a]|</a[^n]|</an[^s]|</ans[^w]|</answ[^e]|</answe[^r]|</answer[^>])*$') AND position('<answer' IN lower(coalesce(completion, ''))) > 0 AS unclosed FROM u WHERE pos < 8)
 GROUP BY bank, id HAVING count(*) = 8)"""
)


def _candidates(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "candidates")


# ---- selection


@query(_BASE + " SELECT bank, id, candidate_index, line_no, round(score, 9) AS score FROM u WHERE pos < 8 QUALIFY row_number() OVER (PARTITION BY bank, id ORDER BY score DESC, candidate_index, line_no) = 1")
def best_of_n_select(s, d):
    return rounded(banks.select_best(_candidates(s, d), 8).select("bank", "id", "candidate_index", "line_no", "score"))


@query(_BASE + " SELECT bank, id, candidate_index, line_no FROM u WHERE pos < 8 QUALIFY row_number() OVER (PARTITION BY bank, id ORDER BY exact_correct DESC, score DESC, candidate_index, line_no) = 1")
def best_of_n_oracle(s, d):
    return banks.select_best(_candidates(s, d), 8, oracle=True).select("bank", "id", "candidate_index", "line_no")


def _report_sql(by: str = "") -> str:
    # selections of each n, then means
    m = ", ".join(f"round(avg({p}.{c}), 9) AS {name}_{c}" for p, name in (("p", "practical"), ("o", "oracle")) for c in M.SELECTED)
    g = f"{by}, " if by else ""
    return (
        _BASE
        + f""", n AS (SELECT unnest([1, 4, 8]) AS n), r AS (SELECT u.*, n.n FROM u JOIN n ON u.pos < n.n), w AS (SELECT bank, id, {g}n, sum(coalesce(completion_token_count, 0)) AS tokens FROM r GROUP BY bank, id, {g}n HAVING count(*) = n),
p AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY bank, id, {g}n ORDER BY score DESC, candidate_index, line_no) = 1), o AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY bank, id, {g}n ORDER BY exact_correct DESC, score DESC, candidate_index, line_no) = 1)
SELECT {'w.' + by + ', ' if by else ''}w.n, count(*) AS units, sum(w.tokens)::BIGINT AS tokens, round(100.0 * w.n / 8, 9) AS seconds, {m}, round(w.n / greatest(avg(p.exact_correct), 1e-12), 9) AS cost_practical, round(w.n / greatest(avg(o.exact_correct), 1e-12), 9) AS cost_oracle
FROM w JOIN p USING (bank, id, {g}n) JOIN o USING (bank, id, {g}n) GROUP BY {'w.' + by + ', ' if by else ''}w.n"""
    )


@query(_report_sql())
def best_of_n_report(s, d):
    return rounded(banks.best_of_n(_candidates(s, d), seconds=100.0))


@query(_report_sql("difficulty"))
def best_of_n_by_tier(s, d):
    return rounded(banks.best_of_n(_candidates(s, d), by=["difficulty"], seconds=100.0))


@query(
    _BASE
    + """, n AS (SELECT bank, id, count(*) AS rows_, count(DISTINCT candidate_index) AS distinct_, max(candidate_index) AS top FROM candidates GROUP BY bank, id), low AS (SELECT bank, id, count(DISTINCT candidate_index) AS l FROM candidates JOIN banks USING (bank) WHERE candidate_index < n_candidates GROUP BY bank, id)
SELECT n.bank, count(*) AS units, sum(rows_)::BIGINT AS "rows", sum(rows_ - distinct_)::BIGINT AS repeated, count(*) FILTER (coalesce(l, 0) < n_candidates) AS incomplete, count(*) FILTER (distinct_ <> top + 1) AS gaps FROM n LEFT JOIN banks USING (bank) LEFT JOIN low ON low.bank = n.bank AND low.id = n.id GROUP BY n.bank"""
)
def bank_integrity(s, d):
    return banks.integrity(_candidates(s, d), table(s, d, "banks"))


@query(_UNITS + ", k AS (SELECT unnest(range(1, 9)) AS n) SELECT difficulty, n::INT AS n, count(*) FILTER (first_exact + 1 = n) AS newly, count(*) FILTER (first_exact + 1 <= n) AS solved, round(count(*) FILTER (first_exact + 1 <= n) / count(*), 9) AS rate FROM f, k GROUP BY difficulty, n")
def solve_curve(s, d):
    return rounded(banks.solve_curve(banks.full_units(_candidates(s, d)), ["difficulty"]))


@query(
    _UNITS
    + """ SELECT difficulty, count(*) AS units, count(*) FILTER (first_exact IS NULL) AS unsolved, count(*) FILTER (first_exact IS NULL AND clipped) AS any_clip, count(*) FILTER (first_exact IS NULL AND clipped_legalish) AS legalish, count(*) FILTER (first_exact IS NULL AND clipped_unclosed) AS unclosed,
 count(*) FILTER (first_exact IS NULL AND (clipped_legalish OR clipped_unclosed)) AS either, round(coalesce(count(*) FILTER (first_exact IS NULL AND (clipped_legalish OR clipped_unclosed)) / nullif(count(*) FILTER (first_exact IS NULL), 0), 0), 9) AS share FROM f GROUP BY difficulty"""
)
def clip_recovery(s, d):
    return rounded(banks.clip_recovery(banks.full_units(_candidates(s, d)), ["difficulty"]))


@query(_UNITS + " SELECT difficulty, count(*) AS units, round(avg(distinct_all), 9) AS avg_distinct_all, round(avg(distinct_span), 9) AS avg_distinct_span, round(avg(distinct_legal), 9) AS avg_distinct_legal, round(avg(legal), 9) AS avg_legal FROM f GROUP BY difficulty")
def diversity(s, d):
    return rounded(banks.diversity(banks.full_units(_candidates(s, d)), ["difficulty"]))


@query(_UNITS + ", k AS (SELECT unnest([8, 16, 32, 64, 256, 1024]) AS n) SELECT n::INT AS n, round(avg(1 - pow(1 - exact / 8.0::DOUBLE, n)), 9) AS predicted, round(avg((exact > 0)::INT), 9) AS asymptote FROM f, k GROUP BY n")
def n_extrapolation(s, d):
    return rounded(banks.extrapolation(banks.full_units(_candidates(s, d))))


@query(_UNITS + " SELECT difficulty, count(*) AS unsolved, count(*) FILTER (legal > 0) AS any_legal, count(*) FILTER (best_distance >= 0.5) AS near, round(avg(best_distance), 9) AS avg_best_distance FROM f WHERE first_exact IS NULL GROUP BY difficulty")
def near_mass(s, d):
    return rounded(banks.near_mass(banks.full_units(_candidates(s, d)), ["difficulty"]))


@query(
    _UNITS
    + """ SELECT difficulty, bank, count(*) AS units, count(*) FILTER (first_exact IS NOT NULL) AS solved, count(*) FILTER (first_exact IS NULL AND (clipped_legalish OR clipped_unclosed)) AS clip_bound, count(*) FILTER (first_exact IS NULL AND legal > 0) AS any_legal, count(*) FILTER (first_exact IS NULL AND best_distance >= 0.5) AS near, round(avg(distinct_legal), 9) AS avg_distinct_legal, round(avg(distinct_all), 9) AS avg_distinct_all, round(avg(1 - pow(1 - exact / 8.0::DOUBLE, 64)), 9) AS predicted, (2 * grouping(difficulty) + grouping(bank))::BIGINT AS level
FROM f GROUP BY GROUPING SETS ((), (difficulty), (bank))"""
)
def headroom_report(s, d):
    return rounded(banks.headroom(_candidates(s, d)))


@query(
    _BASE
    + """ SELECT bank, difficulty, count(*) AS candidates, count(*) FILTER (valid_expression >= 1) AS legal, round(count(*) FILTER (valid_expression >= 1) / count(*), 9) AS legality, count(*) FILTER (valid_expression >= 1 AND exact_correct >= 1) AS exact_legal,
 round(coalesce(count(*) FILTER (valid_expression >= 1 AND exact_correct >= 1) / nullif(count(*) FILTER (valid_expression >= 1), 0), 0), 9) AS exact_given_legal, round(avg(coalesce(completion_token_count, 0)), 9) AS tokens, round(avg(coalesce(completion_token_count >= 256, false)::INT), 9) AS clip_rate FROM b GROUP BY bank, difficulty"""
)
def candidate_stats(s, d):
    return rounded(banks.candidate_stats(_candidates(s, d), ["bank", "difficulty"]))


_RUNS = _report_sql("bank").replace("SELECT w.bank, w.n,", ", per AS (SELECT w.bank, w.n,", 1) + ")"


@query(
    _RUNS
    + """ SELECT method, n, count(*) AS runs, round(coalesce(avg(practical_exact_correct), 'inf'::DOUBLE), 9) AS practical_exact_correct_mean, round(coalesce(stddev_samp(practical_exact_correct), 0), 9) AS practical_exact_correct_std,
 round(coalesce(avg(cost) FILTER (cost < 1e11), 'inf'::DOUBLE), 9) AS cost_mean, round(coalesce(stddev_samp(cost) FILTER (cost < 1e11), 0), 9) AS cost_std FROM (SELECT *, cost_practical AS cost FROM per) JOIN banks USING (bank) GROUP BY method, n"""
)
def mean_std_over_runs(s, d):
    per = rounded(banks.best_of_n(_candidates(s, d), by=["bank"], seconds=100.0)).join(table(s, d, "banks").select("bank", "method"), "bank")
    per = per.withColumn("cost", F.when(F.col("cost_practical") >= 1e11, float("inf")).otherwise(F.col("cost_practical")))
    return rounded(banks.seeds_mean_std(per, ["method", "n"], ["practical_exact_correct", "cost"]))


@query(_report_sql("bank").replace("SELECT w.bank, w.n,", ", per AS (SELECT w.bank, w.n,", 1) + ") SELECT bank, units, round(oracle_exact_correct * units)::BIGINT AS oracle, round(practical_exact_correct * units)::BIGINT AS reranked, (round(oracle_exact_correct * units) - round(practical_exact_correct * units))::BIGINT AS gap FROM per WHERE n = 8")
def selection_saturation(s, d):
    return banks.saturation(_candidates(s, d))


# ---- diagnosis

_CLASS = """CASE WHEN exact_correct > 0 THEN 'exact_correct' WHEN has_extractable_answer_span <= 0 THEN 'no_answer_span' WHEN parse_ok <= 0 THEN 'parse_failure' WHEN uses_no_extra_numbers <= 0 THEN 'illegal_extra_or_repeated_number' WHEN uses_all_required_numbers <= 0 THEN 'missing_required_number'
 WHEN uses_allowed_ops <= 0 THEN 'illegal_operator' WHEN evaluates_without_exception <= 0 THEN 'evaluation_error' WHEN valid_expression > 0 THEN 'legal_but_wrong_value' WHEN (length(coalesce(completion, '')) - length(replace(coalesce(completion, ''), '</answer>', ''))) / 9 > 1 THEN 'repeated_answer_tag' ELSE 'other_invalid' END"""


@query(_BASE + f" SELECT bank, label, count(*) AS \"rows\", round(count(*) / sum(count(*)) OVER (PARTITION BY bank), 9) AS share FROM (SELECT bank, {_CLASS} AS label FROM c) GROUP BY bank, label")
def taxonomy_counts(s, d):
    return rounded(diagnosis.taxonomy(_candidates(s, d), ["bank"]))


@query(_BASE + f" SELECT label, line_no, id, target, completion, m_expression AS expression, m_error AS error FROM (SELECT *, {_CLASS} AS label FROM c) QUALIFY row_number() OVER (PARTITION BY label ORDER BY line_no) = 1")
def taxonomy_examples(s, d):
    return diagnosis.taxonomy_examples(_candidates(s, d))


@query(_BASE + " SELECT difficulty, count(*) AS \"rows\", " + ", ".join(f"round(avg({x}), 9) AS {x}" for x in M.SELECTED) + ", grouping(difficulty)::BIGINT AS level FROM c GROUP BY ROLLUP (difficulty)")
def eval_by_difficulty(s, d):
    return rounded(diagnosis.rollup_means(_candidates(s, d), M.SELECTED))


@query(
    _BASE
    + f""", e AS (SELECT bank, correct AS p, {' + '.join(f'0.2*{k}' for k in M.AUXILIARY)} AS a, contains_open_answer_tag AS o, contains_close_answer_tag AS cl, has_extractable_answer_span AS sp, parse_ok, uses_allowed_numbers, uses_allowed_ops, exact_correct, format FROM c)
SELECT bank, count(*) AS "rows", round(avg(p), 9) AS primary_mean, round(coalesce(stddev_samp(p), 0), 9) AS primary_std, round(avg(a), 9) AS auxiliary_mean, round(coalesce(stddev_samp(a), 0), 9) AS auxiliary_std, round(avg(p + a), 9) AS total_mean, round(coalesce(stddev_samp(p + a), 0), 9) AS total_std,
 round(avg(o), 9) AS open_tag, round(avg(cl), 9) AS close_tag, round(avg(sp), 9) AS span, round(avg(parse_ok), 9) AS parseable, round(avg(uses_allowed_numbers), 9) AS numbers, round(avg(uses_allowed_ops), 9) AS operators, round(avg(exact_correct), 9) AS exact, round(avg(sp) - avg(parse_ok), 9) AS tag_only,
 round(avg((sp > 0 AND parse_ok = 0)::INT), 9) AS tag_only_observed, round(avg(parse_ok) - avg(exact_correct), 9) AS parseable_but_wrong, round(avg(exact_correct) / greatest(avg(parse_ok), 1e-12), 9) AS correct_given_parseable, round(avg((format > 0)::INT), 9) AS format_nonzero, coalesce(stddev_samp(format), 0) > 1e-9 AS format_varies FROM e GROUP BY bank"""
)
def run_health(s, d):
    return rounded(diagnosis.reward_health(_candidates(s, d), ["bank"]))


@query(f"SELECT count(*) AS batches, round(avg((s > 1e-9)::INT), 9) AS varying FROM (SELECT coalesce(stddev_samp({_m('correct')} + {_AUX}), 0) AS s FROM candidates GROUP BY bank, line_no // 16)")
def run_health_batch_variance(s, d):
    return rounded(diagnosis.batch_variance(_candidates(s, d).withColumn("batch", F.floor(F.col("line_no") / 16)), ["bank", "batch"], M.total_reward()))


_GROUPS = f"""WITH g AS (SELECT bank, line_no // 16 AS batch, line_no, round({_m('correct')} + ({_AUX}), 9) AS r FROM candidates), p AS (SELECT *, (row_number() OVER (PARTITION BY bank, batch ORDER BY line_no) - 1) // 4 AS grp FROM g),
q AS (SELECT *, row_number() OVER (PARTITION BY bank, batch, grp ORDER BY line_no) - 1 AS i, avg(r) OVER (PARTITION BY bank, batch, grp) AS mean FROM p)"""


def _grouped(s, d):
    rows = _candidates(s, d).select("bank", F.floor(F.col("line_no") / 16).cast("long").alias("batch"), "line_no", F.round(M.total_reward(), 9).alias("r"))
    return diagnosis.positional_groups(rows, ["bank", "batch"], ["line_no"], 4)


@query(_GROUPS + ' SELECT bank, batch::BIGINT AS batch, grp::BIGINT AS grp, count(*) AS "rows", round(stddev_pop(r), 7) AS spread FROM p GROUP BY ALL')
def positional_groups(s, d):
    return rounded(_grouped(s, d).groupBy("bank", "batch", "grp").agg(F.count(F.lit(1)).alias("rows"), F.stddev_pop("r").alias("spread")), 7)


@query(_GROUPS + ' SELECT bank, batch::BIGINT AS batch, grp::BIGINT AS grp, count(*) AS "rows", arg_max(i, (r, -i))::INT AS top, round(stddev_pop(r), 7) AS spread, array_to_string(list(i ORDER BY i) FILTER (r > mean + 1e-12), \',\') AS positive FROM q GROUP BY ALL')
def group_advantage(s, d):
    g = diagnosis.group_structure(_grouped(s, d), ["bank", "batch", "grp"], ["line_no"], F.col("r"))
    return rounded(g.withColumn("positive", F.nullif(F.array_join(F.col("positive").cast("array<string>"), ","), F.lit(""))), 7)


_DIFF = f"WITH c AS (SELECT bank, line_no // 16 AS batch, avg({_m('format')}) AS a, avg({_m('valid_expression')}) AS b FROM candidates GROUP BY ALL), s AS (SELECT bank, abs(a - lag(a) OVER w) AS x, abs(b - lag(b) OVER w) AS y FROM c WINDOW w AS (PARTITION BY bank ORDER BY batch))"


@query(_DIFF + " SELECT bank, count(*) AS steps, round(avg(x + y), 9) AS mean_l1, round(max(greatest(x, y)), 9) AS max_linf FROM s WHERE x IS NOT NULL GROUP BY bank")
def weight_diff_l1_linf(s, d):
    b = _candidates(s, d).groupBy("bank", F.floor(F.col("line_no") / 16).alias("batch")).agg(F.avg(M.metric("format")).alias("a"), F.avg(M.metric("valid_expression")).alias("b"))
    return rounded(diagnosis.consecutive_change(b, ["bank"], ["batch"], ["a", "b"]))


@query(f"WITH b AS (SELECT bank, line_no // 16 AS batch, avg({_m('correct')}) AS p FROM candidates GROUP BY ALL), l AS (SELECT bank, list(p ORDER BY batch) AS v FROM b GROUP BY bank) SELECT bank, len(v)::INT AS steps, round(list_sum(list_transform(v, lambda x, i: x * 0.1 * pow(0.9, len(v) - i))), 9) AS ema FROM l")
def ema_fold(s, d):
    b = _candidates(s, d).groupBy("bank", F.floor(F.col("line_no") / 16).alias("batch")).agg(F.avg(M.primary_reward()).alias("p"))
    return rounded(control.ema(b, "bank", "batch", "p"))


@query("SELECT user_id, arg_min(value, event_id) AS first, arg_max(value, event_id) AS last FROM events GROUP BY user_id")
def first_last(s, d):
    return diagnosis.first_last(table(s, d, "events"), ["user_id"], "event_id", "value")


_OOD = _BASE.replace("FROM candidates)", "FROM candidates JOIN (SELECT bank, method FROM banks) USING (bank))", 1)


@query(
    _OOD
    + """, st AS (SELECT method, count(*) AS candidates, count(*) FILTER (valid_expression > 0) / count(*) AS legal_rate, avg(number_multiset_f1) AS f1_mean, coalesce(count(*) FILTER (exact_correct > 0) / nullif(count(*) FILTER (valid_expression > 0), 0), 0) AS exact_given_legal, count(*) FILTER (exact_correct > 0) / count(*) AS exact_rate,
 avg(coalesce(contains(extracted_expression, '/'), false)::INT) AS division_rate, avg(coalesce(completion_token_count >= 256, false)::INT) AS truncation_rate, avg(coalesce(completion_token_count, 0)) AS mean_tokens FROM b GROUP BY method),
so AS (SELECT method, count(*) AS units, count(*) FILTER (e > 0) AS oracle FROM (SELECT method, bank, id, max(exact_correct) AS e FROM u WHERE pos < 8 GROUP BY ALL) GROUP BY method), a AS (SELECT * FROM st JOIN so USING (method)), z AS (SELECT * FROM a WHERE method = 'static')
SELECT a.method, a.candidates, a.units, round(a.legal_rate, 9) AS legal_rate, round(a.f1_mean, 9) AS f1_mean, round(a.exact_given_legal, 9) AS exact_given_legal, round(a.exact_rate, 9) AS exact_rate, a.oracle, round(a.division_rate, 9) AS division_rate, round(a.truncation_rate, 9) AS truncation_rate, round(a.mean_tokens, 9) AS mean_tokens,
 round(a.legal_rate - z.legal_rate, 9) AS legal_vs_base, round(a.division_rate - z.division_rate, 9) AS division_vs_base, a.oracle - z.oracle AS oracle_vs_base FROM a, z"""
)
def ood_vs_base(s, d):
    return rounded(diagnosis.out_of_distribution(_candidates(s, d).join(table(s, d, "banks").select("bank", "method"), "bank"), "method", base="static"))


_SHIFT = _BASE + """, w AS (SELECT difficulty, count(*) FILTER (prompt_field = 'prompt_high') AS nh, count(*) FILTER (prompt_field = 'prompt_low') AS nm, avg((valid_expression > 0)::INT) FILTER (prompt_field = 'prompt_high') AS lh, avg((valid_expression > 0)::INT) FILTER (prompt_field = 'prompt_low') AS lm,
 coalesce(avg(number_multiset_f1) FILTER (prompt_field = 'prompt_high' AND p), 0) AS fh, coalesce(avg(number_multiset_f1) FILTER (prompt_field = 'prompt_low' AND p), 0) AS fm FROM (SELECT *, evaluates_without_exception > 0 OR valid_expression > 0 OR (m_expression IS NOT NULL AND number_multiset_f1 > 0) AS p FROM b) GROUP BY difficulty)"""


@query(_SHIFT + " SELECT difficulty, round(lh, 9) AS legal_strong, round(lm, 9) AS legal_weak, round(lh - lm, 9) AS legal_loss, round(fh, 9) AS f1_strong, round(fm, 9) AS f1_weak, round(fh - fm, 9) AS f1_loss FROM w WHERE nh > 0 AND nm > 0")
def prompt_shift_pivot(s, d):
    return rounded(diagnosis.prompt_shift(_candidates(s, d), ["difficulty"], weak="prompt_low"))


@query(
    _BASE
    + ", k AS (SELECT line_no // 16 AS batch, bank, valid_expression AS ref, unnest(["
    + ", ".join(f"{{'name': '{x}', 'v': {x}}}" for x in M.AUXILIARY)
    + """]) AS x FROM c), p AS (SELECT bank, batch, x.name AS name, stddev_pop(x.v) AS s, sum(x.v) AS t, count(*) AS n, bool_and(x.v = ref) AS same FROM k GROUP BY ALL)
SELECT name, round(avg(s), 9) AS mean_spread, round(avg((s > 1e-9)::INT), 9) AS varying, round(sum(t) / sum(n), 9) AS mean, bool_and(same) AND name <> 'valid_expression' AS same_as_reference, avg(s) > 0.01 AND NOT (bool_and(same) AND name <> 'valid_expression') AS kept FROM p GROUP BY name"""
)
def aux_prune(s, d):
    return rounded(diagnosis.prune_components(_candidates(s, d).withColumn("batch", F.floor(F.col("line_no") / 16)), ["bank", "batch"], M.AUXILIARY))


@query("SELECT bank, count(*) AS \"rows\", round(avg(completion_token_count), 9) AS mean, median(completion_token_count) AS median, round(avg((completion_token_count >= 256)::INT), 9) AS capped FROM candidates WHERE completion_token_count IS NOT NULL GROUP BY bank")
def completion_lengths(s, d):
    return rounded(diagnosis.length_stats(_candidates(s, d), ["bank"]))


_KEY = "(list_sort(numbers), target, list_sort(list_distinct(allowed_ops)))"


@query(
    _BASE
    + f""", g AS (SELECT DISTINCT {_KEY} AS k, replace(solution, ' ', '') AS s FROM tasks WHERE lower(trim(split)) = 'train' AND solution IS NOT NULL AND numbers IS NOT NULL AND target IS NOT NULL AND allowed_ops IS NOT NULL), e AS (SELECT {_KEY.replace('allowed_ops', 'task_ops')} AS k, replace(m_expression, ' ', '') AS s FROM c WHERE exact_correct > 0)
SELECT count(*) AS exact_on_known, count(*) FILTER (EXISTS (SELECT 1 FROM g WHERE g.k = e.k AND g.s = e.s)) AS verbatim, count(*) FILTER (NOT EXISTS (SELECT 1 FROM g WHERE g.k = e.k AND g.s = e.s)) AS novel FROM e WHERE EXISTS (SELECT 1 FROM g WHERE g.k = e.k)"""
)
def verbatim_vs_novel(s, d):
    return diagnosis.verbatim_and_novel(_candidates(s, d), table(s, d, "tasks"))


# ---- comparisons and tests

_OUT = _OOD + ", s AS (SELECT method, id, exact_correct, difficulty FROM u WHERE pos < 8 QUALIFY row_number() OVER (PARTITION BY bank, id ORDER BY score DESC, candidate_index, line_no) = 1), t AS (SELECT method, id, max((exact_correct > 0)::INT) AS outcome, avg(exact_correct) AS rate, min(difficulty) AS difficulty FROM s GROUP BY method, id), pr AS (SELECT a.method, a.id, a.difficulty, a.outcome AS arm, z.outcome AS base FROM t a JOIN t z USING (id) WHERE z.method = 'static' AND a.method <> 'static')"


def _pairs(s, d):
    rows = _candidates(s, d)
    t = banks.select_best(rows, 8).join(table(s, d, "banks").select("bank", "method"), "bank").groupBy("method", "id").agg(F.max((F.col("exact_correct") > 0).cast("int")).alias("outcome"), F.avg("exact_correct").alias("rate"))
    tiers = rows.where("difficulty is not null").groupBy("id").agg(F.min("difficulty").alias("difficulty"))
    p = t.where("method <> 'static'").select("method", "id", F.col("outcome").alias("arm")).join(t.where("method = 'static'").select("id", F.col("outcome").alias("base")), "id")
    return p.join(tiers, "id")


_COUNTS = "count(*) AS n, count(*) FILTER (arm > 0 AND base > 0) AS \"both\", count(*) FILTER (arm > 0 AND base = 0) AS arm_only, count(*) FILTER (arm = 0 AND base > 0) AS base_only, count(*) FILTER (arm = 0 AND base = 0) AS neither, round((count(*) FILTER (arm > 0) - count(*) FILTER (base > 0)) / count(*), 9) AS delta"


@query(_OUT + f" SELECT method, {_COUNTS} FROM pr GROUP BY method")
def paired_2x2(s, d):
    return rounded(pairing.paired_counts(_pairs(s, d), ["method"]))


_SUB = ", sb AS (SELECT *, unnest(list_filter([CASE WHEN difficulty = 'easy' THEN 'easy' END, CASE WHEN difficulty IN ('easy', 'medium') THEN 'easy_medium' END, 'all'], lambda x: x IS NOT NULL)) AS subset FROM pr)"


@query(_OUT + _SUB + f" SELECT method, subset, {_COUNTS} FROM sb GROUP BY method, subset")
def tier_subset_pairs(s, d):
    return rounded(pairing.paired_counts(pairing.in_subsets(_pairs(s, d)), ["method", "subset"]))


@query(_OUT + _SUB + f", q AS (SELECT subset, {_COUNTS} FROM sb GROUP BY subset), o AS (SELECT max(delta) FILTER (subset = 'easy') AS easy, max(delta) FILTER (subset = 'all') AS \"all\", max(n) FILTER (subset = 'easy') AS easy_tasks, max(n) FILTER (subset = 'all') AS all_tasks FROM q) SELECT easy, \"all\", round(CASE WHEN \"all\" <> 0 THEN easy / \"all\" END, 9) AS ratio, easy_tasks, all_tasks FROM o")
def dilution(s, d):
    return rounded(pairing.dilution(rounded(pairing.paired_counts(pairing.in_subsets(_pairs(s, d)), ["subset"]))))


@query(_OOD + " SELECT method, split, difficulty, count(*) AS n, round(avg((exact_correct > 0)::INT), 9) AS rate FROM (SELECT b.method, b.difficulty, b.exact_correct, banks.split FROM b JOIN banks USING (bank)) GROUP BY GROUPING SETS ((method, split, difficulty), (method, difficulty))")
def tier_rates_grouping_sets(s, d):
    rows = banks.once(banks.measured(_candidates(s, d), ["difficulty"])).join(table(s, d, "banks").select("bank", "method", "split"), "bank")
    return rounded(pairing.tier_rates(rows.withColumn("e", F.col("exact_correct") > 0), ["method"], ["split"], "difficulty", "e"))


@query(_OUT + ", q AS (SELECT method, count(*) FILTER (arm > 0 AND base = 0) AS b, count(*) FILTER (arm = 0 AND base > 0) AS c FROM pr GROUP BY method) SELECT method, b, c, round(CASE WHEN b + c = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, least(b, c) + 1), lambda i: exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) + (b + c) * ln(0.5))))) END, 9) AS p FROM q")
def mcnemar_exact(s, d):
    q = pairing.paired_counts(_pairs(s, d), ["method"]).select("method", F.col("arm_only").alias("b"), F.col("base_only").alias("c"))
    return rounded(q.withColumn("p", F.when(F.col("b") + F.col("c") <= 1000, inference.mcnemar_p(F.col("b"), F.col("c"))).otherwise(inference.mcnemar_large("b", "c"))))


#: erfc by its series, exact to nine digits where it is above 1e-9.
_ERFC = "CASE WHEN {x} > 4.5 THEN 0.0 ELSE 1 - 1.1283791670955126 * list_sum(list_transform(range(0, 90), lambda k: CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END * exp((2 * k + 1) * ln(greatest({x}, 1e-300)) - lgamma(k + 1)) / (2 * k + 1))) END"


@query(
    _OOD
    + f""", st AS (SELECT method, count(*) FILTER (valid_expression >= 1) AS n, count(*) FILTER (valid_expression >= 1 AND exact_correct >= 1) AS k FROM b GROUP BY method), j AS (SELECT a.method, a.k / nullif(a.n, 0) AS p1, z.k / nullif(z.n, 0) AS p2, (a.k + z.k) / nullif(a.n + z.n, 0) AS pool, 1 / nullif(a.n, 0) + 1 / nullif(z.n, 0) AS v FROM st a, st z WHERE z.method = 'static'),
x AS (SELECT method, abs(p1 - p2) / nullif(sqrt(pool * (1 - pool) * v), 0) / sqrt(2) AS x FROM j) SELECT method, round(coalesce(CASE WHEN x = 0 THEN 1.0 ELSE {_ERFC.format(x='x')} END, 1.0), 9) AS p FROM x"""
)
def two_proportion_z(s, d):
    stats = banks.candidate_stats(_candidates(s, d).join(table(s, d, "banks").select("bank", "method"), "bank"), ["method"])
    z = stats.where("method = 'static'").select(F.col("exact_legal").alias("k0"), F.col("legal").alias("n0"))
    j = stats.crossJoin(F.broadcast(z))  # one row
    return rounded(j.select("method", inference.two_proportion_p(F.col("exact_legal"), F.col("legal"), F.col("k0"), F.col("n0")).alias("p")))


_MCNEMAR = "round(CASE WHEN b + c = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, least(b, c) + 1), lambda i: exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) + (b + c) * ln(0.5))))) END, 9)"
_TIER_P = _OUT + f", q AS (SELECT method || ' ' || difficulty AS name, count(*) FILTER (arm > 0 AND base = 0) AS b, count(*) FILTER (arm = 0 AND base > 0) AS c FROM pr GROUP BY method, difficulty), v AS (SELECT name, {_MCNEMAR} AS p FROM q)"


@query(_TIER_P + ", h AS (SELECT name, p, least(1.0, (count(*) OVER () - row_number() OVER (ORDER BY p, name) + 1) * p) AS step FROM v) SELECT name, p, round(max(step) OVER (ORDER BY p, name ROWS UNBOUNDED PRECEDING), 9) AS adjusted, max(step) OVER (ORDER BY p, name ROWS UNBOUNDED PRECEDING) < 0.05 AS reject FROM h")
def holm_adjust(s, d):
    cells = pairing.paired_counts(_pairs(s, d), ["method", "difficulty"])
    x, y = F.col("arm_only"), F.col("base_only")
    p = F.when(x + y <= 1000, inference.mcnemar_p(x, y)).otherwise(inference.mcnemar_large("arm_only", "base_only"))
    return rounded(inference.holm(cells.select(F.concat_ws(" ", "method", "difficulty").alias("name"), F.round(p, 9).alias("p"))))


@query("SELECT event_type, round(quantile_cont(value, 0.025), 9) AS low, round(quantile_cont(value, 0.975), 9) AS high FROM events GROUP BY event_type")
def percentile_interval(s, d):
    return rounded(inference.percentile_interval(table(s, d, "events"), "value", ["event_type"]))


def _drawn(*parts: str) -> str:
    """A number in [0, 1) hashed from the seed and the parts, as ``inference`` does."""
    return "(('0x' || substring(md5('17:' || " + " || ':' || ".join(parts) + "), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def _times(*parts: str) -> str:
    """How often a unit is drawn."""
    return "(CASE " + " ".join(f"WHEN {_drawn(*parts)} < {p!r} THEN {k}" for k, p in enumerate(inference.POISSON)) + f" ELSE {len(inference.POISSON)} END)::DOUBLE"


def _flips_sql(by: str, effects: str = "ef") -> str:
    """sz and fp: p of the sign flips by group, of a table of by, key, effect; exact up to 20 effects, else 2000 draws."""
    return f""", sz AS (SELECT {by}, count(*) FILTER (abs(effect) > 1e-15)::INT AS nonzero, abs(sum(CASE WHEN abs(effect) > 1e-15 THEN effect ELSE 0 END)) AS seen FROM {effects} GROUP BY {by}),
kn AS (SELECT e.*, sz.nonzero, sz.seen FROM {effects} e JOIN sz USING ({by}) WHERE abs(effect) > 1e-15), mc AS (SELECT {by}, seen, draw, sum(effect * CASE WHEN {_drawn("'sign'", 'draw', 'key')} < 0.5 THEN -1.0 ELSE 1.0 END) AS t FROM kn, (SELECT unnest(range(0, 2000)) AS draw) WHERE nonzero > 20 GROUP BY {by}, seen, draw),
fw AS (SELECT {by}, seen, list(effect ORDER BY effect) AS v FROM kn WHERE nonzero <= 20 GROUP BY {by}, seen), cd AS (SELECT *, unnest(range(0, (1::BIGINT << len(v))::BIGINT)) AS code FROM fw),
fp AS (SELECT {by}, count(*) AS assignments, (count(*) FILTER (abs(t) >= seen - 1e-12) + 1) / (count(*) + 1) AS p FROM mc GROUP BY {by} UNION ALL SELECT {by}, count(*), count(*) FILTER (abs(list_sum(list_transform(v, lambda x, i: x * (1 - 2 * ((code >> (i - 1)) & 1))))) >= seen - 1e-12) / count(*) FROM cd GROUP BY {by})"""


_EFFECT = _OUT + ", ef AS (SELECT method, id AS key, (arm - base)::DOUBLE AS effect FROM pr)"
_MEANS = f", dr AS (SELECT method, draw, sum(effect * w) / nullif(sum(w), 0) AS mean FROM (SELECT method, effect, draw, {_times('draw', 'key')} AS w FROM ef, (SELECT unnest(range(0, 2000)) AS draw)) GROUP BY method, draw)"


@query(_EFFECT + _MEANS + " SELECT method, draw::INT AS draw, round(mean, 9) AS mean FROM dr")
def task_bootstrap_means(s, d):
    effects = _pairs(s, d).select("method", "id", (F.col("arm") - F.col("base")).alias("effect"))
    return rounded(inference.task_bootstrap(effects, "id", ["effect"], by=["method"]).select("method", "draw", F.try_divide("effect", "weight").alias("mean")))


@query(_EFFECT + _flips_sql("method") + " SELECT sz.method, nonzero, coalesce(assignments, 1) AS assignments, round(coalesce(p, 1.0), 9) AS p FROM sz LEFT JOIN fp ON sz.method = fp.method")
def sign_flip_test(s, d):
    return rounded(inference.sign_flips(_pairs(s, d).select("method", "id", (F.col("arm") - F.col("base")).alias("effect")), "id", "effect", by=["method"]))


@query(
    _EFFECT + _MEANS + _flips_sql("method")
    + """, iv AS (SELECT method, quantile_cont(mean, 0.025) AS low, quantile_cont(mean, 0.975) AS high FROM dr GROUP BY method), pt AS (SELECT method, count(*) AS tasks, avg(effect) AS estimate FROM ef GROUP BY method)
SELECT pt.method, tasks, round(estimate, 9) AS estimate, round(low, 9) AS low, round(high, 9) AS high, nonzero, coalesce(assignments, 1) AS assignments, round(coalesce(p, 1.0), 9) AS p FROM pt JOIN iv USING (method) JOIN sz USING (method) LEFT JOIN fp USING (method)"""
)
def clustered_difference(s, d):
    return rounded(inference.clustered_difference(_pairs(s, d), "id", "arm", "base", by=["method"]))


@query(
    f"""WITH e AS (SELECT event_type AS run, user_id AS key, avg(value) AS effect FROM events GROUP BY event_type, user_id), ok AS (SELECT key FROM e GROUP BY key HAVING count(*) = (SELECT count(DISTINCT event_type) FROM events)), p AS (SELECT e.* FROM e JOIN ok USING (key)),
w AS (SELECT draw, effect, {_times('draw', 'key')} * {_times("'run'", 'draw', 'run')} AS w FROM p, (SELECT unnest(range(0, 500)) AS draw)), m AS (SELECT draw, sum(w * effect) / nullif(sum(w), 0) AS mean FROM w GROUP BY draw)
SELECT (SELECT count(DISTINCT key) FROM p) AS tasks, (SELECT count(DISTINCT run) FROM p) AS runs, round((SELECT avg(effect) FROM p), 7) AS estimate, round(quantile_cont(mean, 0.025), 7) AS low, round(quantile_cont(mean, 0.975), 7) AS high FROM m"""
)
def product_bootstrap(s, d):
    """Users play the tasks and event types the runs: the one panel of the tables in which most units are in every run."""
    e = table(s, d, "events").groupBy(F.col("event_type").alias("run"), F.col("user_id").alias("key")).agg(F.avg("value").alias("effect"))
    runs = e.agg(F.count_distinct("run").alias("runs"))
    whole = e.groupBy("key").count().join(F.broadcast(runs), F.col("count") == F.col("runs")).select("key")
    return rounded(inference.product_bootstrap(e.join(whole, "key"), "key", "run", "effect", draws=500), 7)


_TASK = "'{\"allowed_ops\":' || to_json(list_sort(list_distinct(OPS))) || ',\"numbers\":' || to_json(list_sort(numbers)) || ',\"target\":' || target || '}'"
_WHOLE_TASK = "numbers IS NOT NULL AND target IS NOT NULL AND OPS IS NOT NULL"
_COMPONENTS = _BASE + f", tc AS (SELECT bank, {_TASK.replace('OPS', 'task_ops')} AS task, count(*) AS candidates, count(*) FILTER (valid_expression >= 1) AS legal, count(*) FILTER (valid_expression >= 1 AND exact_correct >= 1) AS exact_legal, count(*) FILTER (valid_expression >= 1) / count(*) AS legality, count(DISTINCT id) = 1 AND max(candidate_index) + 1 = count(*) AS whole FROM b WHERE {_WHOLE_TASK.replace('OPS', 'task_ops')} GROUP BY ALL)"


@query(_COMPONENTS + " SELECT bank, task, candidates, legal, exact_legal, round(legality, 9) AS legality, whole FROM tc")
def task_components(s, d):
    return rounded(scorecard.task_components(_candidates(s, d)))


_RATIO = "CASE WHEN {1} > 0 AND {3} > 0 THEN {0} / {1} - {2} / {3} END"


@query(
    _COMPONENTS
    + f""", pm AS (SELECT method, task, avg(legality) AS legality, sum(exact_legal) AS exact, sum(legal) AS legal FROM tc JOIN banks USING (bank) GROUP BY method, task), tr AS (SELECT DISTINCT {_TASK.replace('OPS', 'allowed_ops')} AS task FROM tasks WHERE lower(trim(split)) = 'train' AND {_WHOLE_TASK.replace('OPS', 'allowed_ops')}),
pn AS (SELECT a.method, a.task AS key, a.legality - z.legality AS effect, a.exact AS an, a.legal AS ad, z.exact AS bn, z.legal AS bd, unnest(['all', CASE WHEN tr.task IS NULL THEN 'held_out' ELSE 'overlap' END]) AS scope FROM pm a JOIN pm z ON a.task = z.task AND z.method = 'static' LEFT JOIN tr ON tr.task = a.task WHERE a.method <> 'static'),
ef AS (SELECT method, scope, key, effect FROM pn), dr AS (SELECT method, scope, draw, sum(effect * w) / nullif(sum(w), 0) AS mean, {_RATIO.format('sum(an * w)', 'sum(ad * w)', 'sum(bn * w)', 'sum(bd * w)')} AS ratio FROM (SELECT *, {_times('draw', 'key')} AS w FROM pn, (SELECT unnest(range(0, 2000)) AS draw)) GROUP BY method, scope, draw)"""
    + _flips_sql("method, scope")
    + f""", iv AS (SELECT method, scope, quantile_cont(mean, 0.025) AS l, quantile_cont(mean, 0.975) AS h, quantile_cont(ratio, 0.025) AS rl, quantile_cont(ratio, 0.975) AS rh, count(*) FILTER (ratio IS NULL) AS dropped FROM dr GROUP BY method, scope),
pt AS (SELECT method, scope, count(*) AS tasks, avg(effect) AS legality, {_RATIO.format('sum(an)', 'sum(ad)', 'sum(bn)', 'sum(bd)')} AS exact FROM pn GROUP BY method, scope), al AS (SELECT *, CASE WHEN exact IS NULL THEN 'an observed denominator is 0' WHEN dropped > 20 THEN 'too many draws have an empty denominator' END AS reason FROM pt JOIN iv USING (method, scope) JOIN sz USING (method, scope) LEFT JOIN fp USING (method, scope))
SELECT method, scope, tasks, round(legality, 9) AS legality, round(l, 9) AS legality_low, round(h, 9) AS legality_high, round(coalesce(p, 1.0), 9) AS legality_p, round(exact, 9) AS exact, CASE WHEN reason IS NULL THEN round(rl, 9) END AS exact_low, CASE WHEN reason IS NULL THEN round(rh, 9) END AS exact_high, dropped, reason FROM al"""
)
def clustered_scopes(s, d):
    return rounded(scorecard.clustered_scopes(_candidates(s, d), table(s, d, "tasks"), table(s, d, "banks"), "static"))


# ---- audits, keys, samples


@query(f"SELECT lower(trim(split)) AS split, count(*) AS \"groups\", sum(c)::BIGINT AS \"rows\", sum(c - 1)::BIGINT AS extra FROM (SELECT split, count(*) AS c FROM (SELECT lower(trim(split)) AS split, {_KEY} AS k FROM tasks WHERE numbers IS NOT NULL AND target IS NOT NULL AND allowed_ops IS NOT NULL) GROUP BY split, k HAVING count(*) > 1) GROUP BY split")
def semantic_key_dups(s, d):
    t = table(s, d, "tasks").withColumn("split", audit.split_name())
    return audit.duplicate_groups(t, K.semantic_key(), ["split"])


_VALID = "coalesce(id IS NOT NULL AND difficulty IS NOT NULL AND len(numbers) > 0 AND len(list_filter(numbers, lambda x: x IS NULL)) = 0 AND target IS NOT NULL AND len(allowed_ops) > 0 AND len(list_filter(allowed_ops, lambda o: o NOT IN ('+', '-', '*', '/'))) = 0 AND length(solution) > 0, false)"


@query(
    f"""WITH t AS (SELECT lower(trim(split)) AS split, id, {_VALID} AS ok, CASE WHEN numbers IS NOT NULL AND target IS NOT NULL AND allowed_ops IS NOT NULL THEN {_KEY} END AS k FROM tasks), i AS (SELECT split, sum(c)::BIGINT AS "rows", count(id) AS ids, count(*) FILTER (c > 1) AS repeated_ids, sum(bad)::BIGINT AS invalid FROM (SELECT split, id, count(*) AS c, count(*) FILTER (NOT ok) AS bad FROM t GROUP BY split, id) GROUP BY split),
k AS (SELECT split, count(*) FILTER (c > 1) AS repeated_keys FROM (SELECT split, k, count(*) AS c FROM t WHERE k IS NOT NULL GROUP BY split, k) GROUP BY split) SELECT i.*, coalesce(repeated_keys, 0) AS repeated_keys FROM i LEFT JOIN k ON i.split IS NOT DISTINCT FROM k.split"""
)
def split_audit(s, d):
    return audit.split_audit(table(s, d, "tasks"))


@query(
    f"""WITH x AS (SELECT k, g, count(*) AS c FROM (SELECT {_KEY} AS k, lower(trim(split)) AS g FROM tasks WHERE split IS NOT NULL AND numbers IS NOT NULL AND target IS NOT NULL AND allowed_ops IS NOT NULL) GROUP BY k, g), t AS (SELECT lower(trim(split)) AS g, count(*) AS t FROM tasks WHERE split IS NOT NULL GROUP BY 1)
SELECT a.g AS "left", b.g AS "right", count(*) AS keys, sum(a.c)::BIGINT AS left_rows, sum(b.c)::BIGINT AS right_rows, sum(a.c * b.c)::BIGINT AS pairs, round(sum(a.c) / any_value(t.t), 9) AS left_share FROM x a JOIN x b ON a.k = b.k AND a.g < b.g JOIN t ON t.g = a.g GROUP BY a.g, b.g"""
)
def overlap_matrix(s, d):
    t = table(s, d, "tasks")
    return rounded(audit.overlap_matrix(t, audit.split_name(), K.semantic_key()))


@query(
    f"""WITH k AS (SELECT {_KEY} AS k, lower(trim(split)) = 'train' AS tr, split IS NOT NULL AS sp FROM tasks WHERE numbers IS NOT NULL AND target IS NOT NULL AND allowed_ops IS NOT NULL), l AS (SELECT k, count(*) AS l FROM k WHERE tr GROUP BY k), r AS (SELECT k, count(*) AS r FROM k WHERE sp AND NOT tr GROUP BY k),
t2 AS (SELECT id, k, tr FROM (SELECT id, {_KEY} AS k, lower(trim(split)) = 'train' AS tr FROM tasks WHERE split IS NOT NULL AND numbers IS NOT NULL AND target IS NOT NULL AND allowed_ops IS NOT NULL)),
b AS (SELECT count(*) AS keys, (SELECT count(DISTINCT id) FROM t2 WHERE tr AND k IN (SELECT k FROM r)) AS left_ids, (SELECT count(DISTINCT id) FROM t2 WHERE NOT tr AND k IN (SELECT k FROM l)) AS right_ids, coalesce(sum(l), 0)::BIGINT AS left_rows, coalesce(sum(r), 0)::BIGINT AS right_rows, coalesce(sum(l * r), 0)::BIGINT AS pairs FROM l JOIN r USING (k)) SELECT *, round(left_rows / (SELECT count(*) FROM tasks WHERE lower(trim(split)) = 'train'), 9) AS left_share, round(right_rows / (SELECT count(*) FROM tasks WHERE lower(trim(split)) <> 'train'), 9) AS right_share FROM b"""
)
def train_overlap(s, d):
    t = table(s, d, "tasks")
    return rounded(audit.overlap_stats(t.where(audit.split_name() == "train"), t.where(audit.split_name() != "train")))


@query("WITH o AS (SELECT id, bool_or(coalesce(lower(trim(split)) = 'validation', false)) AS ok FROM tasks GROUP BY id), i AS (SELECT id, count(*) AS c FROM candidates WHERE bank IN (SELECT bank FROM banks WHERE split = 'validation') GROUP BY id) SELECT coalesce(sum(c), 0)::BIGINT AS ids, count(*) AS distinct_ids, count(*) FILTER (c > 1) AS repeated, count(*) FILTER (ok IS NULL) AS missing, count(*) FILTER (NOT ok) AS wrong_split FROM i LEFT JOIN o USING (id)")
def frozen_id_audit(s, d):
    ids = _candidates(s, d).join(table(s, d, "banks").where("split = 'validation'").select("bank"), "bank", "left_semi").select("id")
    return audit.frozen_ids(ids, table(s, d, "tasks"), audit.split_name() == "validation")


@query("WITH h AS (SELECT lower(trim(split)) AS split, difficulty, count(*) AS c FROM tasks WHERE split IS NOT NULL AND difficulty IS NOT NULL GROUP BY ALL), q AS (SELECT unnest(['train', 'train', 'validation']) AS split, unnest(['easy', 'medium', 'hard']) AS difficulty, unnest([100, 200, 300]) AS quota) SELECT coalesce(h.split, q.split) AS split, coalesce(h.difficulty, q.difficulty) AS difficulty, coalesce(c, 0) AS \"rows\", coalesce(quota, 0)::INT AS quota FROM h FULL JOIN q ON h.split = q.split AND h.difficulty = q.difficulty WHERE coalesce(c, 0) <> coalesce(quota, 0)")
def quota_check(s, d):
    quotas = s.createDataFrame([("train", "easy", 100), ("train", "medium", 200), ("validation", "hard", 300)], "split string, difficulty string, quota int")
    return audit.quota_check(table(s, d, "tasks").where("split is not null and difficulty is not null"), [audit.split_name(), F.col("difficulty")], quotas, ["split", "difficulty"])


@query("SELECT t.id, count(*) FILTER (NOT (c.numbers IS NOT DISTINCT FROM t.numbers)) AS numbers, count(*) FILTER (NOT (c.target IS NOT DISTINCT FROM t.target)) AS target FROM candidates c JOIN (SELECT id, arg_max({'numbers': numbers, 'target': target}, line_no).numbers AS numbers, arg_max({'numbers': numbers, 'target': target}, line_no).target AS target FROM tasks GROUP BY id) t ON c.id = t.id GROUP BY t.id")
def payload_equality(s, d):
    last = table(s, d, "tasks").groupBy("id").agg(F.max_by(F.struct("numbers", "target"), "line_no").alias("t"))
    j = _candidates(s, d).select("id", "numbers", "target").join(last, "id")
    return j.groupBy("id").agg(*(F.count_if(~F.col(c).eqNullSafe(F.col(f"t.{c}"))).alias(c) for c in ("numbers", "target")))


@query("SELECT c.id AS id, c.candidate_index, c.line_no FROM candidates c WHERE NOT EXISTS (SELECT 1 FROM tasks t WHERE t.id = c.id)")
def missing_tasks(s, d):
    return _candidates(s, d).join(table(s, d, "tasks").select("id"), "id", "left_anti").select("id", "candidate_index", "line_no")


@query("SELECT doc_id, lang, kind FROM documents WHERE text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1 UNION ALL SELECT doc_id, lang, kind FROM documents WHERE text IS NULL")
def keep_first_dedup(s, d):
    return audit.keep_first(table(s, d, "documents"), F.col("text"), "doc_id").select("doc_id", "lang", "kind")


_HASH = "sha256('7' || chr(0) || 'sample' || chr(0) || doc_id)"


@query(f"SELECT doc_id, kind FROM documents QUALIFY row_number() OVER (PARTITION BY kind ORDER BY {_HASH}, doc_id) <= 20")
def hash_stratified_sample(s, d):
    return sampling.stratified_sample(table(s, d, "documents").select("doc_id", "kind"), "kind", "doc_id", 20, seed=7)


@query(f"SELECT doc_id, kind, CASE WHEN r <= 50 THEN 'train' WHEN r <= 70 THEN 'validation' WHEN r <= 80 THEN 'test' END AS part FROM (SELECT doc_id, kind, row_number() OVER (PARTITION BY kind ORDER BY {_HASH}) AS r FROM documents)")
def hash_split_quota(s, d):
    return sampling.split_by_quota(table(s, d, "documents").select("doc_id", "kind"), "kind", K.stable_order(7, "sample", F.col("doc_id")), [("train", 50), ("validation", 20), ("test", 10)])


@query("SELECT 'left' AS side, id FROM (SELECT DISTINCT id FROM tasks EXCEPT SELECT DISTINCT id FROM candidates) UNION ALL SELECT 'right', id FROM (SELECT DISTINCT id FROM candidates EXCEPT SELECT DISTINCT id FROM tasks)")
def set_difference(s, d):
    return sampling.set_difference(table(s, d, "tasks"), _candidates(s, d), "id")


@query(f"WITH v AS (SELECT id, {_KEY} AS k, (list_sort(numbers), target) AS l, lower(trim(split)) AS split FROM tasks) SELECT 'id' AS key, count(DISTINCT id) AS shared FROM v WHERE split = 'train' AND id IN (SELECT id FROM v WHERE split = 'validation') UNION ALL SELECT 'semantic', count(DISTINCT k) FROM v WHERE split = 'train' AND k IN (SELECT k FROM v WHERE split = 'validation' AND k[1] IS NOT NULL AND k[2] IS NOT NULL AND k[3] IS NOT NULL) AND k[1] IS NOT NULL AND k[2] IS NOT NULL AND k[3] IS NOT NULL UNION ALL SELECT 'loose', count(DISTINCT l) FROM v WHERE split = 'train' AND l IN (SELECT l FROM v WHERE split = 'validation' AND l[1] IS NOT NULL AND l[2] IS NOT NULL) AND l[1] IS NOT NULL AND l[2] IS NOT NULL")
def guard_intersections(s, d):
    t = table(s, d, "tasks")
    return audit.guard_intersections(t.where(audit.split_name() == "train"), t.where(audit.split_name() == "validation"), {"id": F.col("id"), "semantic": K.semantic_key(), "loose": K.loose_key()})


@query("SELECT kind, n FROM (SELECT kind, count(*) AS n FROM documents WHERE kind IS NOT NULL GROUP BY kind) ORDER BY n DESC, kind LIMIT 3")
def top_kinds(s, d):
    return sampling.top_by_count(table(s, d, "documents"), "kind", 3)


@query("SELECT event_id, sha256('{' || '\"event_id\":' || event_id || ',\"event_type\":' || to_json(event_type) || ',\"props\":' || to_json(props) || ',\"user_id\":' || user_id || '}') AS digest FROM events")
def row_digest(s, d):
    return table(s, d, "events").select("event_id", K.row_digest(["event_id", "event_type", "props", "user_id"]).alias("digest"))


@query("SELECT bank, sha256(string_agg(id, chr(10) ORDER BY id) || chr(10)) AS digest, count(*) AS members FROM (SELECT DISTINCT bank, id FROM candidates) GROUP BY bank")
def set_digest(s, d):
    return K.set_digest(_candidates(s, d).select("bank", "id").distinct(), "id", ["bank"])


# ---- functions


@query("SELECT line_no, trim(CASE WHEN regexp_matches(coalesce(completion, ''), '(?is)<answer>.*?</answer>') THEN regexp_extract(completion, '(?is)<answer>(.*?)</answer>', 1) ELSE coalesce(completion, '') END, ' ' || chr(10) || chr(9) || chr(13) || chr(160) || chr(8201) || chr(8202)) AS expression, regexp_matches(coalesce(completion, ''), '(?is)<answer>.*?</answer>') AS found FROM candidates")
def answer_extract(s, d):
    return _candidates(s, d).select("line_no", X.extract_answer(F.col("completion")).alias("a")).select("line_no", "a.expression", "a.found")


@query(
    """WITH n AS (SELECT line_no, numbers AS r, list_transform(regexp_extract_all(metrics.expression, '\\d+'), lambda x: x::BIGINT) AS u FROM candidates WHERE metrics.expression IS NOT NULL AND numbers IS NOT NULL),
k AS (SELECT line_no, len(u) AS lu, len(r) AS lr, coalesce(list_sum(list_transform(list_distinct(u), lambda x: least(len(list_filter(u, lambda y: y = x)), len(list_filter(r, lambda y: y = x))))), 0)::DOUBLE AS c FROM n)
SELECT line_no, round(c / greatest(1, lu), 9) AS "precision", round(c / greatest(1, lr), 9) AS recall, round(CASE WHEN c = 0 THEN 0 ELSE 2 * (c / greatest(1, lu)) * (c / greatest(1, lr)) / (c / greatest(1, lu) + c / greatest(1, lr)) END, 9) AS f1, c = lu AS no_extra, c = lr AS all_required FROM k"""
)
def multiset_f1(s, d):
    used = F.transform(F.regexp_extract_all(F.col("metrics.expression"), F.lit(r"(\d+)")), lambda x: x.cast("long"))
    rows = _candidates(s, d).where("metrics.expression is not null and numbers is not null").select("line_no", A.multiset_scores(used, F.col("numbers")).alias("m"))
    return rounded(rows.select("line_no", "m.*"))


@query("SELECT line_no, len(regexp_extract_all(completion, '[^\\t-\\r \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+')) AS words FROM candidates WHERE completion IS NOT NULL")
def word_counts(s, d):
    return _candidates(s, d).where("completion is not null").select("line_no", X.word_count(F.col("completion")).cast("long").alias("words"))


@query(
    """SELECT line_no, list_sum(list_filter(numbers, lambda x: x > 0))::BIGINT AS sum_positive, len(list_filter(numbers, lambda x: x % 2 = 0))::INT AS count_even, list_max(numbers) AS max_list, list_sort(list_distinct(numbers))::VARCHAR AS unique_sorted, numbers = list_sort(numbers) AS is_sorted_asc, numbers = list_reverse(numbers) AS is_palindrome_list,
 list_transform(numbers, lambda x, i: list_sum(numbers[1:i]))::VARCHAR AS prefix_sum, list_transform(numbers, lambda x, i: list_max(numbers[1:i]))::VARCHAR AS running_max, list_sort(list_distinct(numbers), 'DESC')[2] AS second_max, list_transform(numbers[2:], lambda x, i: x - numbers[i])::VARCHAR AS pairwise_diff FROM tasks WHERE len(numbers) > 0"""
)
def list_functions(s, d):
    n, f = F.col("numbers"), A.LIST_FUNCTIONS
    show = lambda c: F.concat(F.lit("["), F.array_join(c.cast("array<string>"), ", "), F.lit("]"))
    named = lambda *names: [f[x](n).alias(x) for x in names]
    shown = lambda *names: [show(f[x](n)).alias(x) for x in names]
    rows = table(s, d, "tasks").where("size(numbers) > 0")
    return rows.select("line_no", F.nullif(f["sum_positive"](n), F.lit(0)).alias("sum_positive"), *named("count_even", "max_list", "is_sorted_asc", "is_palindrome_list", "second_max"), *shown("unique_sorted", "prefix_sum", "running_max", "pairwise_diff"))


@query(
    """SELECT line_no, target * 2 AS double, target * target AS square, abs(-target) AS abs, target % 2 = 0 AS is_even, greatest(target, numbers[1]) AS max_two, least(target, numbers[1]) AS min_two, numbers[1] AS first, numbers[-1] AS last, len(list_filter(numbers, lambda x: x > 10))::INT AS count_greater, len(list_filter(numbers, lambda x: x BETWEEN 5 AND 20))::INT AS count_in_range,
 coalesce(list_sum(list_filter(numbers, lambda x: x > 0 AND x % 2 = 0)), 0)::BIGINT AS sum_pos_even, list_transform(numbers, lambda x, i: list_min(numbers[1:i]))::VARCHAR AS running_min, list_filter(numbers, lambda x, i: list_position(numbers, x) = i)::VARCHAR AS dedupe, list_sort(list_concat(numbers, numbers))::VARCHAR AS merge_sorted,
 list_transform(numbers, lambda x, i: x + list_reverse(numbers)[i])::VARCHAR AS zip_sum, list_filter(numbers, lambda x: x % 2 = 0)::VARCHAR || list_filter(numbers, lambda x: x % 2 <> 0)::VARCHAR AS group_parity, list_filter(numbers, lambda x: x < 0)::VARCHAR || list_filter(numbers, lambda x: x = 0)::VARCHAR || list_filter(numbers, lambda x: x > 0)::VARCHAR AS group_by_sign,
 array_to_string(list_transform(st, lambda a, k: numbers[a] || 'x' || (coalesce(st[k + 1], len(numbers) + 1) - a)), ' ') AS run_length, len(list_filter(range(1, len(numbers) + 1), lambda i: len(list_filter(range(i + 1, len(numbers) + 1), lambda j: numbers[i] + numbers[j] = target)) > 0)) > 0 AS two_sum_exists
FROM (SELECT *, list_filter(range(1, len(numbers) + 1), lambda i: i = 1 OR numbers[i] <> numbers[i - 1]) AS st FROM tasks WHERE len(numbers) > 0 AND target IS NOT NULL)"""
)
def list_functions_more(s, d):
    n, t, f = F.col("numbers"), F.col("target"), A.LIST_FUNCTIONS
    show = lambda c: F.concat(F.lit("["), F.array_join(c.cast("array<string>"), ", "), F.lit("]"))
    parts = lambda c, *names: F.concat(*(show(c[x]) for x in names))
    runs = F.array_join(F.transform(f["run_length"](n), lambda r: F.concat(r["value"].cast("string"), F.lit("x"), r["length"].cast("string"))), " ")
    rows = table(s, d, "tasks").where("size(numbers) > 0 and target is not null")
    return rows.select(
        "line_no", f["double"](t).alias("double"), f["square"](t).alias("square"), f["abs"](-t).alias("abs"), f["is_even"](t).alias("is_even"), f["max_two"](t, n[0]).alias("max_two"), f["min_two"](t, n[0]).alias("min_two"), f["first"](n).alias("first"), f["last"](n).alias("last"), f["count_greater"](n, F.lit(10)).alias("count_greater"),
        f["count_in_range"](n, F.lit(5), F.lit(20)).alias("count_in_range"), f["sum_pos_even"](n).alias("sum_pos_even"), show(f["running_min"](n)).alias("running_min"), show(f["dedupe"](n)).alias("dedupe"), show(f["merge_sorted"](n, n)).alias("merge_sorted"), show(f["zip_sum"](n, F.reverse(n))).alias("zip_sum"),
        parts(f["group_parity"](n), "even", "odd").alias("group_parity"), parts(f["group_by_sign"](n), "negative", "zero", "positive").alias("group_by_sign"), runs.alias("run_length"), f["two_sum_exists"](n, t).alias("two_sum_exists"),
    )


@query(f"SELECT bank, round(avg({_m('correct')}), 9) AS \"primary\", round(avg({_AUX}), 9) AS auxiliary, round(avg({_m('correct')} + {_AUX}), 9) AS total FROM candidates GROUP BY bank")
def reward_split(s, d):
    return rounded(_candidates(s, d).groupBy("bank").agg(F.avg(M.primary_reward()).alias("primary"), F.avg(M.auxiliary_reward()).alias("auxiliary"), F.avg(M.total_reward()).alias("total")))


def expr_verify(s, d):
    rows = _candidates(s, d).select("line_no", V.verify_completion(F.col("completion"), F.col("numbers"), F.col("target"), F.col("allowed_ops")).alias("v"))
    return rows.select("line_no", "v.parse_ok", "v.uses_numbers", "v.number_multiset_f1", "v.uses_allowed_ops", "v.valid_expression", "v.correct", "v.numeric_distance_reward", "v.value")


_DOUBLES = (*files.METRICS, "reward_hacking_candidate")


@query(
    "SELECT line_no, id, "
    + ", ".join(f"round(try_cast(nullif(metrics.{x}::VARCHAR, 'nan') AS DOUBLE), 9) AS {x}" for x in _DOUBLES)
    + ", metrics.expression AS expression, metrics.value AS value, metrics.error AS error, array_to_string(list_filter(["
    + ", ".join(f"CASE WHEN metrics.{x}::VARCHAR = 'nan' THEN '{x}' END" for x in _DOUBLES)
    + "], lambda x: x IS NOT NULL), ',') AS nan FROM candidates"
)
def flatten_metrics(s, d):
    """All fields of metrics; since engines compare NaN differently, the fields that are NaN are null and named in ``nan``."""
    flat = files.flatten(_candidates(s, d).select("line_no", "id", "metrics"))
    names = F.array_join(F.array(*(F.when(F.isnan(x), F.lit(x)) for x in _DOUBLES)), ",")
    return rounded(flat.select(*(F.nullif(F.col(c), F.lit(float("nan"))).alias(c) if c in _DOUBLES else F.col(c) for c in flat.columns), names.alias("nan")))


QUERIES["expr_verify"] = expr_verify


@query("SELECT event_type, round(avg((props->>'k')::DOUBLE), 9) AS mean, round(stddev_samp((props->>'k')::DOUBLE), 9) AS sample_std, round(stddev_pop((props->>'k')::DOUBLE), 9) AS pop_std FROM events GROUP BY event_type")
def props_flatten_means(s, d):
    k = F.from_json("props", "k double")["k"]
    return rounded(table(s, d, "events").groupBy("event_type").agg(F.avg(k).alias("mean"), F.stddev_samp(k).alias("sample_std"), F.stddev_pop(k).alias("pop_std")))


# ---- controllers


def _batches(s, d):
    return control.batch_means(_candidates(s, d), ["bank"], F.floor(F.col("line_no") / 16).cast("long"))


def _teacher_sql(phased: bool, delay: int = 5) -> str:
    """st: the state of the stable (or phased) controller after every batch, by recursion over batches and, between two
    of them, over the passes of the projection (pass -1: done). Lists go by the order of the keys."""
    keys = M.AUXILIARY
    at = {k: i + 1 for i, k in enumerate(keys)}

    def bounds(phase: str | None) -> tuple[str, str]:
        cap, raised = control.PHASES[phase] if phase else (control.CAPS["numeric_distance_reward"], {})
        low = [max(0.02, control.FLOORS.get(k, 0.02), raised.get(k, 0.0)) for k in keys]
        high = [max(x, cap if k == "numeric_distance_reward" else 0.35) for x, k in zip(low, keys, strict=True)]
        return tuple("[" + ", ".join(f"{x}::DOUBLE" for x in v) + "]" for v in (low, high))

    either = lambda i, phase: f"CASE WHEN {phase} = 'A' THEN {bounds('A')[i]} ELSE {bounds('B')[i]} END" if phased else bounds(None)[i]
    unit = lambda x: f"least(1.0, greatest(0.0, {x}))"
    f1, legal = f"ea[{at['number_multiset_f1']}]", f"ea[{at['valid_expression']}]"
    wants = f"CASE WHEN ph = 'A' THEN {f1} >= 0.80 AND {legal} >= 0.35 ELSE {f1} < 0.75 OR {legal} < 0.30 END" if phased else "false"
    means = ", ".join(f"avg({_m(k)})" for k in keys)
    return f"""WITH RECURSIVE bt AS (SELECT *, row_number() OVER (PARTITION BY bank ORDER BY batch) AS k FROM (SELECT bank, line_no // 16 AS batch, avg({_m('correct')}) AS p, [{means}] AS a FROM candidates GROUP BY bank, line_no // 16)),
rc AS (SELECT bank, 0::BIGINT AS k, -1 AS pass, [0.2::DOUBLE, 0.2, 0.2, 0.2, 0.2, 0.2] AS w, [0.2::DOUBLE, 0.2, 0.2, 0.2, 0.2, 0.2] AS was, 0.0::DOUBLE AS ep, [0.0::DOUBLE, 0, 0, 0, 0, 0] AS ea, 'A' AS ph, 0 AS streak FROM banks
 UNION ALL (WITH nx AS (SELECT r.bank, b.k, r.k AS step, r.w, 0.9 * r.ep + 0.1 * b.p AS ep, list_transform(r.ea, lambda x, i: 0.9 * x + 0.1 * b.a[i]) AS ea, r.ph, r.streak FROM rc r JOIN bt b ON b.bank = r.bank AND b.k = r.k + 1 WHERE r.pass = -1),
 ns AS (SELECT *, CASE WHEN step >= {delay} AND ({wants}) THEN streak + 1 ELSE 0 END AS ns FROM nx), np AS (SELECT * EXCLUDE (ph, streak, ns), CASE WHEN ns >= 5 THEN CASE WHEN ph = 'A' THEN 'B' ELSE 'A' END ELSE ph END AS ph, CASE WHEN ns >= 5 THEN 0 ELSE ns END AS streak FROM ns),
 nb AS (SELECT *, {either(0, 'ph')} AS lo, {either(1, 'ph')} AS hi, greatest(0.0, 1 - 0.75 * {unit('ep')}) AS decay FROM np),
 nw AS (SELECT bank, k, CASE WHEN step < {delay} THEN -1 ELSE 0 END AS pass, CASE WHEN step < {delay} THEN [0.2::DOUBLE, 0.2, 0.2, 0.2, 0.2, 0.2] ELSE list_transform(w, lambda x, i: least(hi[i], greatest(lo[i], 0.9 * x + 0.1 * (0.9 * x + 0.1 * least(0.35, greatest(0.02, 0.02 + 0.33 * (1 - {unit('ea[i]')}) * decay)))))) END AS w, w AS was, ep, ea, ph, streak FROM nb),
 pr AS (SELECT *, {either(0, 'ph')} AS lo, {either(1, 'ph')} AS hi FROM rc WHERE pass >= 0), pg AS (SELECT *, greatest(list_sum(lo), least(1.2, list_sum(hi))) - list_sum(w) AS gap FROM pr), po AS (SELECT *, list_transform(w, lambda x, i: CASE WHEN gap > 0 THEN CASE WHEN hi[i] - x > 1e-12 THEN hi[i] - x ELSE 0 END ELSE CASE WHEN x - lo[i] > 1e-12 THEN x - lo[i] ELSE 0 END END) AS room FROM pg)
 SELECT bank, k, pass, w, was, ep, ea, ph, streak FROM nw UNION ALL SELECT bank, k, CASE WHEN abs(gap) <= 1e-9 OR pass >= 32 OR list_sum(room) <= 1e-12 THEN -1 ELSE pass + 1 END, CASE WHEN abs(gap) <= 1e-9 OR pass >= 32 OR list_sum(room) <= 1e-12 THEN w ELSE list_transform(w, lambda x, i: least(hi[i], greatest(lo[i], x + gap * room[i] / list_sum(room)))) END, was, ep, ea, ph, streak FROM po)),
st AS (SELECT rc.*, bt.batch, {either(0, 'ph')} AS lo, {either(1, 'ph')} AS hi FROM rc JOIN bt USING (bank, k) WHERE pass = -1 AND k > 0)"""


@query(_teacher_sql(False) + " SELECT bank, batch::BIGINT AS batch, k AS step, round(ep + 1e-13, 9) AS ema_primary, round(list_sum(w), 9) AS weight_sum, round(list_sum(list_transform(w, lambda x, i: abs(x - was[i]))), 9) AS l1, round(list_max(list_transform(w, lambda x, i: abs(x - was[i]))), 9) AS linf FROM st")
def teacher_replay(s, d):
    records = control.replay_weights(_batches(s, d), "bank", control.WeightSettings(strategy="adaptive_stable", delay=5))
    # averages of sixteenths end after some digits, also right where they are rounded: a hair more decides for both engines
    return rounded(records.select("bank", "batch", "step", (F.col("ema_primary") + 1e-13).alias("ema_primary"), "weight_sum", "l1", "linf"))


_NAMES = "[" + ", ".join(f"'{k}'" for k in M.AUXILIARY) + "]"
_LONG = _teacher_sql(True) + f", lg AS (SELECT bank, k, {_NAMES}[i] AS key, w[i] AS w, lo[i] AS lo, hi[i] AS hi FROM st, (SELECT unnest(range(1, 7)) AS i))"


@query(_LONG + " SELECT bank, key, round(arg_min(w, k), 9) AS first, round(arg_max(w, k), 9) AS last, round(min(w), 9) AS least, round(max(w), 9) AS most, round(avg(w), 9) AS mean, round(avg((w <= lo + 1e-8)::INT), 9) AS at_floor, round(avg((w >= hi - 1e-8)::INT), 9) AS at_cap FROM lg GROUP BY bank, key")
def teacher_health(s, d):
    records = control.replay_weights(_batches(s, d), "bank", control.WeightSettings(strategy="adaptive_phased", delay=5))
    return rounded(diagnosis.weight_summary(records, "bank"))


@query(_teacher_sql(True) + ", fp AS (SELECT bank, k, ph, ph <> lag(ph, 1, 'A') OVER (PARTITION BY bank ORDER BY k) AS f FROM st) SELECT bank, ph AS phase, count(*) AS records, round(count(*) / sum(count(*)) OVER (PARTITION BY bank), 9) AS share, (SELECT count(*) FILTER (g.f) FROM fp g WHERE g.bank = fp.bank) AS flips FROM fp GROUP BY bank, ph")
def phase_shares(s, d):
    records = control.replay_weights(_batches(s, d), "bank", control.WeightSettings(strategy="adaptive_phased", delay=5))
    return rounded(diagnosis.phase_shares(records, "bank"))


@query(_LONG + ", ch AS (SELECT bank, key, arg_max(w, k) - arg_min(w, k) AS change FROM lg GROUP BY bank, key) SELECT bank, row_number() OVER (PARTITION BY bank ORDER BY abs(change) DESC, key)::INT AS rank, key, round(change, 9) AS change FROM ch QUALIFY row_number() OVER (PARTITION BY bank ORDER BY abs(change) DESC, key) <= 3")
def weight_movers(s, d):
    records = control.replay_weights(_batches(s, d), "bank", control.WeightSettings(strategy="adaptive_phased", delay=5))
    return rounded(reports.movers(records, "bank"))


def _tier_states(old: str, new: str, n: str) -> str:
    """A tier's average after a batch that has n rows of it (or none)."""
    return f"CASE WHEN {n} IS NULL THEN {old} WHEN {old} IS NULL THEN {new} ELSE pow(0.9, {n}) * {old} + (1 - pow(0.9, {n})) * {new} END"


_TIER_SET = ("easy", "medium", "hard")
_NEAR = lambda t: f"CASE WHEN l_{t} IS NULL THEN 1.0 WHEN l_{t} < 0.5 THEN exp(-((l_{t} - 0.5) ** 2) / 0.125) ELSE exp(-((e_{t} - 0.175) ** 2) / 0.045) END"


@query(
    f"""WITH RECURSIVE tb AS (SELECT bank, line_no // 16 AS batch, {', '.join(f"nullif(count(*) FILTER (difficulty = '{t}'), 0) AS n_{t}, avg({_m('valid_expression')}) FILTER (difficulty = '{t}') AS v_{t}, avg({_m('correct')}) FILTER (difficulty = '{t}') AS c_{t}" for t in _TIER_SET)} FROM candidates WHERE difficulty IS NOT NULL GROUP BY bank, line_no // 16),
bt AS (SELECT *, row_number() OVER (PARTITION BY bank ORDER BY batch) AS k FROM tb), rc AS (SELECT bank, 0::BIGINT AS k, {', '.join(f'NULL::DOUBLE AS l_{t}, NULL::DOUBLE AS e_{t}' for t in _TIER_SET)} FROM banks UNION ALL SELECT r.bank, b.k, {', '.join(_tier_states(f'r.l_{t}', f'b.v_{t}', f'b.n_{t}') + ', ' + _tier_states(f'r.e_{t}', f'b.c_{t}', f'b.n_{t}') for t in _TIER_SET)} FROM rc r JOIN bt b ON b.bank = r.bank AND b.k = r.k + 1),
nr AS (SELECT *, {', '.join(f'{_NEAR(t)} AS s_{t}' for t in _TIER_SET)} FROM rc WHERE k > 0) SELECT nr.bank, bt.batch::BIGINT AS batch, nr.k AS updates, {', '.join(f'round(CASE WHEN nr.k < 25 THEN 1 / 3.0::DOUBLE ELSE 0.1 + 0.7 * (0.8 * s_{t} / (s_easy + s_medium + s_hard) + 0.2 / 3) END, 9) AS {t}' for t in _TIER_SET)} FROM nr JOIN bt USING (bank, k)"""
)
def curriculum_replay(s, d):
    t = control.tier_batches(_candidates(s, d), ["bank"], F.floor(F.col("line_no") / 16).cast("long"))
    return control.replay_tiers(t, "bank").select("bank", "batch", "updates", *(F.round(F.col("shares")[x], 9).alias(x) for x in ("easy", "medium", "hard")))


def _unit_groups(s, d):
    """Groups of four of the first eight rows of each unit: full, and of one task."""
    rows = banks.prefix(banks.once(_candidates(s, d).select("line_no", *banks.UNIT, "candidate_index", "metrics")), 8)
    full = rows.groupBy(*banks.UNIT).agg(F.count(F.lit(1)).alias("n")).where("n = 8").select(*banks.UNIT)
    return control.reward_groups(rows.join(full, banks.UNIT), ["bank"], F.col("id"), ["pos"])


def bandit_replay(s, d):
    return rounded(control.replay_bandit(_unit_groups(s, d), "bank").drop("weights"))


def bandit_control(s, d):
    return rounded(control.replay_bandit(_unit_groups(s, d), "bank", signal=False).drop("weights"))


_VECTORS = "[" + ", ".join("[" + ", ".join(f"{x!r}::DOUBLE" for x in v) + "]" for v in control.candidate_weights().tolist()) + "]"
_CEILINGS = (
    _BASE
    + f""", fu AS (SELECT bank, id FROM u WHERE pos < 8 GROUP BY bank, id HAVING count(*) = 8), gr AS (SELECT bank, id, pos // 4 AS grp, list(correct ORDER BY pos) AS c, {', '.join(f'list({k} ORDER BY pos) AS k{i}' for i, k in enumerate(M.AUXILIARY))} FROM u JOIN fu USING (bank, id) WHERE pos < 8 GROUP BY bank, id, pos // 4),
vs AS (SELECT i, vv[i] AS w FROM (SELECT {_VECTORS} AS vv), (SELECT unnest(range(1, 209)) AS i)), rw AS (SELECT bank, id, grp, i, c, list_transform([1, 2, 3, 4], lambda j: c[j] + ({' + '.join(f'k{n}[j] * w[{n + 1}]' for n in range(6))})) AS r FROM gr, vs),
st AS (SELECT bank, id, grp, i, c, list_position(r, list_max(r)) AS top, list_transform(r, lambda x: x > list_avg(r) + 1e-12) AS pos, sqrt(greatest(list_avg(list_transform(r, lambda x: (x - list_avg(r)) * (x - list_avg(r)))), 0)) > 1e-9 AS alive FROM rw),
u0 AS (SELECT bank, id, grp, top AS t0, pos AS p0, alive AS a0, c[top] >= 0.5 AS h0 FROM st WHERE i = 1),
fl AS (SELECT bank, id, grp, any_value(list_max(c) >= 0.5) AS has, any_value(NOT a0) AS dead, any_value(h0) AS on_top, bool_or(top <> t0) AS top_flips, bool_or(pos <> p0) AS changes, bool_or(c[top] >= 0.5) AS any_hit, bool_or(c[top] < 0.5) AS any_miss, bool_or(alive) AS any_alive FROM st JOIN u0 USING (bank, id, grp) GROUP BY bank, id, grp),
cr AS (SELECT bank, count(*) AS groups, count(*) FILTER (has) AS with_correct, count(*) FILTER (dead) AS dead, count(*) FILTER (top_flips) / count(*) AS top_flips, count(*) FILTER (changes) / count(*) AS positive_changes, count(*) FILTER (dead AND any_alive) / count(*) AS revivable, coalesce(count(*) FILTER (on_top) / nullif(count(*) FILTER (has), 0), 0) AS on_top,
 coalesce(count(*) FILTER (has AND NOT on_top AND any_hit) / nullif(count(*) FILTER (has AND NOT on_top), 0), 0) AS rescuable, coalesce(count(*) FILTER (on_top AND any_miss) / nullif(count(*) FILTER (on_top), 0), 0) AS demotable FROM fl GROUP BY bank)"""
)
_SHARES = ("top_flips", "positive_changes", "revivable", "on_top", "rescuable", "demotable")


@query(_CEILINGS + f" SELECT bank, groups, with_correct, dead, {', '.join(f'round({c}, 9) AS {c}' for c in _SHARES)} FROM cr")
def oracle_ceilings(s, d):
    return rounded(control.ceiling_report(control.ceilings(_unit_groups(s, d), ["bank"]), ["bank"]))


@query(_CEILINGS + f" SELECT CASE WHEN contains(method, 'stable') THEN 'stable' WHEN contains(method, 'static') THEN 'static' ELSE 'other' END AS family, count(*) AS streams, {', '.join(f'round(avg({c}), 9) AS {c}' for c in _SHARES)} FROM cr JOIN banks USING (bank) GROUP BY 1")
def family_ceilings(s, d):
    per = control.ceiling_report(control.ceilings(_unit_groups(s, d), ["bank"]), ["bank"])
    return rounded(reports.family_means(per, table(s, d, "banks"), list(_SHARES)))


@query("WITH g AS (SELECT bank, line_no // 16 AS batch, (row_number() OVER (PARTITION BY bank, line_no // 16 ORDER BY line_no) - 1) // 4 AS grp, id FROM candidates), c AS (SELECT bank, batch, grp, count(*) AS n, count(DISTINCT id) AS ids FROM g GROUP BY ALL) SELECT bank, count(*) AS groups, count(*) FILTER (n < 4) AS uneven, count(*) FILTER (ids > 1) AS mixed FROM c GROUP BY bank")
def reward_group_faults(s, d):
    return control.group_faults(_candidates(s, d), ["bank"], F.floor(F.col("line_no") / 16).cast("long"), ["line_no"])


def generated_tasks(s, d):
    pools = [(generate.proposals(s, tier, 400, seed), 150) for seed, tier in enumerate(generate.TIERS)]
    return generate.accept(pools)


_QUOTAS = {"train": {"easy": 200, "medium": 200, "hard": 200}, "validation": {"easy": 40, "medium": 40, "hard": 40}, "test_ood_long": {"ood_long": 40}, "test_ood_division": {"ood_division": 40}}


def generated_splits(s, d):
    tasks = generate.build_splits(s, _QUOTAS, dict.fromkeys(generate.TIERS, 600))
    return generate.manifest(tasks, _QUOTAS)


def controller_simulations(s, d):
    grid = [control.WeightSettings(strategy=x, delay=10, smoothing=a) for x in ("static", "adaptive", "adaptive_stable", "adaptive_phased") for a in (0.1, 0.5)]
    last = control.simulate(s, grid).where("step = 199")
    return rounded(last.select("setting", "strategy", "primary", F.col("behaviours")["format"].alias("hack"), F.col("weights")["format"].alias("hack_weight")))


QUERIES |= {f.__name__: f for f in (bandit_replay, bandit_control, generated_tasks, generated_splits, controller_simulations)}


# ---- combined reports


@query(
    _OOD
    + f""", tr AS (SELECT DISTINCT {_KEY} AS k FROM tasks WHERE lower(trim(split)) = 'train' AND numbers IS NOT NULL AND target IS NOT NULL AND allowed_ops IS NOT NULL),
sc AS (SELECT *, unnest(['all', CASE WHEN numbers IS NOT NULL AND target IS NOT NULL AND task_ops IS NOT NULL AND {_KEY.replace('allowed_ops', 'task_ops')} IN (SELECT k FROM tr) THEN 'overlap' ELSE 'held_out' END]) AS scope FROM b)
SELECT method, scope, difficulty, count(*) AS candidates, round(avg((valid_expression >= 1)::INT), 9) AS legality, round(coalesce(count(*) FILTER (valid_expression >= 1 AND exact_correct >= 1) / nullif(count(*) FILTER (valid_expression >= 1), 0), 0), 9) AS exact_given_legal,
 round(avg(coalesce(completion_token_count, 0)), 9) AS tokens, round(avg(coalesce(completion_token_count >= 256, false)::INT), 9) AS clip_rate, grouping(difficulty)::TINYINT AS total FROM sc GROUP BY GROUPING SETS ((method, scope, difficulty), (method, scope))"""
)
def arm_scorecard(s, d):
    return rounded(scorecard.scorecard(_candidates(s, d), table(s, d, "tasks"), table(s, d, "banks")))


@query(
    _OUT
    + f""", q AS (SELECT method, {_COUNTS} FROM pr GROUP BY method), p AS (SELECT *, CASE WHEN arm_only + base_only = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, least(arm_only, base_only) + 1), lambda i: exp(lgamma(arm_only + base_only + 1) - lgamma(i + 1) - lgamma(arm_only + base_only - i + 1) + (arm_only + base_only) * ln(0.5))))) END AS p FROM q),
h AS (SELECT *, least(1.0, (count(*) OVER () - row_number() OVER (ORDER BY p, method) + 1) * p) AS step FROM p) SELECT method, n, "both", arm_only, base_only, neither, delta, round(p, 9) AS p, round(max(step) OVER (ORDER BY p, method ROWS UNBOUNDED PRECEDING), 9) AS adjusted, max(step) OVER (ORDER BY p, method ROWS UNBOUNDED PRECEDING) < 0.05 AS reject FROM h"""
)
def score_matrix(s, d):
    return rounded(scorecard.contrasts(_candidates(s, d), table(s, d, "banks"), "static"))


@query(
    re.sub(r"round\((avg\([po]\.\w+\)), 9\)", r"\1", _report_sql("difficulty")).replace("w.difficulty, w.n,", "w.bank, w.difficulty, w.n,").replace("SELECT w.bank, w.difficulty,", ", per AS (SELECT w.bank, w.difficulty,", 1).replace("GROUP BY w.difficulty, w.n", "GROUP BY w.bank, w.difficulty, w.n")
    + """) SELECT bank, method, split, seed, round(practical, 9) AS practical, round(oracle, 9) AS oracle, tokens, round(tokens_per_exact, 9) AS tokens_per_exact, (SELECT round(avg(coalesce(completion_token_count >= 256, false)::INT), 9) FROM b WHERE b.bank = o.bank) AS cap_share FROM (SELECT bank, avg(practical_exact_correct) AS practical, avg(oracle_exact_correct) AS oracle, sum(tokens)::BIGINT AS tokens, sum(tokens)::DOUBLE / nullif(sum(round(practical_exact_correct * units)), 0) AS tokens_per_exact FROM per WHERE n = 8 GROUP BY bank) o JOIN banks USING (bank)"""
)
def macro_outcomes(s, d):
    return rounded(scorecard.macro_outcomes(_candidates(s, d), table(s, d, "banks")))


@query("SELECT bank, regexp_extract(bank, '^([a-z]+)_', 1) AS method, regexp_extract(bank, '^[a-z]+_(.+)_s[0-9]+$', 1) AS split, regexp_extract(bank, '_s([0-9]+)$', 1)::BIGINT AS seed FROM banks")
def run_identity(s, d):
    return table(s, d, "banks").select("bank", scorecard.run_identity(F.col("bank")).alias("r")).select("bank", "r.*")


@query(
    """WITH j AS (SELECT bank, json_valid(line) AS v, CASE WHEN json_valid(line) THEN line::JSON END AS x FROM raw_records), o AS (SELECT *, coalesce(v AND json_type(x) = 'OBJECT', false) AS ok FROM j)
SELECT bank, count(*) AS lines, count(*) FILTER (NOT ok) AS broken, count(*) FILTER (ok AND coalesce(json_type(x, '$.id'), 'X') <> 'VARCHAR') AS no_id, count(*) FILTER (ok AND coalesce(json_type(x, '$.metrics'), 'X') <> 'OBJECT') AS no_metrics, count(*) FILTER (ok AND coalesce(json_type(x, '$.candidate_index'), 'X') NOT IN ('UBIGINT', 'BIGINT')) AS odd_index FROM o GROUP BY bank"""
)
def raw_line_check(s, d):
    return scorecard.raw_line_check(table(s, d, "raw_records"))


def bank_reverified(s, d):
    return scorecard.reverified(_candidates(s, d))


QUERIES["bank_reverified"] = bank_reverified


# ---- further audits


@query("WITH p AS (SELECT DISTINCT id, '{\"allowed_ops\":' || to_json(list_sort(list_distinct(allowed_ops))) || ',\"numbers\":' || to_json(list_sort(numbers)) || ',\"target\":' || target || '}' AS task FROM tasks WHERE id IS NOT NULL AND numbers IS NOT NULL AND target IS NOT NULL AND allowed_ops IS NOT NULL) SELECT 'id' AS kind, id AS value, count(*) AS others FROM p GROUP BY id HAVING count(*) > 1 UNION ALL SELECT 'task', task, count(*) FROM p GROUP BY task HAVING count(*) > 1")
def identity_conflicts(s, d):
    return audit.identity_conflicts(table(s, d, "tasks"))


@query("SELECT lower(trim(split)) AS split, difficulty, count(*) AS \"rows\" FROM tasks WHERE NOT CASE WHEN lower(trim(split)) LIKE 'test\\_ood\\_%' ESCAPE '\\' THEN difficulty = substring(lower(trim(split)), 6) ELSE difficulty IN ('easy', 'medium', 'hard') END GROUP BY ALL")
def misplaced_tiers(s, d):
    return table(s, d, "tasks").where(~audit.tier_fits_split()).groupBy(audit.split_name().alias("split"), "difficulty").agg(F.count(F.lit(1)).alias("rows"))


@query(f"WITH r AS (SELECT doc_id, row_number() OVER (PARTITION BY kind ORDER BY {_HASH}, doc_id) <= 20 AS s FROM documents) SELECT 0::BIGINT AS shared, count(*) - count(*) FILTER (s) - count(*) FILTER (NOT s) AS missing, 0::BIGINT AS \"foreign\" FROM r")
def view_checks(s, d):
    docs = table(s, d, "documents").select("doc_id", "kind")
    sample = sampling.stratified_sample(docs, "kind", "doc_id", 20, seed=7)
    return audit.view_checks(docs, sample, sampling.complement(docs, sample, "doc_id"), "doc_id")


@query("WITH t AS (SELECT * FROM tasks WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY line_no DESC) = 1) SELECT c.line_no, c.id, CASE c.prompt_field WHEN 'prompt_low' THEN prompt_low WHEN 'prompt_mid' THEN prompt_mid WHEN 'prompt_high' THEN prompt_high END AS prompt FROM candidates c LEFT JOIN t ON c.id = t.id")
def shown_prompts(s, d):
    return pairing.shown_prompt(_candidates(s, d), table(s, d, "tasks"))


@query(
    _BASE
    + f""" SELECT bank, count(*) AS "rows", count(*) FILTER (exact_correct <> correct) AS exact_differs, count(*) FILTER (NOT (number_precision BETWEEN 0 AND 1 AND number_recall BETWEEN 0 AND 1 AND number_multiset_f1 BETWEEN 0 AND 1 AND numeric_distance_reward BETWEEN 0 AND 1 AND format BETWEEN 0 AND 1)) AS outside,
 count(*) FILTER (abs((contains_open_answer_tag + contains_close_answer_tag + has_extractable_answer_span) / 3 - format) > 1e-6) AS format_differs, count(*) FILTER (valid_expression >= 1 AND parse_ok < 1) AS legal_unparsed, count(*) FILTER (correct >= 1 AND valid_expression < 1) AS correct_illegal,
 coalesce(stddev_samp(correct + {' + '.join(f'0.2*{k}' for k in M.AUXILIARY)}), 0) > 1e-9 AS varies FROM c GROUP BY bank"""
)
def health_gate(s, d):
    return diagnosis.health_gate(_candidates(s, d), ["bank"])


# ---- further reports

_CODE = {"valid_expression": "valid_expression", "runs_without_error": "evaluates_without_exception", "visible_pass_rate": "number_multiset_f1", "no_hardcoding_heuristic": "uses_no_extra_numbers", "held_out_pass_rate": "correct", "exact_correct": "exact_correct"}
_CODE_SCORE = "3.0*valid_expression + evaluates_without_exception + 2.0*number_multiset_f1 + uses_no_extra_numbers"


@query(
    _BASE
    + f""", n AS (SELECT unnest([1, 4, 8]) AS n), r AS (SELECT u.*, n.n, {_CODE_SCORE} AS cs FROM u JOIN n ON u.pos < n.n), w AS (SELECT bank, id, n, sum(coalesce(completion_token_count, 0)) AS tokens FROM r GROUP BY bank, id, n HAVING count(*) = n),
p AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY bank, id, n ORDER BY cs DESC, candidate_index, line_no) = 1), o AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY bank, id, n ORDER BY exact_correct DESC, cs DESC, candidate_index, line_no) = 1)
SELECT w.n, count(*) AS units, sum(w.tokens)::BIGINT AS tokens, {', '.join(f'round(avg({t}.{c}), 9) AS {name}_{x}' for t, name in (('p', 'practical'), ('o', 'oracle')) for x, c in _CODE.items())}, round(avg(p.number_multiset_f1) - avg(p.correct), 9) AS proxy_gap, round(w.n / greatest(avg(p.exact_correct), 1e-12), 9) AS cost_practical, round(w.n / greatest(avg(o.exact_correct), 1e-12), 9) AS cost_oracle
FROM w JOIN p USING (bank, id, n) JOIN o USING (bank, id, n) GROUP BY w.n"""
)
def code_best_of_n(s, d):
    """The tables hold no code candidates; metrics of theirs that mean the same stand in for those of code."""
    rows = _candidates(s, d).withColumn("metrics", F.struct(*(F.col(f"metrics.{c}").alias(x) for x, c in _CODE.items())))
    return rounded(reports.code_best_of_n(rows))


@query(
    _BASE
    + """, un AS (SELECT bank, id, difficulty, count(*) AS n, count(*) FILTER (valid_expression >= 1) AS legal, count(*) FILTER (exact_correct > 0) AS exact, sum(number_multiset_f1) AS v, stddev_pop(number_multiset_f1) AS s FROM b GROUP BY bank, id, difficulty)
SELECT bank, difficulty, count(*) AS units, sum(n)::BIGINT AS candidates, round(sum(legal) / sum(n), 9) AS legal, round(sum(exact) / sum(n), 9) AS exact, round(count(*) FILTER (exact > 0) / count(*), 9) AS oracle, round(sum(v) / sum(n), 9) AS value, round(avg(s), 7) AS spread, round(avg((s > 1e-9)::INT), 9) AS varying FROM un GROUP BY bank, difficulty"""
)
def base_probe(s, d):
    return rounded(reports.base_probe(_candidates(s, d), M.metric("number_multiset_f1"), ["bank", "difficulty"])).withColumn("spread", F.round("spread", 7))


@query("""WITH per AS (SELECT bank, avg(coalesce(completion_token_count, 0)) AS t FROM candidates GROUP BY bank), j AS (SELECT avg(t) FILTER (method = 'stable') AS arm, avg(t) FILTER (method = 'static') AS base, sqrt(stddev_pop(t) FILTER (method = 'stable') ** 2 + stddev_pop(t) FILTER (method = 'static') ** 2) AS noise FROM per JOIN banks USING (bank))
SELECT round(arm, 9) AS arm, round(base, 9) AS base, round(arm / base, 9) AS ratio, round(base - arm, 9) AS gap, round(noise, 9) AS noise, round((base - arm) / nullif(noise, 0), 9) AS gap_over_noise FROM j WHERE arm IS NOT NULL AND base IS NOT NULL""")
def cost_claim(s, d):
    return rounded(reports.cost_claim(_candidates(s, d), table(s, d, "banks"), "stable", "static", []))


_BEST = _BASE + ", be AS (SELECT bank, id, exact_correct FROM u WHERE pos < 8 QUALIFY row_number() OVER (PARTITION BY bank, id ORDER BY score DESC, candidate_index, line_no) = 1)"


@query(_BASE + ", f8 AS (SELECT bank, id FROM u WHERE pos < 8 GROUP BY bank, id HAVING count(*) = 8), be AS (SELECT bank, id, exact_correct FROM u JOIN f8 USING (bank, id) WHERE pos < 8 QUALIFY row_number() OVER (PARTITION BY bank, id ORDER BY score DESC, candidate_index, line_no) = 1), oc AS (SELECT bank, id, max(exact_correct) AS o FROM u JOIN f8 USING (bank, id) WHERE pos < 8 GROUP BY bank, id) SELECT method, split, seed, count(*) AS units, round(sum(o))::BIGINT AS oracle, round(sum(be.exact_correct))::BIGINT AS reranked FROM be JOIN oc USING (bank, id) JOIN banks USING (bank) GROUP BY method, split, seed")
def outcomes_by_run(s, d):
    return reports.outcomes_by_run(_candidates(s, d), table(s, d, "banks"))


@query(_BEST + """, ch AS (SELECT method, split, bank, id, (exact_correct > 0)::INT AS v FROM be JOIN banks USING (bank)), pp AS (SELECT a.method, a.bank AS x, z.bank AS y, count(*) AS n, count(*) FILTER (a.v > 0 AND z.v > 0) AS bo, count(*) FILTER (a.v > 0 AND z.v = 0) AS ao, count(*) FILTER (a.v = 0 AND z.v > 0) AS zo, count(*) FILTER (a.v = 0 AND z.v = 0) AS ne, (sum(a.v) - sum(z.v)) / count(*) AS d FROM ch a JOIN ch z ON a.id = z.id AND z.method = 'static' WHERE a.method <> 'static' GROUP BY ALL)
SELECT method, count(*) AS pairs, sum(n)::BIGINT AS n, sum(bo)::BIGINT AS "both", sum(ao)::BIGINT AS arm_only, sum(zo)::BIGINT AS base_only, sum(ne)::BIGINT AS neither, round(avg(d), 9) AS delta_mean, round(coalesce(stddev_samp(d), 0), 9) AS delta_std FROM pp GROUP BY method""")
def paired_over_runs(s, d):
    return rounded(reports.paired_over_runs(_candidates(s, d), table(s, d, "banks"), "static", []))


@query(_BEST + f", ky AS (SELECT bank, id, min({_TASK.replace('OPS', 'allowed_ops')}) AS task FROM candidates WHERE {_WHOLE_TASK.replace('OPS', 'allowed_ops')} GROUP BY bank, id) SELECT bank, task, max((exact_correct > 0)::INT) AS outcome, count(DISTINCT id) AS ids FROM be JOIN ky USING (bank, id) GROUP BY bank, task")
def outcome_by_task(s, d):
    return reports.outcome_by_task(_candidates(s, d))


@query("SELECT id, arg_max(coalesce(difficulty, '-'), line_no) AS difficulty FROM tasks WHERE id IS NOT NULL GROUP BY id")
def last_tier(s, d):
    return reports.last_tier(table(s, d, "tasks").withColumn("difficulty", F.coalesce("difficulty", F.lit("-"))))


@query("SELECT bank, '\"loop\"' AS hf_gen_mode, seed::VARCHAR AS sampling_seed, max_new_tokens::VARCHAR AS max_new_tokens, to_json(coalesce(prompt_field, 'prompt'))::VARCHAR AS prompt_field FROM banks")
def sampling_identities(s, d):
    config = F.parse_json(F.to_json(F.struct(F.col("seed").alias("sampling_seed"), "max_new_tokens", "prompt_field")))
    return table(s, d, "banks").select("bank", identity.sampling_identity(config).alias("i")).select("bank", "i.hf_gen_mode", "i.sampling_seed", "i.max_new_tokens", "i.prompt_field")


@query("SELECT method, count(*) AS runs, count(DISTINCT (coalesce(max_new_tokens, -1), coalesce(prompt_field, '-'))) AS versions FROM banks GROUP BY method")
def config_drift(s, d):
    config = F.to_json(F.struct("seed", F.coalesce("max_new_tokens", F.lit(-1)).alias("max_new_tokens"), F.coalesce("prompt_field", F.lit("-")).alias("prompt_field")))
    return identity.drifted(table(s, d, "banks").withColumn("config", config), ["method"], "config")


@query("SELECT line_no, " + " AND ".join(f"coalesce(metrics.{x}::VARCHAR NOT IN ('nan', 'inf', '-inf'), true)" for x in _DOUBLES) + " AS finite FROM candidates")
def finite_metrics(s, d):
    return _candidates(s, d).select("line_no", M.all_finite(F.col("metrics"), _candidates(s, d).schema["metrics"].dataType).alias("finite"))


@query("SELECT line_no, " + ", ".join("CASE WHEN numbers IS NOT NULL AND target IS NOT NULL AND allowed_ops IS NOT NULL THEN " + "'" + X.PROMPTS[level].replace("'", "''").replace("{numbers}", "' || array_to_string(numbers, ', ') || '").replace("{target}", "' || target || '").replace("{ops}", "' || array_to_string(allowed_ops, ' ') || '") + f"' END AS {level}" for level in X.PROMPTS) + " FROM tasks")
def prompts_of_levels(s, d):
    return table(s, d, "tasks").select("line_no", *(X.prompt(F.col("numbers"), F.col("target"), F.col("allowed_ops"), level).alias(level) for level in X.PROMPTS))


@query(f"SELECT key, array_to_string(list_sort(list(DISTINCT id)), ',') AS ids FROM (SELECT {_TASK.replace('OPS', 'allowed_ops')} AS key, id FROM tasks WHERE id IS NOT NULL AND {_WHOLE_TASK.replace('OPS', 'allowed_ops')}) GROUP BY key")
def ids_by_key(s, d):
    return K.ids_by_key(table(s, d, "tasks").where("id is not null"), K.semantic_key()).select("key", F.array_join("ids", ",").alias("ids"))


@query(
    f"""WITH v AS (SELECT DISTINCT id FROM tasks WHERE lower(trim(split)) = 'validation' AND id IS NOT NULL), k AS (SELECT id, lower(trim(split)) AS sp, {_KEY} AS k FROM tasks WHERE numbers IS NOT NULL AND target IS NOT NULL AND allowed_ops IS NOT NULL)
SELECT (SELECT sha256(string_agg(id || chr(10), '' ORDER BY id)) FROM v) AS digest, (SELECT count(*) FROM v) AS ids, count(DISTINCT id) AS exposed FROM k WHERE id IN (SELECT id FROM v) AND k IN (SELECT k FROM k WHERE sp = 'train')"""
)
def train_exposure(s, d):
    t = table(s, d, "tasks")
    ids = t.where(audit.split_name() == "validation").where("id is not null").select("id").distinct().withColumn("pos", F.col("id"))
    return audit.train_exposure(ids, t)


_CHECKED = f"SELECT id, lower(trim(split)) AS split, difficulty, {_VALID} AS ok, CASE WHEN numbers IS NOT NULL AND target IS NOT NULL AND allowed_ops IS NOT NULL THEN {_KEY} END AS k, CASE WHEN numbers IS NOT NULL AND target IS NOT NULL THEN (list_sort(numbers), target) END AS l FROM tasks"


@query(
    f"""WITH t AS ({_CHECKED}), pi AS (SELECT split, id, count(*) AS c FROM t GROUP BY split, id), pk AS (SELECT split, k, count(*) AS c FROM t WHERE k IS NOT NULL GROUP BY split, k), un AS (SELECT DISTINCT id, k FROM t WHERE id IS NOT NULL AND k IS NOT NULL)
SELECT 'rows that lack what a task needs' AS "check", 'integrity' AS level, count(*) FILTER (NOT ok) AS failures FROM t UNION ALL SELECT 'ids that repeat in a split', 'integrity', count(*) FILTER (c > 1) FROM pi UNION ALL SELECT 'tasks that repeat in a split', 'warning', count(*) FILTER (c > 1) FROM pk
UNION ALL SELECT 'ids that stand for several tasks', 'integrity', count(*) FROM (SELECT id FROM un GROUP BY id HAVING count(*) > 1) UNION ALL SELECT 'tasks that have several ids', 'warning', count(*) FROM (SELECT k FROM un GROUP BY k HAVING count(*) > 1) UNION ALL SELECT 'rows without a split', 'integrity', count(*) FILTER (split IS NULL) FROM t
UNION ALL SELECT 'tiers that their split may not hold', 'integrity', count(*) FILTER (NOT CASE WHEN split LIKE 'test\\_ood\\_%' ESCAPE '\\' THEN difficulty = substring(split, 6) ELSE difficulty IN ('easy', 'medium', 'hard') END) FROM t
UNION ALL SELECT 'evaluation ids whose task is in train', 'leak', count(DISTINCT id) FROM t WHERE split <> 'train' AND k IN (SELECT k FROM t WHERE split = 'train' AND k IS NOT NULL) UNION ALL SELECT 'evaluation ids whose numbers and target are in train', 'warning', count(DISTINCT id) FROM t WHERE split <> 'train' AND l IN (SELECT l FROM t WHERE split = 'train' AND l IS NOT NULL)"""
)
def audit_verdict(s, d):
    return audit.audit_verdict(table(s, d, "tasks"))


@query("SELECT bank, count(DISTINCT line_no // 16) AS records, 0::BIGINT AS drifted, 0::BIGINT AS off_budget FROM candidates GROUP BY bank")
def weight_health(s, d):
    records = control.replay_weights(_batches(s, d), "bank", control.WeightSettings(strategy="adaptive_stable", delay=5))
    return reports.weight_health(records, "bank", "adaptive_stable", 5)


# ---- flags of candidates


@query(
    """SELECT line_no, regexp_matches(coalesce(completion, ''), '(?i)<answer>') AS open_tag, regexp_matches(coalesce(completion, ''), '(?i)</answer>') AS close_tag, regexp_matches(coalesce(completion, ''), '(?is)<answer>.*?</answer>') AS span, coalesce(completion_token_count >= 256, false) AS hit_cap,
 CASE WHEN finish_reason = 'eos' THEN 'eos' WHEN completion_token_count >= 256 THEN 'length' ELSE 'other' END AS reason, """
    + f"(CASE WHEN {_m('has_extractable_answer_span')} > 0 AND {_m('correct')} < 1 AND ({_m('uses_numbers')} < 1 OR {_m('evaluates_without_exception')} < 1) THEN 1.0 ELSE 0.0 END)::DOUBLE AS hacking, coalesce(contains(extracted_expression, '/'), false) AS division FROM candidates"
)
def candidate_flags(s, d):
    tags, tokens = X.tag_signals(F.col("completion")), F.col("completion_token_count")
    ended = F.coalesce(F.col("finish_reason") == "eos", F.lit(False))
    return _candidates(s, d).select(
        "line_no", tags["open"].alias("open_tag"), tags["close"].alias("close_tag"), tags["span"].alias("span"), F.coalesce(M.hit_cap(tokens, F.lit(256), F.lit(False)), F.lit(False)).alias("hit_cap"), M.finish_reason(tokens, F.lit(256), ended).alias("reason"), M.hacking_candidate().alias("hacking"), M.uses_division(F.col("extracted_expression")).alias("division")
    )


@query("""WITH o AS (SELECT line_no, list_distinct(regexp_extract_all(metrics.expression, '[-+*/]')) AS used, allowed_ops, numbers FROM candidates WHERE metrics.expression IS NOT NULL AND allowed_ops IS NOT NULL AND numbers IS NOT NULL)
SELECT line_no, round(CASE WHEN len(used) = 0 THEN CASE WHEN len(numbers) <= 1 THEN 1.0 ELSE 0.0 END ELSE len(list_filter(used, lambda x: list_contains(allowed_ops, x))) / len(used)::DOUBLE END, 9) AS share FROM o""")
def operator_shares(s, d):
    rows = _candidates(s, d).where("metrics.expression is not null and allowed_ops is not null and numbers is not null")
    used = F.regexp_extract_all(F.col("metrics.expression"), F.lit("([-+*/])"))
    return rounded(rows.select("line_no", A.operator_share(used, F.col("allowed_ops"), F.col("numbers")).alias("share")))


@query(_SHIFT.replace("FROM b) GROUP BY difficulty)", "FROM b JOIN (SELECT bank, method FROM banks) USING (bank)) GROUP BY difficulty, method)").replace("w AS (SELECT difficulty,", "w AS (SELECT difficulty, method,") + ", sh AS (SELECT difficulty, method, lh - lm AS loss FROM w WHERE nh > 0 AND nm > 0), ad AS (SELECT a.loss - z.loss AS x FROM sh a JOIN sh z ON a.difficulty = z.difficulty AND a.method = 'stable' AND z.method = 'static') SELECT count(*) AS pairs, round(avg(x), 9) AS mean, round(stddev_pop(x), 9) AS spread, coalesce(bool_and(x > 0), false) OR coalesce(bool_and(x < 0), false) AS consistent FROM ad")
def shift_interaction(s, d):
    rows = _candidates(s, d).join(table(s, d, "banks").select("bank", "method"), "bank")
    shift = diagnosis.prompt_shift(rows, ["difficulty", "method"], weak="prompt_low")
    return rounded(diagnosis.shift_interaction(shift, "method", ["difficulty"], "stable", "static"))


@query("SELECT 'split' AS \"column\", count(DISTINCT split) AS n FROM banks HAVING count(DISTINCT split) > 1 UNION ALL SELECT 'prompt_field', count(DISTINCT prompt_field) FROM banks HAVING count(DISTINCT prompt_field) > 1 UNION ALL SELECT 'n_candidates', count(DISTINCT n_candidates) FROM banks HAVING count(DISTINCT n_candidates) > 1")
def signature_differences(s, d):
    """Which choices the banks do not share."""
    return inference.same_signature(table(s, d, "banks"), ["split", "prompt_field", "n_candidates"]).select("column", F.size("values").cast("long").alias("n"))


def scored_completions(s, d):
    rows = _candidates(s, d).where("numbers is not null and target is not null and allowed_ops is not null").select("line_no", "completion", "numbers", "target", "allowed_ops")
    return rounded(scoring.scored(rows).select("line_no", "reward", "components.valid_expression", "components.exact_correct"))


def code_task_sets(s, d):
    return generate.code_tasks(s, 20)


QUERIES |= {"scored_completions": scored_completions, "code_task_sets": code_task_sets}
