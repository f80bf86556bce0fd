"""Column functions over metrics, counts and texts of candidates. Missing metrics count as 0 throughout."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The weights of the practical score and the order in which they are added.
PRACTICAL = (("valid_expression", 3.0), ("uses_allowed_numbers", 2.0), ("number_multiset_f1", 1.5), ("uses_allowed_ops", 1.0), ("numeric_distance_reward", 1.0), ("reward_hacking_candidate", -2.0))
#: The metrics that a selection report averages.
SELECTED = ("valid_expression", "exact_correct", "reward_hacking_candidate", "uses_allowed_numbers", "number_multiset_f1", "uses_allowed_ops", "uses_all_required_numbers", "uses_no_extra_numbers", "numeric_distance_reward")
#: Auxiliary reward components and their default weight.
AUXILIARY = ("format", "valid_expression", "number_multiset_f1", "allowed_ops", "numeric_distance_reward", "brevity")


def metric(name: str, struct: str = "metrics") -> Column:
    """A metric; null, NaN and a null struct count as 0."""
    return F.coalesce(F.nanvl(F.col(f"{struct}.{name}").cast("double"), F.lit(0.0)), F.lit(0.0))


def weighted(weights, struct: str = "metrics") -> Column:
    """The sum of metrics by weight, added in the given order."""
    total = None
    for name, w in weights:
        total = metric(name, struct) * F.lit(float(w)) if total is None else total + metric(name, struct) * F.lit(float(w))
    return total


def practical_score(struct: str = "metrics") -> Column:
    """Legality and distance, never exactness."""
    return weighted(PRACTICAL, struct)


def code_practical_score(struct: str = "metrics") -> Column:
    """The practical score of code candidates."""
    return weighted((("valid_expression", 3.0), ("runs_without_error", 1.0), ("visible_pass_rate", 2.0), ("no_hardcoding_heuristic", 1.0)), struct)


def is_exact(struct: str = "metrics") -> Column:
    return metric("exact_correct", struct) > 0


def is_legal(struct: str = "metrics") -> Column:
    return metric("valid_expression", struct) >= 1


def is_clipped(cap: int | Column = 256) -> Column:
    """Whether a completion took its whole budget of tokens; unknown counts did not."""
    return F.coalesce(F.col("completion_token_count") >= cap, F.lit(False))


def hit_cap(tokens: Column, cap: Column, ended: Column) -> Column:
    return (tokens >= cap) & ~ended


def finish_reason(tokens: Column, cap: Column, ended: Column) -> Column:
    return F.when(ended, "eos").when(tokens >= cap, "length").otherwise("other")


def hacking_candidate(struct: str = "metrics") -> Column:
    """An answer span that is not correct and does not use the numbers or does not evaluate."""
    broken = (metric("uses_numbers", struct) < 1) | (metric("evaluates_without_exception", struct) < 1)
    return ((metric("has_extractable_answer_span", struct) > 0) & (metric("correct", struct) < 1) & broken).cast("double")


def uses_division(expression: Column) -> Column:
    return F.coalesce(F.contains(expression, F.lit("/")), F.lit(False))


def unclosed_answer(text: Column) -> Column:
    """Whether the last opening answer tag stands after the last closing one, in any letter case."""
    t = F.reverse(F.lower(F.coalesce(text, F.lit(""))))
    opened, closed = F.instr(t, "rewsna<"), F.instr(t, ">rewsna/<")
    return (opened > 0) & ((closed == 0) | (opened < closed))


def parseable(struct: str = "metrics") -> Column:
    return (metric("evaluates_without_exception", struct) > 0) | (metric("valid_expression", struct) > 0) | (F.col(f"{struct}.expression").isNotNull() & (metric("number_multiset_f1", struct) > 0))


def cost_per_exact(n: Column, rate: Column) -> Column:
    return n / F.greatest(rate, F.lit(1e-12))


def failure_class(struct: str = "metrics", completion: str = "completion") -> Column:
    """The first rule that holds, of ten."""
    m = lambda x: metric(x, struct)
    tags = F.regexp_count(F.coalesce(F.col(completion), F.lit("")), F.lit("</answer>"))
    return (
        F.when(m("exact_correct") > 0, "exact_correct")
        .when(m("has_extractable_answer_span") <= 0, "no_answer_span")
        .when(m("parse_ok") <= 0, "parse_failure")
        .when(m("uses_no_extra_numbers") <= 0, "illegal_extra_or_repeated_number")
        .when(m("uses_all_required_numbers") <= 0, "missing_required_number")
        .when(m("uses_allowed_ops") <= 0, "illegal_operator")
        .when(m("evaluates_without_exception") <= 0, "evaluation_error")
        .when(m("valid_expression") > 0, "legal_but_wrong_value")
        .when(tags > 1, "repeated_answer_tag")
        .otherwise("other_invalid")
    )


def primary_reward(struct: str = "metrics") -> Column:
    return metric("correct", struct)


def auxiliary_reward(weights: dict[str, float] | None = None, struct: str = "metrics") -> Column:
    chosen = weights or dict.fromkeys(AUXILIARY, 0.2)
    return weighted(tuple(chosen.items()), struct)


def total_reward(weights: dict[str, float] | None = None, primary_weight: float = 1.0, struct: str = "metrics") -> Column:
    return primary_reward(struct) * F.lit(float(primary_weight)) + auxiliary_reward(weights, struct)


def all_finite(value: Column, kind: T.DataType) -> Column:
    """Whether all numbers in a value of any type are finite; texts, booleans and nulls pass."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.coalesce(~F.isnan(value) & (F.abs(value) < float("inf")), F.lit(True))
    if isinstance(kind, T.StructType):
        parts = [all_finite(value[f.name], f.dataType) for f in kind.fields]
        return functools.reduce(lambda a, b: a & b, parts, F.lit(True))
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.forall(value, lambda x: all_finite(x, kind.elementType)), F.lit(True))
    if isinstance(kind, T.MapType):
        return F.coalesce(F.forall(F.map_values(value), lambda x: all_finite(x, kind.valueType)), F.lit(True))
    return F.lit(True)


def json_safe(value: Column, kind: T.DataType) -> Column:
    """A value of any type in which numbers that JSON cannot say (NaN, infinities) are null."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*(json_safe(value[f.name], f.dataType).alias(f.name) for f in kind.fields)))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: json_safe(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda _, x: json_safe(x, kind.valueType))
    return value


def first_known(df: DataFrame, *columns: str) -> Column:
    """The first of the columns that the table has, with 0 for null and NaN; 0 where it has none."""
    named = next((c for c in columns if c in df.columns), None)
    return F.lit(0.0) if named is None else F.coalesce(F.nanvl(F.col(named).cast("double"), F.lit(0.0)), F.lit(0.0))
