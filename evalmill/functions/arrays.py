"""Arrays as multisets and lists, in Spark's higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _long(x) -> Column:
    return F.lit(x).cast("long")


def occurrences(a: Column, x: Column) -> Column:
    return F.size(F.filter(a, lambda y: y == x))


def multiset_common(a: Column, b: Column) -> Column:
    """How many elements two multisets share."""
    return F.aggregate(F.array_distinct(a), _long(0), lambda s, x: s + F.least(occurrences(a, x), occurrences(b, x)))


def multiset_scores(used: Column, required: Column) -> Column:
    """Struct of precision, recall, f1, no_extra and all_required of the numbers used."""
    common = multiset_common(used, required).cast("double")
    p, r = common / F.greatest(F.lit(1), F.size(used)), common / F.greatest(F.lit(1), F.size(required))
    f1 = F.when(p + r == 0, 0.0).otherwise(F.try_divide(2 * p * r, p + r))
    return F.struct(p.alias("precision"), r.alias("recall"), f1.alias("f1"), (common == F.size(used)).alias("no_extra"), (common == F.size(required)).alias("all_required"))


def operator_share(ops: Column, allowed: Column, required: Column) -> Column:
    """Share of the distinct operators used that are allowed; without any, 1 where one number is required at most."""
    d = F.array_distinct(ops)
    return F.when(F.size(d) == 0, F.when(F.size(required) <= 1, 1.0).otherwise(0.0)).otherwise(F.size(F.array_intersect(d, allowed)) / F.greatest(F.lit(1), F.size(d)))


def _prefixes(a: Column, fold) -> Column:
    return F.transform(a, lambda x, i: fold(F.slice(a, 1, i + 1)))


def _sum(a: Column) -> Column:
    return F.aggregate(a, _long(0), lambda s, x: s + x)


def _even(x: Column) -> Column:
    return F.pmod(x, F.lit(2)) == 0


def run_lengths(a: Column) -> Column:
    """Array of (value, length) of the runs of equal neighbours."""
    starts = F.filter(F.transform(a, lambda x, i: F.struct(x.alias("value"), i.alias("at"))), lambda s: (s.at == 0) | ~s.value.eqNullSafe(F.try_element_at(a, s.at)))
    return F.transform(starts, lambda s, k: F.struct(s.value.alias("value"), (F.coalesce(F.try_element_at(starts, k + 2).getField("at"), F.size(a)) - s.at).alias("length")))


def pair_sums_to(a: Column, target: Column) -> Column:
    """Whether two elements at different places add up to the target."""
    return F.exists(F.transform(a, lambda x, i: F.exists(F.transform(a, lambda y, j: (i < j) & (x + y == target)), lambda t: t)), lambda t: t)


#: The list functions of code tasks, by name, over array columns (and numbers where there are two arguments).
LIST_FUNCTIONS = {
    "double": lambda x: x * 2,
    "square": lambda x: x * x,
    "abs": F.abs,
    "is_even": _even,
    "max_two": F.greatest,
    "min_two": F.least,
    "first": lambda a: F.try_element_at(a, F.lit(1)),
    "last": lambda a: F.try_element_at(a, F.lit(-1)),
    "max_list": F.array_max,
    "count_even": lambda a: F.size(F.filter(a, _even)),
    "count_greater": lambda a, t: F.size(F.filter(a, lambda x: x > t)),
    "count_in_range": lambda a, lo, hi: F.size(F.filter(a, lambda x: x.between(lo, hi))),
    "sum_positive": lambda a: _sum(F.filter(a, lambda x: x > 0)),
    "sum_pos_even": lambda a: _sum(F.filter(a, lambda x: (x > 0) & _even(x))),
    "prefix_sum": lambda a: _prefixes(a, _sum),
    "running_max": lambda a: _prefixes(a, F.array_max),
    "running_min": lambda a: _prefixes(a, F.array_min),
    "dedupe": F.array_distinct,
    "unique_sorted": lambda a: F.array_sort(F.array_distinct(a)),
    "second_max": lambda a: F.try_element_at(F.reverse(F.array_sort(F.array_distinct(a))), F.lit(2)),
    "is_sorted_asc": lambda a: a == F.array_sort(a),
    "is_palindrome_list": lambda a: a == F.reverse(a),
    "merge_sorted": lambda a, b: F.array_sort(F.concat(a, b)),
    "pairwise_diff": lambda a: F.transform(F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(0))), lambda x, i: x - F.try_element_at(a, i + 1)),
    "zip_sum": lambda a, b: F.transform(F.slice(a, 1, F.least(F.size(a), F.size(b))), lambda x, i: x + F.try_element_at(b, i + 1)),
    "group_parity": lambda a: F.struct(F.filter(a, _even).alias("even"), F.filter(a, lambda x: ~_even(x)).alias("odd")),
    "group_by_sign": lambda a: F.struct(F.filter(a, lambda x: x < 0).alias("negative"), F.filter(a, lambda x: x == 0).alias("zero"), F.filter(a, lambda x: x > 0).alias("positive")),
    "run_length": run_lengths,
    "two_sum_exists": pair_sums_to,
}


def strip_padding(tokens: Column, pad: Column) -> Column:
    """Token ids without the padding at the end."""
    kept = F.array_max(F.filter(F.transform(tokens, lambda x, i: F.when(~x.eqNullSafe(pad), i + 1)), lambda i: i.isNotNull()))
    return F.slice(tokens, 1, F.coalesce(kept, F.lit(0)))
