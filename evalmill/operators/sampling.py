"""Deterministic orders, stratified samples, splits by quota and sets of keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalmill.functions import keys as K


def stratified_sample(df: DataFrame, strata: str, key: str, quota: int | dict[str, int], seed: int = 0, domain: str = "sample") -> DataFrame:
    """The ``quota`` rows of each stratum that come first in the stable order; the limit is applied before the shuffle."""
    w = Window.partitionBy(strata).orderBy(K.stable_order(seed, domain, F.col(key)), key)
    most = quota if isinstance(quota, int) else max(quota.values(), default=0)
    ranked = df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most)
    if isinstance(quota, dict):
        limit = F.coalesce(*(F.when(F.col(strata).eqNullSafe(F.lit(s)), F.lit(q)) for s, q in quota.items()), F.lit(0))
        ranked = ranked.where(F.col("_n") <= limit)
    return ranked.drop("_n")


def complement(df: DataFrame, sample: DataFrame, key: str) -> DataFrame:
    return df.join(sample.select(key), key, "left_anti")


def split_by_quota(df: DataFrame, strata: str, order: Column, quotas: list[tuple[str, int]]) -> DataFrame:
    """Adds ``part``: each stratum in order, cut at the cumulative quotas; rows beyond all quotas have none.

    Only the first rows of each stratum are ranked, a number that Spark limits before the shuffle; they give the places
    to cut at, and every row is compared with those of its stratum. ``order`` is unique in a stratum and never null.
    """
    ends = [sum(q for _, q in quotas[: k + 1]) for k in range(len(quotas))]
    w = Window.partitionBy("_s").orderBy("_o")
    first = df.select(F.col(strata).alias("_s"), order.alias("_o")).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= ends[-1])
    cuts = first.groupBy("_s").agg(F.count(F.lit(1)).alias("_rows"), *(F.max(F.when(F.col("_n") <= e, F.col("_o"))).alias(f"_c{k}") for k, e in enumerate(ends)))
    part = F.lit(None).cast("string")
    for k in reversed(range(len(ends))):
        part = F.when((F.col("_rows") < ends[k]) | (order <= F.col(f"_c{k}")), quotas[k][0]).otherwise(part)
    return df.join(cuts, df[strata].eqNullSafe(cuts["_s"]), "left").select(*(df[c] for c in df.columns), part.alias("part"))


def weighted_order(df: DataFrame, key: str, weight: str, seed: int = 0) -> DataFrame:
    """Adds ``draw``: ascending, it orders rows as weighted sampling without replacement does; weight 0 comes last."""
    u = (F.conv(F.substring(K.stable_order(seed, "weighted", F.col(key)), 1, 12), 16, 10).cast("double") + 1) / (1 << 48)
    return df.withColumn("draw", F.when(F.col(weight) > 0, -F.log(u) / F.col(weight)).otherwise(F.lit(float("inf"))))


def set_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(side, key) of keys on one side only."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    missing = a.join(b, key, "left_anti").select(F.lit("left").alias("side"), key)
    return missing.unionByName(b.join(a, key, "left_anti").select(F.lit("right").alias("side"), key))


def top_by_count(df: DataFrame, key: str, k: int) -> DataFrame:
    """The k most frequent values, ties by value."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), key).limit(k)


def tier_draws(df: DataFrame, key: str, tier: str, shares: dict[str, float], count: int, seed: int = 0) -> DataFrame:
    """The ``count`` rows that tier-weighted sampling without replacement draws, with ``draw``, in whose order they come.

    Each row's weight is the share of its tier over the rows of that tier; rows of tiers without a share are never drawn.
    """
    sizes = df.groupBy(tier).agg(F.count(F.lit(1)).alias("_n"))
    share = F.coalesce(*(F.when(F.col(tier) == t, F.lit(float(x))) for t, x in shares.items()), F.lit(0.0))
    weighted = df.join(F.broadcast(sizes), tier).withColumn("_w", share / F.col("_n"))  # one row for each tier
    return weighted_order(weighted.where("_w > 0"), key, "_w", seed).drop("_n", "_w").orderBy("draw", key).limit(count)


def ordered_digest(df: DataFrame, position: str, value: str) -> DataFrame:
    """One row: the digest of a list's values in the order of their positions, each with a line end, and how many there are.

    For id lists, which a task can hold.
    """
    lines = F.transform(F.array_sort(F.collect_list(F.struct(position, value))), lambda x: F.concat(x[value].cast("string"), F.lit("\n")))
    return df.where(F.col(value).isNotNull()).agg(F.sha2(F.array_join(lines, ""), 256).alias("digest"), F.count(F.lit(1)).alias("ids"))
