"""Records of the evaluation splits that occur in train again, exactly or with one number changed.

A record is its target, the multiset of its numbers and the set of its operators; its class is a 128-bit digest of
these. Two records of equally many numbers n that differ in one number share n-1 of n multiset tokens, so by the prefix
filter they share one of the two rarest tokens of each. Evaluation prefixes are indexed by (target, n, token), train
prefixes probe them, and the few pairs that meet are verified. The length filter is in the key, since both sides hold n
numbers; with two tokens in a prefix no position is too far back, so a filter by position has nothing to leave out.
Copies are folded into classes before the join; only class ids and tokens go through it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of one class that one task unfolds, at most about so many.
CHUNK = 4096


def _split() -> Column:
    return F.lower(F.regexp_replace("split", r"(?U)^[\s\p{Cf}]+|[\s\p{Cf}]+$", ""))


def _records(df: DataFrame, *more: Column) -> DataFrame:
    """(line_no, is_train, cid, target, nums, ops, n) of the rows that can be a case, and further columns."""
    whole = df.where("split is not null and target is not null and allowed_ops is not null and size(numbers) > 0")
    rows = whole.select("line_no", (_split() == "train").alias("is_train"), "target", F.array_sort("numbers").alias("nums"), F.array_sort(F.array_distinct("allowed_ops")).alias("ops"), *more)
    return rows.select("*", F.size("nums").alias("n"), F.unhex(F.md5(F.to_json(F.struct("target", "nums", "ops")))).alias("cid"))


def _prefixed(records: DataFrame) -> DataFrame:
    """(is_train, cid, target, n, ops, rows, tokens, prefix): one row for each side and class.

    ``tokens`` are its multiset tokens, as value#occurrence, the rarest first, ``prefix`` the first two. Rarity is the
    number of classes of a side that hold the token under the same target and n, then the token itself. A record of one
    number gets a token that all such records share, since one changed number leaves none.
    """
    keys = ["is_train", "cid", "target", "n", "ops"]
    classes = records.groupBy(*keys, "nums").agg(F.count(F.lit(1)).alias("rows"))
    tokens = F.expr("transform(nums, (x, i) -> concat(coalesce(cast(x as string), 'null'), '#', cast(size(filter(slice(nums, 1, i), y -> y <=> x)) as string)))")
    exploded = classes.select(*keys, "rows", F.explode(F.when(F.col("n") == 1, F.array_append(tokens, F.lit("*"))).otherwise(tokens)).alias("token"))
    rarity = exploded.groupBy("target", "n", "token").agg(F.count(F.lit(1)).alias("df"))
    ranked = exploded.join(rarity, ["target", "n", "token"]).groupBy(*keys, "rows").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("ranked"))  # n tokens of one class
    return ranked.select(*keys, "rows", F.transform("ranked", lambda x: x.token).alias("tokens")).withColumn("prefix", F.slice("tokens", 1, 2))


def _class_pairs(records: DataFrame) -> DataFrame:
    """(train_cid, train_rows, other_cid, other_rows, exact): pairs of classes, one of train and one of another split, that are equal or differ in one number."""
    p = _prefixed(records)
    side = lambda train, name: p.where(F.col("is_train") == train).select("target", "n", *(F.col(c).alias(f"{name}_{c}") for c in ("cid", "ops", "rows", "tokens", "prefix")), F.explode("prefix").alias("token"))
    met = side(False, "other").join(side(True, "train"), ["target", "n", "token"])
    first = F.element_at(F.array_intersect("other_prefix", "train_prefix"), 1) == F.col("token")
    common = F.size(F.array_intersect("other_tokens", "train_tokens")) - F.when(F.col("n") == 1, 1).otherwise(0)
    exact = common == F.col("n")
    return met.where(first & (exact | ((F.col("other_ops") == F.col("train_ops")) & (common == F.col("n") - 1)))).select("train_cid", "train_rows", "other_cid", "other_rows", exact.alias("exact"))


def split_overlap(df: DataFrame) -> DataFrame:
    """(line_a, line_b), line_a < line_b: all pairs of rows, one of split train and one of another, that overlap.

    Reads line_no, split, numbers, target and allowed_ops; other columns are ignored. Defined cases: rows with a
    null split, target or allowed_ops, or null or empty numbers are no case; a null inside numbers is a value equal
    to itself; an empty set of operators is a set; a blank split is a split other than train; repeated rows each
    take part; an empty table gives no rows.

    A class with very many copies on both sides is unfolded in chunks of both sides' members, so that no task
    holds more than the rows of one pair of chunks.
    """
    records = _records(df)
    chunks = lambda rows: F.ceil(F.col(rows) / CHUNK).cast("int")
    large = records.groupBy("is_train", "cid").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > CHUNK).select("is_train", "cid", chunks("rows").alias("chunks"))
    members = records.select("line_no", "is_train", "cid").join(large, ["is_train", "cid"], "left").select("line_no", "is_train", "cid", F.pmod(F.xxhash64("line_no"), F.coalesce("chunks", F.lit(1))).cast("int").alias("chunk"))
    pairs = _class_pairs(records)
    for name in ("train", "other"):
        pairs = pairs.select("*", F.explode(F.sequence(F.lit(0), chunks(f"{name}_rows") - 1)).alias(f"{name}_chunk"))
    for name, train in (("train", True), ("other", False)):
        m = members.where(F.col("is_train") == train).select(F.col("cid").alias(f"{name}_cid"), F.col("chunk").alias(f"{name}_chunk"), F.col("line_no").alias(f"{name}_line"))
        pairs = pairs.join(m, [f"{name}_cid", f"{name}_chunk"])
    return pairs.select(F.least("train_line", "other_line").alias("line_a"), F.greatest("train_line", "other_line").alias("line_b"))


def split_overlap_report(df: DataFrame) -> DataFrame:
    """Per split other than train and metadata.source (null where unknown): rows that overlap train, exactly and almost.

    A row that overlaps both ways counts as exact. Uses the classes; no pairs of rows are made.
    """
    hit = _class_pairs(_records(df)).groupBy(F.col("other_cid").alias("cid")).agg(F.max("exact").alias("exact"))
    rows = _records(df, _split().alias("split"), F.col("metadata.source").alias("source")).where("not is_train").select("split", "source", "cid").join(hit, "cid")
    return rows.groupBy("split", "source").agg(F.count(F.lit(1)).alias("overlapping"), F.count_if("exact").alias("exact"), F.count_if(~F.col("exact")).alias("almost"))
