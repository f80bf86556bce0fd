"""Audits of task sets: schema, duplicates, overlap between splits, frozen ids, quotas and drift."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalmill.functions import keys as K


def split_name(column: str = "split") -> Column:
    """A split's name without the case and blanks it was written with."""
    return F.lower(F.trim(F.regexp_replace(column, r"(?U)\s+", " ")))


def duplicate_groups(df: DataFrame, key: Column, by: list[str] | None = None, line: str = "line_no") -> DataFrame:
    """(by, groups, rows, extra): keys that occur more than once, their rows, and rows beyond the first of each."""
    by = by or []
    g = df.select(*by, key.alias("_k")).where("_k is not null").groupBy(*by, "_k").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    return g.groupBy(*by).agg(F.count(F.lit(1)).alias("groups"), F.sum("c").alias("rows"), F.sum(F.col("c") - 1).alias("extra"))


def keep_first(df: DataFrame, key: Column, order: str = "line_no") -> DataFrame:
    """The first row of each key; rows with a null key stay. One partial aggregation and a join on the unique order."""
    firsts = df.select(key.alias("_k"), F.col(order).alias("_o")).where("_k is not null").groupBy("_k").agg(F.min("_o").alias("_o")).select("_o")
    unkeyed = df.select(key.alias("_k"), F.col(order).alias("_o")).where("_k is null").select("_o")
    return df.join(firsts.unionByName(unkeyed), df[order] == F.col("_o"), "left_semi")


def split_audit(df: DataFrame, split: str = "split") -> DataFrame:
    """Per split: rows, distinct ids, ids that repeat, task keys that repeat, rows that fail the schema check."""
    bad = ~valid_task()
    per_id = df.groupBy(split_name(split).alias("split"), "id").agg(F.count(F.lit(1)).alias("c"), F.count_if(bad).alias("bad"))
    ids = per_id.groupBy("split").agg(F.sum("c").alias("rows"), F.count("id").alias("ids"), F.count_if(F.col("c") > 1).alias("repeated_ids"), F.sum("bad").alias("invalid"))
    keys = df.select(split_name(split).alias("split"), K.semantic_key().alias("k")).where("k is not null").groupBy("split", "k").agg(F.count(F.lit(1)).alias("c")).groupBy("split").agg(F.count_if(F.col("c") > 1).alias("repeated_keys"))
    return ids.alias("i").join(keys.alias("k"), F.col("i.split").eqNullSafe(F.col("k.split")), "left").select("i.*", F.coalesce("repeated_keys", F.lit(0)).alias("repeated_keys"))


def valid_task() -> Column:
    """Whether a task row has all that a task needs: id, tier, numbers, operators of the four, target and solution."""
    ops = F.forall("allowed_ops", lambda o: o.isin("+", "-", "*", "/"))
    return F.coalesce(
        F.col("id").isNotNull() & F.col("difficulty").isNotNull() & (F.size("numbers") > 0) & F.forall("numbers", lambda x: x.isNotNull()) & F.col("target").isNotNull() & (F.size("allowed_ops") > 0) & ops & (F.length("solution") > 0), F.lit(False)
    )


def overlap_matrix(df: DataFrame, group: Column, key: Column) -> DataFrame:
    """(left, right, keys, left_rows, right_rows, pairs, left_share): keys that two groups share, for all pairs of groups.

    Rows are counted by (key, group) first; the join meets one row for each key and group, whatever the copies.
    """
    counts = df.select(group.alias("g"), key.alias("k")).where("g is not null and k is not null").groupBy("k", "g").agg(F.count(F.lit(1)).alias("c"))
    total = df.select(group.alias("g")).where("g is not null").groupBy("g").agg(F.count(F.lit(1)).alias("t"))
    a, b = counts.select("k", F.col("g").alias("left"), F.col("c").alias("l")), counts.select("k", F.col("g").alias("right"), F.col("c").alias("r"))
    met = a.join(b, "k").where("left < right").groupBy("left", "right").agg(F.count(F.lit(1)).alias("keys"), F.sum("l").alias("left_rows"), F.sum("r").alias("right_rows"), F.sum(F.col("l") * F.col("r")).alias("pairs"))
    return met.join(total.withColumnRenamed("g", "left"), "left").select("left", "right", "keys", "left_rows", "right_rows", "pairs", (F.col("left_rows") / F.col("t")).alias("left_share"))


def overlap_stats(left: DataFrame, right: DataFrame, key: Callable[[], Column] = K.semantic_key, row_id: str = "id") -> DataFrame:
    """One row: shared keys, affected rows and distinct ids of both sides, pairs of rows, shares of both sides."""
    side = lambda df: df.select(key().alias("k"))
    count = lambda df, n: side(df).where("k is not null").groupBy("k").agg(F.count(F.lit(1)).alias(n))
    met = count(left, "l").join(count(right, "r"), "k")
    both = met.agg(F.count(F.lit(1)).alias("keys"), F.coalesce(F.sum("l"), F.lit(0)).alias("left_rows"), F.coalesce(F.sum("r"), F.lit(0)).alias("right_rows"), F.coalesce(F.sum(F.col("l") * F.col("r")), F.lit(0)).alias("pairs"))
    ids = affected_ids(left, right, key, row_id).groupBy().agg(F.count_if(F.col("side") == "left").alias("left_ids"), F.count_if(F.col("side") == "right").alias("right_ids"))
    sizes = left.agg(F.count(F.lit(1)).alias("ln")).crossJoin(right.agg(F.count(F.lit(1)).alias("rn"))).crossJoin(ids)  # one row each
    return both.crossJoin(sizes).select("keys", "left_rows", "right_rows", "left_ids", "right_ids", "pairs", F.coalesce(F.try_divide("left_rows", "ln"), F.lit(0.0)).alias("left_share"), F.coalesce(F.try_divide("right_rows", "rn"), F.lit(0.0)).alias("right_share"))


def affected_ids(left: DataFrame, right: DataFrame, key: Callable[[], Column] = K.semantic_key, row_id: str = "id") -> DataFrame:
    """(side, id): the distinct ids of either side whose keys the other side has too."""
    rows = lambda df: df.select(key().alias("k"), F.col(row_id).alias("id")).where("k is not null")
    one = lambda a, b, name: rows(a).join(rows(b).select("k"), "k", "left_semi").where("id is not null").select(F.lit(name).alias("side"), "id").distinct()
    return one(left, right, "left").unionByName(one(right, left, "right"))


def frozen_ids(ids: DataFrame, tasks: DataFrame, intended: Column) -> DataFrame:
    """One row: ids, distinct, repeated, missing from the tasks, in another split than intended."""
    owner = tasks.groupBy("id").agg(F.bool_or(F.coalesce(intended, F.lit(False))).alias("right_split"))
    j = ids.groupBy("id").agg(F.count(F.lit(1)).alias("c")).join(owner, "id", "left")
    return j.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("ids"), F.count(F.lit(1)).alias("distinct_ids"), F.count_if(F.col("c") > 1).alias("repeated"), F.count_if(F.col("right_split").isNull()).alias("missing"), F.count_if(~F.col("right_split")).alias("wrong_split"))


def quota_check(df: DataFrame, group: list[Column], quotas: DataFrame, names: list[str]) -> DataFrame:
    """Groups whose count is not their quota; ``quotas`` has the names and ``quota``."""
    have = df.groupBy(*(g.alias(n) for g, n in zip(group, names, strict=True))).agg(F.count(F.lit(1)).alias("rows"))
    return have.join(quotas, names, "full_outer").select(*names, F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("quota", F.lit(0)).alias("quota")).where("rows <> quota")


def drift(expected: DataFrame, actual: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(field, differing) over rows of both, plus how many keys are missing and extra; null equals null."""
    e, a = expected.select(key, F.struct(*fields).alias("e")), actual.select(key, F.struct(*fields).alias("a"))
    j = e.join(a, key, "full_outer")
    both = F.col("e").isNotNull() & F.col("a").isNotNull()
    facts = [("(missing)", F.col("a").isNull()), ("(extra)", F.col("e").isNull()), *((f, both & ~F.col(f"e.{f}").eqNullSafe(F.col(f"a.{f}"))) for f in fields)]
    return j.select(F.explode(F.array(*(F.struct(F.lit(n).alias("field"), c.cast("long").alias("x")) for n, c in facts))).alias("f")).groupBy("f.field").agg(F.sum("f.x").alias("differing"))


def guard_intersections(view: DataFrame, protected: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """(key, shared): how many distinct values of each key a view shares with protected rows."""
    long = lambda df: df.select(F.explode(F.array(*(F.struct(F.lit(n).alias("key"), c.alias("value")) for n, c in keys.items()))).alias("x")).select("x.*").where("value is not null").distinct()
    shared = long(view).join(long(protected), ["key", "value"], "left_semi").groupBy("key").agg(F.count(F.lit(1)).alias("shared"))
    names = view.sparkSession.createDataFrame([(n,) for n in keys], "key string")
    return names.join(shared, "key", "left").select("key", F.coalesce("shared", F.lit(0)).alias("shared"))


def containment(long_texts: DataFrame, short_texts: DataFrame, key: str, text: str, short_key: str, short: str, words: int = 4) -> DataFrame:
    """(key, short_key) of texts that contain a short text whole, by an equi-join on a run of its words, then a check.

    Every text is cut into runs of ``words`` words; short texts need two words more than that. Keys are unique.
    """
    cut = lambda c: F.array_compact(F.transform(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda x: F.nullif(x, F.lit(""))))
    runs = F.expr(f"transform(sequence(1, greatest(1, size(w) - {words - 1})), i -> array_join(slice(w, i, {words}), ' '))")
    grams = long_texts.where(F.col(text).isNotNull()).select(key, cut(F.col(text)).alias("w")).select(key, F.explode(F.array_distinct(runs)).alias("g"))
    # the first word may be the end of a longer one, so the run begins at the second
    head = short_texts.where(F.col(short).isNotNull()).select(short_key, cut(F.col(short)).alias("w")).where(F.size("w") > words + 1).select(short_key, F.array_join(F.slice("w", 2, words), " ").alias("g"))
    met = grams.join(head, "g").select(key, short_key).distinct()
    return met.join(long_texts.select(key, text), key).join(short_texts.select(short_key, short), short_key).where(F.contains(F.col(text), F.col(short))).select(key, short_key)


def ranked(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w))


def identity_conflicts(df: DataFrame) -> DataFrame:
    """(kind, value, others): ids that stand for several tasks, and tasks that have several ids, with how many."""
    pairs = df.select("id", K.semantic_key().alias("task")).where("id is not null and task is not null").distinct()
    ids = pairs.groupBy(F.col("id").alias("value")).agg(F.count(F.lit(1)).alias("others")).where("others > 1").select(F.lit("id").alias("kind"), "value", "others")
    return ids.unionByName(pairs.groupBy(F.col("task").alias("value")).agg(F.count(F.lit(1)).alias("others")).where("others > 1").select(F.lit("task").alias("kind"), "value", "others"))


def tier_fits_split(split: str = "split", tier: str = "difficulty") -> Column:
    """Whether a split may hold a tier: the three of the usual distribution, or the one that the split is named after."""
    name = split_name(split)
    return F.when(name.startswith("test_ood_"), F.col(tier) == F.regexp_replace(name, "^test_", "")).otherwise(F.col(tier).isin("easy", "medium", "hard"))


def view_checks(source: DataFrame, sample: DataFrame, rest: DataFrame, key: str) -> DataFrame:
    """(shared, missing, foreign): whether a sample and its complement share keys, miss some of the source or hold others."""
    flag = lambda df, n: df.select(key, F.lit(n).alias("side")).distinct()
    sides = flag(source, "source").unionByName(flag(sample, "sample")).unionByName(flag(rest, "rest")).groupBy(key).agg(F.collect_set("side").alias("in"))  # three names at most
    has = lambda n: F.array_contains("in", n)
    return sides.agg(F.count_if(has("sample") & has("rest")).alias("shared"), F.count_if(has("source") & ~has("sample") & ~has("rest")).alias("missing"), F.count_if(~has("source")).alias("foreign"))


def train_exposure(ids: DataFrame, tasks: DataFrame) -> DataFrame:
    """One row: the digest of an ordered list of (pos, id), its ids, and how many of their tasks train has too, by key."""
    from evalmill.operators.sampling import ordered_digest

    own = ids.select("id").distinct().join(tasks.select("id", K.semantic_key().alias("k")), "id").where("k is not null")
    train = tasks.where(split_name() == "train").select(K.semantic_key().alias("k")).where("k is not null").distinct()
    exposed = own.join(train, "k", "left_semi").agg(F.count_distinct("id").alias("exposed"))
    return ordered_digest(ids, "pos", "id").crossJoin(exposed)  # one row each


def audit_verdict(df: DataFrame, split: str = "split") -> DataFrame:
    """(check, level, failures): every check of a task set with how many rows, ids or keys fail it, also where none does.

    Levels: integrity (the data is wrong), leak (evaluation tasks are in train), warning.
    """
    per = split_audit(df, split)
    name = split_name(split)
    t = df.withColumn("_split", name)
    overlap = overlap_stats(t.where("_split = 'train'"), t.where("_split <> 'train'"))
    loose = overlap_stats(t.where("_split = 'train'"), t.where("_split <> 'train'"), K.loose_key)
    conflicts = identity_conflicts(df)
    facts = [
        (per.agg(F.coalesce(F.sum("invalid"), F.lit(0)).alias("n")), "rows that lack what a task needs", "integrity"),
        (per.agg(F.coalesce(F.sum("repeated_ids"), F.lit(0)).alias("n")), "ids that repeat in a split", "integrity"),
        (per.agg(F.coalesce(F.sum("repeated_keys"), F.lit(0)).alias("n")), "tasks that repeat in a split", "warning"),
        (conflicts.where("kind = 'id'").agg(F.count(F.lit(1)).alias("n")), "ids that stand for several tasks", "integrity"),
        (conflicts.where("kind = 'task'").agg(F.count(F.lit(1)).alias("n")), "tasks that have several ids", "warning"),
        (t.agg(F.count_if(F.col("_split").isNull()).alias("n")), "rows without a split", "integrity"),
        (t.agg(F.count_if(F.coalesce(~tier_fits_split(split), F.lit(False))).alias("n")), "tiers that their split may not hold", "integrity"),
        (overlap.select(F.col("right_ids").alias("n")), "evaluation ids whose task is in train", "leak"),
        (loose.select(F.col("right_ids").alias("n")), "evaluation ids whose numbers and target are in train", "warning"),
    ]
    out = None
    for counted, check, level in facts:
        row = counted.select(F.lit(check).alias("check"), F.lit(level).alias("level"), F.col("n").cast("long").alias("failures"))
        out = row if out is None else out.unionByName(row)
    return out
