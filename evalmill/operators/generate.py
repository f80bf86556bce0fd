"""Solvable arithmetic tasks, proposed independently of each other and accepted in a fixed order."""

from __future__ import annotations

import random
from collections.abc import Iterator
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalmill.functions import arrays as A
from evalmill.functions import keys as K
from evalmill.functions.verifier import judge

#: For each tier how many numbers, which operators, the largest number and the largest target.
TIERS = {
    "easy": (3, ("+", "-"), 12, 60),
    "medium": (4, ("+", "-", "*"), 15, 250),
    "hard": (5, ("+", "-", "*"), 20, 700),
    "ood_long": (6, ("+", "-", "*"), 20, 999),
    "ood_division": (5, ("+", "-", "*", "/"), 20, 999),
}
ATTEMPTS = 10_000
SCHEMA = "tier string, proposal_seed long, proposal_index long, numbers array<long>, target long, allowed_ops array<string>, solution string"


def propose(tier: str, seed: int, index: int) -> tuple[list[int], int, str]:
    """The proposal at an index: it depends on nothing but tier, seed and index.

    Two random terms are combined until one is left; terms that divide by 0 or grow beyond five targets, and totals
    that are no integer from 1 to the largest target, start it over.
    """
    count, ops, most, top = TIERS[tier]
    rng = random.Random(f"{tier}:{seed}:{index}")
    for _ in range(ATTEMPTS):
        numbers = [rng.randint(1, most) for _ in range(count)]
        terms = [(Fraction(n), str(n)) for n in numbers]
        while len(terms) > 1:
            (x, a), (y, b) = (terms.pop(rng.randrange(len(terms))) for _ in range(2))
            op = rng.choice(ops)
            if op == "/" and not y:
                break
            value = x + y if op == "+" else x - y if op == "-" else x * y if op == "*" else x / y
            if abs(value) > 5 * top:
                break
            terms.append((value, f"({a}{op}{b})"))
        else:
            value, solution = terms[0]
            if value.denominator == 1 and 1 <= value <= top:
                rng.shuffle(numbers)
                if judge(solution, numbers, int(value), ops)["correct"]:
                    return numbers, int(value), solution
    raise RuntimeError(f"no task of tier {tier} after {ATTEMPTS} attempts")


def proposals(spark: SparkSession, tier: str, count: int, seed: int = 0) -> DataFrame:
    """``count`` proposals of a tier, made where their index is."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(tier, seed, int(i), *propose(tier, seed, int(i))) for i in b["id"]]
            yield pd.DataFrame([(t, s, i, n, v, list(TIERS[tier][1]), e) for t, s, i, n, v, e in rows], columns=["tier", "proposal_seed", "proposal_index", "numbers", "target", "allowed_ops", "solution"])

    return spark.range(count).mapInPandas(run, SCHEMA)


def accept(pools: list[tuple[DataFrame, int]]) -> DataFrame:
    """The first ``target`` new tasks of each pool, in pool order: no (numbers, target) twice over all pools.

    Adds ``pool`` and ``position``. A pool with too few new tasks gives fewer; compare with the targets.
    """
    every = None
    for k, (df, _) in enumerate(pools):
        d = df.withColumn("pool", F.lit(k))
        every = d if every is None else every.unionByName(d)
    order = F.struct("pool", "proposal_index")
    kept = every.groupBy(K.loose_key().alias("key")).agg(F.min_by(F.struct(*every.columns), order).alias("row")).select("row.*")
    w = Window.partitionBy("pool").orderBy("proposal_index")
    targets = F.coalesce(*(F.when(F.col("pool") == k, F.lit(t)) for k, (_, t) in enumerate(pools)))
    most = max(t for _, t in pools)
    ranked = kept.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most)
    return ranked.withColumn("position", F.col("_n") - 1).drop("_n").where(F.col("position") < targets)


def rejections(pools: list[tuple[DataFrame, int]]) -> DataFrame:
    """(pool, proposals, new): how many proposals each pool had and how many of them were new."""
    made = None
    for k, (df, _) in enumerate(pools):
        d = df.select(F.lit(k).alias("pool"), K.loose_key().alias("key"))
        made = d if made is None else made.unionByName(d)
    first = made.groupBy("key").agg(F.min("pool").alias("pool")).groupBy("pool").agg(F.count(F.lit(1)).alias("new"))
    return made.groupBy("pool").agg(F.count(F.lit(1)).alias("proposals")).join(first, "pool", "left").select("pool", "proposals", F.coalesce("new", F.lit(0)).alias("new"))


class RecipeError(ValueError):
    """A recipe asks for what cannot be built."""


def pool_targets(quotas: dict[str, dict[str, int]]) -> dict[str, int]:
    """How many tasks each tier needs over all splits."""
    out: dict[str, int] = {}
    for tiers in quotas.values():
        for tier, n in tiers.items():
            out[tier] = out.get(tier, 0) + n
    return out


def check_recipe(quotas: dict[str, dict[str, int]], proposals_of: dict[str, int]) -> None:
    """Raises RecipeError for unknown tiers, quotas that are no positive integers, and pools that are smaller than their quotas."""
    for split, tiers in quotas.items():
        for tier, n in tiers.items():
            if tier not in TIERS:
                raise RecipeError(f"{split}: unknown tier {tier!r}")
            if type(n) is not int or n < 1:
                raise RecipeError(f"{split}: {tier} has the quota {n!r}")
    for tier, n in pool_targets(quotas).items():
        if proposals_of.get(tier, 0) < n:
            raise RecipeError(f"{tier} needs {n} tasks of {proposals_of.get(tier, 0)} proposals")


def build_splits(spark: SparkSession, quotas: dict[str, dict[str, int]], proposals_of: dict[str, int], seed: int = 0) -> DataFrame:
    """(split, difficulty, numbers, target, allowed_ops, solution, ...): all splits of a data set from one set of pools.

    Each tier is one pool; no task is in two splits or twice in one. A tier's tasks go to the splits in the order given,
    by their quotas. A pool that ran out gives short splits; ``manifest`` shows them.
    """
    check_recipe(quotas, proposals_of)
    targets = pool_targets(quotas)
    tasks = accept([(proposals(spark, tier, proposals_of[tier], seed + k), n) for k, (tier, n) in enumerate(targets.items())])
    split, ends = F.lit(None).cast("string"), dict.fromkeys(targets, 0)
    for name, tiers in quotas.items():
        for tier, n in tiers.items():
            here = (F.col("tier") == tier) & F.col("position").between(ends[tier], ends[tier] + n - 1)
            split, ends[tier] = F.when(here, name).otherwise(split), ends[tier] + n
    return tasks.withColumn("split", split).withColumnRenamed("tier", "difficulty")


def manifest(tasks: DataFrame, quotas: dict[str, dict[str, int]]) -> DataFrame:
    """(split, difficulty, quota, rows, digest): what was asked for and built; the digest is over the sorted task keys."""
    asked = tasks.sparkSession.createDataFrame([(s, t, n) for s, tiers in quotas.items() for t, n in tiers.items()], "split string, difficulty string, quota int")
    built = K.set_digest(tasks.select("split", "difficulty", K.semantic_key().alias("k")), "k", ["split", "difficulty"])
    return asked.join(built, ["split", "difficulty"], "left").select("split", "difficulty", "quota", F.coalesce("members", F.lit(0)).alias("rows"), "digest")


#: Templates of code tasks: functions of one list.
LIST_TASKS = ("max_list", "count_even", "sum_positive", "sum_pos_even", "prefix_sum", "running_max", "running_min", "dedupe", "unique_sorted", "is_sorted_asc", "is_palindrome_list", "pairwise_diff", "last", "first")


def code_tasks(spark: SparkSession, per_template: int, templates: tuple[str, ...] = LIST_TASKS, visible: int = 3, held_out: int = 5, seed: int = 0) -> DataFrame:
    """(id, fn_name, prompt, visible_tests, held_out_tests): tasks to write a function of a list, with their tests.

    The lists are hashed from seed, template, task and case; what is expected is computed by the engine's own list
    functions. Tests are JSON lists of [[argument], expected]. No two tests of a task have the same list.
    """
    every = None
    for name in templates:
        f = A.LIST_FUNCTIONS[name]
        draw = lambda case, i: F.pmod(F.xxhash64(F.lit(seed), F.lit(name), F.col("id"), case, i), F.lit(21)) - 5  # noqa: B023, E731
        size = lambda case: (F.pmod(F.xxhash64(F.lit(seed), F.lit(name), F.col("id"), case), F.lit(6)) + 2).cast("int")  # noqa: B023, E731
        lists = F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(4 * (visible + held_out))), lambda c: F.transform(F.sequence(F.lit(1), size(c)), lambda i: draw(c, i))))  # noqa: B023
        rows = spark.range(per_template).select("id", F.slice(lists, 1, visible + held_out).alias("lists"))
        shown = rows.select("id", F.transform("lists", lambda a: F.concat(F.lit("[["), F.to_json(a), F.lit("], "), _as_json(f(a)), F.lit("]"))).alias("tests"))  # noqa: B023
        part = lambda first, n: F.concat(F.lit("["), F.array_join(F.slice("tests", first, n), ", "), F.lit("]"))
        tests = shown.select(F.concat(F.lit(f"{name}-"), F.col("id").cast("string")).alias("id"), F.lit(name).alias("fn_name"), part(1, visible).alias("visible_tests"), part(visible + 1, held_out).alias("held_out_tests"))
        every = tests if every is None else every.unionByName(tests)
    prompt = F.concat(F.lit("Write a Python function "), F.col("fn_name"), F.lit(" of one list of integers. Some of its tests, as [[argument], result]: "), F.col("visible_tests"), F.lit(". Answer in <answer></answer>."))
    return every.select("id", "fn_name", prompt.alias("prompt"), "visible_tests", "held_out_tests")


def _as_json(c: Column) -> Column:
    """A number, a boolean or a list as JSON."""
    return F.regexp_extract(F.to_json(F.struct(c.alias("v")), {"ignoreNullFields": "false"}), r"^\{\"v\":(.*)\}$", 1)
