"""The engine's functions by name for SQL: scalar functions and a table function that proposes tasks."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from evalmill.functions import verifier
from evalmill.functions.code import code_is_legal
from evalmill.functions.scoring import flip_p
from evalmill.operators.generate import SCHEMA, TIERS, propose


@udtf(returnType=SCHEMA)
class ProposeTasks:
    """propose_tasks(tier, seed, first, count): the proposals of a tier from an index on."""

    def eval(self, tier: str, seed: int, first: int, count: int) -> Iterator[tuple]:
        for i in range(first, first + count):
            numbers, target, solution = propose(tier, seed, i)
            yield tier, seed, i, numbers, target, list(TIERS[tier][1]), solution


def register(spark: SparkSession) -> None:
    """Makes verify_expression, code_is_legal, the aggregate flip_p and propose_tasks known to the session."""
    spark.udf.register("verify_expression", verifier._judge)
    spark.udf.register("code_is_legal", code_is_legal)
    spark.udf.register("flip_p", flip_p)
    spark.udtf.register("propose_tasks", ProposeTasks)
