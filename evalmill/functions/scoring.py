"""Scorers that can be exchanged: how a completion becomes components and a reward."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalmill.functions import code, measures, verifier

#: A scorer takes the completion and gives a struct of components, of which ``correct`` is the primary one.
Scorer = Callable[[Column], Column]


def arithmetic(completion: Column) -> Column:
    """Components of an arithmetic answer; the task is in numbers, target and allowed_ops."""
    return verifier.components(completion, verifier.verify_completion(completion, F.col("numbers"), F.col("target"), F.col("allowed_ops")))


def programs(execute: bool = False) -> Scorer:
    """Components of a code answer; the task is in fn_name, visible_tests and held_out_tests."""
    return lambda completion: code.code_components(completion, code.verify_code(completion, F.col("fn_name"), F.col("visible_tests"), F.col("held_out_tests"), execute))


def scored(df: DataFrame, completion: str = "completion", scorer: Scorer = arithmetic, weights: dict[str, float] | None = None, primary_weight: float = 1.0) -> DataFrame:
    """Adds ``components`` and ``reward``: the weighted primary component plus the weighted others; unknown ones count as 0."""
    with_components = df.withColumn("components", scorer(F.col(completion)))
    known = with_components.schema["components"].dataType.names
    total = F.coalesce(F.col("components.correct"), F.lit(0.0)) * primary_weight
    for name, w in (dict.fromkeys(measures.AUXILIARY, 0.2) if weights is None else weights).items():
        if name in known:
            total = total + F.coalesce(F.nanvl(F.col(f"components.{name}"), F.lit(0.0)), F.lit(0.0)) * w
    return with_components.withColumn("reward", total)


@F.pandas_udf(T.DoubleType())
def flip_p(effects: pd.Series) -> float:
    """A grouped aggregate: the exact sign-flip p of at most 20 effects that are not 0; null for more, 1 for none."""
    e = effects.dropna().to_numpy(dtype=float)
    e = e[np.abs(e) > 1e-15]
    if len(e) > 20:
        return float("nan")
    sums = np.zeros(1)
    for x in e:
        sums = np.concatenate([sums + x, sums - x])
    return float(np.mean(np.abs(sums) >= abs(e.sum()) - 1e-12)) if len(e) else 1.0
