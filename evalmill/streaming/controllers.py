"""The weight controller and batch statistics over streams.

Batches of a run may arrive out of order: the state keeps those that came early and folds them once their turn comes,
so the records are those of the replay over the same batches.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import asdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from evalmill.operators.control import WEIGHT_RECORD, WeightController, WeightSettings


def stream_weights(batches: DataFrame, run: str, settings: WeightSettings | None = None, first: int = 0) -> DataFrame:
    """Records of the controller for a stream of (run, batch, primary, aux) whose batches are numbered from ``first``.

    A batch that comes again is ignored; one that never comes holds back those after it.
    """
    chosen = asdict(settings or WeightSettings())

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else {"next": first, "early": {}, "controller": None}
        for part in parts:
            for b, p, a in zip(part["batch"], part["primary"], part["aux"], strict=True):
                if b >= held["next"]:
                    held["early"].setdefault(str(b), [float(p), dict(a)])
        c, rows = WeightController(WeightSettings(**chosen), held["controller"]), []
        while (got := held["early"].pop(str(held["next"]), None)) is not None:
            rows.append({run: key[0], "batch": held["next"], **c.update(*got)})
            held["next"] += 1
        state.update((json.dumps(held | {"controller": c.state}),))
        if rows:
            yield pd.DataFrame(rows)

    kind = batches.schema[run].dataType.simpleString()
    return batches.groupBy(run).applyInPandasWithState(fold, f"{run} {kind}, batch long, {WEIGHT_RECORD}", "held string", "append", GroupStateTimeout.NoTimeout)


def stream_bank_rates(rows: DataFrame, late: str = "1 hour", window: str = "30 minutes") -> DataFrame:
    """Exact and legal rows for each bank and window of logged_at; rows later than the watermark are left out."""
    from evalmill.functions import measures as M

    return rows.withWatermark("logged_at", late).groupBy(F.window("logged_at", window), "bank").agg(F.count(F.lit(1)).alias("rows"), F.count_if(M.is_exact()).alias("exact"), F.count_if(M.is_legal()).alias("legal"))


def append_log(stream: DataFrame, path: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] | None = None):
    """Starts a query that appends each micro-batch to a folder of JSON lines, once, by its batch number."""

    def write(batch: DataFrame, number: int) -> None:
        (transform(batch) if transform else batch).write.mode("overwrite").json(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def reward_steps(stream: DataFrame, path: str, checkpoint: str, settings: WeightSettings | None = None, completion: str = "completion", scorer: Callable | None = None):
    """Starts a query whose every micro-batch is one step of the reward loop: rows are scored with the weights so far,
    their means move the controller, and rows and record are logged. Batches that arrive empty move nothing.

    Under ``path``: rewards/batch=N (scored rows), steps/batch=N (the record, and the controller's state after it). A batch
    that runs again after a failure begins with the state before it and overwrites its own folders, so it counts once.
    """
    from evalmill.functions import scoring
    from evalmill.sources import files

    s = settings or WeightSettings()

    def before(spark, number: int) -> dict | None:
        for earlier in range(number - 1, -1, -1):
            if files.published(spark, f"{path}/steps/batch={earlier}"):
                return json.loads(spark.read.schema("state string").json(f"{path}/steps/batch={earlier}").first().state)
        return None

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        controller = WeightController(s, before(spark, number))
        used = dict(controller.state["weights"])
        rows = scoring.scored(batch, completion, scorer or scoring.arithmetic, used)
        rows.write.mode("overwrite").json(f"{path}/rewards/batch={number}")
        logged = spark.read.schema(rows.schema).json(f"{path}/rewards/batch={number}")  # what was scored once is not scored again
        known = [k for k in s.keys if k in rows.schema["components"].dataType.names]
        mean = lambda c: F.avg(F.coalesce(F.col(f"components.{c}"), F.lit(0.0))).alias(c)
        m = logged.agg(F.count(F.lit(1)).alias("rows"), F.avg("reward").alias("reward"), F.coalesce(F.stddev_pop("reward"), F.lit(0.0)).alias("spread"), mean("correct"), *(mean(k) for k in known if k != "correct")).first()
        record = controller.update(m["correct"], {k: m[k] for k in known}) if m["rows"] else {}
        line = {"batch": number, "rows": m["rows"], "reward": m["reward"], "spread": m["spread"], "used": used, "record": json.dumps(record), "state": json.dumps(controller.state)}
        kinds = "batch long, rows long, reward double, spread double, used map<string,double>, record string, state string"
        spark.createDataFrame([tuple(line.values())], kinds).coalesce(1).write.mode("overwrite").json(f"{path}/steps/batch={number}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
