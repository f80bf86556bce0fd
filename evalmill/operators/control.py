"""Controllers of reward weights and task tiers, replayed over ordered batches.

Rows are reduced to batch means by Spark first; only one small row for each batch enters the sequential fold of a run.
"""

from __future__ import annotations

import json
import math
import random
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalmill.functions import measures as M

#: Least weights of the stable controller, its largest ones, and the wider envelope of its variant.
FLOORS = {"format": 0.03, "valid_expression": 0.16, "number_multiset_f1": 0.18, "allowed_ops": 0.12, "numeric_distance_reward": 0.0, "brevity": 0.02}
CAPS = {"numeric_distance_reward": 0.20}
WIDE_FLOORS = FLOORS | {"valid_expression": 0.30}
WIDE_CAPS = CAPS | {"valid_expression": 0.45}
#: In the phases A and B of the phased controller, the cap of the distance weight and raised floors.
PHASES = {"A": (0.16, {"valid_expression": 0.22, "number_multiset_f1": 0.28, "allowed_ops": 0.12}), "B": (0.25, {"valid_expression": 0.18, "number_multiset_f1": 0.20})}
STRATEGIES = ("adaptive", "adaptive_stable", "adaptive_stable_v12", "adaptive_phased", "static", "manual", "random")


@dataclass
class WeightSettings:
    strategy: str = "adaptive"
    keys: tuple[str, ...] = M.AUXILIARY
    least: float = 0.02
    most: float = 0.35
    start: float = 0.20
    starts: dict[str, float] = field(default_factory=dict)
    beta: float = 0.90
    rate: float = 0.30
    success_decay: float = 0.75
    warmup: int = 100
    delay: int = 50
    stable_rate: float = 0.10
    smoothing: float = 0.10
    budget: float = 1.20
    enter: tuple[float, float] = (0.80, 0.35)
    leave: tuple[float, float] = (0.75, 0.30)
    dwell: int = 5
    seed: int = 0

    def __post_init__(self):
        if self.strategy not in STRATEGIES:
            raise ValueError(f"unknown strategy {self.strategy!r}")
        if odd := set(self.starts) - set(self.keys):
            raise ValueError(f"start weights for unknown keys: {sorted(odd)}")


def project(weights: dict[str, float], floors: dict[str, float], caps: dict[str, float], budget: float) -> dict[str, float]:
    """Weights moved into their bounds and to the sum ``budget`` (as near as the bounds let it).

    What is missing or too much is shared in proportion to the room that each weight has, repeatedly.
    """
    w = {k: min(caps[k], max(floors[k], v)) for k, v in weights.items()}
    goal = max(sum(floors.values()), min(budget, sum(caps.values())))
    for _ in range(32):
        gap = goal - sum(w.values())
        if abs(gap) <= 1e-9:
            break
        room = {k: (caps[k] - v if gap > 0 else v - floors[k]) for k, v in w.items()}
        room = {k: r for k, r in room.items() if r > 1e-12}
        total = sum(room.values())
        if total <= 1e-12:
            break
        for k, r in room.items():
            w[k] = min(caps[k], max(floors[k], w[k] + gap * r / total))
    return w


class WeightController:
    """Moving averages of batch means, and the weights that follow from them; its state is plain data."""

    def __init__(self, settings: WeightSettings, state: dict | None = None):
        self.s = settings
        begin = {k: settings.starts.get(k, settings.start) for k in settings.keys}
        self.begin = begin
        self.state = state or {"step": 0, "primary": 0.0, "aux": dict.fromkeys(settings.keys, 0.0), "weights": dict(begin), "phase": "A", "streak": 0, "flips": 0, "drawn": 0}

    def _targets(self, rate: float) -> dict[str, float]:
        """Weights drawn to what each behaviour still needs, less as primary success grows."""
        s, st = self.s, self.state
        decay = max(0.0, 1 - s.success_decay * min(1.0, max(0.0, st["primary"])))
        out = {}
        for k, old in st["weights"].items():
            need = 1 - min(1.0, max(0.0, st["aux"][k]))
            goal = min(s.most, max(s.least, s.least + (s.most - s.least) * need * decay))
            out[k] = (1 - rate) * old + rate * goal
        return out

    def _bounds(self) -> tuple[dict[str, float], dict[str, float]]:
        wide = self.s.strategy == "adaptive_stable_v12"
        floors, caps = dict(WIDE_FLOORS if wide else FLOORS), dict(WIDE_CAPS if wide else CAPS)
        if self.s.strategy == "adaptive_phased":
            cap, raised = PHASES[self.state["phase"]]
            caps["numeric_distance_reward"] = cap
            floors |= {k: max(floors.get(k, 0.0), v) for k, v in raised.items()}
        low = {k: max(self.s.least, floors.get(k, self.s.least)) for k in self.s.keys}
        return low, {k: max(low[k], caps.get(k, self.s.most)) for k in self.s.keys}

    def _phase(self) -> None:
        """Phase A until f1 and legality stay above the entry levels, B until one stays below its exit level."""
        st, s = self.state, self.s
        now = (st["aux"].get("number_multiset_f1", 0.0), st["aux"].get("valid_expression", 0.0))
        wants = all(x >= y for x, y in zip(now, s.enter, strict=True)) if st["phase"] == "A" else any(x < y for x, y in zip(now, s.leave, strict=True))
        st["streak"] = st["streak"] + 1 if wants else 0
        if st["streak"] >= max(1, s.dwell):
            st |= {"phase": "B" if st["phase"] == "A" else "A", "streak": 0, "flips": st["flips"] + 1}

    def update(self, primary: float, aux: dict[str, float]) -> dict:
        """One batch; returns its record. The weights used for the batch are those before it."""
        s, st = self.s, self.state
        before = dict(st["weights"])
        st["primary"] = s.beta * st["primary"] + (1 - s.beta) * primary
        st["aux"] = {k: s.beta * st["aux"][k] + (1 - s.beta) * aux.get(k, 0.0) for k in s.keys}
        waiting = s.strategy.startswith(("adaptive_stable", "adaptive_phased")) and st["step"] < s.delay
        if s.strategy == "adaptive":
            st["weights"] = self._targets(s.rate)
        elif s.strategy == "manual":
            done = min(1.0, st["step"] / max(1, s.warmup))
            st["weights"] = dict.fromkeys(s.keys, s.most * (1 - done) + s.least * done)
        elif s.strategy == "random":
            rng = random.Random(f"{s.seed}:{st['drawn']}")
            st["weights"] = {k: rng.uniform(s.least, s.most) for k in s.keys}
            st["drawn"] += 1
        elif s.strategy == "static" or waiting:
            st["weights"] = dict(self.begin)
        else:
            if s.strategy == "adaptive_phased":
                self._phase()
            a = min(1.0, max(0.0, s.smoothing))
            goal = self._targets(s.stable_rate)
            st["weights"] = project({k: (1 - a) * before[k] + a * goal[k] for k in s.keys}, *self._bounds(), s.budget)
        st["step"] += 1
        change = [abs(st["weights"][k] - before[k]) for k in s.keys]
        low, high = self._bounds()
        return {"step": st["step"], "ema_primary": st["primary"], "ema_aux": dict(st["aux"]), "weights": dict(st["weights"]), "weight_sum": sum(st["weights"].values()), "waiting": waiting, "phase": st["phase"], "flips": st["flips"], "l1": sum(change), "linf": max(change), "at_floor": [k for k in s.keys if st["weights"][k] <= low[k] + 1e-8], "at_cap": [k for k in s.keys if st["weights"][k] >= high[k] - 1e-8]}


WEIGHT_RECORD = "step long, ema_primary double, ema_aux map<string,double>, weights map<string,double>, weight_sum double, waiting boolean, phase string, flips long, l1 double, linf double, at_floor array<string>, at_cap array<string>"


def batch_means(df: DataFrame, run: list[str], batch: Column, keys: tuple[str, ...] = M.AUXILIARY) -> DataFrame:
    """(run, batch, rows, primary, aux): means of each batch, with partial aggregation."""
    g = df.select(*run, batch.alias("batch"), M.primary_reward().alias("primary"), *(M.metric(k).alias(k) for k in keys)).groupBy(*run, "batch")
    return g.agg(F.count(F.lit(1)).alias("rows"), F.avg("primary").alias("primary"), F.create_map(*(x for k in keys for x in (F.lit(k), F.avg(k)))).alias("aux"))


def replay_weights(batches: DataFrame, run: str, settings: WeightSettings | None = None) -> DataFrame:
    """The controller's record of every batch of every run, in batch order."""
    chosen = asdict(settings or WeightSettings())

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        c = WeightController(WeightSettings(**chosen))
        group = group.sort_values("batch")
        rows = [{run: r, "batch": b, **c.update(p, dict(a))} for r, b, p, a in zip(group[run], group["batch"], group["primary"], group["aux"], strict=True)]
        return pd.DataFrame(rows)

    kind = batches.schema[run].dataType.simpleString()
    return batches.groupBy(run).applyInPandas(fold, f"{run} {kind}, batch long, {WEIGHT_RECORD}")


def ema(batches: DataFrame, run: str, order: str, value: str, beta: float = 0.9) -> DataFrame:
    """(run, steps, ema): the moving average of a run from 0, as the weighted sum that it is; a run is sorted, not collected."""
    age = F.row_number().over(Window.partitionBy(run).orderBy(F.col(order).desc())) - 1
    aged = batches.select(run, F.col(value).alias("_v"), age.alias("_age"))
    return aged.groupBy(run).agg(F.count(F.lit(1)).cast("int").alias("steps"), F.sum(F.col("_v") * (1 - beta) * F.pow(F.lit(float(beta)), F.col("_age"))).alias("ema"))


@dataclass
class TierSettings:
    mode: str = "uniform"
    tiers: tuple[str, ...] = ("easy", "medium", "hard")
    beta: float = 0.90
    mix: float = 0.20
    least: float = 0.10
    delay: int = 25
    gate: float = 0.50
    legality: tuple[float, float] = (0.50, 0.25)
    exactness: tuple[float, float] = (0.175, 0.15)


#: From which update on the manual schedule draws easy, medium and hard tasks with which shares.
SCHEDULE = ((0, (0.60, 0.30, 0.10)), (100, (0.34, 0.33, 0.33)), (200, (0.10, 0.30, 0.60)))


def observe(seen: dict[str, tuple[float, float]], batch: dict[str, tuple[int, float, float]], s: TierSettings) -> None:
    """Moves each tier's averages of legality and exactness by a batch of (rows, legality, exactness); more rows, more weight."""
    for tier, (rows, legal, exact) in batch.items():
        if tier in s.tiers and rows:
            keep = s.beta**rows
            old = seen.get(tier)
            seen[tier] = (legal, exact) if old is None else (keep * old[0] + (1 - keep) * legal, keep * old[1] + (1 - keep) * exact)


def tier_shares(seen: dict[str, tuple[float, float]], updates: int, s: TierSettings) -> dict[str, float]:
    """The share of draws of each tier: near its target competence a tier is drawn most; unseen tiers count as that near."""
    n = len(s.tiers)
    if s.mode == "manual":
        return dict(zip(s.tiers, [shares for start, shares in SCHEDULE if updates >= start][-1], strict=True))
    if s.mode == "uniform" or updates < s.delay:
        return dict.fromkeys(s.tiers, 1 / n)

    def near(tier: str) -> float:
        if tier not in seen:
            return 1.0
        legal, exact = seen[tier]
        value, (goal, width) = (legal, s.legality) if legal < s.gate else (exact, s.exactness)
        return math.exp(-((value - goal) ** 2) / (2 * width**2))

    scores = {t: near(t) for t in s.tiers}
    total = sum(scores.values())
    return {t: s.least + (1 - n * s.least) * ((1 - s.mix) * v / total + s.mix / n) for t, v in scores.items()}


def tier_batches(df: DataFrame, run: list[str], batch: Column) -> DataFrame:
    """(run, batch, tiers): rows, legality and exactness of each tier of each batch."""
    per = df.select(*run, batch.alias("batch"), "difficulty", M.metric("valid_expression").alias("v"), M.metric("correct").alias("c")).where("difficulty is not null").groupBy(*run, "batch", "difficulty").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("v"), F.avg("c").alias("c"))
    return per.groupBy(*run, "batch").agg(F.map_from_entries(F.collect_list(F.struct("difficulty", F.struct("n", "v", "c")))).alias("tiers"))


def replay_tiers(batches: DataFrame, run: str, settings: TierSettings | None = None) -> DataFrame:
    """Averages and shares of each tier after every batch of every run."""
    s = settings or TierSettings(mode="adaptive")

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        seen, rows = {}, []
        for k, (r, b, tiers) in enumerate(group.sort_values("batch")[[run, "batch", "tiers"]].itertuples(index=False), 1):
            observe(seen, {t: (x["n"], x["v"], x["c"]) for t, x in dict(tiers).items()}, s)
            rows.append({run: r, "batch": b, "updates": k, "legality": {t: v for t, (v, _) in seen.items()}, "exactness": {t: c for t, (_, c) in seen.items()}, "shares": tier_shares(seen, k, s)})
        return pd.DataFrame(rows)

    kind = batches.schema[run].dataType.simpleString()
    return batches.groupBy(run).applyInPandas(fold, f"{run} {kind}, batch long, updates long, legality map<string,double>, exactness map<string,double>, shares map<string,double>")


def candidate_weights(random_count: int = 200, seed: int = 0, keys: tuple[str, ...] = M.AUXILIARY) -> np.ndarray:
    """Weight vectors to search: uniform, none, each key alone, and random shares of the budget 1.2."""
    n = len(keys)
    rng = random.Random(seed)
    drawn = [[rng.random() for _ in range(n)] for _ in range(random_count)]
    return np.array([[0.2] * n, [0.0] * n, *np.eye(n).tolist(), *([1.2 * x / (sum(v) or 1.0) for x in v] for v in drawn)])


def _grouped_rewards(df: DataFrame, run: list[str], batch: Column, order: list[str], size: int, keys: tuple[str, ...]) -> DataFrame:
    from evalmill.operators.diagnosis import positional_groups

    rows = df.select(*run, batch.alias("batch"), *[c for c in order if c not in run], F.col("id").alias("_id"), F.array(M.metric("correct"), *(M.metric(k) for k in keys)).alias("x"))
    g = positional_groups(rows, [*run, "batch"], order, size).groupBy(*run, "batch", "grp")
    return g.agg(F.array_sort(F.collect_list(F.struct(*order, "x"))).alias("r"), F.count_distinct("_id").alias("ids"))  # size rows at most


def group_faults(df: DataFrame, run: list[str], batch: Column, order: list[str], size: int = 4) -> DataFrame:
    """(run, groups, uneven, mixed): groups of consecutive rows, those that are not full, and those of several ids."""
    g = _grouped_rewards(df, run, batch, order, size, ())
    return g.groupBy(*run).agg(F.count(F.lit(1)).alias("groups"), F.count_if(F.size("r") < size).alias("uneven"), F.count_if(F.col("ids") > 1).alias("mixed"))


def reward_groups(df: DataFrame, run: list[str], batch: Column, order: list[str], size: int = 4, keys: tuple[str, ...] = M.AUXILIARY) -> DataFrame:
    """(run, batch, grp, rows): groups of ``size`` consecutive rows of a batch, each row [correct, components].

    A batch that does not divide into full groups, and a group of several ids, raise; see ``group_faults``.
    """
    g = _grouped_rewards(df, run, batch, order, size, keys)
    whole = (F.size("r") == size) & (F.col("ids") <= 1)
    rows = F.when(whole, F.transform("r", lambda r: r.x)).otherwise(F.raise_error(F.concat_ws(" ", F.lit("a group is not full or has several ids:"), *(F.col(c).cast("string") for c in (*run, "batch", "grp")))))
    return g.select(*run, "batch", "grp", rows.alias("rows"))


CEILING = "has_correct boolean, dead boolean, on_top boolean, top_flips boolean, positive_changes boolean, rescuable boolean, demotable boolean, revivable boolean"


def ceiling_flags(x: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Flags as in ``CEILING`` of groups x[group, row, 1 + key] under all weight vectors, the first of which is uniform."""
    rewards = x[:, :, :1] + x[:, :, 1:] @ vectors.T
    top = rewards.argmax(axis=1)
    positive = rewards > rewards.mean(axis=1, keepdims=True) + 1e-12
    alive = rewards.std(axis=1) > 1e-9
    correct = x[:, :, 0] >= 0.5
    hit = np.take_along_axis(correct, top, axis=1)
    has, on = correct.any(axis=1), hit[:, 0]
    return np.stack([has, ~alive[:, 0], on, (top != top[:, :1]).any(axis=1), (positive != positive[:, :, :1]).any(axis=(1, 2)), has & ~on & hit.any(axis=1), on & (~hit).any(axis=1), ~alive[:, 0] & alive.any(axis=1)], axis=1)


def ceilings(groups: DataFrame, keep: list[str], vectors: np.ndarray | None = None) -> DataFrame:
    """What any of the weight vectors could change in each group's ranking against uniform weights."""
    v = candidate_weights() if vectors is None else vectors
    names = [x.split()[0] for x in CEILING.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                flags = ceiling_flags(np.array([[list(r) for r in g] for g in b["rows"]], dtype=float), v)
                yield pd.concat([b[keep].reset_index(drop=True), pd.DataFrame(flags, columns=names)], axis=1)

    kinds = ", ".join(f"{c} {groups.schema[c].dataType.simpleString()}" for c in keep)
    return groups.mapInPandas(run, f"{kinds}, {CEILING}")


def ceiling_report(flags: DataFrame, by: list[str] | None = None) -> DataFrame:
    share = lambda a, b: F.coalesce(F.try_divide(F.count_if(a), F.count_if(b)), F.lit(0.0))
    c, every = F.col, F.lit(True)
    return flags.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("groups"), F.count_if(c("has_correct")).alias("with_correct"), F.count_if(c("dead")).alias("dead"), share(c("top_flips"), every).alias("top_flips"), share(c("positive_changes"), every).alias("positive_changes"), share(c("revivable"), every).alias("revivable"),
        share(c("on_top"), c("has_correct")).alias("on_top"), share(c("rescuable"), c("has_correct") & ~c("on_top")).alias("rescuable"), share(c("demotable"), c("on_top")).alias("demotable"),
    )


class Bandit:
    """EXP3 over the keys and an arm that does nothing; the drawn arm raises its weight and the budget is kept."""

    def __init__(self, keys: int, gamma: float = 0.1, step: float = 0.05, seed: int = 0, signal: bool = True):
        self.n, self.gamma, self.step = keys + 1, gamma, step
        self.signal = signal  # without it no arm ever gains, which shows how far chance alone goes
        self.arms, self.weights, self.rng = np.ones(keys + 1), np.full(keys, 0.2), random.Random(seed)

    def round(self, x: np.ndarray) -> None:
        p = (1 - self.gamma) * self.arms / self.arms.sum() + self.gamma / self.n
        arm = self.rng.choices(range(self.n), weights=p.tolist())[0]
        new = self.weights.copy()
        if arm < self.n - 1:
            new[arm] = min(0.35, new[arm] + self.step)
            new *= 0.2 * len(new) / new.sum()
        gain = 0.0
        if len(x) and self.signal:
            r = x[:, :, :1] + x[:, :, 1:] @ np.stack([self.weights, new], axis=1)
            positive = r > r.mean(axis=1, keepdims=True) + 1e-12
            gain = float((positive[:, :, 0] != positive[:, :, 1]).any(axis=1).mean())
        self.arms[arm] *= math.exp(self.gamma * gain / p[arm] / self.n)
        self.arms *= self.n / self.arms.sum()
        self.weights = new


def replay_bandit(groups: DataFrame, run: str, block: int = 10, seed: int = 0, keys: int = len(M.AUXILIARY), signal: bool = True) -> DataFrame:
    """(run, rounds, final_l1, max_l1, weights): the bandit over each run's groups, ``block`` batches a round.

    ``signal=False`` is the control in which no arm gains anything.

    Groups of a run come to one task as a sorted stream; only those of the current round are in memory.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = None

        def finish() -> pd.DataFrame:
            close()
            return pd.DataFrame([{run: state["run"], "rounds": state["rounds"], "final_l1": float(np.abs(state["bandit"].weights - 0.2).sum()), "max_l1": state["most"], "weights": state["bandit"].weights.tolist()}])

        def close() -> None:
            if state["rows"]:
                before = state["bandit"].weights
                state["bandit"].round(np.array(state["rows"], dtype=float))
                state["most"], state["rounds"], state["rows"] = max(state["most"], float(np.abs(state["bandit"].weights - before).sum())), state["rounds"] + 1, []

        for part in batches:
            for r, b, rows in zip(part[run].tolist(), part["batch"].tolist(), part["rows"], strict=True):
                if state is None or state["run"] != r:
                    if state is not None:
                        yield finish()
                    state = {"run": r, "bandit": Bandit(keys, seed=seed, signal=signal), "batch": b, "seen": 0, "rows": [], "rounds": 0, "most": 0.0}
                if b != state["batch"]:
                    state["batch"], state["seen"] = b, state["seen"] + 1
                    if state["seen"] % block == 0:
                        close()
                state["rows"].append([list(x) for x in rows])
        if state is not None:
            yield finish()

    kind = groups.schema[run].dataType.simpleString()
    return groups.repartition(run).sortWithinPartitions(run, "batch", "grp").mapInPandas(fold, f"{run} {kind}, rounds long, final_l1 double, max_l1 double, weights array<double>")


def simulate(spark: SparkSession, grid: list[WeightSettings], steps: int = 200, gain: float = 0.02, hack: str = "format", seed: int = 0) -> DataFrame:
    """(setting, strategy, step, primary, behaviours, weights): closed loops of controllers and what they reward.

    In each step a behaviour moves to 1 by ``gain`` times its weight, and back to 0 by a tenth of ``gain``; the primary
    success follows the product of the behaviours other than ``hack``, which costs nothing to show and brings nothing.
    A little noise, drawn by setting and step, is added. One setting is one row of work, spread over the cluster.
    """
    rows = [(i, json.dumps(asdict(s))) for i, s in enumerate(grid)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for number, text in zip(b["setting"], b["settings"], strict=True):
                given = json.loads(text)
                chosen = WeightSettings(**{k: tuple(v) if isinstance(v, list) else v for k, v in given.items()})
                controller, rng = WeightController(chosen), random.Random(f"{seed}:{number}")
                shown, out = dict.fromkeys(chosen.keys, 0.1), []
                for step in range(steps):
                    weights = dict(controller.state["weights"])
                    shown = {k: min(1.0, max(0.0, v + gain * (weights[k] * (1 - v) - 0.1 * v) + rng.gauss(0, 0.002))) for k, v in shown.items()}
                    primary = math.prod(v for k, v in shown.items() if k != hack)
                    controller.update(primary, shown)
                    out.append((number, chosen.strategy, step, primary, dict(shown), weights))
                yield pd.DataFrame(out, columns=["setting", "strategy", "step", "primary", "behaviours", "weights"])

    return spark.createDataFrame(rows, "setting long, settings string").repartition(max(1, len(rows))).mapInPandas(run, "setting long, strategy string, step long, primary double, behaviours map<string,double>, weights map<string,double>")


def dump(state: dict) -> str:
    return json.dumps(state, sort_keys=True)
