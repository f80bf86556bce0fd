"""What identifies a run: the settings that its samples depend on, and the choices that compared runs must share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The settings that determine a bank of samples.
SAMPLING = ("model_name", "model_revision", "adapter_path", "sampling_seed", "temperature", "top_p", "max_new_tokens")
#: The choices of an evaluation that compared banks share, besides its mode.
EVALUATION = ("temperature", "top_p", "max_new_tokens", "device", "effective_generation_config", "limit", "n_examples", "max_n")


def _of(config: Column, name: str) -> Column:
    """A setting of a VARIANT object as JSON text; null where it is missing or null."""
    return F.nullif(F.to_json(F.try_variant_get(config, f"$.{name}", "variant")), F.lit("null"))


def sampling_identity(config: Column) -> Column:
    """Struct of the settings, as JSON texts, that determine a bank: the mode is loop and the prompt field prompt unless
    said otherwise; the batch size counts in batched mode only."""
    mode = F.coalesce(_of(config, "hf_gen_mode"), F.lit('"loop"'))
    return F.struct(
        mode.alias("hf_gen_mode"), *(_of(config, c).alias(c) for c in SAMPLING), F.coalesce(_of(config, "prompt_field"), F.lit('"prompt"')).alias("prompt_field"), F.when(mode == '"batched"', _of(config, "batch_size")).alias("batch_size")
    )


def evaluation_signature(config: Column, resolved: Column, requested: Column, split: Column | None = None) -> Column:
    """Struct of an evaluation's choices, as JSON texts: each from the configuration, else as resolved, else as requested."""
    known = lambda *names: F.coalesce(*(_of(source, n) for source in (config, resolved, requested) for n in names))
    or_else = lambda c, value: F.coalesce(c, F.lit(value))
    mode = or_else(known("hf_gen_mode"), '"loop"')
    own = known("split") if split is None else F.coalesce(F.concat(F.lit('"'), split, F.lit('"')), known("split"))
    return F.struct(
        known("sampling_seed", "seed").alias("sampling_seed"), *(known(c).alias(c) for c in EVALUATION), or_else(known("prompt_field"), '"prompt"').alias("prompt_field"), or_else(known("engine"), '"hf"').alias("engine"),
        mode.alias("hf_gen_mode"), F.when(mode == '"batched"', known("batch_size")).alias("batch_size"), own.alias("split"),
    )


def normalised(config: Column, drop: tuple[str, ...] = ("seed", "sampling_seed")) -> Column:
    """A configuration (JSON object as text) with sorted names and without what differs between repeats, as text."""
    fields = F.from_json(config, "map<string,string>")
    kept = F.map_filter(fields, lambda k, _: ~k.isin(*drop))
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(kept))))


def drifted(runs: DataFrame, by: list[str], config: str) -> DataFrame:
    """(by, runs, versions): groups of runs and how many different normalised configurations they have."""
    return runs.groupBy(*by).agg(F.count(F.lit(1)).alias("runs"), F.count_distinct(normalised(F.col(config))).alias("versions"))


def chained(evaluations: DataFrame, trainings: DataFrame) -> DataFrame:
    """(evaluation, training, parent, state): evaluations (evaluation, adapter_digest), the training whose output their
    adapter is (training, output_digest, parent_digest), and the training that this one began with.

    State: whole, or which link is missing: training (unknown adapter) or parent (a parent that is named but unknown).
    """
    t = trainings.select("training", "output_digest", "parent_digest")
    parents = trainings.select(F.col("training").alias("parent"), F.col("output_digest").alias("_p"))
    joined = evaluations.join(t, F.col("adapter_digest") == F.col("output_digest"), "left").join(parents, F.col("parent_digest") == F.col("_p"), "left")
    state = F.when(F.col("training").isNull(), "training").when(F.col("parent_digest").isNotNull() & F.col("parent").isNull(), "parent").otherwise("whole")
    return joined.select("evaluation", "training", "parent", state.alias("state"))
