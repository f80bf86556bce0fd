"""Identities of tasks and rows: order-insensitive keys, canonical JSON and digests."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def semantic_key(numbers: str = "numbers", target: str = "target", ops: str = "allowed_ops") -> Column:
    """Compact JSON of sorted distinct operators, sorted numbers and the target; null if one is null."""
    return F.when(
        F.col(numbers).isNotNull() & F.col(target).isNotNull() & F.col(ops).isNotNull(),
        F.to_json(F.struct(F.array_sort(F.array_distinct(ops)).alias("allowed_ops"), F.array_sort(numbers).alias("numbers"), F.col(target).alias("target"))),
    )


def loose_key(numbers: str = "numbers", target: str = "target") -> Column:
    """Like the semantic key, whatever the operators."""
    return F.when(F.col(numbers).isNotNull() & F.col(target).isNotNull(), F.to_json(F.struct(F.array_sort(numbers).alias("numbers"), F.col(target).alias("target"))))


def strict_semantic_key(numbers: Column, target: Column, ops: Column) -> Column:
    """The key of VARIANT values; null unless numbers and target are integers (no booleans, no fractions) and operators texts."""
    whole = lambda v: F.schema_of_variant(v) == "BIGINT"
    n, o = F.try_variant_get(numbers, "$", "array<variant>"), F.try_variant_get(ops, "$", "array<variant>")
    fits = F.forall(n, whole) & whole(target) & F.forall(o, lambda v: F.schema_of_variant(v) == "STRING")
    cast = lambda a, kind: F.transform(a, lambda v: F.try_variant_get(v, "$", kind))
    return F.when(F.coalesce(fits, F.lit(False)), F.to_json(F.struct(F.array_sort(F.array_distinct(cast(o, "string"))).alias("allowed_ops"), F.array_sort(cast(n, "bigint")).alias("numbers"), F.try_variant_get(target, "$", "bigint").alias("target"))))


def ids_by_key(df: DataFrame, key: Column, row_id: str = "id") -> DataFrame:
    """(key, ids): the sorted distinct ids of each key; keys are tasks, whose ids are few."""
    return df.select(key.alias("key"), row_id).where("key is not null").groupBy("key").agg(F.array_sort(F.collect_set(row_id)).alias("ids"))


def ordered_key(numbers: str = "numbers", target: str = "target", ops: str = "allowed_ops") -> Column:
    """The older key, which keeps the order of the operators."""
    return F.to_json(F.struct(F.col(ops).alias("allowed_ops"), F.array_sort(numbers).alias("numbers"), F.col(target).alias("target")))


def canonical_json(columns: list[str]) -> Column:
    """Compact JSON with sorted names, nulls kept."""
    return F.to_json(F.struct(*(F.col(c) for c in sorted(columns))), {"ignoreNullFields": "false"})


def row_digest(columns: list[str]) -> Column:
    return F.sha2(canonical_json(columns), 256)


def set_digest(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """One digest for each group (or the whole table): of its sorted values, each with a line end, and how many there are.

    A digest runs over its values in order, so a group goes through one task; there it is a sorted stream that spills,
    of which only the state of the digest is in memory. Null values are left out; a group of nothing else has no row.
    """
    by = by or []
    values = df.select(*by, F.col(value).cast("string").alias("_v")).where("_v is not null")
    placed = values.repartition(*by) if by else values.repartition(1)
    stream = placed.sortWithinPartitions(*by, F.encode("_v", "UTF-8"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, state, members = None, None, 0
        kinds = None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(pa.array([x], k) for x, k in zip(group, kinds, strict=True)), pa.array([state.hexdigest()]), pa.array([members], pa.int64())], [*by, "digest", "members"])

        for b in batches:
            kinds = [b.column(c).type for c in by]
            for *key, v in zip(*(b.column(c).to_pylist() for c in [*by, "_v"]), strict=True):
                if key != group:
                    if state is not None:
                        yield row()
                    group, state, members = key, hashlib.sha256(), 0
                state.update(v.encode("utf-8", "surrogatepass") + b"\n")
                members += 1
        if state is not None:
            yield row()

    kinds = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in by)
    return stream.mapInArrow(run, f"{kinds}digest string, members long")


def stable_order(seed: int, domain: str, key: Column) -> Column:
    """A hash that orders keys the same way everywhere: SHA-256 of seed, domain and key, with NUL between."""
    return F.sha2(F.concat(F.lit(str(seed)), F.lit("\x00"), F.lit(domain), F.lit("\x00"), key.cast("string")), 256)
