"""Texts cut off by limits on their length or in mid-transfer.

Ends are judged by an end-of-text model (``tails``). An open end inside a number, expression or tag, or in a text that
marks its sentences or opens a tag, is a cut. A plain run of words without any mark may be whole in a source that
writes no marks; two statistics of its source decide:

* the length histograms in characters, bytes and tokens: a spike at the maximum is a limit, and what has that length
  was cut;
* the end-of-text likelihood of its last four characters: how many different texts of the source end with them,
  against all their other occurrences in the source. A cut falls anywhere, so its last characters stand inside other
  words and texts too; only what ends many texts and stands nowhere else is a habit of ending.

One pass over the texts counts both; each task adds up lengths and four-character groups by source.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalmill.llm import tails
from evalmill.llm.batches import pieces

#: A spike holds at least so many texts, so many times the mean of the lengths below it and twice the most of them,
#: and nearly all texts are shorter.
LEAST, TIMES, BELOW, MOST_ABOVE = 8, 5.0, 16, 0.05
#: At a limit, at most this share of the texts ends as whole; counts that are merely frequent are no limit.
MOST_FINISHED = 0.5
#: An ending of this likelihood is a habit; so many occurrences elsewhere are assumed for each ending.
HABIT, ASSUMED = 0.5, 8
UNITS = ("chars", "bytes", "tokens")
#: Hash table of groups of four bytes for each source, and how many sources a task adds up before it sends them on.
BUCKETS, HELD = 1 << 16, 128
_MULTIPLIER, _SHIFT = 10368889, 20

_FOLD = np.arange(256, dtype=np.uint64)
_FOLD[65:91] += 32
_FOLD[48:58] = 48
_CAN_END = np.zeros(256, dtype=bool)
_CAN_END[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def _last_group(t: Column) -> Column:
    """The bucket of the last four bytes of a text, letters in lower case and digits alike; as ``_groups`` counts them."""
    upper = "".join(map(chr, range(65, 91)))
    code = F.conv(F.hex(F.substring(F.encode(F.translate(F.right(t, F.lit(4)), upper + "123456789", upper.lower() + "0" * 9), "UTF-8"), -4, 4)), 16, 10).cast("long")
    return F.shiftright(code * _MULTIPLIER, _SHIFT).bitwiseAND(F.lit(BUCKETS - 1)).cast("int")


def _groups(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of each four bytes of the texts whose last one is of a letter or digit."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    if len(data) < 4:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(texts)), np.diff(offsets))
    f = _FOLD[data]
    keep = (row[3:] == row[:-3]) & _CAN_END[f[3:]]
    code = (f[:-3] << np.uint64(24) | f[1:-2] << np.uint64(16) | f[2:-1] << np.uint64(8) | f[3:])[keep]
    return row[:-3][keep], ((code * np.uint64(_MULTIPLIER) >> np.uint64(_SHIFT)) & np.uint64(BUCKETS - 1)).astype(np.int64)


_COUNTS = "kind string, length long, ending long, texts long, content long, finished long"


def _count(kind: pa.DataType):
    """mapInArrow: counts of lengths by source and unit; of four-byte groups by source; the endings that may be habits."""

    def rows(source: pa.Array, name: str, length, ending=None, texts=None, content=None, finished=None) -> pa.RecordBatch:
        n = len(length)
        long = lambda x: pa.nulls(n, pa.int64()) if x is None else pa.array(x).cast(pa.int64()) if isinstance(x, np.ndarray) else x.cast(pa.int64())
        columns = [source.cast(kind), pa.repeat(name, n), *map(long, (length, ending, texts, content, finished))]
        return pa.RecordBatch.from_arrays(columns, ["source", "kind", "length", "ending", "texts", "content", "finished"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for source, counts in held.items():
                at = np.flatnonzero(counts)
                yield rows(pa.repeat(pa.scalar(source, kind), len(at)), "group", at, texts=counts[at])
            held.clear()

        for b in pieces(batches, "text"):
            t = pa.table({c: b.column(c) for c in ("source", *UNITS)} | {"one": np.ones(b.num_rows, np.int64)} | {c: b.column(c).cast(pa.int64()) for c in ("content", "finished")})
            for unit in UNITS:
                g = t.filter(pc.is_valid(t[unit])).group_by(["source", unit]).aggregate([("one", "sum"), ("content", "sum"), ("finished", "sum")]).combine_chunks()
                if g.num_rows:
                    column = lambda c: g[c].combine_chunks()  # noqa: B023, E731
                    yield rows(column("source"), unit, column(unit), None, column("one_sum"), column("content_sum"), column("finished_sum"))
            plain = pa.table({c: b.column(c) for c in ("source", "last", "ending")}).filter(pc.is_valid(b.column("ending"))).combine_chunks()
            if plain.num_rows:
                column = lambda c: plain[c].combine_chunks()  # noqa: B023, E731
                yield rows(column("source"), "group", column("last"), column("ending"), pa.array(np.ones(plain.num_rows, np.int64)))
            names = b.column("source").dictionary_encode(null_encoding="encode")
            row, bucket = _groups(b.column("text"))
            owner = names.indices.to_numpy()[row].astype(np.int64)
            for first in range(0, len(names.dictionary), 32):
                here = (owner >= first) & (owner < first + 32)
                n = min(32, len(names.dictionary) - first)
                counts = np.bincount((owner[here] - first) * BUCKETS + bucket[here], minlength=n * BUCKETS).reshape(n, BUCKETS)
                for source, c in zip(names.dictionary.slice(first, n).to_pylist(), counts, strict=True):
                    held[source] = held[source] + c if source in held else c.copy()
                if len(held) > HELD:
                    yield from flush()
        yield from flush()

    return run


def _texts(df: DataFrame, source: str, text: str, tokens: str | None, key: str | None = None) -> DataFrame:
    """(key, source, text, tokens, ended): the texts that are not null, also without what may follow their end."""
    count = (F.col(tokens) if tokens else F.lit(None)).cast("long").alias("tokens")
    named = [F.col(key).alias("key")] if key else []
    return df.where(F.col(text).isNotNull()).select(*named, F.col(source).alias("source"), F.col(text).alias("text"), count, tails.once(tails.bare(F.col(text))).alias("ended"))


def _by_source(df: DataFrame, source: str, text: str, tokens: str | None) -> DataFrame:
    """One row for each source: texts, its limits by unit (that with the most texts, null where it has none, and all), and its habits of ending."""
    t = F.col("text")
    ready = _texts(df, source, text, tokens).select(
        "source", "text", "tokens", "ended", tails.has_content(t, F.col("ended")).alias("content"), tails.once(tails.unfinished_bare(F.col("ended"))).alias("open")
    ).select(
        "source", "text", F.length(t).cast("long").alias("chars"), F.octet_length(t).cast("long").alias("bytes"), "tokens", "content", (F.col("content") & ~F.col("open")).alias("finished"),
        tails.once(F.when(F.col("content") & F.col("open") & ~tails.shows_ends(F.col("ended")), F.col("ended"))).alias("plain"),
    )
    ready = ready.select("source", "text", *UNITS, "content", "finished", _last_group(F.col("plain")).alias("last"), F.when(F.col("plain").isNotNull(), F.xxhash64("text")).alias("ending"))
    kind = df.schema[source].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    counts = ready.mapInArrow(_count(to_arrow_type(kind)), f"source {kind.simpleString()}, {_COUNTS}")
    sums = [F.sum(c).alias(c) for c in ("texts", "content", "finished")]
    # copies of a text count as one ending; counts of groups have no ending
    once = counts.groupBy("source", "kind", "length", "ending").agg(*sums).withColumn("ends", F.when(F.col("ending").isNotNull(), F.col("texts")))
    histogram = once.groupBy("source", "kind", "length").agg(F.coalesce(F.sum(F.when(F.col("ending").isNull(), F.col("texts"))), F.lit(0)).alias("texts"), *sums[1:], F.count("ends").alias("endings"), F.coalesce(F.sum("ends"), F.lit(0)).alias("end_rows"))
    elsewhere = F.greatest(F.col("texts") - F.col("end_rows"), F.lit(0))
    is_group, habit = F.col("kind") == "group", F.col("endings") >= HABIT * (F.col("endings") + elsewhere + ASSUMED)
    by = Window.partitionBy("source", "kind")
    near = by.orderBy("length").rangeBetween(-BELOW, -1)
    marked = (
        histogram.where(~is_group | habit).withColumn("below", F.coalesce(F.sum("texts").over(near), F.lit(0)) / BELOW)
        .withColumn("peak", F.coalesce(F.max("texts").over(near), F.lit(0)))
        .withColumn("above", F.try_divide(F.coalesce(F.sum("texts").over(by.orderBy("length").rangeBetween(1, Window.unboundedFollowing)), F.lit(0)), F.sum("texts").over(by)))
    )
    spike = ~is_group & (F.col("texts") >= LEAST) & (F.col("texts") >= TIMES * F.col("below")) & (F.col("texts") >= 2 * F.col("peak")) & (F.col("above") <= MOST_ABOVE) & (F.col("finished") <= MOST_FINISHED * F.col("content"))
    at = lambda u: spike & (F.col("kind") == u)
    return marked.groupBy("source").agg(
        F.sum(F.when(F.col("kind") == "chars", F.col("texts"))).alias("texts"),
        *(F.max(F.when(at(u), F.struct("texts", "length"))).getField("length").alias(f"{u}_limit") for u in UNITS),
        *(F.array_sort(F.collect_list(F.when(at(u), F.col("length")))).alias(f"{u}_limits") for u in UNITS),
        F.collect_list(F.when(is_group, F.col("length").cast("int"))).alias("habits"),
    )


def length_limits(df: DataFrame, source: str, text: str, tokens: str | None = None) -> DataFrame:
    """(source, unit, limit) of the spikes at the maximum, for the units chars, bytes and tokens.

    Null texts and null token counts are left out; a null source is a source of its own; an empty table gives no rows.
    """
    wide = _by_source(df, source, text, tokens)
    return wide.select("source", F.explode(F.array(*(F.struct(F.lit(u).alias("unit"), F.col(f"{u}_limits").alias("limits")) for u in UNITS))).alias("x")).select("source", "x.unit", F.explode("x.limits").alias("limit"))


def _judged(df: DataFrame, key: str, source: str, text: str, tokens: str | None, by_source: DataFrame) -> DataFrame:
    """(key, own, at_limit) of the texts that were cut."""
    t = F.col("text")
    rows = _texts(df, source, text, tokens, key).where(tails.unfinished_bare(F.col("ended"))).where(tails.has_content(t, F.col("ended")))
    open_ends = rows.select("key", F.col("source").alias("own"), F.length(t).alias("chars"), F.octet_length(t).alias("bytes"), "tokens", tails.shows_ends(F.col("ended")).alias("shown"), _last_group(F.col("ended")).alias("last"))
    joined = open_ends.join(by_source.alias("s"), F.col("own").eqNullSafe(F.col("s.source")), "left")
    at = F.lit(False)
    for unit in UNITS:
        at = at | F.coalesce(F.array_contains(f"{unit}_limits", F.col(unit)), F.lit(False))
    habit = F.coalesce(F.array_contains("habits", F.col("last")), F.lit(False))
    return joined.withColumn("at_limit", at).where(F.col("shown") | F.col("at_limit") | ~habit).select("key", "own", "at_limit")


def truncated(df: DataFrame, key: str, source: str, text: str, tokens: str | None = None) -> DataFrame:
    """(key, source, at_limit) of every text that was cut; at_limit tells spike lengths from cuts in mid-transfer.

    ``key``, ``source``, ``text`` and ``tokens`` name columns; others are not read. Defined cases: null, empty and
    blank texts, empty tags and placeholders are no case; neither are texts that end as whole, however long;
    repeated rows each count; a null source is a source of its own; an empty table gives no rows. A plain run of words
    that ends as its source is used to is a case at a limit only (see above). Only texts with an open end meet the
    tables of sources, so no whole source is gathered anywhere.
    """
    return _judged(df, key, source, text, tokens, _by_source(df, source, text, tokens)).select(F.col("key").alias(key), F.col("own").alias(source), "at_limit")


def truncation_report(df: DataFrame, key: str, source: str, text: str, tokens: str | None = None) -> DataFrame:
    """Per source with texts: texts, truncated ones, how many of them at a limit, their share, and the limits found (by unit the one with the most texts, and all of them)."""
    by_source = _by_source(df, source, text, tokens)
    cut = _judged(df, key, source, text, tokens, by_source).groupBy("own").agg(F.count(F.lit(1)).alias("truncated"), F.count_if("at_limit").alias("at_limit"))
    n = F.coalesce(F.col("truncated"), F.lit(0))
    return (
        by_source.alias("s").join(cut.alias("c"), F.col("s.source").eqNullSafe(F.col("c.own")), "left")
        .select(F.col("s.source").alias(source), "texts", n.alias("truncated"), F.coalesce("at_limit", F.lit(0)).alias("at_limit"), F.try_divide(n, F.col("texts")).alias("share"), *(f"{u}_limit" for u in UNITS), *(f"{u}_limits" for u in UNITS))
    )
