"""Prompt and response pairs whose response is unusable, with the type of the defect.

One pass over the responses in Arrow batches gives each its language posteriors (character n-gram naive Bayes) and a
rolling hash that is compared with that of its prompt. Prompts get the same once for each task. Only these numbers, no
texts, meet in the join of responses and prompts (and the start of a response that offers no expression, since a
lead-in may stand there). Whether a response is cut is told by the end-of-text likelihood (``tails``) of its own end, so
that no other row and no copy of it can hide it. Whether it declines is told by a classifier of sentences (``refusals``).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalmill.llm import language, refusals, tails
from evalmill.llm.batches import byte_lengths, pieces

#: A lead-in before a repeated prompt is no longer than the prompt; where the response has an expression, which may be
#: its answer, it has at most so many letters and digits.
LEAD_IN = 40
#: A response whose language agrees with the prompt's with a lower probability is in another language.
MOST_AGREEING = 0.003

_EXPRESSION = r"[\d)]\s*[-+*/×÷−]\s*[\d(]"
#: A line or tagged part without any letters that holds an expression: an answer, whatever stands beside it.
_OFFERED = rf"(?:^|>|\n)[^\p{{L}}\n<>]*{_EXPRESSION}[^\p{{L}}\n<>]*(?:<|\n|$)"
_TAG = re.compile(rb"</?[a-z]\w*>|```")
_ALNUM = np.zeros(256, dtype=np.uint8)
for _b in range(256):
    if _b >= 128 or chr(_b).isalnum():
        _ALNUM[_b] = _b
_BASE = np.uint64(0xD6E8FEB86659FD93)


def _plain(text: Column) -> Column:
    """Lower case without invisible characters, for hashing."""
    return F.translate(F.lower(text), "​‌‍⁠﻿­", "")


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a batch with a line end after each text, and where each text starts; null is empty."""
    data = ("\n".join(t or "" for t in texts.to_pylist()) + "\n").encode("utf-8", "surrogatepass")
    raw = np.frombuffer(data, dtype=np.uint8)
    lengths = byte_lengths(texts)
    return raw, np.concatenate([[0], np.cumsum(lengths[:-1] + 1)]).astype(np.int64)


def _signals(keep: list[str]):
    """mapInArrow: the columns ``keep`` and, from ``text``, the signals of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            raw, starts = _buffers(b.column("text"))
            tags = np.zeros(len(raw), dtype=bool)
            for m in _TAG.finditer(raw.tobytes()):
                tags[m.start() : m.end()] = True
            p, _ = language.posteriors(raw, starts, tags)
            values = _ALNUM[raw]
            values[tags] = 0
            kept = values != 0
            lengths = np.diff(np.append(starts, len(raw)))
            counted = np.cumsum(kept)
            n = np.add.reduceat(kept.astype(np.int64), starts)
            left = np.repeat(counted[starts] - kept[starts] + n, lengths) - counted  # how many follow
            powers = np.ones(int(n.max()) + 1, dtype=np.uint64)
            with np.errstate(over="ignore"):
                powers[1:] = np.multiply.accumulate(np.full(len(powers) - 1, _BASE, dtype=np.uint64))
                terms = values.astype(np.uint64) * powers[np.maximum(left, 0)]
                terms[~kept] = 0
                total = np.add.reduceat(terms, starts)
            rank = counted - np.repeat(counted[starts] - kept[starts], lengths)
            most = np.maximum(n // 2, LEAD_IN)
            if "offers" in b.schema.names:
                most = np.where(b.column("offers").to_numpy(zero_copy_only=False), LEAD_IN, most)
            head = kept & (rank <= np.repeat(most, lengths))
            heads = np.add.reduceat(head.astype(np.int64), starts)
            text = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(heads)]).astype(np.int32).tobytes()), pa.py_buffer(values[head].tobytes())])
            arrays = [b.column(c) for c in keep]
            if "refuses" in keep:  # so far: whether it may
                may, cut = (b.column(c).to_numpy(zero_copy_only=False) for c in ("refuses", "open_end"))
                texts = b.column("text")
                arrays[keep.index("refuses")] = pa.array([bool(m) and refusals.declines(texts[i].as_py(), bool(cut[i])) for i, m in enumerate(may)], pa.bool_())
            arrays += [pa.FixedSizeListArray.from_arrays(pa.array(p.ravel()), p.shape[1]).cast(pa.list_(pa.float32())), pa.array(n.astype(np.int64)), pa.array(total.view(np.int64)), text]
            yield pa.RecordBatch.from_arrays(arrays, [*keep, "lang", "n", "hash", "head"])

    return run


_SIGNALS = "lang array<float>, n long, hash long, head binary"


@F.pandas_udf(T.BooleanType())
def _repeats(n: pd.Series, total: pd.Series, head: pd.Series, prompt_n: pd.Series, prompt_hash: pd.Series) -> pd.Series:
    """Whether a response is its prompt after a lead-in: its hash without the lead-in is the prompt's; -1 for no prompt."""
    out = np.zeros(len(n), dtype=bool)
    for i in np.flatnonzero(prompt_n.to_numpy() > 0):
        cut = int(n.iat[i]) - int(prompt_n.iat[i])
        if not 0 <= cut <= len(head.iat[i]):
            continue
        value, power = int(total.iat[i]), pow(int(_BASE), int(n.iat[i]) - 1, 1 << 64)
        for byte in head.iat[i][:cut]:
            value -= byte * power
            power = power * _INVERSE % (1 << 64)
        out[i] = (value - int(prompt_hash.iat[i])) % (1 << 64) == 0
    return pd.Series(out)


_INVERSE = pow(int(_BASE), -1, 1 << 64)


def _responses(df: DataFrame, keep: list[str], text: Column) -> DataFrame:
    """Signals of the responses; what Spark's own functions can tell is told before the Python pass."""
    raw, ended = F.col("raw"), F.col("ended")
    ready = df.select(*keep, text.alias("raw"), tails.once(tails.bare(text)).alias("ended")).select(
        *keep, _plain(raw).alias("text"), (~tails.has_content(raw, ended)).alias("empty"), F.coalesce(~raw.rlike(_OFFERED), F.lit(False)).alias("refuses"), tails.unfinished_bare(ended).alias("open_end"), F.coalesce(raw.rlike(_EXPRESSION), F.lit(False)).alias("offers")
    )
    types = {f.name: f.dataType.simpleString() for f in ready.schema.fields}
    through = [*keep, "empty", "refuses", "open_end"]
    return ready.mapInArrow(_signals(through), ", ".join(f"`{c}` {types[c]}" for c in through) + f", {_SIGNALS}")


def _prompts(df: DataFrame, keep: list[str], text: str) -> DataFrame:
    ready = df.select(*keep, _plain(F.col(text)).alias("text"))
    types = {f.name: f.dataType.simpleString() for f in ready.schema.fields}
    return ready.mapInArrow(_signals(keep), ", ".join(f"`{c}` {types[c]}" for c in keep) + f", {_SIGNALS}")


def broken_pairs(tasks: DataFrame, candidates: DataFrame) -> DataFrame:
    """(tab, line_no, defect) of every response of the two tables that is unusable.

    A response of tasks answers ``prompt``, one of candidates the prompt that ``prompt_field`` names in its task.
    Where that is unknown (a null prompt or prompt_field), any of the task's prompts may be repeated, and the language
    of any of them is fine, but for prompts too short to tell theirs; a response without any known prompt is neither a copy nor in another language. Types, of which the first that holds is given: 'empty',
    'copy', 'refusal', 'language', 'truncated'.

    Prompts and responses meet by task and field, one row for each distinct prompt; nothing is collected by task.

    Defined cases: a null response is empty; a response without letters has no language; a task with several rows
    counts with all its distinct prompts; repeated rows each come out; empty tables give no rows; other columns are
    not read.
    """
    fields = ["prompt_low", "prompt_mid", "prompt_high", "prompt"]
    prompts = tasks.select(F.col("id").alias("task"), F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("text")) for c in fields))).alias("p")).select("task", "p.field", "p.text").where("text is not null and task is not null").distinct()
    by_field, by_task = Window.partitionBy("task", "field"), Window.partitionBy("task")
    known = F.array_max("lang") >= 0.5
    facts = _prompts(prompts, ["task", "field"], "text").select(
        "task", "field", F.col("n").alias("p_n"), F.col("hash").alias("p_hash"), F.col("lang").alias("p_lang"), known.alias("p_known"), F.count_if(known).over(by_field).alias("of_field"), F.count_if(known).over(by_task).alias("of_task")
    )
    given = F.when(F.col("prompt").isNotNull(), F.lit("prompt"))
    both = tasks.select("line_no", F.col("id").alias("task"), F.lit("tasks").alias("tab"), given.alias("field"), "completion").unionByName(
        candidates.select("line_no", F.col("id").alias("task"), F.lit("candidates").alias("tab"), F.col("prompt_field").alias("field"), "completion")
    )
    rows = _responses(both, ["tab", "line_no", "task", "field"], F.col("completion"))
    rows = rows.withColumn("known", F.col("field").isNotNull()).withColumn("field", F.explode(F.when(F.col("field").isNotNull(), F.array("field")).otherwise(F.array(*map(F.lit, fields)))))
    met = rows.join(facts, ["task", "field"], "left")
    agreement = F.aggregate(F.zip_with("lang", "p_lang", lambda a, b: a * b), F.lit(0.0).cast("float"), lambda s, x: s + x)
    foreign = F.coalesce(F.col("p_known") & (agreement < MOST_AGREEING), F.lit(False))
    near = (F.col("n") - F.col("p_n")).between(0, F.octet_length("head"))
    judged = met.select(
        "tab", "line_no", "empty", "refuses", F.col("open_end").alias("cut"), foreign.alias("foreign"), F.when(F.col("known"), F.col("of_field")).otherwise(F.col("of_task")).alias("prompts"),
        "n", "hash", "head", F.when(near, F.col("p_n")).otherwise(F.lit(-1)).alias("p_n"), F.coalesce("p_hash", F.lit(0)).alias("p_hash"),
    )
    judged = judged.withColumn("copied", _repeats("n", "hash", "head", "p_n", "p_hash")).where("empty or copied or refuses or foreign or cut")
    seen = judged.groupBy("tab", "line_no").agg(*(F.max(c).alias(c) for c in ("empty", "copied", "refuses", "cut", "prompts")), F.count_if("foreign").alias("foreign"))
    kind = (
        F.when(F.col("empty"), "empty").when(F.col("copied"), "copy").when(F.col("refuses"), "refusal").when(F.col("foreign") >= F.greatest("prompts", F.lit(1)), "language").when(F.col("cut"), "truncated")
    )
    return seen.select("tab", "line_no", kind.alias("defect")).where("defect is not null")


def defect_report(tasks: DataFrame, candidates: DataFrame) -> DataFrame:
    """(tab, defect, responses): how many responses have each defect."""
    return broken_pairs(tasks, candidates).groupBy("tab", "defect").agg(F.count(F.lit(1)).alias("responses"))
