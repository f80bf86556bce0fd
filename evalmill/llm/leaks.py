"""Held-out passages inside a corpus, found by winnowing and verified word by word.

Texts become words (case, punctuation, markup, escapes and line prefixes fall away). Of every w consecutive hashes of
k words the least is kept; any run of k + w - 1 words that a document shares with an item has a kept hash in common.
A passage of 24 words of which one in ten is changed has an unchanged run of at least 7 words, so k = 5 and w = 3
miss none. Documents and items that share a kept hash are aligned, and the longest stretch within the tolerance counts.
"""

from __future__ import annotations

import difflib
import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words in a hash, and hashes in a window.
K, WINDOW = 5, 3
#: Words of an item that must run on, and how many words there may be for each changed one.
LEAST, PER_EDIT = 24, 10
#: Items are sent to all tasks if their texts take at most so many bytes; beyond that fingerprints are joined.
MOST_SENT = 32 << 20
#: Parts of a fingerprint's documents in the join.
PARTS = 16

_ESCAPE = re.compile(r"\\u([0-9a-fA-F]{4})|\\x([0-9a-fA-F]{2})|\\[nrtbfv\"'/\\]")
_TAG = re.compile(r"</?[A-Za-z][^<>\n]*+>")  # a tag ends before the next one begins, so this is linear
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_INSIDE = re.compile("[­​‌‍⁠﻿]")


def words(text: str | None) -> list[str]:
    """The words of a text in lower case; null and empty texts have none."""
    if not text:
        return []
    if "\\" in text:
        text = _ESCAPE.sub(lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else " ", text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = _INSIDE.sub("", text).replace("’", "'")
    return _WORD.findall(text.lower())


class _Hashes(dict):
    """A 64-bit hash of each word, kept for the words seen last."""

    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_word_hash = _Hashes()
_MIX = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(ws: list[str]) -> np.ndarray:
    """The hash of each K consecutive words."""
    if len(ws) < K:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(_word_hash.__getitem__, ws), dtype=np.uint64, count=len(ws))
    out = np.zeros(len(ws) - K + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(K):
            out = out * _MIX + h[i : i + len(out)]
        out ^= out >> np.uint64(29)
        return out * _MIX


def winnow(hashes: np.ndarray) -> np.ndarray:
    """The distinct least hashes of all windows; a text of fewer than WINDOW hashes keeps its least one."""
    if len(hashes) == 0:
        return hashes
    if len(hashes) < WINDOW:
        return hashes.min(keepdims=True)
    return np.unique(np.lib.stride_tricks.sliding_window_view(hashes, WINDOW).min(axis=1))


def longest_shared(doc: list[str], item: list[str]) -> int:
    """The most words of the item that run on in the document with at most one in PER_EDIT changed, dropped or added."""
    grams: dict[tuple, list[int]] = {}
    for p in range(len(item) - K + 1):
        grams.setdefault(tuple(item[p : p + K]), []).append(p)
    hits = sorted({(j - p, j) for j in range(len(doc) - K + 1) for p in grams.get(tuple(doc[j : j + K]), ())})
    best, slack = 0, len(item) // PER_EDIT + 1
    clusters: list[list[int]] = []  # lowest and highest diagonal, first and last position
    for diagonal, j in hits:
        if clusters and diagonal - clusters[-1][1] <= slack:
            c = clusters[-1]
            c[1], c[2], c[3] = diagonal, min(c[2], j), max(c[3], j)
        else:
            clusters.append([diagonal, diagonal, j, j])
    for low, high, _, _ in clusters:
        part = doc[max(0, low - slack) : high + len(item) + slack]
        blocks = [b for b in difflib.SequenceMatcher(None, part, item, autojunk=False).get_matching_blocks() if b.size]
        edits = [max(b.a - a.a - a.size, b.b - a.b - a.size) for a, b in zip(blocks, blocks[1:], strict=False)]
        for s in range(len(blocks)):
            changed = 0
            for e in range(s, len(blocks)):
                changed += edits[e - 1] if e > s else 0
                run = blocks[e].b + blocks[e].size - blocks[s].b
                if changed * PER_EDIT <= run:
                    best = max(best, run)
    return best


def leaked(doc: list[str], item: list[str]) -> bool:
    """Whether at least LEAST words of the item run on in the document."""
    enough = LEAST - LEAST // PER_EDIT
    if sum((Counter(doc) & Counter(item)).values()) < enough:
        return False
    return longest_shared(doc, item) >= LEAST


def _fingerprints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        prints = [winnow(gram_hashes(words(t))).view(np.int64) for t in b["text"].tolist()]
        yield pd.DataFrame({"key": np.repeat(b["key"].to_numpy(), [len(p) for p in prints]), "h": np.concatenate([*prints, np.zeros(0, np.int64)])})


@F.pandas_udf(T.BooleanType())
def _leaked(docs: pd.Series, items: pd.Series) -> pd.Series:
    return pd.Series([leaked(words(d), words(i)) for d, i in zip(docs.tolist(), items.tolist(), strict=True)])


class Index:
    """Fingerprints of the items in arrays that are made once and sent as they are; texts become words when they are met."""

    def __init__(self, items: list[tuple[int, str]]):
        self.keys, self.texts = [k for k, _ in items], [t for _, t in items]
        prints = [winnow(gram_hashes(words(t))) for t in self.texts]
        hashes = np.concatenate([*prints, np.zeros(0, np.uint64)])
        owners = np.repeat(np.arange(len(prints)), [len(p) for p in prints])
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.owners = hashes[order], owners[order].astype(np.int32)

    def met(self, prints: np.ndarray) -> list[int]:
        """Numbers of the items that share a fingerprint."""
        lo, hi = np.searchsorted(self.hashes, prints, "left"), np.searchsorted(self.hashes, prints, "right")
        hits = np.flatnonzero(hi > lo)
        return sorted({n for i, j in zip(lo[hits].tolist(), hi[hits].tolist(), strict=True) for n in self.owners[i:j].tolist()}) if len(hits) else []


def _sent(docs: DataFrame, items: list[tuple[int, str]]) -> DataFrame:
    """The items and their index are in every task; documents are read once and nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(Index(items))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index, known = shared.value, {}
        for b in batches:
            found = []
            for key, text in zip(b["key"].tolist(), b["text"].tolist(), strict=True):
                ws = words(text)
                for n in index.met(winnow(gram_hashes(ws))):
                    item = known.get(n) or known.setdefault(n, words(index.texts[n]))
                    if leaked(ws, item):
                        found.append((key, index.keys[n]))
            yield pd.DataFrame(found, columns=["key", "item"]).astype("int64")

    return docs.mapInPandas(run, "key long, item long")


def _joined(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Fingerprints of both sides are joined, then the texts of the pairs that met.

    A fingerprint that very many documents hold is joined in parts by the key of the document.
    """
    kind = "key long, h long"
    d = docs.mapInPandas(_fingerprints, kind)
    i = items.mapInPandas(_fingerprints, kind).select(F.col("key").alias("item"), "h")
    d = d.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(PARTS)).cast("int"))
    i = i.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    pairs = d.join(i, ["h", "part"]).select("key", "item").distinct()
    texts = pairs.join(docs, "key").join(items.select(F.col("key").alias("item"), F.col("text").alias("item_text")), "item")
    return texts.where(_leaked("text", "item_text")).select("key", "item")


def leaks(docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text", most_sent: int = MOST_SENT) -> DataFrame:
    """(doc_key, item_key) of every document that holds a passage of an item.

    A passage is at least 24 words of the item running on, of which at most one in ten is changed, dropped or added.
    Items are measured first: up to ``most_sent`` bytes they are sent to all tasks, beyond that fingerprints are
    joined; both ways give the same rows.

    Defined cases: null and empty texts, and items of fewer than 24 words, are in no pair; keys are integers, null
    keys are no case; repeated documents each come out, repeated item keys once; empty tables give no rows; other
    columns are not read.
    """
    d = docs.select(F.col(doc_key).cast("long").alias("key"), F.col(text).alias("text")).where("text is not null and key is not null")
    i = items.select(F.col(item_key).cast("long").alias("key"), F.col(text).alias("text")).where("text is not null and key is not null")
    size = i.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    found = _sent(d, [tuple(r) for r in i.collect()]) if size <= most_sent else _joined(d, i)
    return found.select(F.col("key").alias(doc_key), F.col("item").alias(item_key)).distinct()


def leak_report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(split, items, leaked_items, documents): per split, its items, those that leaked and the documents they are in."""
    hits = leaks(docs, items).join(items.select("item_id", "split"), "item_id")
    per = hits.groupBy("split").agg(F.countDistinct("item_id").alias("leaked_items"), F.countDistinct("doc_id").alias("documents"))
    total = items.groupBy("split").agg(F.count(F.lit(1)).alias("items"))
    return total.alias("t").join(per.alias("p"), F.col("t.split").eqNullSafe(F.col("p.split")), "left").select("t.split", "items", F.coalesce("leaked_items", F.lit(0)).alias("leaked_items"), F.coalesce("documents", F.lit(0)).alias("documents"))
