"""Token ids of whole texts by a public byte-level BPE, with content-defined chunks that are encoded once.

Texts are cut where a rolling hash of the last bytes hits a mask, so that stretches that recur in other texts give
the same chunks; each distinct chunk is encoded once and its ids are kept. A cut may fall anywhere, also inside a word,
so joins are repaired: of a chunk only the ids between its first and last safe place are kept and used again, and what
lies between two kept stretches is encoded anew, as one text. A safe place is one where a character that is no white
space is followed by white space: no piece of the splitting pattern spans it and none looks back over it, so ids on
both sides agree with those of the whole text. Where a chunk holds no such place, the stretch grows over the next chunks.

New chunks cost little more than plain encoding: neighbours are encoded together, and the ids of a chunk are sliced from
that when it comes again.
"""

from __future__ import annotations

import base64
import importlib
import os
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame

#: Bytes in the window of the rolling hash (a power of 2), and the mask: a cut every 128 bytes on average.
WINDOW, MASK = 16, 127
#: Bytes of chunks that a worker keeps, at most.
KEPT_BYTES = 16 << 20
#: A vocabulary file larger than this is not sent to the executors.
MOST_VOCABULARY = 64 << 20

#: Unicode's white space, as the splitting pattern knows it.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_FIRST, _LAST = (regex.compile(rf"{direction}[^{_SPACE}][{_SPACE}]") for direction in ("", "(?r)"))

_BASE = 0x9E3779B1
_GEAR = np.array([pow(0x85EBCA6B * (i + 1), 5, 1 << 32) for i in range(256)], dtype=np.uint32)
_DOUBLINGS = tuple(1 << k for k in range(WINDOW.bit_length() - 1))


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken", folder: str | None = None) -> str:
    """The place of a public vocabulary file: in ``folder``, in the installed package, or in /opt/tokenizers."""
    if folder is None:
        try:
            folder = os.path.dirname(importlib.import_module("public_tokenizers").__file__)
        except ImportError:
            folder = "/opt/tokenizers"
    return os.path.join(folder, name)


def splitting_pattern() -> str:
    """The pattern that belongs to the public rank files."""
    try:
        return importlib.import_module("public_tokenizers").PATTERN
    except ImportError:
        return r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def encoding(ranks_file: bytes):
    """A tiktoken encoding of a rank file's content."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks_file.splitlines() if line)}
    return tiktoken.Encoding("public", pat_str=splitting_pattern(), mergeable_ranks=ranks, special_tokens={})


def cuts(data: bytes) -> list[int]:
    """Places to cut at, ascending, by content: never inside a UTF-8 sequence, never at either end."""
    return cuts_of_all([data])[0]


def cuts_of_all(texts: list[bytes]) -> list[list[int]]:
    """``cuts`` of many texts, whose bytes go through the rolling hash together."""
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    b = np.frombuffer(b"".join(texts), dtype=np.uint8)
    if len(b) <= WINDOW:
        return [[] for _ in texts]
    h = _GEAR[b]
    with np.errstate(over="ignore"):
        for k in _DOUBLINGS:  # hashes of 2, 4, 8, ... bytes, each from two of half the length
            h = h[:-k] * np.uint32(pow(_BASE, k, 1 << 32)) + h[k:]
    h = h[:-1]  # no cut at the end
    at = np.flatnonzero(((h >> np.uint32(12)) & np.uint32(MASK)) == 0) + WINDOW
    at = at[(b[at] & 0xC0) != 0x80]
    starts = np.cumsum(lengths) - lengths
    owner = np.searchsorted(starts, at, "right") - 1
    at = at - starts[owner]
    inside = at >= WINDOW  # the window lies in one text
    bounds = np.searchsorted(owner[inside], np.arange(len(texts) + 1))
    kept = at[inside].tolist()
    return [kept[i:j] for i, j in zip(bounds, bounds[1:], strict=False)]


class ChunkEncoder:
    """Encodes texts chunk by chunk; equal to encoding them whole."""

    def __init__(self, enc, kept_bytes: int = KEPT_BYTES):
        self.enc, self.kept_bytes, self.size = enc, kept_bytes, 0
        #: of each chunk: its place in a stretch and that stretch's ids, or, once it came again, its own ids
        self.kept: OrderedDict[bytes, list] = OrderedDict()
        self.lengths = np.array([len(enc.decode_single_token_bytes(i)) for i in range(enc.n_vocab)], dtype=np.int64)
        self.reused = self.encoded = self.reused_bytes = self.bytes = 0

    def _known(self, chunk: bytes) -> tuple[list[int], int, int] | None:
        """(ids, first, last) between the first and last safe place of a chunk that was met before."""
        entry = self.kept.get(chunk)
        if entry is None:
            return None
        self.kept.move_to_end(chunk)
        if len(entry) == 3:
            position, size, ids = entry
            first, last = safe_places(chunk)
            if 0 <= first < last and position + first >= 0 and position + last <= size:
                ends = np.cumsum(self.lengths[ids])
                lo, hi = np.searchsorted(ends, [position + first, position + last], "right").tolist()
                entry[:] = [(ids[lo:hi], first, last)]
            else:
                entry[:] = [None]
        return entry[0]

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text; the empty list for an empty text and for null."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str | None]) -> list[list[int]]:
        """The ids of each text."""
        data = [(t or "").encode("utf-8") for t in texts]
        return [self._encode(d, c) if d else [] for d, c in zip(data, cuts_of_all(data), strict=True)]

    def _encode(self, data: bytes, at: list[int]) -> list[int]:
        """What is kept is copied; the stretches between are encoded, and the new chunks in them are kept."""
        out: list[int] = []
        start = 0  # what is not in ``out`` yet begins here
        new: list[tuple[int, bytes]] = []
        self.bytes += len(data)
        position, end = 0, len(data)
        for stop in [*at, end]:
            chunk = data[position:stop]
            if (got := self._known(chunk)) is not None:
                ids, first, last = got
                out += self._stretch(data, start, position + first, new)
                out += ids
                self.reused += 1
                self.reused_bytes += last - first
                start, new = position + last, []
            elif chunk not in self.kept:
                new.append((position, chunk))
            position = stop
        return out + self._stretch(data, start, end, new)

    def _stretch(self, data: bytes, start: int, stop: int, new: list[tuple[int, bytes]]) -> list[int]:
        """The ids of data[start:stop]; keeps where the new chunks lie in it."""
        if stop <= start:
            return []
        ids = self.enc.encode_ordinary(data[start:stop].decode("utf-8"))
        for position, chunk in new:
            if chunk in self.kept:  # twice in one text
                continue
            self.encoded += 1
            self.kept[chunk] = [position - start, stop - start, ids]
            self.size += len(chunk)
        while self.size > self.kept_bytes:
            self.size -= len(self.kept.popitem(last=False)[0])
        return ids


def safe_places(chunk: bytes) -> tuple[int, int]:
    """First and last place, in bytes, between a character that is no white space and white space; -1, -1 if none."""
    text = chunk.decode("utf-8")
    first = _FIRST.search(text)
    if not first:
        return -1, -1
    last = _LAST.search(text)
    if len(text) == len(chunk):
        return first.start() + 1, last.start() + 1
    return tuple(len(text[: m.start() + 1].encode("utf-8")) for m in (first, last))


def token_ids(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(key, ids) of every row by the rank file ``vocabulary`` (a path on the driver), without special tokens.

    The file's content (checked against a bound) is broadcast, so executors need no file. Strings of special tokens
    in a text are ordinary text. Defined cases: empty and null texts get the empty list; a text of any length is
    encoded whole; an empty table gives no rows; repeated rows come out repeatedly; other columns are not read.
    """
    path = vocabulary or vocabulary_path()
    if os.path.getsize(path) > MOST_VOCABULARY:
        raise ValueError(f"{path} is larger than {MOST_VOCABULARY} bytes")
    with open(path, "rb") as f:
        ranks = df.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = None
        for batch in batches:
            encoder = encoder or _encoder(ranks.value)
            yield pd.DataFrame({key: batch[key], "ids": encoder.encode_all(batch[text].tolist())})

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInPandas(run, f"`{key}` {kind}, ids array<int>")


_encoders: dict[int, ChunkEncoder] = {}


def _encoder(ranks: bytes) -> ChunkEncoder:
    """One encoder for a worker and vocabulary, kept between tasks."""
    at = hash(ranks)
    if at not in _encoders:
        _encoders.clear()
        _encoders[at] = ChunkEncoder(encoding(ranks))
    return _encoders[at]
