"""Text compared up to formatting: one table folds or skips each character, nothing canonical is built.

``fold_hashes`` streams a batch of strings through the table into polynomial hashes; ``same`` walks two strings
with one pointer each, skipping what does not count.
"""

from __future__ import annotations

import json
import sys
import unicodedata

import numpy as np
import pyarrow as pa

from evalmill.llm.batches import byte_lengths, cuts

#: Decorative punctuation, beside white space and invisible characters.
DECORATION = "\"'`$,;:!?" + "‘’‚‛“”„‟‹›«»`´′″＂＇"
#: A full stop is skipped too unless it stands between digits.
STOP = ord(".")
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def _fold_table() -> np.ndarray:
    """For each code point: 0 to skip it, else the code point of its lower case (plus one, so that none is 0)."""
    table = np.arange(1, sys.maxunicode + 2, dtype=np.uint32)
    for cp in range(0x30000):
        c = chr(cp)
        category = unicodedata.category(c)
        if c.isspace() or category in ("Zs", "Zl", "Zp", "Cf", "Cc") or cp in (0x3164, 0x115F, 0x1160, 0xFFA0, 0x2800) or 0xFE00 <= cp <= 0xFE0F:
            table[cp] = 0
        elif category in ("Lu", "Lt", "Nl", "So") and len(low := c.lower()) == 1:
            table[cp] = ord(low) + 1
    table[[ord(c) for c in DECORATION]] = 0
    table[0xE0000:0xE1000] = 0
    return table


TABLE = _fold_table()
ASCII = TABLE[:128].copy()
_DIGIT = np.zeros(128, dtype=bool)
_DIGIT[48:58] = True
_powers = np.ones(1, dtype=np.uint64)


def _power_table(n: int) -> np.ndarray:
    """BASE to the powers 0..n-1, modulo 2**64; grown as longer texts come."""
    global _powers
    if len(_powers) < n:
        size = max(n, 2 * len(_powers), 1024)
        p = np.full(size, BASE, dtype=np.uint64)
        p[0] = 1
        with np.errstate(over="ignore"):
            _powers = np.multiply.accumulate(p)
    return _powers


def _hash_codes(codes: np.ndarray, values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Polynomial hash of each segment of folded values; skipped characters (0) take no power."""
    is_stop = np.flatnonzero(codes == STOP)
    if len(is_stop):
        digit = (codes >= 48) & (codes < 58)
        before, after = digit[np.maximum(is_stop - 1, 0)], digit[np.minimum(is_stop + 1, len(codes) - 1)]
        inside = ~np.isin(is_stop, starts) & ~np.isin(is_stop + 1, starts) & (is_stop + 1 < len(codes))
        values = values.copy()
        values[is_stop[~(before & after & inside)]] = 0
    kept = values != 0
    rank = np.cumsum(kept) - kept
    lengths = np.diff(np.append(starts, len(codes)))
    rank = rank - np.repeat(rank[starts], lengths)
    with np.errstate(over="ignore"):
        terms = values.astype(np.uint64) * _power_table(int(rank.max()) + 2)[rank]
        terms[~kept] = 0
        return np.add.reduceat(terms, starts) + np.add.reduceat(kept.astype(np.uint64), starts)


def fold_hashes(strings: pa.Array) -> np.ndarray:
    """The hashes of ``_fold_piece``, piece by piece, so that work arrays stay small however long the texts are."""
    if isinstance(strings, pa.ChunkedArray):
        strings = strings.combine_chunks()
    strings = strings.cast(pa.large_string())
    parts = [_fold_piece(strings.slice(first, rows)) for first, rows in cuts(byte_lengths(strings))]
    return np.concatenate([np.zeros(0, np.uint64), *parts])


def _fold_piece(strings: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string up to formatting; 0 for null, and for texts of which nothing counts.

    Strings with only ASCII are hashed straight from the Arrow buffer; the others by code points, with the same
    result for the same characters.
    """
    n = len(strings)
    out = np.zeros(n, dtype=np.uint64)
    if not n or strings.null_count == n:
        return out
    offsets = np.frombuffer(strings.buffers()[1], dtype=np.int64)[strings.offset : strings.offset + n + 1]
    data = strings.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
    filled = np.diff(offsets) > 0
    if not filled.any():
        return out
    rows, starts = np.flatnonzero(filled), offsets[:-1][filled]
    high = np.add.reduceat((data >= 128).astype(np.int64), starts) > 0
    with np.errstate(over="ignore"):
        out[rows] = _hash_codes(data, ASCII[np.minimum(data, 127)], starts)
    if high.any():
        wide = rows[high]
        texts = [strings[int(i)].as_py() for i in wide]
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        lengths = np.array([len(t) for t in texts])
        out[wide] = _hash_codes(codes, TABLE[codes], np.concatenate([[0], np.cumsum(lengths)[:-1]]))
    return out


def fold_hash(text: str) -> int:
    """The hash that ``fold_hashes`` gives for one string."""
    return int(fold_hashes(pa.array([text]))[0])


def _next(text: str, i: int) -> tuple[int, int]:
    """(folded value, index after it) of the next character that counts from index i; value 0 at the end."""
    n = len(text)
    while i < n:
        cp = ord(text[i])
        value = int(TABLE[cp])
        if cp == STOP and not (0 < i < n - 1 and "0" <= text[i - 1] <= "9" and "0" <= text[i + 1] <= "9"):
            value = 0
        i += 1
        if value:
            return value, i
    return 0, i


def same(a: str | None, b: str | None) -> bool:
    """Whether two strings are the same up to formatting; null equals only null."""
    if a is None or b is None or a == b:
        return a == b
    i = j = 0
    while True:
        x, i = _next(a, i)
        y, j = _next(b, j)
        if x != y:
            return False
        if not x:
            return True


def _no_constant(name: str):
    raise ValueError(name)


class _Pairs(list):
    """The fields of a JSON object in their order; a plain list is an array."""


_decoder = json.JSONDecoder(object_pairs_hook=_Pairs, parse_constant=_no_constant)


def parse_json(line: str | None):
    """(whether it is whole JSON, the value with objects as ``_Pairs``)."""
    if line is None:
        return False, None
    try:
        return True, _decoder.decode(line.strip("﻿​ \t\r\n"))
    except (ValueError, RecursionError):
        return False, None


_MASK = (1 << 64) - 1


def _mix(x: int) -> int:
    """A 64-bit finaliser."""
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _MASK
    return x ^ (x >> 31)


def _strings_of(value, out: list[str]) -> None:
    if isinstance(value, _Pairs):
        for name, v in value:
            out.append(name)
            _strings_of(v, out)
    elif isinstance(value, list):
        for v in value:
            _strings_of(v, out)
    elif isinstance(value, str):
        out.append(value)


def _json_hash(value, strings) -> int:
    """Objects add up the hashes of their fields, so that their order is free; arrays chain; numbers go by value."""
    if isinstance(value, _Pairs):
        return _mix(1 + sum(_mix(next(strings) * 3 + _json_hash(v, strings) & _MASK) for _, v in value) & _MASK)
    if isinstance(value, list):
        h = 2
        for v in value:
            h = _mix((h * 31 + _json_hash(v, strings)) & _MASK)
        return h
    if isinstance(value, str):
        return _mix(next(strings) ^ 0xA5)
    if value is None:
        return 11
    if isinstance(value, bool):
        return 13 + value
    return _mix(hash(value) & _MASK ^ 0x5A5A)


def json_hashes(lines: list[str | None]) -> list[int | None]:
    """A hash of the content of each line of JSON up to formatting; null for lines that are not whole JSON."""
    parsed, strings = [], []
    for line in lines:
        ok, value = parse_json(line)
        parsed.append((ok, value))
        if ok:
            _strings_of(value, strings)
    hashes = iter(fold_hashes(pa.array(strings, pa.large_string())).tolist())
    return [_json_hash(value, hashes) if ok else None for ok, value in parsed]


def _same_value(a, b) -> bool:
    if isinstance(a, _Pairs) or isinstance(b, _Pairs):
        if not (isinstance(a, _Pairs) and isinstance(b, _Pairs) and len(a) == len(b)):
            return False
        left = list(b)
        for name, value in a:
            at = next((k for k, (other, v) in enumerate(left) if same(name, other) and _same_value(value, v)), None)
            if at is None:
                return False
            left.pop(at)
        return True
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(_same_value, a, b))
    if isinstance(a, str) and isinstance(b, str):
        return same(a, b)
    number = lambda x: isinstance(x, (int, float)) and not isinstance(x, bool)
    if number(a) and number(b):
        return a == b
    return type(a) is type(b) and a == b


def same_json(a: str | None, b: str | None) -> bool:
    """Whether two lines are whole JSON of the same content up to formatting."""
    if a is not None and a == b:
        return parse_json(a)[0]
    (ok_a, x), (ok_b, y) = parse_json(a), parse_json(b)
    return ok_a and ok_b and _same_value(x, y)


def folded(text: str) -> str:
    """The characters that count, folded. Only for the few rows whose hashes collide without being the same."""
    out, i = [], 0
    while True:
        value, i = _next(text, i)
        if not value:
            return "".join(out)
        out.append(chr(value - 1))


def folded_json(value) -> str:
    """A text that is equal for JSON values of the same content. Only for rows whose hashes collide."""
    if isinstance(value, _Pairs):
        return "{" + ",".join(sorted(f"{json.dumps(folded(k))}:{folded_json(v)}" for k, v in value)) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(folded_json, value)) + "]"
    if isinstance(value, str):
        return json.dumps(folded(value))
    if value is None or isinstance(value, bool):
        return json.dumps(value)
    return repr(int(value)) if isinstance(value, int) or value.is_integer() else repr(value)
