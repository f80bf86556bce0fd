"""Text that was decoded with the wrong character encoding, and its repair by the round trip back.

Two kinds of round trip are tried on each stretch of characters outside ASCII:

* UTF-8 read as a legacy encoding: the stretch is encoded in that encoding again and strictly decoded as UTF-8,
  repeatedly for nested layers;
* one legacy encoding read as another: words are encoded as the one and decoded as the other.

A round trip is accepted when a cost of garbling drops. For the first kind the cost counts what does not go together:
symbols inside words, control characters, capitals after small letters, mixed or rare scripts. For the second kind,
where letters turn into other letters, it is the likelihood of the letters under a trigram model counted over
trusted text: sentences with words that may be swapped count only where their other words are of a language that such
letters belong to, so that garbled rows, however many, never speak for themselves. Words that no language writes
(accented letters alone, signs between letters) settle the encoding of their text. U+FFFD marks characters that are lost. Signs that stand alone in quotation marks are mentioned, not garbled.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalmill.llm import language
from evalmill.llm.batches import pieces
from evalmill.llm.language import SEEDS

#: Encodings that UTF-8 may have been read as; nested layers are undone up to so many times.
READ_AS = ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1251", "cp1250", "cp1254")
MOST_LAYERS = 4
#: (encoding that was used, encoding that was meant) for one byte a character.
SWAPS = (("cp1252", "cp1250"), ("latin-1", "iso8859_2"), ("cp1252", "cp1251"), ("latin-1", "koi8_r"), ("cp1252", "koi8_r"), ("latin-1", "cp1251"))
#: Languages that are written in the letters of latin-1, in which words that may be swapped can be right.
_WESTERN = [k for k, x in enumerate(language.LANGUAGES) if x in ("en", "de", "fr", "es", "pt", "it", "nl", "sv")]
#: The encoding of a text is settled by so many different words that no language writes.
SETTLE = 2
#: The trigram model: buckets, weight of the built-in text, and by how much the mean log-likelihood must rise.
BITS, SEED_WEIGHT, RISE = 17, 2.0, 1.2
#: A changed trigram must be this frequent at least (with the built-in text) on average, as a logarithm.
LEAST_LIKELY = 1.0

_OUTSIDE = re.compile(r"[^\x00-\x7f]+")
_OPEN, _CLOSE = "“‘„‚«‹", "”’“‘»›"
#: Controls that no text holds on purpose, and what stands for a mention while a text is repaired.
_CONTROL, _HIDDEN = re.compile("[\x80-\x84\x86-\x9f]"), re.compile("\ue000+")
_RARE_BLOCKS = ((0x180, 0x24F), (0x250, 0x2FF), (0x370, 0x385), (0x460, 0x52F), (0x530, 0x5CF), (0x700, 0x8FF), (0x1400, 0x1DFF))
_COMMON_SIGNS = set("’‘“”„‚«»‹›–—‑…•·   ")
_SEQUENCE = re.compile(b"(?:[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3})+")


@lru_cache(None)
def _bytes_of(encoding: str) -> dict[str, int]:
    """Character to byte of an encoding, for bytes from 0x80; bytes without a character stand for C1 controls."""
    out = {}
    for b in range(0x80, 0x100):
        try:
            out[bytes([b]).decode(encoding)] = b
        except UnicodeDecodeError:
            out[chr(b)] = b
    return out


@lru_cache(100_000)
def _kind(c: str) -> tuple[str, str]:
    """(class, script) of a character: L, l letters, s common sign, x symbol, d digit, c control, r rare, u unassigned."""
    cp, category = ord(c), unicodedata.category(c)
    if category in ("Cn", "Co", "Cs"):
        return "u", ""
    if category == "Cc":
        return "c", ""
    if c in _COMMON_SIGNS or category == "Cf":
        return "s", ""
    if category[0] in "LM":
        if any(a <= cp <= b for a, b in _RARE_BLOCKS) or category[0] == "M":
            return "r", ""
        return ("L" if category in ("Lu", "Lt") else "l"), unicodedata.name(c, "?").split(" ")[0]
    return ("d" if category == "Nd" else "x"), ""


def garbling_cost(before: str, run: str, after: str) -> float:
    """What does not go together in a run of characters between its neighbours."""
    total = 0.0
    kinds = [_kind(c) if c else ("", "") for c in (before, *run, after)]
    for i in range(1, len(kinds) - 1):
        kind, script = kinds[i]
        left, right = kinds[i - 1], kinds[i + 1]
        total += 1.0
        if kind in "cu":
            total += 4.0
        elif kind == "r":
            total += 4.0
        elif kind == "x":
            total += 2.0 * ((left[0] in ("L", "l")) + (right[0] in ("L", "l")))
        elif kind in "Ll":
            for other in (left, right):
                total += 2.0 * (other[0] in ("L", "l") and other[1] != script)
            total += 1.5 * (kind == "L" and left[0] == "l")
            total += 1.5 * (right[0] == "L" and kind == "l")
    return total


def _undo(run: str, encoding: str, whole: bool) -> str | None:
    """The run with its UTF-8 sequences decoded, or None; whole: only if it consists of sequences."""
    table = _bytes_of(encoding)
    data = bytes(table.get(c, 0) for c in run)
    if whole:
        try:
            new = None if 0 in data else data.decode("utf-8")
        except UnicodeDecodeError:
            return None
        other = new and {s for c in new if (s := _kind(c)[1]) not in ("", "LATIN", "CYRILLIC", "GREEK")}
        return None if other and (len(other) > 1 or not new.isalpha() or len(new) < 2) else new
    out, at = [], 0
    for m in _SEQUENCE.finditer(data):
        try:
            text = m[0].decode("utf-8")
        except UnicodeDecodeError:
            continue
        if all(_kind(c)[1] in ("LATIN", "CYRILLIC", "GREEK") or c in _COMMON_SIGNS for c in text):
            out += [run[at : m.start()], text]
            at = m.end()
    return "".join(out) + run[at:] if at else None


@lru_cache(200_000)
def repair_run(before: str, run: str, after: str, whole: bool = True) -> str:
    """The run with layers of UTF-8 read as a legacy encoding undone, as long as the cost drops."""
    for _ in range(MOST_LAYERS):
        cost, best = garbling_cost(before, run, after), None
        for encoding in READ_AS:
            new = _undo(run, encoding, whole)
            if new is not None and (c := garbling_cost(before, new, after)) < cost:
                cost, best = c, new
        if best is None:
            return run
        run = best
    return run


def _mentioned(before: str, run: str, after: str) -> bool:
    """Whether the run is only quoted: alone between quotation marks of either kind."""
    if len(run) > 2 and run[0] in _OPEN and run[-1] in _CLOSE:
        return not any(c in _OPEN + _CLOSE for c in run[1:-1]) or len(run) <= 8
    return before in "\"'`" and before == after and before != ""


def _fold(codes: np.ndarray) -> np.ndarray:
    return np.where(codes < len(_LOWER), _LOWER[np.minimum(codes, len(_LOWER) - 1)], codes)


_LOWER = np.array([ord(chr(i).lower()) if len(chr(i).lower()) == 1 and chr(i).isalpha() else (i if chr(i).isalpha() or i >= 128 else 32) for i in range(0x600)], dtype=np.uint32)


def _trigrams(codes: np.ndarray) -> np.ndarray:
    """Buckets of the trigrams that hold a character outside ASCII."""
    if len(codes) < 3:
        return np.zeros(0, dtype=np.int64)
    c = _fold(codes)
    wide = c >= 128
    at = np.flatnonzero(wide[:-2] | wide[1:-1] | wide[2:])
    return _bucket(c[at], c[at + 1], c[at + 2])


def _bucket(a, b, c):
    with np.errstate(over="ignore"):
        h = (a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (c.astype(np.uint64) * np.uint64(0x165667B19E3779F9))
        h *= np.uint64(0xD6E8FEB86659FD93)
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def seed_counts() -> np.ndarray:
    """Trigram counts of the built-in text of all languages."""
    text = _codes(" \n ".join(SEEDS.values()))
    return np.bincount(_trigrams(text), minlength=1 << BITS).astype(np.float64) * SEED_WEIGHT


def _swapped(word: str, used: str, meant: str) -> tuple[str, list[int]] | None:
    """The word decoded as meant, and the places that change; None if it cannot have been meant."""
    try:
        new = "".join(c if ord(c) < 128 else bytes([_bytes_of(used)[c]]).decode(meant) for c in word)
    except (KeyError, UnicodeDecodeError):
        return None
    changed = [i for i, (a, b) in enumerate(zip(word, new, strict=True)) if a != b]
    if not changed or not all(_kind(new[i])[0] in ("L", "l") for i in changed):
        return None
    if len({_kind(c)[1] for c in new if c.isalpha()}) > 1 or re.search(r"[^\W\d_][A-ZА-ЯŁŚŻŹĆŃĄĘ]", new) and not new.isupper():
        return None
    return new, changed


@lru_cache(100_000)
def _suspect(word: str) -> tuple[bool, bool]:
    """(whether a word may be swapped, whether no language writes it as it is)."""
    ways = [new for way in SWAPS if (new := _swapped(word, *way)) is not None]
    foreign = len(word) > 2 and not any(c.isascii() for c in word) and any(_kind(new[0][0])[1] == "CYRILLIC" for new in ways)
    return bool(ways), bool(ways) and (foreign or _SIGN_INSIDE.search(word) is not None)


def trusted(texts: list[str]) -> str:
    """The sentences that tell what is right: those without words that may be swapped, or in a Western language without them."""
    kept, doubtful, rests = [], [], []
    for t in texts:
        if not _SWAP_WORD.search(t):
            kept.append(t)
            continue
        for sentence in _SENTENCE.split(t):
            seen = [_suspect(w) for w in set(_SWAP_WORD.findall(sentence))]
            if not any(may for may, _ in seen):
                kept.append(sentence)
            elif not any(never for _, never in seen):
                doubtful.append(sentence)
                rests.append(_SWAP_WORD.sub(lambda m: " " if _suspect(m[0])[0] else m[0], sentence).lower().encode("utf-8", "replace") + b"\n")
    if doubtful:
        starts = np.cumsum([0, *map(len, rests[:-1])])
        p, _ = language.posteriors(np.frombuffer(b"".join(rests), dtype=np.uint8), starts)
        kept += [s for s, west in zip(doubtful, p[:, _WESTERN].sum(axis=1), strict=True) if west >= 0.5]
    return " \n ".join(kept)


def corpus_counts(df: DataFrame, text: str) -> np.ndarray:
    """Trigram counts over all trusted text: each task adds up a table of fixed size; at most 2**17 sums come back."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BITS, dtype=np.int64)
        for b in pieces(batches, text):
            joined = trusted([t for t in b.column(0).to_pylist() if t and not t.isascii()])
            total += np.bincount(_trigrams(_codes(joined)), minlength=1 << BITS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["g", "n"])

    out = seed_counts()
    for g, n in df.select(text).mapInArrow(count, "g long, n long").groupBy("g").agg(F.sum("n")).collect():
        out[g] += n
    return out


class Swaps:
    """Words whose letters were read in another encoding of one byte a character."""

    def __init__(self, counts: np.ndarray):
        self.logs = np.log(counts + 0.1)
        self.known: dict[str, str | None] = {}

    def likelihood(self, word: str, changed: list[int]) -> float:
        """Mean log-count of the trigrams of a word, between blanks, that touch the changed places."""
        codes = _fold(_codes(f" {word} "))
        starts = sorted({s for i in changed for s in (i - 1, i, i + 1) if 0 <= s <= len(codes) - 3})
        at = np.array(starts)
        return float(self.logs[_bucket(codes[at], codes[at + 1], codes[at + 2])].mean())

    def repair(self, word: str) -> str | None:
        """The word as it was meant, or None if it is fine as it is."""
        if word not in self.known:
            if len(self.known) > 100_000:
                self.known.clear()
            self.known[word] = self._repair(word)
        return self.known[word]

    def _repair(self, word: str) -> str | None:
        best, most = None, -np.inf
        for way in SWAPS:
            if (got := _swapped(word, *way)) is None:
                continue
            new, changed = got
            had, has = self.likelihood(word, changed), self.likelihood(new, changed)
            if has > most and has - had >= RISE and has >= LEAST_LIKELY:
                best, most = new, has
        return best

    def settled(self, words: set[str]) -> tuple[dict[str, str], dict[str, str]]:
        """(words to repair, those to repair beside words that no language writes) of one text; empty if too few of these settle it.

        The pair of encodings that fits most words holds for all of them, the likelier of equal ones. The first are words
        that are not likelier as they are, the second all words that become Cyrillic.
        """
        never = [w for w in words if _suspect(w)[1]]
        best, most = {}, (0, 0.0)
        for way in SWAPS if len(never) >= SETTLE else ():
            able = {w: got for w in words if (got := _swapped(w, *way)) is not None and not _CAPITAL_INSIDE(got[0])}
            score = len(able), sum(self.likelihood(*got) for got in able.values())
            if sum(w in able for w in never) >= SETTLE and (not best or score > most):
                best, most = able, score
        likely = {w: new for w, (new, changed) in best.items() if self.likelihood(new, changed) >= self.likelihood(w, changed)}
        return likely, {w: new for w, (new, _) in best.items() if _kind(new[0])[1] == "CYRILLIC"}


_SIGN_IN_WORD = "¡¢£¤¥¦§¨©ª«¬®¯°±²³´¶·¸¹º»¼½¾¿×÷"
_SWAP_WORD = re.compile(rf"[A-Za-zÀ-ÿ{_SIGN_IN_WORD}ŒœŠšŸŽžƒ]*[¡-ÿŒœŠšŸŽžƒ][A-Za-zÀ-ÿ{_SIGN_IN_WORD}ŒœŠšŸŽžƒ]*")

_SIGN_INSIDE = re.compile(r"[^\W\d_][¹³¿¼¾£¥ª¯¶][^\W\d_]")
_CAPITAL_INSIDE = lambda word: any(_kind(a)[0] == "l" and _kind(b)[0] == "L" for a, b in zip(word, word[1:]))
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


def _replace(text: str, pattern: re.Pattern, new) -> str:
    """The text with each match outside mentions replaced by what ``new`` makes of it and its neighbours."""
    out, at = [], 0
    for m in pattern.finditer(text):
        got = new(text[max(0, m.start() - 1) : m.start()], m[0], text[m.end() : m.end() + 1])
        if got is not None and got != m[0]:
            out += [text[at : m.start()], got]
            at = m.end()
    return "".join(out) + text[at:] if out else text


def repair(text: str | None, swaps: Swaps) -> tuple[str | None, bool, bool]:
    """(text with what can be restored, whether any character came out wrong, whether some are lost).

    Whole stretches of UTF-8 come first, then words of another encoding, then sequences within stretches. A word of
    one letter is only taken as swapped where a longer word is.
    """
    if not text or text.isascii():
        return text, False, False
    mentions: list[str] = []

    def hide(before: str, run: str, after: str) -> str | None:
        if _mentioned(before, run, after):
            mentions.append(run)
            return "\ue000" * len(run)
        return None

    start = _replace(text, _OUTSIDE, hide)
    now = _replace(start, _OUTSIDE, lambda b, run, a: repair_run(b, run, a) if len(run) > 1 else None)
    found = set(_SWAP_WORD.findall(now))
    words, beside = swaps.settled(found) if not _CONTROL.search(now) else ({}, {})  # controls: other layers are left
    if beside:
        parts = _SENTENCE.split(now), _SENTENCE.findall(now)
        fixed = [_replace(t, _SWAP_WORD, lambda _, w, __: beside.get(w)) if any(w in beside and _suspect(w)[1] for w in _SWAP_WORD.findall(t)) else t for t in parts[0]]
        now = "".join(x for pair in zip(fixed, [*parts[1], ""], strict=True) for x in pair)
    words |= {w: new for w in found - words.keys() if (new := swaps.repair(w)) is not None}
    if any(len(w) > 1 for w in words):
        now = _replace(now, _SWAP_WORD, lambda _, w, __: words.get(w))
    now = _replace(now, _OUTSIDE, lambda b, run, a: repair_run(b, run, a, False) if len(run) > 1 else None)
    lost = "\ufffd" in now or _CONTROL.search(now) is not None
    wrong = now != start or lost
    if mentions:
        quoted = iter(mentions)
        now = _HIDDEN.sub(lambda _: next(quoted), now)
    return now, wrong, lost


def garbled(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, restored, lost) of every text with a character that came out wrong; lost: some cannot be restored.

    Defined cases: null, empty and ASCII texts are no case; correct letters, signs and drawing characters of any
    script are no case, nor are garbled signs that stand alone in quotation marks; a text of any length is read
    whole; repeated rows come out repeatedly; an empty table gives no rows; other columns are not read.
    """
    counts = corpus_counts(df, text)
    shared = df.sparkSession.sparkContext.broadcast(counts.astype(np.float32))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        swaps = Swaps(shared.value)
        for b in batches:
            rows = [(k, *repair(t, swaps)) for k, t in zip(b["key"].tolist(), b["text"].tolist(), strict=True)]
            yield pd.DataFrame([(k, t, gone) for k, t, wrong, gone in rows if wrong], columns=["key", "restored", "lost"])

    kind = df.schema[key].dataType.simpleString()
    found = df.where(F.col(text).rlike(r"[^\x00-\x7f]")).select(F.col(key).alias("key"), F.col(text).alias("text")).mapInPandas(run, f"key {kind}, restored string, lost boolean")
    return found.withColumnRenamed("key", key)
