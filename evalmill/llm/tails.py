"""Whether a text ends where a text can end: a sentence, a closed tag or fence, or a whole expression.

The end of a text is read as its last three symbols (letter, digit, sentence mark, operator, closed tag, ...). A
trigram model gives the likelihood that a text ends there. It is fitted on built-in texts only: each of their ends
counts as an end, each place inside them as a cut. So no row of the data can make its own end likely.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections import Counter

from pyspark.sql import Column
from pyspark.sql import functions as F

from evalmill.llm.language import SEEDS

#: What stands for no value.
PLACEHOLDERS = ("null", "none", "nil", "n/a", "na", "nan", "undefined")
#: An end of a lower likelihood is a cut.
LEAST_LIKELY = 0.5
#: As many observations as a shorter context counts for.
BACK_OFF = 0.5

_INVISIBLE = r"\s\p{Cf}\x{00A0}\x{2000}-\x{200B}\x{2028}\x{2029}\x{202F}\x{3000}\x{FEFF}"
_BREAK = rf"(?:[{_INVISIBLE}]|\.{{2,}}|…|\[(?:\.{{2,}}|…)\])+$"
_INNER_MARK = r"[.!?؟।]['\"”’»)\]*_]*\s|[。！？]|</?\w|```"
_CLOSED_TAG = r"</\w+>\s*[\p{So}\p{Sk}]*$"
_CLOSED_FENCE = r"```\s*[\p{So}\p{Sk}]*$"

#: Symbols: other, letter, digit, blank, sentence mark, closing mark, bracket, operator, opening mark, comma and the like; and
#: what only an end is: the bracket that closes a whole expression, a closed tag, a closed fence.
SYMBOLS = "^a0 .q)+(,ETF"
_SIGNS = {".": "!?؟।。！？", "+": "-*/=×÷−", "(": "[{<", ",": ";:、，", "q": "\"'”’»]_", " ": "\n\t\r"}
_FROM, _TO = "".join(_SIGNS.values()), "".join(k * len(v) for k, v in _SIGNS.items())
_LINE_ENDS = (">", "\n", ". ", "? ", "! ")

#: Built-in whole texts in parts; a text may end after a part that is marked.
_FORMS = [
    *([(s, True)] for text in SEEDS.values() for s in re.split(r"(?<=[.!?。])\s*", text) if s),
    *([(s, True)] for s in (
        "The sum of both is 12.", "This comes to 7.", "We need 64 in all!", "Is the goal 30?", "It is 250.", "That leaves 8.", "So the value is 3.5 at first and 19 at last.", "He calls it “done.”", 'She said: "That is all."',
        "(The rest is not used.)", "It is done.*", "It is _done._", "**That is it.**", "*Both are used.*", "**So it is 12.**", "(He says “this is all.”)", "[“That is 12.”]", "The word “sum” stands for 3 and 4 here.", 'Both are "used" now.', "Take [3, 4, 5] as they are, in any order; nothing else is left.", "Ça va « bien. »", "It's the others' turn, isn't it?",
        "Il fait 12.", "Das sind 9!", "答案是12。", "これで全部です！", "Ready? Yes.'", "Stop there.)", "f[x] is k_1 = 4, so x is 5.",
    )),
    *([(s, True), ("\n<answer>", False), (e, True), ("</answer>", True), (" ✓", True)] for s in ("Start with 3.", "Take both.") for e in ("(3+4)", "((3+4)*5)", "(12 - (3 * 2))", "(9+((4*2)-(6-1)))", "(8/(2+2))", "((1+2)-3)")),
    *([("```\n", False), (e, False), ("\n```", True)] for e in ("(3+4)", "x = 5", "print(7)")),
    *([("<b>", False), ("All of it", False), ("</b>", True)] for _ in range(2)),
    *([(e, True)] for e in ("(14+9)", "((14+9)*2)", "(7 - 2)", "(6 * (5 + 1))", "(12-(3*(2+1)))", "(((2+1)*4)-(8/(5-1)))", "((14 - 9) * ((2 + 1) * (6 - 3)))")),
]


def bare(text: Column) -> Column:
    """The text without the white space and ellipses that stand at its end."""
    last = F.right(text, F.lit(1))
    kept = F.when(last == ".", F.right(text, F.lit(2)) != "..").otherwise(last.rlike(r"[\p{L}\p{N}>)+*/(]"))
    return F.when(kept, text).otherwise(F.regexp_replace(text, _BREAK, ""))


def once(c: Column) -> Column:
    """The same column, evaluated in one place: the optimizer copies no expression that depends on the partition."""
    return F.when(F.spark_partition_id() >= 0, c)


def has_content(text: Column, ended: Column | None = None) -> Column:
    """Whether more than tags, fences, punctuation and a placeholder is left of a text; false for null. ``ended`` is the text when ``bare``.

    Two words in a row, or a number with an operator, settle it for nearly every text; only the rest is stripped.
    """
    core = F.lower(F.regexp_replace(bare(text) if ended is None else ended, rf"</?\w+>|```|[{_INVISIBLE}]", ""))
    words = F.regexp_replace(core, r"[^\p{L}\p{N}]", "")
    left = (~core.isin(*PLACEHOLDERS) & ~words.isin("", *PLACEHOLDERS)) | core.rlike(r"^[(+*/<\[{]+$")
    return F.coalesce(F.when(text.rlike(r"[\p{L}\p{N}]\s[\p{L}\p{N}]|[0-9][-+*/)]"), F.lit(True)).otherwise(left), F.lit(False))


#: What stands for letters and digits.
_ASCII = "".join(map(chr, (*range(65, 91), *range(97, 123), *range(48, 58))))


def _count(t: Column, part: str) -> Column:
    return ((F.length(t) - F.length(F.replace(t, F.lit(part), F.lit("")))) / len(part)).cast("int")


def end_symbols(text: str) -> str:
    """The last three symbols of a bare text, for fitting; ``end_code`` says the same inside the engine."""
    line = text
    for mark in _LINE_ENDS:
        line = line.rsplit(mark, 1)[-1]
    stripped = text.rstrip("✓✔ ")
    if re.search(r"</\w+>$", stripped):
        return "^^T"
    if stripped.endswith("```"):
        return "^^F" if text.count("```") % 2 == 0 else "^^^"
    if text.endswith(")") and line.count("(") == line.count(")"):
        return "^^E"

    def symbol(c: str) -> str:
        kind = unicodedata.category(c)[0]
        c = _TO[_FROM.index(c)] if c in _FROM else "a" if kind in "LM" else "0" if kind == "N" else c
        return c if c in SYMBOLS[1:10] else "^"

    return "".join(map(symbol, text[-3:])).rjust(3, "^")


@functools.cache
def likelihoods() -> dict[str, float]:
    """The likelihood that a text ends after each three symbols, backed off to two, one and none that are known better."""
    seen, ends = Counter(), Counter()
    for form in _FORMS:
        text, stops = "", set()
        for part, stop in form:
            text += part
            if stop:
                stops.add(len(text))
        for i in range(1, len(text) + 1):
            if not text[i - 1].isspace():
                code = end_symbols(text[:i])
                for k in range(4):
                    seen[code[k:]] += 1
                    ends[code[k:]] += i in stops
    out = {"": ends[""] / seen[""]}
    for k in range(1, 4):
        for code in (a + b for a in SYMBOLS for b in list(out) if len(b) == k - 1):
            out[code] = (ends[code] + BACK_OFF * out[code[1:]]) / (seen[code] + BACK_OFF)
    return {c: p for c, p in out.items() if len(c) == 3}


def end_code(t: Column) -> Column:
    """The last three symbols of a ``bare`` text, as ``end_symbols``."""
    line = t
    for mark in _LINE_ENDS:
        line = F.substring_index(line, mark, -1)
    end, tail = F.right(t, F.lit(1)), F.right(t, F.lit(3))
    letters = F.when(F.octet_length(tail) > F.length(tail), F.regexp_replace(F.regexp_replace(tail, r"[\p{L}\p{M}]", "a"), r"\p{N}", "0")).otherwise(tail)
    symbols = F.lpad(F.regexp_replace(F.translate(letters, _ASCII + _FROM, "a" * 52 + "0" * 10 + _TO), r"[^a0 .q)+(,`]", "^"), 3, "^")
    return (
        F.when(end.rlike(r"[\p{L}\p{N}.]"), symbols)
        .when(end == ")", F.when(_count(line, "(") == _count(line, ")"), "^^E").otherwise(symbols))
        .when(t.rlike(_CLOSED_TAG), "^^T")
        .when(t.rlike(_CLOSED_FENCE), F.when(_count(t, "```") % 2 == 0, "^^F").otherwise("^^^"))
        .otherwise(symbols)
    )


def unfinished(text: Column) -> Column:
    """``unfinished_bare`` of a text that may still have white space or an ellipsis at its end."""
    return unfinished_bare(bare(text))


def unfinished_bare(t: Column) -> Column:
    """Whether a text stops where texts do not end: inside a word, number, expression, tag or sentence; false for null and empty texts.

    An ellipsis at the end changes nothing. A text may end with a finished sentence, a closed tag or fence, or an
    expression whose brackets all close, also where the tag or fence around it is still open.
    """
    ends = [code for code, p in likelihoods().items() if p >= LEAST_LIKELY]
    return F.coalesce((t != "") & ~end_code(t).isin(ends), F.lit(False))


def shows_ends(t: Column) -> Column:
    """Whether a ``bare`` text shows by itself how it ends: it is whole, or it is open and no plain run of words.

    An open end is plain only after a letter or digit, in a text without a sentence mark before other text, a tag, a
    fence or a bracket that is still open: only such a text may be whole but for its last mark. False for null.
    """
    return F.coalesce((t != "") & (~F.right(t, F.lit(1)).rlike(r"[\p{L}\p{N}]") | t.rlike(_INNER_MARK) | (_count(t, "(") > _count(t, ")"))), F.lit(False))
