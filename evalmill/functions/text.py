"""Texts: answer spans, tags, chat messages, prompts and number lists."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(text: Column) -> Column:
    """Without any Unicode white space at either end."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)^\s+", ""), r"(?U)\s+$", "")


def extract_answer(text: Column, ignore_case: bool = True) -> Column:
    """Struct of the first answer span (the whole text where there is none), stripped, and whether there is one."""
    pattern = ("(?is)" if ignore_case else "(?s)") + "<answer>(.*?)</answer>"
    t = F.coalesce(text, F.lit(""))
    found = t.rlike(pattern)
    return F.struct(strip(F.when(found, F.regexp_extract(t, pattern, 1)).otherwise(t)).alias("expression"), found.alias("found"))


def tag_signals(text: Column) -> Column:
    """Struct of whether an opening tag, a closing tag and a whole span occur."""
    t = F.coalesce(text, F.lit(""))
    return F.struct(t.rlike("(?i)<answer>").alias("open"), t.rlike("(?i)</answer>").alias("close"), t.rlike("(?is)<answer>.*?</answer>").alias("span"))


def without_space(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+", "")


def word_count(text: Column) -> Column:
    """Words between white space; the fallback where no token count is known."""
    s = strip(F.coalesce(text, F.lit("")))
    return F.when(s == "", 0).otherwise(F.size(F.split(s, r"(?U)\s+")))


def last_message(messages: Column) -> Column:
    """The content of the last of an array of (role, content) structs; null for an empty array."""
    return F.try_element_at(messages, F.lit(-1)).getField("content")


def parse_counts(text: Column) -> Column:
    """'1, 4 8' as distinct ascending integers; other parts are left out."""
    parts = F.split(F.coalesce(text, F.lit("")), r"[\s,]+")
    return F.array_sort(F.array_distinct(F.filter(F.transform(parts, lambda x: x.try_cast("int")), lambda x: x.isNotNull())))


#: The prompts of three levels and the training answer.
PROMPTS = {
    "low": "Use the numbers [{numbers}] to make {target}. Allowed operations: {ops}. Return only one expression in <answer>...</answer>.",
    "mid": "Solve this arithmetic puzzle.\nNumbers: [{numbers}]\nTarget: {target}\nAllowed operations: {ops}\nUse every number exactly once. Do not introduce constants. Do not explain. Do not use markdown. Return only one expression inside <answer>...</answer>.",
    "high": "You are solving a verifiable arithmetic task.\n\nRules:\n1. Use each number in this multiset exactly once: [{numbers}]\n2. Use only these operators: {ops}\n3. Parentheses are allowed. No new constants are allowed.\n4. The expression must evaluate exactly to the target: {target}\n5. Put only the final expression in <answer>...</answer>.\n6. Do not include explanation, prose, or markdown outside the answer tags.\n\nBad answer example: <answer>target</answer> because it invents a constant.\nBad answer example: <answer>7</answer> unless 7 is one of the provided numbers and all other numbers are used.\nGood answer format example: <answer>(1+2)*3</answer>\n\nNow solve the task.",
}
COMPLETION = "<reasoning>One valid expression is {solution}. It evaluates to {target} while following the task constraints.</reasoning>\n<answer>{solution}</answer>"


def filled(template: str, **values: Column) -> Column:
    """A template with each {name} replaced by a text column; null if one of them is null."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*(values[p].cast("string") if i % 2 else F.lit(p) for i, p in enumerate(parts) if p or i % 2))


def prompt(numbers: Column, target: Column, ops: Column, level: str = "high") -> Column:
    """The prompt of a task at a level: low, mid or high."""
    if level not in PROMPTS:
        raise ValueError(f"unknown level {level!r}")
    return filled(PROMPTS[level], numbers=F.array_join(numbers.cast("array<string>"), ", "), target=target, ops=F.array_join(ops, " "))


def completion(solution: Column, target: Column) -> Column:
    """The training answer of a task."""
    return filled(COMPLETION, solution=solution, target=target)


def message_text(message: Column) -> Column:
    """The text of a VARIANT that is a text, a message with a content, or a list: its last message's content, else its items line by line."""
    kind = lambda v: F.coalesce(F.schema_of_variant(v), F.lit("VOID"))
    content = lambda v: F.try_variant_get(v, "$.content", "string")
    items = F.try_variant_get(message, "$", "array<variant>")
    last = F.try_element_at(items, F.lit(-1))
    listed = F.array_join(F.transform(items, lambda v: v.cast("string")), "\n")
    return (
        F.when(kind(message) == "STRING", F.try_variant_get(message, "$", "string"))
        .when(kind(message).startswith("ARRAY"), F.when(content(last).isNotNull(), content(last)).otherwise(listed))
        .when(content(message).isNotNull(), content(message))
        .otherwise(F.to_json(message))
    )


def shortened(text: Column, most: int = 240) -> Column:
    """The first characters of a text, for examples in reports."""
    return F.left(text, F.lit(most))
