"""Arithmetic answers judged with exact rational numbers, in Arrow batches."""

from __future__ import annotations

import ast
import operator
from collections import Counter
from collections.abc import Iterable
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalmill.functions import text as X

_OPERATIONS = {ast.Add: ("+", operator.add), ast.Sub: ("-", operator.sub), ast.Mult: ("*", operator.mul), ast.Div: ("/", operator.truediv)}
_FLAGS = ("parse_ok", "uses_numbers", "uses_no_extra_numbers", "uses_all_required_numbers", "uses_allowed_ops", "evaluates_without_exception", "valid_expression", "correct")
_SCORES = ("number_precision", "number_recall", "number_multiset_f1", "operator_precision", "operator_recall", "numeric_distance_reward", "brevity")
RESULT = T.StructType([*(T.StructField(f, T.DoubleType()) for f in (*_FLAGS, *_SCORES)), T.StructField("value", T.StringType()), T.StructField("error", T.StringType())])
#: Longer expressions count as not brief.
BRIEF = 600


class _Facts:
    """What one walk over a parsed expression finds: numbers, operators, and the first constant that is no integer."""

    def __init__(self, tree: ast.AST):
        self.numbers: list[int] = []
        self.operators: set[str] = set()
        self.fault: str | None = None
        for node in ast.walk(tree):
            if isinstance(node, ast.Constant):
                if type(node.value) is int:
                    self.numbers.append(node.value)
                elif self.fault is None:
                    self.fault = f"constant {node.value!r} is not an integer"
            elif isinstance(node, ast.BinOp):
                self.operators.add(_OPERATIONS.get(type(node.op), (type(node.op).__name__,))[0])
        if self.fault:
            self.numbers, self.operators = [], set()


def evaluate(tree: ast.AST, allowed: Iterable[str]) -> Fraction:
    """The value of integers combined by allowed operators; anything else, signs too, raises ValueError."""
    if isinstance(tree, ast.Expression):
        return evaluate(tree.body, allowed)
    if isinstance(tree, ast.Constant) and type(tree.value) is int:
        return Fraction(tree.value)
    if isinstance(tree, ast.BinOp):
        symbol, apply = _OPERATIONS.get(type(tree.op), (type(tree.op).__name__, None))
        if apply is None or symbol not in allowed:
            raise ValueError(f"operator {symbol} is not allowed")
        left, right = evaluate(tree.left, allowed), evaluate(tree.right, allowed)
        if symbol == "/" and not right:
            raise ZeroDivisionError("division by zero")
        return apply(left, right)
    raise ValueError(f"{type(tree).__name__} is not supported")


def judge(expression: str | None, numbers: Iterable[int], target: int, allowed: Iterable[str]) -> dict:
    """The components of an expression for a task, as in ``RESULT``. Never raises for any text."""
    text, required, allowed = (expression or "").strip(), list(numbers), set(allowed)
    out = dict.fromkeys((*_FLAGS, *_SCORES), 0.0) | {"value": None, "error": None, "brevity": float(len(text) <= BRIEF)}
    if not text:
        return out | {"error": "empty"}
    try:
        tree = ast.parse(text, mode="eval")
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        return out | {"error": str(e) or type(e).__name__}
    facts = _Facts(tree)
    used, need = Counter(facts.numbers), Counter(required)
    common = (used & need).total()
    precision, recall = common / max(1, used.total()), common / max(1, need.total())
    f1 = 2 * precision * recall / (precision + recall) if common else 0.0
    whole, covered, same = used <= need, need <= used, used == need
    legal_ops = facts.operators <= allowed and (bool(facts.operators) or len(required) <= 1) and not facts.fault
    share = len(facts.operators & allowed) / len(facts.operators) if facts.operators else float(len(required) <= 1)
    out |= {"parse_ok": 1.0, "number_precision": precision, "number_recall": recall, "number_multiset_f1": f1, "uses_numbers": float(same and not facts.fault), "uses_all_required_numbers": float(covered), "uses_allowed_ops": float(legal_ops), "operator_precision": share, "operator_recall": share}
    try:
        if facts.fault:
            raise ValueError(facts.fault)
        value = evaluate(tree, allowed)
        shown = str(value)
    except (ArithmeticError, ValueError, RecursionError, MemoryError) as e:
        return out | {"uses_no_extra_numbers": float(whole and bool(facts.numbers)), "error": str(e) or type(e).__name__}
    near = float(1 / (1 + abs(value - target)))
    right = same and legal_ops and value == target
    return out | {"uses_no_extra_numbers": float(whole), "evaluates_without_exception": 1.0, "valid_expression": float(same and legal_ops), "correct": float(right), "numeric_distance_reward": f1 * near, "value": shown}


@F.pandas_udf(RESULT)
def _judge(expression: pd.Series, numbers: pd.Series, target: pd.Series, allowed: pd.Series) -> pd.DataFrame:
    seen: dict[tuple, dict] = {}
    rows = []
    for e, n, t, o in zip(expression, numbers, target, allowed, strict=True):
        if n is None or o is None or t != t or t is None:
            rows.append(dict.fromkeys((*_FLAGS, *_SCORES)) | {"value": None, "error": "the task is incomplete"})
            continue
        key = (e, tuple(n), int(t), tuple(o))
        rows.append(seen.get(key) or seen.setdefault(key, judge(*key)))
    return pd.DataFrame(rows, columns=RESULT.names)


def verify(expression: Column, numbers: Column, target: Column, allowed: Column) -> Column:
    """A struct ``RESULT`` for each row; a null number, target or operator list gives nulls and an error."""
    return _judge(expression, numbers, target, allowed)


def verify_completion(completion: Column, numbers: Column, target: Column, allowed: Column) -> Column:
    """``verify`` of the answer span, or of the whole text where there is none."""
    return verify(X.extract_answer(completion)["expression"], numbers, target, allowed)


def components(completion: Column, judged: Column) -> Column:
    """All components of a completion: its tag signals, their mean as ``format``, and the judged fields."""
    tags = X.tag_signals(completion)
    flag = lambda name: tags[name].cast("double")
    return F.struct(
        flag("open").alias("contains_open_answer_tag"), flag("close").alias("contains_close_answer_tag"), flag("span").alias("has_extractable_answer_span"), ((flag("open") + flag("close") + flag("span")) / 3).alias("format"),
        judged["parse_ok"].alias("parse_ok"), judged["parse_ok"].alias("expression_parseable"), judged["uses_numbers"].alias("uses_numbers"), judged["uses_numbers"].alias("uses_allowed_numbers"),
        *(judged[c].alias(c) for c in ("number_precision", "number_recall", "number_multiset_f1", "uses_no_extra_numbers", "uses_all_required_numbers")),
        judged["uses_allowed_ops"].alias("allowed_ops"), judged["uses_allowed_ops"].alias("uses_allowed_ops"),
        *(judged[c].alias(c) for c in ("operator_precision", "operator_recall", "evaluates_without_exception", "numeric_distance_reward", "valid_expression", "brevity", "correct")),
        judged["correct"].alias("exact_correct"), judged["value"].alias("value"), judged["error"].alias("error"),
    )
