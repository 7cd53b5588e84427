"""Exact decimal arithmetic beyond 38 digits, in Arrow batches: a restricted evaluator and an influence test."""

from __future__ import annotations

import ast
import decimal
import re

from pyspark.sql import Column

from tracelark.functions.batches import batched

# Limits of the grammar, and the ways in which an operand is moved to see whether it matters.
PRECISION, MAX_CHARS, MAX_NODES = 50, 500, 100
MAX_NUMBER_CHARS, MAX_EXPONENT = 256, 10_000
MAX_POWER, MAX_PLACES = 100, 28
NUDGES = (
    lambda x: x + 1,
    lambda x: x - 1,
    lambda x: x + max(abs(x), decimal.Decimal(1)),
    lambda x: x - max(abs(x), decimal.Decimal(1)),
    lambda x: x * 2 + 1,
    lambda x: x * decimal.Decimal("1.137") + decimal.Decimal("0.731"),
)

_NUMBER = re.compile(r"([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)(%?)")
_BINARY = {
    ast.Add: decimal.Decimal.__add__,
    ast.Sub: decimal.Decimal.__sub__,
    ast.Mult: decimal.Decimal.__mul__,
    ast.Div: decimal.Decimal.__truediv__,
    ast.Mod: decimal.Decimal.__mod__,
}


def parse(text) -> tuple[decimal.Decimal, bool] | None:
    """A number and whether it is a percentage; None for anything else.

    Outer white space does not count. Numbers of more than 256 characters or beyond 10 to the 10,000th are none."""
    if text is None:
        return None
    t = str(text).strip()
    m = _NUMBER.fullmatch(t) if len(t) <= MAX_NUMBER_CHARS else None
    if not m:
        return None
    try:
        d = decimal.Decimal(m[1])
    except decimal.DecimalException:
        return None
    return (d, bool(m[2])) if d.is_finite() and abs(d.adjusted()) <= MAX_EXPONENT else None


def _whole(d: decimal.Decimal, most: int) -> int:
    if d != d.to_integral_value() or abs(d) > most:
        raise ValueError("range")
    return int(d)


def evaluate(expression: str, operands: dict[str, decimal.Decimal]) -> decimal.Decimal:
    """Value of an expression of names, integers, + - * / %, integer powers, abs and round, with 50 digits.

    Outer white space does not count. The result may be of any size; ValueError where there is none."""
    if not isinstance(expression, str) or not expression.strip() or len(expression) > MAX_CHARS:
        raise ValueError("length")
    try:
        tree = ast.parse(expression.strip(), mode="eval")
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        raise ValueError("syntax") from e
    if sum(1 for _ in ast.walk(tree)) > MAX_NODES:
        raise ValueError("nodes")

    def value(n):
        match n:
            case ast.Constant(value=int(v)) if not isinstance(v, bool) and (p := parse(v)):
                return p[0]
            case ast.Name(id=name) if name in operands:
                return operands[name]
            case ast.UnaryOp(op=ast.USub(), operand=x):
                return -value(x)
            case ast.UnaryOp(op=ast.UAdd(), operand=x):
                return value(x)
            case ast.BinOp(left=a, op=ast.Pow(), right=b):
                base = value(a)
                return base ** _whole(value(b), MAX_POWER)
            case ast.BinOp(left=a, op=op, right=b) if type(op) in _BINARY:
                return _BINARY[type(op)](value(a), value(b))
            case ast.Call(func=ast.Name(id="abs"), args=[x], keywords=[]):
                return abs(value(x))
            case ast.Call(func=ast.Name(id="round"), args=[x], keywords=[]):
                return decimal.Decimal(round(value(x)))
            case ast.Call(func=ast.Name(id="round"), args=[x, places], keywords=[]):
                d = value(x)
                return round(d, _whole(value(places), MAX_PLACES))
        raise ValueError("form")

    with decimal.localcontext() as c:
        c.prec = PRECISION
        try:
            out = value(tree.body)
        except (ArithmeticError, RecursionError) as e:
            raise ValueError("arithmetic") from e
    if not out.is_finite():
        raise ValueError("range")
    return out


def influences(expression: str, operands: dict[str, decimal.Decimal], name: str, base: decimal.Decimal) -> bool:
    """Whether moving one operand, in any of a few fixed ways, changes the result.

    A move that leaves the operand as it is, or with which the expression has no value, tells nothing."""
    x = operands[name]
    for nudge in NUDGES:
        try:
            y = nudge(x)
            if y != x and evaluate(expression, operands | {name: y}) != base:
                return True
        except (ArithmeticError, ValueError):
            continue
    return False


def _calculated(expression, operands):
    numbers = {k: parse(v) for k, v in dict(operands or {}).items()}
    if any(v is None for v in numbers.values()):
        return None, None
    named = {k: v[0] for k, v in numbers.items()}
    try:
        r = evaluate(expression, named)
    except ValueError:
        return None, None
    with decimal.localcontext() as c:
        c.prec = max(PRECISION, len(r.as_tuple().digits))
        shown = format(r.normalize(), "f") if abs(r.adjusted()) <= MAX_NUMBER_CHARS else str(r.normalize())
    return shown, sorted(k for k in named if not influences(expression, named, k, r))


def calculated(expression: Column, operands: Column) -> Column:
    """struct<result STRING, idle ARRAY<STRING>> of an expression and its operands map<string,string>.

    result is null where expression or operands are invalid, in scientific notation beyond 256 digits; idle names
    operands without influence on it."""
    return batched(_calculated, "result string, idle array<string>", ["result", "idle"])(expression, operands)
