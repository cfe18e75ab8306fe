"""Derived-column expressions: text such as ``[A] / max([A], 0.001)`` to Spark columns.

Python's own ``ast`` module reads the text; only the node kinds handled below are accepted, and
nothing is evaluated. The result is built from Spark functions only, so it stays inside codegen.

Some functions name an operand several times (a quotient also tests its divisor). Such an operand
becomes an intermediate column unless it is a field or a number, so that each part of the expression
is computed once and the plan grows with the length of the text.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BooleanType, NumericType, StructType

from gridtide.functions import columns as C

_REFERENCE = re.compile(r"\[([^\]]+)\]")

# Function name -> (number of arguments, builder).
FUNCTIONS = {
    "abs": (1, F.abs),
    "sqrt": (1, F.sqrt),
    "log": (1, C.log),
    "ln": (1, C.log),
    "log10": (1, C.log10),
    "exp": (1, F.exp),
    "sin": (1, F.sin),
    "cos": (1, F.cos),
    "tan": (1, F.tan),
    "ceil": (1, C.ceil),
    "floor": (1, C.floor),
    "round": (1, C.round_half_away),
    "sign": (1, F.signum),
    "min": (2, F.least),
    "max": (2, F.greatest),
}
_BINARY = {
    ast.Add: lambda a, b: a + b,
    ast.Sub: lambda a, b: a - b,
    ast.Mult: lambda a, b: a * b,
    ast.Div: C.divide,
    ast.Mod: C.floored_modulo,
    ast.Pow: C.power,
}
# These use an operand more than once.
_REPEATING_OPERATORS = (ast.Div, ast.Mod, ast.Pow)
_REPEATING_FUNCTIONS = {"log", "ln", "log10", "ceil", "floor", "round"}
_UNARY = {ast.UAdd: lambda a: a, ast.USub: lambda a: -a}


class ExpressionError(ValueError):
    pass


class Compiled(NamedTuple):
    """Intermediate columns in the order they build on each other, and the result over them."""

    steps: list[tuple[str, Column]]
    result: Column

    def over(self, frame: DataFrame) -> DataFrame:
        """The frame with the intermediate columns added at its end."""
        for name, column in self.steps:
            frame = frame.select("*", column.alias(name))
        return frame


def strip_comments(text: str) -> str:
    lines = [line for line in text.split("\n") if not line.strip().startswith("#")]
    return " ".join(lines).strip()


def check_expression(text: str, names: Iterable[str]) -> str:
    """Return the comment-free expression, or raise with the reason it is not acceptable.

    Fixed values: the four messages.
    """
    body = strip_comments(text)
    if not body:
        raise ExpressionError("Expression is empty")
    for left, right, kind in (("(", ")", "parentheses"), ("[", "]", "brackets")):
        if body.count(left) != body.count(right):
            raise ExpressionError(f"Unbalanced {kind}")
    known = set(names)
    for name in _REFERENCE.findall(body):
        if name not in known:
            raise ExpressionError(f"Unknown field: [{name}]")
    return body


def parse_expression(text: str, names: Iterable[str]) -> tuple[ast.AST, dict[str, str]]:
    """The syntax tree of a checked expression, and the field that each of its names stands for."""
    body = check_expression(text, names)
    stem = "ref"
    while stem in body:
        stem += "_"
    fields: dict[str, str] = {}

    def placeholder(match: re.Match) -> str:
        key = f"{stem}{len(fields)}"
        fields[key] = match.group(1)
        return f" {key} "

    source = _REFERENCE.sub(placeholder, body).replace("^", "**")
    try:
        return ast.parse(source.strip(), mode="eval").body, fields
    except (SyntaxError, ValueError, OverflowError, RecursionError, MemoryError) as error:
        raise ExpressionError(f"Cannot read expression: {error}") from None


def compile_expression(text: str, schema: StructType) -> Compiled:
    """Turn the text into a double column over a frame with this schema."""
    tree, fields = parse_expression(text, schema.names)
    try:
        builder = _Builder(fields, schema)
        return Compiled(builder.steps, builder.column(tree).cast("double"))
    except ExpressionError:
        raise
    except (ValueError, OverflowError, RecursionError, MemoryError) as error:
        raise ExpressionError(f"Cannot read expression: {error}") from None


def operation(node: ast.AST) -> tuple[str, tuple[ast.AST, ...]]:
    """What an inner node of a tree computes, and its operands; raises if it is not allowed."""
    if isinstance(node, ast.BinOp) and type(node.op) in _BINARY:
        return type(node.op).__name__, (node.left, node.right)
    if isinstance(node, ast.UnaryOp) and type(node.op) in _UNARY:
        return type(node.op).__name__, (node.operand,)
    if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and not node.keywords:
        name = node.func.id.lower()
        if name not in FUNCTIONS:
            raise ExpressionError(f"Unknown function: {node.func.id}")
        if len(node.args) != FUNCTIONS[name][0]:
            raise ExpressionError(f"{name} takes {FUNCTIONS[name][0]} argument(s), got {len(node.args)}")
        return name, tuple(node.args)
    raise ExpressionError(f"Not allowed in an expression: {ast.unparse(node)}")


# What ``operation`` names, as a builder of columns, and those that use an operand more than once.
BUILDERS = {kind.__name__: build for kind, build in (_BINARY | _UNARY).items()} | {n: build for n, (_, build) in FUNCTIONS.items()}
REPEATING = {kind.__name__ for kind in _REPEATING_OPERATORS} | _REPEATING_FUNCTIONS


def number_field(name: str, schema: StructType) -> Column:
    if not isinstance(schema[name].dataType, (NumericType, BooleanType)):
        raise ExpressionError(f"Field is not numeric: [{name}]")
    return C.number(name)


class _Builder:
    def __init__(self, fields: dict[str, str], schema: StructType) -> None:
        self.fields, self.schema = fields, schema
        self.steps: list[tuple[str, Column]] = []
        self.stem = "step"
        while any(name.lower().startswith(self.stem) for name in schema.names):
            self.stem += "_"

    def once(self, node: ast.AST) -> Column:
        """The column of an operand that is named more than once."""
        column = self.column(node)
        if isinstance(node, (ast.Constant, ast.Name)):
            return column
        name = f"{self.stem}{len(self.steps)}"
        self.steps.append((name, column))
        return F.col(name)

    def column(self, node: ast.AST) -> Column:
        if isinstance(node, ast.Constant) and type(node.value) in (int, float):
            return F.lit(float(node.value))
        if isinstance(node, ast.Name) and node.id in self.fields:
            return number_field(self.fields[node.id], self.schema)
        kind, operands = operation(node)
        return BUILDERS[kind](*map(self.once if kind in REPEATING else self.column, operands))
