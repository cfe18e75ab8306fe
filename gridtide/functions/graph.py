"""Several derived fields that use one another, compiled together.

The expressions of all fields become one graph in which equal parts are one node, whichever field they
stand in. Fields may be given in any order; each is computed after those it uses, and a cycle is refused.
A node that is used more than once becomes an intermediate column, so the plan holds it once; nodes that
do not depend on one another share a projection.
"""

from __future__ import annotations

import ast
from collections import Counter
from collections.abc import Mapping
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from gridtide.functions.expressions import BUILDERS, REPEATING, ExpressionError, number_field, operation, parse_expression


class CompiledFields(NamedTuple):
    """Projections of intermediate columns that build on one another, and the fields over the last."""

    levels: list[list[tuple[str, Column]]]
    results: dict[str, Column]

    def over(self, frame: DataFrame) -> DataFrame:
        for level in self.levels:
            frame = frame.select("*", *(column.alias(name) for name, column in level))
        return frame


def compile_fields(definitions: Mapping[str, str], schema: StructType) -> CompiledFields:
    """Double columns for these fields over a frame with this schema.

    In the expressions ``[name]`` is the new field of that name if there is one. In a field's own
    expression its name is the column that it replaces.
    """
    try:
        graph = _Graph(definitions, schema)
        return graph.compiled()
    except (RecursionError, OverflowError, MemoryError) as error:
        raise ExpressionError(f"Cannot read expression: {error}") from None


class _Graph:
    def __init__(self, definitions: Mapping[str, str], schema: StructType) -> None:
        self.schema = schema
        self.nodes: list[tuple[str, object, tuple[int, ...]]] = []
        self.numbers: dict[tuple, int] = {}
        names = {*schema.names, *definitions}
        trees = {}
        for name, text in definitions.items():
            known = names - {name} if name not in schema.names else names
            trees[name] = parse_expression(text, known)
        self.fields: dict[str, int] = {}
        for name in _in_order(trees):
            tree, placeholders = trees[name]
            self.fields[name] = self._node(tree, placeholders, name)
        self.outputs = {name: self.fields[name] for name in definitions}

    def _node(self, node: ast.AST, placeholders: dict[str, str], own: str) -> int:
        if isinstance(node, ast.Constant) and type(node.value) in (int, float):
            return self._number("number", float(node.value), ())
        if isinstance(node, ast.Name) and node.id in placeholders:
            name = placeholders[node.id]
            if name in self.fields and name != own:
                return self.fields[name]
            number_field(name, self.schema)
            return self._number("field", name, ())
        kind, operands = operation(node)
        return self._number(kind, None, tuple(self._node(operand, placeholders, own) for operand in operands))

    def _number(self, kind: str, value: object, operands: tuple[int, ...]) -> int:
        key = (kind, repr(value), operands)
        if key not in self.numbers:
            self.numbers[key] = len(self.nodes)
            self.nodes.append((kind, value, operands))
        return self.numbers[key]

    def compiled(self) -> CompiledFields:
        uses = Counter(self.outputs.values())
        for kind, _, operands in self.nodes:
            for operand in operands:
                uses[operand] += 2 if kind in REPEATING else 1
        stem = "step"
        while any(name.lower().startswith(stem) for name in (*self.schema.names, *self.outputs)):
            stem += "_"
        columns: list[Column] = []
        # The number of projections that must come before a node, which its operands' numbers precede.
        depth: list[int] = []
        levels: list[list[tuple[str, Column]]] = []
        for at, (kind, value, operands) in enumerate(self.nodes):
            before = max((depth[o] for o in operands), default=0)
            if kind == "number":
                column = F.lit(value)
            elif kind == "field":
                column = number_field(value, self.schema)
            else:
                column = BUILDERS[kind](*(columns[o] for o in operands))
                if uses[at] > 1:
                    if before == len(levels):
                        levels.append([])
                    levels[before].append((f"{stem}{at}", column))
                    column, before = F.col(f"{stem}{at}"), before + 1
            columns.append(column)
            depth.append(before)
        return CompiledFields(levels, {name: columns[at].cast("double") for name, at in self.outputs.items()})


def _in_order(trees: Mapping[str, tuple[ast.AST, dict[str, str]]]) -> list[str]:
    """The fields, each after those it uses."""
    order: list[str] = []
    waiting = {name: {used for used in placeholders.values() if used in trees and used != name} for name, (_, placeholders) in trees.items()}
    while waiting:
        ready = [name for name, used in waiting.items() if not used & waiting.keys()]
        if not ready:
            raise ExpressionError(f"Fields use one another in a cycle: {', '.join(_cycle(waiting))}")
        order += ready
        for name in ready:
            del waiting[name]
    return order


def _cycle(waiting: Mapping[str, set[str]]) -> list[str]:
    path = [next(iter(waiting))]
    while path[-1] not in path[:-1]:
        path.append(min(waiting[path[-1]] & waiting.keys()))
    return path[path.index(path[-1]) :]
