"""Field management: derive, add, drop, rename, order and move columns.

Every operator is one ``select`` over exact names checked in Python, so results do not depend on the
session's case sensitivity.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import NumericType

from gridtide.functions.columns import field
from gridtide.functions.expressions import compile_expression
from gridtide.functions.graph import compile_fields
from gridtide.plans.session import SETTINGS
from gridtide.sources.binding import require_columns

# Offered type name -> Spark type.
FIELD_TYPES = {
    "Float64": "double",
    "Float32": "float",
    "Int64": "bigint",
    "Int32": "int",
    "String": "string",
    "Boolean": "boolean",
}
_INTEGER_BITS = {"Int64": 64, "Int32": 32}


def _new_name(name: str) -> str:
    name = name.strip()
    if not name:
        raise ValueError("Field name cannot be empty")
    return name


def _check_case(cells: DataFrame, names: Sequence[str]) -> None:
    """Names that differ only in case could never be told apart again in a case-insensitive session."""
    if cells.sparkSession.conf.get("spark.sql.caseSensitive") == "true":
        return
    folded = [name.lower() for name in names]
    repeated = sorted({name for name in names if folded.count(name.lower()) > 1})
    if repeated:
        raise ValueError(f"Names differ only in case, set spark.sql.caseSensitive=true: {repeated}")


def put_columns(cells: DataFrame, new: Mapping[str, Column], names: Sequence[str] | None = None) -> DataFrame:
    """Replace columns of these exact names in place and append the others; ``names``: columns to keep."""
    names = cells.columns if names is None else names
    kept = [new[name].alias(name) if name in new else field(name) for name in names]
    extra = [name for name in new if name not in names]
    _check_case(cells, [*names, *extra])
    return cells.select(*kept, *(new[name].alias(name) for name in extra))


# A size of methods, and what Spark has for it where nobody has chosen one.
METHOD_LIMIT, METHOD_LIMIT_UNSET = "spark.sql.codegen.hugeMethodLimit", "65535"


def _small_methods(spark: SparkSession) -> None:
    """Formulas with intermediate columns, fused into one method, soon exceed what the JVM compiles. The
    session setting that avoids it (plans/session.py) changes no result; one that was chosen stays."""
    if spark.conf.get(METHOD_LIMIT) == METHOD_LIMIT_UNSET:
        spark.conf.set(METHOD_LIMIT, SETTINGS[METHOD_LIMIT])


def derive_field(cells: DataFrame, name: str, expression: str) -> DataFrame:
    """Add or replace a double column computed from an expression text."""
    compiled = compile_expression(expression, cells.schema)
    if compiled.steps:
        _small_methods(cells.sparkSession)
    return put_columns(compiled.over(cells), {_new_name(name): compiled.result}, cells.columns)


def derive_fields(cells: DataFrame, definitions: Mapping[str, str]) -> DataFrame:
    """Add or replace several double columns whose expressions may use one another, in any order.

    ``[name]`` is the new field where there is one; only in its own expression it is the column that
    it replaces. Parts that several fields share are computed once.
    """
    named = {_new_name(name): text for name, text in definitions.items()}
    if len(named) < len(definitions):
        raise ValueError("A field is defined twice")
    compiled = compile_fields(named, cells.schema)
    if compiled.levels:
        _small_methods(cells.sparkSession)
    return put_columns(compiled.over(cells), compiled.results, cells.columns)


def add_constant_field(
    cells: DataFrame, name: str, dtype: str = "Float64", default: str | None = "null"
) -> DataFrame:
    """Add or replace a typed constant. Blank, ``null`` and unreadable defaults give nulls."""
    dtype = dtype if dtype in FIELD_TYPES else "Float64"
    value = _constant(dtype, (default or "").strip())
    return put_columns(cells, {_new_name(name): F.lit(value).cast(FIELD_TYPES[dtype])})


def _constant(dtype: str, text: str) -> object:
    if not text or text.lower() == "null":
        return None
    if dtype == "String":
        return text
    if dtype == "Boolean":
        return text.lower() in ("true", "1")
    try:
        if dtype in _INTEGER_BITS:
            value = int(text)
            limit = 2 ** (_INTEGER_BITS[dtype] - 1)
            return value if -limit <= value < limit else None
        return float(text)
    except ValueError:
        return None


def drop_fields(cells: DataFrame, names: Sequence[str]) -> DataFrame:
    require_columns(cells.columns, names)
    gone = set(names)
    return cells.select(*(field(name) for name in cells.columns if name not in gone))


def rename_fields(cells: DataFrame, renames: Mapping[str, str]) -> DataFrame:
    """Rename all at once, so that swapping two names works."""
    require_columns(cells.columns, renames)
    names = [_new_name(renames[old]) if old in renames else old for old in cells.columns]
    repeated = sorted({name for name in names if names.count(name) > 1})
    if repeated:
        raise ValueError(f"Names already exist: {repeated}")
    _check_case(cells, names)
    return cells.select(*(field(old).alias(new) for old, new in zip(cells.columns, names)))


def reorder_fields(cells: DataFrame, order: Sequence[str]) -> DataFrame:
    """Keep these fields in this order; fields left out are dropped."""
    require_columns(cells.columns, order)
    if len(set(order)) != len(order):
        raise ValueError("A field appears twice in the order")
    return cells.select(*(field(name) for name in order))


def manage_fields(
    cells: DataFrame, renames: Mapping[str, str] | None = None, order: Sequence[str] | None = None
) -> DataFrame:
    """Rename first, then order by the new names."""
    if renames:
        cells = rename_fields(cells, renames)
    return reorder_fields(cells, order) if order else cells


def order_fields_az(cells: DataFrame) -> DataFrame:
    return reorder_fields(cells, sorted(cells.columns, key=str.lower))


def order_fields_by_type(cells: DataFrame) -> DataFrame:
    """Numeric fields first, each part from A to Z."""
    numeric = {f.name for f in cells.schema if isinstance(f.dataType, NumericType)}
    return reorder_fields(cells, sorted(cells.columns, key=lambda n: (n not in numeric, n.lower())))


def move_field(cells: DataFrame, name: str, where: str) -> DataFrame:
    """Move one field to the ``top`` or ``bottom``, or one place ``up`` or ``down``."""
    require_columns(cells.columns, [name])
    others = [other for other in cells.columns if other != name]
    at = cells.columns.index(name)
    targets = {"top": 0, "up": max(at - 1, 0), "down": min(at + 1, len(others)), "bottom": len(others)}
    if where not in targets:
        raise ValueError(f"where must be one of {sorted(targets)}")
    others.insert(targets[where], name)
    return reorder_fields(cells, others)
