"""Exact sets of raw codes that can be merged, as bitmaps.

A set row holds the codes of one column that fall into one bucket: ``bits`` has a bit for each whole
number of the bucket's range. A code that is no whole number, or too large to count in ones, is a row
of its own (``odd``). However often a code occurs, and under however many keys, it is one bit, so the
report can fold dirty codes in its own state and still count them exactly.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from gridtide import schema as S
from gridtide.functions.columns import EXACT_INTEGER_LIMIT, present, quoted
from gridtide.operators.filters import valid_age
from gridtide.sources.binding import require_columns

NAME, BUCKET, BITS, ODD = "column", "bucket", "bits", "odd"


def code_sets(cells: DataFrame, columns: Sequence[str] = S.CODE_COLUMNS) -> DataFrame:
    """The distinct present codes of each column, over the cells of valid age.

    The cells are first reduced to distinct combinations of codes, which Spark combines before the
    shuffle. Columns the input lacks have no rows.
    """
    require_columns(cells.columns, [S.AGE])
    found = [name for name in columns if name in cells.columns]
    # The constant keeps the schema when the input has none of the columns.
    combos = valid_age(cells).selectExpr("1 AS one", *(f"{present(name)} AS {quoted(name)}" for name in found)).distinct()
    entries = ", ".join(f"named_struct('{NAME}', {_text(name)}, 'code', {quoted(name)})" for name in found)
    each = combos.selectExpr(f"inline(array({entries}))") if found else combos.selectExpr(f"'' AS {NAME}", "cast(NULL AS double) AS code")
    each = each.filter("code IS NOT NULL")
    whole = f"abs(code) < {EXACT_INTEGER_LIMIT!r}D AND code = floor(code)"
    ones = each.filter(whole).selectExpr(NAME, "cast(code AS bigint) AS code")
    ones = ones.groupBy(NAME, F.expr(f"bitmap_bucket_number(code) AS {BUCKET}"))
    bits = ones.agg(F.expr(f"bitmap_construct_agg(bitmap_bit_position(code)) AS {BITS}"))
    odds = each.filter(f"NOT ({whole})").select(NAME, "code").distinct()
    return _together(bits, odds.withColumnRenamed("code", ODD))


def merge_sets(sets: DataFrame) -> DataFrame:
    """The union of sets built apart."""
    bits = sets.filter(f"{ODD} IS NULL").groupBy(NAME, BUCKET).agg(F.expr(f"bitmap_or_agg({BITS}) AS {BITS}"))
    return _together(bits, sets.filter(f"{ODD} IS NOT NULL").select(NAME, ODD).distinct())


def set_size(name: str) -> str:
    """SQL text of an aggregate over merged sets: how many codes this column has."""
    size = f"CASE WHEN {NAME} <> {_text(name)} THEN 0L WHEN {ODD} IS NULL THEN bitmap_count({BITS}) ELSE 1L END"
    return f"coalesce(sum({size}), 0L)"


def _text(name: str) -> str:
    return "'" + name.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _together(bits: DataFrame, odds: DataFrame) -> DataFrame:
    odds = odds.selectExpr(NAME, f"cast(NULL AS bigint) AS {BUCKET}", f"cast(NULL AS binary) AS {BITS}", ODD)
    return bits.selectExpr(NAME, BUCKET, BITS, f"cast(NULL AS double) AS {ODD}").union(odds)
