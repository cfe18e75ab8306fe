"""Row order in files, so that filters skip most of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from gridtide import schema as S
from gridtide.functions.columns import field, present, quoted
from gridtide.sources.binding import require_columns

CODES = (S.AGE, *S.CODE_COLUMNS)
# Bits of the space-filling order in all. Values outside these quantiles share the outermost steps.
_BITS, _LOW, _HIGH = 60, 0.001, 0.999


def clustered(cells: DataFrame, columns: Sequence[str] = CODES) -> DataFrame:
    """The rows along a space-filling curve of these numeric columns.

    Each column is cut into equal steps between its quantiles, and the steps' bits are interleaved, so
    that rows that are close in all columns are close in the order and a stretch of it spans few values of
    each. Spark deals the order out by ranges. A hash of the whole row follows the curve, so that
    cells that share all codes, however many, are spread over several files. Missing values come first.
    """
    require_columns(cells.columns, columns)
    bits = _BITS // len(columns)
    finite = "CASE WHEN abs({0}) < double('infinity') THEN {0} END"
    quantiles = [F.expr(f"percentile_approx({finite.format(present(name))}, array({_LOW}D, {_HIGH}D), 1000)") for name in columns]
    bounds = cells.agg(*(q.alias(f"q{at}") for at, q in enumerate(quantiles))).first()
    steps = [_step(name, *(found or (0.0, 0.0)), bits) for name, found in zip(columns, bounds)]
    names = [f"__step{at}" for at in range(len(columns))]
    # Ids of the steps first, so that each is computed once and not once per bit.
    stepped = cells.selectExpr("*", *(f"{step} AS {name}" for step, name in zip(steps, names)))
    parts = [
        f"shiftleft(shiftright({name}, {bit}) & 1L, {bit * len(names) + at})" for at, name in enumerate(names) for bit in range(bits)
    ]
    curve = f"{' | '.join(parts)} AS __curve"
    spread = f"xxhash64({', '.join(map(quoted, cells.columns))}) AS __spread"
    placed = stepped.selectExpr(*map(quoted, cells.columns), curve, spread)
    order = ["__curve", "__spread"]
    return placed.repartitionByRange(*order).sortWithinPartitions(*order).select(*map(field, cells.columns))


def _step(name: str, low: float, high: float, bits: int) -> str:
    """SQL text of a column's step, from 1 to 2^bits - 1, or 0 where the value is missing."""
    most = (1 << bits) - 2
    scale = most / (high - low) if high > low else 0.0
    place = f"least(greatest(({present(name)} - {low!r}D) * {scale!r}D, 0.0D), {float(most)!r}D)"
    return f"coalesce(cast({place} AS bigint) + 1L, 0L)"
