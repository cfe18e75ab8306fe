"""Mergeable moments: the state to keep when batches are aggregated one by one.

The sums of powers are part of the state for whoever wants them. Mean and deviation are finished from
the count, mean and squared deviations, which lose no precision to a large common offset.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from gridtide.functions.columns import field, quoted
from gridtide.operators.summary import merge, moment_value


def moment_sums(
    cells: DataFrame, keys: Sequence[str], columns: Sequence[str], exclude_zero: bool = True
) -> DataFrame:
    """Per group and column: sum, sum of squares, count, minimum, maximum, mean and squared deviations
    from the mean (m2) of the present values."""
    values = {name: moment_value(name, exclude_zero) for name in columns}
    prepared = cells.selectExpr(*map(quoted, keys), *(f"{text} AS {quoted(name)}" for name, text in values.items()))
    aggregates = []
    for name in columns:
        value = quoted(name)
        texts = {
            "sum": f"coalesce(sum({value}), 0.0D)",
            "sq_sum": f"coalesce(sum({value} * {value}), 0.0D)",
            "count": f"count({value})",
            "min": f"min({value})",
            "max": f"max({value})",
            "mean": f"avg({value})",
            "m2": f"var_pop({value}) * count({value})",
        }
        aggregates += [F.expr(f"{text} AS {quoted(f'{name}_{kind}')}") for kind, text in texts.items()]
    return prepared.groupBy(*map(quoted, keys)).agg(*aggregates)


def merge_moment_sums(parts: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Add the states of each group and finish them: mean, population std, SE, min, max, n."""
    kinds = {"n": "count", "mean": "mean", "m2": "m2", "min": "min", "max": "max"}
    state = parts.select(
        *map(field, keys), *(field(f"{c}_{kept}").alias(f"{c}__{kind}") for c in columns for kind, kept in kinds.items())
    )
    added = merge(state, keys, [f"{c}__{kind}" for c in columns for kind in kinds])
    finished = []
    for c in columns:
        n = F.nullif(field(f"{c}__n"), F.lit(0))
        std = F.sqrt(field(f"{c}__m2") / n)
        finished += [
            field(f"{c}__mean").alias(f"{c}_Mean"),
            std.alias(f"{c}_Std"),
            field(f"{c}__n").alias(f"{c}_n"),
            (std / F.sqrt(n)).alias(f"{c}_SE"),
            field(f"{c}__min").alias(f"{c}_Min"),
            field(f"{c}__max").alias(f"{c}_Max"),
        ]
    return added.select(*map(field, keys), *finished)
