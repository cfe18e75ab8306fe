"""Partial aggregates of grid cells, and their roll-up to report categories.

``summarise`` reads the cells once and groups them by age and raw codes. Spark combines before the
shuffle, so a code that holds a third of all cells still arrives as one partial row per task. The
result has at most (ages x code combinations) rows. Labels are joined to that, never to the cells,
and the ``All`` rows come from it too.

A state row carries ``cells``, ``flooded``, ``<column>__sum`` per total and, per moment column, the
mergeable ``<column>__n/__mean/__m2`` (m2: sum of squared deviations from the mean), with
``extremes`` also ``__min`` and ``__max``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from gridtide import schema as S
from gridtide.functions.columns import equals_one, present, quoted
from gridtide.operators.filters import HAS_VALID_AGE, valid_age
from gridtide.operators.labels import Labels, with_label
from gridtide.sources.binding import require_columns

CATEGORY = "Category"
IS_ALL = "Is_All"
CELLS = "cells"
FLOODED = "flooded"
# The rows of one key meet in so many groups first.
SALTS = 32
# Moments of a list of (n, mean, m2) with n > 0; null without any.
_FOLD = (
    "aggregate({rows}, cast(NULL AS struct<n: bigint, mean: double, m2: double>), (a, x) -> if(a IS NULL, x,"
    " named_struct('n', a.n + x.n, 'mean', a.mean + (x.mean - a.mean) * (x.n / (a.n + x.n)),"
    " 'm2', a.m2 + x.m2 + (x.mean - a.mean) * (x.mean - a.mean) * a.n * (x.n / (a.n + x.n)))))"
)


def moment_value(name: str, exclude_zero: bool) -> str:
    return f"nullif({present(name)}, 0.0D)" if exclude_zero else present(name)


def _moment_aggregates(name: str, extremes: bool) -> list[str]:
    value = quoted(name)
    aggregates = {
        "n": f"count({value})",
        "mean": f"avg({value})",
        "m2": f"var_pop({value}) * count({value})",
    }
    if extremes:
        aggregates |= {"min": f"min({value})", "max": f"max({value})"}
    return [f"{text} AS {part(name, kind)}" for kind, text in aggregates.items()]


def summarise(
    cells: DataFrame,
    dims: Sequence[S.Dimension] = (),
    *,
    flood: str | None = None,
    moments: Sequence[str] = (),
    totals: Sequence[str] = (),
    exclude_zero: bool = True,
    extremes: bool = False,
    keep_invalid: bool = False,
    fold_codes: bool | None = None,
) -> DataFrame:
    """Group cells by age and the codes of ``dims``; columns the input lacks are left out.

    Cells of no valid age are dropped, or with ``keep_invalid`` counted in one row of null keys.
    Codes that no label knows are folded into null, and country codes into whole numbers, so that a
    dirty code column makes no more groups than its dictionary has. ``run_summary`` counts raw codes,
    which ``keep_invalid`` or ``fold_codes=False`` keeps.
    """
    require_columns(cells.columns, [S.AGE])
    have = set(cells.columns)
    keys = {S.AGE: f"cast({S.AGE} AS int)"}
    keys |= {dim.column: _code(dim, not keep_invalid if fold_codes is None else fold_codes) for dim in dims if dim.column in have}
    if keep_invalid:
        keys = {name: f"CASE WHEN {HAS_VALID_AGE} THEN {key} END" for name, key in keys.items()}
    else:
        cells = valid_age(cells)
    moments = [name for name in moments if name in have]
    totals = [name for name in totals if name in have]
    # Values are cleaned in a projection of their own, so each is computed once per cell and not
    # once per aggregate that uses it.
    values = keys | {name: moment_value(name, exclude_zero) for name in moments}
    values |= {f"{name}__sum": f"coalesce({present(name)}, 0.0D)" for name in totals}
    prepared = [F.expr(f"{text} AS {quoted(name)}") for name, text in values.items()]
    aggregates = [f"count(1) AS {CELLS}"]
    if flood is not None and flood in have:
        prepared.append(equals_one(flood, cells.schema[flood].dataType).alias(FLOODED))
        aggregates.append(f"count_if({FLOODED}) AS {FLOODED}")
    for name in moments:
        aggregates += _moment_aggregates(name, extremes)
    aggregates += [f"sum({part(name, 'sum')}) AS {part(name, 'sum')}" for name in totals]
    return cells.select(*prepared).groupBy(*map(quoted, keys)).agg(*map(F.expr, aggregates))


def _code(dim: S.Dimension, fold: bool) -> str:
    code = present(dim.column)
    if not fold:
        return code
    if dim.labels is None:
        return f"cast(try_cast({code} AS bigint) AS double)"
    return f"CASE WHEN {code} IN ({', '.join(f'{known}D' for known in dim.labels)}) THEN {code} END"


def part(name: str, kind: str) -> str:
    """State column of one measure, quoted for SQL text."""
    return quoted(f"{name}__{kind}")


def merge(state: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Combine the state rows that share ``keys``, for these state columns.

    Sums and extremes combine before the shuffle. Moments are combined in a tree of two levels: first
    among the rows of a key that share one of ``SALTS`` numbers, then among these results, so that no
    task sees all rows of a key. Each step moves the mean by the difference of the two and adds its
    square to the squared deviations, so values with a large common offset lose no precision.
    """
    moments = [name for name, _, kind in (column.rpartition("__") for column in columns) if kind == "m2"]
    if moments:
        salt = f"pmod(xxhash64({', '.join(map(quoted, state.columns))}), {SALTS}L) AS __salt"
        state = _combined(state.selectExpr("*", salt), [*keys, "__salt"], columns, moments)
    return _combined(state, keys, columns, moments)


def _combined(state: DataFrame, keys: Sequence[str], columns: Sequence[str], moments: Sequence[str]) -> DataFrame:
    parts = {part(name, kind) for name in moments for kind in ("n", "mean", "m2")}
    plain = {quoted(c): c.rpartition("__")[2] for c in columns if quoted(c) not in parts}
    aggregates = [f"{kind if kind in ('min', 'max') else 'sum'}({c}) AS {c}" for c, kind in plain.items()]
    for name in moments:
        n, mean, m2 = (part(name, kind) for kind in ("n", "mean", "m2"))
        rows = f"collect_list(named_struct('n', cast({n} AS bigint), 'mean', {mean}, 'm2', {m2})) FILTER (WHERE {n} > 0)"
        aggregates.append(f"{_FOLD.format(rows=rows)} AS {part(name, 'all')}")
    grouped = state.groupBy(*map(quoted, keys)).agg(*map(F.expr, aggregates))
    shown = {quoted(c): quoted(c) for c in columns}
    for name in moments:
        whole = part(name, "all")
        shown |= {part(name, "n"): f"coalesce({whole}.n, 0L)", part(name, "mean"): f"{whole}.mean", part(name, "m2"): f"{whole}.m2"}
    return grouped.selectExpr(*map(quoted, keys), *(f"{shown[quoted(c)]} AS {quoted(c)}" for c in columns))


def by_category(
    state: DataFrame,
    dim: S.Dimension,
    columns: Sequence[str],
    labels: Labels = None,
    *,
    all_without_dim: bool = False,
) -> DataFrame:
    """State per (category, age): one ``All`` row per age over every cell, plus the labelled groups.

    ``Is_All`` tells the two apart; a null label joins no group but still counts in ``All``. Without
    the dimension's column the result is empty, or only ``All`` with ``all_without_dim``.
    """
    labelled = _labelled(state, dim, columns, labels, keep_rows=all_without_dim)
    memberships = (
        f"inline(array(struct(true AS {IS_ALL}, 'All' AS {CATEGORY}),"
        f" struct(false AS {IS_ALL}, __group AS {CATEGORY})))"
    )
    members = labelled.selectExpr("*", memberships).filter(f"{CATEGORY} IS NOT NULL")
    return merge(members, [IS_ALL, CATEGORY, S.AGE], columns)


def by_label(state: DataFrame, dim: S.Dimension, columns: Sequence[str], labels: Labels = None) -> DataFrame:
    """State per label over all valid ages, without ``All``."""
    labelled = _labelled(state, dim, columns, labels).withColumnRenamed("__group", CATEGORY)
    return merge(labelled.filter(f"{CATEGORY} IS NOT NULL"), [CATEGORY], columns)


def _labelled(
    state: DataFrame, dim: S.Dimension, columns: Sequence[str], labels: Labels, keep_rows: bool = False
) -> DataFrame:
    """The needed state columns of valid ages with the label as ``__group``."""
    has_dim = dim.column in state.columns
    keys = [S.AGE, dim.column] if has_dim else [S.AGE]
    rows = state.selectExpr(*map(quoted, [*keys, *columns])).filter(f"{quoted(S.AGE)} IS NOT NULL")
    if has_dim:
        return with_label(rows, dim, labels, "__group")
    rows = rows.selectExpr("*", "cast(NULL AS string) AS __group")
    return rows if keep_rows else rows.filter("false")
