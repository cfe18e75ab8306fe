"""Row filters. Each is a plain predicate that Spark pushes to the Parquet scan."""

from __future__ import annotations

import operator
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame

from gridtide import schema as S
from gridtide.functions.columns import field
from gridtide.sources.binding import require_columns

_COMPARISONS = {
    "==": operator.eq,
    "!=": operator.ne,
    "<": operator.lt,
    "<=": operator.le,
    ">": operator.gt,
    ">=": operator.ge,
}


HAS_VALID_AGE = f"{S.AGE} IN ({', '.join(map(str, S.AGES))})"


def valid_age(cells: DataFrame) -> DataFrame:
    return cells.filter(HAS_VALID_AGE)


def matches(criteria: Mapping[str, object]) -> Column:
    """Predicate that all criteria hold: a value, a list of values, or a pair such as (">=", 35)."""
    tests = []
    for name, wanted in criteria.items():
        if isinstance(wanted, tuple):
            comparison, value = wanted
            tests.append(_COMPARISONS[comparison](field(name), value))
        elif isinstance(wanted, (list, set, frozenset)):
            tests.append(field(name).isin(*wanted))
        else:
            tests.append(field(name) == wanted)
    return reduce(operator.and_, tests)


def filter_codes(cells: DataFrame, criteria: Mapping[str, object]) -> DataFrame:
    """Keep the rows that meet every criterion."""
    require_columns(cells.columns, criteria)
    return cells.filter(matches(criteria)) if criteria else cells
