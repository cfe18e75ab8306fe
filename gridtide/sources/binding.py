"""Choosing and checking input columns. Works on names only, so no Spark job runs."""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Sequence

from gridtide import schema as S


def require_columns(available: Iterable[str], wanted: Iterable[str]) -> None:
    have = set(available)
    missing = [name for name in wanted if name not in have]
    if missing:
        raise ValueError(f"Missing required columns: {missing}")


def bind_return_periods(
    available: Iterable[str], periods: Sequence[float] = S.RETURN_PERIODS
) -> list[tuple[float, str]]:
    """Pair each return period with the first column, by name, that carries it as RP<T> or rp_<T>.

    The number must end where the digits end: 10 does not bind ``RP100``. Periods without a column
    are left out.
    """
    names = sorted(available)
    bound = []
    for period in periods:
        text = f"{period:g}"
        token = re.compile(
            rf"(?:RP{re.escape(text.zfill(3))}|RP{re.escape(text)}|rp{re.escape(text.zfill(3))}|rp_{re.escape(text)})(?!\d)"
        )
        match = next((name for name in names if token.search(name)), None)
        if match is not None:
            bound.append((float(period), match))
    return bound


def validate_periods(rows: Iterable[tuple[object, str | None]], available: Iterable[str]) -> list[tuple[float, str]]:
    """Check user-entered (return period, column) rows; rows with a blank side are skipped."""
    have = set(available)
    mapping = []
    for period, name in rows:
        period_text = "" if period is None else str(period).strip()
        name = (name or "").strip()
        if not period_text or not name:
            continue
        try:
            years = float(period_text)
        except ValueError:
            raise ValueError(f"Return period {period_text!r} is not a valid number") from None
        if not (years > 0 and math.isfinite(years)):
            raise ValueError(f"Return period {period_text!r} must be positive and finite")
        if name not in have:
            raise ValueError(f"Column {name!r} does not exist in the input")
        mapping.append((years, name))
    if len(mapping) < 2:
        raise ValueError("At least 2 return-period columns are required")
    names = [name for _, name in mapping]
    if len(names) != len(set(names)):
        raise ValueError("Duplicate column selections in the mapping")
    return mapping


def validate_mapping(
    rows: Iterable[tuple[object, str | None]],
    available: Iterable[str],
    exposure: str | None,
    vulnerability: str | None,
) -> list[tuple[float, str]]:
    """Check the (return period, column) rows and the other two columns of the risk index."""
    have = set(available)
    mapping = validate_periods(rows, have)
    for role, name in (("exposure", exposure), ("vulnerability", vulnerability)):
        if not name:
            raise ValueError(f"Select the {role} column")
    require_columns(have, [exposure, vulnerability])
    return mapping


def detect_flood_column(available: Iterable[str]) -> str | None:
    """First column, in file order, whose name suggests a flood flag."""
    return next(
        (name for name in available if any(hint in name.lower() for hint in S.FLOOD_NAME_HINTS)), None
    )


def report_columns(
    available: Iterable[str], flood: str | None, environment: Sequence[str] = S.ENVIRONMENT
) -> list[str]:
    """The columns the statistics need and the input has, in input order."""
    available = list(available)
    require_columns(available, [S.AGE])
    wanted = {S.AGE, S.POPULATION, *S.CODE_COLUMNS, *environment}
    wanted.update(S.exposure_column(year) for year in S.YEARS)
    if flood:
        wanted.add(flood)
    return [name for name in available if name in wanted]
