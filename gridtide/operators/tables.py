"""Report tables, each computed from a ``summarise`` state.

Give every function either the state of one dimension or the shared state of the whole report.
Ratios and moments without a value are null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from gridtide import schema as S
from gridtide.functions.columns import field, quoted
from gridtide.operators.distinct import set_size
from gridtide.operators.labels import Labels, dictionary
from gridtide.operators.rank import ranked
from gridtide.operators.summary import CATEGORY, CELLS, FLOODED, IS_ALL, by_category, by_label, merge, part

_POPULATION, _EXPOSED = f"{S.POPULATION}__sum", f"{S.EXPOSED_POPULATION}__sum"


def _report_order(table: DataFrame, measures: Sequence[str]) -> DataFrame:
    """``All`` first, then categories by code point, then age."""
    ordered = table.orderBy(F.col(IS_ALL).desc(), CATEGORY, S.AGE)
    return ordered.selectExpr(CATEGORY, S.AGE, *measures)


def _percent(part_: str, whole: str, otherwise: str) -> str:
    return f"CASE WHEN {whole} > 0 THEN {part_} / {whole} * 100.0D ELSE {otherwise} END"


def _area(count: str) -> str:
    return f"{count} * {S.CELL_AREA_KM2}D"


def area_table(state: DataFrame) -> DataFrame:
    """Cells and area by development status and age, with each age's share of its category."""
    groups = by_category(state, S.DEVELOPMENT, [CELLS], all_without_dim=True)
    total = f"sum({CELLS}) OVER (PARTITION BY {IS_ALL}, {CATEGORY})"
    groups = groups.selectExpr("*", f"{_percent(CELLS, total, '0.0D')} AS share")
    return _report_order(
        groups, [f"{CELLS} AS Grid_Count", f"{_area(CELLS)} AS Area_km2", "share AS Ratio_Percent"]
    )


def flood_table(state: DataFrame, dim: S.Dimension, labels: Labels = None) -> DataFrame:
    """Flooded cells, area and ratio; empty without a flood column."""
    if FLOODED not in state.columns:
        state = state.selectExpr("*", f"0L AS {FLOODED}").filter("false")
    return _report_order(
        by_category(state, dim, [CELLS, FLOODED], labels),
        [
            f"{CELLS} AS Total_Grid_Count",
            f"{FLOODED} AS Flooded_Grid_Count",
            f"{_area(CELLS)} AS Total_Area_km2",
            f"{_area(FLOODED)} AS Flooded_Area_km2",
            f"{_percent(FLOODED, CELLS, '0.0D')} AS Flood_Area_Ratio_Percent",
        ],
    )


def moments_table(
    state: DataFrame,
    dim: S.Dimension,
    columns: Sequence[str],
    labels: Labels = None,
    *,
    extremes: bool = False,
) -> DataFrame:
    """Mean, population standard deviation, n and standard error per column, or also min and max.

    Columns the input lacks get n = 0 and no values; without any of them there are no rows.
    """
    kinds = ("n", "mean", "m2", "min", "max") if extremes else ("n", "mean", "m2")
    lacking = [c for c in columns if f"{c}__m2" not in state.columns]
    if lacking:
        empty = {kind: "0L" if kind == "n" else "cast(NULL AS double)" for kind in kinds}
        state = state.selectExpr("*", *(f"{value} AS {part(c, kind)}" for c in lacking for kind, value in empty.items()))
    if len(lacking) == len(columns):
        state = state.filter("false")
    measures = []
    for c in columns:
        n, m2 = f"nullif({part(c, 'n')}, 0)", part(c, "m2")
        measures += [
            f"{part(c, 'mean')} AS {quoted(f'{c}_Mean')}",
            f"sqrt({m2} / {n}) AS {quoted(f'{c}_Std')}",
            f"{part(c, 'n')} AS {quoted(f'{c}_n')}",
            f"sqrt({m2} / {n}) / sqrt({n}) AS {quoted(f'{c}_SE')}",
        ]
        if extremes:
            measures += [f"{part(c, 'min')} AS {quoted(f'{c}_Min')}", f"{part(c, 'max')} AS {quoted(f'{c}_Max')}"]
    needed = [f"{c}__{kind}" for c in columns for kind in kinds]
    return _report_order(by_category(state, dim, needed, labels), measures)


def environment_table(
    state: DataFrame, dim: S.Dimension, labels: Labels = None, columns: Sequence[str] = S.ENVIRONMENT
) -> DataFrame:
    return moments_table(state, dim, columns, labels)


def risk_table(state: DataFrame, dim: S.Dimension, labels: Labels = None) -> DataFrame:
    return moments_table(state, dim, [S.RISK], labels, extremes=True)


def _with_population(state: DataFrame) -> DataFrame:
    """Both population columns are needed; without them there are no rows."""
    lacking = [name for name in (_POPULATION, _EXPOSED) if name not in state.columns]
    if not lacking:
        return state
    return state.selectExpr("*", *(f"0.0D AS {quoted(name)}" for name in lacking)).filter("false")


_EXPOSURE_MEASURES = (
    f"{_POPULATION} AS Total_Population",
    f"{_EXPOSED} AS Total_Exposure",
    f"{_percent(_EXPOSED, _POPULATION, 'NULL')} AS Exposure_Ratio_Percent",
)


def exposure_global_table(state: DataFrame) -> DataFrame:
    """Population, exposed population and ratio per age."""
    valid = _with_population(state).filter(f"{S.AGE} IS NOT NULL")
    by_age = merge(valid, [S.AGE], [_POPULATION, _EXPOSED])
    return by_age.selectExpr(S.AGE, *_EXPOSURE_MEASURES).orderBy(S.AGE)


def exposure_table(state: DataFrame, dim: S.Dimension, labels: Labels = None) -> DataFrame:
    groups = by_category(_with_population(state), dim, [_POPULATION, _EXPOSED], labels)
    return _report_order(groups, _EXPOSURE_MEASURES)


def _year_sums(state: DataFrame) -> dict[str, str]:
    """Year -> state column, for the years the input has."""
    have = set(state.columns)
    named = {str(year): f"{S.exposure_column(year)}__sum" for year in S.YEARS}
    return {year: name for year, name in named.items() if name in have}


def country_year_table(state: DataFrame, labels: Labels = None) -> DataFrame:
    """Exposed population per country and year, one column per year the input has."""
    sums = _year_sums(state)
    groups = by_label(state, S.COUNTRY, list(sums.values()) or [CELLS], labels)
    return groups.selectExpr(f"{CATEGORY} AS Country", *(f"{name} AS `{year}`" for year, name in sums.items()))


def years_to_rows(wide: DataFrame, key: str) -> DataFrame:
    """One row per key and year."""
    years = [name for name in wide.columns if name != key]
    if not years:
        return wide.select(key, F.lit(0).alias("Year"), F.lit(0.0).alias("Total")).filter("false")
    long = wide.unpivot([key], years, "Year", "Total")
    return long.select(key, F.col("Year").cast("int").alias("Year"), "Total")


def years_to_columns(long: DataFrame, key: str) -> DataFrame:
    """One row per key and a column for each report year, 0 where there is none."""
    wide = long.groupBy(key).pivot("Year", list(S.YEARS)).agg(F.sum("Total"))
    return wide.selectExpr(key, *(f"coalesce(`{y}`, 0.0D) AS `{y}`" for y in S.YEARS))


def country_rank_table(state: DataFrame, labels: Labels = None) -> DataFrame:
    """Countries by exposed population of the last year, largest first, sums rounded half to even.

    Years the input lacks show 0; without any year column there are no rows. The countries are ranked
    by ranges, so that open codes may be many, and stored on the way.
    """
    sums = _year_sums(state)
    wide = country_year_table(state, labels) if sums else country_year_table(state.filter("false"), labels)
    years = {y: f"coalesce(`{y}`, 0.0D)" if str(y) in sums else "0.0D" for y in S.YEARS}
    wide = wide.selectExpr("Country", *(f"{text} AS `{y}`" for y, text in years.items()))
    places = ranked(wide, [field(str(S.YEARS[-1])).desc(), F.col("Country").asc()])
    return places.selectExpr("Rank", "Country", *(f"bround(`{y}`, 0) AS `{y}`" for y in S.YEARS)).orderBy("Rank")


def income_year_table(state: DataFrame) -> DataFrame:
    """Exposed population per income level and year; every level appears, with 0 where it has no cells."""
    sums = _year_sums(state)
    levels = dictionary(state.sparkSession, S.INCOME.labels).rows.selectExpr(f"label AS {CATEGORY}")
    groups = by_label(state, S.INCOME, list(sums.values()) or [CELLS])
    joined = levels.join(groups, CATEGORY, "left")
    if S.INCOME.column not in state.columns:
        joined = joined.filter("false")
    years = (f"coalesce({name}, 0.0D) AS `{year}`" for year, name in sums.items())
    return joined.selectExpr(f"{CATEGORY} AS Income", *years)


def run_summary(
    state: DataFrame, flood: str | None = None, total_rows: int | None = None, codes: DataFrame | None = None
) -> DataFrame:
    """One row of counts. Distinct codes come from ``codes`` (merged ``code_sets``), or without it from a
    state that keeps its raw codes.

    Without ``total_rows`` the state must also hold the cells of no valid age (``keep_invalid``).
    """

    def distinct(column: str) -> str:
        return f"count(DISTINCT {column})" if column in state.columns else "0L"

    measures = {
        "total_rows": f"coalesce(sum({CELLS}), 0L)" if total_rows is None else f"{total_rows}L",
        "valid_rows": f"coalesce(sum({CELLS}) FILTER (WHERE {S.AGE} IS NOT NULL), 0L)",
        "ages_count": distinct(S.AGE),
    }
    counted = {"countries_count": S.COUNTRY, "continents_count": S.CONTINENT, "income_levels_count": S.INCOME}
    order = ["total_rows", "valid_rows", *counted, "ages_count"]
    make = distinct if codes is None else set_size
    found = {name: make(dim.column) for name, dim in counted.items()}
    if codes is None:
        counts = state.agg(*(F.expr(f"{value} AS {name}") for name, value in (measures | found).items()))
    else:
        # Two rows, one of each side.
        counts = state.agg(*(F.expr(f"{value} AS {name}") for name, value in measures.items())).withColumn("one", F.lit(1))
        sizes = codes.agg(*(F.expr(f"{value} AS {name}") for name, value in found.items())).withColumn("one", F.lit(1))
        counts = counts.join(F.broadcast(sizes), "one")
    return counts.select(*order).withColumn("flood_column", F.lit(flood or "N/A"))
