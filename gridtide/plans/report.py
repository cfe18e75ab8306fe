"""The full statistics report from one pass over the cells."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from gridtide import schema as S
from gridtide.functions.display import format_report_values, with_headers
from gridtide.operators import tables as T
from gridtide.operators.distinct import code_sets
from gridtide.operators.labels import Labels, dictionary, with_label
from gridtide.operators.summary import summarise
from gridtide.plans.work import written
from gridtide.sources.binding import detect_flood_column
from gridtide.sources.scan import scan_for_report
from gridtide.sources.sinks import put_in_place, refuse_overlap


class Sheet(NamedTuple):
    section: str
    name: str
    description: str


# Section, table name and description of the data tables, in report order.
SHEETS = (
    Sheet("A. Area Statistics", "A_Area_Stats", "Built-up area by development status and Built-up Age (includes All)"),
    Sheet("B1. Flood by Development", "B1_Flood_DevStatus", "Flood inundation area & ratio by development status (includes All)"),
    Sheet("B2. Flood by Income", "B2_Flood_Income", "Flood inundation area & ratio by income classification (includes All)"),
    Sheet("B3. Flood by Continent", "B3_Flood_Continent", "Flood inundation area & ratio by continent (includes All)"),
    Sheet("B4. Flood by Country", "B4_Flood_Country", "Flood inundation area & ratio by country/region (includes All)"),
    Sheet("C1. Env by Development", "C1_Env_DevStatus", "Environmental factors by development status (includes All) with n, SE"),
    Sheet("C2. Env by Income", "C2_Env_Income", "Environmental factors by income level (includes All) with n, SE"),
    Sheet("C3. Env by Continent", "C3_Env_Continent", "Environmental factors by continent (includes All) with n, SE"),
    Sheet("C4. Env by Country", "C4_Env_Country", "Environmental factors by country/region (includes All) with n, SE"),
    Sheet("D1. Global Exposure Ratio", "D1_Global_ExpRatio", "Global population exposure ratio by Built-up Age"),
    Sheet("D2. Exposure by Country-Year", "D2_Exp_Country_Year", "Total exposure population by country and year (1975-2025)"),
    Sheet("D3. Exposure Ratio by Country", "D3_ExpRatio_Country", "Exposure ratio by country/region and Built-up Age (includes All)"),
    Sheet("D4. Exposure Ratio by Income", "D4_ExpRatio_Income", "Exposure ratio by income level and Built-up Age (includes All)"),
    Sheet("D5. Exposure Ratio by Continent", "D5_ExpRatio_Continent", "Exposure ratio by continent and Built-up Age (includes All)"),
    Sheet("D6. Exposure Ratio by DevStatus", "D6_ExpRatio_DevStatus", "Exposure ratio by development status and Built-up Age (includes All)"),
)
# What the category column of these tables is called in display text.
CATEGORY_HEADERS = {
    "D3_ExpRatio_Country": "Country",
    "D4_ExpRatio_Income": "Income Level",
    "D5_ExpRatio_Continent": "Continent",
    "D6_ExpRatio_DevStatus": "Development Status",
}
WHOLE_NUMBERS = {"D2_Exp_Country_Year", "Exposure_Income_Year"}
DIMENSION_OF = {"DevStatus": S.DEVELOPMENT, "Income": S.INCOME, "Continent": S.CONTINENT, "Country": S.COUNTRY}
OVERVIEW = "Overview"
CATALOGUE = "Catalogue"
INCOME_YEARS = "Exposure_Income_Year"

# The overview counts the distinct raw codes of these columns.
COUNTED = (S.COUNTRY.column, S.CONTINENT.column, S.INCOME.column)
REPORT_TOTALS = (S.POPULATION, *(S.exposure_column(year) for year in S.YEARS))


def report_state(
    cells: DataFrame,
    flood: str | None = None,
    *,
    exclude_zero: bool = True,
    environment: Sequence[str] = S.ENVIRONMENT,
    keep_invalid: bool = False,
    dims: Sequence[S.Dimension] = tuple(S.DIMENSIONS.values()),
    totals: Sequence[str] = REPORT_TOTALS,
) -> DataFrame:
    """Everything the report's tables need, grouped once by age and all four codes.

    Codes that make no group of their own are folded (``summarise``), so the state has at most ages x
    labels rows; the overview counts raw codes from ``code_sets``. Cells of no valid age are filtered in the scan; ``keep_invalid`` counts them instead, for inputs
    that can be read only once. Fewer ``dims``, ``environment`` factors and ``totals`` make a smaller
    state.
    """
    return summarise(
        scan_for_report(cells, flood if flood in cells.columns else None, environment),
        dims,
        flood=flood,
        moments=environment,
        totals=totals,
        exclude_zero=exclude_zero,
        keep_invalid=keep_invalid,
        fold_codes=True,
    )


def report_tables(
    state: DataFrame,
    labels: Labels = None,
    flood: str | None = None,
    environment: Sequence[str] = S.ENVIRONMENT,
    total_rows: int | None = None,
    codes: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """All report tables from the state, by table name. Store the state before using several.

    ``total_rows`` counts the input's rows where the state holds only those of valid age; ``codes`` are
    the ``code_sets`` of the overview, which without them counts the state's folded codes.
    """
    tables = {OVERVIEW: T.run_summary(state, flood, total_rows, codes)}
    labels = dictionary(state.sparkSession, labels)
    for sheet in SHEETS:
        dim = DIMENSION_OF.get(sheet.name.rsplit("_", 1)[1])
        used = labels if dim is S.COUNTRY else None
        if sheet.name == "A_Area_Stats":
            table = T.area_table(state)
        elif sheet.name == "D1_Global_ExpRatio":
            table = T.exposure_global_table(state)
        elif sheet.name == "D2_Exp_Country_Year":
            table = T.country_rank_table(state, labels)
        elif sheet.name.startswith("B"):
            table = T.flood_table(state, dim, used)
        elif sheet.name.startswith("C"):
            table = T.environment_table(state, dim, used, environment)
        else:
            table = T.exposure_table(state, dim, used)
        tables[sheet.name] = table
    tables[INCOME_YEARS] = T.income_year_table(state)
    return tables


def report_catalogue(state: DataFrame, labels: Labels = None, environment: Sequence[str] = S.ENVIRONMENT) -> DataFrame:
    """Section, table name, description and record count of the data tables.

    The record counts follow from how many ages, labels and pairs of both the state holds, which one
    pass over it counts for all tables.
    """
    have = set(state.columns)
    rows = state.filter(f"{S.AGE} IS NOT NULL")
    known = dictionary(state.sparkSession, labels)
    counts = {"ages": F.countDistinct(S.AGE), "countries": F.lit(0)}
    dims = [dim for dim in S.DIMENSIONS.values() if dim.column in have]
    for dim in dims:
        rows = with_label(rows, dim, known if dim is S.COUNTRY else None, f"__{dim.name}")
        pair = F.when(F.col(f"__{dim.name}").isNotNull(), F.struct(f"__{dim.name}", S.AGE))
        counts[dim.name] = F.countDistinct(pair) + F.countDistinct(S.AGE)
        if dim is S.COUNTRY:
            counts["countries"] = F.countDistinct(f"__{dim.name}")
    exposed = f"{S.POPULATION}__sum" in have and f"{S.EXPOSED_POPULATION}__sum" in have
    yearly = any(f"{S.exposure_column(year)}__sum" in have for year in S.YEARS)
    measured = {"B": T.FLOODED in have, "C": any(f"{c}__m2" in have for c in environment), "D": exposed}

    def records(sheet: Sheet) -> str:
        dim = DIMENSION_OF.get(sheet.name.rsplit("_", 1)[1])
        if sheet.name == "D2_Exp_Country_Year":
            return "countries" if yearly and "countries" in counts else "none"
        if sheet.name == "A_Area_Stats":
            return S.DEVELOPMENT.name if S.DEVELOPMENT in dims else "ages"
        if not measured[sheet.name[0]]:
            return "none"
        if dim is None:
            return "ages"
        return dim.name if dim in dims else "none"

    found = rows.agg(F.lit(0).cast("bigint").alias("none"), *(c.cast("bigint").alias(name) for name, c in counts.items()))
    listed = F.array(
        *(
            F.struct(
                F.lit(sheet.section).alias("Section"),
                F.lit(sheet.name).alias("Sheet"),
                F.lit(sheet.description).alias("Description"),
                F.col(records(sheet)).alias("Records"),
            )
            for sheet in SHEETS
        )
    )
    return found.select(F.inline(listed)).orderBy("Sheet")


def build_report(
    cells: DataFrame,
    labels: Labels = None,
    flood: str | None = "auto",
    *,
    exclude_zero: bool = True,
    environment: Sequence[str] = S.ENVIRONMENT,
) -> dict[str, DataFrame]:
    """Aggregate the cells once, store that small state, and return every table over it.

    ``flood`` names the flag column; ``auto`` looks for one, and a name the input lacks means none.
    ``environment`` lists the factors of the C tables, and ``exclude_zero`` leaves their zeros out.
    """
    if flood == "auto":
        flood = detect_flood_column(cells.columns)
    elif flood not in cells.columns:
        flood = None
    state = written(report_state(cells, flood, exclude_zero=exclude_zero, environment=environment))
    codes = written(code_sets(cells, COUNTED))
    # Counting reads no column. The state itself reads only cells of valid age.
    tables = report_tables(state, labels, flood, environment, cells.count(), codes)
    tables[CATALOGUE] = report_catalogue(state, labels, environment)
    return tables


def write_report(
    tables: dict[str, DataFrame], output: str, inputs: list[str], *, csv: bool = False, versioned: bool = False
) -> list[str]:
    """One Parquet folder per table below ``output``, and with ``csv`` its display text beside it.

    The whole report is put in place at once: until then an old report stays as it is. A ``versioned``
    one is found with ``stored_path``.
    """
    spark = next(iter(tables.values())).sparkSession
    refuse_overlap(spark, output, inputs)

    def write(folder: str) -> None:
        for name, table in tables.items():
            table.write.parquet(f"{folder}/{name}")
            if csv:
                stored = spark.read.schema(table.schema).parquet(f"{folder}/{name}")
                display_text(name, stored).write.option("header", True).csv(f"{folder}/{name}_csv")

    put_in_place(spark, output, write, versioned)
    return list(tables)


def display_text(name: str, table: DataFrame) -> DataFrame:
    """A report table as its readers see it: formatted values under display headers."""
    return with_headers(format_report_values(table, name in WHOLE_NUMBERS), CATEGORY_HEADERS.get(name, "Category"))
