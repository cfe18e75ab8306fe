"""Column names, code dictionaries and constants of the grid-cell table."""

from __future__ import annotations

from typing import NamedTuple

AGE = "Built_Up_Age"
HAZARD_EAD = "Hazard_Index_EAD"
RISK = "Risk_Index"
EXPOSURE = "Exposure_Index"
VULNERABILITY = "Vulnerability_Index"
POPULATION = "POP_2025"
EXPOSED_POPULATION = "POP_Exposure_2025"

# They define the results and must not change.
AGES = (5, 10, 15, 20, 25, 30, 35, 40, 45, 50)
YEARS = (1975, 1980, 1985, 1990, 1995, 2000, 2005, 2010, 2015, 2020, 2025)
RETURN_PERIODS = (10, 20, 50, 75, 100, 200, 500)
ENVIRONMENT = ("Slope", "DEM", "Distance_from_River")
CELL_AREA_KM2 = 0.01
DEVELOPMENT_LABELS = {1: "Developed", 2: "Developing"}
INCOME_LABELS = {
    0: "Unclassified",
    1: "Low Income",
    2: "Lower Middle Income",
    3: "Upper Middle Income",
    4: "High Income",
}
CONTINENT_LABELS = {
    10: "Asia",
    11: "Europe",
    12: "Africa",
    13: "North America",
    14: "South America",
    15: "Oceania",
    17: "Seven Seas",
}
# The prefix of unnamed countries, and parts of column names that suggest a flood flag.
COUNTRY_FALLBACK_PREFIX = "Country_"
FLOOD_NAME_HINTS = ("flood", "inundat", "water", "submer")


def exposure_column(year: int) -> str:
    return f"POP_Exposure_{year}"


class Dimension(NamedTuple):
    """A code column that cells are grouped by.

    A closed dimension has a fixed dictionary and drops codes that are not in it. The open one
    (country) takes its dictionary as a parameter and names unknown codes ``Country_<code>``.
    """

    name: str
    column: str
    labels: dict[int, str] | None


DEVELOPMENT = Dimension("development", "Developed", DEVELOPMENT_LABELS)
INCOME = Dimension("income", "Income_Classification", INCOME_LABELS)
CONTINENT = Dimension("continent", "Sovereig", CONTINENT_LABELS)
COUNTRY = Dimension("country", "Country", None)
DIMENSIONS = {d.name: d for d in (DEVELOPMENT, INCOME, CONTINENT, COUNTRY)}
CODE_COLUMNS = tuple(d.column for d in DIMENSIONS.values())
