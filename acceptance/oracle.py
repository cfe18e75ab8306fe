"""The same results as SQL for DuckDB, written without the Spark code's helpers."""

from __future__ import annotations

YEARS = range(1975, 2026, 5)
HAZARDS = {10: 2.0, 20: 3.5, 50: 5.0, 75: 5.8, 100: 6.5, 200: 7.8, 500: 12.0}


def _hazard(period: int) -> str:
    value = f"l_discount * CAST({HAZARDS[period]} AS DOUBLE)"
    if period == 500:
        value = f"CASE WHEN l_partkey % 41 = 0 THEN NULL ELSE {value} END"
    return f"{value} AS Hazard_Index_RP{period:03d}"


def _yearly(index: int, year: int) -> str:
    return (
        f"CASE WHEN l_suppkey % 47 = 0 THEN NULL ELSE CAST(l_linenumber * {5 * (index + 1)} AS DOUBLE) END"
        f" AS POP_Exposure_{year}"
    )


GRID_COLUMNS = [
    "CAST(5 * (1 + CAST(l_quantity AS INT) % 12) AS INT) AS Built_Up_Age",
    "CASE WHEN c_custkey % 29 = 0 THEN NULL ELSE CAST(1 + c_nationkey % 3 AS DOUBLE) END AS Developed",
    "CASE WHEN c_custkey % 31 = 0 THEN NULL ELSE CAST(c_nationkey % 6 AS DOUBLE) END AS Income_Classification",
    "CAST(10 + c_nationkey % 8 AS DOUBLE) AS Sovereig",
    "CASE WHEN c_custkey % 37 = 0 THEN NULL WHEN c_nationkey = 24 THEN CAST(999 AS DOUBLE)"
    " WHEN c_nationkey = 23 THEN CAST(275 AS DOUBLE) ELSE CAST(100 + c_nationkey * 10 AS DOUBLE) END AS Country",
    *(_hazard(period) for period in HAZARDS),
    "l_quantity / CAST(45 AS DOUBLE) AS Exposure_Index",
    "CASE WHEN l_suppkey % 43 = 0 THEN NULL ELSE l_tax * CAST(10 AS DOUBLE) + CAST(0.1 AS DOUBLE) END AS Vulnerability_Index",
    "CASE WHEN l_linenumber = 7 THEN CAST(0 AS DOUBLE) ELSE l_discount * CAST(300 AS DOUBLE) END AS Slope",
    "CASE WHEN l_suppkey % 53 = 0 THEN CAST('NaN' AS DOUBLE)"
    " ELSE l_extendedprice / CAST(100 AS DOUBLE) - CAST(50 AS DOUBLE) END AS DEM",
    "CAST(l_partkey AS DOUBLE) AS Distance_from_River",
    "CASE l_returnflag WHEN 'A' THEN '1' WHEN 'N' THEN '0' ELSE 'n/a' END AS Flood_Flag",
    "CAST(l_linenumber * 100 AS DOUBLE) AS POP_2025",
    *(_yearly(i, year) for i, year in enumerate(YEARS)),
]
GRID_TYPES = {"Built_Up_Age": "int", "Flood_Flag": "string"}
GRID_NAMES = [column.rsplit(" AS ", 1)[1] for column in GRID_COLUMNS]
GRID = (
    "WITH grid AS (SELECT " + ", ".join(GRID_COLUMNS) + " FROM lineitem JOIN orders ON l_orderkey = o_orderkey"
    " JOIN customer ON o_custkey = c_custkey),"
    " valid AS (SELECT * FROM grid WHERE Built_Up_Age BETWEEN 5 AND 50 AND Built_Up_Age % 5 = 0)"
)
LABELS = {
    "development": "CASE Developed WHEN 1 THEN 'Developed' WHEN 2 THEN 'Developing' END",
    "income": "CASE Income_Classification WHEN 0 THEN 'Unclassified' WHEN 1 THEN 'Low Income'"
    " WHEN 2 THEN 'Lower Middle Income' WHEN 3 THEN 'Upper Middle Income' WHEN 4 THEN 'High Income' END",
    "continent": "CASE Sovereig WHEN 10 THEN 'Asia' WHEN 11 THEN 'Europe' WHEN 12 THEN 'Africa'"
    " WHEN 13 THEN 'North America' WHEN 14 THEN 'South America' WHEN 15 THEN 'Oceania' WHEN 17 THEN 'Seven Seas' END",
    "country": "CASE WHEN Country IS NOT NULL THEN coalesce((SELECT n_name FROM nation WHERE n_nationkey < 23"
    " AND 100 + 10 * n_nationkey = Country), 'Country_' || CAST(CAST(Country AS BIGINT) AS VARCHAR)) END",
}
CODES = {
    "development": "Developed",
    "income": "Income_Classification",
    "continent": "Sovereig",
    "country": "Country",
}
NUDGE = "CAST('1.2345678e-7' AS DOUBLE)"
FLOODED = "count(*) FILTER (WHERE Flood_Flag = '1')"


def _round(value: str, digits: int = 6) -> str:
    return f"round({value} + {NUDGE}, {digits})"


def _ead() -> str:
    """Trapezoids between exceedance probabilities, the curve extended flat to 0 and 1."""
    periods = sorted(HAZARDS, reverse=True)
    heights = [f"coalesce(Hazard_Index_RP{t:03d}, 0.0)" for t in periods]
    heights = [heights[0], *heights, heights[-1]]
    points = [0.0, *(1.0 / t for t in periods), 1.0]
    area = " + ".join(
        f"({heights[i]} + {heights[i + 1]}) / 2.0 * CAST('{points[i + 1] - points[i]!r}' AS DOUBLE)"
        for i in range(len(points) - 1)
    )
    return f"CAST(greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), {area})) AS FLOAT)"


def _unit(value: str) -> str:
    return f"greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), coalesce({value}, CAST(0 AS DOUBLE))))"


def _risk(hazard: str) -> str:
    product = " * ".join(_unit(v) for v in (f"CAST({hazard} AS DOUBLE)", "Exposure_Index", "Vulnerability_Index"))
    return f"CAST(pow({product}, CAST(1 AS DOUBLE) / 3) AS FLOAT)"


RISK_GRID = (
    GRID
    + f", hazard AS (SELECT *, {_ead()} AS ead FROM grid), risky AS (SELECT *, {_risk('ead')} AS risk FROM hazard)"
)


def _special(expressions: dict[str, str], digits: int | None, source: str, grid: str = GRID) -> str:
    inner = ", ".join(f"{text} AS {name}" for name, text in expressions.items())
    shown = []
    for name in expressions:
        value = _round(name, digits) if digits is not None else name
        shown.append(
            f"CASE WHEN isfinite({name}) THEN {value} + CAST(0 AS DOUBLE) END AS {name},"
            f" CASE WHEN {name} IS NULL THEN 'null' WHEN isnan({name}) THEN 'nan'"
            f" WHEN isinf({name}) THEN CASE WHEN {name} > 0 THEN '+inf' ELSE '-inf' END ELSE 'finite' END AS {name}_kind"
        )
    return f"{grid} SELECT {', '.join(shown)} FROM (SELECT {inner} FROM {source})"


def _log(kind: str, x: str) -> str:
    return (
        f"CASE WHEN isnan({x}) THEN CAST('NaN' AS DOUBLE) WHEN {x} > 0 THEN {kind}({x})"
        f" WHEN {x} = 0 THEN CAST('-inf' AS DOUBLE) WHEN {x} < 0 THEN CAST('NaN' AS DOUBLE) END"
    )


def _mod(n: str, d: str) -> str:
    return f"{n} - {d} * floor({n} / {d})"


DERIVED = {
    "derive_arith": {"r": "-(Slope + 2.0) * Exposure_Index - POP_2025 / 4.0 + 1.5"},
    "derive_div": {
        "r1": "DEM / Slope",
        "r2": "Slope / Slope",
        "r3": "POP_Exposure_2025 / (CAST(-1 AS DOUBLE) * Slope)",
    },
    "derive_mod": {
        "r1": _mod("DEM", "CAST(7 AS DOUBLE)"),
        "r2": _mod("Distance_from_River", "CAST(-3 AS DOUBLE)"),
        "r3": _mod("POP_2025", "Slope"),
    },
    "derive_pow": {
        "r1": "pow(Exposure_Index, 2)",
        "r2": "-pow(Slope, 2)",
        "r3": "pow(2, pow(Exposure_Index, 0.5))",
    },
    "derive_unary": {
        "r1": "abs(DEM - 500)",
        "r2": "CASE WHEN Slope < 6 THEN CAST('NaN' AS DOUBLE) ELSE sqrt(Slope - 6) END",
        "r3": "exp(-Exposure_Index)",
        "r4": "sin(Slope) + cos(Exposure_Index)",
        "r5": "tan(Exposure_Index)",
        "r6": "CAST(sign(Slope - 15) AS DOUBLE)",
    },
    "derive_log": {
        "r1": _log("ln", "Slope"),
        "r2": _log("ln", "Exposure_Index"),
        "r3": _log("log10", "(DEM - 500)"),
    },
    "derive_round": {"r1": "ceil(DEM)", "r2": "floor(DEM - 700)", "r3": "round(Slope / 2)"},
    "derive_minmax": {
        "r1": "least(Vulnerability_Index, Exposure_Index)",
        "r2": "greatest(DEM, Distance_from_River)",
    },
    "derive_example_1": {"r": "Hazard_Index_RP100 / greatest(Hazard_Index_RP100, CAST(0.001 AS DOUBLE))"},
    "derive_example_2": {
        "r": "CAST(ead AS DOUBLE) * CAST(0.4 AS DOUBLE) + Exposure_Index * CAST(0.3 AS DOUBLE)"
        " + Vulnerability_Index * CAST(0.3 AS DOUBLE)"
    },
    "derive_example_3": {"r": "exp(-Distance_from_River / 1000)"},
    "derive_example_4": {
        "r": "CAST(ead AS DOUBLE) * (1 + sin(Slope * CAST(3.14159 AS DOUBLE) / CAST(180 AS DOUBLE)))"
    },
}


def _nested() -> str:
    """Eight levels as eight nested selects, each over the one before."""
    steps = {
        "r1": "{x} / (Exposure_Index + {k})",
        "r2": _mod("({x} + CAST(17.25 AS DOUBLE))", "(Exposure_Index + {k})"),
        "r3": "pow({x} * CAST(0.5 AS DOUBLE) + 1, CAST(0.5 AS DOUBLE) + Exposure_Index / (2 + {k}))",
        "r4": "round({x} * CAST(1.5 AS DOUBLE) + {k})",
        "r5": "floor({x} * CAST(1.25 AS DOUBLE) + {k})",
        "r6": "ln({x} + 20 + {k})",
    }
    source = f"(SELECT Exposure_Index, {', '.join(f'Slope AS {name}' for name in steps)} FROM grid)"
    for level in range(1, 9):
        columns = ", ".join(f"{text.format(x=name, k=f'CAST({level} AS DOUBLE)')} AS {name}" for name, text in steps.items())
        source = f"(SELECT Exposure_Index, {columns} FROM {source})"
    return _special({name: name for name in steps}, 6, source)


FEW = ["Built_Up_Age", "Slope", "Distance_from_River", "Exposure_Index", "Flood_Flag", "POP_2025"]


def _ordered(select: str, order: str) -> str:
    return f"{GRID} SELECT {select}, '{order}' AS column_order FROM grid"


def _categories(dim: str | None, grid: str = GRID, source: str = "valid") -> str:
    """Rows once as ``All`` and once under their label."""
    labelled = (
        f" UNION ALL SELECT {LABELS[dim]} AS Category, * FROM {source} WHERE {LABELS[dim]} IS NOT NULL" if dim else ""
    )
    return f"{grid}, members AS (SELECT 'All' AS Category, * FROM {source}{labelled})"


def _grouped(dim: str, measures: str, grid: str = GRID, source: str = "valid") -> str:
    return f"{_categories(dim, grid, source)} SELECT Category, Built_Up_Age, {measures} FROM members GROUP BY ALL"


def _area() -> str:
    return (
        _categories("development") + ", counted AS (SELECT Category, Built_Up_Age, count(*) AS n FROM members GROUP BY ALL)"
        f" SELECT Category, Built_Up_Age, n AS Grid_Count, {_round('n * CAST(0.01 AS DOUBLE)')} AS Area_km2,"
        f" {_round('n / CAST(sum(n) OVER (PARTITION BY Category) AS DOUBLE) * 100')} AS Ratio_Percent FROM counted"
    )


FLOOD_MEASURES = (
    f"count(*) AS Total_Grid_Count, {FLOODED} AS Flooded_Grid_Count,"
    f" {_round('count(*) * CAST(0.01 AS DOUBLE)')} AS Total_Area_km2,"
    f" {_round(f'{FLOODED} * CAST(0.01 AS DOUBLE)')} AS Flooded_Area_km2,"
    f" {_round(f'CAST({FLOODED} AS DOUBLE) / count(*) * 100')} AS Flood_Area_Ratio_Percent"
)


def _moments(values: dict[str, str], extremes: bool = False, digits: int = 6) -> str:
    parts = []
    for name, v in values.items():
        parts += [
            f"{_round(f'avg({v})', digits)} AS {name}_Mean",
            f"{_round(f'stddev_pop({v})', digits)} AS {name}_Std",
            f"count({v}) AS {name}_n",
            f"{_round(f'stddev_pop({v}) / sqrt(nullif(count({v}), 0))', digits)} AS {name}_SE",
        ]
        if extremes:
            parts += [f"{_round(f'min({v})', digits)} AS {name}_Min", f"{_round(f'max({v})', digits)} AS {name}_Max"]
    return ", ".join(parts)


def _environment(exclude_zero: bool) -> str:
    zero = " AND {c} <> 0" if exclude_zero else ""
    return _moments(
        {
            c: f"CASE WHEN NOT isnan({c}){zero.format(c=c)} THEN {c} END"
            for c in ("Slope", "DEM", "Distance_from_River")
        }
    )


EXPOSED = "coalesce(sum(POP_Exposure_2025), 0)"
EXPOSURE_MEASURES = (
    f"sum(POP_2025) AS Total_Population, {EXPOSED} AS Total_Exposure,"
    f" {_round(f'CASE WHEN sum(POP_2025) > 0 THEN {EXPOSED} / sum(POP_2025) * 100 END')} AS Exposure_Ratio_Percent"
)
YEAR_SUMS = ", ".join(f'coalesce(sum(POP_Exposure_{y}), 0) AS "{y}"' for y in YEARS)
COUNTRY_YEAR = (
    f"{GRID}, named AS (SELECT {LABELS['country']} AS Country_Label, * FROM valid),"
    f" yearly AS (SELECT Country_Label AS Country, {YEAR_SUMS} FROM named WHERE Country_Label IS NOT NULL GROUP BY 1)"
)


def _country_year_long() -> str:
    return COUNTRY_YEAR + " " + " UNION ALL ".join(
        f'SELECT Country, CAST({y} AS INT) AS Year, "{y}" AS Total FROM yearly' for y in YEARS
    )


def _country_rank() -> str:
    years = ", ".join(f'round_even("{y}", 0) AS "{y}"' for y in YEARS)
    return (
        f'{COUNTRY_YEAR} SELECT CAST(row_number() OVER (ORDER BY "2025" DESC, Country) AS INT) AS Rank,'
        f" Country, {years} FROM yearly"
    )


def _income_year() -> str:
    names = ["Unclassified", "Low Income", "Lower Middle Income", "Upper Middle Income", "High Income"]
    levels = ", ".join(f"({code}, '{name}')" for code, name in enumerate(names))
    return (
        f"{GRID} SELECT name AS Income, {YEAR_SUMS} FROM (VALUES {levels}) AS levels(code, name)"
        " LEFT JOIN valid ON Income_Classification = code GROUP BY name"
    )


PART_VALUES = {"Slope": "nullif(Slope, 0)", "Distance_from_River": "nullif(Distance_from_River, 0)"}


def _moments_partial() -> str:
    measures = ", ".join(
        f"{_round(value, 4)} AS {c}_{part}"
        for c, v in PART_VALUES.items()
        for part, value in (
            ("sum", f"coalesce(sum({v}), 0)"),
            ("sq_sum", f"coalesce(sum({v} * {v}), 0)"),
            ("min", f"min({v})"),
            ("max", f"max({v})"),
            ("mean", f"avg({v})"),
            ("m2", f"var_pop({v}) * count({v})"),
        )
    )
    counts = ", ".join(f"count({v}) AS {c}_count" for c, v in PART_VALUES.items())
    return f"{GRID} SELECT Sovereig, Built_Up_Age, {measures}, {counts} FROM valid GROUP BY ALL"


def _moments_merged() -> str:
    measures = _moments(PART_VALUES, extremes=True, digits=5)
    return f"{GRID} SELECT Built_Up_Age, {measures} FROM valid GROUP BY ALL"


def _field_profile() -> str:
    rows = " UNION ALL ".join(
        f"SELECT CAST({i} AS INT) AS position, '{name}' AS name, '{GRID_TYPES.get(name, 'double')}' AS dtype,"
        f" {name != 'Flood_Flag'} AS is_numeric, count(*) - count({name}) AS null_count FROM grid"
        for i, name in enumerate(GRID_NAMES)
    )
    return f"{GRID} {rows}"


def _filter_by_codes() -> str:
    filters = {
        "developed": "Developed = 1",
        "middle_income": "Income_Classification IN (2, 3)",
        "asia": "Sovereig = 10",
        "newest": "Built_Up_Age = 5",
        "older_than_30": "Built_Up_Age >= 35",
        "older_developing_low_or_high_income": "Developed = 2 AND Income_Classification IN (1, 4) AND Built_Up_Age >= 35",
    }
    return f"{GRID} " + " UNION ALL ".join(
        f"SELECT '{name}' AS name, count(*) AS cells, sum(POP_2025) AS population FROM grid WHERE {test} HAVING count(*) > 0"
        for name, test in filters.items()
    )


def _display(value: str) -> str:
    return (
        f"CASE WHEN {value} IS NULL OR isnan({value}) THEN 'N/A' WHEN abs({value}) >= 1e6 THEN format('{{:,.0f}}', {value})"
        f" WHEN abs({value}) < 1e-4 AND {value} <> 0 THEN printf('%.2E', {value})"
        f" ELSE format('{{:,.6f}}', round({value}, 6)) END"
    )


def _format_values() -> str:
    ratio = f"CASE WHEN sum(POP_2025) > 0 THEN {EXPOSED} / sum(POP_2025) * 100 END"
    values = _grouped(
        "income",
        f"sum(POP_2025) AS p, {EXPOSED} AS e, {ratio} AS r, {ratio} / 1e7 AS s",
    )
    head, select = values.rsplit(" SELECT Category, Built_Up_Age,", 1)
    return (
        f"{head}, sums AS (SELECT Category, Built_Up_Age,{select}) SELECT Category, Built_Up_Age,"
        f" {_display('p')} AS Total_Population, {_display('e')} AS Total_Exposure, {_display('r')} AS Exposure_Ratio_Percent,"
        f" {_display('s')} AS Exposure_Share, 'N/A' AS Missing FROM sums"
    )


# Section, table name, description, and what the rows are counted by.
CATALOGUE = [
    ("A. Area Statistics", "A_Area_Stats", "Built-up area by development status and Built-up Age (includes All)", "development"),
    ("B1. Flood by Development", "B1_Flood_DevStatus", "Flood inundation area & ratio by development status (includes All)", "development"),
    ("B2. Flood by Income", "B2_Flood_Income", "Flood inundation area & ratio by income classification (includes All)", "income"),
    ("B3. Flood by Continent", "B3_Flood_Continent", "Flood inundation area & ratio by continent (includes All)", "continent"),
    ("B4. Flood by Country", "B4_Flood_Country", "Flood inundation area & ratio by country/region (includes All)", "country"),
    ("C1. Env by Development", "C1_Env_DevStatus", "Environmental factors by development status (includes All) with n, SE", "development"),
    ("C2. Env by Income", "C2_Env_Income", "Environmental factors by income level (includes All) with n, SE", "income"),
    ("C3. Env by Continent", "C3_Env_Continent", "Environmental factors by continent (includes All) with n, SE", "continent"),
    ("C4. Env by Country", "C4_Env_Country", "Environmental factors by country/region (includes All) with n, SE", "country"),
    ("D1. Global Exposure Ratio", "D1_Global_ExpRatio", "Global population exposure ratio by Built-up Age", "ages"),
    ("D2. Exposure by Country-Year", "D2_Exp_Country_Year", "Total exposure population by country and year (1975-2025)", "countries"),
    ("D3. Exposure Ratio by Country", "D3_ExpRatio_Country", "Exposure ratio by country/region and Built-up Age (includes All)", "country"),
    ("D4. Exposure Ratio by Income", "D4_ExpRatio_Income", "Exposure ratio by income level and Built-up Age (includes All)", "income"),
    ("D5. Exposure Ratio by Continent", "D5_ExpRatio_Continent", "Exposure ratio by continent and Built-up Age (includes All)", "continent"),
    ("D6. Exposure Ratio by DevStatus", "D6_ExpRatio_DevStatus", "Exposure ratio by development status and Built-up Age (includes All)", "development"),
]


def _catalogue() -> str:
    ctes = ", ".join(
        f"groups_{d} AS (SELECT DISTINCT Built_Up_Age, 'All' AS c, TRUE AS a FROM valid"
        f" UNION SELECT DISTINCT Built_Up_Age, {LABELS[d]}, FALSE FROM valid WHERE {LABELS[d]} IS NOT NULL)"
        for d in LABELS
    )
    size = {d: f"(SELECT count(*) FROM groups_{d})" for d in LABELS}
    size["countries"] = f"(SELECT count(DISTINCT {LABELS['country']}) FROM valid)"
    size["ages"] = "(SELECT count(DISTINCT Built_Up_Age) FROM valid)"
    return f"{GRID}, {ctes} " + " UNION ALL ".join(
        f"SELECT '{a}' AS Section, '{b}' AS Sheet, '{c}' AS Description, {size[by]} AS Records" for a, b, c, by in CATALOGUE
    )


def _graph() -> str:
    """Ten fields in the order in which they build on one another."""
    steps = (
        "exp(-Distance_from_River / CAST(1000 AS DOUBLE)) AS f2, abs(Distance_from_River % CAST(7 AS DOUBLE)) + Slope AS f5",
        "sqrt(f5) + f2 AS f3, sin(f5) * f2 - sqrt(f5) AS f10",
        "f3 / (f2 + 1) AS f1",
        "pow(greatest(f1, f3), 2) AS f4",
        "ln(f4 + f5 + 1) AS f6",
        "least(f6, f10) AS f7",
        "f7 - f1 * f2 AS f8",
        "(f8 + f7) / (f2 + f3 + 1) AS f9",
    )
    source = "grid"
    for step in steps:
        source = f"(SELECT *, {step} FROM {source})"
    return _special({f"f{i}": f"f{i}" for i in range(1, 11)}, 6, source)


def _stored_profile() -> str:
    columns = {
        "l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int", "l_quantity": "double",
        "l_extendedprice": "double", "l_discount": "double", "l_tax": "double", "l_returnflag": "string", "l_linestatus": "string",
        "l_shipdate": "timestamp_ntz",
    }
    return " UNION ALL ".join(
        f"SELECT CAST({i} AS INTEGER) AS position, '{n}' AS name, '{t}' AS dtype,"
        f" {'false' if t in ('string', 'timestamp_ntz') else 'true'} AS is_numeric, count(*) - count({n}) AS null_count FROM lineitem"
        for i, (n, t) in enumerate(columns.items())
    )


def _display_rank() -> str:
    years = ", ".join(f"format('{{:,.0f}}', \"{y}\") AS \"{y}\"" for y in YEARS)
    return f"SELECT Rank, Country, {years} FROM ({_country_rank()})"


def _years_wide() -> str:
    years = ", ".join(f"coalesce(sum(POP_Exposure_{y}), 0) AS \"{y}\"" for y in YEARS)
    return f"{GRID} SELECT Sovereig, {years} FROM valid GROUP BY Sovereig"


def _two_period_risk() -> str:
    """EAD from the two periods 10 and 100 alone."""
    low, high = (f"coalesce(Hazard_Index_RP{t}, 0.0)" for t in ("010", "100"))
    area = (
        f"({high} + {high}) / 2.0 * CAST('0.01' AS DOUBLE) + ({high} + {low}) / 2.0 * CAST('{0.1 - 0.01!r}' AS DOUBLE)"
        f" + ({low} + {low}) / 2.0 * CAST('0.9' AS DOUBLE)"
    )
    value = f"CAST(greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), {area})) AS FLOAT)"
    return (
        f"{GRID}, hazard AS (SELECT *, {value} AS ead FROM grid) SELECT Built_Up_Age,"
        f" CAST(ead AS DOUBLE) AS Hazard_Index_EAD, CAST({_risk('ead')} AS DOUBLE) AS Risk_Index FROM hazard"
    )


def all_oracles() -> dict[str, str]:
    named = [n for n in GRID_NAMES if n != "DEM"]
    output_names = [*GRID_NAMES, "Hazard_Index_EAD", "Risk_Index"]
    output_types = ",".join(
        f"{n}:{'float' if n in ('Hazard_Index_EAD', 'Risk_Index') else GRID_TYPES.get(n, 'double')}" for n in output_names
    )
    few = ", ".join(FEW)
    found = {
        "scan_grid": _special({"DEM": "DEM"}, None, "grid").replace(
            "SELECT CASE", f"SELECT {', '.join(named)}, CASE", 1
        ).replace("(SELECT DEM AS DEM FROM grid)", "grid"),
        "scan_pruned": "SELECT l_quantity, l_partkey FROM lineitem",
        "dataset_profile": "SELECT count(*) AS row_count, CAST(11 AS BIGINT) AS column_count,"
        " CAST(8 AS BIGINT) AS numeric_column_count, CAST(ceil(count(*) / 500000.0) AS BIGINT) AS estimated_chunks FROM lineitem",
        "field_profile": _field_profile(),
        "field_samples": f"{GRID}, one AS (SELECT {few} FROM grid ORDER BY {few} LIMIT 1) "
        + " UNION ALL ".join(f"SELECT '{n}' AS name, CAST({n} AS VARCHAR) AS sample FROM one" for n in FEW),
        "file_profile": "SELECT CAST(1 AS BIGINT) AS file_count, count(*) AS row_count, CAST(11 AS BIGINT) AS column_count,"
        " CAST(ceil(count(*) / 500000.0) AS BIGINT) AS estimated_chunks FROM lineitem",
        "derive_nested": _nested(),
        "preview": f"{GRID} SELECT {few} FROM grid ORDER BY {few} LIMIT 100",
        **{
            key: _special(e, 6, *(("risky", RISK_GRID) if "ead" in " ".join(e.values()) else ("grid", GRID)))
            for key, e in DERIVED.items()
        },
        "drop_fields": _ordered(
            "Built_Up_Age, Distance_from_River, Exposure_Index, POP_2025",
            "Built_Up_Age,Distance_from_River,Exposure_Index,POP_2025",
        ),
        "add_constant_field": f"{GRID} SELECT Built_Up_Age, CAST(1.5 AS DOUBLE) AS Slope, CAST(2.5 AS DOUBLE) AS c_double,"
        " CAST(0.5 AS DOUBLE) AS c_float, CAST(7 AS BIGINT) AS c_long, CAST(-3 AS INT) AS c_int, 'urban' AS c_text,"
        " TRUE AS c_true, FALSE AS c_false, CAST(NULL AS VARCHAR) AS c_none, TRUE AS c_bad FROM grid",
        "rename_fields": _ordered(
            "Built_Up_Age, Slope AS Distance_from_River, Distance_from_River AS Slope, Exposure_Index, Flood_Flag, POP_2025 AS People",
            "Built_Up_Age,Distance_from_River,Slope,Exposure_Index,Flood_Flag,People",
        ),
        "reorder_fields": _ordered("POP_2025, Slope AS Steepness, Built_Up_Age", "POP_2025,Steepness,Built_Up_Age"),
        "order_fields_az": _ordered(few, "Built_Up_Age,Distance_from_River,Exposure_Index,Flood_Flag,POP_2025,Slope"),
        "order_fields_by_type": _ordered(few, "Built_Up_Age,Distance_from_River,Exposure_Index,POP_2025,Slope,Flood_Flag"),
        "move_field": _ordered(few, "POP_2025,Distance_from_River,Slope,Flood_Flag,Exposure_Index,Built_Up_Age"),
        "ead_output_schema": f"{RISK_GRID} SELECT Developed, Income_Classification, Sovereig, Country,"
        " CAST(ead AS DOUBLE) AS Hazard_Index_EAD, CAST(risk AS DOUBLE) AS Risk_Index,"
        f" '{output_types}' AS output_types FROM risky",
        "filter_valid_age": f"{GRID} SELECT {few} FROM valid",
        "filter_by_codes": _filter_by_codes(),
        "filter_older_developing": f"{GRID} SELECT Built_Up_Age, Developed, Income_Classification, Slope, POP_2025"
        " FROM grid WHERE Developed = 2 AND Income_Classification IN (1, 4) AND Built_Up_Age >= 35",
        "ead": f"{RISK_GRID} SELECT Built_Up_Age, Hazard_Index_RP010, CAST(ead AS DOUBLE) AS Hazard_Index_EAD FROM risky",
        "risk_index": f"{GRID} SELECT Built_Up_Age, Exposure_Index,"
        f" CAST({_risk('CAST(Hazard_Index_RP100 AS FLOAT)')} AS DOUBLE) AS Risk_Index FROM grid",
        "ead_and_risk": f"{RISK_GRID} SELECT Built_Up_Age, count(*) AS cells, "
        + ", ".join(
            f"{_round(f'{f}(CAST({c} AS DOUBLE))')} AS {k}_{c}"
            for c in ("ead", "risk")
            for k, f in (("mean", "avg"), ("min", "min"), ("max", "max"))
        )
        + " FROM risky GROUP BY Built_Up_Age",
        "area_by_development": _area(),
        "env_by_development_with_zeros": _grouped("development", _environment(False)),
        "exposure_global": f"{GRID} SELECT Built_Up_Age, {EXPOSURE_MEASURES} FROM valid GROUP BY Built_Up_Age",
        "exposure_country_year": f"{COUNTRY_YEAR} SELECT * FROM yearly",
        "exposure_country_year_long": _country_year_long(),
        "exposure_country_rank": _country_rank(),
        "exposure_income_year": _income_year(),
        "run_summary": f"{GRID} SELECT (SELECT count(*) FROM grid) AS total_rows, count(*) AS valid_rows,"
        " count(DISTINCT Country) AS countries_count, count(DISTINCT Sovereig) AS continents_count,"
        " count(DISTINCT Income_Classification) AS income_levels_count, count(DISTINCT Built_Up_Age) AS ages_count,"
        " 'Flood_Flag' AS flood_column FROM valid",
        "moments_partial": _moments_partial(),
        "moments_merged": _moments_merged(),
        "stream_ead": f"{RISK_GRID} SELECT Built_Up_Age, CAST(ead AS DOUBLE) AS Hazard_Index_EAD,"
        " CAST(risk AS DOUBLE) AS Risk_Index FROM risky",
        "stream_flood_by_development": _grouped("development", FLOOD_MEASURES),
        "format_report_values": _format_values(),
        "report_catalogue": _catalogue(),
    }
    found |= {
        "stream_env_by_income": _grouped("income", _environment(False)),
        "stream_risk_named": _two_period_risk(),
        "exposure_years_wide": _years_wide(),
        "report_area": found["area_by_development"],
        "report_env_by_country": _grouped("country", _environment(True)),
        "report_country_rank": found["exposure_country_rank"],
        "report_overview": found["run_summary"],
        "report_display_country_year": _display_rank(),
        "stream_delta_report": _grouped("country", _environment(True)),
        "stream_delta_overview": found["run_summary"],
        "field_profile_stored": _stored_profile(),
        "derive_graph": _graph(),
        "filter_clustered": f"{GRID} SELECT Developed, Income_Classification, Sovereig, Country, Slope, POP_2025"
        " FROM grid WHERE Country IN (110, 200) AND Built_Up_Age = 25",
        "scan_versioned": f"{GRID} SELECT Built_Up_Age, Slope, Distance_from_River FROM grid",
    }
    risk_measures = _moments({"Risk_Index": "CAST(risk AS DOUBLE)"}, extremes=True)
    valid_risk = RISK_GRID + ", valid_risk AS (SELECT * FROM risky WHERE Built_Up_Age BETWEEN 5 AND 50)"
    for dim, label in LABELS.items():
        found[f"label_{dim}"] = (
            f"{GRID}, named AS (SELECT {label} AS Label, * FROM grid) SELECT {CODES[dim]}, Label,"
            " count(*) AS cells, sum(POP_2025) AS population FROM named GROUP BY ALL"
        )
        found[f"flood_by_{dim}"] = _grouped(dim, FLOOD_MEASURES)
        found[f"env_by_{dim}"] = _grouped(dim, _environment(True))
        found[f"exposure_by_{dim}"] = _grouped(dim, EXPOSURE_MEASURES)
        found[f"risk_by_{dim}"] = _grouped(dim, risk_measures, valid_risk, "valid_risk")
    return found
