import math

import pytest

from gridtide import schema as S
from gridtide.operators import tables as T
from gridtide.operators.labels import with_label
from gridtide.operators.summary import summarise
from tests.grid import COUNTRIES, groups, is_flooded, label_of, make_cells

FLOOD = "Flooded_100"
DIMS = list(S.DIMENSIONS.values())
TOTALS = [S.POPULATION, *(S.exposure_column(y) for y in S.YEARS)]


@pytest.fixture(scope="module", params=[False, True], ids=["even", "hot"])
def cells(spark, request):
    data = make_cells(hot=request.param)
    frame = spark.createDataFrame(data)
    return data, frame.repartition(5)


def labels(dim):
    return COUNTRIES if dim is S.COUNTRY else None


def rows_of(frame):
    return [r.asDict() for r in frame.collect()]


def close(a, b):
    if a is None or (isinstance(b, float) and math.isnan(b)):
        return a is None and (b is None or math.isnan(b))
    return a == pytest.approx(b, rel=1e-9, abs=1e-12)


def check(table, expected):
    """Same keys in report order and the same values."""
    found = rows_of(table)
    keys = sorted(expected, key=lambda k: (not k[0], k[1], k[2]))
    assert [(r["Category"], r[S.AGE]) for r in found] == [(k[1], k[2]) for k in keys]
    for row, key in zip(found, keys):
        for name, value in expected[key].items():
            assert close(row[name], value), (key, name, row[name], value)


@pytest.mark.parametrize("dim", DIMS, ids=lambda d: d.name)
def test_flood(cells, dim):
    data, frame = cells
    expected = {}
    for key, group in groups(data, dim).items():
        flooded = sum(map(is_flooded, group[FLOOD]))
        expected[key] = {
            "Total_Grid_Count": len(group),
            "Flooded_Grid_Count": flooded,
            "Total_Area_km2": len(group) * 0.01,
            "Flooded_Area_km2": flooded * 0.01,
            "Flood_Area_Ratio_Percent": flooded / len(group) * 100,
        }
    check(T.flood_table(summarise(frame, [dim], flood=FLOOD), dim, labels(dim)), expected)


@pytest.mark.parametrize("exclude_zero", [True, False])
@pytest.mark.parametrize("dim", DIMS, ids=lambda d: d.name)
def test_environment(cells, dim, exclude_zero):
    data, frame = cells
    expected = {}
    for key, group in groups(data, dim).items():
        expected[key] = {}
        for column in S.ENVIRONMENT:
            values = group[column].dropna()
            values = values[values != 0] if exclude_zero else values
            n = len(values)
            std = float(values.std(ddof=0)) if n else None
            expected[key] |= {
                f"{column}_Mean": float(values.mean()) if n else None,
                f"{column}_n": n,
            }
            # The DEM has a large common offset and a tiny spread.
            expected[key][f"{column}_Std"] = std
            expected[key][f"{column}_SE"] = std / math.sqrt(n) if n else None
    table = T.environment_table(summarise(frame, [dim], moments=S.ENVIRONMENT, exclude_zero=exclude_zero), dim, labels(dim))
    found = rows_of(table)
    keys = sorted(expected, key=lambda k: (not k[0], k[1], k[2]))
    assert [(r["Category"], r[S.AGE]) for r in found] == [(k[1], k[2]) for k in keys]
    for row, key in zip(found, keys):
        for name, value in expected[key].items():
            assert row[name] == (None if value is None else pytest.approx(value, rel=1e-6, abs=1e-9)), (key, name)


@pytest.mark.parametrize("dim", DIMS, ids=lambda d: d.name)
def test_exposure(cells, dim):
    data, frame = cells
    expected = {}
    for key, group in groups(data, dim).items():
        people, exposed = group["POP_2025"].sum(), group["POP_Exposure_2025"].sum()
        expected[key] = {
            "Total_Population": people,
            "Total_Exposure": exposed,
            "Exposure_Ratio_Percent": exposed / people * 100 if people > 0 else None,
        }
    state = summarise(frame, [dim], totals=[S.POPULATION, S.EXPOSED_POPULATION])
    check(T.exposure_table(state, dim, labels(dim)), expected)
    if dim is S.COUNTRY:
        by_age = {r[S.AGE]: r for r in rows_of(T.exposure_global_table(state))}
        assert {a: r["Total_Exposure"] for a, r in by_age.items()} == {
            k[2]: v["Total_Exposure"] for k, v in expected.items() if k[0]
        }
        assert by_age[50]["Exposure_Ratio_Percent"] is None


def test_area(cells):
    data, frame = cells
    found = groups(data, S.DEVELOPMENT)
    totals = {}
    for (is_all, name, _), group in found.items():
        totals[is_all, name] = totals.get((is_all, name), 0) + len(group)
    expected = {
        k: {"Grid_Count": len(g), "Area_km2": len(g) * 0.01, "Ratio_Percent": len(g) / totals[k[:2]] * 100}
        for k, g in found.items()
    }
    check(T.area_table(summarise(frame, [S.DEVELOPMENT])), expected)
    only_all = T.area_table(summarise(frame.drop("Developed"), [S.DEVELOPMENT]))
    check(only_all, {k: v for k, v in expected.items() if k[0]})


def test_years(cells):
    data, frame = cells
    valid = data[data[S.AGE].isin(S.AGES)]
    wanted = {}
    for _, row in valid.iterrows():
        label = label_of(S.COUNTRY, row["Country"])
        if label is not None:
            sums = wanted.setdefault(label, dict.fromkeys(S.YEARS, 0.0))
            for year in S.YEARS:
                value = row[S.exposure_column(year)]
                sums[year] += 0.0 if math.isnan(value) else value
    state = summarise(frame, [S.COUNTRY, S.INCOME], totals=TOTALS)
    wide = {r["Country"]: r for r in rows_of(T.country_year_table(state, COUNTRIES))}
    assert {k: {y: r[str(y)] for y in S.YEARS} for k, r in wide.items()} == wanted
    long = T.years_to_rows(T.country_year_table(state, COUNTRIES), "Country")
    assert {(r["Country"], r["Year"]): r["Total"] for r in rows_of(long)} == {
        (k, y): v for k, sums in wanted.items() for y, v in sums.items()
    }
    ranked = rows_of(T.country_rank_table(state, COUNTRIES))
    order = sorted(wanted, key=lambda k: (-wanted[k][2025], k))
    assert [(r["Rank"], r["Country"]) for r in ranked] == list(enumerate(order, 1))
    income = {r["Income"]: r for r in rows_of(T.income_year_table(state))}
    assert set(income) == set(S.INCOME_LABELS.values())
    for code, label in S.INCOME_LABELS.items():
        rows = valid[valid["Income_Classification"] == code]
        for year in S.YEARS:
            assert income[label][str(year)] == rows[S.exposure_column(year)].sum()
    assert income["Upper Middle Income"]["1990"] == 0.0


def test_absent_years_are_zero_in_the_rank_table_only(spark):
    data = make_cells(60)[[S.AGE, "Country", "POP_Exposure_1990"]]
    state = summarise(spark.createDataFrame(data), [S.COUNTRY], totals=TOTALS)
    assert T.country_year_table(state, COUNTRIES).columns == ["Country", "1990"]
    row = T.country_rank_table(state, COUNTRIES).first()
    assert row["1990"] > 0 and row["2025"] == 0.0


def test_rank_rounds_half_to_even(spark):
    frame = spark.createDataFrame([(5, 1.0, 2.5), (5, 2.0, 3.5)], f"{S.AGE} int, Country double, POP_Exposure_2025 double")
    found = rows_of(T.country_rank_table(summarise(frame, [S.COUNTRY], totals=TOTALS)))
    assert [(r["Country"], r["2025"]) for r in found] == [("Country_2", 4.0), ("Country_1", 2.0)]


def test_summary(cells):
    data, frame = cells
    valid = data[data[S.AGE].isin(S.AGES)]
    row = T.run_summary(summarise(frame, DIMS, keep_invalid=True), FLOOD).first().asDict()
    assert row == {
        "total_rows": len(data),
        "valid_rows": len(valid),
        "countries_count": valid["Country"].nunique(),
        "continents_count": valid["Sovereig"].nunique(),
        "income_levels_count": valid["Income_Classification"].nunique(),
        "ages_count": valid[S.AGE].nunique(),
        "flood_column": FLOOD,
    }


def test_keeping_invalid_rows_changes_no_table(cells):
    _, frame = cells
    for keep in (True, False):
        state = summarise(frame, DIMS, flood=FLOOD, keep_invalid=keep)
        found = T.flood_table(state, S.CONTINENT).collect()
        if keep:
            first = found
    assert first == found


def test_missing_columns_give_empty_tables(spark):
    bare = spark.createDataFrame([(5,), (10,)], f"{S.AGE} int")
    state = summarise(bare, DIMS, flood="nope", moments=S.ENVIRONMENT, totals=TOTALS)
    for dim in DIMS:
        for table in (T.flood_table(state, dim), T.environment_table(state, dim), T.exposure_table(state, dim)):
            assert table.count() == 0 and "Category" in table.columns
    assert T.exposure_global_table(state).count() == 0
    assert T.country_rank_table(state).count() == 0 and T.income_year_table(state).count() == 0
    assert T.years_to_rows(T.country_year_table(state), "Country").count() == 0
    assert T.area_table(state).count() == 2
    some = summarise(bare.selectExpr("*", "1.5D AS DEM", "1.0D AS Developed"), [S.DEVELOPMENT], moments=S.ENVIRONMENT)
    row = T.environment_table(some, S.DEVELOPMENT).first()
    assert (row["DEM_Mean"], row["DEM_Std"], row["Slope_n"], row["Slope_Mean"]) == (1.5, 0.0, 0, None)
    with pytest.raises(ValueError, match=S.AGE):
        summarise(bare.withColumnRenamed(S.AGE, "x"))


def test_empty_input(spark):
    empty = spark.createDataFrame(make_cells(10)).filter("false")
    state = summarise(empty, DIMS, flood=FLOOD, moments=S.ENVIRONMENT, totals=TOTALS, keep_invalid=True)
    assert T.run_summary(state).first()["total_rows"] == 0
    assert T.area_table(state).count() == T.flood_table(state, S.COUNTRY).count() == 0
    assert T.income_year_table(state).count() == 5


def test_risk_moments_golden(spark):
    values = [0.45, 0.52, 0.48, 0.55, 0.50]
    frame = spark.createDataFrame([(5, 1.0, v) for v in values], f"{S.AGE} int, Developed double, {S.RISK} double")
    state = summarise(frame, [S.DEVELOPMENT], moments=[S.RISK], exclude_zero=False, extremes=True)
    row = T.risk_table(state, S.DEVELOPMENT).first()
    assert (row["Risk_Index_Mean"], row["Risk_Index_n"]) == (pytest.approx(0.50), 5)
    assert row["Risk_Index_Std"] == pytest.approx(0.034, abs=5e-4)
    assert row["Risk_Index_SE"] == pytest.approx(0.015, abs=5e-4)
    assert (row["Risk_Index_Min"], row["Risk_Index_Max"]) == (0.45, 0.55)


@pytest.mark.parametrize(
    "values,kind,flooded",
    [
        ([1, 0, None, 2], "int", 1),
        ([1.0, float("nan"), 0.99], "double", 1),
        ([True, False, None], "boolean", 1),
        (["1", " 1 ", "1.0", "+1", "1e0", "1d", "1f", "true", "abc", "", None, "11"], "string", 5),
    ],
)
def test_flood_flags(spark, values, kind, flooded):
    frame = spark.createDataFrame([(5, 1.0, v) for v in values], f"{S.AGE} int, Developed double, f {kind}")
    row = T.flood_table(summarise(frame, [S.DEVELOPMENT], flood="f"), S.DEVELOPMENT).first()
    assert (row["Flooded_Grid_Count"], row["Total_Grid_Count"]) == (flooded, len(values))


def test_unusable_flood_type(spark):
    frame = spark.sql(f"SELECT 5 AS {S.AGE}, array(1) AS f")
    with pytest.raises(ValueError, match="f has type"):
        summarise(frame, flood="f")


def test_labels(spark):
    codes = [None, float("nan"), 109.0, 109.5, -0.5, 341.0, float("inf"), 1.0]
    frame = spark.createDataFrame([(c, c) for c in codes], "Country double, Developed double")
    expected = [None, None, "China", "China", "Country_0", "Country_341", None, "Country_1"]
    as_frame = spark.createDataFrame([(109, "China"), (109, "China"), (7, "x")], "code int, label string")
    for given in (COUNTRIES, as_frame):
        found = {repr(r["Country"]): r["Label"] for r in with_label(frame, S.COUNTRY, given).collect()}
        assert found == {repr(c): label for c, label in zip(codes, expected)}
    assert with_label(frame, S.COUNTRY, as_frame).count() == len(codes)
    found = {repr(r["Developed"]): r["Label"] for r in with_label(frame, S.DEVELOPMENT).collect()}
    assert found[repr(1.0)] == "Developed" and sum(v is not None for v in found.values()) == 1
    quoted = with_label(frame, S.COUNTRY, {109: "Cote d'Ivoire \\ \"x\""}).filter("Country = 109").first()
    assert quoted["Label"] == "Cote d'Ivoire \\ \"x\""


def test_odd_ages_are_invalid_not_errors(spark):
    ages = [5.0, 5.5, float("nan"), 1e20, float("-inf"), None, 50.0]
    frame = spark.createDataFrame([(a, 1.0) for a in ages], f"{S.AGE} double, Developed double")
    for keep in (True, False):
        found = T.area_table(summarise(frame, [S.DEVELOPMENT], keep_invalid=keep)).filter("Category = 'All'").collect()
        assert [(r[S.AGE], r["Grid_Count"]) for r in found] == [(5, 1), (50, 1)]
    assert T.run_summary(summarise(frame, keep_invalid=True)).first()["total_rows"] == len(ages)
