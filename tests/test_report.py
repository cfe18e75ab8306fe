import os

import pytest
from pyspark.sql import functions as F

from gridtide import schema as S
from gridtide.functions.display import format_report_values
from gridtide.operators import tables as T
from gridtide.operators.summary import summarise
from gridtide.plans import report as R
from gridtide.plans.work import work_folder, written
from tests.grid import COUNTRIES, make_cells

FLOOD = "Flooded_100"


@pytest.fixture(scope="module")
def cells(spark):
    return spark.createDataFrame(make_cells(hot=True)).repartition(4)


@pytest.fixture(scope="module")
def tables(cells):
    return R.build_report(cells, COUNTRIES)


def same_rows(a, b):
    left, right = a.collect(), b.collect()
    assert len(left) == len(right) > 0
    for x, y in zip(left, right):
        for p, q in zip(x, y):
            assert p == (pytest.approx(q, rel=1e-7, abs=1e-9) if isinstance(q, float) else q)


def test_report_equals_single_tables(cells, tables):
    for dim, suffix in ((S.DEVELOPMENT, "DevStatus"), (S.INCOME, "Income"), (S.CONTINENT, "Continent"), (S.COUNTRY, "Country")):
        used = COUNTRIES if dim is S.COUNTRY else None
        state = summarise(cells, [dim], flood=FLOOD, moments=S.ENVIRONMENT, totals=[S.POPULATION, S.EXPOSED_POPULATION])
        for letter, make in (("B", T.flood_table), ("C", T.environment_table), ("D", T.exposure_table)):
            name = next(s.name for s in R.SHEETS if s.name.startswith(letter) and s.name.endswith(suffix))
            same_rows(tables[name], make(state, dim, used))


def test_catalogue_counts_every_table(tables):
    rows = tables[R.CATALOGUE].collect()
    assert [r["Sheet"] for r in rows] == [s.name for s in R.SHEETS]
    assert {r["Sheet"]: r["Records"] for r in rows} == {s.name: tables[s.name].count() for s in R.SHEETS}
    assert tables[R.OVERVIEW].first()["flood_column"] == FLOOD


def test_unknown_flood_column_disables_flood_tables(cells):
    tables = R.build_report(cells, COUNTRIES, flood="nope")
    assert tables["B4_Flood_Country"].count() == 0 and tables["A_Area_Stats"].count() > 0
    assert tables[R.OVERVIEW].first()["flood_column"] == "N/A"


def test_chosen_environment_factors(cells):
    tables = R.build_report(cells, COUNTRIES, environment=["DEM", "POP_2025"], exclude_zero=False)
    assert "POP_2025_Mean" in tables["C2_Env_Income"].columns and "Slope_Mean" not in tables["C2_Env_Income"].columns
    assert tables["C2_Env_Income"].first()["POP_2025_n"] > 0


def test_write_report(spark, tables, folder):
    names = R.write_report(tables, f"{folder}/out", [f"{folder}/in"], csv=True)
    assert len(names) == len(R.SHEETS) + 3
    for name in ("C1_Env_DevStatus", R.CATALOGUE, R.INCOME_YEARS):
        same_rows(spark.read.parquet(f"{folder}/out/{name}").orderBy(*tables[name].columns[:2]), tables[name].orderBy(*tables[name].columns[:2]))
    text = spark.read.option("header", True).csv(f"{folder}/out/C1_Env_DevStatus_csv")
    assert text.count() == tables["C1_Env_DevStatus"].count() and text.filter("`Slope Mean` = 'N/A'").count() > 0
    assert text.columns[:4] == ["Category", "Built-up Age", "Slope Mean", "Slope Std"] and "River Dist SE" in text.columns
    years = spark.read.option("header", True).csv(f"{folder}/out/D2_Exp_Country_Year_csv")
    assert all("." not in row["2025"] for row in years.collect())
    assert "Income Level" in spark.read.option("header", True).csv(f"{folder}/out/D4_ExpRatio_Income_csv").columns
    assert os.listdir(folder) == ["out"]
    with pytest.raises(ValueError, match="overlaps"):
        R.write_report(tables, folder, [f"{folder}/in"])


def test_a_report_that_fails_leaves_the_old_one_whole(spark, tables, folder):
    R.write_report({"A": spark.range(3).toDF("x")}, f"{folder}/out", [])
    bad = spark.range(3).select(F.raise_error(F.lit("boom")).cast("string").alias("x"))
    with pytest.raises(Exception, match="boom"):
        R.write_report({"A": spark.range(9).toDF("x"), "B": bad}, f"{folder}/out", [], csv=True)
    assert os.listdir(folder) == ["out"] and spark.read.parquet(f"{folder}/out/A").count() == 3


def test_report_scan_is_pushed_and_the_catalogue_is_one_pass(spark, cells, folder):
    cells.write.parquet(f"{folder}/grid")
    state = R.report_state(spark.read.parquet(f"{folder}/grid"), FLOOD)
    assert "In(Built_Up_Age" in state._jdf.queryExecution().executedPlan().toString()
    plan = R.report_catalogue(written(state), COUNTRIES)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") + plan.count("FileScan parquet") <= 2


def test_display(spark):
    values = [None, float("nan"), 1234567.6, -2.5e6, 1.23e-5, 0.0, 0.12345678, 1234.5, 999999.4]
    frame = spark.createDataFrame([(i, v, "t") for i, v in enumerate(values)], "i int, v double, s string")
    found = [r["v"] for r in format_report_values(frame).orderBy("i").collect()]
    assert found == ["N/A", "N/A", "1,234,568", "-2,500,000", "1.23E-05", "0.000000", "0.123457", "1,234.500000", "999,999.400000"]
    assert format_report_values(frame).columns == ["i", "v", "s"]


def test_work_folder_follows_the_session(spark):
    assert work_folder(spark).startswith(spark.conf.get("spark.checkpoint.dir"))
    frame = spark.range(3).selectExpr("id", "CAST(NULL AS string) AS s")
    stored = written(frame)
    assert stored.schema.names == frame.schema.names and stored.count() == 3
    assert "Range" not in stored._jdf.queryExecution().executedPlan().toString()
