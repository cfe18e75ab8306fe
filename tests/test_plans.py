"""The physical plans are the ones the scale calls for."""

import re

import pytest

from gridtide import schema as S
from gridtide.operators import tables as T
from gridtide.operators.fields import derive_field
from gridtide.operators.distinct import code_sets
from gridtide.operators.filters import filter_codes
from gridtide.operators.labels import with_label
from gridtide.operators.summary import summarise
from gridtide.plans.report import report_state
from gridtide.plans.risk import risk_output
from gridtide.sources.profile import statistics_counts
from gridtide.sources.scan import scan_for_report, scan_grid
from tests.grid import COUNTRIES, make_cells
from tests.test_risk import make_input


@pytest.fixture(scope="module")
def cells(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("grid")) + "/t"
    spark.createDataFrame(make_cells(400)).write.parquet(path)
    return spark.read.parquet(path)


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def exchanges(text, kind=""):
    return len(re.findall(rf"(?<!Broadcast)Exchange {kind}", text))


def test_scan_reads_and_filters_only_what_is_needed(cells):
    text = plan(T.flood_table(summarise(cells, [S.DEVELOPMENT], flood="Flooded_100"), S.DEVELOPMENT))
    assert "In(Built_Up_Age, [10,15,20,25,30,35,40,45,5,50])" in text.split("PushedFilters:")[1]
    read = re.search(r"ReadSchema: struct<(.*?)>", text).group(1)
    assert sorted(c.split(":")[0] for c in read.split(",")) == ["Built_Up_Age", "Developed", "Flooded_100"]


def test_cells_are_shuffled_only_as_partial_aggregates(cells):
    text = plan(summarise(cells, list(S.DIMENSIONS.values()), moments=S.ENVIRONMENT, flood="Flooded_100"))
    assert exchanges(text) == 1 and "partial_count" in text.split("Exchange")[-1]
    assert "SortAggregate" not in text and "ObjectHashAggregate" not in text and "Expand" not in text


def test_labels_join_the_aggregate_not_the_cells(cells):
    text = plan(T.environment_table(summarise(cells, [S.COUNTRY], moments=S.ENVIRONMENT), S.COUNTRY, COUNTRIES))
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text and "CartesianProduct" not in text
    join = text.index("BroadcastHashJoin")
    assert join < text.index("partial_count")
    # Aggregate of the cells, two levels of merging, report order.
    assert exchanges(text) == 4 and "Python" not in text
    assert "Window" not in text and "__salt" in text


def test_row_labels_broadcast_the_dictionary(cells):
    text = plan(with_label(cells, S.INCOME))
    assert "BroadcastHashJoin" in text and exchanges(text) == 0


def test_risk_is_one_projection(spark, folder):
    make_input(spark, f"{folder}/in")
    text = plan(derive_field(risk_output(scan_grid(spark, f"{folder}/in")), "x", "[Risk_Index] ^ 2 / [id]"))
    assert exchanges(text) == 0 and "Join" not in text and "Python" not in text
    assert text.count("FileScan") == 1


def test_report_reads_the_cells_once(cells):
    text = plan(report_state(cells, "Flooded_100"))
    assert text.count("FileScan") == 1 and exchanges(text) == 1
    assert set(scan_for_report(cells, None).columns) == set(cells.columns) - {"Flooded_100"}


def test_code_filters_reach_the_scan(spark, cells):
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    text = plan(filter_codes(cells, {"Developed": 2, "Sovereig": [10, 11], S.AGE: (">=", 35)}))
    pushed = text.split("PushedFilters:")[1]
    for part in ("EqualTo(Developed,2.0)", "In(Sovereig, [10.0,11.0])", "GreaterThanOrEqual(Built_Up_Age,35)"):
        assert part in pushed
    spark.conf.unset("spark.sql.maxMetadataStringLength")


def test_merged_moments_have_no_window(cells):
    state = summarise(cells, list(S.DIMENSIONS.values()), moments=S.ENVIRONMENT)
    for dim in S.DIMENSIONS.values():
        assert "Window" not in plan(T.environment_table(state, dim, COUNTRIES))


def test_code_sets_shuffle_distinct_combinations(spark, cells):
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    text = plan(code_sets(cells))
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "Python" not in text and "In(Built_Up_Age" in text
    read = re.search(r"ReadSchema: struct<(.*?)>", text).group(1)
    assert sorted(c.split(":")[0] for c in read.split(",")) == sorted([S.AGE, *S.CODE_COLUMNS])


def test_rank_has_no_unpartitioned_window(cells):
    state = summarise(cells, [S.COUNTRY], totals=["POP_Exposure_2025"])
    text = plan(T.country_rank_table(state, COUNTRIES))
    assert "Window" not in text and "SinglePartition" not in text


def test_null_counts_are_pushed_into_the_footers(spark, folder, cells):
    cells.write.parquet(f"{folder}/t")
    text = plan(statistics_counts(spark, f"{folder}/t", ["Slope", "Flooded_100"]))
    assert "PushedAggregation: [COUNT(*), COUNT(Slope), COUNT(Flooded_100)]" in text
    assert "BatchScan" in text and "ReadSchema: struct<count(*):bigint" in text
