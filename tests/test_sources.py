import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from gridtide import schema as S
from gridtide.operators.filters import filter_codes, valid_age
from gridtide.sources import profile, scan, sinks, storage
from tests.conftest import TESTDATA
from tests.grid import make_cells


def parquet_files(folder):
    return [os.path.join(folder, f) for f in os.listdir(folder) if f.endswith(".parquet")]


def test_file_profile(spark, folder):
    spark.range(1000).repartition(3).write.parquet(f"{folder}/t")
    row = profile.file_profile(scan.scan_grid(spark, f"{folder}/t"), 300).first()
    assert row["file_count"] == 3 and row["row_count"] == 1000 and row["estimated_chunks"] == 4
    assert row["size_bytes"] == sum(map(os.path.getsize, parquet_files(f"{folder}/t")))
    assert row["size_gb"] == row["size_bytes"] / 1024**3
    assert row["column_count"] == row["numeric_column_count"] == 1


def test_dataset_profile(spark):
    frame = spark.sql("SELECT id, 'x' AS t, 1.5 AS d, array(1) AS a FROM range(11)")
    assert profile.dataset_profile(frame, 5).first().asDict() == {
        "row_count": 11, "column_count": 4, "numeric_column_count": 2, "estimated_chunks": 3,
    }


def test_field_profile(spark):
    frame = spark.createDataFrame([(1, None), (2, "b")], "`a.x` int, t string").coalesce(1)
    rows = {r["name"]: r for r in profile.field_profile(frame).collect()}
    assert (rows["a.x"]["dtype"], rows["a.x"]["is_numeric"], rows["a.x"]["null_count"]) == ("int", True, 0)
    assert rows["a.x"]["sample_values"] == ["1", "2"]
    assert (rows["t"]["is_numeric"], rows["t"]["null_count"], rows["t"]["sample_values"]) == (False, 1, [None, "b"])
    assert rows["t"]["position"] == 1


def test_preview(spark):
    frame = spark.range(500)
    assert scan.preview(frame).count() == 100
    assert [r["id"] for r in scan.preview(frame.orderBy(F.rand(1)), 3, ["id"]).collect()] == [0, 1, 2]


def test_labels_from_parquet(spark, folder):
    spark.createDataFrame([(7, "x")], "c int, n string").write.parquet(f"{folder}/l")
    frame = scan.read_code_labels(spark, f"{folder}/l", "c", "n")
    assert frame.dtypes == [("code", "bigint"), ("label", "string")]


def test_filters(spark):
    frame = spark.createDataFrame([(5, 1.0), (7, 1.0), (35, 2.0), (None, 3.0)], f"{S.AGE} int, Developed double")
    assert valid_age(frame).count() == 2
    assert filter_codes(frame, {"Developed": [1, 3]}).count() == 3
    assert filter_codes(frame, {S.AGE: (">=", 7), "Developed": 2}).count() == 1
    with pytest.raises(ValueError, match="zz"):
        filter_codes(frame, {"zz": 1})


def test_field_sink_is_zstd(spark, folder):
    sinks.write_fields(spark.range(10).coalesce(1), f"{folder}/out", [f"{folder}/in"])
    meta = pq.read_metadata(parquet_files(f"{folder}/out")[0])
    assert meta.row_group(0).column(0).compression == "ZSTD"
    sinks.write_risk(spark.range(3).coalesce(1), f"{folder}/out", [f"{folder}/in"])
    meta = pq.read_metadata(parquet_files(f"{folder}/out")[0])
    assert meta.row_group(0).column(0).compression == "SNAPPY" and spark.read.parquet(f"{folder}/out").count() == 3
    assert os.listdir(folder) == ["out"]


@pytest.mark.parametrize("output", ["in", "in/part", ".", "link", "./in/"])
def test_overlap_is_refused(spark, folder, output):
    os.mkdir(f"{folder}/in")
    os.symlink(f"{folder}/in", f"{folder}/link")
    with pytest.raises(ValueError, match="overlaps"):
        sinks.refuse_overlap(spark, f"{folder}/{output}", [f"file://{folder}/in"])
    sinks.refuse_overlap(spark, f"{folder}/inner", [f"{folder}/in"])
    sinks.refuse_overlap(spark, "hdfs://h/in2", ["hdfs://h/in"])
    with pytest.raises(ValueError, match="overlaps"):
        sinks.refuse_overlap(spark, "hdfs://h/in/", ["hdfs://h/in"])


@pytest.mark.parametrize(
    ("one", "two", "default"),
    [
        ("/data/in", "hdfs://nn/data/in", "hdfs://nn"),
        ("/data/in", "hdfs://nn:8020/data/in", "hdfs://NN"),
        ("s3://b/x", "s3a://b/x", "file:///"),
        ("hdfs://nn//data/in", "hdfs://nn/data/in", "file:///"),
        ("hdfs://nn/data/./in/../in", "hdfs://nn/data", "file:///"),
        ("file:/data/in", "/data/in/part", "file:///"),
    ],
)
def test_equal_places(one, two, default):
    assert storage.place(one, default).overlaps(storage.place(two, default))


@pytest.mark.parametrize(
    ("one", "two", "default"),
    [
        ("/data/in", "hdfs://nn/data/in", "file:///"),
        ("/data/in", "hdfs://other/data/in", "hdfs://nn"),
        ("s3://b/x", "s3a://c/x", "file:///"),
        ("/data/in", "/data/in2", "hdfs://nn"),
    ],
)
def test_other_places(one, two, default):
    assert not storage.place(one, default).overlaps(storage.place(two, default))


def test_a_failed_write_keeps_the_old_table(spark, folder):
    sinks.write_risk(spark.range(5), f"{folder}/out", [])
    bad = spark.range(5).select(F.raise_error(F.lit("boom")).cast("string").alias("x"))
    with pytest.raises(Exception, match="boom"):
        sinks.write_risk(bad, f"{folder}/out", [])
    assert os.listdir(folder) == ["out"]
    assert spark.read.parquet(f"{folder}/out").count() == 5


def test_default_name():
    assert sinks.default_field_output("/data/a/grid.parquet") == "/data/a/calc_grid.parquet"


def test_null_counts_from_statistics_equal_a_scan(spark, folder):
    cells = spark.createDataFrame(make_cells(300)).selectExpr(
        "*", "if(Slope > 0, named_struct('a', DEM), null) AS nested", "array(DEM) AS list", "nullif(Slope, 0) AS `a.b c`", "cast(NULL AS int) AS none", "1 AS rows"
    )
    cells.repartition(3).write.parquet(f"{folder}/t")
    wanted = profile.field_profile(scan.scan_grid(spark, f"{folder}/t")).drop("sample_values")
    found = profile.stored_field_profile(spark, f"{folder}/t")
    assert found.columns == profile.field_profile(cells).columns
    assert sorted(found.drop("sample_values").collect()) == sorted(wanted.collect())
    few = profile.stored_field_profile(spark, f"{folder}/t", names=["none", "a.b c"]).collect()
    assert sorted((r["name"], r["null_count"] > 0) for r in few) == [("a.b c", True), ("none", True)]
    spark.createDataFrame([], "a int, b string").write.parquet(f"{folder}/empty")
    assert [r["null_count"] for r in profile.stored_field_profile(spark, f"{folder}/empty").collect()] == [0, 0]


def test_null_counts_without_statistics(spark, folder):
    os.mkdir(f"{folder}/t")
    table = pa.table({"a": [1, None, 3], "b": ["x", None, None]})
    pq.write_table(table, f"{folder}/t/one.parquet", write_statistics=False)
    found = profile.stored_field_profile(spark, f"{folder}/t").orderBy("position").collect()
    assert [(r["name"], r["null_count"]) for r in found] == [("a", 1), ("b", 2)]
