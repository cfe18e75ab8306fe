import pytest

from gridtide import schema as S
from gridtide.__main__ import run
from gridtide.sources.scan import scan_grid, stored_path
from gridtide.streaming.incremental import latest_report_state
from tests.grid import make_cells
from tests.test_risk import make_input


def test_profile(spark, folder, capsys):
    spark.range(7).write.parquet(f"{folder}/in")
    run(spark, ["profile", f"{folder}/in"])
    assert "size_gb" in capsys.readouterr().out


def test_fields(spark, folder):
    spark.range(5).selectExpr("id", "id AS a", "id AS b").write.parquet(f"{folder}/in")
    run(spark, ["fields", f"{folder}/in", "--derive", "c=[a] * 2 + [b]", "--drop", "a", "--rename", "c=total", "--order", "total,id"])
    out = spark.read.parquet(f"{folder}/calc_in")
    assert out.columns == ["total", "id"] and out.agg({"total": "sum"}).first()[0] == 30.0
    with pytest.raises(SystemExit):
        run(spark, ["fields", f"{folder}/in", "--derive", "c="])


def test_risk(spark, folder):
    make_input(spark, f"{folder}/in")
    run(spark, ["risk", f"{folder}/in", f"{folder}/out", "--map", "10=Hazard_Index_RP010", "--map", "50=Hazard_Index_RP100"])
    assert S.RISK in spark.read.parquet(f"{folder}/out").columns


def test_report(spark, folder):
    spark.createDataFrame(make_cells(120)).write.parquet(f"{folder}/in")
    spark.createDataFrame([(109, "China")], "code int, label string").write.parquet(f"{folder}/labels")
    run(spark, ["report", f"{folder}/in", f"{folder}/out", "--countries", f"{folder}/labels", "--csv"])
    names = {r["Country"] for r in spark.read.parquet(f"{folder}/out/D2_Exp_Country_Year").collect()}
    assert {"China", "Country_100"} <= names
    assert spark.read.csv(f"{folder}/out/Overview_csv", header=True).count() == 1


def test_fields_options(spark, folder, capsys):
    spark.range(3).selectExpr("id AS b", "'t' AS A", "1.5D AS c").write.parquet(f"{folder}/in")
    run(spark, ["fields", f"{folder}/in", f"{folder}/out", "--add", "d=Int32:7", "--by-type", "--move", "A=top"])
    out = spark.read.parquet(f"{folder}/out")
    assert out.columns == ["A", "b", "c", "d"] and out.dtypes[3] == ("d", "int")
    run(spark, ["fields", f"{folder}/in", f"{folder}/out", "--add", "e=String", "--az"])
    assert spark.read.parquet(f"{folder}/out").columns == ["A", "b", "c", "e"]
    run(spark, ["preview", f"{folder}/in", "--rows", "2", "--order-by", "b"])
    assert "|0  |t  |1.5|" in capsys.readouterr().out


def test_stream_command(spark, folder):
    cells = spark.createDataFrame(make_cells(60))
    cells.write.parquet(f"{folder}/in")
    run(spark, ["stream", "report", f"{folder}/in", f"{folder}/state", f"{folder}/c", "--keep-zeros"])
    assert latest_report_state(spark, f"{folder}/state").count() > 0
    run(spark, ["arrived", f"{folder}/state", f"{folder}/out", "--flood", "Flooded_100", "--versioned"])
    assert spark.read.parquet(f"{stored_path(spark, f'{folder}/out')}/Overview").first()["total_rows"] == 60


def test_published_and_clustered_fields(spark, folder):
    spark.createDataFrame(make_cells(60)).write.parquet(f"{folder}/in")
    run(spark, ["fields", f"{folder}/in", f"{folder}/out", "--cluster-by", f"{S.AGE},Country", "--versioned"])
    assert scan_grid(spark, f"{folder}/out").count() == 60
