import os

import pyarrow.parquet as pq
import pytest

from gridtide import schema as S
from gridtide.operators.filters import filter_codes
from gridtide.operators.layout import CODES, clustered
from gridtide.sources.scan import scan_grid
from gridtide.sources.sinks import write_fields
from tests.grid import make_cells
from tests.test_plans import plan

ROWS = 120_000


@pytest.fixture(scope="module")
def cells(spark):
    """Codes in no order; a third of the cells share all of them, and some codes are far out."""
    rows = spark.range(ROWS).selectExpr("id", "xxhash64(id) AS h").selectExpr(
        "id", f"if(id % 3 = 0, 25, cast(5 * (1 + pmod(h, 10)) AS int)) AS {S.AGE}", "if(id % 3 = 0, 1D, 1D + pmod(h div 16, 2)) AS Developed",
        "if(id % 3 = 0, 2D, cast(pmod(h div 64, 5) AS double)) AS Income_Classification", "if(id % 3 = 0, 10D, 10D + pmod(h div 1024, 7)) AS Sovereig",
        "CASE WHEN id % 3 = 0 THEN 109D WHEN id % 5000 = 1 THEN 1e12 WHEN id % 5000 = 2 THEN NULL ELSE 100D + pmod(h div 65536, 250) END AS Country",
    )
    return rows.repartition(4).cache()


def touched(folder, tests):
    """Row groups that a filter must read by their statistics, and all of them."""
    read = total = 0
    for name in os.listdir(folder):
        if not name.endswith(".parquet"):
            continue
        meta = pq.ParquetFile(f"{folder}/{name}").metadata
        columns = {meta.schema.column(i).name: i for i in range(meta.num_columns)}
        for at in range(meta.num_row_groups):
            stats = {c: meta.row_group(at).column(columns[c]).statistics for c in tests}
            total += 1
            read += all(stats[c].has_min_max and stats[c].min <= v <= stats[c].max for c, v in tests.items())
    return read, total


def test_filters_skip_most_row_groups(spark, folder, cells):
    tests = {"Country": 230.0, S.AGE: 40}
    small = {"row_group_bytes": 16 * 1024}
    write_fields(cells, f"{folder}/plain", [], **small)
    write_fields(cells, f"{folder}/near", [], cluster_by=["Country", S.AGE], **small)
    write_fields(cells, f"{folder}/codes", [], cluster_by=CODES, **small)
    assert touched(f"{folder}/plain", tests)[0] == touched(f"{folder}/plain", tests)[1]
    for name, share in (("near", 0.1), ("codes", 0.4)):
        read, total = touched(f"{folder}/{name}", tests)
        assert total >= 40 and read <= share * total, (name, read, total)
        kept = filter_codes(scan_grid(spark, f"{folder}/{name}"), tests)
        assert sorted(kept.collect()) == sorted(filter_codes(cells, tests).collect())
        assert scan_grid(spark, f"{folder}/{name}").exceptAll(cells).count() == 0


def test_a_hot_group_of_codes_is_spread(spark, cells):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    sizes = [r[1] for r in clustered(cells).selectExpr("spark_partition_id() AS p").groupBy("p").count().collect()]
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) == 4 and max(sizes) < 0.4 * ROWS


def test_edges(spark, folder):
    rows = spark.createDataFrame(make_cells(200)).selectExpr("*", "1 AS __curve_", "double('infinity') AS far", "cast(NULL AS int) AS none")
    found = clustered(rows, [S.AGE, "Country", "far", "none"])
    assert found.columns == rows.columns and found.dtypes == rows.dtypes
    assert sorted(map(str, found.collect())) == sorted(map(str, rows.collect()))
    assert clustered(rows.limit(0)).count() == 0
    with pytest.raises(ValueError, match="nope"):
        clustered(rows, ["nope"])
    assert "Python" not in plan(found)
