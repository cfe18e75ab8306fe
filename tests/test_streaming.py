import os
import pathlib

import pytest
from pyspark.sql import functions as F

from gridtide import schema as S
from gridtide.operators import tables as T
from gridtide.operators.distinct import code_sets
from gridtide.plans.report import build_report, report_state
from gridtide.plans.risk import risk_output
from gridtide.sources import storage
from gridtide.streaming import incremental as I, segments as G
from tests.grid import COUNTRIES, make_cells
from tests.test_report import same_rows
from tests.test_risk import NAMES, PERIODS

FLOOD = "Flooded_100"


def test_report_state_follows_arriving_files(spark, folder):
    data = make_cells(600)
    source, state, checkpoint = f"{folder}/in", f"{folder}/state", f"{folder}/checkpoint"
    schema = spark.createDataFrame(data).schema
    with pytest.raises(FileNotFoundError):
        I.latest_report_state(spark, state)
    for start, stop in ((0, 250), (250, 600)):
        spark.createDataFrame(data[start:stop], schema).repartition(3).write.mode("append").parquet(source)
        cells = I.read_arriving(spark, source, schema, files_per_batch=2)
        I.finish(I.stream_report_state(cells, state, checkpoint, FLOOD), 300)
        found = I.latest_report_state(spark, state)
        wanted = report_state(spark.createDataFrame(data[:stop], schema), FLOOD, keep_invalid=True)
        sets = code_sets(spark.createDataFrame(data[:stop], schema))
        overview = T.run_summary(found, FLOOD, codes=I.latest_code_sets(spark, state))
        assert overview.collect() == T.run_summary(wanted, FLOOD, codes=sets).collect()
        for dim in S.DIMENSIONS.values():
            labels = COUNTRIES if dim is S.COUNTRY else None
            assert T.flood_table(found, dim, labels).collect() == T.flood_table(wanted, dim, labels).collect()
            same_rows(T.environment_table(found, dim, labels), T.environment_table(wanted, dim, labels))


def arrivals(spark, folder, files, name="in"):
    data = make_cells(40 * files)
    schema = spark.createDataFrame(data).schema
    for at in range(files):
        spark.createDataFrame(data[40 * at : 40 * at + 40], schema).coalesce(1).write.mode("append").parquet(f"{folder}/{name}")
    return data, schema, I.read_arriving(spark, f"{folder}/{name}", schema, files_per_batch=1)


@pytest.mark.parametrize("fan", [2, 3, 100])
def test_arrived_report_equals_the_batch_report(spark, folder, fan):
    data, schema, cells = arrivals(spark, folder, 7)
    I.finish(I.stream_report_state(cells, f"{folder}/state", f"{folder}/c", FLOOD, fan=fan, grace_seconds=0), 600)
    left = G.visible(G.finished(spark, f"{folder}/state"))
    # Seven in base two and three; without merging all seven stay.
    assert [s.last - s.first + 1 for s in left] == {2: [4, 2, 1], 3: [3, 3, 1], 100: [1] * 7}[fan]
    assert (left[0].first, left[-1].last) == (0, 6)
    found = I.arrived_report(spark, f"{folder}/state", COUNTRIES, FLOOD)
    wanted = build_report(spark.createDataFrame(data, schema), COUNTRIES, FLOOD)
    assert set(found) == set(wanted)
    for name, table in wanted.items():
        same_rows(found[name], table)


def test_merged_segments_are_deleted_after_the_grace_time(spark, folder):
    _, _, cells = arrivals(spark, folder, 4)
    for name, grace, left in (("now", 0, 1), ("later", 3600, 7)):
        I.finish(I.stream_report_state(cells, f"{folder}/{name}", f"{folder}/c_{name}", FLOOD, fan=2, grace_seconds=grace), 600)
        assert len(G.finished(spark, f"{folder}/{name}")) == left
        assert T.run_summary(I.latest_report_state(spark, f"{folder}/{name}")).first()["total_rows"] == 160


def test_a_batch_writes_what_it_changes(spark, folder):
    """A batch of one group after one of very many writes one row, not the whole state."""
    many = spark.range(20_000).selectExpr(f"5 AS {S.AGE}", "cast(id AS double) AS Country", "1.0D AS Slope")
    many.coalesce(1).write.parquet(f"{folder}/in")
    one = many.limit(1)
    one.write.mode("append").parquet(f"{folder}/in")
    cells = I.read_arriving(spark, f"{folder}/in", many.schema, files_per_batch=1)
    I.finish(I.stream_report_state(cells, f"{folder}/state", f"{folder}/c", None), 300)
    found = G.visible(G.finished(spark, f"{folder}/state"))
    rows = sorted(G.read(spark, [s], I.STATE).count() for s in found)
    assert rows == [1, 20_000]
    size = {s: sum(f.stat().st_size for f in pathlib.Path(s.path.removeprefix("file:"), I.STATE).glob("*.parquet")) for s in found}
    assert min(size.values()) * 10 < max(size.values())
    assert I.latest_report_state(spark, f"{folder}/state").agg(F.sum("cells")).first()[0] == 20_001


def test_replayed_and_unfinished_segments_do_not_count(spark, folder):
    add = lambda low, high: G.add(spark, f"{folder}/s", low, high, {"t": spark.range(low, high + 1)})
    read = lambda: sorted(r["id"] for r in G.read(spark, G.visible(G.finished(spark, f"{folder}/s")), "t").collect())
    add(0, 0)
    add(0, 0)  # a replay
    unfinished = add(1, 1)
    os.remove(f"{unfinished}/{G.DONE}")
    assert read() == [0]
    add(1, 1)
    add(2, 2)
    assert read() == [0, 1, 2]
    merges = {"t": lambda rows: rows}
    assert G.compact(spark, f"{folder}/s", merges, 3) == 1 and G.compact(spark, f"{folder}/s", merges, 3) == 0
    assert read() == [0, 1, 2] and len(G.visible(G.finished(spark, f"{folder}/s"))) == 1
    add(1, 1)  # a replay of what has been merged
    assert read() == [0, 1, 2]
    assert len(G.sweep(spark, f"{folder}/s", 3600)) == 0
    assert len(G.sweep(spark, f"{folder}/s", 0)) == 6 and read() == [0, 1, 2]


def test_stored_text_is_written_once(spark, folder):
    assert storage.create(spark, f"{folder}/x", "one") and not storage.create(spark, f"{folder}/x", "two")
    assert open(f"{folder}/x").read() == "one"


def test_risk_of_arriving_files_is_written_once(spark, folder):
    source, output, checkpoint = f"{folder}/in", f"{folder}/out", f"{folder}/checkpoint"
    for batch in range(2):
        frame = spark.range(batch * 10, batch * 10 + 10).selectExpr(
            "id", *(f"id / {t}D AS {n}" for t, n in zip(PERIODS, NAMES)), "0.5D AS Exposure_Index", "0.7D AS Vulnerability_Index"
        )
        frame.write.mode("append").parquet(source)
        for _ in range(2):  # the second run finds nothing new
            I.finish(I.stream_risk(I.read_arriving(spark, source, frame.schema), output, checkpoint), 300)
    found = spark.read.parquet(output).orderBy("id").collect()
    assert found == risk_output(spark.read.parquet(source)).orderBy("id").collect() and len(found) == 20
