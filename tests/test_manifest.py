import os
import time

import pytest
from pyspark.sql import functions as F

from gridtide.sources import manifest, sinks, storage
from gridtide.sources.scan import scan_grid, stored_path


class Killed(BaseException):
    """Ends a write as a kill does: nothing cleans up."""


def ids(spark, table):
    return sorted(r["id"] for r in scan_grid(spark, table).collect())


def put(spark, table, rows, **more):
    return manifest.publish(spark, table, lambda path: spark.range(rows).write.parquet(path), **more)


def test_versions_follow_one_another(spark, folder):
    table = f"{folder}/t"
    assert manifest.current(spark, table) is None and stored_path(spark, table) == table
    first = put(spark, table, 3)
    assert ids(spark, table) == [0, 1, 2] and stored_path(spark, table) == first
    open_read = scan_grid(spark, table)
    put(spark, table, 5)
    assert ids(spark, table) == list(range(5))
    assert open_read.count() == 3  # within the grace time the old version stays
    put(spark, table, 1, grace_seconds=0)
    assert ids(spark, table) == [0] and len(os.listdir(f"{table}/_data")) == 1
    assert not os.path.exists(first.removeprefix("file:"))


def test_a_kill_at_every_step_leaves_a_readable_table(spark, folder, monkeypatch):
    table = f"{folder}/t"
    put(spark, table, 2)

    def in_data(path):
        spark.range(9).write.parquet(path)
        os.remove(f"{path}/_SUCCESS")
        raise Killed

    def before_manifest(*_):
        raise Killed

    def cut_short(spark_, path, text=""):
        assert real(spark_, path, text[: len(text) // 2])
        raise Killed

    def after_manifest(*_):
        raise Killed

    real = storage.create
    write = lambda path: spark.range(7).write.parquet(path)
    for step, fill, patched, wanted in (
        ("data", in_data, None, 2),
        ("before the manifest", write, ("create", before_manifest), 2),
        ("within the manifest", write, ("create", cut_short), 2),
        ("after the manifest", write, ("children", None), 7),
    ):
        with monkeypatch.context() as patch:
            if patched and patched[0] == "create":
                patch.setattr(storage, "create", patched[1])
            elif patched:
                patch.setattr(manifest, "sweep", after_manifest)
            with pytest.raises(Killed):
                manifest.publish(spark, table, fill)
        assert ids(spark, table) == list(range(wanted)), step
    put(spark, table, 4, grace_seconds=0)
    assert ids(spark, table) == [0, 1, 2, 3]
    assert len(os.listdir(f"{table}/_data")) == 1
    put(spark, table, 6)
    assert ids(spark, table) == list(range(6))


def test_writers_at_the_same_time_take_different_numbers(spark, folder):
    table = f"{folder}/t"

    def write(path):
        put(spark, table, 3)  # another writer is faster
        spark.range(8).write.parquet(path)

    real, seen = manifest._numbers, []
    manifest._numbers = lambda *a: seen.append(1) or ({} if len(seen) < 3 else real(*a))
    try:
        manifest.publish(spark, table, write)
    finally:
        manifest._numbers = real
    assert ids(spark, table) == list(range(8))
    assert sorted(n.lstrip("0") for n in os.listdir(f"{table}/_manifest") if n.isdigit()) == ["1", "2"]


def test_sweep_keeps_what_may_be_in_use(spark, folder):
    table = f"{folder}/t"
    for rows in (1, 2, 3):
        put(spark, table, rows)
    unfinished = f"{table}/_data/unfinished"
    os.mkdir(unfinished)
    manifest.sweep(spark, table, 3600)
    assert len(os.listdir(f"{table}/_data")) == 4
    old = time.time() - 7200
    os.utime(unfinished, (old, old))
    manifest.sweep(spark, table, 3600)
    assert len(os.listdir(f"{table}/_data")) == 3
    manifest.sweep(spark, table, 0)
    assert len(os.listdir(f"{table}/_data")) == 1 and ids(spark, table) == [0, 1, 2]


def test_sinks_publish(spark, folder):
    table = f"{folder}/t"
    sinks.write_risk(spark.range(4), table, [f"{folder}/in"], versioned=True)
    sinks.write_fields(spark.range(6), table, [], versioned=True)
    assert ids(spark, table) == list(range(6))
    bad = spark.range(5).select(F.raise_error(F.lit("boom")).cast("string").alias("id"))
    with pytest.raises(Exception, match="boom"):
        sinks.write_risk(bad, table, [], versioned=True)
    assert ids(spark, table) == list(range(6))
    with pytest.raises(ValueError, match="overlaps"):
        sinks.write_risk(scan_grid(spark, table), f"{table}/_data", [table], versioned=True)
    sinks.write_risk(spark.range(2), f"{folder}/plain", [])
    with pytest.raises(ValueError, match="not published"):
        sinks.write_risk(spark.range(2), f"{folder}/plain", [], versioned=True)
    sinks.write_risk(spark.range(3), table, [])  # a plain write replaces the whole folder
    assert ids(spark, table) == [0, 1, 2] and stored_path(spark, table) == table
