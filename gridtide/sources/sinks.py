"""Parquet outputs. No output may overlap an input, and old results stay until new ones are whole."""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession

from gridtide.operators.layout import clustered
from gridtide.sources import manifest, storage

ROW_GROUP_BYTES = 256 * 1024 * 1024


def refuse_overlap(spark: SparkSession, output: str, inputs: Iterable[str]) -> None:
    """Writing onto, into or around a path that the same plan reads would destroy the input."""
    target = storage.resolve(spark, output)
    for source in inputs:
        if target.overlaps(storage.resolve(spark, source)):
            raise ValueError(f"Output {output} overlaps input {source}")


def default_field_output(input_path: str) -> str:
    folder, name = posixpath.split(input_path.rstrip("/"))
    return posixpath.join(folder, f"calc_{name}")


def write_fields(
    cells: DataFrame,
    output: str,
    inputs: Iterable[str],
    *,
    cluster_by: Sequence[str] = (),
    row_group_bytes: int = ROW_GROUP_BYTES,
    versioned: bool = False,
) -> None:
    """Save an edited table: zstd level 3, large row groups.

    ``cluster_by`` lays the rows out so that filters on these columns skip files and row groups
    (``operators/layout.py``). ``versioned`` publishes by a manifest instead of renames; read the table
    with ``scan_grid``.
    """
    refuse_overlap(cells.sparkSession, output, inputs)
    cells = clustered(cells, cluster_by) if cluster_by else cells
    writer = (
        cells.write.option("compression", "zstd")
        .option("parquet.compression.codec.zstd.level", "3")
        .option("parquet.block.size", row_group_bytes)
    )
    replace_on_success(cells.sparkSession, writer, output, versioned=versioned)


def write_risk(cells: DataFrame, output: str, inputs: Iterable[str], *, versioned: bool = False) -> None:
    """Save the EAD and risk table with snappy; an empty input leaves an empty table with its schema."""
    refuse_overlap(cells.sparkSession, output, inputs)
    replace_on_success(cells.sparkSession, cells.write.option("compression", "snappy"), output, versioned=versioned)


def replace_on_success(
    spark: SparkSession, writer: DataFrameWriter, output: str, source: str = "parquet", *, versioned: bool = False
) -> None:
    """Write beside the target and put it in its place once the job has committed.

    A plain overwrite deletes the old table before the job starts, so a failed job would lose it.
    """
    put_in_place(spark, output, lambda path: writer.mode("errorifexists").format(source).save(path), versioned)


def put_in_place(spark: SparkSession, output: str, write: Callable[[str], None], versioned: bool) -> None:
    """By a manifest, which needs no rename, or by renames, which leave a plain folder."""
    if versioned:
        manifest.publish(spark, output, write)
    else:
        staged(spark, output, write)


def staged(spark: SparkSession, output: str, write: Callable[[str], None]) -> None:
    """Let ``write`` fill a hidden folder beside the output, then put it in the output's place.

    The old output is moved aside first and deleted last, so that at any time one of the two is
    whole. A failed write leaves nothing behind and the old output as it was.
    """
    target = output.rstrip("/")
    folder, name = posixpath.split(target)
    mark = uuid.uuid4().hex
    # Spark's scans of the parent folder skip names that start with an underscore.
    new, old = (posixpath.join(folder, f"_{name}.{kind}-{mark}") for kind in ("new", "old"))
    try:
        write(new)
    except BaseException:
        storage.delete(spark, new)
        raise
    if not storage.exists(spark, target):
        storage.move(spark, new, target)
        return
    storage.move(spark, target, old)
    try:
        storage.move(spark, new, target)
    except BaseException:
        storage.move(spark, old, target)
        storage.delete(spark, new)
        raise
    storage.delete(spark, old)
