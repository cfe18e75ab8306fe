"""Reading grid tables and code dictionaries from Parquet."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from gridtide import schema as S
from gridtide.functions.columns import field
from gridtide.sources import manifest
from gridtide.sources.binding import report_columns, require_columns


def scan_grid(spark: SparkSession, path: str) -> DataFrame:
    """Lazy scan of one Parquet file, a directory of them, or the current version of a published table."""
    return spark.read.parquet(stored_path(spark, path))


def stored_path(spark: SparkSession, path: str) -> str:
    """Where the data of a table is: the path itself, unless the table is published by a manifest."""
    return manifest.current(spark, path) or path


def scan_columns(cells: DataFrame, names: Sequence[str]) -> DataFrame:
    """Keep only these columns; Spark prunes the Parquet read to them."""
    require_columns(cells.columns, names)
    return cells.select(*(field(name) for name in names))


def scan_for_report(
    cells: DataFrame, flood: str | None = None, environment: Sequence[str] = S.ENVIRONMENT
) -> DataFrame:
    return scan_columns(cells, report_columns(cells.columns, flood, environment))


def preview(cells: DataFrame, rows: int = 100, order_by: Sequence[str] = ()) -> DataFrame:
    """The first rows. Without ``order_by`` any rows may come; with it Spark plans a top-n."""
    ordered = cells.orderBy(*(field(name) for name in order_by)) if order_by else cells
    return ordered.limit(rows)


def read_code_labels(spark: SparkSession, path: str, code: str = "code", label: str = "label") -> DataFrame:
    """A code dictionary stored as Parquet, for the ``labels`` parameter of the country operators."""
    return spark.read.parquet(path).select(
        field(code).cast("bigint").alias("code"), field(label).cast("string").alias("label")
    )
