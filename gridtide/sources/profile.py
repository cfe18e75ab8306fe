"""Dataset, file and field profiles, each as a DataFrame."""

from __future__ import annotations

from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, MapType, NumericType, StructField, StructType

from gridtide.functions.columns import field
from gridtide.sources.scan import scan_grid

CHUNK_ROWS = 500_000
_NESTED = (StructType, ArrayType, MapType)


def dataset_profile(cells: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """One row: rows, columns, numeric columns and how many chunks of ``chunk_rows`` that makes."""
    rows = F.count(F.lit(1))
    return cells.agg(
        rows.alias("row_count"),
        *_shape(cells),
        F.ceil(rows / F.lit(chunk_rows)).alias("estimated_chunks"),
    )


def file_profile(cells: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``dataset_profile`` and files, bytes and GB, for a frame that scans files.

    Spark names each row's file and its size, so this works on any storage that Spark reads, and no
    data column is read. A file counts if it holds rows.
    """
    files = cells.groupBy(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes"))
    size = F.coalesce(F.sum("bytes"), F.lit(0))
    rows = F.coalesce(F.sum("rows"), F.lit(0))
    return files.agg(F.count(F.lit(1)).alias("rows")).agg(
        F.count(F.lit(1)).alias("file_count"),
        size.alias("size_bytes"),
        (size / F.lit(float(1024**3))).alias("size_gb"),
        rows.alias("row_count"),
        *_shape(cells),
        F.ceil(rows / F.lit(chunk_rows)).alias("estimated_chunks"),
    )


def _shape(cells: DataFrame) -> list[Column]:
    numeric = sum(isinstance(f.dataType, NumericType) for f in cells.schema)
    return [
        F.lit(len(cells.columns)).cast("bigint").alias("column_count"),
        F.lit(numeric).cast("bigint").alias("numeric_column_count"),
    ]


def field_profile(cells: DataFrame, samples: int = 3, names: Sequence[str] | None = None) -> DataFrame:
    """One row per field: position, name, type, numeric or not, null count and first values as text.

    All null counts come from one scan of the fields, or of ``names`` only; the samples from one
    small limit. ``stored_field_profile`` needs no scan for the counts.
    """
    fields = [(i, f) for i, f in enumerate(cells.schema) if names is None or f.name in names]
    counted = cells.agg(
        F.array(
            *(
                F.struct(
                    *(value.alias(name) for name, value in zip(_FACTS, _facts(i, f))),
                    F.count(F.when(field(f.name).isNull(), F.lit(1))).alias("null_count"),
                )
                for i, f in fields
            )
        ).alias("fields")
    ).select(F.inline("fields"))
    return counted.join(_samples(cells, fields, samples), "position")


_FACTS = ("position", "name", "dtype", "is_numeric")


def _facts(position: int, f: StructField) -> list[Column]:
    return [F.lit(position), F.lit(f.name), F.lit(f.dataType.simpleString()), F.lit(isinstance(f.dataType, NumericType))]


def _samples(cells: DataFrame, fields: Sequence[tuple[int, StructField]], samples: int) -> DataFrame:
    return (
        cells.limit(samples)
        .agg(
            F.array(
                *(
                    F.struct(
                        F.lit(i).alias("position"),
                        # The struct keeps nulls, which collect_list alone would drop.
                        F.collect_list(F.struct(field(f.name).cast("string").alias("v")))["v"].alias("sample_values"),
                    )
                    for i, f in fields
                )
            ).alias("fields")
        )
        .select(F.inline("fields"))
    )


def stored_field_profile(
    spark: SparkSession, path: str, samples: int = 3, names: Sequence[str] | None = None
) -> DataFrame:
    """``field_profile`` of a Parquet table, with null counts from the statistics in its files.

    Rows and present values per column come from aggregates that Spark pushes into the files' footers,
    so no column is read. Nested columns have no such statistics and are counted by a scan of them
    alone; so are all columns where a writer has left the statistics out.
    """
    cells = scan_grid(spark, path)
    fields = [(i, f) for i, f in enumerate(cells.schema) if names is None or f.name in names]
    flat = [f for _, f in fields if not isinstance(f.dataType, _NESTED)]
    nested = [f for _, f in fields if isinstance(f.dataType, _NESTED)]
    try:
        counts = statistics_counts(spark, path, [f.name for f in flat]).first()
    except (PySparkException, Py4JJavaError) as error:
        if "aggregatePushdown" not in str(error):
            raise
        counts = _present(cells, [f.name for f in flat]).first()
    present = dict(zip([f.name for f in flat], counts[1:]))
    if nested:
        present |= zip([f.name for f in nested], _present(cells, [f.name for f in nested]).first()[1:])
    # Pushed counts over no rows at all come back as nulls.
    rows = [(i, (counts[0] or 0) - (present[f.name] or 0)) for i, f in fields]
    nulls = spark.createDataFrame(rows, "position int, null_count bigint")
    listed = F.array(*(F.struct(*(v.alias(name) for name, v in zip(_FACTS, _facts(i, f)))) for i, f in fields))
    facts = spark.range(1).select(F.inline(listed))
    return facts.join(F.broadcast(nulls), "position").join(_samples(cells, fields, samples), "position")


def statistics_counts(spark: SparkSession, path: str, names: Sequence[str]) -> DataFrame:
    """One row: the number of rows, then of present values of each column, pushed into the footers.

    The frame belongs to a session of its own with the settings that this needs, so that the
    caller's stay as they are.
    """
    own = spark.newSession()
    for name, value in spark.conf.getAll.items():
        if name.startswith("spark.sql.") and own.conf.isModifiable(name):
            own.conf.set(name, value)
    sources = own.conf.get("spark.sql.sources.useV1SourceList").split(",")
    own.conf.set("spark.sql.sources.useV1SourceList", ",".join(s for s in sources if s.strip().lower() != "parquet"))
    own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    return _present(scan_grid(own, path), names)


def _present(cells: DataFrame, names: Sequence[str]) -> DataFrame:
    return cells.agg(F.count(F.lit(1)), *(F.count(field(name)) for name in names))
