"""The same operators over Parquet files that arrive one by one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from gridtide import schema as S
from gridtide.functions.hazard import Mapping
from gridtide.operators.distinct import code_sets, merge_sets
from gridtide.operators.labels import Labels
from gridtide.operators.summary import merge
from gridtide.plans.report import CATALOGUE, COUNTED, REPORT_TOTALS, report_catalogue, report_state, report_tables
from gridtide.plans.risk import risk_output
from gridtide.plans.work import written
from gridtide.sources.binding import detect_flood_column
from gridtide.streaming import segments

# Tables of a segment, segments of a tier before they are merged, and how long whoever reads a segment
# that has been merged has to finish.
STATE, CODES = "state", "codes"
FAN, GRACE_SECONDS = 8, 24 * 3600


def read_arriving(
    spark: SparkSession, path: str, schema: StructType, files_per_batch: int | None = None
) -> DataFrame:
    """Stream the Parquet files of a folder, old and new. A stream needs its schema up front."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def stream_risk(
    cells: DataFrame,
    output: str,
    checkpoint: str,
    mapping: Mapping | None = None,
    exposure: str = S.EXPOSURE,
    vulnerability: str = S.VULNERABILITY,
) -> StreamingQuery:
    """Append EAD and risk for every new file; exactly once through the sink's log and checkpoint."""
    return (
        risk_output(cells, mapping, exposure, vulnerability)
        .writeStream.format("parquet")
        .outputMode("append")
        .option("path", output)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_report_state(
    cells: DataFrame,
    output: str,
    checkpoint: str,
    flood: str | None = "auto",
    *,
    exclude_zero: bool = True,
    environment: Sequence[str] = S.ENVIRONMENT,
    dims: Sequence[S.Dimension] = tuple(S.DIMENSIONS.values()),
    totals: Sequence[str] = REPORT_TOTALS,
    fan: int = FAN,
    grace_seconds: float = GRACE_SECONDS,
) -> StreamingQuery:
    """Keep the report state running over all files so far; options as for the batch report.

    A batch is aggregated by itself and stored as a segment (``segments.py``): mergeable rows of the groups
    it touches, and the sets of its raw codes. Nothing is kept in the stream's own state, so it needs no
    watermark and no batch rewrites what it does not change. A replayed batch counts once.
    """
    if flood == "auto":
        flood = detect_flood_column(cells.columns)
    spark = cells.sparkSession
    counted = [dim.column for dim in dims if dim.column in COUNTED]

    def store(arrived: DataFrame, batch: int) -> None:
        state = report_state(
            arrived, flood, exclude_zero=exclude_zero, environment=environment, keep_invalid=True, dims=dims, totals=totals
        )
        segments.add(spark, output, batch, batch, {STATE: state, CODES: code_sets(arrived, counted)})
        segments.compact(spark, output, {STATE: _merged_state, CODES: merge_sets}, fan)
        segments.sweep(spark, output, grace_seconds)

    return (
        cells.writeStream.outputMode("update")
        .foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _merged_state(rows: DataFrame) -> DataFrame:
    keys = [name for name in rows.columns if name in (S.AGE, *S.CODE_COLUMNS)]
    return merge(rows, keys, [name for name in rows.columns if name not in keys])


def _visible(spark: SparkSession, output: str) -> list[segments.Segment]:
    found = segments.visible(segments.finished(spark, output))
    if not found:
        raise FileNotFoundError(f"No finished batch below {output}")
    return found


def latest_report_state(spark: SparkSession, output: str) -> DataFrame:
    """The state over all batches so far, ready for the report tables.

    The frame reads its folders lazily. A running stream keeps them for ``grace_seconds``.
    """
    found = _visible(spark, output)
    rows = segments.read(spark, found, STATE)
    return rows if len(found) == 1 else _merged_state(rows)


def latest_code_sets(spark: SparkSession, output: str) -> DataFrame:
    """The sets of raw codes over all batches so far."""
    found = _visible(spark, output)
    rows = segments.read(spark, found, CODES)
    return rows if len(found) == 1 else merge_sets(rows)


def arrived_report(
    spark: SparkSession,
    output: str,
    labels: Labels = None,
    flood: str | None = None,
    environment: Sequence[str] = S.ENVIRONMENT,
) -> dict[str, DataFrame]:
    """Every report table over all files that a stream has taken so far."""
    state, codes = written(latest_report_state(spark, output)), written(latest_code_sets(spark, output))
    tables = report_tables(state, labels, flood, environment, codes=codes)
    tables[CATALOGUE] = report_catalogue(state, labels, environment)
    return tables


def finish(query: StreamingQuery, timeout: float | None = None) -> None:
    """Wait for an available-now query to take everything there is; raise if it fails or is late."""
    if timeout is None:
        query.awaitTermination()
    elif not query.awaitTermination(timeout):
        query.stop()
        raise TimeoutError(f"Stream did not finish within {timeout} s")
