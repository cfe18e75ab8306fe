"""The risk pipeline: hazards to EAD to composite risk, and its Parquet-to-Parquet run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridtide import schema as S
from gridtide.functions.columns import field, number
from gridtide.functions.hazard import Mapping, ead, risk_index
from gridtide.operators.fields import put_columns
from gridtide.sources.binding import bind_return_periods, require_columns, validate_mapping, validate_periods
from gridtide.sources.scan import scan_grid
from gridtide.sources.sinks import write_risk


def with_ead(cells: DataFrame, mapping: Mapping | None = None) -> DataFrame:
    """Add ``Hazard_Index_EAD``. Without a mapping the columns are bound by their names."""
    mapping = bind_return_periods(cells.columns) if mapping is None else mapping
    return put_columns(cells, {S.HAZARD_EAD: ead(validate_periods(mapping, cells.columns))})


def with_risk(
    cells: DataFrame, exposure: str = S.EXPOSURE, vulnerability: str = S.VULNERABILITY
) -> DataFrame:
    """Add ``Risk_Index`` from the float32 ``Hazard_Index_EAD``, exposure and vulnerability."""
    require_columns(cells.columns, [S.HAZARD_EAD, exposure, vulnerability])
    risk = risk_index(field(S.HAZARD_EAD), field(exposure), field(vulnerability))
    return put_columns(cells, {S.RISK: risk})


def risk_output(
    cells: DataFrame,
    mapping: Mapping | None = None,
    exposure: str = S.EXPOSURE,
    vulnerability: str = S.VULNERABILITY,
) -> DataFrame:
    """The output table: input columns in order, code columns as double, then the two float32 results.

    One projection over the scan with no shuffle. Earlier results in the input are replaced.
    """
    mapping = bind_return_periods(cells.columns) if mapping is None else mapping
    mapping = validate_mapping(mapping, cells.columns, exposure, vulnerability)
    inputs = cells.select(*(field(n) for n in cells.columns if n not in (S.HAZARD_EAD, S.RISK)))
    codes = {name: number(name) for name in S.CODE_COLUMNS if name in inputs.columns}
    return with_risk(with_ead(put_columns(inputs, codes), mapping), exposure, vulnerability)


def run_risk(
    spark: SparkSession,
    input_path: str,
    output_path: str,
    mapping: Mapping | None = None,
    exposure: str = S.EXPOSURE,
    vulnerability: str = S.VULNERABILITY,
    *,
    versioned: bool = False,
) -> None:
    cells = scan_grid(spark, input_path)
    write_risk(risk_output(cells, mapping, exposure, vulnerability), output_path, [input_path], versioned=versioned)
