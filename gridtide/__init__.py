"""Flood-risk analytics over grid-cell tables, as plain DataFrame functions."""

from gridtide.operators.fields import (
    add_constant_field,
    derive_field,
    derive_fields,
    drop_fields,
    manage_fields,
    move_field,
    order_fields_az,
    order_fields_by_type,
    rename_fields,
    reorder_fields,
)
from gridtide.operators.filters import filter_codes, valid_age
from gridtide.operators.labels import with_label
from gridtide.operators.summary import summarise
from gridtide.plans.report import build_report, write_report
from gridtide.plans.risk import risk_output, run_risk, with_ead, with_risk
from gridtide.sources.scan import preview, read_code_labels, scan_grid
from gridtide.sources.sinks import write_fields, write_risk

__all__ = [
    "add_constant_field",
    "build_report",
    "derive_field",
    "derive_fields",
    "drop_fields",
    "filter_codes",
    "manage_fields",
    "move_field",
    "order_fields_az",
    "order_fields_by_type",
    "preview",
    "read_code_labels",
    "rename_fields",
    "reorder_fields",
    "risk_output",
    "run_risk",
    "scan_grid",
    "summarise",
    "valid_age",
    "with_ead",
    "with_label",
    "with_risk",
    "write_fields",
    "write_report",
    "write_risk",
]
