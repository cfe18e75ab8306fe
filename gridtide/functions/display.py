"""Report values as display text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gridtide.functions.columns import field, is_floating


def display_value(value: Column) -> Column:
    """``N/A`` for missing; no decimals from a million on; scientific below 0.0001; else 6 places."""
    value = F.nanvl(value.cast("double"), F.lit(None))
    size = F.abs(value)
    return (
        F.when(value.isNull(), F.lit("N/A"))
        .when(size >= 1e6, F.format_number(value, 0))
        .when((size < 1e-4) & (size != 0.0), F.format_string("%.2E", value))
        .otherwise(F.format_number(F.round(value, 6), 6))
    )


def whole_value(value: Column) -> Column:
    """``N/A`` for missing, else a whole number with thousands separators."""
    value = F.nanvl(value.cast("double"), F.lit(None))
    return F.when(value.isNull(), F.lit("N/A")).otherwise(F.format_number(F.bround(value, 0), 0))


def format_report_values(table: DataFrame, whole: bool = False) -> DataFrame:
    """Turn every floating column into display text, as whole numbers if asked; other columns stay."""
    shown = whole_value if whole else display_value
    return table.select(
        *(shown(field(f.name)).alias(f.name) if is_floating(f.dataType) else field(f.name) for f in table.schema)
    )


def display_header(name: str, category: str = "Category") -> str:
    """Header of a report column: words for underscores, units in brackets."""
    if name == "Category":
        return category
    text = name.replace("Distance_from_River", "River Dist").replace("Built_Up", "Built-up")
    for ending, unit in (("_Percent", " (%)"), ("_km2", " (km2)")):
        text = text.removesuffix(ending) + unit if text.endswith(ending) else text
    return text.replace("_", " ")


def with_headers(table: DataFrame, category: str = "Category") -> DataFrame:
    return table.select(*(field(name).alias(display_header(name, category)) for name in table.columns))
