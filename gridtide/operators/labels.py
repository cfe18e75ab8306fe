"""Code to label: joins with small dictionaries."""

from __future__ import annotations

import json
from collections.abc import Mapping
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, functions as F

from gridtide.functions.columns import present, quoted
from gridtide.plans.work import written
from gridtide.schema import COUNTRY_FALLBACK_PREFIX, Dimension

# Dictionaries are broadcast up to this many entries; the results are the same beyond it.
BROADCAST_LABELS = 10_000


class Dictionary(NamedTuple):
    """Codes and labels, one row per code, and whether their number is known to be small."""

    rows: DataFrame
    small: bool


Labels = Mapping[int, str] | DataFrame | Dictionary | None


def dictionary(spark: SparkSession, labels: Labels) -> Dictionary:
    """Prepare labels for joins: a Python mapping, or a frame with columns ``code`` and ``label``."""
    if isinstance(labels, Dictionary):
        return labels
    if isinstance(labels, DataFrame):
        rows = labels.groupBy(F.col("code").cast("bigint").alias("code")).agg(F.min("label").alias("label"))
        return Dictionary(rows, _few(rows))
    text = json.dumps({str(int(code)): label for code, label in (labels or {}).items()})
    entries = spark.range(0, 1, 1, 1).select(F.explode(F.from_json(F.lit(text), "map<string, string>")))
    rows = entries.selectExpr("cast(key AS bigint) AS code", "value AS label")
    return Dictionary(rows, len(labels or {}) <= BROADCAST_LABELS)


def _few(rows: DataFrame) -> bool:
    return rows.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS


def _lookup_code(dim: Dimension) -> str:
    """What a code is looked up by: the exact code, or its whole part for the open dimension."""
    code = present(dim.column)
    return code if dim.labels is not None else f"try_cast({code} AS bigint)"


def with_label(rows: DataFrame, dim: Dimension, labels: Labels = None, name: str = "Label") -> DataFrame:
    """Add the label of a dimension's code; null where the row belongs to no group.

    A closed dimension uses its own dictionary and gives null to unknown codes. The country
    dictionary is passed as ``labels``; unknown countries become ``Country_<code>``.

    A dictionary too large to broadcast is first joined to the distinct codes, which are few however
    often one of them occurs, and these then to the rows.
    """
    closed = dim.labels is not None
    known = dictionary(rows.sparkSession, dim.labels if closed else labels)
    code_type = "double" if closed else "bigint"
    right = known.rows.selectExpr(f"cast(code AS {code_type}) AS __code", "label AS __label")
    keyed = rows.selectExpr("*", f"{_lookup_code(dim)} AS __code")
    if not known.small:
        right = written(keyed.select("__code").distinct().join(right, "__code"))
    joined = keyed.join(F.broadcast(right) if known.small or _few(right) else right, "__code", "left")
    label = "__label" if closed else f"coalesce(__label, '{COUNTRY_FALLBACK_PREFIX}' || cast(__code AS string))"
    return joined.selectExpr(*map(quoted, rows.columns), f"{label} AS {quoted(name)}")
