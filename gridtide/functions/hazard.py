"""Expected annual damage and the composite risk index as single generated projections."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, functions as F

from gridtide.functions.columns import clip01, finite, number

Mapping = Sequence[tuple[float, str]]


def ead_weights(mapping: Mapping) -> list[tuple[str, float]]:
    """Weight of each hazard column in the trapezoid integral over exceedance probability 1/T.

    The curve is extended flat to probability 0 and 1, so the outermost columns also carry the whole
    outer interval. The integral of a constant 1 normalises the weights.
    """
    curve = sorted((1.0 / period, name) for period, name in mapping)
    points = [0.0, *(p for p, _ in curve), 1.0]
    steps = [right - left for left, right in zip(points, points[1:])]
    last = len(curve) - 1
    raw = []
    for i, (_, name) in enumerate(curve):
        left = steps[i] if i == 0 else steps[i] / 2
        right = steps[i + 1] if i == last else steps[i + 1] / 2
        raw.append((name, left + right))
    total = sum(weight for _, weight in raw)
    return [(name, weight / total) for name, weight in raw]


def ead(mapping: Mapping) -> Column:
    """Normalised expected annual damage in [0, 1], as float32."""
    terms = [finite(number(name)) * F.lit(weight) for name, weight in ead_weights(mapping)]
    return clip01(reduce(add, terms)).cast("float")


def risk_index(hazard: Column, exposure: Column, vulnerability: Column) -> Column:
    """Geometric mean of the three indices, each clipped to [0, 1] with missing as 0, as float32."""
    factors = [clip01(finite(c.cast("double"))) for c in (hazard, exposure, vulnerability)]
    product = factors[0] * factors[1] * factors[2]
    return F.pow(product, F.lit(1.0 / 3.0)).cast("float")
