"""Small column helpers: exact references, missing values, IEEE arithmetic."""

from __future__ import annotations

import sys

from pyspark.sql import Column, functions as F
from pyspark.sql.types import BooleanType, DataType, DoubleType, FloatType, NumericType, StringType

INF = float("inf")
MAX_DOUBLE = sys.float_info.max
EXACT_INTEGER_LIMIT = float(2**53)
_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def quoted(name: str) -> str:
    """A column name, which may hold dots, spaces or backticks, for use in SQL text."""
    return "`" + name.replace("`", "``") + "`"


def field(name: str) -> Column:
    return F.col(quoted(name))


def number(name: str) -> Column:
    return field(name).cast("double")


def present(name: str) -> str:
    """SQL text for a column as double, where NaN counts as missing, like null.

    Text, because plans over many columns build several times faster from it than from ``Column``
    calls.
    """
    return f"nanvl(cast({quoted(name)} AS double), NULL)"


def finite(value: Column) -> Column:
    """Missing becomes 0 and an infinity the largest double of its sign."""
    bounded = F.greatest(F.lit(-MAX_DOUBLE), F.least(F.lit(MAX_DOUBLE), value))
    return F.when(value.isNull() | F.isnan(value), F.lit(0.0)).otherwise(bounded)


def clip01(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def equals_one(name: str, dtype: DataType) -> Column:
    """True where the value reads as the number 1; text that is no number is false, as is null."""
    if isinstance(dtype, StringType):
        text = field(name)
        # The usual flags need no parsing. The pattern keeps junk from the cast, which would raise and
        # catch an error per row inside the JVM, and rejects Java literals such as "1d".
        parsed = text.rlike(_NUMBER) & (text.try_cast("double") == 1.0)
        is_one = F.when(text == "1", True).when(text.isin("0", ""), False).otherwise(parsed)
    elif isinstance(dtype, (NumericType, BooleanType)):
        is_one = number(name) == 1.0
    else:
        raise ValueError(f"Flood column {name} has type {dtype.simpleString()}; need number, text or boolean")
    return F.coalesce(is_one, F.lit(False))


def is_floating(dtype: DataType) -> bool:
    return isinstance(dtype, (DoubleType, FloatType))


def divide(num: Column, den: Column) -> Column:
    """IEEE division: x/0 is a signed infinity and 0/0 is NaN, where bare ``/`` raises in ANSI mode.

    ``pow`` gives the infinity with the sign of the zero.
    """
    return F.when(den != 0.0, num / den).otherwise(num * F.pow(den, F.lit(-1.0)))


def _integral(value: Column, rounded: Column) -> Column:
    # Spark's ceil and floor return BIGINT. Doubles from 2^53 on are whole numbers already.
    return F.when(F.abs(value) < EXACT_INTEGER_LIMIT, rounded.cast("double")).otherwise(value)


def floor(value: Column) -> Column:
    return _integral(value, F.floor(value))


def ceil(value: Column) -> Column:
    return _integral(value, F.ceil(value))


def round_half_away(value: Column) -> Column:
    """Nearest whole number, halves away from zero.

    Spark's ``round`` goes through a decimal object per value; this stays with doubles and is as
    exact, since a double minus its floor has no rounding error.
    """
    size = F.abs(value)
    whole = floor(size)
    return F.signum(value) * (whole + F.when(size - whole >= 0.5, F.lit(1.0)).otherwise(F.lit(0.0)))


def floored_modulo(num: Column, den: Column) -> Column:
    """Remainder with the sign of the divisor; NaN for a zero divisor."""
    return num - den * floor(divide(num, den))


def power(base: Column, exponent: Column) -> Column:
    """C ``pow``: unlike Java's, it gives 1 for 1^NaN and for (+-1)^(+-inf)."""
    one = (base == 1.0) & exponent.isNotNull()
    unit_to_infinity = (F.abs(base) == 1.0) & (F.abs(exponent) == INF)
    return F.when(one | unit_to_infinity, F.lit(1.0)).otherwise(F.pow(base, exponent))


def _logarithm(value: Column, log: Column) -> Column:
    return (
        F.when(value > 0.0, log)
        .when(value == 0.0, F.lit(-INF))
        .when(value < 0.0, F.lit(float("nan")))
    )


def log(value: Column) -> Column:
    return _logarithm(value, F.log(value))


def log10(value: Column) -> Column:
    return _logarithm(value, F.log10(value))
