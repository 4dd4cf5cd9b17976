"""Column lookup, coercion and rounding, all as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netbehave.constants import ALIASES, EMPTY_FIELD, UNSET_FIELD


def ref(name: str) -> Column:
    """Column by exact name, also when the name contains a dot."""
    return F.col(f"`{name}`")


def find(df: DataFrame, logical: str) -> str | None:
    """First existing name of a logical column; presence counts, not values."""
    return next((name for name in ALIASES[logical] if name in df.columns), None)


def has(df: DataFrame, *logical: str) -> bool:
    return all(find(df, item) for item in logical)


def value(df: DataFrame, logical: str) -> Column:
    """A logical column as it is stored, with NaN read as null."""
    name = find(df, logical)
    if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)):
        return not_nan(ref(name))
    return ref(name)


def number(df: DataFrame, logical: str) -> Column:
    """A logical column as a number; what cannot be read as one is null.

    Numeric columns pass through uncast, so that a comparison still reaches the scan.
    """
    name = find(df, logical)
    if isinstance(df.schema[name].dataType, T.NumericType):
        return value(df, logical)
    return to_double(ref(name))


def whole_number(df: DataFrame, logical: str) -> Column:
    """A logical column as a 64-bit whole number."""
    if isinstance(df.schema[find(df, logical)].dataType, T.IntegralType):
        return value(df, logical).cast("bigint")
    if isinstance(df.schema[find(df, logical)].dataType, T.NumericType):
        return value(df, logical).try_cast("bigint")
    return to_long(value(df, logical))


def not_nan(column: Column) -> Column:
    return F.nanvl(column, F.lit(None))


def to_double(column: Column) -> Column:
    return not_nan(column.try_cast("double"))


def to_long(column: Column) -> Column:
    """Whole number from text: "22" and "22.0" are 22, "abc" is null.

    Exact over the whole 64-bit range. Digits are looked for first because a failed cast
    costs many times what the look does; either way the same text gives the same number.
    """
    return F.when(column.rlike("^[0-9]{1,18}$"), column.try_cast("bigint")).otherwise(
        column.try_cast("decimal(38,18)").try_cast("bigint")
    )


def unset_to_null(column: Column) -> Column:
    """Null for the two tokens that mark a missing value."""
    return F.when(~column.isin(UNSET_FIELD, EMPTY_FIELD), column)


def epoch_time(seconds: Column) -> Column:
    """Timestamp of epoch seconds, exact to the microsecond."""
    return seconds.try_cast("decimal(20,6)").try_cast("timestamp")


def round_places(column: Column, places: int) -> Column:
    """A non-negative double rounded to the nearest decimal, exact ties to even.

    The stored binary value decides, not its shortest text, so 0.10005 (stored slightly
    above) becomes 0.1001. Only the fraction is rounded. It is cut into a short and a small
    part; either times twice the scale is exact, so the sign of ``side`` tells which
    neighbour is nearer. From 2^53 / scale on, doubles lie further apart than decimals, and
    the nearest double to the rounded value is the value itself.
    """
    scale = 10**places
    whole = F.floor(column).cast("double")
    fraction = column - whole
    below = F.floor(fraction * scale).cast("double")
    short = fraction.cast("float").cast("double")
    side = (short * (2 * scale) - (below * 2 + 1)) + (fraction - short) * (2 * scale)
    step = F.when(side > 0, 1).when(side < 0, 0).otherwise((whole * scale + below) % 2)
    rounded = (whole * scale + below + step) / F.lit(float(scale))
    return F.when(column * scale < 2.0**53, rounded).otherwise(column)
