"""Type classes of columns (schema walk only, never a job).

Two different "numeric" predicates are kept on purpose:

* ``column_class`` — the profiling/feature class: integer, fractional,
  decimal and day-time interval columns are ``numeric``; string-like columns
  are ``categorical``; everything else (boolean, date, timestamp, binary,
  nested) is ``other`` and is profiled but never used as a feature.
* ``is_loose_numeric`` — the looser test used for target typing and upload
  labels: numeric columns **and booleans** count, intervals do not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = "numeric"
CATEGORICAL = "categorical"
OTHER = "other"

_NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
_STRING_TYPES = (T.StringType, T.VarcharType, T.CharType)


def qcol(name: str) -> Column:
    """Column by its exact name (dots, spaces and backticks are part of the name, not paths)."""
    return F.col("`" + name.replace("`", "``") + "`")


def column_class(dtype: T.DataType) -> str:
    if isinstance(dtype, _NUMERIC_TYPES) or isinstance(dtype, T.DayTimeIntervalType):
        return NUMERIC
    if isinstance(dtype, _STRING_TYPES):
        return CATEGORICAL
    return OTHER


def column_classes(df: DataFrame) -> list[tuple[int, str, str]]:
    """``[(position, name, class)]`` in column order."""
    return [(i, f.name, column_class(f.dataType)) for i, f in enumerate(df.schema.fields)]


def is_loose_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, _NUMERIC_TYPES) or isinstance(dtype, T.BooleanType)


def is_fractional(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.FloatType, T.DoubleType))


def missing_mask(name: str, dtype: T.DataType) -> Column:
    """True where the cell is missing: null, or NaN for floating columns."""
    c = qcol(name)
    if is_fractional(dtype):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def normalized(name: str, dtype: T.DataType) -> Column:
    """The column with NaN turned into null and -0.0 into 0.0 (one notion of missing)."""
    c = qcol(name)
    if is_fractional(dtype):
        return F.when(~F.isnan(c), c + F.lit(0.0).cast(dtype))
    if isinstance(dtype, T.DayTimeIntervalType):
        return (F.unix_micros(F.timestamp_seconds(F.lit(0)) + c) / F.lit(1e6))
    return c


def as_text(name: str, dtype: T.DataType) -> Column:
    """Injective text form of a cell (missing stays null) for frequency tables."""
    c = normalized(name, dtype)
    if isinstance(dtype, T.BinaryType):
        return F.hex(c)
    if isinstance(dtype, _STRING_TYPES):
        return c
    return c.cast("string")
