"""Numeric helpers."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def r6(col: Column | str) -> Column:
    """Round to 6 decimals, never negative zero."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(F.abs(c) < F.lit(5e-7), F.lit(0.0)).otherwise(F.round(c, 6))


def safe_ratio(num: Column, den: Column) -> Column:
    """``num / den``, 0 when the denominator is 0."""
    return F.when(den == 0, F.lit(0.0)).otherwise(F.try_divide(num.cast("double"), den.cast("double")))


def f1_of(precision: Column, recall: Column) -> Column:
    return safe_ratio(2 * precision * recall, precision + recall)


def nan_to_null(col: Column) -> Column:
    return F.when(~F.isnan(col), col)
