"""Single values of a first pass as literals, so that filters on them reach the scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def value_of(df: DataFrame, aggregate: Column) -> Column:
    """The value of an aggregate over all rows as a literal of its own type.

    It passes as text, which loses nothing and does not depend on the driver's clock zone; a null stays a null.
    """
    found = df.agg(aggregate.alias("v"))
    text = found.select(F.col("v").cast("string")).first()[0]  # one row
    return F.lit(text).cast(found.schema["v"].dataType)
