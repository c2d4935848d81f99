"""Single evaluation of a column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once a row, whatever the optimizer does with projections."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
