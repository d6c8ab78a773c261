"""A let-expression for columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once a row.

    Lambdas of array functions evaluate everything inside them for each element; what does not
    depend on the element is bound outside.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
