"""A value that is used several times within lambdas, computed once for each row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once: what a lambda refers to from outside is computed for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
