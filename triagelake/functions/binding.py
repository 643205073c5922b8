"""Naming an intermediate value inside an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    A lambda such as the one of ``filter`` computes what it refers to again for
    every element, unless that is a column or the parameter of an outer lambda.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
