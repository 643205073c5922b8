"""Vector expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from triagelake.functions.binding import bind
from triagelake.functions.text import _col


def l2_normalize(vec: str | Column) -> Column:
    """Unit-length form of an array of numbers; a zero vector stays zero."""
    values = F.transform(_col(vec), lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x * x))
    return bind(
        F.when(norm > 0, norm).otherwise(1.0), lambda n: F.transform(_col(vec), lambda x: x.cast("double") / n)
    )


def dot(a: str | Column, b: str | Column) -> Column:
    """Inner product in double precision."""
    products = F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)
