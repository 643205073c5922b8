"""Text projections of an incident row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode blanks plus the four ASCII separators 0x1c-0x1f, which count as blank too.
_BLANK = r"[\s\x1c-\x1f]+"


def has_resolution(resolution: str | Column = "resolution") -> Column:
    """An empty resolution counts as none."""
    return F.coalesce(F.length(_col(resolution)) > 0, F.lit(False))


def query_text(title: str | Column = "title", description: str | Column = "description") -> Column:
    return F.concat(_col(title), F.lit(" "), _col(description))


def embedding_text(
    title: str | Column = "title",
    description: str | Column = "description",
    resolution: str | Column = "resolution",
) -> Column:
    """Title and description, followed by the resolution if there is one."""
    resolved = F.when(has_resolution(resolution), F.concat(F.lit("Resolution: "), _col(resolution)))
    return F.concat_ws(" ", _col(title), _col(description), resolved)


def title_key(title: str | Column = "title") -> Column:
    """The form under which two titles count as the same."""
    return F.regexp_replace(F.lower(_col(title)), rf"(?U)\A{_BLANK}|{_BLANK}\z", "")


def first_chars(col: str | Column, n: int) -> Column:
    return F.substring(_col(col), 1, n)


def two_decimals(score: str | Column) -> Column:
    """A score in [0, 1] with two decimals, rounded from its exact binary value.

    ``format_string('%.2f')`` rounds the decimal rendering half up, so 0.125
    gives 0.13. Here the score is scaled by a power of two into an exact integer
    and rounded half to even: 0.12.
    """
    scale = 1 << 62
    units = (F.least(F.greatest(_col(score), F.lit(0.0)), F.lit(1.0)) * F.lit(float(scale))).cast("bigint")
    hundredfold = units.cast("decimal(20,0)") * F.lit(100).cast("decimal(3,0)")
    whole = F.floor(hundredfold / F.lit(scale).cast("decimal(20,0)")).cast("bigint")
    rest = hundredfold - whole.cast("decimal(20,0)") * F.lit(scale).cast("decimal(20,0)")
    half = F.lit(scale // 2).cast("decimal(24,0)")
    up = (rest > half) | ((rest == half) & (whole % 2 == 1))
    cents = whole + up.cast("bigint")
    return F.concat(
        F.floor(cents / 100).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0")
    )


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c
