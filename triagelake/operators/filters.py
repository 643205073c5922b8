"""Metadata filters over incidents."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from triagelake.schema import UNKNOWN

# Ids up to this number are pushed into the scan; more go as a table.
LISTED_IDS = 100

Instant = str | dt.date | dt.datetime


def incident_predicate(
    categories: Sequence[str] | None = None,
    severities: Sequence[str] | None = None,
    after: Instant | None = None,
    before: Instant | None = None,
) -> Column | None:
    """Conjunction of the given filters, None when there are none.

    Dates are inclusive. A list that is given but empty matches nothing. Plain
    comparisons with literals, so all of it reaches the Parquet scan.
    """
    tests = []
    for name, values in [("category", categories), ("severity", severities)]:
        if values is not None:
            tests.append(F.col(name).isin(list(values)) if len(values) else F.lit(False))
    if after is not None:
        tests.append(F.col("created_at") >= instant(after))
    if before is not None:
        tests.append(F.col("created_at") <= instant(before))
    if not tests:
        return None
    combined = tests[0]
    for test in tests[1:]:
        combined = combined & test
    return combined


def instant(value: Instant) -> Column:
    """A date means its midnight."""
    if isinstance(value, str):
        value = dt.datetime.fromisoformat(value)
    elif not isinstance(value, dt.datetime):
        value = dt.datetime.combine(value, dt.time.min)
    if value.tzinfo is None:
        value = value.replace(tzinfo=dt.timezone.utc)
    return F.lit(value)


def filter_incidents(
    df: DataFrame,
    categories: Sequence[str] | None = None,
    severities: Sequence[str] | None = None,
    after: Instant | None = None,
    before: Instant | None = None,
) -> DataFrame:
    predicate = incident_predicate(categories, severities, after, before)
    return df if predicate is None else df.filter(predicate)


def filter_ids(df: DataFrame, **filters) -> DataFrame:
    """Ids only; an id that occurs several times is listed once."""
    return filter_incidents(df, **filters).select("id").distinct()


def union_ids(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Ids that are in any of the tables."""
    ids = first.select("id")
    for other in others:
        ids = ids.unionByName(other.select("id"))
    return ids.distinct()


def intersect_ids(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Ids that are in all of the tables."""
    ids = first.select("id").distinct()
    for other in others:
        ids = ids.join(other.select("id"), "id", "left_semi")
    return ids


def lookup(df: DataFrame, ids: Sequence[str] | DataFrame) -> DataFrame:
    """Incidents with the given ids; unknown ids give no row."""
    if not isinstance(ids, DataFrame):
        if len(ids) <= LISTED_IDS:
            return df.filter(F.col("id").isin(list(ids)))
        ids = df.sparkSession.createDataFrame([(i,) for i in ids], T.StructType([df.schema["id"]]))
    return df.join(ids.select("id").distinct(), "id", "left_semi")


def labelled_only(df: DataFrame) -> DataFrame:
    return df.filter(F.col("category") != UNKNOWN)


def by_time(df: DataFrame) -> DataFrame:
    """Total order by time; the id keeps equal instants apart."""
    return df.orderBy("created_at", "id")
