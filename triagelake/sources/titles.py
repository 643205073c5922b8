"""One incident per title, kept up by increments.

The stored rows lie in buckets of their titles. An increment is brought to the buckets and held against
what is stored there; the stored rows stay where they are, and only the keys and the order of them
are read. What an increment adds becomes a layer of files of its own.
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from triagelake.functions.text import title_key
from triagelake.operators.ranking import first_per_key
from triagelake.session import cut

KEY = "_title_key"


@dataclasses.dataclass(frozen=True)
class TitleTable:
    """Name in the session's catalog, folder, number of buckets, and the columns by which the first row of a title is told."""

    name: str
    path: str
    buckets: int = 200
    order: tuple[str, ...] = ("created_at", "id")

    def place(self) -> Column:
        return F.struct(*self.order)


def open_titles(spark: SparkSession, titles: TitleTable, schema: T.StructType) -> None:
    """Make the table known to the session; what its folder holds already belongs to it.

    So a catalog that forgets its tables with the session will do.
    """
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {titles.name} ({columns}, {KEY} STRING) USING parquet "
        f"CLUSTERED BY ({KEY}) INTO {titles.buckets} BUCKETS LOCATION '{titles.path}'"
    )


def with_key(df: DataFrame) -> DataFrame:
    """Rows without a title share one key, apart from that of an empty title."""
    return df.withColumn(KEY, F.coalesce(F.concat(F.lit("="), title_key()), F.lit("")))


def ahead_of_stored(spark: SparkSession, titles: TitleTable, firsts: DataFrame) -> DataFrame:
    """Rows of ``firsts``, one per title, whose title is not stored or stored only with later rows."""
    stored = spark.table(titles.name).groupBy(F.col(KEY).alias("_stored_key")).agg(F.min(titles.place()).alias("_stored"))
    joined = firsts.join(stored, F.col(KEY) == F.col("_stored_key"), "left")
    return joined.where(F.col("_stored_key").isNull() | (titles.place() < F.col("_stored"))).select(*firsts.columns)


def add_titles(spark: SparkSession, titles: TitleTable, increment: DataFrame) -> DataFrame:
    """Add what the increment brings anew; returns those rows.

    A title that is stored is added again only if the increment has an earlier row of it, by
    ``titles.order``, nulls first. Adding an increment twice adds nothing the second time. An
    increment with a title that fills it is cut to one row per title and task before it is shuffled.
    """
    firsts = first_per_key(with_key(increment), [KEY], [F.col(c) for c in titles.order])
    fresh = cut(ahead_of_stored(spark, titles, cut(firsts, "titles-first")), "titles-fresh")
    # A task for each bucket, so that an increment brings one file to a bucket at most.
    stored = fresh.select(*spark.table(titles.name).columns).repartition(titles.buckets, KEY)
    stored.write.mode("append").format("parquet").bucketBy(titles.buckets, KEY).saveAsTable(titles.name)
    return fresh.drop(KEY)


def titles_now(spark: SparkSession, titles: TitleTable) -> DataFrame:
    """The first row of every title over all layers, found bucket by bucket without a shuffle."""
    return first_per_key(spark.table(titles.name), [KEY], [F.col(c) for c in titles.order]).drop(KEY)


def compact_titles(spark: SparkSession, titles: TitleTable, name: str, path: str) -> TitleTable:
    """A table of one layer with the rows as they stand; the old one is left as it is."""
    new = dataclasses.replace(titles, name=name, path=path)
    now = titles_now(spark, titles)
    open_titles(spark, new, now.schema)
    rows = with_key(now).select(*spark.table(name).columns).repartition(new.buckets, KEY)
    rows.write.mode("append").format("parquet").bucketBy(new.buckets, KEY).saveAsTable(name)
    return new
