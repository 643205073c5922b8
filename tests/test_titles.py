import uuid

import pytest
from pyspark.sql import functions as F

from conftest import ids
from triagelake.operators.dedupe import dedupe_titles
from triagelake.sources.titles import TitleTable, add_titles, ahead_of_stored, compact_titles, open_titles, titles_now, with_key

SCHEMA = "id string, title string, created_at timestamp, n int"


@pytest.fixture
def titles(spark, tmp_path):
    made = []

    def make(buckets=4):
        table = TitleTable(f"titles_{uuid.uuid4().hex}", str(tmp_path / uuid.uuid4().hex), buckets)
        open_titles(spark, table, spark.createDataFrame([], SCHEMA).schema)
        made.append(table.name)
        return table

    yield make
    for name in made:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def rows(spark, n=600):
    """Titles that repeat in other forms, a hot one, empty ones and nulls."""
    i = F.col("id")
    title = F.when(i % 3 == 0, " Hot Title").when(i % 50 == 1, None).when(i % 50 == 2, " ").otherwise(F.concat(F.lit("Title "), i % 90))
    return spark.range(n).select(
        i.cast("string").alias("id"), F.when(i % 2 == 0, F.upper(title)).otherwise(title).alias("title"),
        F.when(i % 40 != 7, F.timestamp_seconds(i * 7919 % 1000)).alias("created_at"), i.cast("int").alias("n"),
    )


def test_increments_equal_a_full_rebuild(spark, titles):
    table, everything = titles(), rows(spark)
    for part in (2, 0, 3, 1):
        add_titles(spark, table, everything.where(F.col("n") % 4 == part))
    assert sorted(titles_now(spark, table).collect()) == sorted(dedupe_titles(everything).collect())
    # Twice is as good as once, and earlier layers are not written again.
    assert add_titles(spark, table, everything).count() == 0
    new = compact_titles(spark, table, f"{table.name}_new", f"{table.path}-new")
    assert spark.table(new.name).count() == titles_now(spark, table).count() < spark.table(table.name).count()
    assert sorted(titles_now(spark, new).collect()) == sorted(dedupe_titles(everything).collect())
    spark.sql(f"DROP TABLE {new.name}")


def test_stored_rows_are_not_shuffled(spark, titles):
    table, everything = titles(8), rows(spark)
    add_titles(spark, table, everything.where("n % 2 = 0"))

    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    increment = with_key(everything.where("n % 2 = 1 and n < 40")).dropDuplicates(["_title_key"])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        fresh = plan(ahead_of_stored(spark, table, increment))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in fresh
    # The branch of the increment ends in its range; what follows is the stored side.
    _, stored = fresh.rsplit("Range (", 1)
    assert "Bucketed: true" in stored and "Exchange" not in stored
    assert "FileScan" in stored and "title#" not in stored.replace("_title_key#", "")
    assert "Exchange" not in plan(titles_now(spark, table))


def test_a_table_is_opened_again(spark, titles):
    table = titles()
    add_titles(spark, table, rows(spark, 50))
    spark.sql(f"DROP TABLE {table.name}")
    open_titles(spark, table, rows(spark, 1).schema)
    assert ids(titles_now(spark, table)) == ids(dedupe_titles(rows(spark, 50)))
    assert add_titles(spark, table, rows(spark, 50)).count() == 0
    assert add_titles(spark, table, rows(spark, 50).limit(0)).count() == 0
