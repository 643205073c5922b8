from pyspark.sql import functions as F

from conftest import ids as ids_of
from triagelake.operators.filters import LISTED_IDS
from triagelake.sources.points import lookup_points, scan_report, write_points

ROWS = 40_000


def stored(spark, path):
    """Even ids first, odd ones appended, so that the ranges of the files overlap."""
    rows = spark.range(ROWS).select(
        F.format_string("id-%06d", "id").alias("id"), F.sha2(F.col("id").cast("string"), 512).alias("title"), F.col("id").alias("n")
    )
    write_points(rows.where("n % 2 = 0"), path, group_bytes=64 << 10)
    write_points(rows.where("n % 2 = 1"), path, append=True, group_bytes=64 << 10)
    return rows


def test_few_ids_read_few_rows(spark, tmp_path):
    stored(spark, str(tmp_path / "points"))
    wanted = [f"id-{i:06d}" for i in range(5, ROWS, ROWS // 10)]
    found = lookup_points(spark, str(tmp_path / "points"), [*wanted, wanted[0], None, "nothing"])
    assert ids_of(found) == wanted
    report = scan_report(lookup_points(spark, str(tmp_path / "points"), wanted))
    assert report["rows_out"] == 10
    assert report["rows_read"] < ROWS / 5


def test_ids_between_others_are_skipped_by_their_filters(spark, tmp_path):
    stored(spark, str(tmp_path / "points"))
    # Inside the ranges of least and greatest ids, but nowhere stored.
    absent = [f"id-{i:06d}x" for i in range(5, ROWS, ROWS // 10)]
    report = scan_report(lookup_points(spark, str(tmp_path / "points"), absent))
    assert report["rows_out"] == 0
    assert report["rows_read"] < ROWS / 20


def test_many_ids_are_joined(spark, tmp_path):
    rows = stored(spark, str(tmp_path / "points"))
    path = str(tmp_path / "points")
    many = rows.where("n % 100 = 7").select("id")
    assert many.count() > LISTED_IDS
    assert ids_of(lookup_points(spark, path, many)) == ids_of(many)
    assert ids_of(lookup_points(spark, path, ids_of(many))) == ids_of(many)
    few = rows.where("n % 10000 = 7").select("id")
    assert ids_of(lookup_points(spark, path, few)) == ids_of(few)


def test_null_repeated_and_crowded_ids(spark, tmp_path):
    path = str(tmp_path / "points")
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.col("id").cast("string")).alias("id"), F.lit(1).alias("other")
    )
    write_points(rows, path)
    assert lookup_points(spark, path, ["hot"]).count() == 1000
    assert ids_of(lookup_points(spark, path, ["1", "4", "2", None])) == ["1", "4"]
    assert lookup_points(spark, path, []).count() == 0 and lookup_points(spark, path, [None]).count() == 0
    write_points(rows.select("id").limit(0), path)
    assert lookup_points(spark, path, ["hot"]).count() == 0
