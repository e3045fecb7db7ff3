"""Tables by month and by key: what is read, what is rewritten, what an upsert sets."""

import datetime as dt
import os

from pyspark.sql import functions as F

from sextant.sources import storage

PRICES = "symbol string, d date, close double"


def prices(spark, days=120):
    rows = [(s, dt.date(2020, 1, 1) + dt.timedelta(i), float(i)) for s in "abc" for i in range(days)]
    return spark.createDataFrame(rows, PRICES)


def files_read(df):
    """The files that a scan opens, by its own count."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().apply("numFiles").value()


def test_day_and_month_scans_read_their_months_only(spark, tmp_path):
    table = storage.monthly(prices(spark), str(tmp_path / "p"), files=2)
    assert table.count() == 360 and files_read(table) == 4  # small: one file a month
    day = storage.scan_day(table, "2020-02-10")
    assert day.count() == 3 and files_read(day) == 1
    two = storage.scan_months(table, "2020-02-01", "2020-04-01").where("symbol = 'b'")
    assert two.count() == 60 and files_read(two) == 2
    plan = two._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan and "PushedFilters: [IsNotNull(d)" in plan
    assert storage.scan_months(table, "2021-01-01", "2021-02-01").count() == 0


def folder_files(path):
    return {os.path.join(d, x) for d, _, names in os.walk(path) for x in names if x.endswith(".parquet") and "manifest" not in d}


def test_upserts_rewrite_the_buckets_they_touch(spark, tmp_path):
    table = storage.KeyedTable(spark, str(tmp_path / "t"), ["k"], "k long, x string, y int", buckets=8)
    assert table.read().count() == 0
    assert table.upsert(spark.range(200).select(F.col("id").alias("k"), F.lit("a").alias("x"), F.lit(1).alias("y")), "one") == 8
    live = set(table._manifest()[1].values())
    assert table.upsert(spark.createDataFrame([(5, None)], "k int, x string"), "two") == 1
    after = set(table._manifest()[1].values())
    assert len(after) == 8 and len(live & after) == 7
    assert table.read().where("k = 5").collect() == [(5, None, 1)]  # a null that is supplied is set, an absent field stays
    before = folder_files(tmp_path)
    assert table.upsert(spark.createDataFrame([(5, "zz")], "k int, x string"), "two") == 0  # the batch again
    assert folder_files(tmp_path) == before and table.read().where("x = 'zz'").count() == 0
    assert table.upsert(spark.createDataFrame([], "k int, x string"), "three") == 0
    assert table.read().count() == 200 and table.upsert(spark.createDataFrame([(7, "q")], "k int, x string"), "three") == 0


def test_records_that_lack_fields(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (3, "c", 3)], "k int, x string, y int")
    new = spark.createDataFrame([(1, None, 9, ["x"]), (2, None, None, None), (4, "n", 5, ["x"])], "k int, x string, y int, has array<string>")
    found = {tuple(r) for r in storage.merged(old, new, ["k"], supplied="has").collect()}
    assert found == {(1, None, 1), (2, None, None), (3, "c", 3), (4, "n", None)}


def test_no_update_on_a_weekend(spark):
    universe = spark.createDataFrame([("a",), ("z",)], "symbol string")
    found = {day: storage.resume_points(prices(spark), universe, F.lit(day).cast("date"), weekdays_only=True).count() for day in ("2020-07-03", "2020-07-04", "2020-07-05", "2020-07-06")}
    assert found == {"2020-07-03": 2, "2020-07-04": 0, "2020-07-05": 0, "2020-07-06": 2}


def test_reload_replaces_and_listings_keep_order(spark, tmp_path):
    path = str(tmp_path / "r")
    storage.append(spark.range(3), path)
    storage.append(spark.range(3), path)
    assert spark.read.parquet(path).count() == 6
    storage.reload(spark.range(2), path)
    assert spark.read.parquet(path).count() == 2
    tail = [r["id"] for r in storage.tail(spark.range(100), 50, "id").collect()]
    assert tail == list(range(50, 100))
