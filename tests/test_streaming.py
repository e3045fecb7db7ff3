"""Streams: pulls above a mark, upserts of repeated batches, the trading desk and its timers."""

import datetime as dt

from sextant.operators import risk
from sextant.sources import storage
from sextant.streaming import ingest

PRICES = "symbol string, d date, close double"


def day(n):
    return dt.date(2024, 1, n)


def test_a_late_file_adds_days_above_the_mark_only(spark, tmp_path):
    table = storage.KeyedTable(spark, str(tmp_path / "t"), ["symbol", "d"], PRICES, 4)
    landings = [[("a", day(1), 1.0), ("a", day(5), 5.0), ("b", day(9), 9.0)], [("a", day(3), 3.0), ("a", day(5), 55.0), ("a", day(6), 6.0), ("b", day(8), 8.0), ("c", day(1), 1.0)]]
    for rows in landings:
        spark.createDataFrame(rows, PRICES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        ingest.pull(ingest.landed(spark, str(tmp_path / "in"), PRICES), table, str(tmp_path / "ck")).awaitTermination()
    assert {tuple(r) for r in table.read().collect()} == {("a", day(1), 1.0), ("a", day(5), 5.0), ("b", day(9), 9.0), ("a", day(6), 6.0), ("c", day(1), 1.0)}


def test_upserts_overwrite_by_key(spark, tmp_path):
    table = storage.KeyedTable(spark, str(tmp_path / "t"), ["symbol", "d"], PRICES, 4)
    for close in (1.0, 2.0):
        spark.createDataFrame([("a", day(1), close), (f"s{close}", day(1), close)], PRICES).write.mode("append").parquet(str(tmp_path / "in"))
        ingest.upserts(ingest.landed(spark, str(tmp_path / "in"), PRICES), table, str(tmp_path / "ck")).awaitTermination()
    assert {tuple(r) for r in table.read().collect()} == {("a", day(1), 2.0), ("s1.0", day(1), 1.0), ("s2.0", day(1), 2.0)}


def test_the_desk_streams_and_a_timer_ends_the_day(spark, tmp_path):
    schema = "book long, seq long, timestamp timestamp, size double, cost double, pnl double"
    at = lambda d, h: dt.datetime(2024, 1, d, h)
    landings = [
        [(1, 1, at(1, 9), 1.0, 0.9, -4.0), (1, 2, at(1, 10), 0.1, 0.1, None), (2, 1, at(1, 9), 1.0, 0.5, None)],
        [(2, 2, at(2, 9), 1.0, 9.6, None), (2, 3, at(3, 9), 1.0, 9.5, None)],
        [(1, 3, at(4, 9), 0.5, 0.5, None)],
    ]
    rows = []
    for landing in landings:
        spark.createDataFrame(landing, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        desk = ingest.trading_desk(ingest.landed(spark, str(tmp_path / "in"), schema).withWatermark("timestamp", "0 seconds"))
        ingest.started(desk.writeStream.format("parquet").option("path", str(tmp_path / "out")), str(tmp_path / "ck")).awaitTermination()
        rows += landing
    found = spark.read.schema(ingest.OUT).parquet(str(tmp_path / "out"))
    want = risk.trading_desk(spark.createDataFrame(rows, schema).selectExpr("book", "seq", "to_date(timestamp) day", "size", "cost", "pnl")).drop("size", "cost", "pnl")
    assert sorted(map(tuple, found.where("seq is not null").collect())) == sorted(map(tuple, want.select(*found.columns).collect()))
    ended = found.where("seq is null and book = 1").collect()  # book 1 had no trade when its first day ended
    assert ended and not any(r["halted"] or r["day_pnl"] for r in ended)


def test_a_query_runs_again_after_an_interval(spark, tmp_path):
    table = storage.KeyedTable(spark, str(tmp_path / "t"), ["symbol", "d"], PRICES, 2)
    spark.createDataFrame([("a", day(1), 1.0)], PRICES).write.parquet(str(tmp_path / "in"))
    running = ingest.upserts(ingest.landed(spark, str(tmp_path / "in"), PRICES), table, str(tmp_path / "ck"), every="1 second")
    try:
        running.processAllAvailable()
        spark.createDataFrame([("b", day(1), 1.0)], PRICES).write.mode("append").parquet(str(tmp_path / "in"))
        running.processAllAvailable()
        assert table.read().count() == 2 and running.isActive
    finally:
        running.stop()


def test_the_desk_takes_neighbouring_books_in_one_group(spark, tmp_path):
    schema = "book long, seq long, timestamp timestamp, size double, cost double, pnl double"
    at = lambda d, h: dt.datetime(2024, 1, d, h)
    first = [(b, s, at(1 + b % 2, 9 + s), 1.0, 0.5 + b / 100, -2.5 if b % 3 == 0 else None) for b in (*range(128), 1 << 40, None) if b is not None for s in range(3)]
    landings = [[*first, (None, 1, at(1, 9), 1.0, 0.5, None)], [(b, 5, at(3, 9), 1.0, 0.5, None) for b in range(0, 128, 2)], [(5, 6, at(5, 9), 1.0, 0.5, None)]]
    rows, states = [], []
    for landing in landings:
        spark.createDataFrame(landing, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        desk = ingest.trading_desk(ingest.landed(spark, str(tmp_path / "in"), schema).withWatermark("timestamp", "0 seconds"))
        running = ingest.started(desk.writeStream.format("parquet").option("path", str(tmp_path / "out")), str(tmp_path / "ck"))
        running.awaitTermination()
        states.append(running.lastProgress["stateOperators"][0]["numRowsTotal"])
        rows += landing
    assert states[-1] == 4  # 0 to 63, 64 to 127, the one far off, and null
    found = spark.read.schema(ingest.OUT).parquet(str(tmp_path / "out"))
    want = risk.trading_desk(spark.createDataFrame(rows, schema).selectExpr("book", "seq", "to_date(timestamp) day", "size", "cost", "pnl")).drop("size", "cost", "pnl")
    assert sorted(map(repr, map(tuple, found.where("seq is not null").collect()))) == sorted(map(repr, map(tuple, want.select(*found.columns).collect())))
    ended = {}
    for r in found.where("seq is null").collect():
        assert not r["halted"] and r["day_pnl"] == 0
        ended[r["book"]] = ended.get(r["book"], 0) + 1
    assert all(ended[b] >= 1 for b in (*range(128), 1 << 40, None)) and ended[4] == ended[2] and ended[1] == 1
