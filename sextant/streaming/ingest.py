"""Structured Streaming forms of the ingestion jobs."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from ..operators import risk
from ..sources import storage


def landed(spark: SparkSession, path: str, schema: StructType | str, files: int = 1000) -> DataFrame:
    """Parquet files as they land; what has been read is in the stream's checkpoint."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def started(writer: DataStreamWriter, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """The query, run over what has landed and then ended, or again and again after ``every`` ('4 hours')."""
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def upserts(stream: DataFrame, table: storage.KeyedTable, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Merges each batch into ``table``, in the buckets that it touches; repeated and late rows overwrite, a batch that is
    run again changes nothing."""
    name = uuid.uuid5(uuid.NAMESPACE_URL, checkpoint).hex
    return started(stream.writeStream.foreachBatch(lambda batch, n: table.upsert(batch, f"{name}-{n}")), checkpoint, every)


def newer(rows: DataFrame, stored: DataFrame, key: str = "symbol", by: str = "d") -> DataFrame:
    """Rows later than the latest stored one of their key; all rows of a key that has none."""
    marks = stored.groupBy(key).agg(F.max(by).alias("_mark"))
    return rows.join(marks, key, "left").where(F.col("_mark").isNull() | (F.col(by) > F.col("_mark"))).drop("_mark")


def pull(stream: DataFrame, table: storage.KeyedTable, checkpoint: str, key: str = "symbol", by: str = "d", every: str | None = None) -> StreamingQuery:
    """Adds what is later than the mark of its key: the latest stored day, read again for each batch. Old days that land
    late, and days that land again, change nothing."""
    name = uuid.uuid5(uuid.NAMESPACE_URL, checkpoint).hex
    return started(stream.writeStream.foreachBatch(lambda batch, n: table.upsert(newer(batch, table.read(), key, by), f"{name}-{n}")), checkpoint, every)


def first_articles(stream: DataFrame, lateness: str = "2 days") -> DataFrame:
    """Each (source, title) once within the lateness of ``scraped_at``."""
    return stream.withWatermark("scraped_at", lateness).dropDuplicatesWithinWatermark(["source", "title"])


def windowed_counts(stream: DataFrame, lateness: str = "1 hour", size: str = "1 hour") -> DataFrame:
    return stream.withWatermark("ts", lateness).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


#: Books of 2 to the ``BOOK_BITS`` neighbouring numbers share a group: pandas is called for the group, not for each book.
BOOK_BITS = 6
STATE = "books array<struct<book: long, until: long, held: long, day: date, pnl: long, halted: boolean>>"
OUT = "book long, seq long, day date, accepted boolean, exposure double, day_pnl double, halted boolean"
DAY_MS = 86_400_000
EPOCH = dt.date(1970, 1, 1)


def trading_desk(stream: DataFrame, max_size: float = risk.MAX_SIZE, max_exposure: float = risk.MAX_EXPOSURE, max_loss: float = risk.MAX_DAY_LOSS) -> DataFrame:
    """``risk.trading_desk`` over trades as they come, with what is kept of each book and the time at which its day ends.

    ``stream``: (book, seq, timestamp, size, cost, pnl), watermarked by ``timestamp``; a batch is taken in order of time and
    seq. When the watermark passes midnight without a trade, a timer ends the day: a row without seq tells that loss and
    halt are gone. Rows that come after their day has been passed by the watermark are late and go. A group has 64 books at
    most, and the timer of the first day that ends among them.
    """
    limits = (max_size, max_exposure, max_loss)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentWatermarkMs()
        books = {book: (until, risk.Desk(*limits, state=tuple(held))) for book, until, *held in (state.get[0] if state.exists else ())}
        out = []
        if not state.hasTimedOut:
            rows = pd.concat(list(frames)).sort_values(["timestamp", "seq"])
            plain = ([None if pd.isna(x) else x for x in rows[n].tolist()] for n in ("book", "seq", "size", "cost", "pnl"))
            for day, book, seq, size, cost, pnl in zip(rows["timestamp"].dt.date, *plain, strict=True):
                _, desk = books.get(book) or (None, risk.Desk(*limits))
                desk.start_day(day)
                ok = desk.admit(size, cost, pnl)
                out.append((book, seq, day, ok, desk.held / 100, desk.pnl / 100, desk.halted))
                books[book] = max(((day - EPOCH).days + 1) * DAY_MS, now + 1), desk
        for book, (until, desk) in books.items():
            if until is not None and until < now:  # no trade since: those of this batch end later
                desk.start_day(None)
                out.append((book, None, None, None, desk.held / 100, 0.0, False))
                books[book] = None, desk
        if ends := [until for until, _ in books.values() if until is not None]:
            state.setTimeoutTimestamp(max(min(ends), now + 1))
        state.update(([(book, until, *desk.state) for book, (until, desk) in books.items()],))
        yield pd.DataFrame(out, columns=["book", "seq", "day", "accepted", "exposure", "day_pnl", "halted"]).astype({"book": "Int64", "seq": "Int64", "accepted": "boolean"})

    rows = stream.select(F.shiftright("book", BOOK_BITS).alias("books"), "book", "seq", "timestamp", "size", "cost", "pnl")
    return rows.groupBy("books").applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
