"""Ordered admission of trades and the daily loss halt, book by book."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as f

MAX_SIZE = 1.00
MAX_EXPOSURE = 10.00
MAX_DAY_LOSS = 4.00


class Desk:
    """A book in the order of its trades: what is held, the day's profit and loss, and whether trading is halted.

    A new UTC day starts with neither loss nor halt. A trade is admitted unless trading is halted, if its size and the
    exposure it leads to are allowed; a rejected one adds nothing. One whose result is known adds it to the day's, another
    adds its cost to what is held. Money counts in whole cents.
    """

    def __init__(self, max_size: float = MAX_SIZE, max_exposure: float = MAX_EXPOSURE, max_loss: float | None = MAX_DAY_LOSS, state: tuple | None = None):
        self.max_size, self.most, self.loss = max_size + 1e-9, round(100 * max_exposure), None if max_loss is None else round(100 * max_loss)
        self.held, self.day, self.pnl, self.halted = state or (0, None, 0, False)

    @property
    def state(self) -> tuple:
        return self.held, self.day, self.pnl, self.halted

    def start_day(self, day: object) -> None:
        if day != self.day:
            self.day, self.pnl, self.halted = day, 0, False

    def admit(self, size: float | None, cost: float | None, pnl: float | None = None) -> bool:
        cents = None if cost is None else round(100 * cost)
        ok = not self.halted and size is not None and cents is not None and size <= self.max_size and self.held + cents <= self.most
        if ok and pnl is None:
            self.held += cents
        elif ok:
            self.pnl += round(100 * pnl)
            self.halted = self.loss is not None and self.pnl <= -self.loss
        return ok

    def settle(self, cost: float, pnl: float) -> None:
        """A trade held gives its cost back and adds its result, halted or not."""
        self.held -= round(100 * cost)
        self.pnl += round(100 * pnl)
        self.halted = self.halted or self.loss is not None and self.pnl <= -self.loss


def _walked(trades: DataFrame, order: list[str], limits: tuple, out: str) -> DataFrame:
    """Books sorted within their partitions and walked by one Python stage, a book's state going from batch to batch: a
    task holds one batch, however long a book is."""
    names, wanted = trades.columns, [x.split()[0] for x in out.split(", ")]
    book, size, cost = (names.index(x) for x in ("book", "size", "cost"))
    day, pnl = (names.index(x) if x in names else None for x in ("day", "pnl"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, desk = object(), Desk()
        for b in batches:
            columns = [c.to_pylist() for c in b.columns]
            none = [None] * b.num_rows
            found = []
            for own, s, c, d, p in zip(columns[book], columns[size], columns[cost], none if day is None else columns[day], none if pnl is None else columns[pnl], strict=True):
                if own != at:
                    at, desk = own, Desk(*limits)
                desk.start_day(d)
                ok = desk.admit(s, c, p)
                found.append((ok, desk.held / 100, desk.pnl / 100, desk.halted))
            new = [pa.array(x, t) for x, t in zip(zip(*found, strict=True), (pa.bool_(), pa.float64(), pa.float64(), pa.bool_()), strict=True)] if found else [pa.array([], t) for t in (pa.bool_(), pa.float64(), pa.float64(), pa.bool_())]
            yield pa.RecordBatch.from_arrays([*b.columns, *new[: len(wanted)]], [*names, *wanted])

    kinds = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in trades.schema)
    return trades.repartition("book").sortWithinPartitions("book", *order).mapInArrow(run, f"{kinds}, {out}")


def admit(trades: DataFrame, max_size: float = MAX_SIZE, max_exposure: float = MAX_EXPOSURE) -> DataFrame:
    """Adds ``accepted`` and ``exposure`` (after the trade): within a book, in order of ``seq``, a trade is accepted if
    its size and the exposure it leads to are allowed; a rejected one adds nothing. Costs count in whole cents."""
    return _walked(trades.select("book", "seq", "size", "cost"), ["seq"], (max_size, max_exposure, None), "accepted boolean, exposure double")


def trading_desk(trades: DataFrame, max_size: float = MAX_SIZE, max_exposure: float = MAX_EXPOSURE, max_loss: float = MAX_DAY_LOSS) -> DataFrame:
    """Admission and the daily halt together (see ``Desk``): (book, seq, day, size, cost, pnl) in order of day and seq, with
    ``accepted``, and ``exposure``, ``day_pnl`` and ``halted`` after each row."""
    return _walked(trades.select("book", "seq", "day", "size", "cost", "pnl"), ["day", "seq"], (max_size, max_exposure, max_loss), "accepted boolean, exposure double, day_pnl double, halted boolean")


def halts(results: DataFrame, max_loss: float = MAX_DAY_LOSS) -> DataFrame:
    """Adds ``day_pnl`` so far and ``halted``, true from the result on that takes the day's loss to ``max_loss``."""
    w = Window.partitionBy("book", "d").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    run = results.withColumn("day_pnl", f.cents(F.sum("pnl").over(w)))
    return run.withColumn("halted", F.max(F.col("day_pnl") <= -max_loss).over(w))
