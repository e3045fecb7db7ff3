"""Rolling, cross-sectional and as-of functions over long panels (symbol, d, value)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


#: Days from 0001-01-01 to 1970-01-01.
FIRST_DAY = 719_162


def series() -> WindowSpec:
    return Window.partitionBy("symbol").orderBy("d")


def period() -> WindowSpec:
    return Window.partitionBy("d")


def rolling(agg, value: Column, n: int, w: WindowSpec | None = None) -> Column:
    """``agg`` over the last ``n`` rows; null until there are ``n``, and while any of them is null."""
    frame = (w or series()).rowsBetween(-(n - 1), 0)
    return F.when(F.count(value).over(frame) == n, agg(value).over(frame))


def bias_ratio(value: Column, n: int, w: WindowSpec | None = None) -> Column:
    """Distance from the moving average, relative to it."""
    mean = rolling(F.avg, value, n, w)
    return F.try_divide(value - mean, mean)


def range_tightness(value: Column, n: int, w: WindowSpec | None = None) -> Column:
    return 1 - F.try_divide(rolling(F.min, value, n, w), rolling(F.max, value, n, w))


def breakout(value: Column, n: int, w: WindowSpec | None = None) -> Column:
    """Whether a value is the highest of the last ``n``, itself included; ties count."""
    return value == rolling(F.max, value, n, w)


def zscore(value: Column, cap: float | None = 3.0, w: WindowSpec | None = None) -> Column:
    """Population z-score within a period, nulls omitted; null where there is no spread or beyond ``cap``, which a score that
    only its last binary digits put above still has (of ten values one can be just 3)."""
    w = w or period()
    z = (value - F.avg(value).over(w)) / F.nullif(F.stddev_pop(value).over(w), F.lit(0.0))
    return z if cap is None else F.when(F.abs(z) <= cap + 1e-9, z)


def zscores(df: DataFrame, names: list[str], by: str = "d", cap: float = 3.0) -> DataFrame:
    """``df`` with ``z_`` and each of ``names``: ``zscore`` by one aggregation of the periods, joined back, so that rows are
    neither dealt nor sorted by period. Equal values have no spread, however their parts are merged."""
    c = F.col
    spread = lambda n: F.nullif(F.when(F.max(n) > F.min(n), F.stddev_pop(n)), F.lit(0.0))
    stats = df.groupBy(c(by).alias("_by")).agg(*(x for n in names for x in (F.avg(n).alias(f"_m_{n}"), spread(n).alias(f"_s_{n}"))))
    z = {n: (c(n) - c(f"_m_{n}")) / c(f"_s_{n}") for n in names}
    both = df.join(F.broadcast(stats), c(by).eqNullSafe(c("_by")))  # as many periods as the calendar has
    return both.select(*df.columns, *(F.when(F.abs(x) <= cap + 1e-9, x).alias(f"z_{n}") for n, x in z.items()))


def pct_change(value: Column, w: WindowSpec | None = None) -> Column:
    """Change from the last value that is not null."""
    w = w or series()
    held = F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    before = F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return F.try_divide(held, before) - 1


def compounded(rate: Column, w: WindowSpec | None = None) -> Column:
    """Product of 1 + rate so far, nulls skipped."""
    return F.product(1 + rate).over((w or series()).rowsBetween(Window.unboundedPreceding, 0))


def rising_streak(df: DataFrame, value: str, mean_rows: int, steps: int, weight: float = 1.0, out: str = "streak") -> DataFrame:
    """``weight`` where the ``mean_rows`` average rose strictly in each of the last ``steps`` steps, else 0."""
    ma = df.withColumns({"_ma": rolling(F.avg, F.col(value), mean_rows), "_i": F.row_number().over(series())})
    up = ma.withColumn("_up", F.coalesce((F.col("_ma") > F.lag("_ma").over(series())).cast("int"), F.lit(0)))
    rose = F.sum("_up").over(series().rowsBetween(-(steps - 1), 0)) == steps
    return up.withColumn(out, F.when(rose & (F.col("_i") > steps), F.lit(weight)).otherwise(0.0)).drop("_ma", "_i", "_up")


def densify(df: DataFrame, values: list[str]) -> DataFrame:
    """Every day from the panel's first to its last for each symbol, with the last values filled forward."""
    span = df.agg(F.min("d").alias("lo"), F.max("d").alias("hi"))
    days = span.select(F.explode(F.sequence("lo", "hi")).alias("d"))
    grid = df.select("symbol").distinct().join(F.broadcast(days))  # a calendar's days, whatever the panel's size
    held = series().rowsBetween(Window.unboundedPreceding, 0)
    return grid.join(df, ["symbol", "d"], "left").select("symbol", "d", *(F.last(v, ignorenulls=True).over(held).alias(v) for v in values))


def asof(left: DataFrame, right: DataFrame, values: list[str], on: str = "d", published: str = "d") -> DataFrame:
    """``left`` with the last ``values`` of its symbol in ``right`` that were published on or before its day."""
    r = right.select("symbol", F.col(published).alias(on), F.lit(0).alias("_side"), F.struct(*values).alias("_v"))
    both = left.withColumn("_side", F.lit(1)).unionByName(r, allowMissingColumns=True)
    held = Window.partitionBy("symbol").orderBy(on, "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("_v", F.last("_v", ignorenulls=True).over(held)).where("_side = 1")
    return both.select(*left.columns, *(F.col(f"_v.{v}").alias(v) for v in values))


def asof_dates(panel: DataFrame, probes: DataFrame) -> DataFrame:
    """(probe, d): the last day of ``panel`` up to each probe, however long before; null if there is none.

    A probe looks among the days of its own block of 256 days, then among the last days of the earlier blocks of its block
    of 65,536, and so on: each level carries the last day of a block to the next, and no window holds more than one block.
    """
    number = lambda d: F.unix_date(d) + FIRST_DAY  # noqa: E731  so that all dates are in one block of the last level
    blocks = panel.where("d is not null").select(number("d").alias("k")).distinct().withColumn("last", F.col("k"))
    asked = probes.select("probe").where("probe is not null").distinct().withColumns({"k": number("probe"), "at": F.lit(None).cast("int")})
    for level in range(3):  # 2 to the 24th days, more than all dates
        rows = blocks.withColumns({"probe": F.lit(None).cast("date"), "at": F.lit(None).cast("int"), "side": F.lit(0)})
        rows = rows.unionByName(asked.withColumns({"last": F.lit(None).cast("int"), "side": F.lit(-1 if level else 1)}))  # a higher block has been searched below
        held = F.last("last", ignorenulls=True).over(Window.partitionBy(F.shiftright("k", 8)).orderBy("k", "side").rowsBetween(Window.unboundedPreceding, 0))
        found = rows.withColumn("held", held).where("probe is not null")
        asked = found.select("probe", F.shiftright("k", 8).alias("k"), F.coalesce("at", "held").alias("at"))
        blocks = blocks.groupBy(F.shiftright("k", 8).alias("k")).agg(F.max("last").alias("last"))
    return asked.select("probe", F.date_from_unix_date(F.col("at") - FIRST_DAY).alias("d"))


def period_quantile(df: DataFrame, value: str, q: float, by: str = "d", out: str = "cut", accuracy: int | None = None) -> DataFrame:
    """(by, out): the quantile of each period, nulls left out, by one aggregation that merges partial results.

    Exact with linear interpolation; with ``accuracy`` a sketch, whose rank is off by at most 1 / ``accuracy`` of the rows.
    """
    found = F.percentile(value, F.lit(q)) if accuracy is None else F.percentile_approx(value, F.lit(q), F.lit(accuracy))
    return df.groupBy(by).agg(found.alias(out))


def top_k(df: DataFrame, period: str, value: str, k: int) -> DataFrame:
    """The ``k`` highest of each period; ties go by symbol."""
    w = Window.partitionBy(period).orderBy(F.col(value).desc_nulls_last(), "symbol")
    return df.where(F.col(value).isNotNull()).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def period_return(df: DataFrame, value: str, by: str, w: WindowSpec | None = None) -> DataFrame:
    """Percent change from the period before, stamped on the end; the first has none and goes."""
    w = w or Window.partitionBy("symbol").orderBy(by)
    return df.withColumn("period_return", 100 * (F.try_divide(F.col(value), F.lag(value).over(w)) - 1)).where("period_return is not null")


def record_breaker(df: DataFrame, value: str, out: str = "record") -> DataFrame:
    """For each row the longest run of rows up to it in which it is the highest (+n), or else the lowest (-n); 0 first.

    Symbols are sorted within their partitions and walked with two monotonic stacks, which go from batch to batch: a task
    holds one batch and the rows that are still records.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, i = None, 0
        high: list[tuple[int, float]] = []
        low: list[tuple[int, float]] = []
        for b in batches:
            found = []
            for symbol, v in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if symbol != now or not i:
                    now, i, high, low = symbol, 0, [], []
                while high and high[-1][1] <= v:
                    high.pop()
                while low and low[-1][1] >= v:
                    low.pop()
                up, down = (i - (stack[-1][0] if stack else -1) for stack in (high, low))
                found.append(0 if i == 0 else up if up >= down else -down)
                high.append((i, v))
                low.append((i, v))
                i += 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.int64())], ["symbol", "d", value, out])

    rows = df.select("symbol", "d", value).where(F.col(value).isNotNull())
    return rows.repartition("symbol").sortWithinPartitions("symbol", "d").mapInArrow(run, f"symbol string, d date, `{value}` double, `{out}` long")


def complete_symbols(df: DataFrame, value: str, period: str = "d") -> DataFrame:
    """Symbols that have a value in every period of the panel."""
    periods = df.agg(F.count_distinct(period).alias("n_periods"))
    have = df.where(F.col(value).isNotNull()).groupBy("symbol").agg(F.count_distinct(period).alias("n"))
    return have.join(F.broadcast(periods), F.col("n") == F.col("n_periods")).select("symbol")
