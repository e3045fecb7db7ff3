"""Keyed tables on Parquet: scans, resume points, appends and upserts."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from ..functions import dates


def by_key(df: DataFrame, symbol: str) -> DataFrame:
    return df.where(F.col("symbol") == symbol)


def by_date(df: DataFrame, day: str) -> DataFrame:
    return df.where(F.col("d") == F.lit(day).cast("date"))


def by_months(df: DataFrame, lo: str, hi: str) -> DataFrame:
    """Rows of the months from ``lo`` up to, not including, ``hi``."""
    return df.where((F.col("d") >= F.lit(lo).cast("date")) & (F.col("d") < F.lit(hi).cast("date")))


def recent(df: DataFrame, n: int = 100, by: str = "d", *ties: str) -> DataFrame:
    return df.orderBy(F.col(by).desc(), *ties).limit(n)


def tail(df: DataFrame, n: int = 50, by: str = "d", *ties: str) -> DataFrame:
    """The last ``n`` rows by ``by``, in ascending order."""
    return recent(df, n, by, *ties).orderBy(by, *ties)


def page(df: DataFrame, number: int, rows: int, *order) -> DataFrame:
    return df.orderBy(*order).offset(number * rows).limit(rows)


def bounds(df: DataFrame) -> DataFrame:
    """Oldest and latest day and the number of rows of each symbol."""
    return df.groupBy("symbol").agg(F.min("d").alias("oldest"), F.max("d").alias("latest"), F.count("*").alias("n"))


def resume_points(df: DataFrame, universe: DataFrame, today: Column, weekdays_only: bool = False) -> DataFrame:
    """For each symbol of the universe the day from which to go on; symbols that are up to date go. With ``weekdays_only``
    there is nothing to do on a Saturday or Sunday."""
    latest = df.groupBy("symbol").agg(F.max("d").alias("latest"))
    return universe.join(latest, "symbol", "left").select("symbol", dates.resume_day(F.col("latest"), today).alias("resume")).where(F.col("resume").isNotNull() & (F.weekday(today) < 5 if weekdays_only else F.lit(True)))


def resume_quarters(df: DataFrame, universe: DataFrame, start: str = "2013Q1") -> DataFrame:
    latest = df.groupBy("symbol").agg(F.max("quarter").alias("latest"))
    return universe.join(latest, "symbol", "left").select("symbol", F.coalesce(dates.next_quarter(F.col("latest")), F.lit(start)).alias("resume"))


def monthly(df: DataFrame, path: str, files: int = 1) -> DataFrame:
    """``df`` written by month of ``d``, sorted by symbol and day within ``files`` files of each month, and read again with
    its ``month``; a scan by day or months reads the folders of those months only, one by symbol few row groups of each."""
    spread = F.pmod(F.xxhash64("symbol"), F.lit(files))
    rows = df.withColumn("month", F.date_format("d", "yyyy-MM")).repartition("month", spread).sortWithinPartitions("month", "symbol", "d")
    rows.write.partitionBy("month").parquet(path)
    return df.sparkSession.read.schema(rows.schema).parquet(path)


def month_of(day: str) -> Column:
    return F.date_format(F.lit(day).cast("date"), "yyyy-MM")


def scan_day(table: DataFrame, day: str) -> DataFrame:
    """The rows of a day of a ``monthly`` table."""
    return by_date(table, day).where(F.col("month") == month_of(day))


def scan_months(table: DataFrame, lo: str, hi: str) -> DataFrame:
    """``by_months`` of a ``monthly`` table, for first days of months."""
    return by_months(table, lo, hi).where((F.col("month") >= month_of(lo)) & (F.col("month") < month_of(hi)))


def merged(old: DataFrame, new: DataFrame, keys: list[str], order: list[str] | None = None, supplied: str | None = None) -> DataFrame:
    """Upsert: a row of ``new`` sets the fields that it has, nulls included; other fields and rows stay.

    Of rows of ``new`` with one key the last by ``order`` (default: all its columns) counts. Where records lack some of the
    columns, ``supplied`` names a column with the list of those that a record has (null: all).
    """
    fields = [c for c in new.columns if c not in keys and c != supplied]
    last = Window.partitionBy(*keys).orderBy(*(F.col(c).desc_nulls_last() for c in order or fields))
    one = new.withColumn("_rn", F.row_number().over(last)).where("_rn = 1")
    has = lambda c: F.coalesce(F.array_contains(supplied, c), F.lit(True)) if supplied else F.lit(True)
    renamed = one.select(*keys, *(F.struct(has(c).alias("has"), F.col(c).alias("value")).alias(f"_new_{c}") for c in fields))
    both = old.join(renamed, keys, "full_outer")
    sets = lambda c: F.col(f"_new_{c}.value") if c not in old.columns else F.when(F.col(f"_new_{c}.has"), F.col(f"_new_{c}.value")).otherwise(F.col(c))
    return both.select(*(sets(c).alias(c) if c in fields else F.col(c) for c in dict.fromkeys([*old.columns, *keys, *fields])))


class KeyedTable:
    """A table by key on Parquet, in hash buckets of the key; an upsert rewrites the buckets that it touches only.

    Each version has a manifest, written last: which folder holds a bucket. Readers see the newest whole version; a batch
    that is repeated under its name changes nothing. ``buckets`` should keep one bucket to what a task can write.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], schema: StructType | str, buckets: int = 64):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), keys, buckets
        self.schema = spark.createDataFrame([], schema).schema

    def _manifest(self) -> tuple[int, dict[int, str], set[str]]:
        """The version, the folders by bucket, and the names of the batches so far."""
        try:
            rows = self.spark.read.schema("bucket int, folder string, batch string, v int").parquet(f"{self.path}/manifest")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return -1, {}, set()
        newest = rows.agg(F.max("v")).first()[0]
        found = rows.where((F.col("v") == newest) & F.col("bucket").isNotNull()).collect()  # a row for each bucket
        return newest, {r["bucket"]: r["folder"] for r in found}, {r["batch"] for r in rows.select("batch").distinct().collect()}

    def _rows(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/{f}" for f in folders))

    def read(self) -> DataFrame:
        return self._rows(list(self._manifest()[1].values()))

    def upsert(self, new: DataFrame, batch: str | None = None, order: list[str] | None = None, supplied: str | None = None) -> int:
        """Merges ``new`` (see ``merged``) as the batch of this name; returns the number of buckets written."""
        version, folders, done = self._manifest()
        if batch is not None and batch in done:
            return 0
        new = new.withColumns({k: F.col(k).cast(self.schema[k].dataType) for k in self.keys})  # hashes differ by type
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        touched = [r[0] for r in new.select(bucket).distinct().collect()]  # at most ``buckets``
        if touched:
            old = self._rows([folders[b] for b in touched if b in folders])
            rows = merged(old, new, self.keys, order, supplied).select(*self.schema.names)
            folder = f"data/{uuid.uuid4().hex}"
            rows.withColumn("_bucket", bucket).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
            folders |= {b: f"{folder}/_bucket={b}" for b in touched}
        lines = [(b, f, batch) for b, f in sorted(folders.items())] or [(None, None, batch)]
        self.spark.createDataFrame(lines, "bucket int, folder string, batch string").coalesce(1).write.parquet(f"{self.path}/manifest/v={version + 1}")
        return len(touched)


def placed(df: DataFrame, by: str, *ties: str, out: str = "place") -> DataFrame:
    """``df`` with its places from 1 in the order of ``by`` descending and then ``ties``: rows are numbered by value of
    ``by`` (a day or a time), and shifted by the rows of later ones, which are as many as the calendar has."""
    counts = df.groupBy(by).agg(F.count(F.lit(1)).alias("_n"))
    later = Window.partitionBy(F.year(by)).orderBy(F.col(by).desc()).rowsBetween(Window.unboundedPreceding, -1)
    years = counts.groupBy(F.year(by).alias("_y")).agg(F.sum("_n").alias("_in_year"))
    after = years.withColumn("_before", F.coalesce(F.sum("_in_year").over(Window.orderBy(F.col("_y").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row for each year
    starts = counts.withColumns({"_y": F.year(by), "_later": F.coalesce(F.sum("_n").over(later), F.lit(0))}).join(after, "_y").select(by, (F.col("_later") + F.col("_before")).alias("_start"))
    inside = F.row_number().over(Window.partitionBy(by).orderBy(*ties))
    return df.withColumn("_i", inside).join(starts, by).withColumn(out, F.col("_start") + F.col("_i")).select(*df.columns, out)


def selected(universe: DataFrame, markets: tuple[str, ...] = (), categories: tuple[str, ...] = ()) -> DataFrame:
    """The symbols of the named markets and categories; none named means all."""
    for column, names in (("market", markets), ("category", categories)):
        universe = universe.where(F.col(column).isin(*names)) if names else universe
    return universe


def with_json_arrays(df: DataFrame) -> DataFrame:
    """``df`` with its array columns as JSON texts, for tables that have none."""
    return df.withColumns({x.name: F.to_json(x.name) for x in df.schema if isinstance(x.dataType, ArrayType)})


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def reload(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def resolve_trades(trades: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Sets outcome and status 'filled' for the trades in ``outcomes`` (trade_id, outcome)."""
    new = outcomes.select("trade_id", F.col("outcome").alias("_outcome"))
    both = trades.join(new, "trade_id", "left")
    hit = F.col("_outcome").isNotNull()
    return both.withColumns({"outcome": F.coalesce("_outcome", "outcome"), "status": F.when(hit, "filled").otherwise(F.col("status"))}).drop("_outcome")


def only(df: DataFrame, universe: DataFrame) -> DataFrame:
    """Rows of symbols in the universe."""
    return df.join(universe.select("symbol").distinct(), "symbol", "left_semi")


def without(df: DataFrame, symbols: DataFrame) -> DataFrame:
    """Rows of symbols that are not listed; rows that repeat stay."""
    return df.join(symbols.select("symbol").distinct(), "symbol", "left_anti")
