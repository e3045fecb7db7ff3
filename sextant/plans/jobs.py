"""Model data, forests and streams as queries."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as f
from ..sources import storage
from ..streaming import ingest
from . import adapters as a
from . import ml
from .queries import DESK, desk_rows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
NAMES = ["eps", "debt", "cash", "assets", "gross_profit"]


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster shares; a local one only where Spark runs in one process."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def held(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` written once and read back, for what reads them again and again, as a fit does."""
    path = shared_path(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def rows(spark: SparkSession, sf: str) -> DataFrame:
    features = a.factor_rows(spark, sf)
    found = ml.dataset(features, NAMES, ml.next_return(features))
    return found.withColumn("part", ml.part(F.col("symbol"), F.col("d")))


BASE = f"""WITH {a.STATEMENTS}, {a.FACTOR_ROWS}, n AS (SELECT *, 100 * (lead(close) OVER (PARTITION BY symbol ORDER BY d) / close - 1) AS target FROM factor_rows),
m AS (SELECT symbol, d, {', '.join(NAMES)}, target FROM n WHERE target IS NOT NULL)"""


def feature_matrix(spark: SparkSession, sf: str) -> DataFrame:
    found = rows(spark, sf)
    return found.select("symbol", "d", *NAMES, f.cents(F.col("target"), 5).alias("target"))


ORACLES["feature_matrix"] = f"{BASE} SELECT symbol, d, {', '.join(NAMES)}, round(target + 1e-9, 5) + 0.0 AS target FROM m"


def standardised_features(spark: SparkSession, sf: str) -> DataFrame:
    whole = rows(spark, sf).withColumn("part", F.when(F.col("d") < "2000-01-01", "train").otherwise("test"))
    return ml.standardised(whole, NAMES).select("symbol", "d", "part", *(f.cents(F.col(n), 5).alias(n) for n in NAMES))


ORACLES["standardised_features"] = f"""{BASE}, t AS (SELECT {', '.join(f'avg({n}) AS m_{n}, stddev_pop({n}) AS s_{n}' for n in NAMES)} FROM m WHERE d < DATE '2000-01-01')
SELECT symbol, d, CASE WHEN d < DATE '2000-01-01' THEN 'train' ELSE 'test' END AS part, {', '.join(f'round(({n} - m_{n}) / s_{n} + 1e-9, 5) + 0.0 AS {n}' for n in NAMES)} FROM m, t"""


def mean_baseline_mse(spark: SparkSession, sf: str) -> DataFrame:
    whole = rows(spark, sf).withColumn("part", F.when(F.col("d") < "2000-01-01", "train").otherwise("test"))
    return ml.baseline(whole, "target").select("part", f.cents(F.col("mean"), 5).alias("mean"), f.cents(F.col("mse"), 4).alias("mse"), "n")


ORACLES["mean_baseline_mse"] = f"""{BASE}, x AS (SELECT *, CASE WHEN d < DATE '2000-01-01' THEN 'train' ELSE 'test' END AS part FROM m), t AS (SELECT avg(target) AS mean FROM x WHERE part = 'train')
SELECT part, round(any_value(mean) + 1e-9, 5) + 0.0 AS mean, round(avg(pow(target - mean, 2)) + 1e-9, 4) + 0.0 AS mse, count(*) AS n FROM x, t GROUP BY part"""


def forest_mse(spark: SparkSession, sf: str) -> DataFrame:
    """Squared error of a forest of 100 trees on each part."""
    _, predicted = ml.forest(held(rows(spark, sf), "forest_rows"), NAMES, "target")
    return predicted.groupBy("part").agg(F.avg(F.pow(F.col("target") - F.col("prediction"), 2)).alias("mse"), F.count("*").alias("n"))


def stream_first_articles(spark: SparkSession, sf: str) -> DataFrame:
    """News read as a stream, each (source, title) once."""
    path, out = shared_path(spark, "news"), shared_path(spark, "articles")
    news = a.news(spark, sf).where(F.length("title") > 5).withColumn("scraped_at", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    news.write.parquet(path)
    stream = ingest.first_articles(ingest.landed(spark, path, news.schema))
    stream.select("source", "title").writeStream.format("parquet").option("path", out).option("checkpointLocation", shared_path(spark, "ck")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("source string, title string").parquet(out)


ORACLES["stream_first_articles"] = f"WITH {a.NEWS} SELECT DISTINCT source, title FROM news WHERE length(title) > 5"


def stream_event_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Event counts by hour and type, read as a stream and written as windows close."""
    path, out = shared_path(spark, "events"), shared_path(spark, "windows")
    events = a.table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    last = events.agg(F.max("ts").alias("ts")).select((F.col("ts") + F.expr("interval 2 days")).alias("ts"), F.lit("end").alias("event_type"), F.lit(0.0).alias("value"))
    events.write.parquet(path)
    last.write.mode("append").parquet(path)  # moves the watermark past the last window
    counted = ingest.windowed_counts(ingest.landed(spark, path, events.schema))
    flat = counted.select(F.col("window.start").alias("hour"), "event_type", "n")
    flat.writeStream.format("parquet").option("path", out).option("checkpointLocation", shared_path(spark, "ck")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(flat.schema).parquet(out).where("event_type <> 'end'").select(F.col("hour").cast("timestamp_ntz").alias("hour"), "event_type", "n")


ORACLES["stream_event_windows"] = "SELECT date_trunc('hour', ts)::TIMESTAMP AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2"


def stream_upserts(spark: SparkSession, sf: str) -> DataFrame:
    """Prices landed in two batches of files and merged by key: the second doubles the prices of 2001."""
    path, ck = shared_path(spark, "prices"), shared_path(spark, "ck")
    p = a.prices(spark, sf)
    p.write.parquet(path)
    table = storage.KeyedTable(spark, shared_path(spark, "table"), ["symbol", "d"], p.schema, 8)
    ingest.upserts(ingest.landed(spark, path, p.schema), table, ck).awaitTermination()
    p.where("d >= date'2001-01-01'").withColumn("close", F.col("close") * 2).write.mode("append").parquet(path)
    ingest.upserts(ingest.landed(spark, path, p.schema), table, ck).awaitTermination()
    return table.read().select("symbol", "d", f.cents(F.col("close"), 4).alias("close"))


ORACLES["stream_upserts"] = f"WITH {a.PRICES} SELECT symbol, d, round(CASE WHEN d >= DATE '2001-01-01' THEN close * 2 ELSE close END + 1e-9, 4) AS close FROM prices"


def stream_pull(spark: SparkSession, sf: str) -> DataFrame:
    """Prices pulled above the mark of their symbol: a first landing to the middle of 1997, then all days again at double the
    price, of which those after each symbol's mark are added."""
    path, ck = shared_path(spark, "prices"), shared_path(spark, "ck")
    p = a.prices(spark, sf)
    table = storage.KeyedTable(spark, shared_path(spark, "table"), ["symbol", "d"], p.schema, 8)
    for landing in (p.where("d < date'1997-07-01'"), p.withColumn("close", F.col("close") * 2)):
        landing.write.mode("append").parquet(path)
        ingest.pull(ingest.landed(spark, path, p.schema), table, ck).awaitTermination()
    return table.read().select("symbol", "d", f.cents(F.col("close"), 4).alias("close"))


ORACLES["stream_pull"] = f"WITH {a.PRICES}, m AS (SELECT symbol, max(d) AS mark FROM prices WHERE d < DATE '1997-07-01' GROUP BY symbol) SELECT symbol, d, round(CASE WHEN d > coalesce(mark, DATE '1900-01-01') THEN close * 2 ELSE close END + 1e-9, 4) AS close FROM prices LEFT JOIN m USING (symbol)"


def stream_trading_desk(spark: SparkSession, sf: str) -> DataFrame:
    """The trading desk as a stream: trades land year by year, books keep their state, timers end their days."""
    path, out, ck = (shared_path(spark, x) for x in ("trades", "desk", "ck"))
    rows = desk_rows(spark, sf)
    for lo, hi in (("1900-01-01", "1994-01-01"), ("1994-01-01", "1996-01-01"), ("1996-01-01", "2100-01-01")):
        rows.where((F.col("day") >= lo) & (F.col("day") < hi)).write.mode("append").parquet(path)
        desk = ingest.trading_desk(ingest.landed(spark, path, rows.schema).withWatermark("timestamp", "0 seconds"))
        ingest.started(desk.writeStream.format("parquet").option("path", out), ck).awaitTermination()
    return spark.read.schema(ingest.OUT).parquet(out).where("seq is not null")


ORACLES["stream_trading_desk"] = DESK


for _q in (feature_matrix, standardised_features, mean_baseline_mse, forest_mse, stream_first_articles, stream_event_windows, stream_upserts, stream_pull, stream_trading_desk):
    QUERIES[_q.__name__] = _q
