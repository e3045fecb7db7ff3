"""Queries over single tables and panels: scans, listings, masks, alignment, and the opportunity job as a whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import panel
from ..functions import scalars as f
from ..operators import clean, market, risk
from ..sources import storage
from . import adapters as a
from .queries import COST, NOW, ORACLES, QUERIES, SIZE, c, query, r, rd

__all__ = ["ORACLES", "QUERIES"]


@query(f"WITH {a.PRICES} SELECT d, {rd('close')} AS close FROM prices WHERE symbol = '7'")
def symbol_scan(spark: SparkSession, sf: str) -> DataFrame:
    return storage.by_key(a.prices(spark, sf), "7").select("d", r(c("close")).alias("close"))


@query(f"WITH {a.PRICES} SELECT symbol, {rd('close')} AS close FROM prices WHERE d = DATE '1997-03-03'")
def day_scan(spark: SparkSession, sf: str) -> DataFrame:
    return storage.by_date(a.prices(spark, sf), "1997-03-03").select("symbol", r(c("close")).alias("close"))


@query(f"WITH {a.TRADES} SELECT trade_id, timestamp, place FROM (SELECT *, row_number() OVER (ORDER BY timestamp DESC, trade_id) - 40 AS place FROM trades) WHERE place BETWEEN 1 AND 20")
def trade_page(spark: SparkSession, sf: str) -> DataFrame:
    """The third page of 20 rows."""
    page = storage.page(a.trades(spark, sf).select("trade_id", "timestamp"), 2, 20, c("timestamp").desc(), "trade_id")
    return storage.placed(page, "timestamp", "trade_id")


@query(f"""WITH {a.PREDICTIONS} SELECT prediction_id, probability, predicted_at, row_number() OVER (ORDER BY predicted_at DESC, prediction_id) AS place FROM predictions""")
def predictions_newest_first(spark: SparkSession, sf: str) -> DataFrame:
    rows = storage.placed(a.predictions(spark, sf).select("prediction_id", "probability", "predicted_at"), "predicted_at", "prediction_id")
    return rows.orderBy("place")


@query(f"WITH {a.TRADES}, {a.PREDICTIONS} SELECT trade_id, prediction_id, probability, size, timestamp, row_number() OVER (ORDER BY timestamp DESC, trade_id) AS place FROM trades JOIN predictions USING (prediction_id)")
def trades_newest_first(spark: SparkSession, sf: str) -> DataFrame:
    rows = a.trades(spark, sf).join(a.predictions(spark, sf), "prediction_id")
    return storage.placed(rows.select("trade_id", "prediction_id", "probability", "size", "timestamp"), "timestamp", "trade_id").orderBy("place")


@query("SELECT event_type, event_id, ts FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY")
def recent_events(spark: SparkSession, sf: str) -> DataFrame:
    """Recency cut-off: what is at most seven days older than the newest row."""
    e = a.table(spark, sf, "events")
    newest = e.agg(F.max("ts").alias("newest"))
    return e.join(F.broadcast(newest)).where(c("ts") >= c("newest") - F.expr("interval 7 days")).select("event_type", "event_id", "ts")  # one row is broadcast


@query(f"WITH {a.PRICES} SELECT (SELECT count(DISTINCT d) FROM prices) AS n_days, (SELECT count(DISTINCT symbol) FROM prices) AS n_symbols")
def distinct_days_and_symbols(spark: SparkSession, sf: str) -> DataFrame:
    return a.prices(spark, sf).agg(F.count_distinct("d").alias("n_days"), F.count_distinct("symbol").alias("n_symbols"))


@query(f"WITH {a.STATEMENTS} SELECT symbol, count(DISTINCT quarter) AS n, list_sort(list(DISTINCT CAST(left(quarter, 4) AS INTEGER))) AS years FROM statements GROUP BY symbol")
def distinct_per_symbol(spark: SparkSession, sf: str) -> DataFrame:
    years = F.array_sort(F.collect_set(F.substring("quarter", 1, 4).cast("int")))
    return a.statements(spark, sf).groupBy("symbol").agg(F.count_distinct("quarter").alias("n"), years.alias("years"))


HIGH = "CASE WHEN count(close) OVER x = 20 AND close = max(close) OVER x THEN"


@query(f"WITH {a.PRICES}, h AS (SELECT *, {HIGH} close END AS masked FROM prices WINDOW x AS (PARTITION BY symbol ORDER BY d ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) SELECT symbol, d, {rd('masked')} AS masked FROM h")
def masked_panel(spark: SparkSession, sf: str) -> DataFrame:
    """A panel that keeps a value where a predicate holds and is null elsewhere."""
    return a.prices(spark, sf).select("symbol", "d", r(F.when(panel.breakout(c("close"), 20), c("close"))).alias("masked"))


@query(f"WITH {a.PRICES}, h AS (SELECT {HIGH} 1 END AS hit FROM prices WINDOW x AS (PARTITION BY symbol ORDER BY d ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) SELECT count(hit) AS selected FROM h")
def selected_cells(spark: SparkSession, sf: str) -> DataFrame:
    return a.prices(spark, sf).select(panel.breakout(c("close"), 20).alias("hit")).agg(F.count_if("hit").alias("selected"))


@query("SELECT event_id, coalesce(CASE WHEN event_id % 3 = 0 THEN value * 2 END, value) AS high, coalesce(CASE WHEN event_id % 5 = 0 THEN value / 2 END, value) AS low FROM events")
def bar_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """High and low that are absent fall back to the close."""
    e = a.table(spark, sf, "events").withColumns({"high": F.when(c("event_id") % 3 == 0, c("value") * 2), "low": F.when(c("event_id") % 5 == 0, c("value") / 2)})
    return e.select("event_id", F.coalesce("high", "value").alias("high"), F.coalesce("low", "value").alias("low"))


@query("SELECT DISTINCT strftime(o_orderdate, '%Y%m%d') AS compact, strftime(o_orderdate, '%Y-%m') AS month, year(o_orderdate) AS year, quarter(o_orderdate) AS season FROM orders")
def date_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Dates as text, and the year and season that key a statement."""
    d = c("o_orderdate")
    return a.table(spark, sf, "orders").select(F.date_format(d, "yyyyMMdd").alias("compact"), F.date_format(d, "yyyy-MM").alias("month"), F.year(d).cast("long").alias("year"), F.quarter(d).cast("long").alias("season")).distinct()


@query("SELECT conv_id, turn, role FROM conversations WHERE turn < 2")
def first_turns(spark: SparkSession, sf: str) -> DataFrame:
    """The first two items of each feed, by their ordinal."""
    return a.table(spark, sf, "conversations").select("conv_id", "turn", "role").where("turn < 2")


@query("""SELECT conv_id, '[' || string_agg('"' || role || '"', ',' ORDER BY turn) || ']' AS roles FROM conversations GROUP BY conv_id""")
def roles_as_json(spark: SparkSession, sf: str) -> DataFrame:
    """Arrays JSON-encoded, as a table without array columns stores them."""
    rows = a.table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("x"))
    return rows.select("conv_id", F.to_json("x.role").alias("roles"))


@query("SELECT n_nationkey, n_name FROM nation")
def without_absent_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Surrogate and optional columns go where they are present; names that are absent are no error."""
    return a.table(spark, sf, "nation").withColumn("_id", F.monotonically_increasing_id()).drop("_id", "n_comment", "n_regionkey", "no_such_column")


FEATURES = ["revenue", "tax"]


@query(f"""WITH {a.STATEMENTS}, x AS (SELECT symbol, quarter, revenue FROM statements WHERE revenue >= 100000), y AS (SELECT symbol, quarter, tax FROM statements WHERE tax <= 8000)
SELECT symbol, quarter, x.revenue, y.tax FROM x FULL JOIN y USING (symbol, quarter)""")
def aligned_features(spark: SparkSession, sf: str) -> DataFrame:
    """Feature panels aligned on (symbol, quarter): one union of long rows and one aggregation for any number of them."""
    long = clean.long_panel(a.statements(spark, sf).select("symbol", "quarter", *FEATURES), FEATURES)
    long = long.where(((c("item") == "revenue") & (c("value") >= 100_000)) | ((c("item") == "tax") & (c("value") <= 8_000)))  # panels with gaps
    return clean.statement_pivot(long, FEATURES)


@query(f"WITH {a.STATEMENTS} SELECT symbol, quarter, tax AS value FROM statements")
def feature_by_name(spark: SparkSession, sf: str) -> DataFrame:
    """One feature panel by its name, out of the long panel of all."""
    long = clean.long_panel(a.statements(spark, sf).select("symbol", "quarter", *FEATURES), FEATURES)
    return long.where(c("item") == "tax").select("symbol", "quarter", "value")


@query(f"""WITH {a.OHLC}, s AS (SELECT min(d) AS lo, max(d) AS hi FROM ohlc), m AS (SELECT DISTINCT symbol, last_day(x) AS d FROM (SELECT DISTINCT symbol FROM ohlc), (SELECT unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS x FROM s)),
k AS (SELECT m.symbol, m.d FROM m, s WHERE m.d <= hi) SELECT k.symbol, k.d, {rd('close')} AS close FROM k ASOF LEFT JOIN ohlc o ON k.symbol = o.symbol AND k.d >= o.d""")
def month_end_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Exact lookups of (day, symbol) on the filled calendar: the last days of months."""
    filled = panel.densify(a.ohlc(spark, sf), ["close"])
    return filled.where(c("d") == F.last_day("d")).select("symbol", "d", r(c("close")).alias("close"))


@query("""SELECT event_type, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 3""")
def log_tail(spark: SparkSession, sf: str) -> DataFrame:
    """The newest three entries of each source of a log."""
    w = Window.partitionBy("event_type").orderBy(c("ts").desc(), c("event_id").desc())
    return a.table(spark, sf, "events").withColumn("rn", F.row_number().over(w)).where("rn <= 3").select("event_type", "event_id", "ts")


@query("SELECT CAST(r_regionkey AS BIGINT) AS i, r_name AS term FROM region")
def term_dictionary(spark: SparkSession, sf: str) -> DataFrame:
    """A dictionary from index to term, and back to rows."""
    rows = a.table(spark, sf, "region").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(c("r_regionkey").cast("long"), "r_name")))).alias("terms"))  # the terms of a dictionary
    return rows.select(F.explode("terms").alias("i", "term"))


CYCLE = f"""WITH RECURSIVE {a.TRADES}, {a.PREDICTIONS}, e AS (SELECT p.*, t.book, t.seq, market_price AS price, CASE WHEN probability > market_price THEN 'YES' ELSE 'NO' END AS direction FROM predictions p JOIN trades t USING (prediction_id)), s AS (SELECT *, {SIZE} AS size FROM e),
o AS (SELECT *, least(0.99::DOUBLE, greatest(0.01::DOUBLE, round(CASE direction WHEN 'YES' THEN price + 0.005::DOUBLE ELSE price - 0.005::DOUBLE END + 1e-9, 2))) AS limit_price FROM s
 WHERE abs(round(probability - market_price + 1e-9, 4)) >= 0.15::DOUBLE AND confidence IN ('medium', 'high') AND size > 0),
q AS (SELECT book, seq, CAST(round(100 * {COST}) AS BIGINT) AS cents, row_number() OVER (PARTITION BY book ORDER BY seq) AS i FROM o),
w AS (SELECT book, i, cents <= 1000 AS accepted, CASE WHEN cents <= 1000 THEN cents ELSE 0 END AS held FROM q WHERE i = 1
 UNION ALL SELECT q.book, q.i, w.held + q.cents <= 1000, w.held + CASE WHEN w.held + q.cents <= 1000 THEN q.cents ELSE 0 END FROM w JOIN q ON q.book = w.book AND q.i = w.i + 1)
SELECT (SELECT count(*) FROM predictions) AS scanned, (SELECT count(*) FROM o) AS opportunities, (SELECT count(*) FROM w WHERE accepted) AS accepted, (SELECT count(*) FROM w WHERE NOT accepted) AS rejected"""


@query(CYCLE)
def opportunity_cycle(spark: SparkSession, sf: str) -> DataFrame:
    """From forecasts to admitted trades, which are stored, and the counts of the cycle, observed as its one job runs."""
    from .jobs import shared_path

    scanned, found_, done = (Observation(x) for x in ("scanned", "found", "done"))
    count = lambda name: F.count(F.lit(1)).alias(name)
    p = a.predictions(spark, sf).observe(scanned, count("scanned"))
    found = market.opportunities_of(p.withColumn("yes_price", c("market_price"))).observe(found_, count("opportunities"))
    books = a.trades(spark, sf).select("prediction_id", "book", "seq")
    orders = found.join(books, "prediction_id").withColumn("cost", f.trade_cost(c("size"), c("limit_price"), c("direction")))
    admitted = risk.admit(orders).observe(done, F.count_if("accepted").alias("accepted"), F.count_if(~c("accepted")).alias("rejected"))
    admitted.write.parquet(shared_path(spark, "admitted"))
    counts = {**scanned.get, **found_.get, **done.get}
    return spark.createDataFrame([tuple(counts[x] for x in ("scanned", "opportunities", "accepted", "rejected"))], "scanned long, opportunities long, accepted long, rejected long")


@query(f"SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(o_custkey AS VARCHAR) AS symbol, DATE '{NOW}' AS d FROM orders")
def appended_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Two appends to a landed table, read back."""
    from .jobs import shared_path

    rows = a.table(spark, sf, "orders").select(c("o_orderkey").cast("string").alias("id"), c("o_custkey").cast("string").alias("symbol"), F.lit(NOW).cast("date").alias("d"))
    path = shared_path(spark, "appended")
    for part in (0, 1):
        storage.append(rows.where(F.pmod(F.xxhash64("id"), F.lit(2)) == part), path)
    return spark.read.schema(rows.schema).parquet(path)
