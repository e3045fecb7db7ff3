"""Domain views over the given tables: each as a DataFrame and, for the SQL check, as the text of a CTE."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, d, close, volume): a supplier's mean log price per unit of each ship date, around 100."""
    c = F.col
    rows = table(spark, sf_dir, "lineitem").groupBy(c("l_suppkey").cast("string").alias("symbol"), c("l_shipdate").cast("date").alias("d"))
    return rows.agg(f.cents(100 + F.log(F.sum("l_extendedprice") / F.sum("l_quantity")), 4).alias("close"), F.sum("l_quantity").alias("volume"))


PRICES = """prices AS (SELECT CAST(l_suppkey AS VARCHAR) AS symbol, CAST(l_shipdate AS DATE) AS d,
  round(100 + ln(sum(l_extendedprice) / sum(l_quantity)) + 1e-9, 4) AS close, sum(l_quantity) AS volume FROM lineitem GROUP BY 1, 2)"""


def ohlc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, d, open, high, low, close, volume): a user's event values of each day."""
    e = table(spark, sf_dir, "events").where("value is not null")
    turn = F.struct("ts", "event_id")
    return e.groupBy(F.col("user_id").cast("string").alias("symbol"), F.to_date("ts").alias("d")).agg(
        F.min_by("value", turn).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", turn).alias("close"), F.count("*").alias("volume"))


OHLC = """ohlc AS (SELECT CAST(user_id AS VARCHAR) AS symbol, CAST(ts AS DATE) AS d, first(value ORDER BY ts, event_id) AS open, max(value) AS high,
  min(value) AS low, last(value ORDER BY ts, event_id) AS close, count(*) AS volume FROM events WHERE value IS NOT NULL GROUP BY 1, 2)"""


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, quarter, and a column for each item): a supplier's quarterly statement."""
    c = F.col
    quarter = F.concat(F.year("l_shipdate").cast("string"), F.lit("Q"), F.quarter("l_shipdate").cast("string"))
    price = c("l_extendedprice")
    return table(spark, sf_dir, "lineitem").groupBy(c("l_suppkey").cast("string").alias("symbol"), quarter.alias("quarter")).agg(
        f.cents(F.sum(price), 2).alias("revenue"), f.cents(F.sum(price * c("l_discount")), 2).alias("discounts"), f.cents(F.sum(price * c("l_tax")), 2).alias("tax"), F.sum("l_quantity").alias("quantity"))


STATEMENTS = """statements AS (SELECT CAST(l_suppkey AS VARCHAR) AS symbol, CAST(year(l_shipdate) AS VARCHAR) || 'Q' || CAST(quarter(l_shipdate) AS VARCHAR) AS quarter,
  round(sum(l_extendedprice) + 1e-9, 2) AS revenue, round(sum(l_extendedprice * l_discount) + 1e-9, 2) AS discounts, round(sum(l_extendedprice * l_tax) + 1e-9, 2) AS tax,
  sum(l_quantity) AS quantity FROM lineitem GROUP BY 1, 2)"""


def universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, market, category): a supplier's nation and region; one region is financial, one nation are ETFs."""
    s, n, r = (table(spark, sf_dir, x) for x in ("supplier", "nation", "region"))
    both = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    kind = F.when(F.col("n_nationkey") == 7, "etf").when(F.col("r_regionkey") == 2, "financial").otherwise("general")
    return both.select(F.col("s_suppkey").cast("string").alias("symbol"), F.col("n_name").alias("market"), kind.alias("category"))


UNIVERSE = """universe AS (SELECT CAST(s_suppkey AS VARCHAR) AS symbol, n_name AS market,
  CASE WHEN n_nationkey = 7 THEN 'etf' WHEN r_regionkey = 2 THEN 'financial' ELSE 'general' END AS category
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A forecast for each order; its market is the order's customer and priority."""
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        k.cast("string").alias("prediction_id"), k.cast("string").alias("market_id"), ((k * 37) % 101 / F.lit(100.0)).alias("probability"), ((k * 61) % 99 / F.lit(100.0) + 0.01).alias("market_price"),
        F.when(k % 3 == 0, "low").when(k % 3 == 1, "medium").otherwise("high").alias("confidence"), ((k * 13) % 101 / F.lit(100.0)).alias("bayesian_prior"), (k % 6).cast("int").alias("n_articles"), F.col("o_orderdate").alias("predicted_at"))


PREDICTIONS = """predictions AS (SELECT CAST(o_orderkey AS VARCHAR) AS prediction_id, CAST(o_orderkey AS VARCHAR) AS market_id, (o_orderkey * 37) % 101 / 100.0::DOUBLE AS probability,
  (o_orderkey * 61) % 99 / 100.0::DOUBLE + 0.01::DOUBLE AS market_price, CASE o_orderkey % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS confidence,
  (o_orderkey * 13) % 101 / 100.0::DOUBLE AS bayesian_prior, CAST(o_orderkey % 6 AS INTEGER) AS n_articles, o_orderdate AS predicted_at FROM orders)"""


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trade for each order; its book is the customer, its outcome the order's status."""
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("t"), k.cast("string")).alias("trade_id"), k.cast("string").alias("prediction_id"), F.col("o_custkey").alias("book"), k.alias("seq"), F.when(k % 2 == 0, "YES").otherwise("NO").alias("direction"),
        ((1 + k % 100) / F.lit(100.0)).alias("size"), ((k * 61) % 99 / F.lit(100.0) + 0.01).alias("limit_price"), F.when(k % 10 == 0, "cancelled").otherwise("simulated").alias("status"),
        F.when(F.col("o_orderstatus") == "F", 1.0).when(F.col("o_orderstatus") == "O", 0.0).alias("outcome"), F.col("o_orderdate").alias("timestamp"))


TRADES = """trades AS (SELECT 't' || CAST(o_orderkey AS VARCHAR) AS trade_id, CAST(o_orderkey AS VARCHAR) AS prediction_id, o_custkey AS book, o_orderkey AS seq,
  CASE WHEN o_orderkey % 2 = 0 THEN 'YES' ELSE 'NO' END AS direction, (1 + o_orderkey % 100) / 100.0::DOUBLE AS size, (o_orderkey * 61) % 99 / 100.0::DOUBLE + 0.01::DOUBLE AS limit_price,
  CASE WHEN o_orderkey % 10 = 0 THEN 'cancelled' ELSE 'simulated' END AS status, CASE o_orderstatus WHEN 'F' THEN 1.0::DOUBLE WHEN 'O' THEN 0.0::DOUBLE END AS outcome, o_orderdate AS timestamp FROM orders)"""


def factor_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, d, and statement items): a supplier's statement of each quarter as the input of factor scores."""
    s = statements(spark, sf_dir)
    d = F.make_date(F.substring("quarter", 1, 4).cast("int"), 3 * F.substring("quarter", 6, 1).cast("int") - 2, F.lit(1))
    c = F.col
    return s.select("symbol", "quarter", d.alias("d"), (c("quantity") * 10).alias("shares"), f.cents(c("revenue") / c("quantity"), 4).alias("close"), f.cents(c("discounts") * 2, 2).alias("debt"), c("tax").alias("cash"),
        f.cents(c("revenue") - c("discounts"), 2).alias("ebitda"), f.cents((c("revenue") - c("discounts") - c("tax")) / c("quantity"), 4).alias("eps"), c("revenue").alias("assets"), f.cents(c("revenue") - 2 * c("discounts"), 2).alias("cash_flow"), f.cents(c("revenue") - c("tax"), 2).alias("gross_profit"),
        f.cents(c("revenue") - 2 * c("discounts"), 2).alias("equity"), f.cents(c("revenue") - c("discounts") - c("tax"), 2).alias("net_income"), f.cents(100 * c("tax") / c("revenue"), 4).alias("dividend_yield"), c("revenue"))


FACTOR_ROWS = """factor_rows AS (SELECT symbol, quarter, make_date(CAST(left(quarter, 4) AS INTEGER), 3 * CAST(right(quarter, 1) AS INTEGER) - 2, 1) AS d, quantity * 10 AS shares, round(revenue / quantity + 1e-9, 4) AS close,
  round(discounts * 2 + 1e-9, 2) AS debt, tax AS cash, round(revenue - discounts + 1e-9, 2) AS ebitda, round((revenue - discounts - tax) / quantity + 1e-9, 4) AS eps, revenue AS assets, round(revenue - 2 * discounts + 1e-9, 2) AS cash_flow,
  round(revenue - tax + 1e-9, 2) AS gross_profit, round(revenue - 2 * discounts + 1e-9, 2) AS equity, round(revenue - discounts - tax + 1e-9, 2) AS net_income, round(100 * tax / revenue + 1e-9, 4) AS dividend_yield, revenue FROM statements)"""


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, title, url, ord): the first line of each document."""
    kinds = F.array(*map(F.lit, ("google", "cnyes", "yahoo", "exchange", "symbol")))
    d = table(spark, sf_dir, "documents")
    hosts = F.array(*map(F.lit, ("www.rt.com", "ft.com", "www.breitbart.com", "example.org", "wsj.com:443")))
    return d.select(F.get(kinds, (F.col("doc_id") % 5).cast("int")).alias("source"), F.split("text", "\n")[0].alias("title"), F.concat(F.lit("http://"), F.get(hosts, (F.col("doc_id") % 5).cast("int")), F.lit("/"), F.col("doc_id").cast("string")).alias("url"), F.col("doc_id").alias("ord"))


NEWS = """news AS (SELECT ['google', 'cnyes', 'yahoo', 'exchange', 'symbol'][doc_id % 5 + 1] AS source, string_split(text, chr(10))[1] AS title,
  'http://' || ['www.rt.com', 'ft.com', 'www.breitbart.com', 'example.org', 'wsj.com:443'][doc_id % 5 + 1] || '/' || CAST(doc_id AS VARCHAR) AS url, doc_id AS ord FROM documents)"""
