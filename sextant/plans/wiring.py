"""Queries of operators that other jobs do not show: single rules of cleaning, sets, ids and answers, and whole chains."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, panel
from ..functions import scalars as f
from ..operators import clean, factors, fundamentals, market, risk
from ..sources import landed, storage
from . import adapters as a
from . import ml
from .jobs import ORACLES, QUERIES, held, shared_path
from .landing import query
from .queries import DEADLINE, NOW, S, Z_SQL, c, r, rd, roll, rolled, streak_sql

__all__ = ["ORACLES", "QUERIES"]

# --- model data ------------------------------------------------------------------------------------------------------

#: Made items of a supplier's quarter: shares of its revenue, discounts and tax.
MADE = {
    "revenue": "revenue", "gross_profit": "revenue - discounts", "operating_income": "revenue - 2 * discounts", "pretax_income": "revenue - 3 * discounts", "net_income": "revenue - 3 * discounts - tax", "recurring_income": "revenue - 4 * discounts",
    "comprehensive_income": "revenue - 3 * discounts - 2 * tax", "ebitda": "revenue - discounts + tax", "depreciation": "tax * 2", "operating_cash_flow": "revenue - discounts * 2 + tax", "capex": "discounts * 3", "interest_expense": "tax / 4",
    "tax": "tax", "non_operating_income": "discounts / 5", "operating_expense": "discounts", "selling_expense": "discounts / 2", "administrative_expense": "discounts / 4", "research_expense": "discounts / 8", "assets": "revenue * 3 + tax",
    "current_assets": "revenue + discounts", "inventory": "discounts * 2", "receivables": "revenue / 2 + quantity", "liabilities": "revenue + tax * 3", "current_liabilities": "revenue / 3 + tax", "equity": "revenue * 2 - tax * 2", "shares": "quantity * 10",
}


def statement_rows(spark: SparkSession, sf: str) -> DataFrame:
    s = a.statements(spark, sf)
    return s.select("symbol", "quarter", dates.filing_deadline(c("quarter")).alias("d"), *(F.expr(x).cast("double").alias(n) for n, x in MADE.items()))


def feature_sql() -> str:
    over = lambda x, y, k="1.0": f"{k} * ({x}) / nullif({y}, 0)"
    u = fundamentals
    parts = [*(f"{x} AS {n}" for n, x in u.LEVELS.items()), *(f"{over(x, y, '100.0')} AS {n}" for n, (x, y) in u.PERCENT.items()), *(f"{over(x, 'shares')} AS {n}" for n, x in u.PER_SHARE.items()),
             *(f"100.0 * ({x} / nullif(lag({x}) OVER (PARTITION BY symbol ORDER BY d), 0) - 1) AS {n}" for n, x in u.GROWTH.items()), f"current_assets - current_liabilities AS {u.WORKING_CAPITAL}", *(f"{over(x, y)} AS {n}" for n, (x, y) in u.TURNOVER.items())]
    made = ", ".join(f"CAST({x} AS DOUBLE) AS {n}" for n, x in MADE.items())
    return f"""made AS (SELECT symbol, quarter, {rolled(DEADLINE)} AS d, {made} FROM (SELECT *, CAST(left(quarter, 4) AS INTEGER) AS y FROM statements)),
features AS (SELECT symbol, quarter, d, {", ".join(parts)} FROM made)"""


RETURNS = """days AS (SELECT DISTINCT d FROM features), last_day_of AS (SELECT days.d AS probe, t.d FROM days ASOF JOIN (SELECT DISTINCT d FROM prices) t ON days.d >= t.d),
returns AS (SELECT symbol, probe AS d, 100 * (close / lag(close) OVER (PARTITION BY symbol ORDER BY probe) - 1) AS target FROM last_day_of JOIN prices USING (d))"""


def model_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The 47 features of each report, and the return to its day from the day of the report before."""
    rows = fundamentals.features(statement_rows(spark, sf))
    p = a.prices(spark, sf)
    at = panel.asof_dates(p, rows.select(c("d").alias("probe"))).join(p, "d").select("symbol", "probe", "close")
    target = panel.period_return(at, "close", "probe").select("symbol", c("probe").alias("d"), c("period_return").alias("target"))
    return ml.dataset(rows, list(fundamentals.FEATURES), target)


@query(f"""WITH {a.STATEMENTS}, {a.PRICES}, {feature_sql()}, {RETURNS} SELECT symbol, d, {", ".join(f"{rd(n, 4)} AS {n}" for n in fundamentals.FEATURES)}, {rd("target", 4)} AS target
FROM features JOIN returns USING (symbol, d) WHERE target IS NOT NULL AND {" AND ".join(f"{n} IS NOT NULL" for n in fundamentals.FEATURES)}""")
def model_features(spark: SparkSession, sf: str) -> DataFrame:
    return model_rows(spark, sf).select("symbol", "d", *(r(c(n), 4).alias(n) for n in (*fundamentals.FEATURES, "target")))


@query()
def return_model(spark: SparkSession, sf: str) -> DataFrame:
    """Error by part of a forest over the 47 features, beside that of the training mean."""
    rows = held(model_rows(spark, sf).withColumn("part", ml.part(c("symbol"), c("d"))), "model_rows")
    _, predicted = ml.forest(rows, list(fundamentals.FEATURES), "target")
    found = predicted.groupBy("part").agg(F.avg(F.pow(c("target") - c("prediction"), 2)).alias("forest_mse"), F.count("*").alias("n"))
    return found.join(ml.baseline(rows, "target").select("part", "mean", c("mse").alias("baseline_mse")), "part")


@query(f"""WITH {a.STATEMENTS}, n AS (SELECT symbol, quarter, CAST('0x' || left(sha256(symbol || '|' || quarter), 8) AS UBIGINT) % 100 AS n FROM statements)
SELECT symbol, quarter, CASE WHEN n < 70 THEN 'train' WHEN n < 85 THEN 'valid' ELSE 'test' END AS part FROM n""")
def split_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Statements dealt to training, validation and test."""
    return a.statements(spark, sf).select("symbol", "quarter", ml.part(c("symbol"), c("quarter")).alias("part"))


# --- ratings by day --------------------------------------------------------------------------------------------------

DAILY = f"""WITH {a.STATEMENTS}, {a.UNIVERSE}, {a.FACTOR_ROWS}, {a.PRICES}, b AS (SELECT f.*, ebitda / lag(ebitda) OVER ({S}) - 1 AS growth, row_number() OVER ({S}) AS i, lag(shares, 12) OVER ({S}) AS shares_before,
 {roll('avg', 'net_income', 5)} AS ma_income, {roll('avg', 'revenue', 5)} AS ma_revenue FROM factor_rows f),
m AS (SELECT *, -({roll('stddev_samp', 'growth', 20)}) AS variability, ma_income > lag(ma_income) OVER ({S}) AS up_income, ma_revenue > lag(ma_revenue) OVER ({S}) AS up_revenue FROM b),
k AS (SELECT *, {streak_sql('income')} AS income_streak, {streak_sql('revenue')} AS revenue_streak, {rolled(DEADLINE)} AS published FROM (SELECT *, CAST(left(quarter, 4) AS INTEGER) AS y FROM m)),
j AS (SELECT p.symbol, p.d, p.close AS price, k.* EXCLUDE (symbol, d, close) FROM prices p ASOF JOIN k ON p.symbol = k.symbol AND p.d >= k.published),
v AS (SELECT j.*, category, shares / 10 * price AS cap, shares / 10 * price + debt - cash AS ev FROM j JOIN universe USING (symbol) WHERE category <> 'etf'),
x AS (SELECT *, cash_flow / nullif(shares, 0) AS cash_flow_share, eps / nullif(price, 0) AS earnings_yield, dividend_yield + (shares - shares_before) * price / nullif(cap, 0) AS shareholder_yield, ebitda / nullif(ev, 0) AS ebitda_ev,
 net_income / nullif(equity, 0) AS roe, net_income / nullif(assets, 0) AS roa, cash_flow / nullif(assets, 0) AS cash_flow_assets, gross_profit / nullif(assets, 0) AS gross_profit_assets, debt / nullif(equity, 0) AS leverage FROM v),
z AS (SELECT *, {Z_SQL} FROM x WINDOW p AS (PARTITION BY d)),
t AS (SELECT *, 0.4 * CASE category WHEN 'financial' THEN (z_roe + z_variability + z_roa) / 3 ELSE 0.2 * (z_roe + z_variability + z_cash_flow_assets + z_gross_profit_assets + z_leverage) END
 + 0.3 * CASE category WHEN 'financial' THEN 0.3 * z_cash_flow_share + 0.3 * z_ebitda_ev + 0.3 * z_earnings_yield + 0.1 * z_shareholder_yield ELSE 0.4 * z_cash_flow_share + 0.4 * z_earnings_yield + 0.2 * z_shareholder_yield END
 + 0.3 * (z_income_streak + z_revenue_streak) AS total FROM z)
SELECT symbol, d, round(CASE WHEN total >= 0 THEN 1 + total ELSE 1 / (1 - total) END, 6) AS score FROM t"""


@query(DAILY)
def daily_factor_rating(spark: SparkSession, sf: str) -> DataFrame:
    """Quarterly factors as last published on each day, against the day's price."""
    found = factors.daily_rating(a.factor_rows(spark, sf), a.prices(spark, sf), a.universe(spark, sf))
    return found.select("symbol", "d", "score")


# --- markets ---------------------------------------------------------------------------------------------------------


def landed_market_rows(spark: SparkSession, sf: str) -> DataFrame:
    """A market text for each order: some have one token, little volume, or too few days to go."""
    k = c("o_orderkey")
    price = (k * 61) % 99 / F.lit(100.0) + 0.01
    token = lambda name, p: F.struct(F.lit(name).alias("outcome"), p.cast("string").alias("price"))
    tokens = F.when(k % 7 == 0, F.array(token("Yes", price))).otherwise(F.array(token("Yes", price), token("No", 1 - price)))
    end = F.concat(F.date_add(F.lit(NOW).cast("date"), (k % 20).cast("int")).cast("string"), F.lit("T00:00:00Z"))
    one = F.struct(k.cast("string").alias("condition_id"), tokens.alias("tokens"), F.array(F.lit("Crypto")).alias("tags"), (k % 4000).cast("string").alias("volume_num_24hr"), end.alias("end_date_iso"), F.lit("q").alias("question"))
    return a.table(spark, sf, "orders").select(F.to_json(F.array(one)).alias("value"))


ELIGIBLE = "CAST(market_id AS BIGINT) % 7 <> 0 AND CAST(market_id AS BIGINT) % 4000 >= 1000 AND CAST(market_id AS BIGINT) % 20 >= 3"


@query(f"""WITH {a.PREDICTIONS}, e AS (SELECT *, round(market_price, 2) AS price FROM predictions WHERE {ELIGIBLE}), g AS (SELECT *, CASE WHEN probability > price THEN 'YES' ELSE 'NO' END AS direction FROM e)
SELECT market_id, direction, round(probability - price + 1e-9, 4) AS edge FROM g WHERE abs(round(probability - price + 1e-9, 4)) >= 0.15::DOUBLE AND confidence IN ('medium', 'high')
 AND least(CASE WHEN direction = 'YES' THEN (probability - price) / (1 - price) ELSE (price - probability) / price END * 0.25, 1.0) >= 0.005 AND probability > 0 AND probability < 1""")
def market_cycle(spark: SparkSession, sf: str) -> DataFrame:
    """From landed market texts to opportunities: eligibility first, then the forecasts of what is eligible."""
    markets = market.eligible(market.landed_markets(landed_market_rows(spark, sf)), F.lit(f"{NOW} 00:00:00").cast("timestamp"))
    return market.opportunities(markets.select("market_id", "yes_price"), a.predictions(spark, sf)).select("market_id", "direction", "edge")


@query(f"""WITH RECURSIVE {a.PREDICTIONS}, e AS (SELECT *, CAST(round(100 * market_price) AS BIGINT) AS pc, CAST(round(100 * probability) AS BIGINT) AS fc, CAST(market_id AS BIGINT) AS k FROM predictions WHERE {ELIGIBLE}),
g AS (SELECT *, fc > pc AS yes, CASE WHEN fc > pc THEN (fc - pc) / (100.0 - pc) ELSE (pc - fc) / CAST(pc AS DOUBLE) END AS kelly FROM e WHERE abs(fc - pc) >= 15 AND confidence IN ('medium', 'high') AND fc > 0 AND fc < 100),
z AS (SELECT *, CAST(round(100 * least(kelly * 0.25, 1.0) + 1e-7) AS BIGINT) AS s, least(99, greatest(1, CASE WHEN yes THEN pc + 1 ELSE pc END)) AS lp FROM g),
o AS (SELECT k % 40 AS book, k AS seq, (s * CASE WHEN yes THEN lp ELSE 100 - lp END + 50) // 100 AS cents, row_number() OVER (PARTITION BY k % 40 ORDER BY k) AS i FROM z WHERE s > 0),
w AS (SELECT book, 0::BIGINT AS i, NULL::BIGINT AS seq, false AS accepted, 0::BIGINT AS held FROM o WHERE i = 1
 UNION ALL SELECT o.book, o.i, o.seq, w.held + o.cents <= 1000, w.held + CASE WHEN w.held + o.cents <= 1000 THEN o.cents ELSE 0 END FROM w JOIN o ON o.book = w.book AND o.i = w.i + 1)
SELECT book, seq, accepted, held / 100.0::DOUBLE AS exposure FROM w WHERE i > 0""")
def market_trades(spark: SparkSession, sf: str) -> DataFrame:
    """The whole chain: landed texts, eligible markets, forecasts, opportunities, and admission book by book."""
    markets = market.eligible(market.landed_markets(landed_market_rows(spark, sf)), F.lit(f"{NOW} 00:00:00").cast("timestamp"))
    found = market.opportunities(markets.select("market_id", "yes_price"), a.predictions(spark, sf))
    orders = found.withColumns({"seq": c("market_id").cast("long"), "book": c("market_id").cast("long") % 40, "cost": f.trade_cost(c("size"), c("limit_price"), c("direction"))})
    return risk.admit(orders).select("book", "seq", "accepted", "exposure")


def even_scorer(rows: list[dict]) -> list[str]:
    """A scorer for tests: the price moved towards a half; every seventh answer is none."""
    answer = lambda p: json.dumps({"estimated_probability": round((p + 0.5) / 2, 6), "confidence": "medium", "reasoning": "r", "key_evidence": [], "risks": [], "bayesian_prior": 0.5})
    return [answer(x["market_price"]) if int(x["market_id"]) % 7 else "no answer" for x in rows]


@query(f"""WITH {a.PREDICTIONS} SELECT market_id, CAST(market_id AS BIGINT) % 7 <> 0 AS valid, {rd('CASE WHEN CAST(market_id AS BIGINT) % 7 <> 0 THEN (market_price + 0.5) / 2 ELSE market_price END', 5)} AS probability FROM predictions""")
def scored_markets(spark: SparkSession, sf: str) -> DataFrame:
    """Markets scored by a plug-in, answers checked, the price where there is none."""
    rows = a.predictions(spark, sf).select("market_id", "market_price")
    found = market.with_fallback(market.parsed_responses(market.scored(rows, even_scorer)))
    return found.select("market_id", "valid", r(c("probability"), 5).alias("probability"))


@query("""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'web' ELSE 'news' END AS provider, 't' || CAST(doc_id AS VARCHAR) AS title, 'http://x/' || CAST(doc_id AS VARCHAR) AS url,
 CASE WHEN doc_id % 4 = 3 THEN TIMESTAMP '2001-02-05 00:00:00' WHEN doc_id % 4 = 2 THEN TIMESTAMP '2001-06-27 12:00:00' WHEN doc_id % 4 = 1 THEN TIMESTAMP '2001-06-30 07:00:00' ELSE TIMESTAMP '2001-06-30 12:00:00' END AS published FROM documents WHERE doc_id IS NOT NULL""")
def search_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Answers of two search providers in one schema, their dates relative or with a month's name."""
    k = c("doc_id")
    when = F.when(k % 4 == 3, "February 5, 2001").when(k % 4 == 2, "3 days ago").when(k % 4 == 1, "5 hours ago").otherwise("some time")
    title, url = F.concat(F.lit("t"), k.cast("string")), F.concat(F.lit("http://x/"), k.cast("string"))
    web = F.to_json(F.struct(F.struct(F.array(F.struct(title.alias("title"), url.alias("url"), F.lit("s").alias("description"), when.alias("age"))).alias("results")).alias("web")))
    news = F.to_json(F.struct(F.array(F.struct(title.alias("title"), url.alias("link"), F.lit("s").alias("snippet"), when.alias("date"))).alias("news_results")))
    docs = a.table(spark, sf, "documents").where(k.isNotNull())
    now = F.lit(f"{NOW} 12:00:00").cast("timestamp")
    of = lambda kind, text: landed.search_results(docs.where(k % 2 == kind).select(text.alias("value"))).select(F.substring("title", 2, 20).cast("long").alias("doc_id"), F.lit(("web", "news")[kind]).alias("provider"), "title", "url", dates.relative_time(c("published"), now).cast("timestamp_ntz").alias("published"))
    return of(0, web).unionByName(of(1, news))


PROMPT_ROWS = """SELECT source, title, url, ord, row_number() OVER (PARTITION BY source ORDER BY ord) AS rn, CASE source WHEN 'google' THEN 'state_media' WHEN 'yahoo' THEN 'partisan' WHEN 'cnyes' THEN 'paywall' WHEN 'symbol' THEN 'paywall' END AS flag FROM news"""


@query(f"""WITH {a.NEWS}, x AS ({PROMPT_ROWS}) SELECT source, 'Will ' || source || ' happen?' || chr(10) || '50.0%' || chr(10) || string_agg('Article ' || CAST(rn AS VARCHAR) || coalesce(' [⚠️ ' || flag || ']', '') || ':' || chr(10) || '  Title: ' || coalesce(title, '') || chr(10)
 || '  Source: ' || source || ' ({NOW})' || chr(10) || '  Summary: ' || chr(10) || '  URL: ' || coalesce(url, ''), chr(10) || chr(10) ORDER BY rn) AS prompt FROM x WHERE rn <= 5 GROUP BY source""")
def article_prompts(spark: SparkSession, sf: str) -> DataFrame:
    """The first five articles of each question as numbered blocks with flags, filled into a prompt."""
    n = a.news(spark, sf).withColumns({"quality_flag": f.source_quality(f.host(c("url"))), "published": F.lit(NOW).cast("date"), "summary": F.lit("")})
    blocks = clean.article_blocks(clean.capped_articles(n, "source"), "source")
    question = F.concat(F.lit("Will "), "source", F.lit(" happen?"))
    return blocks.select("source", market.prompt("{question}\n{price}%\n{news}", question, F.lit(0.5), c("block")).alias("prompt"))


# --- rows, sets, ids -------------------------------------------------------------------------------------------------


@query(f"""WITH {a.STATEMENTS} SELECT symbol, quarter, CASE WHEN CAST(symbol AS BIGINT) % 3 = 0 THEN NULL ELSE revenue END AS revenue, CASE WHEN right(quarter, 1) = '2' THEN NULL ELSE tax END AS tax FROM statements WHERE CAST(symbol AS BIGINT) % 3 <> 0""")
def rows_and_symbols_with_values(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that are null in all features go, and symbols that have no value at all in one."""
    s, k = a.statements(spark, sf), c("symbol").cast("long")
    rows = s.select("symbol", "quarter", F.when(k % 3 != 0, c("revenue")).alias("revenue"), F.when(F.right("quarter", F.lit(1)) != "2", c("tax")).alias("tax"))
    return clean.symbols_with_values(clean.whole_null_rows(rows, ["revenue", "tax"]), "revenue")


@query("SELECT CAST(c_custkey AS VARCHAR) AS symbol, c_custkey IN (SELECT o_custkey FROM orders) AS traded FROM customer")
def symbol_sets(spark: SparkSession, sf: str) -> DataFrame:
    """Symbols in a universe and those without, as two sets that make up the whole."""
    customers = a.table(spark, sf, "customer").select(c("c_custkey").cast("string").alias("symbol"))
    traded = a.table(spark, sf, "orders").select(c("o_custkey").cast("string").alias("symbol"))
    return storage.only(customers, traded).withColumn("traded", F.lit(True)).unionByName(storage.without(customers, traded).withColumn("traded", F.lit(False)))


@query(f"WITH {a.PRICES}, {a.UNIVERSE} SELECT symbol, d, {rd('close')} AS close FROM prices JOIN universe USING (symbol) WHERE market IN ('NATION_3', 'NATION_8', 'NATION_13', 'NATION_20') AND category = 'general'")
def market_and_category(spark: SparkSession, sf: str) -> DataFrame:
    """The prices of the symbols that a market and a category name."""
    chosen = storage.selected(a.universe(spark, sf), markets=("NATION_3", "NATION_8", "NATION_13", "NATION_20"), categories=("general",))
    return storage.only(a.prices(spark, sf), chosen).select("symbol", "d", r(c("close")).alias("close"))


@query(f"""WITH {a.PREDICTIONS} SELECT sha256(market_id || '|' || CAST(predicted_at AS VARCHAR)) AS id, market_id, '["e' || market_id || '","x"]' AS key_evidence, '[]' AS risks FROM predictions""")
def stored_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Forecasts appended with ids that repeated runs give again and arrays as JSON, read back."""
    path = shared_path(spark, "predictions")
    p = a.predictions(spark, sf)
    rows = p.select(f.row_id(c("market_id"), c("predicted_at")).alias("id"), "market_id", F.array(F.concat(F.lit("e"), "market_id"), F.lit("x")).alias("key_evidence"), F.array().cast("array<string>").alias("risks"))
    storage.append(storage.with_json_arrays(rows), path)
    return spark.read.schema("id string, market_id string, key_evidence string, risks string").parquet(path)


@query("SELECT n_nationkey, n_name FROM nation")
def reloaded_rows(spark: SparkSession, sf: str) -> DataFrame:
    """A table that was loaded before, dropped and loaded anew."""
    path = shared_path(spark, "reloaded")
    rows = a.table(spark, sf, "nation").select("n_nationkey", "n_name")
    storage.reload(rows.unionAll(rows), path)
    storage.reload(rows, path)
    return spark.read.schema(rows.schema).parquet(path)


@query("SELECT DISTINCT date_trunc('month', o_orderdate)::DATE AS month, (year(DATE '2001-06-30') - year(o_orderdate)) * 12 + 6 - month(o_orderdate) - 3 AS gap FROM orders")
def month_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Months from each order's to a given one, less the three that a report takes."""
    d = F.trunc("o_orderdate", "MM")
    return a.table(spark, sf, "orders").select(d.alias("month"), dates.month_gap(d, F.lit(NOW).cast("date")).cast("long").alias("gap")).distinct()


ORACLES["code_mentions"] = """WITH x AS (SELECT doc_id, [y FOR y IN regexp_split_to_array(text, '[^\\p{L}\\p{N}_]+') IF regexp_full_match(y, '[0-9]{4}')] AS codes FROM documents) SELECT doc_id, codes FROM x WHERE len(codes) > 0"""
#: The pages' anchors have no attribute but the address and no markup inside.
ORACLES["page_links"] = """WITH x AS (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1) AS h, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2) AS t FROM pages)
SELECT page_id, i - 1 AS ord, t[i] AS title, h[i] AS href FROM (SELECT *, unnest(range(1, len(h) + 1)) AS i FROM x)"""
