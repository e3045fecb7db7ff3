"""Queries over the given tables, each beside its SQL: one for every operator or job."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dates, panel
from ..functions import scalars as f
from ..operators import clean, factors, market, risk, scoring
from ..sources import landed, storage
from . import adapters as a

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
NOW = "2001-06-30"
c = F.col


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def r(x: Column, n: int = 6) -> Column:
    return F.round(x + F.signum(x) * 1e-9, n)


S = "PARTITION BY symbol ORDER BY d"


def frame(n: int) -> str:
    return f"OVER (PARTITION BY symbol ORDER BY d ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def roll(fn: str, x: str, n: int) -> str:
    return f"CASE WHEN count({x}) {frame(n)} = {n} THEN {fn}({x}) {frame(n)} END"


def rd(x: str, n: int = 6) -> str:
    return f"round({x} + sign({x}) * 1e-9, {n}) + 0.0"


# --- rolling and cross-sectional ---------------------------------------------------------------------------------


@query(f"WITH {a.PRICES} SELECT symbol, d, {rd(roll('avg', 'close', 20))} AS ma FROM prices")
def rolling_mean(spark: SparkSession, sf: str) -> DataFrame:
    return a.prices(spark, sf).select("symbol", "d", r(panel.rolling(F.avg, c("close"), 20)).alias("ma"))


@query(f"""WITH {a.PRICES}, m AS (SELECT *, {roll('avg', 'close', 20)} AS ma, row_number() OVER ({S}) AS i FROM prices)
SELECT symbol, d, {rd('(close - ma) / ma')} AS bias FROM m WHERE i > 20""")
def bias_ratio(spark: SparkSession, sf: str) -> DataFrame:
    rows = a.prices(spark, sf).withColumns({"bias": r(panel.bias_ratio(c("close"), 20)), "i": F.row_number().over(panel.series())})
    return rows.where("i > 20").select("symbol", "d", "bias")


#: Prices as whole ten-thousandths: whether a bias is 0 is not left to the order in which doubles are added.
BACKTEST = f"""WITH {a.PRICES}, u AS (SELECT *, CAST(round(close * 10000) AS BIGINT) AS units FROM prices), m AS (SELECT *, {roll('sum', 'units', 20)} AS total FROM u), b AS (SELECT *, CAST(20 * units - total AS DOUBLE) / CAST(total AS DOUBLE) AS bias FROM m WHERE total IS NOT NULL),
s AS (SELECT *, CASE WHEN bias < avg(bias) FILTER (WHERE bias > 0) OVER (PARTITION BY symbol) THEN -1 WHEN bias > avg(bias) FILTER (WHERE bias < 0) OVER (PARTITION BY symbol) THEN 1 ELSE 0 END AS signal FROM b),
t AS (SELECT *, close / lag(close) OVER ({S}) - 1 AS ret, lag(signal) OVER ({S}) AS position FROM s)
SELECT symbol, d, {rd('bias')} AS bias, signal, {rd('product(1 + ret) OVER (' + S + ' ROWS UNBOUNDED PRECEDING)')} AS market_growth, {rd('product(1 + ret * position) OVER (' + S + ' ROWS UNBOUNDED PRECEDING)')} AS strategy_growth FROM t"""


@query(BACKTEST)
def bias_backtest(spark: SparkSession, sf: str) -> DataFrame:
    return factors.bias_backtest(a.prices(spark, sf)).select("symbol", "d", r(c("bias")).alias("bias"), "signal", r(c("market_growth")).alias("market_growth"), r(c("strategy_growth")).alias("strategy_growth"))


@query(f"WITH {a.PRICES} SELECT symbol, d, close, close = {roll('max', 'close', 120)} AS high FROM prices")
def breakout_high(spark: SparkSession, sf: str) -> DataFrame:
    return a.prices(spark, sf).select("symbol", "d", "close", panel.breakout(c("close"), 120).alias("high"))


@query(f"WITH {a.PRICES} SELECT symbol, d, {rd('1 - (' + roll('min', 'close', 60) + ') / (' + roll('max', 'close', 60) + ')')} AS tightness FROM prices")
def range_tightness(spark: SparkSession, sf: str) -> DataFrame:
    return a.prices(spark, sf).select("symbol", "d", r(panel.range_tightness(c("close"), 60)).alias("tightness"))


@query(f"WITH {a.PRICES} SELECT symbol, d, {rd('-(' + roll('stddev_samp', 'close', 20) + ')', 4)} AS variability FROM prices")
def rolling_std(spark: SparkSession, sf: str) -> DataFrame:
    return a.prices(spark, sf).select("symbol", "d", r(-panel.rolling(F.stddev_samp, c("close"), 20), 4).alias("variability"))


@query(f"""WITH {a.PRICES}, p AS (SELECT symbol, d, close * 0.14::DOUBLE AS close FROM prices), q AS (SELECT d, quantile_cont(close, 0.15) AS cut FROM p GROUP BY d),
t AS (SELECT *, 1 - ({roll('min', 'close', 60)}) / ({roll('max', 'close', 60)}) AS tightness FROM p)
SELECT symbol, d, {rd('close')} AS close, {rd('cut')} AS cut, {rd('tightness')} AS tightness FROM t JOIN q USING (d) WHERE close < cut AND close <= 15""")
def low_price_screen(spark: SparkSession, sf: str) -> DataFrame:
    """The tables' prices are around 100; scaled to around 15, both bounds count."""
    p = a.prices(spark, sf).select("symbol", "d", (c("close") * 0.14).alias("close"))
    return factors.low_price_screen(p).select("symbol", "d", r(c("close")).alias("close"), r(c("cut")).alias("cut"), r(c("tightness")).alias("tightness"))


@query(f"WITH {a.PRICES}, z AS (SELECT *, (close - avg(close) OVER (PARTITION BY d)) / nullif(stddev_pop(close) OVER (PARTITION BY d), 0) AS z FROM prices) SELECT symbol, d, CASE WHEN abs(z) <= 3.000000001 THEN {rd('z', 5)} END AS z FROM z")
def zscore_cross_section(spark: SparkSession, sf: str) -> DataFrame:
    return a.prices(spark, sf).select("symbol", "d", r(panel.zscore(c("close")), 5).alias("z"))


@query(f"""WITH {a.PRICES}, m AS (SELECT *, {roll('avg', 'close', 5)} AS ma, row_number() OVER ({S}) AS i FROM prices),
u AS (SELECT *, CASE WHEN ma > lag(ma) OVER ({S}) THEN 1 ELSE 0 END AS up FROM m)
SELECT symbol, d, CASE WHEN sum(up) {frame(3)} = 3 AND i > 3 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS streak FROM u""")
def rising_streak(spark: SparkSession, sf: str) -> DataFrame:
    return panel.rising_streak(a.prices(spark, sf), "close", 5, 3).select("symbol", "d", "streak")


@query(f"WITH {a.PRICES} SELECT symbol, d, {rd('close / lag(close) OVER (' + S + ') - 1')} AS ret, {rd('100 * (close / lag(close, 12) OVER (' + S + ') - 1)')} AS year_pct FROM prices")
def pct_change(spark: SparkSession, sf: str) -> DataFrame:
    return a.prices(spark, sf).select("symbol", "d", r(panel.pct_change(c("close"))).alias("ret"), r(100 * (F.try_divide(c("close"), F.lag("close", 12).over(panel.series())) - 1)).alias("year_pct"))


@query(f"""WITH {a.PRICES}, t AS (SELECT *, close / lag(close) OVER ({S}) - 1 AS ret FROM prices)
SELECT symbol, d, {rd('product(1 + ret) OVER (' + S + ' ROWS UNBOUNDED PRECEDING)', 5)} AS growth FROM t""")
def cumulative_return(spark: SparkSession, sf: str) -> DataFrame:
    rows = a.prices(spark, sf).withColumn("ret", panel.pct_change(c("close")))
    return rows.select("symbol", "d", r(panel.compounded(c("ret")), 5).alias("growth"))


@query(f"""WITH {a.OHLC}, s AS (SELECT min(d) AS lo, max(d) AS hi FROM ohlc), g AS (SELECT symbol, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS d FROM (SELECT DISTINCT symbol FROM ohlc), s)
SELECT symbol, d, {rd('last_value(close IGNORE NULLS) OVER (' + S + ')')} AS close FROM g LEFT JOIN ohlc USING (symbol, d)""")
def densify_ffill(spark: SparkSession, sf: str) -> DataFrame:
    return panel.densify(a.ohlc(spark, sf), ["close"]).select("symbol", "d", r(c("close")).alias("close"))


DEADLINE = """CASE right(quarter, 1) WHEN '1' THEN make_date(y, 5, 15) WHEN '2' THEN make_date(y, 8, 14) WHEN '3' THEN make_date(y, 11, 14) ELSE make_date(y + 1, 3, 31) END"""


def rolled(x: str) -> str:
    return f"({x}) + CASE isodow({x}) WHEN 6 THEN 2 WHEN 7 THEN 1 ELSE 0 END"


@query(f"""WITH {a.PRICES}, {a.STATEMENTS}, p AS (SELECT symbol, quarter, revenue, {rolled(DEADLINE)} AS published FROM (SELECT *, CAST(left(quarter, 4) AS INTEGER) AS y FROM statements))
SELECT x.symbol, x.d, p.revenue, p.quarter FROM prices x ASOF LEFT JOIN p ON x.symbol = p.symbol AND x.d >= p.published""")
def asof_quarterly_to_daily(spark: SparkSession, sf: str) -> DataFrame:
    right = a.statements(spark, sf).withColumn("published", dates.filing_deadline(c("quarter")))
    return panel.asof(a.prices(spark, sf).select("symbol", "d"), right, ["revenue", "quarter"], published="published")


@query(f"""WITH {a.PRICES}, e AS (SELECT DISTINCT last_day(d) AS probe FROM prices), n AS (SELECT probe, t.d FROM e ASOF JOIN (SELECT DISTINCT d FROM prices) t ON e.probe >= t.d),
x AS (SELECT symbol, probe, close FROM n JOIN prices USING (d)), y AS (SELECT symbol, probe, 100 * (close / lag(close) OVER (PARTITION BY symbol ORDER BY probe) - 1) AS ret FROM x)
SELECT symbol, probe, {rd('ret')} AS period_return FROM y WHERE ret IS NOT NULL""")
def period_return(spark: SparkSession, sf: str) -> DataFrame:
    p = a.prices(spark, sf)
    probes = p.select(F.last_day("d").alias("probe")).distinct()
    at = panel.asof_dates(p, probes).join(p, "d").select("symbol", "probe", "close")
    return panel.period_return(at, "close", "probe").select("symbol", "probe", r(c("period_return")).alias("period_return"))


ZS = ("cash_flow_share", "earnings_yield", "shareholder_yield", "ebitda_ev", "roe", "roa", "variability", "cash_flow_assets", "gross_profit_assets", "leverage", "income_streak", "revenue_streak")
Z_SQL = ", ".join(f"CASE WHEN abs((({n}) - avg({n}) OVER p) / nullif(stddev_pop({n}) OVER p, 0)) <= 3.000000001 THEN (({n}) - avg({n}) OVER p) / nullif(stddev_pop({n}) OVER p, 0) END AS z_{n}" for n in ZS)


def streak_sql(x: str) -> str:
    """1 where the mean of five rows rose three times running."""
    return f"CASE WHEN i > 3 AND sum(CASE WHEN up_{x} THEN 1 ELSE 0 END) {frame(3)} = 3 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"


@query(f"""WITH {a.STATEMENTS}, {a.UNIVERSE}, {a.FACTOR_ROWS}, b AS (SELECT f.*, category, shares / 10 * close AS cap, shares / 10 * close + debt - cash AS ev, ebitda / lag(ebitda) OVER ({S}) - 1 AS growth, row_number() OVER ({S}) AS i,
 {roll('avg', 'net_income', 5)} AS ma_income, {roll('avg', 'revenue', 5)} AS ma_revenue FROM factor_rows f JOIN universe USING (symbol) WHERE category <> 'etf'),
m AS (SELECT *, cash_flow / nullif(shares, 0) AS cash_flow_share, eps / nullif(close, 0) AS earnings_yield, dividend_yield + (shares - lag(shares, 12) OVER ({S})) * close / nullif(cap, 0) AS shareholder_yield, ebitda / nullif(ev, 0) AS ebitda_ev,
 net_income / nullif(equity, 0) AS roe, net_income / nullif(assets, 0) AS roa, -({roll('stddev_samp', 'growth', 20)}) AS variability, cash_flow / nullif(assets, 0) AS cash_flow_assets, gross_profit / nullif(assets, 0) AS gross_profit_assets,
 debt / nullif(equity, 0) AS leverage, ma_income > lag(ma_income) OVER ({S}) AS up_income, ma_revenue > lag(ma_revenue) OVER ({S}) AS up_revenue FROM b),
k AS (SELECT *, {streak_sql('income')} AS income_streak, {streak_sql('revenue')} AS revenue_streak FROM m), z AS (SELECT *, {Z_SQL} FROM k WINDOW p AS (PARTITION BY d)),
t AS (SELECT *, 0.4 * CASE category WHEN 'financial' THEN (z_roe + z_variability + z_roa) / 3 ELSE 0.2 * (z_roe + z_variability + z_cash_flow_assets + z_gross_profit_assets + z_leverage) END
 + 0.3 * CASE category WHEN 'financial' THEN 0.3 * z_cash_flow_share + 0.3 * z_ebitda_ev + 0.3 * z_earnings_yield + 0.1 * z_shareholder_yield ELSE 0.4 * z_cash_flow_share + 0.4 * z_earnings_yield + 0.2 * z_shareholder_yield END
 + 0.3 * (z_income_streak + z_revenue_streak) AS total FROM z),
w AS (SELECT symbol, d, round(CASE WHEN total >= 0 THEN 1 + total ELSE 1 / (1 - total) END, 6) AS score FROM t),
q AS (SELECT d, round(quantile_cont(score, 0.75), 6) AS cut FROM w GROUP BY d) SELECT symbol, d, score, coalesce(score > cut, false) AS selected FROM w JOIN q USING (d)""")
def multi_factor_rating(spark: SparkSession, sf: str) -> DataFrame:
    return factors.multi_factor_rating(a.factor_rows(spark, sf), a.universe(spark, sf)).select("symbol", "d", "score", "selected")


TOP = f"""{a.STATEMENTS}, v AS (SELECT symbol, quarter, {rd('(revenue - discounts) / nullif(quantity, 0)', 4)} AS value FROM statements)"""


def quality_of(spark: SparkSession, sf: str) -> DataFrame:
    return a.statements(spark, sf).select("symbol", "quarter", r(F.try_divide(c("revenue") - c("discounts"), c("quantity")), 4).alias("value"))


@query(f"WITH {TOP} SELECT quarter, symbol, value, rank FROM (SELECT *, row_number() OVER (PARTITION BY quarter ORDER BY value DESC, symbol) AS rank FROM v WHERE value IS NOT NULL) WHERE rank <= 5")
def top_k_per_quarter(spark: SparkSession, sf: str) -> DataFrame:
    return panel.top_k(quality_of(spark, sf), "quarter", "value", 5).select("quarter", "symbol", "value", c("rank").cast("long").alias("rank"))


@query(f"""WITH {a.PRICES}, {TOP}, n AS (SELECT count(DISTINCT quarter) AS n FROM v), full_s AS (SELECT symbol FROM v WHERE value IS NOT NULL GROUP BY symbol HAVING count(DISTINCT quarter) = (SELECT n FROM n)),
picks AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY quarter ORDER BY value DESC, symbol) AS rank FROM v WHERE value IS NOT NULL AND symbol IN (SELECT symbol FROM full_s)) WHERE rank <= 5),
e AS (SELECT quarter, {rolled('last_day(make_date(CAST(left(quarter, 4) AS INTEGER), 3 * CAST(right(quarter, 1) AS INTEGER), 1))')} AS d,
 lead(quarter) OVER (ORDER BY quarter) AS exit_quarter FROM (SELECT DISTINCT quarter FROM v)),
pt AS (SELECT s.symbol, e.quarter, e.d, e.exit_quarter FROM (SELECT DISTINCT symbol FROM picks) s, e), x AS (SELECT pt.*, close FROM pt ASOF LEFT JOIN prices p ON pt.symbol = p.symbol AND pt.d >= p.d),
g AS (SELECT a.exit_quarter AS quarter, sum(b.close / a.close - 1) AS gain FROM picks JOIN x a USING (symbol, quarter) JOIN x b ON b.symbol = a.symbol AND b.quarter = a.exit_quarter GROUP BY 1)
SELECT e.quarter, {rd('100 * coalesce(gain, 0)')} AS roi, {rd('10000 * product(1 + coalesce(gain, 0)) OVER (ORDER BY e.quarter)', 2)} AS capital
FROM (SELECT exit_quarter AS quarter FROM e WHERE exit_quarter IS NOT NULL UNION SELECT min(quarter) FROM e) e LEFT JOIN g USING (quarter)""")
def top_k_backtest(spark: SparkSession, sf: str) -> DataFrame:
    found = factors.top_k_backtest(quality_of(spark, sf), a.prices(spark, sf))
    return found.select("quarter", r(c("roi")).alias("roi"), r(c("capital"), 2).alias("capital"))


FEE = repr(factors.FEE)


@query(f"""WITH {a.PRICES}, hi AS (SELECT symbol, d, close, {roll('max', 'close', 20)} AS top FROM prices), s AS (SELECT symbol, d, date_trunc('month', d) AS m FROM hi WHERE close >= 0.9 * top),
k AS (SELECT symbol, m, least(0.2, 1.0 / count(*) OVER (PARTITION BY m)) AS weight FROM (SELECT *, max(d) OVER (PARTITION BY m) AS last FROM s) WHERE d = last),
f AS (SELECT symbol, date_trunc('month', d) AS m, arg_min(close, d) AS price FROM prices GROUP BY 1, 2)
SELECT CAST(k.m + INTERVAL 1 MONTH AS DATE) AS month, {rd(f'sum(weight * (o.price * (1 - {FEE}) / (i.price * (1 + {FEE})) - 1))')} AS ret, count(*) AS n
FROM k JOIN f i ON i.symbol = k.symbol AND i.m = k.m + INTERVAL 1 MONTH JOIN f o ON o.symbol = k.symbol AND o.m = k.m + INTERVAL 2 MONTH GROUP BY 1""")
def rebalance_returns(spark: SparkSession, sf: str) -> DataFrame:
    p = a.prices(spark, sf)
    chosen = p.withColumn("top", panel.rolling(F.max, c("close"), 20)).where("close >= 0.9D * top").select("symbol", "d")
    found = factors.rebalance_returns(chosen, p)
    return found.select("month", r(c("ret")).alias("ret"), "n")


@query(f"""WITH {a.PRICES}, i AS (SELECT symbol, d, close, row_number() OVER ({S}) - 1 AS i FROM prices),
h AS (SELECT x.symbol, x.d, x.close, x.i, x.i - coalesce(max(y.i) FILTER (WHERE y.close > x.close), -1) AS up, x.i - coalesce(max(y.i) FILTER (WHERE y.close < x.close), -1) AS down
 FROM i x LEFT JOIN i y ON y.symbol = x.symbol AND y.i < x.i GROUP BY x.symbol, x.d, x.close, x.i) SELECT symbol, d, close, CASE WHEN i = 0 THEN 0 WHEN up >= down THEN up ELSE -down END AS record FROM h""")
def record_breaker(spark: SparkSession, sf: str) -> DataFrame:
    return panel.record_breaker(a.prices(spark, sf), "close")


@query(f"""WITH {a.STATEMENTS}, w AS (SELECT symbol, quarter, revenue, count(revenue) OVER x AS n, sum(revenue) OVER x AS prior FROM statements WINDOW x AS (PARTITION BY symbol ORDER BY quarter ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING))
SELECT symbol, quarter, {rd("CASE WHEN right(quarter, 1) = '4' AND n = 3 THEN revenue - prior ELSE revenue END", 2)} AS alone FROM w""")
def q4_decumulate(spark: SparkSession, sf: str) -> DataFrame:
    return clean.q4_alone(a.statements(spark, sf), "revenue").select("symbol", "quarter", r(c("alone"), 2).alias("alone"))


@query(f"WITH {a.STATEMENTS} SELECT symbol FROM statements WHERE revenue IS NOT NULL GROUP BY symbol HAVING count(DISTINCT quarter) = (SELECT count(DISTINCT quarter) FROM statements)")
def complete_history_symbols(spark: SparkSession, sf: str) -> DataFrame:
    return panel.complete_symbols(a.statements(spark, sf), "revenue", "quarter")


@query(f"WITH {a.PRICES} SELECT symbol, count(*) FILTER (WHERE ma IS NULL) AS ma_nulls, count(*) AS n FROM (SELECT symbol, {roll('avg', 'close', 20)} AS ma FROM prices) GROUP BY symbol")
def null_profile(spark: SparkSession, sf: str) -> DataFrame:
    return clean.null_profile(a.prices(spark, sf).withColumn("ma", panel.rolling(F.avg, c("close"), 20)), ["ma"])


# --- markets, risk and scores --------------------------------------------------------------------------------------

KINDS = "['tech', 'sports', 'AI', 'politics', '']"


@query(f"""SELECT CAST(p_partkey AS VARCHAR) AS market_id, round(p_partkey % 101 / 100.0::DOUBLE, 2) AS yes_price, p_retailprice * 10 AS volume_24h,
 CASE WHEN p_partkey % 5 = 4 THEN lower(p_type) ELSE lower({KINDS}[p_partkey % 5 + 1]) END AS category FROM part
WHERE p_partkey % 7 <> 0 AND p_partkey % 11 <> 0 AND p_retailprice * 10 >= 1000 AND (lower({KINDS}[p_partkey % 5 + 1]) IN ('tech', 'ai') OR p_partkey % 3 = 0) AND DATE '{NOW}' + CAST(p_size AS INTEGER) >= DATE '{NOW}' + 3""")
def market_eligibility(spark: SparkSession, sf: str) -> DataFrame:
    k = c("p_partkey")
    kinds = F.array(*map(F.lit, ("tech", "sports", "AI", "politics", "")))
    outcome = lambda name, price: F.struct(F.lit(name).alias("outcome"), price.cast("string").alias("price"))
    yes = k % 101 / F.lit(100.0)
    tokens = F.when(k % 7 == 0, F.array(outcome("Yes", yes))).when(k % 11 == 0, F.array(outcome("Up", yes), outcome("Down", yes))).otherwise(F.array(outcome("No", 1 - yes), outcome("Yes", yes)))
    tags = F.when(k % 3 == 0, F.array(c("p_type"), F.lit("Crypto"))).otherwise(F.array(c("p_type")))
    end = F.concat(F.date_add(F.lit(NOW).cast("date"), c("p_size")).cast("string"), F.lit("T00:00:00Z"))
    one = F.struct(k.cast("string").alias("condition_id"), tokens.alias("tokens"), tags.alias("tags"), (c("p_retailprice") * 10).cast("string").alias("volume_num_24hr"), F.get(kinds, (k % 5).cast("int")).alias("category"), end.alias("end_date_iso"), c("p_name").alias("question"))
    raw = a.table(spark, sf, "part").select(F.when(k % 2 == 0, F.to_json(F.array(one))).otherwise(F.concat(F.lit('{"data": '), F.to_json(F.array(one)), F.lit(', "next_cursor": "x"}'))).alias("value"))
    return market.eligible(market.landed_markets(raw), F.lit(f"{NOW} 00:00:00").cast("timestamp")).select("market_id", "yes_price", "volume_24h", "category")


KELLY = "CASE WHEN {o} <= 0 OR {p} <= 0 OR {p} >= 1 THEN 0 ELSE greatest(0, ({o} * {p} - (1 - {p})) / {o}) END"
SIZE = f"round(least(CASE WHEN probability > price THEN {KELLY.format(o='(1 / price - 1)', p='probability')} ELSE {KELLY.format(o='(1 / (1 - price) - 1)', p='(1 - probability)')} END * 0.25::DOUBLE, 1.0::DOUBLE) + 1e-9, 2)"


@query(f"""WITH {a.PREDICTIONS}, e AS (SELECT *, market_price AS price, round(probability - market_price + 1e-9, 4) AS edge, CASE WHEN probability > market_price THEN 'YES' ELSE 'NO' END AS direction FROM predictions), s AS (SELECT *, {SIZE} AS size FROM e)
SELECT market_id, edge, direction, size, least(0.99::DOUBLE, greatest(0.01::DOUBLE, round(CASE direction WHEN 'YES' THEN price + 0.005::DOUBLE ELSE price - 0.005::DOUBLE END + 1e-9, 2))) AS limit_price, n_articles < 3 AS low_evidence
FROM s WHERE abs(edge) >= 0.15::DOUBLE AND confidence IN ('medium', 'high') AND size > 0""")
def opportunities(spark: SparkSession, sf: str) -> DataFrame:
    p = a.predictions(spark, sf)
    markets = p.select("market_id", c("market_price").alias("yes_price"))
    return market.opportunities(markets, p).select("market_id", "edge", "direction", "size", "limit_price", "low_evidence")


#: Money in decimals, which round a half up exactly, where Spark's side rounds doubles.
MONEY = "CAST(size AS DECIMAL(12,2)) * CASE direction WHEN 'YES' THEN CAST(limit_price AS DECIMAL(12,2)) ELSE 1 - CAST(limit_price AS DECIMAL(12,2)) END"
COST = f"CAST(round({MONEY}, 2) AS DOUBLE)"


@query(f"""WITH RECURSIVE {a.TRADES}, o AS (SELECT book, seq, size, CAST(round(100 * {COST}) AS BIGINT) AS cents, row_number() OVER (PARTITION BY book ORDER BY seq) AS i FROM trades),
w AS (SELECT book, seq, i, size <= 1.0 AND cents <= 1000 AS accepted, CASE WHEN size <= 1.0 AND cents <= 1000 THEN cents ELSE 0 END AS held FROM o WHERE i = 1
 UNION ALL SELECT o.book, o.seq, o.i, o.size <= 1.0 AND w.held + o.cents <= 1000, w.held + CASE WHEN o.size <= 1.0 AND w.held + o.cents <= 1000 THEN o.cents ELSE 0 END FROM w JOIN o ON o.book = w.book AND o.i = w.i + 1)
SELECT book, seq, accepted, held / 100.0::DOUBLE AS exposure FROM w""")
def risk_admission(spark: SparkSession, sf: str) -> DataFrame:
    t = a.trades(spark, sf)
    t = t.withColumn("cost", f.trade_cost(c("size"), c("limit_price"), c("direction")))
    return risk.admit(t).select("book", "seq", "accepted", "exposure")


#: A book day by day: loss and halt start anew each day; what is resolved counts to the day, what is open to the exposure.
#: Money is counted in whole hundredths of cents here.
DESK = f"""WITH RECURSIVE {a.TRADES}, x AS (SELECT book, seq, CAST(timestamp AS DATE) AS day, size, outcome, CAST(round(size * 100) AS BIGINT) AS s,
  CAST(round(size * 100) AS BIGINT) * CASE direction WHEN 'YES' THEN CAST(round(limit_price * 100) AS BIGINT) ELSE 100 - CAST(round(limit_price * 100) AS BIGINT) END AS cost FROM trades),
y AS (SELECT *, CASE WHEN outcome = 1 THEN 100 * s - cost WHEN outcome IS NOT NULL THEN -cost END AS won FROM x),
o AS (SELECT book, seq, day, size, (cost + 50) // 100 AS cents, CAST(sign(won) AS BIGINT) * ((abs(won) + 50) // 100) AS pnl, row_number() OVER (PARTITION BY book ORDER BY day, seq) AS i FROM y),
w AS (SELECT book, 0::BIGINT AS i, NULL::BIGINT AS seq, NULL::DATE AS day, false AS accepted, 0::BIGINT AS held, 0::BIGINT AS lost, false AS halted FROM o WHERE i = 1
 UNION ALL SELECT book, i, seq, day, ok, held + CASE WHEN ok AND pnl IS NULL THEN cents ELSE 0 END, lost + CASE WHEN ok THEN coalesce(pnl, 0) ELSE 0 END, halted OR (ok AND pnl IS NOT NULL AND lost + pnl <= -400)
  FROM (SELECT o.book, o.i, o.seq, o.day, o.cents, o.pnl, w.held, CASE WHEN o.day = w.day THEN w.lost ELSE 0 END AS lost, coalesce(o.day = w.day AND w.halted, false) AS halted,
   NOT coalesce(o.day = w.day AND w.halted, false) AND o.size <= 1.0 AND w.held + o.cents <= 1000 AS ok FROM w JOIN o ON o.book = w.book AND o.i = w.i + 1))
SELECT book, seq, day, accepted, held / 100.0::DOUBLE AS exposure, lost / 100.0::DOUBLE AS day_pnl, halted FROM w WHERE i > 0"""


def desk_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Trades with what they cost and, where they are resolved, what they earned."""
    t = a.trades(spark, sf)
    pnl = f.payoff(c("size"), c("limit_price"), c("direction"), c("outcome"))
    return t.select("book", "seq", c("timestamp").cast("timestamp").alias("timestamp"), F.to_date("timestamp").alias("day"), "size", f.trade_cost(c("size"), c("limit_price"), c("direction")).alias("cost"), f.cents(pnl).alias("pnl"))


@query(DESK)
def trading_desk(spark: SparkSession, sf: str) -> DataFrame:
    """Admission and daily halt of every book together."""
    return risk.trading_desk(desk_rows(spark, sf)).select("book", "seq", "day", "accepted", "exposure", "day_pnl", "halted")


PAYOFF = f"CASE WHEN outcome = 1 THEN CAST(size AS DECIMAL(12,2)) - {MONEY} WHEN outcome IS NOT NULL THEN -({MONEY}) END"


@query(f"""WITH {a.TRADES}, p AS (SELECT book, CAST(timestamp AS DATE) AS d, seq, {PAYOFF} AS pnl FROM trades WHERE outcome IS NOT NULL),
x AS (SELECT *, CAST(round(sum(pnl) OVER w, 2) AS DOUBLE) AS day_pnl FROM p WINDOW w AS (PARTITION BY book, d ORDER BY seq ROWS UNBOUNDED PRECEDING))
SELECT book, d, seq, day_pnl + 0.0 AS day_pnl, bool_or(day_pnl <= -4.0) OVER (PARTITION BY book, d ORDER BY seq ROWS UNBOUNDED PRECEDING) AS halted FROM x""")
def loss_halt(spark: SparkSession, sf: str) -> DataFrame:
    t = a.trades(spark, sf).where("outcome is not null")
    pnl = f.payoff(c("size"), c("limit_price"), c("direction"), c("outcome"))
    rows = t.select("book", F.to_date("timestamp").alias("d"), "seq", pnl.alias("pnl"))
    return risk.halts(rows).select("book", "d", "seq", "day_pnl", "halted")


@query(f"WITH {a.TRADES} SELECT book, round(sum(CASE WHEN outcome IS NULL AND status <> 'cancelled' THEN {COST} ELSE 0 END) + 1e-9, 2) AS exposure FROM trades GROUP BY book")
def open_exposure(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.exposure(a.trades(spark, sf))


@query(f"WITH {a.TRADES} SELECT CAST(timestamp AS DATE) AS d, CAST(round(sum({PAYOFF}), 2) AS DOUBLE) + 0.0 AS pnl, count(*) AS n FROM trades WHERE outcome IS NOT NULL GROUP BY 1")
def daily_pnl(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.daily_pnl(a.trades(spark, sf))


BRIER = "round(avg(pow(CASE direction WHEN 'NO' THEN 1 - probability ELSE probability END - outcome, 2)) + 1e-9, 4)"


@query(f"WITH {a.TRADES}, {a.PREDICTIONS} SELECT {BRIER} AS brier FROM trades JOIN predictions USING (prediction_id) WHERE outcome IS NOT NULL")
def brier(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.brier(scoring.resolved(a.trades(spark, sf), a.predictions(spark, sf)))


CALIBRATION = """SELECT bucket, count(*) AS n, round(avg(outcome) + 1e-9, 3) AS actual, CAST(bucket * 10 AS VARCHAR) || '%-' || CAST((bucket + 1) * 10 AS VARCHAR) || '%' AS label
 FROM (SELECT CAST(floor(probability / 0.1::DOUBLE) AS BIGINT) AS bucket, outcome FROM trades JOIN predictions USING (prediction_id) WHERE outcome IS NOT NULL) GROUP BY bucket"""


@query(f"WITH {a.TRADES}, {a.PREDICTIONS} {CALIBRATION}")
def calibration(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.calibration(scoring.resolved(a.trades(spark, sf), a.predictions(spark, sf)))


@query(f"""WITH {a.TRADES}, {a.PREDICTIONS} SELECT count(DISTINCT prediction_id) AS n_predictions, count(trade_id) AS n_trades, count(*) FILTER (WHERE outcome IS NULL AND status <> 'cancelled') AS n_open, count(outcome) AS n_resolved,
 {BRIER} AS brier, CAST(round(sum({PAYOFF}), 2) AS DOUBLE) + 0.0 AS pnl, (SELECT string_agg(label || ' ' || CAST(n AS VARCHAR) || ' ' || CAST(actual AS VARCHAR), '; ' ORDER BY bucket) FROM ({CALIBRATION})) AS calibration FROM trades JOIN predictions USING (prediction_id)""")
def report(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.report(a.trades(spark, sf), a.predictions(spark, sf))


@query(f"""WITH {a.TRADES}, {a.PREDICTIONS} SELECT trade_id, prediction_id, probability, outcome, timestamp FROM trades JOIN predictions USING (prediction_id) WHERE outcome IS NOT NULL ORDER BY timestamp DESC, trade_id LIMIT 50""")
def recent_resolved(spark: SparkSession, sf: str) -> DataFrame:
    rows = scoring.resolved(a.trades(spark, sf), a.predictions(spark, sf)).select("trade_id", "prediction_id", "probability", "outcome", "timestamp")
    return storage.recent(rows, 50, "timestamp", "trade_id")


@query(f"WITH {a.PREDICTIONS} SELECT prediction_id, probability BETWEEN 0 AND 1 AND bayesian_prior BETWEEN 0.2 AND 1 AND confidence IN ('low', 'medium', 'high') AS valid FROM predictions")
def prediction_constraints(spark: SparkSession, sf: str) -> DataFrame:
    p = a.predictions(spark, sf)
    good, bad = scoring.valid_predictions(p.withColumn("bayesian_prior", F.when(c("bayesian_prior") >= 0.2, c("bayesian_prior")).otherwise(-1.0)))
    return good.select("prediction_id", F.lit(True).alias("valid")).unionByName(bad.select("prediction_id", F.lit(False).alias("valid")))


@query(f"""WITH {a.PREDICTIONS}, x AS (SELECT *, CAST(prediction_id AS BIGINT) AS k FROM predictions), v AS (SELECT *, k % 5 <> 0 AND k % 7 <> 0 AS valid FROM x)
SELECT prediction_id, valid, round(CASE WHEN valid THEN probability ELSE market_price END + 1e-9, 4) AS probability, CASE WHEN valid THEN round(probability - market_price + 1e-9, 4) ELSE 0.0::DOUBLE END AS edge, CASE WHEN valid THEN confidence ELSE 'low' END AS confidence FROM v""")
def response_parse(spark: SparkSession, sf: str) -> DataFrame:
    k = c("prediction_id").cast("long")
    p = a.predictions(spark, sf)
    answer = F.to_json(F.struct(F.when(k % 5 == 0, F.lit("1.5")).otherwise(c("probability").cast("string")).alias("estimated_probability"), F.when(k % 7 == 0, "very_high").otherwise(c("confidence")).alias("confidence"), F.lit("because").alias("reasoning"), F.array(F.lit("x")).alias("key_evidence"), c("bayesian_prior")))
    fenced = F.when(k % 2 == 0, F.concat(F.lit("```json\n"), answer, F.lit("\n```"))).otherwise(answer)
    rows = p.select("prediction_id", "market_price", fenced.alias("response"))
    found = market.with_fallback(market.parsed_responses(rows))
    return found.select("prediction_id", "valid", r(c("probability"), 4).alias("probability"), "edge", "confidence")


# --- calendar and storage --------------------------------------------------------------------------------------------


@query(f"WITH {a.STATEMENTS} SELECT DISTINCT quarter, {rolled(DEADLINE)} AS deadline FROM (SELECT quarter, CAST(left(quarter, 4) AS INTEGER) AS y FROM statements)")
def filing_deadline(spark: SparkSession, sf: str) -> DataFrame:
    return a.statements(spark, sf).select("quarter").distinct().select("quarter", dates.filing_deadline(c("quarter")).alias("deadline"))


@query(f"""WITH {a.STATEMENTS}, q AS (SELECT DISTINCT quarter, make_date(CAST(left(quarter, 4) AS INTEGER), 3 * CAST(right(quarter, 1) AS INTEGER) - 2, 1) AS s FROM statements)
SELECT quarter, {rolled('s')} AS first_day, {rolled('last_day(CAST(s + INTERVAL 2 MONTH AS DATE))')} AS last_day, CAST(year(s + INTERVAL 3 MONTH) AS VARCHAR) || 'Q' || CAST(quarter(s + INTERVAL 3 MONTH) AS VARCHAR) AS next_quarter,
 CASE right(quarter, 1) WHEN '1' THEN quarter WHEN '4' THEN 'entire_' || left(quarter, 4) ELSE left(quarter, 4) || 'Q1-' || quarter END AS covers FROM q""")
def quarter_bounds(spark: SparkSession, sf: str) -> DataFrame:
    q = c("quarter")
    rows = a.statements(spark, sf).select(F.concat(F.left("quarter", F.lit(4)), F.lit("-"), F.right("quarter", F.lit(2))).alias("spelt")).distinct().select(dates.canonical_quarter(c("spelt")).alias("quarter"))
    return rows.select("quarter", dates.roll_weekend(dates.quarter_start(q)).alias("first_day"), dates.roll_weekend(dates.quarter_end(q)).alias("last_day"), dates.next_quarter(q).alias("next_quarter"), dates.cumulative_label(q).alias("covers"))


@query("SELECT DISTINCT date_trunc('month', o_orderdate)::DATE AS month, year(o_orderdate) - 1911 AS roc_year FROM orders")
def roc_date(spark: SparkSession, sf: str) -> DataFrame:
    d = c("o_orderdate")
    text = F.concat(F.lit("查詢月份： "), (F.year(d) - 1911).cast("string"), F.lit(" 年 "), F.lpad(F.month(d).cast("string"), 2, "0"), F.lit(" 月份"))
    rows = a.table(spark, sf, "orders").select(text.alias("t")).distinct()
    return rows.select(dates.roc_month(c("t")).alias("month"), dates.to_roc_year(dates.roc_month(c("t"))).cast("long").alias("roc_year"))


@query(f"""WITH {a.PRICES}, {a.UNIVERSE}, l AS (SELECT symbol, max(d) AS latest FROM prices WHERE CAST(symbol AS BIGINT) % 7 <> 0 GROUP BY symbol)
SELECT symbol, coalesce(latest + 1, DATE '2013-01-01') AS resume FROM universe LEFT JOIN l USING (symbol) WHERE coalesce(latest + 1, DATE '2013-01-01') < DATE '2001-11-03'""")
def resume_points(spark: SparkSession, sf: str) -> DataFrame:
    p = a.prices(spark, sf).where(c("symbol").cast("long") % 7 != 0)
    return storage.resume_points(p, a.universe(spark, sf), F.lit("2001-11-03").cast("date"))


@query(f"""WITH {a.STATEMENTS}, {a.UNIVERSE}, l AS (SELECT symbol, max(quarter) AS q FROM statements WHERE CAST(symbol AS BIGINT) % 7 <> 0 GROUP BY symbol)
SELECT symbol, CASE WHEN q IS NULL THEN '2013Q1' WHEN right(q, 1) = '4' THEN CAST(CAST(left(q, 4) AS INTEGER) + 1 AS VARCHAR) || 'Q1' ELSE left(q, 5) || CAST(CAST(right(q, 1) AS INTEGER) + 1 AS VARCHAR) END AS resume FROM universe LEFT JOIN l USING (symbol)""")
def resume_quarters(spark: SparkSession, sf: str) -> DataFrame:
    s = a.statements(spark, sf).where(c("symbol").cast("long") % 7 != 0)
    return storage.resume_quarters(s, a.universe(spark, sf))


@query(f"WITH {a.PRICES} SELECT symbol, min(d) AS oldest, max(d) AS latest, count(*) AS n FROM prices GROUP BY symbol")
def date_bounds(spark: SparkSession, sf: str) -> DataFrame:
    return storage.bounds(a.prices(spark, sf))


@query(f"WITH {a.PRICES} SELECT symbol, d, close FROM prices WHERE d >= DATE '1997-03-01' AND d < DATE '1997-06-01' AND isodow(d) < 6")
def month_scan(spark: SparkSession, sf: str) -> DataFrame:
    return storage.by_months(a.prices(spark, sf), "1997-03-01", "1997-06-01").where(F.weekday("d") < 5).select("symbol", "d", "close")


@query(f"WITH {a.PRICES} SELECT symbol, d, close FROM prices ORDER BY d DESC, symbol LIMIT 100")
def recent_rows(spark: SparkSession, sf: str) -> DataFrame:
    return storage.recent(a.prices(spark, sf).select("symbol", "d", "close"), 100, "d", "symbol")


@query(f"""WITH {a.PRICES}, old AS (SELECT symbol, d, close, volume FROM prices WHERE d < DATE '2001-06-01'), new AS (SELECT symbol, d, close * 2 AS close FROM prices WHERE d >= DATE '2001-01-01')
SELECT symbol, d, {rd('coalesce(new.close, old.close)', 4)} AS close, old.volume FROM old FULL JOIN new USING (symbol, d)""")
def upsert_merge(spark: SparkSession, sf: str) -> DataFrame:
    p = a.prices(spark, sf)
    new = p.where("d >= date'2001-01-01'").select("symbol", "d", (c("close") * 2).alias("close"))
    out = storage.merged(p.where("d < date'2001-06-01'"), new.unionAll(new), ["symbol", "d"])
    return out.select("symbol", "d", r(c("close"), 4).alias("close"), "volume")


@query(f"""WITH {a.TRADES} SELECT trade_id, CASE WHEN seq % 4 = 0 THEN 1.0::DOUBLE ELSE outcome END AS outcome, CASE WHEN seq % 4 = 0 THEN 'filled' ELSE status END AS status FROM trades""")
def resolve_trades(spark: SparkSession, sf: str) -> DataFrame:
    t = a.trades(spark, sf)
    return storage.resolve_trades(t, t.where("seq % 4 = 0").select("trade_id", F.lit(1.0).alias("outcome"))).select("trade_id", "outcome", "status")


# --- cleaning ------------------------------------------------------------------------------------------------------


@query(f"""WITH {a.STATEMENTS} SELECT symbol, quarter, CASE WHEN CAST(symbol AS BIGINT) % 3 = 0 THEN NULL ELSE revenue END AS revenue, -discounts AS discounts, DATE '{NOW}' AS d FROM statements WHERE CAST(symbol AS BIGINT) % 10 <> 0""")
def revenue_clean(spark: SparkSession, sf: str) -> DataFrame:
    s, k = a.statements(spark, sf), c("symbol").cast("long")
    money = lambda x: x.cast("decimal(20,2)").cast("string")
    raw = s.select(F.when(k % 10 == 0, clean.TOTAL_ROW).otherwise(c("symbol")).alias("symbol"), "quarter", F.when(k % 3 == 0, "不適用").otherwise(money(c("revenue"))).alias("revenue"), F.concat(F.lit("("), money(c("discounts")), F.lit(")")).alias("discounts"))
    return clean.revenue_clean(raw, ["revenue", "discounts"], F.lit(NOW).cast("date"))


@query(f"WITH {a.STATEMENTS} SELECT symbol, quarter, revenue, tax FROM statements")
def statement_pivot(spark: SparkSession, sf: str) -> DataFrame:
    long = clean.long_panel(a.statements(spark, sf), ["revenue", "discounts", "tax", "quantity"])
    return clean.statement_pivot(long, ["revenue", "tax"])


@query(f"WITH {a.STATEMENTS} SELECT symbol, quarter, CAST((tax <> 0)::INTEGER + 3 AS INTEGER) AS n_items, revenue FROM statements")
def statement_maps(spark: SparkSession, sf: str) -> DataFrame:
    long = clean.long_panel(a.statements(spark, sf), ["revenue", "discounts", "tax", "quantity"]).where("item <> 'tax' or value <> 0")
    return clean.statement_map(long).select("symbol", "quarter", F.size("items").alias("n_items"), c("items")["revenue"].alias("revenue"))


@query(f"""SELECT CAST(o_custkey AS VARCHAR) AS symbol, CAST(o_orderkey AS VARCHAR) AS bond_code, o_orderpriority[1:1] AS kind, DATE '{NOW}' AS d FROM orders""")
def debt_clean(spark: SparkSession, sf: str) -> DataFrame:
    cells = [c("o_custkey").cast("string"), F.left("o_orderpriority", F.lit(1)), F.lit("name"), c("o_orderkey").cast("string"), *[F.lit(str(i)) for i in range(10)]]
    line = F.concat_ws(" ", *cells)
    text = a.table(spark, sf, "orders").groupBy(F.floor(c("o_orderkey") / 200).alias("page")).agg(F.concat(F.lit("header line\n"), F.array_join(F.collect_list(line), "\n"), F.lit("\n共 9 筆")).alias("text"))
    return clean.bond_rows(text.unionAll(text), "text", F.lit(NOW).cast("date")).select("symbol", "bond_code", "kind", "d")


NEWS_RANK = "CASE source WHEN 'google' THEN 0 WHEN 'cnyes' THEN 1 WHEN 'yahoo' THEN 2 WHEN 'exchange' THEN 3 ELSE 4 END"


@query(f"WITH {a.NEWS} SELECT source, title, ord FROM (SELECT *, row_number() OVER (PARTITION BY title ORDER BY {NEWS_RANK}, ord) AS rn FROM news WHERE length(title) > 5) WHERE rn = 1")
def news_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return clean.first_by_title(a.news(spark, sf)).select("source", "title", "ord")


@query(f"WITH {a.NEWS} SELECT source, ord, CASE WHEN source = 'google' THEN url END AS url, CASE WHEN source <> 'google' THEN title END AS title FROM news")
def union_sources(spark: SparkSession, sf: str) -> DataFrame:
    n = a.news(spark, sf)
    return clean.union_sources(n.where("source = 'google'").select("source", "ord", "url"), n.where("source <> 'google'").select("source", "ord", "title"))


@query(f"""WITH {a.NEWS}, h AS (SELECT ord, url, regexp_replace(regexp_extract(url, '://([^/:]+)', 1), '^www\\.', '') AS host FROM news)
SELECT ord, url, host, CASE WHEN host IN ('rt.com') THEN 'state_media' WHEN host IN ('breitbart.com') THEN 'partisan' WHEN host IN ('wsj.com', 'ft.com') THEN 'paywall' END AS quality_flag FROM h""")
def source_quality(spark: SparkSession, sf: str) -> DataFrame:
    n = a.news(spark, sf).select("ord", f.absolute_url(F.replace("url", F.lit("http://"), F.lit("//")), "http:").alias("url")).withColumn("host", f.host(c("url")))
    return n.withColumn("quality_flag", f.source_quality(c("host")))


@query(f"""WITH {a.NEWS}, x AS (SELECT source, title, url, row_number() OVER (PARTITION BY source ORDER BY ord) AS rn FROM news)
SELECT source, string_agg(CAST(rn AS VARCHAR) || '. ' || title, chr(10) ORDER BY rn) AS block FROM x WHERE rn <= 5 GROUP BY source""")
def article_blocks(spark: SparkSession, sf: str) -> DataFrame:
    n = a.news(spark, sf).withColumn("quality_flag", F.lit(None).cast("string"))
    return clean.article_block(clean.capped_articles(n.unionAll(n), "source"), "source")


TAGGED = "['[標的]', '[請益]', '[心得]', '[新聞]', '[閒聊]', '']"


@query("SELECT ['target', 'question', 'review', 'news', 'chat', 'general'][doc_id % 6 + 1] AS post_type, count(*) AS n FROM (SELECT doc_id FROM documents ORDER BY doc_id DESC LIMIT 50) GROUP BY 1")
def post_type_counts(spark: SparkSession, sf: str) -> DataFrame:
    tags = F.array(*map(F.lit, (*f.POST_TAGS, "")))
    recent = storage.recent(a.table(spark, sf, "documents").select("doc_id", "lang"), 50, "doc_id")  # the 50 newest posts, as the rule is defined
    rows = recent.select(F.concat(F.get(tags, (c("doc_id") % 6).cast("int")), F.lit(" 2330 "), F.coalesce("lang", F.lit("x"))).alias("title"), F.lit("3").alias("push_count"))
    return clean.posts(rows).groupBy("post_type").agg(F.count("*").alias("n"))


@query("SELECT conv_id AS post_id, count(*) FILTER (WHERE role = 'user') AS push_up, count(*) FILTER (WHERE role = 'assistant') AS push_down, count(*) AS total_comments FROM conversations GROUP BY conv_id")
def reaction_counts(spark: SparkSession, sf: str) -> DataFrame:
    tag = F.when(c("role") == "user", "推 ").when(c("role") == "assistant", "噓 ").otherwise("→ ")
    return clean.reaction_counts(a.table(spark, sf, "conversations").select(c("conv_id").alias("post_id"), tag.alias("tag")))


@query()
def code_mentions(spark: SparkSession, sf: str) -> DataFrame:
    return a.table(spark, sf, "documents").select("doc_id", f.code_mentions(c("text")).alias("codes")).where(F.size("codes") > 0)


@query()
def page_links(spark: SparkSession, sf: str) -> DataFrame:
    return landed.page_links(a.table(spark, sf, "pages"), "page_id", "html")


@query("""SELECT o_orderpriority AS source, count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'F') AS done, count(*) FILTER (WHERE o_orderstatus = 'O') AS errors, count(*) FILTER (WHERE o_orderstatus = 'P') AS active,
 round(100.0 * count(*) FILTER (WHERE o_orderstatus = 'F') / count(*), 2) AS percent, CASE WHEN count(*) FILTER (WHERE o_orderstatus = 'P') > 0 THEN 'running' WHEN count(*) FILTER (WHERE o_orderstatus = 'O') > 0 THEN 'error' ELSE 'completed' END AS label FROM orders GROUP BY 1""")
def ingest_progress(spark: SparkSession, sf: str) -> DataFrame:
    status = F.when(c("o_orderstatus") == "F", "done").when(c("o_orderstatus") == "O", "error").otherwise("running")
    return clean.ingest_progress(a.table(spark, sf, "orders").select(c("o_orderpriority").alias("source"), status.alias("status")))
