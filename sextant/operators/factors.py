"""Factor scores, screens and portfolio returns over all symbols at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, panel
from ..functions import scalars as f

#: Weights of the value scores (for all symbols, for financial ones) and of the total; the fee of a trade.
VALUE = {"cash_flow_share": 0.4, "earnings_yield": 0.4, "shareholder_yield": 0.2}
VALUE_FINANCIAL = {"cash_flow_share": 0.3, "ebitda_ev": 0.3, "earnings_yield": 0.3, "shareholder_yield": 0.1}
QUALITY = ("roe", "variability", "cash_flow_assets", "gross_profit_assets", "leverage")
QUALITY_FINANCIAL = ("roe", "variability", "roa")
MOMENTUM = ("income_streak", "revenue_streak")
TOTAL = {"quality": 0.4, "value": 0.3, "momentum": 0.3}
FEE = 1.425 / 1000 * 0.3


def derived_ratios(df: DataFrame) -> DataFrame:
    """Market cap, enterprise value and the ratios that the scores use; division by 0 gives null.

    Shares are compared with those 12 rows before; more shares count as a higher yield, as the rule is defined.
    """
    c, w = F.col, panel.series()
    rows = df.withColumns({"cap": f.market_cap(c("shares"), c("close")), "growth": panel.pct_change(c("ebitda"))})
    return price_ratios(rows.withColumn("variability", -panel.rolling(F.stddev_samp, c("growth"), 20)), F.lag("shares", 12).over(w))


def price_ratios(rows: DataFrame, shares_before: Column) -> DataFrame:
    c = F.col
    return rows.withColumn("ev", f.enterprise_value(c("cap"), c("debt"), c("cash"))).withColumns({
        "ebitda_ev": F.try_divide(c("ebitda"), c("ev")), "earnings_yield": F.try_divide(c("eps"), c("close")), "cash_flow_share": F.try_divide(c("cash_flow"), c("shares")),
        "shareholder_yield": c("dividend_yield") + f.repurchase_rate(c("shares"), shares_before, c("close"), c("cap")),
        "roe": F.try_divide(c("net_income"), c("equity")), "roa": F.try_divide(c("net_income"), c("assets")),
        "cash_flow_assets": F.try_divide(c("cash_flow"), c("assets")), "gross_profit_assets": F.try_divide(c("gross_profit"), c("assets")), "leverage": F.try_divide(c("debt"), c("equity")),
    })


def _total(rows: DataFrame) -> DataFrame:
    """``rows`` with ``score``: blended z-scores of quality, value and momentum by period, as a weight."""
    names = dict.fromkeys([*VALUE, *VALUE_FINANCIAL, *QUALITY, *QUALITY_FINANCIAL, *MOMENTUM])
    z = panel.zscores(rows, list(names))
    weighted = lambda weights: f.blend(*((w, F.col(f"z_{n}")) for n, w in weights.items()))
    mean = lambda names: weighted(dict.fromkeys(names, 1 / len(names)))
    financial = F.col("category") == "financial"
    z = z.withColumns({"value": F.when(financial, weighted(VALUE_FINANCIAL)).otherwise(weighted(VALUE)), "quality": F.when(financial, mean(QUALITY_FINANCIAL)).otherwise(mean(QUALITY)), "momentum": weighted(dict.fromkeys(MOMENTUM, 1.0))})
    total = f.blend(*((w, F.col(n)) for n, w in TOTAL.items()))
    return z.withColumn("score", F.round(f.z_weight(total), 6))


def _with_streaks(rows: DataFrame) -> DataFrame:
    for value, out in zip(("net_income", "revenue"), MOMENTUM, strict=True):
        rows = panel.rising_streak(rows, value, 5, 3, 1.0, out)
    return rows


def _listed(df: DataFrame, universe: DataFrame) -> DataFrame:
    """``df`` with the category of its symbols, without ETFs."""
    return df.join(universe.where("category <> 'etf'").select("symbol", "category"), "symbol")


def multi_factor_rating(df: DataFrame, universe: DataFrame, quantile: float = 0.75, accuracy: int | None = None) -> DataFrame:
    """Blended z-scores of quality, value and momentum by period, as weights, and whether they exceed the quantile.

    Financial symbols have a value score with the earnings of the enterprise and the mean of three quality scores in
    place of five; momentum is the sum of the z-scores of two streaks. Any null makes the score null; ETFs go. With
    ``accuracy`` the quantile is that of a sketch.
    """
    scored = _total(_with_streaks(derived_ratios(_listed(df, universe))))
    cut = panel.period_quantile(scored, "score", quantile, accuracy=accuracy).select("d", F.round("cut", 6).alias("cut"))
    return scored.join(cut, "d").withColumn("selected", F.coalesce(F.col("score") > F.col("cut"), F.lit(False)))


def daily_rating(statements: DataFrame, prices: DataFrame, universe: DataFrame) -> DataFrame:
    """``multi_factor_rating`` on every day that has a price: what goes by quarters (growth, streaks, shares before) is made
    of the quarters; then each day takes the last statement published by it, and its own price."""
    c, w = F.col, panel.series()
    rows = _with_streaks(statements.withColumns({"growth": panel.pct_change(c("ebitda")), "shares_before": F.lag("shares", 12).over(w)}))
    rows = rows.withColumns({"variability": -panel.rolling(F.stddev_samp, c("growth"), 20), "published": dates.filing_deadline(c("quarter"))})
    values = [x for x in rows.columns if x not in ("symbol", "d", "close", "published")]
    day = panel.asof(prices.select("symbol", "d", "close"), rows, values, published="published").where("quarter is not null")
    return _total(price_ratios(_listed(day, universe).withColumn("cap", f.market_cap(c("shares"), c("close"))), c("shares_before")))


def low_price_screen(prices: DataFrame, quantile: float = 0.15, most: float = 15.0, days: int = 60, accuracy: int | None = None) -> DataFrame:
    """Rows whose price is below the day's quantile and ``most`` at most, with their range tightness; with ``accuracy`` the
    quantile is that of a sketch."""
    rows = prices.withColumn("tightness", panel.range_tightness(F.col("close"), days)).join(panel.period_quantile(prices, "close", quantile, accuracy=accuracy), "d")
    return rows.where((F.col("close") < F.col("cut")) & (F.col("close") <= most))


def bias_backtest(prices: DataFrame, n: int = 20, digits: int = 4) -> DataFrame:
    """Signals from the bias ratio against its mean highs and lows, held from the next day, compounded.

    The means are those of the symbol's whole history, as the rule is defined; a sale overrides a purchase. Prices count
    in whole units of their last digit, whose sums are exact: a price that equals its mean has a bias of just 0.
    """
    c = F.col
    units = F.round(c("close") * 10**digits).try_cast("long")
    total = panel.rolling(F.sum, units, n)
    b = prices.withColumn("bias", F.try_divide((n * units - total).cast("double"), total.cast("double"))).where("bias is not null")
    by = Window.partitionBy("symbol")
    b = b.withColumns({"pos_mean": F.avg(F.when(c("bias") > 0, c("bias"))).over(by), "neg_mean": F.avg(F.when(c("bias") < 0, c("bias"))).over(by)})
    signal = F.when(c("bias") < c("pos_mean"), -1).when(c("bias") > c("neg_mean"), 1).otherwise(0)
    return signal_backtest(b.withColumn("signal", signal))


def signal_backtest(rows: DataFrame) -> DataFrame:
    """Market and strategy return of the position that yesterday's ``signal`` gives, both compounded."""
    s = rows.withColumns({"ret": panel.pct_change(F.col("close")), "position": F.lag("signal").over(panel.series())})
    s = s.withColumn("strategy_ret", F.col("ret") * F.col("position"))
    return s.withColumns({"market_growth": panel.compounded(F.col("ret")), "strategy_growth": panel.compounded(F.col("strategy_ret"))})


def top_k_backtest(features: DataFrame, prices: DataFrame, k: int = 5, capital: float = 10_000.0, weighting: str = "full") -> DataFrame:
    """Capital from holding the previous quarter's top ``k`` to the end of each quarter; the first is flat.

    ``features``: (symbol, quarter, value), complete symbols only. With 'full' each name is sized with the whole
    capital, as the rule is defined; 'equal' splits it. Prices are filled forward to the quarters' rolled ends.
    """
    c = F.col
    quarters = features.select("quarter").distinct()
    ends = quarters.select("quarter", dates.roll_weekend(dates.quarter_end(c("quarter"))).alias("d"), dates.next_quarter(c("quarter")).alias("exit_quarter"))
    complete = features.withColumn("_have", F.count("value").over(Window.partitionBy("symbol"))).join(F.broadcast(quarters.agg(F.count("*").alias("_all")))).where("_have = _all")  # one row
    picks = panel.top_k(complete, "quarter", "value", k)
    known = F.broadcast(ends.select("quarter", "d", "exit_quarter").join(ends.select(c("quarter").alias("exit_quarter"), c("d").alias("exit_d")), "exit_quarter"))  # as many quarters as the calendar has
    trades = picks.select("symbol", "quarter").join(known, "quarter").select("symbol", "exit_quarter", F.explode(F.array(F.struct("d", F.lit(0).alias("leaves")), F.struct(c("exit_d").alias("d"), F.lit(1).alias("leaves")))).alias("x"))
    at = panel.asof(trades.select("symbol", "exit_quarter", "x.d", "x.leaves"), prices, ["close"])
    held = at.groupBy("symbol", "exit_quarter").agg(*(F.max(F.when(c("leaves") == i, c("close"))).alias(n) for i, n in enumerate(("entry", "exit"))))
    gain = F.sum(F.try_divide("exit", "entry") - 1) / (1 if weighting == "full" else k)
    roi = quarters.select(c("quarter").alias("exit_quarter")).join(held.where("entry is not null and exit is not null").groupBy("exit_quarter").agg(gain.alias("gain")), "exit_quarter", "left")
    so_far = Window.orderBy("exit_quarter").rowsBetween(Window.unboundedPreceding, 0)  # a row for each quarter
    return roi.select(c("exit_quarter").alias("quarter"), (100 * F.coalesce("gain", F.lit(0.0))).alias("roi"), (capital * F.product(1 + F.coalesce("gain", F.lit(0.0))).over(so_far)).alias("capital"))


def rebalance_returns(selected: DataFrame, prices: DataFrame, most: float = 0.2, fee: float = FEE) -> DataFrame:
    """Monthly return of the symbols selected on the last day of each month: equal weights of ``most`` at most, in at
    the first price of the next month, out at that of the month after, a fee on both trades.

    ``selected``: (symbol, d) ; ``prices``: (symbol, d, close).
    """
    month = F.trunc("d", "MM")
    last = Window.partitionBy("m")
    picks = selected.withColumn("m", month).withColumn("_last", F.max("d").over(last)).where("d = _last").select("symbol", "m")
    picks = picks.withColumn("weight", F.least(F.lit(most), 1 / F.count("*").over(last)))
    first = prices.withColumn("m", month).groupBy("symbol", "m").agg(F.min_by("close", "d").alias("price"))
    enter = first.select("symbol", F.add_months("m", -1).cast("date").alias("m"), F.col("price").alias("entry"))
    leave = first.select("symbol", F.add_months("m", -2).cast("date").alias("m"), F.col("price").alias("exit"))
    held = picks.join(enter, ["symbol", "m"]).join(leave, ["symbol", "m"])
    gain = F.sum(F.col("weight") * (F.try_divide(F.col("exit") * (1 - fee), F.col("entry") * (1 + fee)) - 1))
    return held.groupBy(F.add_months("m", 1).alias("month")).agg(gain.alias("ret"), F.count("*").alias("n"))
