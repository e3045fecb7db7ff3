"""Scores of resolved forecasts: Brier, calibration, profit and loss, exposure."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as f


def resolved(trades: DataFrame, predictions: DataFrame) -> DataFrame:
    return trades.join(predictions, "prediction_id").where(F.col("outcome").isNotNull())


def brier(rows: DataFrame) -> DataFrame:
    """Mean squared difference of forecast and outcome; the forecast of a NO trade is 1 - p. Null without rows."""
    p = F.when(F.col("direction") == "NO", 1 - F.col("probability")).otherwise(F.col("probability"))
    return rows.agg(f.cents(F.avg(F.pow(p - F.col("outcome"), 2)), 4).alias("brier"))


def calibration(rows: DataFrame, width: float = 0.1) -> DataFrame:
    """Forecasts by bucket: how many, and how often they came true."""
    index = f.bucket_index(F.col("probability"), width)
    found = rows.groupBy(index.alias("bucket")).agg(F.count("*").alias("n"), f.cents(F.avg("outcome"), 3).alias("actual"))
    return found.withColumn("label", f.bucket_label(F.col("bucket"), width))


def daily_pnl(trades: DataFrame) -> DataFrame:
    pnl = f.payoff(F.col("size"), F.col("limit_price"), F.col("direction"), F.col("outcome"))
    return trades.where("outcome is not null").groupBy(F.to_date("timestamp").alias("d")).agg(f.cents(F.sum(pnl)).alias("pnl"), F.count("*").alias("n"))


def exposure(trades: DataFrame) -> DataFrame:
    cost = f.trade_cost(F.col("size"), F.col("limit_price"), F.col("direction"))
    return trades.groupBy("book").agg(f.cents(F.sum(F.when(f.open_trade(F.col("status"), F.col("outcome")), cost).otherwise(0.0))).alias("exposure"))


def report(trades: DataFrame, predictions: DataFrame) -> DataFrame:
    """One row: predictions, trades, open and resolved trades, Brier score, profit and loss, and the calibration: each
    bucket's label, forecasts and share that came true, in the order of the buckets."""
    pnl = f.payoff(F.col("size"), F.col("limit_price"), F.col("direction"), F.col("outcome"))
    p = F.when(F.col("direction") == "NO", 1 - F.col("probability")).otherwise(F.col("probability"))
    joined = trades.join(predictions, "prediction_id", "full_outer")
    line = F.concat_ws(" ", "label", F.col("n").cast("string"), F.col("actual").cast("string"))
    rows = calibration(resolved(trades, predictions)).agg(F.array_sort(F.collect_list(F.struct("bucket", line.alias("line")))).alias("x"))  # one row for each bucket
    buckets = rows.select(F.array_join("x.line", "; ").alias("calibration"))
    one = joined.agg(
        F.count_distinct("prediction_id").alias("n_predictions"), F.count("trade_id").alias("n_trades"),
        F.count_if(F.col("trade_id").isNotNull() & f.open_trade(F.col("status"), F.col("outcome"))).alias("n_open"), F.count("outcome").alias("n_resolved"),
        f.cents(F.avg(F.when(F.col("outcome").isNotNull(), F.pow(p - F.col("outcome"), 2))), 4).alias("brier"), f.cents(F.sum(pnl)).alias("pnl"),
    )
    return one.join(F.broadcast(buckets))  # one row each


def valid_predictions(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that keep the ranges and enumerations of a prediction, and the rest."""
    ok = F.col("probability").between(0, 1) & F.col("market_price").between(0, 1) & F.col("confidence").rlike("^(low|medium|high)$") & F.col("bayesian_prior").between(0, 1)
    marked = df.withColumn("_ok", F.coalesce(ok, F.lit(False)))
    return marked.where("_ok").drop("_ok"), marked.where("not _ok").drop("_ok")
