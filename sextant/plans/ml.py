"""Model-ready tables and a regression forest on period returns."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import panel
from ..functions import scalars as f

SPLIT = (70, 85)


def dataset(features: DataFrame, names: list[str], target: DataFrame) -> DataFrame:
    """Complete rows of (symbol, d, features, target): infinities are nulls, features meet the target by symbol and day."""
    clean = features.select("symbol", "d", *(f.finite(F.col(n).cast("double")).alias(n) for n in names))
    return clean.join(target, ["symbol", "d"]).na.drop("any")


def part(*keys: Column) -> Column:
    """train, valid or test, from a hash of the keys: the same rows each time."""
    n = F.conv(F.left(F.sha2(F.concat_ws("|", *(k.cast("string") for k in keys)), 256), F.lit(8)), 16, 10).cast("long") % 100
    return F.when(n < SPLIT[0], "train").when(n < SPLIT[1], "valid").otherwise("test")


def standardised(df: DataFrame, names: list[str]) -> DataFrame:
    """Features less the mean and over the population deviation of the training rows; 0 where there is no spread."""
    means = {n: F.avg(n).alias(f"_m_{n}") for n in names} | {f"{n} ": F.stddev_pop(n).alias(f"_s_{n}") for n in names}
    train = df.where("part = 'train'").agg(*means.values())
    z = {n: F.when(F.col(f"_s_{n}") > 0, (F.col(n) - F.col(f"_m_{n}")) / F.col(f"_s_{n}")).otherwise(0.0) for n in names}
    return df.join(F.broadcast(train)).withColumns(z).select(*df.columns)  # one row


def baseline(df: DataFrame, target: str) -> DataFrame:
    """Mean of the training target, and the squared error of predicting it, by part."""
    mean = df.where("part = 'train'").agg(F.avg(target).alias("mean"))
    return df.join(F.broadcast(mean)).groupBy("part").agg(F.first("mean").alias("mean"), F.avg(F.pow(F.col(target) - F.col("mean"), 2)).alias("mse"), F.count("*").alias("n"))


def forest(df: DataFrame, names: list[str], target: str, trees: int = 100, seed: int = 42) -> tuple[object, DataFrame]:
    """A regression forest fitted on the training rows, and all rows with its ``prediction``."""
    rows = VectorAssembler(inputCols=names, outputCol="features").transform(df)
    model = RandomForestRegressor(featuresCol="features", labelCol=target, numTrees=trees, seed=seed).fit(rows.where("part = 'train'"))
    return model, model.transform(rows)


def next_return(features: DataFrame, price: str = "close") -> DataFrame:
    """(symbol, d, target): percent change of the price to the next period, on the earlier day."""
    w = panel.series()
    return features.select("symbol", "d", (100 * (F.try_divide(F.lead(price).over(w), F.col(price)) - 1)).alias("target")).where("target is not null")
