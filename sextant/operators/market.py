"""Prediction markets: eligibility, response parsing, opportunities."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as f

#: Categories that are followed, and limits of the pipeline.
CATEGORIES = ("tech", "technology", "business", "ai", "artificial intelligence", "crypto")
MIN_VOLUME = 1000.0
MIN_DAYS = 3
MIN_EDGE = 0.15
CONFIDENT = ("medium", "high")
MIN_ARTICLES = 3
MARKET = (
    "struct<tokens: array<struct<outcome: string, price: string>>, tags: array<string>, volume_num_24hr: string, volume24hr: string, category: string, "
    "end_date_iso: string, end_date: string, question: string, condition_id: string, id: string>"
)
RESPONSE = "estimated_probability string, confidence string, reasoning string, key_evidence array<string>, risks array<string>, bayesian_prior string"


def landed_markets(raw: DataFrame, column: str = "value") -> DataFrame:
    """One row for each market in texts that hold a list, or an object with the list in ``data``; others give none."""
    text = F.trim(column)
    bare = F.when(text.startswith("["), F.from_json(text, f"array<{MARKET}>"))
    inside = F.when(text.startswith("{"), F.from_json(text, f"data array<{MARKET}>")["data"])
    return raw.select(F.explode(F.coalesce(bare, inside)).alias("m")).select("m.*")


def eligible(markets: DataFrame, now: Column, min_volume: float = MIN_VOLUME, min_days: int = MIN_DAYS) -> DataFrame:
    """Binary markets with enough volume, a followed category or tag, and enough days to go; malformed rows go."""
    yes = F.filter("tokens", lambda t: F.upper(t["outcome"]) == "YES")
    tags = F.transform("tags", F.lower)
    category = F.lower(F.coalesce("category", F.lit("")))
    found = markets.withColumns({
        "yes_price": F.get(yes, F.lit(0))["price"].try_cast("double"),
        "volume_24h": F.coalesce("volume_num_24hr", "volume24hr").try_cast("double"),
        "end_date": F.try_to_timestamp(F.coalesce("end_date_iso", "end_date")),
        "category": F.when(category != "", category).otherwise(F.coalesce(F.get(tags, F.lit(0)), F.lit("unknown"))),
        "market_id": F.coalesce("condition_id", "id"),
        "_fits": category.isin(*CATEGORIES) | F.coalesce(F.arrays_overlap(tags, F.array(*map(F.lit, CATEGORIES))), F.lit(False)),
    })
    keep = (F.size("tokens") == 2) & F.col("yes_price").between(0, 1) & (F.col("volume_24h") >= min_volume) & F.col("_fits")
    keep = keep & (F.col("end_date") >= now + F.make_interval(days=F.lit(min_days)))
    return found.where(keep).select("market_id", "question", F.round("yes_price", 2).alias("yes_price"), "volume_24h", "end_date", "category")


def parsed_responses(df: DataFrame, response: str = "response") -> DataFrame:
    """Model answers as columns, with ``valid``: fences stripped, numbers coerced, ranges and confidence checked."""
    bare = F.regexp_replace(F.regexp_replace(F.col(response), r"^```[^\n]*\n", ""), r"\n```\s*$", "")
    x = F.from_json(bare, RESPONSE)
    p, prior = x["estimated_probability"].try_cast("double"), x["bayesian_prior"].try_cast("double")
    valid = F.coalesce(p.between(0, 1) & prior.between(0, 1) & x["confidence"].isin("low", "medium", "high"), F.lit(False))
    return df.withColumns({"probability": p, "bayesian_prior": prior, "confidence": x["confidence"], "reasoning": x["reasoning"], "key_evidence": x["key_evidence"], "risks": x["risks"], "valid": valid})


def prompt(template: str, question: Column, price: Column, news: Column) -> Column:
    """``template`` with its {question}, {price} (in percent, one digit) and {news} filled in; without news it says so."""
    filled = F.lit(template)
    values = {"question": question, "price": F.format_string("%.1f", 100 * price), "news": F.coalesce(news, F.lit("No recent news articles found."))}
    marks = {n: f"\x00{n}\x00" for n in values}  # so that a value with a mark of another stays as it is
    for n, mark in marks.items():
        filled = F.replace(filled, F.lit(f"{{{n}}}"), F.lit(mark))
    pieces = F.split(filled, "\x00")
    return F.array_join(F.transform(pieces, lambda x: F.when(x == "question", values["question"]).when(x == "price", values["price"]).when(x == "news", values["news"]).otherwise(x)), "")


def with_fallback(df: DataFrame, price: str = "market_price") -> DataFrame:
    """Where an answer is not valid the market price stands in, with an edge of 0 and low confidence."""
    ok = F.col("valid")
    p = F.when(ok, F.col("probability")).otherwise(F.col(price))
    return df.withColumns({"probability": p, "edge": f.edge(p, F.col(price)), "confidence": F.when(ok, F.col("confidence")).otherwise("low")})


def opportunities(markets: DataFrame, predictions: DataFrame, min_edge: float = MIN_EDGE) -> DataFrame:
    """Markets whose confident forecast differs enough from the price, with side, size and limit price.

    Both sides grow with the input, so that they are merged: Spark takes texts of markets for few and would send them whole
    through the driver to every task."""
    return opportunities_of(markets.hint("merge").join(predictions, "market_id"), min_edge)


def opportunities_of(both: DataFrame, min_edge: float = MIN_EDGE) -> DataFrame:
    """``opportunities`` of forecasts that have the price of their market beside them."""
    p, price = F.col("probability"), F.col("yes_price")
    both = both.withColumns({"edge": f.edge(p, price), "direction": F.when(p > price, "YES").otherwise("NO"), "size": f.bet_size(p, price)})
    kept = both.where((F.abs("edge") >= min_edge) & F.col("confidence").isin(*CONFIDENT) & (F.col("size") > 0))
    return kept.withColumns({"limit_price": f.limit_price(price, F.col("direction")), "low_evidence": F.col("n_articles") < MIN_ARTICLES})


def scored(df: DataFrame, scorer: Callable[[list[dict]], list[str]]) -> DataFrame:
    """``df`` with ``response``, what ``scorer`` answers for each batch of rows; the place for a model of one's own."""
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scorer(b.to_pylist()), pa.string())], [*names, "response"])

    return df.mapInArrow(run, df.withColumn("response", F.lit("")).schema)
