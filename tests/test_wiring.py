"""Features, prompts, places and selections."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from sextant.operators import clean, factors, fundamentals, market
from sextant.plans import ml
from sextant.sources import storage


def test_there_are_47_features(spark):
    assert len(fundamentals.FEATURES) == len(set(fundamentals.FEATURES)) == 47
    rows = [("a", f"2020Q{q}", dt.date(2020, 3 * q, 1), *(float(i + q) for i in range(len(fundamentals.ITEMS)))) for q in (1, 2)]
    rows.append(("z", "2020Q1", dt.date(2020, 3, 1), *[0.0] * len(fundamentals.ITEMS)))
    found = {(r["symbol"], r["quarter"]): r for r in fundamentals.features(spark.createDataFrame(rows, "symbol string, quarter string, d date, " + ", ".join(f"{x} double" for x in fundamentals.ITEMS))).collect()}
    items = dict(zip(fundamentals.ITEMS, rows[1][3:], strict=True))
    two = found["a", "2020Q2"]
    assert two["gross_margin"] == pytest.approx(100 * items["gross_profit"] / items["revenue"]) and two["eps"] == pytest.approx(items["net_income"] / items["shares"])
    assert two["revenue_growth"] == pytest.approx(100.0) and found["a", "2020Q1"]["revenue_growth"] is None
    assert found["z", "2020Q1"]["roe"] is None and found["z", "2020Q1"]["working_capital"] == 0


def test_prompts_take_values_as_they_are(spark):
    df = spark.createDataFrame([("Will {news} \\1 $x?", 0.505, "a {question}"), ("q", 0.5, None)], "q string, p double, n string")
    found = [r[0] for r in df.select(market.prompt("{question} at {price}%:\n{news}", F.col("q"), F.col("p"), F.col("n"))).collect()]
    assert found == ["Will {news} \\1 $x? at 50.5%:\na {question}", "q at 50.0%:\nNo recent news articles found."]


def test_article_blocks(spark):
    rows = [("q", 2, "t2", "s", dt.date(2024, 1, 2), None, "u2", None), ("q", 1, None, "s", None, "sum", "u1", "paywall")]
    df = spark.createDataFrame(rows, "id string, rn int, title string, source string, published date, summary string, url string, quality_flag string")
    assert clean.article_blocks(df, "id").first()["block"] == "Article 1 [⚠️ paywall]:\n  Title: \n  Source: s ()\n  Summary: sum\n  URL: u1\n\nArticle 2:\n  Title: t2\n  Source: s (2024-01-02)\n  Summary: \n  URL: u2"


def test_places_over_years(spark):
    rows = [(i, dt.date(1999 + i % 4, 1 + i % 12, 1 + i % 28)) for i in range(300)]
    found = {r["id"]: r["place"] for r in storage.placed(spark.createDataFrame(rows, "id int, d date"), "d", "id").collect()}
    assert [found[i] for i, _ in sorted(rows, key=lambda x: (-x[1].toordinal(), x[0]))] == list(range(1, 301))


def test_standardised_by_the_training_rows(spark):
    df = spark.createDataFrame([("train", 1.0, 5.0), ("train", 3.0, 5.0), ("test", 5.0, 9.0)], "part string, a double, b double")
    assert sorted(tuple(r) for r in ml.standardised(df, ["a", "b"]).collect()) == [("test", 3.0, 0.0), ("train", -1.0, 0.0), ("train", 1.0, 0.0)]


def test_capital_of_the_quarters_top_names(spark):
    features = spark.createDataFrame([(s, q, v) for q in ("2020Q1", "2020Q2", "2020Q3") for s, v in (("a", 3.0), ("b", 2.0), ("c", 1.0))] + [("d", "2020Q1", 9.0)], "symbol string, quarter string, value double")
    price = {("a", 3): 10.0, ("a", 6): 11.0, ("a", 9): 11.0, ("b", 3): 10.0, ("b", 6): 9.0, ("b", 9): 18.0}
    prices = spark.createDataFrame([(s, dt.date(2020, m, 20), v) for (s, m), v in price.items()], "symbol string, d date, close double")
    found = {r["quarter"]: (round(r["roi"], 6), round(r["capital"], 6)) for r in factors.top_k_backtest(features, prices, k=2).collect()}
    assert found == {"2020Q1": (0.0, 10000.0), "2020Q2": (0.0, 10000.0), "2020Q3": (100.0, 20000.0)}
    plan = factors.top_k_backtest(features, prices, k=2)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
