"""Golden cases of risk, scores, markets, storage and cleaning."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from sextant.functions import scalars
from sextant.operators import clean, factors, market, risk, scoring
from sextant.sources import landed, storage

TRADE = "trade_id string, prediction_id string, book long, direction string, size double, limit_price double, status string, outcome double, timestamp timestamp_ntz"


def trades(spark, rows):
    return spark.createDataFrame([(f"t{i}", f"p{i}", 1, *r, None) for i, r in enumerate(rows)], TRADE)


def admitted(spark, sizes, cost=None):
    df = spark.createDataFrame([(1, i, s, cost or s) for i, s in enumerate(sizes)], "book long, seq long, size double, cost double")
    return [r["accepted"] for r in risk.admit(df).orderBy("seq").collect()]


def test_admission_is_no_prefix_sum(spark):
    assert admitted(spark, [1.0] * 11) == [True] * 10 + [False]
    assert admitted(spark, [1.0] * 9 + [1.01, 1.0, 0.5]) == [True] * 9 + [False, True, False]
    assert admitted(spark, [2.0, 0.5]) == [False, True]


def test_books_longer_than_a_batch_keep_their_state(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [(b, i, 1.0, 0.4) for b in (1, 2, None) for i in range(100)]
        found = risk.admit(spark.createDataFrame(rows, "book long, seq long, size double, cost double")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for b in (1, 2, None):
        assert [r["accepted"] for r in sorted((r for r in found if r["book"] == b), key=lambda r: r["seq"])] == [True] * 25 + [False] * 75
    assert risk.admit(spark.createDataFrame([], "book long, seq long, size double, cost double")).count() == 0


def test_desk_halts_until_the_next_day(spark):
    import datetime as dt

    one, two = dt.date(2024, 1, 1), dt.date(2024, 1, 2)
    rows = [(1, 1, one, 1.0, 0.9, -3.0), (1, 2, one, 1.0, 0.9, -1.0), (1, 3, one, 0.1, 0.1, None), (1, 4, two, 1.0, 0.7, None), (1, 5, two, None, 0.1, None), (1, 6, two, 1.0, 0.5, 0.5)]
    found = risk.trading_desk(spark.createDataFrame(rows, "book long, seq long, day date, size double, cost double, pnl double")).orderBy("seq").collect()
    assert [tuple(r)[6:] for r in found] == [(True, 0.0, -3.0, False), (True, 0.0, -4.0, True), (False, 0.0, -4.0, True), (True, 0.7, 0.0, False), (False, 0.7, 0.0, False), (True, 0.7, 0.5, False)]


@pytest.mark.parametrize(("row", "held"), [(("YES", 1.0, 0.6, "simulated", None), 0.6), (("NO", 1.0, 0.6, "simulated", None), 0.4), (("YES", 1.0, 0.6, "filled", 1.0), 0.0), (("YES", 1.0, 0.6, "cancelled", None), 0.0)])
def test_exposure(spark, row, held):
    assert scoring.exposure(trades(spark, [row])).first()["exposure"] == held


@pytest.mark.parametrize(("row", "pnl"), [(("YES", 1.0, 0.4, "filled", 1.0), 0.6), (("YES", 1.0, 0.4, "filled", 0.0), -0.4), (("NO", 1.0, 0.6, "filled", 1.0), 0.6), (("NO", 1.0, 0.6, "filled", 0.0), -0.4)])
def test_pnl(spark, row, pnl):
    df = trades(spark, [row]).withColumn("timestamp", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    assert scoring.daily_pnl(df).first()["pnl"] == pnl


def test_halt_is_sticky(spark):
    rows = [(1, "d", i, x) for i, x in enumerate([-0.9] * 5 + [3.0])] + [(2, "d", i, -0.5) for i in range(3)]
    found = risk.halts(spark.createDataFrame(rows, "book long, d string, seq long, pnl double")).orderBy("book", "seq").collect()
    assert [r["halted"] for r in found] == [False] * 4 + [True, True] + [False] * 3


@pytest.mark.parametrize(("rows", "score"), [([(1.0, 1.0, "YES")], 0.0), ([(1.0, 0.0, "YES")], 1.0), ([(0.5, 1.0, "YES")], 0.25), ([(0.9, 1.0, "YES"), (0.9, 0.0, "YES")], 0.41), ([(0.2, 1.0, "NO")], 0.04), ([], None)])
def test_brier(spark, rows, score):
    assert scoring.brier(spark.createDataFrame(rows, "probability double, outcome double, direction string")).first()["brier"] == score


def test_calibration_bucket(spark):
    rows = [(p, 1.0) for p in (0.75, 0.72, 0.78, 0.25, 0.22)]
    found = {r["label"]: r["n"] for r in scoring.calibration(spark.createDataFrame(rows, "probability double, outcome double")).collect()}
    assert found == {"70%-80%": 3, "20%-30%": 2}


GOOD = {"estimated_probability": 0.65, "confidence": "medium", "reasoning": "r", "key_evidence": ["a"], "risks": ["b"], "bayesian_prior": 0.5}


@pytest.mark.parametrize(
    ("text", "valid"),
    [(json.dumps(GOOD), True), (f"```json\n{json.dumps(GOOD)}\n```", True), (json.dumps(GOOD | {"estimated_probability": "0.65"}), True), (json.dumps(GOOD | {"estimated_probability": 1.5}), False), (json.dumps(GOOD | {"estimated_probability": -0.1}), False),
     (json.dumps(GOOD | {"confidence": "very_high"}), False), ("not json", False), (json.dumps({k: v for k, v in GOOD.items() if k != "bayesian_prior"}), False), (json.dumps(GOOD | {"bayesian_prior": 1.5}), False)],
)
def test_responses(spark, text, valid):
    row = market.with_fallback(market.parsed_responses(spark.createDataFrame([(text, 0.5)], "response string, market_price double"))).first()
    assert row["valid"] is valid
    assert row["probability"] == (0.65 if valid else 0.5)
    assert row["confidence"] == ("medium" if valid else "low")


def test_opportunities(spark):
    markets = spark.createDataFrame([("1", 0.3), ("2", 0.4), ("3", 0.5)], "market_id string, yes_price double")
    forecasts = spark.createDataFrame([("1", 0.8, "high", 5), ("2", 0.45, "high", 5), ("3", 0.9, "medium", 1)], "market_id string, probability double, confidence string, n_articles int")
    found = {r["market_id"]: r["low_evidence"] for r in market.opportunities(markets, forecasts).collect()}
    assert found == {"1": False, "3": True}


def test_markets_are_merged_with_forecasts(spark):
    markets = spark.range(3).selectExpr("cast(id as string) market_id", "0.3d yes_price")
    forecasts = spark.range(3).selectExpr("cast(id as string) market_id", "0.8d probability", "'high' confidence", "5 n_articles")
    plan = market.opportunities(markets, forecasts)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_a_price_that_is_its_mean_has_no_bias(spark):
    rng, rows = random.Random(7), []
    for s in range(40):
        middle, steps = rng.randrange(1_050_000, 1_090_000), [rng.randrange(1, 9_000) for _ in range(9)]
        units = [middle, *(middle + x for x in steps), *(middle - x for x in steps), middle]
        rows += [(str(s), dt.date(2020, 1, 1 + i), x / 10_000) for i, x in enumerate(units)]
    found = factors.bias_backtest(spark.createDataFrame(rows, "symbol string, d date, close double")).collect()
    assert [(r["bias"], r["signal"]) for r in found] == [(0.0, 0)] * 40


def test_markets_skip_malformed_rows(spark):
    one = {"tokens": [{"outcome": "No", "price": 0.4}, {"outcome": "yes", "price": "0.6"}], "tags": ["Crypto"], "volume_num_24hr": 2000, "end_date_iso": "2024-02-01T00:00:00Z", "condition_id": "m", "question": "q"}
    texts = [json.dumps([one]), json.dumps({"data": [one | {"condition_id": "n", "tags": ["x"], "category": "Tech"}]}), json.dumps([one | {"tokens": one["tokens"][:1]}, one | {"volume_num_24hr": "x"}, one | {"end_date_iso": "2024-01-02T00:00:00Z"}, one | {"tags": []}]), "broken", ""]
    raw = spark.createDataFrame([(t,) for t in texts], "value string")
    found = market.eligible(market.landed_markets(raw), F.lit("2024-01-01 00:00:00").cast("timestamp"))
    assert {(r["market_id"], r["yes_price"], r["category"]) for r in found.collect()} == {("m", 0.6, "crypto"), ("n", 0.6, "tech")}


def test_upsert_keeps_fields_that_are_not_supplied(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, x string, y int")
    new = spark.createDataFrame([(2, "c"), (2, "d"), (3, "e")], "k int, x string")
    found = {tuple(r) for r in storage.merged(old, new, ["k"]).collect()}
    assert found == {(1, "a", 1), (2, "d", 2), (3, "e", None)}


def test_news_keeps_the_first_source(spark):
    rows = [("yahoo", "long title", 1), ("google", "long title", 2), ("x", "tiny", 3), ("x", "other title", 4)]
    found = {(r["source"], r["title"]) for r in clean.first_by_title(spark.createDataFrame(rows, "source string, title string, ord long")).collect()}
    assert found == {("google", "long title"), ("x", "other title")}


def test_landed_html(spark):
    page = '<table><tr><th>a</th><th>b</th></tr><tr><td>1 &amp; 2</td><td><b>x</b></td></tr></table><a class="k" href="/p?a=1&amp;b=2">A <i>title</i></a>'
    df = spark.createDataFrame([(1, page), (2, None), (3, "")], "id int, html string")
    assert [r["cells"] for r in landed.html_tables(df, "id", "html").orderBy("row_no").collect()] == [["a", "b"], ["1 & 2", "x"]]
    assert [tuple(r) for r in landed.page_links(df, "id", "html").collect()] == [(1, 0, "A title", "/p?a=1&b=2")]


def test_search_results_have_one_schema(spark):
    a = json.dumps({"web": {"results": [{"title": "t", "url": "u", "description": "s", "age": "1 day"}]}})
    b = json.dumps({"news_results": [{"title": "v", "link": "w", "snippet": "x", "date": "2 days"}]})
    found = landed.search_results(spark.createDataFrame([(a,), (b,), ("x",)], "value string"))
    assert {tuple(r) for r in found.collect()} == {("t", "u", "s", "1 day"), ("v", "w", "x", "2 days")}


def test_bond_rows_drop_header_and_footer(spark):
    line = " ".join(str(i) for i in range(14))
    df = spark.createDataFrame([(f"head\n{line}\n{line}\n2 筆",)], "text string")
    found = clean.bond_rows(df, "text", F.lit("2024-01-01").cast("date")).collect()
    assert len(found) == 1 and found[0]["month_end_balance"] == "11"


def test_forum_pages(spark):
    entry = '<div class="r-ent"><div class="nrec"><span class="hl">9</span></div><div class="title"><a href="/p1">[標的] 2330</a></div><div class="meta"><div class="author">me</div><div class="date">1/02</div></div></div>'
    gone = '<div class="r-ent"><div class="title">(deleted)</div></div>'
    listing = landed.forum_listing(spark.createDataFrame([(1, entry + gone), (2, None)], "id int, html string"), "id", "html", "http://b")
    assert [tuple(r) for r in listing.collect()] == [(1, "[標的] 2330", "http://b/p1", "me", "1/02", "9")]
    assert clean.posts(listing).first()["post_type"] == "target"
    post = '<div id="main-content" class="x"><div class="article-metaline"><span>meta</span></div>body text\n※ 發信站 x<div class="push"><span class="hl push-tag">推 </span></div><div class="push"><span class="push-tag">噓 </span></div></div>'
    found = landed.forum_posts(spark.createDataFrame([(1, post), (2, "none")], "id int, html string"), "id", "html").collect()
    assert [tuple(r) for r in found] == [(1, "body text", 1, 1, 2)]


def test_scorer_and_helpers(spark):
    df = spark.createDataFrame([("q", 0.5)], "question string, market_price double")
    answers = market.scored(df, lambda rows: [json.dumps(GOOD) for _ in rows])
    assert market.parsed_responses(answers).first()["probability"] == 0.65
    assert landed.numeric_columns(df) == ["market_price"]
    a = spark.createDataFrame([("x",), ("x",), ("y",)], "symbol string")
    assert storage.without(a, a.where("symbol = 'y'")).count() == 2 and storage.only(a, a.where("symbol = 'y'")).count() == 1


def test_legacy_files(spark, tmp_path):
    (tmp_path / "t.html").write_bytes("<table><tr><td>合計</td></tr></table>".encode("big5"))
    rows = landed.html_tables(landed.binary_text(spark, str(tmp_path / "t.html")), "path", "text").collect()
    assert rows[0]["cells"] == ["合計"]


def test_rounding_is_half_up_by_magnitude(spark):
    df = spark.createDataFrame([(0.005,), (-0.005,), (-0.004,), (0.285,), (-1.005,)], "x double")
    assert [r[0] for r in df.select(scalars.cents(F.col("x"))).collect()] == [0.01, -0.01, 0.0, 0.29, -1.01]


def test_statement_items_that_repeat(spark):
    rows = [("a", "2020Q1", "x", 1.0), ("a", "2020Q1", "x", 2.0), ("a", "2020Q1", "y", None), ("a", "2020Q1", "z", 3.0)]
    df = spark.createDataFrame(rows, "symbol string, quarter string, item string, value double")
    assert clean.statement_map(df).first()["items"] == {"x": 2.0, "z": 3.0}
    assert clean.statement_pivot(df, ["x", "y"]).first()[2:] == (2.0, None)


def test_low_prices_have_an_upper_bound(spark):
    rows = [(s, "2020-01-01", v) for s, v in (("a", 14.0), ("b", 15.0), ("c", 15.5), ("d", 40.0), ("e", 50.0))]
    df = spark.createDataFrame(rows, "symbol string, d string, close double")
    assert {r["symbol"] for r in factors.low_price_screen(df, 0.7).collect()} == {"a", "b"}
