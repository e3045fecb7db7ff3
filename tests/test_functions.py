"""Golden values of the column functions."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from sextant.functions import dates, panel
from sextant.functions import scalars as f
from sextant.operators import factors


def one(spark, column, **values):
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, F.lit(v))
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("p", "odds", "share"), [(0.7, 1, 0.4), (0.5, 1, 0), (0.3, 1, 0), (0.6, 3, 0.467), (0.0, 1, 0), (0.5, 0, 0), (1.0, 1, 0)])
def test_kelly(spark, p, odds, share):
    assert one(spark, f.kelly(F.col("p"), F.col("o")), p=p, o=float(odds)) == pytest.approx(share, abs=0.01)


def test_edge_size_and_price(spark):
    assert one(spark, f.edge(F.col("p"), F.col("m")), p=0.7, m=0.5) == 0.2
    assert one(spark, f.edge(F.col("p"), F.col("m")), p=0.3, m=0.5) == -0.2
    for m in (0.0, 1.0):
        assert one(spark, f.bet_size(F.col("p"), F.col("m")), p=0.7, m=m) == 0
    assert one(spark, f.bet_size(F.col("p"), F.col("m")), p=0.99, m=0.01) <= 1
    assert one(spark, f.limit_price(F.col("m"), F.lit("YES")), m=0.50) == 0.51
    assert one(spark, f.limit_price(F.col("m"), F.lit("YES")), m=0.99) == 0.99


def test_text_functions(spark):
    assert one(spark, f.number(F.col("t")), t="(1,234.5)") == -1234.5
    assert one(spark, f.number(F.col("t")), t="n/a") is None
    assert one(spark, f.sentinel_null(F.col("t")), t="不適用") is None
    assert one(spark, f.post_type(F.col("t")), t="[標的] 2330") == "target"
    assert one(spark, f.post_type(F.col("t")), t="x") == "general"
    assert one(spark, f.code_mentions(F.col("t")), t="台積電2330 2317 12345 (2454)") == ["2317", "2454"]
    assert one(spark, f.host(F.col("t")), t="http://www.rt.com/x") == "rt.com"
    assert one(spark, f.post_body(F.col("t")), t=" body ※ 發信站 x") == "body"
    assert one(spark, f.ideographic(F.col("t")), t="2013年第1季") == "2013Q1"
    assert one(spark, f.z_weight(F.col("z")), z=-1.0) == 0.5
    assert one(spark, f.finite(F.col("z")), z=float("inf")) is None


def test_dates(spark):
    q = F.col("q")
    assert one(spark, dates.filing_deadline(q), q="2021Q1") == dt.date(2021, 5, 17)  # the 15th was a Saturday
    assert one(spark, dates.filing_deadline(q), q="2020-Q4") == dt.date(2021, 3, 31)
    assert one(spark, dates.quarter_end(q), q="2020Q1") == dt.date(2020, 3, 31)
    assert one(spark, dates.quarter_end(q), q="nonsense") is None
    assert one(spark, dates.next_quarter(q), q="2020Q4") == "2021Q1"
    assert one(spark, dates.roc_month(q), q="查詢月份： 112 年 02 月份") == dt.date(2023, 2, 1)
    assert one(spark, dates.cumulative_label(q), q="2013Q3") == "2013Q1-2013Q3"
    now = F.lit("2024-01-10 12:00:00").cast("timestamp")
    assert one(spark, dates.relative_time(q, now), q="3 hours ago") == dt.datetime(2024, 1, 10, 9)
    assert one(spark, dates.relative_time(q, now), q="2024-01-02") == dt.datetime(2024, 1, 2)
    assert one(spark, dates.relative_time(q, now), q="soon") == dt.datetime(2024, 1, 10, 12)
    assert one(spark, dates.month_ends(F.lit("2024-01-15").cast("date"), F.lit("2024-03-01").cast("date"))) == [dt.date(2024, 2, 29), dt.date(2024, 3, 31)]


def series(spark, values, symbol="a"):
    day = dt.date(2020, 1, 1)
    return spark.createDataFrame([(symbol, day + dt.timedelta(i), v) for i, v in enumerate(values)], "symbol string, d date, close double")


def column(df, name):
    return [r[name] for r in df.orderBy("symbol", "d").collect()]


def test_rolling_guards_nulls(spark):
    df = series(spark, [1.0, 2.0, None, 4.0, 6.0])
    assert column(df.withColumn("m", panel.rolling(F.avg, F.col("close"), 2)), "m") == [None, 1.5, None, None, 5.0]


def test_pct_change_holds_values(spark):
    df = series(spark, [1.0, None, 2.0])
    assert column(df.withColumn("r", panel.pct_change(F.col("close"))), "r") == [None, 0.0, 1.0]


def test_record_breaker_matches_the_rule(spark):
    rng = random.Random(3)
    values = [float(rng.randint(0, 8)) for _ in range(60)]
    expected = []
    for i, v in enumerate(values):
        up = next((n for n in range(1, i + 1) if values[i - n] > v), i + 1)
        down = next((n for n in range(1, i + 1) if values[i - n] < v), i + 1)
        expected.append(0 if i == 0 else up if up >= down else -down)
    assert column(panel.record_breaker(series(spark, values), "close"), "record") == expected


def test_rising_streak_matches_the_rule(spark):
    rng = random.Random(4)
    values = [float(rng.randint(0, 5)) for _ in range(40)]
    ma = [sum(values[i - 1 : i + 1]) / 2 if i else None for i in range(len(values))]
    rises = [i > 0 and ma[i - 1] is not None and ma[i] > ma[i - 1] for i in range(len(values))]
    expected = [1.0 if i >= 3 and all(rises[i - 2 : i + 1]) else 0.0 for i in range(len(values))]
    assert column(panel.rising_streak(series(spark, values), "close", 2, 3), "streak") == expected


def test_asof_and_densify(spark):
    left = series(spark, [1.0] * 5).select("symbol", "d")
    right = spark.createDataFrame([("a", dt.date(2020, 1, 2), "x"), ("a", dt.date(2020, 1, 4), None)], "symbol string, d date, v string")
    assert column(panel.asof(left, right, ["v"]), "v") == [None, "x", "x", None, None]
    gaps = series(spark, [1.0, None, None, 4.0]).where("close is not null")
    assert column(panel.densify(gaps, ["close"]), "close") == [1.0, 1.0, 1.0, 4.0]


def test_top_k_breaks_ties_by_symbol(spark):
    df = spark.createDataFrame([("q", s, 1.0) for s in "dcba"], "quarter string, symbol string, value double")
    assert sorted(r["symbol"] for r in panel.top_k(df, "quarter", "value", 2).collect()) == ["a", "b"]


def test_zscore_drops_outliers_and_flat_periods(spark):
    rows = [(str(i), dt.date(2020, 1, 1), 0.0) for i in range(30)] + [("x", dt.date(2020, 1, 1), 100.0)]
    df = spark.createDataFrame(rows, "symbol string, d date, close double").withColumn("z", panel.zscore(F.col("close")))
    assert df.where("symbol = 'x'").first()["z"] is None
    flat = series(spark, [1.0]).withColumn("z", panel.zscore(F.col("close")))
    assert flat.first()["z"] is None


def test_backtest_holds_from_the_next_day(spark):
    df = series(spark, [1.0, 2.0, 1.0]).withColumn("signal", F.lit(1))
    assert column(factors.signal_backtest(df), "strategy_growth") == [None, 2.0, 1.0]


@pytest.mark.parametrize(("text", "want"), [("January 5, 2024", (2024, 1, 5)), ("Sep 9, 2023", (2023, 9, 9)), ("2023-09-08", (2023, 9, 8)), ("2023-09-08T01:02:03", (2023, 9, 8, 1, 2, 3)), ("2 days, 10:30 left", (2024, 1, 8, 12)), ("12 hours ago", (2024, 1, 10)), ("hours ago", (2024, 1, 10, 12)), ("", (2024, 1, 10, 12)), (None, (2024, 1, 10, 12))])
def test_relative_and_absolute_times(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(dates.relative_time(F.col("t"), F.lit("2024-01-10 12:00:00").cast("timestamp")).alias("x")).first()["x"] == dt.datetime(*want)


def test_asof_dates_reach_back_any_time(spark):
    days = [dt.date(2000, 1, 3), dt.date(2000, 1, 1), dt.date(1800, 6, 1), dt.date(2003, 1, 1), None]
    probes = [dt.date(2002, 12, 31), dt.date(2000, 1, 3), dt.date(2000, 1, 2), dt.date(1999, 12, 31), dt.date(1800, 5, 31), dt.date(9999, 12, 31), None]
    panel_ = spark.createDataFrame([(d,) for d in days], "d date")
    found = dict(panel.asof_dates(panel_, spark.createDataFrame([(p,) for p in probes * 2], "probe date")).collect())
    known = sorted(d for d in days if d)
    assert found == {p: max((d for d in known if d <= p), default=None) for p in probes if p}
    rng = random.Random(1)
    many = [dt.date(1990, 1, 1) + dt.timedelta(rng.randrange(20_000)) for _ in range(60)]
    asked = [dt.date(1989, 1, 1) + dt.timedelta(rng.randrange(21_000)) for _ in range(300)]
    found = dict(panel.asof_dates(spark.createDataFrame([(d,) for d in many], "d date"), spark.createDataFrame([(p,) for p in asked], "probe date")).collect())
    assert found == {p: max((d for d in many if d <= p), default=None) for p in asked}
    assert panel.asof_dates(panel_.where("false"), panel_.select(F.col("d").alias("probe"))).where("d is not null").count() == 0


def test_period_quantiles_exact_and_sketched(spark):
    rng = random.Random(2)
    rows = [(k, rng.random() if i % 7 else None) for k in "ab" for i in range(2000)]
    df = spark.createDataFrame(rows, "d string, v double")
    exact, sketch = (dict(panel.period_quantile(df, "v", 0.15, accuracy=x).collect()) for x in (None, 100))
    for k in "ab":
        values = sorted(v for d, v in rows if d == k and v is not None)
        at = 0.15 * (len(values) - 1)
        low = int(at)
        assert exact[k] == pytest.approx(values[low] + (at - low) * (values[low + 1] - values[low]))
        assert abs(sum(v <= sketch[k] for v in values) / len(values) - 0.15) <= 1 / 100 + 1e-3


def test_a_deadline_parses_its_quarter_once(spark):
    df = spark.createDataFrame([("2013Q4",), ("2013-Q1",), ("2013Q5",), (None,)], "q string").select(dates.filing_deadline(F.col("q")).alias("d"))
    assert [str(r["d"]) for r in df.collect()] == ["2014-03-31", "2013-05-15", "None", "None"]
    assert df._jdf.queryExecution().analyzed().toString().count("regexp_extract") <= 3


def test_zscores_of_periods_without_windows(spark):
    rng = random.Random(3)
    rows = [(dt.date(2020, 1, 1 + i % 5) if i % 7 else None, rng.choice([None, 1.5, 2.5, 9.0]), 0.1) for i in range(300)]
    df = spark.createDataFrame(rows, "d date, a double, same double").repartition(7)
    found = panel.zscores(df, ["a", "same"])
    want = found.withColumn("w", panel.zscore(F.col("a"))).collect()
    assert len(want) == 300 and all((r["w"] is None) == (r["z_a"] is None) and (r["w"] is None or abs(r["w"] - r["z_a"]) < 1e-9) and r["z_same"] is None for r in want)
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString()


def test_the_days_of_a_rating_are_not_sorted(spark):
    from sextant.plans import wiring

    plan = wiring.QUERIES["daily_factor_rating"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "windowspecdefinition(d#" not in plan
