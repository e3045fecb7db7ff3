"""Cleaning of landed tables: revenues, statements, bonds, news, forum posts, run logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, panel
from ..functions import scalars as f
from ..sources import landed

#: The total row of revenue tables, the bond columns in order, the order of news sources.
TOTAL_ROW = "合計"
NO_DATA = "查無資料"
REVENUE_HEADERS = {"公司代號": "symbol", "當月營收": "revenue", "上月營收": "revenue_before", "去年當月營收": "revenue_year_ago", "上月比較增減(%)": "change", "去年同月增減(%)": "change_year", "去年累計營收": "ytd_year_ago", "前期比較增減(%)": "ytd_change"}
REVENUE_NUMBERS = tuple(REVENUE_HEADERS.values())[1:]
BOND_COLUMNS = ("symbol", "kind", "company", "bond_code", "bond_name", "issued", "coupon", "due", "series", "currency", "issue_total", "month_end_balance")
NEWS_ORDER = ("google", "cnyes", "yahoo", "exchange")


def revenue_table(pages: DataFrame, key: str, text: str) -> DataFrame:
    """(symbol, d, and ``REVENUE_NUMBERS``) of landed monthly revenue pages: pages without data go, the tables that are 6 to
    11 columns wide count, the month is the page's, columns go by the last header level, totals go."""
    known = pages.where(landed.has_data(F.col(text), NO_DATA))
    months = known.select(F.col(key).alias("_page"), dates.roc_month(F.col(text)).alias("_month")).groupBy("_page").agg(F.max("_month").alias("_month"))  # a page's own month
    rows = landed.fitting_tables(landed.html_tables(known, key, text))
    cells = landed.named_cells(rows, REVENUE_HEADERS, [F.col(key).alias("_page")]).join(months, "_page")
    return revenue_clean(cells.drop("_page"), list(REVENUE_NUMBERS), F.col("_month")).drop("_month")


def revenue_clean(df: DataFrame, numbers: list[str], now: Column) -> DataFrame:
    """Total rows go, the sentinel becomes null, text becomes numbers, the month is added."""
    rows = df.where((F.col("symbol") != TOTAL_ROW) & F.col("symbol").isNotNull())
    return rows.withColumns({n: f.number(f.sentinel_null(F.col(n))) for n in numbers}).withColumn("d", now)


def whole_null_rows(df: DataFrame, features: list[str]) -> DataFrame:
    return df.na.drop("all", subset=features)


def symbols_with_values(df: DataFrame, value: str) -> DataFrame:
    """``df`` without symbols that have no value at all."""
    return df.join(df.groupBy("symbol").agg(F.count(value).alias("n")).where("n > 0").select("symbol"), "symbol", "left_semi")


def long_panel(df: DataFrame, values: list[str]) -> DataFrame:
    """(keys, item, value) from wide columns."""
    keys = [c for c in df.columns if c not in values]
    return df.unpivot(keys, values, "item", "value")


def statement_pivot(df: DataFrame, items: list[str]) -> DataFrame:
    """One row for each symbol and quarter with a column for each declared item; of values of one item the largest counts."""
    return df.groupBy("symbol", "quarter").pivot("item", items).agg(F.max("value"))


def statement_map(df: DataFrame) -> DataFrame:
    """One row for each symbol and quarter with all items in a map, nulls left out; of values of one item the largest counts."""
    rows = df.where("value is not null").groupBy("symbol", "quarter", "item").agg(F.max("value").alias("value")).groupBy("symbol", "quarter").agg(F.collect_list(F.struct("item", "value")).alias("x"))
    return rows.select("symbol", "quarter", F.map_from_entries("x").alias("items"))


def statement_items(pages: DataFrame, text: str, modern: int = 2019) -> DataFrame:
    """(symbol, quarter, item, value) of landed statement pages (symbol, quarter and a text with tables).

    From the year ``modern`` on a row's item and value are its second and third cell, before that its first and second.
    Items lose ideographic spaces; empty values are null.
    """
    key = F.struct("symbol", "quarter")
    rows = landed.html_tables(pages.select(F.to_json(key).alias("_page"), text), "_page", text).where("not header")
    page = F.from_json("_page", "symbol string, quarter string")
    rows = rows.select(page["symbol"].alias("symbol"), page["quarter"].alias("quarter"), "cells")
    first = F.when(F.substring("quarter", 1, 4).cast("int") >= modern, 1).otherwise(0)
    item = F.trim(f.ideographic(F.get("cells", first)))
    return rows.select("symbol", "quarter", item.alias("item"), F.nullif(F.trim(F.get("cells", first + 1)), F.lit("")).alias("value")).where("item <> ''")


def news_rows(feed: DataFrame, links: DataFrame, announced: DataFrame, base: str, now: Column) -> DataFrame:
    """(source, title, url, host, quality_flag, published) of feeds, listings and announcements, the first of each title."""
    place = lambda df, at: df.withColumn("ord", F.struct(F.col("page").cast("long").alias("page"), F.col(at).cast("long").alias("place")))
    a = place(feed, "ord").withColumn("source", F.lit("google")).withColumn("published", dates.relative_time(F.col("published_at"), now).cast("timestamp_ntz"))
    b = place(links, "ord").select(F.lit("cnyes").alias("source"), "title", f.absolute_url(F.col("href"), base).alias("url"), "ord")
    c = place(announced, "row_no").select(F.lit("exchange").alias("source"), "title", "ord")
    rows = first_by_title(union_sources(a.select("source", "title", "url", "published", "ord"), b, c))
    rows = rows.withColumn("host", f.host(F.col("url")))
    return rows.select("source", "title", "url", "host", f.source_quality(F.col("host")).alias("quality_flag"), "published")


def q4_alone(df: DataFrame, value: str = "value") -> DataFrame:
    """A fourth quarter, reported for the year, less the three quarters before it."""
    w = Window.partitionBy("symbol").orderBy("quarter")
    last3 = w.rowsBetween(-3, -1)
    whole = (F.substring("quarter", 6, 1) == "4") & (F.count(value).over(last3) == 3)
    return df.withColumn("alone", F.when(whole, F.col(value) - F.sum(value).over(last3)).otherwise(F.col(value)))


def bond_rows(df: DataFrame, text: str, month: Column) -> DataFrame:
    """Bond tables landed as lines of space-parted cells: the header line and the footer (a row count) go."""
    lines = df.select(month.alias("_month"), F.posexplode(F.split(text, "\n")).alias("at", "line"))
    cells = lines.where((F.col("at") > 0) & (F.trim("line") != "")).withColumn("c", F.slice(F.split("line", " "), 1, 14))
    kept = cells.where(F.size("c") >= len(BOND_COLUMNS))
    return kept.select(*(F.get("c", F.lit(i)).alias(n) for i, n in enumerate(BOND_COLUMNS)), F.col("_month").alias("d")).distinct()


def bond_extracts(pages: DataFrame, text: str) -> DataFrame:
    """Bonds of several extracts (outstanding and settled ones, present and past months), each row once; a page's month is the
    one that its first line names."""
    return bond_rows(pages, text, dates.roc_month(F.substring_index(text, "\n", 1)))


def union_sources(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for x in frames[1:]:
        out = out.unionByName(x, allowMissingColumns=True)
    return out


def first_by_title(df: DataFrame, order: tuple[str, ...] = NEWS_ORDER, tie: str = "ord") -> DataFrame:
    """The first row of each title, sources ranked by ``order``, others last; short and empty titles go."""
    rank = F.coalesce(*(F.when(F.col("source") == s, i) for i, s in enumerate(order)), F.lit(len(order)))
    w = Window.partitionBy("title").orderBy("rank", tie)
    rows = df.where(F.length("title") > 5).withColumn("rank", rank)
    return rows.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def capped_articles(df: DataFrame, group: str, most: int = 5) -> DataFrame:
    """Each URL once, and the first ``most`` of each question."""
    once = df.withColumn("rn", F.row_number().over(Window.partitionBy(group, "url").orderBy("ord"))).where("rn = 1")
    return once.withColumn("rn", F.row_number().over(Window.partitionBy(group).orderBy("ord"))).where(F.col("rn") <= most)


def article_block(df: DataFrame, group: str) -> DataFrame:
    """The articles of each question as one numbered text."""
    line = F.concat(F.col("rn").cast("string"), F.lit(". "), F.coalesce("title", F.lit("")), F.coalesce(F.concat(F.lit(" ["), F.col("quality_flag"), F.lit("]")), F.lit("")))
    rows = df.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("rn", line.alias("line")))).alias("x"))
    return rows.select(group, F.array_join("x.line", "\n").alias("block"))


def article_blocks(df: DataFrame, group: str) -> DataFrame:
    """The numbered articles (``rn``) of each question as blocks of title, source and day, summary and URL, flagged."""
    text = lambda x: F.coalesce(F.col(x).cast("string"), F.lit(""))
    flag = F.coalesce(F.concat(F.lit(" [⚠️ "), F.col("quality_flag"), F.lit("]")), F.lit(""))
    day = F.coalesce(F.date_format("published", "yyyy-MM-dd"), F.lit(""))
    one = F.concat(F.lit("Article "), text("rn"), flag, F.lit(":\n  Title: "), text("title"), F.lit("\n  Source: "), text("source"), F.lit(" ("), day, F.lit(")\n  Summary: "), text("summary"), F.lit("\n  URL: "), text("url"))
    rows = df.groupBy(F.col(group).alias("_group")).agg(F.array_sort(F.collect_list(F.struct("rn", one.alias("one")))).alias("x"))
    return rows.select(F.col("_group").alias(group), F.array_join("x.one", "\n\n").alias("block"))


def reaction_counts(df: DataFrame, tag: str = "tag") -> DataFrame:
    """Approvals, objections and all comments of each post."""
    return df.groupBy("post_id").agg(F.count_if(F.col(tag).contains("推")).alias("push_up"), F.count_if(F.col(tag).contains("噓")).alias("push_down"), F.count("*").alias("total_comments"))


def posts(df: DataFrame) -> DataFrame:
    """Forum rows with a title: kind, codes mentioned, number of pushes."""
    kept = df.where(F.length("title") > 0)
    return kept.withColumns({"post_type": f.post_type(F.col("title")), "mentioned": f.code_mentions(F.col("title")), "push_number": F.col("push_count").try_cast("int")})


def ingest_progress(log: DataFrame) -> DataFrame:
    """Done share, errors and status of each source in a run log (source, status)."""
    found = log.groupBy("source").agg(F.count("*").alias("total"), F.count_if(F.col("status") == "done").alias("done"), F.count_if(F.col("status") == "error").alias("errors"), F.count_if(F.col("status") == "running").alias("active"))
    label = F.when(F.col("active") > 0, "running").when(F.col("errors") > 0, "error").when(F.col("done") == F.col("total"), "completed").otherwise("idle")
    return found.withColumns({"percent": F.round(100 * F.try_divide("done", "total"), 2), "label": label})


def null_profile(df: DataFrame, values: list[str]) -> DataFrame:
    return df.groupBy("symbol").agg(*(F.count_if(F.col(v).isNull()).alias(f"{v}_nulls") for v in values), F.count("*").alias("n"))


def revenue_growth(df: DataFrame, value: str) -> DataFrame:
    return df.withColumn("growth", 100 * panel.pct_change(F.col(value)))
