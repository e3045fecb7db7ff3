"""Jobs from landed pages and files to clean tables, each with the pages that it reads made of the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import panel
from ..functions import scalars as f
from ..operators import clean
from ..sources import landed, storage
from . import adapters as a
from .jobs import ORACLES, QUERIES, shared_path
from .queries import NOW, c, r, rd


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def cells(*values: Column, tag: str = "td") -> Column:
    return F.concat(F.lit("<tr>"), *(x for v in values for x in (F.lit(f"<{tag}>"), F.coalesce(v.cast("string"), F.lit("")), F.lit(f"</{tag}>"))), F.lit("</tr>"))


def escaped(text: Column) -> Column:
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(mark), F.lit(entity))
    return text


# --- monthly revenues ------------------------------------------------------------------------------------------------

REVENUE_PAGES, PAGE_ROWS = 16, 200
LEVELS = "<tr><th rowspan=2>公司代號</th><th rowspan=2>公司名稱</th><th colspan=5>營業收入</th><th colspan=3>累計營業收入</th><th rowspan=2>備註</th></tr><tr><th>當月營收</th><th>上月營收</th><th>去年當月營收</th><th>上月比較增減(%)</th><th>去年同月增減(%)</th><th>當月累計營收</th><th>去年累計營收</th><th>前期比較增減(%)</th></tr>"


def revenue_pages(spark: SparkSession, sf: str) -> DataFrame:
    """(page, text): a month's revenues of a sixteenth of the suppliers, 200 keys a page, with a narrow table, a total and
    absent values."""
    month = F.trunc("l_shipdate", "MM")
    money = F.sum("l_extendedprice").cast("decimal(20,2)")
    rows = a.table(spark, sf, "lineitem").groupBy(c("l_suppkey").alias("k"), month.alias("m")).agg(money.alias("now"))
    line = cells(c("k"), F.lit("x"), F.format_number(c("now").cast("double"), 2), F.lit("不適用"), F.lit("7"), F.lit("-"), F.lit("1.5"), F.lit("9"), F.lit("8"), F.lit("2.5"), F.lit(""))
    page = rows.groupBy("m", (c("k") % REVENUE_PAGES).alias("p"), F.expr(f"k div {REVENUE_PAGES * PAGE_ROWS}").alias("n")).agg(F.array_join(F.collect_list(line), "").alias("lines"))
    total = cells(F.lit(clean.TOTAL_ROW), *[F.lit("1")] * 10)
    roc = F.concat(F.lit("查詢月份： "), (F.year("m") - 1911).cast("string"), F.lit(" 年 "), F.lpad(F.month("m").cast("string"), 2, "0"), F.lit(" 月份"))
    table = F.concat(F.lit(f"<table>{LEVELS}"), c("lines"), total, F.lit("</table>"))
    text = F.concat(roc, F.lit("<table><tr><td>a</td><td>b</td></tr></table>"), table, F.when(c("p") == 15, F.lit(clean.NO_DATA)).otherwise(""))
    return page.select(F.concat_ws("-", *(c(x).cast("string") for x in "mpn")).alias("page"), text.alias("text"))


@query(f"""WITH m AS (SELECT l_suppkey AS k, CAST(date_trunc('month', l_shipdate) AS DATE) AS d, round(sum(CAST(l_extendedprice AS DECIMAL(20,2))), 2) AS now FROM lineitem WHERE l_suppkey % {REVENUE_PAGES} <> 15 GROUP BY 1, 2)
SELECT CAST(k AS VARCHAR) AS symbol, d, CAST(now AS DOUBLE) AS revenue, CAST(NULL AS DOUBLE) AS revenue_before, 7.0::DOUBLE AS revenue_year_ago, CAST(NULL AS DOUBLE) AS change, 2.5::DOUBLE AS ytd_change,
 {rd("100 * (CAST(now AS DOUBLE) / lag(CAST(now AS DOUBLE)) OVER (PARTITION BY k ORDER BY d) - 1)", 4)} AS growth FROM m""")
def revenue_job(spark: SparkSession, sf: str) -> DataFrame:
    """Landed revenue pages to a table of revenues with their growth."""
    found = clean.revenue_growth(clean.revenue_table(revenue_pages(spark, sf), "page", "text"), "revenue")
    return found.select("symbol", "d", "revenue", "revenue_before", "revenue_year_ago", "change", "ytd_change", r(c("growth"), 4).alias("growth"))


# --- statements ------------------------------------------------------------------------------------------------------

ITEMS = ("revenue", "discounts", "tax")


def statement_pages(spark: SparkSession, sf: str, modern: int = 1996) -> DataFrame:
    """(symbol, quarter, text): statement pages, which from ``modern`` on have a code before the item."""
    s = a.statements(spark, sf)
    money = lambda x: F.concat(F.lit("("), c(x).cast("decimal(20,2)").cast("string"), F.lit(")")) if x == "tax" else c(x).cast("decimal(20,2)").cast("string")
    new = F.substring("quarter", 1, 4).cast("int") >= modern
    line = lambda x: F.when(new, cells(F.lit("1000"), F.lit(f"　{x}"), money(x), F.lit("9"))).otherwise(cells(F.lit(f"　{x}"), money(x), F.lit("9")))
    empty = F.when(new, cells(F.lit("1001"), F.lit("none"), F.lit(""))).otherwise(cells(F.lit("none"), F.lit("")))
    return s.select("symbol", "quarter", F.concat(F.lit("<table>"), *map(line, ITEMS), empty, F.lit("</table>")).alias("text"))


@query(f"""WITH {a.STATEMENTS}, q AS (SELECT *, right(quarter, 1) = '4' AND count(*) OVER w = 3 AS whole, sum(revenue) OVER w AS prior FROM statements WINDOW w AS (PARTITION BY symbol ORDER BY quarter ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING))
SELECT symbol, quarter, revenue, discounts, -tax AS tax, 3 AS n_items, {rd('CASE WHEN whole THEN revenue - prior ELSE revenue END', 2)} AS alone FROM q""")
def statement_job(spark: SparkSession, sf: str) -> DataFrame:
    """Landed statement pages to one row a symbol and quarter, with the revenue of the quarter alone."""
    items = clean.statement_items(statement_pages(spark, sf), "text", modern=1996)
    held = clean.statement_map(items).withColumn("n_items", F.size("items"))
    rows = held.select("symbol", "quarter", "n_items", *(f.number(c("items")[x]).alias(x) for x in ITEMS))
    return clean.q4_alone(rows, "revenue").select("symbol", "quarter", *ITEMS, "n_items", r(c("alone"), 2).alias("alone"))


# --- news ------------------------------------------------------------------------------------------------------------

FEED_ROWS, FEED_FIRST = 50, 20


def headlines(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, title): the first line of each document whose letters a page and a feed can both hold."""
    title = F.regexp_replace(F.split("text", "\n")[0], r"[^\p{L}\p{N} .,:-]", "")
    return a.table(spark, sf, "documents").where(c("text").isNotNull()).select("doc_id", F.trim(F.regexp_replace(title, " +", " ")).alias("title"))


def news_pages(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Feeds of fifty items, listings and announcement tables: a third of the headlines each, by id."""
    h = headlines(spark, sf).withColumn("page", F.floor(c("doc_id") / FEED_ROWS))
    gather = lambda kind, line: h.where(c("doc_id") % 3 == kind).groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", line.alias("x")))), lambda y: y["x"]), "").alias("lines"))
    item = F.concat(F.lit("<item><title>"), escaped(c("title")), F.lit("</title><link>http://www.rt.com/"), c("doc_id").cast("string"), F.lit("</link><pubDate>2 hours ago</pubDate></item>"))
    link = F.concat(F.lit("<div><a href='/news/"), c("doc_id").cast("string"), F.lit("'><b>"), escaped(c("title")), F.lit("</b></a></div>"))
    row = cells(c("doc_id"), F.lit("x"), escaped(c("title")), F.lit("112/02/01"))
    wrap = lambda df, lo, hi: df.select("page", F.concat(F.lit(lo), "lines", F.lit(hi)).alias("text"))
    head = cells(*map(F.lit, ("代號", "公司", "主旨", "日期")))
    table = gather(2, row).select("page", F.concat(F.lit("<table>"), head, "lines", F.lit("</table>")).alias("text"))
    return wrap(gather(0, item), "<rss><channel>", "</channel></rss>"), wrap(gather(1, link), "<html>", "</html>"), table


CLEAN_TITLE = "trim(regexp_replace(regexp_replace(string_split(text, chr(10))[1], '[^\\p{L}\\p{N} .,:-]', '', 'g'), ' +', ' ', 'g'))"
NEWS_JOB = f"""WITH h AS (SELECT doc_id, doc_id // {FEED_ROWS} AS page, {CLEAN_TITLE} AS title FROM documents WHERE text IS NOT NULL),
n AS (SELECT 'google' AS source, title, 'http://www.rt.com/' || CAST(doc_id AS VARCHAR) AS url, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY doc_id) AS i FROM h WHERE doc_id % 3 = 0) WHERE i <= {FEED_FIRST}
 UNION ALL SELECT 'cnyes', title, 'https://news.cnyes.com/news/' || CAST(doc_id AS VARCHAR), doc_id FROM h WHERE doc_id % 3 = 1 UNION ALL SELECT 'exchange', title, NULL, doc_id FROM h WHERE doc_id % 3 = 2),
d AS (SELECT *, row_number() OVER (PARTITION BY title ORDER BY CASE source WHEN 'google' THEN 0 WHEN 'cnyes' THEN 1 ELSE 2 END, doc_id) AS rn FROM n WHERE length(title) > 5)
SELECT source, title, url, CASE source WHEN 'google' THEN 'rt.com' WHEN 'cnyes' THEN 'news.cnyes.com' END AS host, CASE source WHEN 'google' THEN 'state_media' END AS quality_flag, CASE source WHEN 'google' THEN TIMESTAMP '{NOW} 10:00:00' END AS published FROM d WHERE rn = 1"""


@query(NEWS_JOB)
def news_job(spark: SparkSession, sf: str) -> DataFrame:
    """Feeds, listings and announcements to one stored table of news, first source first, upserted by source and title."""
    feeds, listings_, tables = news_pages(spark, sf)
    table = storage.KeyedTable(spark, shared_path(spark, "news"), ["source", "title"], "source string, title string, url string, host string, quality_flag string, published timestamp_ntz", 16)
    rows = clean.news_rows(landed.feed_items(feeds, "page", "text", FEED_FIRST), landed.page_links(listings_, "page", "text"), landed.announcements(landed.html_tables(tables, "page", "text")), "https://news.cnyes.com", F.lit(f"{NOW} 12:00:00").cast("timestamp"))
    table.upsert(rows, "first")
    table.upsert(rows, "again")
    return table.read()


@query(f"""WITH h AS (SELECT doc_id, doc_id // {FEED_ROWS} AS page, {CLEAN_TITLE} AS title FROM documents WHERE text IS NOT NULL AND doc_id % 3 = 0)
SELECT page, i - 1 AS ord, title FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY doc_id) AS i FROM h) WHERE i <= {FEED_FIRST}""")
def feed_first_items(spark: SparkSession, sf: str) -> DataFrame:
    """The first twenty items of each feed, by their place in it."""
    return landed.feed_items(news_pages(spark, sf)[0], "page", "text", FEED_FIRST).select("page", c("ord").cast("long").alias("ord"), "title")


# --- forum -----------------------------------------------------------------------------------------------------------


def forum_pages(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """A board's entries and a post's page for each conversation; turns after the first are comments, some without a tag."""
    t = a.table(spark, sf, "conversations")
    tag = F.when(c("role") == "assistant", "推").when(c("turn") % 4 == 0, "噓").otherwise("→")
    comment = F.concat(F.lit("<div class='push'>"), F.when(c("turn") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("<div><span class='hl push-tag'>"), tag, F.lit(" </span></div>"))), F.lit("<span>x</span></div>"))
    body = F.concat(F.lit("<div>"), F.regexp_replace(escaped(F.coalesce("text", F.lit(""))), r"\s+", " "), F.lit("</div>"))
    posts = t.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.when(c("turn") == 0, body).otherwise(comment).alias("x")))), lambda y: y["x"]), "").alias("x"))
    page = F.concat(F.lit("<div id='main-content'><div class='article-metaline'><span>作者</span></div>"), F.regexp_replace("x", "(<div class='push'>)", "※ 發信站: b$1"), F.lit("</div>"))
    tags = F.array(*map(F.lit, (*f.POST_TAGS, "")))
    title = F.concat(F.get(tags, (c("conv_id") % 6).cast("int")), F.lit(" "), (c("conv_id") + 1000).cast("string"), F.lit(" x"))
    entry = F.concat(F.lit("<div class='r-ent'><div class='nrec'><span>"), (c("conv_id") % 90).cast("string"), F.lit("</span></div><div class='title'><a href='/"), c("conv_id").cast("string"), F.lit("'>"), title, F.lit("</a></div><div class='meta'><div class='author'>u</div></div></div><div class='r-ent'><div class='title'>(gone)</div></div>"))
    return t.select("conv_id").distinct().select("conv_id", entry.alias("text")), posts.select("conv_id", page.alias("text"))


@query("""WITH k AS (SELECT DISTINCT conv_id FROM conversations),
p AS (SELECT conv_id, count(*) FILTER (WHERE turn > 0 AND turn % 3 <> 0 AND role = 'assistant') AS push_up, count(*) FILTER (WHERE turn > 0 AND turn % 3 <> 0 AND coalesce(role, '') <> 'assistant' AND turn % 4 = 0) AS push_down,
 count(*) FILTER (WHERE turn > 0) AS total_comments, left(trim(regexp_replace(coalesce(max(text) FILTER (WHERE turn = 0), ''), '\\s+', ' ', 'g')), 2000) AS body FROM conversations GROUP BY conv_id)
SELECT k.conv_id, ['target', 'question', 'review', 'news', 'chat', 'general'][k.conv_id % 6 + 1] AS post_type, CASE WHEN k.conv_id + 1000 <= 9999 THEN CAST(k.conv_id + 1000 AS VARCHAR) ELSE '' END AS mentioned,
 k.conv_id % 90 AS push_number, '/' || CAST(k.conv_id AS VARCHAR) AS url, body, push_up, push_down, total_comments FROM k JOIN p USING (conv_id)""")
def forum_job(spark: SparkSession, sf: str) -> DataFrame:
    """Board pages and post pages to posts with their type, codes, bodies and reactions."""
    boards, pages = forum_pages(spark, sf)
    posts = clean.posts(landed.forum_listing(boards, "conv_id", "text"))
    found = posts.join(landed.forum_posts(pages, "conv_id", "text"), "conv_id")
    long = [c(x).cast("long").alias(x) for x in ("push_up", "push_down", "total_comments")]
    return found.select("conv_id", "post_type", F.array_join("mentioned", ",").alias("mentioned"), c("push_number").cast("long").alias("push_number"), "url", "body", *long)


# --- bonds -----------------------------------------------------------------------------------------------------------

EXTRACTS = ((0, 1), (1, 2), (2, 3), (3, 0))


@query("SELECT CAST(o_custkey AS VARCHAR) AS symbol, CAST(o_orderkey AS VARCHAR) AS bond_code, CAST(date_trunc('month', o_orderdate) AS DATE) AS d FROM orders")
def bond_job(spark: SparkSession, sf: str) -> DataFrame:
    """Four extracts of landed bond tables that overlap, each bond once with the month of its page."""
    o = a.table(spark, sf, "orders").withColumn("m", F.trunc("o_orderdate", "MM"))
    line = F.concat_ws(" ", c("o_custkey").cast("string"), F.lit("k"), F.lit("n"), c("o_orderkey").cast("string"), *[F.lit(str(i)) for i in range(10)])
    head = F.concat(F.lit("公司債 查詢月份： "), (F.year("m") - 1911).cast("string"), F.lit(" 年 "), F.month("m").cast("string"), F.lit(" 月份\n"))
    page = lambda kinds: o.where((c("o_orderkey") % 4).isin(*kinds)).groupBy("m", (c("o_orderkey") % 32).alias("p")).agg(F.array_join(F.collect_list(line), "\n").alias("x")).select(F.concat(head, "x", F.lit("\n共 9 筆")).alias("text"))
    pages = [page(kinds) for kinds in EXTRACTS]
    return clean.bond_extracts(clean.union_sources(*pages), "text").select("symbol", "bond_code", "d")


# --- scans -----------------------------------------------------------------------------------------------------------


@query(f"WITH {a.PRICES} SELECT symbol, d, {rd('close')} AS close FROM prices WHERE d >= DATE '1996-02-01' AND d < DATE '1996-05-01' AND CAST(symbol AS BIGINT) % 10 = 3 OR d = DATE '1997-03-03'")
def monthly_scans(spark: SparkSession, sf: str) -> DataFrame:
    """Months of some symbols and a single day out of a table that is kept by month."""
    table = storage.monthly(a.prices(spark, sf), shared_path(spark, "monthly"))
    months = storage.scan_months(table, "1996-02-01", "1996-05-01").where(c("symbol").cast("long") % 10 == 3)
    return months.unionAll(storage.scan_day(table, "1997-03-03")).select("symbol", "d", r(c("close")).alias("close"))


@query(f"WITH {a.PRICES}, t AS (SELECT symbol, d, close FROM prices ORDER BY d DESC, symbol DESC LIMIT 50) SELECT row_number() OVER (ORDER BY d, symbol) AS i, symbol, d, {rd('close')} AS close FROM t")
def last_rows_ascending(spark: SparkSession, sf: str) -> DataFrame:
    """The last fifty rows, in ascending order, with their places."""
    rows = storage.recent(a.prices(spark, sf).select("symbol", "d", "close"), 50, "d", c("symbol").desc())
    x = rows.agg(F.array_sort(F.collect_list(F.struct("d", "symbol", "close"))).alias("x"))  # fifty rows
    return x.select(F.posexplode("x").alias("i", "y")).select((c("i") + 1).cast("long").alias("i"), "y.symbol", "y.d", r(c("y.close")).alias("close"))


@query(f"WITH {a.PRICES}, t AS (SELECT d, quantile_cont(close, 0.15) AS low, quantile_cont(close, 0.75) AS high, count(*) AS n FROM prices GROUP BY d) SELECT d, {rd('low')} AS low, {rd('high')} AS high FROM t")
def day_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    p = a.prices(spark, sf)
    low, high = (panel.period_quantile(p, "close", q, out=out) for q, out in ((0.15, "low"), (0.75, "high")))
    return low.join(high, "d").select("d", r(c("low")).alias("low"), r(c("high")).alias("high"))
