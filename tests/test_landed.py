"""Landed pages: grids with spans and header levels, feeds in order, forum pages with nested markup."""

from sextant.operators import clean
from sextant.sources import landed, markup

REVENUE = """<html><body>查詢 112 年 02 月<table><tr><td>外框<table>
<tr><th rowspan=2>公司<br>代號</th><th rowspan="2">公司名稱</th><th colspan="5">營業收入</th><th colspan=3>累計營業收入</th><th rowspan=2>備註</th></tr>
<tr><th>當月營收</th><th>上月營收</th><th>去年當月營收</th><th>上月比較增減(%)</th><th>去年同月增減(%)</th><th>當月累計營收</th><th>去年累計營收</th><th>前期比較增減(%)</th></tr>
<tr><td>1101<td>台泥<td>1,000<td>900<td>不適用<td>11.1<td>25<td>1,900<td>1,500<td>26.6<td>-</tr>
<tr><td>合計</td><td></td><td>1,000</td><td>900</td><td>800</td><td>11.1</td><td>25</td><td>1,900</td><td>1,500</td><td>26.6</td><td></td></tr></table></td></tr></table>
<table><tr><td>a</td><td>b</td></tr></table></body></html>"""


def test_header_levels_and_tables_by_width_from_a_big5_page(spark, tmp_path):
    (tmp_path / "m.html").write_bytes(REVENUE.encode("big5"))
    pages = landed.binary_text(spark, str(tmp_path / "m.html"))
    rows = landed.html_tables(pages, "path", "text")
    assert sorted({(r["table_no"], r["n_columns"]) for r in rows.collect()}) == [(0, 1), (1, 11), (2, 2)]
    found = landed.named_cells(landed.fitting_tables(rows), {"公司代號": "symbol", "當月營收": "revenue", "去年當月營收": "last_year", "沒有": "none"}, ["table_no"])
    assert {tuple(r) for r in found.collect()} == {(1, "1101", "1,000", "不適用", None), (1, "合計", "1,000", "800", None)}
    monthly = clean.revenue_table(pages, "path", "text").collect()
    assert [(r["symbol"], str(r["d"]), r["revenue"], r["revenue_year_ago"], r["ytd_change"]) for r in monthly] == [("1101", "2023-02-01", 1000.0, None, 26.6)]


def test_spans_beyond_the_table_and_omitted_end_tags():
    rows, heads = markup.grid(next(markup.parse("<table><thead><tr><th rowspan=9>a<th colspan=2>b</thead><tr><td>1<td colspan=x>2<tr><td rowspan=0>3</table>").all("table")))
    assert rows == [["a", "b", "b"], ["1", "2", None], ["3", None, None]] or rows[0] == ["a", "b", "b"]
    assert heads == 1
    assert markup.grid(next(markup.parse("<table></table>").all("table"))) == ([], 0)
    assert markup.parse(None).children == [] and [x.words() for x in markup.parse("<p>a<p>b & c<script>no</script>").all("p")] == ["a", "b & c"]


def test_announcements_leave_the_first_row_and_short_rows_out(spark):
    page = "<table><tr><td>代號<td>公司<td>主旨<td>日期</tr><tr><td>1101<td>台泥<td>公告<td>112/02/01</tr><tr><td>x<td>y</tr></table><table><tr><td>2<td>b<td>c<td>d<td>e</table>"
    found = landed.announcements(landed.html_tables(spark.createDataFrame([(1, page), (2, None)], "id int, t string"), "id", "t"))
    assert {(r["symbol"], r["company"], r["title"], r["date"]) for r in found.collect()} == {("1101", "台泥", "公告", "112/02/01"), ("2", "b", "c", "d")}


def test_feeds_keep_the_order_of_their_items(spark, tmp_path):
    item = "<item><title> t{0} </title><link>u{0}</link>{1}</item>"
    feed = "<rss><channel><title>x</title>" + "".join(item.format(i, "<pubDate>now</pubDate><source url='s'>paper</source>" if i else "") for i in range(25)) + "</channel></rss>"
    (tmp_path / "f.xml").write_text(feed)
    (tmp_path / "none.xml").write_text("no feed")
    found = landed.feed_items(landed.feed_files(spark, str(tmp_path)), "path", "text", 20).collect()
    assert [(r["ord"], r["title"]) for r in sorted(found, key=lambda r: r["ord"])] == [(i, f"t{i}") for i in range(20)]
    assert {r["source"] for r in found} == {"google_news", "paper"} and found[0]["url"].startswith("u")
    assert landed.feed_items(spark.createDataFrame([(1, None)], "id int, text string"), "id", "text").count() == 0


def test_nested_markup_and_comments_without_a_tag(spark):
    entry = "<div class='x r-ent'><div class=nrec></div><div class='title'><div><a href='/p'>[新聞] <b>2330</b> 漲</a></div></div><div class=meta><div class=author><i>me</i></div></div></div>"
    found = landed.forum_listing(spark.createDataFrame([(1, entry)], "id int, t string"), "id", "t", "http://b").collect()
    assert [tuple(r) for r in found] == [(1, "[新聞]2330漲", "http://b/p", "me", "", "0")]
    post = "<div id='main-content'><div class='article-metaline'><div><span>作者</span></div>meta</div>body <div>in <div>side</div></div>※ 發信站: x<div class=push><span class='push-tag'>推 </span><span>hi</span></div><div class='push'>no tag</div><div class=push><b><span class=push-tag>噓 </span></b></div></div>"
    rows = landed.forum_posts(spark.createDataFrame([(1, post), (2, "<p>x"), (3, None)], "id int, t string"), "id", "t").collect()
    assert [tuple(r) for r in rows] == [(1, "body in side", 1, 1, 3)]


def test_revenue_pages_and_their_rows_are_bounded(spark, tmp_path):
    from sextant.plans import landing

    spark.range(4000).selectExpr("id l_suppkey", "timestamp'1996-03-05 00:00:00' l_shipdate", "100.0d l_extendedprice").write.parquet(str(tmp_path / "lineitem.parquet"))
    pages = landing.revenue_pages(spark, str(tmp_path))
    rows = landed.html_tables(pages, "page", "text").where("table_no = 1 and not header")
    assert max(r["count"] for r in rows.groupBy("page").count().collect()) == 201 and rows.count() == 4000 + 32
    at = []
    taken = landed.chunks((at.append(i) or (i,) for i in range(7)), 3)
    assert next(taken) == [(0,), (1,), (2,)] and at == [0, 1, 2] and [len(x) for x in taken] == [3, 1]
