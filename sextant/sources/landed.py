"""Landed files as rows: HTML tables and listings, feeds, forum pages, search answers."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import NumericType

from ..functions import scalars
from . import markup

#: The elements of a board's entries and of a post.
ENTRY, POST, META, COMMENT, COMMENT_TAG = ".r-ent", "main-content", ("article-metaline", "article-metaline-right"), ".push", ".push-tag"
#: Rows that an extractor gives at a time.
CHUNK = 2_000


def chunks(rows: Iterator[tuple], n: int) -> Iterator[list[tuple]]:
    """Lists of ``n`` rows and a last shorter one, none of them ahead of its turn."""
    while found := list(islice(rows, n)):
        yield found


def extracted(df: DataFrame, key: str, text: str, find: Callable[[str | None], Iterable[tuple]], columns: str) -> DataFrame:
    """``key`` and ``columns`` of every row that ``find`` gives for a text; the pages are parsed one by
    one, and a task holds one page and ``CHUNK`` of its rows beside the Arrow batch.

    A null text counts as an empty one, a null key stays, pages of one key are pages of their own.
    """
    kind = df.schema[key].dataType.simpleString()
    fields = df.sparkSession.createDataFrame([], columns).schema
    types = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows in chunks(((i, *r) for i, x in enumerate(b.column(1)) for r in find(x.as_py())), CHUNK):
                at, *values = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *(pa.array(v, t.type) for v, t in zip(values, types, strict=True))], [key, *types.names])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, {columns}")


def binary_text(spark: SparkSession, path: str, charset: str = "Big5") -> DataFrame:
    """(path, text) of landed files in a legacy encoding."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.decode(charset, "replace") for x in b.column(1).to_pylist()], pa.string())], ["path", "text"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, text string")


def html_tables(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, table_no, row_no, header, n_columns, names, cells) of every table row of a page.

    Cells that span rows or columns are repeated in each, so all rows of a table have its ``n_columns``; ``names`` are the
    cells of the last header row, null without one. Tables within a cell are tables of their own.
    """

    def find(page: str | None) -> Iterator[tuple]:
        for t, table in enumerate(markup.parse(page).all("table")):
            rows, heads = markup.grid(table)
            for r, cells in enumerate(rows):
                yield t, r, r < heads, len(cells), rows[heads - 1] if heads else None, cells

    return extracted(df, key, text, find, "table_no int, row_no int, header boolean, n_columns int, names array<string>, cells array<string>")


def fitting_tables(rows: DataFrame, least: int = 6, most: int = 11) -> DataFrame:
    """Rows of the tables that are ``least`` to ``most`` columns wide; a table is taken or left whole."""
    return rows.where(F.col("n_columns").between(least, most))


def named_cells(rows: DataFrame, names: dict[str, str], keep: list[str | Column]) -> DataFrame:
    """``keep`` and a column for each of ``names`` (header to column), of body rows; null where a table has no such header."""
    cell = lambda header: F.get("cells", F.array_position("names", header).cast("int") - 1)
    return rows.where(~F.col("header") & F.col("names").isNotNull()).select(*keep, *(cell(header).alias(column) for header, column in names.items()))


def announcements(rows: DataFrame) -> DataFrame:
    """Table rows of four cells or more, each page's first row left out: symbol, company, title, date."""
    kept = rows.where((F.size(F.filter("cells", lambda x: x.isNotNull())) >= 4) & ((F.col("table_no") > 0) | (F.col("row_no") > 0)))
    return kept.select(*[c for c in rows.columns if c not in ("header", "names", "cells", "n_columns")], *(F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(("symbol", "company", "title", "date"))))


def page_links(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, ord, title, href) of every anchor with an address, in page order."""

    def find(page: str | None) -> Iterator[tuple]:
        links = (a for a in markup.parse(page).all("a") if "href" in a.attributes)
        return ((n, a.words(), a.attributes["href"]) for n, a in enumerate(links))

    return extracted(df, key, text, find, "ord int, title string, href string")


def feed_items(df: DataFrame, key: str, text: str, n: int | None = None) -> DataFrame:
    """(key, ord, title, url, published_at, source) of the items of landed feeds, in feed order; the first ``n`` if given.

    A feed is read as one value with its items as an array, so that an item's place is known. What is no feed gives no row.
    """
    feed = F.from_xml(text, F.lit("channel struct<item: array<struct<title: string, link: string, pubDate: string, source: struct<_VALUE: string, _url: string>>>>"))
    items = df.where(F.col(text).isNotNull()).select(key, F.posexplode(feed["channel"]["item"]).alias("ord", "x"))
    rows = items.select(key, "ord", F.coalesce(F.trim("x.title"), F.lit("")).alias("title"), F.coalesce(F.trim("x.link"), F.lit("")).alias("url"), F.coalesce(F.trim("x.pubDate"), F.lit("")).alias("published_at"), F.coalesce(F.trim("x.source._VALUE"), F.lit("google_news")).alias("source"))
    return rows if n is None else rows.where(F.col("ord") < n)


def feed_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of landed feeds, a file each."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def search_results(df: DataFrame, text: str = "value") -> DataFrame:
    """Answers of two providers in one schema: title, url, summary, published."""
    web = F.from_json(text, "web struct<results: array<struct<title: string, url: string, description: string, age: string>>>")
    organic = F.from_json(text, "news_results array<struct<title: string, link: string, snippet: string, date: string>>")
    a = df.select(F.explode(web["web"]["results"]).alias("r")).select("r.title", "r.url", F.col("r.description").alias("summary"), F.col("r.age").alias("published"))
    b = df.select(F.explode(organic["news_results"]).alias("r")).select("r.title", F.col("r.link").alias("url"), F.col("r.snippet").alias("summary"), F.col("r.date").alias("published"))
    return a.unionByName(b)


def has_data(text: Column, marker: str) -> Column:
    return ~text.contains(marker)


def forum_listing(df: DataFrame, key: str, text: str, base: str = "") -> DataFrame:
    """(key, title, url, author, date, push_count) of a board page's entries; entries without a title link go."""

    def find(page: str | None) -> Iterator[tuple]:
        for entry in markup.parse(page).all(ENTRY):
            link = entry.path(".title", "a")
            if link is not None:
                found = (entry.path(".meta", ".author"), entry.path(".meta", ".date"), entry.path(".nrec", "span"))
                yield link.text(), base + link.attributes.get("href", ""), *(e.text() if e is not None else none for e, none in zip(found, ("", "", "0"), strict=True))

    return extracted(df, key, text, find, "title string, url string, author string, date string, push_count string")


def forum_posts(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, body, push_up, push_down, total_comments) of a post's page; a page without a main part gives no row.

    Every comment element counts, one without a tag too; approval and objection go by the first tag inside.
    """

    def find(page: str | None) -> Iterator[tuple]:
        root = markup.parse(page)
        main = next(root.all(lambda e: e.attributes.get("id") == POST), None)
        if main is not None:
            comments = list(root.all(COMMENT))
            tags = [e.path(COMMENT_TAG) for e in comments]
            said = ["".join(t.strings()) for t in tags if t is not None]
            yield "".join(main.strings(lambda e: any(c in META for c in e.classes))), sum("推" in t for t in said), sum("噓" in t for t in said), len(comments)

    rows = extracted(df, key, text, find, "raw string, push_up int, push_down int, total_comments int")
    return rows.select(key, scalars.post_body(F.col("raw")).alias("body"), "push_up", "push_down", "total_comments")


def numeric_columns(df: DataFrame, n: int = 5) -> list[str]:
    """The first ``n`` columns of a number type."""
    return [f.name for f in df.schema if isinstance(f.dataType, NumericType)][:n]
