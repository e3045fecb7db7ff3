"""Benchmark decontamination: one Aho-Corasick automaton over normalised test items, each text scanned once."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, new_path, small_batches, written

WINDOW = 13
#: Words are runs of digits, letters a to z (after lower-casing A to Z) and every byte from 128 up.
WORD_BYTES = bytes(c if c >= 0x80 or chr(c) in "0123456789abcdefghijklmnopqrstuvwxyz" else c + 32 if chr(c) in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else 32 for c in range(256))
#: Item text, in bytes, that one automaton holds. Beyond it the items are scanned for in several blocks.
BLOCK_BYTES = 1 << 20
#: Words of an item that are kept together; longer items go in pieces that overlap by a window less one word.
PIECE_WORDS = 1 << 14


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(WORD_BYTES).split()


def word_offsets(text: str) -> list[tuple[int, int]]:
    """Start and end of each word of ``words(text)``, in characters of the original text."""
    raw = text.encode()
    flat = np.frombuffer(raw.translate(WORD_BYTES), np.uint8) != 32
    edges = np.flatnonzero(np.diff(np.concatenate(([False], flat, [False])).astype(np.int8)))
    chars = np.concatenate(([0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)))
    return [(int(chars[a]), int(chars[b])) for a, b in zip(edges[::2], edges[1::2], strict=True)]


class Items:
    """The automaton: each distinct item word is one symbol, each window a pattern over symbols."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW):
        self.symbols: dict[bytes, str] = {}
        windows: dict[str, set[str]] = {}
        for item, text in items:
            # symbols skip the surrogates; symbol 1 stands for every word that no item has
            line = "".join(self.symbols.setdefault(w, chr(n + 2 if n < 0xD000 else n + 0x2000)) for w in words(text) for n in [len(self.symbols)])
            for i in range(max(1, len(line) - window + 1) if line else 0):
                windows.setdefault(line[i : i + window], set()).update([item] if item is not None else [])
        self.automaton = ahocorasick.Automaton()
        for pattern, owners in windows.items():
            self.automaton.add_word(pattern, (len(pattern), owners))
        self.automaton.make_automaton()
        self.empty = not windows

    def scan(self, found: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """Which words lie in an occurrence of a window, and the items with such windows."""
        edge = np.zeros(len(found) + 1, np.int32)
        owners: set[str] = set()
        if not self.empty:
            get = self.symbols.get
            for end, (n, who) in self.automaton.iter("".join([get(w, "\1") for w in found])):
                edge[end + 1 - n] += 1
                edge[end + 1] -= 1
                owners |= who
        return np.cumsum(edge[:-1]) > 0, owners


def item_pieces(benchmark: DataFrame, item: str, text: str, window: int) -> DataFrame:
    """(item, text) of distinct items, those of more than PIECE_WORDS words in pieces that have all their windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for name, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = words(x)
                starts = range(0, max(1, len(found) - window + 1), PIECE_WORDS)
                out += [(name, b" ".join(found[i : i + PIECE_WORDS + window - 1]).decode()) for i in starts]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.string()) for k in (0, 1)], ["item", "text"])

    rows = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).alias("text")).distinct()
    return rows.mapInArrow(run, "item string, text string")


def item_blocks(benchmark: DataFrame, item: str, text: str, block_bytes: int = BLOCK_BYTES, window: int = WINDOW) -> tuple[DataFrame, int]:
    """The items' pieces with the block of each, written, and how many blocks there are: one unless the checked size of all
    texts is over ``block_bytes``, else blocks of about that size."""
    rows = written(item_pieces(benchmark, item, text, window), "items")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    return rows.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(blocks))), blocks


def block_items(items: DataFrame, block: int) -> list[tuple[str | None, str | None]]:
    """One block, about ``block_bytes`` of text, which goes to the tasks with the function that scans for it."""
    return [(r["item"], r["text"]) for r in items.where(F.col("block") == block).select("item", "text").collect()]


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, keep: bool = False) -> DataFrame:
    """Words of ``docs`` that lie in any ``window`` consecutive item words (a shorter item is one window).

    Returns, for each row: ``key`` (or with ``keep`` all columns), n_words, n_hit, item_ids (sorted as strings),
    spans array<struct<start, end>> (hit runs, in characters of the original text) and contaminated
    (n_hit > 0 and 20 * n_hit >= n_words). Null and empty texts and items have no words; items without an id
    mark words but are not listed. Columns named like an output are replaced. Very long texts and items are taken whole,
    rows that repeat stay, repeated items count once; an empty table, of either kind, leaves nothing covered.
    """
    spark = docs.sparkSession
    small_batches(spark)
    made = ["n_words", "n_hit", "item_ids", "spans", "contaminated"]
    given = docs.select(*([c for c in docs.columns if c not in made] if keep else dict.fromkeys([key, text])))
    rows = given.withColumns({fresh(given, "_marks"): F.lit(None).cast("array<int>"), fresh(given, "_items"): F.lit(None).cast("array<string>")})
    rows = _scan(rows, *item_blocks(benchmark, item, item_text, block_bytes, window), text, window)
    rows = _spans(rows, text, given.columns if keep else [key])
    return rows


def _marked(rows: DataFrame, found: list[tuple[str | None, str | None]], text: str, window: int) -> DataFrame:
    """Sets the last two columns to the indexes of the words that a window covers and the items of the windows; null where
    nothing is covered."""
    at = rows.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(found, window)
        for b in batches:
            marks, owners = [], []
            for x in b.column(at).to_pylist():
                hit, who = items.scan(words(x))
                marks.append(np.flatnonzero(hit).tolist() if hit.any() else None)
                owners.append(sorted(who) if hit.any() else None)
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(marks, pa.list_(pa.int32())), pa.array(owners, pa.list_(pa.string()))], b.schema.names)

    return rows.mapInArrow(run, rows.schema)


def _scan(rows: DataFrame, items: DataFrame, blocks: int, text: str, window: int) -> DataFrame:
    """Sets the last two columns of ``rows`` (see ``_marked``) for the windows of any block.

    With one block the texts are scanned once, in the result itself. With several each block scans the distinct texts for
    itself; what is covered in a text, few rows of numbers, is written, united by the text's 128-bit hash and joined back.
    """
    if blocks == 1:
        return _marked(rows, block_items(items, 0), text, window)
    hashes = [F.xxhash64(text), F.xxhash64(text, F.lit(1))]
    h = [fresh(rows, x) for x in ("_h1", "_h2")]
    path = new_path(rows.sparkSession, "hits")
    marks, owners = rows.columns[-2:]
    texts = rows.select(*(x.alias(n) for x, n in zip(hashes, h, strict=True)), text, marks, owners)
    for block in range(blocks):
        found = _marked(texts, block_items(items, block), text, window).drop(text).where(F.col(marks).isNotNull()).dropDuplicates(h)
        found.write.mode("append").parquet(path)
    hits = rows.sparkSession.read.schema(texts.drop(text).schema).parquet(path)
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)  # noqa: E731  of one text, a row for each block at most
    hits = hits.groupBy(*h).agg(union(marks), union(owners))
    keyed = rows.drop(marks, owners).withColumns(dict(zip(h, hashes, strict=True)))
    return keyed.join(hits, h, "left").select(*rows.columns)


def _spans(rows: DataFrame, text: str, keep: list[str]) -> DataFrame:
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    at, names = rows.columns.index(text), rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, marks, owners = (b.column(i).to_pylist() for i in (at, len(names) - 2, len(names) - 1))
            n_words, spans = [], []
            for x, m in zip(texts, marks, strict=True):
                n_words.append(len(words(x)))
                runs: list[dict[str, int]] = []
                if m:
                    where = word_offsets(x)
                    breaks = np.flatnonzero(np.diff(m) > 1) + 1
                    runs = [{"start": where[int(r[0])][0], "end": where[int(r[-1])][1]} for r in np.split(np.array(m), breaks)]
                spans.append(runs)
            hit = [len(m or []) for m in marks]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(names.index(c)) for c in keep), pa.array(n_words, pa.int64()), pa.array(hit, pa.int64()), pa.array([o or [] for o in owners], pa.list_(pa.string())), pa.array(spans, span), pa.array([h > 0 and 20 * h >= n for h, n in zip(hit, n_words, strict=True)])],
                [*keep, "n_words", "n_hit", "item_ids", "spans", "contaminated"],
            )

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in (rows.schema[c] for c in keep))
    return rows.mapInArrow(run, f"{kinds}, n_words long, n_hit long, item_ids array<string>, spans array<struct<start: int, end: int>>, contaminated boolean")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the contaminated ones, columns as given."""
    found = contamination(docs, benchmark, keep=True, **options)
    clean = found.where(~F.col("contaminated"))
    return clean.select(*docs.columns) if {"n_words", "n_hit", "item_ids", "spans", "contaminated"}.isdisjoint(docs.columns) else _clashing(docs, clean, options.get("key", "doc_id"))


def _clashing(docs: DataFrame, clean: DataFrame, key: str) -> DataFrame:
    """Columns of ``docs`` that are named like the scan's own come back by the key."""
    return docs.join(clean.select(key).distinct(), key, "left_semi").select(*docs.columns)


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
#: Windows of items and of documents as texts, joined when equal.
ORACLE = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
i AS (SELECT item, least({WINDOW}, len(w)) AS k, unnest(list_transform(range(1, len(w) - least({WINDOW}, len(w)) + 2), lambda i : array_to_string(w[i:i + least({WINDOW}, len(w)) - 1], ' '))) AS win FROM b WHERE len(w) > 0),
n AS (SELECT doc_id, k, unnest(range(1, len(w) - k + 2)) AS pos, unnest(list_transform(range(1, len(w) - k + 2), lambda i : array_to_string(w[i:i + k - 1], ' '))) AS win FROM d, (SELECT DISTINCT k FROM i) WHERE len(w) >= k),
h AS (SELECT n.doc_id, n.pos, n.k, i.item FROM n JOIN i USING (k, win)),
c AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + k)) AS pos FROM h) GROUP BY doc_id),
o AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN o USING (doc_id)
"""
