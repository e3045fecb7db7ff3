"""Byte-level BPE through a table of distinct words: each is encoded once, ids come back by position.

Texts are split into words and kept as numbers of words in blocks of documents. The distinct words of the blocks are
dealt to buckets by their hash; within its bucket each word is encoded once for all blocks. Ids go back to the blocks by
word number and are joined there with the vocabulary's (id, bytes) to decode. Block tables are bucketed by block, so that
the number sequences, by far the largest part, are never shuffled.
"""

from __future__ import annotations

import json
import math
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import fresh, new_path, small_batches

#: The published word pattern of byte-level BPE (GPT-2's encoder), as it stands there.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of text whose words share one local dictionary; a longer text has a block of its own.
BLOCK_CHARS = 16_000_000
#: Buckets of distinct words at least; a task holds the words of one bucket at a time. Their number grows with the square
#: root of the input, as distinct words do.
BUCKETS = 1024


def public_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def load(spec: str) -> Tokenizer:
    """A tokenizer from its JSON text, without truncation and padding."""
    t = Tokenizer.from_str(spec)
    t.no_truncation()
    t.no_padding()
    return t


def splitter(spec: str):
    """A function from text to its words; added tokens such as an end mark are words of their own."""
    find = regex.compile(WORD).findall
    added = sorted((x["content"] for x in json.loads(spec)["added_tokens"]), key=len, reverse=True)
    if not added:
        return find
    marks = regex.compile("(" + "|".join(map(regex.escape, added)) + ")")

    def split(text: str) -> list[str]:
        if not any(a in text for a in added):
            return find(text)
        parts = marks.split(text)
        return [w for i, p in enumerate(parts) for w in ([p] if i % 2 else find(p))]

    return split


def byte_of() -> dict[str, int]:
    """The byte for each character of a byte-level vocabulary: printable ones stand for themselves, others follow 255."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def piece_rows(spec: str) -> list[tuple[int, bytes]]:
    """(id, bytes) for the whole vocabulary."""
    t, table = load(spec), byte_of()
    vocab = t.get_vocab(with_added_tokens=True)
    return sorted((i, bytes(table[c] for c in p) if all(c in table for c in p) else p.encode()) for p, i in vocab.items())


_TABLES: dict[str, np.ndarray] = {}


def _pieces(spec: str) -> np.ndarray:
    """The vocabulary's bytes by id, made once in a worker."""
    if spec not in _TABLES:
        rows = piece_rows(spec)
        table = np.full(rows[-1][0] + 1, b"", object)
        for i, x in rows:
            table[i] = x
        _TABLES[spec] = table
    return _TABLES[spec]


def packed(seq: np.ndarray) -> bytes:
    """Word numbers as deflated byte planes: the first planes hold most, the others are nearly all 0."""
    return zlib.compress(seq.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpacked(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(blob), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel()


def flat(parts: list[bytes]) -> bytes:
    """Byte strings as one deflated string, their lengths first."""
    sizes = np.fromiter(map(len, parts), "<u4", len(parts)).view(np.uint8).reshape(-1, 4).T.tobytes()
    return zlib.compress(b"".join([len(parts).to_bytes(4, "little"), sizes, *parts]), 1)


def unflat(blob: bytes) -> list[bytes]:
    data = zlib.decompress(blob)
    n = int.from_bytes(data[:4], "little")
    sizes = np.ascontiguousarray(np.frombuffer(data, np.uint8, 4 * n, 4).reshape(4, -1).T).view("<u4").ravel()
    ends = (np.cumsum(sizes) + 4 + 4 * n).tolist()
    return [data[a:b] for a, b in zip([4 + 4 * n, *ends], ends, strict=False)]


def split_blocks(docs: DataFrame, key: str, text: str, spec: str, block_chars: int = BLOCK_CHARS, buckets: int = BUCKETS) -> DataFrame:
    """Blocks of documents: (block, rows array<struct<key, n>>, seq, parts). ``seq`` holds the documents' word numbers
    one after another, ``n`` how many are each one's, and ``parts`` the block's distinct words by bucket: at (their
    numbers, 32-bit) and words (deflated)."""
    kind = docs.schema[key].dataType
    part = pa.struct([("bucket", pa.int32()), ("at", pa.binary()), ("words", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = splitter(spec)
        number: dict[str, int] = {}
        keys: list = []
        seqs: list[np.ndarray] = []
        chars = 0

        def block() -> pa.RecordBatch:
            seq = np.concatenate(seqs) if seqs else np.empty(0, np.uint32)
            order = np.argsort(-np.bincount(seq, minlength=len(number)), kind="stable")  # frequent words get small numbers
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order), dtype=np.uint32)
            words = np.array([*number, ""], object)[:-1][order]
            bucket = np.fromiter((xxhash.xxh3_64_intdigest(w) % buckets for w in words), np.int32, len(words))
            by_bucket = np.argsort(bucket, kind="stable")
            parts = [{"bucket": int(bucket[i[0]]), "at": i.astype("<i4").tobytes(), "words": flat([w.encode() for w in words[i]])} for i in np.split(by_bucket, np.flatnonzero(np.diff(bucket[by_bucket])) + 1) if len(i)]
            rows = pa.StructArray.from_arrays([pa.concat_arrays(keys), pa.array(list(map(len, seqs)), pa.int32())], ["key", "n"])
            lists = pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows)
            return pa.RecordBatch.from_arrays([lists, pa.array([packed(rank[seq])], pa.binary()), pa.array([parts], pa.list_(part))], ["rows", "seq", "parts"])

        for b in batches:
            for i, x in enumerate(b.column(1).to_pylist()):
                found = split(x or "")
                if keys and chars + len(x or "") > block_chars:
                    yield block()
                    number, keys, seqs, chars = {}, [], [], 0
                chars += len(x or "")
                new = number.setdefault
                seqs.append(np.fromiter([new(w, len(number)) for w in found], np.uint32, len(found)))
                keys.append(b.column(0).slice(i, 1))
        if keys:
            yield block()

    blocks = docs.select(key, text).mapInArrow(run, f"rows array<struct<key: {kind.simpleString()}, n: int>>, seq binary, parts array<struct<bucket: int, at: binary, words: binary>>")
    return blocks.withColumn("block", F.monotonically_increasing_id())


def bucketed(blocks: DataFrame) -> DataFrame:
    """``blocks`` written to the shared folder as a table bucketed by block, and read again."""
    spark = blocks.sparkSession
    name = f"bpe_blocks_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks.write.bucketBy(n, "block").option("compression", "zstd").option("path", new_path(spark, name)).saveAsTable(name)
    return spark.table(name)


def encoded(places: DataFrame, spec: str) -> DataFrame:
    """(of, bucket, ids) for the rows of ``places`` (block, bucket, words): the ids of each word, in order, deflated.

    All rows of a bucket lie together, and each of its distinct words is encoded once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = load(spec).encode
        now, table = None, {}
        for b in batches:
            out = []
            for bucket, blob in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if bucket != now:
                    now, table = bucket, {}
                words = unflat(blob)
                for w in words:
                    if w not in table:
                        table[w] = np.array(encode(w.decode(), add_special_tokens=False).ids, "<u4").tobytes()
                out.append(flat([table[w] for w in words]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], ["of", "bucket", "ids"])

    dealt = places.repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, "of long, bucket int, ids binary")


def encode_decode(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str | None = None, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(key, ids, decoded) for each row of ``docs``: ids as little-endian unsigned 32-bit integers, and the text that
    the ids decode to.

    Equals what the tokenizers library gives for the whole text with add_special_tokens=False. Null and empty texts
    have no ids; repeated rows stay; an empty table gives an empty result; very long texts are encoded whole. A key column
    named ids or decoded leaves that name to the key, and the output's has an underscore after it; other columns are not read. ``tokenizer`` is the path of a byte-level
    BPE file, read on the driver.
    """
    spark = docs.sparkSession
    small_batches(spark)
    with open(tokenizer or public_path(), encoding="utf-8") as f:
        spec = f.read()
    kind = docs.schema[key].dataType.simpleString()
    out = [fresh(docs.select(key), x) for x in ("ids", "decoded")]
    size = docs.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
    blocks = bucketed(split_blocks(docs, key, text, spec, block_chars, max(BUCKETS, math.isqrt(size) // 16)))
    places = blocks.select("block", F.explode("parts").alias("p")).select("block", "p.bucket", "p.words")
    back = encoded(places, spec)

    def join(rows: pa.Table, parts: pa.Table) -> pa.Table:
        piece = _pieces(spec)
        coded = dict(zip(parts.column("bucket").to_pylist(), parts.column("ids").to_pylist(), strict=True))
        own = rows.column("parts")[0].as_py()
        n = sum(len(p["at"]) // 4 for p in own)
        ids, pieces = np.empty(n, object), np.empty(n, object)
        for p in own:
            found = unflat(coded[p["bucket"]])
            at = np.frombuffer(p["at"], "<i4")
            ids[at] = found
            pieces[at] = [b"".join(piece[np.frombuffer(x, "<u4")]) for x in found]  # the join with (id, bytes)
        seq = unpacked(rows.column("seq")[0].as_py())
        found = rows.column("rows").combine_chunks().flatten()
        ends = np.cumsum(found.field("n").to_numpy())
        spans = [seq[e - n : e] for e, n in zip(ends, found.field("n").to_pylist(), strict=True)]
        return pa.Table.from_arrays([found.field("key"), pa.array([b"".join(ids[s]) for s in spans], pa.binary()), pa.array([b"".join(pieces[s]).decode("utf-8", "replace") for s in spans], pa.string())], ["_key", *out])

    own = blocks.select("block", "rows", "seq", F.transform("parts", lambda p: F.struct(p["bucket"], p["at"])).alias("parts"))
    return own.groupBy("block").cogroup(back.groupBy("of")).applyInArrow(join, f"_key {kind}, {out[0]} binary, {out[1]} string").withColumnRenamed("_key", key)
