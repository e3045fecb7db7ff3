"""Prefix trie of conversations by fixed-length block hashing.

Conversations are first grouped by the digests of successive blocks of four turns, each digest covering all turns up to the
end of its block. Only inside blocks that have siblings, where conversations part, the turns between are told apart; in a
block without siblings every turn has the members of the block. Figures of subtrees are sums over blocks: each node belongs
to its smallest member, whose path carries the node's share to the blocks above.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_rows, group_min, group_total, written

#: Turns of a block, and blocks that are hashed in one row.
BLOCK = 4
SEGMENT = 64
#: A conversation's turns are numbered in runs of turn numbers, and a node's members are joined in runs of ids: 2 to this power.
RUN_BITS = 10
ROOT = "0" * 32


def digest(kind: str, *parts: Column) -> Column:
    """128 bits of SHA-256 as hexadecimal text; ``kind`` keeps digests of different things apart."""
    return F.left(F.sha2(F.concat(F.lit(kind), *parts).cast("binary"), 256), F.lit(32))


def turn_rows(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(conv, at, d, bytes) of every turn, numbered from 1, and (conv, n) of every conversation.

    Turns are in the order of ``turn``, nulls first, equal numbers in the order of their digests. Null roles and texts are
    empty; rows without a conversation belong to none. Turn numbers of a conversation are taken in runs of 1,024, counted
    first, so that a conversation with most of the rows is spread; rows with one turn number are sorted in one task.
    """
    who, said = (F.coalesce(F.col(x).cast("string"), F.lit("")) for x in (role, text))
    d = digest("", F.octet_length(who).cast("string"), F.lit(":"), who, said)
    rows = df.where(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("conv"), F.col(turn).cast("long").alias("turn"), d.alias("d"), F.octet_length(said).cast("long").alias("bytes"))
    run = F.coalesce(F.shiftright("turn", RUN_BITS), F.lit(-(1 << 62)))
    rows = written(rows.withColumn("run", run), "turns")
    counts = rows.groupBy("conv", "run").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("conv", "run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("conv", "run").orderBy(F.col("turn").asc_nulls_first(), "d", "bytes"))
    numbered = rows.withColumn("i", inside).join(starts, ["conv", "run"]).select("conv", (F.col("start") + F.col("i")).alias("at"), "d", "bytes")
    return numbered, counts.groupBy("conv").agg(F.sum("n").alias("n"))


def shared_starts(turns: DataFrame, convs: DataFrame, family: int = 5, longest: int = 9) -> DataFrame:
    """(conv, at, d, bytes) of conversations that open with the first turns of their family's head.

    Conversation c takes the first h turns of c - c % ``family``, h being crc32 of c as text modulo ``longest``, and then
    its own after its first h.
    """
    c = F.col
    h = F.crc32(c("conv").cast("string").cast("binary")) % longest
    own = convs.select("conv", "n", h.alias("h"), (c("conv") - c("conv") % family).alias("head"))
    heads = convs.where(c("conv") % family == 0).select(c("conv").alias("head"), c("n").alias("m"))
    own = own.join(heads, "head", "left").withColumn("taken", F.least("h", F.coalesce("m", F.lit(0))))
    opening = turns.where((c("conv") % family == 0) & (c("at") < longest)).withColumnRenamed("conv", "head")
    first = opening.join(own.select("conv", "head", "h"), "head").where("at <= h").select("conv", "at", "d", "bytes")
    rest = turns.join(own.select("conv", "h", "taken"), "conv").where("at > h").select("conv", (c("at") - c("h") + c("taken")).alias("at"), "d", "bytes")
    return first.unionByName(rest)


def chained(digests: Column) -> Column:
    """Running digests over an array: each covers all before it."""
    step = lambda done, d: F.concat(done, F.array(digest("c", F.coalesce(F.get(done, F.size(done) - 1), F.lit("")), d)))
    return F.aggregate(digests, F.array().cast("array<string>"), step)


def openings(ends: DataFrame, most: int) -> DataFrame:
    """(conv, i, top): the digest of all before segment ``i`` of a conversation, from (conv, i, d) of whole segments.

    64 digests are chained in one row; longer conversations are chained by rows of rows, ``most`` being the largest ``i``.
    """
    rows = ends.groupBy("conv", F.floor(F.col("i") / SEGMENT).alias("g")).agg(F.array_sort(F.collect_list(F.struct("i", "d"))).alias("x"))
    rows = rows.select("conv", "g", "x", chained(F.transform("x", lambda y: y["d"])).alias("inner"))
    top = F.lit(ROOT)
    if most >= SEGMENT:
        above = openings(rows.where(F.size("x") == SEGMENT).select("conv", F.col("g").alias("i"), F.get("inner", F.lit(SEGMENT - 1)).alias("d")), most // SEGMENT)
        rows = rows.join(above.select("conv", F.col("i").alias("g"), "top"), ["conv", "g"], "left")
        top = F.coalesce("top", F.lit(ROOT))
    pairs = F.transform("x", lambda y, j: F.struct((y["i"] + 1).alias("i"), digest("o", top, F.get("inner", j)).alias("top")))
    return rows.select("conv", F.explode(pairs).alias("y")).select("conv", "y.i", "y.top")


def paths(turns: DataFrame) -> DataFrame:
    """(conv, seg, blocks) with (k, parent, line, bytes) of each block: ``line`` has the ids of its turns' nodes."""
    seg = F.floor((F.col("at") - 1) / (BLOCK * SEGMENT)).alias("seg")
    rows = written(turns.groupBy("conv", seg).agg(F.array_sort(F.collect_list(F.struct("at", "d", "bytes"))).alias("x")), "segments")
    most = rows.agg(F.max("seg")).first()[0] or 0
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size("x") - 1) / BLOCK).cast("int")), lambda b: F.slice("x", b * BLOCK + 1, F.lit(BLOCK)))
    rows = rows.select("conv", "seg", cut.alias("cut"))
    joined = lambda y: F.array_join(F.transform(y, lambda z: z["d"]), "")
    rows = rows.withColumn("inner", chained(F.transform("cut", lambda y: joined(y))))
    if most:
        whole = rows.where((F.size("cut") == SEGMENT) & (F.size(F.get("cut", F.lit(SEGMENT - 1))) == BLOCK))
        tops = openings(whole.select("conv", F.col("seg").alias("i"), F.get("inner", F.lit(SEGMENT - 1)).alias("d")), most)
        after = tops.select("conv", (F.col("i") - 1).alias("seg"), F.col("top").alias("next"))
        rows = rows.join(tops.withColumnRenamed("i", "seg"), ["conv", "seg"], "left").join(after, ["conv", "seg"], "left").withColumn("top", F.coalesce("top", F.lit(ROOT)))
    else:
        rows = rows.withColumns({"top": F.lit(ROOT), "next": F.lit(None).cast("string")})
    own = lambda b: digest("b", F.col("top"), F.get("inner", b))
    named = lambda b: F.when(b == SEGMENT - 1, F.coalesce("next", own(b))).otherwise(own(b))  # noqa: E731  the last block of a whole segment is what opens the next one

    def block(y: Column, b: Column) -> Column:
        parent = F.when(b == 0, F.col("top")).otherwise(named(b - 1))
        line = F.transform(y, lambda z, j: F.when(j == BLOCK - 1, named(b)).otherwise(digest("t", parent, joined(F.slice(y, F.lit(1), j + 1)))))
        return F.struct((F.col("seg") * SEGMENT + b).alias("k"), parent.alias("parent"), line.alias("line"), F.transform(y, lambda z: z["bytes"]).alias("bytes"))

    return written(rows.select("conv", "seg", F.transform("cut", block).alias("blocks")), "paths")


def ends_digests(ends: DataFrame) -> DataFrame:
    """(id, ends_sha256) from (id, conv): SHA-256 of each node's members in numerical order, joined by commas.

    Members are joined in runs of 1,024 ids first; a task then reads a node's runs in order and keeps the hash only.
    """
    runs = ends.groupBy("id", F.shiftright("conv", RUN_BITS).alias("run")).agg(F.array_join(F.array_sort(F.collect_list("conv")), ",").alias("piece"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, hashed = None, None
        for b in batches:
            out = []
            for i, piece in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if i == own:
                    hashed.update(b"," + piece.encode())
                else:
                    if own is not None:
                        out.append((own, hashed.hexdigest()))
                    own, hashed = i, hashlib.sha256(piece.encode())
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.string()) for k in (0, 1)], ["id", "ends_sha256"])
        if own is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.string()) for x in (own, hashed.hexdigest())], ["id", "ends_sha256"])

    spark = ends.sparkSession
    with arrow_rows(spark, 500):
        return written(runs.repartition("id").sortWithinPartitions("id", "run").select("id", "piece").mapInArrow(run, "id string, ends_sha256 string"), "ends")


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row for each distinct start of the conversations (conv of ``convs``; conv, at, d, bytes of ``turns``), from the
    textless root: its smallest member, depth, the smallest member of its parent, members, children, childless nodes of the
    subtree, bytes that the subtree's members share, and the digest of the members that end there.

    Conversations without turns are members of the root only. Without any conversation there is no node.
    """
    c = F.col
    way = paths(turns)
    flat = way.select("conv", F.explode("blocks").alias("b")).select("conv", "b.*")
    blocks = written(flat.groupBy("parent", "k", "line", "bytes").agg(F.count(F.lit(1)).alias("n"), F.min("conv").alias("first")), "blocks")
    blocks = group_total(blocks, "parent", F.count(F.lit(1)), "siblings")
    each = F.transform("line", lambda i, j: F.struct(i.alias("id"), F.when(j == 0, c("parent")).otherwise(F.get("line", j - 1)).alias("up"), (c("k") * BLOCK + j + 1).alias("depth"), F.get("bytes", j).alias("bytes"), F.slice("line", F.lit(1), j + 1).alias("line")))
    turn_nodes = blocks.select("n", "first", "siblings", F.explode(each).alias("y")).select("n", "first", "siblings", "y.*")
    same = ["id", "up", "depth", "bytes", "line"]
    plain = turn_nodes.where("siblings = 1").select(*same, "n", "first")
    parted = turn_nodes.where("siblings > 1").groupBy(*same).agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    nodes = written(plain.unionByName(parted), "nodes")

    last = way.select("conv", "seg", F.get(F.get("blocks", F.size("blocks") - 1)["line"], F.size(F.get("blocks", F.size("blocks") - 1)["line"]) - 1).alias("id"))
    last = last.groupBy("conv").agg(F.max_by("id", "seg").alias("id"))
    ends = written(convs.select("conv").join(last, "conv", "left").select("conv", F.coalesce("id", F.lit(ROOT)).alias("id")), "ends")

    children = nodes.groupBy(c("up").alias("id")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(children, "id", "left").withColumns({"n_children": F.coalesce("n_children", F.lit(0)), "w": (c("n") - 1) * c("bytes")})
    nodes = written(nodes.withColumn("leaf", (c("n_children") == 0).cast("long")), "nodes")

    # the smallest member of a parent is that of its children, or one that ends there
    members = nodes.select("id", "up", "first").unionByName(ends.select(F.lit(None).cast("string").alias("id"), c("id").alias("up"), c("conv").alias("first")))
    parents = group_min(members, "up", "first", "parent_conv_id", "first").where("id is not null").select("id", "parent_conv_id")

    below = shares_below(way, nodes)
    subtree = nodes.join(below, "id", "left").select(F.explode("line").alias("id"), (c("w") + F.coalesce("below_w", F.lit(0))).alias("w"), (c("leaf") + F.coalesce("below_leaf", F.lit(0))).alias("leaf"))
    subtree = subtree.groupBy("id").agg(F.sum("w").alias("saved_tokens"), F.sum("leaf").alias("n_leaves"))

    found = nodes.select("id", c("first").alias("conv_id"), "depth", c("n").alias("n_convs"), "n_children").join(parents, "id").join(subtree, "id")
    top = ends.agg(F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    whole = nodes.agg(F.coalesce(F.sum("w"), F.lit(0)).alias("saved_tokens"), F.greatest(F.coalesce(F.sum("leaf"), F.lit(0)), F.lit(1)).alias("n_leaves"), F.count_if(c("depth") == 1).alias("n_children"))
    root = top.join(F.broadcast(whole)).select(F.lit(ROOT).alias("id"), "conv_id", F.lit(0).cast("long").alias("depth"), "n_convs", "n_children", F.lit(None).cast("long").alias("parent_conv_id"), "saved_tokens", "n_leaves")  # one row each
    found = found.unionByName(root).join(ends_digests(ends), "id", "left")
    none = hashlib.sha256(b"").hexdigest()
    return found.select("conv_id", c("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))


def shares_below(way: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, below_w, below_leaf) of each block's end: the shares and childless nodes of all blocks below it.

    Nodes are summed by (smallest member, block); a conversation brings what it owns in later blocks to each of its blocks.
    Later segments of one conversation come by a window over its segments, of 256 turns each.
    """
    c = F.col
    owned = nodes.groupBy(c("first").alias("conv"), F.floor((c("depth") - 1) / BLOCK).alias("k")).agg(F.sum("w").alias("w"), F.sum("leaf").alias("leaf"))
    owned = owned.groupBy("conv", F.floor(c("k") / SEGMENT).alias("seg")).agg(F.collect_list(F.struct("k", "w", "leaf")).alias("own"), F.sum("w").alias("seg_w"), F.sum("leaf").alias("seg_leaf"))
    rows = way.join(owned, ["conv", "seg"], "left")
    after = Window.partitionBy("conv").orderBy(c("seg").desc()).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({f"later_{x}": F.coalesce(F.sum(f"seg_{x}").over(after), F.lit(0)) for x in ("w", "leaf")})
    total = lambda b, x: c(f"later_{x}") + F.coalesce(F.aggregate(F.filter("own", lambda o: o["k"] > b["k"]), F.lit(0).cast("long"), lambda s, o: s + o[x]), F.lit(0))
    each = F.transform("blocks", lambda b: F.struct(F.get(b["line"], F.size(b["line"]) - 1).alias("id"), total(b, "w").alias("w"), total(b, "leaf").alias("leaf")))
    found = rows.select(F.explode(each).alias("y")).select("y.*").where("w <> 0 or leaf <> 0")
    return found.groupBy("id").agg(F.sum("w").alias("below_w"), F.sum("leaf").alias("below_leaf"))


def prefix_trie(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The trie of the conversations of ``df`` as they are (see ``turn_rows`` and ``trie``); other columns play no part, and
    an empty table gives an empty result."""
    turns, convs = turn_rows(df, conv, turn, role, text)
    return trie(turns, convs)


def family_trie(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The trie of the conversations that ``shared_starts`` makes of ``df``."""
    turns, convs = turn_rows(df, conv, turn, role, text)
    turns, convs = written(turns, "numbered"), written(convs, "convs")
    return trie(shared_starts(turns, convs), convs)


CRC_TABLE = [zlib.crc32(bytes([i])) ^ zlib.crc32(b"\0") for i in range(256)]  # differences from the first entry, which is 0

#: The same by DuckDB: every start of every conversation as a list, grouped and compared whole.
ORACLE = f"""WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
  sha256(CAST(strlen(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, ''))) AS i FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY i) AS x FROM t GROUP BY conv_id),
h AS (SELECT conv_id, x, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), [CAST(ascii(y) AS BIGINT) for y in string_split(CAST(conv_id AS VARCHAR), '')]),
  lambda a, b: xor(a // 256, {CRC_TABLE}[xor(a, b) % 256 + 1])), 4294967295) % 9 AS h FROM o),
r AS MATERIALIZED (SELECT h.conv_id, list_concat(coalesce(b.x[1:h.h], []), h.x[h.h + 1:]) AS x FROM h LEFT JOIN o b ON b.conv_id = h.conv_id - h.conv_id % 5),
p AS MATERIALIZED (SELECT conv_id, x[1:d] AS x, d, len(x) = d AS ends FROM (SELECT *, unnest(range(len(x) + 1)) AS d FROM r)),
n AS MATERIALIZED (SELECT x, d, min(conv_id) AS conv_id, count(*) AS n, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '') AS ends FROM p GROUP BY x, d),
k AS MATERIALIZED (SELECT n.*, u.conv_id AS parent, coalesce(c.n, 0) AS children, CASE WHEN n.d = 0 THEN 0 ELSE (n.n - 1) * strlen(n.x[n.d].text) END AS w FROM n
  LEFT JOIN n u ON u.d = n.d - 1 AND u.x = n.x[1:n.d - 1] LEFT JOIN (SELECT x[1:d - 1] AS x, d - 1 AS d, count(*) AS n FROM n WHERE d > 0 GROUP BY ALL) c ON c.d = n.d AND c.x = n.x),
s AS (SELECT x[1:e] AS x, e AS d, sum(w) AS saved, count(*) FILTER (WHERE children = 0) AS leaves FROM (SELECT *, unnest(range(d + 1)) AS e FROM k) GROUP BY 1, 2)
SELECT k.conv_id, k.d AS depth, k.parent AS parent_conv_id, k.n AS n_convs, k.children AS n_children, s.leaves AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(k.ends) AS ends_sha256
FROM k JOIN s ON s.d = k.d AND s.x = k.x"""
