"""MinHash near-duplicates by a multi-index Hamming join.

A document's set of five-word shingles has a signature of K symbols of 16 bits, each the low bits of a minimum. The
signature is cut into chunks; by the pigeonhole principle two signatures that differ in at most
``K / CHUNK * (ERRORS + 1) - 1`` symbols have a chunk with at most ERRORS errors. For every chunk and every choice of
ERRORS positions, the other positions are hashed to a key: all pairs under that distance share a key. With K = 24,
chunks of 4 and 2 errors the distance is 17, and a pair of similarity 0.75 (mean distance 6) lies above it with a
probability of 4e-7. Pairs that share a key must also be near in a longer signature of SKETCH symbols of 2 bits, which
tells apart documents that only share a common passage, and after the first pass in a wide one, which has the minima of
each of BINS parts of a set: eight times the symbols for the same hashing. They are then confirmed on their full sets.

Groups may be large, so not all pairs of a key are tried: a hub of each key is compared with the others, what is linked
becomes one component, and only keys that still hold several components go on, with GROWTH times as many hubs each
round; from the third on, shingles that no other component has are left out of the bound of what two nodes share, and
once keys are small, all their rows are hubs, which ends the search. A pair is tried under the first key that it shares only. It is left out only when both are in one component already, or were
compared. A first pass over few keys joins most of a large group, whose other keys then hold one component and go no
further.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import group_min, small_batches, written

SHINGLE = 5
K = 24
CHUNK = 4
ERRORS = 2
SALTS = 64
#: Hubs of a key from one round to the next.
GROWTH = 16
#: Symbols of 2 bits for the pair filter. A pair of similarity 0.75 differs in 24 of them; more than MOST has a
#: probability of 2e-7.
SKETCH = 128
MOST = 48
#: Parts of a set by the highest bits of its shingles, each with SKETCH symbols in the wide sketch, for sets of WIDE_FROM
#: shingles or more, whose parts are about alike. A pair of similarity 0.75 differs in 192 of the symbols; more than
#: WIDE_MOST has a probability of 2e-7.
BINS = 8
WIDE_FROM = 128
WIDE_MOST = 266
#: Rows of a key that meet its hubs in one task part, and pairs that are compared at once there.
PART_ROWS = 1024
PAIRS_AT_ONCE = 1 << 17
#: Shingles whose minima are taken at once: what a processor's cache holds.
AT_ONCE = 1 << 15
_RNG = np.random.default_rng(20_240_601)
_MUL = _RNG.integers(1, 2**63, SKETCH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_XOR = _RNG.integers(0, 2**63, SKETCH, dtype=np.uint64) * np.uint64(2)
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Columns of a node: chunks of the signature, parts of the sketch; each is a long.
CHUNKS = [f"g{i}" for i in range(K // CHUNK)]
PARTS = [f"s{i}" for i in range(SKETCH // 32)]
WIDE = [f"w{i}" for i in range(BINS * SKETCH // 32)]
PLACES = list(combinations(range(CHUNK), CHUNK - ERRORS))
#: Keys of a first pass, which joins most of a large group before all keys are made.
PILOT = (0, 2 * len(PLACES), 4 * len(PLACES))


def words(text: str | None) -> list[bytes]:
    """Lower-cased (A to Z only) runs without white space (9 to 13 and 32)."""
    return (text or "").encode().lower().split()


def rolled(h: np.ndarray, size: int) -> np.ndarray:
    """A hash for each ``size`` neighbours of ``h``."""
    out = np.full(len(h) - size + 1, size, np.uint64)
    for i in range(size):
        out = (out ^ h[i : i + len(out)]) * _MIX
        out ^= out >> np.uint64(29)
    return out


def shingle_sets(texts: list[str | None], size: int = SHINGLE) -> list[np.ndarray]:
    """The distinct shingles of each text as sorted 64-bit hashes; fewer than ``size`` words are one shingle, none give
    none. Each distinct word of all the texts is hashed once."""
    found = [words(x) for x in texts]
    every = list(chain.from_iterable(found))
    hashes = {w: xxhash.xxh3_64_intdigest(w) for w in set(every)}
    h = np.fromiter(map(hashes.__getitem__, every), np.uint64, len(every))
    whole = rolled(h, size) if len(h) >= size else h[:0]
    sets, at = [], 0
    for n in map(len, found):
        sets.append(np.unique(whole[at : at + n - size + 1]) if n >= size else rolled(h[at : at + n], n) if n else h[:0])
        at += n
    return sets


def minima(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The mixed minima of each set (none of them empty) under SKETCH hash functions: of whole sets (sets, SKETCH), and of
    their BINS parts (sets, BINS * SKETCH)."""
    low = np.full((len(sets) * BINS, SKETCH), np.iinfo(np.uint64).max, np.uint64)
    first = 0
    while first < len(sets):
        last, total = first, 0
        while last < len(sets) and (last == first or total + len(sets[last]) <= AT_ONCE):
            total += len(sets[last])
            last += 1
        flat = np.concatenate(sets[first:last])
        # sets are sorted, so that the parts of each lie one after another
        part = np.repeat(np.arange(first, last), list(map(len, sets[first:last]))) * BINS + (flat // np.uint64(2**64 // BINS)).astype(np.int64)
        starts = np.concatenate([[0], np.flatnonzero(part[1:] != part[:-1]) + 1])
        for k in range(SKETCH):
            low[part[starts], k] = np.minimum.reduceat((flat ^ _XOR[k]) * _MUL[k], starts)
        first = last
    parts = low.reshape(len(sets), BINS, SKETCH)
    return mixed(parts.min(axis=1)), mixed(parts.reshape(len(sets), BINS * SKETCH))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


def signatures(low: np.ndarray) -> np.ndarray:
    """16 bits of the first K minima, four in a long: (sets, K / 4)."""
    return np.ascontiguousarray((low[:, :K] >> np.uint64(48)).astype("<u2")).view("<i8")


def sketches(low: np.ndarray) -> np.ndarray:
    """2 bits of each of the minima, 32 in a long: (sets, minima / 32)."""
    bits = (low & np.uint64(3)) << (np.arange(low.shape[1], dtype=np.uint64) * np.uint64(2) % np.uint64(64))
    return np.bitwise_or.reduce(bits.reshape(len(low), -1, 32), axis=2).view(np.int64)


def signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def shingle_rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, n, node, print, chunks and parts) for each row: set size, the set's 64-bit hash (none for an empty set), the
    text's own hash, which is that of Spark's xxhash64, its signature and its sketches."""
    small_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    longs = [*CHUNKS, *PARTS, *WIDE]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            sets = shingle_sets(texts)
            n = np.fromiter(map(len, sets), np.int64, len(sets))
            full = np.flatnonzero(n)
            node, own = np.zeros(len(sets), np.int64), np.zeros((len(sets), len(longs)), np.int64)
            if len(full):
                low, parts = minima([sets[i] for i in full])
                own[full] = np.concatenate([signatures(low), sketches(low), sketches(parts)], axis=1)
                node[full] = [signed(xxhash.xxh3_64_intdigest(sets[i].tobytes())) for i in full]
            prints = [signed(xxhash.xxh64_intdigest((x or "").encode(), 42)) for x in texts]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n), pa.array(node, mask=n == 0), pa.array(prints, pa.int64()), *(pa.array(np.ascontiguousarray(c)) for c in own.T)],
                ["id", "n", "node", "print", *longs],
            )

    kinds = ", ".join(f"{c} long" for c in longs)
    return docs.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInArrow(run, f"id {kind}, n long, node long, print long, {kinds}")


def key_marks(nodes: DataFrame, numbers: list[int]) -> DataFrame:
    """(key, number, node, root, c): for each chunk and each choice of positions that must agree, a hash of these."""
    masks = [sum(0xFFFF << 16 * i for i in p) for p in PLACES]
    part = lambda n: F.col(CHUNKS[n // len(PLACES)]).bitwiseAND(F.lit(signed(masks[n % len(PLACES)])).cast("long"))
    keys = [F.struct(F.xxhash64(F.lit(n), part(n)).alias("key"), F.lit(n).alias("number")) for n in numbers]
    return nodes.select(F.explode(F.array(*keys)).alias("k"), "node", "root", F.col("n").alias("c")).select("k.key", "k.number", "node", "root", "c")


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The (a, b) of ``pairs`` (hub, node) whose full sets have 100 * intersection >= percent * union. ``texts``: (node,
    text). A hub's text goes once to each task part that compares it, before those of its partners."""
    salted = pairs.select("hub", "node", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int").alias("salt"))
    others = salted.join(texts, "node").select("hub", "salt", F.col("node").alias("other"), "text")
    own = salted.select("hub", "salt").distinct().join(texts.withColumnRenamed("node", "hub"), "hub").select("hub", "salt", F.lit(None).cast("long").alias("other"), "text")
    dealt = own.unionByName(others).repartition("hub", "salt").sortWithinPartitions("hub", "salt", F.col("other").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub_set = np.empty(0, np.uint64)
        for batch in batches:
            a, b, texts = batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()
            good = []
            for other, s in zip(b, shingle_sets(texts), strict=True):
                if other is None:
                    hub_set = s
                    good.append(False)
                    continue
                both = np.concatenate([hub_set, s])
                both.sort(kind="stable")  # two sorted runs
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                good.append(100 * common >= percent * (len(both) - common))
            low, high = ([f(x, y) for x, y, g in zip(a, b, good, strict=True) if g] for f in (min, max))
            yield pa.RecordBatch.from_arrays([pa.array(low, pa.int64()), pa.array(high, pa.int64())], ["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def starred(edges: DataFrame) -> DataFrame:
    """One step of alternating stars: ``edges`` (u, v), u > v, that connect the same nodes with fewer steps, written."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    large = group_min(both, "u", "v", "m", salt_on="v").withColumn("m", F.least("m", "u"))
    e = large.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    small = group_min(e, "u", "v", "m", salt_on="v")
    ends = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))
    return written(small.select(F.explode(ends).alias("x")).select("x.*").where("u <> v").distinct(), "stars")


def downward(edges: DataFrame) -> DataFrame:
    """Edges (a, b) as distinct (u, v), u > v, written."""
    return written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")


def named(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest neighbour of each node that has a smaller one. After the last step this is the smallest
    node of its component, before that some node of it."""
    return edges.groupBy("u").agg(F.min("v").alias("v")).toDF("node", "root")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of ``edges`` (u, v), u > v, but the roots themselves: the smallest node of their
    component, by steps of alternating stars until nothing changes."""
    print_of = lambda x: tuple(x.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    now = print_of(edges)
    while now[0]:
        edges = starred(edges)
        before, now = now, print_of(edges)
        if before == now:
            break
    return named(edges)


def multiple(rows: DataFrame) -> DataFrame:
    """The rows of keys with two components or more, with their key's number of rows as ``size`` and its least node as
    ``lead``. Counting combines before the shuffle, and a key with most of the rows meets one row only, so that Spark can
    split it."""
    several = rows.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("size"), F.min("node").alias("lead")).where("lo <> hi")
    return rows.drop("size", "lead").join(several.select("key", "size", "lead"), "key")


def hub_choice(hubs: int) -> Column:
    """Whether a row of ``multiple`` is a hub: its key's lead, and others by their hash, about ``hubs`` in all, or every row
    of a key of up to ``hubs``. The row itself tells, so that hubs are neither gathered nor joined back."""
    rate = F.ceil(F.col("size") / hubs)
    return (F.col("node") == F.col("lead")) | (F.lit(hubs > 1) & (F.pmod(F.xxhash64("node", F.lit(hubs)), rate) == 0))


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Symbols of 2 bits in which the rows of ``a`` and ``b`` differ."""
    x = (a ^ b).view(np.uint64)
    return np.bitwise_count((x | x >> np.uint64(1)) & np.uint64(0x5555555555555555)).sum(axis=1, dtype=np.int64)


def first_shared(a: np.ndarray, b: np.ndarray, numbers: list[int]) -> np.ndarray:
    """The first of the key ``numbers`` that two signatures share; -1 if there is none."""
    same = ((a ^ b).view("<u2") == 0).reshape(len(a), len(CHUNKS), CHUNK)
    shared = np.stack([same[:, n // len(PLACES), list(PLACES[n % len(PLACES)])].all(axis=1) for n in numbers], axis=1)
    return np.where(shared.any(axis=1), np.asarray(numbers)[shared.argmax(axis=1)], -1)


#: Columns of a row of a key, before its signature and sketches.
ROW = ["key", "salt", "other", "node", "root", "c", "number", "n"]


def near_pairs(x: np.ndarray, hubs: np.ndarray, first: np.ndarray, last: np.ndarray, numbers: list[int], percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hub, node) of rows ``x`` and the rows ``first`` to ``last`` of ``hubs`` that may be linked. Columns: ROW, CHUNKS,
    PARTS and WIDE or nothing."""
    of = {c: i for i, c in enumerate(ROW)}
    g, p = len(ROW), len(ROW) + len(CHUNKS)
    w = p + len(PARTS)
    total = np.cumsum(last - first)
    at = 0
    while at < len(x):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS_AT_ONCE, "right")))
        many = (last - first)[at:end]
        i = np.repeat(np.arange(at, end), many)
        j = np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many) + first[i]
        # two hubs of a key meet twice: once is enough
        is_hub = np.zeros(len(x), bool)
        is_hub[i[x[i, of["node"]] == hubs[j, of["node"]]]] = True
        ok = (x[i, of["root"]] != hubs[j, of["root"]]) & (~is_hub[i] | (hubs[j, of["node"]] < x[i, of["node"]]))
        ok &= (100 + percent) * np.minimum(x[i, of["c"]], hubs[j, of["c"]]) >= percent * (x[i, of["n"]] + hubs[j, of["n"]])
        i, j = i[ok], j[ok]
        ok = differing(x[i, p:w], hubs[j, p:w]) <= MOST
        i, j = i[ok], j[ok]
        if x.shape[1] > w:
            ok = (np.minimum(x[i, of["n"]], hubs[j, of["n"]]) < WIDE_FROM) | (differing(x[i, w:], hubs[j, w:]) <= WIDE_MOST)
            i, j = i[ok], j[ok]
        if len(i):
            ok = first_shared(x[i, g:p], hubs[j, g:p], numbers) == x[i, of["number"]]
            yield hubs[j[ok], of["node"]], x[i[ok], of["node"]]
        at = end


def hub_pairs(rows: DataFrame, nodes: DataFrame, numbers: list[int], hub: Column, percent: int, wide_sketch: bool) -> DataFrame:
    """Pairs (hub, node) of each key's rows that are a ``hub`` with its nodes of other components, whose sizes and sketches
    allow a link, under the first key that both share. ``rows``: (key, number, node, root, c, size, lead), c being a bound
    of what a node may have in common with another. Keys of many rows are parted; their hubs go to each part."""
    of_node = ["n", *CHUNKS, *PARTS, *(WIDE if wide_sketch else [])]
    columns = ["key", "salt", "other", "node", "root", "c", "number", *of_node]
    parts = F.ceil(F.col("size") / PART_ROWS).cast("int")
    own = rows.where(hub).withColumn("salt", F.explode(F.sequence(F.lit(0), parts - 1))).withColumn("other", F.lit(0))
    others = rows.withColumn("salt", F.pmod(F.xxhash64("node"), parts).cast("int")).withColumn("other", F.lit(1))
    met = own.unionByName(others).join(nodes.select("node", *of_node), "node")
    dealt = met.select(*(F.col(c).cast("long") for c in columns)).repartition("key", "salt").sortWithinPartitions("key", "salt", "other")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.empty((0, len(columns)), np.int64)  # hubs of the part that the batch before ended in
        for batch in batches:
            y = np.concatenate([known, np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)])
            part = np.cumsum((y[1:, :2] != y[:-1, :2]).any(axis=1)) if len(y) else y[:, 0]
            part = np.concatenate([[0], part])[: len(y)]
            is_hub = y[:, 2] == 0
            h, x, at = y[is_hub], y[~is_hub], part[is_hub]
            first, last = (np.searchsorted(at, part[~is_hub], side) for side in ("left", "right"))
            known = h[at == part[-1]] if len(y) else h
            low = high = np.empty(0, np.int64)
            found = list(near_pairs(x, h, first, last, numbers, percent))
            if found:
                low, high = (np.concatenate(y) for y in zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(low), pa.array(high)], ["hub", "node"])

    return dealt.mapInArrow(run, "hub long, node long")


def small_keys(rows: DataFrame, hubs: int) -> bool:
    """Whether all pairs within the keys of ``rows`` are no more than the next round would meet, and the copies of the hubs
    for the parts of a key no more than the rows."""
    n, squares = rows.agg(F.count("*"), F.sum(F.col("size").cast("double"))).first()
    return squares <= min(GROWTH * hubs, PART_ROWS) * n


def supported(rows: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """``rows`` with c, how many of a node's shingles a node of another component in ``rows`` has, too; nodes that cannot
    have a link for want of them go. What is left unlinked in a large group mostly owes it to words of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = shingle_sets(b.column(2).to_pylist())
            at = pa.array(np.repeat(np.arange(len(sets)), list(map(len, sets))))
            flat = np.concatenate([np.empty(0, np.uint64), *sets]).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(flat)], ["node", "root", "shingle"])

    left = rows.select("node", "root").distinct().join(texts, "node").select("node", "root", "text")
    every = written(left.mapInArrow(run, "node long, root long, shingle long"), "support")
    shared = every.groupBy("shingle").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("shingle")
    counts = every.join(shared, "shingle", "left_semi").groupBy("node").agg(F.count("*").cast("int").alias("c"))
    sizes = every.groupBy("node").agg(F.count("*").alias("size"))
    able = counts.join(sizes, "node").where(100 * F.col("c") >= percent * F.col("size")).select("node", "c")
    return rows.drop("c").join(able, "node").select(*rows.columns)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 75) -> DataFrame:
    """(key, n_shingles, component_id, kept) for each row of ``docs``.

    Rows are linked where 100 * intersection >= ``percent`` * union of their sets of five-word shingles;
    component_id is the smallest key of all rows that links lead to, kept is key = component_id. Texts without words,
    and null texts, are linked with nothing; very long texts are compared whole. Repeated rows are linked like other
    copies; rows with a null key are linked with rows of the same set only. An empty table gives an empty result.
    Other columns are not read, whatever their names.
    """
    rows = written(shingle_rows(docs, key, text), "shingles")
    # one node for each distinct set
    full = rows.where("node is not null")
    own = written(group_min(full.select("id", "n", "node", "print"), "node", "id", "_least", salt_on="id"), "nodes")
    one = written(full.select("node", F.col("n").cast("int").alias("n"), *CHUNKS, *PARTS, *WIDE).dropDuplicates(["node"]), "sets")
    edges = linked(docs, key, text, own, one, None, PILOT, percent, 2)
    edges = linked(docs, key, text, own, one, edges, range(len(CHUNKS) * len(PLACES)), percent)
    nodes = own.select("id", "n", "node", "_least")
    if edges is None:
        done = nodes.withColumn("component_id", F.col("_least"))
    else:
        found = nodes.join(components(edges), "node", "left").withColumn("root", F.coalesce("root", "node"))
        done = group_min(found, "root", "_least", "component_id", salt_on="id")
    done = done.select("id", "n", "component_id")
    empty = rows.where("node is null").select("id", "n", F.col("id").alias("component_id"))
    every = done.unionByName(empty)
    return every.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def node_texts(docs: DataFrame, key: str, text: str, own: DataFrame, buckets: DataFrame) -> DataFrame:
    """(node, text) of the nodes that share a key with another."""
    wanted = own.where(F.col("id").eqNullSafe(F.col("_least"))).join(buckets.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.min(F.struct("id", "print")).alias("x"))
    wanted = wanted.select("node", "x.id", "x.print")
    found = docs.select(F.col(key).alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("print"))
    return written(found.join(wanted, found["id"].eqNullSafe(wanted["id"]) & (found["print"] == wanted["print"])).select("node", "text").dropDuplicates(["node"]), "texts")


def linked(docs: DataFrame, key: str, text: str, own: DataFrame, nodes: DataFrame, edges: DataFrame | None, numbers: Sequence[int], percent: int, rounds: int | None = None) -> DataFrame | None:
    """Edges (u, v) that connect what is linked, from ``edges`` on, by the keys ``numbers``: all links, or those found in
    ``rounds``. None if no two nodes share a key.

    Each round takes one step of alternating stars only: nodes of one component that do not have the same name yet are
    merely compared again.
    """
    rooted = nodes.withColumn("root", F.col("node")) if edges is None else nodes.join(named(edges), "node", "left").withColumn("root", F.coalesce("root", "node"))
    buckets = written(multiple(key_marks(rooted, list(numbers))), "buckets")
    if buckets.isEmpty():
        return edges
    texts = node_texts(docs, key, text, own, buckets)
    hubs, wide_sketch, last = 1 if edges is None else GROWTH, False, False
    while True:
        hub = F.lit(True) if last else hub_choice(hubs)
        pairs = hub_pairs(buckets, nodes, list(numbers), hub, percent, wide_sketch)
        links = downward(confirmed(written(pairs, "pairs"), texts, percent))
        edges = links if edges is None else links.unionByName(edges)
        if last:
            return edges.distinct()
        edges = starred(edges)
        rounds = rounds and rounds - 1
        if rounds == 0:
            return edges
        rest = buckets.where(~hub).drop("root").join(named(edges), "node", "left")
        buckets = written(multiple(rest.select("key", "number", "node", F.coalesce("root", "node").alias("root"), "c")), "buckets")
        if buckets.isEmpty():
            return edges
        hubs *= GROWTH
        if hubs >= GROWTH**2:
            wide_sketch = True
            buckets = written(multiple(supported(buckets, texts, percent)), "buckets")
            if buckets.isEmpty():
                return edges
            last = small_keys(buckets, hubs)


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 75) -> DataFrame:
    """``docs`` with one row of each group: that with the smallest key. Rows with a null key are never dropped."""
    gone = near_duplicates(docs, key, text, percent).where("not kept").select(key).distinct()
    return docs.join(gone, key, "left_anti")


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: All pairs that share a shingle, without signatures; components by spreading every id over the links.
ORACLE = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i : array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c, any_value(a.n) + any_value(b.n) AS n FROM x a JOIN x b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE 100 * c >= 75 * (n - c)),
r AS (SELECT doc_id, doc_id AS root FROM s UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.doc_id)
SELECT s.doc_id, any_value(len(s.s)) AS n_shingles, min(r.root) AS component_id, s.doc_id = min(r.root) AS kept FROM s JOIN r ON r.doc_id = s.doc_id GROUP BY s.doc_id
"""
