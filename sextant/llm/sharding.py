"""Rendezvous (highest random weight) sharding of stable record keys over weighted shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh

SEED = 20_011


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard of ``key``: every shard draws u in (0, 1) from (key, shard), the least -ln(u) / weight wins.

    A shard's draws do not depend on the others, so one more shard takes rows only into itself, in proportion to its
    weight. Shards of weight 0 take nothing. A null key is the empty key.
    """
    if not weights or any(w < 0 for w in weights) or not any(weights):
        raise ValueError("weights must hold a positive number and none below 0")
    name = F.coalesce(key.cast("string"), F.lit(""))
    live = F.array(*[F.struct(F.lit(float(w)).alias("w"), F.lit(i).alias("i")) for i, w in enumerate(weights) if w > 0])

    def draw(x: Column) -> Column:
        u = (F.shiftrightunsigned(F.xxhash64(name, x["i"], F.lit(SEED)), 11) + F.lit(0.5)) / F.lit(float(2**53))
        return F.struct((-F.log(u) / x["w"]).alias("score"), x["i"].alias("shard"))

    return F.array_min(F.transform(live, draw))["shard"]


def slots(df: DataFrame, shard: str, order: Sequence[str], buckets: int = 1024, out: str = "slot") -> DataFrame:
    """``out``: the place of a row in its shard, 0, 1, 2, ... without gaps.

    Rows are numbered inside (shard, hash bucket) and shifted by the rows of the buckets before; a shard is never
    sorted in one task. Rows that agree in all of ``order`` are alike and may swap places.
    """
    bucket, n, start, rank = (fresh(df, x) for x in ("_bucket", "_n", "_start", "_rank"))
    rows = df.withColumn(bucket, F.pmod(F.xxhash64(order[0]), F.lit(buckets)).cast("int"))
    before = Window.partitionBy(shard).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(shard, bucket).agg(F.count(F.lit(1)).alias(n))
    starts = starts.select(shard, bucket, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(start))
    inside = Window.partitionBy(shard, bucket).orderBy(*order)
    ranked = rows.withColumn(rank, F.row_number().over(inside) - 1)
    return ranked.join(starts, [shard, bucket]).withColumn(out, F.col(start) + F.col(rank)).drop(bucket, start, rank)


def shard_records(df: DataFrame, key: str, weights: Sequence[float], grown_weight: float = 1.0, text: str | None = None) -> DataFrame:
    """``df`` with ``shard``, ``slot`` and ``grown_shard`` (the shard after one more of ``grown_weight`` joins).

    Equal keys share a shard; a null key counts as the empty one; an empty table gives an empty result. Columns named
    like an output are replaced.
    """
    rows = df.drop("shard", "grown_shard", "slot").withColumns({"shard": rendezvous(F.col(key), weights), "grown_shard": rendezvous(F.col(key), [*weights, grown_weight])})
    return slots(rows, "shard", [key, *([text] if text else [])])


def write_shards(df: DataFrame, path: str) -> None:
    """One folder for each shard, records in slot order within their files."""
    df.repartition("shard", F.floor(F.col("slot") / 1_000_000)).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
