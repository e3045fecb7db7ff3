"""Small helpers that the operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch: texts are kilobytes each, so the default of 10,000 would hold too much at once.
BATCH_ROWS = 1000


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """At most ``rows`` rows in one Arrow batch of the jobs that run inside."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Lower the rows of an Arrow batch, so that a Python worker holds a few megabytes of text."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a local one only where it is unset and Spark runs
    in one process."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = spark.conf.get("sextant.shared.dir", None)
    if not at:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
        spark.conf.set("sextant.shared.dir", at)
        spark.sparkContext.setCheckpointDir(at)
    return at


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores after it until no column of ``df`` is called so (Spark compares names without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: cuts lineage, survives a lost executor."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1, F.lit(False))


def group_min(df: DataFrame, key: str, value: str, out: str, salt_on: str, salts: int = 64) -> DataFrame:
    """``df`` with the smallest ``value`` of its ``key`` group in ``out``, safe for a key with most of the rows.

    Rows are aggregated per (key, salt) first and then per key. The join back is on (key, salt), for the salts that
    occur, so that a hot key is spread over ``salts`` tasks and the small side never exceeds the rows of ``df``.
    The salt stays as ``_salt``; ``key`` must not be null.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(salt_on), F.lit(salts)).cast("int"))
    parts = salted.groupBy(key, "_salt").agg(F.min(value).alias("_least"))
    least = parts.groupBy(key).agg(F.min("_least").alias(out), F.collect_list("_salt").alias("_salts"))
    spread = least.select(key, out, F.explode("_salts").alias("_salt"))
    return salted.join(spread, [key, "_salt"])


def group_total(df: DataFrame, key: str, total_parts: Column, out: str, salts: int = 64) -> DataFrame:
    """``df`` with ``out``, the total of its ``key`` group, nulls being one group: as ``group_min``, safe for a hot key.

    ``total_parts`` is a sum or a count over the rows of one (key, salt); the salt is a row's place in the scan.
    """
    salt, one, same = (fresh(df, x) for x in ("_salt", "_part", "_same"))
    salted = df.withColumn(salt, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(salts)).cast("int"))
    parts = salted.groupBy(key, salt).agg(total_parts.alias(one))
    totals = parts.groupBy(F.col(key).alias(same)).agg(F.sum(one).alias(out), F.collect_list(salt).alias(salt))
    spread = totals.select(same, out, F.explode(salt).alias(one))
    return salted.join(spread, F.col(key).eqNullSafe(F.col(same)) & (F.col(salt) == F.col(one))).drop(salt, one, same)
