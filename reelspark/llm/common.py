"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, scratch_path

#: Narrow rows that one task writes of a table whose size is known.
ROWS_PER_TASK = 250_000
#: Bits of a filter of keys, at least and at most: 64 KB, and 8 MB as a table of 64-bit words.
LEAST_BITS, MOST_BITS = 1 << 19, 1 << 26


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables; Spark's reader alone opens the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession, rows: int = 2000, mb: int = 32) -> None:
    """Bound what one Arrow batch hands to a Python worker, by rows and by bytes.

    Workers also get this package's folder on their path, for sessions that were started without
    it; on a cluster the package is installed or sent with ``--py-files`` as usual.
    """
    home = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    spark.sparkContext.environment.setdefault("PYTHONPATH", home)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{mb}m")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster's shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return scratch_path(spark, f"llm/{name}-{uuid.uuid4().hex}")


def shared_table(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    This cuts the lineage with a copy that every executor can reach, so a lost executor costs
    only its running tasks. The reread table also carries no partitioning, so that a join with
    it shuffles both sides and adaptive execution may split a hot key. Where at most ``rows`` rows
    are known to come out, they are written by as many tasks as that takes, two a core at least.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    if rows is not None:
        df = df.coalesce(max(2 * spark.sparkContext.defaultParallelism, rows // ROWS_PER_TASK))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def marked(rows: DataFrame, key: Column, keys: DataFrame) -> DataFrame:
    """``rows`` with ``_may``: false only where ``key`` (a 64-bit hash) is not in ``keys`` (one column of such hashes).

    The keys set one bit each in a table of ``MOST_BITS`` bits at most, which is broadcast: its size has that bound whatever
    the keys, and rows that no key can want need no shuffle. Beyond about ``MOST_BITS`` keys it tells less, and is still right.
    """
    keys = keys.toDF("_k").where("_k is not null")
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (16 * keys.count()).bit_length()))
    words = shared_table(
        keys.select(F.pmod("_k", F.lit(bits)).alias("_k")).groupBy(F.floor(F.col("_k") / 64).cast("int").alias("_word"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(_k % 64 as int)))").alias("_bits")).coalesce(8), "key-bits")
    at = F.pmod(key, F.lit(bits))
    return (rows.withColumns({"_word": F.floor(at / 64).cast("int"), "_bit": (at % 64).cast("int")})
            .join(F.broadcast(words), "_word", "left")
            .withColumn("_may", F.coalesce(F.expr("shiftright(_bits, _bit) & 1 = 1"), F.lit(False))).drop("_word", "_bit", "_bits"))
