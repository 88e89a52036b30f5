"""Joining per-group statistics back to the rows of their groups, safe for hot groups.

A group that holds a third of all rows would put them into one task of a plain join: adaptive
execution splits a hot key only where a shuffle stands directly below both sides, and here one
side is an aggregate on the join key. So the rows of heavy hitters, and only theirs, are dealt over as many parts of
their group as their count asks for, by a hash of their other columns, and only the statistics of heavy hitters
are repeated, once per part. All other rows join plainly.

Which groups are heavy comes from a count in the statistics' own aggregate, where they are statistics of the rows
that they are joined to (``counted``). Else a frequent-items sketch of the rows' keys tells: ``TRACKED`` counters a
task, merged in two steps, so its size does not grow with the rows or their keys. Either way at most ``HOT_KEYS`` groups
of over ``HOT_ROWS`` rows are named; that table is broadcast. A group that is not named is smaller than all that are,
so it holds less than one ``HOT_KEYS``-th of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Name of the count among the statistics; it is not handed on.
ROWS = "_rows"
#: Rows of a group from which on it is dealt over parts, and the most groups that are.
HOT_ROWS, HOT_KEYS = 100_000, 4_096
#: Counters of the sketch, and groups of tasks whose sketches are merged first.
TRACKED, MERGES = 16_384, 64


def counted(*aggs: Column) -> list[Column]:
    """Aggregates of the rows by group, with the group's count for ``join_stats``."""
    return [*aggs, F.count(F.lit(1)).alias(ROWS)]


def heavy_hitters(rows: DataFrame, keys: list[str], hot_rows: int | None = None) -> DataFrame:
    """``_h`` (hash of the keys), ``_parts``: groups of more than ``hot_rows`` rows, by a sketch."""
    hashed = rows.select(F.xxhash64(*keys).alias("_h"), F.pmod(F.spark_partition_id(), F.lit(MERGES)).alias("_m"))
    some = hashed.groupBy("_m").agg(F.expr(f"approx_top_k_accumulate(_h, {TRACKED})").alias("_s"))
    # grouped by a constant: without rows there is no sketch to ask
    top = some.groupBy(F.lit(0).alias("_one")).agg(F.expr(f"approx_top_k_combine(_s, {TRACKED})").alias("_s")).select(
        F.explode(F.expr(f"approx_top_k_estimate(_s, {HOT_KEYS})")).alias("_t"))
    return _parts(top.select(F.col("_t.item").alias("_h"), F.col("_t.count").alias(ROWS)), hot_rows)


def _parts(counts: DataFrame, hot_rows: int | None) -> DataFrame:
    limit = HOT_ROWS if hot_rows is None else hot_rows
    return counts.where(F.col(ROWS) > limit).select("_h", F.ceil(F.col(ROWS) / limit).cast("int").alias("_parts"))


def join_stats(rows: DataFrame, stats: DataFrame, keys: list[str], how: str = "inner",
               sizes: DataFrame | None = None, hot_rows: int | None = None) -> DataFrame:
    """``rows`` with the columns of ``stats`` (one row per group); ``how`` is ``inner`` or ``left``.

    ``sizes`` is what the sketch reads where ``stats`` has no count: a table that has the rows' keys about as often as
    ``rows`` and is cheaper to read; by default ``rows``. It decides where rows are joined, never with what. The part of a row is a
    function of the row, so a task that runs again deals its rows alike; rows that agree in every column go
    to one part.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"statistics are joined by inner or left, not {how}")
    if ROWS in stats.columns:
        hashed = stats.select(F.xxhash64(*keys).alias("_h"), ROWS)
        hot = _parts(hashed.orderBy(F.col(ROWS).desc(), "_h").limit(HOT_KEYS), hot_rows)
    else:
        hot = heavy_hitters(rows if sizes is None else sizes, keys, hot_rows)
    other = [F.col(c) for c, t in rows.dtypes if c not in keys and not t.startswith("map")]
    part = F.pmod(F.xxhash64(*other), F.col("_parts")) if other else F.lit(0)
    left = rows.withColumn("_h", F.xxhash64(*keys)).join(F.broadcast(hot), "_h", "left") \
        .withColumn("_salt", F.coalesce(part, F.lit(0)).cast("int")).drop("_h", "_parts")
    right = stats.drop(ROWS).withColumn("_h", F.xxhash64(*keys)).join(F.broadcast(hot), "_h", "left") \
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_h", "_parts")
    return left.join(right, [*keys, "_salt"], how).drop("_salt")
