"""Fold assignment: stratified (W03/W04), temporal expanding (W05), plain (W06), 80/20.

All splits are per user and deterministic: the shuffle order is ``md5(seed ‖ ':' ‖ item_id)``
(same hex in every engine), ties broken by ``item_id``.

Exact per-group row numbers without one task per group
------------------------------------------------------
A plain ``row_number() over (partition by user_id …)`` sends every row of a user to one task;
a user holding a third of the data would stall the job. :func:`position_in_group` instead splits
crowded groups into *ordered buckets* — a prefix of the md5 (or the rating date), which is
monotone in the sort order — and computes

    pos = (rows of the group in earlier buckets) + row_number() within (group, bucket)

Which groups are crowded comes from a sketch of the keys; all others are one bucket, without
counts. The bucket counts are a partial ``groupBy`` of the crowded groups' rows, their running
sum is a window over that small count table, and the only full-data window is partitioned by
(group, bucket), i.e. a hot user is spread over up to 4,096 tasks, and rows are shuffled once. The result is
identical to the single window.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import EVEN_EDGES, EVEN_LABELS, STRAT_EDGES
from .salting import heavy_hitters, join_stats

#: Rows of a group from which on it is numbered in buckets, and of a user in a month from which on the month is in finer ones.
CROWDED = 100_000


def shuffle_key(seed: int, id_col: str = "item_id") -> Column:
    """Deterministic pseudo-random order: md5 of ``seed:id`` as hex text."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


def position_in_group(df: DataFrame, by: list[str], bucket: Column, order: list[Column],
                      pos_col: str = "pos", n_col: str = "n", crowded: int | None = None) -> DataFrame:
    """Exact 1-based position of each row within ``by`` under ``(bucket, order…)`` ascending,
    plus the group size; ``bucket`` must be monotone in the order (see module doc). NULL keys and
    buckets are groups of their own: no row is lost. Groups of up to ``crowded`` rows are one bucket."""
    hot = heavy_hitters(df, by, CROWDED if crowded is None else crowded).select("_h", F.lit(True).alias("_hot"))
    # a struct, as its equality is null-safe: one shuffle by it serves the windows and the join
    part = F.struct(*by, F.when(F.col("_hot"), bucket).alias("_in"))
    b = (df.withColumn("_h", F.xxhash64(*by)).join(F.broadcast(hot), "_h", "left")
         .select(part.alias("_bk"), "_hot", *[c for c in df.columns if c not in by]))
    counts = b.where("_hot").groupBy("_bk").agg(F.count("*").alias("_c"))
    group = Window.partitionBy(*[F.col("_bk")[c] for c in by])
    offs = counts.select("_bk", (F.sum("_c").over(group.orderBy(F.col("_bk")["_in"])) - F.col("_c")).alias("_off"),
                         F.sum("_c").over(group).alias("_n"))
    rows = Window.partitionBy("_bk")
    # shuffled before the order is computed: an md5 text is wider than the rest of a row
    r = (b.drop("_hot").repartition("_bk").withColumn("_local", F.row_number().over(rows.orderBy(*order)))
         .withColumn("_size", F.count("*").over(rows)).join(offs, "_bk", "left"))
    return r.select(*[F.col("_bk")[c].alias(c) if c in by else F.col(c) for c in df.columns],
                    (F.coalesce("_off", F.lit(0)) + F.col("_local")).cast("bigint").alias(pos_col),
                    F.coalesce("_n", "_size").alias(n_col))


def md5_bucket(key: Column, hex_digits: int = 3) -> Column:
    """Leading hex digits of an md5 text as an int: monotone in the text order."""
    return F.conv(F.substring(key, 1, hex_digits), 16, 10).cast("int")


def order_prefix(c: str, df: DataFrame) -> Column:
    """A coarse key monotone in ``c``'s order: ``floor(c / 4096)`` for numbers, the first three
    characters for text."""
    numeric = dict(df.dtypes)[c] in ("bigint", "int", "smallint", "tinyint", "double", "float")
    return F.floor(F.col(c) / 4096) if numeric else F.substring(F.col(c), 1, 3)


def rating_bin(rating: Column, edges=STRAT_EDGES, labels=None) -> Column:
    """``pd.cut(include_lowest=True)``: bin i holds (edges[i], edges[i+1]], the first also
    holds edges[0]. Returns the label (default: bin index)."""
    labels = labels or list(range(len(edges) - 1))
    out = F.when(rating.isNull(), F.lit(None))
    for i in range(len(edges) - 1):
        lo, hi = edges[i], edges[i + 1]
        cond = (rating >= lo) & (rating <= hi) if i == 0 else (rating > lo) & (rating <= hi)
        out = out.when(cond, F.lit(labels[i]))
    return out.cast("int")


def stratified_folds(ratings: DataFrame, k: int = 5, seed: int = 42, edges=STRAT_EDGES,
                     labels=None, by: tuple[str, ...] = ("user_id",)) -> DataFrame:
    """Within each (user, rating bin), rows in md5 order are dealt round-robin into
    ``k`` folds, so every fold holds the same share of each bin."""
    key = shuffle_key(seed)
    df = ratings.withColumn("rating_bin", rating_bin(F.col("my_rating"), edges, labels))
    p = position_in_group(df, [*by, "rating_bin"], md5_bucket(key), [key, F.col("item_id")])
    return p.withColumn("fold", ((F.col("pos") - 1) % k).cast("int")).drop("pos", "n")


def even_bin_folds(ratings: DataFrame, k: int = 5, seed: int = 42) -> DataFrame:
    """As W03 with bins (0,2],(2,4],(4,6],(6,8],(8,10] labelled 1,3,5,7,9."""
    return stratified_folds(ratings, k, seed, EVEN_EDGES, EVEN_LABELS)


def plain_folds(ratings: DataFrame, k: int = 3, seed: int = 42) -> DataFrame:
    """Shuffled k-fold per user (md5 order dealt round-robin)."""
    key = shuffle_key(seed)
    p = position_in_group(ratings, ["user_id"], md5_bucket(key), [key, F.col("item_id")])
    return p.withColumn("fold", ((F.col("pos") - 1) % k).cast("int")).drop("pos", "n")


def split_train_validation(ratings: DataFrame, val_frac: float = 0.2, seed: int = 42) -> DataFrame:
    """Per user, the first ``ceil(val_frac·n)`` rows in md5 order are validation."""
    key = shuffle_key(seed)
    p = position_in_group(ratings, ["user_id"], md5_bucket(key), [key, F.col("item_id")])
    is_val = F.col("pos") <= F.ceil(F.lit(val_frac) * F.col("n"))
    return p.withColumn("split", F.when(is_val, "validation").otherwise("train")) \
        .drop("pos", "n")


def temporal_folds(ratings: DataFrame, k: int = 5, date_col: str = "rated_at") -> DataFrame:
    """Expanding-window folds per user in date order (ties by item id).

    With ``n`` rows and ``t = n div (k+1)``, fold ``i`` tests positions
    ``[n − (k−i)·t, n − (k−i−1)·t)`` (0-based) and trains on every earlier row. Each row gets
    ``pos`` (0-based), ``test_fold`` (NULL for rows never tested) and ``first_train_fold`` —
    the first fold whose training set contains it; rows with ``t = 0`` get neither.
    """
    # Ordered bucket: the month, and inside crowded months the date and an item-id prefix. Both are
    # monotone in (date, item_id), so a user with many ratings in a month, or on one day, is still
    # numbered across tasks, while the table of counts has a row per user and month.
    month = F.trunc(F.col(date_col), "month")
    crowded = (ratings.groupBy("user_id", month.alias("_month")).agg(F.count("*").alias("_n"))
               .where(F.col("_n") > CROWDED).select("user_id", "_month", F.lit(True).alias("_crowded")))
    rows = join_stats(ratings.withColumn("_month", month), crowded, ["user_id", "_month"], "left")
    fine = F.when(F.col("_crowded"), F.struct(F.col(date_col).alias("d"), order_prefix("item_id", ratings).alias("p")))
    p = position_in_group(rows, ["user_id"], F.struct(F.col("_month"), fine), [F.col(date_col), F.col("item_id")])
    n, t = F.col("n"), F.floor(F.col("n") / (k + 1))
    pos0 = F.col("pos") - 1
    start = n - k * t
    test = F.when((t > 0) & (pos0 >= start), F.floor((pos0 - start) / t))
    first_train = F.when(t > 0, F.when(pos0 < start, F.lit(0))
                         .otherwise(F.floor((pos0 - start) / t) + 1))
    first_train = F.when(first_train < k, first_train)
    return p.select(*ratings.columns, pos0.cast("bigint").alias("pos"), n.cast("bigint").alias("n"),
                    test.cast("int").alias("test_fold"),
                    first_train.cast("int").alias("first_train_fold"))


def temporal_ranges(tfolds: DataFrame, k: int = 5, by: tuple[str, ...] = ("user_id",), date_col: str = "rated_at") -> DataFrame:
    """What each temporal fold trains and tests on: ``by``, ``fold``, ``n_train``, ``train_start``, ``train_end``,
    ``n_test``, ``test_start``, ``test_end``.

    ``tfolds``: rows of :func:`temporal_folds`. Rows are aggregated by the block they lie in (block 0 trains all folds, block
    j + 1 is tested by fold j); a fold's training part is the running total over at most ``k`` blocks of a group.
    """
    block = F.coalesce(F.col("test_fold") + 1, F.lit(0))
    blocks = (tfolds.where(F.col("test_fold").isNotNull() | F.col("first_train_fold").isNotNull())
              .groupBy(*by, block.alias("fold")).agg(F.count("*").alias("n"), F.min(date_col).alias("lo"), F.max(date_col).alias("hi")))
    before = Window.partitionBy(*by).orderBy("fold").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.select(
        *by, (F.col("fold") - 1).cast("int").alias("fold"), F.sum("n").over(before).alias("n_train"),
        F.min("lo").over(before).alias("train_start"), F.max("hi").over(before).alias("train_end"),
        F.col("n").alias("n_test"), F.col("lo").alias("test_start"), F.col("hi").alias("test_end")).where("fold >= 0")
