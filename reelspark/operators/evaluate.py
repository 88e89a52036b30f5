"""Cross-validation of scorers (M07, M08) without replicating the data per fold.

For the hybrid scorer X20 the only training statistic is each user's mean rating over the
*other* folds. With per-(user, fold) sums and counts (a partial groupBy) that mean is
``(Σ_user − Σ_user,fold) / (n_user − n_user,fold)`` — every rating gets its out-of-fold
prediction in one pass, instead of k copies of the training data. Model scorers (ALS, elastic
net) fit once per fold on cached fold frames (see ``models``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import clip_rating, crowd_signal, r6
from . import metrics as mt
from .salting import join_stats


def out_of_fold_user_mean(folded: DataFrame, by: str = "user_id") -> DataFrame:
    """(user, fold) → the user's mean rating over all other folds (NULL if none)."""
    from pyspark.sql import Window
    uf = folded.groupBy(by, "fold").agg(F.sum("my_rating").alias("_s"), F.count("my_rating").alias("_c"))
    every = Window.partitionBy(by)  # over one row per fold of a user
    ut = uf.withColumn("_ts", F.sum("_s").over(every)).withColumn("_tc", F.sum("_c").over(every))
    rest = F.col("_tc") - F.col("_c")
    return ut.select(by, "fold", F.when(rest > 0, (F.col("_ts") - F.col("_s")) / rest).alias("train_mean"))


def mean_predictor(folded: DataFrame) -> DataFrame:
    """Fold → mean rating of all other folds, and its RMSE on the fold.

    From n, Σy and Σy² of each fold alone: Σ(m − y)² = n·m² − 2m·Σy + Σy². No row is joined.
    """
    from pyspark.sql import Window
    y = F.col("my_rating").cast("double")
    f = folded.groupBy("fold").agg(F.sum(y).alias("_s"), F.sum(y * y).alias("_q"), F.count("my_rating").alias("_c"))
    every = Window.partitionBy()  # over one row per fold
    rest = F.sum("_c").over(every) - F.col("_c")
    m = F.when(rest > 0, (F.sum("_s").over(every) - F.col("_s")) / rest)
    sse = F.col("_c") * F.col("train_mean") * F.col("train_mean") - 2 * F.col("train_mean") * F.col("_s") + F.col("_q")
    return (f.withColumn("train_mean", m)
            .select("fold", "train_mean", F.sqrt(F.greatest(F.try_divide(sse, F.col("_c")), F.lit(0.0))).alias("rmse")))


def temporal_user_mean(tfolds: DataFrame, k: int) -> DataFrame:
    """(user, fold) → mean rating of the user's rows that train fold ``fold`` in the expanding
    temporal split (rows with ``first_train_fold <= fold``). From per-(user, block) sums and a
    running sum over at most k blocks per user — no row is copied per fold."""
    from pyspark.sql import Window
    blocks = (tfolds.where(F.col("first_train_fold").isNotNull())
              .groupBy("user_id", F.col("first_train_fold").alias("fold"))
              .agg(F.sum("my_rating").alias("_s"), F.count("my_rating").alias("_c")))
    w = Window.partitionBy("user_id").orderBy("fold").rowsBetween(Window.unboundedPreceding, 0)
    run = blocks.select("user_id", "fold", F.sum("_s").over(w).alias("_rs"),
                        F.sum("_c").over(w).alias("_rc"))
    # blocks 0..k-1 all exist whenever a user has test folds (block 0 holds n − k·t ≥ t rows,
    # block j+1 is test block j), so fold i's training totals are the running sums at block i
    return run.select("user_id", "fold", (F.col("_rs") / F.col("_rc")).alias("train_mean"))


def holdout_hybrid_temporal(tfolds: DataFrame, items: DataFrame, k: int,
                            w_user: float = 0.7, w_crowd: float = 0.3) -> DataFrame:
    """Test rows of each temporal fold with the X20 prediction from earlier rows only."""
    m = temporal_user_mean(tfolds, k)
    crowd = crowd_signal(F.col("imdb_rating"), 0.0)
    test = tfolds.where(F.col("test_fold").isNotNull()).withColumn("fold", F.col("test_fold"))
    return (join_stats(test, m, ["user_id", "fold"], "left")
            .join(items.select("item_id", "imdb_rating"), "item_id", "left")
            .withColumn("pred", w_crowd * F.coalesce(F.col("train_mean"), crowd) + w_user * crowd))


def holdout_hybrid(folded: DataFrame, items: DataFrame, w_user: float = 0.7,
                   w_crowd: float = 0.3, crowd_missing: float = 0.0) -> DataFrame:
    """Out-of-fold X20 prediction ``pred`` for every rated row (the row is unrated to its
    own fold's model): ``w_crowd·train_mean + w_user·crowd``; no training rating → crowd."""
    m = out_of_fold_user_mean(folded)
    crowd = crowd_signal(F.col("imdb_rating"), crowd_missing)
    return (join_stats(folded, m, ["user_id", "fold"], "left")
            .join(items.select("item_id", "imdb_rating"), "item_id", "left")
            .withColumn("pred", w_crowd * F.coalesce(F.col("train_mean"), crowd) + w_user * crowd))


def fold_metrics(pred: DataFrame, model: str, pred_col: str = "pred",
                 mapping=mt.eval_prediction) -> DataFrame:
    """M07 per fold: rating metrics over all validation rows of the fold (prediction passed
    through ``mapping``) and ranking metrics averaged over the fold's users."""
    pairs = pred.select("fold", F.col("my_rating").cast("double").alias("y"),
                        mapping(F.col(pred_col)).alias("p"))
    rm = mt.rating_metrics(pairs, ["fold"])
    scored = pred.select("user_id", "item_id", "fold", "my_rating",
                         r6(F.col(pred_col)).alias("score"))
    rk = mt.ranking_metrics(scored, ["user_id", "fold"]).groupBy("fold").agg(
        *[F.avg(m).alias(m) for m in ("precision_at_10", "recall_at_10", "ndcg_at_10")])
    return rm.join(rk, "fold", "full_outer").select(F.lit(model).alias("model"), "*")


def clipped(pred):
    return clip_rating(pred)
