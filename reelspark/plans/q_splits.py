"""Registered queries: splits (W03–W07), metrics (A08, R01–R03), CV summaries, baselines,
grid analysis."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.constants import EVEN_EDGES, EVEN_LABELS, STRAT_EDGES
from ..functions.scalar import clip_rating, r6
from ..functions.scalar import r6_sql as R
from ..operators import evaluate as ev
from ..operators import metrics as mt
from ..operators import splits as sp
from ..operators.salting import join_stats
from ..sources import testbind as tb
from .registry import query

K, SEED = 5, 42


# ----------------------------------------------------------------------------- SQL builders

def _bin_sql(x: str, edges, labels=None) -> str:
    labels = labels or list(range(len(edges) - 1))
    parts = []
    for i in range(len(edges) - 1):
        lo, hi = edges[i], edges[i + 1]
        cond = f"{x} >= {lo} AND {x} <= {hi}" if i == 0 else f"{x} > {lo} AND {x} <= {hi}"
        parts.append(f"WHEN {cond} THEN {labels[i]}")
    return f"CAST(CASE {' '.join(parts)} END AS INT)"


def _key_sql(seed: int) -> str:
    return f"md5('{seed}:' || CAST(item_id AS VARCHAR))"


def folded_sql(k=K, seed=SEED, edges=STRAT_EDGES, labels=None, name="folded") -> str:
    return f""", {name} AS (
  SELECT user_id, item_id, my_rating, rated_at, rating_bin,
    CAST((row_number() OVER (PARTITION BY user_id, rating_bin
          ORDER BY {_key_sql(seed)}, item_id) - 1) % {k} AS INT) AS fold
  FROM (SELECT *, {_bin_sql('my_rating', edges, labels)} AS rating_bin FROM ratings))"""


OOF_SQL = """, uf AS (SELECT user_id, fold, sum(my_rating) AS s, count(my_rating) AS c
           FROM folded GROUP BY user_id, fold),
ut AS (SELECT user_id, sum(s) AS ts, sum(c) AS tc FROM uf GROUP BY user_id),
oof AS (SELECT uf.user_id, uf.fold,
          CASE WHEN ut.tc - uf.c > 0 THEN (ut.ts - uf.s) / (ut.tc - uf.c) END AS train_mean
        FROM uf JOIN ut ON ut.user_id = uf.user_id),
pred AS (SELECT f.*, i.imdb_rating,
           0.3 * coalesce(o.train_mean, coalesce(i.imdb_rating, 0.0))
           + 0.7 * coalesce(i.imdb_rating, 0.0) AS pred
         FROM folded f JOIN oof o ON o.user_id = f.user_id AND o.fold = f.fold
         LEFT JOIN items i ON i.item_id = f.item_id)"""

EVAL_SQL = "least(greatest(least(greatest((pred - 1.0) / 9.0, 0.0), 1.0) * 3.0 + 5.5, 1.0), 10.0)"

RATING_METRICS_SQL = f""", rm AS (
  SELECT fold, CAST(count(*) AS BIGINT) AS n,
    sqrt(avg(({EVAL_SQL} - my_rating) * ({EVAL_SQL} - my_rating))) AS rmse,
    avg(abs({EVAL_SQL} - my_rating)) AS mae,
    CASE WHEN var_pop(my_rating) * count(*) > 0 THEN
      1 - sum(({EVAL_SQL} - my_rating) * ({EVAL_SQL} - my_rating)) / (var_pop(my_rating) * count(*))
    END AS r2
  FROM pred WHERE my_rating IS NOT NULL GROUP BY fold)"""

RANKING_SQL = f""", sv AS (SELECT user_id, item_id, fold, my_rating, {R('pred')} AS score FROM pred),
rk AS (SELECT *, row_number() OVER (PARTITION BY user_id, fold ORDER BY score DESC NULLS LAST,
          item_id) AS r FROM sv),
top AS (SELECT user_id, fold, count(*) AS nrec, sum(CAST(my_rating >= 8 AS INT)) AS hits,
          sum(CASE WHEN my_rating >= 8 THEN 1.0 / log2(r + 1) ELSE 0.0 END) AS dcg
        FROM rk WHERE r <= 10 GROUP BY user_id, fold),
tot AS (SELECT user_id, fold, sum(CAST(my_rating >= 8 AS INT)) AS nrel FROM sv GROUP BY user_id, fold),
um AS (SELECT t.user_id, t.fold,
  CASE WHEN t.nrel > 0 AND coalesce(p.nrec > 0, false) THEN p.hits / least(10, p.nrec) ELSE 0.0 END
    AS precision_at_10,
  CASE WHEN t.nrel > 0 AND coalesce(p.nrec > 0, false) THEN p.hits / t.nrel ELSE 0.0 END AS recall_at_10,
  CASE WHEN t.nrel > 0 AND coalesce(p.nrec > 0, false) THEN p.dcg /
    list_sum(list_transform(range(1, CAST(least(10, t.nrel) AS BIGINT) + 1), lambda i: 1.0 / log2(i + 1)))
    ELSE 0.0 END AS ndcg_at_10
  FROM tot t LEFT JOIN top p ON p.user_id = t.user_id AND p.fold = t.fold)"""

FOLD_METRICS_SQL = f"""{RATING_METRICS_SQL}{RANKING_SQL},
fm AS (SELECT 'hybrid' AS model, rm.fold, rm.n, rm.rmse, rm.mae, rm.r2, u.precision_at_10,
         u.recall_at_10, u.ndcg_at_10
       FROM rm FULL OUTER JOIN (SELECT fold, avg(precision_at_10) AS precision_at_10,
            avg(recall_at_10) AS recall_at_10, avg(ndcg_at_10) AS ndcg_at_10 FROM um GROUP BY fold) u
       ON u.fold = rm.fold)"""


def _summary_sql(pop: bool, src: str = "fm") -> str:
    sd = "stddev_pop" if pop else "stddev_samp"
    cols = ", ".join(f"{R(f'avg({m})')} AS mean_{m}, {R(f'coalesce({sd}({m}), 0.0)')} AS std_{m}"
                     for m in mt.METRICS)
    return f"""SELECT model, CAST(count(*) AS BIGINT) AS n_folds,
  CAST(count(rmse) AS BIGINT) AS valid_folds, {cols} FROM {src} GROUP BY model"""


# ----------------------------------------------------------------------------- Spark bindings

def folded(spark, sf_dir, k=K, seed=SEED):
    """Stratified fold assignment, computed once per dataset and (k, seed) and then scanned by
    every CV query — folds are assigned first, before any statistic is taken."""
    return tb.materialized(spark, sf_dir, f"folds_strat_k{k}_s{seed}",
                           lambda: sp.stratified_folds(tb.ratings(spark, sf_dir), k, seed))


def hybrid_oof(spark, sf_dir):
    return ev.holdout_hybrid(folded(spark, sf_dir), tb.items(spark, sf_dir))


def hybrid_fold_metrics(spark, sf_dir):
    return ev.fold_metrics(hybrid_oof(spark, sf_dir), "hybrid")


def _r6_all(df, keep):
    return df.select(*keep, *[r6(c).alias(c) for c in df.columns if c not in keep])


# ----------------------------------------------------------------------------- W03–W07

@query("fold_stratified", tb.with_views(f"""{folded_sql()}
SELECT user_id, item_id, my_rating, rating_bin, fold FROM folded""", "ratings"))
def fold_stratified(spark, sf_dir):
    return folded(spark, sf_dir).select("user_id", "item_id", "my_rating", "rating_bin", "fold")


@query("fold_even_bins", tb.with_views(f"""{folded_sql(edges=EVEN_EDGES, labels=EVEN_LABELS)}
SELECT user_id, item_id, my_rating, rating_bin, fold FROM folded""", "ratings"))
def fold_even_bins(spark, sf_dir):
    f = sp.even_bin_folds(tb.ratings(spark, sf_dir), K, SEED)
    return f.select("user_id", "item_id", "my_rating", "rating_bin", "fold")


@query("fold_temporal", tb.with_views(f"""
, p AS (SELECT user_id, item_id, rated_at,
          row_number() OVER (PARTITION BY user_id ORDER BY rated_at, item_id) - 1 AS pos,
          count(*) OVER (PARTITION BY user_id) AS n FROM ratings),
q AS (SELECT *, n // {K + 1} AS t, n - {K} * (n // {K + 1}) AS st FROM p),
f AS (SELECT *, CASE WHEN t > 0 AND pos >= st THEN (pos - st) // t END AS tf,
        CASE WHEN t > 0 THEN (CASE WHEN pos < st THEN 0 ELSE (pos - st) // t + 1 END) END AS ff
      FROM q)
SELECT user_id, item_id, rated_at, CAST(pos AS BIGINT) AS pos, CAST(n AS BIGINT) AS n,
  CAST(tf AS INT) AS test_fold, CAST(CASE WHEN ff < {K} THEN ff END AS INT) AS first_train_fold
FROM f""", "ratings"))
def fold_temporal(spark, sf_dir):
    t = sp.temporal_folds(tb.ratings(spark, sf_dir), K)
    return t.select("user_id", "item_id", "rated_at", "pos", "n", "test_fold", "first_train_fold")


@query("fold_plain", tb.with_views(f"""
SELECT user_id, item_id, CAST((row_number() OVER (PARTITION BY user_id
  ORDER BY {_key_sql(SEED)}, item_id) - 1) % 3 AS INT) AS fold FROM ratings""", "ratings"))
def fold_plain(spark, sf_dir):
    return sp.plain_folds(tb.ratings(spark, sf_dir), 3, SEED).select("user_id", "item_id", "fold")


@query("split_80_20", tb.with_views(f"""
SELECT user_id, item_id, CASE WHEN row_number() OVER (PARTITION BY user_id
  ORDER BY {_key_sql(SEED)}, item_id) <= ceil(0.2 * count(*) OVER (PARTITION BY user_id))
  THEN 'validation' ELSE 'train' END AS split FROM ratings""", "ratings"))
def split_80_20(spark, sf_dir):
    return sp.split_train_validation(tb.ratings(spark, sf_dir)).select("user_id", "item_id", "split")


# ----------------------------------------------------------------------------- A08, R01–R03

@query("metrics_rating", tb.with_views(f"""{folded_sql()}{OOF_SQL}{RATING_METRICS_SQL}
SELECT fold, n, {R('rmse')} AS rmse, {R('mae')} AS mae, {R('r2')} AS r2 FROM rm""",
                                       "items", "ratings"))
def metrics_rating(spark, sf_dir):
    """Out-of-fold hybrid predictions of each fold's validation ratings."""
    p = hybrid_oof(spark, sf_dir)
    pairs = p.select("fold", F.col("my_rating").cast("double").alias("y"),
                     mt.eval_prediction(F.col("pred")).alias("p"))
    return _r6_all(mt.rating_metrics(pairs, ["fold"]), ["fold", "n"])


@query("metrics_ranking", tb.with_views(f"""{folded_sql()}{OOF_SQL}{RANKING_SQL}
SELECT user_id, fold, {R('precision_at_10')} AS precision_at_10, {R('recall_at_10')} AS recall_at_10,
  {R('ndcg_at_10')} AS ndcg_at_10 FROM um""", "items", "ratings"))
def metrics_ranking(spark, sf_dir):
    """F06 J09 R01 R02 R03 per (user, fold)."""
    p = hybrid_oof(spark, sf_dir).select("user_id", "item_id", "fold", "my_rating",
                                         r6("pred").alias("score"))
    return _r6_all(mt.ranking_metrics(p, ["user_id", "fold"]), ["user_id", "fold"])


@query("cv_summary", tb.with_views(f"""{folded_sql()}{OOF_SQL}{FOLD_METRICS_SQL}
{_summary_sql(False)}""", "items", "ratings"))
def cv_summary(spark, sf_dir):
    """Mean and sample std of the six fold metrics."""
    s = mt.fold_summary(hybrid_fold_metrics(spark, sf_dir))
    return _r6_all(s, ["model", "n_folds", "valid_folds"])


@query("cv_summary_pop", tb.with_views(f"""{folded_sql()}{OOF_SQL}{FOLD_METRICS_SQL}
{_summary_sql(True)}""", "items", "ratings"))
def cv_summary_pop(spark, sf_dir):
    """The scripts' population std."""
    s = mt.fold_summary(hybrid_fold_metrics(spark, sf_dir), pop=True)
    return _r6_all(s, ["model", "n_folds", "valid_folds"])


# ----------------------------------------------------------------------------- A20, A18

BASELINE_SQL = """, fs AS (SELECT fold, sum(my_rating) AS s, count(my_rating) AS c FROM folded GROUP BY fold),
tt AS (SELECT sum(my_rating) AS ts, count(my_rating) AS tc FROM folded),
gm AS (SELECT fs.fold, CASE WHEN tt.tc - fs.c > 0 THEN (tt.ts - fs.s) / (tt.tc - fs.c) END AS train_mean
       FROM fs CROSS JOIN tt),
base AS (SELECT f.fold, gm.train_mean,
           sqrt(avg((gm.train_mean - f.my_rating) * (gm.train_mean - f.my_rating))) AS rmse
         FROM folded f JOIN gm ON gm.fold = f.fold GROUP BY f.fold, gm.train_mean)"""


def _baseline(spark, sf_dir):
    return ev.mean_predictor(folded(spark, sf_dir))


@query("baseline_mean", tb.with_views(f"""{folded_sql()}{BASELINE_SQL}
SELECT fold, {R('train_mean')} AS train_mean, {R('rmse')} AS rmse FROM base""", "ratings"))
def baseline_mean(spark, sf_dir):
    """The training-fold mean as the prediction for every validation rating."""
    return _r6_all(_baseline(spark, sf_dir), ["fold"])


@query("improvement", tb.with_views(f"""{folded_sql()}{BASELINE_SQL}{OOF_SQL},
hy AS (SELECT fold, sqrt(avg((least(greatest(pred, 1.0), 10.0) - my_rating)
                            * (least(greatest(pred, 1.0), 10.0) - my_rating))) AS rmse
       FROM pred GROUP BY fold),
agg AS (SELECT (SELECT avg(rmse) FROM base) AS baseline_rmse, (SELECT avg(rmse) FROM hy) AS model_rmse)
SELECT {R('baseline_rmse')} AS baseline_rmse, {R('model_rmse')} AS model_rmse,
  {R('(baseline_rmse - model_rmse) / baseline_rmse * 100.0')} AS improvement_pct FROM agg""",
                                   "items", "ratings"))
def improvement(spark, sf_dir):
    """Percent RMSE improvement of the clipped hybrid over the mean predictor."""
    base = _baseline(spark, sf_dir).agg(F.avg("rmse").alias("baseline_rmse"))
    e = clip_rating(F.col("pred")) - F.col("my_rating")
    hy = (hybrid_oof(spark, sf_dir).groupBy("fold").agg(F.sqrt(F.avg(e * e)).alias("rmse"))
          .agg(F.avg("rmse").alias("model_rmse")))
    # two single-row aggregates side by side: a join on a constant key, one row each
    j = base.withColumn("_k", F.lit(1)).join(hy.withColumn("_k", F.lit(1)), "_k")
    return j.select(r6("baseline_rmse").alias("baseline_rmse"), r6("model_rmse").alias("model_rmse"),
                    r6(mt.improvement(F.col("baseline_rmse"), F.col("model_rmse")))
                    .alias("improvement_pct"))


# ----------------------------------------------------------------------------- T04, A17

W_USER = [0.5, 0.6, 0.7, 0.8, 0.9]
CROWD_FILL = [0.0, 6.5]


def grid_rows(spark, sf_dir):
    """CV grid of the hybrid scorer over (w_user, crowd_fill): one row per combination with
    the mean and population std of fold RMSE and mean R². The parameter grid is a fixed
    literal array exploded per row — data × 10 settings in one pass, no join."""
    f = folded(spark, sf_dir)
    m = ev.out_of_fold_user_mean(f)
    grid = F.array(*[F.struct(F.lit(w).alias("w_user"), F.lit(c).alias("crowd_fill"))
                     for w in W_USER for c in CROWD_FILL])
    j = (join_stats(f, m, ["user_id", "fold"]).join(tb.items(spark, sf_dir).select("item_id", "imdb_rating"),
                                                    "item_id", "left")
         .select("fold", "my_rating", "train_mean", "imdb_rating", F.explode(grid).alias("g"))
         .select("fold", "my_rating", "g.w_user", "g.crowd_fill", "train_mean", "imdb_rating"))
    crowd = F.coalesce(F.col("imdb_rating"), F.col("crowd_fill"))
    w = F.col("w_user")
    pred = (1 - w) * F.coalesce(F.col("train_mean"), crowd) + w * crowd
    pairs = j.select("w_user", "crowd_fill", "fold", F.col("my_rating").cast("double").alias("y"),
                     clip_rating(pred).alias("p"))
    per_fold = mt.rating_metrics(pairs, ["w_user", "crowd_fill", "fold"])
    return per_fold.groupBy("w_user", "crowd_fill").agg(
        F.avg("rmse").alias("rmse_mean"), F.stddev_pop("rmse").alias("rmse_std"),
        F.avg("r2").alias("r2_mean"))


GRID_SQL = f"""{folded_sql()}, uf AS (SELECT user_id, fold, sum(my_rating) AS s, count(my_rating) AS c
           FROM folded GROUP BY user_id, fold),
ut AS (SELECT user_id, sum(s) AS ts, sum(c) AS tc FROM uf GROUP BY user_id),
oof AS (SELECT uf.user_id, uf.fold,
          CASE WHEN ut.tc - uf.c > 0 THEN (ut.ts - uf.s) / (ut.tc - uf.c) END AS train_mean
        FROM uf JOIN ut ON ut.user_id = uf.user_id),
g AS (SELECT * FROM (VALUES {', '.join(f'({w}, {c})' for w in W_USER for c in CROWD_FILL)}) AS g(w_user, crowd_fill)),
gp AS (SELECT g.w_user, g.crowd_fill, f.fold, CAST(f.my_rating AS DOUBLE) AS y,
         least(greatest((1 - g.w_user) * coalesce(o.train_mean, coalesce(i.imdb_rating, g.crowd_fill))
           + g.w_user * coalesce(i.imdb_rating, g.crowd_fill), 1.0), 10.0) AS p
       FROM folded f JOIN oof o ON o.user_id = f.user_id AND o.fold = f.fold
       LEFT JOIN items i ON i.item_id = f.item_id CROSS JOIN g),
pf AS (SELECT w_user, crowd_fill, fold, sqrt(avg((p - y) * (p - y))) AS rmse,
         CASE WHEN var_pop(y) * count(*) > 0 THEN 1 - sum((p - y) * (p - y)) / (var_pop(y) * count(*)) END AS r2
       FROM gp GROUP BY w_user, crowd_fill, fold),
grid AS (SELECT w_user, crowd_fill, avg(rmse) AS rmse_mean, stddev_pop(rmse) AS rmse_std,
           avg(r2) AS r2_mean FROM pf GROUP BY w_user, crowd_fill),
ranked AS (SELECT *, row_number() OVER (ORDER BY rmse_mean, rmse_std, w_user, crowd_fill) AS rk FROM grid)"""


@query("grid_results", tb.with_views(f"""{GRID_SQL}
SELECT CAST(w_user AS DOUBLE) AS w_user, CAST(crowd_fill AS DOUBLE) AS crowd_fill,
  {R('rmse_mean')} AS rmse_mean, {R('rmse_std')} AS rmse_std, {R('r2_mean')} AS r2_mean,
  CAST(rk AS BIGINT) AS grid_rank FROM ranked""", "items", "ratings"))
def grid_results(spark, sf_dir):
    """Grid rows numbered in (rmse mean, rmse std, params) order; rank 1 is the best."""
    g = grid_rows(spark, sf_dir)
    r = g.withColumn("grid_rank", F.row_number().over(
        Window.orderBy(*mt.grid_order(g, "w_user", "crowd_fill"))).cast("bigint"))
    return _r6_all(r, ["w_user", "crowd_fill", "grid_rank"])


@query("grid_analysis", tb.with_views(f"""{GRID_SQL}
, sides AS (SELECT 'all' AS param, CAST(NULL AS DOUBLE) AS value, * FROM ranked
  UNION ALL SELECT 'w_user', CAST(w_user AS DOUBLE), * FROM ranked UNION ALL SELECT 'crowd_fill', CAST(crowd_fill AS DOUBLE), * FROM ranked),
ga AS (SELECT param, value, min(rmse_mean) AS best_rmse, max(rmse_mean) AS worst_rmse, avg(rmse_mean) AS mean_rmse,
    max(r2_mean) AS best_r2, avg(r2_mean) AS mean_r2, min(rk) AS best_rank, sum(CASE WHEN rk <= 5 THEN 1 ELSE 0 END) AS in_top
  FROM sides GROUP BY param, value)
SELECT param, value, {R('best_rmse')} AS best_rmse, {R('worst_rmse')} AS worst_rmse, {R('mean_rmse')} AS mean_rmse,
  {R('best_r2')} AS best_r2, {R('mean_r2')} AS mean_r2, CAST(best_rank AS BIGINT) AS best_rank, CAST(in_top AS BIGINT) AS in_top,
  param <> 'all' AND row_number() OVER (PARTITION BY param ORDER BY in_top DESC, best_rank) = 1 AS top_mode
FROM ga""", "items", "ratings"))
def grid_analysis(spark, sf_dir):
    """A17 over the hybrid grid, by user weight, by crowd fill and in all."""
    a = mt.grid_analysis(grid_rows(spark, sf_dir), "w_user", "crowd_fill")
    return _r6_all(a, ["param", "value", "best_rank", "in_top", "top_mode"])


# ----------------------------------------------------------------------------- M07 temporal

TEMPORAL_SQL = f"""
, p AS (SELECT user_id, item_id, my_rating, rated_at,
          row_number() OVER (PARTITION BY user_id ORDER BY rated_at, item_id) - 1 AS pos,
          count(*) OVER (PARTITION BY user_id) AS n FROM ratings),
q AS (SELECT *, n // {K + 1} AS t, n - {K} * (n // {K + 1}) AS st FROM p),
tf AS (SELECT *, CASE WHEN t > 0 AND pos >= st THEN (pos - st) // t END AS test_fold,
         CASE WHEN t > 0 THEN (CASE WHEN pos < st THEN 0 ELSE (pos - st) // t + 1 END) END AS ff
       FROM q),
tm AS (SELECT t.user_id, t.test_fold AS fold, avg(r.my_rating) AS train_mean
       FROM (SELECT DISTINCT user_id, test_fold FROM tf WHERE test_fold IS NOT NULL) t
       JOIN tf r ON r.user_id = t.user_id AND r.ff IS NOT NULL AND r.ff < {K} AND r.ff <= t.test_fold
       GROUP BY t.user_id, t.test_fold),
pred AS (SELECT f.user_id, f.item_id, f.my_rating, f.test_fold AS fold,
           0.3 * coalesce(tm.train_mean, coalesce(i.imdb_rating, 0.0)) + 0.7 * coalesce(i.imdb_rating, 0.0) AS pred
         FROM tf f LEFT JOIN tm ON tm.user_id = f.user_id AND tm.fold = f.test_fold
         LEFT JOIN items i ON i.item_id = f.item_id WHERE f.test_fold IS NOT NULL)"""


@query("fold_temporal_ranges", tb.with_views(f"""{TEMPORAL_SQL},
te AS (SELECT user_id, test_fold AS fold, count(*) AS n_test, min(rated_at) AS test_start, max(rated_at) AS test_end
       FROM tf WHERE test_fold IS NOT NULL GROUP BY user_id, test_fold),
tr AS (SELECT te.user_id, te.fold, count(*) AS n_train, min(r.rated_at) AS train_start, max(r.rated_at) AS train_end
       FROM te JOIN tf r ON r.user_id = te.user_id AND r.ff <= te.fold GROUP BY te.user_id, te.fold)
SELECT te.user_id, CAST(te.fold AS INT) AS fold, CAST(n_train AS BIGINT) AS n_train, train_start, train_end,
  CAST(n_test AS BIGINT) AS n_test, test_start, test_end
FROM te JOIN tr ON tr.user_id = te.user_id AND tr.fold = te.fold""", "items", "ratings"))
def fold_temporal_ranges(spark, sf_dir):
    """Size and date range of every temporal fold's training and test part, per user."""
    return sp.temporal_ranges(sp.temporal_folds(tb.ratings(spark, sf_dir), K), K)


@query("cv_temporal", tb.with_views(f"""{TEMPORAL_SQL}{FOLD_METRICS_SQL.replace("'hybrid'", "'hybrid_temporal'")}
{_summary_sql(False)}""", "items", "ratings"))
def cv_temporal(spark, sf_dir):
    """M07 with the temporal strategy: expanding-window folds per user (W05); each fold's
    test rows are scored from earlier rows only; A15 summary."""
    tf = sp.temporal_folds(tb.ratings(spark, sf_dir), K)
    p = ev.holdout_hybrid_temporal(tf, tb.items(spark, sf_dir), K)
    s = mt.fold_summary(ev.fold_metrics(p, "hybrid_temporal"))
    return _r6_all(s, ["model", "n_folds", "valid_folds"])
