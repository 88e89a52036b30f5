"""Registered queries: reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import crowd_signal, hybrid_signal, r6
from ..functions.scalar import r6_sql as R
from ..operators import evaluate as ev
from ..operators import features as fe
from ..operators import metrics as mt
from ..operators import reports as rp
from ..operators.salting import join_stats
from ..sources import testbind as tb
from . import q_features as qf
from . import q_splits as qs
from .registry import query


def _r6_all(df, keep):
    return df.select(*keep, *[r6(c).alias(c) if dict(df.dtypes)[c] == "double" else F.col(c)
                              for c in df.columns if c not in keep])


def _rd2(x: str) -> str:
    return f"CAST(round_even(TRY_CAST({x} AS DECIMAL(38,12)), 2) AS DOUBLE)"


X09_SQL = (f"CASE WHEN least(greatest((pred - 1.0) / 9.0, 0.0), 1.0) > 0 THEN "
           f"{_rd2('1.0 + 9.0 * least(greatest((pred - 1.0) / 9.0, 0.0), 1.0)')} END")

QUALITY_SQL = """CASE WHEN abs_diff IS NULL THEN 'no_prediction' WHEN abs_diff <= 0.5 THEN 'excellent'
  WHEN abs_diff <= 1.0 THEN 'good' WHEN abs_diff <= 1.5 THEN 'fair' ELSE 'poor' END"""

REPORT_SQL = f"""{qs.folded_sql()}{qs.OOF_SQL},
pv AS (SELECT r.user_id, r.item_id, r.my_rating, {X09_SQL.replace('pred', 'p.pred')} AS predicted_rating
       FROM ratings r LEFT JOIN pred p ON p.user_id = r.user_id AND p.item_id = r.item_id),
pa AS (SELECT *, abs(my_rating - predicted_rating) AS abs_diff FROM pv),
rep AS (SELECT *, {QUALITY_SQL} AS quality,
          row_number() OVER (PARTITION BY user_id ORDER BY abs_diff ASC NULLS LAST, item_id) AS rb,
          row_number() OVER (PARTITION BY user_id ORDER BY abs_diff DESC NULLS LAST, item_id) AS rw
        FROM pa)"""


def _report(spark, sf_dir):
    preds = qs.hybrid_oof(spark, sf_dir).select("user_id", "item_id", "pred")
    return rp.predictions_vs_actuals(tb.ratings(spark, sf_dir), preds)


@query("prediction_report", tb.with_views(f"""{REPORT_SQL}
SELECT user_id, item_id, my_rating, predicted_rating, {R('abs_diff')} AS abs_diff, quality,
  CAST(CASE WHEN rb <= 10 THEN rb END AS BIGINT) AS best_rank,
  CAST(CASE WHEN rw <= 10 THEN rw END AS BIGINT) AS worst_rank FROM rep""", "items", "ratings"))
def prediction_report(spark, sf_dir):
    """Every rating with its out-of-fold prediction (J03, X09), |error|, quality band
    (X18) and per-user best/worst-10 ranks (T03, W02)."""
    return _r6_all(_report(spark, sf_dir), ["user_id", "item_id", "my_rating", "predicted_rating"])


@query("quality_counts", tb.with_views(f"""{REPORT_SQL}
SELECT quality, CAST(count(*) AS BIGINT) AS cnt,
  {R('count(*) * 100.0 / sum(count(*)) OVER ()')} AS pct FROM rep GROUP BY quality""",
                                       "items", "ratings"))
def quality_counts(spark, sf_dir):
    """Value counts of the quality band with percentages."""
    return _r6_all(rp.value_counts(_report(spark, sf_dir), "quality"), ["quality", "cnt"])


@query("accuracy_summary", tb.with_views(f"""{REPORT_SQL}
SELECT user_id, CAST(count(*) AS BIGINT) AS n,
  {R('sqrt(avg((predicted_rating - my_rating) * (predicted_rating - my_rating)))')} AS rmse,
  {R('avg(abs(predicted_rating - my_rating))')} AS mae,
  {R('corr(CAST(my_rating AS DOUBLE), predicted_rating)')} AS corr,
  {R('avg(my_rating)')} AS mean_actual, {R('avg(predicted_rating)')} AS mean_predicted,
  {R('avg(abs_diff)')} AS mean_abs_diff
FROM rep WHERE predicted_rating IS NOT NULL GROUP BY user_id""", "items", "ratings"))
def accuracy_summary(spark, sf_dir):
    """A08 A09 A14 per user over the prediction report."""
    return _r6_all(rp.accuracy_summary(_report(spark, sf_dir)), ["user_id", "n"])


# ----------------------------------------------------------------------------- M12, A13

WATCH_SQL = """, um AS (SELECT user_id, avg(my_rating) AS m FROM ratings GROUP BY user_id),
wp AS (SELECT c.user_id, c.item_id, i.title_type,
         0.3 * coalesce(um.m, coalesce(i.imdb_rating, 0.0)) + 0.7 * coalesce(i.imdb_rating, 0.0) AS pred
       FROM (SELECT user_id, item_id FROM watchlist w WHERE NOT EXISTS (SELECT 1 FROM ratings r
             WHERE r.user_id = w.user_id AND r.item_id = w.item_id)) c
       LEFT JOIN items i ON i.item_id = c.item_id LEFT JOIN um ON um.user_id = c.user_id)"""


def _watch_preds(spark, sf_dir):
    r, it = tb.ratings(spark, sf_dir), tb.items(spark, sf_dir)
    um = r.groupBy("user_id").agg(F.avg("my_rating").alias("m"))
    cand = tb.watchlist(spark, sf_dir).join(r.select("user_id", "item_id"),
                                             ["user_id", "item_id"], "left_anti")
    meta = it.select("item_id", "title_type", "imdb_rating")
    return (join_stats(cand.join(meta, "item_id", "left"), um, ["user_id"], "left",
                       sizes=tb.watchlist(spark, sf_dir))
            .select("user_id", "item_id", "title_type",
                    hybrid_signal(F.lit(None), F.col("m"), crowd_signal("imdb_rating")).alias("pred")))


@query("watchlist_report", tb.with_views(f"""{WATCH_SQL}
SELECT user_id, item_id, title_type, {R('pred')} AS pred, CAST(rank AS BIGINT) AS rank,
  {X09_SQL} AS predicted_rating
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY pred DESC NULLS LAST, item_id) AS rank
      FROM wp) WHERE rank <= 25""", "items", "ratings", "watchlist"))
def watchlist_report(spark, sf_dir):
    """M12 + T02: top-25 unrated watchlist predictions per user with the X09 rating."""
    w = rp.watchlist_predictions(_watch_preds(spark, sf_dir), 25)
    return w.select("user_id", "item_id", "title_type", r6("pred").alias("pred"), "rank",
                    "predicted_rating")


@query("by_type", tb.with_views(f"""{WATCH_SQL}
SELECT title_type, CAST(count(*) AS BIGINT) AS cnt, {R('avg(pred)')} AS mean_pred
FROM wp GROUP BY title_type""", "items", "ratings", "watchlist"))
def by_type(spark, sf_dir):
    """Watchlist predictions per title type."""
    return _r6_all(rp.by_type(_watch_preds(spark, sf_dir)), ["title_type", "cnt"])


@query("prediction_summary", tb.with_views(f"""{WATCH_SQL}
SELECT user_id, count(*) AS n, {R('avg(pred)')} AS mean_pred, {R('max(pred)')} AS max_pred,
  {R('min(pred)')} AS min_pred FROM wp GROUP BY user_id""", "items", "ratings", "watchlist"))
def prediction_summary(spark, sf_dir):
    """Count, mean, max and min of every user's watchlist predictions."""
    return _watch_preds(spark, sf_dir).groupBy("user_id").agg(
        F.count("*").alias("n"), r6(F.avg("pred")).alias("mean_pred"),
        r6(F.max("pred")).alias("max_pred"), r6(F.min("pred")).alias("min_pred"))


# ----------------------------------------------------------------------------- M09

@query("model_overlap", tb.with_views(f"""{WATCH_SQL},
a AS (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY {R('pred')} DESC,
        item_id) AS rank FROM wp),
b AS (SELECT w.user_id, w.item_id, row_number() OVER (PARTITION BY w.user_id
        ORDER BY coalesce(i.imdb_rating, 0.0) DESC, w.item_id) AS rank
      FROM wp w LEFT JOIN items i ON i.item_id = w.item_id),
j AS (SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.item_id, b.item_id) AS item_id,
        CAST(a.rank AS BIGINT) AS rank_a, CAST(b.rank AS BIGINT) AS rank_b
      FROM (SELECT * FROM a WHERE rank <= 10) a
      FULL OUTER JOIN (SELECT * FROM b WHERE rank <= 10) b
        ON a.user_id = b.user_id AND a.item_id = b.item_id)
SELECT j.*, rank_a IS NOT NULL AND rank_b IS NOT NULL AS in_both,
  CAST(sum(CAST(rank_a IS NOT NULL AND rank_b IS NOT NULL AS INT)) OVER (PARTITION BY user_id) AS BIGINT)
    AS overlap
FROM j""", "items", "ratings", "watchlist"))
def model_overlap(spark, sf_dir):
    """Top-10 of the hybrid scorer vs top-10 of the crowd-only scorer per user."""
    from ..operators.ranking import top_k_per_group
    wp = _watch_preds(spark, sf_dir)
    a = top_k_per_group(wp.withColumn("s", r6("pred")), 10, ["user_id"],
                        [F.col("s").desc(), F.col("item_id")])
    crowd = wp.join(tb.items(spark, sf_dir).select("item_id", "imdb_rating"), "item_id", "left") \
        .withColumn("s", F.coalesce("imdb_rating", F.lit(0.0)))
    b = top_k_per_group(crowd, 10, ["user_id"], [F.col("s").desc(), F.col("item_id")])
    return rp.model_overlap(a, b)


# ----------------------------------------------------------------------------- A10, A11

@query("feature_corr", tb.with_views(f"""{qf.RI_CTE}{qf.base_sql('ri', 'ri', 'b')}{qf._std_sql('b')},
lf AS ({qf._features_long_sql('b', 'ri', 'st')}),
t AS (SELECT user_id, item_id, CAST(my_rating AS DOUBLE) AS y FROM ri),
g AS (SELECT CAST(count(*) AS DOUBLE) AS n, sum(y) AS sy, sum(y * y) AS syy FROM t),
s AS (SELECT feature, sum(value) AS sx, sum(value * value) AS sxx, sum(value * y) AS sxy
      FROM lf JOIN t USING (user_id, item_id) GROUP BY feature),
c AS (SELECT feature, CASE WHEN sxx - sx * sx / n > 0 AND syy - sy * sy / n > 0
        THEN (sxy - sx * sy / n) / sqrt((sxx - sx * sx / n) * (syy - sy * sy / n)) END AS corr
      FROM s CROSS JOIN g)
SELECT feature, {R('corr')} AS corr FROM c WHERE corr IS NOT NULL
ORDER BY abs(corr) DESC, feature LIMIT 10""", "items", "ratings"))
def feature_corr(spark, sf_dir):
    """A10: top-10 features by |corr| with the rating (absent feature = 0)."""
    ri, ff = qf._research(spark, sf_dir)
    # the target rides along as a key of the long rows, so nothing is joined back
    lf = fe.long_features(ri.withColumn("y", F.col("my_rating")), ff, ("user_id", "item_id", "y"))
    t = ri.select(F.col("my_rating").alias("y"))
    c = rp.feature_target_corr(lf, t)
    return c.select("feature", r6("corr").alias("corr"))


#: The whole matrix without standardisation.
WIDE = fe.with_spec(fe.RESEARCH, standardize=False, numeric=(*fe.NUMERIC, *fe.RAW))


@query("feature_extremes", tb.with_views(f"""{qf.RI_CTE}{qf.base_sql('ri', 'ri', 'b')},
e AS ({qf._features_long_sql('b', 'ri', None)}),
n AS (SELECT count(*) AS n FROM ri),
s AS (SELECT feature, min(value) AS mn, max(value) AS mx, count(*) AS cnt FROM e GROUP BY feature),
r AS (SELECT feature, CASE WHEN cnt < n THEN least(mn, 0.0) ELSE mn END AS min_value,
        CASE WHEN cnt < n THEN greatest(mx, 0.0) ELSE mx END AS max_value FROM s CROSS JOIN n)
SELECT feature, {R('min_value')} AS min_value, {R('max_value')} AS max_value FROM r
WHERE max_value > 1000 OR min_value < -1000""", "items", "ratings"))
def feature_extremes(spark, sf_dir):
    """A11 on every feature of the rated frame before standardisation: numeric, raw columns, one-hots, genres, directors."""
    ri = qf.rated_items(spark, sf_dir)
    x = rp.feature_extremes(fe.long_features(ri, fe.fit(ri, WIDE)), ri.count())
    return x.select("feature", r6("min_value").alias("min_value"), r6("max_value").alias("max_value"))


# ----------------------------------------------------------------------------- A19, F07

PROFILE_COLS = ["my_rating", "year", "imdb_rating", "num_votes", "runtime"]


@query("data_profile", tb.with_views(f"""{qf.RI_CTE}
, one AS (SELECT count(*) AS rows, count_if(imdb_rating > 9.5) AS crowd_over_9_5,
   count_if(num_votes > 1000000) AS votes_over_1m, count_if(year > 2025) AS future_year FROM ri)
""" + "\nUNION ALL\n".join(
    f"""SELECT CAST(one.rows AS BIGINT) AS rows, CAST(one.crowd_over_9_5 AS BIGINT) AS crowd_over_9_5,
  CAST(one.votes_over_1m AS BIGINT) AS votes_over_1m, CAST(one.future_year AS BIGINT) AS future_year,
  '{c}' AS "column", CAST(count({c}) AS BIGINT) AS non_null, CAST(count_if({c} IS NULL) AS BIGINT) AS nulls,
  min(CAST({c} AS DOUBLE)) AS min, max(CAST({c} AS DOUBLE)) AS max, {R(f'avg(CAST({c} AS DOUBLE))')} AS mean,
  {R(f'stddev_samp(CAST({c} AS DOUBLE))')} AS std
FROM ri CROSS JOIN one GROUP BY one.rows, one.crowd_over_9_5, one.votes_over_1m, one.future_year"""
    for c in PROFILE_COLS), "items", "ratings"))
def data_profile(spark, sf_dir):
    """A19 + F07 over the rated frame."""
    p = rp.data_profile(qf.rated_items(spark, sf_dir), PROFILE_COLS)
    return p.select(*[c for c in p.columns if c not in ("mean", "std")],
                    r6("mean").alias("mean"), r6("std").alias("std"))


# ----------------------------------------------------------------------------- M07, M08

_CROWD_METRICS_SQL = ((qs.RATING_METRICS_SQL + qs.RANKING_SQL).replace(", rm AS", ", rm_c AS").replace("FROM pred ", "FROM pred_c ")
                      .replace("FROM pred)", "FROM pred_c)").replace(", sv AS", ", sv_c AS").replace("FROM sv)", "FROM sv_c)")
                      .replace("FROM sv GROUP", "FROM sv_c GROUP").replace("rk AS (", "rk_c AS (").replace("FROM rk ", "FROM rk_c ")
                      .replace("top AS (", "top_c AS (").replace("JOIN top p", "JOIN top_c p").replace("tot AS (", "tot_c AS (")
                      .replace("FROM tot t", "FROM tot_c t").replace("um AS (", "um_c AS ("))
_SIX = ("rmse", "mae", "r2", "precision_at_10", "recall_at_10", "ndcg_at_10")


@query("model_comparison", tb.with_views(f"""{qs.folded_sql()}{qs.OOF_SQL}{qs.FOLD_METRICS_SQL}
, pred_c AS (SELECT f.*, coalesce(i.imdb_rating, 0.0) AS pred FROM folded f LEFT JOIN items i USING (item_id))
{_CROWD_METRICS_SQL}
, fm_c AS (SELECT 'crowd' AS model, rm_c.fold, rm_c.rmse, rm_c.mae, rm_c.r2, u.precision_at_10, u.recall_at_10, u.ndcg_at_10
  FROM rm_c FULL OUTER JOIN (SELECT fold, avg(precision_at_10) AS precision_at_10, avg(recall_at_10) AS recall_at_10,
    avg(ndcg_at_10) AS ndcg_at_10 FROM um_c GROUP BY fold) u ON u.fold = rm_c.fold)
, all_fm AS (SELECT model, fold, {", ".join(_SIX)} FROM fm UNION ALL SELECT model, fold, {", ".join(_SIX)} FROM fm_c)
SELECT model, CAST(count(*) AS BIGINT) AS n_folds, CAST(count(rmse) AS BIGINT) AS valid_folds,
  {", ".join(f"{R(f'avg({m})')} AS mean_{m}, {R(f'coalesce(stddev_samp({m}), 0.0)')} AS std_{m}" for m in _SIX)}
FROM all_fm GROUP BY model""", "items", "ratings"))
def model_comparison(spark, sf_dir):
    """M07 + M08: hybrid (out-of-fold user mean + crowd) against the crowd-only scorer under the
    same stratified 5-fold split, all six metrics with mean and std over the valid folds."""
    f, it = qs.folded(spark, sf_dir), tb.items(spark, sf_dir)
    hy = ev.fold_metrics(ev.holdout_hybrid(f, it), "hybrid")
    cr = ev.fold_metrics(f.join(it.select("item_id", "imdb_rating"), "item_id", "left")
                         .withColumn("pred", F.coalesce("imdb_rating", F.lit(0.0))), "crowd")
    cols = ["model", "fold", *_SIX]
    s = mt.fold_summary(hy.select(*cols).unionByName(cr.select(*cols)), metrics=list(_SIX))
    return _r6_all(s, ["model", "n_folds", "valid_folds"])
