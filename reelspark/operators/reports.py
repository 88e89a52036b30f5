"""Reports: predictions vs actuals (M11), watchlist predictions (M12), model overlap (M09),
feature diagnostics (A10, A11), data profile (A19, F07), value counts and summaries
(A12–A14). All are aggregations keyed by user or by a small domain (quality band, title type,
feature); per-user orderings use a ``rank <= k`` window (WindowGroupLimit)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import AS_OF
from ..functions.scalar import pred_to_score, quality_band
from .ranking import top_k_per_group


def bround2(x: Column) -> Column:
    """Half-even to 2 places through an exact decimal (engine-independent ties)."""
    return F.bround(x.try_cast("decimal(38,12)"), 2).cast("double")


def score_to_rating(score: Column) -> Column:
    """``1 + 9s`` when s > 0, else NULL, rounded half-even to 2 places."""
    return F.when(score > 0, bround2(1.0 + 9.0 * score))


def predictions_vs_actuals(ratings: DataFrame, preds: DataFrame, k: int = 10) -> DataFrame:
    """J03 left lookup of each rating's prediction (missing stays NULL → no_prediction),
    X09 rating, absolute difference, X18 band, and T03 best/worst-k ranks per user."""
    j = ratings.join(preds, ["user_id", "item_id"], "left")
    pr = score_to_rating(pred_to_score(F.col("pred")))
    d = j.select("user_id", "item_id", "my_rating", pr.alias("predicted_rating"))
    d = d.withColumn("abs_diff", F.abs(F.col("my_rating") - F.col("predicted_rating")))
    d = d.withColumn("quality", quality_band(F.col("abs_diff")))
    # best / worst k per user as two filtered top-k windows (WindowGroupLimit keeps k rows per
    # task and user), joined back on the row key — no unbounded per-user window
    key = ["user_id", "item_id"]
    best = top_k_per_group(d, k, ["user_id"], [F.col("abs_diff").asc_nulls_last(), F.col("item_id")],
                           "best_rank").select(*key, "best_rank")
    worst = top_k_per_group(d, k, ["user_id"], [F.col("abs_diff").desc_nulls_last(), F.col("item_id")],
                            "worst_rank").select(*key, "worst_rank")
    return d.join(best, key, "left").join(worst, key, "left")


def pearson(a: Column, b: Column) -> Column:
    """Pearson correlation; NULL when either side has no spread (ANSI-safe, where the
    built-in ``corr`` would raise on a zero divisor)."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Count and percentage of each value. The total comes from the aggregated rows (one
    per distinct value), so the window runs over a handful of rows."""
    c = df.groupBy(col).agg(F.count("*").cast("bigint").alias("cnt"))
    return c.withColumn("pct", F.col("cnt") * 100.0 / F.sum("cnt").over(Window.partitionBy()))


def accuracy_summary(report: DataFrame, by: list[str] | None = None) -> DataFrame:
    """A08 + A09 + A14 per user: count, RMSE, MAE, Pearson correlation, mean actual, mean
    predicted, mean absolute difference over the rated rows that have a prediction."""
    by = by or ["user_id"]
    d = report.where(F.col("predicted_rating").isNotNull())
    e = F.col("predicted_rating") - F.col("my_rating")
    return d.groupBy(*by).agg(
        F.count("*").cast("bigint").alias("n"),
        F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"),
        pearson(F.col("my_rating").cast("double"), F.col("predicted_rating")).alias("corr"),
        F.avg("my_rating").alias("mean_actual"), F.avg("predicted_rating").alias("mean_predicted"),
        F.avg("abs_diff").alias("mean_abs_diff"))


def watchlist_predictions(watch_preds: DataFrame, k: int = 25) -> DataFrame:
    """M12 + T02: per user, unrated watchlist items by prediction desc (NULLs last), top k,
    with the X09 rating."""
    w = Window.partitionBy("user_id").orderBy(F.col("pred").desc_nulls_last(), "item_id")
    r = F.row_number().over(w)
    return (watch_preds.withColumn("rank", r.cast("bigint")).where(F.col("rank") <= k)
            .withColumn("predicted_rating", score_to_rating(pred_to_score(F.col("pred")))))


def by_type(watch_preds: DataFrame) -> DataFrame:
    """Count and mean prediction per title type, count desc."""
    return (watch_preds.groupBy("title_type")
            .agg(F.count("*").cast("bigint").alias("cnt"), F.avg("pred").alias("mean_pred"))
            .orderBy(F.col("cnt").desc(), F.col("title_type")))


def model_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """Full outer join of two ranked top-k tables on (user, item) with both ranks and the
    per-user overlap count (a partial groupBy joined back)."""
    j = (a.select("user_id", "item_id", F.col("rank").alias("rank_a"))
         .join(b.select("user_id", "item_id", F.col("rank").alias("rank_b")),
               ["user_id", "item_id"], "full_outer"))
    both = (F.col("rank_a").isNotNull() & F.col("rank_b").isNotNull())
    ov = j.groupBy("user_id").agg(F.sum(both.cast("int")).cast("bigint").alias("overlap"))
    return j.withColumn("in_both", both).join(ov, "user_id")


def feature_target_corr(long_df: DataFrame, target: DataFrame, n_rows: int | None = None,
                        top: int = 10) -> DataFrame:
    """A10: Pearson correlation of every feature with the target, where a feature absent from
    a row counts as 0 (long form stores only non-zeros).

    No raw sums of squares: a feature's own rows give count, means and central moments, which Spark merges between tasks
    as such; the rows without it are a second group (x = 0, their mean of y follows from the overall one) that is merged in closed
    form. With n₁ rows of mean (x₁, y₁) out of n and overall mean ȳ, the co-moment grows by x₁(y₁ − ȳ)n₁ and the moment of x by
    x₁²n₁(n − n₁)/n. So large offsets cancel before anything is squared. Undefined correlations are dropped; top ``top`` by
    |corr| (ties by feature name). ``long_df`` carries the target as column ``y`` beside every feature, so nothing is joined;
    rows without a target do not count, and an empty target gives no rows."""
    t = target.select(F.col("y").cast("double").alias("y"))
    g = t.agg(F.count("y").alias("n"), F.avg("y").alias("mean"), F.var_pop("y").alias("var")).first()
    n, mean, m2y = float(g["n"] or 1), g["mean"] or 0.0, (g["var"] or 0.0) * (g["n"] or 0)
    own = long_df.withColumn("y", F.col("y").cast("double")).where(F.col("y").isNotNull())
    s = own.groupBy("feature").agg(F.count("value").cast("double").alias("n1"), F.avg("value").alias("x1"), F.avg("y").alias("y1"),
                                   F.var_pop("value").alias("vx"), F.covar_pop("value", "y").alias("cxy"))
    n1, x1 = F.col("n1"), F.col("x1")
    m2x = F.col("vx") * n1 + x1 * x1 * n1 * (F.lit(n) - n1) / F.lit(n)
    cov = F.col("cxy") * n1 + x1 * (F.col("y1") - F.lit(mean)) * n1
    corr = F.when((m2x > 0) & (F.lit(m2y) > 0), cov / (F.sqrt(m2x) * F.sqrt(F.lit(m2y))))
    c = s.select("feature", corr.alias("corr")).where(F.col("corr").isNotNull())
    return (c.orderBy(F.abs("corr").desc(), F.col("feature")).limit(top))


def feature_extremes(long_df: DataFrame, n_rows: int, bound: float = 1000.0) -> DataFrame:
    """Per feature min and max over all rows (absent → 0 counts when a feature is missing
    from some row) and the features whose range leaves ±bound."""
    s = long_df.groupBy("feature").agg(F.min("value").alias("mn"), F.max("value").alias("mx"),
                                       F.count("*").alias("cnt"))
    sparse = F.col("cnt") < n_rows
    mn = F.when(sparse, F.least("mn", F.lit(0.0))).otherwise(F.col("mn"))
    mx = F.when(sparse, F.greatest("mx", F.lit(0.0))).otherwise(F.col("mx"))
    return (s.select("feature", mn.alias("min_value"), mx.alias("max_value"))
            .where((F.col("max_value") > bound) | (F.col("min_value") < -bound)))


def data_profile(df: DataFrame, cols: list[str], as_of: str = AS_OF) -> DataFrame:
    """A19 + F07 (titles of years after ``as_of`` are in the future): one row per column with count, nulls, min, max, mean, sample std — one global
    aggregate (partial per task), reshaped by exploding a fixed array of structs."""
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        aggs += [F.count(x).alias(f"{c}__n"), F.count_if(x.isNull()).alias(f"{c}__nulls"),
                 F.min(x).alias(f"{c}__min"), F.max(x).alias(f"{c}__max"),
                 F.avg(x).alias(f"{c}__mean"), F.stddev_samp(x).alias(f"{c}__std")]
    extra = []
    if "imdb_rating" in df.columns:
        extra.append(F.count_if(F.col("imdb_rating") > 9.5).alias("crowd_over_9_5"))
    if "num_votes" in df.columns:
        extra.append(F.count_if(F.col("num_votes") > 1_000_000).alias("votes_over_1m"))
    if "year" in df.columns:
        extra.append(F.count_if(F.col("year") > int(as_of[:4])).alias("future_year"))
    one = df.agg(F.count("*").alias("rows"), *aggs, *extra)
    rows = F.array(*[F.struct(F.lit(c).alias("column"),
                              F.col(f"{c}__n").cast("bigint").alias("non_null"),
                              F.col(f"{c}__nulls").cast("bigint").alias("nulls"),
                              F.col(f"{c}__min").alias("min"), F.col(f"{c}__max").alias("max"),
                              F.col(f"{c}__mean").alias("mean"), F.col(f"{c}__std").alias("std"))
                     for c in cols])
    return one.select(F.col("rows").cast("bigint").alias("rows"),
                      *[F.col(n).cast("bigint").alias(n) for n in
                        ("crowd_over_9_5", "votes_over_1m", "future_year") if n in one.columns],
                      F.explode(rows).alias("p")).select("*", "p.*").drop("p")
