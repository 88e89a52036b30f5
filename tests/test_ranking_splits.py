"""T01, F01/F02, W03–W07, A08, A15, R01–R03 on small hand-made frames."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from reelspark.operators import evaluate as ev
from reelspark.operators import metrics as mt
from reelspark.operators import ranking as rk
from reelspark.operators import splits as sp
from reelspark.operators.recommend import hybrid_scores, recommend_top_n

RSCHEMA = "user_id long, item_id long, my_rating int, rated_at date"


def _items(spark):
    return spark.createDataFrame(
        [(1, "A", 1994, "Drama", 9.0, 1000, "movie"), (2, "B", 2001, "Crime", 8.0, 500, "tvSeries"),
         (3, "C", 2010, None, 8.0, 900, "movie"), (4, "D", None, "Action", None, None, "tvMovie"),
         (5, "E", 1999, "Drama", 7.0, 10, "short")],
        "item_id long, title string, year int, genres string, imdb_rating double, "
        "num_votes long, title_type string")


def test_top_n_excludes_rated_and_sorts(spark):
    import datetime as dt
    r = spark.createDataFrame([(1, 1, 9, dt.date(2020, 1, 1))], RSCHEMA)
    w = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (1, 4), (1, 5)], "user_id long, item_id long")
    recs = recommend_top_n(hybrid_scores(r, w, _items(spark)), k=3).orderBy("rank").collect()
    assert [x["item_id"] for x in recs] == [3, 2, 5]        # 3 ties 2 on score, more votes
    assert [x["rank"] for x in recs] == [1, 2, 3]
    assert recs[0]["score"] >= recs[1]["score"] >= recs[2]["score"]
    assert all(x["item_id"] != 1 for x in recs)
    assert recs[0]["genres"] == ""


def test_content_filter_sets(spark):
    it = _items(spark)
    movies = sorted(r[0] for r in rk.filter_content_type(it, "movies").select("item_id").collect())
    tv = sorted(r[0] for r in rk.filter_content_type(it, "tv").select("item_id").collect())
    assert movies == [1, 3, 5] and tv == [2, 4]
    assert rk.filter_content_type(it, "all").count() == 5
    with pytest.raises(ValueError):
        rk.filter_content_type(it, "cartoons")
    with pytest.raises(ValueError):
        rk.filter_content_type(it.drop("title_type"), "movies")


def test_require_metadata(spark):
    it = _items(spark)
    rk.require_metadata(it)
    with pytest.raises(ValueError):
        rk.require_metadata(it.withColumn("title_type", F.lit(None).cast("string")))


def _ratings(spark, n_users=3, n_items=40):
    import datetime as dt
    rows = [(u, i, 1 + (u * 7 + i * 3) % 10, dt.date(2020, 1, 1) + dt.timedelta(days=i % 9))
            for u in range(n_users) for i in range(n_items)]
    return spark.createDataFrame(rows, RSCHEMA)


def test_stratified_folds_cover_and_balance(spark):
    f = sp.stratified_folds(_ratings(spark), k=5).collect()
    assert len(f) == 120 and len({(r["user_id"], r["item_id"]) for r in f}) == 120
    from collections import Counter
    per = Counter((r["user_id"], r["rating_bin"], r["fold"]) for r in f)
    bins = Counter((r["user_id"], r["rating_bin"]) for r in f)
    for (u, b), n in bins.items():
        sizes = [per[(u, b, k)] for k in range(5)]
        assert max(sizes) - min(sizes) <= 1 and sum(sizes) == n


def test_position_in_group_equals_row_number(spark):
    from pyspark.sql import Window
    df = _ratings(spark, 2, 300).withColumn("k", sp.shuffle_key(7))
    a = sp.position_in_group(df, ["user_id"], sp.md5_bucket(F.col("k"), 1), [F.col("k"), F.col("item_id")])
    b = df.withColumn("pos2", F.row_number().over(Window.partitionBy("user_id").orderBy("k", "item_id")))
    j = a.join(b, ["user_id", "item_id"])
    assert j.where(F.col("pos") != F.col("pos2")).count() == 0
    assert j.where(F.col("n") != 300).count() == 0


def test_temporal_folds_chronology(spark):
    t = sp.temporal_folds(_ratings(spark, 1, 12), k=2).collect()
    # n = 12, test size 4: folds test positions 4–7 and 8–11
    by_fold = {f: [r for r in t if r["test_fold"] == f] for f in (0, 1)}
    assert [len(by_fold[0]), len(by_fold[1])] == [4, 4]
    for f in (0, 1):
        train = [r for r in t if r["first_train_fold"] is not None and r["first_train_fold"] <= f]
        assert max(r["pos"] for r in train) < min(r["pos"] for r in by_fold[f])
        assert max(r["rated_at"] for r in train) <= min(r["rated_at"] for r in by_fold[f])


def test_split_80_20(spark):
    s = sp.split_train_validation(_ratings(spark, 2, 11)).groupBy("user_id", "split").count().collect()
    assert {(r["split"], r["count"]) for r in s} == {("validation", 3), ("train", 8)}


def test_cv_anchor_mean_predictor(spark):
    """Four ratings 1, 2, 9, 10, two stratified folds, mean-of-training predictor: whichever
    low/high pairing the folds make, RMSE and MAE follow the reference's arithmetic."""
    import datetime as dt
    r = spark.createDataFrame([(0, i + 1, v, dt.date(2021, 1, i + 1)) for i, v in enumerate([1, 2, 9, 10])],
                              RSCHEMA)
    f = sp.stratified_folds(r, k=2)
    gm = ev.mean_predictor(f)
    assert {round(r["rmse"], 9) for r in gm.collect()} == {
        round(r["rmse"], 9) for r in f.join(gm.drop("rmse"), "fold").groupBy("fold").agg(
            F.sqrt(F.avg(F.pow(F.col("train_mean") - F.col("my_rating"), 2))).alias("rmse")).collect()}
    pred = f.join(gm, "fold").select("fold", F.col("my_rating").cast("double").alias("y"),
                                     F.col("train_mean").alias("p"))
    m = mt.rating_metrics(pred, ["fold"]).withColumn("model", F.lit("mean"))
    for c in ("precision_at_10", "recall_at_10", "ndcg_at_10"):
        m = m.withColumn(c, F.lit(0.0))
    s = mt.fold_summary(m).first()
    folds = {x["fold"]: sorted(x["ys"]) for x in
             f.groupBy("fold").agg(F.collect_list("my_rating").alias("ys")).collect()}
    if sorted(map(tuple, folds.values())) == [(1, 10), (2, 9)]:
        assert s["mean_rmse"] == pytest.approx(4.0) and s["mean_mae"] == pytest.approx(4.0)
        assert s["std_rmse"] == pytest.approx(0.7071, rel=1e-3)
    else:
        assert s["mean_rmse"] == pytest.approx(math.sqrt(17)) and s["std_rmse"] == pytest.approx(0.0)


def _rank_py(scores, ratings, k=10):
    rel = {i for i, r in ratings.items() if r >= 8}
    if not scores or not rel:
        return 0.0, 0.0, 0.0
    top = sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k]
    hits = sum(1 for i, _ in top if i in rel)
    dcg = sum(1 / math.log2(p + 2) for p, (i, _) in enumerate(top) if i in rel)
    idcg = sum(1 / math.log2(p + 2) for p in range(min(k, len(rel))))
    return hits / min(k, len(top)), hits / len(rel), dcg / idcg


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 10), st.integers(0, 50)), min_size=1, max_size=25))
def test_ranking_metrics_match_python(spark, rows):
    data = [(0, 0, i, r, float(s)) for i, (r, s) in enumerate(rows)]
    df = spark.createDataFrame(data, "user_id int, fold int, item_id int, my_rating int, score double")
    got = mt.ranking_metrics(df, ["user_id", "fold"]).first()
    exp = _rank_py({i: float(s) for i, (_, s) in enumerate(rows)}, {i: r for i, (r, _) in enumerate(rows)})
    assert (got["precision_at_10"], got["recall_at_10"], got["ndcg_at_10"]) == pytest.approx(exp)


def test_rating_metrics(spark):
    df = spark.createDataFrame([(0, 1.0, 2.0), (0, 3.0, 3.0), (0, 5.0, 4.0), (0, None, 1.0)],
                               "fold int, y double, p double")
    m = mt.rating_metrics(df, ["fold"]).first()
    assert m["n"] == 3 and m["rmse"] == pytest.approx(math.sqrt(2 / 3))
    assert m["mae"] == pytest.approx(2 / 3) and m["r2"] == pytest.approx(1 - 2 / 8)


def test_temporal_folds_of_crowded_months(spark, monkeypatch):
    """Finer buckets in crowded months number the rows as one window over the user does."""
    import datetime as dt
    rows = [(u, i, 1 + i % 10, dt.date(2020, 1 + i % 2, 1 + (i * 7) % 3)) for u in (1, 2) for i in range(u * 60)]
    df = spark.createDataFrame(rows, RSCHEMA)
    plain = sorted(map(tuple, sp.temporal_folds(df, 3).collect()))
    monkeypatch.setattr(sp, "CROWDED", 20)
    assert sorted(map(tuple, sp.temporal_folds(df, 3).collect())) == plain
    order = sorted((r[0], r[3], r[1]) for r in rows)
    want = {(u, i): sum(1 for x in order if x[0] == u and x < (u, d, i)) for u, d, i in order}
    cols = sp.temporal_folds(df, 3).columns
    assert {(r[0], r[1]): r[cols.index("pos")] for r in plain} == want


def test_folds_keep_rows_outside_every_bin_and_null_ids(spark):
    """NULL, 0-below, 11 and NULL item ids: every row gets a fold."""
    df = spark.createDataFrame([(1, 1, None), (1, 2, -1), (1, 3, 11), (1, 4, 5), (1, None, 6), (2, None, None)],
                               "user_id long, item_id long, my_rating int")
    for f in (sp.stratified_folds(df, 3, 1), sp.even_bin_folds(df, 3, 1), sp.plain_folds(df, 3, 1)):
        rows = f.collect()
        assert len(rows) == 6 and all(r["fold"] is not None for r in rows)
    assert sp.split_train_validation(df).count() == 6


def test_positions_of_crowded_groups_and_null_keys(spark):
    """Bucketed and plain groups side by side, NULL keys and NULL order: one window over the group numbers them alike."""
    from pyspark.sql import Window
    rows = [(u, None if i % 50 == 7 else i) for u in (1, None) for i in range(120)] + [(2, i) for i in range(9)]
    df = spark.createDataFrame([(u, i, n) for n, (u, i) in enumerate(rows)], "user_id long, item_id long, row_no long")
    key = sp.shuffle_key(3)
    got = sp.position_in_group(df, ["user_id"], sp.md5_bucket(key, 1), [key, F.col("item_id"), F.col("row_no")], crowded=20)
    assert got.columns == [*df.columns, "pos", "n"]
    w = Window.partitionBy("user_id")
    want = (df.withColumn("pos", F.row_number().over(w.orderBy(key, "item_id", "row_no")).cast("long"))
            .withColumn("n", F.count("*").over(w)))
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}
