"""Model properties (M01, M03), streaming = batch twin (ST01, ST02), leakage checks."""

import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF001
from reelspark.operators import evaluate as ev
from reelspark.operators import features as fe
from reelspark.operators import models as md
from reelspark.operators import splits as sp
from reelspark.sources import sinks
from reelspark.sources import testbind as tb
from reelspark.streaming import actions as st


def _vec_schema():
    from pyspark.ml.linalg import VectorUDT
    from pyspark.sql.types import DoubleType, StructField, StructType
    return StructType([StructField("features", VectorUDT()), StructField("label", DoubleType())])


def _cd_elastic_net(X, y, alpha, l1, iters=5000):
    """Reference yardstick: scikit-learn's objective by plain coordinate descent."""
    n, p = X.shape
    xm, ym = X.mean(0), y.mean()
    Xc, yc = X - xm, y - ym
    w = np.zeros(p)
    z = (Xc ** 2).sum(0) / n
    for _ in range(iters):
        for j in range(p):
            r = yc - Xc @ w + Xc[:, j] * w[j]
            rho = Xc[:, j] @ r / n
            w[j] = np.sign(rho) * max(abs(rho) - alpha * l1, 0) / (z[j] + alpha * (1 - l1))
    return w, ym - xm @ w


def test_elastic_net_matches_coordinate_descent(spark):
    from pyspark.ml.linalg import Vectors
    rng = np.random.default_rng(0)
    X = rng.normal(size=(300, 5))
    y = 5 + X @ np.array([1.5, -2.0, 0.0, 0.3, 0.0]) + rng.normal(scale=0.5, size=300)
    df = spark.createDataFrame([(Vectors.dense(x.tolist()), float(t)) for x, t in zip(X, y)],
                               _vec_schema())
    m = md.SkElasticNet(alpha=0.1, l1Ratio=0.5, maxIter=500, tol=1e-12).fit(df)
    w, b = _cd_elastic_net(X, y, 0.1, 0.5)
    assert np.allclose(m.coefficients.toArray(), w, atol=2e-4)
    assert m.intercept == pytest.approx(b, abs=2e-4)


def test_elastic_net_constant_target(spark):
    from pyspark.ml.linalg import Vectors
    df = spark.createDataFrame([(Vectors.dense([float(i), 1.0]), 7.0) for i in range(10)],
                               _vec_schema())
    m = md.SkElasticNet().fit(df)
    assert np.allclose(m.coefficients.toArray(), 0, atol=1e-6)
    assert m.intercept == pytest.approx(7.0, abs=1e-6)


def test_als_user_normal_equations(spark):
    """MLlib ALS scales λ by the user's rating count: (VᵀV + λ·n·I)u = Vᵀr for a fitted user."""
    rows = [(u, i, float(1 + (u * 3 + i * 7) % 10)) for u in range(6) for i in range(12) if (u + i) % 3]
    df = spark.createDataFrame(rows, "user int, item int, rating float")
    model = md.fit_als(df, rank=3, reg=0.1, iters=15, seed=1, blocks=1)
    U = {r["id"]: np.array(r["features"]) for r in model.userFactors.collect()}
    V = {r["id"]: np.array(r["features"]) for r in model.itemFactors.collect()}
    # the last half-step solves the users given the items: check every user
    for u in U:
        obs = [(i, r) for (uu, i, r) in rows if uu == u]
        A = np.array([V[i] for i, _ in obs])
        b = np.array([r for _, r in obs])
        lhs = (A.T @ A + 0.1 * len(obs) * np.eye(3)) @ U[u]
        assert np.allclose(lhs, A.T @ b, atol=1e-3)


def test_feature_statistics_use_training_rows_only(spark):
    """Leakage guard: statistics fitted on the training fold differ from the full-data ones
    whenever validation rows would move them, and the fitted object never sees validation."""
    r = tb.ratings(spark, SF001).join(tb.items(spark, SF001), "item_id")
    f = sp.stratified_folds(r, k=5)
    train = f.where(F.col("fold") != 0)
    ff_train, ff_all = fe.fit(train), fe.fit(r)
    assert ff_train.scaler["days_since_first_rate"] != ff_all.scaler["days_since_first_rate"]


def test_out_of_fold_user_mean_excludes_own_fold(spark):
    import datetime as dt
    r = spark.createDataFrame([(0, i, v, dt.date(2020, 1, 1)) for i, v in enumerate([1, 9, 5, 5])],
                              "user_id long, item_id long, my_rating int, rated_at date")
    f = r.withColumn("fold", (F.col("item_id") % 2).cast("int"))
    m = {x["fold"]: x["train_mean"] for x in ev.out_of_fold_user_mean(f).collect()}
    assert m == {0: 7.0, 1: 3.0}


def test_stream_dedup_equals_batch(spark):
    s = st.run_dedup(spark, f"{SF001}/events*.parquet")
    b = tb.actions(spark, SF001).select(*st.DEDUP_KEY).distinct()
    assert s.count() == b.count() and s.exceptAll(b).count() == 0


def test_stream_state_equals_batch_twin(spark):
    s = st.run_state(spark, f"{SF001}/events*.parquet")
    b = st.batch_state(tb.actions(spark, SF001))
    assert s.count() == b.count() and s.exceptAll(b).count() == 0 and b.exceptAll(s).count() == 0


def test_repeat_within_batch_is_dropped(spark):
    """rate 5, 7, 5 in one batch ends at 7: the second 5 repeats the first and is dropped."""
    import datetime as dt
    base = dt.datetime(2024, 1, 1, 10)
    rows = [(eid, base + dt.timedelta(minutes=eid), 1, "rate", r, 42, dt.date(2024, 1, 1))
            for eid, r in enumerate((5, 7, 5))]
    df = spark.createDataFrame(
        rows, "event_id long, ts timestamp, user_id long, action string, rating int, "
              "item_id long, batch_id date")
    assert st.batch_state(df).first()["current_rating"] == 7
    assert st.batch_dedup(df).count() == 2


def test_model_package_scores_after_loading(spark, tmp_path):
    """Model, metadata and feature statistics saved, loaded and used on new rows."""
    from reelspark.plans import q_features as qf
    ri = qf.rated_items(spark, SF001)
    ff = fe.fit(ri, fe.RESEARCH)
    train = fe.vectorize(ri, ff).select("features", F.col("my_rating").cast("double").alias("label"))
    m = md.SkElasticNet(alpha=0.05, l1Ratio=0.5).fit(train)
    md.save_package(m, str(tmp_path / "pkg"), {"alpha": 0.05}, ff)
    m2, meta, ff2 = md.load_package(str(tmp_path / "pkg"))
    assert meta == {"alpha": 0.05} and ff2 == ff or ff2.vocabulary == ff.vocabulary
    keys = ["user_id", "item_id"]
    want = {tuple(x)[:2]: x["prediction"] for x in m.transform(fe.vectorize(ri, ff)).select(*keys, "prediction").collect()}
    got = {tuple(x)[:2]: x["prediction"] for x in m2.transform(fe.vectorize(ri, ff2)).select(*keys, "prediction").collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_action_log_append(spark, tmp_path):
    """S11 batch form: appends keep the log's column order and accumulate."""
    from reelspark.sources import sinks
    a = spark.createDataFrame([("2024-01-01T00:00:00Z", "tt0111161", "rate", "10", "b1")],
                              "timestamp_iso string, imdb_const string, action string, rating string, "
                              "batch_id string")
    p = str(tmp_path / "log")
    sinks.append_actions(a, p)
    sinks.append_actions(a, p)
    back = spark.read.option("header", True).csv(p)
    assert back.columns == sinks.ACTION_LOG_COLS and back.count() == 2


def test_package_preset_features(spark):
    """The package preset: year clipped to 2024, date fills 2020/6/3/6, three one-hot families."""
    import datetime as dt
    df = spark.createDataFrame(
        [(1, 1, 8, None, 2030, "Drama", "Someone", 7.0, 100, "movie", 90, dt.date(2020, 5, 1))],
        "user_id long, item_id long, my_rating int, rated_at date, year int, genres string, "
        "directors string, imdb_rating double, num_votes long, title_type string, runtime int, "
        "release_date date")
    ff = fe.fit(df, fe.PACKAGE)
    b = fe.base_features(df, ff).first()
    assert b["year_f"] == 2024.0 and (b["rate_year"], b["rate_month"], b["rate_dow"]) == (2020, 6, 3)
    assert not any(v.startswith(("rate_dow_", "rel_m_")) for v in ff.vocabulary)
    assert fe.vectorize(df, ff).first()["features"].size == len(ff.vocabulary)


def test_ingested_string_ids_reach_the_recommendations(spark, tmp_path):
    """CSV → ALS on string ids (and a user −1) → blend → top-n → sink with the title type."""
    from reelspark.operators import algorithms as al
    from reelspark.sources import ingest as ig
    rows = [f"{u},tt70000{i:02d},movie,{1 + (u * 3 + i * 7) % 10},2020-01-01T00:00:00Z"
            for u in range(-1, 6) for i in range(12) if (u + i) % 3]
    (tmp_path / "r.csv").write_text("userId,titleId,titleType,rating,timestamp\n" + "\n".join(rows) + "\n")
    (tmp_path / "w.csv").write_text("userId,titleId,titleType\n" + "".join(
        f"{u},tt70000{i:02d},movie\n" for u in range(-1, 6) for i in (*range(12), 99)))
    r = ig.load_ratings_csv(spark, str(tmp_path / "r.csv"), "userid")
    w = ig.load_watchlist(spark, str(tmp_path / "w.csv"), "userid")
    items = spark.createDataFrame([(f"tt70000{i:02d}", f"t{i}", 2000, "Drama", 5.0 + i / 4, 10, "movie") for i in range(12)],
                                  "item_id string, title string, year int, genres string, imdb_rating double, num_votes long, title_type string")
    data = al.Dataset(r, w, items)
    top = al.recommend(data, ["als", "hybrid"], {"als": {"rank": 3, "iters": 3}}, k=3)
    got = top.collect()
    rated = {(x["user_id"], x["item_id"]) for x in r.collect()}
    assert {x["user_id"] for x in got} == {str(u) for u in range(-1, 6)}
    assert all((x["user_id"], x["item_id"]) not in rated and 0 <= x["score"] <= 1 for x in got)
    assert all([x["rank"] for x in got if x["user_id"] == str(u)] == [1, 2, 3] for u in range(-1, 6)) or len(got) == 21
    sinks.write_recommendations(top, str(tmp_path / "recs"))
    assert spark.read.parquet(str(tmp_path / "recs")).columns == ["user_id", "item_id", "score", "title_type"]
    # a content type needs the items' types (F02); the filter takes effect before or after the top-k
    none = items.withColumn("title_type", F.lit(None).cast("string"))
    with pytest.raises(ValueError, match="title type"):
        al.recommend(al.Dataset(r, w, none), ["hybrid"], content_type="movies")
    with pytest.raises(KeyError, match="no algorithm"):
        al.get("nothing")
    assert {"als", "crowd", "hybrid"} <= set(al.names())


def test_numbers_are_dense(spark):
    ids = spark.createDataFrame([(f"tt{i % 700}",) for i in range(3000)] + [(None,)], "item_id string")
    got = md.number_ids(ids, "item_id", buckets=16).collect()
    assert sorted(x["number"] for x in got) == list(range(700)) and len({x["item_id"] for x in got}) == 700


def test_crowd_column_is_split(spark):
    r = spark.createDataFrame([("a", "x", 5)], "user_id string, item_id string, my_rating int")
    it = spark.createDataFrame([(f"i{k}", 7.0) for k in range(400)], "item_id string, imdb_rating double")
    users = md.number_ids(r, "user_id")
    numbered = md.number_ids(r.select("item_id").union(it.select("item_id")), "item_id")
    rows = md.als_training_rows(r, it, users, numbered).collect()
    crowd = [x["user"] for x in rows if x["user"] < 0]
    assert len(rows) == 401 and len(crowd) == 400 and set(crowd) == set(range(-md.CROWD_PARTS, 0))


def test_stats_are_joined_back_in_parts(spark):
    """A third of the rows on one user: no task of the final plan reads more than a few parts of them."""
    from reelspark.operators.salting import counted, join_stats
    n = 30_000
    rows = spark.range(n).select(F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).alias("user_id"),
                                 F.col("id").alias("item_id"))
    stats = rows.groupBy("user_id").agg(F.count("*").alias("c"))
    with_counts = rows.groupBy("user_id").agg(*counted(F.count("*").alias("c")))
    keep = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.shuffle.partitions", "64")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        for known in (stats, with_counts):  # heavy users by the sketch, then by the statistics' own count
            out = join_stats(rows, known, ["user_id"], hot_rows=1000)
            assert out.columns == ["user_id", "item_id", "c"]
            sizes = out.groupBy(F.spark_partition_id().alias("p")).count().collect()
            assert sum(x["count"] for x in sizes) == n and out.where("user_id = 0").first()["c"] == n // 3
            assert max(x["count"] for x in sizes) < n // 3 / 2
            assert out.where("user_id = 0").select(F.spark_partition_id()).distinct().count() > 5
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", keep)
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_elastic_net_on_real_features_matches_coordinate_descent(spark):
    """On the sf0.001 rating features (noise data, small signal) the default tolerance still
    reaches the coordinate-descent optimum — a loose tolerance would stop at all zeros."""
    from reelspark.plans import q_features as qf
    ri = qf.rated_items(spark, SF001)
    ff = fe.fit(ri, fe.RESEARCH)
    tr = fe.vectorize(ri, ff).select("features", F.col("my_rating").cast("double").alias("label"))
    rows = tr.collect()
    X = np.array([r["features"].toArray() for r in rows])
    y = np.array([r["label"] for r in rows])
    w, b = _cd_elastic_net(X, y, 0.05, 0.5, iters=400)
    m = md.SkElasticNet(alpha=0.05, l1Ratio=0.5).fit(tr)
    assert np.count_nonzero(w) > 0
    assert np.allclose(m.coefficients.toArray(), w, atol=1e-4)


def test_stream_state_over_many_batches_with_compaction(spark, tmp_path):
    """Three time-ordered files, one per micro-batch, compaction every two batches: the
    snapshot + delta state equals the batch twin."""
    ev = tb.table(spark, SF001, "events")
    src = str(tmp_path / "events_src")
    bounds = ev.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
    step = (bounds["b"] - bounds["a"]) / 3
    for i in range(3):
        lo, hi = bounds["a"] + step * i, bounds["a"] + step * (i + 1)
        part = ev.where((F.col("ts") >= lo) & ((F.col("ts") < hi) if i < 2 else F.lit(True)))
        part.coalesce(1).write.mode("append").parquet(src)
    s = st.run_state(spark, src, compact_every=2, max_files=1)
    b = st.batch_state(tb.actions(spark, SF001))
    assert s.count() == b.count() and s.exceptAll(b).count() == 0 and b.exceptAll(s).count() == 0


def test_stream_does_not_depend_on_file_order(spark, tmp_path):
    """Newest file first, one per micro-batch, and one file twice: late rows are not lost."""
    ev = tb.table(spark, SF001, "events")
    bounds = ev.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
    step = (bounds["b"] - bounds["a"]) / 3
    src = str(tmp_path / "late")
    for i in (2, 1, 0, 2):
        lo, hi = bounds["a"] + step * i, bounds["a"] + step * (i + 1)
        part = ev.where((F.col("ts") >= lo) & ((F.col("ts") < hi) if i < 2 else F.lit(True)))
        part.coalesce(1).write.mode("append").parquet(src)
    b = st.batch_state(tb.actions(spark, SF001))
    s = st.run_state(spark, src, compact_every=3, max_files=1)
    assert s.count() == b.count() and s.exceptAll(b).count() == 0
    d = st.run_dedup(spark, src, max_files=1)
    want = st.batch_dedup(tb.actions(spark, SF001)).select(*st.DEDUP_KEY)
    assert d.count() == want.count() and d.exceptAll(want).count() == 0


def test_action_log_is_cleaned(spark, tmp_path):
    p = tmp_path / "log.csv"
    p.write_text("timestamp_iso,imdb_const,action,rating,notes,source,batch_id\n"
                 '2024-02-02T10:00:00Z,tt7000001,rate,8,"said ""yes"", twice",web,b1\n'
                 '2024-02-02T09:00:00Z,tt7000001,rate,8,"said ""yes"", twice",app,b1\n'
                 "2024-02-02T10:00:00Z,tt7000001,rate,8,other note,web,b1\n"
                 "2024-02-03T10:00:00Z,tt7000001,rate,,,web,b2\n2024-02-03T10:00:00Z,tt7,watchlist_add,,,web,b2\n"
                 "2024-02-03T10:00:00Z,tt7000002,,,,web,b2\n2024-02-03T10:00:00Z,tt7000002,watchlist_add,,,web,b2\n")
    clean, bad = st.clean_action_log(st.read_action_log(spark, str(p)))
    assert clean.columns == sinks.ACTION_LOG_COLS
    got = sorted((r["timestamp_iso"], r["action"], r["rating"], r["notes"]) for r in clean.collect())
    assert got == [("2024-02-02T09:00:00Z", "rate", 8, 'said "yes", twice'), ("2024-02-02T10:00:00Z", "rate", 8, "other note"),
                   ("2024-02-03T10:00:00Z", "watchlist_add", None, None)]
    assert sorted(r["reason"] for r in bad.collect()) == ["bad_action", "bad_id", "bad_rating"]


def test_normalised_tables_follow_their_source(spark, tmp_path):
    folder = str(tmp_path / "sf")
    for name in ("lineitem", "orders"):
        tb.table(spark, SF001, name).write.parquet(f"{folder}/{name}.parquet")
    before = tb.ratings(spark, folder).count()
    tb.table(spark, SF001, "lineitem").where("l_orderkey % 2 = 0").write.mode("overwrite").parquet(f"{folder}/lineitem.parquet")
    after = tb.ratings(spark, folder).count()
    assert after < before and after == tb.build_ratings(spark, folder).count()


def test_only_heavy_groups_are_dealt_out(spark):
    """Parts follow the count; statistics of all other groups are there once; NULL keys keep their rows."""
    from reelspark.operators.salting import heavy_hitters, join_stats
    rows = spark.range(9000).select(F.when(F.col("id") < 4000, F.lit("a")).when(F.col("id") < 5500, F.lit("b"))
                                    .when(F.col("id") >= 8990, F.lit(None).cast("string")).otherwise(F.col("id").cast("string")).alias("k"),
                                    F.col("id").alias("v"))
    hot = {r["_h"]: r["_parts"] for r in heavy_hitters(rows, ["k"], 1000).collect()}
    names = {r["h"]: r["k"] for r in rows.select("k", F.xxhash64("k").alias("h")).distinct().collect()}
    assert {names[h]: p for h, p in hot.items()} == {"a": 4, "b": 2}
    stats = rows.where("k is not null and k <> '7000'").groupBy("k").agg(F.sum("v").alias("s"))
    want = {r["k"]: r["s"] for r in stats.collect()}
    left = join_stats(rows, stats, ["k"], "left", hot_rows=1000).collect()
    assert len(left) == 9000 and all(r["s"] == want.get(r["k"]) for r in left)
    inner = join_stats(rows, stats, ["k"], hot_rows=1000).collect()
    assert len(inner) == 9000 - 10 - 1 and all(r["s"] == want[r["k"]] for r in inner)
    assert sorted(r["v"] for r in inner if r["k"] == "a") == list(range(4000))
    assert join_stats(rows.limit(0), stats, ["k"], "left").count() == join_stats(rows, stats.limit(0), ["k"]).count() == 0


def test_medians_are_exact_in_bounded_passes(spark):
    """Bit-equal to the built-in median for wide domains, ties, few rows, NULL and NaN."""
    from reelspark.operators.quantiles import exact_medians
    rng = np.random.default_rng(1)
    n = 20_000
    rows = [(float(a), float(b), float(c), None if i % 3 else float(i), 4.0, None) for i, (a, b, c) in enumerate(zip(
        rng.lognormal(size=n), rng.integers(0, 7, size=n), np.where(rng.random(n) < 0.7, 3.0, rng.normal(size=n))))]
    rows[5] = (float("nan"), 1.0, 2.0, None, 4.0, None)
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double, f double").repartition(7)
    cols = {x: F.col(x) for x in "abcdef"} | {"pair": F.when(F.col("d") < 6, F.col("d")), "shift": F.col("a") * 1e9 - 5e17}
    clean = df.withColumn("a", F.nanvl("a", F.lit(None).cast("double")))
    want = clean.agg(*[F.median(c).alias(x) for x, c in cols.items()]).first().asDict()
    for limit, accuracy in ((100_000, 2000), (300, 100), (1, 50)):
        assert exact_medians(df, cols, limit, accuracy) == want
    assert exact_medians(df.limit(0), {"a": F.col("a")}) == {"a": None} and exact_medians(df, {}) == {}


def _log_files(folder, batches):
    folder.mkdir(exist_ok=True)
    for i, rows in enumerate(batches):
        (folder / f"part{i}.csv").write_text("timestamp_iso,imdb_const,action,rating,notes,source,batch_id\n" + "\n".join(rows) + "\n")


def _log_batches():
    """Late rows, repeats within and across files, bad rows."""
    line = lambda h, item, action, rating, notes, b: f"2024-02-02T{h:02d}:00:00Z,{item},{action},{rating},{notes},web,{b}"
    return [[line(10 + i, "tt7000001", "rate", 8, "n", "b1"), line(9 - i, "tt7000001", "rate", 8, "n", "b1"),
             line(5, f"tt700001{i}", "watchlist_add", "", f"file {i}", "b2"), line(6, "tt7", "rate", 5, "", f"b{i}"),
             line(7, "tt7000002", "rate", 11 if i % 2 else 6, "x", "b3")] for i in range(7)]


def _log_rows(df):
    return sorted(tuple(map(str, r)) for r in df.collect())


def test_log_stream_equals_the_cleaned_batch(spark, tmp_path):
    _log_files(tmp_path / "in", _log_batches())
    base = str(tmp_path / "log")
    assert st.read_log(spark, base).count() == 0
    st.append_log_stream(spark, str(tmp_path / "in"), base, compact_every=2, max_files=1)
    clean, bad = st.clean_action_log(st.read_action_log(spark, str(tmp_path / "in")))
    assert _log_rows(st.read_log(spark, base)) == _log_rows(clean) and st.read_log(spark, base).columns == sinks.ACTION_LOG_COLS
    assert st.read_log_quarantine(spark, base).count() == bad.count() > 0
    # seven batches, snapshots after 1, 3 and 5: the previous one and what it does not hold are there, the rest is gone
    left = {p.parent.name + "/" + p.name for p in (tmp_path / "log").glob("*/*=*")}
    assert {x for x in left if x.startswith("snap")} == {"snap/upto=3", "snap/upto=5"}
    assert {x for x in left if x.startswith("clean")} == {"clean/micro_batch=4", "clean/micro_batch=5", "clean/micro_batch=6"}
    # more files later, also ones with rows that are there already
    _log_files(tmp_path / "in", _log_batches() + [["2024-02-01T00:00:00Z,tt7000001,rate,8,n,app,b1"]])
    st.append_log_stream(spark, str(tmp_path / "in"), base, compact_every=2)
    assert "2024-02-01T00:00:00Z" in {r.timestamp_iso for r in st.read_log(spark, base).collect()}


@pytest.mark.parametrize("dies_at", ["before", "after"])
def test_log_stream_survives_a_killed_batch(spark, tmp_path, monkeypatch, dies_at):
    """A batch that dies before or after its manifest is written is replayed to the same log."""
    _log_files(tmp_path / "in", _log_batches())
    base = str(tmp_path / "log")
    commit, killed = st._commit, []

    def dying(session, where, micro_batch, upto):
        if micro_batch == 3 and not killed:
            killed.append(1)
            if dies_at == "after":
                commit(session, where, micro_batch, upto)
            raise RuntimeError("killed")
        commit(session, where, micro_batch, upto)

    monkeypatch.setattr(st, "_commit", dying)
    with pytest.raises(Exception, match="killed"):
        st.append_log_stream(spark, str(tmp_path / "in"), base, compact_every=2, max_files=1)
    assert st.committed(spark, base)[0] == (2 if dies_at == "before" else 3)
    st.read_log(spark, base).count()  # a reader meets whole batches only
    st.append_log_stream(spark, str(tmp_path / "in"), base, compact_every=2, max_files=1)
    clean, bad = st.clean_action_log(st.read_action_log(spark, str(tmp_path / "in")))
    assert _log_rows(st.read_log(spark, base)) == _log_rows(clean)
    assert st.read_log_quarantine(spark, base).count() == bad.count()


def test_appended_actions_are_validated(spark, tmp_path):
    rows = [("2024-01-01T00:00:00Z", "tt0111161", "rate", "10", "b1"), ("2024-01-01T00:00:00Z", "nothing", "rate", "10", "b1"),
            ("2024-01-01T00:00:00Z", "tt0111161", "rate", "12", "b1")]
    a = spark.createDataFrame(rows, "timestamp_iso string, imdb_const string, action string, rating string, batch_id string")
    bad = sinks.append_actions(a, str(tmp_path / "log"))
    assert spark.read.option("header", True).csv(str(tmp_path / "log")).count() == 1
    assert sorted(r.reason for r in bad.collect()) == ["bad_id", "bad_rating"]


def test_ingest_options_reach_the_loaders(spark, tmp_path):
    """Order column, encoding and line mode through ``ingest_sources``; each export is parsed once."""
    from reelspark.sources import ingest as ig
    (tmp_path / "r.csv").write_bytes("Const,Your Rating,Title Type,Title,Seq\ntt0000001,5,movie,Été,1\ntt0000001,7,movie,Été,2\nbad,3,movie,x,1\n".encode("latin-1"))
    (tmp_path / "w.csv").write_bytes("Const,Title Type,Title,Seq\ntt0000002,movie,Où,2\ntt0000002,movie,Là,1\n".encode("latin-1"))
    got = ig.ingest_sources(spark, str(tmp_path / "r.csv"), str(tmp_path / "w.csv"), str(tmp_path / "out"), order_col="Seq",
                            multi_line=False, encoding="ISO-8859-1")
    by = {r.item_id: r for r in got.ratings.collect()}
    assert by["tt0000001"].my_rating == 7 and by["tt0000001"].title == "Été"
    assert [r.title for r in got.watchlist.collect()] == ["Où"]
    assert [(r.item_id, r.reason, r.source) for r in got.quarantine.collect()] == [("bad", "bad_id", "ratings")]


def test_a_hot_user_is_in_no_single_block(spark):
    """A user with a third of all ratings: dealt over pseudo-users for the fit, factors meet the normal equations, and
    pairs are scored with them."""
    rng = np.random.default_rng(6)
    rows = [("hot", f"i{i:04d}", int(rng.integers(1, 11))) for i in range(600)]
    rows += [(f"u{u}", f"i{int(i):04d}", int(rng.integers(1, 11))) for u in range(60) for i in rng.choice(600, 20, replace=False)]
    r = spark.createDataFrame(rows, "user_id string, item_id string, my_rating int")
    it = spark.createDataFrame([(f"i{i:04d}", 5.0 + i % 5) for i in range(620)], "item_id string, imdb_rating double")
    fit = md.train_als(r, it, rank=3, reg=0.1, iters=8, hot_ratings=100)
    numbers = {x.user_id: x["number"] for x in fit.users.collect()}
    base = md.als_training_rows(r, it, fit.users, fit.items)
    sent = md.dealt_out(base, md.hot_users(base, 100)).groupBy("user").count().collect()
    assert max(x["count"] for x in sent if x.user != numbers["hot"]) < 150 and numbers["hot"] not in {x.user for x in sent}
    u = {x.id: np.array(x.features) for x in fit.user_factors().collect()}
    v = {x.id: np.array(x.features) for x in fit.model.itemFactors.collect()}
    place = {x.item_id: x["number"] for x in fit.items.collect()}
    assert set(u) == set(numbers.values())
    own = [(v[place[i]], m) for who, i, m in rows if who == "hot"]
    a, b = np.array([x for x, _ in own]), np.array([m for _, m in own], dtype=float)
    assert np.allclose((a.T @ a + 0.1 * len(own) * np.eye(3)) @ u[numbers["hot"]], a.T @ b, rtol=1e-4)
    pairs = spark.createDataFrame([("hot", "i0610"), ("u3", "i0610"), ("hot", "nothing"), ("nobody", "i0001")], "user_id string, item_id string")
    got = {(x.user_id, x.item_id): x for x in md.score_als(fit, pairs).collect()}
    for who in ("hot", "u3"):
        assert got[who, "i0610"].p == pytest.approx(float(u[numbers[who]] @ v[place["i0610"]]), abs=1e-4)
    assert got["hot", "nothing"].cold and got["nobody", "i0001"].cold and len(got) == 4
    fit.release()


def test_als_drops_its_shuffle_files_every_few_iterations(spark, monkeypatch):
    from reelspark.operators import models as md

    asked = {}

    class Recorded(md.ALS):
        def __init__(self, **kw):
            asked.update(kw)
            super().__init__(**kw)

    monkeypatch.setattr(md, "ALS", Recorded)
    rows = spark.createDataFrame([(u, i, float(1 + (u * i) % 10)) for u in range(6) for i in range(5)], "user int, item int, rating float")
    md.fit_als(rows, rank=2, iters=3, blocks=1)
    assert asked["checkpointInterval"] <= 2


def test_settings_of_a_fold_share_its_training_rows(spark, monkeypatch):
    from reelspark.plans import q_models as qm

    made = []
    rows_of = md.als_training_rows
    monkeypatch.setattr(md, "als_training_rows", lambda *a, **kw: made.append(1) or rows_of(*a, **kw))
    settings = [(2, 0.1, 2), (3, 0.1, 2)]
    both = {(r.factors, r.fold): r for r in qm._als_folds(spark, SF001, settings, 2).collect()}
    assert len(made) == 2 and set(both) == {(2, 0), (2, 1), (3, 0), (3, 1)}
    assert sum(both[2, f].n for f in (0, 1)) == tb.ratings(spark, SF001).count()
    alone = {r.fold: r for r in qm._als_folds(spark, SF001, settings[1:], 2).collect()}
    assert all(both[3, f].rmse == pytest.approx(alone[f].rmse, abs=1e-6) for f in (0, 1))


@pytest.mark.parametrize("name", ["als_cv", "als_grid"])
def test_a_failed_fold_is_no_result(spark, monkeypatch, name):
    """One fit of one fold fails: raised, no row of NULLs that the means leave out."""
    from pyspark.errors import PySparkException

    from reelspark.plans import q_models as qm

    fit = md.fit_prepared

    def broken(data, rank, reg, iters, seed):
        if seed == 43:
            raise PySparkException("no space left on device")
        return fit(data, 2, reg, 1, seed)

    monkeypatch.setattr(md, "fit_prepared", broken)
    with pytest.raises(PySparkException, match="no space left"):
        getattr(qm, name)(spark, SF001).collect()


def test_folds_without_rows_have_nothing_to_measure(spark, monkeypatch):
    from reelspark.plans import q_models as qm

    r = spark.createDataFrame([(1, 1, 5, None)], "user_id long, item_id long, my_rating int, rated_at date")
    it = spark.createDataFrame([(1, None)], "item_id long, imdb_rating double")
    monkeypatch.setattr(tb, "ratings", lambda *a: r)
    monkeypatch.setattr(tb, "items", lambda *a: it)
    rows = qm._als_folds(spark, SF001, [(2, 0.1, 1)], 2).collect()
    assert len(rows) == 2 and all(x.rmse is None for x in rows)


def test_many_ratings_have_a_block_a_core_and_drop_their_files_every_iteration():
    assert [md.block_count(n, 12) for n in (0, 100_000, 1_000_000)] == [1, 6, 24]  # as before
    assert md.block_count(24_000_000, 12) == md.block_count(1_000_001, 12) == 12
    assert md.block_count(24_000_000, 12, jobs=2) == 6 and md.block_count(24_000_000, 1) == 2
    assert md.block_count(10**9, 12) == 72 and md.block_count(10**9, 12) * md.MOST_PER_BLOCK >= 10**9
    assert md.CHECKPOINT_EVERY == 1


def test_files_of_finished_fits_are_deleted(spark, monkeypatch):
    """When the folds of a large table are done, the fits' shuffle files are gone, not left for some later collection."""
    from reelspark.plans import q_models as qm

    def shuffles():
        dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
        return {f for d in dirs for _, _, fs in os.walk(d) for f in fs if f.startswith("shuffle_")}

    seen = []
    metrics = qm.mt.rating_metrics
    monkeypatch.setattr(qm.mt, "rating_metrics", lambda *a: seen.append(shuffles()) or metrics(*a))
    monkeypatch.setattr(md, "FEW_RATINGS", 100)
    before = shuffles()
    qm._als_folds(spark, SF001, [(2, 0.1, 12)], 2)
    made = set.union(*seen) - before
    for _ in range(20):  # Spark deletes them in a thread of its own
        left = made & shuffles()
        if len(left) < 0.5 * len(made):
            break
        time.sleep(1)
    assert made and len(left) < 0.5 * len(made)
