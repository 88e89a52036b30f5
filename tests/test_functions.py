"""X01–X12, X17–X20, A02, A03 against plain-Python definitions."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from reelspark.functions import content as cv
from reelspark.functions import scalar as sc
from reelspark.functions.constants import GENRES
from reelspark.operators import ranking as rk


def _one(spark, expr, schema="x int", row=(1,)):
    return spark.createDataFrame([row], schema).select(expr.alias("r")).first()["r"]


def test_genre_vector_unit_length(spark):
    v = _one(spark, cv.genre_vector(F.lit("Drama, Crime,Unknown,,")))
    assert len(v) == 22
    assert v[GENRES.index("Drama")] == pytest.approx(1 / math.sqrt(2))
    assert sum(x * x for x in v) == pytest.approx(1.0)
    assert _one(spark, cv.genre_vector(F.lit(None).cast("string"))) == [0.0] * 22


@pytest.mark.parametrize("year,idx", [(1980, 0), (1981, 1), (1990, 1), (2000, 2), (2010, 3),
                                      (2020, 4), (2021, 5), (1900, 0), (None, None)])
def test_year_bucket_edges(spark, year, idx):
    v = _one(spark, cv.year_bucket(F.col("y")), "y int", (year,))
    assert len(v) == 6
    if idx is None:
        assert v == [0.0] * 6
    else:
        assert v[idx] == 1.0 and sum(v) == 1.0


def test_content_vector_length(spark):
    assert len(_one(spark, cv.content_vector(F.lit("Action"), F.lit(1999)))) == 28


def test_cosine_zero_vector(spark):
    assert _one(spark, cv.cosine(F.array(F.lit(0.0), F.lit(0.0)),
                                 F.array(F.lit(1.0), F.lit(0.0)))) == 0.0
    assert _one(spark, cv.cosine(F.array(F.lit(1.0), F.lit(1.0)),
                                 F.array(F.lit(2.0), F.lit(2.0)))) == pytest.approx(1.0)


def _recency_py(year, alpha):
    if alpha <= 0 or year is None:
        return 1.0
    y = max(1980, min(2025, int(year)))
    return (1 - alpha) + alpha * (0.6 + 0.4 * ((y - 1980) / 45))


@pytest.mark.parametrize("year,alpha", [(1970, 0.5), (2000, 0.3), (2030, 1.0), (None, 0.5),
                                        (2000, 0.0)])
def test_recency_weight(spark, year, alpha):
    got = _one(spark, sc.recency_weight(F.col("y"), alpha), "y int", (year,))
    assert got == pytest.approx(_recency_py(year, alpha))


def test_score_mappings(spark):
    assert _one(spark, sc.pred_to_score(F.lit(10.0))) == 1.0
    assert _one(spark, sc.pred_to_score(F.lit(-3.0))) == 0.0
    assert _one(spark, sc.eval_mapping(F.lit(1.0))) == 8.5
    assert _one(spark, sc.eval_mapping(F.lit(-5.0))) == 1.0
    assert _one(spark, sc.clip_rating(F.lit(12.0))) == 10.0
    assert _one(spark, sc.bounded_scale(F.lit(7.0), F.lit(7.0), F.lit(1.0))) == 5.5
    assert _one(spark, sc.bounded_scale(F.lit(7.0), F.lit(7.0), F.lit(0.0))) == 5.5
    assert _one(spark, sc.bounded_scale(F.lit(12.0), F.lit(None), F.lit(None))) == 10.0


def test_hybrid_and_crowd(spark):
    assert _one(spark, sc.hybrid_signal(F.lit(8), F.lit(None), F.lit(6.0))) == pytest.approx(7.4)
    assert _one(spark, sc.hybrid_signal(F.lit(None), F.lit(8.0), F.lit(6.0))) == pytest.approx(6.6)
    assert _one(spark, sc.crowd_signal(F.lit(None).cast("double"), 6.5)) == 6.5


def test_quality_band(spark):
    df = spark.createDataFrame([(0.5,), (0.7,), (1.5,), (2.0,), (None,)], "e double")
    got = [r[0] for r in df.select(sc.quality_band(F.col("e"))).collect()]
    assert got == ["excellent", "good", "fair", "poor", "no_prediction"]


def test_blend_mean_over_scoring_algos(spark):
    a = spark.createDataFrame([(1, "i1", "a", 1.0, "x"), (1, "i2", "a", 0.0, None)],
                              "user_id int, item_id string, algo string, score double, why string")
    b = spark.createDataFrame([(1, "i1", "b", 0.5, "y")],
                              "user_id int, item_id string, algo string, score double, why string")
    got = {r["item_id"]: r for r in rk.blend(a, b).collect()}
    assert got["i1"]["score"] == pytest.approx(0.75) and got["i1"]["why_explainer"] == "x; y"
    assert got["i2"]["score"] == 0.0
    assert got["i2"]["why_explainer"] == "blended score from multiple models"


def _norm_py(vals):
    lo, hi = min(vals), max(vals)
    if hi - lo <= 0:
        return [0.5] * len(vals)
    return [(v - lo) / (hi - lo) for v in vals]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.floats(min_value=-100, max_value=100, allow_nan=False), min_size=1, max_size=8))
def test_normalize_matches_python(spark, vals):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(vals)],
                               "user_id int, item_id int, score double")
    got = [r["score"] for r in rk.normalize_scores(df).orderBy("item_id").collect()]
    assert got == pytest.approx(_norm_py(vals), abs=1e-9)


def test_metadata_filter(spark):
    df = spark.createDataFrame(
        [(1, 2020, 7.0, 100, "Drama"), (2, 2030, 7.0, 100, "Drama"), (3, 2020, None, None, "Drama"),
         (4, 2020, 0.0, 10, "nan"), (5, None, 8.0, 5, "")],
        "item_id int, year int, imdb_rating double, num_votes long, genres string")
    kept = sorted(r[0] for r in rk.metadata_filter(df, "2025-12-31").select("item_id").collect())
    assert kept == [1, 5]


def test_r6_near_and_off_ties_as_the_exact_decimal(spark):
    import random

    from pyspark.sql import functions as F

    from reelspark.functions.scalar import r6

    rng = random.Random(3)
    values = [0.0, -0.0, 1.0, 0.5e-6, -0.5e-6, 1.0000005, 2.6750005, -7.1234565, 0.1234564999999, 99999.9999995, 1e5, 1e7 + 0.1234565,
              1e25, 1e30, float("nan"), float("inf"), float("-inf"), None, 1e-9, -1e-9]
    values += [rng.uniform(-1, 1) * 10 ** rng.randint(-7, 6) for _ in range(3000)]
    values += [(2 * rng.randint(-10**9, 10**9) + 1) * 0.5e-6 for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in values], "x double").withColumn("f", F.col("x").cast("float"))
    for c in ("x", "f"):
        exact = F.round(F.col(c).try_cast("decimal(38,12)"), 6).cast("double")
        got = df.select(c, r6(c).cast("string").alias("got"), exact.cast("string").alias("exact"))
        assert got.where(~F.col("got").eqNullSafe(F.col("exact"))).collect() == []
    # most values stay clear of the decimal
    assert "FLOOR" in df.select(r6("x"))._jdf.queryExecution().optimizedPlan().toString()


def test_split_tokens_equals_split_list(spark):
    odd = ["", " ", ",", " , a,, b c ,", "\ta \n,\r\n b\x0b", "a  ", "a ", " a \x85", " a ,  b", "a \n ", None, "x,y  ,z"]
    rows = spark.createDataFrame([(x,) for x in odd], "x string").select(cv.split_list("x").alias("a"), cv.split_tokens("x").alias("b")).collect()
    assert len(rows) == len(odd) and all(r.a == r.b for r in rows)
