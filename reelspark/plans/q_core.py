"""Registered queries: ingest views, catalog, exclusion, filters, ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.constants import AS_OF, TEST_MOVIE_TYPES, TEST_TV_TYPES, WHY_BLEND_DEFAULT
from ..functions.scalar import r6, r6_sql as R
from ..operators import catalog as cat
from ..operators import ranking as rk
from ..operators.recommend import hybrid_scores, recommend_top_n
from ..sources import testbind as tb
from .registry import query

MOVIES_SQL = ", ".join(f"'{t}'" for t in TEST_MOVIE_TYPES)
TV_SQL = ", ".join(f"'{t}'" for t in TEST_TV_TYPES)

# ---------------------------------------------------------------- recommend_topn (flagship)

_HYBRID_SQL = f"""
scored AS (
  SELECT c.user_id, c.item_id,
    {R('0.3 * coalesce(um.user_mean, coalesce(i.imdb_rating, 0.0)) + 0.7 * coalesce(i.imdb_rating, 0.0)')} AS score,
    i.title, i.year, i.genres, i.num_votes, i.title_type
  FROM (SELECT user_id, item_id FROM watchlist w
        WHERE NOT EXISTS (SELECT 1 FROM ratings r
                          WHERE r.user_id = w.user_id AND r.item_id = w.item_id)) c
  LEFT JOIN items i ON i.item_id = c.item_id
  LEFT JOIN (SELECT user_id, avg(my_rating) AS user_mean FROM ratings GROUP BY user_id) um
    ON um.user_id = c.user_id),
bounds AS (SELECT user_id, min(score) AS lo, max(score) AS hi FROM scored GROUP BY user_id)"""


def _topn_sql(k: int, type_filter: str) -> str:
    return tb.with_views(f""",
{_HYBRID_SQL.strip()}
SELECT s.user_id, s.rank, s.item_id, coalesce(s.title, '') AS title, s.year,
  coalesce(s.genres, '') AS genres,
  {R('CASE WHEN b.hi - b.lo > 0 THEN (s.score - b.lo) / (b.hi - b.lo) ELSE 0.5 END')} AS score,
  '{WHY_BLEND_DEFAULT}' AS why_explainer
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY score DESC NULLS LAST,
        coalesce(CAST(num_votes AS DOUBLE), 0) DESC, coalesce(CAST(year AS DOUBLE), 0) DESC,
        item_id ASC) AS BIGINT) AS rank
      FROM scored {type_filter}) s
JOIN bounds b ON b.user_id = s.user_id
WHERE s.rank <= {k}""", "items", "ratings", "watchlist")


def recommend_for(spark, sf_dir, k=10, content_type="all"):
    scored = hybrid_scores(tb.ratings(spark, sf_dir), tb.watchlist(spark, sf_dir),
                           tb.items(spark, sf_dir))
    return recommend_top_n(scored, k=k, content_type=content_type,
                           movie_types=TEST_MOVIE_TYPES, tv_types=TEST_TV_TYPES)


@query("recommend_topn", _topn_sql(10, ""))
def recommend_topn(spark, sf_dir):
    return recommend_for(spark, sf_dir, 10, "all")


@query("content_filter_movies", _topn_sql(10, f"WHERE title_type IN ({MOVIES_SQL})"))
def content_filter_movies(spark, sf_dir):
    return recommend_for(spark, sf_dir, 10, "movies")


@query("content_filter_tv", _topn_sql(10, f"WHERE title_type IN ({TV_SQL})"))
def content_filter_tv(spark, sf_dir):
    return recommend_for(spark, sf_dir, 10, "tv")


# ---------------------------------------------------------------- ingest views

@query("items", tb.with_views("SELECT * FROM items", "items"))
def items_q(spark, sf_dir):
    return tb.items(spark, sf_dir)


@query("ratings_latest", tb.with_views("SELECT * FROM ratings", "ratings"))
def ratings_latest(spark, sf_dir):
    return tb.ratings(spark, sf_dir)


@query("watchlist", tb.with_views("SELECT * FROM watchlist", "watchlist"))
def watchlist_q(spark, sf_dir):
    return tb.watchlist(spark, sf_dir)


# ---------------------------------------------------------------- catalog / universe / exclusion

@query("catalog", tb.with_views("""
SELECT coalesce(r.user_id, w.user_id) AS user_id, coalesce(r.item_id, w.item_id) AS item_id,
  r.my_rating, r.rated_at, coalesce(w.in_watchlist, false) AS in_watchlist,
  i.title, i.year, i.genres, i.imdb_rating, i.num_votes, i.title_type
FROM ratings r
FULL OUTER JOIN (SELECT user_id, item_id, true AS in_watchlist FROM watchlist) w
  ON r.user_id = w.user_id AND r.item_id = w.item_id
LEFT JOIN items i ON i.item_id = coalesce(r.item_id, w.item_id)""",
                                "items", "ratings", "watchlist"))
def catalog_q(spark, sf_dir):
    r = tb.ratings(spark, sf_dir)
    w = tb.watchlist(spark, sf_dir).withColumn("in_watchlist", F.lit(True))
    c = cat.catalog(r, w)
    meta = tb.items(spark, sf_dir).select("item_id", *cat.META_COLS)
    return (c.select("user_id", "item_id", "my_rating", "rated_at",
                     F.coalesce("in_watchlist", F.lit(False)).alias("in_watchlist"))
            .join(meta, "item_id", "left")
            .select("user_id", "item_id", "my_rating", "rated_at", "in_watchlist",
                    *cat.META_COLS))


@query("item_universe", tb.with_views("""
SELECT item_id, source, title_type FROM (
  SELECT u.*, row_number() OVER (PARTITION BY item_id ORDER BY source DESC, title_type DESC) rn
  FROM (SELECT r.item_id, 1 AS source, i.title_type FROM ratings r LEFT JOIN items i USING (item_id)
        UNION ALL
        SELECT w.item_id, 0 AS source, i.title_type FROM watchlist w LEFT JOIN items i USING (item_id)) u
) t WHERE rn = 1""", "items", "ratings", "watchlist"))
def item_universe_q(spark, sf_dir):
    it = tb.items(spark, sf_dir).select("item_id", "title_type")
    r = tb.ratings(spark, sf_dir).join(it, "item_id", "left")
    w = tb.watchlist(spark, sf_dir).join(it, "item_id", "left")
    return cat.item_universe(r, w, ["title_type"])


@query("exclude_rated", tb.with_views("""
SELECT user_id, item_id FROM watchlist w
WHERE NOT EXISTS (SELECT 1 FROM ratings r WHERE r.user_id = w.user_id AND r.item_id = w.item_id)""",
                                      "ratings", "watchlist"))
def exclude_rated_q(spark, sf_dir):
    return rk.exclude_rated(tb.watchlist(spark, sf_dir), tb.ratings(spark, sf_dir))


# ---------------------------------------------------------------- release / metadata filters

@query("release_filter", tb.with_views(f"""
SELECT item_id, year, release_date,
  (year IS NULL OR year <= {AS_OF[:4]}) AS released_by_year,
  ((year IS NULL OR year <= {AS_OF[:4]})
   AND (release_date IS NULL OR release_date <= DATE '{AS_OF}')
   AND (CAST(coalesce(imdb_rating > 0, false) AS INT) + CAST(coalesce(num_votes > 0, false) AS INT)
        + CAST(coalesce(trim(genres) <> '' AND lower(trim(genres)) <> 'nan', false) AS INT)) >= 2)
   AS keep_metadata
FROM items""", "items"))
def release_filter_q(spark, sf_dir):
    """F03 and F04 as flags over the whole item table (both filters, side by side)."""
    it = tb.items(spark, sf_dir)
    f3 = rk.released_filter(it, AS_OF).select("item_id", F.lit(True).alias("released_by_year"))
    f4 = rk.metadata_filter(it, AS_OF).select("item_id", F.lit(True).alias("keep_metadata"))
    return (it.select("item_id", "year", "release_date")
            .join(f3, "item_id", "left").join(f4, "item_id", "left")
            .select("item_id", "year", "release_date",
                    F.coalesce("released_by_year", F.lit(False)).alias("released_by_year"),
                    F.coalesce("keep_metadata", F.lit(False)).alias("keep_metadata")))


# ---------------------------------------------------------------- blend / normalise

_ALGO_SQL = """
algo_scores AS (
  SELECT user_id, item_id, 'crowd' AS algo, coalesce(imdb_rating, 0.0) / 10 AS score,
         CASE WHEN imdb_rating >= 8 THEN 'highly rated by the crowd' END AS why
  FROM watchlist LEFT JOIN items USING (item_id)
  UNION ALL
  SELECT w.user_id, w.item_id, 'user_mean' AS algo, um.m / 10 AS score, NULL AS why
  FROM watchlist w JOIN (SELECT user_id, avg(my_rating) AS m FROM ratings GROUP BY user_id) um
    ON um.user_id = w.user_id)"""


def _algo_scores(spark, sf_dir):
    w = tb.watchlist(spark, sf_dir)
    it = tb.items(spark, sf_dir).select("item_id", "imdb_rating")
    crowd = w.join(it, "item_id", "left").select(
        "user_id", "item_id", F.lit("crowd").alias("algo"),
        (F.coalesce("imdb_rating", F.lit(0.0)) / 10).alias("score"),
        F.when(F.col("imdb_rating") >= 8, F.lit("highly rated by the crowd")).alias("why"))
    um = tb.ratings(spark, sf_dir).groupBy("user_id").agg(F.avg("my_rating").alias("m"))
    mean = w.join(um, "user_id").select(
        "user_id", "item_id", F.lit("user_mean").alias("algo"), (F.col("m") / 10).alias("score"),
        F.lit(None).cast("string").alias("why"))
    return crowd, mean


@query("blend_scores", tb.with_views(f""",{_ALGO_SQL.strip()}
SELECT user_id, item_id, {R('avg(score)')} AS score,
  coalesce(nullif(string_agg(why, '; ' ORDER BY algo), ''), '{WHY_BLEND_DEFAULT}') AS why_explainer
FROM algo_scores GROUP BY user_id, item_id""", "items", "ratings", "watchlist"))
def blend_scores_q(spark, sf_dir):
    b = rk.blend(*_algo_scores(spark, sf_dir))
    return b.select("user_id", "item_id", r6("score").alias("score"), "why_explainer")


@query("normalize_scores", tb.with_views(f""",{_ALGO_SQL.strip()},
s AS (SELECT user_id, item_id, score FROM algo_scores WHERE algo = 'crowd'),
b AS (SELECT user_id, min(score) lo, max(score) hi FROM s GROUP BY user_id)
SELECT s.user_id, s.item_id,
  {R('CASE WHEN hi - lo > 0 THEN (score - lo) / (hi - lo) ELSE 0.5 END')} AS score
FROM s JOIN b USING (user_id)""", "items", "ratings", "watchlist"))
def normalize_scores_q(spark, sf_dir):
    crowd, _ = _algo_scores(spark, sf_dir)
    n = rk.normalize_scores(crowd.select("user_id", "item_id", "score"))
    return n.select("user_id", "item_id", r6("score").alias("score"))


# ---------------------------------------------------------------- P03 P04 P05 on raw log rows

@query("validate_quarantine", """
SELECT event_id, item_const, action, rating,
  CASE WHEN NOT regexp_matches(item_const, '^tt\\d{7,}$') THEN 'bad_id'
       WHEN action NOT IN ('rate', 'watchlist_add', 'watchlist_remove') THEN 'bad_action'
       WHEN (rating IS NOT NULL AND NOT (rating BETWEEN 1 AND 10))
            OR (action = 'rate' AND rating IS NULL) THEN 'bad_rating' END AS reason
FROM (SELECT event_id,
        'tt' || CASE WHEN length(json_extract_string(props, '$.k')) < 7 THEN lpad(json_extract_string(props, '$.k'), 7, '0')
             ELSE json_extract_string(props, '$.k') END AS item_const,
        CASE event_type WHEN 'purchase' THEN 'rate' WHEN 'signup' THEN 'watchlist_add'
             WHEN 'error' THEN 'watchlist_remove' ELSE event_type END AS action,
        CASE WHEN event_type = 'purchase' THEN CAST(round_even(TRY_CAST(CAST(value AS VARCHAR) AS DOUBLE), 0) AS INT)
        END AS rating
      FROM events)""")
def validate_quarantine(spark, sf_dir):
    """Every event as a raw action-log row: the item constant is formatted from ``props.k``,
    the rating text parsed tolerantly and rounded half-even (P03, P04); P05 tags each row
    clean (NULL reason) or with its quarantine reason."""
    from ..functions.constants import ACTIONS
    from ..functions.scalar import rating_int
    from ..sources.ingest import tag_invalid
    ev = tb.table(spark, sf_dir, "events")
    et, k = F.col("event_type"), F.get_json_object("props", "$.k")
    raw = ev.select(
        "event_id",
        F.concat(F.lit("tt"), F.when(F.length(k) < 7, F.lpad(k, 7, "0")).otherwise(k)).alias("item_const"),
        F.when(et == "purchase", "rate").when(et == "signup", "watchlist_add")
        .when(et == "error", "watchlist_remove").otherwise(et).alias("action"),
        F.when(et == "purchase", rating_int(F.col("value"))).alias("rating"))
    return tag_invalid(raw, "item_const", "rating", "action", ACTIONS)


# ---------------------------------------------------------------- the library path

def _pipeline_sql(before: bool) -> str:
    only = f"title_type IN ({MOVIES_SQL})"
    return tb.with_views(f""",
{_HYBRID_SQL.strip()},
parts AS (SELECT user_id, item_id, 'hybrid' AS algo, score FROM scored UNION ALL
  SELECT w.user_id, w.item_id, 'crowd', {R('coalesce(i.imdb_rating, 0.0)')} FROM watchlist w
  LEFT JOIN items i ON i.item_id = w.item_id
  WHERE NOT EXISTS (SELECT 1 FROM ratings r WHERE r.user_id = w.user_id AND r.item_id = w.item_id)),
pb AS (SELECT user_id, algo, min(score) AS lo, max(score) AS hi FROM parts GROUP BY user_id, algo),
blended AS (SELECT p.user_id, p.item_id, {R('avg(CASE WHEN hi - lo > 0 THEN (score - lo) / (hi - lo) ELSE 0.5 END)')} AS score
  FROM parts p JOIN pb ON pb.user_id = p.user_id AND pb.algo = p.algo GROUP BY p.user_id, p.item_id),
ranked AS (SELECT b.*, i.title, i.year, i.genres, i.title_type, CAST(row_number() OVER (PARTITION BY b.user_id
    ORDER BY b.score DESC NULLS LAST, coalesce(CAST(i.num_votes AS DOUBLE), 0) DESC,
    coalesce(CAST(i.year AS DOUBLE), 0) DESC, b.item_id ASC) AS BIGINT) AS rank
  FROM blended b LEFT JOIN items i ON i.item_id = b.item_id {f"WHERE {only}" if before else ""})
SELECT user_id, rank, item_id, coalesce(title, '') AS title, year, coalesce(genres, '') AS genres, title_type, score,
  '{WHY_BLEND_DEFAULT}' AS why_explainer
FROM ranked WHERE rank <= 10 {"" if before else f"AND {only}"}""", "items", "ratings", "watchlist")


def _pipeline(spark, sf_dir, before: bool):
    from ..operators import algorithms as al
    data = al.Dataset(tb.ratings(spark, sf_dir), tb.watchlist(spark, sf_dir), tb.items(spark, sf_dir))
    return al.recommend(data, ["hybrid", "crowd"], k=10, content_type="movies", filter_before=before,
                        movie_types=TEST_MOVIE_TYPES, tv_types=TEST_TV_TYPES)


@query("pipeline_recommend", _pipeline_sql(True))
def pipeline_recommend(spark, sf_dir):
    """§2.10: two algorithms by name, normalised, blended, filtered, top 10."""
    return _pipeline(spark, sf_dir, True)


@query("pipeline_recommend_after", _pipeline_sql(False))
def pipeline_recommend_after(spark, sf_dir):
    """As ``pipeline_recommend`` with the content filter after the top-k."""
    return _pipeline(spark, sf_dir, False)
