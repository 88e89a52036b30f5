"""Registered queries: imputation, dates, tokens, vectors, one-hots, alignment, signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import content as cv
from ..functions.constants import AS_OF, GENRES, WHY_ALS_DEFAULT, WHY_HIGH, WHY_SEED, YEAR_EDGES
from ..functions.scalar import (bounded_scale, clip_rating, crowd_signal, hybrid_signal,
                                pred_to_score, r6, recency_weight)
from ..functions.scalar import r6_sql as R
from ..operators import features as fe
from ..operators.salting import ROWS, counted, join_stats
from ..sources import testbind as tb
from .registry import query

# ----------------------------------------------------------------------------- bindings


def rated_items(spark, sf_dir):
    """Ratings with item metadata: the training frame of the feature builder. Rows without metadata stay, the
    imputer fills them."""
    return tb.ratings(spark, sf_dir).join(tb.items(spark, sf_dir), "item_id", "left")


def watch_items(spark, sf_dir):
    """Unrated watchlist rows with item metadata: the scoring frame."""
    w = tb.watchlist(spark, sf_dir).join(tb.ratings(spark, sf_dir).select("user_id", "item_id"),
                                         ["user_id", "item_id"], "left_anti")
    return w.join(tb.items(spark, sf_dir), "item_id", "left")


RI_CTE = """, ri AS (SELECT r.user_id, r.item_id, r.my_rating, r.rated_at, i.title, i.year,
   i.genres, i.directors, i.imdb_rating, i.num_votes, i.title_type, i.runtime, i.release_date
 FROM ratings r LEFT JOIN items i ON i.item_id = r.item_id)"""

WI_CTE = """, wi AS (SELECT w.user_id, w.item_id, CAST(NULL AS DATE) AS rated_at, i.title, i.year,
   i.genres, i.directors, i.imdb_rating, i.num_votes, i.title_type, i.runtime, i.release_date
 FROM watchlist w LEFT JOIN items i ON i.item_id = w.item_id
 WHERE NOT EXISTS (SELECT 1 FROM ratings r WHERE r.user_id = w.user_id AND r.item_id = w.item_id))"""


def _tok(expr: str) -> str:
    """DuckDB twin of ``split_list``: trimmed non-empty tokens."""
    return (f"list_filter(list_transform(string_split(coalesce({expr}, ''), ','), lambda t: trim(t)),"
            f" lambda t: t <> '')")


def _clean(expr: str) -> str:
    return f"substr(regexp_replace({expr}, '[^A-Za-z0-9]+', '_', 'g'), 1, 30)"


def base_sql(src: str, train: str, out: str) -> str:
    """DuckDB twin of ``features.base_features`` under the research preset, statistics fitted
    on CTE ``train`` and applied to CTE ``src``; defines CTEs ``{out}_med`` and ``{out}``."""
    has_date = src != "wi"
    first = (f"LEFT JOIN (SELECT user_id, min(rated_at) AS first_at FROM {src} GROUP BY user_id) f"
             f" ON f.user_id = s.user_id") if has_date else ""
    days = "coalesce(CAST(s.rated_at - f.first_at AS DOUBLE), 0.0)" if has_date else "0.0"
    return f""", {out}_med AS (SELECT median(CAST(year AS DOUBLE)) AS my,
   median(CAST(runtime AS DOUBLE)) AS mr, coalesce(median(imdb_rating), 7.0) AS mi,
   median(CAST(num_votes AS DOUBLE)) AS mv,
   median(CAST(DATE '{AS_OF}' - release_date AS DOUBLE)) AS ma FROM {train}),
{out}_0 AS (SELECT s.*,
   least(greatest(coalesce(CAST(s.year AS DOUBLE), m.my), 1900.0), 2025.0) AS year_f,
   coalesce(CAST(s.runtime AS DOUBLE), m.mr) AS runtime_f,
   coalesce(s.imdb_rating, m.mi) AS imdb,
   least(coalesce(CAST(s.num_votes AS DOUBLE), m.mv), 2000000.0) AS votes,
   CAST(coalesce(year(s.rated_at), 0) AS INT) AS rate_year,
   CAST(coalesce(month(s.rated_at), 0) AS INT) AS rate_month,
   CAST(coalesce(isodow(s.rated_at) - 1, 0) AS INT) AS rate_dow,
   CAST(coalesce(month(s.release_date), 0) AS INT) AS rel_month,
   {days} AS days_since_first_rate,
   coalesce(CAST(DATE '{AS_OF}' - s.release_date AS DOUBLE), m.ma, 0.0) AS age_at_rating_days,
   CAST(len({_tok('s.directors')}) > 0 AS INT) AS has_director_info
 FROM {src} s CROSS JOIN {out}_med m {first}),
{out} AS (SELECT *, ln(1 + votes) AS log_votes, CAST(floor(year_f / 10) * 10 AS INT) AS decade
 FROM {out}_0)"""


NUMERIC_SQL = {"year": "year_f", "runtime": "runtime_f", "imdb": "imdb", "log_votes": "log_votes",
               "days_since_first_rate": "days_since_first_rate",
               "age_at_rating_days": "age_at_rating_days"}


def _research(spark, sf_dir):
    ri = rated_items(spark, sf_dir)
    return ri, fe.fit(ri, fe.RESEARCH)


# ----------------------------------------------------------------------------- P07–P10

@query("impute_clip", tb.with_views(f"""{RI_CTE}{base_sql('ri', 'ri', 'b')}
SELECT user_id, item_id, year_f, runtime_f, {R('imdb')} AS imdb, votes,
  {R('log_votes')} AS log_votes, decade FROM b""", "items", "ratings"))
def impute_clip(spark, sf_dir):
    ri = rated_items(spark, sf_dir)
    ff = fe.FittedFeatures(fe.RESEARCH, fe.fit_medians(ri), [])
    b = fe.base_features(ri, ff)
    return b.select("user_id", "item_id", "year_f", "runtime_f", r6("imdb").alias("imdb"),
                    "votes", r6("log_votes").alias("log_votes"), "decade")


# ----------------------------------------------------------------------------- P06, P11–P13

@query("date_features", tb.with_views(f"""{RI_CTE}{base_sql('ri', 'ri', 'b')}
SELECT user_id, item_id, rate_year, rate_month, rate_dow, rel_month, days_since_first_rate,
  age_at_rating_days FROM b""", "items", "ratings"))
def date_features(spark, sf_dir):
    ri = rated_items(spark, sf_dir)
    ff = fe.FittedFeatures(fe.RESEARCH, fe.fit_medians(ri), [])
    b = fe.base_features(ri, ff)
    return b.select("user_id", "item_id", "rate_year", "rate_month", "rate_dow", "rel_month",
                    "days_since_first_rate", "age_at_rating_days")


# ----------------------------------------------------------------------------- P14–P16, A05

@query("list_tokens", tb.with_views(f"""
SELECT item_id, 'genres' AS field, tok AS token, {_clean('tok')} AS clean_token
FROM (SELECT item_id, unnest({_tok('genres')}) AS tok FROM items)
UNION ALL
SELECT item_id, 'directors' AS field, tok AS token, {_clean('tok')} AS clean_token
FROM (SELECT item_id, unnest({_tok('directors')}) AS tok FROM items)""", "items"))
def list_tokens(spark, sf_dir):
    it = tb.items(spark, sf_dir)
    parts = [it.select("item_id", F.lit(f).alias("field"), F.explode(cv.split_list(f)).alias("token"))
             for f in ("genres", "directors")]
    u = parts[0].unionByName(parts[1])
    return u.withColumn("clean_token", cv.clean_name("token"))


@query("director_info", tb.with_views(f"""
SELECT item_id, CAST(len({_tok('directors')}) AS INT) AS n_directors,
  CAST(len({_tok('directors')}) > 0 AS INT) AS has_director_info FROM items""", "items"))
def director_info(spark, sf_dir):
    d = cv.split_list("directors")
    return tb.items(spark, sf_dir).select("item_id", F.size(d).cast("int").alias("n_directors"),
                                          (F.size(d) > 0).cast("int").alias("has_director_info"))


@query("vocabulary", tb.with_views(f"""
SELECT field, token, CAST(row_number() OVER (PARTITION BY field ORDER BY token) AS BIGINT) AS idx
FROM (SELECT DISTINCT 'genres' AS field, unnest({_tok('genres')}) AS token FROM items
      UNION SELECT DISTINCT 'title_type', title_type FROM items WHERE title_type IS NOT NULL
      UNION SELECT DISTINCT 'decade', CAST(CAST(floor(year / 10) * 10 AS INT) AS VARCHAR)
            FROM items WHERE year IS NOT NULL
      UNION SELECT DISTINCT 'rate_month', CAST(month(rated_at) AS VARCHAR) FROM ratings WHERE rated_at IS NOT NULL
      UNION SELECT DISTINCT 'rate_dow', CAST((dayofweek(rated_at) + 6) % 7 AS VARCHAR)
            FROM ratings WHERE rated_at IS NOT NULL)""", "items", "ratings"))
def vocabulary(spark, sf_dir):
    """Distinct sorted tokens of the five categorical fields, indexed from 1; the per-field
    window runs over distinct values only."""
    it = tb.items(spark, sf_dir)
    g = it.select(F.lit("genres").alias("field"), F.explode(cv.split_list("genres")).alias("token"))
    t = it.where(F.col("title_type").isNotNull()).select(F.lit("title_type").alias("field"),
                                                        F.col("title_type").alias("token"))
    d = it.where(F.col("year").isNotNull()).select(
        F.lit("decade").alias("field"),
        (F.floor(F.col("year") / 10) * 10).cast("int").cast("string").alias("token"))
    from pyspark.sql import Window
    r = tb.ratings(spark, sf_dir).where(F.col("rated_at").isNotNull())
    m = r.select(F.lit("rate_month").alias("field"), F.month("rated_at").cast("string").alias("token"))
    w = r.select(F.lit("rate_dow").alias("field"), F.weekday("rated_at").cast("string").alias("token"))
    v = g.unionByName(t).unionByName(d).unionByName(m).unionByName(w).distinct()
    return v.withColumn("idx", F.row_number().over(
        Window.partitionBy("field").orderBy("token")).cast("bigint"))


# ----------------------------------------------------------------------------- A04, X16

@query("director_topk", tb.with_views(f"""{RI_CTE}
SELECT director, cnt, CAST(row_number() OVER (ORDER BY cnt DESC, director) AS BIGINT) AS rank
FROM (SELECT tok AS director, CAST(count(*) AS BIGINT) AS cnt
      FROM (SELECT unnest({_tok('directors')}) AS tok FROM ri) GROUP BY tok)
QUALIFY rank <= 30""", "items", "ratings"))
def director_topk(spark, sf_dir):
    from pyspark.sql import Window
    top = fe.top_directors(rated_items(spark, sf_dir), 30)
    # ≤ 30 rows by construction: numbering them needs no partitioning
    return top.withColumn("rank", F.row_number().over(
        Window.orderBy(F.col("cnt").desc(), F.col("director"))).cast("bigint"))


# ----------------------------------------------------------------------------- X01–X03, X07

def _genre_slots_sql() -> str:
    return "(VALUES " + ", ".join(f"({i + 1}, '{g}')" for i, g in enumerate(GENRES)) + ") AS gl(slot, name)"


def _year_idx_sql(y: str) -> str:
    cases = " ".join(f"WHEN {y} <= {e} THEN {i}" for i, e in enumerate(YEAR_EDGES))
    return f"CASE WHEN {y} IS NULL THEN NULL {cases} ELSE {len(YEAR_EDGES)} END"


GENRE_VEC_SQL = f"""gv AS (
  SELECT item_id, slot, 1.0 / sqrt(count(*) OVER (PARTITION BY item_id)) AS value
  FROM (SELECT DISTINCT i.item_id, gl.slot
        FROM (SELECT item_id, unnest({_tok('genres')}) AS tok FROM items) i
        JOIN {_genre_slots_sql()} ON gl.name = i.tok))"""


@query("genre_vector", tb.with_views(f""", {GENRE_VEC_SQL}
SELECT item_id, CAST(slot AS INT) AS slot, {R('value')} AS value FROM gv""", "items"))
def genre_vector(spark, sf_dir):
    it = cv.with_genre_vector(tb.items(spark, sf_dir).select("item_id", "genres"), out="gv")
    # the vector always has 22 slots: the _outer generator yields the same rows and keeps
    # Catalyst from inferring a size(gv) > 0 filter that would inline the vector below the scan
    e = it.select("item_id", F.posexplode_outer("gv").alias("pos", "value"))
    return e.where(F.col("value") > 0).select(
        "item_id", (F.col("pos") + 1).cast("int").alias("slot"), r6("value").alias("value"))


@query("year_bucket", tb.with_views(f"""
SELECT item_id, year, CAST({_year_idx_sql('year')} AS INT) AS bucket FROM items""", "items"))
def year_bucket(spark, sf_dir):
    it = tb.items(spark, sf_dir)
    return it.select("item_id", "year", cv.year_bucket_index("year").alias("bucket"))


@query("content_vector", tb.with_views(f""", {GENRE_VEC_SQL}
SELECT item_id, CAST(slot AS INT) AS slot, {R('value')} AS value FROM gv
UNION ALL
SELECT item_id, CAST(23 + {_year_idx_sql('year')} AS INT) AS slot, 1.0 AS value
FROM items WHERE year IS NOT NULL""", "items"))
def content_vector(spark, sf_dir):
    it = cv.with_content_vector(tb.items(spark, sf_dir).select("item_id", "genres", "year"), out="v")
    e = it.select("item_id", F.posexplode_outer("v").alias("pos", "value"))   # 28 slots always
    return e.where(F.col("value") > 0).select(
        "item_id", (F.col("pos") + 1).cast("int").alias("slot"), r6("value").alias("value"))


@query("recency_weight", tb.with_views(f"""
SELECT item_id, year, {R('CASE WHEN year IS NULL THEN 1.0 ELSE 0.5 + 0.5 * (0.6 + 0.4 * ((least(greatest(year, 1980), 2025) - 1980) / 45.0)) END')} AS weight
FROM items""", "items"))
def recency_weight_q(spark, sf_dir):
    it = tb.items(spark, sf_dir)
    return it.select("item_id", "year", r6(recency_weight("year", 0.5)).alias("weight"))


# ----------------------------------------------------------------------------- X04 on embeddings

@query("cosine_embeddings", """
WITH e AS (SELECT vec_id, label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS pos
           FROM embeddings),
c AS (SELECT label, pos, avg(CAST(v AS DOUBLE)) AS cv FROM e GROUP BY label, pos),
s AS (SELECT e.vec_id, e.label, sum(CAST(e.v AS DOUBLE) * c.cv) AS d,
        sum(CAST(e.v AS DOUBLE) * CAST(e.v AS DOUBLE)) AS nv, sum(c.cv * c.cv) AS nc
      FROM e JOIN c ON c.label = e.label AND c.pos = e.pos GROUP BY e.vec_id, e.label)
SELECT vec_id, label,
  """ + R("CASE WHEN nv = 0 OR nc = 0 THEN 0.0 ELSE d / (sqrt(nv) * sqrt(nc)) END") + """ AS cosine
FROM s""")
def cosine_embeddings(spark, sf_dir):
    """X04 against each label's centroid: per-label mean vector (a partial groupBy over
    (label, position), bounded by labels × dims), joined to every vector on ``label``."""
    emb = tb.embeddings(spark, sf_dir).select(
        "vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("vec"))
    pos = emb.select("label", F.posexplode("vec").alias("pos", "v"))
    cen = (pos.groupBy("label", "pos").agg(*counted(F.avg("v").alias("m")))
           .groupBy("label")
           .agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("_c"), F.max(ROWS).alias(ROWS))
           .select("label", F.transform("_c", lambda s: s["m"]).alias("centroid"), ROWS))
    j = join_stats(emb, cen, ["label"])
    return j.select("vec_id", "label", r6(cv.cosine("vec", "centroid")).alias("cosine"))


# ----------------------------------------------------------------------------- X05, X06, X17

def _content_list_sql(g: str, y: str) -> str:
    toks = _tok(g)
    hits = [f"CAST(list_contains({toks}, '{x}') AS DOUBLE)" for x in GENRES]
    n = " + ".join(hits)
    gv = ", ".join(f"CASE WHEN ({n}) > 0 THEN {h} / sqrt({n}) ELSE 0.0 END" for h in hits)
    idx = _year_idx_sql(y)
    yb = ", ".join(f"CASE WHEN ({idx}) = {i} THEN 1.0 ELSE 0.0 END" for i in range(len(YEAR_EDGES) + 1))
    return f"[{gv}, {yb}]"


SEED_SQL = f""", cvec AS (SELECT item_id, {_content_list_sql('genres', 'year')} AS vec FROM items),
seedl AS (SELECT r.user_id, unnest(c.vec) AS v, generate_subscripts(c.vec, 1) AS pos
          FROM ratings r JOIN cvec c ON c.item_id = r.item_id WHERE r.my_rating = 10),
seed AS (SELECT user_id, list(m ORDER BY pos) AS sv
         FROM (SELECT user_id, pos, avg(v) AS m FROM seedl GROUP BY user_id, pos) GROUP BY user_id),
cand AS (SELECT w.user_id, w.item_id FROM watchlist w
         WHERE NOT EXISTS (SELECT 1 FROM ratings r WHERE r.user_id = w.user_id AND r.item_id = w.item_id)),
sim AS (SELECT c.user_id, c.item_id,
          least(greatest(list_dot_product(s.sv, v.vec), 0.0), 1.0) AS similarity
        FROM cand c JOIN seed s ON s.user_id = c.user_id JOIN cvec v ON v.item_id = c.item_id)"""


def seed_vectors(ratings, items, seed_rating: int = 10):
    """Per-user mean content vector of the seed titles (items the user rated
    ``seed_rating``); seeds missing from the catalog are skipped by the inner join.

    posexplode → partial groupBy(user, pos) → 28-slot array per user: the per-user state is
    28 numbers however many seeds the user has."""
    vecs = cv.with_content_vector(items.select("item_id", "genres", "year"), out="vec")
    seeds = (ratings.where(F.col("my_rating") == seed_rating).select("user_id", "item_id")
             .join(vecs.select("item_id", "vec"), "item_id"))
    p = seeds.select("user_id", F.posexplode_outer("vec").alias("pos", "v"))   # 28 slots always
    return (p.groupBy("user_id", "pos").agg(F.avg("v").alias("m"))
            .groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("_s"))
            .select("user_id", F.transform("_s", lambda s: s["m"]).alias("seed_vec")))


def _seed_sim(spark, sf_dir):
    r, it = tb.ratings(spark, sf_dir), tb.items(spark, sf_dir)
    sv = seed_vectors(r, it)
    cand = tb.watchlist(spark, sf_dir).join(r.select("user_id", "item_id"),
                                             ["user_id", "item_id"], "left_anti")
    iv = cv.with_content_vector(it.select("item_id", "genres", "year"), out="vec") \
        .select("item_id", "vec")
    return join_stats(cand, sv, ["user_id"], sizes=tb.watchlist(spark, sf_dir)).join(iv, "item_id").select(
        "user_id", "item_id", cv.seed_similarity("seed_vec", "vec").alias("similarity"))


@query("seed_similarity", tb.with_views(f"""{SEED_SQL}
SELECT user_id, item_id, {R('similarity')} AS similarity, similarity > 0.6 AS similar_to_seeds
FROM sim""", "items", "ratings", "watchlist"))
def seed_similarity(spark, sf_dir):
    s = _seed_sim(spark, sf_dir)
    return s.select("user_id", "item_id", r6("similarity").alias("similarity"),
                    (F.col("similarity") > 0.6).alias("similar_to_seeds"))


@query("explanations", tb.with_views(f"""{SEED_SQL},
um AS (SELECT user_id, avg(my_rating) AS m FROM ratings GROUP BY user_id),
p AS (SELECT c.user_id, c.item_id,
        0.3 * coalesce(um.m, coalesce(i.imdb_rating, 0.0)) + 0.7 * coalesce(i.imdb_rating, 0.0) AS pred,
        sim.similarity
      FROM cand c LEFT JOIN items i ON i.item_id = c.item_id
      LEFT JOIN um ON um.user_id = c.user_id
      LEFT JOIN sim ON sim.user_id = c.user_id AND sim.item_id = c.item_id)
SELECT user_id, item_id, {R('pred')} AS pred,
  coalesce(nullif(concat_ws('; ', CASE WHEN similarity > 0.6 THEN '{WHY_SEED}' END,
                                   CASE WHEN pred >= 8 THEN '{WHY_HIGH}' END), ''),
           '{WHY_ALS_DEFAULT}') AS why
FROM p""", "items", "ratings", "watchlist"))
def explanations(spark, sf_dir):
    """X17 on the hybrid prediction of every unrated watchlist item."""
    r, it = tb.ratings(spark, sf_dir), tb.items(spark, sf_dir)
    cand = tb.watchlist(spark, sf_dir).join(r.select("user_id", "item_id"),
                                             ["user_id", "item_id"], "left_anti")
    um = r.groupBy("user_id").agg(F.avg("my_rating").alias("m"))
    pred = hybrid_signal(F.lit(None), F.col("m"), crowd_signal("imdb_rating"))
    p = (join_stats(cand.join(it.select("item_id", "imdb_rating"), "item_id", "left"), um, ["user_id"], "left",
                    sizes=tb.watchlist(spark, sf_dir))
         .join(_seed_sim(spark, sf_dir), ["user_id", "item_id"], "left")
         .select("user_id", "item_id", pred.alias("pred"), "similarity"))
    why = F.concat_ws("; ", F.when(F.col("similarity") > 0.6, F.lit(WHY_SEED)),
                      F.when(F.col("pred") >= 8, F.lit(WHY_HIGH)))
    return p.select("user_id", "item_id", r6("pred").alias("pred"),
                    F.coalesce(F.nullif(why, F.lit("")), F.lit(WHY_ALS_DEFAULT)).alias("why"))


# ----------------------------------------------------------------------------- X19, X20

@query("crowd_signal", tb.with_views("""
SELECT item_id, coalesce(imdb_rating, 0.0) AS crowd, coalesce(imdb_rating, 6.5) AS crowd_tuning
FROM items""", "items"))
def crowd_signal_q(spark, sf_dir):
    it = tb.items(spark, sf_dir)
    return it.select("item_id", crowd_signal("imdb_rating").alias("crowd"),
                     crowd_signal("imdb_rating", 6.5).alias("crowd_tuning"))


@query("hybrid_signal", tb.with_views(f"""
SELECT c.user_id, c.item_id, c.my_rating,
  {R('CASE WHEN c.my_rating IS NOT NULL THEN 0.7 * c.my_rating + 0.3 * coalesce(i.imdb_rating, 0.0) ELSE 0.3 * coalesce(um.m, coalesce(i.imdb_rating, 0.0)) + 0.7 * coalesce(i.imdb_rating, 0.0) END')} AS hybrid
FROM (SELECT coalesce(r.user_id, w.user_id) AS user_id, coalesce(r.item_id, w.item_id) AS item_id,
        r.my_rating
      FROM ratings r FULL OUTER JOIN watchlist w ON r.user_id = w.user_id AND r.item_id = w.item_id) c
LEFT JOIN items i ON i.item_id = c.item_id
LEFT JOIN (SELECT user_id, avg(my_rating) AS m FROM ratings GROUP BY user_id) um
  ON um.user_id = c.user_id""", "items", "ratings", "watchlist"))
def hybrid_signal_q(spark, sf_dir):
    from ..operators.catalog import catalog
    r, it = tb.ratings(spark, sf_dir), tb.items(spark, sf_dir)
    c = catalog(r.select("user_id", "item_id", "my_rating"), tb.watchlist(spark, sf_dir)) \
        .select("user_id", "item_id", "my_rating")
    um = r.groupBy("user_id").agg(F.avg("my_rating").alias("m"))
    j = join_stats(c.join(it.select("item_id", "imdb_rating"), "item_id", "left"), um, ["user_id"], "left", sizes=r)
    h = hybrid_signal("my_rating", "m", crowd_signal("imdb_rating"))
    return j.select("user_id", "item_id", "my_rating", r6(h).alias("hybrid"))


# ----------------------------------------------------------------------------- A06, X13

def _std_sql(src: str) -> str:
    cols = ", ".join(f"avg({c}) AS {n}_mu, coalesce(nullif(stddev_samp({c}), 0), 1.0) AS {n}_sd"
                     for n, c in NUMERIC_SQL.items())
    return f", st AS (SELECT {cols} FROM {src})"


def _z_sql(n: str, c: str, t: str = "b") -> str:
    return f"({t}.{c} - st.{n}_mu) / st.{n}_sd"


@query("standardize", tb.with_views(f"""{RI_CTE}{base_sql('ri', 'ri', 'b')}{_std_sql('b')}
""" + "\nUNION ALL\n".join(
    f"SELECT b.user_id, b.item_id, '{n}' AS feature, {R(_z_sql(n, c))} AS z FROM b CROSS JOIN st"
    for n, c in NUMERIC_SQL.items()), "items", "ratings"))
def standardize(spark, sf_dir):
    """A06 + X13: z-scores of the six numeric features with the frame's mean and sample std
    (statistics are one aggregate row; applying them is a projection)."""
    ri = rated_items(spark, sf_dir)
    ff = fe.FittedFeatures(fe.RESEARCH, fe.fit_medians(ri), [])
    b = fe.base_features(ri, ff)
    st = fe.fit_standardizer(b)
    cols = F.array(*[F.struct(F.lit(n).alias("feature"),
                              ((F.col(fe.FILLED.get(n, n)) - st[n][0]) / st[n][1]).alias("z"))
                     for n in fe.NUMERIC])
    return b.select("user_id", "item_id", F.explode_outer(cols).alias("s")).select(   # 6 entries
        "user_id", "item_id", "s.feature", r6("s.z").alias("z"))


# ----------------------------------------------------------------------------- A07, X08, X11, X12

@query("scale_predictions", tb.with_views(f"""
, um AS (SELECT user_id, avg(my_rating) AS m, stddev_pop(my_rating) AS sd FROM ratings GROUP BY user_id),
p AS (SELECT w.user_id, w.item_id,
        0.3 * coalesce(um.m, coalesce(i.imdb_rating, 0.0)) + 0.7 * coalesce(i.imdb_rating, 0.0) AS pred,
        um.m, um.sd
      FROM watchlist w LEFT JOIN items i ON i.item_id = w.item_id LEFT JOIN um ON um.user_id = w.user_id)
SELECT user_id, item_id, {R('pred')} AS pred,
  {R('least(greatest((pred - 1.0) / 9.0, 0.0), 1.0)')} AS score,
  {R('CASE WHEN m IS NULL OR sd IS NULL THEN least(greatest(pred, 1.0), 10.0) WHEN sd = 0 THEN 5.5 ELSE least(greatest(5.5 + 4.5 * tanh((pred - m) / (2.0 * sd)), 1.0), 10.0) END')} AS bounded,
  {R('least(greatest(pred, 1.0), 10.0)')} AS clipped
FROM p""", "items", "ratings", "watchlist"))
def scale_predictions(spark, sf_dir):
    """A07 (per-user target mean and population std) feeding X08, X11 and X12."""
    r, it = tb.ratings(spark, sf_dir), tb.items(spark, sf_dir)
    um = r.groupBy("user_id").agg(F.avg("my_rating").alias("m"),
                                  F.stddev_pop("my_rating").alias("sd"))
    w = tb.watchlist(spark, sf_dir).join(it.select("item_id", "imdb_rating"), "item_id", "left")
    p = (join_stats(w, um, ["user_id"], "left", sizes=tb.watchlist(spark, sf_dir))
         .withColumn("pred", hybrid_signal(F.lit(None), F.col("m"), crowd_signal("imdb_rating"))))
    return p.select("user_id", "item_id", r6("pred").alias("pred"),
                    r6(pred_to_score("pred")).alias("score"),
                    r6(bounded_scale("pred", "m", "sd")).alias("bounded"),
                    r6(clip_rating("pred")).alias("clipped"))


# ----------------------------------------------------------------------------- X14–X16, J08

#: The raw columns beside the six numeric features.
RAW_SQL = {"votes": "votes", "decade": "decade", "rate_year": "rate_year", "rate_month": "rate_month", "rate_dow": "rate_dow",
           "rel_month": "rel_month", "rated_epoch": "coalesce(epoch(rated_at), 0)", "release_epoch": "coalesce(epoch(release_date), 0)"}


def _features_long_sql(src_base: str, train_base: str, st: str | None) -> str:
    """Long-form research features of CTE ``src_base`` with the director top-K of
    ``train_base``'s rows and the standardiser CTE ``st``; without one the numbers and raw columns as they are."""
    if st is None:
        num = "\nUNION ALL\n".join(f"SELECT user_id, item_id, '{n}' AS feature, CAST({c} AS DOUBLE) AS value FROM {src_base}"
                                   for n, c in (NUMERIC_SQL | RAW_SQL).items())
    else:
        num = "\nUNION ALL\n".join(
            f"SELECT s.user_id, s.item_id, '{n}' AS feature, {_z_sql(n, c, 's')} AS value "
            f"FROM {src_base} s CROSS JOIN {st} st" for n, c in NUMERIC_SQL.items())
    oh = [("'type_' || coalesce(title_type, 'Unknown')"),
          ("'dec_' || CAST(coalesce(decade, 0) AS VARCHAR)"),
          ("'rate_m_' || CAST(rate_month AS VARCHAR)"),
          ("'rate_dow_' || CAST(rate_dow AS VARCHAR)"),
          ("'rel_m_' || CAST(rel_month AS VARCHAR)")]
    ohs = "\nUNION ALL\n".join(f"SELECT user_id, item_id, {e} AS feature, 1.0 AS value FROM {src_base}"
                               for e in oh)
    return f"""{num}
UNION ALL
{ohs}
UNION ALL
SELECT DISTINCT user_id, item_id, 'g_' || tok AS feature, 1.0 AS value
FROM (SELECT user_id, item_id, unnest({_tok('genres')}) AS tok FROM {src_base})
UNION ALL
SELECT DISTINCT user_id, item_id, 'dir_' || tok AS feature, 1.0 AS value
FROM (SELECT user_id, item_id, unnest({_tok('directors')}) AS tok FROM {src_base})
WHERE tok IN (SELECT director FROM (SELECT tok AS director, count(*) AS cnt
      FROM (SELECT unnest({_tok('directors')}) AS tok FROM {train_base}) GROUP BY tok
      ORDER BY cnt DESC, director LIMIT 30))"""


@query("features_long", tb.with_views(f"""{RI_CTE}{base_sql('ri', 'ri', 'b')}{_std_sql('b')}
SELECT user_id, item_id, feature, {R('value')} AS value FROM (
{_features_long_sql('b', 'ri', 'st')})""", "items", "ratings"))
def features_long(spark, sf_dir):
    """X14 one-hots, X15 multi-hot genres, X16 top-30 directors and standardised numerics, in
    long form, fitted on the rated frame itself."""
    ri, ff = _research(spark, sf_dir)
    lf = fe.long_features(ri, ff)
    return lf.select("user_id", "item_id", "feature", r6("value").alias("value"))


@query("features_aligned", tb.with_views(f"""{RI_CTE}{WI_CTE}{base_sql('ri', 'ri', 'b')}{_std_sql('b')}
{base_sql('wi', 'ri', 'wb')},
tl AS ({_features_long_sql('b', 'ri', 'st')}),
wl AS ({_features_long_sql('wb', 'ri', 'st')})
SELECT user_id, item_id, feature, {R('value')} AS value FROM wl
WHERE feature IN (SELECT feature FROM tl)""", "items", "ratings", "watchlist"))
def features_aligned(spark, sf_dir):
    """J08(a): watchlist features in the training feature space — statistics, top-K and
    vocabulary fitted on the rated rows; unseen features are dropped."""
    ri, ff = _research(spark, sf_dir)
    wl = fe.long_features(watch_items(spark, sf_dir).drop("my_rating"), ff)
    vocab = ri.sparkSession.createDataFrame([(v,) for v in ff.vocabulary], "feature string")
    al = fe.align(wl, vocab)
    return al.select("user_id", "item_id", "feature", r6("value").alias("value"))


@query("features_union", tb.with_views(f"""{RI_CTE}{WI_CTE}{base_sql('ri', 'ri', 'b')}{_std_sql('b')}
{base_sql('wi', 'ri', 'wb')},
tl AS ({_features_long_sql('b', 'ri', 'st')}),
wl AS ({_features_long_sql('wb', 'ri', 'st')}),
a AS (SELECT feature, count(*) AS n FROM tl GROUP BY feature),
w AS (SELECT feature, count(*) AS n FROM wl GROUP BY feature)
SELECT coalesce(a.feature, w.feature) AS feature, CAST(coalesce(a.n, 0) AS BIGINT) AS rows_a,
  CAST(coalesce(w.n, 0) AS BIGINT) AS rows_b
FROM a FULL OUTER JOIN w ON a.feature = w.feature""", "items", "ratings", "watchlist"))
def features_union(spark, sf_dir):
    """J08(b): the union feature space of rated and watchlist items."""
    ri, ff = _research(spark, sf_dir)
    return fe.union_space(fe.long_features(ri, ff),
                          fe.long_features(watch_items(spark, sf_dir).drop("my_rating"), ff))


@query("features_union_rows", tb.with_views(f"""{RI_CTE}{WI_CTE}{base_sql('ri', 'ri', 'b')}{_std_sql('b')}
{base_sql('wi', 'ri', 'wb')},
tl AS ({_features_long_sql('b', 'ri', 'st')}),
wl AS ({_features_long_sql('wb', 'ri', 'st')}),
num AS (SELECT feature, row_number() OVER (ORDER BY feature) - 1 AS idx, count(*) OVER () AS size
        FROM (SELECT feature FROM tl UNION SELECT feature FROM wl)),
lf AS (SELECT 'a' AS side, * FROM tl UNION ALL SELECT 'b' AS side, * FROM wl)
SELECT side, user_id, item_id, CAST(max(size) AS BIGINT) AS size, string_agg(idx, ',' ORDER BY idx) AS indices,
  {R('sum(value * (idx + 1))')} AS weighed
FROM lf JOIN num USING (feature) GROUP BY side, user_id, item_id""", "items", "ratings", "watchlist"))
def features_union_rows(spark, sf_dir):
    """J08(b): rated and watchlist rows over the union feature space, 0 where not listed. ``weighed`` sums
    value × (index + 1) over a row's entries."""
    ri, ff = _research(spark, sf_dir)
    rows = fe.union_packed_rows(fe.feature_rows(ri, ff), fe.feature_rows(watch_items(spark, sf_dir).drop("my_rating"), ff))
    weighed = F.aggregate(F.arrays_zip("indices", "values"), F.lit(0.0),
                          lambda acc, c: acc + c["values"] * (c["indices"] + 1))
    return rows.select("side", "user_id", "item_id", "size", F.array_join(F.col("indices").cast("array<string>"), ",").alias("indices"),
                       r6(weighed).alias("weighed"))


@query("target_stats", tb.with_views(f"""
SELECT user_id, count(*) AS n, {R('avg(my_rating)')} AS mean, {R('stddev_pop(my_rating)')} AS std,
  min(my_rating) AS min_rating, max(my_rating) AS max_rating FROM ratings GROUP BY user_id""", "ratings"))
def target_stats(spark, sf_dir):
    """Count, mean, population std, min and max of every user's ratings."""
    y = F.col("my_rating")
    return tb.ratings(spark, sf_dir).groupBy("user_id").agg(
        F.count("*").alias("n"), r6(F.avg(y)).alias("mean"), r6(F.stddev_pop(y)).alias("std"),
        F.min(y).alias("min_rating"), F.max(y).alias("max_rating"))
