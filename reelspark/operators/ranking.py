"""Exclusion, lookup, normalisation, blending, filtering and per-user top-k.

J02 J03 J05 J06 F01–F04 A02 A03 T01–T03 W02.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import MOVIE_TYPES, TV_TYPES, WHY_BLEND_DEFAULT
from .salting import counted, join_stats


def exclude_rated(candidates: DataFrame, ratings: DataFrame,
                  key: list[str] | None = None) -> DataFrame:
    """Candidates with no rating by the same user (left anti join on user and item)."""
    key = key or ["user_id", "item_id"]
    return candidates.join(ratings.select(*key), key, "left_anti")


def attach(df: DataFrame, lookup: DataFrame, key: list[str] | str, how: str = "left") -> DataFrame:
    """Left lookup of metadata or predictions; a missing match stays NULL.

    No broadcast hint: the item table grows with the data, so the choice is left to AQE,
    which broadcasts only when the runtime size is under ``autoBroadcastJoinThreshold``.
    """
    return df.join(lookup, key, how)


def content_types(content_type: str, movie_types=None, tv_types=None) -> list[str] | None:
    if content_type == "all":
        return None
    if content_type == "movies":
        return list(movie_types or MOVIE_TYPES)
    if content_type == "tv":
        return list(tv_types or TV_TYPES)
    raise ValueError(f"Unknown content_type: {content_type}")


def filter_content_type(df: DataFrame, content_type: str, type_col: str = "title_type",
                        movie_types=None, tv_types=None) -> DataFrame:
    """keep rows of the requested content type; ``all`` is a no-op."""
    allowed = content_types(content_type, movie_types, tv_types)
    if allowed is None:
        return df
    if type_col not in df.columns:
        raise ValueError("title type metadata required for content-type filtering")
    return df.where(F.col(type_col).isin(allowed))


def require_metadata(df: DataFrame, type_col: str = "title_type") -> None:
    """fail when the type column is missing or entirely NULL (one global aggregate)."""
    if type_col not in df.columns:
        raise ValueError("title type metadata required for content-type filtering")
    row = df.agg(F.max(F.col(type_col).isNotNull().cast("int")).alias("ok")).first()
    if not row or not row["ok"]:
        raise ValueError("title type metadata required for content-type filtering")


def released_filter(df: DataFrame, as_of: str, max_year: int | None = None) -> DataFrame:
    """keep titles with unknown year or year not after ``max_year`` (default as_of's)."""
    y = max_year if max_year is not None else int(as_of[:4])
    return df.where(F.col("year").isNull() | (F.col("year") <= y))


def metadata_filter(df: DataFrame, as_of: str) -> DataFrame:
    """drop unreleased titles and titles with thin metadata.

    Keep when year is NULL or ≤ the as-of year, release date is NULL or ≤ as_of, and at least
    two of {crowd > 0, votes > 0, genres non-empty and not 'nan'} hold; when only one of those
    columns exists, it alone must hold. Column presence comes from the schema.
    """
    cond = F.lit(True)
    if "year" in df.columns:
        cond = cond & (F.col("year").isNull() | (F.col("year") <= int(as_of[:4])))
    if "release_date" in df.columns:
        cond = cond & (F.col("release_date").isNull()
                       | (F.col("release_date") <= F.lit(as_of).cast("date")))
    checks = []
    if "imdb_rating" in df.columns:
        checks.append(F.coalesce(F.col("imdb_rating") > 0, F.lit(False)))
    if "num_votes" in df.columns:
        checks.append(F.coalesce(F.col("num_votes") > 0, F.lit(False)))
    if "genres" in df.columns:
        g = F.trim(F.col("genres"))
        checks.append(F.coalesce((g != "") & (F.lower(g) != "nan"), F.lit(False)))
    if len(checks) >= 2:
        n = sum((c.cast("int") for c in checks[1:]), checks[0].cast("int"))
        cond = cond & (n >= 2)
    elif len(checks) == 1:
        cond = cond & checks[0]
    return df.where(cond)


def normalize_scores(scores: DataFrame, by: list[str] | None = None, col: str = "score",
                     out: str = "score") -> DataFrame:
    """Min-max normalise ``col`` per ``by`` group; zero spread or a non-finite bound →
    0.5 for the whole group.

    The bounds come from a partial ``groupBy`` (one row per group) joined back on the group
    key in salted parts, not from an unbounded window, so a hot user is aggregated map-side and
    its rows are spread over tasks.
    """
    by = by or ["user_id"]
    b = scores.groupBy(*by).agg(*counted(F.min(col).alias("_lo"), F.max(col).alias("_hi")))
    lo, hi = F.col("_lo"), F.col("_hi")
    finite = ~(F.isnan(lo) | F.isnan(hi) | (F.abs(lo) == float("inf"))
               | (F.abs(hi) == float("inf")))
    val = F.when(finite & ((hi - lo) > 0), (F.col(col) - lo) / (hi - lo)).otherwise(F.lit(0.5))
    return join_stats(scores, b, by).withColumn(out, val).drop("_lo", "_hi")


def blend(*algo_scores: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Mean over the algorithms that scored each (user, item); an algorithm that did not
    score an item does not count as 0. Explanations of all algorithms are joined with '; '
    (sorted by algorithm name), default text when none."""
    key = key or ["user_id", "item_id"]
    u = None
    for s in algo_scores:
        s = s.select(*key, "algo", "score",
                     (F.col("why") if "why" in s.columns else F.lit(None).cast("string")).alias("why"))
        u = s if u is None else u.unionByName(s)
    whys = F.array_sort(F.collect_list(F.when(F.col("why") != "",
                                               F.struct("algo", "why"))))
    agg = u.groupBy(*key).agg(F.avg("score").alias("score"), whys.alias("_w"))
    why = F.array_join(F.transform("_w", lambda x: x["why"]), "; ")
    return agg.select(*key, "score",
                      F.coalesce(F.nullif(why, F.lit("")), F.lit(WHY_BLEND_DEFAULT))
                      .alias("why_explainer"))


def top_k_per_group(df: DataFrame, k: int | None, by: list[str], order: list[Column],
                    rank_col: str = "rank") -> DataFrame:
    """``row_number`` per group over ``order`` and keep ``rank <= k``.

    With a ``rank <= k`` filter Catalyst inserts a WindowGroupLimit below the shuffle, so each
    map task forwards at most ``k`` rows per group — a hot group costs k rows per task, not its
    full size. ``k=None`` ranks everything (W02).
    """
    w = Window.partitionBy(*by).orderBy(*order)
    ranked = df.withColumn(rank_col, F.row_number().over(w).cast("bigint"))
    return ranked if k is None else ranked.where(F.col(rank_col) <= k)


def ranking_order(score: str = "score") -> list[Column]:
    """T01 order: score desc, votes desc, year desc (NULL counts as 0), then item id."""
    return [F.col(score).desc_nulls_last(),
            F.coalesce(F.col("num_votes").cast("double"), F.lit(0.0)).desc(),
            F.coalesce(F.col("year").cast("double"), F.lit(0.0)).desc(),
            F.col("item_id").asc()]
