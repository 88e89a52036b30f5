"""Content vectors (X01–X06) as array expressions — evaluated per row inside codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import GENRES, YEAR_EDGES


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def split_list(x) -> Column:
    """Comma-separated text → array of trimmed, non-empty tokens (NULL → empty array).

    Plain expressions only (regex trim around commas, ``split``, ``array_remove``): they stay
    inside whole-stage codegen and share common subexpressions, unlike lambda functions."""
    t = F.regexp_replace(F.coalesce(_c(x), F.lit("")), r"^\s+|\s+$", "")
    return F.array_remove(F.split(F.regexp_replace(t, r"\s*,\s*", ","), ","), "")


#: What ``\\s`` matches, and the line ends besides, before which ``$`` matches too.
_SPACE, _LINE_ENDS = " \t\n\x0b\f\r", ("\x85", "\u2028", "\u2029")


def split_tokens(x) -> Column:
    """:func:`split_list` without its three regexes a row, where its result is used once (a lambda is not shared)."""
    t = F.coalesce(_c(x), F.lit(""))
    plain = F.array_remove(F.transform(F.split(t, ","), lambda v: F.btrim(v, F.lit(_SPACE))), "")
    odd = [F.endswith(t, F.lit(e)) for e in _LINE_ENDS]
    return F.when(odd[0] | odd[1] | odd[2], split_list(x)).otherwise(plain)


def clean_name(x) -> Column:
    """Runs of non-alphanumerics → ``_``, first 30 characters."""
    return F.substring(F.regexp_replace(_c(x), "[^A-Za-z0-9]+", "_"), 1, 30)


def genre_vector(genres) -> Column:
    """22 fixed slots, multi-hot over known genres, scaled to unit length; empty → zeros.

    Written as 22 plain ``array_contains`` tests and their sum, so the token array is computed
    once per row (common-subexpression elimination) instead of once per slot."""
    toks = split_list(genres)
    hits = [F.array_contains(toks, F.lit(g)).cast("double") for g in GENRES]
    n = sum(hits[1:], hits[0])
    return F.array(*[F.when(n > 0, h / F.sqrt(n)).otherwise(F.lit(0.0)) for h in hits])


def with_genre_vector(df, genres="genres", out: str = "genre_vec"):
    """X01 on a DataFrame in staged projections: tokens, then the 22 hits, then their count,
    then the scaled vector. Catalyst keeps a projection separate when a costly column is used
    more than once, so the tokens are split once per row (the single-expression form
    :func:`genre_vector` is convenient for literals but re-derives them per slot)."""
    hits = F.array(*[F.array_contains(F.col("_gtoks"), F.lit(g)).cast("double") for g in GENRES])
    return (df.withColumn("_gtoks", split_list(genres))
            .withColumn("_ghits", hits)
            .withColumn("_gn", F.aggregate("_ghits", F.lit(0.0), lambda a, v: a + v))
            .withColumn(out, F.transform("_ghits", lambda h: F.when(F.col("_gn") > 0,
                                                                    h / F.sqrt(F.col("_gn")))
                                         .otherwise(F.lit(0.0))))
            .drop("_gtoks", "_ghits", "_gn"))


def with_content_vector(df, genres="genres", year="year", out: str = "content_vec"):
    """X03 on a DataFrame: staged genre vector ‖ year bucket (length 28)."""
    return (with_genre_vector(df, genres, "_gv")
            .withColumn(out, F.concat(F.col("_gv"), year_bucket(year))).drop("_gv"))


def year_bucket_index(year) -> Column:
    """Index 0..5 of the year bucket; NULL year → NULL."""
    y = _c(year).cast("int")
    idx = F.lit(len(YEAR_EDGES))
    for i, e in reversed(list(enumerate(YEAR_EDGES))):
        idx = F.when(y <= e, F.lit(i)).otherwise(idx)
    return F.when(y.isNull(), F.lit(None).cast("int")).otherwise(idx)


def year_bucket(year) -> Column:
    """One-hot of 6 year buckets; NULL year → zeros."""
    idx = year_bucket_index(year)
    return F.array(*[F.when(idx == i, F.lit(1.0)).otherwise(F.lit(0.0))
                     for i in range(len(YEAR_EDGES) + 1)])


def content_vector(genres, year) -> Column:
    """Genre vector ‖ year bucket, length 28."""
    return F.concat(genre_vector(genres), year_bucket(year))


def dot(a, b) -> Column:
    """Dot product of two equal-length numeric arrays."""
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x * y), F.lit(0.0),
                       lambda acc, v: acc + v)


def norm(a) -> Column:
    return F.sqrt(F.aggregate(F.transform(_c(a), lambda x: x * x), F.lit(0.0),
                              lambda acc, v: acc + v))


def cosine(a, b) -> Column:
    """Cosine similarity; a zero vector on either side → 0.0."""
    na, nb = norm(a), norm(b)
    return F.when((na == 0) | (nb == 0), F.lit(0.0)).otherwise(dot(a, b) / (na * nb))


def seed_similarity(seed_vec, item_vec) -> Column:
    """``clip(seed · item, 0, 1)`` — a dot product, not a cosine."""
    return F.least(F.greatest(dot(seed_vec, item_vec), F.lit(0.0)), F.lit(1.0))
