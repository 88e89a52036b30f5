"""Scalar column expressions (JVM-side, whole-stage codegen; no Python UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import QUALITY_BANDS, QUALITY_ELSE, QUALITY_NONE


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clip(x, lo: float, hi: float) -> Column:
    """``min(hi, max(lo, x))``; NULL stays NULL."""
    return F.least(F.greatest(_c(x), F.lit(lo)), F.lit(hi))


def try_double(x) -> Column:
    """Tolerant number parse; text that is not a number, and NaN, become NULL."""
    v = _c(x).cast("string").try_cast("double")
    return F.when(F.isnan(v), F.lit(None).cast("double")).otherwise(v)


def rating_int(x) -> Column:
    """Parse, round half-even, integer; bad text → NULL."""
    return F.bround(try_double(x), 0).cast("int")


def pred_to_score(p) -> Column:
    """Prediction on 1–10 → score in [0, 1]."""
    return clip((_c(p) - 1.0) / 9.0, 0.0, 1.0)


def score_to_rating(s) -> Column:
    """Score → 1 + 9s when s > 0, else NULL; rounded half-even to 2 places."""
    return F.when(_c(s) > 0, F.bround(1.0 + 9.0 * _c(s), 2))


def eval_mapping(s) -> Column:
    """Evaluation mapping of a [0, 1] score onto 1–10."""
    return clip(_c(s) * 3.0 + 5.5, 1.0, 10.0)


def bounded_scale(p, mean, std) -> Column:
    """X11: ``clip(5.5 + 4.5·tanh((p − mean)/(2·std)), 1, 10)``; no statistics → clip(p);
    zero spread → 5.5."""
    p, mean, std = _c(p), _c(mean), _c(std)
    return (F.when(mean.isNull() | std.isNull(), clip(p, 1.0, 10.0))
            .when(std == 0, F.lit(5.5))
            .otherwise(clip(5.5 + 4.5 * F.tanh((p - mean) / (2.0 * std)), 1.0, 10.0)))


def clip_rating(p) -> Column:
    """X12."""
    return clip(p, 1.0, 10.0)


def recency_weight(year, alpha: float) -> Column:
    """``(1−a) + a·(0.6 + 0.4·(y−1980)/45)`` with y clamped to 1980–2025; a ≤ 0 or NULL
    year → 1."""
    if alpha <= 0:
        return F.lit(1.0)
    y = clip(_c(year).cast("int"), 1980, 2025)
    base = 0.6 + 0.4 * ((y - 1980) / 45.0)
    return F.when(_c(year).isNull(), F.lit(1.0)).otherwise((1.0 - alpha) + alpha * base)


def crowd_signal(crowd, missing: float = 0.0) -> Column:
    """Crowd rating; missing → ``missing`` (0 = unobserved, 6.5 in the tuning scripts)."""
    return F.coalesce(_c(crowd), F.lit(float(missing)))


def hybrid_signal(my_rating, user_mean, crowd, w_user: float = 0.7, w_crowd: float = 0.3) -> Column:
    """Rated → ``w_user·rating + w_crowd·crowd``; unrated → ``w_crowd·user_mean +
    w_user·crowd``. A user with no training rating falls back to the crowd alone."""
    r, um, c = _c(my_rating), _c(user_mean), _c(crowd)
    return F.when(r.isNotNull(), w_user * r + w_crowd * c) \
        .otherwise(w_crowd * F.coalesce(um, c) + w_user * c)


def quality_band(abs_err) -> Column:
    """Absolute error → excellent / good / fair / poor; NULL → no_prediction."""
    e = _c(abs_err)
    out = F.when(e.isNull(), F.lit(QUALITY_NONE))
    for bound, label in QUALITY_BANDS:
        out = out.when(e <= bound, F.lit(label))
    return out.otherwise(F.lit(QUALITY_ELSE))


def r6(x) -> Column:
    """Round to 6 places through an exact decimal (half-up), so that values sitting on a
    half-way tie round the same in every engine; NaN/inf → NULL.

    Only values near a tie, or too large for a double's digits to tell, go through the decimal: elsewhere the nearest
    millionth is certain, and whole / 1e6 is the double nearest to it, which is what the decimal gives."""
    x = _c(x)
    v = x.try_cast("double")
    m = v * 1e6
    certain = (F.abs(v) < 1e5) & (F.abs(m - F.floor(m) - 0.5) > 1e-4)
    return F.when(certain, F.floor(m + 0.5) / 1e6).otherwise(F.round(x.try_cast("decimal(38,12)"), 6).cast("double"))


def r6_sql(expr: str) -> str:
    """The DuckDB twin of :func:`r6`."""
    return f"CAST(round(TRY_CAST({expr} AS DECIMAL(38,12)), 6) AS DOUBLE)"
