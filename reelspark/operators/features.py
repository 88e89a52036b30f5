"""Feature engineering: P07–P16, A04–A07, X13–X16, J08.

Every statistic (medians, first rating date, vocabulary, director top-K, mean/std) is *fitted*
on the frame passed as ``train`` and applied to any frame; that is what keeps cross-validation
leakage-free. Fitted statistics are single aggregate rows or bounded lists (≤ K directors, a
vocabulary bounded by the one-hot domains), brought to the driver once and applied as
literals, so applying them is a projection — no join, no shuffle.

A row's features are an ``array<struct<feature: string, value: double>>``: the long form used
by the checks is ``explode`` of it, and the model vector is ``array_to_vector`` over the fitted
vocabulary. No pivot over tokens anywhere.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import (AS_OF, DEFAULT_CROWD, DEFAULT_RUNTIME, DEFAULT_VOTES,
                                   DEFAULT_YEAR, VOTES_CAP)
from ..functions.content import split_list, split_tokens
from ..session import ensure_checkpoint_dir
from .quantiles import exact_medians
from .salting import counted, join_stats

#: Categorical features that the driver lists, for MLlib's vectorisers.
MAX_VOCABULARY = 100_000
NUMERIC = ["year", "runtime", "imdb", "log_votes", "days_since_first_rate", "age_at_rating_days"]


@dataclass(frozen=True)
class FeatureSpec:
    year_range: tuple[int, int] | None = (1900, 2025)
    votes_cap: int | None = VOTES_CAP
    date_fill: tuple[int, int, int, int] = (0, 0, 0, 0)   # rate year, month, dow, release month
    age_reference: str = "as_of"                          # "as_of" or "rated"
    onehots: tuple[str, ...] = ("type", "decade", "rate_m", "rate_dow", "rel_m")
    standardize: bool = True
    top_dir_k: int = 30
    as_of: str = AS_OF
    numeric: tuple[str, ...] = tuple(NUMERIC)             # numeric columns of the matrix; NUMERIC are standardised


RESEARCH = FeatureSpec()
#: The package's matrix also holds what its features were made from.
RAW = ("votes", "decade", "rate_year", "rate_month", "rate_dow", "rel_month", "rated_epoch", "release_epoch")
PACKAGE = FeatureSpec(year_range=(1900, 2024), date_fill=(2020, 6, 3, 6),
                      onehots=("type", "decade", "rate_m"), standardize=False, numeric=(*NUMERIC, *RAW))
RUN_CV = FeatureSpec(year_range=None, votes_cap=None, age_reference="rated")


def with_spec(spec: FeatureSpec, **kw) -> FeatureSpec:
    return replace(spec, **kw)


# ----------------------------------------------------------------------------- fitted statistics

def _age_days(df: DataFrame, spec: FeatureSpec) -> Column:
    ref = F.col("rated_at") if spec.age_reference == "rated" else F.lit(spec.as_of).cast("date")
    return F.datediff(ref, F.col("release_date")).cast("double")


def median_columns(df: DataFrame, spec: FeatureSpec = RESEARCH) -> dict[str, Column]:
    """What P07 takes the median of, by name."""
    out = {name: F.col(src).cast("double") for name, src in
           (("year", "year"), ("runtime", "runtime"), ("imdb", "imdb_rating"), ("votes", "num_votes")) if src in df.columns}
    if "release_date" in df.columns and (spec.age_reference != "rated" or "rated_at" in df.columns):
        out["age"] = _age_days(df, spec)
    return out


def median_defaults(medians: dict, df: DataFrame) -> dict:
    """An all-NULL crowd rating has the median 7.0."""
    if medians.get("imdb") is None and "imdb_rating" in df.columns:
        return {**medians, "imdb": DEFAULT_CROWD}
    return medians


def fit_medians(train: DataFrame, spec: FeatureSpec = RESEARCH) -> dict:
    """Exact medians of year, runtime, crowd rating, votes and age over ``train``, in passes with a bounded state
    (:mod:`.quantiles`)."""
    return median_defaults(exact_medians(train, median_columns(train, spec)), train)


FILLED = {"year": "year_f", "runtime": "runtime_f"}


def fit_standardizer(based: DataFrame, names: list[str] = NUMERIC) -> dict:
    """Training mean and *sample* std per numeric feature of a ``base_features`` frame;
    std 0 or undefined → 1. One aggregate row."""
    aggs = []
    for n in names:
        c = F.col(FILLED.get(n, n))
        aggs += [F.avg(c).alias(f"{n}__mu"), F.stddev_samp(c).alias(f"{n}__sd")]
    row = based.agg(*aggs).first().asDict()
    out = {}
    for n in names:
        sd = row[f"{n}__sd"]
        out[n] = (row[f"{n}__mu"] or 0.0, sd if sd not in (None, 0.0) and sd == sd else 1.0)
    return out


def director_counts(train: DataFrame) -> DataFrame:
    """Director token frequency over the rows of ``train`` (partial groupBy)."""
    toks = train.select(F.explode(split_list("directors")).alias("director"))
    return toks.groupBy("director").agg(F.count("*").cast("bigint").alias("cnt"))


def top_directors(train: DataFrame, k: int = 30) -> DataFrame:
    """Top-K by (count desc, token asc) — a TakeOrderedAndProject, K rows per task."""
    return director_counts(train).orderBy(F.col("cnt").desc(), F.col("director").asc()).limit(k)


@dataclass
class FittedFeatures:
    spec: FeatureSpec
    medians: dict
    top_dirs: list[str]
    scaler: dict | None = None
    cat_vocabulary: list[str] | None = None

    @property
    def vocabulary(self) -> list[str]:
        """Model vector slot names: the numeric features, then the categorical tokens."""
        return list(self.spec.numeric) + list(self.cat_vocabulary or [])


def fit(train: DataFrame, spec: FeatureSpec = RESEARCH) -> FittedFeatures:
    """Fit every statistic on ``train`` (medians, director top-K, numeric mean/std, token
    vocabulary). Four passes over the training rows, so they are persisted (memory, spilling
    to disk) for the duration of the fit and released after. Independent passes run as
    concurrent Spark jobs: medians ∥ director top-K, then standardiser ∥ vocabulary (both need
    the first two)."""
    from concurrent.futures import ThreadPoolExecutor

    from pyspark import StorageLevel

    cached = train.storageLevel == StorageLevel.NONE
    if cached:
        train = train.persist(StorageLevel.MEMORY_AND_DISK)

    def dirs_job():
        if "directors" not in train.columns or spec.top_dir_k <= 0:
            return []
        return [r["director"] for r in top_directors(train, spec.top_dir_k).collect()]

    def vocab_job(base):
        toks = base.select(F.explode(category_tokens(ff)).alias("t")).distinct()
        found = [r["t"] for r in toks.orderBy("t").limit(MAX_VOCABULARY + 1).collect()]
        if len(found) > MAX_VOCABULARY:
            raise ValueError(f"over {MAX_VOCABULARY} categorical features; number them with dictionary() and build rows "
                             "with sparse_rows()")
        return found

    try:
        with ThreadPoolExecutor(2) as pool:
            med_f, dirs_f = pool.submit(fit_medians, train, spec), pool.submit(dirs_job)
            ff = FittedFeatures(spec, med_f.result(), dirs_f.result())
            base = base_features(train, ff)
            sc_f = pool.submit(fit_standardizer, base, [c for c in NUMERIC if c in spec.numeric]) if spec.standardize else None
            voc_f = pool.submit(vocab_job, base)
            ff.scaler = sc_f.result() if sc_f else None
            ff.cat_vocabulary = voc_f.result()
    finally:
        if cached:
            train.unpersist()
    return ff


# ----------------------------------------------------------------------------- row features

def _epoch(d: Column) -> Column:
    return F.coalesce(F.unix_seconds(d.cast("timestamp")).cast("double"), F.lit(0.0))


def _num(df: DataFrame, src: str) -> Column:
    return F.col(src).cast("double") if src in df.columns else F.lit(None).cast("double")


def base_features(df: DataFrame, ff: FittedFeatures) -> DataFrame:
    """P07–P13 and P16 on any frame with the fitted statistics of ``ff``.

    Adds: year, runtime, imdb, votes, log_votes, decade, rate_year, rate_month, rate_dow,
    rel_month, days_since_first_rate, age_at_rating_days, rated_epoch, release_epoch (seconds, unknown 0),
    has_director_info. The first rating
    date is per user (P12): a partial ``groupBy(user_id).min`` joined back on ``user_id``, or the column ``_first`` of a
    frame that has it.
    """
    spec, med = ff.spec, ff.medians
    cols = set(df.columns)

    def filled(src, name, default):
        m = med.get(name)
        fill = m if m is not None else (default if src not in cols else None)
        v = _num(df, src)
        return F.coalesce(v, F.lit(fill).cast("double")) if fill is not None else v

    year = filled("year", "year", float(DEFAULT_YEAR))
    runtime = filled("runtime", "runtime", float(DEFAULT_RUNTIME))
    imdb = filled("imdb_rating", "imdb", DEFAULT_CROWD)
    votes = filled("num_votes", "votes", float(DEFAULT_VOTES))
    if spec.votes_cap is not None:
        votes = F.least(votes, F.lit(float(spec.votes_cap)))
    if spec.year_range is not None:
        year = F.least(F.greatest(year, F.lit(float(spec.year_range[0]))),
                       F.lit(float(spec.year_range[1])))
    out = df
    if "rated_at" in cols and "user_id" in cols:
        if "_first" not in cols:
            first = df.groupBy("user_id").agg(*counted(F.min("rated_at").alias("_first")))
            out = join_stats(out, first, ["user_id"], "left")
        d = F.col("rated_at")
        days = F.coalesce(F.datediff(d, F.col("_first")).cast("double"), F.lit(0.0))
    else:
        d = F.lit(None).cast("date")
        days = F.lit(0.0)
    fy, fm, fd, fr = spec.date_fill
    rel = F.col("release_date") if "release_date" in cols else F.lit(None).cast("date")
    if "release_date" in cols:
        age = _age_days(df, spec)
        age = F.coalesce(age, F.lit(med.get("age")).cast("double"), F.lit(0.0))
    else:
        age = F.lit(0.0)
    out = out.select(
        *df.columns,
        year.alias("f_year"), runtime.alias("f_runtime"), imdb.alias("imdb"),
        votes.alias("votes"), F.log1p(votes).alias("log_votes"),
        (F.floor(year / 10) * 10).cast("int").alias("decade"),
        F.coalesce(F.year(d), F.lit(fy)).alias("rate_year"),
        F.coalesce(F.month(d), F.lit(fm)).alias("rate_month"),
        F.coalesce(F.weekday(d), F.lit(fd)).alias("rate_dow"),
        F.coalesce(F.month(rel), F.lit(fr)).alias("rel_month"),
        days.alias("days_since_first_rate"),
        age.alias("age_at_rating_days"), _epoch(d).alias("rated_epoch"), _epoch(rel).alias("release_epoch"),
        (split_tokens("genres") if "genres" in cols else F.array().cast("array<string>"))
        .alias("genre_tokens"),
        (split_tokens("directors") if "directors" in cols else F.array().cast("array<string>"))
        .alias("director_tokens"),
    )
    out = out.withColumn("has_director_info", (F.size("director_tokens") > 0).cast("int"))
    # expose the filled numerics under their feature names without clobbering raw columns
    return out.withColumnRenamed("f_year", "year_f").withColumnRenamed("f_runtime", "runtime_f")


def _numeric_value(name: str, ff: FittedFeatures) -> Column:
    v = F.col(FILLED.get(name, name)).cast("double")
    if ff.spec.standardize and ff.scaler and name in ff.scaler:
        mu, sd = ff.scaler[name]
        v = (v - F.lit(mu)) / F.lit(sd)
    return v


def category_tokens(ff: FittedFeatures, decade: Column | None = None) -> Column:
    """X14–X16 as one token array per row: one-hots (``type_…``, ``dec_…``, ``rate_m_…``,
    ``rate_dow_…``, ``rel_m_…``), genres (``g_…``) and top-K directors (``dir_<token>``; the cleaned name is only a label),
    de-duplicated. Applied to a ``base_features`` frame. Where a ``decade`` is given and NULL, the row has none."""
    oh = {
        "type": F.concat(F.lit("type_"), F.coalesce(F.col("title_type"), F.lit("Unknown"))),
        "decade": F.concat(F.lit("dec_"), F.coalesce(F.col("decade"), F.lit(0)).cast("string")),
        "rate_m": F.concat(F.lit("rate_m_"), F.col("rate_month").cast("string")),
        "rate_dow": F.concat(F.lit("rate_dow_"), F.col("rate_dow").cast("string")),
        "rel_m": F.concat(F.lit("rel_m_"), F.col("rel_month").cast("string")),
    }
    if decade is not None:
        oh["decade"] = F.concat(F.lit("dec_"), decade.cast("string"))
    onehots = F.array(*[oh[o] for o in ff.spec.onehots])
    if decade is not None:
        onehots = F.array_compact(onehots)
    # no two prefixes begin alike: only a row's genres, and its directors, can repeat among themselves
    genres = F.transform(F.array_distinct("genre_tokens"), lambda g: F.concat(F.lit("g_"), g))
    if not ff.top_dirs:
        return F.concat(onehots, genres)
    # keyed by the raw token: two directors whose cleaned names agree stay two features
    dirs = F.transform(F.array_distinct(F.filter("director_tokens", lambda d: d.isin(list(ff.top_dirs)))),
                       lambda d: F.concat(F.lit("dir_"), d))
    return F.concat(onehots, genres, dirs)


def feature_array(based: DataFrame, ff: FittedFeatures) -> Column:
    """Numeric features (standardised when the spec says so) + categorical tokens with value
    1.0, as ``array<struct<feature, value>>`` — the long form's source."""
    nums = F.array(*[F.struct(F.lit(n).alias("feature"), _numeric_value(n, ff).alias("value"))
                     for n in ff.spec.numeric])
    cats = F.transform(category_tokens(ff),
                       lambda t: F.struct(t.alias("feature"), F.lit(1.0).alias("value")))
    return F.concat(nums, cats)


def long_features(df: DataFrame, ff: FittedFeatures, keys=("user_id", "item_id")) -> DataFrame:
    """Long form ``(keys…, feature, value)``: one row per non-zero feature of each input row."""
    b = base_features(df, ff)
    # never empty (numeric entries): explode_outer avoids an inferred size() > 0 filter
    # that Catalyst would push below the projections, evaluating the features twice
    return (b.select(*keys, F.explode_outer(feature_array(b, ff)).alias("f"))
            .select(*keys, "f.feature", F.coalesce("f.value", F.lit(0.0)).alias("value")))


def align(long_df: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """J08a in long form: keep only training features (missing ones are the implicit zeros of a
    sparse row, extras dropped)."""
    return long_df.join(vocabulary.select("feature"), "feature", "left_semi")


def union_space(a: DataFrame, b: DataFrame) -> DataFrame:
    """The union feature space of two long frames: ``feature``, and on how many rows of either
    side it has a value (``rows_a``, ``rows_b``; 0 where a side lacks it).

    Absent values are 0.0 without being stored: ``vectorize`` over these names gives the zero-filled
    rows of both sides as sparse vectors, so no row is multiplied by the number of features.
    """
    side = lambda x, n: x.groupBy("feature").agg(F.count("*").alias(n))
    j = side(a, "rows_a").join(side(b, "rows_b"), "feature", "full_outer")
    return j.select("feature", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("rows_a", "rows_b")])


def dictionary(features: DataFrame, col: str = "feature") -> DataFrame:
    """A05 as a table: ``feature``, ``idx``: the distinct non-NULL values in rising order, numbered from 0 without a gap.

    A global sort spreads the values over tasks; a value's number is its place in its task plus the sizes of the tasks
    before. Nothing but one count per task is ever in one place.
    """
    spark = features.sparkSession
    placed = (features.select(F.col(col).alias("feature")).where("feature is not null").distinct().orderBy("feature")
              .withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.select("feature", F.shiftright("_at", 33).cast("int").alias("_task"),
                           F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)).alias("_in"))
    ensure_checkpoint_dir(spark)
    placed = placed.checkpoint()  # the places stay what they are if a task runs again
    sizes = placed.groupBy("_task").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_task")) - F.col("_n")  # over one row per task
    return placed.join(F.broadcast(sizes.select("_task", before.alias("_before"))), "_task") \
        .select("feature", (F.col("_before") + F.col("_in")).alias("idx"))


def sparse_rows(long_df: DataFrame, numbered: DataFrame, keys=("user_id", "item_id")) -> DataFrame:
    """Rows over the feature space ``numbered`` (``feature``, ``idx``): ``keys``, ``indices`` (rising), ``values``.

    Everything not listed is 0; features outside the space are dropped (J08a). Assembled by aggregation on the keys,
    so a row's features meet, never a column's.
    """
    cells = long_df.join(numbered, "feature").groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("idx", "value"))).alias("_c"))
    return cells.select(*keys, F.col("_c.idx").alias("indices"), F.col("_c.value").alias("values"))


def union_rows(a: DataFrame, b: DataFrame, keys=("user_id", "item_id")) -> DataFrame:
    """The rows of both long frames over their union feature space, in sorted order, with 0 where a side lacks a
    feature: ``side`` ('a' or 'b'), ``keys``, ``size`` of the space, ``indices``, ``values``."""
    numbered = dictionary(a.select("feature").union(b.select("feature")))
    sides = a.select(F.lit("a").alias("side"), *keys, "feature", "value").unionByName(
        b.select(F.lit("b").alias("side"), *keys, "feature", "value"))
    size = numbered.agg(F.count("*").alias("size"))
    return sparse_rows(sides, numbered, ("side", *keys)).crossJoin(F.broadcast(size)) \
        .select("side", *keys, "size", "indices", "values")


def feature_rows(df: DataFrame, ff: FittedFeatures, keys=("user_id", "item_id")) -> DataFrame:
    """The rows of :func:`long_features` before they are exploded: ``keys``, ``features`` (``array<struct<feature, value>>``)."""
    b = base_features(df, ff)
    return b.select(*keys, F.transform(feature_array(b, ff), lambda f: F.struct(
        f["feature"].alias("feature"), F.coalesce(f["value"], F.lit(0.0)).alias("value"))).alias("features"))


def union_packed_rows(a: DataFrame, b: DataFrame, keys=("user_id", "item_id")) -> DataFrame:
    """:func:`union_rows` of two frames of :func:`feature_rows`.

    A row's features stay together: what is shuffled is one packed row a key, not one for each of its features. Spaces of up to
    ``MAX_VOCABULARY`` features are looked up in every task; larger ones are joined by feature."""
    sides = a.select(F.lit("a").alias("side"), *keys, "features").unionByName(b.select(F.lit("b").alias("side"), *keys, "features"))
    # explode_outer: see long_features
    numbered = dictionary(sides.select(F.explode_outer("features").alias("f")).select("f.feature"))
    space = [r["feature"] for r in numbered.orderBy("idx").limit(MAX_VOCABULARY + 1).collect()]
    if len(space) > MAX_VOCABULARY:
        return union_rows(*[s.select(*keys, F.explode_outer("features").alias("f")).select(*keys, "f.feature", "f.value") for s in (a, b)],
                          keys=keys)
    table = F.from_json(F.lit(json.dumps({f: i for i, f in enumerate(space)})), "map<string, bigint>")
    cells = F.sort_array(F.transform("features", lambda f: F.struct(F.try_element_at(table, f["feature"]).alias("idx"), f["value"].alias("value"))))
    packed = sides.select("side", *keys, cells.alias("_c")).select("side", *keys, F.struct(
        F.col("_c.idx").alias("i"), F.col("_c.value").alias("v")).alias("_p"))
    # rows that agree in their keys become one; mostly there is one, sorted already
    met = packed.groupBy("side", *keys).agg(F.collect_list("_p").alias("_g"))
    merged = F.sort_array(F.flatten(F.transform("_g", lambda g: F.arrays_zip(g["i"].alias("i"), g["v"].alias("v")))))
    one = F.col("_g")[0]
    met = met.select("side", *keys, one.alias("_p"), F.when(F.size("_g") > 1, merged).alias("_m"))
    return met.select("side", *keys, F.lit(len(space)).cast("bigint").alias("size"), F.coalesce("_m.i", "_p.i").alias("indices"),
                      F.coalesce("_m.v", "_p.v").alias("values"))


def vectorize(df: DataFrame, ff: FittedFeatures, out: str = "features") -> DataFrame:
    """Model input without pivoting: the categorical token array goes through
    ``CountVectorizerModel.from_vocabulary(binary=True)`` (sparse, JVM-side; tokens outside the
    training vocabulary are dropped — J08a) and ``VectorAssembler`` prepends the numeric
    features. Vector slots follow ``ff.vocabulary`` (numeric first, then sorted tokens)."""
    from pyspark.ml.feature import CountVectorizerModel, VectorAssembler

    b = base_features(df, ff)
    nums = [f"_n{i}" for i in range(len(ff.spec.numeric))]
    b = b.select("*", *[_numeric_value(n, ff).alias(c) for n, c in zip(ff.spec.numeric, nums)],
                 category_tokens(ff).alias("_cat"))
    cv = CountVectorizerModel.from_vocabulary(ff.cat_vocabulary, inputCol="_cat",
                                              outputCol="_catv", binary=True)
    va = VectorAssembler(inputCols=[*nums, "_catv"], outputCol=out, handleInvalid="keep")
    return va.transform(cv.transform(b)).drop(*nums, "_cat", "_catv")
