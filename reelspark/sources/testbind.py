"""Canonical rating tables derived from the driver's TPC-H-style parquet tables.

ratings   = lineitem ⋈ orders, l_returnflag <> 'R', latest row per (user, item)
watchlist = same join, l_returnflag = 'R', distinct (user, item)
items     = part with derived metadata (nulls, future years, multi-genre, multi-director)
actions   = events mapped onto rate / watchlist_add / watchlist_remove

Every frame is lazy; scans read only the columns used, and the filters on ``l_returnflag`` and
``event_type`` reach the parquet scan as pushed filters.
"""

from __future__ import annotations

import hashlib
import threading
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.constants import GENRES
from ..session import scratch_path

# bump when a view definition changes, so stale materialisations are not read
BINDING_VERSION = "3"
# the tables that the normalised ones are built from
SOURCES = ("lineitem", "orders")

_LOCKS: dict[str, threading.Lock] = {}
_LOCKS_GUARD = threading.Lock()


def _lock_for(path: str) -> threading.Lock:
    with _LOCKS_GUARD:
        return _LOCKS.setdefault(path, threading.Lock())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _genre_at(idx: Column) -> Column:
    return F.element_at(F.array(*[F.lit(g) for g in GENRES]), idx.cast("int"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    year = (F.lit(1950) + k % 80).cast("int")
    g1 = _genre_at(1 + k % 22)
    g2 = _genre_at(1 + (k * 5 + 3) % 22)
    return p.select(
        k.alias("item_id"),
        F.col("p_name").alias("title"),
        year.alias("year"),
        F.when(k % 19 == 0, F.lit(None).cast("string"))
        .when(k % 13 == 0, g1)
        .otherwise(F.concat(g1, F.lit(","), g2)).alias("genres"),
        F.when(k % 5 == 0, F.concat(F.col("p_brand"), F.lit(", Brand#1")))
        .otherwise(F.col("p_brand")).alias("directors"),
        F.when(k % 17 == 0, F.lit(None).cast("double"))
        .otherwise((F.lit(10) + (k * 7) % 91).cast("double") / 10).alias("imdb_rating"),
        F.when(k % 23 == 0, F.lit(None).cast("bigint"))
        .otherwise(F.col("p_size").cast("bigint") * 1000).alias("num_votes"),
        F.col("p_type").alias("title_type"),
        (F.lit(60) + 3 * F.col("p_size")).cast("int").alias("runtime"),
        F.make_date(year, (1 + k % 12).cast("int"), (1 + k % 28).cast("int")).alias("release_date"),
    )


def _line_orders(spark: SparkSession, sf_dir: str, returned: bool) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    cond = (F.col("l_returnflag") == "R") if returned else (F.col("l_returnflag") != "R")
    li = li.where(cond)
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return li.join(o, li.l_orderkey == o.o_orderkey)


def rating_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rating row before de-duplication, with its full tie-break columns."""
    j = _line_orders(spark, sf_dir, returned=False)
    return j.select(
        F.col("o_custkey").alias("user_id"),
        F.col("l_partkey").alias("item_id"),
        ((F.col("l_quantity").cast("int") - 1) % 10 + 1).cast("int").alias("my_rating"),
        F.col("l_shipdate").cast("date").alias("rated_at"),
        "l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity",
    )


def source_state(spark: SparkSession, sf_dir: str, tables: tuple[str, ...]) -> str:
    """Names, sizes and change times of the source files, as one hash."""
    jvm, seen = spark._jvm, []
    for name in tables:
        root = jvm.org.apache.hadoop.fs.Path(f"{sf_dir.rstrip('/')}/{name}.parquet")
        files = root.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(root)
        seen += [f"{f.getPath()}|{f.getLen()}|{f.getModificationTime()}" for f in files]
    return hashlib.sha1("\n".join(sorted(seen)).encode()).hexdigest()


def committed(spark: SparkSession, folder: str) -> str | None:
    """The first complete table under ``folder`` (its write left ``_SUCCESS``), or None."""
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return None
    done = [str(f.getPath()) for f in fs.listStatus(root)
            if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))]
    return min(done, default=None)


def materialized(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """Normalise once, scan many times (the S05 → S04 pattern).

    The first use writes ``build()`` as Parquet under the shared checkpoint folder, keyed by the
    source files (names, sizes, change times) and the binding version; every later plan scans
    that table, so filters and column pruning reach a compact scan instead of re-running the join
    and de-duplication in each branch of each query. When the source changes, so does the key.
    Every write goes to a fresh folder, and only complete ones are read: a half-written table or a
    second process writing the same one does no harm.
    """
    state = source_state(spark, sf_dir, SOURCES)
    key = hashlib.sha1(f"{sf_dir.rstrip('/')}|{state}|{BINDING_VERSION}".encode()).hexdigest()[:16]
    folder = scratch_path(spark, f"normalized/{key}/{name}")
    # one writer per table in this process: concurrent queries wait for it
    with _lock_for(folder):
        path = committed(spark, folder)
        if path is None:
            path = f"{folder}/{uuid.uuid4().hex}"
            build().write.parquet(path)
        return spark.read.parquet(path)


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest rating per (user, item), normalised once per dataset (see :func:`materialized`)."""
    return materialized(spark, sf_dir, "ratings", lambda: build_ratings(spark, sf_dir))


def watchlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct returned (user, item) pairs, normalised once per dataset."""
    return materialized(spark, sf_dir, "watchlist", lambda: build_watchlist(spark, sf_dir))


def build_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest rating per (user, item).

    ``max(struct(ordering…, payload…))`` instead of ``row_number()``: the aggregate is partial
    (map-side combine), so a user or item holding a third of all rows never lands whole in one
    task, and the shuffle carries one row per key and map partition.
    """
    ev = rating_events(spark, sf_dir)
    latest = F.max(F.struct(
        "l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity",
        "my_rating", "rated_at")).alias("m")
    return (ev.groupBy("user_id", "item_id").agg(latest)
            .select("user_id", "item_id", "m.my_rating", "m.rated_at"))


def build_watchlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = _line_orders(spark, sf_dir, returned=True)
    return (j.select(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("item_id"))
            .distinct())


def actions(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """Action log rows. ``events`` may be a streaming frame of the same schema."""
    ev = events if events is not None else table(spark, sf_dir, "events")
    et = F.col("event_type")
    return ev.where(et.isin("purchase", "signup", "error")).select(
        "user_id",
        F.get_json_object("props", "$.k").cast("bigint").alias("item_id"),
        F.when(et == "purchase", "rate").when(et == "signup", "watchlist_add")
        .when(et == "error", "watchlist_remove").alias("action"),
        F.when(et == "purchase", (1 + F.floor("value").cast("bigint") % 10).cast("int"))
        .alias("rating"),
        F.col("ts").cast("timestamp").alias("ts"),
        "event_id",
        F.col("ts").cast("date").alias("batch_id"),
    )


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


# DuckDB definitions of the same views, used by the oracle SQL (FIXTURES.md).
def _genre_sql(expr: str) -> str:
    return f"split_part('{','.join(GENRES)}', ',', CAST({expr} AS INT))"


ITEMS_SQL = f"""
SELECT p_partkey AS item_id, p_name AS title, CAST(1950 + p_partkey % 80 AS INT) AS year,
  CASE WHEN p_partkey % 19 = 0 THEN NULL
       WHEN p_partkey % 13 = 0 THEN {_genre_sql('1 + p_partkey % 22')}
       ELSE {_genre_sql('1 + p_partkey % 22')} || ',' || {_genre_sql('1 + (p_partkey * 5 + 3) % 22')}
  END AS genres,
  CASE WHEN p_partkey % 5 = 0 THEN p_brand || ', Brand#1' ELSE p_brand END AS directors,
  CASE WHEN p_partkey % 17 = 0 THEN NULL
       ELSE CAST(10 + (p_partkey * 7) % 91 AS DOUBLE) / 10 END AS imdb_rating,
  CASE WHEN p_partkey % 23 = 0 THEN NULL ELSE CAST(p_size AS BIGINT) * 1000 END AS num_votes,
  p_type AS title_type, CAST(60 + 3 * p_size AS INT) AS runtime,
  make_date(CAST(1950 + p_partkey % 80 AS INT), CAST(1 + p_partkey % 12 AS INT),
            CAST(1 + p_partkey % 28 AS INT)) AS release_date
FROM part"""

RATING_EVENTS_SQL = """
SELECT o_custkey AS user_id, l_partkey AS item_id,
  CAST((CAST(l_quantity AS INT) - 1) % 10 + 1 AS INT) AS my_rating,
  CAST(l_shipdate AS DATE) AS rated_at,
  l_shipdate, l_orderkey, l_linenumber, l_suppkey, l_quantity
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag <> 'R'"""

RATINGS_SQL = f"""
SELECT user_id, item_id, my_rating, rated_at FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, item_id
    ORDER BY l_shipdate DESC NULLS LAST, l_orderkey DESC, l_linenumber DESC, l_suppkey DESC,
             l_quantity DESC) AS rn
  FROM ({RATING_EVENTS_SQL}) e) t
WHERE rn = 1"""

WATCHLIST_SQL = """
SELECT DISTINCT o_custkey AS user_id, l_partkey AS item_id
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R'"""

ACTIONS_SQL = """
SELECT user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS item_id,
  CASE event_type WHEN 'purchase' THEN 'rate' WHEN 'signup' THEN 'watchlist_add'
                  WHEN 'error' THEN 'watchlist_remove' END AS action,
  CASE WHEN event_type = 'purchase'
       THEN CAST(1 + CAST(floor(value) AS BIGINT) % 10 AS INT) END AS rating,
  CAST(ts AS TIMESTAMP) AS ts, event_id, CAST(ts AS DATE) AS batch_id
FROM events WHERE event_type IN ('purchase', 'signup', 'error')"""


def with_views(sql: str, *names: str) -> str:
    """Prefix ``sql`` with CTEs for the named canonical views (in dependency order)."""
    defs = {"items": ITEMS_SQL, "ratings": RATINGS_SQL, "watchlist": WATCHLIST_SQL,
            "actions": ACTIONS_SQL, "rating_events": RATING_EVENTS_SQL}
    ctes = ",\n".join(f"{n} AS ({defs[n]})" for n in names)
    return f"WITH {ctes}\n{sql}" if names else sql
