"""Catalog construction (J01, J07) and keep-latest-per-key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

META_COLS = ["title", "year", "genres", "imdb_rating", "num_votes", "title_type"]


def latest_per_key(df: DataFrame, keys: list[str], order: list[str | Column],
                   payload: list[str]) -> DataFrame:
    """Keep the last row per ``keys`` by ``order`` (all DESC, NULLs lose).

    Expressed as ``max(struct(order…, payload…))``: a partial aggregate, so the shuffle moves
    at most one row per key per map task and a hot key cannot pile up in one reducer. Rows with
    a NULL leading ordering value are ranked below every dated row, as ``DESC NULLS LAST``.
    """
    ordered = [F.col(o) if isinstance(o, str) else o for o in order]
    names = [f"_o{i}" for i in range(len(ordered))]
    flag = F.col(names[0]).isNotNull().alias("_has")
    s = F.struct(flag, *[F.col(n) for n in names], *[F.col(p) for p in payload])
    pre = df.select(*keys, *[c.alias(n) for c, n in zip(ordered, names)], *payload)
    return pre.groupBy(*keys).agg(F.max(s).alias("_m")).select(*keys, *[F.col(f"_m.{p}") for p in payload])


def catalog(ratings: DataFrame, watchlist: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Full outer join on (user, item); every metadata column coalesced, ratings win.

    Both inputs are hash-partitioned on the join key by the shuffle, so each output row is
    built in one place; the six metadata columns always exist (NULL when neither side has them).
    """
    key = key or ["user_id", "item_id"]
    r = ratings.alias("r")
    w = watchlist.alias("w")
    cols = [F.coalesce(*[F.col(f"{a}.{k}") for a in ("r", "w")]).alias(k) for k in key]
    rcols, wcols = set(ratings.columns), set(watchlist.columns)
    extra = []
    for c in dict.fromkeys(list(ratings.columns) + list(watchlist.columns) + META_COLS):
        if c in key:
            continue
        parts = [F.col(f"r.{c}")] if c in rcols else []
        parts += [F.col(f"w.{c}")] if c in wcols else []
        if not parts:
            extra.append(F.lit(None).alias(c))
        else:
            extra.append((F.coalesce(*parts) if len(parts) > 1 else parts[0]).alias(c))
    cond = [F.col(f"r.{k}") == F.col(f"w.{k}") for k in key]
    return r.join(w, cond, "full_outer").select(*cols, *extra)


def item_universe(ratings: DataFrame, watchlist: DataFrame, cols: list[str]) -> DataFrame:
    """Union of rated and watchlisted items, first source wins per item (ratings first).

    Winner by ``max(struct(priority, …))`` per item — partial aggregation, no global sort.
    """
    a = ratings.select("item_id", F.lit(1).alias("_src"), *cols)
    b = watchlist.select("item_id", F.lit(0).alias("_src"), *cols)
    u = a.unionByName(b)
    return (u.groupBy("item_id")
            .agg(F.max(F.struct("_src", *cols)).alias("_m"))
            .select("item_id", F.col("_m._src").cast("int").alias("source"),
                    *[F.col(f"_m.{c}") for c in cols]))
