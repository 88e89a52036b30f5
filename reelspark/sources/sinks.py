"""Sinks: recommendations (S06, S07), grid / CV / summary tables (S08, S09), action log.

All are DataFrame writers; nothing is gathered on the driver. ``single_file`` coalesces to one
output file only for small report tables (a handful of rows by construction)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.constants import ACTIONS
from ..functions.scalar import rating_int
from .ingest import validate


def write_recommendations(recs: DataFrame, path: str, fmt: str = "parquet") -> None:
    """``item_id, score, title_type`` (+ ``user_id``) as Parquet or CSV."""
    missing = {"item_id", "score", "title_type"} - set(recs.columns)
    if missing:
        raise ValueError(f"recommendations lack {', '.join(sorted(missing))}")
    cols = [c for c in ("user_id", "item_id", "score", "title_type") if c in recs.columns]
    w = recs.select(*cols).write.mode("overwrite")
    (w.parquet(path) if fmt == "parquet" else w.option("header", True).csv(path))


def export_recommendations_csv(recs: DataFrame, path: str, topk: int | None = None,
                               model_name: str = "blend") -> None:
    """``user_id, rank, item_id, title, year, genres, <model>_score, explanation``,
    partitioned by user hash at write time (no global sort)."""
    r = recs if topk is None else recs.where(F.col("rank") <= topk)
    out = r.select("user_id", "rank", "item_id", "title", "year", "genres",
                   F.col("score").alias(f"{model_name}_score"),
                   F.col("why_explainer").alias("explanation"))
    out.write.mode("overwrite").option("header", True).csv(path)


def write_table(df: DataFrame, path: str, fmt: str = "csv", single_file: bool = False) -> None:
    """Grid / CV / summary results as CSV or JSON."""
    d = df.coalesce(1) if single_file else df
    w = d.write.mode("overwrite")
    if fmt == "csv":
        w.option("header", True).csv(path)
    elif fmt == "json":
        w.json(path)
    else:
        w.parquet(path)


def read_table(spark: SparkSession, path: str, fmt: str = "csv", schema=None) -> DataFrame:
    """Read a written result table back (explicit schema recommended for CSV)."""
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    if fmt == "csv":
        return r.option("header", True).option("inferSchema", schema is None).csv(path)
    if fmt == "json":
        return r.json(path)
    return r.parquet(path)


ACTION_LOG_COLS = ["timestamp_iso", "imdb_const", "action", "rating", "notes", "source", "batch_id"]


def append_actions(actions: DataFrame, path: str) -> DataFrame:
    """S11 (batch form): append the rows that pass P05 in the action-log column order; returns the others with their
    ``reason``."""
    cols = [F.col(c) if c in actions.columns else F.lit(None).cast("string").alias(c)
            for c in ACTION_LOG_COLS]
    clean, bad = validate(actions.select(*cols).withColumn("rating", rating_int(F.col("rating"))), "imdb_const", "rating", "action", ACTIONS)
    clean.write.mode("append").option("header", True).csv(path)
    return bad
