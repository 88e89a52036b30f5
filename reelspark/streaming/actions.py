"""Structured Streaming over the action log (ST01, ST02, S11).

ST01  drop repeats of (batch_id, user, item, action, rating).
ST02  fold the log into current state per (user, item): the rating of the latest ``rate`` and
      watchlist membership from the latest add/remove, where a repeat dropped by ST01 does not
      count (rate 5, 7, 5 in one batch id ends at 7).

Both rest on one table: the *first occurrence* ``min(struct(ts, event_id))`` of every ST01 key.
Each micro-batch appends the first occurrences among its own rows; a reader merges all deltas
by ``min`` — associative and commutative, so files may arrive in any order, late by any time, or
twice (a retried micro-batch rewrites its own folder) and the result is that of one batch run. No
watermark takes part, so no late row is lost, and the stream holds no operator state: what grows
is the table, partitioned by ``batch_id`` and compacted every N micro-batches.

Every path lives under ``spark.checkpoint.dir`` (shared storage on a cluster).
"""

from __future__ import annotations

import uuid

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.constants import ACTIONS
from ..functions.scalar import rating_int
from ..session import scratch_path
from ..sources import testbind as tb
from ..sources.ingest import parse_timestamp, validate
from ..sources.sinks import ACTION_LOG_COLS

DEDUP_KEY = ["batch_id", "user_id", "item_id", "action", "rating"]


def action_stream(spark: SparkSession, events_path: str, max_files: int | None = None) -> DataFrame:
    """Streaming action rows from a folder (or file glob) of event parquet files."""
    schema = spark.read.parquet(events_path).schema
    r = spark.readStream.schema(schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return tb.actions(spark, "", r.parquet(events_path))


def first_occurrences(actions: DataFrame) -> DataFrame:
    """Earliest (ts, event_id) of every ST01 key (partial aggregate)."""
    return actions.groupBy(*DEDUP_KEY).agg(F.min(F.struct("ts", "event_id")).alias("first"))


def fold_state(firsts: DataFrame) -> DataFrame:
    """ST02 batch step: per (user, item), latest rating and latest watchlist action among the
    given first occurrences, as comparable structs (so states merge by ``max``)."""
    is_rate = F.col("action") == "rate"
    return firsts.groupBy("user_id", "item_id").agg(
        F.max(F.when(is_rate, F.struct(F.col("first.ts").alias("ts"),
                                       F.col("first.event_id").alias("event_id"),
                                       F.col("rating").alias("value")))).alias("last_rate"),
        F.max(F.when(~is_rate, F.struct(F.col("first.ts").alias("ts"),
                                        F.col("first.event_id").alias("event_id"),
                                        (F.col("action") == "watchlist_add").alias("value"))))
        .alias("last_watch"))


def present_state(state: DataFrame) -> DataFrame:
    return state.select("user_id", "item_id",
                        F.col("last_rate.value").cast("int").alias("current_rating"),
                        F.col("last_watch.value").alias("in_watchlist"))


def read_if_there(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path``, or None where nothing has been written; other errors are raised."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def read_firsts(spark: SparkSession, base: str) -> DataFrame | None:
    """First occurrences so far: the latest snapshot and every newer delta, merged by ``min``;
    ``None`` before the first micro-batch."""
    upto, parts = -1, []
    snaps = read_if_there(spark, f"{base}/snap")
    if snaps is not None:
        upto = snaps.agg(F.max("upto")).first()[0]
        parts.append(snaps.where(F.col("upto") == upto).drop("upto"))
    deltas = read_if_there(spark, f"{base}/delta")
    if deltas is not None:
        parts.append(deltas.where(F.col("micro_batch") > upto).drop("micro_batch"))
    if not parts:
        return None
    u = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return u.groupBy(*DEDUP_KEY).agg(F.min("first").alias("first"))


def run_firsts(spark: SparkSession, actions: DataFrame, run_id: str | None = None,
               compact_every: int = 20) -> DataFrame:
    """Run the stream ``actions`` to completion (availableNow); return the first occurrences.

    A micro-batch writes ``delta/micro_batch=<id>``, its own first occurrences, so the write volume
    follows the new rows. Every ``compact_every`` micro-batches the table is compacted into
    ``snap/upto=<id>``. Both writes are keyed by the micro-batch, so retries and restarts from
    the checkpoint give the same table.
    """
    rid = run_id or uuid.uuid4().hex
    base, ck = scratch_path(spark, f"actions/{rid}/firsts"), scratch_path(spark, f"actions/{rid}/ckpt")

    def append(batch: DataFrame, micro_batch: int) -> None:
        first_occurrences(batch).write.mode("overwrite").parquet(f"{base}/delta/micro_batch={micro_batch}")
        if (micro_batch + 1) % compact_every == 0:
            read_firsts(batch.sparkSession, base).write.mode("overwrite").parquet(
                f"{base}/snap/upto={micro_batch}")

    q = (actions.writeStream.outputMode("append").option("checkpointLocation", ck)
         .foreachBatch(append).trigger(availableNow=True).start())
    q.awaitTermination()
    firsts = read_firsts(spark, base)
    if firsts is None:
        raise RuntimeError("the action stream produced no micro-batch")
    return firsts


def run_dedup(spark: SparkSession, events_path: str, run_id: str | None = None,
              max_files: int | None = None) -> DataFrame:
    """ST01 over a folder of event files; rows in a sink partitioned by ``batch_id``."""
    rid = run_id or uuid.uuid4().hex
    firsts = run_firsts(spark, action_stream(spark, events_path, max_files), rid)
    out = scratch_path(spark, f"actions/{rid}/deduplicated")
    firsts.select(*DEDUP_KEY).write.mode("overwrite").partitionBy("batch_id").parquet(out)
    return spark.read.parquet(out).select(*DEDUP_KEY)


def run_state(spark: SparkSession, events_path: str, run_id: str | None = None,
              compact_every: int = 20, max_files: int | None = None) -> DataFrame:
    """ST02 over a folder of event files; returns the current-state table."""
    firsts = run_firsts(spark, action_stream(spark, events_path, max_files), run_id, compact_every)
    return present_state(fold_state(firsts))


def batch_dedup(actions: DataFrame) -> DataFrame:
    """ST01 batch twin: the earliest row of each key by (ts, event_id)."""
    return first_occurrences(actions).select(*DEDUP_KEY, "first.ts", "first.event_id")


def batch_state(actions: DataFrame) -> DataFrame:
    """ST02 batch twin (same functions as the stream, on a static frame)."""
    return present_state(fold_state(first_occurrences(actions)))


# ----------------------------------------------------------------------------- the log itself

LOG_KEY = ["batch_id", "imdb_const", "action", "rating", "notes"]


def read_action_log(spark: SparkSession, path: str, streaming: bool = False,
                    max_files: int | None = None) -> DataFrame:
    """Rows of an action log in CSV (``ACTION_LOG_COLS``), all parsed tolerantly; ``ts`` is the
    parsed ``timestamp_iso``."""
    schema = ", ".join(f"{c} string" for c in ACTION_LOG_COLS)
    r = spark.readStream if streaming else spark.read
    if streaming and max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    rows = r.schema(schema).option("header", True).option("escape", '"').csv(path)
    return rows.withColumns({"rating": rating_int(F.col("rating")),
                             "ts": parse_timestamp(F.col("timestamp_iso"))})


def clean_action_log(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """P05 and the de-duplication of a log: (first row of every ``LOG_KEY``, quarantine)."""
    clean, bad = validate(log, "imdb_const", "rating", "action", ACTIONS)
    first = F.min(F.struct("ts", "timestamp_iso", "source")).alias("first")
    return (clean.groupBy(*LOG_KEY).agg(first)
            .select(F.col("first.timestamp_iso"), "imdb_const", "action", "rating", "notes",
                    F.col("first.source"), "batch_id"), bad)


def _merged(firsts: DataFrame) -> DataFrame:
    """One row per ``LOG_KEY``: the earliest."""
    return firsts.groupBy(*LOG_KEY).agg(F.min("first").alias("first"))


def _delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of any store that Spark writes to; one that is not there is no error."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _commit(spark: SparkSession, base: str, micro_batch: int, upto: int) -> None:
    """The manifest of a micro-batch: that it is whole, and the newest snapshot at that time."""
    spark.createDataFrame([(micro_batch, upto)], "micro_batch long, upto long").coalesce(1) \
        .write.mode("overwrite").parquet(f"{base}/manifest/id={micro_batch}")


def committed(spark: SparkSession, base: str) -> tuple[int, int]:
    """(newest micro-batch, newest snapshot) that are whole; -1 for none."""
    manifest = read_if_there(spark, f"{base}/manifest")
    if manifest is None:
        return -1, -1
    newest = manifest.agg(F.max("micro_batch"), F.max("upto")).first()
    return (-1, -1) if newest[0] is None else (newest[0], newest[1])


def _log_firsts(spark: SparkSession, base: str, newest: int, upto: int) -> DataFrame | None:
    parts = []
    if upto >= 0:
        parts.append(spark.read.parquet(f"{base}/snap/upto={upto}"))
    if newest > upto:
        deltas = read_if_there(spark, f"{base}/clean")
        if deltas is not None:
            parts.append(deltas.where((F.col("micro_batch") > upto) & (F.col("micro_batch") <= newest)).drop("micro_batch"))
    if not parts:
        return None
    return _merged(parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]))


def append_log_stream(spark: SparkSession, source: str, base: str, compact_every: int = 20, max_files: int | None = None) -> None:
    """S11/ST01: take the action-log files in folder ``source`` that are new into the log under ``base`` (both on storage
    that all executors reach), with the key ``LOG_KEY`` and P05.

    A micro-batch writes its first row of every key (``clean``) and its quarantine, then, last of all, its manifest: what a
    reader sees is what manifests name, so a batch that died half-way is not there, and when it is replayed it writes the same
    folders again. Every ``compact_every`` batches the log is merged into a snapshot; when the manifest that names it is there,
    the deltas and snapshots before the *previous* snapshot are deleted, so a reader that has just read an
    older manifest still finds its files.
    """
    def take(batch: DataFrame, micro_batch: int) -> None:
        session = batch.sparkSession
        newest, upto = committed(session, base)
        if micro_batch <= newest:  # replayed after its manifest was written: it is whole
            retire_log(session, base)
            return
        batch = batch.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            clean, bad = validate(batch, "imdb_const", "rating", "action", ACTIONS)
            clean.groupBy(*LOG_KEY).agg(F.min(F.struct("ts", "timestamp_iso", "source")).alias("first")) \
                .write.mode("overwrite").parquet(f"{base}/clean/micro_batch={micro_batch}")
            bad.write.mode("overwrite").parquet(f"{base}/quarantine/micro_batch={micro_batch}")
        finally:
            batch.unpersist()
        snap = upto
        if (micro_batch + 1) % compact_every == 0:
            _log_firsts(session, base, micro_batch, upto).write.mode("overwrite").parquet(f"{base}/snap/upto={micro_batch}")
            snap = micro_batch
        _commit(session, base, micro_batch, snap)
        if snap == micro_batch:
            retire_log(session, base)

    (read_action_log(spark, source, streaming=True, max_files=max_files).writeStream.outputMode("append")
     .option("checkpointLocation", f"{base}/ckpt").foreachBatch(take).trigger(availableNow=True).start().awaitTermination())


def _snapshots(spark: SparkSession, base: str) -> list[int]:
    """Snapshots that manifests name, newest first."""
    manifest = read_if_there(spark, f"{base}/manifest")
    if manifest is None:
        return []
    return sorted((r.upto for r in manifest.select("upto").where("upto >= 0").distinct().collect()), reverse=True)


def retire_log(spark: SparkSession, base: str) -> None:
    """Delete what no reader can need: deltas and manifests that the previous snapshot holds, and the snapshots before it."""
    snaps = _snapshots(spark, base)
    if len(snaps) < 2:
        return
    keep = snaps[1]
    for old in snaps[2:]:
        _delete(spark, f"{base}/snap/upto={old}")
    manifest = spark.read.parquet(f"{base}/manifest")
    for r in manifest.select("micro_batch").where(F.col("micro_batch") < keep).collect():
        _delete(spark, f"{base}/clean/micro_batch={r.micro_batch}")
        _delete(spark, f"{base}/manifest/id={r.micro_batch}")
    _delete(spark, f"{base}/clean/micro_batch={keep}")


def read_log(spark: SparkSession, base: str) -> DataFrame:
    """The log under ``base`` in ``ACTION_LOG_COLS``: the first row of every key of all whole micro-batches."""
    firsts = _log_firsts(spark, base, *committed(spark, base))
    if firsts is None:
        return spark.createDataFrame([], ", ".join(f"{c} {'int' if c == 'rating' else 'string'}" for c in ACTION_LOG_COLS))
    return firsts.select(F.col("first.timestamp_iso"), "imdb_const", "action", "rating", "notes", F.col("first.source"), "batch_id")


def read_log_quarantine(spark: SparkSession, base: str) -> DataFrame | None:
    """Refused rows of all whole micro-batches with their ``reason``; None where nothing has been written."""
    bad = read_if_there(spark, f"{base}/quarantine")
    return None if bad is None else bad.where(F.col("micro_batch") <= committed(spark, base)[0]).drop("micro_batch")
