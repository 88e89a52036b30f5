"""Registered queries: streaming action log (ST01, ST02), each run as a real Structured
Streaming query (availableNow) over the events table; the oracles are the batch twins."""

from __future__ import annotations

from ..sources import testbind as tb
from ..streaming import actions as st
from .registry import query


@query("action_log_dedup", tb.with_views("""
SELECT DISTINCT batch_id, user_id, item_id, action, rating FROM actions""", "actions"))
def action_log_dedup(spark, sf_dir):
    return st.run_dedup(spark, f"{sf_dir.rstrip('/')}/events*.parquet")


@query("action_log_state", tb.with_views("""
, firsts AS (SELECT batch_id, user_id, item_id, action, rating, min(ts) AS ts,
               arg_min(event_id, (ts, event_id)) AS event_id
             FROM actions GROUP BY batch_id, user_id, item_id, action, rating),
lr AS (SELECT user_id, item_id, rating FROM (SELECT *, row_number() OVER (PARTITION BY user_id, item_id
         ORDER BY ts DESC, event_id DESC) AS rn FROM firsts WHERE action = 'rate') WHERE rn = 1),
lw AS (SELECT user_id, item_id, action = 'watchlist_add' AS in_watchlist FROM (
         SELECT *, row_number() OVER (PARTITION BY user_id, item_id ORDER BY ts DESC, event_id DESC) AS rn
         FROM firsts WHERE action <> 'rate') WHERE rn = 1)
SELECT coalesce(lr.user_id, lw.user_id) AS user_id, coalesce(lr.item_id, lw.item_id) AS item_id,
  CAST(lr.rating AS INT) AS current_rating, lw.in_watchlist
FROM lr FULL OUTER JOIN lw ON lr.user_id = lw.user_id AND lr.item_id = lw.item_id""", "actions"))
def action_log_state(spark, sf_dir):
    return st.run_state(spark, f"{sf_dir.rstrip('/')}/events*.parquet")
