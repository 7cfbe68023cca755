"""Catalogue queries over operation history.

``events`` plays the operation log: one row per attempt, ``error`` is a
failed attempt, ``user_id`` is the host.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.operators import aggs, rowmap, windows
from fleetlens.plans.registry import query
from fleetlens.sources.tables import read_table


def _events(spark, sf_dir, *cols):
    return read_table(spark, sf_dir, "events").select(*cols)


@query("retry_chains", "W3", sql="""
WITH e AS (SELECT user_id, ts, event_id, event_type <> 'error' AS ok FROM events),
c AS (SELECT *, CAST(coalesce(sum(CAST(ok AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, event_id
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS chain FROM e),
g AS (SELECT user_id, chain, count(*) AS attempts, bool_or(ok) AS succeeded,
             min(ts) AS first_ts, max(ts) AS last_ts FROM c GROUP BY user_id, chain)
SELECT user_id, chain, attempts, first_ts, last_ts,
       CASE WHEN succeeded AND attempts <= 3 THEN 'succeeded' WHEN succeeded THEN 'late'
            WHEN attempts >= 3 THEN 'exhausted' ELSE 'open' END AS outcome
FROM g
""")
def q_retry_chains(spark, sf_dir):
    e = _events(spark, sf_dir, "user_id", "ts", "event_id", (F.col("event_type") != "error").alias("ok"))
    return windows.retry_chains(e, "user_id", "ts", "event_id", "ok", limit=3)


@query("time_to_state", "W4", sql="""
WITH n AS (SELECT event_id, user_id, ts, event_type,
             min(CASE WHEN event_type = 'purchase' THEN ts END) OVER (
               PARTITION BY user_id ORDER BY ts, event_id
               ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_target_ts FROM events)
SELECT event_id, user_id, ts, next_target_ts,
       CAST((epoch_us(next_target_ts) - epoch_us(ts)) // 1000000 AS BIGINT) AS wait_seconds
FROM n WHERE event_type IN ('signup', 'purchase')
""")
def q_time_to_state(spark, sf_dir):
    e = _events(spark, sf_dir, "event_id", "user_id", "ts", "event_type")
    return windows.time_to_state(e, "user_id", "ts", "event_id", "event_type",
                                 ["signup", "purchase"], "purchase").drop("event_type")


@query("latest_state", "W5", sql="""
SELECT user_id, ts, event_type, value FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1
""")
def q_latest_state(spark, sf_dir):
    e = _events(spark, sf_dir, "user_id", "ts", "event_id", "event_type", "value")
    return windows.latest_state(e, "user_id", "ts", ["event_type", "value"], tiebreak="event_id")


@query("fold_outcomes", "A6", sql="""
SELECT CAST(ts AS DATE) AS op_day, count(*) AS hosts,
       count(*) FILTER (WHERE event_type = 'error') AS failures,
       bool_or(event_type = 'error') AS failed,
       arg_min(user_id, ts) FILTER (WHERE event_type = 'error') AS first_failed_host
FROM events GROUP BY CAST(ts AS DATE)
""")
def q_fold_outcomes(spark, sf_dir):
    e = _events(spark, sf_dir, F.to_date("ts").alias("op_day"), "user_id", "ts",
                (F.col("event_type") != "error").alias("ok"))
    return aggs.fold_outcomes(e, "op_day", "user_id", "ok", "ts")


END_TS = "timestampadd(MICROSECOND, CAST(floor(value * 1000000) AS BIGINT), ts)"


@query("duration_summary", "A9", sql="""
WITH o AS (SELECT user_id, ts AS started, ts + to_microseconds(CAST(floor(value * 1000000) AS BIGINT)) AS finished
           FROM events WHERE event_type <> 'error'),
d AS (SELECT user_id, CAST(epoch(date_trunc('second', finished)) - epoch(date_trunc('second', started)) AS BIGINT) AS s
      FROM o)
SELECT user_id, count(*) AS ops, min(s) AS min_seconds, max(s) AS max_seconds,
       CAST(sum(s) AS BIGINT) AS total_seconds
FROM d GROUP BY user_id
""")
def q_duration_summary(spark, sf_dir):
    e = _events(spark, sf_dir, "user_id", F.col("ts").alias("started"),
                F.expr(END_TS).alias("finished"), (F.col("event_type") != "error").alias("ok"))
    return aggs.duration_summary(e, "user_id", "started", "finished", "ok")


def document_stats(row: dict) -> dict:
    """Example user function: UTF-8 size and line count of a document;
    documents in German are refused (a per-row failure)."""
    if row["lang"] == "de":
        raise ValueError("unsupported language de")
    text = row["text"]
    return {"n_bytes": len(text.encode("utf-8")), "n_lines": text.count("\n") + 1}


@query("map_rows", "M1", sql="""
SELECT doc_id,
       CASE WHEN lang = 'de' THEN NULL ELSE CAST(strlen(text) AS BIGINT) END AS n_bytes,
       CASE WHEN lang = 'de' THEN NULL ELSE CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS BIGINT) END AS n_lines,
       CASE WHEN lang = 'de' THEN 'ValueError: unsupported language de' END AS error
FROM documents
""")
def q_map_rows(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return rowmap.map_rows(docs, document_stats, "n_bytes long, n_lines long", keep=["doc_id"])


@query("map_until_failure", "M1", sql="""
SELECT doc_id, CAST(strlen(text) AS BIGINT) AS n_bytes,
       CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS BIGINT) AS n_lines,
       CAST(NULL AS VARCHAR) AS error, 'ok' AS status
FROM documents
""")
def q_map_until_failure(spark, sf_dir):
    """A function that no row makes fail: every wave runs."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", F.lit("").alias("lang"), "text")
    return rowmap.map_until_failure(docs, document_stats, "n_bytes long, n_lines long", keep=["doc_id"], waves=4)
