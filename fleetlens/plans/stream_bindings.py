"""Catalogue queries for the streaming operators.

Each query streams the files of the ``events`` table where they are
(``availableNow``) and returns what the sink holds. Where windows, sessions
or timers wait for the watermark, the table's event time is ended by a
heartbeat (``streams.run_to_end``), so nothing is left in state.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.plans import derived as d
from fleetlens.plans.registry import query
from fleetlens.plans.rules_bindings import CLUSTER_STATE, COMMAND, _DECISIONS
from fleetlens.sources.tables import read_table
from fleetlens.streaming import machines, streams


def _path(sf_dir):
    return f"{sf_dir.rstrip('/')}/events.parquet"


def _events(spark, sf_dir):
    return streams.event_stream(spark, _path(sf_dir))


@query("health_windows", "T2", sql="""
WITH b AS (SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type <> 'error' AS ok FROM events)
SELECT window_start, window_start + INTERVAL '1 hour' AS window_end, count(*) AS probes,
       count(*) FILTER (WHERE ok) AS successes, count(*) FILTER (WHERE NOT ok) AS failures,
       count(*) FILTER (WHERE ok) = 0 AS down
FROM b GROUP BY window_start
""")
def q_health_windows(spark, sf_dir):
    return streams.run_to_end(spark, _path(sf_dir), lambda e: streams.health_windows(
        e.withColumn("ok", F.col("event_type") != "error"), "ok", "1 hour"), "health_windows")


@query("health_windows_sliding", "T2", sql="""
WITH b AS (SELECT time_bucket(INTERVAL '30 minutes', ts) AS s, event_type <> 'error' AS ok FROM events),
w AS (SELECT s AS window_start, ok FROM b UNION ALL SELECT s - INTERVAL '30 minutes', ok FROM b)
SELECT window_start, window_start + INTERVAL '1 hour' AS window_end, count(*) AS probes,
       count(*) FILTER (WHERE ok) AS successes, count(*) FILTER (WHERE NOT ok) AS failures,
       count(*) FILTER (WHERE ok) = 0 AS down
FROM w GROUP BY window_start
""")
def q_health_windows_sliding(spark, sf_dir):
    return streams.run_to_end(spark, _path(sf_dir), lambda e: streams.health_windows(
        e.withColumn("ok", F.col("event_type") != "error"), "ok", "1 hour", "30 minutes"), "health_windows_sliding")


# Hosts waited for: every customer, from an hour of the month derived from its key. Most of them never send an event.
SINCE = "TIMESTAMP '2024-01-01 00:00:00' + (c_custkey * 37 % 700) * INTERVAL '1 hour'"


@query("health_deadlines", "T2", sql=f"""
WITH h AS (SELECT c_custkey AS user_id, {SINCE} AS since FROM customer)
SELECT h.user_id, h.since, h.since + INTERVAL '12 hours' AS deadline,
       CASE WHEN count(*) FILTER (WHERE e.event_type <> 'error') > 0 THEN 'up' ELSE 'down' END AS status,
       count(e.event_id) AS probes, count(*) FILTER (WHERE e.event_type <> 'error') AS successes,
       min(e.ts) FILTER (WHERE e.event_type <> 'error') AS first_ok
FROM h LEFT JOIN events e ON e.user_id = h.user_id AND e.ts BETWEEN h.since AND h.since + INTERVAL '12 hours'
GROUP BY h.user_id, h.since
""")
def q_health_deadlines(spark, sf_dir):
    hosts = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.expr(
        "timestampadd(HOUR, c_custkey * 37 % 700, TIMESTAMP_NTZ'2024-01-01 00:00:00')").alias("since"))
    return streams.run_to_end(spark, _path(sf_dir), lambda e: machines.health_deadlines(
        e.withColumn("ok", F.col("event_type") != "error"), hosts, "user_id", "ok", "12 hours"), "health_deadlines")


@query("attempt_sessions", "T3", sql="""
WITH e AS (SELECT user_id, ts, event_id, event_type,
                  CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL '4 hours' THEN 1 ELSE 0 END AS new
           FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS sid FROM e)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL '4 hours' AS session_end,
       count(*) AS attempts, count(*) FILTER (WHERE event_type = 'error') AS failures
FROM s GROUP BY user_id, sid
""")
def q_attempt_sessions(spark, sf_dir):
    return streams.run_to_end(spark, _path(sf_dir), lambda e: streams.attempt_sessions(
        e.withColumn("ok", F.col("event_type") != "error"), "user_id", "ok", "4 hours"), "attempt_sessions")


# An attempt of each kind: purchases succeed, sign-ups fail for good, the rest may be tried again.
FAILURE_KIND = """CASE event_type WHEN 'error' THEN 'timeout' WHEN 'click' THEN 'connection-refused'
  WHEN 'view' THEN 'authentication' WHEN 'signup' THEN 'ssh-protocol' END"""


@query("attempt_outcomes", "T3", sql="""
WITH a AS (SELECT user_id, ts, event_id, CASE event_type WHEN 'purchase' THEN 'ok' WHEN 'signup' THEN 'fatal' ELSE 'retry' END AS act
           FROM events),
b AS (SELECT *, CASE WHEN lag(act) OVER w IS DISTINCT FROM 'retry' OR ts - lag(ts) OVER w > INTERVAL '12 hours' THEN 1 ELSE 0 END AS new
      FROM a WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS seg FROM b),
n AS (SELECT *, (row_number() OVER (PARTITION BY user_id, seg ORDER BY ts, event_id) - 1) // 3 AS part FROM s)
SELECT user_id, min(ts) AS chain_start, max(ts) AS chain_end, count(*) AS attempts,
       CASE arg_max(act, (ts, event_id)) WHEN 'ok' THEN 'succeeded' WHEN 'fatal' THEN 'fatal'
            ELSE CASE WHEN count(*) = 3 THEN 'exhausted' ELSE 'open' END END AS outcome
FROM n GROUP BY user_id, seg, part
""")
def q_attempt_outcomes(spark, sf_dir):
    return streams.run_to_end(spark, _path(sf_dir), lambda e: machines.attempt_outcomes(
        e.withColumn("ok", F.col("event_type") == "purchase").withColumn("kind", F.expr(FAILURE_KIND)),
        "user_id", "ok", "kind", 3, 12 * 3600), "attempt_outcomes")


@query("stream_dedupe", "T4", sql="""
SELECT DISTINCT user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS rule_k FROM events
""")
def q_stream_dedupe(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("rule_k", F.get_json_object("props", "$.k").cast("bigint"))
    return streams.dedupe_into(e, ["user_id", "rule_k"], "stream_dedupe", watermark="2 days")


@query("admit_stream", "T5", sql=f"""
WITH c AS (SELECT event_id, {COMMAND} AS command, {CLUSTER_STATE} AS state FROM events),
t(command, state, decision, exit_code) AS (VALUES {_DECISIONS})
SELECT event_id, c.command, c.state, coalesce(t.decision, 'invalid') AS decision,
       coalesce(t.exit_code, 1) AS exit_code
FROM c LEFT JOIN t ON c.command = t.command AND (c.state = t.state OR (t.state = '*' AND c.state IS NOT NULL))
""")
def q_admit_stream(spark, sf_dir):
    e = _events(spark, sf_dir).select("event_id", d.col(COMMAND).alias("command"),
                                      d.col(CLUSTER_STATE).alias("state"))
    return streams.run_available(streams.admit_stream(e, "command", "state"), "admit_stream")


# State changes are the events of three types, with a state by value; commands are the other two.
CHANGE_TYPES = ("purchase", "signup", "error")
LIVE_STATE = "CASE WHEN value < 10 THEN 'stopped' WHEN value < 40 THEN 'running' ELSE 'pending' END"
LIVE_COMMAND = """CASE event_id % 5 WHEN 0 THEN 'start' WHEN 1 THEN 'stop' WHEN 2 THEN 'run-command'
  WHEN 3 THEN 'add-slaves' ELSE 'destroy' END"""


@query("admit_live", "T5", sql=f"""
WITH r AS (SELECT event_id, user_id, ts, {LIVE_COMMAND} AS command FROM events WHERE event_type IN ('click', 'view')),
s AS (SELECT user_id, ts, {LIVE_STATE} AS state FROM events WHERE event_type IN ('purchase', 'signup', 'error')),
c AS (SELECT r.*, s.state FROM r ASOF LEFT JOIN s ON r.user_id = s.user_id AND r.ts >= s.ts),
t(command, state, decision, exit_code) AS (VALUES {_DECISIONS})
SELECT c.*, coalesce(t.decision, 'invalid') AS decision, coalesce(t.exit_code, 1) AS exit_code
FROM c LEFT JOIN t ON c.command = t.command AND (c.state = t.state OR (t.state = '*' AND c.state IS NOT NULL))
""")
def q_admit_live(spark, sf_dir):
    def build(e):
        beat, change = F.col("event_type") == streams.HEARTBEAT, F.col("event_type").isin(*CHANGE_TYPES)
        return machines.admit_live(
            e.filter(beat | ~change).withColumn("command", F.expr(LIVE_COMMAND)),
            e.filter(beat | change).withColumn("state", F.expr(LIVE_STATE)), "user_id", "command", "state")
    return streams.run_to_end(spark, _path(sf_dir), build, "admit_live")


@query("track_state", "T1", sql="""
WITH l AS (SELECT user_id, user_id % 10 AS cluster, event_type FROM events
           QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
SELECT cluster, count(*) AS members, count(*) FILTER (WHERE event_type <> 'purchase') AS laggards,
       count(*) FILTER (WHERE event_type <> 'purchase') = 0 AS all_reached
FROM l GROUP BY cluster
""")
def q_track_state(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("cluster", F.col("user_id") % 10)
    changes = streams.run_available_updates(
        streams.track_state(e, "user_id", "cluster", "event_type"), "track_state")
    return streams.cluster_status(changes, "purchase")


def _clusters(name, cluster, spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("cluster", cluster)
    return machines.newest_status(streams.run_available(
        machines.track_cluster(e, "user_id", "cluster", "event_type", "purchase"), name))


@query("track_cluster", "T1", sql="""
WITH l AS (SELECT user_id, user_id % 10 AS cluster, event_type FROM events
           QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
SELECT cluster, count(*) AS members, count(*) FILTER (WHERE event_type <> 'purchase') AS laggards,
       count(*) FILTER (WHERE event_type <> 'purchase') = 0 AS all_reached
FROM l GROUP BY cluster
""")
def q_track_cluster(spark, sf_dir):
    return _clusters("track_cluster", F.col("user_id") % 10, spark, sf_dir)


@query("track_cluster_moves", "T1", sql="""
WITH l AS (SELECT user_id, (user_id + day(ts)) % 10 AS cluster, event_type FROM events
           QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
SELECT cluster, count(*) AS members, count(*) FILTER (WHERE event_type <> 'purchase') AS laggards,
       count(*) FILTER (WHERE event_type <> 'purchase') = 0 AS all_reached
FROM l GROUP BY cluster
""")
def q_track_cluster_moves(spark, sf_dir):
    """Members change their cluster from day to day."""
    return _clusters("track_cluster_moves", (F.col("user_id") + F.dayofmonth("ts")) % 10, spark, sf_dir)
