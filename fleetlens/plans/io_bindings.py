"""Catalogue queries for sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.plans import derived as d
from fleetlens.plans.fleet_bindings import CONSENSUS_SQL
from fleetlens.plans.registry import query
from fleetlens.session import scratch_path
from fleetlens.sources import log_files, manifests, report, text
from fleetlens.sources.tables import read_table

# ------------------------------------------------------------------ S1
MANIFEST_DOC = """CASE WHEN event_id % 97 = 0 THEN '{broken' ELSE concat(
  '{"java_version": ', CAST(8 + user_id % 10 AS STRING), ', "services": [["Spark", ', props,
  '], ["HDFS", {"version": "3.3.', CAST(event_id % 7 AS STRING), '"}]], ',
  '"ssh_key_pair": {"public": "k", "private": "p"}}') END"""


@query("read_manifests", "S1", sql="""
SELECT event_id, 'ok' AS status, 8 + CAST(user_id % 10 AS INTEGER) AS java_version, 'Spark' AS service,
       NULL::VARCHAR AS version, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
FROM events WHERE event_id % 97 <> 0
UNION ALL
SELECT event_id, 'ok', 8 + CAST(user_id % 10 AS INTEGER), 'HDFS', concat('3.3.', CAST(event_id % 7 AS VARCHAR)), NULL
FROM events WHERE event_id % 97 <> 0
UNION ALL
SELECT event_id, 'invalid', NULL, NULL, NULL, NULL FROM events WHERE event_id % 97 = 0
""")
def q_read_manifests(spark, sf_dir):
    e = read_table(spark, sf_dir, "events").select("event_id", d.col(MANIFEST_DOC).alias("doc"))
    return manifests.read_manifests(e, "doc", ["event_id"], fields={"k": "bigint"})


# ------------------------------------------------------------------ S2
JAVA = "CASE WHEN n_regionkey % 2 = 0 THEN 11 ELSE 17 END"


@query("write_manifests", "S2", sql=f"""
WITH c AS (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY s_nationkey)
SELECT n_name AS cluster, concat('{{"java_version":', CAST({JAVA} AS VARCHAR),
  ',"services":[["HDFS",{{"executor_instances":null,"version":"3.', CAST(n_regionkey AS VARCHAR), '.0"}}],',
  '["Spark",{{"executor_instances":', CAST(coalesce(c.n, 0) AS VARCHAR), ',"version":"3.',
  CAST(n_nationkey % 6 AS VARCHAR), '.0"}}]]}}') AS manifest, false AS conflict
FROM nation LEFT JOIN c ON n_nationkey = c.s_nationkey
""")
def q_write_manifests(spark, sf_dir):
    n = read_table(spark, sf_dir, "nation")
    counts = read_table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n"))
    nodes = n.join(counts, n.n_nationkey == counts.s_nationkey, "left")
    svc = F.array(
        F.struct(F.lit("HDFS").alias("service"),
                 F.concat(F.lit("3."), F.col("n_regionkey").cast("string"), F.lit(".0")).alias("version"),
                 F.lit(None).cast("bigint").alias("executor_instances")),
        F.struct(F.lit("Spark").alias("service"),
                 F.concat(F.lit("3."), (F.col("n_nationkey") % 6).cast("string"), F.lit(".0")).alias("version"),
                 F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("executor_instances")))
    rows = nodes.select("n_name", d.col(JAVA).alias("java_version"), F.explode(svc).alias("s")) \
        .select("n_name", "java_version", "s.*")
    return manifests.write_manifests(rows, "n_name", "service", ["version", "executor_instances"],
                                     "java_version")


# ------------------------------------------------------------------ S3
@query("read_key_value_lines", "S3", sql="""
WITH q AS (SELECT page_id, regexp_replace(replace(regexp_extract(url, '\\?([^#]*)', 1), '&', ' '),
                                          '([^ =]+)=([^ ]*)', '\\1="\\2"', 'g') AS line FROM pages),
p AS (SELECT page_id, regexp_extract_all(line, '([A-Za-z0-9_]+)="([^"]*)"', 1) AS ks,
             regexp_extract_all(line, '([A-Za-z0-9_]+)="([^"]*)"', 2) AS vs FROM q)
SELECT page_id, lower(unnest(ks)) AS key, lower(unnest(vs)) AS value FROM p
""")
def q_read_key_value_lines(spark, sf_dir):
    p = read_table(spark, sf_dir, "pages").select("page_id", "url")
    query_text = F.try_parse_url(F.col("url"), F.lit("QUERY"))
    line = F.regexp_replace(F.replace(query_text, F.lit("&"), F.lit(" ")), "([^ =]+)=([^ ]*)", '$1="$2"')
    return text.read_key_value_lines(p.select("page_id", line.alias("line")), "line", ["page_id"],
                                     lower_values=True)


DEVICE_LINE = ("concat('NAME=\"sda', CAST(p_partkey AS STRING), '\" MAJ:MIN=\"8:1\" SIZE=\"', CAST(p_size AS STRING), '\"', "
               "CASE WHEN p_size % 2 = 0 THEN concat(' MOUNTPOINT=\"/', p_brand, '\"') ELSE '' END)")


@query("read_device_lines", "S3", sql="""
SELECT p_partkey, concat('sda', CAST(p_partkey AS VARCHAR)) AS name, CAST(p_size AS VARCHAR) AS size,
       CASE WHEN p_size % 2 = 0 THEN lower(concat('/', p_brand)) END AS mountpoint, '8:1' AS "maj:min"
FROM part
""")
def q_read_device_lines(spark, sf_dir):
    p = read_table(spark, sf_dir, "part").select("p_partkey", d.col(DEVICE_LINE).alias("line"))
    return text.read_device_lines(p, "line", ["name", "size", "mountpoint", "maj:min"], ["p_partkey"])


# ------------------------------------------------------------------ S4
FIELD_LINE = "CASE WHEN p_size > 45 THEN concat(p_name, ' ', p_brand) ELSE p_name END"


@query("read_fields", "S4", sql=f"""
WITH l AS (SELECT p_partkey, {FIELD_LINE} AS line FROM part),
s AS (SELECT *, string_split_regex(regexp_replace(line, '^\\s+|\\s+$', '', 'g'), '\\s+') AS f FROM l)
SELECT p_partkey, line, CASE WHEN len(f) = 2 THEN 'ok' ELSE 'invalid' END AS status,
       CASE WHEN len(f) = 2 THEN f[1] END AS color, CASE WHEN len(f) = 2 THEN f[2] END AS kind
FROM s
""")
def q_read_fields(spark, sf_dir):
    p = read_table(spark, sf_dir, "part").select("p_partkey", d.col(FIELD_LINE).alias("line"))
    return text.read_fields(p, "line", ["color", "kind"])


# ------------------------------------------------------------------ S5
MODULE = "CASE event_type WHEN 'error' THEN 'ssh' WHEN 'signup' THEN 'ec2' ELSE 'core' END"
LEVEL = "CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'view' THEN 'DEBUG' ELSE 'INFO' END"
HOST = "concat('10.0.', CAST(user_id % 256 AS STRING), '.', CAST(event_id % 256 AS STRING))"
MESSAGE = "concat(event_type, ' cents=', CAST(CAST(floor(value * 100) AS BIGINT) AS STRING))"


def _log_line(time_text: str) -> str:
    return (f"CASE WHEN event_id % 101 = 0 THEN concat('Traceback (most recent call last): ', event_type) "
            f"ELSE concat({time_text}, ' - fleet.', rpad({MODULE}, 9, ' '), ' - ', rpad({LEVEL}, 5, ' '), "
            f"' - [', {HOST}, '] ', {MESSAGE}) END")


@query("read_operation_log", "S5", sql=f"""
SELECT event_id,
       CASE WHEN event_id % 101 = 0 THEN 'invalid' ELSE 'ok' END AS status,
       CASE WHEN event_id % 101 = 0 THEN NULL ELSE date_trunc('millisecond', ts) END AS ts,
       CASE WHEN event_id % 101 = 0 THEN NULL ELSE concat('fleet.', {MODULE}) END AS logger,
       CASE WHEN event_id % 101 = 0 THEN NULL ELSE {LEVEL} END AS level,
       CASE WHEN event_id % 101 = 0 THEN NULL ELSE {HOST} END AS host,
       CASE WHEN event_id % 101 = 0 THEN NULL ELSE {MESSAGE} END AS message
FROM events
""")
def q_read_operation_log(spark, sf_dir):
    e = read_table(spark, sf_dir, "events").select(
        "event_id", d.col(_log_line("date_format(ts, 'yyyy-MM-dd HH:mm:ss,SSS')")).alias("line"))
    return text.read_operation_log(e, "line").drop("line")


# Some messages go on over two more lines.
_MORE = "CASE WHEN event_id % 7 = 0 THEN concat(chr(10), '  at step ', CAST(event_id % 5 AS STRING), chr(10), '  done') ELSE '' END"


@query("read_log_files", "S5", sql=f"""
SELECT date_trunc('millisecond', ts) AS ts, concat('fleet.', {MODULE}) AS logger, {LEVEL} AS level, {HOST} AS host,
       concat({MESSAGE}, {_MORE.replace("AS STRING", "AS VARCHAR")}) AS message, 'ok' AS status
FROM events WHERE event_id % 101 <> 0
""")
def q_read_log_files(spark, sf_dir):
    """The well-formed lines of the events' log, written as files and read back in blocks of 256 KiB."""
    e = read_table(spark, sf_dir, "events").filter("event_id % 101 <> 0")
    folder = scratch_path(spark, "logs")
    line = d.col(_log_line("date_format(ts, 'yyyy-MM-dd HH:mm:ss,SSS')"))
    e.select(F.concat(line, F.expr(_MORE)).alias("value")).write.text(folder)
    return log_files.read_log_files(spark, folder, 1 << 18).select("ts", "logger", "level", "host", "message", "status")


# ------------------------------------------------------------------ S6
NODE_STATE = """CASE WHEN n_regionkey = 4 THEN 'stopped'
  WHEN n_regionkey = 3 AND s_suppkey % 17 = 0 THEN 'stopped' ELSE 'running' END"""
NODE_ROLE = "CASE WHEN s_suppkey < 25 THEN 'master' ELSE 'slave' END"
NODE_HOST = "concat('node-', CAST(s_suppkey AS STRING), '.internal')"


@query("fleet_report", "S6", sql=f"""
WITH n AS (SELECT n_name AS cluster, {NODE_STATE} AS state, {NODE_ROLE} AS role, {NODE_HOST} AS host
           FROM supplier JOIN nation ON s_nationkey = n_nationkey),
s AS (SELECT cluster, {CONSENSUS_SQL.format(c='state')} AS state, count(*) AS node_count,
             min(host) FILTER (WHERE role = 'master') AS master FROM n GROUP BY cluster)
SELECT cluster, 0 AS chunk,
       concat(cluster, ':', chr(10), '  state: ', coalesce(state, 'None'), chr(10), '  node-count: ',
              CAST(node_count AS VARCHAR),
              CASE WHEN state = 'running' THEN concat(chr(10), '  master: ', coalesce(master, ''), chr(10), '  slaves:')
                   ELSE '' END) AS report
FROM s
UNION ALL
SELECT cluster, 1 AS chunk, string_agg(concat('    - ', host), chr(10) ORDER BY host) AS report
FROM n WHERE role = 'slave' AND cluster IN (SELECT cluster FROM s WHERE state = 'running')
GROUP BY cluster
""")
def q_fleet_report(spark, sf_dir):
    s = read_table(spark, sf_dir, "supplier")
    n = read_table(spark, sf_dir, "nation")
    nodes = s.join(n, s.s_nationkey == n.n_nationkey).select(
        F.col("n_name").alias("cluster"), d.col(NODE_STATE).alias("state"),
        d.col(NODE_ROLE).alias("role"), d.col(NODE_HOST).alias("host"))
    return report.fleet_report(nodes, "cluster", "state", "role", "host")


# ------------------------------------------------------------------ S7
OBJECT_PATH = """CASE WHEN url LIKE 'https://%' THEN concat('s3n://', substr(url, 9))
     ELSE concat('s3://', substr(url, 8)) END"""


@query("normalize_object_paths", "S7", sql=f"""
SELECT page_id, regexp_replace({OBJECT_PATH}, '^s3n?://', 's3a://') AS path FROM pages
""")
def q_normalize_object_paths(spark, sf_dir):
    p = read_table(spark, sf_dir, "pages").select("page_id", d.col(OBJECT_PATH).alias("path"))
    return text.normalize_object_paths(p, "path")
