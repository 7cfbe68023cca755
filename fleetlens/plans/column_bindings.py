"""Catalogue queries for the per-row column jobs.

Inputs with no natural table (versions, Java banners, tag text, access
sources, settings documents, payloads) are derived from fixture columns
by one SQL expression shared with the oracle.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.functions import columns as X
from fleetlens.plans import derived as d
from fleetlens.plans.registry import query
from fleetlens.sources.tables import read_table

# ------------------------------------------------------------------ X1
VERSION = """CASE WHEN p_partkey % 50 = 0 THEN concat('v', CAST(p_size AS STRING))
     WHEN p_partkey % 77 = 0 THEN ''
     WHEN p_partkey % 91 = 0 THEN concat(md5(CAST(p_partkey AS STRING)), substr(md5(p_name), 1, 8))
     ELSE concat(CAST(p_size % 4 + 1 AS STRING), '.', CAST(p_partkey % 12 AS STRING), '.',
                 CAST(p_size % 3 AS STRING)) END"""


@query("version_audit", "X1", sql=f"""
WITH v AS (SELECT p_partkey, {VERSION} AS version FROM part),
k AS (SELECT *, list_transform(string_split(version, '.'), lambda x: TRY_CAST(x AS INTEGER)) AS k FROM v),
s AS (SELECT *, CASE WHEN version IS NULL OR version = '' THEN 'empty'
                     WHEN regexp_full_match(version, '[0-9a-f]{{40}}') THEN 'commit'
                     WHEN NOT list_bool_or(list_transform(k, lambda x: x IS NULL)) THEN 'release'
                     ELSE 'invalid' END AS status FROM k)
SELECT p_partkey, version, status,
       CASE WHEN status = 'release' THEN k END AS version_key,
       CASE WHEN status = 'empty' THEN NULL
            WHEN contains(version, '.') THEN array_to_string(list_slice(string_split(version, '.'), 1, 2), '.')
            ELSE version END AS short_version,
       CASE WHEN status <> 'release' THEN NULL WHEN k < [2, 7] THEN 'hadoop2.6'
            WHEN k < [3, 0] THEN 'hadoop2.7' ELSE 'hadoop3.2' END AS hadoop_build
FROM s
""")
def q_version_audit(spark, sf_dir):
    p = read_table(spark, sf_dir, "part").select("p_partkey", d.col(VERSION).alias("version"))
    return X.version_audit(p, "version")


# ------------------------------------------------------------------ X2
BANNER = """CASE p_size % 5
  WHEN 0 THEN concat('openjdk version "1.8.0_', CAST(p_partkey AS STRING), '"')
  WHEN 1 THEN concat('openjdk version "11.0.', CAST(p_partkey % 20 AS STRING), '" 2020-04-14')
  WHEN 2 THEN 'java version "17"'
  WHEN 3 THEN 'bash: java: command not found'
  ELSE 'openjdk version "21.0.1" 2023-10-17' END"""

JAVA_MAJOR_SQL = """TRY_CAST(CASE WHEN len(parts) >= 2 THEN (CASE WHEN parts[1] = '1' THEN parts[2] ELSE parts[1] END)
                  ELSE parts[1] END AS INTEGER)"""


@query("runtime_compliance", "X2", sql=f"""
WITH b AS (SELECT p_brand, {BANNER} AS banner FROM part),
t AS (SELECT *, string_split_regex(regexp_replace(banner, '^\\s+|\\s+$', '', 'g'), '\\s+') AS tokens FROM b),
r AS (SELECT *, CASE WHEN len(tokens) >= 3 THEN regexp_replace(tokens[3], '^"+|"+$', '', 'g') END AS raw FROM t),
p AS (SELECT *, string_split(raw, '.') AS parts FROM r),
j AS (SELECT p_brand, {JAVA_MAJOR_SQL} AS major FROM p)
SELECT p_brand, count(*) FILTER (WHERE major = 11) AS n_equal, count(*) FILTER (WHERE major > 11) AS n_newer,
       count(*) FILTER (WHERE major < 11) AS n_older, count(*) FILTER (WHERE major IS NULL) AS n_missing
FROM j GROUP BY p_brand
""")
def q_runtime_compliance(spark, sf_dir):
    p = read_table(spark, sf_dir, "part").select("p_brand", d.col(BANNER).alias("banner"))
    return X.runtime_compliance(p, "banner", "p_brand", required=11)


# ------------------------------------------------------------------ X3
TAG_TEXT = """CASE WHEN p_partkey % 50 = 0 THEN replace(p_name, ' ', ',,')
     WHEN p_partkey % 53 = 0 THEN concat(' ,', p_name)
     WHEN p_partkey % 59 = 0 THEN p_name
     WHEN p_partkey % 61 = 0 THEN concat(p_name, ',')
     ELSE replace(p_name, ' ', ', ') END"""


@query("ingest_tags", "X3", sql=f"""
WITH t AS (SELECT p_partkey, {TAG_TEXT} AS raw FROM part),
s AS (SELECT *, len(string_split(raw, ',')) - 1 AS commas,
             regexp_replace(split_part(raw, ',', 1), '^\\s+|\\s+$', '', 'g') AS k,
             regexp_replace(split_part(raw, ',', 2), '^\\s+|\\s+$', '', 'g') AS v FROM t),
o AS (SELECT *, (commas = 1 AND k <> '') AS ok FROM s)
SELECT p_partkey, raw, CASE WHEN ok THEN 'ok' ELSE 'invalid' END AS status,
       CASE WHEN ok THEN k END AS tag_key, CASE WHEN ok THEN v END AS tag_value
FROM o
""")
def q_ingest_tags(spark, sf_dir):
    p = read_table(spark, sf_dir, "part").select("p_partkey", d.col(TAG_TEXT).alias("raw"))
    return X.ingest_tags(p, "raw")


# ------------------------------------------------------------------ X4
TAG_ARRAY = """array(named_struct('Key', 'Name', 'Value', s_name),
      named_struct('Key', 'role', 'Value', CASE WHEN s_suppkey % 7 = 0 THEN 'master' ELSE 'slave' END),
      named_struct('Key', CASE WHEN s_suppkey % 3 = 0 THEN 'Name' ELSE 'zone' END,
                   'Value', concat('node-', CAST(s_suppkey AS STRING))))"""


@query("tags_to_map", "X4", sql="""
SELECT s_suppkey,
       CASE WHEN s_suppkey % 3 = 0 THEN concat('node-', CAST(s_suppkey AS VARCHAR)) ELSE s_name END AS name,
       CASE WHEN s_suppkey % 7 = 0 THEN 'master' ELSE 'slave' END AS role,
       CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE concat('node-', CAST(s_suppkey AS VARCHAR)) END AS zone,
       CASE WHEN s_suppkey % 3 = 0 THEN 2 ELSE 3 END AS n_tags
FROM supplier
""")
def q_tags_to_map(spark, sf_dir):
    s = read_table(spark, sf_dir, "supplier").select("s_suppkey", d.col(TAG_ARRAY).alias("tags"))
    m = X.tags_to_map(s, "tags")
    return m.select("s_suppkey", F.col("tag_map")["Name"].alias("name"),
                    F.col("tag_map")["role"].alias("role"),
                    F.try_element_at("tag_map", F.lit("zone")).alias("zone"),
                    F.size("tag_map").alias("n_tags"))


# ------------------------------------------------------------------ X5
SOURCE = """CASE s_suppkey % 8
 WHEN 0 THEN concat('sg-', substr(md5(CAST(s_suppkey AS STRING)), 1, 17))
 WHEN 1 THEN concat('10.', CAST(s_suppkey % 256 AS STRING), '.0.0/16')
 WHEN 2 THEN concat('10.', CAST(s_suppkey % 256 AS STRING), '.', CAST(s_suppkey % 7 AS STRING), '.0/16')
 WHEN 3 THEN concat('192.168.', CAST(s_suppkey % 256 AS STRING), '.', CAST((s_suppkey * 3) % 256 AS STRING))
 WHEN 4 THEN concat('10.', CASE WHEN s_suppkey % 3 = 0 THEN '010' ELSE '10' END, '.0.0/16')
 WHEN 5 THEN concat('172.16.0.0/', CASE s_suppkey % 3 WHEN 0 THEN '255.255.0.0'
                                   WHEN 1 THEN '0.0.255.255' ELSE '255.0.255.0' END)
 WHEN 6 THEN concat('10.', CAST(s_suppkey % 300 AS STRING), '.0.0/16')
 ELSE concat('10.0.0.0/', CAST(s_suppkey % 40 AS STRING)) END"""


def ipv4_sql(t: str) -> str:
    """DuckDB: dotted IPv4 text to integer, NULL if malformed."""
    parts = f"string_split({t}, '.')"
    ok = (f"(len({parts}) = 4 AND list_bool_and(list_transform({parts}, "
          f"lambda q: regexp_full_match(q, '0|[1-9][0-9]{{0,2}}') AND TRY_CAST(q AS INTEGER) <= 255)))")
    val = f"list_reduce(list_transform({parts}, lambda q: TRY_CAST(q AS BIGINT)), lambda a, b: a * 256 + b)"
    return f"(CASE WHEN {ok} THEN {val} END)"


NETMASK_LIST = "[" + ", ".join(str(k) for k, _ in sorted(X.NETMASKS.items(), key=lambda kv: kv[1])) + "]"
HOSTMASK_LIST = "[" + ", ".join(str(k) for k, _ in sorted(X.HOSTMASKS.items(), key=lambda kv: kv[1])) + "]"

SOURCES_SQL = f"""
WITH s AS (SELECT s_suppkey, {SOURCE} AS source FROM supplier),
h AS (SELECT *, string_split(source, '/') AS halves FROM s),
p AS (SELECT *, {ipv4_sql('halves[1]')} AS addr,
             CASE WHEN len(halves) >= 2 THEN halves[2] END AS pfx FROM h),
l AS (SELECT *, CASE WHEN len(halves) = 1 THEN 32
                     WHEN regexp_full_match(pfx, '[0-9]+') THEN
                          CASE WHEN TRY_CAST(pfx AS BIGINT) <= 32 THEN TRY_CAST(pfx AS INTEGER) END
                     ELSE coalesce(list_position({NETMASK_LIST}, {ipv4_sql('pfx')}) - 1,
                                   list_position({HOSTMASK_LIST}, {ipv4_sql('pfx')}) - 1) END AS plen FROM p),
m AS (SELECT *, (CAST(1 AS BIGINT) << (32 - plen)) - 1 AS hostbits FROM l),
k AS (SELECT *, CASE WHEN starts_with(source, 'sg-') THEN 'group'
                     WHEN len(halves) <= 2 AND addr IS NOT NULL AND plen IS NOT NULL AND (addr & hostbits) = 0
                     THEN 'cidr' ELSE 'invalid' END AS kind FROM m)
SELECT s_suppkey, source, kind,
       CASE WHEN kind = 'cidr' THEN plen END AS prefix_len,
       CASE WHEN kind = 'cidr' THEN addr END AS net_start,
       CASE WHEN kind = 'cidr' THEN addr + hostbits END AS net_end,
       CASE WHEN kind = 'group' THEN source
            WHEN kind = 'cidr' THEN concat(concat_ws('.', (addr >> 24) & 255, (addr >> 16) & 255,
                                                     (addr >> 8) & 255, addr & 255), '/', plen) END AS source_value
FROM k
"""


def supplier_sources(spark, sf_dir):
    s = read_table(spark, sf_dir, "supplier").select("s_suppkey", d.col(SOURCE).alias("source"))
    return X.ingest_sources(s, "source")


@query("ingest_sources", "X5", sql=SOURCES_SQL)
def q_ingest_sources(spark, sf_dir):
    return supplier_sources(spark, sf_dir)


# ------------------------------------------------------------------ X6
SCHEME_RE = "^([A-Za-z][A-Za-z0-9+.-]*)://"
AUTH_RE = "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"
PATH_RE = "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"


@query("url_inventory", "X6", sql=f"""
WITH u AS (SELECT regexp_extract(url, '{SCHEME_RE}', 1) AS scheme,
                  regexp_extract(url, '{AUTH_RE}', 1) AS authority,
                  regexp_extract(url, '{PATH_RE}', 1) AS path FROM pages)
SELECT authority, count(*) AS urls, count(*) FILTER (WHERE scheme = 'https') AS https_urls,
       count(*) FILTER (WHERE suffix(path, '/')) AS trailing_slash_urls,
       count(*) FILTER (WHERE suffix(lower(path), '.gz') OR suffix(lower(path), '.tgz')) AS archive_urls
FROM u GROUP BY authority
""")
def q_url_inventory(spark, sf_dir):
    return X.url_inventory(read_table(spark, sf_dir, "pages").select("url"), "url")


# ------------------------------------------------------------------ X7
SETTINGS_DOC = """concat('{"java-version": ', CAST(8 + user_id % 3 AS STRING),
  ', "ec2": {"spot-price": ', CAST(CAST(floor(value * 100) AS BIGINT) AS STRING),
  ', "key-name": "key-', CAST(user_id AS STRING), '", "tags": {}}, "tags": ["a-b", "c"], "props": ',
  props, '}')"""


@query("flatten_settings", "X7", sql="""
SELECT event_id, 'java_version' AS path, CAST(8 + user_id % 3 AS VARCHAR) AS value, 'ok' AS status FROM events
UNION ALL SELECT event_id, 'ec2.spot_price', CAST(CAST(floor(value * 100) AS BIGINT) AS VARCHAR), 'ok' FROM events
UNION ALL SELECT event_id, 'ec2.key_name', concat('key-', CAST(user_id AS VARCHAR)), 'ok' FROM events
UNION ALL SELECT event_id, 'tags', '["a-b","c"]', 'ok' FROM events
UNION ALL SELECT event_id, 'props.k', json_extract_string(props, '$.k'), 'ok' FROM events
""")
def q_flatten_settings(spark, sf_dir):
    e = read_table(spark, sf_dir, "events").select("event_id", d.col(SETTINGS_DOC).alias("doc"))
    return X.flatten_settings(e, "doc", ["event_id"])


SECTIONS_DOC = """concat('{"launch": {"num-slaves": ', CAST(user_id % 5 AS STRING), ', "java-version": 11}, ',
  '"providers": {"ec2": {"key-name": "key-', CAST(user_id AS STRING), '", "region": null}}, ',
  '"services": {"spark": {"version": "3.', CAST(event_id % 6 AS STRING), '.0"}, "hdfs": ',
  CASE WHEN event_id % 3 = 0 THEN 'null' ELSE '{"download-source": "s"}' END, '}}')"""


@query("command_defaults", "X7", sql="""
WITH c(command) AS (VALUES ('launch'), ('describe'), ('destroy'), ('login'), ('start'), ('stop'), ('add-slaves'),
                           ('remove-slaves'), ('run-command'), ('copy-file'))
SELECT event_id, 'launch' AS command, 'num_slaves' AS option, CAST(user_id % 5 AS VARCHAR) AS value FROM events
UNION ALL SELECT event_id, 'launch', 'java_version', '11' FROM events
UNION ALL SELECT event_id, command, 'ec2_key_name', concat('key-', CAST(user_id AS VARCHAR)) FROM events CROSS JOIN c
UNION ALL SELECT event_id, command, 'ec2_region', NULL FROM events CROSS JOIN c
UNION ALL SELECT event_id, 'launch', 'spark_version', concat('3.', CAST(event_id % 6 AS VARCHAR), '.0') FROM events
UNION ALL SELECT event_id, 'launch', 'hdfs_download_source', 's' FROM events WHERE event_id % 3 <> 0
""")
def q_command_defaults(spark, sf_dir):
    e = read_table(spark, sf_dir, "events").select("event_id", d.col(SECTIONS_DOC).alias("doc"))
    return X.command_defaults(e, "doc", ["event_id"])


# ------------------------------------------------------------------ X8
EPHEMERAL = ("slice(array('/media/ephemeral0', '/media/ephemeral1/', '/media/ephemeral2'), 1, "
             "CAST(s_suppkey % 4 AS INT))")


def _dirs_sql(svc: str) -> str:
    return (f"array_to_string(list_transform(list_slice(['/media/ephemeral0', '/media/ephemeral1/', "
            f"'/media/ephemeral2'], 1, s_suppkey % 4), lambda p: CASE WHEN suffix(p, '/') THEN p || '{svc}' "
            f"ELSE p || '/{svc}' END), ',')")


@query("storage_layout", "X8", sql=f"""
SELECT s_suppkey, {_dirs_sql('spark')} AS spark_ephemeral_dirs,
       CASE WHEN s_suppkey % 4 = 0 THEN '/media/root/spark' ELSE {_dirs_sql('spark')} END AS spark_root_ephemeral_dirs,
       CASE WHEN s_suppkey % 4 = 0 THEN '/media/root/hadoop' ELSE {_dirs_sql('hadoop')} END AS hadoop_root_ephemeral_dirs
FROM supplier
""")
def q_storage_layout(spark, sf_dir):
    s = read_table(spark, sf_dir, "supplier").select(
        "s_suppkey", F.lit("/media/root").alias("root"), d.col(EPHEMERAL).alias("ephemeral"))
    return X.storage_layout(s, "root", "ephemeral").select(
        "s_suppkey", "spark_ephemeral_dirs", "spark_root_ephemeral_dirs", "hadoop_root_ephemeral_dirs")


# ------------------------------------------------------------------ X9
FAILURE_KIND_BY_K = ("timeout", "connection-refused", "authentication", "ssh-protocol",
                     "usage", "nothing-to-do", "disk-full")


def _kind_case(k: str) -> str:
    whens = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(FAILURE_KIND_BY_K))
    return f"CASE {k} % {len(FAILURE_KIND_BY_K)} {whens} END"


# written out by hand, not taken from the library's table
_FAILURE_VALUES = """('timeout', 'retry', 1), ('connection-refused', 'retry', 1), ('authentication', 'retry', 1),
  ('connection-error', 'fatal', 1), ('ssh-protocol', 'fatal', 1), ('cluster-not-found', 'fatal', 1),
  ('cluster-invalid-state', 'fatal', 1), ('nothing-to-do', 'none', 0), ('usage', 'fatal', 2),
  ('unsupported-provider', 'fatal', 2)"""


@query("classify_failures", "X9", sql=f"""
WITH f AS (SELECT {_kind_case("CAST(json_extract_string(props, '$.k') AS INTEGER)")} AS kind
           FROM events WHERE event_type = 'error'),
m(kind, action, exit_code) AS (VALUES {_FAILURE_VALUES})
SELECT f.kind, coalesce(m.action, 'fatal') AS action, coalesce(m.exit_code, 1) AS exit_code,
       count(*) AS failures
FROM f LEFT JOIN m ON f.kind = m.kind GROUP BY ALL
""")
def q_classify_failures(spark, sf_dir):
    e = read_table(spark, sf_dir, "events").filter(F.col("event_type") == "error")
    f = e.select(d.col(_kind_case("CAST(get_json_object(props, '$.k') AS INT)")).alias("kind"))
    return X.failure_counts(f, "kind")


# ------------------------------------------------------------------ X10
@query("raise_volume_floor", "X10", sql="""
SELECT p_partkey, greatest(p_size, 30) AS volume_size,
       CASE WHEN p_size < 30 THEN 'gp2' ELSE p_type END AS volume_type, p_brand AS snapshot_id
FROM part
""")
def q_raise_volume_floor(spark, sf_dir):
    p = read_table(spark, sf_dir, "part").select("p_partkey", F.struct(
        F.col("p_size").alias("VolumeSize"), F.col("p_type").alias("VolumeType"),
        (F.col("p_size") % 2 == 0).alias("Encrypted"), F.col("p_brand").alias("SnapshotId")).alias("ebs"))
    out = X.raise_volume_floor(p, "ebs", 30)
    return out.select("p_partkey", F.col("ebs.VolumeSize").alias("volume_size"),
                      F.col("ebs.VolumeType").alias("volume_type"),
                      F.col("ebs.SnapshotId").alias("snapshot_id"))


# ------------------------------------------------------------------ X11
PAYLOAD = """CASE WHEN lang = 'de' THEN NULL WHEN source = 'src3' THEN '@@not base64@@'
     ELSE base64(encode(text, 'UTF-8')) END"""


@query("decode_payload", "X11", sql="""
SELECT doc_id, md5(CASE WHEN lang = 'de' OR source = 'src3' THEN '' ELSE text END) AS digest,
       CAST(strlen(CASE WHEN lang = 'de' OR source = 'src3' THEN '' ELSE text END) AS BIGINT) AS n_bytes
FROM documents
""")
def q_decode_payload(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", d.col(PAYLOAD).alias("payload"))
    out = X.decode_payload(docs, "payload")
    return out.select("doc_id", F.md5("decoded").alias("digest"),
                      F.octet_length("decoded").cast("bigint").alias("n_bytes"))
