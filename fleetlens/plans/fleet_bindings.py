"""Catalogue queries for listing and describing the fleet (F, O, A1-A3, A7, A8).

Fleet roles of the fixture tables: customer or nation is a cluster,
orders / suppliers are members, ``o_orderstatus`` is member state,
conversation roles are node roles.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.operators import aggs, filters
from fleetlens.plans import derived as d
from fleetlens.plans.registry import query
from fleetlens.sources.tables import read_table

CONSENSUS_SQL = """CASE WHEN count({c}) = 0 THEN NULL
       WHEN min({c}) = max({c}) AND count({c}) = count(*) THEN min({c})
       ELSE 'inconsistent' END"""


def describe_fleet(spark, sf_dir):
    """Flagship: every customer with orders as a cluster, its state by
    consensus of order status and its node counts, by name."""
    orders = read_table(spark, sf_dir, "orders")
    live = filters.inventory_filter(orders, any_of={"o_orderstatus": ["F", "O", "P"], "o_custkey": []})
    summary = aggs.describe_groups(live, "o_custkey", "o_orderstatus", "o_orderpriority",
                                   master_roles=["1-URGENT"],
                                   slave_roles=["2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"])
    out = summary.select(F.col("o_custkey").alias("cluster"), "state", "masters", "slaves", "nodes")
    return filters.order_by_name(out, "cluster")


query("describe_fleet", "F1+A2+A3+O1", sql=f"""
SELECT o_custkey AS cluster, {CONSENSUS_SQL.format(c='o_orderstatus')} AS state,
       count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS masters,
       count(*) FILTER (WHERE o_orderpriority IN ('2-HIGH','3-MEDIUM','4-NOT SPECIFIED','5-LOW')) AS slaves,
       count(*) FILTER (WHERE o_orderpriority IN ('1-URGENT','2-HIGH','3-MEDIUM','4-NOT SPECIFIED','5-LOW')) AS nodes
FROM orders
WHERE o_orderstatus IN ('F','O','P')
GROUP BY o_custkey ORDER BY cluster
""")(describe_fleet)


@query("inventory_filter", "F1", sql="""
SELECT c_custkey, c_name, c_nationkey FROM customer
WHERE c_mktsegment = 'BUILDING' AND c_nationkey IN (1, 3, 5, 7)
""")
def q_inventory_filter(spark, sf_dir):
    c = read_table(spark, sf_dir, "customer")
    return filters.inventory_filter(
        c, equals={"c_mktsegment": "BUILDING"},
        any_of={"c_nationkey": [1, 3, 5, 7], "c_name": []},
    ).select("c_custkey", "c_name", "c_nationkey")


@query("tag_filter", "F2", sql="""
SELECT p_partkey, p_type FROM part WHERE p_type IN ('PROMO', 'SMALL')
""")
def q_tag_filter(spark, sf_dir):
    p = read_table(spark, sf_dir, "part").withColumn(
        "tags", F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("type"), F.col("p_type")))
    return filters.tag_filter(p, "tags", "type", ["PROMO", "SMALL"]).select("p_partkey", "p_type")


@query("device_filter", "F3", sql=f"""
SELECT l_orderkey, l_linenumber, kname, CAST(size AS BIGINT) AS size_bytes FROM (
  SELECT l_orderkey, l_linenumber, {d.DEVICE_KNAME} AS kname, {d.DEVICE_MOUNT} AS mountpoint,
         {d.DEVICE_SIZE} AS size FROM lineitem)
WHERE (mountpoint IS NULL OR mountpoint <> '/') AND TRY_CAST(size AS BIGINT) >= 1073741824
""")
def q_device_filter(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber",
        d.col(d.DEVICE_KNAME).alias("kname"), d.col(d.DEVICE_MOUNT).alias("mountpoint"),
        d.col(d.DEVICE_SIZE).alias("size"))
    return (filters.device_filter(li, "mountpoint", "size")
            .select("l_orderkey", "l_linenumber", "kname",
                    F.col("size").cast("bigint").alias("size_bytes")))


@query("choose_address", "F4", sql=f"""
SELECT c_custkey,
       CASE WHEN {d.CUSTOMER_PRIVATE} THEN {d.CUSTOMER_PRIVATE_IP} ELSE {d.CUSTOMER_PUBLIC_IP} END AS ip,
       CASE WHEN {d.CUSTOMER_PRIVATE} THEN {d.CUSTOMER_PRIVATE_HOST} ELSE {d.CUSTOMER_PUBLIC_HOST} END AS host
FROM customer
""")
def q_choose_address(spark, sf_dir):
    c = read_table(spark, sf_dir, "customer").select(
        "c_custkey", d.col(d.CUSTOMER_PRIVATE).alias("private"),
        d.col(d.CUSTOMER_PRIVATE_IP).alias("private_ip"), d.col(d.CUSTOMER_PUBLIC_IP).alias("public_ip"),
        d.col(d.CUSTOMER_PRIVATE_HOST).alias("private_host"),
        d.col(d.CUSTOMER_PUBLIC_HOST).alias("public_host"))
    return (filters.choose_address(c, "private", "private_ip", "public_ip", "private_host", "public_host")
            .select("c_custkey", "ip", "host"))


@query("cluster_addresses", "F4", sql=f"""
WITH n AS (SELECT *, {d.CUSTOMER_PRIVATE} AS private, c_mktsegment = 'BUILDING' AS is_master FROM customer),
d AS (SELECT c_nationkey, arg_min(private, struct_pack(n := NOT is_master, i := c_custkey)) AS private FROM n GROUP BY c_nationkey)
SELECT c_custkey, c_nationkey,
       CASE WHEN d.private THEN {d.CUSTOMER_PRIVATE_IP} ELSE {d.CUSTOMER_PUBLIC_IP} END AS ip,
       CASE WHEN d.private THEN {d.CUSTOMER_PRIVATE_HOST} ELSE {d.CUSTOMER_PUBLIC_HOST} END AS host
FROM customer JOIN d USING (c_nationkey)
""")
def q_cluster_addresses(spark, sf_dir):
    c = read_table(spark, sf_dir, "customer").select(
        "c_custkey", "c_nationkey", "c_mktsegment", d.col(d.CUSTOMER_PRIVATE).alias("private"),
        d.col(d.CUSTOMER_PRIVATE_IP).alias("private_ip"), d.col(d.CUSTOMER_PUBLIC_IP).alias("public_ip"),
        d.col(d.CUSTOMER_PRIVATE_HOST).alias("private_host"),
        d.col(d.CUSTOMER_PUBLIC_HOST).alias("public_host"))
    return filters.cluster_addresses(c, "c_nationkey", "c_custkey", "c_mktsegment", "private", "private_ip", "public_ip",
                                     "private_host", "public_host", master_role="BUILDING") \
        .select("c_custkey", "c_nationkey", "ip", "host")


LIVE_STATE = """CASE o_orderstatus WHEN 'F' THEN 'terminated' WHEN 'O' THEN 'running'
  ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'shutting-down' ELSE 'pending' END END"""


@query("live_instances", "F1", sql=f"""
WITH i AS (SELECT o_orderkey, {LIVE_STATE} AS state FROM orders)
SELECT o_orderkey, state FROM i WHERE state IN ('pending', 'running', 'stopping', 'stopped')
""")
def q_live_instances(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", d.col(LIVE_STATE).alias("state"))
    return filters.live_instances(o, "state")


MASTER_HOST = "concat('master-', CAST(c_custkey AS STRING), '.internal')"


@query("project_hosts", "F5", sql=f"SELECT c_name AS name, {MASTER_HOST} AS master_host FROM customer")
def q_project_hosts(spark, sf_dir):
    c = read_table(spark, sf_dir, "customer").withColumn("master_host", d.col(MASTER_HOST))
    return filters.project_hosts(c, "c_name", "master_host")


@query("transfer_warning", "F6", sql="""
WITH t AS (SELECT source, CAST(sum(n_chars) AS BIGINT) AS total_bytes FROM documents GROUP BY source),
     n AS (SELECT source, count(DISTINCT lang) AS node_count FROM documents GROUP BY source)
SELECT source, total_bytes, node_count, total_bytes * node_count AS transfer_bytes
FROM t JOIN n USING (source) WHERE total_bytes * node_count > 300000
""")
def q_transfer_warning(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    return filters.transfer_warning(docs.select("source", "n_chars"), docs.select("source", "lang"),
                                    "source", "n_chars", "lang", limit=300_000)


PATHS = "array(concat('/media/ephemeral', CAST(c_custkey % 3 AS STRING)), '/media/ephemeral0', '/media/data')"


@query("order_by_name", "O1", sql=f"""
SELECT c_name AS name, list_sort({PATHS.replace("array(", "list_value(", 1)}) AS paths FROM customer ORDER BY name
""")
def q_order_by_name(spark, sf_dir):
    c = read_table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), d.col(PATHS).alias("paths"))
    return filters.order_by_name(c, "name", array_cols=["paths"])


@query("sample_first", "O2", sql="""
SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal, c_custkey LIMIT 10
""")
def q_sample_first(spark, sf_dir):
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return filters.sample_first(c, 10, ["c_acctbal", "c_custkey"])


@query("compose_groups", "A1", sql="""
WITH n AS (SELECT c_nationkey, c_name, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_name) - 1 AS i,
                  count(*) OVER (PARTITION BY c_nationkey) AS n_members FROM customer)
SELECT c_nationkey, CAST(i // 20 AS INTEGER) AS chunk, list(c_name ORDER BY c_name) AS members, any_value(n_members) AS n_members
FROM n GROUP BY c_nationkey, i // 20
""")
def q_compose_groups(spark, sf_dir):
    c = read_table(spark, sf_dir, "customer")
    return aggs.compose_groups(c, "c_nationkey", "c_name", chunk_size=20)


@query("group_consensus", "A2", sql=f"""
SELECT c.c_custkey AS o_custkey,
       CASE WHEN o.n_rows IS NULL THEN 'inconsistent' ELSE o.state END AS state,
       coalesce(o.n_rows, 0) AS n_rows
FROM customer c LEFT JOIN (
  SELECT o_custkey, {CONSENSUS_SQL.format(c='o_orderstatus')} AS state, count(*) AS n_rows
  FROM orders GROUP BY o_custkey) o
ON c.c_custkey = o.o_custkey
""")
def q_group_consensus(spark, sf_dir):
    orders = read_table(spark, sf_dir, "orders")
    clusters = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"))
    return aggs.group_consensus(orders, "o_custkey", "o_orderstatus", clusters=clusters)


@query("role_counts", "A3", sql="""
SELECT conv_id, count(*) FILTER (WHERE role = 'system') AS masters,
       count(*) FILTER (WHERE role IN ('user', 'assistant')) AS slaves,
       count(*) FILTER (WHERE role IN ('system', 'user', 'assistant')) AS nodes
FROM conversations GROUP BY conv_id
""")
def q_role_counts(spark, sf_dir):
    c = read_table(spark, sf_dir, "conversations")
    return aggs.role_counts(c, "conv_id", "role", ["system"], ["user", "assistant"])


URL_HOST = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:@]*@)?([^/?#:]*)', 2)"


@query("distinct_names", "A7", sql=f"SELECT DISTINCT {URL_HOST} AS name FROM pages")
def q_distinct_names(spark, sf_dir):
    p = read_table(spark, sf_dir, "pages").select(d.col(URL_HOST).alias("host"))
    return aggs.distinct_names(p, "host")


NAME_TAG = "CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_brand END"


@query("unnamed_rows", "A7", sql=f"SELECT p_partkey, 'missing name' AS problem FROM part WHERE ({NAME_TAG}) IS NULL")
def q_unnamed_rows(spark, sf_dir):
    p = read_table(spark, sf_dir, "part").select("p_partkey", d.col(NAME_TAG).alias("name"))
    return aggs.unnamed_rows(p, "name", ["p_partkey"])


WORKER_CORES = "(4 * (1 + s_suppkey % 4))"
EXECUTORS = "(1 + s_suppkey % 3)"


@query("capacity", "A8", sql=f"""
SELECT r_name, n_name, count(*) AS nodes, CAST(sum({WORKER_CORES}) AS BIGINT) AS worker_cores,
       CAST(sum({EXECUTORS}) AS BIGINT) AS executors,
       CAST(sum(CAST(floor({WORKER_CORES} / {EXECUTORS}) AS BIGINT)) AS BIGINT) AS executor_cores,
       GROUPING(r_name, n_name) AS level
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
GROUP BY ROLLUP (r_name, n_name)
""")
def q_capacity(spark, sf_dir):
    s = read_table(spark, sf_dir, "supplier")
    n = read_table(spark, sf_dir, "nation")
    r = read_table(spark, sf_dir, "region")
    nodes = (s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
             .select("r_name", "n_name", d.col(WORKER_CORES).alias("cores"),
                     d.col(EXECUTORS).alias("executors")))
    return aggs.capacity(nodes, ["r_name", "n_name"], "cores", "executors")
