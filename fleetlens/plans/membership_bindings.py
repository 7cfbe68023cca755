"""Catalogue queries for membership: joins, set operations and per-cluster
picks (J1-J3, J8, U1-U3, W1, W2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.operators import joins, windows
from fleetlens.plans import derived as d
from fleetlens.plans.registry import query
from fleetlens.sources.tables import read_table


# Two snapshots of the whole order book: before and after a date.
SPLIT = "1998-01-01"


def snapshot(spark, sf_dir, after: bool):
    o = read_table(spark, sf_dir, "orders")
    date = F.lit(SPLIT).cast("timestamp_ntz")
    return o.filter(F.col("o_orderdate") >= date if after else F.col("o_orderdate") < date)


BEFORE, AFTER = f"o_orderdate < TIMESTAMP '{SPLIT}'", f"o_orderdate >= TIMESTAMP '{SPLIT}'"
REQUESTED = "concat('Customer#', lpad(CAST(user_id * 13 AS STRING), 9, '0'))"


@query("missing_names", "J1", sql=f"""
SELECT DISTINCT {REQUESTED.replace("STRING", "VARCHAR")} AS name FROM events
EXCEPT SELECT c_name FROM customer
""")
def q_missing_names(spark, sf_dir):
    requested = read_table(spark, sf_dir, "events").select(d.col(REQUESTED).alias("c_name"))
    return joins.missing_names(requested, read_table(spark, sf_dir, "customer"), "c_name")


@query("missing_message", "J1", sql=f"""
WITH m AS (SELECT DISTINCT {REQUESTED.replace("STRING", "VARCHAR")} AS name FROM events
           EXCEPT SELECT c_name FROM customer),
n AS (SELECT name, row_number() OVER (ORDER BY name) - 1 AS i, count(*) OVER () AS missing FROM m)
SELECT CAST(i // 10 AS INTEGER) AS chunk, any_value(missing) AS missing,
       concat('Could not find the following security group', CASE WHEN any_value(missing) = 1 THEN '' ELSE 's' END, ': ',
              string_agg(name, ', ' ORDER BY name)) AS message
FROM n GROUP BY i // 10
""")
def q_missing_message(spark, sf_dir):
    return joins.missing_message(q_missing_names(spark, sf_dir), chunk_size=10)


@query("in_use", "J2", sql="""
SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem
WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 10)
""")
def q_in_use(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    small = read_table(spark, sf_dir, "part").filter(F.col("p_size") < 10)
    return joins.in_use(li, small, "l_partkey", "p_partkey")


@query("insert_if_absent", "J3", sql=f"""
SELECT c_custkey, c_name,
       CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE {BEFORE})
            THEN 'rejected' ELSE 'accepted' END AS status
FROM customer
""")
def q_insert_if_absent(spark, sf_dir):
    new = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    existing = snapshot(spark, sf_dir, after=False).select(F.col("o_custkey").alias("c_custkey"))
    return joins.insert_if_absent(new, existing, "c_custkey")


@query("snapshot_diff", "J8", sql=f"""
WITH b AS (SELECT o_custkey, max(o_orderstatus) AS status FROM orders WHERE {BEFORE} GROUP BY o_custkey),
     a AS (SELECT o_custkey, max(o_orderstatus) AS status FROM orders WHERE {AFTER} GROUP BY o_custkey)
SELECT coalesce(b.o_custkey, a.o_custkey) AS o_custkey, b.status AS before_status, a.status AS after_status,
       CASE WHEN b.o_custkey IS NULL THEN 'added' WHEN a.o_custkey IS NULL THEN 'removed'
            WHEN b.status IS NOT DISTINCT FROM a.status THEN 'kept' ELSE 'changed' END AS change
FROM b FULL OUTER JOIN a ON b.o_custkey = a.o_custkey
""")
def q_snapshot_diff(spark, sf_dir):
    def snap(after):
        return snapshot(spark, sf_dir, after).groupBy("o_custkey").agg(F.max("o_orderstatus").alias("status"))
    return joins.snapshot_diff(snap(False), snap(True), "o_custkey", ["status"])


# Statuses per customer: many orders of a customer share one, so rows repeat.
_BAG = "SELECT o_custkey, o_orderstatus FROM orders WHERE"


@query("bag_diff", "J8", sql=f"""
WITH b AS ({_BAG} {BEFORE}), a AS ({_BAG} {AFTER}),
x AS (SELECT 'added' AS change, * FROM (FROM a EXCEPT ALL FROM b) UNION ALL SELECT 'removed', * FROM (FROM b EXCEPT ALL FROM a)
      UNION ALL SELECT 'kept', * FROM (FROM a INTERSECT ALL FROM b))
SELECT o_custkey, o_orderstatus, change, count(*) AS copies FROM x GROUP BY ALL
""")
def q_bag_diff(spark, sf_dir):
    return joins.bag_diff(snapshot(spark, sf_dir, False), snapshot(spark, sf_dir, True), ["o_custkey", "o_orderstatus"])


@query("new_copies", "U1", sql=f"""
{_BAG} {AFTER} EXCEPT ALL {_BAG} {BEFORE}
""")
def q_new_copies(spark, sf_dir):
    cols = ["o_custkey", "o_orderstatus"]
    return joins.new_copies(snapshot(spark, sf_dir, True).select(*cols), snapshot(spark, sf_dir, False).select(*cols))


@query("new_members", "U1", sql=f"""
SELECT o_custkey FROM orders WHERE {AFTER} EXCEPT SELECT o_custkey FROM orders WHERE {BEFORE}
""")
def q_new_members(spark, sf_dir):
    return joins.new_members(snapshot(spark, sf_dir, True).select("o_custkey"),
                             snapshot(spark, sf_dir, False).select("o_custkey"))


@query("combine_rules", "U2", sql="""
SELECT o_orderkey AS key, 'orders' AS src FROM orders
UNION ALL SELECT l_orderkey AS key, 'lineitem' AS src FROM lineitem
""")
def q_combine_rules(spark, sf_dir):
    a = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.lit("orders").alias("src"))
    b = read_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), F.lit("lineitem").alias("src"))
    return joins.combine_rules(a, b)


@query("dedupe_rules", "U3", sql="""
SELECT l_orderkey, l_linenumber, copies, l_partkey, l_suppkey FROM (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
         count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS copies,
         row_number() OVER (PARTITION BY l_orderkey, l_linenumber
                            ORDER BY l_shipdate, l_partkey, l_suppkey) AS rn
  FROM lineitem) WHERE rn = 1
""")
def q_dedupe_rules(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem")
    return joins.dedupe_rules(li, ["l_orderkey", "l_linenumber"],
                              keep_first_by=["l_shipdate", "l_partkey", "l_suppkey"],
                              carry=["l_partkey", "l_suppkey"])


@query("pick_victims", "W1", sql="""
SELECT c_nationkey, c_custkey, victim_rank FROM (
  SELECT c_nationkey, c_custkey, CAST(row_number() OVER (
      PARTITION BY c_nationkey ORDER BY (c_acctbal < 0) DESC, c_custkey) AS INTEGER) AS victim_rank
  FROM customer) WHERE victim_rank <= 3
""")
def q_pick_victims(spark, sf_dir):
    c = read_table(spark, sf_dir, "customer").select(
        "c_nationkey", "c_custkey", (F.col("c_acctbal") < 0).alias("is_spot"))
    return windows.pick_victims(c, "c_nationkey", 3, "is_spot", "c_custkey") \
        .select("c_nationkey", "c_custkey", "victim_rank")


@query("assign_ordinals", "W2", sql="""
SELECT s_nationkey, s_suppkey, s_acctbal,
       row_number() OVER (PARTITION BY s_nationkey ORDER BY s_name, s_suppkey) - 1 AS ordinal,
       concat('/media/ephemeral', CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_name, s_suppkey) - 1 AS VARCHAR)) AS mount_path
FROM supplier
""")
def q_assign_ordinals(spark, sf_dir):
    s = read_table(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey", "s_name", "s_acctbal")
    return windows.assign_ordinals(s, "s_nationkey", "s_name", prefix="/media/ephemeral",
                                   tiebreak=["s_suppkey"]).drop("s_name")
