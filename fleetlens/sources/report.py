"""Fleet report: one YAML block per cluster.

Fixed values: the report layout (key names, two-space indent, "- " list
items; master and slaves only for a running cluster)::

    <cluster>:
      state: <state>
      node-count: <n>
      master: <master host, or empty>      # only when running
      slaves:                              # only when running
        - <slave host>

State is the consensus of member states. The slave list is built with
``compose_groups``, so a very large cluster yields several consecutive
text rows (``chunk`` 0, 1, ...) instead of one unbounded string; the
header is chunk 0 and slave lists are chunks 1, 2, ... Joining the rows
with newlines in (cluster, chunk) order (as ``path=`` writes them) gives
the whole document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.operators.aggs import compose_groups, consensus_expr
from fleetlens.session import materialize


def fleet_report(nodes: DataFrame, cluster_col: str, state_col: str, role_col: str,
                 host_col: str, master_role: str = "master", slave_role: str = "slave",
                 chunk_size: int = 10_000, path: str | None = None) -> DataFrame:
    is_master = F.col(role_col) == F.lit(master_role)
    is_slave = F.col(role_col) == F.lit(slave_role)
    summary = nodes.groupBy(cluster_col).agg(
        consensus_expr(state_col).alias("state"),
        F.count(F.lit(1)).alias("node_count"),
        F.min(F.when(is_master, F.col(host_col))).alias("master"))
    # One row per cluster, written once: the headers and the slave filter both read it.
    summary = materialize(summary, "fleet-summary")
    # Slave lists only for running clusters; between two plain scans AQE can split a hot cluster.
    names = summary.filter(F.col("state") == F.lit("running")).select(F.col(cluster_col).alias("_running"))
    running_slaves = nodes.filter(is_slave).join(names, F.col(cluster_col).eqNullSafe(F.col("_running")), "left_semi")
    slaves = compose_groups(running_slaves, cluster_col, host_col, chunk_size=chunk_size) \
        .select(cluster_col, "chunk", "members")
    running = F.col("state") == F.lit("running")
    header = F.concat(
        F.col(cluster_col).cast("string"), F.lit(":\n  state: "), F.coalesce(F.col("state"), F.lit("None")),
        F.lit("\n  node-count: "), F.col("node_count").cast("string"),
        F.when(running, F.concat(F.lit("\n  master: "), F.coalesce(F.col("master"), F.lit("")),
                                 F.lit("\n  slaves:"))).otherwise(F.lit("")))
    head_rows = summary.select(F.col(cluster_col).alias("cluster"), F.lit(0).alias("chunk"),
                               header.alias("report"))
    items = F.array_join(F.transform("members", lambda h: F.concat(F.lit("    - "), h)), "\n")
    slave_rows = slaves.select(F.col(cluster_col).alias("cluster"), (F.col("chunk") + 1).alias("chunk"),
                               items.alias("report"))
    out = head_rows.unionByName(slave_rows)
    if path is not None:
        out.orderBy("cluster", "chunk").select(F.col("report").alias("value")).write.mode("overwrite").text(path)
    return out
