"""Projections, filters, predicates and ordering.

All of these are narrow transformations except ``transfer_warning``
(two partial aggregates) and the sorts; Catalyst pushes the equality
and IN predicates into the Parquet scan.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.session import materialize

# Instance states that a fleet listing shows (terminated
# and shutting-down machines are hidden).
LIVE_STATES = ("pending", "running", "stopping", "stopped")

GIB = 1024 ** 3


def inventory_filter(df: DataFrame, equals: Mapping[str, object] | None = None,
                     any_of: Mapping[str, Iterable] | None = None) -> DataFrame:
    """AND of ``col == value`` and ``col IN (values)``.

    An empty value list means "no filter on this column", as a listing
    with no cluster names lists every cluster.
    """
    cond: Column | None = None
    for name, value in (equals or {}).items():
        term = F.col(name) == F.lit(value)
        cond = term if cond is None else cond & term
    for name, values in (any_of or {}).items():
        values = list(values)
        if not values:
            continue
        term = F.col(name).isin(values)
        cond = term if cond is None else cond & term
    return df if cond is None else df.filter(cond)


def live_instances(df: DataFrame, state_col: str = "state") -> DataFrame:
    """Default listing filter: hide terminated rows."""
    return inventory_filter(df, any_of={state_col: LIVE_STATES})


def tag_filter(df: DataFrame, tags_col: str, tag: str, values: Iterable[str]) -> DataFrame:
    """Keep rows whose tag ``tag`` (in a MAP<STRING,STRING> column) is in ``values``."""
    return df.filter(F.element_at(F.col(tags_col), F.lit(tag)).isin(list(values)))


def device_filter(df: DataFrame, mountpoint_col: str = "mountpoint", size_col: str = "size",
                  min_size: int = GIB) -> DataFrame:
    """Block devices worth using: not mounted at ``/`` and at least ``min_size`` bytes.

    Sizes arrive as text; a size that does not parse drops the device
    instead of failing the job.
    """
    size = F.col(size_col).try_cast("bigint")
    not_root = F.col(mountpoint_col).isNull() | (F.col(mountpoint_col) != F.lit("/"))
    return df.filter(not_root & (size >= F.lit(min_size)))


def choose_address(df: DataFrame, private_col: str, private_ip: str, public_ip: str,
                   private_host: str, public_host: str) -> DataFrame:
    """Address to reach a node: private if its subnet is private, else public."""
    private = F.coalesce(F.col(private_col), F.lit(False))
    return df.withColumns({
        "ip": F.when(private, F.col(private_ip)).otherwise(F.col(public_ip)),
        "host": F.when(private, F.col(private_host)).otherwise(F.col(public_host)),
    })


def cluster_addresses(nodes: DataFrame, cluster_col: str, id_col: str, role_col: str, private_col: str,
                      private_ip: str, public_ip: str, private_host: str, public_host: str,
                      master_role: str = "master") -> DataFrame:
    """Address to reach each node, decided once per cluster: by the master's
    subnet, or the first node's (by id) if there is no master. ``nodes`` gains
    ``ip`` and ``host``.

    The deciding row is a partial aggregate per cluster, written once, so
    the join back runs between two plain scans and AQE can split a hot cluster.
    """
    first = F.struct(F.coalesce(F.col(role_col) != F.lit(master_role), F.lit(True)).alias("n"), F.col(id_col).alias("i"))
    private = F.coalesce(F.col(private_col), F.lit(False))
    decided = materialize(nodes.groupBy(F.col(cluster_col).alias("_c"))
                          .agg(F.min_by(private, first).alias("_private")), "cluster-addresses")
    joined = nodes.join(decided, F.col(cluster_col).eqNullSafe(F.col("_c")), "left").drop("_c")
    return choose_address(joined, "_private", private_ip, public_ip, private_host, public_host).drop("_private")


def project_hosts(df: DataFrame, name_col: str = "name", master_col: str = "master_host") -> DataFrame:
    """Name and master host only (column pruning reaches the scan)."""
    return df.select(F.col(name_col).alias("name"), F.col(master_col).alias("master_host"))


def transfer_warning(files: DataFrame, nodes: DataFrame, cluster_col: str,
                     size_col: str, node_col: str, limit: int = 10 ** 6) -> DataFrame:
    """Clusters whose copy volume (total file bytes x node count) exceeds ``limit``.

    Both sides are reduced to one row per cluster before the join, so the
    join input is bounded by the number of clusters, not files or nodes.
    """
    total = files.groupBy(cluster_col).agg(F.sum(size_col).cast("bigint").alias("total_bytes"))
    node_count = (nodes.select(cluster_col, node_col).distinct()
                  .groupBy(cluster_col).agg(F.count(F.lit(1)).alias("node_count")))
    return (total.join(node_count, cluster_col)
            .withColumn("transfer_bytes", F.col("total_bytes") * F.col("node_count"))
            .filter(F.col("transfer_bytes") > F.lit(limit)))


def order_by_name(df: DataFrame, name_col: str = "name", array_cols: Iterable[str] = ()) -> DataFrame:
    """Order rows by name; sort the given array columns (e.g. mount paths) too."""
    out = df.withColumns({c: F.array_sort(F.col(c)) for c in array_cols}) if array_cols else df
    return out.orderBy(F.col(name_col).asc_nulls_last())


def sample_first(df: DataFrame, n: int, keys: Iterable[str]) -> DataFrame:
    """First ``n`` rows by a stable key (plans as TakeOrderedAndProject)."""
    keys = list(keys)
    return df.orderBy(*[F.col(k).asc_nulls_last() for k in keys]).limit(n)
