"""Aggregations over groups of fleet rows.

Every aggregate here is algebraic (min, max, count, sum, bool_or,
min_by/max_by), so Spark computes a partial aggregate before the
shuffle and a group holding a third of all rows costs one row per map
task in the exchange. Member lists are the one non-algebraic output;
``compose_groups`` bounds them by splitting large groups into chunks.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.session import materialize

# The state reported for a group whose members disagree.
INCONSISTENT = "inconsistent"

DEFAULT_CHUNK = 10_000


def _cols(keys: str | Sequence[str]) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def compose_groups(df: DataFrame, key: str | Sequence[str], member: str,
                   chunk_size: int = DEFAULT_CHUNK) -> DataFrame:
    """Members of each group as sorted arrays.

    Output: ``key..., chunk, members, n_members`` where ``n_members`` is
    the size of the whole group. Chunk ``i`` holds the members with sorted
    positions ``i * chunk_size`` up to the next chunk's, at every group
    size, so reading a group's chunks in order gives its sorted list, and no
    array (and no task) holds more than ``chunk_size`` members. Positions
    come from ``assign_ordinals``, which spreads a hot group over tasks.
    """
    from fleetlens.operators.windows import _join_back, assign_ordinals
    keys = _cols(key)
    rows = assign_ordinals(df.select(*keys, member), keys, member)
    chunks = (rows.withColumn("chunk", F.floor(F.col("ordinal") / F.lit(chunk_size)).cast("int"))
              # an explicit shuffle on (key, chunk): the aggregate must not inherit one on the key alone
              .repartition(*keys, "chunk").groupBy(*keys, "chunk")
              .agg(F.array_sort(F.collect_list(member)).alias("members"), F.max("ordinal").alias("_last")))
    chunks = materialize(chunks, "groups")
    sizes = chunks.groupBy(*keys).agg((F.max("_last") + 1).alias("n_members"))
    return _join_back(chunks.drop("_last"), sizes, keys)


def consensus_expr(col: str) -> Column:
    """The single shared value of ``col`` in a group, else 'inconsistent'.

    A missing value is a value of its own: {x, NULL} is inconsistent and
    all-NULL is NULL. Uses min/max/count instead of a distinct count so the
    aggregate stays partial (one exchange).
    """
    c = F.col(col)
    n_all = F.count(F.lit(1))
    n_set = F.count(c)
    return (F.when(n_set == 0, F.lit(None).cast("string"))
            .when((F.min(c) == F.max(c)) & (n_set == n_all), F.min(c).cast("string"))
            .otherwise(F.lit(INCONSISTENT)))


def _state_counts(df: DataFrame, keys: list[str], col: str, extra: list[Column] = ()) -> DataFrame:
    """Phase 1 of consensus: rows per (group, value), NULL value included.
    Grouping by the string value keeps every aggregate buffer fixed-width,
    so this runs as a hash aggregate with a map-side partial."""
    return df.groupBy(*keys, F.col(col).alias("_v")).agg(F.count(F.lit(1)).alias("_n"), *extra)


def _consensus_of_counts(keys: list[str]) -> list[Column]:
    """Phase 2 over at most (groups x distinct values) rows: the value, or
    'inconsistent', with the group's row count."""
    n_all = F.sum("_n")
    n_set = F.sum(F.when(F.col("_v").isNotNull(), F.col("_n")))
    state = (F.when(F.coalesce(n_set, F.lit(0)) == 0, F.lit(None).cast("string"))
             .when((F.count("_v") == 1) & (n_set == n_all), F.min("_v").cast("string"))
             .otherwise(F.lit(INCONSISTENT)))
    return [state, n_all.cast("bigint")]


def group_consensus(df: DataFrame, key: str | Sequence[str], col: str,
                    clusters: DataFrame | None = None, out: str = "state") -> DataFrame:
    """One row per group with the agreed value of ``col`` (or 'inconsistent').

    Two hash aggregates: rows per (group, value), then the decision per
    group over that small table. A group holding a third of all rows is
    pre-aggregated on the map side in phase 1. With ``clusters`` (a list
    of group keys) the result is left-joined onto it, and a group with no
    rows at all is 'inconsistent'.
    """
    keys = _cols(key)
    state, n_all = _consensus_of_counts(keys)
    agg = _state_counts(df, keys, col).groupBy(*keys).agg(state.alias(out), n_all.alias("n_rows"))
    if clusters is None:
        return agg
    from fleetlens.operators.windows import _join_back
    return (_join_back(clusters.select(*keys), agg, keys, "left")
            .withColumn(out, F.when(F.col("n_rows").isNull(), F.lit(INCONSISTENT))
                        .otherwise(F.col(out)))
            .withColumn("n_rows", F.coalesce(F.col("n_rows"), F.lit(0)).cast("bigint")))


def role_count_exprs(role_col: str, master_roles: Iterable[str] = ("master",),
                     slave_roles: Iterable[str] = ("slave",)) -> list[Column]:
    """Aggregate expressions ``masters`` and ``slaves`` (compose with others
    in one ``agg`` so a single pass computes a whole cluster summary)."""
    role = F.col(role_col)
    return [F.count_if(role.isin(list(master_roles))).alias("masters"),
            F.count_if(role.isin(list(slave_roles))).alias("slaves")]


def role_counts(df: DataFrame, key: str | Sequence[str], role_col: str,
                master_roles: Iterable[str] = ("master",),
                slave_roles: Iterable[str] = ("slave",)) -> DataFrame:
    """Masters, slaves and nodes per group."""
    return (df.groupBy(*_cols(key)).agg(*role_count_exprs(role_col, master_roles, slave_roles))
            .withColumn("nodes", F.col("masters") + F.col("slaves")))


def describe_groups(df: DataFrame, key: str | Sequence[str], state_col: str, role_col: str,
                    master_roles: Iterable[str] = ("master",),
                    slave_roles: Iterable[str] = ("slave",)) -> DataFrame:
    """Cluster summary: consensus state and role counts, from one scan.

    Phase 1 counts rows and roles per (cluster, state) in a hash aggregate;
    phase 2 folds those few rows per cluster into the state and the counts.
    """
    keys = _cols(key)
    role = F.col(role_col)
    per_state = _state_counts(df, keys, state_col, [
        F.count_if(role.isin(list(master_roles))).alias("_m"),
        F.count_if(role.isin(list(slave_roles))).alias("_s")])
    state, _ = _consensus_of_counts(keys)
    return (per_state.groupBy(*keys)
            .agg(state.alias("state"), F.sum("_m").cast("bigint").alias("masters"),
                 F.sum("_s").cast("bigint").alias("slaves"))
            .withColumn("nodes", F.col("masters") + F.col("slaves")))


def split_roles(df: DataFrame, key: str | Sequence[str], role_col: str, host_col: str,
                master_role: str = "master", slave_roles: Iterable[str] = ("slave",),
                with_slaves: bool = False, chunk_size: int = DEFAULT_CHUNK) -> DataFrame:
    """Master and slave split per group, with violations as values.

    No master is legal. More than one master, or a role that is neither
    master nor slave, is reported in ``violation`` instead of failing the
    job. ``master`` is the master host when there is exactly one.
    With ``with_slaves`` the slave hosts are added as a sorted array,
    in bounded chunks (``compose_groups``): one row per (group, chunk),
    chunk 0 with an empty array for a group without slaves.
    """
    keys = _cols(key)
    role = F.col(role_col)
    slave_roles = list(slave_roles)
    is_master = role == F.lit(master_role)
    known = is_master | role.isin(slave_roles)
    agg = df.groupBy(*keys).agg(
        F.count_if(is_master).alias("n_masters"),
        F.count_if(role.isin(slave_roles)).alias("n_slaves"),
        F.count_if(~F.coalesce(known, F.lit(False))).alias("n_unknown"),
        F.min(F.when(is_master, F.col(host_col))).alias("first_master"),
    )
    violation = (F.when(F.col("n_masters") > 1, F.lit("multiple masters"))
                 .when(F.col("n_unknown") > 0, F.lit("unknown role")))
    out = (agg.withColumn("violation", violation)
           .withColumn("master", F.when(F.col("n_masters") == 1, F.col("first_master")))
           .drop("first_master"))
    if not with_slaves:
        return out
    from fleetlens.operators.windows import _join_back
    host_type = df.schema[host_col].dataType.simpleString()
    slaves = compose_groups(df.filter(role.isin(slave_roles)), keys, host_col, chunk_size) \
        .select(*keys, "chunk", F.col("members").alias("slaves"))
    return (_join_back(out, slaves, keys, "left")
            .withColumn("chunk", F.coalesce(F.col("chunk"), F.lit(0)))
            .withColumn("slaves", F.coalesce(F.col("slaves"), F.array().cast(f"array<{host_type}>"))))


def all_reached(df: DataFrame, key: str | Sequence[str], state_col: str, target: str,
                id_col: str, sample: int = 3) -> DataFrame:
    """Whether every member of a group is in ``target``, with laggard count
    and the ``sample`` smallest laggard ids.

    The sample uses ``row_number() <= sample``, which Spark plans as a
    partial WindowGroupLimit before the exchange, so a huge group ships at
    most ``sample`` rows per map task.
    """
    keys = _cols(key)
    lagging = ~F.coalesce(F.col(state_col) == F.lit(target), F.lit(False))
    summary = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("members"),
        F.count_if(lagging).alias("laggards"),
    ).withColumn("all_reached", F.col("laggards") == 0)
    from pyspark.sql.window import Window
    w = Window.partitionBy(*keys).orderBy(F.col(id_col))
    firsts = (df.filter(lagging).select(*keys, id_col)
              .withColumn("_rn", F.row_number().over(w))
              .filter(F.col("_rn") <= sample)
              .groupBy(*keys).agg(F.array_sort(F.collect_list(id_col)).alias("sample_laggards")))
    id_type = df.schema[id_col].dataType.simpleString()
    from fleetlens.operators.windows import _join_back
    return (_join_back(summary, firsts, keys, "left")
            .withColumn("sample_laggards",
                        F.coalesce(F.col("sample_laggards"), F.array().cast(f"array<{id_type}>"))))


def fold_outcomes(df: DataFrame, key: str | Sequence[str], host_col: str, ok_col: str,
                  finished_col: str) -> DataFrame:
    """An operation over many hosts fails if any host fails.

    Reports the first failing host (earliest finish, then host) and the
    number of failures; ``min_by`` keeps this a partial aggregate.
    """
    failed = ~F.coalesce(F.col(ok_col), F.lit(False))
    order = F.when(failed, F.struct(F.col(finished_col), F.col(host_col)))
    return df.groupBy(*_cols(key)).agg(
        F.count(F.lit(1)).alias("hosts"),
        F.count_if(failed).alias("failures"),
        F.bool_or(failed).alias("failed"),
        F.min_by(F.when(failed, F.col(host_col)), order).alias("first_failed_host"),
    )


def distinct_names(df: DataFrame, col: str, out: str = "name") -> DataFrame:
    """The set of names (one exchange, partial distinct per map task)."""
    return df.select(F.col(col).alias(out)).filter(F.col(out).isNotNull()).distinct()


def unnamed_rows(df: DataFrame, col: str, id_cols: Sequence[str]) -> DataFrame:
    """Rows without a name, as violations (``id..., problem``): a member must
    carry a name, so ``distinct_names`` alone would hide it."""
    return df.filter(F.col(col).isNull()).select(*id_cols, F.lit("missing name").alias("problem"))


def capacity(df: DataFrame, keys: Sequence[str], cores_col: str, executors_col: str) -> DataFrame:
    """Worker cores, executors and cores per executor (integer quotient),
    summed per cluster with a ``rollup`` over ``keys`` (e.g. region, cluster).

    ``level`` is Spark's grouping id: 0 = per cluster, then per region,
    then the grand total.
    """
    quotient = F.try_divide(F.col(cores_col).cast("bigint"), F.col(executors_col).cast("bigint"))
    per_node = df.withColumn("executor_cores", F.floor(quotient).cast("bigint"))
    return (per_node.rollup(*keys).agg(
        F.count(F.lit(1)).alias("nodes"),
        F.sum(F.col(cores_col).cast("bigint")).alias("worker_cores"),
        F.sum(F.col(executors_col).cast("bigint")).alias("executors"),
        F.sum("executor_cores").alias("executor_cores"),
        F.grouping_id().alias("level")))


def whole_seconds(start_col: str, end_col: str) -> Column:
    """Whole-second duration: both ends truncated to the second first."""
    return F.timestamp_diff("SECOND", F.date_trunc("second", F.col(start_col)),
                            F.date_trunc("second", F.col(end_col)))


def duration_summary(ops: DataFrame, key: str | Sequence[str], start_col: str, end_col: str,
                     ok_col: str) -> DataFrame:
    """Count, min, max and sum of whole-second durations of successful operations."""
    d = whole_seconds(start_col, end_col)
    return (ops.filter(F.col(ok_col))
            .withColumn("seconds", d)
            .groupBy(*_cols(key)).agg(
                F.count(F.lit(1)).alias("ops"),
                F.min("seconds").alias("min_seconds"),
                F.max("seconds").alias("max_seconds"),
                F.sum("seconds").alias("total_seconds")))
