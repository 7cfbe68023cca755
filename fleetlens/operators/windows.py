"""Per-group ordered logic.

``pick_victims`` is a top-n per group, which Spark plans as a partial
``WindowGroupLimit`` before the exchange. ``latest_state`` needs no
window at all (``max_by``). The sequence operators (ordinals, retry
chains, next target time) never hand a whole group to one task: they
split each group into ordered blocks (time blocks, or range partitions
for ordinals), compute the per-row part inside each block with a
running-frame window, and add a per-block offset from a small per-key
table. A group holding a third of all rows is therefore spread over as
many tasks as it has blocks.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.session import materialize


def _cols(keys: str | Sequence[str]) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def pick_victims(df: DataFrame, key: str | Sequence[str], n: int, spot_col: str,
                 id_col: str) -> DataFrame:
    """``n`` rows per cluster to remove: spot members first, then by id.

    ``n`` larger than a cluster simply takes the whole cluster (the clamp).
    """
    if n < 0:
        raise ValueError("n must be >= 0")
    spot = F.coalesce(F.col(spot_col), F.lit(False))
    w = Window.partitionBy(*_cols(key)).orderBy(spot.desc(), F.col(id_col).asc())
    return (df.withColumn("victim_rank", F.row_number().over(w))
            .filter(F.col("victim_rank") <= n))


def assign_ordinals(df: DataFrame, key: str | Sequence[str], name_col: str,
                    prefix: str | None = None, tiebreak: Iterable[str] = (),
                    range_partitions: int | None = None) -> DataFrame:
    """0-based number per member in name order (e.g. ``/media/ephemeral0``).

    The ordinal (BIGINT) of a row is the number of rows of its group that
    sort before it. Rows are range-partitioned on (key, name, tiebreak), so a
    very large group is spread over several contiguous partitions; each
    partition numbers its rows locally and adds the count of the group's
    rows in earlier partitions (a small per-(key, partition) table). The
    partitioning samples its bounds, so it runs once: the rows are written
    with their partition number to the shared checkpoint folder, and both
    the numbering and the counts read that. Rows equal in key, name and
    tie-break are ordered by a hash of the whole row, which also lets the
    range bounds split a long run of them.
    """
    keys = _cols(key)
    order = [F.col(name_col), *[F.col(c) for c in tiebreak]]
    n = range_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hashable = [f.name for f in df.schema.fields if _hashable(f.dataType)]
    order.append(F.col("_row"))
    ranged = materialize(
        df.withColumn("_row", F.xxhash64(*hashable))
        .repartitionByRange(n, *[F.col(k) for k in keys], *order)
        .withColumn("_part", F.spark_partition_id()), "ordinals")
    local = ranged.withColumn(
        "_local", F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order)) - 1)
    sizes = ranged.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    out = (_join_back(local, offsets, [*keys, "_part"])
           .withColumn("ordinal", (F.col("_offset") + F.col("_local")).cast("bigint"))
           .drop("_part", "_row", "_local", "_offset"))
    if prefix is not None:
        out = out.withColumn("mount_path", F.concat(F.lit(prefix), F.col("ordinal").cast("string")))
    return out


def _hashable(t: T.DataType) -> bool:
    """Whether ``xxhash64`` takes the type (maps and variants it does not)."""
    if isinstance(t, T.ArrayType):
        return _hashable(t.elementType)
    if isinstance(t, T.StructType):
        return all(_hashable(f.dataType) for f in t.fields)
    return not isinstance(t, (T.MapType, T.VariantType))


def _block(ts_col: str, block: str):
    """Time block of a row: ``date_trunc(block, ts)`` (e.g. 'hour', 'day').
    A NULL time sorts first, as in the window order, so it gets the
    smallest block."""
    return F.coalesce(F.date_trunc(block, F.col(ts_col)),
                      F.lit("0001-01-01 00:00:00").cast("timestamp"))


def _join_back(rows: DataFrame, small: DataFrame, cols: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on ``cols`` that treats NULL keys as equal (a NULL group key is
    a group like any other, as in ``groupBy``)."""
    r = small
    for c in cols:
        r = r.withColumnRenamed(c, f"_r_{c}")
    cond = None
    for c in cols:
        term = F.col(c).eqNullSafe(F.col(f"_r_{c}"))
        cond = term if cond is None else cond & term
    return rows.join(r, cond, how).drop(*[f"_r_{c}" for c in cols])


def retry_chains(df: DataFrame, key: str | Sequence[str], ts_col: str, id_col: str,
                 success_col: str, limit: int, block: str = "hour") -> DataFrame:
    """Group attempts into chains that end at a success.

    The chain id of an attempt is the number of successes before it in its
    group. Per chain: attempts, first and last time, and the outcome:
    ``succeeded`` (success within ``limit`` attempts), ``late`` (success
    after more), ``exhausted`` (no success, ``limit`` or more attempts) or
    ``open`` (still retrying).

    The prefix count is computed in time blocks so that no group is
    processed by one task: (1) successes per (key, block), a partial
    aggregate; (2) successes before each block, a running sum over that
    small per-key table; (3) successes before each row inside its block, a
    window partitioned by (key, block). Chain id = (2) + (3).
    Only (3) shuffles the rows; (1) is a partial aggregate whose exchange
    carries one row per (key, block) per map task. For keys that are dense
    in time pass a finer ``block`` (``minute``, ``second``): the answer is
    the same, and the blocks hold fewer rows.
    """
    keys = _cols(key)
    ok = F.coalesce(F.col(success_col), F.lit(False)).cast("bigint")
    base = df.withColumn("_ok", ok).withColumn("_blk", _block(ts_col, block))
    per_block = base.groupBy(*keys, "_blk").agg(F.sum("_ok").alias("_succ"))
    before_block = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_block.withColumn("_offset", F.coalesce(F.sum("_succ").over(before_block), F.lit(0))) \
        .drop("_succ")
    in_block = (Window.partitionBy(*keys, "_blk").orderBy(F.col(ts_col), F.col(id_col))
                .rowsBetween(Window.unboundedPreceding, -1))
    local = base.withColumn("_local", F.coalesce(F.sum("_ok").over(in_block), F.lit(0)))
    chained = (_join_back(local, offsets, [*keys, "_blk"])
               .withColumn("chain", (F.col("_offset") + F.col("_local")).cast("bigint")))
    per_chain = chained.groupBy(*keys, "chain").agg(
        F.count(F.lit(1)).alias("attempts"),
        F.bool_or(F.col("_ok") == 1).alias("succeeded"),
        F.min(ts_col).alias("first_ts"),
        F.max(ts_col).alias("last_ts"))
    outcome = (F.when(F.col("succeeded") & (F.col("attempts") <= limit), F.lit("succeeded"))
               .when(F.col("succeeded"), F.lit("late"))
               .when(F.col("attempts") >= limit, F.lit("exhausted"))
               .otherwise(F.lit("open")))
    return per_chain.withColumn("outcome", outcome).drop("succeeded")


def time_to_state(df: DataFrame, key: str | Sequence[str], ts_col: str, id_col: str,
                  state_col: str, start_states: Iterable[str], target: str,
                  block: str = "hour") -> DataFrame:
    """For each request row (state in ``start_states``), the next time the
    group reaches ``target`` after it, and the wait in seconds.

    Computed in time blocks, like ``retry_chains``: the first target time
    of every (key, block) is a partial aggregate; the first target in any
    later block is a running minimum over that small per-key table (in
    reverse block order); inside a block, the next target after a row is a
    running minimum over the block's rows in reverse order. The answer is
    the in-block value, else the later-block value. Every frame is a
    running one, so each block is one linear pass. ``block`` is chosen as
    in ``retry_chains``.
    """
    keys = _cols(key)
    hit = F.when(F.col(state_col) == F.lit(target), F.col(ts_col))
    base = df.withColumn("_hit", hit).withColumn("_blk", _block(ts_col, block))
    firsts = base.groupBy(*keys, "_blk").agg(F.min("_hit").alias("_first"))
    later = Window.partitionBy(*keys).orderBy(F.col("_blk").desc()).rowsBetween(Window.unboundedPreceding, -1)
    after_block = firsts.withColumn("_later", F.min("_first").over(later)).drop("_first")
    in_block = (Window.partitionBy(*keys, "_blk").orderBy(F.col(ts_col).desc(), F.col(id_col).desc())
                .rowsBetween(Window.unboundedPreceding, -1))
    local = base.withColumn("_next", F.min("_hit").over(in_block))
    requests = local.filter(F.col(state_col).isin(list(start_states)))
    out = (_join_back(requests, after_block, [*keys, "_blk"])
           .withColumn("next_target_ts", F.coalesce(F.col("_next"), F.col("_later")))
           .drop("_hit", "_blk", "_next", "_later"))
    return out.withColumn("wait_seconds",
                          F.timestamp_diff("SECOND", F.col(ts_col), F.col("next_target_ts")))


def latest_state(df: DataFrame, key: str | Sequence[str], ts_col: str,
                 value_cols: Sequence[str], tiebreak: str | None = None) -> DataFrame:
    """Newest row per member (``max_by``; a partial aggregate, no window)."""
    order = F.struct(F.col(ts_col), F.col(tiebreak)) if tiebreak else F.col(ts_col)
    latest = F.max_by(F.struct(F.col(ts_col).alias(ts_col), *[F.col(c) for c in value_cols]), order)
    keys = _cols(key)
    return (df.groupBy(*keys).agg(latest.alias("_l"))
            .select(*keys, *[F.col(f"_l.{c}").alias(c) for c in [ts_col, *value_cols]]))
