"""Structured Streaming versions of the fleet polling loops.

Sources are ``readStream`` scans with an explicit schema. Event time is
the ``ts`` column (TIMESTAMP_NTZ, UTC wall clock) turned into a TIMESTAMP
instant through epoch microseconds, since watermarks reject
TIMESTAMP_NTZ and a cast would depend on the session time zone.

Windows, sessions and dedupe (T2-T4) keep state only until the watermark
passes, and append to a file sink. State tracking (T1) keeps one state
row per member (or per cluster), bounded by the fleet size rather than
by time, and writes its updates per micro-batch through an idempotent
``foreachBatch`` sink (or appends, for the processors). Every query
checkpoints in a folder of the caller's, or a fresh one in the shared
checkpoint folder: a query that is started again on the caller's folders
resumes exactly once (a fresh folder starts from the beginning).

The operators whose state no built-in aggregate expresses (members that move,
deadlines, attempt outcomes, admission by the live state) are in ``machines``.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from fleetlens.operators.joins import admit_commands, dedupe_rules
from fleetlens.session import scratch_path

EVENT_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("props", T.StringType()),
])


def _epoch():
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def ntz_to_instant(col: str):
    """TIMESTAMP_NTZ read as UTC wall-clock time to a TIMESTAMP instant,
    independent of the session time zone (via epoch microseconds)."""
    return F.timestamp_micros(F.timestamp_diff("MICROSECOND", _epoch(), F.col(col)))


def instant_to_ntz(col: str):
    """TIMESTAMP instant back to UTC wall-clock TIMESTAMP_NTZ."""
    return F.timestamp_add("MICROSECOND", F.unix_micros(F.col(col)), _epoch())


def _as_glob(path: str) -> str:
    """``path`` as a pattern that matches just it: a streaming source takes a
    single file only through a pattern, and a table folder either way."""
    path = path.rstrip("/")
    return f"{path[:-1]}[{path[-1]}]"


def event_stream(spark: SparkSession, path: str, schema: T.StructType = EVENT_SCHEMA,
                 max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming scan of a Parquet event table (a file or a folder of part
    files), with ``event_time`` (TIMESTAMP instant of ``ts`` read as UTC) for
    watermarks and windows."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(_as_glob(path)).withColumn("event_time", ntz_to_instant("ts"))


# The type of the row that ends an input: it carries no host.
HEARTBEAT = "heartbeat"


def write_arrivals(events: DataFrame, path: str, batches: int = 4, heartbeat: str | None = None) -> str:
    """Land an event table in ``path`` as it would arrive: ``batches`` appends
    of equal spans of time, oldest first.

    With ``heartbeat`` (a delay, e.g. ``2 days``) a last file brings one row
    of type ``heartbeat`` that much after the newest event. It moves the
    watermark past every open window and session, so an append-mode stream
    emits all of them. A source that is never quiet needs no such row.
    """
    first, last = events.agg(F.min("ts"), F.max("ts")).first()
    if first is None:
        events.write.mode("append").parquet(path)
        return path
    step = (last - first) / batches
    for i in range(batches):
        part = events.filter(F.col("ts") >= F.lit(first + i * step).cast("timestamp_ntz")) if i else events
        if i + 1 < batches:
            part = part.filter(F.col("ts") < F.lit(first + (i + 1) * step).cast("timestamp_ntz"))
        part.write.mode("append").parquet(path)
    if heartbeat:
        write_heartbeat(events.sparkSession, path, events.schema,
                        F.lit(last).cast("timestamp_ntz") + F.expr(f"INTERVAL {heartbeat}"))
    return path


def write_heartbeat(spark: SparkSession, path: str, schema: T.StructType, at) -> None:
    """Append one row of type ``heartbeat`` with the time ``at``; its other columns are null."""
    spark.range(1).select(*[
        at.alias(f.name) if f.name == "ts"
        else F.lit(HEARTBEAT if f.name == "event_type" else None).cast(f.dataType).alias(f.name)
        for f in schema.fields]).write.mode("append").parquet(path)


def use_rocksdb(spark: SparkSession) -> None:
    """The state store that the stateful processors need."""
    provider = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != provider:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", provider)


def _await(query, name: str, timeout_s: float | None) -> None:
    query.awaitTermination(timeout_s)
    if query.isActive:
        query.stop()
        raise TimeoutError(f"stream {name} did not finish")
    if query.exception() is not None:
        raise query.exception()


def _places(spark: SparkSession, name: str, out: str | None, checkpoint: str | None) -> tuple[str, str]:
    """Sink and checkpoint folders: the caller's, or fresh ones in the shared checkpoint folder."""
    if (out is None) != (checkpoint is None):
        raise ValueError("give both a sink and a checkpoint folder, or neither")
    base = scratch_path(spark, os.path.join("streams", name)) if out is None else ""
    return out or os.path.join(base, "out"), checkpoint or os.path.join(base, "checkpoint")


def run_available(sdf: DataFrame, name: str, output_mode: str = "append", timeout_s: float | None = None,
                  out: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Run a streaming plan over all available input into a Parquet sink;
    return the sink as a batch DataFrame. ``trigger(availableNow=True)``
    processes the backlog in micro-batches and stops. A later run with the
    same ``out`` and ``checkpoint`` folders goes on where the last one ended
    and adds only what new input gives; without them a run starts afresh."""
    spark = sdf.sparkSession
    out, checkpoint = _places(spark, name, out, checkpoint)
    _await(sdf.writeStream.format("parquet").outputMode(output_mode)
           .option("path", out).option("checkpointLocation", checkpoint)
           .trigger(availableNow=True).start(), name, timeout_s)
    return spark.read.schema(sdf.schema).parquet(out)


# The end of event time: later than any event.
END_OF_TIME = "9999-01-01 00:00:00"


def run_to_end(spark: SparkSession, path: str, build: Callable[[DataFrame], DataFrame], name: str,
               schema: T.StructType = EVENT_SCHEMA, max_files_per_trigger: int | None = None,
               timeout_s: float | None = None) -> DataFrame:
    """Stream a table's own files through ``build`` (append mode) and then end its event time.

    The events are read where they are; beside them the stream watches a
    folder of its own for heartbeats. When all files are read, one heartbeat
    row at ``END_OF_TIME`` is put there and the query goes on from its
    checkpoint: the watermark passes every window, session and timer, and all
    of them are emitted. Only for tables that are complete: rows that come
    after the end are late.
    """
    beats = scratch_path(spark, "heartbeats")
    out, checkpoint = _places(spark, name, None, None)
    rows = event_stream(spark, path, schema, max_files_per_trigger)
    plan = build(rows.unionByName(event_stream(spark, beats, schema)))
    run_available(plan, name, "append", timeout_s, out, checkpoint)
    write_heartbeat(spark, beats, schema, F.lit(END_OF_TIME).cast("timestamp_ntz"))
    return run_available(plan, name, "append", timeout_s, out, checkpoint)


def run_available_updates(sdf: DataFrame, name: str, timeout_s: float | None = None,
                          out: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Run an update-mode streaming plan over all available input. Each
    micro-batch's updated rows are written to ``batch_id=<n>`` under the
    sink folder; rewriting a batch after a retry overwrites the same
    folder, so the sink is idempotent. Returns every update with its
    ``batch_id``. ``out`` and ``checkpoint`` as in ``run_available``."""
    spark = sdf.sparkSession
    out, checkpoint = _places(spark, name, out, checkpoint)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(os.path.join(out, f"batch_id={batch_id}"))

    _await(sdf.writeStream.outputMode("update").foreachBatch(write_batch)
           .option("checkpointLocation", checkpoint).trigger(availableNow=True).start(), name, timeout_s)
    schema = T.StructType(sdf.schema.fields + [T.StructField("batch_id", T.LongType())])
    return spark.read.schema(schema).parquet(out)


def _ntz(col: str):
    return instant_to_ntz(col)


# ------------------------------------------------------------------ T2
def health_windows(events: DataFrame, ok_col: str, window: str, slide: str | None = None,
                   watermark: str = "1 hour", keys: Iterable[str] = ()) -> DataFrame:
    """Probe successes and failures per event-time window (tumbling, or
    sliding with ``slide``); a window with no success is ``down``.
    Windows are emitted once the watermark passes their end."""
    w = F.window("event_time", window, slide) if slide else F.window("event_time", window)
    ok = F.coalesce(F.col(ok_col), F.lit(False))
    agg = (events.withWatermark("event_time", watermark)
           .groupBy(w.alias("w"), *keys)
           .agg(F.count(F.lit(1)).alias("probes"), F.count_if(ok).alias("successes")))
    return agg.select(
        _ntz("w.start").alias("window_start"), _ntz("w.end").alias("window_end"), *keys,
        "probes", "successes", (F.col("probes") - F.col("successes")).alias("failures"),
        (F.col("successes") == 0).alias("down"))


# ------------------------------------------------------------------ T3
def attempt_sessions(events: DataFrame, key: str, ok_col: str, gap: str,
                     watermark: str = "1 hour") -> DataFrame:
    """Attempts per host grouped into sessions separated by ``gap`` of inactivity."""
    ok = F.coalesce(F.col(ok_col), F.lit(False))
    agg = (events.withWatermark("event_time", watermark)
           .groupBy(F.session_window("event_time", gap).alias("s"), key)
           .agg(F.count(F.lit(1)).alias("attempts"), F.count_if(~ok).alias("failures")))
    return agg.select(key, _ntz("s.start").alias("session_start"), _ntz("s.end").alias("session_end"),
                      "attempts", "failures")


# ------------------------------------------------------------------ T4
def stream_dedupe(events: DataFrame, keys: Iterable[str], watermark: str | None = None) -> DataFrame:
    """Drop repeated events (same ``keys``): a rule that exists is ignored,
    however long ago it came. State is one row per key. With ``watermark``
    a key is forgotten after that delay, and may come again."""
    if watermark is None:
        return events.dropDuplicates(list(keys))
    return events.withWatermark("event_time", watermark).dropDuplicatesWithinWatermark(list(keys))


def dedupe_into(events: DataFrame, keys: Iterable[str], name: str, watermark: str | None = None,
                order: Iterable[str] = ("ts", "event_id"), carry: Iterable[str] = (), buckets: int = 32,
                timeout_s: float | None = None, out: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Run a stream over all available input into a table that holds each key once; returns the table.

    The table itself is what a repeat is held against: each micro-batch keeps
    the first row of a key (by ``order``), drops the keys that the table has,
    and adds the rest. So a repeat is dropped however long after, and after a
    restart, without a state that grows with the keys. The table lies in
    ``batch_id=<n>/bucket=<b>`` folders: a batch reads only the buckets that
    its own keys fall in, and a repeated batch replaces its own folder and
    ignores what it or later ones wrote. With ``watermark`` repeats within that delay are dropped in
    the stream first (a bounded state), and rows later than that are lost.
    Null keys are equal to each other.
    """
    spark, keys, carry = events.sparkSession, list(keys), list(carry)
    out, checkpoint = _places(spark, name, out, checkpoint)
    rows = stream_dedupe(events, keys, watermark) if watermark else events
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    columns = T.StructType([rows.schema[c] for c in (*keys, *carry)])
    schema = T.StructType([*columns.fields, T.StructField("batch_id", T.LongType()), T.StructField("bucket", T.IntegerType())])

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        first = dedupe_rules(batch, keys, list(order), carry).withColumn("bucket", bucket).persist()
        touched = [r.bucket for r in first.select("bucket").distinct().collect()]  # at most ``buckets``
        have = (spark.read.schema(schema).parquet(out).where(F.col("bucket").isin(touched) & (F.col("batch_id") < batch_id))
                .select("bucket", *[F.col(k).alias(f"_have_{k}") for k in keys]).withColumnRenamed("bucket", "_bucket"))
        same = F.col("bucket") == F.col("_bucket")
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"_have_{k}"))
        new = first.join(have, same, "left_anti").select(*columns.names, "bucket")
        new.write.mode("overwrite").partitionBy("bucket").parquet(os.path.join(out, f"batch_id={batch_id}"))
        first.unpersist()

    # an empty first folder, so that the table can be read before the first batch
    spark.createDataFrame([], T.StructType([f for f in schema.fields if f.name not in ("batch_id", "bucket")])).write.mode(
        "ignore").parquet(os.path.join(out, "batch_id=-1", "bucket=-1"))
    _await(rows.writeStream.outputMode("append").foreachBatch(write_batch)
           .option("checkpointLocation", checkpoint).trigger(availableNow=True).start(), name, timeout_s)
    return spark.read.schema(schema).parquet(out).select(*columns.names)


# ------------------------------------------------------------------ T5
def admit_stream(requests: DataFrame, command_col: str, state_col: str) -> DataFrame:
    """Command admission on a stream: stream-static join with the fixed
    decision table (broadcast), stateless, so it needs no watermark."""
    return admit_commands(requests, command_col, state_col)


# ------------------------------------------------------------------ T1
STATE_CHANGE_SCHEMA = T.StructType([
    T.StructField("member", T.LongType()),
    T.StructField("cluster", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("event_id", T.LongType()),
    T.StructField("state", T.StringType()),
])


COMBINE_ROWS = 100_000


def _newest_per_member(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Map-side combine for the state processors: within one partition of a
    micro-batch keep only each member's newest row, passing them on when
    ``COMBINE_ROWS`` members are held."""
    names = ["member", "cluster", "ts", "event_id", "state"]
    best: dict = {}
    for pdf in batches:
        if pdf.empty:
            continue
        top = pdf.sort_values(["member", "ts", "event_id"]).groupby("member", sort=False).tail(1)
        for row in top.itertuples(index=False):
            cur = best.get(row.member)
            if cur is None or (row.ts, row.event_id) > (cur.ts, cur.event_id):
                best[row.member] = row
        if len(best) >= COMBINE_ROWS:
            yield pd.DataFrame(list(best.values()), columns=names)
            best = {}
    if best:
        yield pd.DataFrame(list(best.values()), columns=names)


def _combined(rows: DataFrame) -> DataFrame:
    """Rows reduced to the newest per member in each partition (stateless,
    so allowed before a stateful operator in a stream)."""
    return rows.mapInPandas(_newest_per_member, STATE_CHANGE_SCHEMA)


class NewestState(StatefulProcessor):
    """Keeps each member's newest (ts, id, state) in a value state and
    emits a row whenever a newer state arrives. Keyed by member, so state
    and per-batch work are spread over all members (no per-cluster hot key)."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        schema = T.StructType([T.StructField("ts", T.TimestampNTZType()),
                               T.StructField("event_id", T.LongType()),
                               T.StructField("state", T.StringType())])
        self.latest = handle.getValueState("latest", schema)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        best = None
        for pdf in rows:
            if pdf.empty:
                continue
            top = pdf.sort_values(["ts", "event_id"]).iloc[-1]
            cand = (pd.Timestamp(top["ts"]), int(top["event_id"]), top["state"], int(top["cluster"]))
            if best is None or cand[:2] > best[:2]:
                best = cand
        if best is None:
            return
        stored = self.latest.get()  # one round trip; None when absent
        if stored is not None and (pd.Timestamp(stored[0]), stored[1]) >= best[:2]:
            return
        self.latest.update((best[0].to_pydatetime(), best[1], best[2]))
        yield pd.DataFrame({"member": [int(key[0])], "cluster": [best[3]], "ts": [best[0]],
                            "event_id": [best[1]], "state": [best[2]]})

    def close(self) -> None:
        pass


def track_state(events: DataFrame, member_col: str, cluster_col: str, state_col: str,
                ts_col: str = "ts", id_col: str = "event_id") -> DataFrame:
    """Stream of newest-state changes per member, with the built-in
    streaming aggregate ``max_by`` (update mode: a member's current newest
    state is emitted in every micro-batch that has rows for it, so late,
    older rows never replace a newer state). State is one row per member in
    the state store; the work stays in the JVM."""
    latest = events.groupBy(F.col(member_col).alias("member")).agg(F.max_by(
        F.struct(F.col(cluster_col).alias("cluster"), F.col(ts_col).alias("ts"),
                 F.col(id_col).alias("event_id"), F.col(state_col).alias("state")),
        F.struct(F.col(ts_col), F.col(id_col))).alias("l"))
    return latest.select("member", "l.cluster", "l.ts", "l.event_id", "l.state")


def track_state_processor(events: DataFrame, member_col: str, cluster_col: str, state_col: str,
                          ts_col: str = "ts", id_col: str = "event_id") -> DataFrame:
    """The same stream of newest-state changes with a custom stateful
    processor (``transformWithStateInPandas``, append mode), for state
    logic that a built-in aggregate cannot express."""
    use_rocksdb(events.sparkSession)
    rows = events.select(F.col(member_col).alias("member"), F.col(cluster_col).alias("cluster"),
                         F.col(ts_col).alias("ts"), F.col(id_col).alias("event_id"),
                         F.col(state_col).alias("state"))
    return _combined(rows).groupBy("member").transformWithStateInPandas(
        statefulProcessor=NewestState(), outputStructType=STATE_CHANGE_SCHEMA,
        outputMode="Append", timeMode="None")


def cluster_status(changes: DataFrame, target: str) -> DataFrame:
    """Fold state changes into per-cluster status: members, laggards and
    whether every member's newest state is ``target`` (partial aggregates)."""
    latest = changes.groupBy("member").agg(
        F.max_by(F.struct("cluster", "state"), F.struct("ts", "event_id")).alias("l"))
    lag = ~F.coalesce(F.col("l.state") == F.lit(target), F.lit(False))
    return (latest.groupBy(F.col("l.cluster").alias("cluster"))
            .agg(F.count(F.lit(1)).alias("members"), F.count_if(lag).alias("laggards"))
            .withColumn("all_reached", F.col("laggards") == 0))
