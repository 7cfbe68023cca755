"""Streaming operators over several micro-batches compared with the batch
answer on the same rows."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from conftest import SMALL_SF
from fleetlens.operators import joins, windows
from fleetlens.plans import derived as d
from fleetlens.plans.rules_bindings import CLUSTER_STATE, COMMAND
from fleetlens.streaming import machines, streams


@pytest.fixture(scope="module")
def split_events(spark):
    """sf0.001 events rewritten as 3 files: by time (ordered) and at random."""
    base = tempfile.mkdtemp(prefix="fleetlens-test-events-")
    ev = spark.read.parquet(os.path.join(SMALL_SF, "events.parquet"))
    ordered, shuffled = os.path.join(base, "ordered"), os.path.join(base, "shuffled")
    for i, part in enumerate(ev.randomSplit([1.0, 1.0, 1.0], seed=1)):
        part.coalesce(1).write.parquet(os.path.join(shuffled, f"f{i}"))
    bounds = ev.selectExpr("percentile_approx(event_id, array(0.33, 0.66)) AS q").first().q
    for i, cond in enumerate([F.col("event_id") <= bounds[0],
                              (F.col("event_id") > bounds[0]) & (F.col("event_id") <= bounds[1]),
                              F.col("event_id") > bounds[1]]):
        ev.filter(cond).coalesce(1).write.parquet(os.path.join(ordered, f"f{i}"))
    return ev, ordered, shuffled


def _stream(spark, folder):
    # one file per micro-batch; files live in sub-folders f0, f1, f2
    return (spark.readStream.schema(streams.EVENT_SCHEMA).option("maxFilesPerTrigger", 1)
            .option("recursiveFileLookup", "true").parquet(folder)
            .withColumn("event_time", streams.ntz_to_instant("ts")))


def _batch_status(ev):
    latest = windows.latest_state(ev, "user_id", "ts", ["event_type"], tiebreak="event_id")
    rows = latest.withColumn("cluster", F.col("user_id") % 10).collect()
    out = {}
    for r in rows:
        m, lag = out.get(r.cluster, (0, 0))
        out[r.cluster] = (m + 1, lag + (r.event_type != "purchase"))
    return out


@pytest.mark.parametrize("engine", ["aggregate", "processor"])
def test_track_state_multi_batch_out_of_order(spark, split_events, engine):
    ev, _, shuffled = split_events
    s = _stream(spark, shuffled).withColumn("cluster", F.col("user_id") % 10)
    if engine == "aggregate":
        changes = streams.run_available_updates(
            streams.track_state(s, "user_id", "cluster", "event_type"), "t1_test_agg")
        assert changes.select("batch_id").distinct().count() >= 3
    else:
        changes = streams.run_available(
            streams.track_state_processor(s, "user_id", "cluster", "event_type"), "t1_test_proc")
    got = {r.cluster: (r.members, r.laggards) for r in streams.cluster_status(changes, "purchase").collect()}
    assert got == _batch_status(ev)


def test_admit_stream_equals_batch(spark, split_events):
    ev, ordered, _ = split_events
    s = _stream(spark, ordered).select("event_id", d.col(COMMAND).alias("command"),
                                       d.col(CLUSTER_STATE).alias("state"))
    got = streams.run_available(streams.admit_stream(s, "command", "state"), "t5_test")
    b = ev.select("event_id", d.col(COMMAND).alias("command"), d.col(CLUSTER_STATE).alias("state"))
    want = joins.admit_commands(b, "command", "state")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect()))


def test_health_windows_closed_windows_equal_batch(spark, split_events):
    ev, ordered, _ = split_events
    s = _stream(spark, ordered).withColumn("ok", F.col("event_type") != "error")
    got = streams.run_available(streams.health_windows(s, "ok", "1 hour", watermark="1 hour"), "t2_test")
    closed = ev.agg(F.max("ts")).first()[0]
    b = (ev.withColumn("window_start", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
         .groupBy("window_start").agg(F.count(F.lit(1)).alias("probes"),
                                      F.count_if(F.col("event_type") != "error").alias("successes")))
    import datetime as dt
    want = {r.window_start: (r.probes, r.successes) for r in b.collect()
            if r.window_start + dt.timedelta(hours=2) <= closed}
    assert {r.window_start: (r.probes, r.successes) for r in got.collect()} == want


def test_track_cluster_emits_progress(spark, split_events):
    ev, _, shuffled = split_events
    s = _stream(spark, shuffled).withColumn("cluster", F.col("user_id") % 10)
    statuses = streams.run_available(
        machines.track_cluster(s, "user_id", "cluster", "event_type", "purchase"), "t1_test_cluster")
    assert statuses.groupBy("cluster").count().filter("count > 1").count() > 0  # several versions
    got = {r.cluster: (r.members, r.laggards) for r in machines.newest_status(statuses).collect()}
    assert got == _batch_status(ev)


def test_attempt_sessions_across_batches_equal_batch(spark, split_events):
    import datetime as dt
    ev, ordered, _ = split_events
    s = _stream(spark, ordered).withColumn("ok", F.col("event_type") != "error")
    got = streams.run_available(streams.attempt_sessions(s, "user_id", "ok", "4 hours", watermark="1 hour"),
                                "t3_test")
    assert got.count() > 0
    gap = dt.timedelta(hours=4)
    closed = ev.agg(F.max("ts")).first()[0] - dt.timedelta(hours=1)
    by_user = {}
    for r in ev.select("user_id", "ts", "event_id", "event_type").collect():
        by_user.setdefault(r.user_id, []).append((r.ts, r.event_id, r.event_type))
    want = set()
    for u, rows in by_user.items():
        rows.sort()
        start = last = None
        n = fails = 0
        for ts, _, et in rows + [(None, None, None)]:
            if start is not None and (ts is None or ts - last >= gap):
                if last + gap <= closed:
                    want.add((u, start, last + gap, n, fails))
                start = None
            if ts is None:
                break
            if start is None:
                start, n, fails = ts, 0, 0
            last = ts
            n += 1
            fails += et == "error"
    assert {(r.user_id, r.session_start, r.session_end, r.attempts, r.failures) for r in got.collect()} == want


def test_event_table_as_a_folder_or_a_file(spark, tmp_path):
    """A table of many part files streams the same rows as one file."""
    ev = spark.read.parquet(os.path.join(SMALL_SF, "events.parquet"))
    folder = str(tmp_path / "events.parquet")
    ev.repartition(5).write.parquet(folder)
    want = sorted(map(tuple, ev.select("event_id", "event_type").collect()))
    for n, path in enumerate((folder, os.path.join(SMALL_SF, "events.parquet"))):
        s = streams.event_stream(spark, path).select("event_id", "event_type")
        assert sorted(map(tuple, streams.run_available(s, f"paths{n}").collect())) == want


def test_dedupe_does_not_depend_on_batches(spark, split_events):
    ev, ordered, shuffled = split_events
    want = sorted(map(tuple, ev.select("user_id", "event_type").distinct().collect()))
    for folder in (ordered, shuffled):
        s = _stream(spark, folder)
        out = streams.stream_dedupe(s, ["user_id", "event_type"]).select("user_id", "event_type")
        assert sorted(map(tuple, streams.run_available(out, "t4_test").collect())) == want


def test_heartbeat_closes_every_window(spark, tmp_path):
    ev = spark.read.parquet(os.path.join(SMALL_SF, "events.parquet"))
    path = streams.write_arrivals(ev, str(tmp_path / "in"), 3, "2 days")
    s = streams.event_stream(spark, path, max_files_per_trigger=1).withColumn("ok", F.col("event_type") != "error")
    got = streams.run_available(streams.health_windows(s, "ok", "1 hour"), "t2_all")
    assert got.agg(F.sum("probes")).first()[0] == ev.count()
    empty = streams.write_arrivals(ev.limit(0), str(tmp_path / "none"), 3, "2 days")
    assert streams.run_available(streams.event_stream(spark, empty), "t_empty").collect() == []


def test_restart_goes_on_from_the_checkpoint(spark, tmp_path):
    ev = spark.read.parquet(os.path.join(SMALL_SF, "events.parquet"))
    first, second = ev.filter("event_id % 2 = 0"), ev.filter("event_id % 2 = 1")
    src, out, ckpt = (str(tmp_path / x) for x in ("in", "out", "ckpt"))

    def run():
        s = streams.event_stream(spark, src)
        return streams.run_available(s.select("event_id"), "restart", out=out, checkpoint=ckpt).count()

    first.write.mode("append").parquet(src)
    assert run() == first.count()
    assert run() == first.count()  # nothing new: nothing is read again
    second.write.mode("append").parquet(src)
    assert run() == ev.count()
