"""Stateful stream operators whose answer does not depend on how the input is cut into batches.

- ``track_cluster``: status per cluster while members come, change state and
  move. A processor per member keeps its newest row and emits corrections
  (the old cluster loses it, the new one gets it); a processor per cluster
  adds them up.
- ``health_deadlines``: every listed host is ``up`` or ``down`` at its
  deadline, also one that never answered: the host list is the operator's
  initial state and an event-time timer per host ends the wait.
- ``attempt_outcomes``: a state machine over a host's attempts.
- ``admit_live``: commands admitted by the state that their cluster had at
  that moment, an as-of join of two streams.

The last two need a key's rows in time order. ``InTimeOrder`` holds rows back
until the watermark has passed them and then hands them on by time, so rows
may come in any order within the watermark's delay; rows later than that are
dropped. State per key: the rows of one delay and a folded value.

Times inside the processors are epoch microseconds, keys are strings with a
mark for null (a null key is a key like any other), and rows arrive as
``Row`` objects, so integers stay integers next to nulls.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from fleetlens.functions.columns import classify_failures
from fleetlens.operators.joins import admit_commands
from fleetlens.streaming.streams import HEARTBEAT, instant_to_ntz, use_rocksdb

MICROS = 1_000_000


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


def _key(col: str):
    """A non-null text for a key of any type."""
    return F.when(F.col(col).isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), F.col(col).cast("string")))


def _micros(col: str):
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(col))


def drop_heartbeats(events: DataFrame, type_col: str = "event_type", time_col: str = "event_time") -> DataFrame:
    """Rows that carry an event, after a watermark was set. The test reads the event time, so it is not pushed below
    the watermark, which has to see the heartbeats; rows without a time have no place in event time and go too."""
    return events.filter(F.when(F.col(time_col).isNull(), F.lit(False)).otherwise(~F.col(type_col).eqNullSafe(F.lit(HEARTBEAT))))


# ------------------------------------------------------------------ T1
def _rank(row) -> tuple:
    """Order of a member's rows: time, id, then cluster and state; nulls lowest."""
    return tuple((v is not None, v if v is not None else 0) for v in row)


class MemberMoves(StatefulProcessor):
    """Keeps a member's newest (ts, id, cluster, state); emits what changes in the clusters it leaves and enters."""

    def __init__(self, target: str, cluster_type: T.DataType):
        self.target, self.cluster_type = target, cluster_type

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getValueState("newest", _struct(
            ts=T.LongType(), id=T.LongType(), cluster=self.cluster_type, state=T.StringType()))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        best = max(((r.ts, r.id, r.cluster, r.state) for r in rows), key=_rank)
        held = self.newest.get()
        if held is not None:
            held = tuple(held)
            if _rank(held) >= _rank(best):
                return
        self.newest.update(best)
        lag = int(best[3] != self.target)
        if held is not None and held[2] == best[2]:
            if lag != int(held[3] != self.target):
                yield Row(cluster=best[2], members=0, laggards=lag - int(held[3] != self.target))
            return
        if held is not None:
            yield Row(cluster=held[2], members=-1, laggards=-int(held[3] != self.target))
        yield Row(cluster=best[2], members=1, laggards=lag)

    def close(self) -> None:
        pass


class ClusterTotals(StatefulProcessor):
    """Running members and laggards of a cluster from corrections; emits each changed status with a rising version."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.totals = handle.getValueState("totals", _struct(version=T.LongType(), members=T.LongType(), laggards=T.LongType()))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        version, members, laggards = self.totals.get() or (0, 0, 0)
        was = members, laggards
        cluster = None
        for r in rows:
            cluster, members, laggards = r.cluster, members + r.members, laggards + r.laggards
        if (members, laggards) == was:
            return
        self.totals.update((version + 1, members, laggards))
        yield Row(cluster=cluster, version=version + 1, members=members, laggards=laggards,
                  all_reached=members > 0 and laggards == 0)

    def close(self) -> None:
        pass


def _newest_of_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each member's newest row of a record batch (stateless, so a hot member ships one row a batch)."""
    for b in batches:
        if b.num_rows:
            t = pa.Table.from_batches([b])
            order = pc.sort_indices(t, sort_keys=[(c, "ascending") for c in ("member_key", "ts", "id", "cluster", "state")],
                                    null_placement="at_start")
            t = t.take(order).combine_chunks()
            keys = t["member_key"].combine_chunks()
            last = pc.not_equal(keys[:-1], keys[1:]).to_pylist() + [True]
            yield from t.filter(pa.array(last)).combine_chunks().to_batches()


def _sum_of_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Corrections summed per cluster within a record batch, so a hot cluster ships a row a batch."""
    for b in batches:
        if b.num_rows:
            t = pa.Table.from_batches([b]).group_by(["cluster_key", "cluster"]).aggregate([("members", "sum"), ("laggards", "sum")])
            t = t.select(["cluster_key", "cluster", "members_sum", "laggards_sum"]).rename_columns(b.schema.names)
            yield from t.combine_chunks().to_batches()


def track_cluster(events: DataFrame, member_col: str, cluster_col: str, state_col: str, target: str,
                  ts_col: str = "ts", id_col: str = "event_id") -> DataFrame:
    """Stream of cluster statuses: cluster, version, members, laggards, all_reached; ``newest_status`` reads the last.

    A member is where its newest row (by time, id, cluster, state; nulls
    lowest) puts it. When it moves, the cluster it leaves is corrected, so the
    last statuses do not depend on how the events are cut into batches. A null
    member is one member, a null cluster one cluster, and a null state is not
    the target. State is one row per member and one per cluster; both inputs
    are reduced before their shuffle, so a hot cluster or member ships at most
    a row per record batch.
    """
    use_rocksdb(events.sparkSession)
    kind = events.schema[cluster_col].dataType
    rows = events.select(_key(member_col).alias("member_key"), _micros(ts_col).alias("ts"), F.col(id_col).cast("long").alias("id"),
                         F.col(cluster_col).alias("cluster"), F.col(state_col).cast("string").alias("state"))
    moves = rows.mapInArrow(_newest_of_batch, rows.schema).groupBy("member_key").transformWithState(
        statefulProcessor=MemberMoves(target, kind), outputStructType=_struct(cluster=kind, members=T.LongType(), laggards=T.LongType()),
        outputMode="Append", timeMode="None")
    keyed = moves.select(_key("cluster").alias("cluster_key"), "cluster", "members", "laggards")
    return keyed.mapInArrow(_sum_of_batch, keyed.schema).groupBy("cluster_key").transformWithState(
        statefulProcessor=ClusterTotals(), outputStructType=_struct(
            cluster=kind, version=T.LongType(), members=T.LongType(), laggards=T.LongType(), all_reached=T.BooleanType()),
        outputMode="Append", timeMode="None")


def newest_status(statuses: DataFrame) -> DataFrame:
    """The last status of each cluster that has members, from a ``track_cluster`` output."""
    last = statuses.groupBy("cluster").agg(F.max_by(F.struct("members", "laggards", "all_reached"), F.col("version")).alias("s"))
    return last.select("cluster", "s.members", "s.laggards", "s.all_reached").filter("members > 0")


# ------------------------------------------------------------------ T2
WAIT_SPAN = 3600 * MICROS  # hosts whose deadlines fall in the same hour
WAIT_SLOTS = 64            # and the same of so many slots (by a hash of the host) wait together


class Deadline(StatefulProcessor):
    """The listed hosts of one span of time and slot: probes counted up to each host's deadline, and one timer, for the
    earliest deadline to come, that reports the hosts whose deadline has passed.

    The list is written once and again when some of it is reported; probes are kept apart, a map entry a host that has any.
    """

    OUT = _struct(host_key=T.StringType(), deadline=T.LongType(), probes=T.LongType(), successes=T.LongType(), first_ok=T.LongType())

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getValueState("waiting", _struct(hosts=T.ArrayType(T.StringType()), deadlines=T.ArrayType(T.LongType())))
        self.seen = handle.getMapState("seen", _struct(host=T.StringType()), _struct(
            probes=T.LongType(), successes=T.LongType(), first_ok=T.LongType()))

    def _wait(self, hosts: list[str], deadlines: list[int]) -> None:
        self.waiting.update((hosts, deadlines))
        self.handle.registerTimer(min(deadlines) // 1000 + 1)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self._wait(list(initialState.hosts), [int(d) for d in initialState.deadlines])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        new: dict[str, tuple] = {}
        for r in rows:
            new[r.host_key] = _add_probes(new.get(r.host_key), (r.probes, r.successes, r.first_ok))
        if new and self.waiting.exists():  # else all are reported already
            for host, counts in new.items():
                self.seen.updateValue((host,), _add_probes(self.seen.getValue((host,)), counts))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = self.waiting.get()
        if held is None:
            return
        fired, passed = expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()
        seen = {k[0]: tuple(v) for k, v in self.seen.iterator()}
        rest: tuple[list[str], list[int]] = ([], [])
        for host, deadline in zip(*held):
            at = deadline // 1000 + 1
            if at > fired and at >= passed:
                rest[0].append(host)
                rest[1].append(deadline)
                continue
            probes, successes, first = seen.get(host, (0, 0, None))
            if host in seen:
                self.seen.removeKey((host,))
            yield Row(host_key=host, deadline=deadline, probes=probes, successes=successes, first_ok=first)
        if rest[0]:
            self._wait(*rest)
        else:
            self.waiting.clear()
            self.seen.clear()

    def close(self) -> None:
        pass


def _add_probes(held: tuple | None, new: tuple) -> tuple:
    """Probes and successes added up, and the earlier first success."""
    if held is None:
        return new
    firsts = [x for x in (held[2], new[2]) if x is not None]
    return held[0] + new[0], held[1] + new[1], min(firsts, default=None)


def _probes_of_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Probes, successes and the first success of each host within a record batch."""
    for b in batches:
        if b.num_rows:
            t = pa.Table.from_batches([b]).group_by(["span", "slot", "host_key"]).aggregate(
                [("probes", "sum"), ("successes", "sum"), ("first_ok", "min")])
            t = t.select(["span", "slot", "host_key", "probes_sum", "successes_sum", "first_ok_min"]).rename_columns(b.schema.names)
            yield from t.combine_chunks().to_batches()


def health_deadlines(events: DataFrame, hosts: DataFrame, host_col: str, ok_col: str, limit: str = "90 seconds",
                     since_col: str = "since", watermark: str = "1 hour") -> DataFrame:
    """One row per listed host when the watermark passes its deadline (``since`` + ``limit``): host, since, deadline,
    status, probes, successes, first_ok.

    ``hosts`` (static) lists each host with the time from which it is waited
    for (the latest one, if it is listed more often; null hosts and times are
    left out). It is ``up`` if a probe from ``since`` to the deadline, both
    included, succeeded, else ``down``: also when no probe came at all. Probes
    of other hosts or times are ignored; a null ``ok`` is a failure. State is
    what each host still waited for needs; hosts whose deadlines fall in one
    hour are dealt over ``WAIT_SLOTS`` lists, each with one timer, so that most
    of the work is a list's and not a host's. Probes are added up per record
    batch before the shuffle. A restarted query goes on waiting.
    """
    use_rocksdb(events.sparkSession)
    listed = (hosts.where(F.col(host_col).isNotNull() & F.col(since_col).isNotNull())
              .groupBy(F.col(host_col).alias("_host")).agg(F.max(since_col).alias("_since"))
              .withColumn("_deadline", F.col("_since") + F.expr(f"INTERVAL {limit}"))
              .withColumn("_span", F.floor(_micros("_deadline") / WAIT_SPAN))
              .withColumn("_slot", F.pmod(F.xxhash64(_key("_host")), F.lit(WAIT_SLOTS))))
    starts = (listed.groupBy(F.col("_span").alias("span"), F.col("_slot").alias("slot"))
              .agg(F.collect_list(F.struct(_key("_host").alias("host"), _micros("_deadline").alias("deadline"))).alias("l"))
              .select("span", "slot", F.col("l.host").alias("hosts"), F.col("l.deadline").alias("deadlines")))
    ok = F.coalesce(F.col(ok_col), F.lit(False))
    probes = drop_heartbeats(events.withWatermark("event_time", watermark))
    # null-safe: an inferred "host is not null" would be pushed below the watermark and take the heartbeats away
    met = probes.join(listed, F.col(host_col).eqNullSafe(F.col("_host")) & F.col("ts").between(F.col("_since"), F.col("_deadline")))
    counted = met.select(F.col("_span").alias("span"), F.col("_slot").alias("slot"), _key("_host").alias("host_key"), F.lit(1).cast("long").alias("probes"), ok.cast("long").alias("successes"),
                         F.when(ok, _micros("ts")).alias("first_ok"))
    done = counted.mapInArrow(_probes_of_batch, counted.schema).groupBy("span", "slot").transformWithState(
        statefulProcessor=Deadline(), outputStructType=Deadline.OUT,
        outputMode="Append", timeMode="EventTime", initialState=starts.groupBy("span", "slot"))
    host = F.substring("host_key", 2, 1 << 30).cast(hosts.schema[host_col].dataType)
    return done.select(host.alias(host_col), _instant("deadline", f"- INTERVAL {limit}").alias("since"), _instant("deadline").alias("deadline"),
                       F.when(F.col("successes") > 0, "up").otherwise("down").alias("status"), "probes", "successes",
                       _instant("first_ok").alias("first_ok"))


def _instant(col: str, plus: str = ""):
    """Epoch microseconds as TIMESTAMP_NTZ."""
    return F.expr(f"timestampadd(MICROSECOND, {col}, TIMESTAMP_NTZ'1970-01-01 00:00:00') {plus}")


# -------------------------------------------------- rows of a key in time order
class InTimeOrder(StatefulProcessor):
    """Hands a key's rows to ``step`` in order of (ts, rank) once the watermark has passed them.

    Subclasses give the fields of a row (``ts`` first, then those that order
    rows of one time), the folded value's and the output's schema (``key`` first), ``step(folded, row)``
    (outputs; it returns the new folded value) and, if time alone can end
    something, ``due(folded)`` and ``expire(folded)``.
    """

    ROW: T.StructType
    FOLDED: T.StructType
    OUT: T.StructType

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # an entry holds the rows of one call, a list a column: a state call and its conversion are a key's, not a row's
        self.waiting = handle.getListState("waiting", T.StructType([T.StructField(f.name, T.ArrayType(f.dataType)) for f in self.ROW]))
        self.folded = handle.getValueState("folded", self.FOLDED)
        self.timer = handle.getValueState("timer", _struct(due=T.LongType()))
        self.made = Row(*self.OUT.names)

    def step(self, folded: tuple | None, row: tuple, out: list[tuple]) -> tuple | None:
        raise NotImplementedError

    def due(self, folded: tuple | None) -> int | None:
        """The time at which the folded value ends by itself."""
        return None

    def expire(self, folded: tuple, out: list[tuple]) -> tuple | None:
        return folded

    def _wake(self, at: int | None) -> None:
        """A timer for the earliest thing to come (later ones are set when it fires)."""
        held = self.timer.get()
        if at is not None and (held is None or at < held[0]):
            self.timer.update((at,))
            self.handle.registerTimer(at // 1000 + 1)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        # the columns of the input are the key and then those of ROW
        new = [t for t in (tuple(r)[1:] for r in rows) if t[0] > passed]
        if new:
            self.waiting.appendValue(tuple(map(list, zip(*new))))
            self._wake(min(t[0] for t in new))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        held = sorted((t for lists in self.waiting.get() for t in zip(*lists)), key=_rank)
        ready = [t for t in held if t[0] < passed]
        folded = self.folded.get()
        folded = None if folded is None else tuple(folded)
        out: list[tuple] = []
        for t in ready:
            end = self.due(folded)
            if end is not None and end < t[0]:
                folded = self.expire(folded, out)
            folded = self.step(folded, t, out)
        end = self.due(folded)
        if end is not None and end < passed:
            folded = self.expire(folded, out)
            end = None
        if folded is None:
            self.folded.clear()
        else:
            self.folded.update(folded)
        if ready:
            rest = held[len(ready):]
            if rest:
                self.waiting.put([tuple(map(list, zip(*rest)))])
            else:
                self.waiting.clear()
        else:
            rest = held
        self.timer.clear()
        nexts = [x for x in (end, rest[0][0] if rest else None) if x is not None]
        self._wake(min(nexts, default=None))
        for r in out:
            yield self.made(key[0], *r)

    def close(self) -> None:
        pass


# ------------------------------------------------------------------ T3
class Attempts(InTimeOrder):
    """A chain of attempts and how it ended. A row is (ts, id, action): ``ok``, ``retry`` or ``fatal``."""

    ROW = _struct(ts=T.LongType(), id=T.LongType(), action=T.StringType())
    FOLDED = _struct(start=T.LongType(), last=T.LongType(), attempts=T.LongType())
    OUT = _struct(key=T.StringType(), start=T.LongType(), last=T.LongType(), attempts=T.LongType(), outcome=T.StringType())

    def __init__(self, limit: int, expiry: int):
        self.limit, self.expiry = limit, expiry

    def step(self, folded, row, out):
        start, _, attempts = folded or (row[0], row[0], 0)
        attempts += 1
        outcome = {"ok": "succeeded", "fatal": "fatal"}.get(row[2], "exhausted" if attempts >= self.limit else None)
        if outcome is None:
            return start, row[0], attempts
        out.append((start, row[0], attempts, outcome))
        return None

    def due(self, folded):
        return None if folded is None else folded[1] + self.expiry

    def expire(self, folded, out):
        out.append((folded[0], folded[1], folded[2], "open"))
        return None


def attempt_outcomes(events: DataFrame, key: str, ok_col: str, kind_col: str, limit: int, expiry_seconds: int,
                     watermark: str = "1 hour", id_col: str = "event_id") -> DataFrame:
    """Chains of attempts per host and their outcome: key, chain_start, chain_end, attempts, outcome.

    A chain ends with its first success (``succeeded``), with a failure of a
    fatal kind (``fatal``; kinds as in ``classify_failures``), with its
    ``limit``-th failure (``exhausted``), or when nothing follows for more
    than ``expiry_seconds`` (``open``: given up). The next attempt begins a new chain.
    A null ``ok`` is a failure. Attempts are taken in order of (ts, id),
    whatever batches they come in; a chain is emitted when the watermark
    passes its end. A null key is a key of its own; attempts of one key are a
    sequence, so they are one task's work.
    """
    if limit < 1 or expiry_seconds <= 0:
        raise ValueError("limit and expiry must be positive")
    use_rocksdb(events.sparkSession)
    ok = F.coalesce(F.col(ok_col), F.lit(False))
    rows = classify_failures(drop_heartbeats(events.withWatermark("event_time", watermark)), kind_col)
    action = F.when(ok, "ok").when(F.col("action") == "retry", "retry").otherwise("fatal")
    rows = rows.select(_key(key).alias("key"), _micros("ts").alias("ts"),
                       F.col(id_col).cast("long").alias("id"), action.alias("action"))
    done = rows.groupBy("key").transformWithState(
        statefulProcessor=Attempts(limit, expiry_seconds * MICROS), outputStructType=Attempts.OUT, outputMode="Append", timeMode="EventTime")
    return done.select(_unkey(events, key), _instant("start").alias("chain_start"), _instant("last").alias("chain_end"),
                       "attempts", "outcome")


def _unkey(events: DataFrame, key: str):
    return F.when(F.col("key") != "n", F.substring("key", 2, 1 << 30)).cast(events.schema[key].dataType).alias(key)


# ------------------------------------------------------------------ T5
class LiveState(InTimeOrder):
    """A cluster's state as of each request. A row is (ts, kind, id, state, command); kind 0 is a state change, 1 a
    request, so a change counts for requests of the same moment."""

    ROW = _struct(ts=T.LongType(), kind=T.IntegerType(), id=T.LongType(), state=T.StringType(), command=T.StringType())
    FOLDED = _struct(state=T.StringType())
    OUT = _struct(key=T.StringType(), id=T.LongType(), ts=T.LongType(), command=T.StringType(), state=T.StringType())

    def step(self, folded, row, out):
        if row[1] == 0:
            return (row[3],)
        out.append((row[2], row[0], row[4], folded[0] if folded else None))
        return folded


def admit_live(requests: DataFrame, changes: DataFrame, cluster_col: str, command_col: str, state_col: str,
               watermark: str = "1 hour", id_col: str = "event_id") -> DataFrame:
    """Command admission by the state that the cluster had when the command came: id, cluster, ts, command, state,
    decision, exit_code.

    Both sides are streams with ``event_time``. A request meets the newest
    change of its cluster at or before its own time (ties to the largest id);
    without one its state is null (no such cluster) and it is invalid. A
    request is answered when the watermark of both sides has passed it, so
    late changes and late requests within ``watermark`` are in their place;
    later ones are dropped. State per cluster: one delay's rows and the last state.
    """
    use_rocksdb(requests.sparkSession)

    def side(df: DataFrame, kind: int) -> DataFrame:
        state, command = (F.col(state_col), F.lit(None)) if kind == 0 else (F.lit(None), F.col(command_col))
        df = drop_heartbeats(df.withWatermark("event_time", watermark))
        return df.select(_key(cluster_col).alias("key"), _micros("ts").alias("ts"), F.lit(kind).alias("kind"),
                         F.col(id_col).cast("long").alias("id"), state.cast("string").alias("state"), command.cast("string").alias("command"))

    answered = side(changes, 0).unionByName(side(requests, 1)).groupBy("key").transformWithState(
        statefulProcessor=LiveState(), outputStructType=LiveState.OUT, outputMode="Append", timeMode="EventTime")
    out = answered.select(F.col("id").alias(id_col), _unkey(requests, cluster_col), _instant("ts").alias("ts"), "command", "state")
    return admit_commands(out, "command", "state")
