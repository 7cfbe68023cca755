"""Joins and set operations over fleet tables.

Join strategy is left to Catalyst and AQE: small sides are broadcast by
``spark.sql.autoBroadcastJoinThreshold`` (a size check on plan
statistics), large ones sort-merge, and AQE splits skewed partitions.
Explicit ``broadcast`` is used only for fixed literal tables, whose size
is known when the plan is built. The one range join (``match_rules``)
is rewritten into an equi-join.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _cols(keys: str | Sequence[str]) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


# --- skew -----------------------------------------------------------------

DEFAULT_SALTS = 32
# A key with more rows than this on the large side of a join counts as hot.
HOT_ROWS = 100_000


def _mark(df: DataFrame, marker: DataFrame, keys: Sequence[str], null_safe: bool) -> DataFrame:
    """Left join a ``_hot`` flag from ``marker`` (distinct keys) onto ``df``."""
    if not null_safe:
        return df.join(marker, list(keys), "left")
    m = marker
    for k in keys:
        m = m.withColumnRenamed(k, f"_m_{k}")
    cond = None
    for k in keys:
        term = F.col(k).eqNullSafe(F.col(f"_m_{k}"))
        cond = term if cond is None else cond & term
    return df.join(m, cond, "left").drop(*[f"_m_{k}" for k in keys])


def salted_join(big: DataFrame, per_key: DataFrame, keys: Sequence[str], how: str = "inner",
                salts: int = DEFAULT_SALTS, salt_by: Sequence[str] | None = None,
                null_safe: bool = False, hot: DataFrame | None = None) -> DataFrame:
    """Join a large table to a table with at most one row per key.

    Rows of ``big`` get a salt from a hash of ``salt_by`` (default: all its
    columns) and the matching ``per_key`` row is repeated once per salt, so
    the join runs on (key, salt): a key holding a third of ``big`` is
    spread over ``salts`` tasks instead of one. AQE's own skew split cannot
    do this when ``per_key`` is an aggregate.

    With ``hot`` (a DataFrame of the keys to spread, e.g. keys with more
    than ``HOT_ROWS`` rows) only those keys are salted and only their
    ``per_key`` rows are repeated; every other key joins on salt 0 with one
    copy, so a huge ``per_key`` table is not multiplied. Without ``hot``
    every key is salted. Valid for inner, left, semi and anti joins. With
    ``null_safe`` a NULL key matches a NULL key (as ``groupBy`` groups
    them); otherwise SQL equality applies.
    """
    keys = list(keys)
    cols = [F.col(c) for c in (salt_by or big.columns)]
    spread = F.pmod(F.xxhash64(*cols), F.lit(salts)).cast("int")
    every = F.sequence(F.lit(0), F.lit(salts - 1))
    if hot is None:
        b = big.withColumn("_salt", spread)
        s = per_key.withColumn("_salt", F.explode(every))
    else:
        marker = hot.select(*keys).distinct().withColumn("_hot", F.lit(True))
        b = (_mark(big, marker, keys, null_safe)
             .withColumn("_salt", F.when(F.col("_hot"), spread).otherwise(F.lit(0))).drop("_hot"))
        s = (_mark(per_key, marker, keys, null_safe)
             .withColumn("_salt", F.explode(F.when(F.col("_hot"), every).otherwise(F.array(F.lit(0)))))
             .drop("_hot"))
    if not null_safe:
        return b.join(s, [*keys, "_salt"], how).drop("_salt")
    for k in keys:
        s = s.withColumnRenamed(k, f"_r_{k}")
    s = s.withColumnRenamed("_salt", "_r_salt")
    cond = F.col("_salt") == F.col("_r_salt")
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return b.join(s, cond, how).drop("_salt", "_r_salt", *[f"_r_{k}" for k in keys])


# --- membership -----------------------------------------------------------

def missing_names(requested: DataFrame, found: DataFrame, name_col: str,
                  found_col: str | None = None) -> DataFrame:
    """Requested names that were not found (left anti join), one row per name."""
    found_col = found_col or name_col
    f = found.select(F.col(found_col).alias("_found")).filter(F.col("_found").isNotNull()).distinct()
    return (requested.select(F.col(name_col).alias("name")).filter(F.col("name").isNotNull())
            .join(f, F.col("name") == F.col("_found"), "left_anti").distinct())


# Message prefix for missing names; "s" is added to the noun
# when more than one name is missing, then ": " and the names.
MISSING_PREFIX = "Could not find the following "


def missing_message(missing: DataFrame, what: str = "security group", name_col: str = "name",
                    chunk_size: int = 1000) -> DataFrame:
    """The missing names as message text, joined with ", ".

    One row per ``chunk_size`` names in sorted order (``chunk`` 0, 1, ...),
    so a huge miss list never becomes one string built in one task.
    """
    from fleetlens.operators.aggs import compose_groups
    grouped = compose_groups(missing.select(F.lit(0).alias("_all"), F.col(name_col)), "_all",
                             name_col, chunk_size=chunk_size)
    plural = F.when(F.col("n_members") == 1, F.lit("")).otherwise(F.lit("s"))
    text = F.concat(F.lit(MISSING_PREFIX + what), plural, F.lit(": "),
                    F.array_join("members", ", "))
    return grouped.select("chunk", F.col("n_members").alias("missing"), text.alias("message"))


def in_use(mounts: DataFrame, devices: DataFrame, device_col: str,
           devices_col: str | None = None) -> DataFrame:
    """Mounts whose device is in the device list (left semi join)."""
    devices_col = devices_col or device_col
    return mounts.join(devices.select(F.col(devices_col).alias("_dev")),
                       F.col(device_col) == F.col("_dev"), "left_semi")


def insert_if_absent(new: DataFrame, existing: DataFrame, key: str | Sequence[str],
                     salts: int = DEFAULT_SALTS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Split requested inserts: names already present are ``rejected``, the
    rest ``accepted``. One left join against the distinct existing keys
    (marked with a flag) decides both; the distinct keys are at most one
    row per key, so no request is duplicated. A name requested more than
    ``hot_rows`` times (found by a partial count) is salted over tasks;
    other names join unsalted, so the existing-key table is not copied. A null
    key is a name like any other: it is present if the existing names hold one."""
    keys = _cols(key)
    ex = existing.select(*keys).distinct().withColumn("_exists", F.lit(True))
    hot = new.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > hot_rows)
    return (salted_join(new, ex, keys, "left", salts, null_safe=True, hot=hot)
            .withColumn("status", F.when(F.col("_exists"), F.lit("rejected")).otherwise(F.lit("accepted")))
            .drop("_exists"))


# --- access rules ---------------------------------------------------------

# Access rules opened for a client source, per service, as
# (service, protocol, from_port, to_port). SSH is always opened. The HDFS
# name node UI port is 50070 before HDFS 3.0 and 9870 from 3.0 on.
SSH_RULE = ("ssh", "tcp", 22, 22)
HDFS_UI_PORT_V2 = 50070
HDFS_UI_PORT_V3 = 9870
SPARK_RULES = (
    ("spark", "tcp", 8080, 8081),
    ("spark", "tcp", 4040, 4050),
    ("spark", "tcp", 7077, 7077),
    ("spark", "tcp", 6066, 6066),  # REST server
)


def service_rules(services: Iterable[str], hdfs_major: int = 3) -> list[tuple]:
    rules = [SSH_RULE]
    for s in services:
        if s == "hdfs":
            port = HDFS_UI_PORT_V3 if hdfs_major >= 3 else HDFS_UI_PORT_V2
            rules.append(("hdfs", "tcp", port, port))
        elif s == "spark":
            rules.extend(SPARK_RULES)
        else:
            raise ValueError(f"unknown service {s!r}")
    return rules


def expand_rules(sources: DataFrame, services: Iterable[str] = ("hdfs", "spark"),
                 hdfs_major: int = 3, kind_col: str = "kind", value_col: str = "source_value") -> DataFrame:
    """Each valid access source times (SSH rule + every service rule).

    ``sources`` is the output of ``columns.ingest_sources`` (``kind`` is
    ``group`` / ``cidr`` / ``invalid``; ``source_value`` the group id or the
    normalized CIDR). The rule templates are a fixed literal array, so this
    is a generator (explode), not a join: no exchange at all.
    """
    templates = F.array(*[
        F.struct(F.lit(s).alias("service"), F.lit(p).alias("protocol"),
                 F.lit(lo).alias("from_port"), F.lit(hi).alias("to_port"))
        for s, p, lo, hi in service_rules(services, hdfs_major)])
    # Invalid sources explode a NULL array (no rows). This is not a Filter,
    # which Catalyst would push below the parsing projections, inlining them.
    valid = F.col(kind_col).isin("group", "cidr")
    out = sources.withColumn("_rule", F.explode(F.when(valid, templates)))
    return out.select(
        *[c for c in sources.columns if c not in (kind_col,)],
        F.col("_rule.service").alias("service"), F.col("_rule.protocol").alias("protocol"),
        F.col("_rule.from_port").alias("from_port"), F.col("_rule.to_port").alias("to_port"),
        F.when(F.col(kind_col) == "cidr", F.col(value_col)).alias("cidr_ip"),
        F.when(F.col(kind_col) == "group", F.col(value_col)).alias("src_group"))


def _network_of(ip_col: str, len_col: str):
    """First address of the ``len``-bit network that contains ``ip`` (as a
    64-bit value, so that a shift by 32 for /0 yields 0)."""
    ip = f"CAST({ip_col} AS BIGINT)"
    return F.expr(f"shiftleft(shiftright({ip}, 32 - {len_col}), 32 - {len_col})")


def _valid_length(col: str):
    return F.coalesce(F.col(col).between(0, 32), F.lit(False))


def invalid_rules(rules: DataFrame, len_col: str) -> DataFrame:
    """Rules whose prefix length is missing or outside 0..32, for quarantine.
    They admit nothing."""
    return rules.filter(~_valid_length(len_col))


# Ports are 32-bit whole numbers; shifted by this they start at 0 and have 33 binary digits.
_PORT_SHIFT = 1 << 31
# A level of port pieces takes this many binary digits: fewer levels for a flow to look up, more pieces a rule.
_PIECE_BITS = 5


def port_pieces(lo_col: str, hi_col: str):
    """The port range as disjoint pieces: an array of (level, piece), piece ``p`` of level ``k`` being the ports
    ``p * 2**k`` to ``(p + 1) * 2**k - 1`` (shifted to start at 0). Levels are 0, 5, .. 30; a range of up to 31 ports
    is met at level 0 alone, and no range has more than 62 pieces a level. Empty for an empty range."""
    lo, hi = (f"CAST(least(greatest(CAST({c} AS BIGINT), {-_PORT_SHIFT}), {_PORT_SHIFT - 1}) AS BIGINT) + {_PORT_SHIFT}L"
              for c in (lo_col, hi_col))
    levels = range(0, 33, _PIECE_BITS)

    def whole(k: int) -> tuple[str, str]:  # pieces of level k wholly inside the range: from, up to but without
        return f"shiftright({lo} + {(1 << k) - 1}L, {k})", f"shiftright({hi} + 1, {k})"

    def span(k: int, start: str, end: str) -> str:
        return (f"IF({start} < {end}, transform(sequence({start}, {end} - 1), p -> named_struct('level', {k}, 'piece', p)), "
                "CAST(array() AS ARRAY<STRUCT<level: INT, piece: BIGINT>>))")

    parts = []
    for k in levels:
        start, end = whole(k)
        if k + _PIECE_BITS not in levels:
            parts.append(span(k, start, end))
            continue
        up_start, up_end = (f"shiftleft({x}, {_PIECE_BITS})" for x in whole(k + _PIECE_BITS))
        # what the next level takes is left out of this one
        parts += [span(k, start, f"IF({up_start} < {up_end}, {up_start}, {end})"),
                  span(k, f"IF({up_start} < {up_end}, {up_end}, {end})", end)]
    return F.expr(f"IF({lo_col} IS NULL OR {hi_col} IS NULL, NULL, concat({', '.join(parts)}))")


# Rules of one network and port piece are met in lists of about this many.
LIST_RULES = 1024


def _rule_lists(r: DataFrame, keys: Sequence[str], fields: Sequence[str], list_rules: int) -> DataFrame:
    """``keys``, their number ``_rules`` and, of each of ``fields``, the values of the key's rules in one order: one
    list, or as many as keep each at about ``list_rules``. The lists of a key are told apart by a hash of the rule, so
    equal rules share one. A column per field, so that fields the caller drops are neither gathered nor shipped."""
    many = (r.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > list_rules)
            .select(*[F.col(k).alias(f"_m{k}") for k in keys], F.ceil(F.col("_n") / list_rules).alias("_lists")))
    same = [F.col(k) == F.col(f"_m{k}") for k in keys]
    part = F.coalesce(F.pmod(F.col("_hash"), F.col("_lists")), F.lit(0))
    # collect_list leaves out nulls, but not structs of them
    gathered = [F.transform(F.collect_list(F.struct(F.col(f).alias("v"))), lambda x: x["v"]).alias(f) for f in fields]
    return (r.withColumn("_hash", F.hash(*fields)).join(many, same, "left").withColumn("_list", part)
            .groupBy(*keys, "_list").agg(F.count(F.lit(1)).cast("int").alias("_rules"), *gathered).drop("_list"))


def match_rules(flows: DataFrame, rules: DataFrame, ip_col: str, port_col: str,
                net_col: str, len_col: str, lo_col: str, hi_col: str,
                lengths: Sequence[int] = tuple(range(33)), list_rules: int = LIST_RULES) -> DataFrame:
    """Flows admitted by a rule: source IP inside the rule's CIDR and port
    inside its range.

    Both tests are range conditions, which Spark can only plan as a
    nested-loop join or as a filter after an address has met all its rules.
    Here both are equi-joins. Each distinct address is expanded once per
    prefix length (``lengths``, by default the whole domain 0..32) and met
    with the distinct networks of the rules. A rule's port range is cut into
    disjoint pieces (``port_pieces``); a flow then looks up, per network of its
    address, its port's piece at each level that the network's rules use
    (one level if no rule names more than 31 ports, seven at most), which is
    what the join ships where the rules are too many to broadcast. A flow meets the rules that admit
    it, each once, and no others, so a network with very many port rules
    multiplies nothing. The rules of a piece are met as lists of about
    ``list_rules`` and unfolded after the join, so the join itself handles a
    row per flow and list; the result has a row per flow and admitting rule,
    which is as many as flows times rules where both share addresses. A rule network with host bits set is reduced to its
    network start; rules outside 0..32 (``invalid_rules``) and rules with an
    empty or null range admit nothing. Ports are whole 32-bit numbers.
    """
    bad = [x for x in lengths if not 0 <= int(x) <= 32]
    if bad:
        raise ValueError(f"prefix lengths {bad} are outside 0..32")
    fields = [f"_f{i}" for i in range(len(rules.columns))]
    r = (rules.filter(_valid_length(len_col)).withColumn(net_col, _network_of(net_col, len_col))
         .withColumn("_p", F.explode(port_pieces(lo_col, hi_col)))
         .select(F.col(len_col).alias("_rlen"), F.col(net_col).alias("_rnet"), F.col("_p.level").alias("_rlevel"),
                 F.col("_p.piece").alias("_rpiece"), *[F.col(c).alias(f) for c, f in zip(rules.columns, fields)])
         .filter(F.col("_rnet").isNotNull()))
    # the result may be far larger than the flows' files: its work is dealt out by rows, not by files
    n = int(flows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the lists too: AQE splits a join's skewed key only where both sides come straight from a shuffle
    lists = _rule_lists(r, ["_rlen", "_rnet", "_rlevel", "_rpiece"], fields, list_rules).repartition(n)
    nets = r.groupBy("_rlen", "_rnet").agg(F.collect_set("_rlevel").alias("_levels"))  # at most 7 levels
    keyed = (flows.select(F.col(ip_col).alias("_ip")).filter(F.col("_ip").isNotNull()).distinct()
             .withColumn("_len", F.explode(F.array(*[F.lit(int(x)) for x in lengths])))
             .withColumn("_net", _network_of("_ip", "_len")))
    by_address = (keyed.join(nets, (F.col("_len") == F.col("_rlen")) & (F.col("_net") == F.col("_rnet")))
                  .select("_ip", "_len", "_net", "_levels"))
    asked = (flows.repartition(n).join(by_address, F.col(ip_col) == F.col("_ip")).drop("_ip")
             .withColumn("_level", F.explode("_levels")).drop("_levels")
             .withColumn("_piece", F.expr(f"shiftright(CAST(`{port_col}` AS BIGINT) + {_PORT_SHIFT}L, _level)")))
    met = asked.join(lists, (F.col("_len") == F.col("_rlen")) & (F.col("_net") == F.col("_rnet"))
                     & (F.col("_level") == F.col("_rlevel")) & (F.col("_piece") == F.col("_rpiece")))
    return met.withColumn("_rule_at", F.explode(F.sequence(F.lit(0), F.col("_rules") - 1))).select(
        *flows.columns, *[F.col(f)[F.col("_rule_at")].alias(c) for c, f in zip(rules.columns, fields)])


# --- settings -------------------------------------------------------------

def resolve_settings(layers: DataFrame, scope_cols: str | Sequence[str], key_col: str,
                     value_col: str, rank_col: str, tiebreak: Sequence[str] = ()) -> DataFrame:
    """Effective setting per (scope, key): the value from the highest-ranked
    layer that sets it. A null value means "not set in this layer".

    ``max_by`` over (rank, tie-break columns) is a partial aggregate, so a
    scope with a huge number of assignments still ships one row per map task.
    """
    keys = _cols(scope_cols) + [key_col]
    order = F.struct(F.col(rank_col), *[F.col(c) for c in tiebreak])
    return (layers.filter(F.col(value_col).isNotNull())
            .groupBy(*keys).agg(F.max_by(F.col(value_col), order).alias("value"),
                                F.max(F.col(rank_col)).alias("layer")))


def stack_layers(layers: Mapping[int, DataFrame]) -> DataFrame:
    """Union setting layers (``scope..., key, value``) with their rank."""
    out = None
    for rank, df in sorted(layers.items()):
        df = df.withColumn("rank", F.lit(rank))
        out = df if out is None else out.unionByName(df)
    return out


# --- commands -------------------------------------------------------------

# What a command does to a cluster in a given state. A state
# of "*" stands for any state of an existing cluster; any pair not listed
# (including a missing cluster, whose state is NULL) is invalid.
#   (command, state, decision, exit_code)
ANY_STATE = "*"
COMMAND_DECISIONS = (
    ("start", "running", "nothing-to-do", 0),
    ("start", "stopped", "ok", 0),
    ("stop", "stopped", "nothing-to-do", 0),
    ("stop", "running", "ok", 0),
    ("add-slaves", "running", "ok", 0),
    ("run-command", "running", "ok", 0),
    ("copy-file", "running", "ok", 0),
    ("remove-slaves", ANY_STATE, "ok", 0),
    ("describe", ANY_STATE, "ok", 0),
    ("destroy", ANY_STATE, "ok", 0),
)
INVALID_EXIT = 1

DECISION_SCHEMA = "command string, state string, decision string, exit_code int"


def decision_table(spark: SparkSession, rows: Iterable[tuple] = COMMAND_DECISIONS) -> DataFrame:
    return spark.createDataFrame(list(rows), DECISION_SCHEMA)


def admit_commands(cmds: DataFrame, command_col: str, state_col: str,
                   decisions: DataFrame | None = None) -> DataFrame:
    """Decide each (command, cluster state) request: ok / nothing-to-do /
    invalid, with the exit code; a pair missing from the decision table is
    invalid. A table lists for a command either states or "*". The built-in decision table is a fixed literal of a dozen rows
    and is broadcast; a caller's own table is joined like any other side
    (broadcast by the planner only if its size estimate is small)."""
    spark = cmds.sparkSession
    dec = decisions if decisions is not None else F.broadcast(decision_table(spark))
    dec = dec.withColumnRenamed("command", "_cmd").withColumnRenamed("state", "_state")
    fits = (F.col(state_col) == F.col("_state")) | (F.col(state_col).isNotNull() & (F.col("_state") == F.lit(ANY_STATE)))
    j = cmds.join(dec, (F.col(command_col) == F.col("_cmd")) & fits, "left")
    return (j.withColumn("decision", F.coalesce(F.col("decision"), F.lit("invalid")))
            .withColumn("exit_code", F.coalesce(F.col("exit_code"), F.lit(INVALID_EXIT)))
            .drop("_cmd", "_state"))


# --- snapshots ------------------------------------------------------------

def snapshot_diff(before: DataFrame, after: DataFrame, keys: str | Sequence[str],
                  compare: Sequence[str]) -> DataFrame:
    """added / removed / changed / kept between two snapshots.

    Full outer join on the keys; ``compare`` columns are compared null-safe
    (``<=>``), so NULL to NULL is unchanged. ``keys`` must identify one row
    per snapshot (as instance ids do); reduce a snapshot with repeated keys
    first (``dedupe_rules`` or an aggregate), or its rows would pair up;
    ``bag_diff`` compares snapshots whose rows repeat.
    """
    keys = _cols(keys)
    b = before.select(*keys, *[F.col(c).alias(f"before_{c}") for c in compare]).withColumn("_b", F.lit(True))
    a = after.select(*keys, *[F.col(c).alias(f"after_{c}") for c in compare]).withColumn("_a", F.lit(True))
    for k in keys:
        a = a.withColumnRenamed(k, f"_after_{k}")
    match = F.lit(True)
    for k in keys:  # a NULL key is a key like any other
        match = match & F.col(k).eqNullSafe(F.col(f"_after_{k}"))
    j = b.join(a, match, "full_outer")
    j = j.withColumns({k: F.coalesce(k, f"_after_{k}") for k in keys}).drop(*[f"_after_{k}" for k in keys])
    same = F.lit(True)
    for c in compare:
        same = same & F.col(f"before_{c}").eqNullSafe(F.col(f"after_{c}"))
    change = (F.when(F.col("_b").isNull(), F.lit("added"))
              .when(F.col("_a").isNull(), F.lit("removed"))
              .when(same, F.lit("kept"))
              .otherwise(F.lit("changed")))
    return j.withColumn("change", change).drop("_a", "_b")


def bag_diff(before: DataFrame, after: DataFrame, columns: Sequence[str]) -> DataFrame:
    """added / removed / kept copies of each row between two snapshots with repeated rows.

    One row per different row and change: ``columns``, ``change``, ``copies``.
    A row with m copies before and n after has min(m, n) kept copies and the
    rest added or removed, so the added copies are those of ``after EXCEPT ALL before``
    and the removed ones those of ``before EXCEPT ALL after``. NULLs are equal
    to each other. One aggregate over both snapshots decides everything: copies are counted
    before the shuffle, so a row that makes up a third of a snapshot
    ships one count per task.
    """
    columns = list(columns)
    counts = (before.select(*columns, F.lit(1).alias("_b"), F.lit(0).alias("_a"))
              .unionByName(after.select(*columns, F.lit(0).alias("_b"), F.lit(1).alias("_a")))
              .groupBy(*columns).agg(F.sum("_b").alias("_b"), F.sum("_a").alias("_a")))
    parts = F.array(*[F.struct(F.lit(name).alias("change"), n.cast("bigint").alias("copies")) for name, n in (
        ("kept", F.least("_b", "_a")), ("removed", F.col("_b") - F.col("_a")), ("added", F.col("_a") - F.col("_b")))])
    return counts.select(*columns, F.explode(parts).alias("_p")).select(*columns, "_p.change", "_p.copies").filter("copies > 0")


# --- set operations -------------------------------------------------------

def new_members(now: DataFrame, before: DataFrame) -> DataFrame:
    """Rows of ``now`` not in ``before`` (EXCEPT DISTINCT)."""
    return now.subtract(before)


def new_copies(now: DataFrame, before: DataFrame) -> DataFrame:
    """Copies of rows of ``now`` beyond those in ``before`` (EXCEPT ALL)."""
    return now.exceptAll(before)


def combine_rules(a: DataFrame, b: DataFrame) -> DataFrame:
    """Keep-all union by column name (no exchange)."""
    return a.unionByName(b, allowMissingColumns=True)


def dedupe_rules(df: DataFrame, keys: str | Sequence[str],
                 keep_first_by: Sequence[str] | None = None,
                 carry: Sequence[str] = ()) -> DataFrame:
    """One row per key: a rule that already exists is ignored.

    With ``keep_first_by`` the kept row is the first by those columns
    (``min_by``, a partial aggregate) and ``carry`` columns come from it;
    ``copies`` counts the duplicates folded in.
    """
    keys = _cols(keys)
    if not keep_first_by:
        if carry:
            raise ValueError("carry needs keep_first_by: carried values must come from one row")
        return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies"))
    order = F.struct(*[F.col(c) for c in keep_first_by])
    first = F.min_by(F.struct(*[F.col(c) for c in carry]), order) if carry else None
    aggs = [F.count(F.lit(1)).alias("copies")]
    if first is not None:
        aggs.append(first.alias("_first"))
    out = df.groupBy(*keys).agg(*aggs)
    if carry:
        out = out.select(*keys, "copies", *[F.col(f"_first.{c}").alias(c) for c in carry])
    return out
