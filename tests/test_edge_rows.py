"""Edge rows of the operators: NULL keys, bad values, whole integers, several
sections of settings."""

import pytest

from fleetlens.functions import columns as X
from fleetlens.operators import aggs, filters, joins, rowmap
from fleetlens.sources import manifests, text


def test_null_group_keys_keep_their_rows(spark):
    df = spark.createDataFrame([(None, 1, "x", "slave"), ("a", 2, "up", "slave")], "k string, id long, s string, r string")
    reached = {r.k: r.sample_laggards for r in aggs.all_reached(df, "k", "s", "up", "id").collect()}
    assert reached == {None: [1], "a": []}
    roles = {r.k: r.slaves for r in aggs.split_roles(df, "k", "r", "id", with_slaves=True).collect()}
    assert roles == {None: [1], "a": [2]}
    states = {r.k: (r.state, r.n_rows) for r in aggs.group_consensus(df, "k", "s", clusters=df.select("k")).collect()}
    assert states == {None: ("x", 1), "a": ("up", 1)}
    diff = {r.k: r.change for r in joins.snapshot_diff(df.select("k", "s"), df.select("k", "s"), "k", ["s"]).collect()}
    assert diff == {None: "kept", "a": "kept"}


def test_bad_times_are_invalid_lines(spark):
    lines = ["2024-13-45 99:99:99,999 - fleet.core - INFO  - [h] x", "2024-01-02 03:04:05,678 - fleet.core - INFO  - [h] x - y",
             None, "", "2024-01-02 03:04:05,678 - fleet.core - INFO  - no host"]
    got = text.read_operation_log(spark.createDataFrame([(x,) for x in lines], "line string"), "line").collect()
    assert [(r.status, r.logger, r.host, r.message) for r in got] == [
        ("invalid", None, None, None), ("ok", "fleet.core", "h", "x - y"), ("invalid", None, None, None),
        ("invalid", None, None, None), ("ok", "fleet.core", None, "no host")]
    assert str(got[1].ts) == "2024-01-02 03:04:05.678000"


def test_device_lines_as_columns(spark):
    lines = [(1, 'KNAME="SDA" MAJ:MIN="8:0" SIZE="10" MOUNTPOINT=""'), (2, 'SIZE="1" SIZE="2"'), (3, "junk"), (4, None)]
    got = text.read_device_lines(spark.createDataFrame(lines, "id long, line string"), "line",
                                 ["kname", "mountpoint", "size", "min"], ["id"]).collect()
    assert [tuple(r) for r in sorted(got)] == [(1, "sda", "", "10", None), (2, None, None, "2", None),
                                              (3, None, None, None, None), (4, None, None, None, None)]


def test_manifests_keep_conflicts_and_missing_java(spark):
    rows = [("c1", "spark", "3.4", None), ("c2", "spark", "3.4", 11), ("c2", "spark", "3.5", 17), ("c2", "spark", "3.5", 17)]
    df = spark.createDataFrame(rows, "c string, s string, version string, java int")
    got = {r.cluster: (r.manifest, r.conflict) for r in manifests.write_manifests(df, "c", "s", ["version"], "java").collect()}
    assert got == {"c1": ('{"java_version":null,"services":[["spark",{"version":"3.4"}]]}', False),
                   "c2": ('{"java_version":17,"services":[["spark",{"version":"3.4"}],["spark",{"version":"3.5"}]]}', True)}


def test_rows_keep_whole_integers_and_none(spark):
    seen = spark.createDataFrame([(9007199254740993, "a"), (None, "b"), (5, None)], "id long, t string")
    out = rowmap.map_rows(seen, lambda r: {"twice": None if r["id"] is None else r["id"] + 1, "kind": repr(r["id"])},
                          "twice long, kind string", keep=["id"]).collect()
    assert sorted((r.kind, r.id, r.twice) for r in out) == [
        ("5", 5, 6), ("9007199254740993", 9007199254740993, 9007199254740994), ("None", None, None)]


def test_deep_settings_have_a_status(spark):
    doc = '{"a": {"b": {"c": {"d-e": 1}}}, "x": {}}'
    df = spark.createDataFrame([(1, doc)], "id long, doc string")
    deep = [(r.path, r.value, r.status) for r in X.flatten_settings(df, "doc", ["id"], max_depth=2).collect()]
    assert deep == [("a.b", '{"c":{"d-e":1}}', "too-deep")]
    whole = [(r.path, r.value, r.status) for r in X.flatten_settings(df, "doc", ["id"]).collect()]
    assert whole == [("a.b.c.d_e", "1", "ok")]


def test_command_defaults(spark):
    doc = """{"launch": {"num-slaves": 3, "java-version": 11}, "providers": {"ec2": {"key-name": "k", "tags": ["a"]}},
              "services": {"spark": {"git-commit": "abc"}, "hdfs": null, "empty": {}}}"""
    df = spark.createDataFrame([(1, doc), (2, "not json"), (3, "{}")], "id long, doc string")
    got = {}
    for r in X.command_defaults(df, "doc", ["id"]).collect():
        got.setdefault((r.id, r.command), {})[r.option] = r.value
    ec2 = {"ec2_key_name": "k", "ec2_tags": '["a"]'}
    assert set(got) == {(1, c) for c in ("launch", *X.OTHER_COMMANDS)}
    assert got[1, "launch"] == {"num_slaves": "3", "java_version": "11", "spark_git_commit": "abc", **ec2}
    assert all(got[1, c] == ec2 for c in X.OTHER_COMMANDS)


@pytest.mark.parametrize("master", [True, False])
def test_one_address_kind_per_cluster(spark, master):
    rows = [("c", 2, "master" if master else "slave", True), ("c", 1, "slave", False), ("c", 3, "slave", None), (None, 4, "slave", True)]
    df = spark.createDataFrame([(*r, "pi", "ui", "ph", "uh") for r in rows],
                               "c string, id long, role string, p boolean, pi string, ui string, ph string, uh string")
    got = {r.id: (r.ip, r.host) for r in filters.cluster_addresses(df, "c", "id", "role", "p", "pi", "ui", "ph", "uh").collect()}
    here = ("pi", "ph") if master else ("ui", "uh")
    assert got == {1: here, 2: here, 3: here, 4: ("pi", "ph")}


def test_unnamed_rows_are_violations(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id long, name string")
    assert [tuple(r) for r in aggs.unnamed_rows(df, "name", ["id"]).collect()] == [(2, "missing name")]


def test_commands_without_a_state_check(spark):
    cmds = [(c, s) for c in ("destroy", "describe", "remove-slaves", "start") for s in ("pending", "stopped", None)]
    got = {(r.c, r.s): r.decision for r in joins.admit_commands(spark.createDataFrame(cmds, "c string, s string"), "c", "s").collect()}
    assert all(got[c, s] == ("invalid" if s is None else "ok") for c in ("destroy", "describe", "remove-slaves") for s in ("pending", "stopped", None))
    assert [got["start", s] for s in ("pending", "stopped", None)] == ["invalid", "ok", "invalid"]


def test_unknown_volume_sizes_are_raised(spark):
    df = spark.sql("select named_struct('VolumeSize', cast(n as int), 'VolumeType', 'st1', 'Encrypted', true) v from values (8), (null), (50) t(n)")
    got = [tuple(r.v) for r in X.raise_volume_floor(df, "v", 30).collect()]
    assert got == [(30, "gp2"), (30, "gp2"), (50, "st1")]
