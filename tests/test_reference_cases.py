"""Small tables for the rules of single operators, and edge rows for the
"""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from fleetlens.functions import columns as X
from fleetlens.operators import aggs, filters, joins, quality, windows


# ---------------------------------------------------------------- X3 tags
@pytest.mark.parametrize("text, want", [
    ("team,storage", ("team", "storage")), ("  cost centre ,\t42 ", ("cost centre", "42")), ("spare,   ", ("spare", "")),
    ("größe,xl", ("größe", "xl")), ("a=b,c=d", ("a=b", "c=d")),
    ("team", None), ("team,storage,disk", None), (",storage", None), ("\t ,storage", None), ("", None), (",", None), (",,", None)])
def test_one_comma_and_a_key_that_is_not_blank(spark, text, want):
    r = X.ingest_tags(spark.createDataFrame([(text,)], "raw string"), "raw").first()
    assert (r.status, r.tag_key, r.tag_value) == (("ok", *want) if want else ("invalid", None, None))


# ------------------------------------------------------------- X1 versions
def test_version_audit_cases(spark):
    commit = "a" * 40
    df = spark.createDataFrame([("",), ("3.5.0",), (commit,), ("3.1.3",), ("2.7.1",), ("2.6.5",),
                                ("10.0",), ("3.x",)], "v string")
    out = {r.v: r for r in X.version_audit(df, "v").collect()}
    assert out[""].status == "empty"
    assert out[commit].status == "commit"
    assert out["3.5.0"].version_key == [3, 5, 0] and out["3.5.0"].short_version == "3.5"
    assert out["3.1.3"].hadoop_build == "hadoop3.2"
    assert out["2.7.1"].hadoop_build == "hadoop2.7"
    assert out["2.6.5"].hadoop_build == "hadoop2.6"
    # numeric everywhere (2.12 #6): 10.0 is not below 3.0
    assert out["10.0"].hadoop_build == "hadoop3.2"
    # non-numeric part is quarantined, not raised (2.12 #7)
    assert out["3.x"].status == "invalid" and out["3.x"].hadoop_build is None


# ----------------------------------------------------------- Q1 requires
DISKS = "host int, encrypt string, key_id string, vault string"


def test_required_columns_are_reported_one_by_one(spark):
    rows = [(1, "yes", "k9", "v1"), (2, "yes", "k9", None), (3, "yes", None, None), (4, None, None, None), (5, "", None, "v1"), (6, "yes", "", "v1")]
    df = spark.createDataFrame(rows, DISKS)
    out = quality.requires(df, ["host"], "encrypt", all_of=["key_id", "vault"]).collect()
    assert sorted((r.host, r.missing) for r in out) == [(2, "vault"), (3, "key_id"), (3, "vault"), (6, "key_id")]
    assert {r.message for r in out if r.host == 2} == {'Error: Missing option "vault" is required by "encrypt".'}
    some = quality.requires(df, ["host"], "encrypt", any_of=["key_id", "vault"]).collect()
    assert [(r.host, r.rule, r.missing) for r in some] == [(3, "requires_any", "key_id, vault")]


def test_a_rule_for_one_value_leaves_the_others_alone(spark):
    df = spark.createDataFrame([(1, "aes", None, None), (2, "none", None, None), (3, "aes", None, "v1"), (4, "", None, None)], DISKS)
    found = lambda value: [r.host for r in quality.requires(df, ["host"], "encrypt", any_of=["key_id", "vault"], when_value=value).collect()]
    assert found("aes") == [1] and found("none") == [2] and found("xts") == []
    assert found("") == []  # an unset option triggers nothing, whatever value the rule names


def test_requires_any_accepts_empty_string(spark):
    # 2.12 #1: requires_any tests only "is not None", so '' satisfies it
    df = spark.createDataFrame([(1, "x", "")], "id int, opt string, other string")
    assert quality.requires(df, ["id"], "opt", any_of=["other"]).count() == 0
    assert quality.requires(df, ["id"], "opt", all_of=["other"]).count() == 1


# ----------------------------------------------------- Q2 / Q3 exclusivity
def test_mutually_exclusive_cases(spark):
    df = spark.createDataFrame([(1, "yes", None), (2, "yes", "no"), (3, "", "no")],
                               "id int, option1 string, option2 string")
    out = quality.mutually_exclusive(df, ["id"], ["option1", "option2"]).collect()
    assert [(r.id, r.used) for r in out] == [(2, "option1,option2")]


def test_exactly_one(spark):
    df = spark.createDataFrame([(1, "sg-1", None), (2, None, None), (3, "sg-1", "10.0.0.0/8"), (4, "", "10.0.0.0/8")],
                               "id int, src_group string, cidr_ip string")
    out = {r.id: r.problem for r in quality.exactly_one(df, ["id"], ["src_group", "cidr_ip"]).collect()}
    assert out == {2: "none set", 3: "more than one set"}


# ------------------------------------------------------ X7 normalize keys
def test_flatten_settings_normalizes_keys_only(spark):
    doc = '{"java-version": 11, "ec2": {"spot-price": 0.05, "key-name": "key.pem"}, "tags": ["a-b, c-d"]}'
    df = spark.createDataFrame([(1, doc), (2, "not json"), (3, '{"services": {}}')], "id int, doc string")
    out = {(r.id, r.path): r.value for r in X.flatten_settings(df, "doc", ["id"]).collect()}
    assert out == {
        (1, "java_version"): "11",
        (1, "ec2.spot_price"): "0.05",
        (1, "ec2.key_name"): "key.pem",
        (1, "tags"): '["a-b, c-d"]',
    }


# ---------------------------------------------------- J7 command on state
def test_admit_commands_cases(spark):
    df = spark.createDataFrame([
        ("start", "running"), ("stop", "stopped"), ("run-command", "stopped"),
        ("copy-file", "stopped"), ("start", None), ("stop", None), ("start", "stopped")],
        "command string, state string")
    out = [(r.command, r.state, r.decision, r.exit_code)
           for r in joins.admit_commands(df, "command", "state").collect()]
    got = {(c, s): (d, e) for c, s, d, e in out}
    assert got[("start", "running")] == ("nothing-to-do", 0)
    assert got[("stop", "stopped")] == ("nothing-to-do", 0)
    assert got[("run-command", "stopped")] == ("invalid", 1)
    assert got[("copy-file", "stopped")] == ("invalid", 1)
    assert got[("start", None)] == ("invalid", 1)
    assert got[("stop", None)] == ("invalid", 1)
    assert got[("start", "stopped")] == ("ok", 0)


# ------------------------------------------------------ A2 consensus rules
def test_group_consensus_semantics(spark):
    # 2.12 #2, #18: {x, NULL} inconsistent, all NULL is NULL, no rows is inconsistent
    df = spark.createDataFrame([("a", "running"), ("a", "running"), ("b", "running"), ("b", None),
                                ("c", None), ("d", "running"), ("d", "stopped")], "k string, s string")
    clusters = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), ("e",)], "k string")
    out = {r.k: r.state for r in aggs.group_consensus(df, "k", "s", clusters=clusters).collect()}
    assert out == {"a": "running", "b": "inconsistent", "c": None, "d": "inconsistent", "e": "inconsistent"}


# --------------------------------------------------------- W1 victims
def test_pick_victims_spot_first_and_clamp(spark):
    df = spark.createDataFrame([("c", 1, False), ("c", 2, True), ("c", 3, False), ("d", 9, False)],
                               "k string, id int, spot boolean")
    out = sorted((r.k, r.id, r.victim_rank) for r in windows.pick_victims(df, "k", 2, "spot", "id").collect())
    assert out == [("c", 1, 2), ("c", 2, 1), ("d", 9, 1)]


# ------------------------------------------------------------ A4 roles
def test_split_roles_violations(spark):
    df = spark.createDataFrame([("a", "master", "h1"), ("a", "slave", "h2"),
                                ("b", "master", "h3"), ("b", "master", "h4"),
                                ("c", "slave", "h5"), ("d", "witch", "h6")], "k string, role string, host string")
    out = {r.k: (r.master, r.violation) for r in aggs.split_roles(df, "k", "role", "host").collect()}
    assert out == {"a": ("h1", None), "b": (None, "multiple masters"), "c": (None, None),
                   "d": (None, "unknown role")}


# --------------------------------------------------------- X5 sources
@pytest.mark.parametrize("text,kind,cidr", [
    ("sg-12345", "group", "sg-12345"),
    ("10.0.0.0/8", "cidr", "10.0.0.0/8"),
    ("10.1.2.3", "cidr", "10.1.2.3/32"),
    ("10.0.0.0/255.0.0.0", "cidr", "10.0.0.0/8"),
    ("10.0.0.0/0.255.255.255", "cidr", "10.0.0.0/8"),
    ("10.0.0.0/08", "cidr", "10.0.0.0/8"),
    ("10.0.0.1/8", "invalid", None),
    ("10.00.0.0/16", "invalid", None),
    ("256.0.0.0/8", "invalid", None),
    ("10.0.0.0/33", "invalid", None),
    ("10.0.0.0/", "invalid", None),
    ("10.0.0.0/8/8", "invalid", None),
    ("10.0.0/8", "invalid", None),
    ("0.0.0.0/0", "cidr", "0.0.0.0/0"),
])
def test_ingest_sources(spark, text, kind, cidr):
    df = spark.createDataFrame([(text,)], "s string")
    r = X.ingest_sources(df, "s").collect()[0]
    assert (r.kind, r.source_value) == (kind, cidr)


# --------------------------------------------------------- X8 / X10 / X11
def test_storage_layout_fallback(spark):
    df = spark.createDataFrame([("/media/root", []), ("/media/root", ["/media/ephemeral0", "/media/ephemeral1/"])],
                               "root string, eph array<string>")
    out = [r.spark_root_ephemeral_dirs for r in X.storage_layout(df, "root", "eph").collect()]
    assert out == ["/media/root/spark", "/media/ephemeral0/spark,/media/ephemeral1/spark"]


def test_raise_volume_floor(spark):
    df = spark.createDataFrame([((8, "standard", True),), ((100, "io1", False),)],
                               "ebs struct<VolumeSize:int, VolumeType:string, Encrypted:boolean>")
    out = X.raise_volume_floor(df, "ebs", 30)
    assert out.schema["ebs"].dataType.fieldNames() == ["VolumeSize", "VolumeType"]
    assert [tuple(r.ebs) for r in out.collect()] == [(30, "gp2"), (100, "io1")]


def test_decode_payload(spark):
    import base64
    payload = base64.b64encode("héllo".encode()).decode()
    df = spark.createDataFrame([(payload,), (None,), ("@@@",)], "p string")
    assert [r.decoded for r in X.decode_payload(df, "p").collect()] == ["héllo", "", ""]


# --------------------------------------------------------- X2 Java banner
def test_java_major(spark):
    df = spark.createDataFrame([('openjdk version "1.8.0_252"',), ('openjdk version "11.0.7" 2020-04-14',),
                                ('java version "17"',), ("command not found",), (None,)], "b string")
    assert [r.m for r in df.select(X.java_major("b").alias("m")).collect()] == [8, 11, 17, None, None]


# ------------------------------------------------------------- F1 / F3
def test_inventory_filter_empty_list_means_all(spark):
    df = spark.createDataFrame([("a", "running"), ("b", "terminated")], "name string, state string")
    assert filters.inventory_filter(df, any_of={"name": []}).count() == 2
    assert [r.name for r in filters.live_instances(df).collect()] == ["a"]


def test_device_filter(spark):
    df = spark.createDataFrame([("/dev/a", "/", str(2 ** 31)), ("/dev/b", None, str(2 ** 30)),
                                ("/dev/c", "/mnt", "1048576"), ("/dev/d", "/mnt", "junk")],
                               "kname string, mountpoint string, size string")
    assert [r.kname for r in filters.device_filter(df).collect()] == ["/dev/b"]


# ---------------------------------------------------------- X4 tags map
def test_tags_to_map_last_wins(spark):
    df = spark.createDataFrame([([("Name", "a"), ("role", "master"), ("Name", "b")],)],
                               "tags array<struct<Key:string, Value:string>>")
    assert X.tags_to_map(df, "tags").collect()[0].tag_map == {"Name": "b", "role": "master"}


# ------------------------------------------------------------- A9 / W3
def test_duration_truncates_both_ends(spark):
    t0 = dt.datetime(2024, 1, 1, 0, 0, 0, 900000)
    t1 = dt.datetime(2024, 1, 1, 0, 0, 2, 100000)
    df = spark.createDataFrame([("op", t0, t1, True), ("op", t0, t1, False)],
                               "k string, s timestamp_ntz, e timestamp_ntz, ok boolean")
    r = aggs.duration_summary(df, "k", "s", "e", "ok").collect()[0]
    assert (r.ops, r.min_seconds, r.total_seconds) == (1, 2, 2)


def test_retry_chain_outcomes(spark):
    t = [dt.datetime(2024, 1, 1, 0, i) for i in range(10)]
    rows = [("h", t[0], 0, False), ("h", t[1], 1, True),                      # succeeded (2)
            ("h", t[2], 2, False), ("h", t[3], 3, False), ("h", t[4], 4, False),
            ("h", t[5], 5, True),                                              # late (4)
            ("h", t[6], 6, False), ("h", t[7], 7, False)]                      # open (2)
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, id int, ok boolean")
    out = [(r.chain, r.attempts, r.outcome) for r in
           windows.retry_chains(df, "k", "ts", "id", "ok", limit=3).orderBy("chain").collect()]
    assert out == [(0, 2, "succeeded"), (1, 4, "late"), (2, 2, "open")]


# --------------------------------------------------- A1 chunked members
def test_compose_groups_chunks_large_groups(spark):
    df = spark.range(0, 1000).select((F.col("id") % 2).alias("k"), F.col("id").cast("string").alias("m"))
    out = aggs.compose_groups(df, "k", "m", chunk_size=100).collect()
    assert max(len(r.members) for r in out) < 200
    for k in (0, 1):
        members = sorted(m for r in out if r.k == k for m in r.members)
        assert members == sorted(str(i) for i in range(k, 1000, 2))


# ------------------------------------------------------ S3 / S4 / S5 lines
def test_key_value_lines_case(spark):
    from fleetlens.sources import text
    df = spark.createDataFrame([(1, 'KNAME="/dev/XVDB" MOUNTPOINT="/Media/X" SIZE="1073741824"')],
                               "id int, line string")
    keep = {r.key: r.value for r in text.read_key_value_lines(df, "line", ["id"]).collect()}
    assert keep == {"kname": "/dev/XVDB", "mountpoint": "/Media/X", "size": "1073741824"}
    low = {r.key: r.value for r in text.read_key_value_lines(df, "line", ["id"], lower_values=True).collect()}
    assert low["mountpoint"] == "/media/x"


def test_read_fields_quarantines_wrong_arity(spark):
    from fleetlens.sources import text
    df = spark.createDataFrame([("/dev/xvdb /media/ephemeral0 ext4 defaults 0 0",), ("/dev/xvdc /mnt",)], "l string")
    names = ["device_name", "mount_point", "filesystem_type", "mount_options", "dump", "pass_number"]
    out = text.read_fields(df, "l", names).collect()
    assert out[0].status == "ok" and out[0].mount_point == "/media/ephemeral0"
    assert out[1].status == "invalid" and out[1].device_name is None


def test_operation_log_line(spark):
    from fleetlens.sources import text
    line = "2024-01-01 00:00:07,179 - fleet.ssh           - ERROR - [10.0.0.8] SSH timeout."
    df = spark.createDataFrame([(line,), ("garbage",)], "l string")
    ok, bad = text.read_operation_log(df, "l").collect()
    assert (ok.logger, ok.level, ok.host, ok.message) == ("fleet.ssh", "ERROR", "10.0.0.8", "SSH timeout.")
    assert str(ok.ts) == "2024-01-01 00:00:07.179000"
    assert bad.status == "invalid" and bad.ts is None


def test_manifest_round_trip(spark):
    from fleetlens.sources import manifests
    rows = spark.createDataFrame([("c1", "HDFS", "3.3.6", 11), ("c1", "Spark", "3.5.0", 11)],
                                 "cluster string, service string, version string, java int")
    doc = manifests.write_manifests(rows, "cluster", "service", ["version"], "java").collect()[0].manifest
    assert doc == ('{"java_version":11,"services":[["HDFS",{"version":"3.3.6"}],'
                   '["Spark",{"version":"3.5.0"}]]}')
    back = manifests.read_manifests(spark.createDataFrame([("c1", doc)], "c string, doc string"), "doc", ["c"])
    assert sorted((r.service, r.version, r.java_version) for r in back.collect()) == [
        ("HDFS", "3.3.6", 11), ("Spark", "3.5.0", 11)]


def test_map_rows_fail_fast(spark):
    from fleetlens.operators import rowmap

    def fn(row):
        if row["x"] == 2:
            raise ValueError("boom")
        return {"y": row["x"] * 10}

    df = spark.createDataFrame([(1,), (2,), (3,)], "x long")
    got = sorted((r.x, r.y, r.error) for r in rowmap.map_rows(df, fn, "y long", keep=["x"]).collect())
    assert got == [(1, 10, None), (2, None, "ValueError: boom"), (3, 30, None)]
    with pytest.raises(Exception):
        rowmap.map_rows(df, fn, "y long", keep=["x"], fail_fast=True).collect()


def test_missing_message(spark):
    one = spark.createDataFrame([("sg-a",)], "name string")
    two = spark.createDataFrame([("sg-b",), ("sg-a",)], "name string")
    assert joins.missing_message(one).collect()[0].message == "Could not find the following security group: sg-a"
    assert joins.missing_message(two).collect()[0].message == \
        "Could not find the following security groups: sg-a, sg-b"


def test_split_roles_with_slaves(spark):
    df = spark.createDataFrame([("a", "master", "h1"), ("a", "slave", "h3"), ("a", "slave", "h2"),
                                ("b", "master", "h4")], "k string, role string, host string")
    out = {r.k: (r.master, r.slaves) for r in aggs.split_roles(df, "k", "role", "host", with_slaves=True).collect()}
    assert out == {"a": ("h1", ["h2", "h3"]), "b": ("h4", [])}


def test_compose_groups_keeps_null_group(spark):
    df = spark.createDataFrame([(None, "a"), (None, "b"), ("x", "c")], "k string, m string")
    out = {r.k: r.members for r in aggs.compose_groups(df, "k", "m").collect()}
    assert out == {None: ["a", "b"], "x": ["c"]}
