"""Settings of any depth, defaults inside a row, port pieces, bag differences, null names."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fleetlens.functions import columns as X
from fleetlens.operators import joins


def test_settings_forty_levels_deep(spark):
    doc = '{"a-b":' * 40 + '{"x": [1], "y": null, "e": {}}' + "}" * 40
    df = spark.createDataFrame([(1, doc), (2, '{"s": "t"}'), (3, "5"), (4, "no json"), (5, None), (2, '{"s": "t"}')], "id int, doc string")
    got = sorted(map(tuple, X.flatten_settings(df, "doc", ["id"]).collect()), key=repr)
    path = ".".join(["a_b"] * 40)
    assert got == sorted([(1, path + ".x", "[1]", "ok"), (1, path + ".y", None, "ok"), (2, "s", "t", "ok"), (2, "s", "t", "ok"),
                          (3, "", "5", "ok")], key=repr)
    assert X.flatten_settings(df.limit(0), "doc", ["id"]).collect() == []


def test_command_defaults_are_resolved_inside_a_row(spark):
    docs = [(1, '{"launch":{"a-b":1,"a_b":2,"ec2_x":"l"},"providers":{"ec2":{"x":"p","y":null}},'
                '"services":{"spark":{"v":{"q":1}},"h":null,"z":3}}'),
            (2, "[]"), (3, None), (4, '{"providers":5,"launch":{"k":true}}'), (5, '{"services":{"s":{"k":[1]},"t":"str"}}'),
            (5, '{"launch":{"k":1}}')]
    out = X.command_defaults(spark.createDataFrame(docs, "id int, doc string"), "doc", ["id"])
    got = sorted((tuple(r) for r in out.collect()), key=repr)
    want = [(1, "launch", o, v) for o, v in (("a_b", "2"), ("ec2_x", "p"), ("ec2_y", None), ("spark_v", '{"q":1}'))]
    want += [(1, c, o, v) for c in X.OTHER_COMMANDS for o, v in (("ec2_x", "p"), ("ec2_y", None))]
    want += [(4, "launch", "k", "true"), (5, "launch", "s_k", "[1]"), (5, "launch", "k", "1")]
    assert got == sorted(want, key=repr)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan


def test_port_pieces_cover_a_range_exactly(spark):
    rnd = random.Random(6)
    ranges = [(0, 65535), (22, 22), (5, 4), (None, 5), (-5, 3), (1, 6), (0, 0), (-2 ** 31, 2 ** 31 - 1), (-10 ** 12, 10 ** 12), (7, 8)]
    ranges += [(a, a + rnd.randrange(0, 3000)) for a in (rnd.randrange(-500, 60000) for _ in range(60))]
    df = spark.createDataFrame([(i, lo, hi) for i, (lo, hi) in enumerate(ranges)], "i int, lo bigint, hi bigint")
    for r in df.select("i", joins.port_pieces("lo", "hi").alias("p")).collect():
        lo, hi = ranges[r.i]
        spans = sorted((p.piece * 2 ** p.level - 2 ** 31, (p.piece + 1) * 2 ** p.level - 1 - 2 ** 31) for p in r.p or [])
        if lo is None or lo > hi:
            assert spans == []
            continue
        assert spans[0][0] == max(lo, -2 ** 31) and spans[-1][1] == min(hi, 2 ** 31 - 1)
        assert all(a[1] + 1 == b[0] for a, b in zip(spans, spans[1:]))


def test_a_short_port_range_is_met_at_one_level(spark):
    rows = [(a, a + w) for a in range(8000, 8070, 7) for w in range(31)] + [(1, 65533), (-2 ** 31 + 1, 2 ** 31 - 2)]
    df = spark.createDataFrame(rows, "lo bigint, hi bigint")
    for r in df.select("lo", "hi", joins.port_pieces("lo", "hi").alias("p")).collect():
        per_level = Counter(p.level for p in r.p)
        assert len(per_level) <= 7 and max(per_level.values()) <= 62
        assert r.hi - r.lo > 30 or set(per_level) == {0}


def test_a_shuffled_flow_asks_once_per_network(spark):
    """With broadcasts off no shuffle carries more rows than there are flows (one rule network each), and a rule column
    that the caller drops is not gathered."""
    rules = spark.createDataFrame([(i, 10 << 24, 8, i * 5, i * 5 + 5 + i % 20, None) for i in range(200)] + [(7, 10 << 24, 8, 35, 47, "x")],
                                  "rid bigint, net bigint, plen int, lo int, hi int, note string")
    flows = spark.range(20000).select("id", (F.lit(10 << 24) + F.col("id") % 500).cast("bigint").alias("ip"), (F.col("id") % 1000).cast("int").alias("port"))
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        out = joins.match_rules(flows, rules, "ip", "port", "net", "plen", "lo", "hi").select("id", "rid")
        from test_scale_paths import _final_plan
        plan = _final_plan(out)
        got = Counter(map(tuple, out.collect()))
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    spans = [(i, i * 5, i * 5 + 5 + i % 20) for i in range(200)] + [(7, 35, 47)]
    assert got == Counter((i, rid) for i in range(20000) for rid, lo, hi in spans if lo <= i % 1000 <= hi)
    assert max(float(x) for x in re.findall(r"rowCount=([0-9.E+]+)", plan)) <= 20000
    assert "_f5" not in plan


def test_many_port_rules_do_not_multiply_flows(spark):
    """One network with 20,000 port rules: the join makes a row per admitted flow, not one per flow and rule."""
    rules = spark.createDataFrame([(i, 10 << 24, 8, i, i) for i in range(20000)], "rid bigint, net bigint, plen int, lo int, hi int")
    flows = spark.range(3000).select("id", (F.lit(10 << 24) + F.col("id") % 7).cast("bigint").alias("ip"), (F.col("id") * 7).cast("int").alias("port"))
    out = joins.match_rules(flows, rules, "ip", "port", "net", "plen", "lo", "hi")
    assert sorted((r.id, r.rid) for r in out.collect()) == [(i, 7 * i) for i in range(3000) if 7 * i < 20000]
    from test_scale_paths import _final_plan
    assert "BroadcastNestedLoop" not in _final_plan(out) and "Cartesian" not in _final_plan(out)


@pytest.mark.parametrize("list_rules", [1, 7, 1024])
def test_rules_met_in_lists_and_flows_of_one_file_by_many_tasks(spark, tmp_path, list_rules):
    """Many rules admit each flow: the result is dealt out over tasks although the flows lie in one file, and does
    not depend on how the rules are listed. Rules and flows repeat, some are null, and both have a column ``note``."""
    rnd = random.Random(21)
    rules = [(j, (10 << 24) + rnd.randrange(0, 4) * 256, rnd.choice([8, 16, 24]), 100, 100 + rnd.randrange(0, 20), "r") for j in range(120)]
    rules += rules[:30] * 2 + [(500, None, 8, 1, 200, "r"), (501, 10 << 24, 8, None, 200, None)]
    flows = [(i, (10 << 24) + rnd.randrange(0, 1024), 95 + rnd.randrange(0, 30), "f") for i in range(200)]
    flows += flows[:20] + [(900, None, 100, "f"), (901, 10 << 24, None, None)]
    for name, rows, schema in (("f", flows, "fid bigint, ip bigint, port int, note string"),
                               ("r", rules, "rid bigint, net bigint, plen int, lo int, hi int, note string")):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / name))
    f, r = (spark.read.parquet(str(tmp_path / name)) for name in "fr")
    out = joins.match_rules(f, r, "ip", "port", "net", "plen", "lo", "hi", list_rules=list_rules)
    assert out.columns == ["fid", "ip", "port", "note", "rid", "net", "plen", "lo", "hi", "note"]
    want = [(*x, rid, net >> 32 - plen << 32 - plen, plen, lo, hi, note) for x in flows for rid, net, plen, lo, hi, note in rules
            if None not in (x[1], x[2], net, lo) and net >> 32 - plen == x[1] >> 32 - plen and lo <= x[2] <= hi]
    assert sorted(map(tuple, out.collect())) == sorted(want) and len(want) > 5000
    from test_scale_paths import _final_plan
    assert "RoundRobinPartitioning(8)" in _final_plan(out)


def test_bag_diff_equals_except_all(spark):
    rnd = random.Random(7)
    rows = lambda n: [(rnd.choice([1, 2, None]), rnd.choice(["a", None])) for _ in range(n)]
    b, a = rows(300), rows(200) + [(9, "z")] * 3
    schema = "k int, v string"
    got = {(r.k, r.v, r.change): r.copies for r in joins.bag_diff(
        spark.createDataFrame(b, schema), spark.createDataFrame(a, schema), ["k", "v"]).collect()}
    cb, ca = Counter(b), Counter(a)
    want = {}
    for x in {*cb, *ca}:
        for name, n in (("kept", min(cb[x], ca[x])), ("added", ca[x] - cb[x]), ("removed", cb[x] - ca[x])):
            if n > 0:
                want[(*x, name)] = n
    assert got == want
    new = Counter(map(tuple, joins.new_copies(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)).collect()))
    assert new == ca - cb


def test_a_null_name_that_exists_is_rejected(spark):
    new = spark.createDataFrame([("a",), (None,), ("b",), (None,)], "k string")
    for have, want in (([("a",), (None,)], {"a": "rejected", None: "rejected", "b": "accepted"}),
                       ([("a",)], {"a": "rejected", None: "accepted", "b": "accepted"})):
        for hot in (100, 1):
            out = joins.insert_if_absent(new, spark.createDataFrame(have, "k string"), "k", hot_rows=hot).collect()
            assert len(out) == 4 and {r.k: r.status for r in out} == want
