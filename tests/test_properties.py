"""Column jobs against independent Python implementations of the same
rules, on generated inputs (one Spark job per test)."""

import ipaddress
import random

from fleetlens.functions import columns as X


def _random_source(rnd: random.Random) -> str:
    def octet():
        r = rnd.random()
        if r < 0.05:
            return "0" + str(rnd.randrange(0, 100))          # leading zero
        if r < 0.08:
            return str(rnd.randrange(256, 1000))            # too large
        return str(rnd.choice([0, 10, 127, 172, 192, 255, rnd.randrange(0, 256)]))

    addr = ".".join(octet() for _ in range(rnd.choice([4, 4, 4, 4, 3, 5])))
    r = rnd.random()
    if r < 0.2:
        return addr
    if r < 0.55:
        plen = rnd.choice(list(range(0, 33)) + [33, 40, 99])
        text = str(plen) if rnd.random() > 0.05 else "0" + str(plen)
        return f"{addr}/{text}"
    if r < 0.7:
        n = rnd.randrange(0, 33)
        mask = ((1 << 32) - 1) ^ ((1 << (32 - n)) - 1)
        return f"{addr}/{ipaddress.IPv4Address(mask)}"
    if r < 0.8:
        n = rnd.randrange(0, 33)
        return f"{addr}/{ipaddress.IPv4Address((1 << (32 - n)) - 1)}"
    if r < 0.85:
        return f"{addr}/{ipaddress.IPv4Address(rnd.randrange(0, 1 << 32))}"
    if r < 0.9:
        return "sg-" + format(rnd.randrange(1 << 40), "x")
    return rnd.choice(["", "/", f"{addr}/", f"{addr}//8", "abc", f" {addr}", f"{addr}/8 "])


def _python_kind(s: str):
    if s.startswith("sg-"):
        return ("group", s)
    try:
        return ("cidr", str(ipaddress.IPv4Network(s)))
    except ValueError:
        return ("invalid", None)


def test_ingest_sources_matches_python_ipaddress(spark):
    rnd = random.Random(20)
    # networks with host bits cleared, so that many inputs are valid
    values = []
    for _ in range(3000):
        s = _random_source(rnd)
        if rnd.random() < 0.5:
            try:
                s = str(ipaddress.IPv4Network(s, strict=False))
            except ValueError:
                pass
        values.append(s)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    got = {r.i: (r.kind, r.source_value) for r in X.ingest_sources(df, "s").collect()}
    want = {i: _python_kind(v) for i, v in enumerate(values)}
    bad = [(values[i], got[i], want[i]) for i in want if got[i] != want[i]]
    assert not bad, bad[:10]
    kinds = {k for k, _ in want.values()}
    assert kinds == {"group", "cidr", "invalid"}


def _python_tag(raw: str):
    if raw.count(",") != 1:
        return None
    key, value = [w.strip() for w in raw.split(",", maxsplit=1)]
    return (key, value) if key else None


def test_ingest_tags_matches_python_rule(spark):
    rnd = random.Random(3)
    parts = ["k", "key", " k ", "", " ", "v", "v v", ",", ",,", "\t", "x,y"]
    values = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 5))) for _ in range(2000)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, raw string")
    got = {r.i: ((r.tag_key, r.tag_value) if r.status == "ok" else None)
           for r in X.ingest_tags(df, "raw").collect()}
    want = {i: _python_tag(v) for i, v in enumerate(values)}
    bad = [(values[i], got[i], want[i]) for i in want if got[i] != want[i]]
    assert not bad, bad[:10]


def _python_build(v: str):
    t = tuple(map(int, v.split(".")))
    return "hadoop2.6" if t < (2, 7) else "hadoop2.7" if t < (3, 0) else "hadoop3.2"


def test_version_classes_match_tuple_order(spark):
    rnd = random.Random(9)
    values = [".".join(str(rnd.choice([0, 1, 2, 3, 6, 7, 9, 10, 12])) for _ in range(rnd.randrange(1, 4)))
              for _ in range(1500)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    got = {r.i: r.hadoop_build for r in X.version_audit(df, "v").collect()}
    assert got == {i: _python_build(v) for i, v in enumerate(values)}


def _python_java_major(banner):
    tokens = banner.split()
    if len(tokens) >= 3:
        parts = tokens[2].strip('"').split(".")
        try:
            if len(parts) >= 2:
                return int(parts[1]) if parts[0] == "1" else int(parts[0])
            return int(parts[0])  # deliberate change: a bare "17" is 17
        except ValueError:
            return None
    return None


def test_java_major_matches_python_rule(spark):
    rnd = random.Random(4)
    heads = ["openjdk version", "java version", "bash: java:", "", "openjdk"]
    vers = ['"1.8.0_252"', '"11.0.7"', '"17"', '"21.0.1"', '"1.7.0"', "x", '"9"', '"abc.1"', '""']
    values = [" ".join(t for t in (rnd.choice(heads), rnd.choice(vers), rnd.choice(["", "2020-04-14"])) if t)
              for _ in range(1000)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, b string")
    got = {r.i: r.m for r in df.select("i", X.java_major("b").alias("m")).collect()}
    want = {i: _python_java_major(v) for i, v in enumerate(values)}
    bad = [(values[i], got[i], want[i]) for i in want if got[i] != want[i]]
    assert not bad, bad[:10]


def _python_requires(scope, option, when_value, all_of, any_of):
    """The rule in plain Python: trigger on a truthy option (equal to
    the value if given); all_of needs truthy values, any_of one non-None."""
    out = []
    v = scope[option]
    if v and (when_value is None or v == when_value):
        out += [("requires_all", r) for r in all_of if not scope[r]]
        if any_of and all(scope[r] is None for r in any_of):
            out.append(("requires_any", ", ".join(any_of)))
    return sorted(out)


def test_requires_matches_python_rule(spark):
    from fleetlens.operators import quality
    rnd = random.Random(8)
    choices = [None, "", "x", "gp3"]
    rows = [(i, *[rnd.choice(choices) for _ in range(4)]) for i in range(800)]
    df = spark.createDataFrame(rows, "i int, o string, a string, b string, c string")
    for when in (None, "gp3"):
        got = {}
        for r in quality.requires(df, ["i"], "o", all_of=["a", "b"], any_of=["b", "c"], when_value=when).collect():
            got.setdefault(r.i, []).append((r.rule, r.missing))
        for i, o, a, b, c in rows:
            want = _python_requires({"o": o, "a": a, "b": b, "c": c}, "o", when, ["a", "b"], ["b", "c"])
            assert sorted(got.get(i, [])) == want, (o, a, b, c, when)


def test_resolve_settings_matches_layering(spark):
    """Later layer wins; a NULL value does not set anything; ties by order."""
    from fleetlens.operators import joins
    rnd = random.Random(31)
    rows = [(rnd.randrange(5), rnd.choice(["a", "b"]), rnd.choice([None, "x", "y", "z"]),
             rnd.randrange(3), i) for i in range(600)]
    df = spark.createDataFrame(rows, "scope int, key string, value string, rank int, seq int")
    got = {(r.scope, r.key): (r.value, r.layer)
           for r in joins.resolve_settings(df, "scope", "key", "value", "rank", tiebreak=["seq"]).collect()}
    want = {}
    for scope, key, value, rank, seq in sorted(rows, key=lambda r: (r[3], r[4])):
        if value is not None:
            want[(scope, key)] = (value, rank)
    assert got == want


def test_snapshot_diff_matches_dict_diff(spark):
    from fleetlens.operators import joins
    rnd = random.Random(32)
    before = {i: rnd.choice(["running", "stopped", None]) for i in rnd.sample(range(300), 200)}
    after = {i: rnd.choice(["running", "stopped", None]) for i in rnd.sample(range(300), 200)}
    b = spark.createDataFrame(list(before.items()), "id int, state string")
    a = spark.createDataFrame(list(after.items()), "id int, state string")
    got = {r.id: r.change for r in joins.snapshot_diff(b, a, "id", ["state"]).collect()}
    want = {}
    for i in set(before) | set(after):
        if i not in before:
            want[i] = "added"
        elif i not in after:
            want[i] = "removed"
        else:
            want[i] = "kept" if before[i] == after[i] else "changed"
    assert got == want


def test_pick_victims_matches_sorted_slice(spark):
    from fleetlens.operators import windows
    rnd = random.Random(33)
    rows = [(rnd.choice(["c1", "c2", "c3"]), i, rnd.random() < 0.3) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, id int, spot boolean")
    for n in (0, 1, 5, 500):
        got = sorted((r.k, r.id) for r in windows.pick_victims(df, "k", n, "spot", "id").collect())
        want = []
        for k in {r[0] for r in rows}:
            members = sorted((r for r in rows if r[0] == k), key=lambda r: (not r[2], r[1]))
            want += [(k, r[1]) for r in members[:n]]
        assert got == sorted(want)


def test_group_consensus_matches_set_rule(spark):
    from fleetlens.operators import aggs
    rnd = random.Random(34)
    rows = [(rnd.randrange(60), rnd.choice(["running", "running", "stopped", None])) for _ in range(300)]
    df = spark.createDataFrame(rows, "k int, s string")
    got = {r.k: r.state for r in aggs.group_consensus(df, "k", "s").collect()}
    want = {}
    for k in {r[0] for r in rows}:
        states = {r[1] for r in rows if r[0] == k}
        want[k] = states.pop() if len(states) == 1 else "inconsistent"
    assert got == want


def test_url_parts_match_urllib(spark):
    """Scheme, authority (netloc) and trailing-slash-trimmed path as Python's
    urlparse gives them."""
    from urllib.parse import urlparse
    rnd = random.Random(5)

    def url():
        return "".join([
            rnd.choice(["http", "https", "s3", "ftp"]), "://",
            rnd.choice(["", "user@", "u:p@"]),
            rnd.choice(["www.apache.org", "archive.apache.org", "mirror.example.com", "10.0.0.1"]),
            rnd.choice(["", ":8080", ":443"]),
            rnd.choice(["", "/", "/dist/spark", "/dist/spark/", "/a/spark-3.5.0-bin-hadoop3.tgz", "/x.tar.gz"]),
            rnd.choice(["", "?action=download", "?a=1&b=2"]),
            rnd.choice(["", "#top"])])

    urls = [url() for _ in range(800)]
    df = spark.createDataFrame(list(enumerate(urls)), "i int, u string")
    got = {r.i: (r.scheme, r.authority, r.path) for r in X.url_parts(df, "u").collect()}
    for i, u in enumerate(urls):
        p = urlparse(u)
        assert got[i] == (p.scheme, p.netloc, p.path.rstrip("/")), u


def test_key_value_lines_match_pair_split(spark):
    """Device listing lines (no spaces inside values) parse like a
    whitespace split into KEY="value" pairs, keys lower-cased."""
    from fleetlens.sources import text
    rnd = random.Random(41)
    lines = []
    for i in range(300):
        pairs = [("KNAME", f"/dev/xvd{chr(97 + rnd.randrange(6))}"),
                 ("MOUNTPOINT", rnd.choice(["", "/", "/media/ephemeral0", "/Mnt/Data"])),
                 ("SIZE", str(rnd.randrange(1, 1 << 41)))]
        rnd.shuffle(pairs)
        lines.append(" ".join(f'{k}="{v}"' for k, v in pairs))
    df = spark.createDataFrame(list(enumerate(lines)), "i int, line string")
    got = {}
    for r in text.read_key_value_lines(df, "line", ["i"]).collect():
        got.setdefault(r.i, {})[r.key] = r.value
    for i, line in enumerate(lines):
        want = {}
        for pair in line.split():
            k, v = pair.split("=")
            want[k.lower()] = v.strip('"')
        assert got[i] == want, line


def test_operation_log_parses_python_logging_lines(spark):
    """Lines written by Python's logging with the fixed layout parse back."""
    import datetime as dt
    import logging
    import time
    from fleetlens.sources import text
    fmt = logging.Formatter("%(asctime)s - fleet.%(module)-9s - %(levelname)-5s - %(message)s")
    fmt.converter = time.gmtime
    rnd = random.Random(42)
    rows, want = [], {}
    for i in range(200):
        created = 1704067200 + rnd.randrange(0, 30 * 86400) + rnd.randrange(0, 1000) / 1000
        host = f"10.0.{rnd.randrange(256)}.{rnd.randrange(256)}"
        msg = rnd.choice([f"[{host}] SSH online.", f"[{host}] Installing Spark...", "Launching 3 instances..."])
        rec = logging.LogRecord("fleet", rnd.choice([logging.DEBUG, logging.INFO, logging.ERROR]),
                                f"/x/{rnd.choice(['ssh', 'core', 'ec2', 'services'])}.py", 1, msg, None, None)
        rec.created, rec.msecs = created, int(round((created % 1) * 1000)) % 1000
        line = fmt.format(rec)
        rows.append((i, line))
        ts = dt.datetime(1970, 1, 1) + dt.timedelta(seconds=int(created), milliseconds=rec.msecs)
        has_host = msg.startswith("[")
        want[i] = (ts, f"fleet.{rec.module}", rec.levelname, host if has_host else None,
                   msg.split("] ", 1)[1] if has_host else msg)
    df = spark.createDataFrame(rows, "i int, line string")
    got = {r.i: (r.ts, r.logger, r.level, r.host, r.message) for r in text.read_operation_log(df, "line").collect()}
    assert got == want


def test_storage_layout_matches_posixpath(spark):
    import posixpath
    rnd = random.Random(51)
    rows = []
    for i in range(300):
        root = rnd.choice(["/media/root", "/media/root/", "/data"])
        eph = [rnd.choice(["/media/ephemeral0", "/media/ephemeral1/", "/mnt/x"]) for _ in range(rnd.randrange(0, 4))]
        rows.append((i, root, eph))
    df = spark.createDataFrame(rows, "i int, root string, eph array<string>")
    got = {r.i: (r.spark_root_ephemeral_dirs, r.hadoop_root_ephemeral_dirs)
           for r in X.storage_layout(df, "root", "eph").collect()}
    for i, root, eph in rows:
        want = []
        for svc in ("spark", "hadoop"):
            dirs = ",".join(posixpath.join(p, svc) for p in eph)
            want.append(dirs if dirs else posixpath.join(root, svc))
        assert got[i] == tuple(want)


def test_decode_payload_matches_base64(spark):
    import base64
    rnd = random.Random(52)
    texts = ["".join(rnd.choice("abcé漢字 \n") for _ in range(rnd.randrange(0, 40))) for _ in range(200)]
    payloads = [base64.b64encode(t.encode()).decode() for t in texts]
    payloads += [base64.b64encode(b"\xff\xfe\xfd").decode(), None]   # not UTF-8, missing
    df = spark.createDataFrame(list(enumerate(payloads)), "i int, p string")
    got = {r.i: r.decoded for r in X.decode_payload(df, "p").collect()}
    for i, t in enumerate(texts):
        assert got[i] == t
    assert got[len(texts)] == "" and got[len(texts) + 1] == ""


def test_capacity_matches_integer_division(spark):
    from fleetlens.operators import aggs
    rnd = random.Random(53)
    rows = [(rnd.choice(["r1", "r2"]), rnd.choice(["c1", "c2", "c3"]), rnd.choice([2, 4, 8, 16, 36]),
             rnd.choice([1, 2, 3, 0])) for _ in range(300)]
    df = spark.createDataFrame(rows, "region string, cluster string, cores int, executors int")
    got = {(r.region, r.cluster): (r.nodes, r.worker_cores, r.executors, r.executor_cores)
           for r in aggs.capacity(df, ["region", "cluster"], "cores", "executors").collect()}
    want = {}
    for region, cluster, cores, ex in rows:
        for key in ((region, cluster), (region, None), (None, None)):
            n, c, e, ec = want.get(key, (0, 0, 0, None))
            q = cores // ex if ex else None              # no executors: no quotient
            want[key] = (n + 1, c + cores, e + ex, (ec or 0) + q if q is not None else ec)
    assert got == want


def _flatten_py(obj, prefix=""):
    """Descend into dicts only, '-' to '_' in keys; leaves keep their value."""
    out = {}
    for k, v in obj.items():
        path = (prefix + "." if prefix else "") + k.replace("-", "_")
        if isinstance(v, dict):
            out.update(_flatten_py(v, path))
        else:
            out[path] = v
    return out


def _leaf_equal(text, value):
    """A string leaf is its raw text; any other leaf is JSON text of an equal
    value (a number may be spelled differently, e.g. 2.0 as 2)."""
    import json
    if value is None or isinstance(value, str):
        return text == value
    return text is not None and json.loads(text) == value


def test_flatten_settings_matches_python(spark):
    import json
    rnd = random.Random(61)

    def value(depth):
        r = rnd.random()
        if depth < 3 and r < 0.3:
            return {rnd.choice(["spot-price", "key-name", "a", "b-c", "d"]) + str(rnd.randrange(3)): value(depth + 1)
                    for _ in range(rnd.randrange(0, 4))}
        return rnd.choice([rnd.randrange(-5, 100), "text-" + str(rnd.randrange(9)), True, None,
                           ["x-y", 1], rnd.randrange(1, 9) / 4])

    docs = []
    for i in range(300):
        doc = {rnd.choice(["java-version", "ec2", "tags", "services", "x"]) + str(j): value(0)
               for j in range(rnd.randrange(1, 5))}
        docs.append((i, json.dumps(doc)))
    df = spark.createDataFrame(docs, "i int, doc string")
    got = {}
    for r in X.flatten_settings(df, "doc", ["i"]).collect():
        got.setdefault(r.i, {})[r.path] = r.value
    for i, text in docs:
        want = _flatten_py(json.loads(text))
        have = got.get(i, {})
        assert set(have) == set(want), text
        assert all(_leaf_equal(have[p], want[p]) for p in want), text


def test_tags_to_map_matches_dict_build(spark):
    rnd = random.Random(71)
    rows = []
    for i in range(300):
        tags = [(rnd.choice(["Name", "role", "env", None]), rnd.choice(["a", "b", None]))
                for _ in range(rnd.randrange(0, 6))]
        rows.append((i, tags))
    df = spark.createDataFrame(rows, "i int, tags array<struct<Key:string, Value:string>>")
    got = {r.i: r.tag_map for r in X.tags_to_map(df, "tags").collect()}
    for i, tags in rows:
        want = {}
        for k, v in tags:       # later duplicates win; NULL keys cannot be map keys
            if k is not None:
                want[k] = v
        assert got[i] == want, tags


def test_read_fields_matches_split(spark):
    from fleetlens.sources import text
    rnd = random.Random(72)
    names = ["device_name", "mount_point", "filesystem_type", "mount_options", "dump", "pass_number"]
    words = ["/dev/xvdb", "/media/ephemeral0", "ext4", "defaults,noatime", "0", "1"]
    lines = [("  " if rnd.random() < 0.2 else "") +
             (" " * rnd.randrange(1, 3)).join(rnd.choice(words) for _ in range(rnd.choice([5, 6, 6, 7])))
             for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(lines)), "i int, l string")
    got = {r.i: r for r in text.read_fields(df, "l", names).collect()}
    for i, line in enumerate(lines):
        parts = line.split()
        if len(parts) == len(names):
            assert got[i].status == "ok" and [got[i][n] for n in names] == parts
        else:
            assert got[i].status == "invalid"


def test_mutually_exclusive_truthiness_across_types(spark):
    from fleetlens.operators import quality
    rnd = random.Random(81)
    rows = [(i, rnd.choice([None, "", "x"]), rnd.choice([None, 0, 5]), rnd.choice([None, False, True]),
             rnd.choice([None, [], ["a"]])) for i in range(400)]
    df = spark.createDataFrame(rows, "i int, s string, n int, b boolean, a array<string>")
    got = {r.i: r.used for r in quality.mutually_exclusive(df, ["i"], ["s", "n", "b", "a"]).collect()}
    want = {}
    for i, *vals in rows:
        used = [name for name, v in zip(["s", "n", "b", "a"], vals) if v]     # Python truthiness
        if len(used) > 1:
            want[i] = ",".join(used)
    assert got == want


def test_fold_outcomes_matches_python(spark):
    import datetime as dt
    from fleetlens.operators import aggs
    rnd = random.Random(82)
    t0 = dt.datetime(2024, 1, 1)
    rows = [(rnd.randrange(20), rnd.randrange(50), rnd.choice([True, True, False, None]),
             t0 + dt.timedelta(seconds=rnd.randrange(0, 100))) for _ in range(400)]
    df = spark.createDataFrame(rows, "op int, host int, ok boolean, finished timestamp_ntz")
    got = {r.op: (r.hosts, r.failures, r.failed, r.first_failed_host)
           for r in aggs.fold_outcomes(df, "op", "host", "ok", "finished").collect()}
    want = {}
    for op in {r[0] for r in rows}:
        rs = [r for r in rows if r[0] == op]
        fails = sorted((r[3], r[1]) for r in rs if not r[2])       # a missing outcome is a failure
        want[op] = (len(rs), len(fails), bool(fails), fails[0][1] if fails else None)
    assert got == want


def test_latest_state_matches_python(spark):
    import datetime as dt
    from fleetlens.operators import windows
    rnd = random.Random(83)
    t0 = dt.datetime(2024, 1, 1)
    rows = [(rnd.randrange(30), t0 + dt.timedelta(minutes=rnd.randrange(0, 50)), i,
             rnd.choice(["running", "stopped", None])) for i in range(500)]
    df = spark.createDataFrame(rows, "m int, ts timestamp_ntz, id int, state string")
    got = {r.m: (r.ts, r.state) for r in windows.latest_state(df, "m", "ts", ["state"], tiebreak="id").collect()}
    want = {}
    for m, ts, i, state in sorted(rows, key=lambda r: (r[1], r[2])):
        want[m] = (ts, state)
    assert got == want


def test_missing_and_new_members_match_set_difference(spark):
    from fleetlens.operators import joins
    rnd = random.Random(84)
    req = [rnd.choice(["c" + str(k) for k in range(40)] + [None]) for _ in range(300)]
    found = [rnd.choice(["c" + str(k) for k in range(25, 60)] + [None]) for _ in range(200)]
    r = spark.createDataFrame([(x,) for x in req], "name string")
    f = spark.createDataFrame([(x,) for x in found], "name string")
    assert sorted(x.name for x in joins.missing_names(r, f, "name").collect()) == \
        sorted({x for x in req if x is not None} - set(found))
    got = sorted(x.name for x in joins.new_members(r, f).collect() if x.name is not None)
    assert got == sorted({x for x in req if x is not None} - set(found))


def test_retry_chains_limits_and_null_outcomes(spark):
    import datetime as dt
    from fleetlens.operators import windows
    rnd = random.Random(91)
    t0 = dt.datetime(2024, 1, 1)
    rows = [(rnd.choice(["h1", "h2"]), t0 + dt.timedelta(minutes=i), i, rnd.choice([True, False, False, None]))
            for i in range(300)]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, id int, ok boolean")
    for limit in (1, 2, 5):
        got = sorted((r.k, r.chain, r.attempts, r.outcome)
                     for r in windows.retry_chains(df, "k", "ts", "id", "ok", limit=limit).collect())
        want = []
        for k in ("h1", "h2"):
            chain, attempts, succeeded = 0, 0, False
            out = []
            for _, _, _, ok in sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2])):
                attempts += 1
                if ok:                                   # a missing outcome is not a success
                    out.append((k, chain, attempts, "succeeded" if attempts <= limit else "late"))
                    chain, attempts = chain + 1, 0
            if attempts:
                out.append((k, chain, attempts, "exhausted" if attempts >= limit else "open"))
            want += out
        assert got == sorted(want), limit


def test_duration_summary_matches_truncation(spark):
    import datetime as dt
    from fleetlens.operators import aggs
    rnd = random.Random(92)
    t0 = dt.datetime(2024, 1, 1)
    rows = []
    for _ in range(300):
        s = t0 + dt.timedelta(microseconds=rnd.randrange(0, 10 ** 9))
        rows.append((rnd.choice(["launch", "stop"]), s, s + dt.timedelta(microseconds=rnd.randrange(0, 10 ** 8)),
                     rnd.choice([True, True, False])))
    df = spark.createDataFrame(rows, "op string, s timestamp_ntz, e timestamp_ntz, ok boolean")
    got = {r.op: (r.ops, r.min_seconds, r.max_seconds, r.total_seconds)
           for r in aggs.duration_summary(df, "op", "s", "e", "ok").collect()}
    want = {}
    for op in ("launch", "stop"):
        secs = [int((e.replace(microsecond=0) - s.replace(microsecond=0)).total_seconds())
                for o, s, e, ok in rows if o == op and ok]
        want[op] = (len(secs), min(secs), max(secs), sum(secs))
    assert got == want


def test_all_reached_matches_python(spark):
    from fleetlens.operators import aggs
    rnd = random.Random(93)
    rows = [(rnd.randrange(25), i, rnd.choice(["running", "running", "pending", None])) for i in range(400)]
    df = spark.createDataFrame(rows, "c int, id int, s string")
    got = {r.c: (r.members, r.laggards, r.all_reached, r.sample_laggards)
           for r in aggs.all_reached(df, "c", "s", "running", "id").collect()}
    want = {}
    for c in {r[0] for r in rows}:
        rs = [r for r in rows if r[0] == c]
        lag = sorted(r[1] for r in rs if r[2] != "running")     # missing state is a laggard
        want[c] = (len(rs), len(lag), not lag, lag[:3])
    assert got == want


def test_in_use_and_dedupe_match_python(spark):
    from fleetlens.operators import joins
    rnd = random.Random(94)
    mounts = [(i, rnd.choice(["/dev/a", "/dev/b", "/dev/c", None])) for i in range(300)]
    devices = [(d,) for d in ("/dev/a", "/dev/c", None)]
    m = spark.createDataFrame(mounts, "i int, dev string")
    d = spark.createDataFrame(devices, "dev string")
    got = sorted(r.i for r in joins.in_use(m, d, "dev").collect())
    assert got == sorted(i for i, dev in mounts if dev in ("/dev/a", "/dev/c"))   # NULL never matches

    rules = [(rnd.choice(["tcp", "udp"]), rnd.choice([22, 80]), rnd.randrange(1000), i) for i in range(300)]
    r = spark.createDataFrame(rules, "proto string, port int, added int, seq int")
    got = {(x.proto, x.port): (x.copies, x.added, x.seq)
           for x in joins.dedupe_rules(r, ["proto", "port"], keep_first_by=["added", "seq"],
                                       carry=["added", "seq"]).collect()}
    want = {}
    for proto, port, added, seq in sorted(rules, key=lambda t: (t[2], t[3])):
        key = (proto, port)
        if key not in want:
            want[key] = [0, added, seq]
        want[key][0] += 1
    assert got == {k: tuple(v) for k, v in want.items()}


def test_runtime_compliance_counts_match_python(spark):
    rnd = random.Random(95)
    banners = ['openjdk version "1.8.0_252"', 'openjdk version "11.0.7" 2020-04-14', 'java version "17"',
               "command not found", 'openjdk version "21.0.1"']
    rows = [(rnd.choice(["c1", "c2", "c3"]), rnd.choice(banners)) for _ in range(300)]
    df = spark.createDataFrame(rows, "cluster string, banner string")
    got = {r.cluster: (r.n_equal, r.n_newer, r.n_older, r.n_missing)
           for r in X.runtime_compliance(df, "banner", "cluster", 11).collect()}
    major = {banners[0]: 8, banners[1]: 11, banners[2]: 17, banners[3]: None, banners[4]: 21}
    want = {}
    for c, b in rows:
        e, n, o, m = want.get(c, (0, 0, 0, 0))
        j = major[b]
        want[c] = (e + (j == 11), n + (j is not None and j > 11), o + (j is not None and j < 11), m + (j is None))
    assert got == want


def test_role_counts_at_most_one_distinct_and_transfer(spark):
    from pyspark.sql import functions as F
    from fleetlens.operators import aggs, filters, quality
    rnd = random.Random(96)
    rows = [(rnd.randrange(15), rnd.choice(["master", "slave", "slave", "witch", None]), f"h{rnd.randrange(40)}")
            for _ in range(300)]
    df = spark.createDataFrame(rows, "c int, role string, host string")
    got = {r.c: (r.masters, r.slaves, r.nodes) for r in aggs.role_counts(df, "c", "role").collect()}
    want = {}
    for c, role, _ in rows:
        m, s, n = want.get(c, (0, 0, 0))
        want[c] = (m + (role == "master"), s + (role == "slave"), n + (role in ("master", "slave")))
    assert got == want
    got = {r.c: r.matches for r in quality.at_most_one(df, "c", F.col("role") == "master").collect()}
    assert got == {c: v[0] for c, v in want.items() if v[0] > 1}
    assert sorted(r.name for r in aggs.distinct_names(df, "host").collect()) == sorted({h for _, _, h in rows})

    files = [(rnd.randrange(10), rnd.randrange(1, 5000)) for _ in range(200)]
    nodes = [(rnd.randrange(10), f"n{rnd.randrange(6)}") for _ in range(200)]
    f = spark.createDataFrame(files, "c int, size long")
    n = spark.createDataFrame(nodes, "c int, node string")
    got = {r.c: r.transfer_bytes for r in filters.transfer_warning(f, n, "c", "size", "node", limit=40000).collect()}
    totals = {}
    for c, size in files:
        totals[c] = totals.get(c, 0) + size
    counts = {c: len({x for cc, x in nodes if cc == c}) for c in {c for c, _ in nodes}}
    assert got == {c: t * counts[c] for c, t in totals.items() if c in counts and t * counts[c] > 40000}


def test_address_failures_volume_and_paths(spark):
    from fleetlens.operators import filters
    from fleetlens.sources import text
    rnd = random.Random(97)
    rows = [(i, rnd.choice([True, False, None]), f"10.0.0.{i}", f"54.0.0.{i}", f"ip-{i}", f"ec2-{i}") for i in range(100)]
    df = spark.createDataFrame(rows, "i int, private boolean, pip string, qip string, ph string, qh string")
    got = {r.i: (r.ip, r.host) for r in filters.choose_address(df, "private", "pip", "qip", "ph", "qh").collect()}
    assert got == {i: ((pip, ph) if p else (qip, qh)) for i, p, pip, qip, ph, qh in rows}

    kinds = [rnd.choice([k for k, _, _ in X.FAILURE_KINDS] + ["disk-full", None]) for _ in range(200)]
    fdf = spark.createDataFrame(list(enumerate(kinds)), "i int, kind string")
    table = {k: (a, c) for k, a, c in X.FAILURE_KINDS}
    got = {r.i: (r.action, r.exit_code) for r in X.classify_failures(fdf, "kind").collect()}
    assert got == {i: table.get(k, X.UNKNOWN_FAILURE) for i, k in enumerate(kinds)}

    vols = [(i, rnd.choice([1, 8, 30, 100]), rnd.choice(["standard", "io1"]), True) for i in range(100)]
    vdf = spark.createDataFrame([(i, (s, t, e)) for i, s, t, e in vols],
                                "i int, ebs struct<VolumeSize:int, VolumeType:string, Encrypted:boolean>")
    got = {r.i: tuple(r.ebs) for r in X.raise_volume_floor(vdf, "ebs", 30).collect()}
    assert got == {i: ((30, "gp2") if s < 30 else (s, t)) for i, s, t, _ in vols}

    paths = [rnd.choice(["s3://b/k", "s3n://b/k", "s3a://b/k", "hdfs://nn/p", "/local/p"]) for _ in range(100)]
    pdf = spark.createDataFrame(list(enumerate(paths)), "i int, p string")
    got = {r.i: r.p for r in text.normalize_object_paths(pdf, "p").collect()}
    assert got == {i: ("s3a://" + p.split("://", 1)[1] if p.startswith(("s3://", "s3n://")) else p)
                   for i, p in enumerate(paths)}


def test_ordering_and_filters_match_python(spark):
    from pyspark.sql import functions as F
    from fleetlens.operators import filters
    rnd = random.Random(98)
    rows = [(i, f"c{rnd.randrange(50):02d}", rnd.choice(["running", "stopped", "terminated"]),
             rnd.randrange(-100, 100)) for i in range(200)]
    df = spark.createDataFrame(rows, "i int, name string, state string, bal int")
    assert [r.name for r in filters.order_by_name(df, "name").collect()] == sorted(r[1] for r in rows)
    first = [(r.bal, r.i) for r in filters.sample_first(df, 7, ["bal", "i"]).collect()]
    assert first == sorted((r[3], r[0]) for r in rows)[:7]
    got = sorted(r.i for r in filters.inventory_filter(
        df, equals={"state": "running"}, any_of={"name": ["c01", "c02", "c03"], "bal": []}).collect())
    assert got == sorted(r[0] for r in rows if r[2] == "running" and r[1] in ("c01", "c02", "c03"))
    tagged = df.withColumn("tags", F.create_map(F.lit("state"), F.col("state")))
    got = sorted(r.i for r in filters.tag_filter(tagged, "tags", "state", ["stopped"]).collect())
    assert got == sorted(r[0] for r in rows if r[2] == "stopped")


def test_manifest_round_trip_random(spark):
    from fleetlens.sources import manifests
    rnd = random.Random(99)
    rows = []
    for c in range(40):
        java = rnd.choice([8, 11, 17])
        for svc in rnd.sample(["HDFS", "Spark", "Hive"], rnd.randrange(1, 4)):
            for _ in range(rnd.randrange(1, 3)):                 # repeated service rows fold into one
                rows.append((f"c{c}", svc, rnd.choice(["3.3.6", "3.5.0", None]), java))
    df = spark.createDataFrame(rows, "cluster string, service string, version string, java int")
    docs = manifests.write_manifests(df, "cluster", "service", ["version"], "java")
    back = manifests.read_manifests(docs, "manifest", ["cluster"]).collect()
    got = {(r.cluster, r.service): (r.version, r.java_version) for r in back}
    want = {}
    for c, svc, ver, java in rows:        # the writer keeps the greatest settings text per service
        prev = want.get((c, svc))
        text = '{"version":' + ('null' if ver is None else '"' + ver + '"') + '}'
        if prev is None or text > prev[0]:
            want[(c, svc)] = (text, ver, java)
    assert got == {k: (v[1], v[2]) for k, v in want.items()}
