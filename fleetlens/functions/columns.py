"""Column jobs: parse, classify and normalize per-row fleet values.

All of these are native Catalyst expressions (no Python UDF), so they
stay inside whole-stage codegen and run as narrow transformations; the
jobs that report per-cluster counts add one partial aggregate. Bad input
never fails the job: it is kept with ``status = 'invalid'`` so it can be
routed to a quarantine output.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.session import materialize

# ---------------------------------------------------------------- X1 versions

HEX40 = "^[0-9a-f]{40}$"

# Hadoop build of Spark by Hadoop version, as (lower bound
# inclusive, build): below 2.7, from 2.7 below 3.0, from 3.0.
HADOOP_BUILDS = (((0, 0), "hadoop2.6"), ((2, 7), "hadoop2.7"), ((3, 0), "hadoop3.2"))


def version_key(col: str) -> Column:
    """'3.5.0' -> [3, 5, 0]; a part that is not an integer becomes NULL."""
    return F.transform(F.split(F.col(col), r"\."), lambda x: x.try_cast("int"))


def version_audit(df: DataFrame, col: str) -> DataFrame:
    """Version text to a comparable key, ``major.minor`` and Hadoop build class.

    ``status``: ``empty``, ``commit`` (a 40-hex git commit), ``release`` or
    ``invalid`` (a non-numeric part; quarantined rather than raised).
    Build class compares the integer key element-wise, like tuples:
    below 2.7 -> hadoop2.6, 2.7 up to 3.0 -> hadoop2.7, 3.0 on -> hadoop3.2.
    """
    v = F.col(col)
    key = version_key(col)
    numeric = ~F.exists(key, lambda x: x.isNull())
    status = (F.when(v.isNull() | (v == ""), F.lit("empty"))
              .when(v.rlike(HEX40), F.lit("commit"))
              .when(numeric, F.lit("release"))
              .otherwise(F.lit("invalid")))
    short = F.when(F.instr(v, ".") > 0, F.substring_index(v, ".", 2)).otherwise(v)
    build = F.lit(HADOOP_BUILDS[0][1])
    for (major, minor), name in HADOOP_BUILDS[1:]:
        build = F.when(key >= F.array(F.lit(major), F.lit(minor)), F.lit(name)).otherwise(build)
    return (df.withColumn("status", status)
            .withColumn("version_key", F.when(F.col("status") == "release", key))
            .withColumn("short_version", F.when(F.col("status") != "empty", short))
            .withColumn("hadoop_build", F.when(F.col("status") == "release", build)))


# ------------------------------------------------------------- X2 Java banner

def java_major(col: str) -> Column:
    """Major Java version from a ``java -version`` first line.

    The third whitespace token, quotes stripped, split on dots: ``1.x``
    is x (Java 8 and before), otherwise the first part. A bare ``"17"``
    is 17. Anything else is NULL (missing).
    """
    tokens = F.split(F.regexp_replace(F.col(col), r"^\s+|\s+$", ""), r"\s+")
    raw = F.when(F.size(tokens) >= 3, F.regexp_replace(F.get(tokens, 2), '^"+|"+$', ""))
    parts = F.split(raw, r"\.")
    major = F.when(F.get(parts, 0) == "1", F.get(parts, 1)).otherwise(F.get(parts, 0))
    return F.when(F.size(parts) >= 2, major).otherwise(F.get(parts, 0)).try_cast("int")


def runtime_compliance(df: DataFrame, banner_col: str, cluster_col: str, required: int) -> DataFrame:
    """Per cluster: members whose Java is equal to, newer or older than
    ``required``, or missing."""
    j = java_major(banner_col)
    cls = (F.when(j.isNull(), F.lit("missing")).when(j == required, F.lit("equal"))
           .when(j > required, F.lit("newer")).otherwise(F.lit("older")))
    c = df.withColumn("java_class", cls)
    return c.groupBy(cluster_col).agg(
        *[F.count_if(F.col("java_class") == k).alias(f"n_{k}") for k in ("equal", "newer", "older", "missing")])


# ------------------------------------------------------------------ X3 tags

_WS_TRIM = r"^\s+|\s+$"


def ingest_tags(df: DataFrame, col: str) -> DataFrame:
    """``Key,Value`` text to (tag_key, tag_value).

    Exactly one comma; both sides trimmed; the key may not be blank, the
    value may. Anything else gets ``status = 'invalid'`` and NULL key/value.
    """
    raw = F.col(col)
    commas = F.size(F.split(raw, ",", -1)) - 1
    key = F.regexp_replace(F.substring_index(raw, ",", 1), _WS_TRIM, "")
    value = F.regexp_replace(F.substring_index(raw, ",", -1), _WS_TRIM, "")
    ok = raw.isNotNull() & (commas == 1) & (key != "")
    return (df.withColumn("status", F.when(ok, F.lit("ok")).otherwise(F.lit("invalid")))
            .withColumn("tag_key", F.when(ok, key))
            .withColumn("tag_value", F.when(ok, value)))


def tags_to_map(df: DataFrame, tags_col: str, out: str = "tag_map") -> DataFrame:
    """ARRAY<STRUCT<Key, Value>> to MAP; on a repeated key the last one wins.

    Duplicates are removed inside the array before building the map, so
    the session's duplicate-key policy is irrelevant.
    """
    entries = F.transform(F.col(tags_col), lambda x, i: F.struct(
        x["Key"].alias("k"), x["Value"].alias("v"), i.alias("i")))
    # Null-safe comparison: a NULL key elsewhere in the array must not turn
    # the "later duplicate exists" test into NULL (three-valued logic).
    keep = F.filter(entries, lambda e: e["k"].isNotNull() & ~F.exists(
        entries, lambda o: o["k"].eqNullSafe(e["k"]) & (o["i"] > e["i"])))
    return df.withColumn(out, F.map_from_entries(
        F.transform(keep, lambda e: F.struct(e["k"], e["v"]))))


# ------------------------------------------------------- X5 CIDR / group ids

_MAX = (1 << 32) - 1
# Mask address (as an integer) -> prefix length, for the dotted forms
# "/255.255.0.0" (netmask) and "/0.0.255.255" (hostmask). Built by rule.
NETMASKS = {(_MAX << (32 - n)) & _MAX: n for n in range(33)}
HOSTMASKS = {(1 << (32 - n)) - 1: n for n in range(33)}


def _map_literal(d: dict) -> Column:
    items = []
    for k, v in sorted(d.items()):
        items += [F.lit(k).cast("bigint"), F.lit(v)]
    return F.create_map(*items)


_OCT = "(0|[1-9][0-9]{0,2})"
_IPV4_RE = rf"^{_OCT}\.{_OCT}\.{_OCT}\.{_OCT}$"


def ipv4_octets(text: Column) -> Column:
    """The four octet strings of a well-formed dotted IPv4 text (no leading
    zeros, at most 3 digits each), else NULL."""
    return F.when(text.rlike(_IPV4_RE), F.split(text, r"\."))


def ipv4_value(octets: Column) -> Column:
    """Integer value of ``ipv4_octets`` output; NULL if an octet is over 255.
    Pass a column (not an expression) so the split is computed once."""
    o = [F.get(octets, i).cast("bigint") for i in range(4)]
    in_range = (o[0] <= 255) & (o[1] <= 255) & (o[2] <= 255) & (o[3] <= 255)
    return F.when(in_range, ((o[0] * 256 + o[1]) * 256 + o[2]) * 256 + o[3])


def ipv4_int(text: Column) -> Column:
    """Dotted IPv4 text to an integer; NULL if malformed (not 4 parts,
    leading zeros, an octet over 255)."""
    return ipv4_value(ipv4_octets(text))


def ingest_sources(df: DataFrame, col: str) -> DataFrame:
    """Classify access sources: ``sg-...`` security group, IPv4 network, or invalid.

    A network is ``a.b.c.d[/len]``; no length means /32; the length may be
    a number 0-32 or a dotted netmask or hostmask. Host bits set, octets
    with leading zeros or over 255 are invalid. Output: ``kind``,
    ``source_value`` (group id or normalized CIDR), ``prefix_len``,
    ``net_start``, ``net_end``.

    The parse is staged in columns (split, octets, value, length, host
    bits), each computed once per row; this keeps every projection small
    enough for whole-stage code generation.
    """
    s = F.col(col)
    out = df.withColumn("_h", F.split(s, "/", -1))
    out = (out.withColumn("_ao", ipv4_octets(F.get(F.col("_h"), 0)))
              .withColumn("_mo", ipv4_octets(F.get(F.col("_h"), 1))))
    out = (out.withColumn("_addr", ipv4_value(F.col("_ao")))
              .withColumn("_mask", ipv4_value(F.col("_mo"))))
    pfx = F.get(F.col("_h"), 1)
    plen = (F.when(F.size("_h") == 1, F.lit(32))
            .when(pfx.rlike("^[0-9]+$"),
                  F.when(pfx.try_cast("int") <= 32, pfx.try_cast("int")))
            .otherwise(F.coalesce(F.try_element_at(_map_literal(NETMASKS), F.col("_mask")),
                                  F.try_element_at(_map_literal(HOSTMASKS), F.col("_mask")))))
    out = out.withColumn("_plen", plen)
    out = out.withColumn("_hb", F.pow(F.lit(2), 32 - F.col("_plen")).cast("bigint") - 1)
    addr, hb = F.col("_addr"), F.col("_hb")
    valid_net = (F.size("_h") <= 2) & addr.isNotNull() & F.col("_plen").isNotNull() & \
        (addr.bitwiseAND(hb) == 0)
    out = out.withColumn("kind", F.when(s.startswith("sg-"), F.lit("group"))
                         .when(F.coalesce(valid_net, F.lit(False)), F.lit("cidr"))
                         .otherwise(F.lit("invalid")))
    is_cidr = F.col("kind") == "cidr"
    dotted = F.concat_ws(".", *[(F.shiftright(addr, sh).bitwiseAND(255)).cast("string")
                                for sh in (24, 16, 8, 0)])
    return (out.withColumn("prefix_len", F.when(is_cidr, F.col("_plen")))
            .withColumn("net_start", F.when(is_cidr, addr))
            .withColumn("net_end", F.when(is_cidr, addr + hb))
            .withColumn("source_value",
                        F.when(F.col("kind") == "group", s)
                        .when(is_cidr, F.concat(dotted, F.lit("/"), F.col("_plen").cast("string"))))
            .drop("_h", "_ao", "_mo", "_addr", "_mask", "_plen", "_hb"))


# ------------------------------------------------------------------ X6 URLs

# A download URL ending in one of these names a file, not a folder.
ARCHIVE_SUFFIXES = (".gz", ".tgz")


def url_parts(df: DataFrame, col: str) -> DataFrame:
    """Scheme, authority (netloc), path with trailing ``/`` trimmed, and
    whether the URL names an archive file rather than a directory."""
    u = F.col(col)
    path = F.try_parse_url(u, F.lit("PATH"))
    return df.withColumns({
        "scheme": F.try_parse_url(u, F.lit("PROTOCOL")),
        "authority": F.try_parse_url(u, F.lit("AUTHORITY")),
        "path": F.regexp_replace(path, "/+$", ""),
        "is_archive": F.lower(path).endswith(ARCHIVE_SUFFIXES[0]) | F.lower(path).endswith(ARCHIVE_SUFFIXES[1]),
        "trailing_slash": path.endswith("/"),
    })


def url_inventory(df: DataFrame, col: str) -> DataFrame:
    """Counts per URL authority."""
    p = url_parts(df, col)
    return p.groupBy("authority").agg(
        F.count(F.lit(1)).alias("urls"),
        F.count_if(F.col("scheme") == "https").alias("https_urls"),
        F.count_if(F.col("trailing_slash")).alias("trailing_slash_urls"),
        F.count_if(F.col("is_archive")).alias("archive_urls"))


# ------------------------------------------------------- X7 nested settings

def flatten_settings(df: DataFrame, col: str, id_cols: Sequence[str], max_depth: int | None = None,
                     sep: str = ".") -> DataFrame:
    """Nested JSON settings to (path, value) rows, to any depth.

    Objects are descended into (``-`` becomes ``_`` in keys only); any
    other value (string, number, boolean, list) is a leaf, rendered as
    text: strings raw, everything else as JSON of the same value (a number
    may be respelled, e.g. ``2.0`` as ``2``); JSON null is NULL. An empty object yields no row; text that
    is not JSON yields no row. ``status`` is ``ok``.

    The descent is a frontier loop: each round opens every object left by
    one level (one ``explode_outer``, no exchange), writes the children once
    to the checkpoint folder, and goes on with those that are objects
    themselves. So the rounds are as many as the deepest document has
    levels, however deep, and a round costs what is left at its level; the
    driver reads one flag a round. With ``max_depth`` the loop stops there, and an
    object below it is one row, whole as JSON, with status ``too-deep``.
    """
    def norm(k):
        return F.replace(k, F.lit("-"), F.lit("_"))

    def text(v):
        return F.try_variant_get(v, "$", "string")

    doc = F.try_parse_json(F.col(col))
    cur = df.select(*id_cols, F.lit("").alias("_path"), doc.alias("_v")).filter(F.col("_v").isNotNull())
    cur = cur.withColumn("_obj", F.try_variant_get("_v", "$", "map<string,variant>"))
    found = []
    level = 0
    while max_depth is None or level < max_depth:
        # a leaf passes through as the outer row (only whole documents that are no objects do)
        step = cur.select(*id_cols, "_path", "_v", F.col("_obj").isNull().alias("_leaf"), F.explode_outer("_obj").alias("_k", "_c"))
        child = F.when(F.col("_path") == "", norm(F.col("_k"))).otherwise(F.concat(F.col("_path"), F.lit(sep), norm(F.col("_k"))))
        leaf = F.col("_leaf")
        step = (step.filter(leaf | F.col("_k").isNotNull())
                .select(*id_cols, F.when(leaf, F.col("_path")).otherwise(child).alias("_path"), F.when(leaf, F.col("_v")).otherwise(F.col("_c")).alias("_v"))
                .withColumn("_obj", F.try_variant_get("_v", "$", "map<string,variant>")))
        opened = F.col("_obj").isNotNull()
        done = materialize(step.select(*id_cols, "_path", F.when(~opened, text(F.col("_v"))).alias("_value"),
                                       F.when(opened, F.col("_v")).alias("_node")), "settings")
        found.append(done.filter("_node is null").select(*id_cols, F.col("_path").alias("path"), F.col("_value").alias("value"),
                                                         F.lit("ok").alias("status")))
        rest = done.filter("_node is not null")
        level += 1
        if rest.isEmpty():
            break
        cur = rest.select(*id_cols, "_path", F.col("_node").alias("_v"))
        if level == max_depth:
            found.append(cur.select(*id_cols, F.col("_path").alias("path"), text(F.col("_v")).alias("value"),
                                    F.lit("too-deep").alias("status")))
        cur = cur.withColumn("_obj", F.try_variant_get("_v", "$", "map<string,variant>"))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


# Settings sections. ``services.<name>.<key>`` becomes
# ``<name>_<key>``, ``providers.ec2.<key>`` becomes ``ec2_<key>`` and
# ``launch.<key>`` keeps its key. The command ``launch`` takes all three, the
# other commands take the provider's settings only.
PROVIDER = "ec2"
LAUNCH = "launch"
OTHER_COMMANDS = ("describe", "destroy", "login", "start", "stop", "add-slaves", "remove-slaves",
                  "run-command", "copy-file")


def command_defaults(df: DataFrame, col: str, id_cols: Sequence[str]) -> DataFrame:
    """Per-command option defaults of a settings document: ``id..., command, option, value``.

    Keys below an option's name stay part of its value (as JSON). Where two
    sections give ``launch`` one option, a service's value is taken before
    the provider's and the provider's before launch's own. Empty sections
    give nothing; a document that is not JSON gives no row. Each row of
    ``df`` is a document of its own: its options are resolved inside the row
    and exploded, so nothing is shuffled.
    """
    def norm(k):
        return F.replace(k, F.lit("-"), F.lit("_"))

    none = F.array().cast("array<struct<option:string,value:string>>")

    def options(entries, prefix):
        """Of a section's entries, in order."""
        return F.coalesce(F.transform(F.map_entries(entries), lambda e: F.struct(
            F.concat(prefix, norm(e["key"])).alias("option"), F.try_variant_get(e["value"], "$", "string").alias("value"))), none)

    def resolved(options_col: str):
        """One entry per option, the last one of each. Rows without a repeated option pass as they are."""
        entries = F.col(options_col)
        names, values = F.reverse(entries["option"]), F.reverse(entries["value"])
        last = F.transform(F.array_distinct(names), lambda k: F.struct(
            k.alias("option"), F.get(values, F.array_position(names, k).cast("int") - 1).alias("value")))
        return F.when(F.size(F.array_distinct(names)) < F.size(names), last).otherwise(entries)

    sections = df.select(*id_cols, F.try_variant_get(F.try_parse_json(F.col(col)), "$", f"struct<{LAUNCH}:map<string,variant>,"
                         f"providers:struct<{PROVIDER}:map<string,variant>>,services:map<string,map<string,variant>>>").alias("_s"))
    listed = sections.select(
        *id_cols, options(F.col("_s")[LAUNCH], F.lit("")).alias("_launch"),
        options(F.col("_s")["providers"][PROVIDER], F.lit(PROVIDER + "_")).alias("_provider"),
        F.flatten(F.coalesce(F.transform(F.map_entries(F.col("_s")["services"]), lambda s: options(
            s["value"], F.concat(norm(s["key"]), F.lit("_")))), F.array(none))).alias("_services"))
    ranked = listed.select(*id_cols, F.concat("_launch", "_provider", "_services").alias("_all"), "_provider")
    own = ranked.select(*id_cols, F.explode(F.array(
        F.struct(F.lit(False).alias("shared"), resolved("_all").alias("options")),
        F.struct(F.lit(True).alias("shared"), resolved("_provider").alias("options")))).alias("_s"))
    commands = F.when(F.col("shared"), F.array(*[F.lit(c) for c in OTHER_COMMANDS])).otherwise(F.array(F.lit(LAUNCH)))
    return (own.select(*id_cols, "_s.shared", F.explode("_s.options").alias("_o"))
            .select(*id_cols, F.explode(commands).alias("command"), "_o.option", "_o.value"))


# ------------------------------------------------------- X8 storage layout

def _join_path(base: Column, leaf: str) -> Column:
    return F.when(base.endswith("/"), F.concat(base, F.lit(leaf))).otherwise(
        F.concat(base, F.lit("/" + leaf)))


def storage_layout(df: DataFrame, root_col: str, ephemeral_col: str,
                   services: Sequence[str] = ("spark", "hadoop")) -> DataFrame:
    """Per service: ephemeral dirs joined with commas, the root dir, and the
    dirs to use: the ephemeral ones, or the root dir when there are none."""
    out = df
    for svc in services:
        eph = F.array_join(F.transform(F.col(ephemeral_col), lambda p: _join_path(p, svc)), ",")
        root = _join_path(F.col(root_col), svc)
        out = out.withColumns({
            f"{svc}_ephemeral_dirs": F.coalesce(eph, F.lit("")),
            f"{svc}_root_dir": root,
            f"{svc}_root_ephemeral_dirs": F.when(F.coalesce(eph, F.lit("")) == "", root).otherwise(eph),
        })
    return out


# --------------------------------------------------- X9 failure classification

# Failure kind -> (action, exit code). Connection refused,
# timeouts and authentication failures are retried; other SSH errors are
# fatal. Exit codes: 0 nothing to do, 2 usage error, 1 any other error.
FAILURE_KINDS = (
    ("timeout", "retry", 1),
    ("connection-refused", "retry", 1),
    ("authentication", "retry", 1),
    ("connection-error", "fatal", 1),
    ("ssh-protocol", "fatal", 1),
    ("cluster-not-found", "fatal", 1),
    ("cluster-invalid-state", "fatal", 1),
    ("nothing-to-do", "none", 0),
    ("usage", "fatal", 2),
    ("unsupported-provider", "fatal", 2),
)
UNKNOWN_FAILURE = ("fatal", 1)


def classify_failures(df: DataFrame, kind_col: str) -> DataFrame:
    """Attach action and exit code to each failure; unknown kinds are fatal (1).

    The mapping is a fixed literal table of ten rows, broadcast.
    """
    spark = df.sparkSession
    mapping = F.broadcast(spark.createDataFrame(
        list(FAILURE_KINDS), "_kind string, action string, exit_code int"))
    j = df.join(mapping, F.col(kind_col) == F.col("_kind"), "left").drop("_kind")
    return (j.withColumn("action", F.coalesce(F.col("action"), F.lit(UNKNOWN_FAILURE[0])))
            .withColumn("exit_code", F.coalesce(F.col("exit_code"), F.lit(UNKNOWN_FAILURE[1]))))


def failure_counts(df: DataFrame, kind_col: str) -> DataFrame:
    c = classify_failures(df, kind_col)
    return c.groupBy(kind_col, "action", "exit_code").agg(F.count(F.lit(1)).alias("failures"))


# --------------------------------------------------------- X10 root volume

def raise_volume_floor(df: DataFrame, col: str, min_size: int, volume_type: str = "gp2",
                       size_field: str = "VolumeSize", type_field: str = "VolumeType",
                       drop_field: str = "Encrypted") -> DataFrame:
    """Raise a nested volume size to ``min_size`` (and set its type when
    raised), and drop one field, without unpacking the struct."""
    s = F.col(col)
    small = F.coalesce(s[size_field] < F.lit(min_size), F.lit(True))  # an unknown size is raised too
    new = (s.withField(type_field, F.when(small, F.lit(volume_type)).otherwise(s[type_field]))
            .withField(size_field, F.greatest(s[size_field], F.lit(min_size))))
    if drop_field:
        new = new.dropFields(drop_field)
    return df.withColumn(col, new)


# ----------------------------------------------------------- X11 payloads

def decode_payload(df: DataFrame, col: str, out: str = "decoded") -> DataFrame:
    """Base64 payload to UTF-8 text; missing or undecodable is ''."""
    raw = F.try_to_binary(F.col(col), F.lit("base64"))
    return df.withColumn(out, F.coalesce(F.try_validate_utf8(raw.cast("string")), F.lit("")))
