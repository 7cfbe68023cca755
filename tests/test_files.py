"""Sources and sinks through real files: text logs in, manifests and
reports out (written under a fresh temporary folder)."""

import os
import tempfile

from fleetlens.sources import manifests, report, text


def test_operation_log_from_text_files(spark):
    folder = tempfile.mkdtemp(prefix="fleetlens-test-logs-")
    lines = ["2024-01-01 00:00:07,179 - fleet.ssh       - DEBUG - [10.0.0.8] SSH timeout.",
             "2024-01-01 00:00:09,001 - fleet.core      - INFO  - [10.0.0.9] Spark online.",
             "not a log line"]
    with open(os.path.join(folder, "part-0.log"), "w") as f:
        f.write("\n".join(lines) + "\n")
    df = text.read_operation_log(text.read_lines(spark, folder), "value")
    got = sorted((r.status, r.level, r.host) for r in df.collect())
    assert got == [("invalid", None, None), ("ok", "DEBUG", "10.0.0.8"), ("ok", "INFO", "10.0.0.9")]


def test_manifest_and_report_sinks(spark):
    out = tempfile.mkdtemp(prefix="fleetlens-test-sinks-")
    rows = spark.createDataFrame([("c1", "HDFS", "3.3.6", 11), ("c2", "Spark", "3.5.0", 17)],
                                 "cluster string, service string, version string, java int")
    manifests.write_manifests(rows, "cluster", "service", ["version"], "java",
                              path=os.path.join(out, "manifests"))
    written = sorted(r.value for r in spark.read.text(os.path.join(out, "manifests")).collect())
    assert written[0].startswith("c1\t{") and written[1].startswith("c2\t{")

    nodes = spark.createDataFrame([("c1", "running", "master", "m1"), ("c1", "running", "slave", "s2"),
                                   ("c1", "running", "slave", "s1"), ("c2", "stopped", "slave", "x")],
                                  "cluster string, state string, role string, host string")
    report.fleet_report(nodes, "cluster", "state", "role", "host", path=os.path.join(out, "report"))
    files = sorted(os.path.join(root, f) for root, _, fs in os.walk(os.path.join(out, "report"))
                   for f in fs if f.startswith("part-"))
    doc = "".join(open(f).read() for f in files)  # part files in (cluster, chunk) order
    assert "c1:\n  state: running\n  node-count: 3\n  master: m1\n  slaves:\n    - s1\n    - s2" in doc
    assert "c2:\n  state: stopped\n  node-count: 1" in doc
