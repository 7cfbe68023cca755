"""Log files as a batch and a streaming source, and row functions until the first failure."""

import os
import random

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import rowmap
from fleetlens.sources import log_files
from fleetlens.streaming import streams


def line(i, text):
    return f"2024-01-{1 + i % 28:02d} 10:00:{i % 60:02d},{i % 1000:03d} - fleet.core      - INFO  - [h{i}] {text}"


def some_messages(rnd, n):
    return [line(i, f"m{i}") + "".join("\n" + rnd.choice(["", "  more", "2024-x", "2024-01-01 10:00", "é" * rnd.randrange(40)])
                                       for _ in range(rnd.choice([0, 0, 1, 3]))) for i in range(n)]


def test_blocks_of_any_size_give_whole_messages(tmp_path, monkeypatch):
    rnd = random.Random(1)
    for k in range(60):
        ms = some_messages(rnd, rnd.randrange(0, 20))
        before = rnd.choice(["", "no message\nyet\n"])
        text = before + "\n".join(ms) + rnd.choice(["", "\n"]) * bool(ms)
        path = tmp_path / f"{k}.log"
        path.write_text(text)
        want = [before.rstrip("\n")] * bool(before) + [m.rstrip("\r\n") for m in ms]
        for block in (1, 7, 26, 64, 1000, 1 << 20):
            for step in (5, 33, 1 << 20):
                monkeypatch.setattr(log_files, "STEP", step)
                blocks = [b for b in log_files._blocks([(str(path), 0, path.stat().st_size)], block) if b.file]
                got = sorted((x for b in blocks for x in log_files.messages(b)), key=lambda x: x[1])
                assert [g[2] for g in got] == want, (block, step)
                assert all(g[1] == len(text.encode()) or text.encode()[g[1]:].startswith(g[2].encode()) for g in got)


def rows(df):
    return sorted((os.path.basename(r.file), r.start, r.status, r.host, r.message) for r in df.collect())


def test_batch_and_stream_give_one_table_and_a_restart_goes_on(spark, tmp_path):
    rnd = random.Random(2)
    src, out, ckpt = (str(tmp_path / x) for x in ("logs", "out", "ckpt"))
    os.makedirs(src)
    ms = some_messages(rnd, 60)

    def write(name, part, mode="w"):
        with open(os.path.join(src, name), mode) as f:
            f.write("".join(m + "\n" for m in part))

    def run():
        s = log_files.stream_log_files(spark, src, block_size=300)
        return rows(streams.run_available(s, "logs", out=out, checkpoint=ckpt))

    write("a.log", ms[:20])
    write("b.log", ["torn line"] + ms[20:30])
    write("_hidden", ["x"])
    want = rows(log_files.read_log_files(spark, src, block_size=500))
    assert len(want) == 31 and sum(r[2] == "invalid" for r in want) == 1
    assert any("\n" in r[4] for r in want if r[4]) and want == rows(log_files.read_log_files(spark, src))
    assert run() == want
    assert run() == want  # nothing new
    write("a.log", ms[30:50], "a")  # a file that grows, and a new one
    write("c.log", ms[50:])
    assert run() == rows(log_files.read_log_files(spark, src, block_size=77))


def test_an_open_message_is_held_back_until_the_file_is_quiet(spark, tmp_path):
    src, out, ckpt = (str(tmp_path / x) for x in ("logs", "out", "ckpt"))
    os.makedirs(src)
    path = os.path.join(src, "a.log")

    def run(quiet):
        s = log_files.stream_log_files(spark, src, quiet_seconds=quiet)
        return [r[4] for r in rows(streams.run_available(s, "open", out=out, checkpoint=ckpt))]

    with open(path, "w") as f:
        f.write(line(1, "one") + "\n" + line(2, "two") + "\n  begins")
    assert run(3600) == ["one"]
    with open(path, "a") as f:
        f.write(" and ends\n  here\n" + line(3, "three") + "\n")
    assert run(3600) == ["one", "two\n  begins and ends\n  here"]
    assert run(0) == ["one", "two\n  begins and ends\n  here", "three"]


def test_no_files_give_no_rows(spark, tmp_path):
    os.makedirs(tmp_path / "none")
    assert log_files.read_log_files(spark, str(tmp_path / "none")).collect() == []


# ------------------------------------------------------------------ M1
def test_rows_run_until_the_first_failure(spark, tmp_path):
    calls = str(tmp_path / "calls")
    os.makedirs(calls)

    def fn(row):
        with open(os.path.join(calls, f"{row['id']}"), "a") as f:
            f.write("x")
        if row["id"] in (700, 701):
            raise ValueError(f"host {row['id']} failed")
        return {"twice": 2 * row["id"]}

    df = spark.range(2000).repartition(4)
    out = rowmap.map_until_failure(df, fn, "twice long", keep=["id"], waves=10).collect()
    assert sorted(r.id for r in out) == list(range(2000))  # every row has an outcome
    by = {s: {r.id for r in out if r.status == s} for s in rowmap.STATUSES}
    called = {int(n): len(open(os.path.join(calls, n)).read()) for n in os.listdir(calls)}
    assert set(called.values()) == {1}  # no row's function is called twice, the failed ones' neither
    assert by["failed"] and by["failed"] <= {700, 701} and by["not-run"]
    assert set(called) == by["ok"] | by["failed"]
    assert all(r.twice == 2 * r.id and r.error is None for r in out if r.status == "ok")
    assert {r.error for r in out if r.status == "failed"} <= {"ValueError: host 700 failed", "ValueError: host 701 failed"}
    assert all(r.twice is None and r.error is None for r in out if r.status == "not-run")


@pytest.mark.parametrize("waves", [1, 3])
def test_without_a_failure_every_row_runs(spark, waves):
    out = rowmap.map_until_failure(spark.range(50), lambda r: {"n": r["id"]}, "n long", keep=["id"], waves=waves)
    assert sorted((r.id, r.n, r.status) for r in out.collect()) == [(i, i, "ok") for i in range(50)]
    assert rowmap.map_until_failure(spark.range(0), lambda r: {}, "n long", waves=waves).collect() == []
    with pytest.raises(ValueError):
        rowmap.map_until_failure(spark.range(1), lambda r: {}, "n long", waves=0)
    assert out.agg(F.count("*")).first()[0] == 50
