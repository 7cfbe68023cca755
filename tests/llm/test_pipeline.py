"""The pipeline, stage by stage, against brute force."""

import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))
import helpers  # noqa: E402

corpus_pipeline = pytest.importorskip("corpus_pipeline")

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    from fleetlens.llm.common import materialize
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"]: r for r in docs.collect()}
        docs = materialize(stage(spark, docs, SF), f"test-stage-{n}")
        after = {r["doc_id"]: r for r in docs.collect()}
        if n < 4:
            assert docs.columns == columns and set(after) <= set(before)
        if n == 0:
            assert len(after) >= 0.98 * len(before)
        elif n == 1:
            groups = helpers.simhash_components([(k, r["text"]) for k, r in before.items()])
            assert set(after) == {c for _, _, c in groups}
        elif n == 2:
            want = {k: (size - gone) for k, size, gone, _, _ in helpers.repeats([(k, r["text"]) for k, r in before.items()], 200)}
            assert set(after) == set(before)
            assert all(abs(len(after[k]["text"].encode()) - size) <= 6 for k, size in want.items())
        elif n == 3:
            leaks = {k for k, r in before.items() for _, t in bench if helpers.contained(r["text"], t) is not None}
            assert set(before) - set(after) == leaks
        else:
            assert set(after) == set(before) and all(r["n_tokens"] >= 0 for r in after.values())


def test_stages_with_awkward_rows_and_clashing_columns(spark):
    from pyspark.sql import functions as F
    text = "One two three four five six seven eight nine ten. " * 8
    rows = [(1, text, "en", "s", 1), (1, text, "en", "s", 1), (2, None, None, None, None), (3, "", "en", "s", 0), (None, text + "x", "en", "s", 1),
            (4, "#" * 50000, "en", "s", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("row_key", "component", "no_text", "_t", "_r1", "rejected", "fp", "n_removed", "kept"):
        docs = docs.withColumn(name, F.lit(7))
    want = [
        [rows[0], rows[1], rows[4]],  # texts without letters are rejected
        [rows[0], rows[2], rows[4], rows[5]],  # a repeated row, and an empty text beside a null one, go
        [(1, "", "en", "s", 0)] * 2 + [rows[2], rows[3], (None, "x", "en", "s", 1), (4, "", "en", "s", 0)],
        rows,
        [(1, "en", "s", 1)] * 2 + [(2, None, None, None), (3, "en", "s", 0), (None, "en", "s", 1), (4, "en", "s", 5)]]
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        columns = out.columns if n < 4 else ["doc_id", "lang", "source", "n_chars"]
        assert n == 4 or columns == list(corpus_pipeline.COLUMNS)
        got = [tuple(r[c] for c in columns) for r in out.collect()]
        assert sorted(map(repr, got)) == sorted(map(repr, want[n])), name
        if n == 4:
            assert {r["doc_id"]: r["n_tokens"] for r in out.where("doc_id in (2, 3)").collect()} == {2: 0, 3: 0}
        assert stage(spark, docs.limit(0), SF).collect() == []


def test_rows_without_an_id_and_with_a_shared_id(spark):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    a, b, c, d, e = (" ".join(word() for _ in range(80)) for _ in range(5))
    rows = [(None, a), (None, b), (None, b), (7, c), (None, c), (8, d), (8, e), (8, e), (None, None), (None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame([(*r, "en", None, 1) for r in rows], schema), SF)
    want = [(None, a), (None, b), (7, c), (8, d), (8, e), (None, None)]
    assert sorted(map(repr, want)) == sorted(repr((r["doc_id"], r["text"])) for r in got.collect())
    leak = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    rows = [(None, f"{a} {leak} {b}"), (None, a), (3, f"{leak} {c}"), (3, c), (4, None), (5, d)]
    got = corpus_pipeline.decontaminate(spark, spark.createDataFrame([(*r, "en", None, 1) for r in rows], schema), SF)
    want = [rows[1], rows[3], rows[4], rows[5]]
    assert sorted(map(repr, want)) == sorted(repr((r["doc_id"], r["text"])) for r in got.collect())
