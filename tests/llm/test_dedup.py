"""Suffix-array dedup, SimHash near-dedup and components against brute force."""

import os
import random
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(__file__))
import helpers  # noqa: E402

from fleetlens.llm import components, queries, repeats, simhash  # noqa: E402

DOCS = "doc_id long, text string"


def texts(n, seed):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randrange(1, 8))) for _ in range(200)]
    passages = [" ".join(rnd.choice(words) for _ in range(60)) for _ in range(4)]
    out = []
    for i in range(n):
        body = [rnd.choice(words) for _ in range(rnd.randrange(1, 120))]
        if i % 3 == 0:
            body.insert(len(body) // 2, passages[i % 4])
        t = " ".join(body)
        out.append(t if i % 5 or not out else rnd.choice(out))
    return out


EDGE_TEXTS = [None, None, "", " \n\t", "One two", "one  TWO", "a" * 900, "ab" * 400, "日本語テキスト" * 60, "日本語テキスト" * 60,
              "same same same same", "x" * 199, "x" * 200]


def some_documents(spark):
    docs = list(enumerate(texts(60, 1) + EDGE_TEXTS))
    docs.append(docs[7])  # a repeated row
    return docs, spark.createDataFrame(docs, DOCS)


def test_repeats_against_brute_force(spark):
    docs, df = some_documents(spark)
    got = repeats.remove_repeats(df)
    assert helpers.rows(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(
        helpers.repeats(docs, 200), key=repr)


def merged_marks(df, **options):
    return {(r["_r1"], r["_r2"], x) for r in repeats.repeated_spans(df, **options).collect()
            for x in repeats.merge_intervals([(i["begin"], i["end"]) for i in r["marks"]])}


def test_hot_groups_give_the_same_marks(spark):
    _, df = some_documents(spark)
    found = [merged_marks(df, max_group=m) for m in (1, 3, 1 << 14)]
    assert found[0] == found[1] == found[2] and found[0]


def test_hot_groups_with_misleading_hashes(spark, monkeypatch):
    """Every window hash of the counted groups collides: the bytes decide."""
    _, df = some_documents(spark)
    right = merged_marks(df)
    seen = []
    monkeypatch.setattr(repeats, "_counted_intervals", lambda c, span, f=repeats._counted_intervals: seen.append(1) or f(c, span))
    monkeypatch.setattr(repeats, "OTHER_BASE", repeats.BASE)
    monkeypatch.setattr(repeats, "_mix", lambda x: x & np.uint64(1))  # anchors too: a few groups hold all
    assert merged_marks(df, max_group=2) == right and seen


def test_many_equal_rows_take_linear_room(spark):
    """A text of 3,000 copies without an id: one row of marks, a context per anchor and row at most, whole result."""
    text = " ".join(f"w{i * i}" for i in range(80))
    other = "start " + text[100:420] + " end"
    df = spark.createDataFrame([(None, text)] * 3000 + [(1, other), (2, "y" * 150)], DOCS)
    rows = repeats._with_name(df, "doc_id", "text")
    anchors = len(repeats.anchors(text.encode())[0])
    marks = repeats.repeated_spans(df, max_group=500)
    assert marks.count() == 2
    found = repeats._anchor_rows(rows, 200, 64).groupBy("g").count().agg({"count": "sum"}).first()[0]
    assert found <= 3002 * (anchors + 10)
    got = repeats.remove_repeats(df).collect()
    assert len(got) == 3002
    size = len(text)
    assert all((r["n_removed"], r["n_spans"]) == (size, 1) for r in got if r["n_bytes"] == size)
    assert {(r["doc_id"], r["n_removed"]) for r in got if r["doc_id"] is not None} == {(1, 320), (2, 0)}


def test_repeats_small_spans_and_batches(spark, monkeypatch):
    rnd = random.Random(5)
    docs = [(i, "".join(rnd.choice("ab") for _ in range(rnd.randrange(0, 90)))) for i in range(40)]
    df = spark.createDataFrame(docs, DOCS)
    rows = repeats._with_name(df, "doc_id", "text")
    got = {}
    found = [(g, r1, r2, a, f, 1, t[f:la + 12]) for r1, r2, t in ((r["_r1"], r["_r2"], bytes(r["_t"])) for r in rows.collect())
             for g, a, f, la in zip(*[x.tolist() for x in repeats.anchors(t, 12, 5)])]
    import pyarrow as pa
    found.sort()
    batch = pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.binary() if i == 6 else pa.int64())
                                        for i in range(7)], names=list("abcdefg"))
    monkeypatch.setattr(repeats, "BATCH_WINDOWS", 50)
    for b in repeats._grouped(12)(iter([batch])):
        for r1, r2, lo, hi in zip(*[c.to_pylist() for c in b.columns]):
            got.setdefault((r1, r2), []).append((lo, hi))
    ids = {r["_k"]: (r["_r1"], r["_r2"]) for r in rows.collect()}
    for k, n, removed, spans, _ in helpers.repeats(docs, 12):
        merged = repeats.merge_intervals(got.get(ids[k], []))
        assert (sum(b - a for a, b in merged), len(merged)) == (removed, spans)


def test_suffix_sort_orders_groups_by_bytes():
    rnd = random.Random(2)
    for limit in (1, 3, 20):
        data = np.frombuffer(bytes(rnd.choice(b"ab\0") for _ in range(300)), np.uint8)
        starts = np.array(rnd.sample(range(300 - limit), 120))
        group = np.sort(np.array([rnd.randrange(4) for _ in starts]))
        keys = [(group[i], data[starts[i]:starts[i] + limit].tobytes())
                for i in repeats.suffix_sort(data, starts, group, limit)]
        assert keys == sorted(keys)


def test_misleading_hashes_are_caught(monkeypatch):
    """With a hash that takes everything for equal the verification restores the right answer."""
    rnd = random.Random(3)
    data = np.frombuffer(bytes(rnd.choice(b"ab") for _ in range(200)), np.uint8)
    starts, group = np.arange(150), np.zeros(150, np.int64)
    right = repeats.repeated(data, starts, group, 8)
    monkeypatch.setattr(repeats.PrefixHashes, "of", lambda self, start, length: np.zeros(len(start), np.uint64))
    assert (repeats.repeated(data, starts, group, 8) == right).all() and right.any() and not right.all()


@pytest.mark.parametrize("max_bucket", [2048, 2])
def test_simhash_against_brute_force(spark, max_bucket):
    base = texts(50, 4)
    rnd = random.Random(4)
    near = []
    for t in base[:20]:
        w = t.split()
        for _ in range(2):
            v = list(w)
            v[rnd.randrange(len(v))] = "changed"
            near.append(" ".join(v))
    docs = list(enumerate(base + near + EDGE_TEXTS))
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in docs], DOCS + ", fp string, component int")
    got = simhash.near_duplicates(df, max_bucket=max_bucket)
    found = got.select("doc_id", simhash.fingerprint_hex(got["fp"]).alias("f"), "component")
    assert helpers.rows(found, "doc_id", "f", "component") == sorted(helpers.simhash_components(docs), key=repr)


def test_masks_cover_every_pair_within_the_radius():
    masks = simhash.masks(list(range(64)), 4, seed=4)
    assert len(masks) == 31
    rnd = random.Random(9)
    for _ in range(3000):
        differ = sum(1 << b for b in rnd.sample(range(64), rnd.randrange(0, 5)))
        assert any(not m & differ for m in masks)


def test_linked_pairs_reach_the_same_components(spark):
    rnd = random.Random(6)
    seeds = [rnd.getrandbits(64) for _ in range(12)]
    fps = {f for s in seeds for _ in range(60)
           for f in [s ^ sum(1 << b for b in rnd.sample(range(64), rnd.randrange(0, 6)))]}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    exact = helpers.components([(a, b) for i, a in enumerate(signed) for b in signed[:i]
                                if bin((a ^ b) & (1 << 64) - 1).count("1") <= 4])
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    for cap in (2048, 10):
        pairs = simhash.linked_pairs(df, 4, cap)
        got = components.connected_components(pairs, "a", "b")
        assert helpers.rows(got, "node", "component") == sorted(exact, key=repr)


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(60)] + [(500, i) for i in range(501, 540)] + [(7, 7), (None, 3), (900, 901), (901, 900)]
    got = components.connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b")
    assert helpers.rows(got, "node", "component") == sorted(helpers.components(edges), key=repr)
    none = components.connected_components(spark.createDataFrame([], "a long, b long"), "a", "b")
    assert none.collect() == []


def test_empty_tables(spark):
    empty = spark.createDataFrame([], DOCS)
    assert repeats.remove_repeats(empty).collect() == []
    assert simhash.near_duplicates(empty).collect() == []


def test_queries_on_the_small_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = queries.op3_suffix_array_dedup(spark, sf)
    assert helpers.rows(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(
        helpers.repeats(docs, 200), key=repr)
    got = queries.op4_simhash_near_dedup(spark, sf)
    assert helpers.rows(got, "doc_id", "fingerprint", "component_id") == sorted(helpers.simhash_components(docs), key=repr)


def test_comparing_neighbours_takes_little_memory():
    """Places of the bytes compared are made for a few thousand pairs at a time."""
    import tracemalloc
    data = np.frombuffer(bytes(range(97, 123)) * 3000, np.uint8)
    x = np.arange(60_000)
    tracemalloc.start()
    way = repeats._compare_bytes(data, x, x + 26 * (x % 2) + x % 3, 200)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [int(w) for w in way[:3]] == [0, -1, -1] and ((way == 0) == (x % 3 == 0)).all()
    assert peak < 40 << 20
