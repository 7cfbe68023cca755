"""Operator 4, SimHash near-dedup by covering locality-sensitive hashing.

Fingerprint: words are runs of bytes other than ASCII white space, A-Z
lower-cased; each ``shingle``-word shingle (repeats included) is hashed by
XXH64 with seed 42, and a fingerprint bit is set when more than half the
hashes have it.

Links: two fingerprints within ``radius`` bits are linked. Every bit
position gets a code word of ``radius + 1`` bits; table ``v`` (any non-zero
combination of code bits) keeps the positions whose code has odd overlap
with ``v``. The at most ``radius`` code words of two fingerprints' differing
positions cannot span all combinations, so some ``v`` is orthogonal to all
of them and its table holds both fingerprints under one key: no linked pair
is missed. With 64 bits and radius 4 that is 31 tables of about 32 bits.

Hot keys: copies with one fingerprint are one row. A bucket over
``max_bucket`` fingerprints is not compared at once: its rows are dealt into
the tables again on the bits that its mask leaves free, which covers every
linked pair again, and once more if needed. A bucket then shares at least
about 56 of the 64 bits, so its distinct fingerprints are few by
construction. In a bucket each member is compared in blocks and only a
spanning forest of the links leaves the task, never all pairs.

Edge cases: a null or word-less text has fingerprint zero and is linked
like any other; fewer words than a shingle count as one shingle; rows with
a repeated id each get a row; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import binary_rows, materialize, slices, spread
from fleetlens.llm.components import connected_components

SEED = 42
MAX_BUCKET = 2048


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the 64-bit values have each bit, most significant first."""
    counts = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 1 << 16):
        part = np.ascontiguousarray(hashes[lo:lo + (1 << 16)].astype(">u8")).view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return counts


def simhash(data: bytes, shingle: int = 4) -> int:
    """64-bit fingerprint of one text's UTF-8 bytes."""
    words = data.lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = (ends - np.fromiter(map(len, words), np.int64, len(words)) - 1).tolist()
    stops = (ends - 1)[shingle - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(flat[a:b], SEED) for a, b in zip(starts, stops)), np.uint64, len(stops))
    counts = _bit_counts(hashes)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 4) -> DataFrame:
    """(key, fp): fp is the fingerprint's 64 bits as a signed long."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 8 << 20, "_t"):
            fps = np.array([simhash(d, shingle) for d in binary_rows(b.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["_k", "fp"])

    src = docs.select(F.col(key).alias("_k"), F.col(text).cast("string").alias("_t"))
    kind = src.schema["_k"].dataType.simpleString()
    return src.mapInArrow(run, f"_k {kind}, fp long").withColumnRenamed("_k", key)


def masks(bits: list[int], radius: int, seed: int) -> list[int]:
    """The covering tables' masks over the given bit positions."""
    codes = np.random.default_rng(seed).permutation(len(bits)) % (1 << (radius + 1))
    out = []
    for v in range(1, 1 << (radius + 1)):
        out.append(sum(1 << b for b, c in zip(bits, codes.tolist()) if bin(c & v).count("1") % 2))
    return out


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _forest(fps: np.ndarray, radius: int) -> np.ndarray:
    """Root index of each fingerprint's component within one bucket."""
    n = len(fps)
    root = np.arange(n)
    todo = np.arange(n)
    while len(todo):
        seed, todo = todo[0], todo[1:]
        front = np.array([seed])
        while len(front) and len(todo):
            near = np.zeros(len(todo), bool)
            for lo in range(0, len(front), 256):
                x = np.bitwise_xor(fps[front[lo:lo + 256], None], fps[None, todo])
                near |= (np.bitwise_count(x) <= radius).any(axis=0)
            front, todo = todo[near], todo[~near]
            root[front] = seed
    return root


def _bucket_edges(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch | None:
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            starts, stops = np.r_[0, cuts], np.r_[cuts, len(fps)]
            a, b = [], []
            for lo, hi in zip(starts[stops - starts > 1], stops[stops - starts > 1]):
                group = fps[lo:hi]
                root = _forest(group, radius)
                linked = root != np.arange(hi - lo)
                a.append(group[linked])
                b.append(group[root[linked]])
            if not a:
                return None
            return pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(a).view(np.int64)), pa.array(np.concatenate(b).view(np.int64))], names=["a", "b"])

        for batch in batches:  # rows come sorted by (tab, key): a bucket is one run
            if not batch.num_rows:
                continue
            cols = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)], axis=1).astype(np.int64)
            held.append(cols)
            if len(cols) and (held[0][0, :2] == cols[-1, :2]).all():
                continue
            rows = np.concatenate(held)
            last = np.flatnonzero((rows[:, :2] != rows[-1, :2]).any(axis=1))[-1] + 1
            if (out := flush(rows[:last, :2], rows[:last, 2].astype(np.uint64))) is not None:
                yield out
            held = [rows[last:]]
        if held:
            rows = np.concatenate(held)
            if (out := flush(rows[:, :2], rows[:, 2].astype(np.uint64))) is not None:
                yield out
    return run


def linked_pairs(fps: DataFrame, radius: int = 4, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """(a, b): links whose closure is that of all pairs within ``radius``.

    ``fps``: distinct fingerprints (column ``fp``). Tables are keyed by
    (mask number, masked bits); the mask number names the path of masks.
    """
    level = masks(list(range(64)), radius, seed=radius)
    tables = F.array(*[F.struct(F.lit(i).cast("long").alias("tab"), F.lit(_signed(m)).alias("mask"))
                       for i, m in enumerate(level)])
    rows = fps.select("fp", F.explode(tables).alias("t")).select("fp", "t.tab", "t.mask")
    edges = None
    for depth in range(3):
        rows = rows.withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
        if depth < 2:
            sizes = rows.groupBy("tab", "key").agg(F.count("*").alias("n")).where(F.col("n") > max_bucket)
            hot = materialize(sizes.select("tab", "key"), "simhash-hot")
            some = bool(hot.take(1))
        else:
            some = False  # two levels of masks leave about 8 bits free at most
        cold = rows.join(hot, ["tab", "key"], "left_anti") if some else rows
        found = (spread(cold.select("tab", "key", "fp"), "tab", "key").sortWithinPartitions("tab", "key")
                 .mapInArrow(_bucket_edges(radius), "a long, b long"))
        edges = found if edges is None else edges.unionAll(found)
        if not some:
            break
        deeper = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(_signed(m)).alias("m"))
                           for i, m in enumerate(masks(list(range(64)), radius, seed=100 + depth))])
        # a second covering of all 64 bits, joined with the first mask: the pair's own table in each
        # covering keeps all its differing bits free, and so does their union
        rows = (rows.join(hot, ["tab", "key"], "left_semi").withColumn("d", F.explode(deeper))
                .select("fp", (F.col("tab") * 1000 + F.col("d.i") + 1).alias("tab"),
                        F.col("mask").bitwiseOR(F.col("d.m")).alias("mask")))
    return edges


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 4, radius: int = 4,
                    max_bucket: int = MAX_BUCKET) -> DataFrame:
    """(key, fp, component): component is the smallest key reachable over links."""
    prints = materialize(fingerprints(docs, key, text, shingle), "simhash")
    classes = materialize(prints.groupBy("fp").agg(F.min(key).alias("_first")), "simhash-classes")
    pairs = linked_pairs(classes.select("fp"), radius, max_bucket)
    comp = connected_components(pairs, "a", "b").withColumnRenamed("node", "fp")
    groups = classes.join(comp, "fp").select("fp", "component", "_first")
    smallest = materialize(groups.groupBy("component").agg(F.min("_first").alias("_least")), "simhash-least")
    known = groups.join(smallest, "component").select("fp", "_least")
    label = materialize(classes.join(known, "fp", "left")
                        .select("fp", F.coalesce("_least", "_first").alias("component")), "simhash-labels")
    return prints.join(label, "fp").select(key, "fp", "component")


def fingerprint_hex(fp: Column) -> Column:
    """16 lowercase hex digits of a signed 64-bit fingerprint."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
