"""Operator 2, token counts by a separator scan of flat token files.

A flat token file is a run of fixed-width little-endian ids with one
end-of-document id after each document and no index. It is held as
consecutive blocks (file, block, data); ``pack_documents`` writes such
blocks, ``read_token_files`` reads raw files as them, by byte ranges, from a
file system that all executors share. Each block is
searched for the separator as one array and gives its separators' places;
nothing else of it is kept. A prefix scan over the blocks' summaries then
stitches documents that cross blocks: how many separators and where the
last one stands before each block. The scan has two levels (blocks in
chunks of ``CHUNK``, then chunks), so a file that holds most blocks is not
one task's work.

Edge cases: a null or empty text is a document of 0 tokens; ids after a
file's last separator are an unfinished document (``ended`` false); an
empty file or table gives no rows; a document longer than a block spans
blocks; other columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetlens.llm.common import materialize, slices, spread, text_rows
from fleetlens.sources.log_files import open_file

BLOCK_TOKENS = 1 << 19
CHUNK = 1024
BLOCKS = "file string, block long, data binary, names array<long>"


def pack_documents(docs: DataFrame, ranks_path: str, pattern: str, eod: int, key: str = "doc_id", text: str = "text",
                   block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Blocks of flat files of 16-bit ids, a file per input partition.

    ``names``: keys of the documents whose separator stands in the block, in
    order (no places; ``None`` for a block of a file from elsewhere).
    The vocabulary file of fixed size is read by the driver and broadcast.
    """
    with open(ranks_path, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken
        from pyspark import TaskContext

        enc, file = None, f"part-{TaskContext.get().partitionId():06d}"
        held, size, names, block = [], 0, [], 0

        def blocks(all_: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, size, names, block
            if size < block_tokens and not (all_ and size):
                return
            flat = np.concatenate(held)
            ends = np.flatnonzero(flat == eod)
            lo = seen = 0
            while len(flat) - lo >= block_tokens or (all_ and lo < len(flat)):
                hi = min(lo + block_tokens, len(flat))
                upto = int(np.searchsorted(ends, hi))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file]), pa.array([block], pa.int64()), pa.array([flat[lo:hi].tobytes()], pa.binary()),
                     pa.array([names[seen:upto]], pa.list_(pa.int64()))], names=["file", "block", "data", "names"])
                lo, seen, block = hi, upto, block + 1
            held, size, names = [flat[lo:]], len(flat) - lo, names[seen:]

        for b in slices(batches, 2 << 20, "_t"):
            if enc is None:
                table = {base64.b64decode(a): int(i) for a, i in map(bytes.split, ranks.value.splitlines())}
                enc = tiktoken.Encoding("flat", pat_str=pattern, mergeable_ranks=table, special_tokens={})
            for k, t in zip(b.column(0).to_pylist(), text_rows(b.column(1))):
                ids = np.array([*enc.encode_ordinary(t), eod], "<u2")
                held.append(ids)
                names.append(k)
                size += len(ids)
                if size >= block_tokens:
                    yield from blocks(False)
        yield from blocks(True)

    return docs.select(F.col(key).cast("long"), F.col(text).cast("string").alias("_t")).mapInArrow(run, BLOCKS)


def read_token_files(spark: SparkSession, path: str, width: int = 2, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Blocks of raw flat files at ``path``, of any size: the files are listed with their lengths, and each block's
    byte range is read by itself, so the blocks of one file are many tasks' work and none is held whole."""
    step = block_tokens * width
    files = spark.read.format("binaryFile").load(path).select("path", "length")  # their contents are not read here
    ranges = spread(files.where("length > 0").select(
        F.col("path").alias("file"), "length",
        F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(length - 1) div {step}"))).alias("block")), "file", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, length, block in zip(*[b.column(i).to_pylist() for i in range(3)]):
                if length % width:
                    raise ValueError(f"{file}: {length} bytes are not whole {width}-byte ids")
                with open_file(file) as f:
                    f.seek(block * step)
                    data = f.read(min(step, length - block * step))
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([block], pa.int64()), pa.array([data], pa.binary()),
                                                  pa.array([None], pa.list_(pa.int64()))], names=["file", "block", "data", "names"])

    return ranges.mapInArrow(run, BLOCKS)


def separators(blocks: DataFrame, eod: int, width: int = 2) -> DataFrame:
    """(file, block, n_ids, ends, names): places of the separator within each block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, ends = [], []
            for data in b.column(2):
                ids = np.frombuffer(data.as_buffer(), f"<u{width}")
                n.append(len(ids))
                ends.append(np.flatnonzero(ids == eod).astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(ends, pa.list_(pa.int64())), b.column(3)],
                names=["file", "block", "n_ids", "ends", "names"])

    return blocks.select("file", "block", "data", "names").mapInArrow(
        run, "file string, block long, n_ids long, ends array<long>, names array<long>")


def token_counts(blocks: DataFrame, eod: int, width: int = 2, block_tokens: int = BLOCK_TOKENS,
                 chunk: int = CHUNK) -> DataFrame:
    """(file, ordinal, name, start, n_tokens, ended) for each document of the files.

    ``start``: index of the document's first id in its file; ``n_tokens``
    without the separator; ``ordinal`` from 0; ``name`` is null where the
    blocks bring none. All blocks but a file's last hold ``block_tokens`` ids.
    """
    s = materialize(separators(blocks, eod, width)
                    .withColumn("base", F.col("block") * block_tokens)
                    .withColumn("chunk", F.floor(F.col("block") / chunk)), "separators")
    n_ends, last = F.size("ends"), F.col("base") + F.element_at("ends", -1)
    brief = s.select("file", "chunk", "block", n_ends.cast("long").alias("n"), F.when(n_ends > 0, last).alias("last"))
    inside = W.partitionBy("file", "chunk").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    before = W.partitionBy("file").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    chunks = materialize(
        brief.groupBy("file", "chunk").agg(F.sum("n").alias("n"), F.max("last").alias("last"), F.max("block").alias("top"))
        .select("file", "chunk", F.max("top").over(W.partitionBy("file")).alias("top"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"),
                F.coalesce(F.max("last").over(before), F.lit(-1)).alias("last0")), "separator-chunks")
    scanned = (brief.select("file", "chunk", "block", F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("n1"),
                            F.max("last").over(inside).alias("last1"))
               .join(chunks, ["file", "chunk"])
               .select("file", "block", (F.col("block") == F.col("top")).alias("final"), (F.col("n0") + F.col("n1")).alias("seen"),
                       F.coalesce("last1", "last0").alias("open")))  # the last separator before the block
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, base, n_ids, ends, names, seen, open_, final in zip(*[b.column(i).to_pylist() for i in range(8)]):
                at = np.array(ends, np.int64) + base
                begin = np.concatenate([[open_], at[:-1]]) + 1 if len(at) else at
                count, ended = at - begin, np.ones(len(at), bool)
                if names is not None and len(names) != len(at):
                    raise ValueError(f"{file}: {len(at)} separators for {len(names)} documents in a block")
                names = list(names) if names is not None else [None] * len(at)
                rest = (int(at[-1]) if len(at) else open_) + 1
                if final and rest < base + n_ids:
                    begin, count = np.append(begin, rest), np.append(count, base + n_ids - rest)
                    ended, names = np.append(ended, False), [*names, None]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file] * len(begin), pa.string()), pa.array(np.arange(len(begin)) + seen, pa.int64()),
                     pa.array(names, pa.int64()), pa.array(begin, pa.int64()), pa.array(count, pa.int64()),
                     pa.array(ended)], names=["file", "ordinal", "name", "start", "n_tokens", "ended"])

    return (s.join(scanned, ["file", "block"])
            .select("file", "base", "n_ids", "ends", "names", "seen", "open", "final")
            .mapInArrow(cut, "file string, ordinal long, name long, start long, n_tokens long, ended boolean"))
