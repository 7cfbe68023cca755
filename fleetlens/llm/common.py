"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.session import scratch_path

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Lazy scan of ``<sf_dir>/<name>.parquet`` (any path Spark can read)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def materialize(df: DataFrame, kind: str) -> DataFrame:
    """Write ``df`` below the shared checkpoint folder and read it back.

    Cuts lineage without executor-local state: the rows survive the loss of
    any executor and are computed once however often they are used.
    """
    path = scratch_path(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *cols: str) -> DataFrame:
    """Deal rows out over the shuffle partitions by ``cols``."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *cols)


def row_key(*cols: str):
    """A stable spreading key: 64-bit hash of ``cols``."""
    return F.xxhash64(*[F.col(c) for c in cols])


def binary_rows(col: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each value, null as empty."""
    if pa.types.is_string(col.type):
        col = col.cast(pa.binary())
    elif pa.types.is_large_string(col.type):
        col = col.cast(pa.large_binary())
    return [b"" if v is None else v for v in col.to_pylist()]


def text_rows(col: pa.Array) -> list[str]:
    """Text of each value, null as empty; malformed UTF-8 becomes U+FFFD."""
    return [v.decode("utf-8", "replace") for v in binary_rows(col)]


def slices(batches: Iterator[pa.RecordBatch], max_bytes: int, column: str) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that ``column`` holds about ``max_bytes`` per
    piece (a single longer row is a piece of its own)."""
    for b in batches:
        if not b.num_rows:
            continue
        col = b.column(b.schema.get_field_index(column))
        if isinstance(col, pa.ChunkedArray):
            col = col.combine_chunks()
        lens = pa.compute.binary_length(col).fill_null(0).to_pylist()
        lo = size = 0
        for i, n in enumerate(lens):
            if size and size + n > max_bytes:
                yield b.slice(lo, i - lo)
                lo, size = i, 0
            size += n
        yield b.slice(lo)
    pa.default_memory_pool().release_unused()  # the worker lives on: give its room back
