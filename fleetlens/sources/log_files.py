"""Operation log files as a batch and a streaming source.

A log message may go on over several lines; its first line begins with a
time (the layout of ``text.read_operation_log``). The source ``operation_log``
reads files in byte blocks, a task a block, and gives one row per message,
whole: a block owns the messages whose first line begins in it, and reads on
past its end for the rest of the last one. So no file is one task's work, and
the table does not depend on the block size.

As a stream it follows a folder: an offset is the length read of each file,
so a restarted query goes on where it ended, also within a file that has
grown. A message's end shows only when the next one begins; the last message
of a file is held back until then, or until the file has not been changed for
``quietSeconds`` (default 0: at once). A file's first lines before any message are one row of their own.

Options: ``path`` (a file, a folder or a glob, on a file system that all
executors share), ``blockSize`` in bytes (default 64 MiB), ``quietSeconds``.
Paths with a scheme other than ``file`` are opened by Arrow's file systems.
"""

from __future__ import annotations

import glob
import json
import os
import re
import time
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from fleetlens.sources.text import read_operation_log

NAME = "operation_log"
SCHEMA = "file string, start bigint, text string"
BLOCK = 64 << 20
STEP = 1 << 20

# a message's first line: its time and the dash after it
_FIRST = re.compile(rb"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2},\d{3} - ", re.M)
_FIRST_SIZE = 26


class Block(InputPartition):
    """Messages of ``file`` whose first line begins at ``lo`` or later and before ``hi``, read up to ``end``."""

    def __init__(self, file: str, lo: int, hi: int, end: int):
        self.file, self.lo, self.hi, self.end = file, lo, hi, end


def open_file(path: str):
    """A file for reading at any place: local, or on a file system that Arrow knows."""
    if "://" in path and not path.startswith("file:"):
        from pyarrow import fs
        system, place = fs.FileSystem.from_uri(path)
        return system.open_input_file(place)
    return open(path.removeprefix("file://").removeprefix("file:"), "rb")


def _list(path: str) -> list[tuple[str, int, float]]:
    """(file, length, time of the last change) of the files at a path, hidden ones left out."""
    if "://" in path and not path.startswith("file:"):
        from pyarrow import fs
        system, place = fs.FileSystem.from_uri(path)
        scheme = path.split("://")[0]
        found = system.get_file_info(fs.FileSelector(place)) if system.get_file_info(place).type == fs.FileType.Directory \
            else [system.get_file_info(place)]
        return sorted((f"{scheme}://{f.path}", f.size, f.mtime.timestamp()) for f in found
                      if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")))
    path = path.removeprefix("file://").removeprefix("file:")
    names = glob.glob(os.path.join(path, "*")) if os.path.isdir(path) else glob.glob(path)
    return sorted((n, os.path.getsize(n), os.path.getmtime(n)) for n in names
                  if os.path.isfile(n) and not os.path.basename(n).startswith(("_", ".")))


def messages(block: Block) -> Iterator[tuple[str, int, str]]:
    """(file, start, text) of a block's messages. Holds one message and a step of the file."""
    if block.lo >= block.end:
        return
    with open_file(block.file) as f:
        # from a byte before the block, so that a first line at its very begin shows as one
        at = max(0, block.lo - 1)
        f.seek(at)
        held = f.read(min(STEP, block.end - at))
        more = at + len(held) < block.end
        if block.lo:
            cut = held.find(b"\n")
            while cut < 0 and more and at + len(held) < block.hi:
                at += len(held)
                held = f.read(min(STEP, block.end - at))
                more = at + len(held) < block.end
                cut = held.find(b"\n")
            if cut < 0:
                return  # no line begins in this block
            at, held = at + cut + 1, held[cut + 1:]
        start = None if block.lo else 0  # what precedes the first message of a file is a row as well
        seen = 0  # no first line begins below this place of ``held``
        while True:
            m = _FIRST.search(held, seen)
            # a match needs its line's begin: ``held`` always begins at one
            if m is None and more:
                line = held.rfind(b"\n") + 1
                seen = max(seen, min(line, len(held)))
                step = f.read(min(STEP, block.end - at - len(held)))
                if not step:
                    more = False
                if start is None:  # nothing of this block's yet: drop whole lines
                    at, held, seen = at + seen, held[seen:], 0
                    if at >= block.hi:
                        return
                held += step
                more = more and at + len(held) < block.end
                continue
            stop = len(held) if m is None else m.start()
            if start is not None and stop > 0:
                yield block.file, at, held[:stop].decode("utf-8", "replace").rstrip("\r\n")
            if m is None or at + stop >= block.hi:
                return
            at, held = at + stop, held[stop:]
            start, seen = at, _FIRST_SIZE


class LogReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.block = options["path"], int(options.get("blockSize", BLOCK))

    def partitions(self) -> list[Block]:
        return _blocks([(f, 0, size) for f, size, _ in _list(self.path)], self.block)

    def read(self, partition: Block) -> Iterator[tuple]:
        yield from messages(partition)


def _blocks(ranges: list[tuple[str, int, int]], block: int) -> list[Block]:
    return [Block(f, lo, min(lo + block, end), end) for f, begin, end in ranges for lo in range(begin, end, block)] or [Block("", 0, 0, 0)]


class LogStreamReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.block = options["path"], int(options.get("blockSize", BLOCK))
        self.quiet = float(options.get("quietSeconds", 0))

    def initialOffset(self) -> dict:
        return {"read": "{}"}

    def latestOffset(self) -> dict:
        now = time.time()
        return {"read": json.dumps({f: size if now - changed >= self.quiet else self._last_first_line(f, size)
                                    for f, size, changed in _list(self.path)}, sort_keys=True)}

    def _last_first_line(self, file: str, size: int) -> int:
        """Where the last message of a file that may still grow begins."""
        with open_file(file) as f:
            hi, tail = size, b""
            while hi > 0:
                lo = max(0, hi - STEP)
                f.seek(lo)
                tail = f.read(hi - lo) + tail[:_FIRST_SIZE]
                places = [m.start() for m in _FIRST.finditer(tail) if lo + m.start() == 0 or m.start() > 0]
                if places:
                    return lo + places[-1]
                hi = lo
        return 0

    def partitions(self, start: dict, end: dict) -> list[Block]:
        before, after = json.loads(start["read"]), json.loads(end["read"])
        return _blocks([(f, before.get(f, 0), size) for f, size in after.items() if size > before.get(f, 0)], self.block)

    def read(self, partition: Block) -> Iterator[tuple]:
        yield from messages(partition)

    def commit(self, end: dict) -> None:
        pass


class OperationLog(DataSource):
    """The data source ``operation_log``: file, start (its first byte), text of each message."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LogReader:
        return LogReader(self.options)

    def streamReader(self, schema) -> LogStreamReader:
        return LogStreamReader(self.options)


def _parsed(raw: DataFrame) -> DataFrame:
    """Columns of ``read_operation_log`` for messages of several lines: the first line is cut, the rest follows it."""
    from pyspark.sql import functions as F
    first = F.substring_index("text", "\n", 1)
    rest = F.substr("text", F.length(first) + 1)
    cut = read_operation_log(raw.withColumn("_first", F.regexp_replace(first, "\r$", "")).withColumn("_rest", rest), "_first")
    return cut.withColumn("message", F.concat("message", "_rest")).drop("_first", "_rest")


def read_log_files(spark: SparkSession, path: str, block_size: int = BLOCK) -> DataFrame:
    """file, start, text, status, ts, logger, level, host, message of every message of log files."""
    spark.dataSource.register(OperationLog)
    return _parsed(spark.read.format(NAME).option("path", path).option("blockSize", block_size).load())


def stream_log_files(spark: SparkSession, path: str, block_size: int = BLOCK, quiet_seconds: float = 0) -> DataFrame:
    """The same table as a stream of the messages that are added."""
    spark.dataSource.register(OperationLog)
    return _parsed(spark.readStream.format(NAME).option("path", path).option("blockSize", block_size)
                   .option("quietSeconds", quiet_seconds).load())
