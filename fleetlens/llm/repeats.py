"""Operator 3, suffix-array dedup by a hash-compared suffix sort.

Every byte covered by a ``span``-byte string that also starts anywhere else
in the table is marked (the same document included; overlaps count; matches
never cross documents).

Sorting every suffix of the table would move it many times over, so suffixes
are first grouped by an anchor: of the ``GRAM``-byte grams that a
``span``-byte window holds, the one with the least hash (the leftmost on a
tie). Equal windows have equal anchors at the same place, so a window's
equals are all found in its anchor's group; anchors that occur once are
dropped by a count. What remains of a text is a context per repeated anchor:
the bytes of all windows that the anchor stands for.

In a group the windows' suffixes are sorted by a bottom-up mergesort.
Prefix polynomial hashes modulo 2**64 give the hash of any substring in two
look-ups, so the common extension of two suffixes is found by binary search
and a comparison takes log2(span) steps. All groups of a batch are sorted in
step, as arrays. The sorted neighbours are then compared byte by byte: this
verifies both the order and every equality, and a batch in which a hash
collision has misled the sort is sorted again on its bytes. Windows equal to
a neighbour are marked.

Equal texts are one text: a text is named by 120 bits of its SHA-256, its
anchors and marks are kept once however often it occurs, and all of a text
that occurs more than once is marked by a count of the names.

Hot groups: the contexts of groups with more than ``MAX_GROUP`` occurrences
are collapsed to the different ones by a grouped count before the sort, and
their marks are joined back to the occurrences. A group that has more than
``MAX_GROUP`` different contexts is not one task's: its windows are counted by two independent
64-bit hashes, pre-aggregated, and every hash pair that counts is verified by
the bytes of all its windows (their least and greatest must be the same);
windows of a pair that fails this are counted again by their bytes.

Edge cases: null text is empty; texts shorter than ``span`` lose nothing;
repeated rows are texts of their own (and so lose all of a text of ``span``
bytes or more); an empty table gives no rows; other columns are kept where
asked for.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import binary_rows, materialize, slices, spread

SPAN = 200
GRAM = 64
MAX_GROUP = 1 << 14
BATCH_WINDOWS = 1 << 17
COMPARED = 1 << 12
BASE = 0x9E3779B97F4A7C15 | 1  # odd, so that it has an inverse modulo 2**64
OTHER_BASE = 0xD1342543DE82EF95


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class PrefixHashes:
    """Polynomial hashes of a byte string's prefixes; ``of`` hashes any substrings."""

    def __init__(self, data: np.ndarray, base: int = BASE):
        n = len(data)
        inverse = pow(base, -1, 1 << 64)
        powers = np.full(n + 1, base, np.uint64)
        self.inverse = np.full(n + 1, inverse, np.uint64)
        powers[0] = self.inverse[0] = 1
        np.cumprod(powers, out=powers)
        np.cumprod(self.inverse, out=self.inverse)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return (self.sums[start + length] - self.sums[start]) * self.inverse[start]


def common_extension(h: PrefixHashes, x: np.ndarray, y: np.ndarray, limit: int) -> np.ndarray:
    """Length, up to ``limit``, of the common extension of the suffixes at x and y."""
    length = np.zeros(len(x), np.int64)
    step = 1 << (limit.bit_length() - 1)
    while step:
        longer = length + step
        fits = np.flatnonzero(longer <= limit)
        same = h.of(x[fits], longer[fits]) == h.of(y[fits], longer[fits])
        length[fits[same]] += step
        step >>= 1
    return length


def _less(data: np.ndarray, h: PrefixHashes, x: np.ndarray, y: np.ndarray, limit: int, or_equal: np.ndarray) -> np.ndarray:
    n = common_extension(h, x, y, limit)
    same = n >= limit
    at = np.where(same, 0, n)
    return np.where(same, or_equal, data[x + at] < data[y + at])


def suffix_sort(data: np.ndarray, starts: np.ndarray, group: np.ndarray, limit: int) -> np.ndarray:
    """Order of suffixes by (group, first ``limit`` bytes); ``group`` is ascending.

    Bottom-up mergesort of all groups in step: in a round, every suffix
    finds its place in the neighbouring run of its group by binary search.
    """
    n = len(starts)
    order = np.arange(n)
    first = np.searchsorted(group, group)  # where each suffix's group begins
    size = np.searchsorted(group, group, side="right") - first
    h = PrefixHashes(data)
    run = 1
    while n and run < size.max():
        place = np.arange(n) - first
        begin = first + place // (2 * run) * (2 * run)
        middle = np.minimum(begin + run, first + size)
        end = np.minimum(begin + 2 * run, first + size)
        own = np.flatnonzero(middle < end)  # the others have no neighbouring run
        is_left = np.arange(n)[own] < middle[own]
        lo = np.where(is_left, middle[own], begin[own])
        hi = np.where(is_left, end[own], middle[own])
        low0 = lo.copy()
        x = starts[order[own]]
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                break
            mid = (lo[open_] + hi[open_]) // 2
            y = starts[order[mid]]
            # of equal suffixes those of the left run come first
            before = _less(data, h, y, x[open_], limit, ~is_left[open_])
            lo[open_] = np.where(before, mid + 1, lo[open_])
            hi[open_] = np.where(before, hi[open_], mid)
        target = np.arange(n)
        target[own] = np.where(is_left, own + (lo - low0), begin[own] + (own - middle[own]) + (lo - low0))
        merged = np.empty(n, np.int64)
        merged[target] = order
        order = merged
        run *= 2
    return order


def _compare_bytes(data: np.ndarray, x: np.ndarray, y: np.ndarray, limit: int) -> np.ndarray:
    """-1, 0 or 1 for each pair of suffixes, from their bytes."""
    out = np.zeros(len(x), np.int8)
    reach = np.arange(limit)
    for lo in range(0, len(x), COMPARED):  # places take eight times the bytes compared
        a = data[x[lo:lo + COMPARED, None] + reach]
        b = data[y[lo:lo + COMPARED, None] + reach]
        differ = a != b
        at = differ.argmax(axis=1)
        rows = np.arange(len(a))
        out[lo:lo + len(a)] = np.where(differ[rows, at], np.where(a[rows, at] < b[rows, at], -1, 1), 0)
    return out


def repeated(data: np.ndarray, starts: np.ndarray, group: np.ndarray, limit: int) -> np.ndarray:
    """Which suffixes share their first ``limit`` bytes with another of their group (``group`` ascending)."""
    order = suffix_sort(data, starts, group, limit)
    pairs = np.flatnonzero(group[order][1:] == group[order][:-1])
    x = starts[order]
    way = _compare_bytes(data, x[pairs], x[pairs + 1], limit)
    if (way > 0).any():  # a hash collision misled the sort
        rows = np.ascontiguousarray(data[starts[:, None] + np.arange(limit)])
        order = np.lexsort((rows.view(f"S{limit}").ravel() if not (rows == 0).any()
                            else np.unique(rows, axis=0, return_inverse=True)[1], group))
        x = starts[order]
        way = _compare_bytes(data, x[pairs], x[pairs + 1], limit)
    out = np.zeros(len(starts), bool)
    same = pairs[way == 0]
    out[order[same]] = out[order[same + 1]] = True
    return out


def anchors(data: bytes, span: int = SPAN, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(gram hash, place, first window, last window) for each anchor of a text."""
    empty = np.zeros(0, np.int64)
    parts = []
    step = 1 << 22  # windows at a time, so that places fit in 24 bits
    for lo in range(0, max(0, len(data) - span + 1), step):
        piece = np.frombuffer(data, np.uint8, min(len(data) - lo, step + span - 1), lo)
        n_grams, width = len(piece) - gram + 1, span - gram + 1
        g = _mix(PrefixHashes(piece).of(np.arange(n_grams), gram))
        key = (g & ~np.uint64(0xFFFFFF)) | np.arange(n_grams, dtype=np.uint64)
        pad = -n_grams % width
        blocks = np.concatenate([key, np.full(pad, ~np.uint64(0))]).reshape(-1, width)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        n_windows = n_grams - width + 1
        at = (np.minimum(behind[:n_windows], ahead[width - 1:width - 1 + n_windows]) & np.uint64(0xFFFFFF)).astype(np.int64)
        cuts = np.flatnonzero(at[1:] != at[:-1]) + 1
        first, last = np.r_[0, cuts], np.r_[cuts, n_windows] - 1
        place = at[first]
        parts.append((g[place].view(np.int64), place + lo, first + lo, last + lo))
    if not parts:
        return empty, empty, empty, empty
    return tuple(np.concatenate(x) for x in zip(*parts))


NAME = ("_r1", "_r2")  # 60 bits each of a text's SHA-256


def _named(df: DataFrame, of: str, names: tuple[str, str]) -> DataFrame:
    """``df`` with 2 x 60 bits of the SHA-256 of the bytes in ``of``."""
    hashed = df.withColumn("_sha", F.sha2(of, 256))
    return hashed.withColumns({n: F.conv(F.substring("_sha", at, 15), 16, 10).cast("long")
                               for n, at in zip(names, (1, 16))}).drop("_sha")


def _with_name(docs: DataFrame, key: str, text: str, keep: tuple[str, ...] = ()) -> DataFrame:
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return _named(docs.select(F.col(key).alias("_k"), *[F.col(c) for c in keep], t.cast("binary").alias("_t")), "_t", NAME)


def _anchor_rows(rows: DataFrame, span: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 4 << 20, "_t"):
            out = [anchors(t, span, gram) for t in binary_rows(b.column(2))]
            cols = [np.concatenate([x[i] for x in out]) for i in range(4)]
            n = [len(x[0]) for x in out]
            names = [pa.array(np.repeat(b.column(i).to_numpy(), n)) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0]), *names, *map(pa.array, cols[1:])],
                                             names=["g", *NAME, "at", "first", "last"])

    return rows.select(*NAME, "_t").mapInArrow(run, "g long, _r1 long, _r2 long, at long, first long, last long")


def _contexts(rows: DataFrame, lists: DataFrame, span: int) -> DataFrame:
    """(g, hot, name, at, first, context): the bytes of each repeated anchor's windows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 4 << 20, "_t"):
            for r1, r2, t, marks in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), binary_rows(b.column(2)), b.column(3)):
                m = marks.values
                at, first, last = (m.field(i).to_numpy() for i in (1, 2, 3))
                for lo in range(0, len(at), 4096):
                    part = slice(lo, lo + 4096)
                    n = len(at[part])
                    yield pa.RecordBatch.from_arrays(
                        [m.field(0)[part], m.field(4)[part], pa.array(np.full(n, r1)), pa.array(np.full(n, r2)), pa.array(at[part]),
                         pa.array(first[part]),
                         pa.array([t[i:j + span] for i, j in zip(first[part].tolist(), last[part].tolist())], pa.binary())],
                        names=["g", "hot", *NAME, "at", "first", "context"])

    return rows.select(*NAME, "_t").join(lists, list(NAME)).select(*NAME, "_t", "marks").mapInArrow(
        run, "g long, hot boolean, _r1 long, _r2 long, at long, first long, context binary")


def _runs(r1: np.ndarray, r2: np.ndarray, first: np.ndarray, n: np.ndarray, dup: np.ndarray, span: int) -> pa.RecordBatch:
    """Covered intervals of contexts from their windows' marks (``n`` windows each, end to end)."""
    owner = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(dup)) - np.repeat(np.cumsum(n) - n, n)
    on = np.flatnonzero(dup)
    new = np.ones(len(on), bool)
    new[1:] = (np.diff(on) > 1) | (owner[on[1:]] != owner[on[:-1]])
    begin = on[new]
    end = on[np.r_[np.flatnonzero(new)[1:], len(on)] - 1] if len(on) else on
    who = owner[begin]
    return pa.RecordBatch.from_arrays([pa.array(r1[who]), pa.array(r2[who]), pa.array(first[who] + place[begin]),
                                       pa.array(first[who] + place[end] + span)], names=[*NAME, "begin", "end"])


def _grouped(span: int):
    """Intervals from contexts, each with its number of copies, that come sorted by anchor hash."""
    def solve(g: np.ndarray, r1: np.ndarray, r2: np.ndarray, at: np.ndarray, first: np.ndarray, copies: np.ndarray,
              contexts: list[bytes]) -> pa.RecordBatch:
        n = np.fromiter(map(len, contexts), np.int64, len(contexts)) - span + 1
        before = at - first
        ids: dict[tuple, int] = {}
        kind = np.fromiter((ids.setdefault(k, len(ids)) for k in zip(g.tolist(), before.tolist(), contexts)),
                           np.int64, len(contexts))
        times = np.bincount(kind, weights=copies)
        one = np.unique(kind, return_index=True)[1]  # one context of each kind
        kinds_in = np.unique(g[one], return_inverse=True)
        lonely = np.bincount(kinds_in[1])[kinds_in[1]] == 1  # the only kind of its group
        offsets = np.cumsum(n[one]) - n[one]
        dup = np.repeat(times > 1, n[one])
        sort = one[~lonely]
        if len(sort):
            data = np.frombuffer(b"".join(contexts[i] for i in sort), np.uint8)
            size = n[sort] + span - 1
            begin = np.cumsum(size) - size
            place = np.arange(int(n[sort].sum())) - np.repeat(np.cumsum(n[sort]) - n[sort], n[sort])
            starts = np.repeat(begin, n[sort]) + place
            # windows of an anchor that hold it at different places cannot be equal
            part = np.repeat(np.unique(g[sort], return_inverse=True)[1], n[sort]) << 12
            part += np.repeat(before[sort], n[sort]) - place + (1 << 11)
            by = np.argsort(part, kind="stable")
            found = np.zeros(len(starts), bool)
            found[by] = repeated(data, starts[by], part[by], span)
            target = np.repeat(offsets[~lonely], n[sort]) + place
            dup[target] |= found
        # every context gets the marks of its kind
        take = np.repeat(offsets[kind], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        return _runs(r1, r2, first, n, dup[take], span)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        windows = 0

        def flush(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows))
            return solve(*[np.array(c, np.int64) for c in cols[:6]], list(cols[6]))

        for b in batches:
            for row in zip(*[b.column(i).to_pylist() for i in range(7)]):
                if held and windows >= BATCH_WINDOWS and row[0] != held[-1][0]:
                    yield flush(held)
                    held, windows = [], 0
                held.append(row)
                windows += len(row[6]) - span + 1
        if held:
            yield flush(held)

    return run


GROUPED = ("g", *NAME, "at", "first", "copies", "context")
INTERVALS = "_r1 long, _r2 long, begin long, end long"


def _sorted_intervals(contexts: DataFrame, span: int) -> DataFrame:
    """Intervals of the contexts' windows by the suffix sort, a group a task."""
    return spread(contexts.select(*GROUPED), "g").sortWithinPartitions("g").mapInArrow(_grouped(span), INTERVALS)


def _counted_intervals(contexts: DataFrame, span: int) -> DataFrame:
    """Intervals of the windows of different contexts (named, first = 0) of groups that are too large for a task:
    windows counted by two hashes, and each pair that counts verified by its windows' bytes."""
    def windows(with_bytes: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(batches, (64 << 10) if with_bytes else (2 << 20), "context"):
                contexts = b.column(3).to_pylist()
                data = np.frombuffer(b"".join(contexts), np.uint8)
                size = np.fromiter(map(len, contexts), np.int64, len(contexts))
                n = size - span + 1
                place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                at = np.repeat(np.cumsum(size) - size, n) + place
                who = np.repeat(np.arange(len(n)), n)
                cols = [pa.array(b.column(i).to_numpy()[who]) for i in (0, 1)] + [pa.array(place), pa.array(b.column(2).to_numpy()[who])]
                cols += [pa.array(_mix(PrefixHashes(data, base).of(at, span)).view(np.int64)) for base in (BASE, OTHER_BASE)]
                if with_bytes:
                    whole = data.tobytes()
                    cols.append(pa.array([whole[i:i + span] for i in at.tolist()], pa.binary()))
                yield pa.RecordBatch.from_arrays(cols, names=[*NAME, "begin", "copies", "h1", "h2", *["bytes"] * with_bytes])

        return contexts.select(*NAME, "copies", "context").mapInArrow(
            run, "_r1 long, _r2 long, begin long, copies long, h1 long, h2 long" + ", bytes binary" * with_bytes)

    pair = ["h1", "h2"]
    counted = materialize(windows(False).groupBy(*pair).agg(F.sum("copies").alias("n")).where("n > 1").select(*pair), "repeat-windows")
    there = windows(True).join(counted, pair, "left_semi")
    checked = materialize(there.groupBy(*pair).agg(F.min("bytes").alias("least"), F.max("bytes").alias("most"))
                          .select(*pair, (F.col("least") == F.col("most")).alias("same")), "repeat-pairs")
    out = windows(False).join(checked.where("same"), pair, "left_semi").select(*NAME, "begin")
    if checked.where("not same").take(1):  # a collision of both hashes
        mixed = windows(True).join(checked.where("not same"), pair, "left_semi")
        equal = mixed.groupBy("bytes").agg(F.sum("copies").alias("n")).where("n > 1").select("bytes")
        out = out.unionAll(mixed.join(equal, "bytes", "left_semi").select(*NAME, "begin"))
    return out.select(*NAME, "begin", (F.col("begin") + span).alias("end"))


def _hot_intervals(hot: DataFrame, span: int, max_group: int) -> DataFrame:
    """Intervals of hot groups' contexts: solved once per different context, then joined back to all its places."""
    name = ("_c1", "_c2")
    hot = materialize(_named(hot.select("g", *NAME, "at", "first", "context"), "context", name), "repeat-hot-contexts")
    # equal contexts hold their anchor at the same place
    each = materialize(hot.groupBy(*name).agg(F.any_value("g").alias("g"), F.any_value(F.col("at") - F.col("first")).alias("at"),
                                              F.count(F.lit(1)).alias("copies"), F.any_value("context").alias("context"))
                       .select("g", *[F.col(c).alias(n) for c, n in zip(name, NAME)], "at", F.lit(0).cast("long").alias("first"),
                               "copies", "context"), "repeat-each-context")
    big = materialize(each.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max_group).select("g"), "repeat-big-groups")
    solved = _sorted_intervals(each.join(big, "g", "left_anti"), span)
    if big.take(1):
        solved = solved.unionAll(_counted_intervals(each.join(big, "g", "left_semi"), span))
    # at most a few hundred windows a context, merged to few intervals
    marks = materialize(solved.select(*[F.col(n).alias(c) for c, n in zip(name, NAME)], "begin", "end"), "repeat-hot-marks")
    return hot.select(*name, *NAME, "first").join(marks, list(name)).select(
        *NAME, (F.col("first") + F.col("begin")).alias("begin"), (F.col("first") + F.col("end")).alias("end"))


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", span: int = SPAN, gram: int = GRAM,
                   max_group: int = MAX_GROUP) -> DataFrame:
    """(``NAME``, marks): per different text, by the bits of its hash, the byte intervals that repeated strings cover."""
    if not 0 < gram <= span <= 1 << 11:
        raise ValueError("needs 0 < gram <= span <= 2048")
    rows = _with_name(docs, key, text)
    found = _anchor_rows(rows, span, gram)
    # an anchor repeats if it stands in two texts or at two places of one: some column differs
    ends = [f(c).alias(f"{f.__name__}_{c}") for c in (*NAME, "at") for f in (F.min, F.max)]
    differs = " or ".join(f"min_{c} <> max_{c}" for c in (*NAME, "at"))
    groups = materialize(found.groupBy("g").agg(F.count(F.lit(1)).alias("n"), *ends).where(differs)
                         .select("g", (F.col("n") > max_group).alias("hot")), "repeat-anchors")
    lists = materialize(found.join(groups, "g").groupBy(*NAME)
                        .agg(F.collect_set(F.struct("g", "at", "first", "last", "hot")).alias("marks")), "repeat-lists")
    if groups.where("hot").take(1):
        contexts = materialize(_contexts(rows, lists, span), "repeat-contexts")
        cold, hot = contexts.where("not hot"), contexts.where("hot")
    else:
        cold, hot = _contexts(rows, lists, span), None
    marks = _sorted_intervals(cold.withColumn("copies", F.lit(1).cast("long")), span)
    if hot is not None:
        marks = marks.unionAll(_hot_intervals(hot, span, max_group))
    size = F.octet_length("_t").cast("long")
    copied = (rows.where(size >= span).groupBy(*NAME).agg(F.count(F.lit(1)).alias("n"), F.max(size).alias("end")).where("n > 1")
              .select(*NAME, F.lit(0).cast("long").alias("begin"), "end"))
    return materialize(marks.unionAll(copied).distinct().groupBy(*NAME)
                       .agg(F.collect_list(F.struct("begin", "end")).alias("marks")), "repeat-marks")


def merge_intervals(marks: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of touching or overlapping intervals."""
    out: list[list[int]] = []
    for lo, hi in sorted(marks):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [tuple(x) for x in out]


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (),
                   span: int = SPAN, with_text: bool = False) -> DataFrame:
    """(key, *keep, n_bytes, n_removed, n_spans, kept_sha256[, kept]) for each row.

    ``kept`` (with_text): the remaining bytes as text; a character that a
    removed run cuts through is dropped.
    """
    rows = _with_name(docs, key, text, keep)
    joined = rows.join(repeated_spans(docs, key, text, span), list(NAME), "left").drop(*NAME)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 4 << 20, "_t"):
            n = b.num_columns
            out = []
            for t, marks in zip(binary_rows(b.column(n - 2)), b.column(n - 1).to_pylist()):
                spans = merge_intervals([(m["begin"], m["end"]) for m in marks or ()])
                edges = [0, *[x for s in spans for x in s], len(t)]
                kept = b"".join(t[i:j] for i, j in zip(edges[::2], edges[1::2]))
                out.append((len(t), len(t) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(),
                            kept.decode("utf-8", "ignore") if with_text else None))
            cols = list(zip(*out))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()][:4 + with_text]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(n - 2)],
                                              *[pa.array(c, k) for c, k in zip(cols, kinds)]], names=names)

    head = joined.schema.fields[:-2]
    names = [key, *[f.name for f in head[1:]], "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_text
    fields = [f"`{n}` {f.dataType.simpleString()}" for n, f in zip(names, head)]
    fields += ["n_bytes long", "n_removed long", "n_spans long", "kept_sha256 string"] + ["kept string"] * with_text
    return joined.mapInArrow(run, ", ".join(fields))
