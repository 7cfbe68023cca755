"""Operator 8, benchmark decontamination by CGK embedding and bit-sampling LSH.

A document contains a benchmark item if some run of its words is within
``floor((1 - similarity) * n)`` word insertions, deletions and changes of the
item's n words. Words are lower-cased runs of letters, digits and
underscores.

The CGK random walk reads a window from its start; at step j it writes the
word under it and moves on if a random bit of (j, word) says so. Windows
within a small edit distance fall into step again after an edit, so their
outputs differ in few places: edit distance becomes Hamming distance.
The agreement falls with the number of edits in a walk, so items are not
embedded whole: an item with at most d edits is cut into pieces so many that
one of them has at most ``PIECE_EDITS`` edits, whatever the item's length.
``WALKS`` walks over each piece are sampled ``SAMPLES`` times at ``BITS`` output
places; a window that agrees with a piece in one sample makes the piece's
item a candidate there. A piece's places are drawn from the steps that its own
length covers; pieces are treated in length classes of ratio ``CLASS_RATIO``.
The other pieces and the windows beside the true one are further chances.
The tests hold every length class at 99 % at least with the full number of edits,
for insertions, deletions and changes alone.

Windows: an item of n words with at most d edits keeps a run of
ceil((n - d) / (d + 1)) words unchanged, so a text without any such run of any
item cannot match. Every start is embedded that can belong to a piece of an
item of which the text holds a run there; nothing is lost by not embedding
the others.

Every candidate is verified by exact edit distance, with free ends, on the
text around the item's place.

The items are broadcast in blocks of at most ``ITEM_BLOCK_CHARS`` characters,
one pass over the documents a block, so the broadcast has a fixed bound.

Items that allow no edit (those under five words) need no embedding: they are
looked up exactly, by a hash of the run of words and then the words.

Characters of scripts that are written without spaces are words of their own.

Edge cases: null or empty text contains nothing; items without a word are
contained in nothing, and items under ``min_words`` words (1: none) are not
looked for; equal items are separate items; items and documents may have keys
of any type; repeated documents are each reported; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from fleetlens.llm.common import slices, text_rows

SIMILARITY = 0.8
MIN_WORDS = 1
WALKS, SAMPLES, BITS = 6, 8, 3
PIECE_EDITS = 1
CLASS_RATIO = 1.3
ITEM_BLOCK_CHARS = 16 << 20
END, OTHER = 0, 1  # word codes: past the end, and any word of no item
NOT_HERE = -1 << 40  # no item of the class holds the run


# scripts that are written without spaces
_UNSPACED = re.compile("([\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff"
                       "\U00020000-\U0003ffff])")


def words_of(texts: list[str]) -> pa.ListArray:
    """Lower-cased words of each text (one empty word if it has none)."""
    spaced = [t if t.isascii() or not _UNSPACED.search(t) else _UNSPACED.sub(r" \1 ", t) for t in texts]
    lower = pc.utf8_lower(pa.array(spaced, pa.large_string()))
    return pc.split_pattern(pc.utf8_trim(pc.replace_substring_regex(lower, r"[^\pL\pM\pN_]+", " "), " "), " ")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _join(keys: np.ndarray, words: np.ndarray) -> np.ndarray:
    return _mix(keys * np.uint64(0x100000001B3) + words.astype(np.uint64) + np.uint64(1))


def edits_allowed(n: int, similarity: float = SIMILARITY) -> int:
    return math.floor((1 - similarity) * n + 1e-9)


def shared_run(n: int, similarity: float = SIMILARITY) -> int:
    """Length of a run of words that an item of n words keeps under the allowed edits."""
    d = edits_allowed(n, similarity)
    return max(1, math.ceil((n - d) / (d + 1)))


def pieces_of(n: int, similarity: float = SIMILARITY) -> list[tuple[int, int]]:
    """(begin, end) of an item's pieces: one has at most ``PIECE_EDITS`` of the allowed edits."""
    k = min(n, edits_allowed(n, similarity) // (PIECE_EDITS + 1) + 1)
    cuts = [n * i // k for i in range(k + 1)]
    return list(zip(cuts, cuts[1:]))


def window_edits(items: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Least edit distance between each row's item and any run of the same row's words."""
    row = np.zeros((len(texts), texts.shape[1] + 1), np.int64)
    reach = np.arange(texts.shape[1] + 1)
    for i in range(items.shape[1]):
        nxt = np.empty_like(row)
        nxt[:, 0] = i + 1
        nxt[:, 1:] = np.minimum(row[:, 1:] + 1, row[:, :-1] + (texts != items[:, i, None]))
        row = np.minimum.accumulate(nxt - reach, axis=1) + reach
    return row.min(axis=1)


class Items:
    """Embedded benchmark items with their LSH tables."""

    def __init__(self, ids: list, texts: list[str], similarity: float = SIMILARITY, min_words: int = MIN_WORDS, seed: int = 8):
        lists = [[w for w in x if w] for x in words_of(texts).to_pylist()] if texts else []
        use = [i for i, x in enumerate(lists) if len(x) >= max(1, min_words)]
        vocabulary = sorted({w for i in use for w in lists[i]})
        self.code = {w: c + 2 for c, w in enumerate(vocabulary)}
        # items with edits are embedded; the others follow them and are looked up
        use.sort(key=lambda i: edits_allowed(len(lists[i]), similarity) == 0)
        self.ids = [ids[i] for i in use]
        every = [np.array([self.code[w] for w in lists[i]], np.int64) for i in use]
        self.words = [len(x) for x in every]
        self.items = [x for x in every if edits_allowed(len(x), similarity) > 0]
        self.exact: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}  # per length: sorted hashes, words, item numbers
        for r in sorted({len(x) for x in every[len(self.items):]}):
            own = [i for i in range(len(self.items), len(every)) if len(every[i]) == r]
            rows = np.stack([every[i] for i in own])
            h = self._run_hashes(rows.ravel(), r)[::r]
            order = np.argsort(h, kind="stable")
            self.exact[r] = h[order], rows[order], np.array(own)[order]
        self.edits = [edits_allowed(len(x), similarity) for x in self.items]
        rng = np.random.default_rng(seed)
        pieces = [(i, *p) for i, x in enumerate(self.items) for p in pieces_of(len(x), similarity)]
        self.owner = np.array([i for i, _, _ in pieces], np.int64)
        self.offset = np.array([lo for _, lo, _ in pieces], np.int64)
        self.longest = max((hi - lo for _, lo, hi in pieces), default=0)
        words = [self.items[i][lo:hi] for i, lo, hi in pieces]
        # an item's pieces differ by one word at most and are in one class
        shortest = [min(hi - lo for lo, hi in pieces_of(len(x), similarity)) for x in self.items]
        lengths = sorted(set(shortest))
        self.classes: list[dict] = []
        class_of: dict[int, int] = {}
        while lengths:
            low = lengths[0]
            high = max(low, int(low * CLASS_RATIO))
            class_of |= {n: len(self.classes) for n in lengths if n <= high}
            self.classes.append({"low": low, "high": high})
            lengths = [n for n in lengths if n > high]
        # runs that some item must share with a matching window: per run length the sorted hashes and, per class,
        # from how far before the run to how far behind its begin the items' pieces can begin
        runs: dict[int, dict[int, np.ndarray]] = {}
        for x, d, n in zip(self.items, self.edits, shortest):
            r = shared_run(len(x), similarity)
            known = runs.setdefault(r, {})
            for o, h in enumerate(self._run_hashes(x, r).tolist()):
                span = known.setdefault(h, np.full((len(self.classes), 2), NOT_HERE, np.int64))
                span[class_of[n]] = np.maximum(span[class_of[n]], (o + d, len(x) - n - o + d))
        self.runs = {r: (np.array(sorted(h), np.uint64), np.array([h[k] for k in sorted(h)], np.int64)) for r, h in runs.items()}
        self.walk_seeds = rng.integers(1, 1 << 62, WALKS).astype(np.uint64)
        for c in self.classes:
            own = [p for p, i in enumerate(self.owner) if c["low"] <= shortest[i] <= c["high"]]
            # two steps a word on average: the walk over the shortest piece's words
            c["steps"] = 2 * c["low"]
            c["places"] = [[np.sort(rng.choice(c["steps"], min(BITS, c["steps"]), replace=False)) for _ in range(SAMPLES)]
                           for _ in range(WALKS)]
            flat, starts = self._flat([words[i] for i in own])
            c["tables"] = []
            for walk in range(WALKS):
                out = self.embed(flat, starts, walk, c["steps"])
                row = []
                for places in c["places"][walk]:
                    keys = self.sample(out, places)
                    order = np.argsort(keys, kind="stable")
                    row.append((keys[order], np.array(own)[order]))
                c["tables"].append(row)

    @staticmethod
    def _flat(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Word codes end to end, each list followed by END, and where each begins."""
        sizes = np.array([len(x) + 1 for x in lists], np.int64)
        return (np.concatenate([np.append(x, END) for x in lists]) if lists else np.zeros(0, np.int64),
                np.cumsum(sizes) - sizes)

    @staticmethod
    def _run_hashes(words: np.ndarray, r: int) -> np.ndarray:
        n = len(words) - r + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        h = np.zeros(n, np.uint64)
        for k in range(r):
            h = _join(h, words[k:k + n])
        return h

    def embed(self, flat: np.ndarray, starts: np.ndarray, walk: int, steps: int) -> np.ndarray:
        """CGK outputs, a row per step, of the windows that begin at ``starts``."""
        out = np.empty((steps, len(starts)), np.int64)
        at = starts.copy()
        words = np.arange(len(self.code) + 2, dtype=np.uint64)
        for j in range(steps):
            w = flat[at]
            out[j] = w
            bit = _mix(words * np.uint64(0x9E3779B97F4A7C15) + self.walk_seeds[walk] + np.uint64(j)) >> np.uint64(63)
            bit[END] = 0  # the walk stays behind the last word
            at += bit.astype(np.int64)[w]
        return out

    @staticmethod
    def sample(out: np.ndarray, places: np.ndarray) -> np.ndarray:
        keys = np.zeros(out.shape[1], np.uint64)
        for j in places:
            keys = _join(keys, out[j])
        return keys

    def shared_runs(self, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of runs of words that a matching window of some item must share, and the pieces' spans around them."""
        at, span = [np.zeros(0, np.int64)], [np.zeros((0, len(self.classes), 2), np.int64)]
        for r, (table, spans) in self.runs.items():
            h = self._run_hashes(flat, r)
            if len(h):
                row = np.minimum(np.searchsorted(table, h), len(table) - 1)
                at.append(np.flatnonzero(table[row] == h))
                span.append(spans[row[at[-1]]])
        return np.concatenate(at), np.concatenate(span)

    @staticmethod
    def starts(flat: np.ndarray, runs: np.ndarray, span: np.ndarray) -> np.ndarray:
        """Starts of pieces of the items that hold one of the runs."""
        here = span[:, 0] > NOT_HERE
        runs, span = runs[here], span[here]
        hit = np.zeros(len(flat) + 1, np.int64)
        np.add.at(hit, np.maximum(runs - span[:, 0], 0), 1)
        np.add.at(hit, np.clip(runs + span[:, 1] + 1, 0, len(flat)), -1)
        return np.flatnonzero((np.cumsum(hit[:-1]) > 0) & (flat != END))

    def candidates(self, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, piece) pairs that collide in some sample."""
        pairs: list[np.ndarray] = [np.zeros((0, 2), np.int64)]
        runs, span = self.shared_runs(flat)
        for k, c in enumerate(self.classes):
            every = self.starts(flat, runs, span[:, k])
            for lo in range(0, len(every), 1 << 15):
                starts = every[lo:lo + (1 << 15)]
                for walk in range(WALKS):
                    out = self.embed(flat, starts, walk, c["steps"])
                    for places, (table, owner) in zip(c["places"][walk], c["tables"][walk]):
                        keys = self.sample(out, places)
                        a, b = np.searchsorted(table, keys), np.searchsorted(table, keys, side="right")
                        n = b - a
                        who = np.repeat(np.arange(len(keys)), n)
                        if len(who):
                            piece = owner[np.repeat(a - (np.cumsum(n) - n), n) + np.arange(len(who))]
                            pairs.append(np.unique(np.stack([starts[who], piece], axis=1), axis=0))
        found = np.unique(np.concatenate(pairs), axis=0)
        return found[:, 0], found[:, 1]

    def exact_matches(self, flat: np.ndarray, ends: np.ndarray) -> list[tuple[int, int, int]]:
        """(text, item, 0) for each item without edits that a text holds."""
        found: list[np.ndarray] = []
        for r, (table, rows, owner) in self.exact.items():
            h = self._run_hashes(flat, r)
            lo, hi = np.searchsorted(table, h), np.searchsorted(table, h, side="right")
            at = np.flatnonzero(hi > lo)
            n = (hi - lo)[at]
            row = np.repeat(lo[at] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            at = np.repeat(at, n)
            same = (flat[at[:, None] + np.arange(r)] == rows[row]).all(axis=1)
            pairs = np.stack([np.searchsorted(ends, at[same]), owner[row[same]]], axis=1)
            found.append(np.unique(pairs, axis=0))
        return [(t, i, 0) for t, i in np.concatenate(found).tolist()] if found else []

    def matches(self, texts: list[str]) -> list[tuple[int, int, int]]:
        """(text, item, edits) for each item that a text contains."""
        if not self.ids or not texts:
            return []
        lists = words_of(texts)
        coded = lists.flatten().dictionary_encode()
        code = np.fromiter((self.code.get(w, OTHER) if w else END for w in coded.dictionary.to_pylist()), np.int64,
                           len(coded.dictionary))
        words = code[coded.indices.to_numpy()] if len(code) else np.zeros(0, np.int64)
        sizes = np.diff(lists.offsets.to_numpy())
        doc = np.repeat(np.arange(len(texts)), sizes)
        # each text is followed by END
        ends = np.cumsum(sizes + 1) - 1
        flat = np.full(len(words) + len(texts), END, np.int64)
        flat[np.arange(len(words)) + doc] = words
        begins = ends - sizes
        short = self.exact_matches(flat, ends)
        if not self.items:
            return short
        start, piece = self.candidates(flat)
        item = self.owner[piece]
        of = np.searchsorted(ends, start)
        lens = np.array([len(x) for x in self.items])
        # places of an item that begin near each other are verified together
        cell = (start - self.offset[piece] - begins[of]) // np.maximum(lens[item], 1)
        todo = np.unique(np.stack([of, item, cell], axis=1), axis=0)
        best: dict[tuple[int, int], int] = {}
        for n in np.unique(lens[todo[:, 1]]).tolist():
            same = todo[lens[todo[:, 1]] == n]
            d = self.edits[same[0, 1]]
            at = begins[same[:, 0]] + same[:, 2] * n - d - self.longest
            width = np.arange(2 * n + 3 * d + 2 * self.longest)
            for lo in range(0, len(same), 256):
                some = same[lo:lo + 256]
                place = at[lo:lo + 256, None] + width
                inside = (place >= begins[some[:, 0], None]) & (place < ends[some[:, 0], None])
                texts_at = np.where(inside, flat[np.clip(place, 0, len(flat) - 1)], END)
                for (t, i, _), e in zip(some.tolist(), window_edits(np.stack([self.items[i] for i in some[:, 1]]), texts_at).tolist()):
                    if e <= d:
                        best[t, i] = min(e, best.get((t, i), e))
        return sorted([(t, i, e) for (t, i), e in best.items()] + short)


def contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
                 item_text: str = "text", similarity: float = SIMILARITY, min_words: int = MIN_WORDS,
                 block_chars: int = ITEM_BLOCK_CHARS) -> DataFrame:
    """(key, item_id, n_words, edits, similarity) for each item that a document contains."""
    spark = docs.sparkSession
    bench = items.where(F.col(item_text).isNotNull()).select(F.col(item_key).alias("_i"), F.col(item_text).alias("_t"))
    size = bench.agg(F.sum(F.length("_t"))).first()[0] or 0
    n_blocks = max(1, math.ceil(size / block_chars))
    src = docs.select(F.col(key).alias("_k"), F.col(text).cast("string").alias("_t"))
    k_type, i_type = (df.schema[c].dataType.simpleString() for df, c in ((src, "_k"), (bench, "_i")))
    schema = f"_k {k_type}, _i {i_type}, n_words long, edits long"
    i_arrow = to_arrow_type(bench.schema["_i"].dataType)
    out = None
    for n in range(n_blocks):
        rows = bench.where(F.pmod(F.xxhash64("_i", "_t"), F.lit(n_blocks)) == n).orderBy("_i", "_t").collect()
        ids = [r["_i"].asDict(True) if isinstance(r["_i"], Row) else r["_i"] for r in rows]
        shared = spark.sparkContext.broadcast((ids, [r["_t"] for r in rows]))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            found = None
            for b in slices(batches, 4 << 20, "_t"):
                found = found or Items(*shared.value, similarity, min_words)
                hits = found.matches(text_rows(b.column(1)))
                if hits:
                    t, i, e = (list(x) for x in zip(*hits))
                    yield pa.RecordBatch.from_pydict({
                        "_k": b.column(0).take(pa.array(t)), "_i": [found.ids[x] for x in i],
                        "n_words": [found.words[x] for x in i], "edits": e},
                        schema=pa.schema([("_k", b.column(0).type), ("_i", i_arrow), ("n_words", pa.int64()),
                                          ("edits", pa.int64())]))

        part = src.mapInArrow(run, schema)
        out = part if out is None else out.unionAll(part)
    return out.select(F.col("_k").alias(key), F.col("_i").alias("item_id"), "n_words", "edits",
                      (1 - F.col("edits") / F.col("n_words")).alias("similarity"))
