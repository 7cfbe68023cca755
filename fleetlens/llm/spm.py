"""Operator 5, SentencePiece encoding and decoding for merge-type vocabularies.

A text is escaped (a leading ``U+2581``, spaces become ``U+2581``) and cut
before each ``U+2581`` that follows another character, where no vocabulary
piece can cross (checked when the model is read). Merges never cross such a
cut, so each chunk is encoded by itself and equal chunks once a task. A chunk is encoded by a score-ordered agenda of
adjacent symbol pairs: the best pair (highest score, leftmost on a tie) is
merged, its neighbours form new pairs, until no pair is a piece. Short
chunks of a batch go through one agenda in step, as arrays; long ones
through a heap, in n log n. Symbols outside the vocabulary become bytes.

Each Arrow batch is checked against the sentencepiece library: every chunk
is encoded by the library too when it is first met, and a difference raises.
Decoding is the library's ``decode(ids)``.

The vocabulary file is a parameter. The driver reads it and broadcasts its
bytes (a model file of fixed size), so executors need no such path.

Edge cases: a null or empty text has no ids and decodes to the empty
string; a very long text is one row, never cut off; memory is bounded by
the row, the batch and two generations of ``CACHE_CHARS`` in each Python worker.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import slices, text_rows

SPACE = "▁"
BATCH_BYTES = 2 << 20
CACHE_CHARS = 12 << 20
STEP_CHARS = 48  # longest chunk of the array agenda
# piece types of the model file format
NORMAL, UNKNOWN, USER_DEFINED, UNUSED, BYTE = 1, 2, 4, 5, 6


class Vocabulary:
    """Pieces, scores and merges of a model file."""

    def __init__(self, model: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(model)
        spec, norm = proto.trainer_spec, proto.normalizer_spec
        if spec.model_type != 2 or norm.name != "identity" or norm.precompiled_charsmap or norm.remove_extra_whitespaces \
                or not norm.add_dummy_prefix or spec.treat_whitespace_as_suffix:
            raise ValueError("needs a merge-type model with identity normalisation and a leading space")
        self.lib = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.unk = self.lib.unk_id()
        self.ids: dict[str, int] = {}
        self.scores: list[float] = []
        self.bytes: dict[int, int] = {}
        for i, p in enumerate(proto.pieces):
            self.scores.append(p.score)
            if p.type == NORMAL:
                self.ids[p.piece] = i
            elif p.type == BYTE:
                self.bytes[int(p.piece[3:5], 16)] = i
            elif p.type in (USER_DEFINED, UNUSED):
                raise ValueError(f"piece {i}: user-defined and unused pieces are not supported")
        # pieces inside which a space mark follows another character would join words
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("pieces that cross words are not supported")
        # every way to split a piece into two pieces or characters is a merge
        chars = sorted({c for p in self.ids for c in p})
        self.sym = dict(self.ids)
        for c in chars:
            self.sym.setdefault(c, len(self.scores) + len(self.sym))
        merges = [(self.sym[p[:k]], self.sym[p[k:]], i) for p, i in self.ids.items() for k in range(1, len(p))
                  if p[:k] in self.sym and p[k:] in self.sym]
        left, right, to = (np.array(x, np.int64) for x in zip(*merges))
        order = np.argsort(left << 32 | right)
        self.pair_keys = (left << 32 | right)[order]
        self.pair_to = to[order]
        # equal scores share a rank, so the leftmost pair wins a tie
        self.rank = np.unique(-np.array(self.scores, np.float64), return_inverse=True)[1].astype(np.int64)
        self.pair_rank = self.rank[self.pair_to]
        self.first = np.full(0x110000, len(self.scores) + len(self.sym), np.int64)  # a character's symbol
        for c in chars:
            self.first[ord(c)] = self.sym[c]
        for b, i in self.bytes.items():  # a one-byte character without a piece is its byte at once
            if b < 128 and chr(b) not in self.sym:
                self.first[b] = i

    def chunks(self, text: str) -> list[str]:
        """Cut an escaped text before each word."""
        return _WORDS.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def _bytes_of(self, symbol: str) -> list[int]:
        return [self.bytes[b] for b in symbol.encode()] if self.bytes else [self.unk]

    def heap_encode(self, chunk: str) -> list[int]:
        """One chunk through the agenda as a heap."""
        n = len(chunk)
        sym, nxt, prv = list(chunk), list(range(1, n + 1)), list(range(-1, n - 1))
        ids, rank, agenda = self.ids, self.rank, []

        def propose(a: int, b: int) -> None:
            if a >= 0 and b < n and (i := ids.get(sym[a] + sym[b])) is not None:
                agenda.append((int(rank[i]), a, sym[a], sym[b], b)) if first else heapq.heappush(
                    agenda, (int(rank[i]), a, sym[a], sym[b], b))

        first = True
        for a in range(n - 1):
            propose(a, a + 1)
        heapq.heapify(agenda)
        first = False
        while agenda:
            _, a, x, y, b = heapq.heappop(agenda)
            if sym[a] != x or sym[b] != y or nxt[a] != b:
                continue  # one of the two has been merged since
            sym[a], sym[b] = x + y, ""
            nxt[a] = nxt[b]
            if nxt[a] < n:
                prv[nxt[a]] = a
            propose(prv[a], a)
            propose(a, nxt[a])
        out: list[int] = []
        for s in sym:
            if s:
                out.extend([ids[s]] if s in ids else self._bytes_of(s))
        return out

    def step_encode(self, chunks: list[str]) -> list[list[int]]:
        """Many short chunks through the agenda in step: each round merges the best pair of every chunk.

        The chunks' symbols lie end to end in one array. ``bid`` of a symbol is its pair's rank and its
        place, so the least bid of a chunk is its best pair, the leftmost on a tie.
        """
        n, base = len(chunks), len(self.scores)
        count = np.fromiter(map(len, chunks), np.int64, n)
        points = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32)
        sym, who = self.first[points], np.arange(n)
        none = np.int64(1) << 40
        bid, to = np.full(len(sym), none), np.full(len(sym), -1, np.int64)

        def look(at: np.ndarray) -> None:
            """Bids of the pairs (at, at + 1)."""
            key = sym[at] << 32 | sym[at + 1]
            i = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            hit = self.pair_keys[i] == key
            to[at] = self.pair_to[i]
            bid[at] = np.where(hit, self.pair_rank[i] << 7, none)

        inner = np.ones(len(sym), bool)
        inner[np.cumsum(count) - 1] = False
        look(np.flatnonzero(inner))
        out: list[list[int]] = [[]] * n
        while len(who):
            start = np.cumsum(count) - count
            place = np.arange(len(sym)) - np.repeat(start, count)
            best = np.minimum.reduceat(np.where(bid < none, bid | place, none), start)
            live = best < none
            if not live.all():
                gone = np.repeat(~live, count)
                ids, stops = sym[gone].tolist(), np.cumsum(count[~live]).tolist()
                lo = 0
                for c, hi in zip(who[~live].tolist(), stops):
                    out[c] = ids[lo:hi]
                    lo = hi
                who, count, best = who[live], count[live], best[live]
                sym, bid, to = sym[~gone], bid[~gone], to[~gone]
                start = np.cumsum(count) - count
                if not len(who):
                    break
            at = start + (best & 127)
            sym[at] = to[at]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            bid[at] = none
            sym, bid, to = sym[keep], bid[keep], to[keep]
            at -= np.arange(len(at))  # each earlier chunk has lost a symbol
            count = count - 1
            start = start - np.arange(len(start))
            look((at - 1)[at > start])
            look(at[at < start + count - 1])
        strange = [i for i, ids in enumerate(out) if max(ids) >= base or min(ids) < 0]
        for i in strange:  # symbols without a piece become bytes
            out[i] = self.heap_encode(chunks[i])
        return out

    def encode_chunks(self, chunks: list[str], check: bool = True) -> list[list[int]]:
        """Ids of escaped chunks, each of which begins with a space mark."""
        out: list[list[int]] = [[]] * len(chunks)
        short = [i for i, c in enumerate(chunks) if len(c) <= STEP_CHARS]
        short.sort(key=lambda i: len(chunks[i]))
        for lo in range(0, len(short), 8192):
            part = short[lo:lo + 8192]
            for i, ids in zip(part, self.step_encode([chunks[i] for i in part])):
                out[i] = ids
        for i, c in enumerate(chunks):
            if len(c) > STEP_CHARS:
                out[i] = self.heap_encode(c)
        if check and chunks:
            theirs = self.lib.encode([c[1:].replace(SPACE, " ") or SPACE for c in chunks], num_threads=1)
            for c, a, b in zip(chunks, out, theirs):
                if a != b and len(c) > 1:
                    raise ValueError(f"encoding differs from the library's for {c[:80]!r}: {a[:20]} and {b[:20]}")
        return out


_WORDS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


class Encoder:
    """Encodes texts, each distinct chunk once while it stays in the cache.

    The cache has two generations. A chunk that is met joins the younger one;
    when that holds ``CACHE_CHARS``, it becomes the older one and the former
    older one goes. So chunks that stay in use stay known, and only those not
    met for a whole generation are encoded (and checked) again.
    """

    def __init__(self, model: bytes, check: bool = True):
        self.vocab, self.check = Vocabulary(model), check
        self.number = list(range(len(self.vocab.scores) + 1))  # one object per id, shared by all chunks
        self.young: dict[str, tuple[tuple[int, ...], str]] = {}
        self.old: dict[str, tuple[tuple[int, ...], str]] = {}
        self.held = 0

    def _know(self, chunks: set[str]) -> None:
        """Bring chunks into the younger generation."""
        if self.held > CACHE_CHARS:
            self.old, self.young, self.held = self.young, {}, 0
        young, old, number = self.young, self.old, self.number
        missing = [c for c in chunks if c not in young]
        new = []
        for c in missing:
            known = old.get(c)
            if known is None:
                new.append(c)
            else:
                young[c] = known
        for c, ids in zip(new, self.vocab.encode_chunks(new, self.check)):
            young[c] = tuple([number[i] for i in ids]), ",".join(map(str, ids))
        self.held += sum(map(len, missing)) + 40 * len(missing)

    def batch(self, texts: list[str]) -> tuple[list[list[int]], list[str]]:
        """Ids of each text, and the same as decimal text."""
        cut = [self.vocab.chunks(t) for t in texts]
        self._know(set().union(*cut))
        get = self.young.__getitem__
        ids, digits = [], []
        for chunks in cut:
            both = list(map(get, chunks))
            ids.append(list(chain.from_iterable([x for x, _ in both])))
            digits.append(",".join([y for _, y in both]))
        return ids, digits

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.batch(texts)[0]


def worker_encoder(model: bytes, check: bool) -> Encoder:
    """This Python worker's encoder: tasks that run in one worker one after another share it, and with it the
    vocabulary's tables and the chunk cache. A worker keeps the encoder of one model."""
    key = hashlib.sha256(model).hexdigest(), check
    held = getattr(pa, "_fleetlens_encoder", None)  # a module that the worker keeps between tasks
    if held is None or held[0] != key:
        held = key, Encoder(model, check)
        pa._fleetlens_encoder = held
    return held[1]


def encode_decode(docs: DataFrame, model_path: str, key: str = "doc_id", text: str = "text",
                  keep: tuple[str, ...] = (), with_ids: bool = False, check: bool = True) -> DataFrame:
    """(key, *keep, n_tokens, ids_sha256, decoded_sha256[, ids]) for each whole text.

    ids_sha256: lowercase hex digest of the decimal ids joined by commas;
    decoded_sha256: of the decoded text in UTF-8.
    """
    spark = docs.sparkSession
    with open(model_path, "rb") as f:
        model = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # millions of small objects and no cycles among them
        try:
            yield from encoded(batches)
        finally:
            gc.enable()

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = None
        for b in slices(batches, BATCH_BYTES, "_t"):
            enc = enc or worker_encoder(model.value, check)
            ids, digits = enc.batch(text_rows(b.column(b.num_columns - 1)))
            decoded = enc.vocab.lib.decode(ids, num_threads=1) if ids else []
            digest = [hashlib.sha256(x.encode()).hexdigest() for x in digits]
            back = [hashlib.sha256(x.encode()).hexdigest() for x in decoded]
            cols = [b.column(i) for i in range(b.num_columns - 1)]
            cols += [pa.array(list(map(len, ids)), pa.int64()), pa.array(digest, pa.string()), pa.array(back, pa.string())]
            if with_ids:
                cols.append(pa.array(ids, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(cols, names=names)

    src = docs.select(F.col(key), *keep, F.col(text).cast("string").alias("_t"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1]]
    fields += ["n_tokens long", "ids_sha256 string", "decoded_sha256 string"] + ["ids array<int>"] * with_ids
    names = [*src.columns[:-1], "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids
    return src.mapInArrow(run, ", ".join(fields))
