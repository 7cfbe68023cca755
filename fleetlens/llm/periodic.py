"""Operator 11, periodic runs of words by block convolution.

A run is a maximal stretch of consecutive words whose words ``q`` apart are
the same (``q`` is its smallest period) and whose length is at least
``max(min_length, 3 * q)``. At each dyadic scale ``B`` a text is cut into
blocks of ``B`` words. For every block, the sums of squared differences
between its word numbers and those of each following window, ``B`` to
``2B - 1`` words further on (at the smallest scale 1 to ``2B - 1``), come
from one exact integer number-theoretic transform; a sum of zero is an
occurrence without a mismatch, and its distance is a period to try. A run of
length at least ``3q`` holds a whole block of its period's scale that occurs
again ``q`` words on, so every run has a seed. Seeds are joined along a
distance and extended word by word to the maximal stretch; of stretches over
the same words the smallest period is kept.

The transforms work modulo a prime near 2**29. Where a sum could reach the
modulus, the blocks with a zero are transformed again modulo further primes,
until their product exceeds any possible sum; so a zero is exact at any size.

A text is one row and one task's work: n log n for n words, with a few
arrays of its word count in memory. Texts up to 2**24 words are covered (the
primes' largest transform); longer ones raise an error. Nothing is shuffled.

Edge cases: a null or empty text has no words and no runs, and an empty
collapsed text; a null key keeps its row; repeated rows are judged apart;
an empty table gives no rows; other columns are ignored unless kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import binary_rows, slices

MIN_LENGTH = 24
SMALLEST = 8  # a run of 24 words holds a block of 8 that occurs again within 15 words
MAX_WORDS = 1 << 24

# Primes with large powers of two in p - 1, and a generator of each.
PRIMES = ((469762049, 3), (167772161, 3), (754974721, 11))
SLAB = 1 << 17  # elements of one transform at a time

_ROOTS: dict[tuple[int, int, bool], np.ndarray] = {}


def _twiddles(p: int, g: int, size: int, inverse: bool) -> np.ndarray:
    """The first half of the powers of a primitive root of order ``size``, as a column."""
    key = (p, size, inverse)
    if key not in _ROOTS:
        w = pow(g, (p - 1) // size, p)
        if inverse:
            w = pow(w, p - 2, p)
        out = np.ones(max(1, size // 2), np.uint64)
        have = 1
        while have < len(out):  # doubling: powers have..2*have-1 from the first ones
            n = min(have, len(out) - have)
            out[have:have + n] = out[:n] * np.uint64(pow(w, have, p)) % np.uint64(p)
            have += n
        _ROOTS[key] = out[:, None]
    return _ROOTS[key]


def _forward(x: np.ndarray, p: int, g: int) -> np.ndarray:
    """Transforms of the columns of ``x`` (B words, below p) followed by B zeros, in bit-reversed order."""
    size, m = x.shape
    P = np.uint64(p)
    a = np.empty((2 * size, m), np.uint64)
    a[:size] = x
    np.multiply(x, _twiddles(p, g, 2 * size, False), out=a[size:])
    a[size:] %= P
    high = 1  # values are below high * p
    h = size // 2
    while h:
        v = a.reshape(size // h, 2, h, m)
        diff = v[:, 0] + np.uint64(high * p)
        diff -= v[:, 1]
        v[:, 0] += v[:, 1]
        diff *= _twiddles(p, g, 2 * h, False)
        np.remainder(diff, P, out=v[:, 1])
        high *= 2
        if high > 8:
            a %= P
            high = 1
        h //= 2
    return a if high == 1 else a % P


def _inverse(a: np.ndarray, p: int, g: int) -> np.ndarray:
    """Inverse transforms of columns in bit-reversed order, times the column length (values not reduced)."""
    n, m = a.shape
    P = np.uint64(p)
    h = 1
    while h < n:
        v = a.reshape(n // (2 * h), 2, h, m)
        t = v[:, 1] * _twiddles(p, g, 2 * h, True)
        t %= P
        np.add(v[:, 0], P, out=v[:, 1])
        v[:, 1] -= t
        v[:, 0] += t
        h *= 2
    return a


def _negated(n: int) -> np.ndarray:
    """Places of the frequencies -k in bit-reversed order: each dyadic range turned round."""
    out = np.arange(n)
    lo = 2
    while lo < n:
        out[lo:2 * lo] = out[lo:2 * lo][::-1]
        lo *= 2
    return out


def _zeros(blocks: np.ndarray, squares: np.ndarray, first: int, p: int, g: int, columns: np.ndarray) -> np.ndarray:
    """Whether the sum of squared differences between block j and the words ``first * B + d`` further on is 0
    modulo p, for d in 0..B-1 and the given columns j. ``squares`` holds the sums of squares of the B words that
    begin at each place, laid out as ``blocks``."""
    size = len(blocks)
    P = np.uint64(p)
    near = columns + first
    f = _forward(blocks, p, g)
    window = f[:, near]  # two blocks side by side: the second one's odd frequencies change sign
    window[:size] += f[:size, near + 1]
    window[size:] += P - f[size:, near + 1]
    window %= P
    window *= f[:, columns][_negated(2 * size)]
    window %= P
    cross = _inverse(window, p, g)[:size]
    total = squares[0, columns] + squares[:, near]
    total %= P
    total *= np.uint64(2 * size)
    return (cross * np.uint64(2) % P) == total % P


def _seeds(flat: np.ndarray, size: int, first: int, highest: int, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(block, distance) of every occurrence without a mismatch of the wanted blocks of ``flat`` (word numbers up to
    ``highest``, whole blocks and two more), ``first * size + 0..size-1`` words further on."""
    bound = size * highest * highest
    width = max(2, SLAB // (2 * size))
    found_j, found_d = [], []
    for lo in range(0, len(wanted), width):
        cols = wanted[lo:lo + width]
        base = int(cols[0])
        part = flat[base * size:(int(cols[-1]) + 4) * size]
        hits = None
        modulus = 1
        for p, g in PRIMES:
            x = part.astype(np.uint64)
            sq = np.concatenate([[0], np.cumsum(x * x % np.uint64(p))]).astype(np.uint64)
            sums = sq[size:] - sq[:-size]  # of the size words from each place
            sums = sums[:len(sums) // size * size].reshape(-1, size).T
            blocks = x.reshape(-1, size).T
            use = cols - base
            if hits is None:
                hits = _zeros(blocks, sums, first, p, g, use)
            else:  # only blocks with a zero so far
                some = np.flatnonzero(hits.any(axis=0))
                if len(some):
                    hits[:, some] &= _zeros(blocks, sums, first, p, g, use[some])
            modulus *= p
            if modulus > bound:
                break
        d, j = np.nonzero(hits)
        found_j.append(cols[j])
        found_d.append(d + first * size)
    if not found_j:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_j), np.concatenate(found_d)


def _agreement(x: np.ndarray, a: np.ndarray, d: np.ndarray, limit: np.ndarray, way: int) -> np.ndarray:
    """How many words agree with those ``d`` further on, from ``a`` in direction ``way``, at most ``limit``."""
    out = np.zeros(len(a), np.int64)
    active = np.flatnonzero(limit > 0)
    step = 8
    while len(active):
        done = []
        for lo in range(0, len(active), max(1, (1 << 20) // step)):
            act = active[lo:lo + max(1, (1 << 20) // step)]
            t = out[act][:, None] + np.arange(step)
            inside = t < limit[act][:, None]
            at = np.where(inside, a[act][:, None] + way * t, 0)
            same = inside & (x[at] == x[np.where(inside, at + d[act][:, None], 0)])
            n = np.where(same.all(axis=1), step, same.argmin(axis=1))
            out[act] += n
            done.append(act[n == step])
        active = np.concatenate(done)
        step = min(2 * step, 4096)
    return out


def find_runs(docs: Sequence[np.ndarray], min_length: int = MIN_LENGTH) -> list[list[tuple[int, int, int]]]:
    """Runs (start, length, period) by start, then period, of each sequence of word numbers (from 0, per sequence)."""
    if min_length < 3 * SMALLEST:
        raise ValueError(f"runs are at least {3 * SMALLEST} words long")
    sizes = np.array([len(d) for d in docs], np.int64)
    if len(sizes) and sizes.max() > MAX_WORDS:
        raise ValueError(f"a text has more than {MAX_WORDS} words")
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(sizes) else sizes
    x = np.concatenate(docs) if len(docs) else np.zeros(0, np.int64)
    highest = np.array([int(d.max()) if len(d) else 0 for d in docs], np.int64)
    runs: list[dict[tuple[int, int], int]] = [{} for _ in docs]
    size = SMALLEST
    while True:
        use = np.flatnonzero(sizes >= max(min_length, 3 * size if size > SMALLEST else 0))
        if not len(use):
            break
        counts = -(-sizes[use] // size)
        first_block = np.concatenate([[0], np.cumsum(counts)])
        flat = np.zeros((int(first_block[-1]) + 4) * size, np.int64)
        wanted = np.zeros(int(first_block[-1]), bool)
        for i, d in enumerate(use):
            lo, n = int(first_block[i]), int(sizes[d])
            flat[lo * size:lo * size + n] = docs[d]
            wanted[lo:lo + n // size] = True
            for (s, length), q in runs[d].items():  # blocks whose windows lie in a known run: only multiples of its period
                if q <= size:
                    last = (s + length) // size - 3 if s + length < n else n // size - 1
                    wanted[lo - (-s // size):lo + max(last + 1, 0)] = False
        cols = np.flatnonzero(wanted)
        found = [_seeds(flat, size, k, int(highest[use].max()), cols) for k in ((0, 1) if size == SMALLEST else (1,))]
        j, d = (np.concatenate(c) for c in zip(*found))
        doc = np.searchsorted(first_block, j, side="right") - 1
        b = (j - first_block[doc]) * size
        n = sizes[use[doc]]
        ok = (d > 0) & (b + d + size <= n) & (3 * d <= n)
        doc, b, d = use[doc[ok]], b[ok], d[ok]
        if len(d):
            order = np.lexsort((b, doc, d))
            doc, b, d = doc[order], b[order], d[order]
            new = np.r_[True, (np.diff(d) != 0) | (np.diff(doc) != 0) | (np.diff(b) != size)]
            head = np.flatnonzero(new)  # neighbouring blocks at one distance are one seed
            tail = np.r_[head[1:], len(d)] - 1
            doc, lo, hi, d = doc[head], b[head], b[tail] + size, d[head]
            at = starts[doc]
            left = lo - _agreement(x, at + lo - 1, d, lo, -1)
            right = hi + _agreement(x, at + hi, d, sizes[doc] - d - hi, 1)
            length = right + d - left
            for i in np.flatnonzero(length >= np.maximum(min_length, 3 * d)):  # by distance: the smallest period first
                runs[doc[i]].setdefault((int(left[i]), int(length[i])), int(d[i]))
        size *= 2
    return [sorted((s, n, q) for (s, n), q in r.items()) for r in runs]


def kept_words(n: int, runs: Sequence[tuple[int, int, int]]) -> np.ndarray:
    """Which of ``n`` words remain when every run is reduced to its first period."""
    keep = np.ones(n, bool)
    for s, length, q in runs:
        keep[s + q:s + length] = False
    return keep


def strongest(runs: Sequence[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of the greatest exact length / period; ties to the smallest start, then period."""
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", min_length: int = MIN_LENGTH,
                  rewrite: Callable[[object, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """One row per document: key, n_words, runs (array of start, length, period), best (the run of the greatest
    exponent, or null), collapsed (the words that remain when each run keeps its first period, joined by spaces).

    Words are separated by ASCII white space. ``rewrite`` may change a row's words (given its key) beforehand.
    """
    src = docs.select(F.col(key).alias("_k"), F.col(text).cast("string").alias("_t"))
    kind = src.schema["_k"].dataType.simpleString()
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1 << 20, "_t"):
            keys, words, numbers = b.column(0).to_pylist(), [], []
            for k, t in zip(keys, binary_rows(b.column(1))):
                w = t.split()
                if rewrite is not None:
                    w = rewrite(k, w)
                seen: dict[bytes, int] = {}
                number = seen.setdefault
                words.append(w)
                numbers.append(np.fromiter((number(v, len(seen)) for v in w), np.int64, len(w)))
            found = find_runs(numbers, min_length)
            best = [strongest(r) for r in found]
            left = [b" ".join([v for v, k in zip(w, kept_words(len(w), r)) if k] if r else w).decode("utf-8", "replace")
                    for w, r in zip(words, found)]
            yield pa.RecordBatch.from_arrays([
                b.column(0), pa.array([len(w) for w in words], pa.int64()),
                pa.array([[dict(zip(("start", "length", "period"), r)) for r in rs] for rs in found], pa.list_(run_type)),
                pa.array([r and dict(zip(("start", "length", "period"), r)) for r in best], run_type),
                pa.array(left, pa.string())], names=["_k", "n_words", "runs", "best", "collapsed"])

    a_run = "struct<start:bigint,length:bigint,period:bigint>"
    return src.mapInArrow(run, f"_k {kind}, n_words long, runs array<{a_run}>, best {a_run}, collapsed string"
                          ).withColumnRenamed("_k", key)
