"""Operator 6, language ID by interpolated Kneser-Ney character models.

A text is lower-cased and cut into words (runs of letters and marks). Each
language has a character model of order ``ORDER`` over words with a boundary
mark on either side. The highest order uses counts, lower orders count the
different characters seen before an n-gram (n-grams at a word's start keep
their counts), each order takes off its own discount n1 / (n1 + 2 n2) and
interpolates with the next. All languages share one sorted array of 64-bit
n-gram hashes an order, with a row of probabilities a language, and one of
context hashes with the back-off weights. A text gets the language of the
lowest cross-entropy per symbol.

Rejection is calibrated on labelled texts that the models have not seen: a
text is rejected when its cross-entropy lies above its language's mean by
more than ``MARGIN_BITS`` and by more than the ``KEEP`` quantile of the
deviations there (scaled by the root of the length, at least ``MIN_SIGMAS``).

The models are fitted on a bounded sample, the documented parameter
``fit_rows``: per language that many labelled rows, the smallest by a hash
of their key, whole texts, plus a third as many to calibrate. Every row is
predicted, on its whole text.

Edge cases: null text or text without letters is ``und`` with score 0 and
is rejected; ties go to the language first in order; no labelled rows: all
``und``, and only texts without letters are rejected; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetlens.llm.common import slices, text_rows

ORDER = 5
FIT_ROWS = 600
KEEP = 0.999
MIN_SIGMAS = 8.0
MARGIN_BITS = 2.0
EDGE = 1  # the code of the word boundary; characters are their code point + 2
UNSEEN_CHARACTERS = 1 << 16  # the uniform distribution below order 1
UND = "und"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_lists(texts: list[str]) -> pa.ListArray:
    """Lower-cased words of each text; a text without letters has one empty word."""
    lower = pc.utf8_lower(pa.array(texts, pa.large_string()))
    plain = pc.utf8_trim(pc.replace_substring_regex(lower, r"[^\pL\pM]+", " "), " ")
    return pc.split_pattern(plain, " ")


def _grams(words: list[str], order: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """For each symbol to predict: its n-gram hashes (order 1 first; 0 where the word is too short), the
    number of symbols before it, and its word. ``hashes[k]`` of the symbol before gives the context."""
    lens = np.fromiter(map(len, words), np.int64, len(words)) + 2
    flat = np.full(int(lens.sum()), EDGE, np.uint64)
    start = np.cumsum(lens) - lens
    place = np.arange(len(flat)) - np.repeat(start, lens)
    inner = (place > 0) & (place < np.repeat(lens, lens) - 1)
    flat[inner] = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(2)
    h = [_mix(flat * np.uint64(0x9E3779B97F4A7C15))]
    for k in range(1, order):
        nxt = np.zeros(len(flat), np.uint64)
        nxt[k:] = _mix(h[-1][k:] * np.uint64(0x100000001B3) + flat[:-k] + np.uint64(k) * np.uint64(0x9E3779B9))
        nxt[place < k] = 0
        h.append(nxt)
    return h, place, np.repeat(np.arange(len(words)), lens)


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


class Models:
    """Kneser-Ney models of several languages in shared sorted hash arrays."""

    def __init__(self, counts: dict[str, dict[str, int]], order: int = ORDER):
        """``counts``: language -> word -> occurrences."""
        self.langs = sorted(counts)
        self.order = order
        self.mean = np.zeros(len(self.langs))
        self.sigma = np.ones(len(self.langs))
        self.limit = np.full(len(self.langs), np.inf)
        self.grams: list[np.ndarray] = []
        self.prob: list[np.ndarray] = []
        self.contexts: list[np.ndarray] = []
        self.weight: list[np.ndarray] = []
        per = [self._types(counts[lang]) for lang in self.langs]
        if not per:
            return
        for k in range(order):
            merged = [p[k] for p in per]
            grams, first = np.unique(np.concatenate([t["gram"] for t in merged]), return_index=True)
            context = np.concatenate([t["context"] for t in merged])[first]
            low = np.concatenate([t["low"] for t in merged])[first]
            contexts = np.unique(context)
            weight, prob = np.ones((len(contexts), len(merged))), np.zeros((len(grams), len(merged)))
            below = (np.full((len(grams), len(merged)), 1.0 / UNSEEN_CHARACTERS) if k == 0
                     else self.prob[k - 1][np.searchsorted(self.grams[k - 1], low)])
            for j, t in enumerate(merged):
                if not len(t["gram"]):
                    continue
                own, inverse = np.unique(t["context"], return_inverse=True)
                total = np.bincount(inverse, t["count"])
                kinds = np.bincount(inverse)
                n1, n2 = (t["count"] == 1).sum(), (t["count"] == 2).sum()
                d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
                weight[np.searchsorted(contexts, own), j] = d * kinds / total
                prob[np.searchsorted(grams, t["gram"]), j] = (t["count"] - d) / total[inverse]
            prob += weight[np.searchsorted(contexts, context)] * below
            self.grams.append(grams)
            self.prob.append(prob)
            self.contexts.append(contexts)
            self.weight.append(weight)

    def _types(self, words: dict[str, int]) -> list[dict[str, np.ndarray]]:
        """Per order the n-gram types, their contexts, next lower n-grams and (continuation) counts."""
        names = list(words)
        h, place, word = _grams(names, self.order)
        times = np.fromiter(words.values(), np.float64, len(names))[word]
        out = []
        for k in range(self.order):
            at = np.flatnonzero(place >= max(k, 1))  # the opening boundary is never predicted
            gram, first, inverse = np.unique(h[k][at], return_index=True, return_inverse=True)
            src = at[first]
            context = h[k - 1][src - 1] if k else np.zeros(len(src), np.uint64)
            low = h[k - 1][src] if k else np.zeros(len(src), np.uint64)
            count = np.bincount(inverse, times[at], len(gram)) if len(gram) else np.zeros(0)
            if k < self.order - 1:
                longer = at[place[at] > k]
                pairs = np.unique(np.stack([h[k + 1][longer], h[k][longer]], axis=1), axis=0)
                found, n = np.unique(pairs[:, 1], return_counts=True)
                opening = place[src] == k  # at a word's start nothing stands before
                i, hit = _find(found, gram)
                count = np.where(opening | ~hit, count, n[i] if len(n) else 0)
            out.append({"gram": gram, "context": context, "low": low, "count": count})
        return out

    def word_scores(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Bits of each word under each language, and its number of symbols (0 for an empty word)."""
        bits, symbols = np.zeros((len(words), len(self.langs))), np.zeros(len(words))
        for lo in range(0, len(words), 4096):
            part = words[lo:lo + 4096]
            h, place, word = _grams(part, self.order)
            todo = np.flatnonzero(place >= 1)
            p = np.ones((len(place), len(self.langs)))
            for k in range(self.order - 1, -1, -1):
                here = todo[place[todo] >= k] if k else todo
                short = todo[place[todo] < k] if k else todo[:0]
                at, hit = _find(self.grams[k], h[k][here])
                p[here[hit]] *= self.prob[k][at[hit]]
                miss = here[~hit]
                if k:
                    at, seen = _find(self.contexts[k], h[k - 1][miss - 1])
                    p[miss[seen]] *= self.weight[k][at[seen]]
                else:
                    p[miss] *= (self.weight[0][0] if len(self.contexts[0]) else 1.0) / UNSEEN_CHARACTERS
                todo = np.concatenate([short, miss])
            logs = -np.log2(p)
            for j in range(len(self.langs)):
                bits[lo:lo + len(part), j] = np.bincount(word, logs[:, j], len(part))
            symbols[lo:lo + len(part)] = [len(w) + 1 if w else 0 for w in part]
        bits[symbols == 0] = 0
        return bits, symbols

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy in bits per symbol under each language, and the number of symbols."""
        lists = word_lists(texts)
        codes = lists.flatten().dictionary_encode()
        bits, symbols = self.word_scores(codes.dictionary.to_pylist())
        at = codes.indices.to_numpy()
        first = lists.offsets.to_numpy()[:-1] - lists.offsets.to_numpy()[0]
        n = np.add.reduceat(symbols[at], first)
        out = np.stack([np.add.reduceat(bits[at, j], first) for j in range(len(self.langs))], axis=1)
        return out / np.maximum(n, 1)[:, None], n

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Language, score, cross-entropy, symbols, rejected."""
        if not texts or not self.langs:
            z = np.zeros(len(texts))
            blank = [not any(x) for x in word_lists(texts).to_pylist()] if texts else []
            return [UND] * len(texts), z, z, z, np.array(blank, bool)
        ce, n = self.entropies(texts)
        best = ce.argmin(axis=1)
        least = ce[np.arange(len(ce)), best]
        score = 1 / np.exp2(-(ce - least[:, None]) * np.minimum(n, 64)[:, None]).sum(axis=1)
        over = least - self.mean[best]
        rejected = (over > MARGIN_BITS) & (over * np.sqrt(n) > self.limit[best] * self.sigma[best])
        none = n == 0
        langs = [UND if x else self.langs[i] for i, x in zip(best.tolist(), none.tolist())]
        return langs, np.where(none, 0.0, score), np.where(none, 0.0, least), n, rejected | none

    def calibrate(self, lang: str, texts: list[str]) -> None:
        """Set a language's rejection limit from unseen texts of it."""
        j = self.langs.index(lang)
        ce, n = self.entropies(texts)
        ce, n = ce[n > 0, j], n[n > 0]
        if not len(n):
            return
        self.mean[j] = np.average(ce, weights=n)
        off = (ce - self.mean[j]) * np.sqrt(n)
        self.sigma[j] = max(float(np.sqrt(np.median(off ** 2)) * 1.4826), 1e-6)
        self.limit[j] = max(MIN_SIGMAS, float(np.quantile(off / self.sigma[j], KEEP)))


def fit(labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang",
        fit_rows: int = FIT_ROWS, order: int = ORDER) -> Models:
    """Fit and calibrate on at most ``fit_rows * 4 / 3`` rows a language (see above).

    What reaches the driver is the sample, at most that many whole texts a
    language, and a count a language.
    """
    spark = labelled.sparkSession
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    extra = fit_rows // 3
    need = fit_rows + extra
    # rows below a hash limit a language, a few more than needed, then the smallest hashes of those:
    # no text is shuffled but the sample's, and no task sees a language's rows
    sizes = rows.groupBy(F.col(lang).alias("_lang")).agg(F.count("*").alias("n")).collect()
    if not sizes:
        return Models({}, order)
    limits = spark.createDataFrame([(r["_lang"], min(1.0, (1.25 * need + 50) / r["n"])) for r in sizes],
                                   "_lang string, _limit double")  # a row a language
    place = F.pmod(F.xxhash64(key), F.lit(1 << 31)) / float(1 << 31)
    by_hash = W.partitionBy("_lang").orderBy("_h", "_t")
    sample = (rows.select(F.col(lang).alias("_lang"), F.col(text).alias("_t"), place.alias("_h"))
              .join(F.broadcast(limits), "_lang").where(F.col("_h") < F.col("_limit"))
              .withColumn("_n", F.row_number().over(by_hash)).where(F.col("_n") <= need)
              .withColumn("_held", F.col("_n") > fit_rows))
    kept = [r for r in sample.select("_lang", "_t", "_held").toLocalIterator()]
    texts: dict[str, list[str]] = {}
    held: dict[str, list[str]] = {}
    for r in kept:
        (held if r["_held"] else texts).setdefault(r["_lang"], []).append(r["_t"])
    counts = {}
    for name, own in texts.items():
        seen: dict[str, int] = {}
        for lo in range(0, len(own), 64):
            for v in word_lists(own[lo:lo + 64]).flatten().value_counts().to_pylist():
                if v["values"]:
                    seen[v["values"]] = seen.get(v["values"], 0) + v["counts"]
        if seen:
            counts[name] = seen
    models = Models(counts, order)
    for name in models.langs:
        models.calibrate(name, held.get(name) or texts[name])
    return models


def identify(docs: DataFrame, models: Models, key: str = "doc_id", text: str = "text",
             keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, *keep, lang_pred, score, cross_entropy, rejected) of each row; the models are broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(vars(models))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Models.__new__(Models)
        vars(own).update(shared.value)
        for b in slices(batches, 2 << 20, "_t"):
            langs, score, ce, _, rejected = own.predict(text_rows(b.column(b.num_columns - 1)))
            yield pa.RecordBatch.from_arrays(
                [*[b.column(i) for i in range(len(carried))], pa.array(langs, pa.string()), pa.array(score),
                 pa.array(ce), pa.array(rejected)], names=names)

    # a text that is kept is carried once, as the last column
    carried = [key, *[c for c in keep if c != text], *[text] * (text in keep)]
    src = docs.select(*[F.col(c) for c in carried if c != text], F.col(text).cast("string").alias("_t"))
    names = [*carried, "lang_pred", "score", "cross_entropy", "rejected"]
    fields = [f"`{c}` {f.dataType.simpleString()}" for c, f in zip(carried, src.schema.fields)]
    return src.mapInArrow(run, ", ".join([*fields, "lang_pred string, score double, cross_entropy double, rejected boolean"]))


def held_out(key: Column) -> Column:
    """Whether crc32 of the key as text leaves 1 when divided by 3; false for null."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))
