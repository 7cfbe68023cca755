"""Periodic runs, personal data and the prefix trie against plain-Python versions."""

import hashlib
import os
import random
import re
import sys
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
import helpers  # noqa: E402

from fleetlens.llm import periodic, pii, queries, trie  # noqa: E402
from fleetlens.llm.common import materialize  # noqa: E402

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"


# --- periodic runs ---------------------------------------------------------------

def numbered(words):
    seen = {}
    return np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)


def made_text(rnd):
    out = []
    for _ in range(rnd.randrange(1, 7)):
        values = rnd.choice([1, 2, 3, 50, 10 ** 6])
        if rnd.random() < 0.35:
            out += [rnd.randrange(values) for _ in range(rnd.randrange(60))]
        else:
            q = rnd.choice([1, 2, 3, 5, 7, 8, 9, 15, 16, 17, 31, 33, 40])
            unit, n = [rnd.randrange(values) for _ in range(q)], rnd.randrange(2 * q, max(30, 6 * q))
            out += (unit * (n // q + 1))[:n]
        if out and rnd.random() < 0.3:
            out += out[-rnd.randrange(1, 40):]
    return out


def test_runs_match_brute_force():
    rnd, total = random.Random(11), 0
    for _ in range(25):
        texts = [made_text(rnd) for _ in range(20)] + [[], [1] * 23, [1] * 24, [1, 2] * 12, list(range(30)), [0] * 200]
        got = periodic.find_runs([numbered(t) for t in texts])
        want = [helpers.runs(t) for t in texts]
        assert got == want
        total += sum(map(len, want))
    assert total > 500


def test_every_period_and_length_at_the_edge():
    for q in range(1, 70):
        unit = list(range(q))
        for n in {max(24, 3 * q) - 1, max(24, 3 * q), 4 * q + 24}:
            for shift in (0, 1, 5, 8, 13):
                text = [1000 + i for i in range(shift)] + (unit * (n // q + 1))[:n] + [2000, 2001]
                want = [(shift, n, q)] if n >= max(24, 3 * q) else []
                assert periodic.find_runs([numbered(text)]) == [want], (q, n, shift)


def test_sums_beyond_one_prime_are_exact():
    n = 9000  # numbers up to 9,000 at blocks of 2,048: sums of squares far above the first prime
    assert periodic.find_runs([np.arange(n * 3 + 5) % n]) == [[(0, n * 3 + 5, n)]]
    p = periodic.PRIMES[0][0]
    x = np.zeros(24, np.int64)
    x[:8] = [0, 0, 0, 0, 0, 0, 0, 1]
    far = int(np.sqrt(p)) + 1  # one pair of words this far apart: its square is near the prime, not zero
    for gap in (far, 2 * far, p):
        y = np.concatenate([x, [gap], x])
        assert periodic.find_runs([y]) == [helpers.runs(y.tolist())]


def test_transform_counts_are_plain_sums():
    rnd = np.random.default_rng(3)
    for size in (8, 16, 64):
        flat = np.concatenate([rnd.integers(0, 2, 12 * size), np.zeros(4 * size, np.int64)])
        j, d = periodic._seeds(flat, size, 1, 1, np.arange(10))
        want = {(b, k) for b in range(10) for k in range(size, 2 * size)
                if (flat[b * size:(b + 1) * size] == flat[b * size + k:(b + 1) * size + k]).all()}
        assert set(zip(j.tolist(), d.tolist())) == want


def test_long_hot_texts():
    rnd = random.Random(2)
    one = [7] * 120_000
    mixed = [w for _ in range(300) for w in [1] * rnd.randrange(20, 120) + [2 + rnd.randrange(3)]]
    got = periodic.find_runs([numbered(one), numbered(mixed)])
    assert got == [[(0, 120_000, 1)], helpers.runs(mixed)]


def brute_op11(doc_id, text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = helpers.runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(runs), *best, None if not runs else 1000 * best[1] // best[2],
            sha("".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()),
            sha(b" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_op11_on_the_documents_and_awkward_rows(spark, tmp_path):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows += [(None, "a b " * 40), (None, None), (10 ** 12, ""), (10 ** 12 + 1, " \t\n"), (5, "la " * 30), (5, "la " * 30),
             (-3, "x y " * 30), (77, "é ü " * 5000)]
    spark.createDataFrame([(*r, 1, "q") for r in rows], DOCS + ", n_words int, runs string").write.parquet(
        str(tmp_path / "documents.parquet"))
    got = queries.op11_periodic_runs(spark, str(tmp_path))
    want = sorted((brute_op11(*r) for r in rows), key=repr)
    assert helpers.rows(got, "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256",
                        "collapsed_sha256") == want
    assert sum(w[1] > 0 for w in want) > 20
    assert periodic.periodic_runs(spark.createDataFrame([], DOCS)).collect() == []


def test_bad_limits_are_refused():
    with pytest.raises(ValueError):
        periodic.find_runs([np.zeros(30, np.int64)], min_length=10)


# --- personal data ---------------------------------------------------------------

PIECES = ["a", "b@", "@", "c.d", ".", "-", "1", "22", "255", "256", "0", "+1", "+", " ", "(", ")", "%", "_", "é", "x@y.z",
          "4111 1111 1111 1111", "4", "\n", "1.2.3.4", "01", "+49 30 1234567"]


def base_only(text):
    return [x[:3] for x in pii.find_spans(text) if x[0] in pii.BASE_KINDS]


def test_base_spans_match_the_plain_patterns():
    rnd = random.Random(12)
    for _ in range(20_000):
        t = "".join(rnd.choice(PIECES) for _ in range(rnd.randrange(14)))
        assert base_only(t) == helpers.personal_data(t), t
    for t in ("0" * 5000 + ".1.1.1", "1" * 5000, "a@b.co_x@d.ef%g@h.i", "4111-1111 1111-1111", "1.2.3.4.5.6.7.8.9"):
        assert base_only(t) == helpers.personal_data(t)


@pytest.mark.parametrize("text", ["1" * 300_000, "a" * 300_000, "a@" * 100_000, "+1 " * 100_000, "1.1.1." * 50_000,
                                  "a.b-" * 80_000 + "@", "AB12 " * 60_000, "+1" + " " * 200_000, "(555)" * 50_000, "1-" * 100_000])
def test_no_text_is_slow(text):
    import time
    t0 = time.process_time()
    pii.find_spans(text)
    assert time.process_time() - t0 < 5


def test_checks_and_context():
    spans = lambda t: [(k, t[s:e]) for k, s, e, _ in pii.find_spans(t)]
    assert spans("IBAN DE89 3704 0044 0532 0130 00 OK") == [("iban", "DE89 3704 0044 0532 0130 00")]
    assert spans("GB82WEST12345698765432.") == [("iban", "GB82WEST12345698765432")]
    assert spans("DE88 3704 0044 0532 0130 00") == [] and spans("xDE89370400440532013000") == []
    assert spans("commit GB82WEST12345698765432") == [("iban", "GB82WEST12345698765432")]  # 0.5: at the threshold
    assert spans("my SSN is 123-45-6789") == [("ssn", "123-45-6789")] and spans("123-45-6789") == []
    assert spans("ssn 666-45-6789 ssn 123-00-6789 ssn 923-45-6789 ssn 123-45-0000") == []
    assert spans("order 123-45-6789") == [] and spans("ssn order 123-45-6789") == []  # the nearest word decides
    assert spans("call (555) 123-4567 now") == [("local_phone", "(555) 123-4567")] and spans("see 555-123-4567") == []
    assert spans("call +1 555-123-4567") == [("phone", "+1 555-123-4567")]  # not twice
    scores = {k: x for k, *_, x in pii.find_spans("order 4111111111111111")}
    assert scores == {"card": 0.4} and pii.find_spans("visa 4111111111111111")[0][3] == 0.95  # base spans stay
    assert pii.find_spans("4111111111111112") == []
    assert pii.redact("mail a@b.co, +49 30 1234567!", pii.find_spans("mail a@b.co, +49 30 1234567!")) == "mail [email], [phone]!"


def test_op12_on_the_documents_and_awkward_rows(spark, tmp_path):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows += [(None, "x@y.zz 1.2.3.4"), (None, None), (10 ** 12, ""), (5, "é x@y.zz"), (5, "é x@y.zz"), (6, "iban GB82WEST12345698765432 x@y.zz")]
    spark.createDataFrame([(*r, "q") for r in rows], DOCS + ", spans string").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op12_pii(spark, str(tmp_path))
    want = []
    for k, t in rows:
        found = helpers.personal_data(t or "")
        text = ",".join(f"{a}:{b}:{c}" for a, b, c in found)
        want.append((k, *(sum(f[0] == n for f in found) for n in pii.BASE_KINDS), hashlib.sha256(text.encode()).hexdigest()))
    assert helpers.rows(got, "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256") == sorted(want, key=repr)
    assert sum(sum(w[1:5]) > 0 for w in want) > 5
    by_id = {r["doc_id"]: r["spans"] for r in got.collect()}
    assert by_id[6] == "iban:5:27,email:28:34" and by_id[10 ** 12] == ""
    red = pii.find_pii(spark.createDataFrame([(1, "é x@y.zz"), (2, None)], DOCS), with_redacted=True)
    assert {r["doc_id"]: r["redacted"] for r in red.collect()} == {1: "é [email]", 2: None}
    assert pii.find_pii(spark.createDataFrame([], DOCS)).collect() == []


# --- prefix trie -------------------------------------------------------------------

CONVERSATIONS = "conv_id long, turn long, role string, text string"


def test_trie_of_awkward_conversations(spark, tmp_path):
    rnd = random.Random(13)
    rows = []
    for c in [*range(60), 10 ** 12, -40, -41, 2 ** 40 + 20]:
        rows += [(c, n, rnd.choice(["user", "assistant", None]), rnd.choice(["a b", "c", None, "", "  x\ty "]))
                 for n in range(rnd.randrange(1, 7))]
    rows += [(3, None, "user", "first"), (3, None, None, None), (4, 0, "user", "tie"), (4, 0, "user", "a tie"), (None, 1, "user", "lost")]
    rows += [(100 + c, n, "user", "copy") for c in range(40) for n in range(5)] + rows[:5]
    rows += [(201, n, "user", f"w{n}") for n in range(300)] + [(202, n, "user", f"w{n}") for n in range(280)]  # long chains
    spark.createDataFrame([(*r, 1, "z") for r in rows], CONVERSATIONS + ", depth int, a string").repartition(5).write.parquet(
        str(tmp_path / "conversations.parquet"))
    got = queries.op13_prefix_trie(spark, str(tmp_path))
    columns = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    assert helpers.rows(got, *columns) == sorted(helpers.prefix_trie(rows), key=repr)


def test_empty_table_has_no_nodes(spark, tmp_path):
    spark.createDataFrame([(None, 1, "user", "x")], CONVERSATIONS).write.parquet(str(tmp_path / "conversations.parquet"))
    assert queries.op13_prefix_trie(spark, str(tmp_path)).collect() == []


def test_subtree_sums_of_any_tree(spark):
    rnd = random.Random(14)
    up = {0: None, 5000: None}
    for i in range(1, 400):
        up[i] = rnd.choice([i - 1, i - 1, i - 1, rnd.randrange(i)])  # long chains with branches
    up.update({1000 + i: 7 for i in range(300)})  # a hub of leaves
    depth = {}
    for i in sorted(up):
        depth[i] = 0 if up[i] is None else depth[up[i]] + 1
    weight = {i: rnd.randrange(100) for i in up}
    want = dict(weight)
    for i in sorted(up, key=lambda n: -depth[n]):
        if up[i] is not None:
            want[up[i]] += want[i]
    nodes = materialize(spark.createDataFrame([(i, up[i], depth[i], weight[i]) for i in up], "n long, p long, d int, w long"), "test-tree")
    got = trie.subtree_sums(nodes, "n", "p", ["w"], "d")
    assert {r["n"]: r["w"] for r in got.collect()} == want
    assert got.agg(F.count("*")).first()[0] == len(up)
