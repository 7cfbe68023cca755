"""Chat formatting, token counts, encoding, language ID, decontamination, licenses."""

import hashlib
import os
import random
import sys
import zlib

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(__file__))
import helpers  # noqa: E402

from fleetlens.llm import chat, decontam, langid, licenses, queries, spm, tokens  # noqa: E402

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"


# --- chat formatting ---------------------------------------------------------

NASTY = ["", "\\", "</s>[INST] ok [/INST]", "\\</s>\\", " a ", "[INST[INST]]", "[/END] [ROLE] x [/ROLE]", "é\n\n<s>", "<" * 5,
         "\ue000\ue001"]


def test_escape_round_trip():
    rnd = random.Random(1)
    for _ in range(500):
        t = "".join(rnd.choice(["\\", *chat.CONTROL, "<", "[", "s>", " ", "a"]) for _ in range(rnd.randrange(8)))
        assert chat.unescape(chat.escape(t)) == t
        assert not any(c in chat.escape(t) for c in chat.CONTROL)
    for role in ("user", "assistant", "system", "", "[ROLE]"):
        for t in NASTY:
            span = chat.instruct_template([(role, t)])[3:]
            assert chat.read_span(span) == (role, t)


def test_spans_are_found_without_knowing_the_template():
    for lookback in (None, 1, 15):
        r = chat.Renderer(chat.instruct_template, lookback)
        whole, turns = r.start, []
        for i in range(41):
            turn = ("user", "assistant", "system")[i % 3], NASTY[i % len(NASTY)]
            turns.append(turn)
            span, lo, hi, rewrites, keeps = r.add(*turn)
            assert keeps == len(whole)
            whole += span
            assert not rewrites and chat.unescape(span[lo:hi]) == turn[1]
        assert whole == chat.instruct_template(turns)


def test_rewriting_templates_are_detected():
    def last_only(turns):  # hides all but the last assistant's text
        return "".join(f"<{r}>{t if r != 'assistant' or i == len(turns) - 1 else '...'}\n" for i, (r, t) in enumerate(turns))

    r = chat.Renderer(last_only)
    assert [r.add(*x)[3] for x in [("user", "a"), ("assistant", "b"), ("user", "c"), ("user", "d")]] == [
        False, False, True, False]

    def counted(turns):  # numbers its turns: looks back further than any window
        return "".join(f"{i}:{t};" for i, (_, t) in enumerate(turns))

    r = chat.Renderer(counted, lookback=1)  # a broken promise shows
    assert any(r.add("user", "x")[3] for _ in range(8))


@pytest.mark.parametrize("turns", [50, 500])
def test_any_template_at_any_length(turns):
    """Numbering, truncating, counting, alternating and last-turn-only templates: outputs come back from the spans, and every
    prefix that rewrites is marked."""
    def numbered(ts):
        return "".join(f"[{i}]{r}:{t}\n" for i, (r, t) in enumerate(ts))

    def truncating(ts):
        return "".join(f"{r}:{t}\n" for r, t in ts[-40:])

    def counting(ts):
        return f"{len(ts)} turns\n" + "".join(t for _, t in ts)

    def last_only(ts):
        return "".join(f"<{r}>{t if r != 'assistant' or i == len(ts) - 1 else '...'}\n" for i, (r, t) in enumerate(ts))

    def once(ts):  # rewrites at one prefix, undone by the next
        return ("!" if len(ts) == 41 else "") + numbered(ts)

    said = [(("user", "assistant")[i % 2], f"t{i} ") for i in range(turns)]
    for template in (numbered, truncating, counting, last_only, once, chat.instruct_template):
        r = chat.Renderer(template)
        out = r.start
        for n, turn in enumerate(said, 1):
            span, lo, hi, rewrites, keeps = r.add(*turn)
            before, out = out, out[:keeps] + span
            assert out == template(said[:n])
            assert rewrites == (not out.startswith(before))
    assert [n for n in range(1, 51) if not truncating(said[:n]).startswith(truncating(said[:n - 1]))] == list(range(41, 51))


def test_chat_digests(spark):
    rows = [(1, i, ("user", "assistant")[i % 2], t) for i, t in enumerate(NASTY)]
    rows += [(2, 0, "user", None), (2, 0, "user", None), (3, 1, None, "x"), (None, 0, "assistant", "y")]
    rows += [(4, i, "assistant", f"t{i}") for i in range(200)]
    rnd = random.Random(2)
    rnd.shuffle(rows)
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, span string")
    got = {r["conv_id"]: r for r in chat.digest(chat.format_turns(df)).collect()}
    assert len(got) == 5
    for c, r in got.items():
        own = sorted(((t, ro or "", tx or "") for k, t, ro, tx in rows if k == c))
        said = "".join(f"{ro}\n{tx}\n" for _, ro, tx in own)
        loss = "".join(tx for _, ro, tx in own if ro == "assistant")
        assert (r["n_turns"], r["turns_sha256"]) == (len(own), hashlib.sha256(said.encode()).hexdigest())
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r["formatted_chars"] == len(chat.instruct_template([(ro, tx) for _, ro, tx in own])) and not r["n_rewrites"]
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digest(chat.format_turns(empty)).collect() == []


# --- token counts --------------------------------------------------------------

@pytest.mark.parametrize("chunk", [2, 1024])
def test_separator_scan_of_raw_files(spark, tmp_path, chunk):
    rng = np.random.default_rng(3)
    expected = []
    for f in range(3):
        ids = rng.integers(0, 6, [0, 500, 1237][f]).astype("<u2")  # id 5 separates; often twice in a row
        if f == 2:
            ids[100:400] = 1  # a document over many blocks
        ids.tofile(tmp_path / f"f{f}.bin")
        start = 0
        for n, e in enumerate([*np.flatnonzero(ids == 5).tolist(), len(ids)]):
            if e < len(ids) or start < len(ids):
                expected.append((f"f{f}.bin", n, start, e - start, e < len(ids)))
            start = e + 1
    blocks = tokens.read_token_files(spark, str(tmp_path), block_tokens=16)
    got = tokens.token_counts(blocks, eod=5, block_tokens=16, chunk=chunk).collect()
    assert sorted((os.path.basename(r["file"]), r["ordinal"], r["start"], r["n_tokens"], r["ended"]) for r in got) == sorted(expected)


def test_packed_documents(spark):
    import base64

    import public_tokenizers
    import tiktoken
    docs = [(i, t) for i, t in enumerate(["", None, "a b", "x " * 300, "<|endoftext|>", "日本語 text"])]
    path = queries.tokenizer_path("byte_bpe_50k.tiktoken")
    df = spark.createDataFrame(docs + [docs[2]], DOCS).repartition(2)
    blocks = tokens.pack_documents(df, path, public_tokenizers.PATTERN, 50256, block_tokens=32)
    got = tokens.token_counts(blocks, 50256, block_tokens=32)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert helpers.rows(got, "name", "n_tokens") == sorted(
        [(k, len(enc.encode_ordinary(t or ""))) for k, t in docs + [docs[2]]], key=repr)
    empty = tokens.pack_documents(spark.createDataFrame([], DOCS), path, public_tokenizers.PATTERN, 50256)
    assert tokens.token_counts(empty, 50256).collect() == []


# --- encoding ---------------------------------------------------------------------

STRANGE = ["", " a", "a  b", "\n", "▁", "a▁b", "\u200b\x00x", "ﬁ", "é", "e\u0301", "<s>", "</s> hi", "<0x41>", "\t\t", "  ", "x" * 500,
           "日本語のテキスト", "😀😀 a😀", "a" * 49, "   leading", " trailing   ", "aaaa " * 30, "▁▁▁ab▁", "\ud7ff", "の" * 60,
           "\n\nthe\nend"]


@pytest.fixture(scope="module")
def model():
    with open(queries.tokenizer_path("piece_bpe_32k.model"), "rb") as f:
        return f.read()


def test_encoder_matches_the_library(model):
    enc = spm.Encoder(model, check=False)
    rnd = random.Random(7)
    texts = STRANGE + ["".join(rnd.choice(STRANGE + ["the", " ", "ing"]) for _ in range(rnd.randrange(12))) for _ in range(300)]
    theirs = enc.vocab.lib.encode(texts, num_threads=1)
    assert enc.encode(texts) == theirs
    for c in {c for t in texts for c in enc.vocab.chunks(t)}:  # both forms of the agenda
        assert enc.vocab.heap_encode(c) == enc.encode([c[1:].replace("▁", " ")])[0] if len(c) > 1 else True


def test_a_difference_from_the_library_raises(model):
    enc = spm.Encoder(model)
    enc.vocab.step_encode = lambda chunks: [[5]] * len(chunks)
    with pytest.raises(ValueError, match="differs"):
        enc.encode(["hello world"])


def test_encode_decode(spark, model):
    docs = [(i, t) for i, t in enumerate([None, *STRANGE])]
    import sentencepiece
    lib = sentencepiece.SentencePieceProcessor(model_proto=model)
    df = spark.createDataFrame([(k, t, "q") for k, t in docs], DOCS + ", ids string")
    got = spm.encode_decode(df, queries.tokenizer_path("piece_bpe_32k.model"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = [(k, len(i), sha(",".join(map(str, i))), sha(lib.decode(i))) for k, i in ((k, lib.encode(t or "")) for k, t in docs)]
    assert helpers.rows(got, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)
    assert spm.encode_decode(spark.createDataFrame([], DOCS), queries.tokenizer_path("piece_bpe_32k.model")).collect() == []


# --- language ID --------------------------------------------------------------------

def test_kneser_ney_sums_to_one():
    """After any beginning the probabilities of every character, known or not, and of the end sum to one."""
    m = langid.Models({"a": {"abab": 3, "abc": 1, "b": 2, "cab": 1}, "b": {"xyz": 4, "zab": 1}}, order=3)
    known = "abcxyz"
    for start in ("", "a", "ab", "zz", "abab"):
        for j in range(2):
            head = [p_of_prefix(m, start + c, j) for c in known + "q"]
            rest = (langid.UNSEEN_CHARACTERS - len(known) - 2) * head[-1]  # as many others as q, the end and known
            total = sum(head) + rest + p_of_word(m, start, j)
            assert abs(total / p_of_prefix(m, start, j) - 1) < 1e-3


def p_of_word(m, word, j):
    h, place, _ = langid._grams([word], m.order)
    return p_of(m, h, place, len(place) - 1, j)


def p_of_prefix(m, word, j):
    h, place, _ = langid._grams([word], m.order)
    return p_of(m, h, place, len(place) - 2, j)


def p_of(m, h, place, last, j):
    """Probability of the symbols up to ``last``, straight from the interpolation formula."""
    total = 1.0
    for i in range(1, last + 1):
        p = 1.0 / langid.UNSEEN_CHARACTERS
        for k in range(min(m.order, i + 1)):
            g = np.searchsorted(m.grams[k], h[k][i])
            context = h[k - 1][i - 1] if k else np.uint64(0)
            c = np.searchsorted(m.contexts[k], context)
            if g < len(m.grams[k]) and m.grams[k][g] == h[k][i]:
                p = m.prob[k][g, j]
            elif c < len(m.contexts[k]) and m.contexts[k][c] == context:
                p *= m.weight[k][c, j]
        total *= p
    return total


def test_word_scores_follow_the_formula():
    m = langid.Models({"a": {"abab": 3, "abc": 1, "b": 2, "cab": 1}, "b": {"xyz": 4, "zab": 1}}, order=3)
    for word in ("abab", "cabx", "q", "zzq", "xyzab"):
        bits, _ = m.word_scores([word])
        assert np.allclose(2.0 ** -bits[0], [p_of_word(m, word, j) for j in range(2)])


def test_language_accuracy_and_rejection(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op6_language_id(spark, sf)
    true = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    rows = got.collect()
    assert len(rows) == len(true)
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert np.mean([r["lang_pred"] == true[r["doc_id"]] for r in held]) > 0.97
    assert np.mean([r["rejected"] for r in rows]) < 0.01
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_edges(spark):
    rnd = random.Random(3)
    word = lambda s: "".join(rnd.choice(s) for _ in range(rnd.randrange(2, 8)))
    docs = [(i, " ".join(word("abcde" if i % 2 else "vwxyz") for _ in range(60)), "ab" if i % 2 else "vz") for i in range(60)]
    df = spark.createDataFrame(docs, DOCS + ", lang string")
    models = langid.fit(df, fit_rows=20)
    tests = [(100, None), (101, ""), (102, "123 ### \n"), (103, "abc deed bad"), (104, "vwx zzz"),
             (105, " ".join(word("qrstuv") for _ in range(400))), (None, "bad cab"), (103, "abc deed bad"), (106, "abcde " * 50000)]
    got = langid.identify(spark.createDataFrame([(*t, 1.0) for t in tests], DOCS + ", score double"), models).collect()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    assert [by[k][0]["lang_pred"] for k in (100, 101, 102)] == ["und"] * 3
    assert (by[103][0]["lang_pred"], by[104][0]["lang_pred"], by[None][0]["lang_pred"]) == ("ab", "vz", "ab")
    assert len(by[103]) == 2 and by[105][0]["rejected"] and not by[103][0]["rejected"]
    none = langid.fit(df.where("lang is null"))
    assert {(r["lang_pred"], r["rejected"]) for r in langid.identify(df, none).collect()} == {("und", False)}
    assert langid.identify(df.limit(0), models).collect() == []


# --- decontamination ------------------------------------------------------------------

def edit(words, n, rnd):
    out = list(words)
    for _ in range(n):
        i, kind = rnd.randrange(len(out)), rnd.randrange(3)
        if kind == 0:
            out[i] = "zzz" + str(rnd.randrange(99))
        elif kind == 1:
            del out[i]
        else:
            out.insert(i, "yyy" + str(rnd.randrange(99)))
    return out


def test_decontamination_recall_against_brute_force(spark):
    rnd = random.Random(11)
    vocab = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(2, 6))) for _ in range(400)]
    items = [(i, " ".join(rnd.choice(vocab) for _ in range(n))) for i, n in enumerate([3, 5, 9, 14, 14, 20, 33, 47, 60, 20])]
    items[9] = (9, items[5][1])  # equal items
    docs = []
    for d in range(240):
        body = [rnd.choice(vocab) for _ in range(rnd.randrange(0, 150))]
        if d % 2:
            w = items[d // 2 % 10][1].split()
            at = rnd.randrange(len(body) + 1)
            body[at:at] = edit(w, rnd.randrange(0, decontam.edits_allowed(len(w)) + 1), rnd)
        t = " ".join(body)
        docs.append((d, t.upper() + "!" if d % 5 == 0 else t))
    docs += [(1000, None), (1001, ""), (1002, " . "), docs[1]]
    got = decontam.contaminated(
        spark.createDataFrame([(*r, 0) for r in docs], DOCS + ", edits int").repartition(3),
        spark.createDataFrame(items + [(99, None)], "item_id long, text string"), block_chars=400)
    found = {(r["doc_id"], r["item_id"], r["edits"]) for r in got.collect()}
    want = {(d, i, e) for d, t in docs for i, it in items if (e := helpers.contained(t, it)) is not None}
    assert found <= want  # exact verification: no false alarms
    assert len(found) >= 0.98 * len(want) and len(want) > 100, sorted(want - found)


def test_decontamination_edges(spark):
    bench = spark.createDataFrame([(0, "one two three four five six seven")], "item_id long, text string")
    none = spark.createDataFrame([], DOCS)
    assert decontam.contaminated(none, bench).collect() == []
    docs = spark.createDataFrame([(1, "x " * 30000 + "One, two three: four five six seven" + " y" * 30000)], DOCS)
    assert [r["edits"] for r in decontam.contaminated(docs, bench).collect()] == [0]
    assert decontam.contaminated(docs, bench.limit(0)).collect() == []


def test_short_items_scripts_without_spaces_and_any_key_type(spark):
    docs = spark.createDataFrame([(1, "The ANSWER is forty-two, I said."), (2, "answer is forty three"), (3, "yes"), (4, "oh yes, yes"),
                                  (5, "今日は東京へ行きます。"), (6, "今日は京都へ行きます。"), (7, None), (8, "answer is"), (9, "forty two answer is")], DOCS)
    items = [("a", "answer is forty two"), ("b", "Yes!"), ("c", "東京へ行"), ("d", "answer is forty two"), ("e", "..."), ("f", None), ("g", "")]
    want = {(1, "a"), (1, "d"), (3, "b"), (4, "b"), (5, "c")}
    for kind, cast in (("string", "i"), ("struct<i:string>", "named_struct('i', i)"), ("binary", "cast(i as binary)"),
                       ("smallint", "cast(ascii(i) as smallint)"), ("decimal(9,2)", "cast(ascii(i) as decimal(9,2))"), ("date", "date_add(date'2020-01-01', ascii(i))")):
        bench = spark.createDataFrame(items, "i string, text string").selectExpr(f"{cast} as item_id", "text")
        got = decontam.contaminated(docs, bench)
        assert got.schema["item_id"].dataType.simpleString() == kind
        names = {repr(r["item_id"]): r["i"] for r in spark.createDataFrame(items, "i string, text string").selectExpr("i", f"{cast} as item_id").collect()}
        assert {(r["doc_id"], names[repr(r["item_id"])]) for r in got.collect()} == want, kind
        assert {(r["edits"], r["similarity"]) for r in got.collect()} == {(0, 1.0)}
    few = decontam.contaminated(docs, spark.createDataFrame(items, "item_id string, text string"), min_words=2)
    assert {(r["doc_id"], r["item_id"]) for r in few.collect()} == want - {(3, "b"), (4, "b")}


@pytest.mark.parametrize("kind", ["changed", "inserted", "deleted"])
def test_decontamination_recall_at_the_full_number_of_edits(kind):
    rnd = random.Random(12)
    unknown = lambda n: [f"u{rnd.randrange(999)}" for _ in range(n)]
    for n in (5, 9, 10, 14, 15, 20, 30, 39, 59, 100, 200):
        items = [[f"w{rnd.randrange(4000)}" for _ in range(n)] for _ in range(100)]
        found = decontam.Items(list(range(100)), [" ".join(x) for x in items])
        texts = []
        for x in items:
            places = sorted(rnd.sample(range(1, n), decontam.edits_allowed(n)), reverse=True)
            for at in places:
                x[at:at + (kind != "inserted")] = [] if kind == "deleted" else unknown(1)
            texts.append(" ".join(unknown(20) + x + unknown(20)))
        hits = {t for t, i, _ in found.matches(texts) if t == i}
        assert len(hits) >= 99, (n, sorted(set(range(100)) - hits))


# --- licenses -----------------------------------------------------------------------------

def test_license_cosines_and_inheritance(spark):
    files = [(1, "a/LICENSE", "words\nReleased under the MIT License."), (2, "a/b/c/x.txt", "nothing here"),
             (3, "a/b/LICENSE.md", "Licensed under CC BY-NC 4.0."), (4, "a/b/c/y.txt", "prose\nThis work is licensed under the GNU General "
              "Public License, version 3.\nmore"), (5, "d/z.txt", "nothing"), (6, "top.txt", None), (7, None, "text"),
             (8, "a/q.txt", ""), (9, "d/w.txt", "Licensed under the Apache License, Version 2.0.")]
    files.append(files[1])
    df = spark.createDataFrame([(*f, "k") for f in files], "doc_id long, path string, text string, own string")
    got = {r["doc_id"]: r for r in licenses.scan_licenses(df).collect()}
    assert {k: (r["own"], r["license"], r["licensed_by"]) for k, r in got.items()} == {
        1: ("MIT", "MIT", "file"), 2: (None, "CC-BY-NC-4.0", "a/b"), 3: ("CC-BY-NC-4.0", "CC-BY-NC-4.0", "file"),
        4: ("GPL-3.0", "GPL-3.0", "file"), 5: (None, None, None), 6: (None, None, None), 7: (None, None, None),
        8: (None, "MIT", "a"), 9: ("Apache-2.0", "Apache-2.0", "file")}
    assert got[4]["line"] == 1 and got[4]["cosine"] > 0.99
    assert licenses.scan_licenses(df.limit(0)).collect() == []


def test_wrapped_inline_and_prefixed_license_headers(spark):
    gpl = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version."""
    apache = """Copyright 2015 Someone

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0"""
    said = [("GPL-3.0", gpl), ("GPL-3.0", gpl.replace("\n# ", " ")), ("LGPL-3.0", gpl.replace("program", "library").replace("GNU", "GNU Lesser")),
            ("AGPL-3.0", gpl.replace("GNU", "GNU Affero")), ("Apache-2.0", apache), ("Apache-2.0", apache.replace("\n", " ")),
            ("MIT", "Copyright (c) 2020 Jane Doe. Released under the MIT License."),
            ("MIT", "Some example code for you. Released under\nthe MIT License. More words follow here."),
            ("MPL-2.0", "x = 1  # This Source Code Form is subject to the\n# terms of the Mozilla Public\n# License, v. 2.0.")]
    files = [(n, f"f/{n}", f"first line\n{t}\nimport os") for n, (_, t) in enumerate(said)]
    files += [(100 + n, f"g/{n}", f"plain prose number {n} of the other files, under the roof of a house") for n in range(200)]
    got = {r["doc_id"]: r for r in licenses.scan_licenses(spark.createDataFrame(files, "doc_id long, path string, text string")).collect()}
    assert [got[n]["own"] for n in range(len(said))] == [name for name, _ in said]
    assert got[0]["line"] == 1 and got[4]["line"] == 3
    assert all(got[100 + n]["own"] is None for n in range(200))


def test_license_query_against_statements(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    own = {r["doc_id"]: r["own"] for r in queries.op9_license_scan(spark, sf).collect()}
    said = {"CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0", "MIT": "Released under the MIT License",
            "Apache-2.0": "Licensed under the Apache License", "GPL-3.0": "GNU General Public License, version 3"}
    want = {d: {n for n, s in said.items() if s in t} for d, t in texts.items()}
    assert any(want.values())
    assert all((own[d] in w) if w else own[d] is None for d, w in want.items())
    rows = queries.op9_license_scan(spark, sf).collect()
    assert sum(r["licensed_by"] not in (None, "file") for r in rows) > 50  # inheritance is exercised


LICENSE_PROBES = [
    ("GPL-2.0", licenses._GNU.format("Foo", "", "2")), ("LGPL-2.1", licenses._GNU.format("This library", "Lesser", "2.1")),
    ("GPL-3.0", licenses._GNU.format("Foo", "", "3")), (None, licenses._GNU.format("This program", "", "1")),
    ("BSD-2-Clause", licenses._BSD + licenses._BSD_END + " and more"),
    ("BSD-3-Clause", licenses._BSD + licenses._BSD_3.replace("the copyright holder", "Acme Corp") + licenses._BSD_END),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."), ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-NC-SA-3.0", "Licensed under CC BY-NC-SA 3.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("0BSD", f"{licenses._ISC}.\n\n{licenses._AS_IS}"),
    ("ISC", f"{licenses._ISC}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{licenses._AS_IS}"),
    (None, "This file is not licensed under the Apache License, Version 2.0."), (None, "Never released under the MIT License."),
    ("MIT", "MIT License\n\nCopyright (c) 2020 X"), ("MIT", "# MIT License"), (None, "We compare the MIT license plate with others"),
    (None, "Er ging mit der Lizenz nach Hause"), ("GPL-3.0", "// SPDX-License-Identifier: GPL-3.0-or-later"),
    ("MPL-2.0", "Mozilla Public License Version 2.0\n====\n1. Definitions"), ("MPL-1.1", "Licensed under the Mozilla Public License, version 1.1."),
]


def test_versions_variants_titles_and_negations():
    """In files of their own: the answer depends on no other file."""
    m = licenses.Matcher()
    assert [m.best(t)[0] for _, t in LICENSE_PROBES] == [name for name, _ in LICENSE_PROBES]
    for t in m.templates:
        name, cosine, line = m.best(f"first line\n{t.text}\nlast line")
        assert (name, line) == (t.name, 1) and cosine > 1 - 1e-9


def test_best_runs_against_all_runs(monkeypatch):
    """Every run of every template's length, from the formula, in texts cut into blocks of any size."""
    m = licenses.Matcher(threshold=0.6)
    lines = [licenses.terms(t.text) for t in m.templates]
    files = {w: sum(w in x for x in lines) for x in lines for w in x}
    weight = lambda w: np.log((1 + len(lines)) / (1 + files.get(w, 0))) + 1

    def brute(text):
        words, best = licenses.terms(text), None
        ends = [i for i, c in enumerate(text) if c == "\n"]
        places = [x.start() for x in licenses._TERM.finditer(text.lower())]
        row = [sum(e < p for e in ends) for p in places]
        for k, t in enumerate(m.templates):
            n = min(len(lines[k]), len(words))
            for s in range(len(words) - n + 1) if n else ():
                run = words[s:s + n]
                if not set(t.need.split()) <= set(run) or set(t.ban.split()) & set(run):
                    continue
                if licenses.NEGATIONS & (set(words[max(0, s - 3):s]) | (set(run) - set(lines[k]))):
                    continue
                if t.title and ((s and row[s - 1] == row[s]) or (s + n < len(words) and row[s + n - 1] == row[s + n])):
                    continue
                vocabulary = sorted({*run, *lines[k]})
                a, b = (np.array([x.count(w) * weight(w) for w in vocabulary]) for x in (run, lines[k]))
                c = float(a @ b / np.linalg.norm(a) / np.linalg.norm(b))
                if c >= 0.6 and (best is None or (-round(c, 9), k, s) < (-round(best[0], 9), *best[1:])):
                    best = c, k, s
        return (None, 0.0, None) if best is None else (m.templates[best[1]].name, best[0], row[best[2]])

    rnd = random.Random(9)
    pool = [w for t in m.templates for w in t.text.split()] + ["mit", "not", "license", "word", "\n", "\n", "2.0", "v3", "the"] * 20
    for n in range(60):
        text = " ".join(rnd.choice(pool) for _ in range(rnd.randrange(0, 60)))
        for _ in range(rnd.randrange(3)):
            w = rnd.choice(m.templates).text.split()
            for _ in range(rnd.randrange(3)):
                w[rnd.randrange(len(w))] = rnd.choice(pool)
            text += rnd.choice([" ", "\n"]) + " ".join(w) + rnd.choice([" ", "\n"]) + " ".join(rnd.choice(pool) for _ in range(30))
        want = brute(text)
        for block in (1 << 18, 700):
            monkeypatch.setattr(licenses, "BLOCK", block)
            name, cosine, line = m.best(text)
            assert (name, line) == (want[0], want[2]) and abs(cosine - want[1]) < 1e-9, (n, block)


def test_a_very_long_text_is_read_in_blocks():
    import tracemalloc
    text = ("plain words of prose without any of it, " * 26 + "\n") * 50_000  # 52 MB
    text += "Released under\nthe MIT License.\n" + "more words " * 1000
    m = licenses.Matcher()
    tracemalloc.start()
    got = m.best(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got[0] == "MIT" and got[2] == 50_000 and peak < 100e6
    assert m.best("x" * 3_000_000 + " Released under the MIT License. " + "y" * 3_000_000)[0] == "MIT"
