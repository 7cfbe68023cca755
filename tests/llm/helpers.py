"""Brute-force versions of the training-data operators, in plain Python."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import xxhash


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def simhash_components(docs, shingle=4, radius=4):
    """(doc_id, hex fingerprint, component) for (doc_id, text) pairs."""
    prints = []
    for key, text in docs:
        words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(
            bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")))
        grams = [b" ".join(words[i:i + shingle]) for i in range(max(1, len(words) - shingle + 1))] if words else []
        h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        prints.append((key, sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))))
    parent = {k: k for k, _ in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(prints):
        for b, y in prints[:i]:
            if bin(x ^ y).count("1") <= radius:
                ra, rb = sorted((root(a), root(b)))
                parent[rb] = ra
    return sorted((k, f"{f:016x}", root(k)) for k, f in prints)


def repeats(docs, span):
    """(doc_id, n_bytes, n_removed, n_spans, sha of the rest) for (doc_id, text) pairs."""
    data = [(k, (t or "").encode()) for k, t in docs]
    seen = Counter(t[i:i + span] for _, t in data for i in range(len(t) - span + 1))
    out = []
    for k, t in data:
        gone = bytearray(len(t))
        for i in range(len(t) - span + 1):
            if seen[t[i:i + span]] > 1:
                gone[i:i + span] = b"\1" * span
        kept = bytes(c for c, g in zip(t, gone) if not g)
        out.append((k, len(t), sum(gone), len(re.findall(b"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def contained(text, item, similarity=0.8):
    """Least edits of the item within the text if few enough, else None (words, free ends)."""
    a, b = (re.findall(r"\w+", (x or "").lower()) for x in (item, text))
    row = [0] * (len(b) + 1)
    for i, w in enumerate(a, 1):
        nxt = [i]
        for j, v in enumerate(b, 1):
            nxt.append(min(row[j] + 1, nxt[-1] + 1, row[j - 1] + (v != w)))
        row = nxt
    return min(row) if min(row) <= math.floor((1 - similarity) * len(a) + 1e-9) else None


def components(edges):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is None or b is None or a == b:
            continue
        ra, rb = sorted((root(a), root(b)))
        parent[rb] = ra
    return sorted((x, root(x)) for x in parent)


def runs(words, min_length=24):
    """Maximal runs (start, length, smallest period) of a sequence, one period after another."""
    out = {}
    n = len(words)
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(min_length, 3 * q):
                out.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted((s, length, q) for (s, length), q in out.items())


def personal_data(text):
    """(kind, start, end) by the plain patterns and checks."""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c.isdigit()][::-1]
        total = sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits))
        if 12 <= len(digits) <= 19 and total % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append(("phone", *m.span()))
    return sorted(out, key=lambda x: (x[1], ["email", "ip", "card", "phone"].index(x[0])))


def prefix_trie(rows):
    """Rows of the prefix trie of (conv, turn, role, text) rows, by walking every rebuilt conversation."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    members, words, ends = {}, {}, {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        path = own.get(base, [])[:h] + ts[h:]
        name = b""
        members.setdefault((0, name), []).append(c)
        for d, (role, text) in enumerate(path, 1):
            name = hashlib.sha256(name + f"{len(role)}:{role}{text}".encode()).digest()
            members.setdefault((d, name), []).append(c)
            words[d, name] = len(re.findall(r"[^\x20\x09-\x0D]+", text))
        ends.setdefault((len(path), name), []).append(c)
    at = {}
    for (d, name), cs in members.items():
        for c in cs:
            at[c, d] = (d, name)
    above = {n: at[members[n][0], n[0] - 1] for n in members if n[0]}
    kids, leaves, saved = {}, {}, {}
    for n, u in above.items():
        kids[u] = kids.get(u, 0) + 1
    for n in sorted(members, key=lambda n: -n[0]):
        leaves[n] = leaves.get(n, 0) + (n not in kids)
        saved[n] = saved.get(n, 0) + (len(members[n]) - 1) * words.get(n, 0)
        if n in above:
            leaves[above[n]] = leaves.get(above[n], 0) + leaves[n]
            saved[above[n]] = saved.get(above[n], 0) + saved[n]
    return [(min(cs), n[0], min(members[above[n]]) if n in above else None, len(cs), kids.get(n, 0), leaves[n], saved[n],
             hashlib.sha256(",".join(map(str, sorted(ends.get(n, [])))).encode()).hexdigest()) for n, cs in members.items()]
