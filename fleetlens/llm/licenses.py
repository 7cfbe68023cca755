"""Operator 9, license scans: sparse TF-IDF cosine, then directory inheritance.

Every run of words of a file that is as long as a template is compared with
it as a sparse TF-IDF vector, across line breaks; a shorter file is one run.
The templates are statements, standard headers, titles and whole short
licences, in their versions and variants. Term weights come from the template
collection, so a file's licence depends on the file alone; a term that stands in no
template weighs the most.

A template names the terms that decide it (``apache`` and ``2``) and those
that decide against it (``sharealike`` for plain attribution). A run has to
hold all of the first and none of the second, so a version or variant is
never taken for its neighbour, however alike they are, and one without a
template is taken for none. The first deciding term is the template's
posting: only runs around its occurrences are looked at, which loses nothing.
A run after a negation within ``REACH`` words, or holding one that the
template does not, says the opposite and does not count. A title counts only where it fills its
lines. A file's own license is the template of its best run at or above ``threshold``;
``line`` is the line of the run's first word.

Texts are read in blocks of ``BLOCK`` characters that overlap by the longest
template, so memory does not grow with a text beyond the text itself. One row
is one task's work, and the corpus is read once.

A file without a license inherits from the nearest licence file (``LICENSE``,
``COPYING`` and the like) in its directory or a directory above. Directories
are resolved once each: a directory's ancestors are joined on their paths
with the licensed directories and the deepest wins; files then join their
directory.

Edge cases: null text or path has no license of its own, a null path
inherits none; ties go to the template first in order of its name, then to
the earlier run; repeated rows are each reported; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import materialize, slices, text_rows

THRESHOLD = 0.75
BLOCK = 1 << 18
REACH = 3
NEGATIONS = frozenset("not never no without isn aren wasn non neither nor cannot".split())


@dataclass(frozen=True)
class Template:
    """A wording of a license. ``need``: terms a run must hold (the first one is rare in prose); ``ban``: must not."""

    name: str
    text: str
    need: str
    ban: str = ""
    title: bool = False


# SPDX names and the wordings of statements, headers, titles and short licences.
_GNU = ("{0} is free software: you can redistribute it and/or modify it under the terms of the GNU {1} General Public "
        "License as published by the Free Software Foundation, either version {2} of the License, or (at your option) any "
        "later version.")
_AS_IS = ("THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING "
          "ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.")
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_MIT = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the "
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice "
        "and this permission notice shall be included in all copies or substantial portions of the Software.")
_BSD = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
        "distribution.")
_BSD_3 = (" 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
          "products derived from this software without specific prior written permission.")
_BSD_END = " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\""
_CC_WORDS = {"BY": "Attribution", "SA": "ShareAlike", "NC": "NonCommercial", "ND": "NoDerivatives"}
_CC = ["BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND"]


def _gnu_family() -> Iterator[Template]:
    for name, kind, version, published, need, ban in (
            ("GPL-2.0", "", "2", "June 1991", "gnu general public 2", "lesser affero"),
            ("GPL-3.0", "", "3", "29 June 2007", "gnu general public 3", "lesser affero"),
            ("LGPL-2.1", "Lesser", "2.1", "February 1999", "lesser gnu 2.1", ""),
            ("LGPL-3.0", "Lesser", "3", "29 June 2007", "lesser gnu 3", ""),
            ("AGPL-3.0", "Affero", "3", "19 November 2007", "affero gnu 3", "")):
        full = f"GNU {kind} General Public License"
        for subject in ("This program", "This library"):
            yield Template(name, _GNU.format(subject, kind, version), need, ban)
        for said in ("This program is licensed under the {0}, version {1}.", "This work is licensed under the {0}, version {1}.",
                     "Licensed under the {0}, version {1}.", "under the terms of the {0} version {1}", "Released under the {0} v{1}."):
            yield Template(name, said.format(full, version), need, ban)
        for title in (f"{full} Version {version}, {published}", f"{full} Version {version}"):
            yield Template(name, title, need, ban, title=True)


def _creative_commons() -> Iterator[Template]:
    for code in _CC:
        parts = code.split("-")
        other = [w for k, w in _CC_WORDS.items() if k not in parts]
        ban = " ".join([*[k for k in _CC_WORDS if k not in parts], *other, "noderivs"]).lower()
        for version, where in (("4.0", "International"), ("3.0", "Unported")):
            name, long, n = f"CC-{code}-{version}", "-".join(_CC_WORDS[p] for p in parts), version[0]
            spelt = " ".join(_CC_WORDS[p] for p in parts).lower()
            yield Template(name, f"Licensed under CC {code} {version}.", f"cc {code.replace('-', ' ').lower()} {n}", ban)
            yield Template(name, f"This work is licensed under a Creative Commons {long} {version} {where} License.",
                           f"creative commons {spelt} {n}", ban)
            yield Template(name, f"Creative Commons {long} {version} {where}", f"creative commons {spelt} {n}", ban, title=True)
    yield Template("CC0-1.0", "CC0 1.0 Universal", "cc0", title=True)
    yield Template("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights "
                   "to this work under CC0 1.0 Universal.", "cc0")


def _others() -> Iterator[Template]:
    apache = "apache license 2"
    yield Template("Apache-2.0", "Licensed under the Apache License, Version 2.0.", apache)
    yield Template("Apache-2.0", "Released under the Apache License 2.0.", apache)
    yield Template("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                   "compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
                   apache)
    for title in ("Apache License", "Apache License Version 2.0", "Apache License Version 2.0, January 2004"):
        yield Template("Apache-2.0", title, "apache license" if title == "Apache License" else apache, title=True)
    for name, clauses, number, word, ban in (("BSD-2-Clause", _BSD, "2", "simplified", "neither endorse promote"),
                                             ("BSD-3-Clause", _BSD + _BSD_3, "3", "new", "")):
        yield Template(name, clauses + _BSD_END, "redistributions binary retain" + (" neither endorse promote" if number == "3" else ""), ban)
        yield Template(name, f"Licensed under the BSD {number}-Clause License.", f"bsd clause {number}")
        yield Template(name, f"BSD {number}-Clause License", f"bsd clause {number}", title=True)
        yield Template(name, f"Licensed under the {word} BSD license.", f"bsd {word}")
    yield Template("0BSD", f"{_ISC}. {_AS_IS}", "disclaims permission fee granted", "appear above notice")
    yield Template("0BSD", "BSD Zero Clause License", "bsd zero clause", title=True)
    yield Template("0BSD", "Zero-Clause BSD", "bsd zero clause", title=True)
    yield Template("ISC", f"{_ISC}, provided that the above copyright notice and this permission notice appear in all copies.",
                   "appear permission fee granted notice")
    yield Template("ISC", "Released under the ISC License.", "isc license")
    yield Template("ISC", "ISC License", "isc license", title=True)
    yield Template("MIT", _MIT, "sublicense permission granted furnished")
    yield Template("MIT", _MIT[:_MIT.index(" files") + 6], "obtaining permission granted charge person")
    for said in ("Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the MIT License",
                 "Distributed under the terms of the MIT license"):
        yield Template("MIT", said, "license mit")
    for title in ("MIT License", "The MIT License", "The MIT License (MIT)"):
        yield Template("MIT", title, "license mit", title=True)
    for version in ("1.1", "2.0"):
        n = version.removesuffix(".0")
        yield Template(f"MPL-{version}", f"Mozilla Public License Version {version}", f"mozilla public {n}", title=True)
        yield Template(f"MPL-{version}", f"Licensed under the Mozilla Public License, version {version}.", f"mozilla public {n}")
    yield Template("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mozilla public 2")
    yield Template("MPL-1.1", "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may "
                   "not use this file except in compliance with the License.", "mozilla public 1.1")
    for version in ("1.0", "2.0"):
        n = version[0]
        yield Template(f"EPL-{version}", "This program and the accompanying materials are made available under the terms of the Eclipse "
                       f"Public License v{version}", f"eclipse public {n}")
        yield Template(f"EPL-{version}", f"Eclipse Public License - v {version}", f"eclipse public {n}", title=True)
    yield Template("BSL-1.0", "Distributed under the Boost Software License, Version 1.0.", "boost software 1")
    yield Template("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003", "boost software 1", title=True)
    yield Template("Unlicense", "This is free and unencumbered software released into the public domain.", "unencumbered public domain")
    yield Template("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be "
                   "held liable for any damages arising from the use of this software.", "liable authors express damages event")


def _all() -> tuple[Template, ...]:
    found = [*_gnu_family(), *_creative_commons(), *_others()]
    for name in dict.fromkeys(t.name for t in found):  # identifier lines
        found.append(Template(name, f"SPDX-License-Identifier: {name}", "spdx identifier " + " ".join(terms(name)), " ".join(
            {w for other in found for w in terms(other.name)} - set(terms(name)))))
    return tuple(sorted(found, key=lambda t: t.name))


# Names of licence files, without extension.
LICENSE_FILES = ["LICENSE", "LICENCE", "COPYING", "NOTICE", "UNLICENSE"]

_TERM = re.compile(r"\w+(?:\.\w+)*")
_VERSION = re.compile(r"v?([0-9]+(?:\.[0-9]+)*?)(?:\.0)*")


def plain(term: str) -> str:
    """A version without its ``v`` and closing zeros (``v2.0``: ``2``); other terms as they are."""
    m = _VERSION.fullmatch(term) if term[-1].isdigit() else None
    return m[1] if m else term


def terms(text: str) -> list[str]:
    return [plain(t) for t in _TERM.findall(text.lower())]


TEMPLATES = _all()


class Matcher:
    """Templates as sparse unit vectors, found by their first deciding term."""

    def __init__(self, templates: Sequence[Template] = TEMPLATES, threshold: float = THRESHOLD):
        self.templates, self.threshold = templates, threshold
        lines = [terms(t.text) for t in templates]
        self.lengths = [len(x) for x in lines]
        self.longest = max(self.lengths, default=0)
        files = Counter(t for line in lines for t in set(line))
        n = len(lines)
        self.idf = {t: math.log((1 + n) / (1 + k)) + 1 for t, k in files.items()}
        self.most = math.log(1 + n) + 1
        self.vectors = []
        for line in lines:
            v = {t: k * self.idf[t] for t, k in Counter(line).items()}
            size = math.sqrt(sum(x * x for x in v.values()))
            self.vectors.append({t: x / size for t, x in v.items()})
        self.need = [frozenset(t.need.split()) for t in templates]
        self.ban = [frozenset(t.ban.split()) for t in templates]
        self.against = [NEGATIONS.difference(line) for line in lines]
        self.postings: dict[str, list[int]] = {}
        for k, t in enumerate(templates):
            self.postings.setdefault(t.need.split()[0], []).append(k)

    def cosine(self, words: Sequence[str], k: int) -> float:
        v, dot, norm = self.vectors[k], 0.0, 0.0
        for t, n in Counter(words).items():
            x = n * self.idf.get(t, self.most)
            norm += x * x
            dot += x * v.get(t, 0.0)
        return dot / math.sqrt(norm) if norm else 0.0

    def _windows(self, words: list[str], k: int, first: int, last: int) -> Iterator[tuple[float, int]]:
        """(cosine, start) of each run of the template's length that begins from first to last."""
        m, v = min(self.lengths[k], len(words)), self.vectors[k]
        count: Counter = Counter()
        dot = norm = 0.0

        def put(t: str, by: int) -> None:
            nonlocal dot, norm
            x, n = self.idf.get(t, self.most), count[t]
            count[t] = n + by
            norm += x * x * (2 * n * by + 1)
            dot += by * x * v.get(t, 0.0)

        for t in words[first:first + m]:
            put(t, 1)
        for s in range(first, last + 1):
            if s > first:
                put(words[s - 1], -1)
                put(words[s + m - 1], 1)
            yield dot / math.sqrt(norm) if norm > 0 else 0.0, s

    def _says_so(self, words: list[str], places: list[int], text: str, k: int, s: int) -> bool:
        """Whether the run meets the template's conditions beside its cosine."""
        run = words[s:s + self.lengths[k]]
        held = set(run)
        if not self.need[k] <= held or not self.ban[k].isdisjoint(held) or not self.against[k].isdisjoint(held) \
                or not NEGATIONS.isdisjoint(words[max(0, s - REACH):s]):
            return False
        if not self.templates[k].title:
            return True
        after = s + len(run)
        return (s == 0 or "\n" in text[places[s - 1]:places[s]]) and (
            after == len(words) or "\n" in text[places[after - 1]:places[after]])

    def _block(self, text: str) -> Iterator[tuple[float, int, int]]:
        """(cosine, template, place) of the best run of each template in a block."""
        low = text.lower()
        words = _TERM.findall(low)
        if self.postings.keys().isdisjoint(words):
            return
        places = [m.start() for m in _TERM.finditer(low)]
        starts: dict[int, list[tuple[int, int]]] = {}
        for i, w in enumerate(words):
            for k in self.postings.get(w, ()):
                m = self.lengths[k]
                lo, hi = max(0, i - m + 1), max(0, min(i, len(words) - m))
                spans = starts.setdefault(k, [])
                if spans and lo <= spans[-1][1] + 1:
                    spans[-1] = spans[-1][0], hi
                else:
                    spans.append((lo, hi))
        words = [plain(w) for w in words]
        for k, spans in starts.items():
            best: tuple[float, int] | None = None
            for lo, hi in spans:
                for c, s in self._windows(words, k, lo, hi):
                    if c >= self.threshold - 1e-9 and (best is None or c > best[0] - 1e-9) and self._says_so(words, places, low, k, s):
                        c = self.cosine(words[s:s + self.lengths[k]], k)
                        if c >= self.threshold and (best is None or c > best[0] + 1e-12):
                            best = c, s
            if best:
                yield best[0], k, places[best[1]]

    def _overlap(self, text: str, begin: int, end: int) -> int | None:
        """Where the next block begins, the longest template's words before this one's end; None if it has no more than these."""
        words, back = self.longest + REACH + 1, 64 * (self.longest + REACH)
        while True:
            lo = max(begin, end - back)
            tail = [m.start() for m in _TERM.finditer(text[lo:end].lower())]
            if len(tail) > words + (lo == begin):
                return lo + tail[-words]
            if lo == begin:
                return None
            back *= 2

    def best(self, text: str) -> tuple[str | None, float, int | None]:
        """(template name, cosine, line number) of the best run, if one reaches the threshold."""
        found: tuple[float, int, int] | None = None
        begin = end = 0
        while True:
            end += BLOCK
            while end < len(text) and not text[end].isspace():
                end += 1
            following = self._overlap(text, begin, end) if end < len(text) else None
            if end < len(text) and following is None:
                continue  # too few words in the block: a longer one
            for c, k, at in self._block(text[begin:end]):
                at += begin
                if found is None or (-round(c, 12), k, at) < (-round(found[0], 12), *found[1:]):
                    found = c, k, at
            if following is None:
                break
            begin = following
        if found is None:
            return None, 0.0, None
        return self.templates[found[1]].name, found[0], text.count("\n", 0, found[2])


def folder_of(path: Column) -> Column:
    """Directory of a path, the empty string for a name without one."""
    return F.when(path.contains("/"), F.regexp_replace(path, r"/[^/]*$", "")).when(path.isNotNull(), F.lit(""))


def own_licenses(files: DataFrame, key: str, path: str, text: str, templates: Sequence[Template] = TEMPLATES,
                 threshold: float = THRESHOLD) -> DataFrame:
    """(key, path, own, cosine, line) of each file."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(templates, threshold)
        for b in slices(batches, 4 << 20, "_t"):
            own, cosine, line = zip(*[matcher.best(t) for t in text_rows(b.column(2))])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(own, pa.string()), pa.array(cosine, pa.float64()), pa.array(line, pa.int64())],
                names=["_k", "_p", "own", "cosine", "line"])

    src = files.select(F.col(key).alias("_k"), F.col(path).alias("_p"), F.col(text).cast("string").alias("_t"))
    kind = src.schema["_k"].dataType.simpleString()
    return src.mapInArrow(run, f"_k {kind}, _p string, own string, cosine double, line long")


def inherit(files: DataFrame, path: str, own: str, license_files: list[str] = LICENSE_FILES) -> DataFrame:
    """``files`` with ``license`` and ``licensed_by`` (``file``, the licence directory's path, or null)."""
    name = F.upper(F.regexp_extract(path, r"([^/.]*)[^/]*$", 1))
    f = files.withColumn("_dir", folder_of(F.col(path)))
    licensed = (f.where(F.col(own).isNotNull() & name.isin(license_files)).groupBy("_dir")
                .agg(F.min(own).alias("_from"), F.min(F.length("_dir")).alias("_depth"))
                .withColumnRenamed("_dir", "_above"))
    parts = F.split("_dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)),
                        lambda i: F.when(i == 0, F.lit("")).otherwise(F.concat_ws("/", F.slice(parts, 1, i))))
    nearest = materialize(
        f.where("_dir is not null").select("_dir").distinct().withColumn("_above", F.explode(F.array_distinct(above)))
        .join(licensed, "_above").groupBy("_dir")
        .agg(F.max(F.struct("_depth", "_above", "_from")).alias("n"))
        .select("_dir", F.col("n._above").alias("_above"), F.col("n._from").alias("_from")), "license-folders")
    return (f.join(nearest, "_dir", "left")
            .withColumn("license", F.coalesce(own, "_from"))
            .withColumn("licensed_by", F.when(F.col(own).isNotNull(), "file").otherwise(F.col("_above")))
            .drop("_dir", "_above", "_from"))


def scan_licenses(files: DataFrame, key: str = "doc_id", path: str = "path", text: str = "text",
                  templates: Sequence[Template] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(key, path, own, cosine, line, license, licensed_by) of each file."""
    own = materialize(own_licenses(files, key, path, text, templates, threshold), "license-files")
    return inherit(own, "_p", "own").withColumnsRenamed({"_k": key, "_p": path})
