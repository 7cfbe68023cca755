"""Operator 12, personal data in texts: patterns propose, checks confirm, context adjusts.

Regular expressions propose spans of each kind. Checks then confirm them:
address parts up to 255, digit counts, the Luhn sum of card numbers, the
mod-97 remainder and country length of IBANs, the fixed rules of social
security numbers. A confirmed span starts from its kind's score; words
within ``REACH`` characters before or after it raise the score (``call``
before a phone number) or lower it (``order`` before a number).

Kinds come in two groups. The base kinds (email, ip, card, phone) are exact:
a confirmed base span is always reported, whatever its score. The context
kinds (iban, ssn, local_phone) are reported from a score of ``threshold`` on,
unless they lie within a base span. So lowering or raising scores never loses
a base span.

The patterns are written so that no text makes them slow: each run of
characters of a class is entered once, so time is linear in the text. One row
is one task's work; nothing is shuffled, and a task holds a megabyte of texts
(or one longer text) at a time.

Edge cases: null and empty texts have no spans; a null key keeps its row;
repeated rows are judged apart; an empty table gives no rows; other columns
are ignored. Places are code points, ends exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import slices, text_rows

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn", "local_phone")
THRESHOLD = 0.5
REACH = 48  # characters of context on either side
RAISE, LOWER = 0.25, 0.3

# A confirmed span's score before its context is read.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.7, "phone": 0.7, "iban": 0.8, "ssn": 0.4, "local_phone": 0.3}

# Words that speak for or against a kind.
FOR = {
    "email": {"mail", "email", "contact", "write", "address"},
    "ip": {"ip", "host", "server", "address", "login", "client", "from"},
    "card": {"card", "visa", "mastercard", "amex", "credit", "debit", "payment", "pay", "cvv"},
    "phone": {"phone", "tel", "telephone", "call", "mobile", "cell", "fax", "whatsapp", "contact"},
    "iban": {"iban", "account", "bank", "transfer", "bic", "konto", "swift"},
    "ssn": {"ssn", "social", "security"},
    "local_phone": {"phone", "tel", "telephone", "call", "mobile", "cell", "fax", "whatsapp"},
}
AGAINST = {
    "email": {"example", "git", "scp", "ssh"},
    "ip": {"version", "release", "section", "chapter", "v"},
    "card": {"order", "invoice", "isbn", "serial", "tracking", "part", "sku"},
    "phone": {"order", "invoice", "isbn", "serial", "part", "version"},
    "iban": {"serial", "sku", "part", "hash", "commit"},
    "ssn": {"order", "invoice", "isbn", "serial", "part", "version", "date"},
    "local_phone": {"order", "invoice", "isbn", "serial", "part", "version", "date"},
}

# Lengths of IBANs by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AT": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "CH": 21, "CY": 28, "CZ": 24, "DE": 22,
    "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IL": 23,
    "IS": 26, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28,
    "PT": 25, "RO": 24, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TR": 26, "UA": 29,
}

_LOCAL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@")
_LOCAL_HERE = re.compile(r"[A-Za-z0-9._%+-]++@")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}+")
_SSN = re.compile(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")
_LOCAL_PHONE = re.compile(r"(?<![\w+.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![\w-])")
_WORD = re.compile(r"[a-z]+")
_NO_DIGIT = re.compile(r"[^0-9]+")

Span = tuple[str, int, int, float]  # kind, start, end, score


def luhn(digits: str) -> bool:
    """Whether the Luhn sum of a digit string is a multiple of ten."""
    total = sum(map(int, digits[-1::-2])) + sum(int(c) * 2 - 9 * (c > "4") for c in digits[-2::-2])
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """Whether an IBAN without spaces has its country's length and leaves a remainder of 1."""
    if IBAN_LENGTHS.get(iban[:2]) != len(iban):
        return False
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    at = 0
    if "@" not in text:
        return
    while (m := _LOCAL.search(text, at)) is not None:
        at = m.end()
        while m is not None and (domain := _DOMAIN.match(text, m.end())) is not None:
            yield m.start(), domain.end()
            at = domain.end()
            m = _LOCAL_HERE.match(text, at)  # a match may end within a run of local characters


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p) <= 255 for p in (g.lstrip("0") or "0" for g in m.groups())):
            yield m.span()


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    if "+" not in text:
        return
    for m in _PHONE.finditer(text):
        if 9 <= len(_NO_DIGIT.sub("", m[0])) <= 15:
            yield m.span()


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    for m in _IBAN.finditer(text):
        n = IBAN_LENGTHS.get(m[0][:2])
        if n is None:
            continue
        size = end = 0
        for i, c in enumerate(m[0]):  # the country's length, spaces apart
            size += c != " "
            if size == n:
                end = i + 1
                break
        follow = text[m.start() + end:m.start() + end + 1]
        if end and not (follow.isascii() and follow.isalnum()) and mod97(m[0][:end].replace(" ", "")):
            yield m.start(), m.start() + end


def _ssns(text: str) -> Iterator[tuple[int, int]]:
    for m in _SSN.finditer(text):
        if m[1] not in ("000", "666") and m[1][0] != "9" and m[2] != "00" and m[3] != "0000":
            yield m.span()


def _local_phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _LOCAL_PHONE.finditer(text):
        yield m.span()


FINDERS = {"email": _emails, "ip": _ips, "card": _cards, "phone": _phones,
           "iban": _ibans, "ssn": _ssns, "local_phone": _local_phones}


def score(kind: str, text: str, start: int, end: int) -> float:
    """A confirmed span's score: its kind's, adjusted by the nearest telling word before it, else after it."""
    before = _WORD.findall(text[max(0, start - REACH):start].lower())[::-1]
    s = SCORES[kind]
    for word in [*before, *_WORD.findall(text[end:end + REACH].lower())]:
        if word in FOR[kind] or word in AGAINST[kind]:
            s += RAISE if word in FOR[kind] else -LOWER
            break
    return round(min(1.0, max(0.0, s)), 2)


def find_spans(text: str, threshold: float = THRESHOLD) -> list[Span]:
    """The spans of one text by start, kind and end: every confirmed base span, and context kinds from the threshold on."""
    base = [(k, s, e, score(k, text, s, e)) for k in BASE_KINDS for s, e in FINDERS[k](text)]
    more = [(k, s, e, score(k, text, s, e)) for k in KINDS[len(BASE_KINDS):] for s, e in FINDERS[k](text)]
    more = [x for x in more if x[3] >= threshold and not any(s <= x[1] and x[2] <= e for _, s, e, _ in base)] if more else []
    return sorted(base + more, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def redact(text: str, spans: list[Span]) -> str:
    """``text`` with each span replaced by its kind in brackets; of overlapping spans the first one names the place."""
    out, at = [], 0
    for kind, s, e, _ in spans:
        if s >= at:
            out += [text[at:s], f"[{kind}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def find_pii(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD,
             with_redacted: bool = False) -> DataFrame:
    """One row per document: key, spans (array of kind, start, end, score, base, in order), and with ``with_redacted``
    the text with every span replaced by its kind (null stays null)."""
    src = docs.select(F.col(key).alias("_k"), F.col(text).cast("string").alias("_t"))
    kind = src.schema["_k"].dataType.simpleString()
    span_type = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()),
                           ("base", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1 << 20, "_t"):
            texts = text_rows(b.column(1))
            found = [find_spans(t, threshold) for t in texts]
            cols = [b.column(0), pa.array([[{"kind": k, "start": s, "end": e, "score": x, "base": k in BASE_KINDS}
                                            for k, s, e, x in f] for f in found], pa.list_(span_type))]
            if with_redacted:
                there = b.column(1).is_valid().to_pylist()
                cols.append(pa.array([redact(t, f) if ok else None for t, f, ok in zip(texts, found, there)], pa.string()))
            yield pa.RecordBatch.from_arrays(cols, names=names)

    names = ["_k", "spans", *(["redacted"] if with_redacted else [])]
    schema = f"_k {kind}, spans array<struct<kind:string,start:bigint,end:bigint,score:double,base:boolean>>"
    return src.mapInArrow(run, schema + (", redacted string" if with_redacted else "")).withColumnRenamed("_k", key)


def span_list(spans) -> "F.Column":
    """``kind:start:end`` of each span, comma-joined (a column of ``find_pii`` spans)."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
