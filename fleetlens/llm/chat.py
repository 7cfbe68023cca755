"""Operator 1, chat formatting by incremental black-box rendering.

A template is any function from a list of (role, text) turns to a string.
The operator renders every successive turn prefix of a conversation and
compares consecutive outputs: what a prefix adds to the one before is the
turn's span. When an output does not begin with the one before it, the
template has rewritten history: the turn is marked ``rewrites``, ``keeps``
says how much of the earlier output stands, and the span is what follows it.
So the outputs can be put together again from the spans, whatever the
template does. Inside a span the text's place is found by rendering the turn
with two different one-character texts: the outputs part where the text
begins, and what follows is the tail.

Turns of a conversation are read in order (turn, role, text; nulls first).
Nothing is assumed about the template: it may number its turns, drop old
ones or look back as far as it likes, so each prefix is rendered whole, and a
conversation's turns and last output are held until it ends. Its time grows
with the square of its length; it is one task's work. For conversations too
long for that, a template's author may promise with ``lookback`` that a turn's
rendering depends on no more than so many turns before it: then at most twice
as many are held and rendered, and time grows with the length. Where the
held turns move on, the last span is rendered again from the shorter history,
and a turn that breaks the promise is marked ``rewrites``.

Edge cases: null text or role is empty; repeated rows are turns of their
own; a null conversation key is one conversation; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import slices, spread, text_rows

Turn = tuple[str, str]
Template = Callable[[Sequence[Turn]], str]

# The control strings of the built-in template.
CONTROL = ["<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]", "[/END]"]

_SPECIAL = re.compile("|".join(map(re.escape, ["\\", *CONTROL])))
_ESCAPED = re.compile(r"\\(.)", re.S)
_SPAN = re.compile(r"\[INST\] (?P<user>.*) \[/INST\]|\[ROLE\] (?P<role>.*?) \[/ROLE\] (?P<text>.*) \[/END\]"
                   r"| (?P<assistant>.*) </s>", re.S)
PROBES = ("\ue000", "\ue001")


def escape(text: str) -> str:
    """Double each backslash and break each control string with one."""
    return _SPECIAL.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def instruct_template(turns: Sequence[Turn]) -> str:
    """``<s>`` then ``[INST] user [/INST]``, `` assistant </s>`` or a marked other role, a turn each."""
    out = ["<s>"]
    for role, text in turns:
        if role == "user":
            out.append(f"[INST] {escape(text)} [/INST]")
        elif role == "assistant":
            out.append(f" {escape(text)} </s>")
        else:
            out.append(f"[ROLE] {escape(role)} [/ROLE] {escape(text)} [/END]")
    return "".join(out)


def read_span(span: str) -> Turn:
    """The (role, text) that a span of ``instruct_template`` was made from."""
    m = _SPAN.fullmatch(span)
    if m is None:
        raise ValueError(f"not a turn: {span[:80]!r}")
    for role in ("user", "assistant"):
        if m[role] is not None:
            return role, unescape(m[role])
    return unescape(m["role"]), unescape(m["text"])


def common_length(a: str, b: str) -> int:
    """Length of the longest common beginning, by halving."""
    if a.startswith(b):
        return len(b)
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:  # the first lo characters agree; the first hi + 1 do not, or there are no more
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


class Renderer:
    """Spans of one conversation's turns, a turn at a time."""

    def __init__(self, template: Template, lookback: int | None = None):
        self.template = template
        self.most = None if lookback is None else 2 * (lookback + 1)
        self.held: list[Turn] = []
        self.out = self.start = template([])
        self.before = 0  # length of the output of turns no longer held, less that of the held ones' opening

    def _text_place(self, role: str, skip: int) -> tuple[int, int]:
        """Lengths of what stands before and after the text in the span."""
        a, b = (self.template([*self.held, (role, p)]) for p in PROBES)
        at = max(skip, common_length(a, b)) if len(a) > skip else len(a)
        return at - skip, max(0, len(a) - at - 1)

    def add(self, role: str, text: str) -> tuple[str, int, int, bool, int]:
        """(span, where its text begins, where it ends, history rewritten, length of the earlier output that stands)."""
        out = self.template([*self.held, (role, text)])
        common = common_length(out, self.out)
        rewrites = common < len(self.out)
        span, keeps = out[common:], self.before + common
        head, tail = self._text_place(role, common)
        self.held.append((role, text))
        self.out = out
        if self.most is not None and len(self.held) >= self.most:
            self.held = self.held[len(self.held) // 2:]
            before, shorter = self.template(self.held[:-1]), self.template(self.held)
            rewrites |= not shorter.startswith(before) or shorter[len(before):] != span
            self.before += len(out) - len(shorter)
            self.out = shorter
        return span, max(0, head), max(0, len(span) - tail), rewrites, keeps


def format_turns(conversations: DataFrame, template: Template = instruct_template, conv: str = "conv_id",
                 turn: str = "turn", role: str = "role", text: str = "text", lookback: int | None = None) -> DataFrame:
    """One row per turn: conv, ordinal (from 0), start (the template's opening, first turn only), span,
    text_from, text_to, loss (an assistant's turn), rewrites, keeps.

    A conversation's formatted text is its rows' ``start`` and ``span`` in
    order; after a turn that rewrites, it is the first ``keeps`` characters of
    what came before, and the span. Rows leave in order, each conversation in one partition.
    """
    src = conversations.select(F.col(conv).alias("_c"), F.col(turn).alias("_n"),
                               F.coalesce(F.col(role).cast("string"), F.lit("")).alias("_r"),
                               F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_t"))
    src = spread(src, "_c").sortWithinPartitions("_c", "_n", "_r", "_t").select("_c", "_r", "_t")
    kind = src.schema["_c"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: object = run  # no conversation yet
        r, n = None, 0
        for b in slices(batches, 4 << 20, "_t"):
            rows = []
            for c, who, what in zip(b.column(0).to_pylist(), text_rows(b.column(1)), text_rows(b.column(2))):
                if r is None or c != now:
                    now, r, n = c, Renderer(template, lookback), 0
                span, lo, hi, rewrites, keeps = r.add(who, what)
                rows.append((n, r.start if n == 0 else "", span, lo, hi, who == "assistant", rewrites, keeps))
                n += 1
            cols = list(zip(*rows))
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(x, k) for x, k in zip(cols, kinds)]], names=names)

    names = ["_c", "ordinal", "start", "span", "text_from", "text_to", "loss", "rewrites", "keeps"]
    return src.mapInArrow(run, f"_c {kind}, ordinal long, start string, span string, text_from long, text_to long, "
                               "loss boolean, rewrites boolean, keeps long").withColumnRenamed("_c", conv)


def digest(turns: DataFrame, conv: str = "conv_id", read: Callable[[str], Turn] = read_span,
           plain: Callable[[str], str] = unescape) -> DataFrame:
    """Digests per conversation, read back from ``format_turns`` rows as they leave it (in order).

    Returns conv, n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars, n_rewrites. Only hash states and counts are held.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: list | None = None
        done: list[tuple] = []

        def close() -> None:
            c, n, turns_h, chars, loss_h, size, rewrites = state
            done.append((c, n, turns_h.hexdigest(), chars, loss_h.hexdigest(), size, rewrites))

        def rows() -> pa.RecordBatch:
            cols = list(zip(*done)) or [[]] * 7
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

        kinds = None
        for b in slices(batches, 4 << 20, "span"):
            kinds = kinds or [b.column(0).type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            for c, n, start, span, lo, hi, loss, rewrites, keeps in zip(*[b.column(i).to_pylist() for i in range(9)]):
                if n == 0:
                    if state:
                        close()
                    state = [c, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                who, what = read(span)
                state[1] += 1
                state[2].update(f"{who}\n{what}\n".encode())
                if loss:
                    masked = plain(span[lo:hi])
                    state[3] += len(masked)
                    state[4].update(masked.encode())
                state[5] = len(start) + len(span) if n == 0 else keeps + len(span)
                state[6] += rewrites
            if done:
                yield rows()
        if state:
            close()
            yield rows()

    kind = turns.schema[conv].dataType.simpleString()
    names = [conv, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_rewrites"]
    return turns.mapInArrow(run, f"`{conv}` {kind}, n_turns long, turns_sha256 string, loss_chars long, "
                                 "loss_sha256 string, formatted_chars long, n_rewrites long")
