"""Secret scan: assignment-aware lexing of source and configuration text.

Around every assignment mark (``=``, ``:``, ``:=``, ``=>``) the lexer reads a target
name on the left and an expression on the right: quoted strings, bare words, and
names of constants, joined by ``+``, ``.`` or juxtaposition, to the expression's end: over
brackets, and over line breaks after a join, a backslash or inside brackets. Names bound to
literals are remembered in text order, so a literal that reaches a sensitive
target through other names (``a = "..."``, ``b = a + "..."``, ``password = b``, or
``"${a}"``) is found where it was written. A literal's score is the sensitivity of
the target's name times the literal's strength (length, character classes,
entropy, not a placeholder); literals of 0.5 and more are reported as ``literal``
spans. So are all pieces of a value that has 0.5 once its pieces are put together. Names without any binding to a literal, and literals bound to plain names,
are left alone. A dotted name is read as what was bound to it (behind ``self``, ``this`` and ``cls`` also as what was bound to its last part), an element ``m["k"]`` or ``m.get("k")`` as what
was bound to ``m["k"]``, ``m.k`` or, in a literal map, to ``k``. Arguments of a call are literals of its target, but for the first one of a function that gets a value by its name
(``getenv("PASS", "...")``). Strings in triple quotes count line by line, put together. The body of a private key in PEM form is a literal named by its header.
A target whose last part says that it is about a secret and is none (``token_url``, ``password_length``) is a plain one. Elements (``<password>...</password>``) and options (``--password ...``) are pairs of a name and a literal too.
Names before commas at a line's begin (``user, password = "...", "..."``) take the values in their order; a name whose line ends
in ``: |`` or ``: >`` takes the lines below that are indented further (blocks inside a block are not read again). Where there are
more or fewer values than names, the last name alone takes the first value.

Three pattern kinds are always reported beside these: ``assign``, ``access`` and ``hex``
(see ``PATTERNS``), leftmost and non-overlapping per kind. Offsets count code
points; ends are exclusive.

Defined results: null text is read as empty and gives no spans; a null id stays
null; repeated rows are scanned each; an empty table gives no rows; columns other
than id and text are ignored. Of a target's name the last ``NAME_MAX`` characters count, whatever blanks follow it, and each name
keeps its newest binding. Values are shared lists, each summed and reported once, so work per text
is linear (times its different characters, for values of several pieces).
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from meterlake.llm.shared import text_of
from meterlake.sources.tables import table

#: Fixed patterns: kind, pattern, group whose length counts, least length.
PATTERNS = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I), 2, 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    ("hex", re.compile(r"[0-9a-f]{16,}"), 0, 16),  # runs are maximal, so shorter ones can be skipped by the pattern
)
KINDS = ("assign", "access", "hex", "literal")

NAME_MAX, MIN_SCORE = 120, 0.5
#: Characters kept of both ends of an assembled value, and pieces from one kept sum to the next.
_ENDS, _STEP = 32, 64

#: Parts of a target's name that make it sensitive, with their weights.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "secret": 1.0, "token": 0.9, "apikey": 1.0, "privatekey": 1.0,
    "accesskey": 1.0, "secretkey": 1.0, "signingkey": 1.0, "encryptionkey": 1.0, "credential": 0.9, "credentials": 0.9, "bearer": 0.8, "auth": 0.7,
}
#: Last parts of names that speak of a secret without being one.
HARMLESS = frozenset(
    "count description enabled endpoint error expires expiry field file filename format header help hint host label length limit link location max message min name "
    "param path pattern placeholder policy prefix prompt regex required rule size suffix timeout title ttl type uri url version visible".split()
)
#: Functions whose first argument is the name of a value.
GETTERS = frozenset("env environ fetch get getenv getparameter getproperty getsecret getvalue lookup read resolve".split())
PLACEHOLDERS = re.compile(r"(?i)^(?:change_?me|example|sample|dummy|none|null|true|false|test|todo|your[_-].*|x{3,}|\*{3,}|<.*>|\.{3,})$")

_OPERATOR = re.compile(r"(?::=|=>|(?<![=!<>:+*/|&^%-])=(?![=~])|(?<!:):(?![:=/]))")
_TARGET = re.compile(r"""([A-Za-z_][A-Za-z0-9_.-]*)(?:["'`]|\]|["'`]\])?(?:[ \t]*:[ \t]*[A-Za-z_][\w.\[\]]*)?[ \t]*$""", re.A)
_JOIN = re.compile(r"""\+|\.\.|\.(?=[ \t]*["'`$A-Za-z_])|\|\|""", re.A)
_PIECE = re.compile(
    r"""[fFrRbBuU]{0,2}(?P<triple>"{3}|'{3})(?P<lines>(?:(?!(?P=triple))(?:\\.|[^\\]))*+)(?P=triple)|[fFrRbBuU]{0,2}(?P<quote>["'`])(?P<text>(?:(?!(?P=quote))[^\\\n]|\\.)*+)(?P=quote)|\$\{?(?P<ref>[A-Za-z_]\w*)\}?|(?P<bare>[A-Za-z0-9_+/.~@%^&*!-]+={0,2})""",
    re.A | re.S,
)
#: What makes a name before it a call, an element, or an element with a default.
_CALL = re.compile(r"\(")
_ITEM = re.compile(r"""(?:\[[ \t]*["']([A-Za-z_][\w.-]*)["'][ \t]*\])+|\.get\([ \t]*["']([A-Za-z_][\w.-]*)["'][ \t]*(?=[,)])""", re.A)
_DOTTED = re.compile(r"[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)+\Z", re.A)
_LIKE_NAME = re.compile(r"(?:[A-Za-z_][A-Za-z_.:/-]*|[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+)\Z", re.A)
_OWNER = re.compile(r"""([A-Za-z_][\w.]*)\[[ \t]*["'`]\Z""", re.A)
#: Bodies of private keys.
_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----\s*([^-\s][^-]*)-----END", re.A)
#: Between pieces of one line; after a join or inside brackets; and before a join that begins an indented line.
_GAP = re.compile(r"(?:[ \t]|\\\r?\n)*+")
_WIDE = re.compile(r"(?:[ \t\r\n]|\\\r?\n|(?:#|//)[^\n]*)*+")
_NEXT = re.compile(r"""\r?\n[ \t]+(?=(?:\+|\.\.?|\|\|)[ \t]*["'`$])""")
#: Names and values without an assignment mark: elements, and options of a command.
_PAIRS = (re.compile(r"<([A-Za-z_][\w.-]*)(?:\s[^<>]*)?>\s*([^<>\s]+)\s*</\1\s*>", re.A), re.compile(r"(?<![\w-])--([A-Za-z][\w-]*)[ \t]+[\"']?([^\s\"'-][^\s\"']*)", re.A))
#: The other names of a list of targets; a value of a list; the rest of a line that begins a block, and a line.
_OTHERS = re.compile(r"(?:\A|;)[ \t]*(?:(?:const|let|var|local)[ \t]+)?((?:[A-Za-z_][\w.]*[ \t]*,[ \t]*)+)\Z", re.A)
_ELEMENT = re.compile(r"""[ \t]*((?:"(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+'|\([^()\n]*+\)|[^,\n=;#])++)""")
_BLOCK = re.compile(r"[ \t]*[|>][-+0-9]{0,2}[ \t]*\r?\n")
_LINE = re.compile(r"([ \t]*+)([^\n]*+)\n?")
_INSIDE = re.compile(r"\$?\{([A-Za-z_]\w*)\}", re.A)
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*\Z", re.A)
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+", re.A)


class Span(NamedTuple):
    kind: str
    start: int
    end: int


def name_weight(name: str) -> float:
    """How sensitive a target's name is: the best weight among its parts and neighbouring pairs of parts."""
    parts = [x.lower() for x in _PARTS.findall(name[-NAME_MAX:])]
    if parts and parts[-1] in HARMLESS:
        return 0.0
    tried = parts + [a + b for a, b in zip(parts, parts[1:])]
    return max((SENSITIVE.get(x, 0.0) for x in tried), default=0.0)


class _Sum(NamedTuple):
    """What ``strength`` asks of a value: characters counted, and its two ends (all of it, if it has ``_ENDS`` or fewer)."""

    n: int
    counts: Counter
    head: str
    tail: str

    def __add__(self, other: _Sum) -> _Sum:  # type: ignore[override]
        return _Sum(self.n + other.n, self.counts + other.counts, (self.head + other.head)[:_ENDS], (self.tail + other.tail)[-_ENDS:])

    def strength(self) -> float:
        n = self.n
        # longer ones: no fixed placeholder is so long, and the open ones ask for the ends or for all characters
        shown = self.head if n <= _ENDS else self.head + "".join(self.counts) + self.tail
        if n < 8 or PLACEHOLDERS.match(shown) or any(c.isspace() for c in self.counts):
            return 0.0
        entropy = -sum(c / n * math.log2(c / n) for c in self.counts.values() if c / n)
        classes = sum(bool(re.search(p, shown)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
        return min(1.0, 0.25 * min(n, 16) / 16 + 0.45 * min(entropy, 3.5) / 3.5 + 0.15 * min(classes, 3)) if classes > 1 or n >= 12 else 0.0


def _sum_of(literal: str) -> _Sum:
    return _Sum(len(literal), Counter(literal), literal[:_ENDS], literal[-_ENDS:])


def strength(literal: str) -> float:
    """How much a literal looks like a secret, 0 to 1."""
    return _sum_of(literal).strength()


class _Value:
    """A literal (``span``), or a list of values that are written one after another: ``part``, then ``next``.

    Lists are shared by all that refer to them. ``stop``: a comma follows, so ``next`` begins
    another value. ``loose``: a word without a binding, which is no part of an assembled value.
    """

    __slots__ = ("judged", "loose", "next", "part", "span", "stop", "sum", "told", "walked")

    def __init__(self, span=None, part=None, next=None, stop=False, loose=False):
        self.span, self.part, self.next, self.stop, self.loose = span, part, next, stop, loose
        self.sum, self.told, self.judged, self.walked = None, False, 0.0, 0.0


_NOTHING = _Sum(0, Counter(), "", "")


def _summed(x: _Value, text: str) -> _Sum:
    """The sum of ``x``; kept at ``x`` and at each ``_STEP`` of its list, so that lists within lists are not summed anew."""
    if x.sum is None and x.part is None:
        x.sum = _sum_of(text[slice(*x.span)])
    if x.sum is None:
        run = []
        y = x
        while y is not None and y.sum is None:
            run.append(y)
            y = None if y.stop else y.next
        total = y.sum if y is not None else _NOTHING
        for k in range(len(run) - 1, -1, -1):
            part = run[k].part
            own = _NOTHING if part.loose else _summed(part, text)  # a literal, or a list that was summed when it was bound
            total = own + total
            if k % _STEP == 0:
                run[k].sum = total
    return x.sum


def _named(word: str, bound: dict[str, _Value]) -> _Value | None:
    """What a name, maybe a dotted one, is bound to."""
    if _NAME.match(word):
        return bound.get(word)
    if not _DOTTED.match(word):
        return None
    return bound.get(word) or (bound.get(word.rpartition(".")[2]) if word.partition(".")[0] in ("self", "this", "cls") else None)


def _lines(lo: int, hi: int, text: str) -> list[_Value]:
    """The lines of a string in triple quotes, without the blanks around them and the marks of a key."""
    found = [(m.start(2), m.start(2) + len(m[2].rstrip())) for m in _LINE.finditer(text, lo, hi) if m[2].strip() and not m[2].startswith("-----")]
    return [_Value(x) for x in found]


def _expression(text: str, at: int, bound: dict[str, _Value], read: dict[tuple, _Value | None]) -> _Value | None:
    """The value written at ``at``, up to its end; None if it has no literals. ``read`` has what was read before, by place."""
    items: list[list] = []
    depth, have, fresh, tail, key, skip = 0, False, True, None, None, False
    while True:
        if key is not None and key in read:
            tail = read[key]
            break
        at = (_WIDE if depth else _GAP).match(text, at).end()
        mark = text[at : at + 1]
        if depth and mark and mark in ")],":
            at += 1
            if mark == ",":
                fresh, skip = True, False
                if items:
                    items[-1][2] = True
            else:
                depth, skip = depth - 1, False
            continue
        if not depth and not fresh and (line := _NEXT.match(text, at)):
            at = line.end()
        if join := _JOIN.match(text, at):
            at = _WIDE.match(text, join.end()).end() if not fresh else _GAP.match(text, join.end()).end()
        if (join or fresh) and text[at : at + 1] in ("(", "["):
            depth, fresh, at = depth + 1, True, at + 1
            continue
        piece = _PIECE.match(text, at)
        if not piece or not (join or fresh or (piece["quote"] and have)):
            break
        at, fresh = piece.end(), False
        new: list[_Value] = []
        word = piece["ref"] or piece["bare"]
        if piece["bare"] and (item := _ITEM.match(text, at)) and (item[1] or item[2]):
            inner = item[1] or item[2]
            base = word.removesuffix(".get")
            value = bound.get(f"{base}.{inner}") or bound.get(inner)
            at, have, opened = item.end(), True, item[2] is not None
            new += [value] * (value is not None)
            depth += opened
        elif piece["bare"] and (_NAME.match(word) or _DOTTED.match(word)) and (call := _CALL.match(text, at)):
            base, _, last = word.rpartition(".")
            argument = _PIECE.match(text, _WIDE.match(text, call.end()).end())
            said = argument["text"] if argument and argument["quote"] else None
            if last == "get" and said is not None and ((value := bound.get(f"{base}.{said}")) or (value := bound.get(said))):
                new.append(value)
            at, depth, fresh, have = call.end(), depth + 1, True, True
            skip = last.lower().replace("_", "") in GETTERS and said is not None and (bool(_LIKE_NAME.match(said)) or text[argument.end() : argument.end() + 1] == ",")
            if skip:
                at, fresh = argument.end(), False
        elif piece["triple"]:
            have = True
            new += _lines(*piece.span("lines"), text)
        elif piece["quote"]:
            have = True
            lo, end = piece.span("text")
            for inner in _INSIDE.finditer(text, lo, end):
                if inner[1] in bound:
                    new += [_Value((lo, inner.start()))] * (lo < inner.start()) + [bound[inner[1]]]
                    lo = inner.end()
            new += [_Value((lo, end))] * (lo < end)
        elif (value := _named(word, bound)) is not None:
            have = True
            new.append(value)
        elif piece["bare"]:
            name = bool(_NAME.match(word) or _DOTTED.match(word))
            have = True
            if not (name and depth) and not (_DOTTED.match(word) and not any(map(str.isdigit, word))):  # a dotted name of letters is one of something else
                new.append(_Value(piece.span("bare"), loose=name))
        for k, value in enumerate(new):
            items.append([key if k == 0 else None, value, False])
        key = (at, depth > 0, have)
    for key, value, stop in reversed(items):
        tail = _Value(part=value, next=tail, stop=stop)
        if key is not None:
            read[key] = tail
    return tail.part if tail is not None and tail.next is None else tail


def _chained(values: list[_Value]) -> _Value | None:
    tail = None
    for value in reversed(values):
        tail = _Value(part=value, next=tail)
    return values[0] if len(values) == 1 else tail


def _block(text: str, mark: int, at: int) -> tuple[_Value | None, int]:
    """The lines from ``at`` that are indented further than the line of ``mark``, without the blanks around them, and where they end."""
    least, lines = len(_LINE.match(text, text.rfind("\n", 0, mark) + 1)[1]), []
    while at < len(text):
        line = _LINE.match(text, at)
        if said := line[2].rstrip():
            if len(line[1]) <= least:
                break
            lines.append(_Value((line.start(2), line.start(2) + len(said))))
        at = line.end()
    return _chained(lines), at


def _listed(text: str, at: int, names: list[str]) -> list[tuple[str, int]]:
    """Each name with the place of its value in the list at ``at``; nothing if there are not as many values up to the end of the statement."""
    starts: list[int] = []
    while (element := _ELEMENT.match(text, at)) and len(starts) < len(names):
        starts.append(element.start(1))
        at = element.end()
        if text[at : at + 1] != ",":
            break
        at += 1
    return list(zip(names, starts)) if len(starts) == len(names) and text[at : at + 1] in ("", "\n", ";", "#") else []


def assigned_literals(text: str) -> list[Span]:
    """Literals that reach a sensitive target, in text order, each once: those strong enough alone, and all pieces of an assembled value that is."""
    bound: dict[str, _Value] = {}
    read: dict[tuple, _Value | None] = {}
    found: set[tuple[int, int]] = set()

    def tell(x: _Value) -> None:
        todo = [x]
        while todo:
            x = todo.pop()
            if x.told:
                continue
            x.told = True
            if x.part is None:
                found.add(x.span)
                continue
            if not x.part.loose:
                todo.append(x.part)
            if x.next is not None and not x.stop:
                todo.append(x.next)

    def judge(x: _Value, weight: float) -> None:
        todo = [(x, True)]
        while todo:
            x, whole = todo.pop()
            if whole and x.judged < weight:
                x.judged = weight
                if not x.told and weight * _summed(x, text).strength() >= MIN_SCORE:
                    tell(x)
            if x.part is not None and x.walked < weight:
                x.walked = weight
                todo.append((x.part, True))
                if x.next is not None:
                    todo.append((x.next, x.stop))

    block = 0
    for op in _OPERATOR.finditer(text):
        end = op.start()
        while end and text[end - 1] in " \t":  # blanks before one mark are those of no other
            end -= 1
        left = text[max(0, end - NAME_MAX) : end]
        target = _TARGET.search(left.rsplit("\n", 1)[-1])
        if not target:
            continue
        line = left[left.rfind("\n") + 1 :]
        pairs = []
        if op[0] != ":" and "," in line and (len(line) < len(left) or end <= NAME_MAX) and (others := _OTHERS.search(line[: target.start()])):
            pairs = _listed(text, op.end(), [*(n.strip() for n in others[1].split(",")[:-1]), target[1]])
        if op[0] == ":" and op.start() >= block and (header := _BLOCK.match(text, op.end())):
            value, block = _block(text, op.start(), header.end())
            met = [(target[1], value)]
        else:
            met = [(name, _expression(text, at, bound, read)) for name, at in pairs or [(target[1], op.end())]]
        for name, value in met:
            names = {name, name.rpartition(".")[2]}
            if owner := _OWNER.search(line[: target.start()]):
                names.add(f"{owner[1]}.{name}")
            if value is None:
                for n in names:
                    bound.pop(n, None)
                continue
            if value.part is not None:
                _summed(value, text)
            bound.update(dict.fromkeys(names, value))
            if weight := name_weight(name):
                judge(value, weight)
    for m in _PEM.finditer(text):
        found.update(v.span for v in _lines(*m.span(2), text))
    for pattern in _PAIRS:
        for m in pattern.finditer(text):
            if (weight := name_weight(m[1])) and weight * strength(m[2]) >= MIN_SCORE:
                found.add(m.span(2))
    return [Span("literal", *x) for x in sorted(found)]


def scan_text(text: str) -> list[Span]:
    """All spans of a text, by start, then kind in the order of ``KINDS``."""
    spans = [Span(kind, *m.span()) for kind, p, group, least in PATTERNS for m in p.finditer(text) if len(m[group]) >= least]
    if "=" in text or ":" in text or "--" in text or "</" in text:
        spans += assigned_literals(text)
    return sorted(spans, key=lambda s: (s.start, KINDS.index(s.kind)))


def redact_text(text: str, spans: list[Span], mark: str = "[secret]") -> str:
    """The text with each run of overlapping spans replaced by ``mark``."""
    out, at = [], 0
    for s in spans:
        if s.end <= at:
            continue
        if s.start >= at:
            out += [text[at : s.start], mark]
        at = s.end
    return "".join(out) + text[at:]


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id and ``spans``, an array of (kind, start, end)."""
    rows = docs.select(docs[id_col].alias("id"), text_of(docs[text_col]).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [[s._asdict() for s in scan_text(t)] for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(found, spans)], ["id", "spans"])

    return rows.mapInArrow(scan, f"id {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>").withColumnRenamed("id", id_col)


def redact_secrets(docs: DataFrame, text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """``docs`` with every secret in ``text_col`` replaced; other columns and rows as they were; null text stays null."""
    schema, at = docs.schema, docs.columns.index(text_col)

    def redact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t and redact_text(t, scan_text(t), mark) for t in b.column(at).to_pylist()]
            yield b.set_column(at, b.schema.field(at), pa.array(texts, b.schema.field(at).type))

    return docs.mapInArrow(redact, schema)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of every document; counts and digest of the three pattern kinds, and all spans as text."""
    from pyspark.sql import functions as F

    found = scan_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] != "literal")
    said = lambda a: F.concat_ws(",", F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")),
        F.sha2(said(base), 256).alias("base_sha256"),
        said(F.col("spans")).alias("spans"),
        count("literal").alias("n_literal"),
    )


QUERIES = {"op5_secret_scan": op5_secret_scan}
ORACLE_SQL: dict[str, str] = {}
