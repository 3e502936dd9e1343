"""Secret scans with multipart credentials linked by place.

Strong candidates stand alone: assignments of a secret, access-key identifiers and long
hexadecimal strings.  Weak candidates say little by themselves: an account or key
identifier, a random-looking string, an endpoint with or without a port.  They are
reported only when complementary parts meet in one scope:

- a secret, an identifier and an endpoint;
- a secret that is called one and the identifier of a key, as access keys come in pairs;
- a secret and an endpoint that names its user.

A scope reaches from a secret over at most ``REACH`` characters and ends at an empty line.
Candidates of each part are intervals in order of their start, so each join is one
bisection a secret and part.  Paths made of words are no secrets.

A document's scopes lie inside its text, so documents are scanned where they are read,
without a shuffle; a text of any length is worked through once per pattern.

Defined results: a null or empty text has no span; every input row gives one output row,
repeated rows included; an empty table gives an empty one; extra columns are left alone.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from math import log2
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from terralog.llm.common import per_text, released

#: The base patterns and the least length of a find.
ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
#: The same hexadecimal runs, short ones left out by the pattern itself: a run is found
#: whole because nothing hexadecimal stands before or after it.
LONG_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")

#: Weak parts: what they look like; the second kind is the one that needs the others.
IDENTIFIER = re.compile(
    r"(?:user(?:_?name)?|login|account|client_?id|access_?key(?:_?id)?|key_?id)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9@._+-]{3,})",
    re.I | re.A,
)
RANDOM = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+={0,2}(?![A-Za-z0-9+/_=-])")
ENDPOINT = re.compile(
    r"(?:https?|ftp|ssh|amqp|redis|mongodb|postgres(?:ql)?|mysql)://[^\s\"'<>]+"
    r"|\b(?:host(?:name)?|endpoint|server)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9.-]+(?::\d{1,5})?"
    r"|\b\d{1,3}(?:\.\d{1,3}){3}(?::\d{1,5})?\b",
    re.I | re.A,
)
#: What makes an identifier that of a key, an endpoint one with a user, a secret one that is called so.
OF_A_KEY = re.compile(r"(?:client_?id|access_?key|key_?id)", re.I | re.A)
WITH_A_USER = re.compile(r"[a-z]+://[^\s/@:]+(?::[^\s/@]*)?@", re.I)
CALLED_SECRET = re.compile(r"(?:secret|passw|passphrase|private|token|credential|key)[A-Za-z_-]*[\"']?\s{0,4}(?:=>|:=|[:=]|is)?\s{0,4}[\"']?\Z", re.I | re.A)
CALLED_WITHIN = 48
#: An empty line, whatever ends the lines.
BREAK = re.compile(r"(?>\r\n|\n|\r)[\x20\t]*(?>\r\n|\n|\r)")
#: A segment of a path: a word, perhaps numbered.
PATH_WORD = re.compile(r"[A-Z]?[a-z]*\d{0,4}|[A-Z]+\d{0,4}", re.A)
REACH = 400
LEAST_BITS = 3.0  # entropy per character of a random-looking string
KINDS = ("assign", "access", "hex", "identifier", "random", "endpoint")


class Span(NamedTuple):
    """Code points from ``start`` up to ``end``."""

    start: int
    kind: int
    end: int

    def __str__(self) -> str:
        return f"{KINDS[self.kind]}:{self.start}:{self.end}"


def base_spans(text: str) -> list[Span]:
    """Spans of the three base kinds by start, then kind."""
    found = [Span(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        found += [Span(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [Span(m.start(), 2, m.end()) for m in LONG_HEX.finditer(text)]
    return sorted(found)


def looks_random(word: str) -> bool:
    """Digits and letters mixed, with enough entropy per character, and no path of words."""
    if "/" in word and all(PATH_WORD.fullmatch(x) for x in re.split("[/_-]", word)):
        return False
    if not (any(c.isdigit() for c in word) and any(c.isalpha() for c in word)):
        return False
    n = len(word)
    return -sum(k / n * log2(k / n) for k in Counter(word).values()) >= LEAST_BITS


class Parts(NamedTuple):
    """Candidates by part, in order; ``keys`` and ``doors`` are those of ``names`` and ``ends`` that pair with a secret alone."""

    names: list[Span]
    ends: list[Span]
    keys: list[Span]
    doors: list[Span]
    secrets: list[Span]


def parts_of(text: str, base: list[Span]) -> Parts:
    """Base spans may be parts too: an access identifier names a key, an assigned or
    hexadecimal string is a secret; they are reported anyway and not repeated."""
    ends = [Span(m.start(), 5, m.end()) for m in ENDPOINT.finditer(text)]
    doors = [s for s in ends if WITH_A_USER.match(text, s.start)]
    own = [Span(m.start(), 3, m.end()) for m in IDENTIFIER.finditer(text)]
    access = [s for s in base if s.kind == 1]
    names = sorted(own + access)
    keys = sorted([s for s in own if OF_A_KEY.match(text, s.start)] + access)
    if not (names and ends or keys or doors):
        return Parts(names, ends, keys, doors, [])
    taken = sorted((s.start, s.end) for s in (*base, *ends, *names))
    starts, furthest, far = [a for a, _ in taken], [], 0
    for _, b in taken:
        far = max(far, b)
        furthest.append(far)

    def free(a: int, b: int) -> bool:
        k = bisect_left(starts, b)
        return k == 0 or furthest[k - 1] <= a

    secrets = [Span(m.start(), 4, m.end()) for m in RANDOM.finditer(text) if looks_random(m[0])]
    secrets = [s for s in secrets if free(s.start, s.end)] + [s for s in base if s.kind != 1]
    return Parts(names, ends, keys, doors, secrets)


def called_secret(text: str, s: Span) -> bool:
    return s.kind == 0 or bool(CALLED_SECRET.search(text[max(0, s.start - CALLED_WITHIN) : s.start]))


def linked_spans(text: str, base: list[Span]) -> list[Span]:
    """Weak candidates whose complementary parts stand in the same scope."""
    parts = parts_of(text, base)
    if not parts.secrets:
        return []
    breaks = [m.start() for m in BREAK.finditer(text)]
    found: set[Span] = set()
    at = {part: [s.start for s in getattr(parts, part)] for part in ("names", "ends", "keys", "doors")}
    used = {part: [0] * (len(starts) + 1) for part, starts in at.items()}
    for s in parts.secrets:
        k = bisect_right(breaks, s.start)
        low = max(s.start - REACH, breaks[k - 1] if k else 0)
        high = min(s.end + REACH, breaks[k] if k < len(breaks) else len(text))
        inside = {part: (bisect_left(starts, low), bisect_left(starts, high)) for part, starts in at.items()}
        there = {part for part, (a, b) in inside.items() if b > a}
        met = {"names", "ends"} if {"names", "ends"} <= there else set()
        if "keys" in there and called_secret(text, s):
            met.add("keys")
        if "doors" in there:
            met.add("doors")
        if met:
            found.add(s)
        for part in met:  # marked as ranges, not one by one
            a, b = inside[part]
            used[part][a] += 1
            used[part][b] -= 1
    for part, changes in used.items():
        covered = 0
        for s, change in zip(getattr(parts, part), changes, strict=False):
            covered += change
            if covered:
                found.add(s)
    return sorted(found - set(base))


def spans(text: str) -> tuple[list[Span], list[Span]]:
    base = base_spans(text)
    return base, sorted({*base, *linked_spans(text, base)})


def joined(found: list[Span]) -> str:
    return ",".join(map(str, found))


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked`` of every document."""

    def of(text: str) -> tuple:
        base, every = spans(text)
        count = Counter(s.kind for s in base)
        digest = hashlib.sha256(joined(base).encode()).hexdigest()
        return count[0], count[1], count[2], digest, joined(every), len(every) - len(base)

    schema = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_linked long"
    return per_text(docs, schema, lambda: of, id_col, text_col)


def masked(text: str, found: list[Span]) -> str:
    """The text with every span replaced by its kind in brackets; overlaps become one."""
    out, at = [], 0
    for s in found:
        if s.start >= at:
            out += [text[at : s.start], f"[{KINDS[s.kind]}]"]
        at = max(at, s.end)
    return "".join((*out, text[at:]))


def redacted(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """All rows and columns, secrets in the text replaced; ``length_col`` follows where it exists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new, changed = [], []
            for text in b.column(text_col).to_pylist():
                found = spans(text)[1] if text else []
                new.append(masked(text, found) if found else text)
                changed.append(bool(found))
            made = {text_col: pa.array(new, b.schema.field(text_col).type)}
            if length_col in b.schema.names:
                old = b.column(length_col).to_pylist()
                lengths = [len(t) if c else n for t, c, n in zip(new, changed, old, strict=True)]
                made[length_col] = pa.array(lengths, b.schema.field(length_col).type)
            columns = [made.get(name, b.column(k)) for k, name in enumerate(b.schema.names)]
            yield pa.RecordBatch.from_arrays(columns, b.schema.names)

    return docs.mapInArrow(lambda batches: released(run(batches)), docs.schema)
