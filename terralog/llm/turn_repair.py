"""Conversation structure repair: the cheapest edits that give ``(system? (user assistant)+)?``.

Rows are first damaged as a hash of conversation and turn says (a test bed: what comes out
is known to be broken), then every conversation is repaired.  Each row has a symbol, its
role's initial and its fault; equal symbols in a row are one run.  A symbol is a min-plus
transition between the four states of the pattern (begun, after system, after user, after
assistant), with insertions closed in.  Costs to the end are found run by run, backwards,
through binary powers of the run's transition, which are kept for all conversations.  Then
the choices of each run are unrolled forwards, the least letter among the cheapest each
time.

Two passes.  The first moves a role, a digest of the text and a turn for each row, and
gives a row per conversation with its counts and its audit; the second moves the texts,
sorted, behind the audit of their conversation and hashes the repaired ones as they come.
A task holds symbols and digests of one conversation and the texts of one batch, never the
texts of a conversation; a conversation is one task's work, as its hash is sequential.

Defined results: null role, text, conversation or turn read as one blank where they are
part of a text, and null conversations are one conversation; rows of equal turn follow by
role, then by digest of the text, and a repeat follows its row; a role of another initial
than s, u or a is never kept as it is; a conversation without rows after damage has zeros,
an empty audit and the hash of the empty text; empty tables give empty ones; very long texts
are hashed whole, once; extra columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\x0c\r"
CLASS = "[ \\t\\n\\x0B\\f\\r]"
#: Costs of the edits, and what a truncated row adds when it stays.
RENAME, DELETE, INSERT, CUT = 2, 3, 2, 1
#: States: nothing yet, after s, after u, after a.  Where each role leads, and where all is done.
NEXT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
STATES, DONE = range(4), (0, 3)
#: What an inserted or renamed row is in each state, and the state after it.
TURN = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}
FAR = float("inf")

Matrix = tuple[tuple[float, ...], ...]


def times(a: Matrix, b: Matrix) -> Matrix:
    return tuple(tuple(min(a[i][k] + b[k][j] for k in STATES) for j in STATES) for i in STATES)


def closure() -> Matrix:
    """Cheapest insertions from state to state."""
    step = tuple(tuple(0 if i == j else INSERT if TURN[i][1] == j else FAR for j in STATES) for i in STATES)
    return times(times(step, step), step)


INSERTS = closure()


def moves(symbol: str) -> list[tuple[str, int, dict[int, int]]]:
    """Letter, cost and next states of what may be done with a row, letters ascending."""
    if symbol == "x":
        return [("D", DELETE, {s: s for s in STATES})]
    role, cut = symbol[0].lower(), CUT * symbol.isupper()
    return [
        ("D", DELETE, {s: s for s in STATES}),
        ("K", cut, NEXT.get(role, {})),
        ("R", RENAME + cut, {s: after for s, (_, after) in TURN.items()}),
    ]


@lru_cache(maxsize=1024)
def power(symbol: str, bit: int) -> Matrix:
    """The transition of 2**bit rows of one symbol, insertions before each row included."""
    if bit:
        half = power(symbol, bit - 1)
        return times(half, half)
    best = [[FAR] * 4 for _ in STATES]
    for _, cost, to in moves(symbol):
        for s, after in to.items():
            best[s][after] = min(best[s][after], cost)
    return times(INSERTS, tuple(map(tuple, best)))


def costs_before(symbol: str, length: int, after: tuple[float, ...]) -> tuple[float, ...]:
    """Costs to the end before a run, by state, from those after it."""
    for bit in range(length.bit_length()):
        if length >> bit & 1:
            m = power(symbol, bit)
            after = tuple(min(m[s][t] + after[t] for t in STATES) for s in STATES)
    return after


def repair(symbols: str) -> tuple[int, str]:
    """Least cost and the ASCII-least audit of that cost."""
    runs = [(s, sum(1 for _ in rows)) for s, rows in groupby(symbols)]
    done = tuple(0 if s in DONE else FAR for s in STATES)
    end = tuple(min(INSERTS[s][t] + done[t] for t in STATES) for s in STATES)
    bounds = [end]
    for symbol, length in reversed(runs):
        bounds.append(costs_before(symbol, length, bounds[-1]))
    bounds.reverse()
    audit, state = [], 0
    for (symbol, length), before, after in zip(runs, bounds, bounds[1:], strict=False):
        # Costs at each row of the run, last row first, from its end.
        inside = [after]
        for _ in range(length - 1):
            inside.append(costs_before(symbol, 1, inside[-1]))
        here, options = before, moves(symbol)
        while inside:
            then = inside.pop()
            while True:
                left = here[state]
                found = [(letter, to[state]) for letter, cost, to in options if state in to and cost + then[to[state]] == left]
                step = TURN[state][1]
                if found and found[0][0] == "D" or not INSERT + here[step] == left:
                    break
                audit.append("I")
                state = step
            letter, state = found[0]
            audit.append(letter)
            here = then
    while state not in DONE:
        audit.append("I")
        state = TURN[state][1]
    return int(bounds[0][0]), "".join(audit)


def damaged(chats: DataFrame) -> DataFrame:
    """Rows after damage: ``conv_id, turn, role, text, digest, copy``; dropped rows have a null ``copy``."""
    blank = F.lit(" ")
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), blank)
    kind = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text_of("text"), "[.!?]", "")).otherwise(text_of("text"))
    rows = chats.select(
        F.col("conv_id").alias("conv_id"),
        F.col("turn").alias("turn"),
        F.when(kind == 4, "user").otherwise(text_of("role")).alias("role"),
        text.alias("text"),
        F.when(kind == 0, F.array(F.lit(None).cast("int")))
        .when(kind == 3, F.array(F.lit(0), F.lit(1)))
        .otherwise(F.array(F.lit(0)))
        .alias("copies"),
    )
    return rows.select(
        "conv_id", "turn", "role", "text", F.unhex(F.md5(F.col("text").cast("binary"))).alias("digest"), F.explode("copies").alias("copy")
    )


def fault_of(text: Column) -> Column:
    """'x' for a blank text, 't' for a truncated one, 'f' otherwise."""
    bare = F.regexp_replace(text, f"{CLASS}+$", "")
    return F.when(bare == "", "x").when(F.substring(bare, -1, 1).isin(".", "!", "?"), "f").otherwise("t")


ORDER = ["conv_id", "turn", "role", "digest", "copy"]
COUNTS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
LEGAL = {"su", "ua", "au"}


class Conversation:
    """Symbols and counts of one conversation, row by row in order."""

    def __init__(self) -> None:
        self.symbols: list[str] = []
        self.seen: set[bytes] = set()
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = self.last = None
        self.initial: str | None = None

    def add(self, turn: int | None, role: str, digest: bytes, fault: str) -> None:
        key, initial = role.encode() + b"\0" + digest, role[:1]
        if self.initial is not None:
            self.illegal += self.initial + initial not in LEGAL
        self.initial = initial
        symbol = initial if initial and initial in "sua" else "o"
        if fault == "x":
            self.blank += 1
            symbol = "x"
        elif key in self.seen:
            self.duplicate += 1
            symbol = "x"
        elif fault == "t":
            self.truncated += 1
            symbol = symbol.upper()
        self.seen.add(key)
        self.symbols.append(symbol)
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.turns += turn != self.last
            self.high = self.last = turn

    def row(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        cost, audit = repair("".join(self.symbols))
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit


def audits(rows: DataFrame) -> DataFrame:
    """A row per conversation: its counts, cost and audit.  Texts do not move, only their digests."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    short = rows.select(*ORDER, fault_of(F.col("text")).alias("fault"))
    dealt = short.repartition("conv_id").sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in ORDER])
    names = ["conv_id", *(part.split()[0] for part in COUNTS.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = None
        chat, at, out = None, None, []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            kinds = [types, *[pa.int64()] * 6, pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

        for b in batches:
            types = b.schema.field("conv_id").type
            for conv, turn, role, digest, copy, fault in zip(*(b.column(c).to_pylist() for c in [*ORDER, "fault"]), strict=True):
                if chat is None or conv != at:
                    if chat is not None:
                        out.append((at, *chat.row()))
                    chat, at = Conversation(), conv
                if copy is not None:
                    chat.add(turn, role, digest, fault)
            if len(out) >= 1000:
                yield flush()
                out = []
        if chat is not None:
            out.append((at, *chat.row()))
            yield flush()

    return dealt.mapInArrow(run, f"conv_id {kind}, {COUNTS}")


def hashed(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``found`` with the hash of each repaired conversation; texts stream by behind their audit."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    texts = rows.where(F.col("copy").isNotNull()).select(F.lit(1).alias("part"), *ORDER, "text")
    both = found.withColumn("part", F.lit(0)).unionByName(texts, allowMissingColumns=True)
    order = ["conv_id", "part", *ORDER[1:]]
    dealt = both.repartition("conv_id").sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in order])
    names = [part.split()[0] for part in COUNTS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, types, out = None, None, []
        state = at = 0
        told, started = sha256(), False

        def put(role: str, text: str) -> None:
            nonlocal started
            told.update((("\n" if started else "") + f"{role}:{text}").encode())
            started = True

        def inserts() -> None:
            nonlocal state, at
            while at < len(head[-1]) and head[-1][at] == "I":
                role, state = TURN[state]
                put(role, "")
                at += 1

        def finish() -> None:
            inserts()
            out.append((*head, told.hexdigest()))

        def flush() -> pa.RecordBatch:
            kinds = [types, *[pa.int64()] * 6, pa.string(), pa.string()]
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]
            return pa.RecordBatch.from_arrays(columns, ["conv_id", *names, "repaired_sha256"])

        for b in batches:
            types = b.schema.field("conv_id").type
            heads = zip(*(b.column(c).to_pylist() for c in ["conv_id", *names]), strict=True)
            for part, role, text, counts in zip(b.column("part").to_pylist(), b.column("role").to_pylist(), b.column("text"), heads, strict=True):
                if not part:
                    if head is not None:
                        finish()
                    head, state, at, told, started = counts, 0, 0, sha256(), False
                    continue
                inserts()
                letter = head[-1][at]
                at += 1
                if letter == "K":
                    state = NEXT[role[0]][state]
                    put(role, text.as_py())
                elif letter == "R":
                    role, state = TURN[state]
                    put(role, text.as_py())
            if len(out) >= 1000:
                yield flush()
                out = []
        if head is not None:
            finish()
            yield flush()

    return dealt.mapInArrow(run, f"conv_id {kind}, {COUNTS}, repaired_sha256 string")


def repaired(chats: DataFrame) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256`` of every conversation."""
    rows = damaged(chats)
    return hashed(rows, audits(rows))
