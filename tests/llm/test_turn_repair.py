"""Repair against plain search over edit sequences, and against a plain reading of the contract."""

import heapq
import re
from hashlib import md5, sha256
from itertools import product
from zlib import crc32

import pytest

from terralog.llm import turn_repair

SCHEMA = "conv_id long, turn long, role string, text string"
PATTERN = re.compile("(s?(ua)+)?")
SPACE = " \t\n\x0b\x0c\r"


def plain_damage(rows):
    chats = {}
    show = lambda x: " " if x is None else str(x)
    for conv, turn, role, text in rows:
        out = chats.setdefault(conv, [])
        kind = crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        role, text = show(role), show(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        out.extend([(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1))
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1], md5(x[2].encode()).digest())) for c, r in chats.items()}


def plain_symbols(rows):
    seen, symbols, counts = set(), [], dict(blank=0, duplicate=0, truncated=0)
    for _, role, text in rows:
        fault = None
        if not text.strip(SPACE):
            fault = "blank"
        elif (role, text) in seen:
            fault = "duplicate"
        elif text.rstrip(SPACE)[-1] not in ".!?":
            fault = "truncated"
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        symbols.append((role[:1], fault))
    return symbols, counts


def plain_repair(symbols):
    """Cheapest edit sequence, least letters first, by search over all of them; the roles come along."""
    heap, best = [(0, "", 0, "")], set()
    while heap:
        cost, audit, at, roles = heapq.heappop(heap)
        if at == len(symbols) and PATTERN.fullmatch(roles):
            return cost, audit
        tail = (at, "" if not roles else roles[-1] if roles[-1] != "s" else "s")
        if tail in best:
            continue
        best.add(tail)
        options = [("I", 2, 0, r) for r in "ua"]
        if at < len(symbols):
            initial, fault = symbols[at]
            extra = fault == "truncated"
            options.append(("D", 3, 1, ""))
            if fault not in ("blank", "duplicate"):
                options.append(("K", extra, 1, initial or "?"))
                options.extend(("R", 2 + extra, 1, r) for r in "ua")
        for letter, more, step, role in options:
            new = roles + role
            if re.fullmatch("(s?(ua)*u?)?", new):
                heapq.heappush(heap, (cost + more, audit + letter, at + step, new))
    raise AssertionError


def plain_hash(rows, audit):
    at, out = 0, []
    names = {"u": "user", "a": "assistant"}
    last = ""
    for letter in audit:
        turn = "a" if last == "u" else "u"
        if letter == "D":
            at += 1
            continue
        if letter == "I":
            out.append(f"{names[turn]}:")
        elif letter == "R":
            out.append(f"{names[turn]}:{rows[at][2]}")
            at += 1
        else:
            out.append(f"{rows[at][1]}:{rows[at][2]}")
            turn = rows[at][1][0]
            at += 1
        last = turn
    return sha256("\n".join(out).encode()).hexdigest()


def plain(rows):
    result = {}
    for conv, chat in plain_damage(rows).items():
        symbols, counts = plain_symbols(chat)
        cost, audit = plain_repair(symbols)
        turns = {t for t, _, _ in chat if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(symbols, symbols[1:], strict=False))
        result[conv] = (gaps, *counts.values(), illegal, cost, audit, plain_hash(chat, audit))
    return result


def got(df):
    return {r.conv_id: tuple(r)[1:] for r in turn_repair.repaired(df).collect()}


def as_symbol(role, fault):
    return "x" if fault in ("blank", "duplicate") else role.upper() if fault else role


@pytest.mark.parametrize("length", range(6))
def test_every_short_symbol_sequence(length):
    kinds = [("s", None), ("u", None), ("a", None), ("o", None), ("u", "truncated"), ("a", "truncated"), ("s", "blank")]
    for symbols in product(kinds, repeat=length):
        assert turn_repair.repair("".join(as_symbol(*s) for s in symbols)) == plain_repair(symbols), symbols


@pytest.mark.parametrize("symbols", ["u" * 700, "sa" + "a" * 513, "U" * 90 + "a" * 64 + "x" * 33 + "A" * 100, "su" + "au" * 400])
def test_long_runs(symbols):
    kinds = [("s", "blank") if s == "x" else (s.lower(), "truncated" if s.isupper() else None) for s in symbols]
    cost, audit = turn_repair.repair(symbols)
    assert (cost, audit) == plain_repair(kinds)


def test_powers_equal_repeated_steps():
    after = (0.0, 4.0, 2.0, 0.0)
    for symbol in "suaoSUAOx":
        stepped = after
        for n in range(1, 70):
            stepped = turn_repair.costs_before(symbol, 1, stepped)
            assert turn_repair.costs_before(symbol, n, after) == stepped


def test_table_equals_plain(spark):
    chats = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    assert got(chats) == plain([tuple(r) for r in chats.collect()])


def test_odd_rows(spark):
    rows = [(c, t, r, x) for c in range(40) for t, r, x in [(0, "system", "Be. "), (0, "user", "A?"), (None, None, None), (9, "user", "A?"), (3, "tool", "x\r\n"), (3, "", "B!")]]
    rows += [(None, 1, "user", "Hi."), (None, 2, "assistant", "Yo."), (-5, None, "assistant", ""), (-5, None, "assistant", " ")]
    rows += [(1000 + k, 0, "user", "Gone?") for k in range(60)]
    rows += [(7, 100 + k, "user" if k % 2 else "assistant", "long " * 100_000 + "." * (k % 3)) for k in range(4)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("audit", turn_repair.F.lit("clash"))
    result = got(df.repartition(5))
    assert result == plain(rows)
    assert (0, 0, 0, 0, 0, 0, "", sha256(b"").hexdigest()) in [result[1000 + k] for k in range(60)]


def test_repeated_rows_and_empty_table(spark):
    rows = [(1, 1, "user", "Same."), (1, 1, "user", "Same."), (1, 2, "assistant", "Fine.")] * 2
    assert got(spark.createDataFrame(rows, SCHEMA)) == plain(rows)
    assert got(spark.createDataFrame([], SCHEMA)) == {}


def test_batches_cut_a_conversation(spark):
    rows = [(k % 3, k, ["user", "assistant"][k % 2 if k % 7 else 0], f"Word {k % 11}.") for k in range(900)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        assert got(spark.createDataFrame(rows, SCHEMA)) == plain(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
