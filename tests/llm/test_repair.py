"""Conversation repair against a plain recursion, with conversations cut into many pieces, and on edges."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict
from functools import cache

import numpy as np
import pytest

from fanout.llm import queries, repair

GRAMMAR = re.compile(r"(s?(ua)+)?")


def first(v):
    return (v is not None, v if v is not None else 0)


def faults(rows):
    """(blank, duplicate, truncated) of rows (role, text) in order."""
    seen, out = set(), []
    for role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        blank, again = bare == "", (role, text) in seen
        seen.add((role, text))
        out.append((blank, not blank and again, not blank and not again and bare[-1] not in ".!?"))
    return out


def cheapest(rows):
    """Least (cost, audit, repaired lines) by plain recursion over rows and states."""
    marks = faults(rows)

    @cache
    def best(i, state, put):
        options = [(0, "", ())] if i == len(rows) and state in ("", "a") else []

        def add(cost, letter, line, then):
            if then is not None:
                options.append((cost + then[0], letter + then[1], line + then[2]))

        spoken = ("assistant" if state == "u" else "user")
        if put < 3:
            add(3, "I", (f"{spoken}:",), best(i, spoken[0], put + 1))
        if i < len(rows):
            (role, text), (blank, again, cut) = rows[i], marks[i]
            add(4, "D", (), best(i + 1, state, 0))
            if not (blank or again):
                if role[:1] == "s" and state == "" or role[:1] == "u" and state != "u" or role[:1] == "a" and state == "u":
                    add(3 * cut, "K", (f"{role}:{text}",), best(i + 1, role[0], 0))
                add(3 + 3 * cut, "R", (f"{spoken}:{text}",), best(i + 1, spoken[0], 0))
        return min(options, key=lambda o: o[:2], default=None)

    return best(0, "", 0)


def report(rows):
    """All result columns for rows (turn, role, text) of a conversation."""
    rows = sorted(rows, key=lambda r: (first(r[0]), r[1], r[2]))
    turns = [t for t, _, _ in rows if t is not None]
    said = [r[1:] for r in rows]
    marks = faults(said)
    pairs = [(a[0][:1] + b[0][:1]) for a, b in itertools.pairwise(said)]
    cost, audit, lines = cheapest(tuple(said))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    counts = [sum(m[k] for m in marks) for k in range(3)]
    illegal = sum(p not in ("su", "ua", "au") for p in pairs)
    return (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def found(rows):
    got = repair.repair(rows)
    hashes = {r.conv: r.sha256 for r in repair.digests(got.messages).collect()}
    columns = ["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    none = hashlib.sha256(b"").hexdigest()
    return {r.conv: (*r[1:], hashes.get(r.conv, none)) for r in got.conversations.select(*columns).collect()}


def wanted(rows):
    groups = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        groups["0" if conv is None else f"1{conv}"].append((turn, " " if role is None else role, " " if text is None else text))
    return {conv: report(g) for conv, g in groups.items()}


def table(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def made(rnd, n):
    texts = ["Well.", "Yes!", "No?", "cut off", "", " \n", "Trailing. \t", "Ünd.", "ja", "x" * 300 + "."]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", "s", "universe", None]
    return [
        (rnd.choice([i, i, i, i + 1, None, -i]), rnd.choice(roles), rnd.choice([*texts, f"Said {rnd.random()}."] + [f"t{i}."] * 9))
        for i in range(n)
    ]


@pytest.mark.parametrize("bits", [1, 2, 12])
def test_against_recursion(spark, monkeypatch, bits):
    monkeypatch.setattr(repair, "PIECE_BITS", bits)
    rnd = random.Random(bits)
    sizes = [1, 2, 3, 4, 5, 6, 7, 8] * 6 + [40, 60, 90]
    rows = [(c, *r) for c, n in enumerate(sizes) for r in made(rnd, n)]
    rnd.shuffle(rows)
    got, want = found(table(spark, rows)), wanted(rows)
    assert got == want
    assert len({r[-2] for r in want.values()}) > 20


def test_every_short_conversation():
    """All sequences of up to four codes: the audits' costs and letters, whole and cut in two."""
    for n in range(1, 5):
        for codes in map("".join, itertools.product("suaoU1", repeat=n)):
            rows = []
            for k, c in enumerate(codes):
                role = {"s": "s", "u": "u", "a": "a", "o": "t", "U": "u", "1": "u"}[c]
                rows.append((role, "" if c == "U" else f"{k}" if c == "1" else f"{k}."))
            cost, audit, lines = cheapest(tuple(rows))
            assert GRAMMAR.fullmatch("".join(x[0] for x in lines))
            table = np.array(repair.costs_to_end(codes, repair.ACCEPTED, True))
            paths = repair.least_paths(codes + repair.LAST, table)
            assert (int(table[0][0]), paths.audits(np.array([0]))) == (cost, [audit])
            assert repair.audit_cost(codes, audit) == cost
            if n > 1:
                left, right = codes[: n // 2], codes[n // 2 :]
                beyond = repair.costs_to_end(right, repair.ACCEPTED, True)
                start = repair.least_paths(left + repair.MORE, np.array(repair.costs_to_end(left, beyond[0], False)))
                state = int(start.ends(np.array([0]))[0])
                rest = repair.least_paths(right + repair.LAST, np.array(beyond)).audits(np.array([state]))
                assert start.audits(np.array([0]))[0] + rest[0] == audit


def test_a_long_conversation_in_pieces(spark):
    rnd = random.Random(1)
    rows = [(7, i, rnd.choice(["user", "assistant"]), rnd.choice([f"m{i}.", f"m{i}", ""])) for i in range(9000)]
    got = repair.repair(table(spark, rows))
    r = got.conversations.first()
    said = [x[2:] for x in rows]
    codes = "".join(c[0].upper() if b or d else str("sua".index(c[0])) if t else c[0] for (c, _), (b, d, t) in zip(said, faults(said)))
    costs = np.array(repair.costs_to_end(codes, repair.ACCEPTED, True))
    assert (r.cost, r.audit) == (costs[0][0], repair.least_paths(codes + ".", costs).audits(np.array([0]))[0])
    messages = got.messages.orderBy("place").collect()
    assert GRAMMAR.fullmatch("".join(m.role[0] for m in messages)) and len(messages) == sum(x != "D" for x in r.audit)


def test_edges(spark):
    rows = [
        (None, None, None, None),
        (None, 2, "user", "Hello."),
        (None, 2, "user", "Hello."),
        (1, None, "user", "a."),
        (1, None, "assistant", "b."),
        (2, 5, "user", "y" * 200_000),
        (2, 5, "user", "y" * 200_000 + "!"),
        (3, 0, "", ""),
        (4, -3, "system", "S."),
    ]
    assert found(table(spark, rows)) == wanted(rows)
    clashing = table(spark, rows)
    for c in ("conv", "row", "piece", "codes", "start", "place", "audit", "last", "text2"):
        clashing = clashing.selectExpr("*", f"'clash' as {c}")
    assert found(clashing) == wanted(rows)
    assert found(table(spark, [])) == {}


def test_query(spark, data):
    original = [tuple(r) for r in spark.read.parquet(f"{data}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    harmed = []
    for conv, turn, role, text in original:
        harm = zlib.crc32(f"{conv}:{turn}".encode()) % 20
        text = "" if harm == 1 else re.sub("[.!?]", "", text) if harm == 2 else text
        harmed += [(conv, turn, "user" if harm == 4 else role, text)] * (0 if harm == 0 else 2 if harm == 3 else 1)
    want = wanted(harmed)
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    got = {r[0]: tuple(r)[1:] for r in queries.op11_conversation_repair(spark, data).collect()}
    assert got == {c: want.get(f"1{c}", nothing) for c in {o[0] for o in original}}
