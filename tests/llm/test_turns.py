"""Conversation repair against all edits in turn, whole tables and odd conversations."""

import random
import re
import time
import zlib
from functools import lru_cache
from hashlib import sha256
from itertools import groupby

from panelwright.llm.queries import QUERIES
from panelwright.llm.turns import cheapest, damage, edited, report

SPACES = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string, place long, step int, present string, edits string"


def best(initials, faults):
    """(cost, audit) by trying every edit at every row, for each string of initials so far."""

    @lru_cache(None)
    def rest(i, so_far):
        found = [(0, "")] if i == len(initials) and re.fullmatch("(s?(ua)+)?", so_far) else []
        steps = [("I", 5, i, c) for c in "ua"]
        if i < len(initials):
            steps.append(("D", 2, i + 1, ""))
            if faults[i] not in (1, 2):
                charge = 5 * (faults[i] == 3)
                steps += [("K", charge, i + 1, initials[i])] + [("R", 1 + charge, i + 1, c) for c in "ua"]
        for letter, price, row, c in steps:
            text = so_far + c
            if c and not re.fullmatch("s?(ua)*u?", text) or letter == "I" and len(text) > 2 * len(initials) + 2:
                continue
            text = text if len(text) < 2 else ("u" if text[-1] == "u" else "ua")  # all that what follows depends on
            if letter == "I" and so_far == text:
                continue
            if letter == "I" and i in inserted and inserted[i] > 1:
                continue
            inserted[i] = inserted.get(i, 0) + (letter == "I")
            cost, audit = rest(row, text)
            inserted[i] -= letter == "I"
            found.append((price + cost, letter + audit))
        return min(found, default=(10**9, ""))

    inserted = {}
    return rest(0, "")


def by_layers(initials, faults):
    """(cost, audit) by the least of all ways to each node, row by row."""
    after = [{"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}]
    layer = {0: (0, "")}

    def put(into, state, way):
        if state not in into or way < into[state]:
            into[state] = way

    def inserts(into):
        for _ in range(2):
            for state, (cost, audit) in list(into.items()):
                put(into, 3 if state == 2 else 2, (cost + 5, audit + "I"))

    for initial, fault in zip(initials, faults):
        inserts(layer)
        below = {}
        for state, (cost, audit) in layer.items():
            put(below, state, (cost + 2, audit + "D"))
            if fault not in (1, 2):
                charge = 5 * (fault == 3)
                if not initial or initial in after[state]:
                    put(below, after[state][initial] if initial else state, (cost + charge, audit + "K"))
                put(below, 3 if state == 2 else 2, (cost + 1 + charge, audit + "R"))
        layer = below
    inserts(layer)
    return min(layer[s] for s in (0, 3) if s in layer)


def plain(rows):
    """The report of (conv_id, turn, role, text) rows, damaged."""
    shown = lambda x: " " if x is None else str(x)
    out = {}
    key = lambda r: (r[0] is not None, r[0] or 0)
    for _, group in groupby(sorted(rows, key=key), key=key):
        group, left = list(group), []
        for conv_id, turn, role, text in group:
            kind, role, text = zlib.crc32(f"{shown(conv_id)}:{shown(turn)}".encode()) % 20, shown(role), shown(text)
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            role = "user" if kind == 4 else role
            left += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
        left.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        faults, seen = [], set()
        for _, role, text in left:
            end = text.rstrip(SPACES)[-1:]
            faults.append(1 if not end else 2 if (role, text) in seen else 3 if end not in ".!?" else 0)
            seen.add((role, text))
        initials = [r[1][:1] for r in left]
        cost, audit = by_layers(initials, faults)
        lines, state, at = [], 0, 0
        for letter in audit:
            if letter in "IR":
                state = 3 if state == 2 else 2
                role, text = "assistant" if state == 3 else "user", left[at][2] if letter == "R" else ""
            elif letter == "K":
                role, text = left[at][1:]
                state = {"s": 1, "u": 2, "a": 3, "": state}[role[:1]]
            if letter != "D":
                lines.append(f"{role}:{text}")
            at += letter != "I"
        turns = {r[0] for r in left} - {None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        out[group[0][0]] = (gaps, faults.count(1), faults.count(2), faults.count(3), illegal, cost, audit, sha256("\n".join(lines).encode()).hexdigest())
    return out


def test_query_equals_the_plain_way(spark, sf):
    for folder in (sf, sf.replace("0.001", "0.01")):
        rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
        got = QUERIES["op13_turns"](spark, folder).collect()
        assert {r.conv_id: tuple(r)[1:] for r in got} == plain(rows) and len(got) == len(plain(rows))


def test_cheapest_edits_are_the_least_of_all():
    draw = random.Random(7)
    for k in range(3000):
        n = draw.randint(0, 4 if k < 400 else 14)
        initials, faults = [draw.choice("suuaaax") if draw.random() < 0.97 else "" for _ in range(n)], [draw.choice([0, 0, 0, 1, 2, 3]) for _ in range(n)]
        got = cheapest(initials, faults)
        assert got == by_layers(initials, faults), (initials, faults)
        if k < 400:
            assert got == best(tuple(initials), tuple(faults)), (initials, faults)


def test_long_conversations_take_little_more_than_their_length():
    draw = random.Random(3)
    for initials, faults in (
        (["u", "a"] * 50_000, [0] * 100_000),
        ([draw.choice("uuaas") for _ in range(60_000)], [draw.choice([0, 0, 0, 0, 1, 2, 3]) for _ in range(60_000)]),
        (["u"] * 60_000, [0] * 60_000),
    ):
        start = time.perf_counter()
        cost, audit = cheapest(initials, faults)
        assert time.perf_counter() - start < 60 and len(audit.replace("I", "")) == len(initials)


def test_odd_conversations(spark):
    rows = [(1, 2, "user", "b."), (1, None, "system", "a."), (1, 2, "assistant", "c."), (2, 1, None, None), (None, None, None, None), (None, 3, "user", "x."), (3, 5, "", "y."), (3, 9, "User", "z"), (4, 1, "user", ""), (4, 1, "user", " \t"), (6, 1, "user", "a" * 200_000)]
    rows += [(5, t, "assistant" if t % 2 else "user", f"turn {t}?") for t in range(300)] + [(5, 7, "assistant", "turn 7?")] + [(8, t, r, "same.") for t in range(3) for r in ("user", "assistant")]
    conversations = spark.createDataFrame([r + (0, 1, "x", "y") for r in rows], SCHEMA).drop("present")
    assert {r.conv_id: tuple(r)[1:] for r in report(damage(conversations)).collect()} == plain(rows)
    nothing = spark.createDataFrame([], SCHEMA).drop("present")
    assert report(damage(nothing)).collect() == [] and edited(nothing).collect() == []


def test_edited_rows_are_the_repair(spark):
    rows = [(1, 0, "system", "s."), (1, 1, "assistant", "one."), (1, 2, "assistant", "two."), (1, 3, "assistant", "two."), (1, 4, "user", "cut off"), (1, 5, "user", "")]
    found = sorted(edited(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect(), key=lambda r: r.place)
    assert [(r.edit, r.fault, r.repaired_role) for r in found] == [("K", None, "system"), ("R", None, "user"), ("K", None, "assistant"), ("D", "duplicate", None), ("D", "truncated", None), ("D", "blank", None)]
    assert [r.place for r in found] == list(range(6)) and [r.text for r in found[:2]] == ["s.", "one."]
