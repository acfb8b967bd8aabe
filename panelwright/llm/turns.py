"""Conversation structure repair: the cheapest edits that make a conversation's roles alternate, by A* on the lattice
of rows and grammar states."""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written

#: What an edit costs, and what a truncated row that stays adds.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Faults of a row, 0 for none.
BLANK, DUPLICATE, CUT = 1, 2, 3
#: Grammar of role initials, (s?(ua)+)?: the state after an initial, by state. 0 is empty, 1 after s, 2 after u, 3 after a.
AFTER = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: The role that a changed or an added row has to have, and the state after it, by state.
NEEDED = (("user", 2), ("user", 2), ("assistant", 3), ("user", 2))
#: States in which a conversation may end.
ENDS = (0, 3)


class _Audit:
    """A string of edits as a node of a trie: equal strings are one node, and two are compared in logarithmic time by
    jumps towards the root, so that each costs a small object whatever its length."""

    __slots__ = ("up", "jump", "depth", "letter", "next")

    def __init__(self, up: _Audit | None = None, letter: str = ""):
        self.up, self.letter, self.next = up or self, letter, {}
        self.depth = up.depth + 1 if up else 0
        far = up.jump if up else self
        self.jump = (far.jump if up.depth - far.depth == far.depth - far.jump.depth else up) if up else self

    def then(self, letter: str) -> _Audit:
        found = self.next.get(letter)
        if found is None:
            found = self.next[letter] = _Audit(self, letter)
        return found

    def _at(self, depth: int) -> _Audit:
        node = self
        while node.depth > depth:
            node = node.jump if node.jump.depth >= depth else node.up
        return node

    def __lt__(self, other: _Audit) -> bool:
        a, b = self._at(other.depth), other._at(self.depth)
        if a is b:
            return self.depth < other.depth
        while a.up is not b.up:
            a, b = (a.jump, b.jump) if a.jump is not b.jump else (a.up, b.up)
        return a.letter < b.letter

    def __str__(self) -> str:
        letters, node = [], self
        while node.depth:
            letters.append(node.letter)
            node = node.up
        return "".join(reversed(letters))


def cheapest(initials: Sequence[str], faults: Sequence[int]) -> tuple[int, str]:
    """(cost, audit) of the cheapest edits, and of these the least audit: K keeps a row, R changes its role, D deletes
    it and I adds one.

    A node is the number of rows done and the state of the grammar. What is still to come costs at least DELETE for
    each row that has to go, and for each truncated row the less of its deletion and its charge: both are sums over a
    suffix. The queue is ordered by cost so far plus that, then by audit; no step lowers their sum, and of two audits
    of one cost at a node neither begins the other, so the first that reaches a node is its best.
    """
    n, least = len(initials), {BLANK: DELETE, DUPLICATE: DELETE, CUT: min(DELETE, TRUNCATED)}
    ahead = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        ahead[i] = ahead[i + 1] + least.get(faults[i], 0)
    queue, done = [(ahead[0], _Audit(), 0, 0)], set()
    while True:
        bound, audit, i, state = heapq.heappop(queue)
        if (i, state) in done:
            continue
        if i == n and state in ENDS:
            return bound, str(audit)
        done.add((i, state))
        cost, needed = bound - ahead[i], NEEDED[state][1]
        steps = [("I", INSERT, i, needed)]
        if i < n:
            steps.append(("D", DELETE, i + 1, state))
            if faults[i] not in (BLANK, DUPLICATE):
                charge = TRUNCATED if faults[i] == CUT else 0
                kept = AFTER[state].get(initials[i]) if initials[i] else state
                if kept is not None:
                    steps.append(("K", KEEP + charge, i + 1, kept))
                if kept != needed:
                    steps.append(("R", REROLE + charge, i + 1, needed))
        for letter, price, row, after in steps:
            if (row, after) not in done:
                heapq.heappush(queue, (cost + price + ahead[row], audit.then(letter), row, after))


def damage(conversations: DataFrame) -> DataFrame:
    """conversations with faults, as real logs have them, by crc32 of `conv_id:turn` modulo 20: 0 drops the row (present
    is false), 1 empties its text, 2 takes its `[.!?]` out, 3 repeats it, 4 makes its role user. Nulls count as one
    space there and in role and text; conv_id and turn stay null."""
    shown = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")}
    kind = (F.crc32(F.concat(shown["conv_id"], F.lit(":"), shown["turn"]).cast("binary")) % 20).alias("kind")
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), shown["role"].alias("role"), shown["text"].alias("text"), kind)
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") != 0).alias("present"), F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1))))
    return rows.drop("col")


_PLACED = "conv_id long, place long, step int, turn long, role string, text string, fault int, edits string"


def _placed(conversations: DataFrame) -> DataFrame:
    """_PLACED: for each row of a conversation its text (step 0) and, once the whole conversation was read, its edits
    (step 1): the letters that stand before it, its own, and after the last row those that come at the end. The texts
    pass through; what is held of a conversation until its end is a digest and some small objects a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _PLACED.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.string()]
        out, now, open_ = [], None, False
        initials, faults, seen = [], [], set()

        def ended() -> None:
            if not open_:
                return
            audit = cheapest(initials, faults)[1]
            at, own, letters = 0, [], []
            for letter in audit:
                letters.append(letter)
                if letter != "I":
                    own.append("".join(letters))
                    letters = []
            if letters and own:
                own[-1] += "".join(letters)
            for at, edits in enumerate(own):
                out.append((now, at, 1, None, None, None, None, edits))

        def flushed(least: int) -> Iterator[pa.RecordBatch]:
            while len(out) > least:
                part, out[:5000] = out[:5000], []
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*part), kinds)], names=names)

        for batch in batches:
            for conv_id, turn, role, text, present, fault, same in zip(*(c.to_pylist() for c in batch.columns)):
                if not open_ or conv_id != now:
                    ended()
                    yield from flushed(5000)
                    now, open_ = conv_id, True
                    initials, faults, seen = [], [], set()
                    out.append((now, -1, 0, None, None, None, None, None))  # stands for a conversation that has no rows
                if not present:
                    continue
                if fault != BLANK and same in seen:
                    fault = DUPLICATE
                seen.add(same)
                out.append((now, len(initials), 0, turn, role, text, fault, None))
                initials.append(role[:1])
                faults.append(fault)
                yield from flushed(10_000)
        ended()
        yield from flushed(0)

    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    last = F.substring(F.rtrim("text", F.lit(" \t\n\x0b\x0c\r")), -1, 1)
    fault = F.when(last == "", BLANK).when(~last.isin(".", "!", "?"), CUT).otherwise(0)
    present = F.coalesce(F.col("present"), F.lit(True)) if "present" in conversations.columns else F.lit(True)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), present.alias("present"))
    same = F.unhex(F.sha2(F.concat("role", F.lit("\0"), "text"), 256))
    rows = rows.withColumns({"fault": fault.cast("int"), "same": same})
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    return ordered.mapInArrow(run, _PLACED)


def _in_order(placed: DataFrame) -> DataFrame:
    return placed.repartition("conv_id").sortWithinPartitions("conv_id", "place", "step")


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv_id, turn, role, text, fault, edit, repaired role) of the rows of _in_order, and of added ones; at the
    beginning of each conversation (conv_id, None, ...)."""
    state, held = 0, ()
    for batch in batches:
        for conv_id, place, step, turn, role, text, fault, edits in zip(*(c.to_pylist() for c in batch.columns)):
            if place < 0:
                state = 0
                yield (conv_id, None, None, None, None, None, None)
            elif not step:
                held = (turn, role, text, fault)
            else:
                for edit in edits:
                    if edit == "I":
                        role, state = NEEDED[state]
                        yield (conv_id, None, None, "", None, edit, role)
                        continue
                    turn, role, text, fault = held
                    new = role if edit == "K" else None
                    if edit == "R":
                        new, state = NEEDED[state]
                    elif edit == "K" and role[:1]:
                        state = AFTER[state][role[:1]]
                    yield (conv_id, turn, role, text, fault, edit, new)


_EDITED = "conv_id long, turn long, role string, text string, fault string, edit string, repaired_role string, place long"


def edited(conversations: DataFrame) -> DataFrame:
    """_EDITED: every row of conversations(conv_id, turn, role, text), with its fault (blank, duplicate, truncated or
    null), its edit (K, R, D) and the role that it has in the repaired conversation (null where it is deleted), and the
    rows added (edit I, no turn and role of their own); place is a row's number in its conversation.

    Rows stand by turn, nulls first; those of one turn by role and text. Null roles and texts count as one space, null
    conv_ids are one conversation; rows whose present is false are as if they weren't there; an empty role has no
    initial and may stand anywhere; extra columns are ignored; an empty table gives no rows. A conversation of any
    length is planned in one task, as its edits depend on each other, with some small objects a row and no texts.
    """

    def run(batches):
        names = [x.split()[0] for x in _EDITED.split(", ")]
        kinds = [pa.int64(), pa.int64(), *[pa.string()] * 5, pa.int64()]
        out, place = [], 0
        for conv_id, turn, role, text, fault, edit, new in _walk(batches):
            if edit is None:
                place = 0
                continue
            out.append((conv_id, turn, role, text, (None, "blank", "duplicate", "truncated")[fault or 0], edit, new, place))
            place += 1
            if len(out) >= 5000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    return _in_order(written(_placed(conversations), "placed")).mapInArrow(run, _EDITED)


_REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def report(conversations: DataFrame) -> DataFrame:
    """_REPORT: a row for each conversation. gaps counts turns that are missing between its first and last, illegal its
    neighbouring rows whose role initials are not su, ua or au; cost and audit are those of its cheapest edits, and the
    digest is of the repaired rows as `role:text`, joined by newlines. Texts go through the digest row by row. Odd rows
    count as in edited; a conversation without rows has zeros, no edits and the digest of nothing."""

    def run(batches):
        names = [x.split()[0] for x in _REPORT.split(", ")]
        out, now = [], None

        def closed() -> tuple:
            gaps = now["most"] - now["least"] + 1 - now["turns"] if now["turns"] else 0
            faults, cost = now["faults"], now["cost"]
            return (now["conv_id"], gaps, faults[BLANK], faults[DUPLICATE], faults[CUT], now["illegal"], cost, "".join(now["audit"]), now["digest"].hexdigest())

        for conv_id, turn, role, text, fault, edit, new in _walk(batches):
            if edit is None:
                if now:
                    out.append(closed())
                    if len(out) >= 2000:
                        yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in out], schema=kinds)
                        out = []
                now = {"conv_id": conv_id, "turns": 0, "least": None, "most": None, "faults": [0] * 4, "illegal": 0, "initial": None, "cost": 0, "audit": [], "digest": sha256(), "lines": 0}
                continue
            now["audit"].append(edit)
            if edit != "I":
                if turn is not None and turn != now["most"]:
                    now["turns"] += 1
                    now["most"] = turn
                    now["least"] = turn if now["least"] is None else now["least"]
                now["faults"][fault] += 1
                if now["initial"] is not None:
                    now["illegal"] += now["initial"] + role[:1] not in ("su", "ua", "au")
                now["initial"] = role[:1]
                now["cost"] += TRUNCATED if fault == CUT and edit != "D" else 0
            now["cost"] += {"K": KEEP, "R": REROLE, "D": DELETE, "I": INSERT}[edit]
            if new is not None:
                now["digest"].update(f"{chr(10) if now['lines'] else ''}{new}:{text}".encode())
                now["lines"] += 1
        if now:
            out.append(closed())
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in out], schema=kinds)

    kinds = pa.schema([(x.split()[0], pa.string() if x.endswith("string") else pa.int64()) for x in _REPORT.split(", ")])
    return _in_order(written(_placed(conversations), "placed")).mapInArrow(run, _REPORT)
