"""Repair of the structure of conversations by lightest derivations.

A conversation is well formed if its roles are an optional system turn and then pairs of a user's and
an assistant's turn, or nothing. Rows are kept, given another role, deleted, and empty turns
inserted; each edit has a price. The cheapest repair is the lightest derivation of a goal item in a
weighted hypergraph: items say that the first rows are done and which role came last, an edit of a
row is an axiom, and a deduction takes one item of each kind. The value of an item is its cost and the
edits so far; deductions add the one and append to the other, which never makes a value smaller, so
Knuth's agenda finalises items in the order of their values and the first goal value is the least.

Two streams over rows sorted by conversation do it: the first has a few bytes for each row and gives
faults and edits, the second carries the texts past the edits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bandrisk.sources.store import Scratch

SPACE = " \t\n\x0b\x0c\r"
STOPS = ".!?"
ROLES = {"u": "user", "a": "assistant"}
KEEP, REROLE, DELETE, INSERT = "KRDI"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 3, 4, 3, 3
LEGAL = frozenset(("su", "ua", "au"))
# Which role came last, and the roles that may follow.
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
_NEXT = {
    (_START, "s"): _SYSTEM,
    (_START, "u"): _USER,
    (_SYSTEM, "u"): _USER,
    (_USER, "a"): _ASSISTANT,
    (_ASSISTANT, "u"): _USER,
}
_AFTER = [[(role, after) for (state, role), after in _NEXT.items() if state == before] for before in range(4)]
_COMPLETE = (_START, _ASSISTANT)
ROWS_IN_BATCH = 8192


class Edits:
    """A string of edits that shares all but its last letter with others; equal strings are one object.

    ``jump`` leads to an earlier string, the same number of letters back for all strings of a length,
    so two strings are compared in logarithmic time.
    """

    __slots__ = ("before", "letter", "length", "jump", "longer")

    def __init__(self, before: Edits | None = None, letter: str = ""):
        self.before, self.letter, self.longer = before or self, letter, {}
        if before is None:
            self.length, self.jump = 0, self
        else:
            self.length = before.length + 1
            far = before.jump
            even = before.length - far.length == far.length - far.jump.length
            self.jump = far.jump if even else before

    def add(self, letter: str) -> Edits:
        longer = self.longer.get(letter)
        if longer is None:
            longer = self.longer[letter] = Edits(self, letter)
        return longer

    def cut(self, length: int) -> Edits:
        """The first ``length`` letters."""
        at = self
        while at.length > length:
            at = at.jump if at.jump.length >= length else at.before
        return at

    def __lt__(self, other: Edits) -> bool:
        if self is other:
            return False
        length = min(self.length, other.length)
        a, b = self.cut(length), other.cut(length)
        if a is b:
            return self.length < other.length
        while a.before is not b.before:
            if a.jump is not b.jump:
                a, b = a.jump, b.jump
            else:
                a, b = a.before, b.before
        return a.letter < b.letter

    def __str__(self) -> str:
        letters, at = [], self
        while at.length:
            letters.append(at.letter)
            at = at.before
        return "".join(reversed(letters))


@dataclass
class Row:
    """What a repair needs to know of a row."""

    initial: str
    lost: bool  # must be deleted
    truncated: bool


def axioms(row: Row) -> Iterator[tuple[str, str, int]]:
    """Edits of a row: letter, role that comes out (none for a deleted one) and cost."""
    yield DELETE, "", DELETE_COST
    if not row.lost:
        more = TRUNCATED_COST if row.truncated else 0
        if row.initial in ("s", "u", "a"):
            yield KEEP, row.initial, more
        for role in ROLES:
            yield REROLE, role, REROLE_COST + more


def lightest(rows: list[Row]) -> tuple[int, str]:
    """Cost and letters of the cheapest repair; of equal costs the letters that sort first.

    Values are compared by cost, then letters. Appending keeps that order: the letters of two values
    of one item are of the same rows, and one that goes on from the other has dearer inserts in it.
    """
    count = len(rows)
    goal = 4 * (count + 1)
    nothing = Edits()
    first_axiom = goal + 1
    axiom_of: list[tuple[int, str, str]] = []
    agenda: list[tuple[int, Edits, int]] = [(0, nothing, 0)]
    for place, row in enumerate(rows):
        for letter, role, cost in axioms(row):
            heappush(agenda, (cost, nothing.add(letter), first_axiom + len(axiom_of)))
            axiom_of.append((place, letter, role))
    # Inserts are axioms that hold at every place.
    anywhere = first_axiom + len(axiom_of)
    for role in ROLES:
        heappush(agenda, (INSERT_COST, nothing.add(INSERT), anywhere + len(axiom_of)))
        axiom_of.append((-1, INSERT, role))
    inserts_from = anywhere - first_axiom
    done: dict[int, tuple[int, Edits]] = {}
    best: dict[int, int] = {}
    states: list[list[int]] = [[] for _ in range(count + 1)]  # finalised, by place
    edits: list[list[tuple[str, str, int]]] = [[] for _ in range(count)]  # finalised axioms, by place
    inserts: list[tuple[str, str, int]] = []

    def deduce(cost: int, letters: Edits, place: int, state: int, edit: tuple[str, str, int]) -> None:
        letter, role, price = edit
        after = state if not role else _NEXT.get((state, role))
        if after is None:
            return
        item = 4 * (place + (letter != INSERT)) + after
        if item not in done and cost + price <= best.get(item, cost + price):
            best[item] = cost + price
            heappush(agenda, (cost + price, letters.add(letter), item))

    while agenda:
        cost, letters, item = heappop(agenda)
        if item in done:
            continue
        done[item] = cost, letters
        if item == goal:
            return cost, str(letters)
        if item < goal:
            place, state = divmod(item, 4)
            states[place].append(state)
            for edit in (*(edits[place] if place < count else ()), *inserts):
                deduce(cost, letters, place, state, edit)
            if place == count and state in _COMPLETE:
                heappush(agenda, (cost, letters, goal))
            continue
        number = item - first_axiom if item < anywhere else item - anywhere
        place, letter, role = axiom_of[number]
        if number >= inserts_from:
            inserts.append((letter, role, cost))
            places = range(count + 1)
        else:
            edits[place].append((letter, role, cost))
            places = (place,)
        for at in places:
            for state in list(states[at]):
                from_cost, from_letters = done[4 * at + state]
                deduce(from_cost, from_letters, at, state, (letter, role, cost))
    raise AssertionError("deleting everything is always a repair")


@dataclass
class Conversation:
    """One conversation as its rows pass by in order."""

    name: int | None
    rows: list[Row] = field(default_factory=list)
    seen: set[bytes] = field(default_factory=set)
    low: int | None = None
    high: int | None = None
    turns: int = 0
    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0

    def add(self, turn: int | None, initial: str, blank: bool, truncated: bool, mark: bytes) -> None:
        if turn is not None:
            if self.low is None:
                self.low = turn
            self.turns += turn != self.high
            self.high = turn
        again = mark in self.seen
        self.seen.add(mark)
        self.blank += blank
        self.duplicate += again and not blank
        cut = truncated and not blank and not again
        self.truncated += cut
        if self.rows:
            self.illegal += self.rows[-1].initial + initial not in LEGAL
        self.rows.append(Row(initial, blank or again, cut))

    def found(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return self.name, gaps, self.blank, self.duplicate, self.truncated, self.illegal, *lightest(self.rows)


REPAIR = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"


def _batches(rows: Iterable[tuple], names: list[str], types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []

    def batch() -> pa.RecordBatch:
        return pa.record_batch([pa.array(v, t) for v, t in zip(zip(*held), types)], names=names)

    for row in rows:
        held.append(row)
        if len(held) == ROWS_IN_BATCH:
            yield batch()
            held = []
    if held:
        yield batch()


def _tuples(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(column.to_pylist() for column in batch.columns))


def _diagnose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Faults and edits of conversations whose rows come one after the other."""

    def found():
        conversation = None
        for name, there, turn, _, initial, blank, truncated, mark in _tuples(batches):
            if conversation is None or name != conversation.name:
                if conversation is not None:
                    yield conversation.found()
                conversation = Conversation(name)
            if there:
                conversation.add(turn, initial, blank, truncated, mark)
        if conversation is not None:
            yield conversation.found()

    names = ["conv_id", *(column.split()[0] for column in REPAIR.split(", "))]
    yield from _batches(found(), names, [*[pa.int64()] * 7, pa.string()])


class Replay:
    """The rows that a string of edits makes of a conversation's rows, as those pass by."""

    def __init__(self, letters: str):
        self.letters, self.at, self.made, self.system = letters, 0, 0, 0

    def _role(self) -> str:
        return ROLES["ua"[(self.made - self.system) % 2]]

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        """Empty turns before the next row, or at the end."""
        while self.at < len(self.letters) and self.letters[self.at] == INSERT:
            yield INSERT, self._role(), ""
            self.at += 1
            self.made += 1

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        yield from self.inserted()
        letter = self.letters[self.at]
        self.at += 1
        if letter == DELETE:
            return
        if letter == KEEP and not self.made and role[:1] == "s":
            self.system = 1
        yield letter, role if letter == KEEP else self._role(), text
        self.made += 1


def _replayed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """``(conversation, None)`` at its start, then its repaired rows as ``(conversation, (edit, role, text))``.

    The row with a conversation's edits comes before its texts.
    """
    name, replay = None, None
    for conv, _, _, _, _, audit, role, text in _tuples(batches):
        if audit is not None:
            if replay is not None:
                yield from ((name, row) for row in replay.inserted())
            name, replay = conv, Replay(audit)
            yield name, None
        else:
            yield from ((name, row) for row in replay.row(role, text))
    if replay is not None:
        yield from ((name, row) for row in replay.inserted())


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        position = 0
        for name, row in _replayed(batches):
            if row is None:
                position = 0
            else:
                yield name, position, *row
                position += 1

    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
    yield from _batches(rows(), ["conv_id", "position", "edit", "role", "text"], types)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        name, state, position = None, None, 0
        for conv, row in _replayed(batches):
            if row is None:
                if state is not None:
                    yield name, state.hexdigest()
                name, state, position = conv, hashlib.sha256(), 0
            else:
                state.update(f"{chr(10) if position else ''}{row[1]}:{row[2]}".encode())
                position += 1
        if state is not None:
            yield name, state.hexdigest()

    yield from _batches(rows(), ["conv_id", "repaired_sha256"], [pa.int64(), pa.string()])


def _mark(role: Column, text: Column) -> Column:
    """16 bytes that tell rows with other roles or texts apart."""
    marked = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return F.substring(F.unhex(F.sha2(marked.cast("binary"), 256)), 1, 16)


_ORDER = ("conv_id", "there", "turn", "role", "mark")


def _prepared(conversations: DataFrame) -> DataFrame:
    blank = F.lit(" ")
    rows = conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        F.coalesce("role", blank).alias("role"),
        F.coalesce("text", blank).alias("text"),
    )
    return rows.withColumn("mark", _mark(F.col("role"), F.col("text")))


def diagnose(conversations: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit`` of every conversation.

    ``conversations(conv_id, turn, role, text)`` are taken by turn, NULL turns first, equal ones by role
    and a hash of role and text. A NULL role or text counts as one space; rows with a NULL id are a
    conversation of their own. ``ids(conv_id)`` names conversations to report even without rows: those
    have zeros and no edits. No rows at all give no rows. Other columns are left out.

    A row's fault is the first of: blank (nothing but white space), duplicate (role and text of an
    earlier row), truncated (its last character but white space is none of ``.!?``). ``gaps`` counts
    missing turn numbers, ``illegal`` neighbours whose role initials are not su, ua or au. ``audit`` are
    the edits: K keep, R another role, D delete, I insert. Texts are not shuffled; a task keeps some
    kilobytes for each row of the one conversation it is at.
    """
    rows = _prepared(conversations)
    ended = F.rtrim(F.col("text"), F.lit(SPACE))
    light = rows.select(
        "conv_id",
        F.lit(1).alias("there"),
        "turn",
        "role",
        F.substring("role", 1, 1).alias("initial"),
        (ended == "").alias("blank"),
        (~F.substring(ended, -1, 1).isin(*STOPS)).alias("truncated"),
        "mark",
    )
    if ids is not None:
        named = ids.select(F.col("conv_id").cast("bigint").alias("conv_id")).distinct().withColumn("there", F.lit(0))
        light = light.unionByName(named, allowMissingColumns=True)
    dealt = light.repartition("conv_id").sortWithinPartitions(*_ORDER)
    return dealt.mapInArrow(_diagnose, f"conv_id bigint, {REPAIR}")


def _replay(conversations: DataFrame, found: DataFrame, function, schema: str) -> DataFrame:
    rows = _prepared(conversations).select(
        "conv_id", F.lit(1).alias("there"), "turn", "role", "mark", F.lit(None).cast("string").alias("audit"),
        F.col("role").alias("_role"), "text",
    )
    edits = found.select("conv_id", F.lit(0).alias("there"), "audit")
    stream = rows.unionByName(edits, allowMissingColumns=True).repartition("conv_id").sortWithinPartitions(*_ORDER)
    return stream.mapInArrow(function, schema)


def repaired_rows(conversations: DataFrame, found: DataFrame) -> DataFrame:
    """``conv_id, position, edit, role, text`` of the conversations after the edits that ``diagnose`` found."""
    return _replay(
        conversations, found, _repaired, "conv_id bigint, position bigint, edit string, role string, text string"
    )


def repaired_digests(conversations: DataFrame, found: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256``: a hash of ``role:text`` of the repaired rows, joined by line breaks."""
    return _replay(conversations, found, _hashed, "conv_id bigint, repaired_sha256 string")


def repair(conversations: DataFrame, scratch: Scratch, ids: DataFrame | None = None) -> DataFrame:
    """The rows of ``diagnose`` with ``repaired_sha256``."""
    found = scratch.keep(diagnose(conversations, ids))
    marks = repaired_digests(conversations, found).withColumnRenamed("conv_id", "_conv_id")
    return found.join(marks, F.col("conv_id").eqNullSafe(F.col("_conv_id"))).drop("_conv_id")
