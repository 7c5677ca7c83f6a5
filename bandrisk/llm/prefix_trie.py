"""A trie of conversations by their turns, built of adaptive radix trees.

A turn becomes an id of fixed width: 16 bytes of a hash of role and text, and the text's length in
bytes as a big-endian number. A conversation's key is the ids of its turns, one after the other.
Keys are dealt to tasks by range, so every task holds a contiguous piece of the order of all keys,
however many conversations share a beginning: ties are cut by conversation. Each task builds an
adaptive radix tree over its keys, whose nodes grow from 4 to 16, 48 and 256 children and keep
one-way stretches as compressed paths; only byte depths that are a whole number of turns become
nodes of the trie.

What a task finds is final but for the nodes on its outermost two paths, which neighbours may share.
Those are summed up over tasks, and what two neighbours counted twice, which their two adjacent keys
tell, is taken off.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bandrisk.sources.store import Scratch

HASH_BYTES = 16
SIZE_BYTES = 4
WIDTH = HASH_BYTES + SIZE_BYTES
# Bytes of keys in a task's tree.
TASK_BYTES = 8 << 20
# Conversation ids written into one row of a list of ends.
ENDS_IN_ROW = 4096
ROWS_IN_BATCH = 8192
ROOT = bytes(HASH_BYTES)

FOUND = (
    "kind int, part int, node binary, parent binary, parent_conv_id bigint, turn binary, depth bigint, conv_id bigint, "
    "n_convs bigint, n_children bigint, n_leaves bigint, gross bigint, own bigint, shared boolean, ends string, "
    "first binary, last binary"
)
_NODE, _BOUNDS, _ENDS = 0, 1, 2


def turn_id(role: Column, text: Column) -> Column:
    """The id of a turn: equal for turns with the same role and text; NULL counts as empty."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    mark = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    size = F.lpad(F.hex(F.octet_length(text)), 2 * SIZE_BYTES, "0")
    return F.unhex(F.concat(F.substring(mark, 1, 2 * HASH_BYTES), size))


def conversation_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, turns``: the turn ids of every conversation of ``(conv_id, turn, role, text)`` in order.

    Turns without a number come first, equal numbers are ordered by turn id, and a repeated row is a
    repeated turn. Rows without a conversation id belong to none and are left out. Only ids are
    shuffled, and a conversation becomes one row of them.
    """
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.struct("turn", turn_id(F.col("role"), F.col("text")).alias("id")).alias("at"),
    )
    # Within a struct a NULL sorts first.
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("at")).getField("id").alias("turns"))


class _Sorted:
    """Up to 4 or 16 children beside their sorted bytes."""

    __slots__ = ("room", "keys", "children")

    def __init__(self, room: int = 4):
        self.room, self.keys, self.children = room, bytearray(), []

    def get(self, byte: int):
        at = self.keys.find(byte)
        return None if at < 0 else self.children[at]

    def add(self, byte: int, child: Node):
        if len(self.keys) == self.room:
            larger = _Sorted(16) if self.room == 4 else _Indexed()
            for old, node in self.items():
                larger.add(old, node)
            return larger.add(byte, child)
        at = bisect_left(self.keys, byte)
        self.keys.insert(at, byte)
        self.children.insert(at, child)
        return self

    def items(self) -> Iterator[tuple[int, Node]]:
        return zip(self.keys, self.children)


class _Indexed:
    """Up to 48 children, found by a byte of position for each possible byte."""

    __slots__ = ("slots", "children")

    def __init__(self):
        self.slots, self.children = bytearray(256), []

    def get(self, byte: int):
        slot = self.slots[byte]
        return self.children[slot - 1] if slot else None

    def add(self, byte: int, child: Node):
        if len(self.children) == 48:
            larger = _Direct()
            for old, node in self.items():
                larger.add(old, node)
            return larger.add(byte, child)
        self.children.append(child)
        self.slots[byte] = len(self.children)
        return self

    def items(self) -> Iterator[tuple[int, Node]]:
        return ((byte, self.children[slot - 1]) for byte, slot in enumerate(self.slots) if slot)


class _Direct:
    """A place for each of the 256 bytes."""

    __slots__ = ("children",)

    def __init__(self):
        self.children = [None] * 256

    def get(self, byte: int):
        return self.children[byte]

    def add(self, byte: int, child: Node):
        self.children[byte] = child
        return self

    def items(self) -> Iterator[tuple[int, Node]]:
        return ((byte, child) for byte, child in enumerate(self.children) if child is not None)


class Node:
    """A compressed path, the children after it by their next byte, what ends there, and the least id below."""

    __slots__ = ("path", "layout", "ends", "least")

    def __init__(self, path: bytes, layout=None, ends: list[int] | None = None, least: int | None = None):
        self.path, self.layout, self.ends, self.least = path, layout, ends or [], least


def _shared(a: bytes, b: bytes) -> int:
    """Length of the common beginning."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


class RadixTree:
    """An adaptive radix tree from keys to the ids that end at them."""

    def __init__(self):
        self.root = Node(b"", _Sorted())

    def insert(self, key: bytes, name: int) -> None:
        node, at = self.root, 0
        while True:
            path = node.path
            same = _shared(path, key[at : at + len(path)])
            if same < len(path):
                # The path parts within: what follows goes one node down.
                below = Node(path[same + 1 :], node.layout, node.ends, node.least)
                node.layout, node.path, node.ends = _Sorted().add(path[same], below), path[:same], []
            if node.least is None or name < node.least:
                node.least = name
            at += same
            if at == len(key):
                node.ends.append(name)
                return
            child = node.layout.get(key[at]) if node.layout else None
            if child is None:
                node.layout = (node.layout or _Sorted()).add(key[at], Node(key[at + 1 :], ends=[name], least=name))
                return
            node, at = child, at + 1


def _step(node: bytes, turn: bytes) -> bytes:
    """The name of the trie node that ``turn`` leads to."""
    return hashlib.sha256(node + turn).digest()[:HASH_BYTES]


def path_names(key: bytes) -> list[bytes]:
    """Names of the trie nodes along a key, the root's first."""
    names = [ROOT]
    for at in range(0, len(key), WIDTH):
        names.append(_step(names[-1], key[at : at + WIDTH]))
    return names


def _size(turn: bytes) -> int:
    return int.from_bytes(turn[HASH_BYTES:], "big")


class _Visit:
    """One radix node while its subtree is walked: the turns that end on its path, and sums so far."""

    __slots__ = ("node", "above", "depth", "turns", "rest", "children", "n", "kids", "leaves", "gross", "own")

    def __init__(self, node: Node, above: tuple[bytes, int], depth: int, pending: bytes):
        data = pending + node.path
        whole = len(data) // WIDTH
        self.node, self.above, self.depth, self.turns = node, above, depth, []
        above = above[0]
        for at in range(0, whole * WIDTH, WIDTH):
            turn = data[at : at + WIDTH]
            above = _step(above, turn)
            self.turns.append((above, turn))
        self.rest = data[whole * WIDTH :]
        self.children = iter(node.layout.items()) if node.layout else iter(())
        self.n = len(node.ends)
        self.kids = self.leaves = self.gross = self.own = 0

    def bottom(self) -> tuple[bytes, int]:
        """The last trie node so far and its smallest member."""
        return (self.turns[-1][0], self.node.least) if self.turns else self.above

    def add(self, other: _Visit) -> None:
        self.n += other.n
        self.kids += other.kids
        self.leaves += other.leaves
        self.gross += other.gross
        self.own += other.own


def walk(tree: RadixTree) -> Iterator[tuple]:
    """Trie nodes, children before parents: the columns of ``FOUND`` from node to own, and the ids that end there.

    ``parent_conv_id`` is the smallest member of the parent within this tree.
    """
    stack = [_Visit(tree.root, (ROOT, tree.root.least), 0, b"")]
    while stack:
        visit = stack[-1]
        step = next(visit.children, None)
        if step is not None:
            byte, child = step
            depth = visit.depth + len(visit.turns)
            stack.append(_Visit(child, visit.bottom(), depth, visit.rest + bytes((byte,))))
            continue
        stack.pop()
        ends = visit.node.ends
        for at in reversed(range(len(visit.turns))):
            name, turn = visit.turns[at]
            parent = (visit.turns[at - 1][0], visit.node.least) if at else visit.above
            if not visit.kids:
                visit.leaves = 1
            visit.gross += visit.n * _size(turn)
            visit.own += _size(turn)
            yield (
                name, *parent, turn, visit.depth + at + 1, visit.node.least, visit.n, visit.kids,
                visit.leaves, visit.gross, visit.own, ends,
            )
            ends, visit.kids = [], 1
        if stack:
            stack[-1].add(visit)
        elif visit.n:
            leaves = visit.leaves if visit.kids else 1
            yield ROOT, None, None, None, 0, visit.node.least, visit.n, visit.kids, leaves, visit.gross, visit.own, ends


def _joined(ids: list[int]) -> str:
    return ",".join(map(str, ids))


def _rows(tree: RadixTree, first: bytes, last: bytes, part: int) -> Iterator[tuple]:
    outer = {*path_names(first), *path_names(last)}
    for name, parent, parent_least, *values, ends in walk(tree):
        shared = name in outer
        ends = sorted(ends)
        mark = None if shared else hashlib.sha256(_joined(ends).encode()).hexdigest()
        known = None if parent in outer else parent_least
        yield _NODE, part, name, parent, known, *values, shared, mark, None, None
        if shared:
            for at in range(0, len(ends), ENDS_IN_ROW):
                few = ends[at : at + ENDS_IN_ROW]
                yield _ENDS, part, name, *(None,) * 4, few[0], *(None,) * 5, True, _joined(few), None, None
    yield _BOUNDS, part, *(None,) * 13, first, last


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == ROWS_IN_BATCH:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([pa.array(v, f.type) for v, f in zip(zip(*rows), schema)], schema=schema)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {
        "int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_(),
    }
    return pa.schema([(name, kinds[kind]) for name, kind in (column.split() for column in ddl.split(", "))])


def _grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The trie nodes of one task's keys."""
    from pyspark import TaskContext

    tree, first, last = RadixTree(), None, None
    for batch in batches:
        for key, name in zip(batch.column("key").to_pylist(), batch.column("conv_id").to_pylist()):
            first = key if first is None else min(first, key)
            last = key if last is None else max(last, key)
            tree.insert(key, name)
    if first is not None:
        yield from _batches(_rows(tree, first, last, TaskContext.get().partitionId()), _arrow(FOUND))


OVERLAP = "node binary, n_children bigint, n_leaves bigint, own bigint"


def overlap(last: bytes, first: bytes) -> Iterator[tuple]:
    """What two neighbours that end and begin with these keys count twice, by trie node, as numbers to add."""
    depth = _shared(last, first) // WIDTH
    names = path_names(last)
    # A key that the next one extends or repeats is no leaf of its own.
    leaf = -1 if depth == len(names) - 1 else 0
    own = 0
    for at in reversed(range(len(names) if leaf else depth + 1)):
        if 0 < at <= depth:
            own += _size(last[(at - 1) * WIDTH : at * WIDTH])
        yield names[at], -1 if at < depth else 0, leaf, -own


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pairs = (pair for batch in batches for pair in zip(batch.column("last").to_pylist(), batch.column("next").to_pylist()))
    yield from _batches((row for pair in pairs for row in overlap(*pair)), _arrow(OVERLAP))


def _hash_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One hash for each node whose lists of ends come one after the other; lists are not kept."""

    def marks():
        name, state = None, None
        for batch in batches:
            for node, ends in zip(batch.column("node").to_pylist(), batch.column("ends").to_pylist()):
                if node == name:
                    state.update(b",")
                else:
                    if state is not None:
                        yield name, state.hexdigest()
                    name, state = node, hashlib.sha256()
                state.update(ends.encode())
        if state is not None:
            yield name, state.hexdigest()

    yield from _batches(marks(), _arrow("node binary, ends string"))


def prefix_trie(conversations: DataFrame, scratch: Scratch, task_bytes: int = TASK_BYTES) -> DataFrame:
    """Every distinct beginning of the conversations ``(conv_id, turns)``, one row for each.

    ``turns`` are ids of ``turn_id``; a conversation without turns (or with NULL) is a member of the
    root. Columns: ``node`` and ``parent`` (names of trie nodes, the root's parent NULL), ``turn``
    (id of the node's last turn), ``depth``, ``conv_id`` (smallest member), ``parent_conv_id``,
    ``n_convs``, ``n_children``, ``n_leaves``, ``saved_bytes`` (over the subtree, for every node its
    members but one times the bytes of its last text), ``ends_sha256`` (hash of the ids of the
    conversations that end there, ascending, joined by commas). Ids must be unique and not NULL.
    No conversations give no rows. Other columns are left out.

    A task's tree is bounded by ``task_bytes`` of keys on average; the number of tasks follows the
    keys. Ids that end at one node are hashed as a stream.
    """
    spark = conversations.sparkSession
    hexed = F.transform(F.coalesce("turns", F.array().cast("array<binary>")), F.hex)
    keys = scratch.keep(conversations.select("conv_id", F.unhex(F.array_join(hexed, "")).alias("key")))
    total = keys.agg(F.sum(F.octet_length("key") + 8)).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // task_bytes))
    dealt = keys.repartitionByRange(tasks, "key", "conv_id")
    found = scratch.keep(dealt.mapInArrow(_grow, FOUND))

    # One row for each task, in the order of keys.
    bounds = found.where(F.col("kind") == _BOUNDS).select("part", "first", "last")
    pairs = bounds.select("last", F.lead("first").over(Window.orderBy("part")).alias("next"))
    twice = pairs.where(F.col("next").isNotNull()).mapInArrow(_overlaps, OVERLAP)

    nodes = found.where(F.col("kind") == _NODE)
    sums = ("n_convs", "n_children", "n_leaves", "gross", "own")
    of_tasks = nodes.where("shared").select("node", "parent", "turn", "depth", "conv_id", *sums)
    listed = found.where(F.col("kind") == _ENDS).select("node", "conv_id", "ends")
    hashed = (
        listed.repartition("node").sortWithinPartitions("node", "conv_id").mapInArrow(_hash_ends, "node binary, ends string")
    )
    nothing = hashlib.sha256(b"").hexdigest()
    shared = scratch.keep(
        of_tasks.unionByName(twice, allowMissingColumns=True)
        .groupBy("node")
        .agg(*[F.max(c).alias(c) for c in ("parent", "turn", "depth")], F.min("conv_id").alias("conv_id"),
             *[F.sum(c).alias(c) for c in sums])
        .join(hashed, "node", "left")
        .withColumn("ends", F.coalesce("ends", F.lit(nothing)))
    )
    # The smallest member of a parent that is not shared is known; shared ones are few, a path or two for each task.
    columns = ("node", "parent", "parent_conv_id", "turn", "depth", "conv_id", *sums, "ends")
    unknown = F.lit(None).cast("bigint").alias("parent_conv_id")
    inner = nodes.where("not shared").select(*columns)
    under = inner.where("parent_conv_id is null").unionByName(shared.withColumn("parent_conv_id", unknown).select(*columns))
    parents = shared.select(F.col("node").alias("_node"), F.col("conv_id").alias("_conv_id"))
    joined = under.join(parents, F.col("parent") == F.col("_node"), "left").withColumn("parent_conv_id", F.col("_conv_id"))
    every = inner.where("parent_conv_id is not null").unionByName(joined.select(*columns))
    return every.select(
        "node", "parent", "turn", "depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves",
        (F.col("gross") - F.col("own")).alias("saved_bytes"), F.col("ends").alias("ends_sha256"),
    )
