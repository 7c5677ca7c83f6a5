import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from bandrisk.llm import prefix_trie
from bandrisk.llm.queries import rebuilt
from bandrisk.sources.store import Scratch

ROWS = "conv_id long, turn long, role string, text string"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_bytes", "ends_sha256")


def expected(paths):
    """Rows of ``COLUMNS`` from ``conv_id -> [(role, text), ...]``."""
    members = defaultdict(list)
    for conv, turns in paths.items():
        for depth in range(len(turns) + 1):
            members[tuple(turns[:depth])].append(conv)
    children = defaultdict(set)
    for node in members:
        if node:
            children[node[:-1]].add(node)
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, convs in members.items():
        for depth in range(len(node) + 1):
            leaves[node[:depth]] += not children[node]
            saved[node[:depth]] += (len(convs) - 1) * (len(node[-1][1].encode()) if node else 0)
    ends = {node: sorted(c for c in convs if len(paths[c]) == len(node)) for node, convs in members.items()}
    return sorted(
        (min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), len(children[node]), leaves[node],
         saved[node], hashlib.sha256(",".join(map(str, ends[node])).encode()).hexdigest())
        for node, convs in members.items()
    )


def turns_of(rows):
    """Ordered turns by conversation, for rows without equal turn numbers."""
    found = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            found[conv].append((turn is not None, turn or 0, role or "", text or ""))
    return {conv: [t[2:] for t in sorted(turns)] for conv, turns in found.items()}


def trie(spark, rows, tasks=8, **options):
    df = spark.createDataFrame(rows, ROWS).withColumn("depth", F.lit("clash")).repartition(4)
    with Scratch(spark) as scratch:
        turns = prefix_trie.conversation_turns(df)
        found = prefix_trie.prefix_trie(turns, scratch, **options).select(*COLUMNS).collect()
    return sorted((tuple(r) for r in found), key=lambda r: (r[0], r[1]))


def forest(seed, count):
    """Conversations of few different turns: copies, beginnings of others, a third with one beginning."""
    rng = random.Random(seed)
    rows = []
    for conv in range(count):
        turns = [rng.choice(["a", "b", "né", "", None]) for _ in range(rng.randrange(7))]
        if conv % 3 == 0:
            turns = ["hot"] * 3 + turns[:2]
        rows += [(conv, n, "user" if n % 2 == 0 else None, text) for n, text in enumerate(turns)]
    return rows


@pytest.mark.parametrize("task_bytes", [100, 3000, 1 << 20])
def test_against_brute_force(spark, task_bytes):
    rows = forest(1, 400)
    assert trie(spark, rows, task_bytes=task_bytes) == expected(turns_of(rows))


def test_odd_rows(spark):
    rows = [
        (1, None, "user", "first"),
        (1, 5, None, None),
        (1, 2, "", ""),
        (2, 0, "user", "first"),
        (-3, 0, "user", "first"),
        (-3, 1, "", "x" * 100_000),
        (None, 0, "user", "lost"),
        (4, None, None, None),
    ]
    assert trie(spark, rows) == expected(turns_of(rows))
    assert trie(spark, []) == []


def test_repeated_rows_are_repeated_turns(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (2, 0, "user", "a")]
    assert trie(spark, rows) == expected({1: [("user", "a")] * 2, 2: [("user", "a")]})


def test_copies_cut_between_tasks_and_conversations_without_turns(spark):
    rows = [(n, t, "user", str(t)) for n in range(300) for t in range(3)] + [(900, t, "user", str(t)) for t in range(6)]
    turns = prefix_trie.conversation_turns(spark.createDataFrame(rows, ROWS))
    none = spark.createDataFrame([(n, None) for n in range(1000, 1060)], "conv_id long, turns array<binary>")
    with Scratch(spark) as scratch:
        found = prefix_trie.prefix_trie(turns.unionByName(none), scratch, task_bytes=400).select(*COLUMNS)
        got = sorted(tuple(r) for r in found.collect())
    paths = turns_of(rows) | {n: [] for n in range(1000, 1060)}
    assert got == sorted(expected(paths))


def test_nodes_grow_and_paths_part():
    tree = prefix_trie.RadixTree()
    rng = random.Random(2)
    keys = {bytes(rng.choice(range(256)) for _ in range(prefix_trie.WIDTH)) * rng.choice((1, 1, 3)) for _ in range(3000)}
    keys |= {key[: prefix_trie.WIDTH] for key in keys}
    layouts = set()
    for name, key in enumerate(sorted(keys, key=hash)):
        tree.insert(key, name)
        layouts.add((type(tree.root.layout).__name__, getattr(tree.root.layout, "room", 0)))
    assert layouts == {("_Sorted", 4), ("_Sorted", 16), ("_Indexed", 0), ("_Direct", 0)}
    found = {row[0]: row for row in prefix_trie.walk(tree)}
    assert set(found) == {name for key in keys for name in prefix_trie.path_names(key)}
    assert sum(len(row[-1]) for row in found.values()) == len(keys)


def test_a_long_conversation_is_walked_without_recursion():
    tree = prefix_trie.RadixTree()
    key = b"".join(n.to_bytes(prefix_trie.WIDTH, "big") for n in range(20_000))
    tree.insert(key, 1)
    for cut in range(0, 20_000, 10):
        tree.insert(key[: cut * prefix_trie.WIDTH] + b"\xff" * prefix_trie.WIDTH, cut + 2)
    assert sum(1 for _ in prefix_trie.walk(tree)) == 20_001 + 2_000


def test_rebuilding(spark):
    import zlib

    rows = [(c, t, "user", f"{c}-{t}") for c in (0, 1, 3, 4, 6, 12, 13, 15, 17, 19) for t in range(c % 7 + 1)]
    own = turns_of(rows)
    paths = {}
    for conv, turns in own.items():
        lent = zlib.crc32(str(conv).encode()) % 9
        paths[conv] = own.get(conv - conv % 5, [])[:lent] + turns[lent:]
    with Scratch(spark) as scratch:
        turns = rebuilt(prefix_trie.conversation_turns(spark.createDataFrame(rows, ROWS)))
        found = prefix_trie.prefix_trie(turns, scratch).select(*COLUMNS).collect()
    assert sorted(tuple(r) for r in found) == sorted(expected(paths))
