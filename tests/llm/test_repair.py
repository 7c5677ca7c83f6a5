import hashlib
import random
import re
import time
from itertools import product

from pyspark.sql import functions as F

from bandrisk.llm import repair
from bandrisk.llm.repair import Edits, Row, lightest
from bandrisk.sources.store import Scratch

ROWS = "conv_id long, turn long, role string, text string"


def all_repairs(rows):
    """Cost and letters of every repair with at most two inserts in one place."""
    fills = ["", "u", "a", "uu", "ua", "au", "aa"]
    edits = []
    for row in rows:
        more = 3 * row.truncated
        kept = [] if row.lost else [("K", row.initial, more)] + [("R", r, 3 + more) for r in "ua"]
        edits.append([("D", "", 4), *kept])
    for chosen in product(*edits):
        for gaps in product(fills, repeat=len(rows) + 1):
            roles = letters = gaps[0] and ""
            roles, letters, cost = gaps[0], "I" * len(gaps[0]), 3 * len(gaps[0])
            for (letter, role, price), gap in zip(chosen, gaps[1:]):
                roles, letters, cost = roles + role + gap, letters + letter + "I" * len(gap), cost + price + 3 * len(gap)
            if re.fullmatch("(s?(ua)+)?", roles):
                yield cost, letters


def some_rows(rng, count):
    return [Row(rng.choice("sssuuuaaax "), rng.random() < 0.15, False) for _ in range(count)]


def test_every_repair_of_few_rows():
    rng = random.Random(3)
    for count in (0, 1, 2, 3, 3, 3):
        for _ in range(12):
            rows = [Row(r.initial, r.lost, not r.lost and rng.random() < 0.3) for r in some_rows(rng, count)]
            assert lightest(rows) == min(all_repairs(rows)), rows


def layered(rows):
    """Least cost and letters by rows done and last role, row by row."""
    after = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}

    def filled(states):
        for _ in range(2):
            for (state, role), to in after.items():
                if state in states and role != "s":
                    cost, letters = states[state]
                    states[to] = min(states.get(to, (10**9, "")), (cost + 3, letters + "I"))
        return states

    states = filled({0: (0, "")})
    for row in rows:
        found = {}
        for state, (cost, letters) in states.items():
            steps = [(state, 4, "D")]
            if not row.lost:
                steps += [(after.get((state, row.initial)), 3 * row.truncated, "K")]
                steps += [(after.get((state, role)), 3 + 3 * row.truncated, "R") for role in "ua"]
            for to, price, letter in steps:
                if to is not None:
                    found[to] = min(found.get(to, (10**9, "")), (cost + price, letters + letter))
        states = filled(found)
    return min(states[s] for s in (0, 3) if s in states)


def test_long_conversations_row_by_row():
    rng = random.Random(4)
    for count in (7, 30, 200):
        for _ in range(5):
            rows = [Row(r.initial, r.lost, not r.lost and rng.random() < 0.3) for r in some_rows(rng, count)]
            assert lightest(rows) == layered(rows)


def test_time_grows_with_the_rows():
    rng = random.Random(5)
    start = time.perf_counter()
    cost, letters = lightest(some_rows(rng, 20_000))
    assert time.perf_counter() - start < 20 and len(letters) >= 20_000 and cost > 0


def test_edits_compare_as_strings():
    rng = random.Random(6)
    strings = ["".join(rng.choice("DIKR") for _ in range(rng.randrange(40))) for _ in range(150)]
    strings += [s[:20] + t[20:] for s, t in zip(strings, strings[1:])]
    nothing, made = Edits(), {}
    for s in strings:
        at = nothing
        for letter in s:
            at = at.add(letter)
        assert made.setdefault(s, at) is at and str(at) == s
    assert all((made[a] < made[b]) == (a < b) for a in strings for b in strings)


def replayed(rows, letters):
    """Repaired ``(role, text)`` of ordered rows."""
    kept, roles, made = [], iter(rows), []
    for letter in letters:
        role, text = (None, "") if letter == "I" else next(roles)
        if letter != "D":
            kept.append((letter, role, text))
    system = bool(kept) and kept[0][0] == "K" and kept[0][1][:1] == "s"
    for n, (letter, role, text) in enumerate(kept):
        made.append((role if letter == "K" else ("user", "assistant")[(n - system) % 2], text))
    return made


def run(spark, rows, ids=None):
    df = spark.createDataFrame(rows, ROWS).withColumn("mark", F.lit("clash")).repartition(3)
    named = spark.createDataFrame([(n,) for n in ids], "conv_id long") if ids is not None else None
    with Scratch(spark) as scratch:
        found = {r.conv_id: r for r in repair.repair(df, scratch, named).collect()}
        diagnosed = repair.diagnose(df, named)
        made = repair.repaired_rows(df, diagnosed).orderBy("conv_id", "position").collect()
    return found, made


def test_odd_rows(spark):
    long = "word " * 200_000 + "end."
    rows = [
        (1, 0, "system", "Be kind."),
        (1, 1, "user", "What?"),
        (1, 2, "user", " \t\n"),
        (1, 4, "user", "What?"),
        (1, 9, "assistant", "This is cut"),
        (2, None, None, "Unnamed."),
        (2, 3, "user", None),
        (2, 3, "", ""),
        (3, 7, "assistant", long),
        (None, 1, "user", "No id."),
        (None, 1, "user", "No id."),
        (5, None, "user", "One."),
        (5, None, "assistant", "Two. \n"),
    ]
    found, made = run(spark, rows, [1, 2, 3, 3, None, 4])
    assert set(found) == {1, 2, 3, 4, 5, None}
    faults = {c: tuple(r)[1:6] for c, r in found.items()}
    assert faults[1] == (5, 1, 1, 1, 2) and (found[1].cost, found[1].audit) == (11, "KKDDK")
    assert faults[2][:4] == (0, 2, 0, 0) and found[2].audit == "DDD"
    assert faults[3] == (0, 0, 0, 0, 0) and found[3].audit == "IK" and found[3].cost == 3
    assert faults[None] == (0, 0, 1, 0, 1) and found[None].audit == "KDI"
    # By role where the turns are equal: another repair, RR, costs as much.
    assert faults[5] == (0, 0, 0, 0, 0) and (found[5].cost, found[5].audit) == (6, "IKKI")
    empty = hashlib.sha256(b"").hexdigest()
    assert tuple(found[4])[1:] == (0, 0, 0, 0, 0, 0, "", empty)
    assert found[2].repaired_sha256 == empty
    text = "user:\nassistant:" + long
    assert found[3].repaired_sha256 == hashlib.sha256(text.encode()).hexdigest()
    of_one = [(r.role, r.text) for r in made if r.conv_id == 1]
    assert of_one == replayed([r[2:] for r in rows[:5]], found[1].audit)
    whole = "\n".join(f"{role}:{text}" for role, text in of_one)
    assert found[1].repaired_sha256 == hashlib.sha256(whole.encode()).hexdigest()


def test_none(spark):
    assert run(spark, []) == ({}, [])


def test_many_conversations_against_the_layers(spark):
    rng = random.Random(8)
    rows = []
    for conv in range(150):
        size = 300 if conv == 0 else rng.randrange(1, 9)
        for turn in range(size):
            role = rng.choice(("user", "assistant", "system", "tool"))
            rows.append((conv, turn, role, f"text {rng.randrange(5)}" + rng.choice((".", "", "! "))))
    found, made = run(spark, rows)
    for conv in range(150):
        own, seen, known = [r[2:] for r in rows if r[0] == conv], set(), []
        for role, text in own:
            again = (role, text) in seen
            seen.add((role, text))
            known.append(Row(role[0], again, not again and text.rstrip()[-1] not in ".!?"))
        assert (found[conv].cost, found[conv].audit) == layered(known)
        assert [(r.role, r.text) for r in made if r.conv_id == conv] == replayed(own, found[conv].audit)
