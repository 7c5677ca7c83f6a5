import re

from bandrisk.llm import decontaminate
from bandrisk.sources.store import Scratch
from tests.llm.data import clashing, documents, odd_rows, text

ITEMS = "item_id long, text string"


def shingles(value):
    folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in value or "")
    tokens = [t for t in re.split(r"[\x20\x09-\x0D]+", folded) if t]
    return {tuple(tokens[i : i + 5]) for i in range(len(tokens) - 4)} or ({tuple(tokens)} if tokens else set())


def expected(rows, items, threshold=0.8):
    found = set()
    for row in rows:
        for item_id, value in items:
            wanted = shingles(value)
            shared = len(wanted & shingles(row[1]))
            if wanted and shared >= threshold * len(wanted) - 1e-9:
                found.add((row[0], item_id, shared, len(wanted)))
    return found


def test_against_brute_force(spark):
    item = text(70, 24)
    broken = item.split()
    broken[3] = "changed"
    worse = list(broken)
    worse[12] = "changed"
    rows = odd_rows() + [
        (50, f"{text(71, 3000)} {item} {text(72, 3000)}", "en", "a", 1),
        (51, "".join(c.upper() if c.isascii() else c for c in item), "en", "a", 1),
        (52, " ".join(broken), "en", "a", 1),
        (53, " ".join(worse), "en", "a", 1),
        (54, f"{item} {item}", "en", "a", 1),
        (54, text(90, 30), "en", "a", 1),
        (55, f"{text(80, 9)}\n{text(81, 70)} {text(80, 9)}", "en", "a", 1),
    ]
    items = [(1, item), (1, item), (2, None), (3, ""), (4, "two words"), (5, text(80, 9)), (6, text(3, 5000)), (None, text(2, 60)), (7, "a a a a a a a")]
    docs = clashing(documents(spark, rows)).repartition(3)
    frame = spark.createDataFrame(items, ITEMS)
    with Scratch(spark) as scratch:
        got = decontaminate.contaminated(docs, frame, scratch).collect()
        kept = decontaminate.drop_contaminated(docs, frame, scratch)
        assert kept.columns == docs.columns
        left = [r.doc_id for r in kept.collect()]
    # Row ids that are used twice may hold an item in one text and not in the other.
    assert {(r.doc_id, r.item_id, r.shared, r.item_shingles) for r in got} == expected(rows, items)
    assert {50, 51, 54} <= {r.doc_id for r in got} and 53 not in {r.doc_id for r in got}
    held = [bool(expected([row], items)) for row in rows]
    assert sorted(left, key=repr) == sorted((row[0] for row, h in zip(rows, held) if not h), key=repr)


def test_empty_tables(spark):
    docs, items = documents(spark, odd_rows()), spark.createDataFrame([(1, "a b c")], ITEMS)
    with Scratch(spark) as scratch:
        assert decontaminate.contaminated(docs.limit(0), items, scratch).count() == 0
        assert decontaminate.contaminated(docs, items.limit(0), scratch).count() == 0
        assert decontaminate.drop_contaminated(docs, items.limit(0), scratch).count() == docs.count()


def test_a_stock_phrase_of_many_items_brings_few_candidates(spark):
    """500 items begin alike, and a third of the documents hold that beginning; a few hold a whole item."""
    stock = "please answer the question below with one letter only and give no reason at all"
    items = [(n, f"{stock} {text(n, 25)}") for n in range(500)]
    docs = [(n, f"{text(5000 + n, 40)} {stock} {text(9000 + n, 40)}", None, None, None) for n in range(300)]
    docs += [(1000 + n, f"{text(7000 + n, 60)}", None, None, None) for n in range(600)]
    docs += [(2000 + n, f"{text(8000 + n, 30)} {items[n][1]} end", None, None, None) for n in range(0, 500, 50)]
    docs.append((3000, stock, None, None, None))
    frame = documents(spark, docs)
    benchmark = spark.createDataFrame([*items, (900, stock), (901, None), (902, "")], "item_id long, text string")
    with Scratch(spark) as scratch:
        pairs = decontaminate.candidates(frame, benchmark, scratch).count()
        got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(frame, benchmark, scratch).collect()}
    expected = {(2000 + n, n) for n in range(0, 500, 50)}
    expected |= {(d[0], 900) for d in docs if stock in d[1]}
    assert got == expected
    assert pairs < 2 * len(expected)
