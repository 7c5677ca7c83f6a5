import hashlib
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from bandrisk.llm import pii
from bandrisk.llm.queries import op12_candidate_boosting
from tests.llm.data import clashing, documents, odd_rows

WORDS = "the house stands near a river and many people walk there every day with their small dogs while children play".split()
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def right(kind, match):
    digits = re.sub(r"[^0-9]", "", match)
    if kind == "ip":
        return all(int(part) <= 255 for part in match.split("."))
    if kind == "card":
        doubled = [int(d) * (1 + n % 2) for n, d in enumerate(reversed(digits))]
        return 16 <= len(digits) <= 19 and sum(d - 9 * (d > 9) for d in doubled) % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def plain(text):
    """Strict spans by the patterns as they are written."""
    found = []
    for kind, pattern in PATTERNS.items():
        found += [(kind, *m.span()) for m in re.finditer(pattern, text) if right(kind, m.group())]
    return found


def strict(text):
    return [(kind, *span) for kind, spans in pii.strict_spans(text, pii.zones(text)).items() for span in spans]


def pieces(rng):
    return rng.choice((
        lambda: "".join(rng.choice("0123456789") for _ in range(rng.randrange(1, 20))),
        lambda: rng.choice("@.-+ ()_%/x") * rng.randrange(1, 3),
        lambda: ".".join(str(rng.randrange(300)) for _ in range(rng.randrange(2, 6))),
        lambda: rng.choice(("a@b.c", "a.b@", "@x", "é", "x@y", "\n", "+1", "٣", "(")),
        lambda: pii._payment(rng),
        lambda: pii._phone(rng),
    ))()


def test_strict_spans_against_the_patterns():
    rng = random.Random(1)
    found = 0
    for _ in range(4000):
        text = "".join(pieces(rng) for _ in range(rng.randrange(1, 9)))
        assert strict(text) == plain(text), text
        found += len(strict(text))
    assert found > 1000


@pytest.mark.parametrize(
    "text",
    ["1" * 400_000, "a@" * 200_000, "+1 " * 100_000, "1.1." * 100_000, "a at b " * 50_000, ":a" * 200_000, "x" * 400_000,
     "a_dot_" * 60_000 + "@", "+1" + " " * 400_000, "1 [.] " * 60_000, "(" * 400_000, "a at b" + " dot b" * 60_000],
)
def test_time_grows_with_the_text(text):
    start = time.perf_counter()
    pii.candidates(text)
    assert time.perf_counter() - start < 8


@pytest.fixture(scope="module")
def finder():
    return pii.train(WORDS)


def test_composed_lines_that_were_not_seen(finder):
    rng = random.Random(77)
    caught, missed, wrong = 0, 0, 0
    for _ in range(3000):
        text, true = pii.composed_line(rng, WORDS, WORDS)
        found = finder.spans([text])[0]
        got = {c[:3] for c in found}
        caught, missed = caught + len(got & true), missed + len(true - got)
        wrong += sum(not c[3] and c[:3] not in true for c in found)
    assert caught / (caught + missed) > 0.95 and wrong / caught < 0.02


@pytest.mark.parametrize(
    "text,kind,span",
    [
        ("Please write to jane.doe [at] example [dot] org today", "email", "jane.doe [at] example [dot] org"),
        ("contact: joe at mail dot example dot com", "email", "joe at mail dot example dot com"),
        ("call (555) 123-4567 now", "phone", "(555) 123-4567"),
        ("tel. 0049 30 1234567", "phone", "0049 30 1234567"),
        ("card 3782 822463 10005 expires", "card", "3782 822463 10005"),
        ("visa 4111.1111.1111.1111 ok", "card", "4111.1111.1111.1111"),
        ("host 2001:db8:85a3::8a2e:370:7334 is down", "ip", "2001:db8:85a3::8a2e:370:7334"),
        ("from 10[.]20[.]30[.]40 again", "ip", "10[.]20[.]30[.]40"),
    ],
)
def test_loose_formats(finder, text, kind, span):
    assert [(c[0], text[c[1] : c[2]], c[3]) for c in finder.spans([text])[0]] == [(kind, span, False)]


@pytest.mark.parametrize(
    "text",
    [
        "He looked at the house. There were 12 dogs and 3 cats at 10:30:15.",
        "Born 1912-06-23, died 1954-06-07; see pages 1045-1099 of volume 12.",
        'token = "57f17a56c90cac3e893f4491169557bdc83d8148"',
        "ISBN 978-3-16-148410-0, price 1 234.50",
        "std::vector<int> and 3 @ 4.50 each, meet at cafe.de",
    ],
)
def test_clean_lines(finder, text):
    assert finder.spans([text]) == [[]]


def test_choice_keeps_strict_spans_and_takes_no_overlaps(finder):
    own = [("ip", 0, 9, True, 0.0), ("card", 0, 12, True, 0.1), ("phone", 8, 20, False, 0.99), ("phone", 30, 40, False, 0.9),
           ("card", 35, 50, False, 0.95), ("phone", 60, 70, False, 0.1)]
    assert finder._chosen(own) == [own[0], own[1], own[4]]


def test_redaction():
    text = "ab 12 cd 34 ef"
    assert pii.redacted(text, [("phone", 9, 11), ("ip", 3, 5)]) == "ab [IP] cd [PHONE] ef"
    assert pii.redacted(text, [("card", 3, 8), ("ip", 4, 11)]) == "ab [CARD] ef"
    assert pii.redacted("", []) == ""


def test_query_against_the_patterns(spark, tmp_path):
    rng = random.Random(5)
    rows = odd_rows() + [(100 + n, pii.composed_line(rng, WORDS, WORDS)[0] * (n % 3), "en", "a", 1) for n in range(300)]
    rows.append((900, "x" * 100_000 + " é 10.0.0.1 a@b.cd " * 2000, None, None, None))
    docs = clashing(documents(spark, rows)).withColumn("_spans", F.lit("x")).withColumn("spans", F.lit("y"))
    docs.repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    got = op12_candidate_boosting(spark, str(tmp_path)).collect()

    def base(text):
        found = plain(text or "")
        joined = ",".join(":".join(map(str, s)) for s in found)
        counts = [sum(s[0] == kind for s in found) for kind in pii.KINDS]
        return (*counts, hashlib.sha256(joined.encode()).hexdigest())

    expected = sorted(((r[0], *base(r[1])) for r in rows), key=repr)
    assert sorted((tuple(r)[:6] for r in got), key=repr) == expected
    for r in got:
        kinds = [s.split(":")[0] for s in r.spans.split(",") if s]
        assert all(kinds.count(k) >= n for k, n in zip(pii.KINDS, tuple(r)[1:5]))


def test_no_rows_and_no_words(spark, tmp_path):
    documents(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    assert op12_candidate_boosting(spark, str(tmp_path)).count() == 0
