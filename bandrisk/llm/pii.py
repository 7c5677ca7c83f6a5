"""Personal data in texts: candidate spans, boosted trees, calibrated thresholds.

Generators propose every span that may be an e-mail address, an IP address, a payment card or a phone
number, in strict formats and in loose ones (other separators, spelled-out signs, version 6 addresses,
national numbers), and for runs of digit groups every piece that may be one, so spans overlap. Boosted
trees score a candidate by its format and by what stands around it. Scores are calibrated on examples
the trees have not seen, and each kind has the lowest threshold that keeps the wanted precision there.
Strict matches always stay; of the others those above their threshold are taken, the surest first,
where they overlap nothing taken before.

The trees are trained on lines composed from a bounded sample of the input's words: personal data in
many formats, with and without words that announce it, and numbers of other kinds.

All scans are linear in the text: digits are looked for in runs of characters that numbers are made
of, signs by plain search.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandrisk.llm.trees import Forest, boost

KINDS = ("email", "ip", "card", "phone")
# Documents whose words fill the training lines, the characters of those that are used, and training lines.
SAMPLE_DOCUMENTS = 100
SAMPLE_CHARACTERS = 2_000
TRAIN_LINES = 9_000
# Of the lines one in so many calibrates; precision to keep there, and the least probability to accept.
CALIBRATION_SHARE = 3
PRECISION = 0.99
LEAST_PROBABILITY = 0.7

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_WIDE = "\u00a0\u2007\u202f\u2010\u2011\u2012\u2013\u2014\u00b7"
_ZONE = re.compile(rf"[0-9+(][0-9 ().+\-_/{_WIDE}]*")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DOTTED = re.compile(r"[0-9.]+")
_GROUP = re.compile(r"[0-9]+")
_CARD_DIGITS, _PHONE_DIGITS = range(16, 20), range(8, 16)


def luhn(digits: str) -> bool:
    """Whether the check digit of a card number is right."""
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = ord(digit) - 48
        if place % 2:
            value = value * 2 - 9 * (value > 4)
        total += value
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(_GROUP.findall(text))


def _tail(text: str, start: int, end: int, letters: str) -> int:
    """Where the run of ``letters`` that ends at ``end`` begins, not before ``start``."""
    return start + len(text[start:end].rstrip(letters))


def strict_emails(text: str) -> Iterator[tuple[int, int]]:
    free, at = 0, text.find("@")
    while at >= 0:
        begin = _tail(text, free, at, _LOCAL)
        found = _DOMAIN.match(text, at + 1) if begin < at else None
        if found:
            yield begin, found.end()
        free = found.end() if found else at + 1
        at = text.find("@", free)


def _dotted_quads(text: str, start: int) -> Iterator[tuple[int, int]]:
    """Leftmost runs of four numbers joined by dots, as an expression would find them."""
    parts, place, at = text.split("."), 0, start
    while place + 4 <= len(parts):
        four = parts[place : place + 4]
        if all(four):
            end = at + sum(map(len, four)) + 3
            yield at, end
            at, place = end + 1, place + 4
        else:
            at, place = at + len(parts[place]) + 1, place + 1


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def zones(text: str) -> list[tuple[int, int]]:
    """Runs of characters that numbers are made of and that are long enough to matter."""
    return [m.span() for m in _ZONE.finditer(text) if m.end() - m.start() >= 7]


def strict_spans(text: str, runs: list[tuple[int, int]]) -> dict[str, list[tuple[int, int]]]:
    """Strict matches by kind: leftmost, not overlapping within a kind, checked and not tried again."""
    found: dict[str, list[tuple[int, int]]] = {kind: [] for kind in KINDS}
    found["email"] = list(strict_emails(text))
    for start, end in runs:
        run = text[start:end]
        if run.count(".") >= 3:
            for m in _DOTTED.finditer(run):
                for a, b in _dotted_quads(m.group(), start + m.start()):
                    if all(map(_octet, text[a:b].split("."))):
                        found["ip"].append((a, b))
        for m in _CARD.finditer(run):
            if m.end() - m.start() >= 16:
                digits = _digits(m.group())
                if len(digits) in _CARD_DIGITS and luhn(digits):
                    found["card"].append((start + m.start(), start + m.end()))
        if "+" in run:
            for m in _PHONE.finditer(run):
                if len(_digits(m.group())) in _PHONE_DIGITS:
                    found["phone"].append((start + m.start(), start + m.end()))
    return found


# Signs that stand for @ and the dot, around which an address is looked for.
_AT_WORD = re.compile(r"[\s\[({<_](?:[aA][tT]|@)[\s\])}>_]")
_AT_SIGNS = ("＠", "&#64;", "%40", "@")
_AT = r"(?:\s?[\[({<]\s?(?:at|@)\s?[\])}>]\s?|\s(?:at|@)\s|_at_|\s?(?:＠|&#64;|%40|@)\s?)"
_DOT = r"(?:\s?[\[({<]\s?(?:dot|punkt|punto|point|\.)\s?[\])}>]\s?|\s(?:dot|punkt|punto|point)\s|_dot_|\.)"
_REST = re.compile(rf"(?i:{_AT})[A-Za-z0-9-]{{1,63}}?(?:(?i:{_DOT})[A-Za-z0-9-]{{1,63}}?)*(?i:{_DOT})[A-Za-z0-9]{{2,24}}(?![A-Za-z0-9])")
_LONGEST_LOCAL = 64
_SIX = re.compile(r":[0-9A-Fa-f:]")
_HEX = "0123456789abcdefABCDEF:"
_HEX_RUN = re.compile(r"[0-9A-Fa-f:]+")
_FANGED = re.compile(r"[0-9]{1,3}(?:\s?(?:[\[({]\s?(?:\.|dot)\s?[\])}]|\sdot\s)\s?[0-9]{1,3}){3}(?![0-9])", re.IGNORECASE)
_FANG = re.compile(r"[0-9] ?[\[({] ?(?:\.|[dD][oO][tT]) ?[\])}]|[0-9] [dD][oO][tT] [0-9]")


def _loose_emails(text: str) -> Iterator[tuple[int, int]]:
    places = [m.start() for m in _AT_WORD.finditer(text)]
    for sign in _AT_SIGNS:
        at = text.find(sign)
        while at >= 0:
            places.append(at)
            at = text.find(sign, at + 1)
    for place in sorted(set(places)):
        # The sign may stand in brackets or between spaces that begin before it.
        for at in range(max(0, place - 2), place + 1):
            rest = _REST.match(text, at, place + 400)
            if rest:
                begin = _tail(text, max(0, at - _LONGEST_LOCAL), at, _LOCAL)
                if begin < at:
                    yield begin, rest.end()
                    break


def _version_six(text: str) -> Iterator[tuple[int, int]]:
    free = 0
    for m in _SIX.finditer(text):
        if m.start() < free:
            continue
        begin = _tail(text, max(free, m.start() - 40), m.start(), _HEX)
        run = _HEX_RUN.match(text, begin)
        free = run.end()
        parts = run.group().split(":")
        short = run.group().count("::")
        if 3 <= len(parts) <= 9 and max(map(len, parts)) <= 4 and short <= 1 and (short or len(parts) == 8):
            yield run.span()


def _fanged(text: str) -> Iterator[tuple[int, int]]:
    free = 0
    for m in _FANG.finditer(text):
        begin = _tail(text, max(free, m.start() - 3), m.start() + 1, "0123456789")
        found = _FANGED.match(text, begin)
        if found and m.start() >= free:
            free = found.end()
            if all(map(_octet, _GROUP.findall(found.group()))):
                yield found.span()


# Groups of digits that a piece of a run may have.
_MOST_GROUPS = 8
_SIGNS, _PLUS = re.compile(r"(?:\+\(|\(\+|\+|\(|)\Z"), re.compile(r"\+?\Z")


def _pieces(text: str, start: int, end: int) -> Iterator[tuple[str, int, int]]:
    """Pieces of a run of digit groups that may be a card or a phone number."""
    groups = [(start + m.start(), start + m.end()) for m in _GROUP.finditer(text[start:end])]
    gaps = [b[0] - a[1] for a, b in zip(groups, groups[1:])]
    for first in range(len(groups)):
        digits = ""
        begin = groups[first][0]
        lead = text[max(start, begin - 2) : begin]
        opens = first == 0 or gaps[first - 1] > 1 or lead[-1:] in ("+", "(")
        for last in range(first, min(first + _MOST_GROUPS, len(groups))):
            if last > first and gaps[last - 1] > 3:
                break
            digits += text[slice(*groups[last])]
            if len(digits) > 19:
                break
            closes = last == len(groups) - 1 or gaps[last] > 1
            if len(digits) >= 13 and digits[0] in "3456" and luhn(digits):
                yield "card", begin, groups[last][1]
            if opens and closes and len(digits) in _PHONE_DIGITS:
                # A bracket belongs to the number if it is closed within.
                signs = _SIGNS if ")" in text[begin : groups[last][1]] else _PLUS
                yield "phone", begin - len(signs.search(lead).group()), groups[last][1]


def candidates(text: str) -> list[tuple[str, int, int, bool]]:
    """``(kind, start, end, strict)`` of all spans that may be personal data, by kind and start."""
    runs = zones(text)
    strict = strict_spans(text, runs)
    found = {(kind, *span): True for kind, spans in strict.items() for span in spans}
    loose: list[tuple[str, int, int]] = [("email", *span) for span in _loose_emails(text)]
    loose += [("ip", *span) for span in (*_version_six(text), *_fanged(text))]
    for run in runs:
        loose += _pieces(text, *run)
    for span in loose:
        found.setdefault(span, False)
    order = {kind: n for n, kind in enumerate(KINDS)}
    return [(*span, found[span]) for span in sorted(found, key=lambda s: (order[s[0]], s[1], s[2]))]


# Words that announce a kind, and words that announce numbers that are no personal data.
CUES = {
    "email": "mail email e-mail courriel correo contact write schreiben escribir address adresse",
    "ip": "ip host server client address gateway login remote von desde",
    "card": "card visa mastercard amex karte carte tarjeta credit debit pay payment zahlung paiement pago",
    "phone": "phone tel telephone telefon telefono call ring fax mobile cell handy mobil appeler llamar whatsapp",
    "other": "order invoice isbn issn version ref id no nr number token hash sum total price usd eur date serial sku"
    " part article doi page pages vol build ticket case account population year size bytes",
}
_CUE_OF = {word: n for n, words in enumerate(CUES.values()) for word in words.split()}
_CUE_WORDS = re.compile(r"[A-Za-z][A-Za-z-]*")
_AROUND = 32
_BEFORE = "\n\t ([{<=\"':#/$_-.,"


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format and context of a candidate as numbers."""
    span = text[start:end]
    groups = _GROUP.findall(span)
    digits = "".join(groups)
    sizes = [len(g) for g in groups] or [0]
    before, after = text[max(0, start - 1) : start], text[end : end + 1]
    left, right = text[max(0, start - _AROUND) : start], text[end : end + _AROUND // 2]
    cues = [0.0] * len(CUES)
    for word in _CUE_WORDS.findall(left):
        cue = _CUE_OF.get(word.lower())
        if cue is not None:
            cues[cue] += 1
    tail = span.rpartition(".")[2]
    signs = [c for c in span if not c.isalnum()]
    words = span.split()
    return [
        *(float(kind == k) for k in KINDS),
        len(span), len(digits), sum(map(str.isalpha, span)), len(signs), len(set(signs)),
        len(groups), sizes[0], sizes[-1], max(sizes), min(sizes), max(sizes) - min(sizes),
        span.startswith("+"), span.startswith("00"), span.startswith("0"), span.startswith("("),
        luhn(digits) if len(digits) >= 12 else 0.0,
        max((int(g) if len(g) <= 4 else 9999) for g in groups) if groups else -1.0,
        float(digits[:4]) if digits else -1.0,
        span.count("."), span.count("-"), span.count(" "), span.count("/"), span.count("@"), span.count(":"),
        sum(c in "[](){}<>" for c in span), len(words), len(words[0]) if words else 0,
        len(tail) if tail.isalpha() else 0.0, "dot" in span.lower(), sum(map(str.isupper, span)),
        _BEFORE.find(before) if before else -2.0, before.isalpha(), before.isdigit(),
        after.isalpha(), after.isdigit(), after in ("%", ".") and text[end + 1 : end + 2].isdigit(),
        sum(map(str.isdigit, left)), sum(map(str.isdigit, right)), left.rstrip().endswith(":"),
        *cues,
    ]


@dataclass
class Finder:
    """Trees, and by kind the slope and offset that calibrate their scores and the probability to accept."""

    forest: Forest
    slopes: dict[str, tuple[float, float]]
    thresholds: dict[str, float]

    def probabilities(self, kinds: list[str], rows: np.ndarray) -> np.ndarray:
        slopes = np.array([self.slopes[k] for k in kinds])
        return _sigmoid(slopes[:, 0] * self.forest.log_odds(rows) + slopes[:, 1])

    def spans(self, texts: list[str]) -> list[list[tuple[str, int, int, bool, float]]]:
        """``(kind, start, end, strict, probability)`` of the personal data of each text, by kind and start."""
        proposed = [candidates(text) for text in texts]
        rows = [features(text, *c[:3]) for text, found in zip(texts, proposed) for c in found]
        if not rows:
            return [[] for _ in texts]
        p = self.probabilities([c[0] for found in proposed for c in found], np.array(rows, float)).tolist()
        taken, at = [], 0
        for found in proposed:
            own = [(*c, p[at + n]) for n, c in enumerate(found)]
            at += len(found)
            taken.append(self._chosen(own))
        return taken

    def _chosen(self, own: list[tuple[str, int, int, bool, float]]) -> list[tuple[str, int, int, bool, float]]:
        chosen = [c for c in own if c[3]]
        others = [c for c in own if not c[3] and c[4] >= self.thresholds[c[0]]]
        if others:
            covered = _Covered([(c[1], c[2]) for c in chosen])
            for c in sorted(others, key=lambda c: (-c[4], c[1] - c[2], c[1])):
                if covered.free(c[1], c[2]):
                    covered.add(c[1], c[2])
                    chosen.append(c)
        order = {kind: n for n, kind in enumerate(KINDS)}
        return sorted(chosen, key=lambda c: (order[c[0]], c[1]))


class _Covered:
    """Which stretches of 64 characters hold which spans, so overlaps are found without comparing all."""

    def __init__(self, spans: Iterable[tuple[int, int]]):
        self.cells: dict[int, list[tuple[int, int]]] = {}
        for span in spans:
            self.add(*span)

    def add(self, start: int, end: int) -> None:
        for cell in range(start >> 6, (end >> 6) + 1):
            self.cells.setdefault(cell, []).append((start, end))

    def free(self, start: int, end: int) -> bool:
        near = (s for cell in range(start >> 6, (end >> 6) + 1) for s in self.cells.get(cell, ()))
        return all(b <= start or a >= end for a, b in near)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _number(rng: random.Random, size: int, first: str = "0123456789") -> str:
    return rng.choice(first) + "".join(rng.choice("0123456789") for _ in range(size - 1))


def _card(rng: random.Random, size: int) -> str:
    body = _number(rng, size - 1, "3456")
    return next(body + d for d in "0123456789" if luhn(body + d))


def _cut(text: str, sizes: Iterable[int], sign: str) -> str:
    parts, at = [], 0
    for size in sizes:
        parts.append(text[at : at + size])
        at += size
    return sign.join(p for p in (*parts, text[at:]) if p)


def _email(rng: random.Random, names: list[str]) -> str:
    local = rng.choice((".", "", "_", "-")).join(rng.choice(names) for _ in range(rng.choice((1, 1, 2))))
    local += rng.choice(("", "", str(rng.randrange(100))))
    domain = [rng.choice(names) + rng.choice(("", "", str(rng.randrange(10)))) for _ in range(rng.choice((1, 1, 2)))]
    end = rng.choice(("com", "org", "net", "de", "fr", "es", "io", "edu", "info", "example", "uk", "eu"))
    at, dot = rng.choice((
        ("@", "."), (" at ", " dot "), ("[at]", "[dot]"), (" [at] ", " [dot] "), ("(at)", "."), ("(at)", "(dot)"),
        (" AT ", " DOT "), ("＠", "."), ("&#64;", "."), (" @ ", "."), ("@ ", "."), ("[@]", "[.]"), ("@", " dot "), ("@", "[.]"),
        (" (at) ", " (dot) "), ("_at_", "_dot_"), ("%40", "."), ("{at}", "{dot}"), (" (at) ", "."), ("<at>", "."),
    ))
    return local + at + dot.join([*domain, end])


def _ip(rng: random.Random) -> str:
    if rng.random() < 0.35:
        parts = [f"{rng.randrange(1 << 16):x}" for _ in range(8)]
        if rng.random() < 0.5:
            cut = rng.randrange(1, 5)
            parts[cut : rng.randrange(cut + 2, 8)] = [""]
        return ":".join(parts) if rng.random() < 0.8 else ":".join(parts).upper()
    dot = rng.choice((".", "[.]", "(.)", " [.] ", "[dot]", "(dot)", " dot ", "{.}"))
    return dot.join(str(rng.randrange(256)) for _ in range(4))


def _phone(rng: random.Random) -> str:
    d = _number
    sign = rng.choice((" ", "-", ".", "/", " ", "‑", " - "))
    return rng.choice((
        lambda: f"({d(rng, 3, '23456789')}) {d(rng, 3)}{rng.choice('- .')}{d(rng, 4)}",
        lambda: sign.join((d(rng, 3, "23456789"), d(rng, 3), d(rng, 4))),
        lambda: sign.join(("1", d(rng, 3, "23456789"), d(rng, 3), d(rng, 4))),
        lambda: f"+{d(rng, rng.randrange(1, 4), '123456789')}{sign}{sign.join(d(rng, rng.randrange(2, 5)) for _ in range(3))}",
        lambda: f"00{d(rng, 2, '123456789')}{sign}{d(rng, 3)}{sign}{d(rng, rng.randrange(5, 8))}",
        lambda: f"0{d(rng, rng.randrange(2, 4), '123456789')}{sign}{d(rng, rng.randrange(6, 9))}",
        lambda: sign.join([f"0{d(rng, 1, '123456789')}", *[d(rng, 2) for _ in range(4)]]),
        lambda: f"+{d(rng, rng.randrange(10, 14), '123456789')}",
        lambda: f"({d(rng, 3, '23456789')}){d(rng, 3)}{sign}{d(rng, 4)}",
    ))()


def _payment(rng: random.Random) -> str:
    size = rng.choice((16, 16, 16, 15, 15, 14, 19))
    sizes = (4, 6) if size == 15 else (4, 6) if size == 14 else (4, 4, 4, 4)
    return _cut(_card(rng, size), sizes, rng.choice(("", " ", "-", ".", "  ", "_", "/", " ", " - ", "‑")))


def _decoy(rng: random.Random, names: list[str]) -> str:
    """A number or a word with a sign that is no personal data."""
    d = _number
    return rng.choice((
        lambda: "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice((16, 32, 40, 64)))),
        lambda: f"{rng.randrange(1900, 2040)}-{rng.randrange(1, 13):02}-{rng.randrange(1, 29):02} {rng.randrange(24):02}:{rng.randrange(60):02}:{rng.randrange(60):02}",
        lambda: f"{rng.randrange(1, 29):02}.{rng.randrange(1, 13):02}.{rng.randrange(1900, 2040)} - {rng.randrange(1, 29):02}.{rng.randrange(1, 13):02}.{rng.randrange(1900, 2040)}",
        lambda: f"{rng.randrange(1900, 2040)}-{rng.randrange(1900, 2040)}",
        lambda: f"978-{d(rng, 1)}-{d(rng, 2)}-{d(rng, 6)}-{d(rng, 1)}",
        lambda: ".".join(d(rng, rng.randrange(1, 3)) for _ in range(rng.choice((3, 5, 6)))),
        lambda: f"{rng.randrange(1, 999)} {d(rng, 3)} {d(rng, 3)}.{d(rng, 2)}",
        lambda: f"{rng.choice(('No', 'ID', 'Ref', '#', 'SKU', 'order'))} {d(rng, rng.randrange(8, 16))}",
        lambda: d(rng, rng.randrange(8, 20)),
        lambda: "-".join(d(rng, rng.randrange(1, 9)) for _ in range(rng.randrange(2, 6))),
        lambda: " ".join(d(rng, rng.randrange(1, 5)) for _ in range(rng.randrange(3, 12))),
        lambda: f"{d(rng, 2)}.{d(rng, 6)}, {d(rng, 2)}.{d(rng, 6)}",
        lambda: f"{rng.choice(names)} at {rng.choice(names)}.{rng.choice(('com', 'org', 'net', 'de'))}",
        lambda: f"{d(rng, rng.randrange(1, 4))} @ {d(rng, rng.randrange(1, 3))}.{d(rng, 2)}",
        lambda: f"{rng.choice(names)} @ {rng.choice(names)}.{rng.choice(names).title()}",
        lambda: f"{rng.choice(names)} at {rng.choice(names)} {rng.choice(names)}.{rng.choice(names)}",
        lambda: f"@{rng.choice(names)} {rng.choice(names)} @ {rng.choice(names)}, {rng.choice(names)}.",
        lambda: f"{rng.choice(names)}::{rng.choice(names)} {rng.randrange(24)}:{rng.randrange(60)}:{rng.randrange(60)}",
        lambda: ":".join(f"{rng.randrange(256):02x}" for _ in range(6)),
        lambda: f"{rng.choice(names)} = \"{''.join(rng.choice('0123456789abcdef') for _ in range(40))}\"",
        lambda: f"http://{rng.choice(names)}.org/{d(rng, 9)}/{d(rng, 4)}-{d(rng, 4)}-{d(rng, 4)}.html",
        lambda: f"{d(rng, 4)} {rng.choice('xXkK')} {d(rng, 4)}, {d(rng, 4)} {d(rng, 4)}",
        lambda: "\n".join("  ".join(d(rng, rng.randrange(1, 6)) for _ in range(3)) for _ in range(4)),
    ))()


def composed_line(rng: random.Random, words: list[str], names: list[str]) -> tuple[str, set[tuple[str, int, int]]]:
    """A line of words around one piece of personal data or something alike, and its true span."""
    kind = rng.choice((*KINDS, None, None, None))
    item = {
        "email": lambda: _email(rng, names),
        "ip": lambda: _ip(rng),
        "card": lambda: _payment(rng),
        "phone": lambda: _phone(rng),
        None: lambda: _decoy(rng, names),
    }[kind]()
    left = [rng.choice(words) for _ in range(rng.randrange(7))]
    if rng.random() < 0.4:
        cue = rng.choice(CUES[kind or "other"].split())
        left.append(rng.choice((cue, cue.title(), cue.upper())) + rng.choice((":", "", ".", " no", "=")))
    right = [rng.choice(words) for _ in range(rng.randrange(7))]
    lead = " ".join(left) + (rng.choice((" ", " ", " ", "\n", ": ", " | ", " (", ", ")) if left else "")
    tail = (rng.choice((" ", " ", ". ", ", ", "\n", " | ", "!! ", "%%% ", "; ", ") ")) if right else rng.choice((".", ""))) + " ".join(right)
    spans = {(kind, len(lead), len(lead) + len(item))} if kind else set()
    return lead + item + tail, spans


def train(words: list[str], lines: int = TRAIN_LINES, seed: int = 12) -> Finder:
    """A finder trained on lines composed from ``words``; without any, from a few letters."""
    words = words or ["word"]
    names = sorted({w.strip(".,;:!?").lower() for w in words if w.isascii()} - {""})
    names = [n for n in names if n.isalnum()] or ["name"]
    rng = random.Random(seed)
    rows, labels, kinds, held = [], [], [], []
    for number in range(lines):
        text, true = composed_line(rng, words, names)
        for kind, start, end, _ in candidates(text):
            rows.append(features(text, kind, start, end))
            labels.append((kind, start, end) in true)
            kinds.append(kind)
            held.append(number % CALIBRATION_SHARE == 0)
    x, y, held = np.array(rows, float), np.array(labels, float), np.array(held)
    forest = boost(x[~held], y[~held])
    scores = forest.log_odds(x)
    slopes, thresholds = {}, {}
    for kind in KINDS:
        own = held & (np.array(kinds) == kind)
        slopes[kind] = platt(scores[own], y[own])
        slope, offset = slopes[kind]
        thresholds[kind] = threshold(_sigmoid(slope * scores[own] + offset), y[own])
    return Finder(forest, slopes, thresholds)


def platt(scores: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset that make scores log odds, by Newton's method on smoothed labels."""
    positive, negative = labels.sum(), len(labels) - labels.sum()
    target = np.where(labels > 0, (positive + 1) / (positive + 2), 1 / (negative + 2))
    x = np.column_stack([scores, np.ones(len(scores))])
    weights = np.array([1.0, 0.0])
    for _ in range(50):
        p = _sigmoid(x @ weights)
        slope = x.T @ (target - p) - 1e-3 * (weights - [1, 0])
        curve = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(curve, slope)
        weights += np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-6:
            break
    return float(weights[0]), float(weights[1])


def threshold(p: np.ndarray, labels: np.ndarray, precision: float = PRECISION) -> float:
    """The least probability that keeps the wanted precision; two (nothing) if none does."""
    order = np.argsort(-p, kind="stable")
    right = labels[order].cumsum() / np.arange(1, len(p) + 1)
    # Only after the last of equal probabilities.
    last = np.append(p[order][1:] != p[order][:-1], True) if len(p) else np.array([], bool)
    good = np.flatnonzero((right >= precision) & last)
    return max(LEAST_PROBABILITY, float(p[order][good[-1]])) if len(good) else 2.0


def sample_words(docs: DataFrame, count: int = SAMPLE_DOCUMENTS) -> list[str]:
    """Words of a bounded sample: the first ``count`` texts by a hash, a middle piece of long ones."""
    marked = docs.where("text IS NOT NULL").select("text", F.xxhash64("text").alias("order"))
    # Only numbers go through the choice; texts come to the driver once they are chosen.
    first = [r.order for r in marked.select("order").distinct().orderBy("order").limit(count).collect()]
    start = F.greatest(F.lit(1), (F.length("text") - SAMPLE_CHARACTERS) / 2).cast("int")
    piece = F.substring(F.col("text"), start, F.lit(SAMPLE_CHARACTERS))
    chosen = marked.where(F.col("order").isin(first)).groupBy("order").agg(F.min(piece).alias("piece"))
    rows = sorted(chosen.collect(), key=lambda row: row.order)
    return [w for row in rows for w in row.piece.split() if not any(map(str.isdigit, w)) and "@" not in w]


# Characters of texts whose candidates are scored together.
GROUP_CHARACTERS = 1 << 20
SPAN = "struct<kind:string,start:bigint,end:bigint,strict:boolean,probability:double>"


def _grouped(texts: list[str]) -> Iterator[list[str]]:
    group, size = [], 0
    for text in texts:
        if group and size + len(text) > GROUP_CHARACTERS:
            yield group
            group, size = [], 0
        group.append(text)
        size += len(text)
    if group:
        yield group


_SPANS = pa.list_(
    pa.struct([
        ("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("strict", pa.bool_()), ("probability", pa.float64()),
    ])
)


def _find(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    finder = shared.value
    fields = [f.name for f in _SPANS.value_type]
    for batch in batches:
        texts = [text or "" for text in batch.column("_text").to_pylist()]
        found = [[dict(zip(fields, span)) for span in spans] for group in _grouped(texts) for spans in finder.spans(group)]
        kept = [(n, batch.column(n)) for n in batch.schema.names if n != "_text"]
        columns = [*(c for _, c in kept), pa.array(found, _SPANS)]
        yield pa.record_batch(columns, [*(n for n, _ in kept), "_spans"])


def find(docs: DataFrame, finder: Finder, keep: Iterable[str] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of every row of ``docs(text, ...)`` and ``_spans``, its personal data.

    Spans have ``kind, start, end`` (code points, the end exclusive), ``strict`` (a match of the strict
    patterns, which always stay) and the calibrated ``probability``; they are ordered by kind as in
    ``KINDS``, then start. A NULL or empty text has none. Equal rows have equal spans. Whole texts are
    searched, each on its own.
    """
    shared = docs.sparkSession.sparkContext.broadcast(finder)
    rows = docs.select(*keep, F.col("text").alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return rows.mapInArrow(lambda batches: _find(batches, shared), f"{kinds}, _spans array<{SPAN}>")


def redacted(text: str, spans: Iterable[tuple[str, int, int]]) -> str:
    """A text with its personal data replaced by the kind in brackets; spans that overlap become one."""
    parts, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], s[2])):
        if start >= at:
            parts += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join(parts) + text[at:]
