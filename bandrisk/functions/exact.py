"""Sums of doubles that lose nothing and do not depend on their order.

A number is a whole multiple of a power of two. ``split`` gives each number such a power, its *bin*,
and the multiple in three small parts; sums of parts by bin are whole numbers, so they are exact and
the same in any order, in any partitioning, and however often partial sums are merged. ``joined`` adds
up the few bins of a group, the largest first, keeping what each addition rounds off. NaN and the two
infinities have bins of their own, in which they are counted.

All of it is SQL expressions over columns.
"""

from __future__ import annotations

BIN = "_bin"
PARTS = ("_top", "_middle", "_low")
# Bits between bins, and of a part: a multiple has up to 60 bits, so 2**43 rows of a group and bin fit a sum.
STEP, PART = 4, 20
PLUS, MINUS, NAN = 1000, 1001, 1002
# Sums by bin.
TYPE = "decimal(38,0)"


def _scaled(value: str, power: str) -> str:
    """``value * 2**power`` in two steps, neither of which is beyond a double."""
    half = f"floor(({power}) / 2)"
    return f"({value} * pow(2D, {half}) * pow(2D, ({power}) - {half}))"


def split(measure: str) -> list[dict[str, str]]:
    """Columns to add one after the other: the bin of a double and the parts of its multiple; no parts for NULL."""
    x = f"cast(`{measure}` as double)"
    infinite = "double('infinity')"
    # The logarithm may be off by one where a power of two is near; a bin leaves room for that.
    place = f"cast(floor((floor(log2(if({x} = 0D or {x} is null, 1D, abs({x})))) - 54) / {STEP}) as int)"
    special = f"isnan({x}) or abs({x}) = {infinite}"
    return [
        {
            BIN: f"""case when isnan({x}) then {NAN} when {x} = {infinite} then {PLUS}
                when {x} = -{infinite} then {MINUS} else {place} end"""
        },
        {"_times": f"case when {special} then 1L else cast({_scaled(x, f'-{STEP} * {BIN}')} as bigint) end"},
        {
            "_top": f"shiftright(_times, {2 * PART})",
            "_middle": f"shiftright(_times, {PART}) & {(1 << PART) - 1}L",
            "_low": f"_times & {(1 << PART) - 1}L",
        },
    ]


def summed(condition: str | None = None) -> str:
    """The sum by bin of the parts of rows that fulfil ``condition``, as one whole number; NULL without any."""
    return _whole(
        *(f"sum({part})" if condition is None else f"sum(case when {condition} then {part} end)" for part in PARTS)
    )


def apart(name: str) -> list[str]:
    """The columns of a sum by bin whose parts are kept apart: numbers that are added faster."""
    return [f"{name}{part}" for part in PARTS]


def together(name: str) -> str:
    """The sum by bin that columns ``apart`` make up, as one whole number."""
    return _whole(*(f"`{c}`" for c in apart(name)))


def _whole(*parts: str) -> str:
    top, middle, low = (f"cast({part} as {TYPE})" for part in parts)
    size = f"cast({1 << PART} as decimal(7,0))"
    return f"cast(({top} * {size} + {middle}) * {size} + {low} as {TYPE})"


def merged(name: str) -> str:
    """The sum of sums by bin."""
    return f"cast(sum(`{name}`) as {TYPE})"


def gathered(names: list[str]) -> str:
    """An aggregate over the bins of a group: sums of ``names`` by bin, the largest bin first. There are few bins."""
    return f"sort_array(collect_list(named_struct('bin', `{BIN}`, 'sums', array({', '.join(f'`{n}`' for n in names)}))), false)"


def joined(bins: str, count: int) -> str:
    """The ``count`` doubles that ``gathered`` bins add up to, as an array; zero where there is nothing."""

    def holds(kind: int) -> str:
        return f"exists({bins}, e -> e.bin = {kind} and coalesce(e.sums[i], 0) > 0)"

    # A sum by bin is two doubles: its upper bits and its lower 53.
    cut = "cast(9007199254740992 as decimal(16,0))"
    value = "coalesce(e.sums[i], cast(0 as decimal(38,0)))"
    terms = f"""flatten(transform(filter({bins}, e -> e.bin < {PLUS}), e -> array(
        {_scaled(f"cast(cast({value} div {cut} as bigint) as double)", f"{STEP} * e.bin + 53")},
        {_scaled(f"cast({value} % {cut} as double)", f"{STEP} * e.bin")})))"""
    # What an addition rounds off is added to the rest; the larger number comes first, but for cancelled ones.
    lost = "if(abs(a.s) >= abs(t), (a.s - (a.s + t)) + t, (t - (a.s + t)) + a.s)"
    total = f"""aggregate({terms}, named_struct('s', 0D, 'c', 0D),
        (a, t) -> named_struct('s', a.s + t, 'c', a.c + {lost}), a -> a.s + if(isnan(a.c), 0D, a.c))"""
    return f"""transform(sequence(0, {count - 1}), i -> case
        when {holds(NAN)} or ({holds(PLUS)} and {holds(MINUS)}) then double('NaN')
        when {holds(PLUS)} then double('infinity') when {holds(MINUS)} then double('-infinity')
        else {total} end)"""
