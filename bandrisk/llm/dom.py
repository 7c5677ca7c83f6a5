"""A small document tree of a web page: elements, their attributes' words, and blocks of text."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import unescape

# The last five are of formulas.
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr"
    " mspace mprescripts none mglyph malignmark".split()
)
# Their content is no text. Annotations repeat a formula in another notation and are not shown.
OPAQUE = frozenset(
    "script style noscript template textarea title iframe svg object canvas select head annotation annotation-xml".split()
)
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small"
    " span strike strong sub sup time tt u var wbr button input"
    " math semantics mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom mfenced menclose"
    " msub msup msubsup munder mover munderover mmultiscripts mprescripts none mtable mtr mlabeledtr mtd maction mglyph"
    " maligngroup malignmark mstack mlongdiv msgroup msrow mscarries mscarry msline".split()
)
# Opening one of these ends an open element of the second column, up to one of the third.
_CLOSES = {
    "li": ("li", "ul ol menu"),
    "dt": ("dt dd", "dl"),
    "dd": ("dt dd", "dl"),
    "tr": ("tr td th", "table"),
    "td": ("td th", "tr table"),
    "th": ("td th", "tr table"),
    "thead": ("thead tbody tfoot tr td th", "table"),
    "tbody": ("thead tbody tfoot tr td th", "table"),
    "tfoot": ("thead tbody tfoot tr td th", "table"),
}
CLOSES = {name: (frozenset(ends.split()), frozenset(stop.split())) for name, (ends, stop) in _CLOSES.items()}
_STOPS_P = frozenset("table td th button object caption".split())

# A tag whose quoted values are short ends in the pattern; any other is scanned by ``_Ends``.
_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*+)(?:([^>"']{0,999}+(?:(?:"[^"]{0,999}"|'[^']{0,999}')[^>"']{0,999}+){0,30}+)>)?+""",
    re.S,
)
_SPECIAL = re.compile("[>\"']")
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_TOKENS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
NAMING = frozenset("class id role aria-label itemprop name data-testid data-component".split())


@dataclass
class Element:
    """One element; ``blocks`` are the numbers of the text blocks directly in it."""

    tag: str
    parent: int
    depth: int
    tokens: tuple[str, ...] = ()
    hidden: bool = False
    marked: bool = False
    children: list[int] = field(default_factory=list)
    blocks: list[int] = field(default_factory=list)
    begin: int = 0


@dataclass
class Block:
    """Text between two block-level boundaries, with its owner and the characters of it in links."""

    owner: int
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""


class _Ends:
    """Where the tags of a page end: at the first ">" outside quotes, or the first one if a quote has no end.

    Quotes that are known to lead to no end are remembered, so that many open ones take no longer.
    """

    def __init__(self, html: str):
        self._html = html
        self._dead: set[int] = set()
        # From each of these places on there is no further quote of the kind.
        self._last = {'"': len(html), "'": len(html)}
        self._special = (0, -1)

    def _next(self, at: int) -> int:
        """The next quote or ">" from a place on, or -1."""
        begin, found = self._special
        if not (begin <= at and (found >= at or found < 0 < begin)):
            match = _SPECIAL.search(self._html, at)
            found = match.start() if match else -1
            self._special = (max(at, 1), found)
        return found

    def __call__(self, at: int) -> int:
        """The place of the ">" of the tag whose name ends at ``at``, or -1."""
        html, seen, look = self._html, [], at
        while True:
            place = self._next(look)
            if place >= 0 and html[place] == ">":
                return place
            if place < 0 or place in self._dead:
                break
            seen.append(place)
            kind = html[place]
            close = html.find(kind, place + 1) if place < self._last[kind] else -1
            if close < 0:
                self._last[kind] = min(self._last[kind], place)
                break
            look = close + 1
        self._dead.update(seen)
        return html.find(">", at)


class Page:
    """The tree of a page. Element 0 is the root; elements and blocks are in page order."""

    def __init__(self, html: str):
        self.elements = [Element("#root", -1, 0)]
        self.blocks: list[Block] = []
        self._stack = [0]
        # Places in the stack of the open elements of a tag, and of the block-level ones, outermost first.
        self._places: dict[str, list[int]] = {}
        self._block_places = [0]
        # Tags that are known to have no closing one any more.
        self._unclosed: set[str] = set()
        self._block: Block | None = None
        self._links = 0
        self._parse(html)
        for block in self.blocks:
            block.text = " ".join("".join(block.parts).split())
        for number, block in enumerate(self.blocks):
            if block.text:
                self.elements[block.owner].blocks.append(number)

    def _owner(self) -> int:
        """The innermost open block-level element."""
        return self._stack[self._block_places[-1]]

    def _add_text(self, text: str) -> None:
        if self._block is None:
            if not text or text.isspace():
                return
            self._block = Block(self._owner())
            self.blocks.append(self._block)
        self._block.parts.append(text)
        if self._links:
            self._block.linked += len(text)

    def _push(self, number: int) -> None:
        tag, place = self.elements[number].tag, len(self._stack)
        self._stack.append(number)
        self._places.setdefault(tag, []).append(place)
        if tag not in INLINE:
            self._block_places.append(place)
        self._links += tag == "a"

    def _pop_to(self, place: int) -> None:
        for number in self._stack[place:]:
            tag = self.elements[number].tag
            self._places[tag].pop()
            self._links -= tag == "a"
        while self._block_places[-1] >= place:
            self._block_places.pop()
        del self._stack[place:]

    def _innermost(self, tags: frozenset) -> int:
        """The place of the innermost open element of one of the tags, or 0."""
        return max((places[-1] for tag in tags if (places := self._places.get(tag))), default=0)

    def _close_open(self, ends: frozenset, stops: frozenset) -> None:
        stop = self._innermost(stops)
        # Outer ones too: a new row ends its predecessor's cell and the row itself.
        while (place := self._innermost(ends)) > stop:
            self._pop_to(place)

    def _open(self, tag: str, attributes: str) -> None:
        if tag not in INLINE:
            self._block = None
            self._close_open(frozenset(("p",)), _STOPS_P)
        if tag in CLOSES:
            self._close_open(*CLOSES[tag])
        elif tag == "a" and self._links:
            self._close_open(frozenset(("a",)), _STOPS_P)
        parent = self._stack[-1]
        element = Element(tag, parent, len(self._stack), begin=len(self.blocks))
        if attributes.strip():
            tokens = []
            for found in _ATTRIBUTE.finditer(attributes):
                name = found[1].lower()
                value = found[2] or found[3] or found[4] or ""
                if name in NAMING:
                    tokens += [t.lower() for t in _TOKENS.findall(value)]
                elif name == "hidden" or (name == "aria-hidden" and value == "true"):
                    element.hidden = True
                elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                    element.hidden = True
                elif name == "data-training-mark":
                    element.marked = True
            element.tokens = tuple(tokens)
        self.elements.append(element)
        self.elements[parent].children.append(len(self.elements) - 1)
        if tag == "br":
            self._add_text(" ")
        if tag not in VOID:
            self._push(len(self.elements) - 1)

    def _close(self, tag: str) -> None:
        if tag not in INLINE:
            self._block = None
        place = self._innermost(frozenset((tag,)))
        # An inline element does not end the block-level ones within it.
        if place and not (tag in INLINE and self._block_places[-1] > place):
            self._pop_to(place)

    def _parse(self, html: str) -> None:
        at, end, ends = 0, len(html), _Ends(html)
        while at < end:
            found = _TOKEN.search(html, at)
            if found is None:
                self._add_text(unescape(html[at:]))
                return
            name, attributes, after = found[2], found[3], found.end()
            if name is not None and attributes is None:
                over = ends(after)
                if over < 0:
                    # No tag ends from here on; only a comment without an end can follow.
                    comment = html.find("<!--", found.start())
                    self._add_text(unescape(html[at : comment if comment >= 0 else end]))
                    return
                attributes, after = html[found.end() : over], over + 1
            if found.start() > at:
                self._add_text(unescape(html[at : found.start()]))
            at = after
            if name is None:
                continue
            tag = name.lower()
            if found[1]:
                self._close(tag)
                continue
            if tag in OPAQUE:
                if tag not in ("head", "svg", "object", "canvas", "annotation", "annotation-xml") or not attributes.rstrip().endswith("/"):
                    closing = re.compile(rf"</{re.escape(tag)}\s*>" + (r"|<body\b" if tag == "head" else ""), re.I)
                    over = None if tag in self._unclosed else closing.search(html, at)
                    if over is None:
                        self._unclosed.add(tag)
                        at = end if tag in ("script", "style", "title", "textarea") else at
                    else:
                        at = over.start() if over[0].lower().startswith("<body") else over.end()
                continue
            self._open(tag, attributes)
