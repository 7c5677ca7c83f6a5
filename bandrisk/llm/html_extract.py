"""Main text of web pages by boosted trees over document nodes and a decoding of the whole tree.

Every block-level element is a node. Trees score whether a node holds any main text, from its own
tag and attribute words, those of the elements around it, how dense its subtree is in text, links
and tags, its depth, its siblings and its place on the page. The labels of a page are then decoded
together: a node cannot be main text below one that is not, so the best consistent labelling of the
tree is found from the leaves up.

The trees are trained on pages that are composed from a sample of the input's words: articles with
the furniture around them that sites use, in many markups, so each node's label is known.
"""

from __future__ import annotations

import html as markup
from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandrisk.llm.dom import INLINE, Page
from bandrisk.llm.trees import Forest, boost

# Pages whose words fill the training pages, the characters of those that are used, and training pages.
SAMPLE_PAGES = 100
SAMPLE_CHARACTERS = 40_000
TRAIN_PAGES = 500
# Characters of markup whose nodes are scored together.
GROUP_CHARACTERS = 1 << 19

# Words of attributes that tell what an element is for.
GROUPS = {
    "main": "article content main post entry body story text prose blog headline title lead paragraph maincontent",
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs pager pagination tabs toolbar sitemap toc links",
    "header": "header masthead topbar banner logo brand hero branding site",
    "footer": "footer foot colophon copyright legal credits bottom imprint contentinfo",
    "side": "side sidebar aside rail widget widgets related recommended recommendations trending popular teaser"
    " teasers tags more complementary archive recent readmore promo",
    "advert": "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors dfp taboola outbrain"
    " adsense promoted commercial affiliate",
    "notice": "cookie cookies consent gdpr notice notices alert alerts modal popup overlay newsletter subscribe"
    " subscription signup paywall disclaimer warning toast dialog privacy announcement",
    "social": "share sharing social follow like likes tweet facebook twitter whatsapp",
    "comment": "comment comments reply replies respond discussion disqus thread feedback review reviews commenter"
    " commentlist guestbook",
    "form": "form search login signin input field captcha register contact button btn",
}
_GROUP_OF = {word: n for n, words in enumerate(GROUPS.values()) for word in words.split()}
TAGS = (
    "p h1 h2 h3 h4 h5 h6 ul ol li dl div section article main nav header footer aside form table tr td th blockquote"
    " pre figure figcaption body html details fieldset address hr"
).split()
_TAG_AT = {tag: n for n, tag in enumerate(TAGS)}
_BAD_TAGS = frozenset("nav header footer aside form dialog menu".split())
_SENTENCE_ENDS = str.maketrans("", "", ".!?,;:")


def _nodes(page: Page) -> list[int]:
    return [n for n, e in enumerate(page.elements) if e.tag not in INLINE]


def _ratio(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return np.divide(part, whole, out=np.zeros(len(part)), where=whole > 0)


def node_features(page: Page) -> tuple[list[int], np.ndarray]:
    """The block-level elements of a page and a row of features for each."""
    elements, blocks = page.elements, page.blocks
    total = len(elements)
    # Of the subtree: characters, those in links, sentence marks, words, texts, elements, paragraphs; and the longest text.
    sums = [[0.0] * 7 for _ in range(total)]
    longest = [0.0] * total
    own_text = [0.0] * total
    groups = np.zeros((total, len(GROUPS)), bool)
    above = np.zeros((total, len(GROUPS)), bool)
    within = [[False] * 3 for _ in range(total)]  # article or main, furniture, hidden
    place, crowd, before, after = [0.0] * total, [1.0] * total, [-1.0] * total, [-1.0] * total
    for n, e in enumerate(elements):
        mine = sums[n]
        mine[5], mine[6] = 1.0, float(e.tag == "p")
        for b in e.blocks:
            text = blocks[b].text
            length = len(text)
            mine[0] += length
            mine[1] += min(length, blocks[b].linked)
            mine[2] += length - len(text.translate(_SENTENCE_ENDS))
            mine[3] += text.count(" ") + 1
            mine[4] += 1
            longest[n] = max(longest[n], length)
        own_text[n] = mine[0]
        for token in e.tokens:
            group = _GROUP_OF.get(token)
            if group is not None:
                groups[n, group] = True
        inside = within[n]
        if e.parent >= 0:
            above[n] = above[e.parent] | groups[e.parent]
            inside[:] = within[e.parent]
        inside[0] |= e.tag in ("article", "main")
        inside[1] |= e.tag in _BAD_TAGS
        inside[2] |= e.hidden
    for n in range(total - 1, 0, -1):
        up = sums[elements[n].parent]
        for k, value in enumerate(sums[n]):
            up[k] += value
        longest[elements[n].parent] = max(longest[elements[n].parent], longest[n])
    for e in elements:
        last = len(e.children) - 1
        for at, child in enumerate(e.children):
            place[child], crowd[child] = at, last + 1
            if at:
                before[child] = sums[e.children[at - 1]][0]
            if at < last:
                after[child] = sums[e.children[at + 1]][0]
    nodes = _nodes(page)
    pick = np.array(nodes)
    parents = np.array([max(0, e.parent) for e in elements])[pick]
    tags = np.array([_TAG_AT.get(e.tag, -1) for e in elements])
    every = np.array(sums)
    text, linked, marks, words, texts, size, paragraphs = every[pick].T
    up_text, up_linked = every[parents, 0], every[parents, 1]
    around = np.where(pick > 0, up_text - text, 0.0)
    begin = np.array([e.begin for e in elements], float)[pick]
    all_blocks = max(len(blocks), 1)
    one_hot = (tags[pick][:, None] == np.arange(len(TAGS))[None, :]).astype(float)
    place, crowd = np.array(place)[pick], np.array(crowd)[pick]
    numbers = [
        np.log1p(text),
        np.log1p(np.array(own_text)[pick]),
        text / max(every[0, 0], 1.0),
        _ratio(linked, text),
        np.log1p(size),
        text / size,
        _ratio(marks, text),
        _ratio(text, words),
        np.log1p(np.array(longest)[pick]),
        _ratio(text, texts),
        np.log1p(paragraphs),
        paragraphs / size,
        np.array([e.depth for e in elements], float)[pick],
        place,
        place / crowd,
        crowd,
        np.array([len(e.children) for e in elements], float)[pick],
        np.log1p(around),
        _ratio(text, text + around),
        np.array(before)[pick],
        np.array(after)[pick],
        begin / all_blocks,
        (all_blocks - begin - texts) / all_blocks,
        *np.array(within, float)[pick].T,
        _ratio(up_linked, up_text),
        tags[parents].astype(float),
        np.array([len(e.tokens) for e in elements], float)[pick],
        texts,
    ]
    return nodes, np.column_stack([one_hot, groups[pick], above[pick], *numbers])


def decode(page: Page, nodes: list[int], log_odds: np.ndarray) -> np.ndarray:
    """For every element whether it is main text: the most likely labels without a main node below another kind.

    Log-likelihoods add up over nodes, so what counts is the sum of log odds of the main ones: a
    node is worth its own log odds and what its children are worth, and is dropped below nothing.
    """
    elements = page.elements
    worth = np.zeros(len(elements))
    worth[nodes] = log_odds
    for n in range(len(elements) - 1, 0, -1):
        if worth[n] > 0:
            worth[elements[n].parent] += worth[n]
    main = np.zeros(len(elements), bool)
    for n, e in enumerate(elements):
        main[n] = worth[n] > 0 and (e.parent < 0 or main[e.parent])
    return main


def main_texts(pages: Sequence[str], forest: Forest) -> list[str]:
    """The main text of each page, a line per block. The trees run once over the nodes of all of them."""
    parsed = [Page(html) for html in pages]
    found = [node_features(page) for page in parsed]
    odds = forest.log_odds(np.concatenate([rows for _, rows in found])) if found else np.zeros(0)
    texts, at = [], 0
    for page, (nodes, _) in zip(parsed, found):
        main = decode(page, nodes, odds[at : at + len(nodes)])
        at += len(nodes)
        texts.append("\n".join(b.text for b in page.blocks if b.text and main[b.owner]))
    return texts


class _Composer:
    """Training pages; elements that hold main text are marked."""

    def __init__(self, words: Sequence[str], seed: int):
        self.words = words
        self.rng = np.random.default_rng(seed)

    def chance(self, p: float) -> bool:
        return bool(self.rng.random() < p)

    def pick(self, *options):
        return options[int(self.rng.integers(len(options)))]

    def some(self, least: int, most: int) -> int:
        return int(self.rng.integers(least, most + 1))

    def phrase(self, least: int, most: int, end: str = "") -> str:
        start = int(self.rng.integers(len(self.words)))
        taken = [self.words[(start + n) % len(self.words)] for n in range(self.some(least, most))]
        return markup.escape(" ".join(taken), quote=False) + end

    def prose(self, least: int, most: int) -> str:
        sentences = [self.phrase(4, 18, self.pick(".", ".", ".", "!", "?")) for _ in range(self.some(least, most))]
        if self.chance(0.2):
            place = self.some(0, len(sentences) - 1)
            tag = self.pick("b", "em", 'a href="/x"', "strong", "span")
            sentences[place] = f"<{tag}>{sentences[place]}" + (f"</{tag.split()[0]}>" if self.chance(0.8) else "")
        return self.pick(" ", " ", "<br>").join(sentences)

    def named(self, group: str | None, tag: str | None = None) -> str:
        """An opening tag that names its purpose by tag, words or not at all; and its closing tag's name."""
        semantic = {"menu": "nav", "header": "header", "footer": "footer", "side": "aside", "main": "article", "form": "form"}
        if tag is None:
            tag = semantic[group] if group in semantic and self.chance(0.45) else self.pick("div", "div", "section")
        tokens = []
        if group and (tag in ("div", "section", "ul") or self.chance(0.4)):
            vocabulary = GROUPS[group].split()
            tokens = [self.pick(*vocabulary) for _ in range(self.some(1, 2))]
        if self.chance(0.25):
            tokens.append(self.pick("wrap", "inner", "box", "col", "row", "container", "block", "item", "clearfix"))
        if not tokens:
            return tag
        return f'{tag} {self.pick("class", "class", "id")}="{self.pick(" ", "-", "_").join(tokens)}"'

    def wrap(self, opening: str, inside: str) -> str:
        return f"<{opening}>{inside}</{opening.split()[0]}>"

    def links(self) -> str:
        entries = [f'<a href="/{n}">{self.phrase(1, 4)}</a>' for n in range(self.some(3, 9))]
        if self.chance(0.7):
            return self.wrap(self.pick("ul", "ul", "ol"), "".join(f"<li>{e}</li>" for e in entries))
        return self.pick(" | ", " ", "").join(entries)

    def furniture(self, group: str) -> str:
        """A piece of the page that is no main text."""
        if group == "menu":
            inside = self.links()
        elif group == "header":
            inside = self.pick(f"<h1>{self.phrase(1, 4)}</h1>", f'<a href="/">{self.phrase(1, 3)}</a>') + self.pick("", f"<p>{self.phrase(3, 9)}</p>", self.links())
        elif group == "footer":
            inside = self.pick("&copy; ", "&copy; 2024 ", "") + self.phrase(3, 14, self.pick("", ".")) + self.pick("", self.links())
            inside = self.pick(inside, f"<p>{inside}</p>")
        elif group == "side":
            head = self.pick("h2", "h3", "h4")
            body = self.pick(self.links(), f"<p>{self.phrase(8, 30, '.')}</p>", self.prose(1, 3))
            inside = self.pick("", f"<{head}>{self.phrase(1, 4)}</{head}>") + body
        elif group == "advert":
            inside = self.pick(self.phrase(4, 25, "."), f"<p>{self.prose(1, 2)}</p>", f'<a href="http://a">{self.phrase(3, 10)}</a>')
        elif group == "notice":
            inside = self.pick("<p>{}</p>", "{}").format(self.prose(1, 3)) + self.pick("", "<button>OK</button>")
        elif group == "social":
            inside = self.links()
        elif group == "comment":
            notes = []
            for _ in range(self.some(1, 6)):
                name = self.pick("<b>{}</b>", "<h4>{}</h4>", "<span>{}</span>").format(self.phrase(1, 2))
                notes.append(self.wrap(self.pick("div", "li", "div class=\"comment\"", "article class=\"comment\""), f"{name}<p>{self.prose(1, 4)}</p>"))
            inside = self.pick("", f"<h3>{self.phrase(1, 3)}</h3>") + "".join(notes)
        else:
            inside = f'<label>{self.phrase(1, 3)}</label><input name="q"><button>{self.phrase(1, 2)}</button>' + self.pick("", f"<p>{self.phrase(4, 12)}</p>")
        return self.wrap(self.named(group), inside)

    def article(self) -> str:
        mark = " data-training-mark"
        parts = []
        if self.chance(0.9):
            head = self.pick("h1", "h1", "h2")
            parts.append(f"<{head}{mark}>{self.phrase(2, 12)}</{head}>")
        for _ in range(self.some(1, 14)):
            kind = self.rng.random()
            if kind < 0.72:
                closing = "</p>" if self.chance(0.85) else ""
                text = self.prose(1, self.pick(1, 2, 6, 14))
                text = f"<b>{text}<br>" if self.chance(0.08) else text
                parts.append(f"<p{mark}>{text}{closing}")
            elif kind < 0.78:
                parts.append(f"<div{mark}>{self.prose(1, 8)}</div>")
            elif kind < 0.84:
                head = self.pick("h2", "h3")
                parts.append(f"<{head}{mark}>{self.phrase(1, 8)}</{head}>")
            elif kind < 0.90:
                entries = "".join(f"<li{mark}>{self.phrase(2, 20, '.')}</li>" for _ in range(self.some(2, 6)))
                parts.append(self.wrap(self.pick("ul", "ol"), entries))
            elif kind < 0.93:
                parts.append(f"<blockquote><p{mark}>{self.prose(1, 3)}</p></blockquote>")
            elif kind < 0.96:
                rows = "".join(f"<tr><td{mark}>{self.phrase(1, 4)}</td><td{mark}>{self.phrase(1, 4)}</td></tr>" for _ in range(self.some(1, 4)))
                parts.append(f"<table>{rows}</table>")
            else:
                parts.append(f'<figure><img src="x"><figcaption{mark}>{self.phrase(2, 12)}</figcaption></figure>')
        for _ in range(self.pick(0, 0, 1, 2)):
            parts.insert(self.some(0, len(parts)), self.furniture(self.pick("advert", "social", "side", "notice")))
        return self.wrap(self.named("main" if self.chance(0.85) else None), "".join(parts))

    def page(self) -> str:
        before = [g for g in ("notice", "header", "menu", "form", "advert", "side") if self.chance(0.45)]
        after = [g for g in ("social", "side", "advert", "comment", "form", "notice", "menu") if self.chance(0.4)]
        self.rng.shuffle(before)
        self.rng.shuffle(after)
        middle = "".join(map(self.furniture, before)) + self.article() + "".join(map(self.furniture, after))
        for _ in range(self.pick(0, 1, 2)):
            middle = self.wrap(self.named(self.pick(None, "main")), middle)
        top = self.furniture("header") if self.chance(0.3) else ""
        end = self.furniture("footer") if self.chance(0.85) else ""
        return f"<html><head><title>{self.phrase(1, 5)}</title></head><body>{top}{middle}{end}</body></html>"


def _labels(page: Page, nodes: list[int]) -> np.ndarray:
    """A node is main if it, or any below, is marked."""
    main = np.array([e.marked for e in page.elements], float)
    for n in range(len(page.elements) - 1, 0, -1):
        up = page.elements[n].parent
        main[up] = max(main[up], main[n])
    return main[nodes]


def train(words: Sequence[str], pages: int = TRAIN_PAGES, seed: int = 5) -> Forest:
    """Trees from pages composed of these words."""
    composer = _Composer(words or "words to fill a page that has none of its own".split(), seed)
    rows, labels = [], []
    for _ in range(pages):
        page = Page(composer.page())
        nodes, features = node_features(page)
        rows.append(features)
        labels.append(_labels(page, nodes))
    return boost(np.concatenate(rows), np.concatenate(labels))


def sample_words(pages: DataFrame, count: int = SAMPLE_PAGES) -> list[str]:
    """Words of a bounded sample: the first ``count`` pages by a hash of their markup, a middle piece of long ones."""
    marked = pages.where("html IS NOT NULL").withColumn("order", F.xxhash64("html"))
    # Only numbers go through the choice; markup comes to the driver once it is chosen.
    first = [r.order for r in marked.select("order").distinct().orderBy("order").limit(count).collect()]
    start = F.greatest(F.lit(1), (F.length("html") - SAMPLE_CHARACTERS) / 2).cast("int")
    piece = F.substring(F.col("html"), start, F.lit(SAMPLE_CHARACTERS))
    chosen = marked.where(F.col("order").isin(first)).groupBy("order").agg(F.min(piece).alias("piece"))
    rows = sorted(chosen.collect(), key=lambda row: row.order)
    return [w for row in rows for b in Page(row.piece).blocks for w in b.text.split()]


def _groups(pages: list[str]) -> Iterator[list[str]]:
    """Pages in runs of a bounded number of characters, or one page."""
    group, size = [], 0
    for page in pages:
        if group and size + len(page) > GROUP_CHARACTERS:
            yield group
            group, size = [], 0
        group.append(page)
        size += len(page)
    if group:
        yield group


def _extract(batches, shared) -> Iterator[pa.RecordBatch]:
    forest = shared.value
    for batch in batches:
        pages = [html or "" for html in batch.column("_html").to_pylist()]
        texts = [t for group in _groups(pages) for t in main_texts(group, forest)]
        names = [c for c in batch.schema.names if c != "_html"]
        kept = [batch.column(c) for c in names]
        sizes = pa.array([len(t) for t in texts], pa.int64())
        yield pa.record_batch([*kept, pa.array(texts, pa.string()), sizes], [*names, "text", "n_chars"])


def extract(pages: DataFrame, forest: Forest) -> DataFrame:
    """The rows of ``pages(html, ...)`` with the main ``text`` and ``n_chars`` in place of the markup.

    Character references are decoded, white space within a block becomes one space, blocks are
    joined by a line break. A NULL or empty page, and one without main text, has an empty text.
    Columns with the names of the new ones are replaced; all others pass through, repeated rows too.
    """
    rows = pages.withColumn("_html", F.col("html")).drop("html", "text", "n_chars")
    shared = pages.sparkSession.sparkContext.broadcast(forest)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("_html").schema)
    return rows.mapInArrow(partial(_extract, shared=shared), f"{schema}, text string, n_chars bigint")
