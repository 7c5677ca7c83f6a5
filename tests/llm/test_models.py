"""The trained operators: language, toxicity and main text."""

import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from bandrisk.llm import html_extract, langid, toxicity, trees
from bandrisk.llm.dom import Page
from tests.llm.data import clashing, documents, odd_rows, text

@pytest.mark.parametrize(
    "html",
    ["<div>" * 200_000, "<b>" * 100_000 + "</i>" * 100_000, "</i>" * 200_000, "<select>" * 200_000,
     "<p><table><td>" + "<div>" * 100_000, "<ul><li>" * 60_000],
)
def test_parsing_time_grows_with_the_page(html):
    start = time.perf_counter()
    page = Page(html + "text")
    assert time.perf_counter() - start < 5 and [b.text for b in page.blocks] == ["text"]


LETTERS = {"aa": "abcdeé", "bb": "klmnoü", "cc": "uvwxyz"}


def made_up(lang: str, seed: int, words: int) -> str:
    rng = random.Random(f"{lang}{seed}")
    return " ".join("".join(rng.choice(LETTERS[lang]) for _ in range(rng.randrange(2, 7))) for _ in range(words))


def test_languages_of_held_out_documents(spark):
    rows = [(n, made_up(lang, n, 5 + n % 40), lang, "a", 1) for n, lang in enumerate(list(LETTERS) * 100)]
    docs = clashing(documents(spark, rows + [(1000, made_up("bb", 1, 4000), None, None, None)]))
    got = langid.predict(docs, langid.train_on(docs)).collect()
    assert len(got) == len(rows) + 1 and all(0 <= r.score <= 1 for r in got)
    unseen = [r for r in got if r.lang and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(unseen) > 40 and sum(r.lang_pred == r.lang for r in unseen) / len(unseen) > 0.95
    assert next(r.lang_pred for r in got if r.doc_id == 1000) == "bb"


def test_texts_without_a_language(spark):
    docs = clashing(documents(spark, odd_rows()))
    model = langid.train_on(docs)
    got = langid.predict(docs, model).collect()
    assert len(got) == docs.count()
    for r in got:
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or ""))
        assert r.lang_pred != "und" or r.score == 0
    kept = langid.drop_undetermined(docs)
    assert kept.dtypes == docs.dtypes and sorted({r.doc_id for r in kept.collect()} & {4, 5, 6, 9}) == []
    # Missing languages are filled with predicted ones, given ones stay.
    given = {r.doc_id: r.lang for r in docs.collect() if r.lang}
    for r in kept.collect():
        assert r.lang is not None and (r.doc_id not in given or r.lang == given[r.doc_id] or r.doc_id in (2, 7))
    unlabelled = docs.where("lang = 'none'")
    assert langid.train_on(unlabelled) is None
    assert {r.lang_pred for r in langid.predict(docs, None).collect()} == {"und"}
    assert langid.predict(unlabelled, model).count() == 0


@pytest.mark.parametrize("labels", ["none", "held out"])
def test_stage_keeps_texts_without_labels(spark, labels):
    docs = clashing(documents(spark, odd_rows()))
    if labels == "none":
        docs = docs.withColumn("lang", F.lit(None).cast("string"))
    else:
        docs = docs.where(langid.held_out(F.col("doc_id")) | F.col("lang").isNull())
        assert docs.where("lang is not null and text is not null").count() > 0
    assert langid.train_on(docs) is None
    kept = langid.drop_undetermined(docs)
    expected = [r for r in docs.collect() if any(c.isalpha() for c in r.text or "")]
    assert kept.dtypes == docs.dtypes and expected
    assert sorted(map(repr, kept.collect())) == sorted(map(repr, expected))


def test_stage_keeps_texts_labelled_und(spark):
    docs = documents(spark, [(n, text(n, 9), "und", "a", 1) for n in range(20)] + [(20, "12", "und", "a", 1)])
    assert langid.drop_undetermined(docs).count() == 20


def test_gradients_of_the_recurrent_network():
    rng = np.random.default_rng(0)
    model = langid.train([b"abc", b"xyz"], ["a", "b"], hidden=3, seed=1)
    for a in model.arrays():
        a += rng.normal(0, 0.1, a.shape)
    codes = langid._coded([b"abcde", b"zy x1"], 7)
    labels = np.array([0, 1])

    def loss():
        ahead, _ = langid._run(model.forward, codes)
        behind, _ = langid._run(model.backward, codes[::-1])
        p = langid._softmax(np.concatenate([ahead, behind[::-1]], axis=2) @ model.output + model.bias)
        there = codes != langid.PAD
        return -np.log(p[:, np.arange(2), labels])[there].sum() / there.sum()

    for array, gradient in zip(model.arrays(), langid._gradients(model, codes, labels)):
        for at in np.argsort(-np.abs(gradient).ravel())[:4]:
            place = np.unravel_index(at, array.shape)
            old, step = array[place], 1e-2
            array[place] = old + step
            up = loss()
            array[place] = old - step
            down = loss()
            array[place] = old
            assert abs((up - down) / (2 * step) - gradient[place]) < 2e-2 * max(0.05, abs(gradient[place]))


def test_labeller_agrees_with_training_code():
    model = langid.train([b"hello there", b"guten tag"], ["a", "b"], hidden=4)
    codes = langid._coded([b"hello", b"tag there is", b""], 16)
    ahead, _ = langid._run(model.forward, codes)
    behind, _ = langid._run(model.backward, codes[::-1])
    p = langid._softmax(np.concatenate([ahead, behind[::-1]], axis=2) @ model.output + model.bias)
    expected = (p * (codes != langid.PAD)[:, :, None]).sum(axis=0)
    assert np.allclose(langid.Labeller(model)(codes), expected, atol=1e-4)


def test_toxic_documents_are_found(spark):
    bad = ["blorg", "snuffle", "grumpf"]
    rows, marks = [], []
    for n in range(600):
        toxic = n % 4 == 0
        words = text(n, 40 + n % 50).split()
        if toxic:
            words[n % len(words)] = bad[n % 7 % 3] + ("er" if n % 8 == 0 else "")
        rows.append((n, " ".join(words), "en", "a", 1))
        marks.append((n, int(n % 8 == 0), int(toxic)))
    docs = clashing(documents(spark, rows))
    known = spark.createDataFrame(marks, "doc_id long, severe int, toxic int")
    chain = toxicity.train_on(docs, known.where("doc_id % 3 <> 0"), ("toxic", "severe"))
    assert len(chain) == 2 and len(chain[1].earlier) == 1
    got = toxicity.predict(docs, chain, ("toxic", "severe")).collect()
    unseen = [r for r in got if r.doc_id % 3 == 0]
    assert np.mean([r.is_toxic == (r.doc_id % 4 == 0) for r in unseen]) > 0.97
    assert np.mean([r.is_severe == (r.doc_id % 8 == 0) for r in unseen]) > 0.9


def test_toxicity_of_odd_rows(spark):
    docs = clashing(documents(spark, odd_rows()))
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (7, None), (3, 0), (3, 0)], "doc_id long, toxic int")
    chain = toxicity.train_on(docs, labels, ("toxic",))
    got = toxicity.predict(docs, chain, ("toxic",))
    assert got.count() == docs.count() and got.where("toxic_prob between 0 and 1").count() == docs.count()
    assert toxicity.train_on(docs, labels.limit(0), ("toxic",)) == []
    assert toxicity.predict(docs, [], ("toxic",)).where("is_toxic").count() == 0
    assert toxicity.predict(docs.limit(0), chain, ("toxic",)).count() == 0


@pytest.fixture(scope="module")
def forest():
    words = [w for n in range(40) for w in text(n, 50).split()]
    return html_extract.train(words, pages=350)


def test_pages_composed_with_another_seed(forest):
    composer = html_extract._Composer(text(99, 3000).split(), 77)
    wrong = total = 0
    for _ in range(80):
        page = Page(composer.page())
        nodes, rows = html_extract.node_features(page)
        main = html_extract.decode(page, nodes, forest.log_odds(rows))
        marked = np.zeros(len(page.elements))
        marked[nodes] = html_extract._labels(page, nodes)
        for block in page.blocks:
            total += len(block.text)
            wrong += len(block.text) * (bool(marked[block.owner]) != main[block.owner])
    assert wrong / total < 0.02


ARTICLE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<div id="cookie-notice"><p>We use cookies.</p></div><header><a href="/">Site</a></header><nav><ul><li><a href="/a">Menu</a></ul></nav>
<div class="content"><article><h1>Head &amp;&nbsp;line</h1><p>First <b>paragraph here,\n with  words</b> &lt;and&gt; more of them.
<p>Second paragraph runs on, and on, with an &eacute; in it.<br>It ends.</p><!-- no --><div class="ad">Buy this now.</div>
<ul><li>an entry of the list<li>another entry of it</ul></article>
<aside class="related"><h3>More</h3><ul><li><a href="/b">Other</a></li></ul></aside></div>
<section id="comments"><h3>Comments</h3><div class="comment"><p>I like it a lot, said a reader.</p></div></section>
<form><label>Search</label><input name=q><button>Go</button></form><footer>&copy; Site</footer></body></html>"""


def test_a_page_by_hand(forest):
    assert html_extract.main_texts([ARTICLE, "", "plain"], forest)[0].split("\n") == [
        "Head & line",
        "First paragraph here, with words <and> more of them.",
        "Second paragraph runs on, and on, with an é in it. It ends.",
        "an entry of the list",
        "another entry of it",
    ]


def test_long_attributes_hold_markup(forest):
    for quote in "\"'":
        value = "1 > 0 <p>no text</p>" * 1000
        page = Page(f"<div data-x={quote}{value}{quote} class=c><p>Text.</p></div>")
        assert [e.tag for e in page.elements] == ["#root", "div", "p"] and page.elements[1].tokens == ("c",)
        assert [b.text for b in page.blocks] == ["Text."]
        held = ARTICLE.replace("<p>Second", f"<p data-x={quote}{value}{quote}>Second")
        assert html_extract.main_texts([held], forest) == html_extract.main_texts([ARTICLE], forest)


def test_quotes_without_an_end():
    # Each quote ends at that of the next tag, and the last one nowhere.
    page = Page("<p>a" + "<i z='>u" * 20001)
    assert page.blocks[0].text == "a" + "u" * 10001 and len(page.elements) == 10003
    assert [b.text for b in Page("<p title='x>one</p><p>two</p>").blocks] == ["one", "two"]


FORMULA = (
    '<math display="block"><semantics><mrow><msup><mi>x</mi><mn>2</mn></msup><mspace width="1em"/><mo>&lt;</mo>'
    '<mfrac><mn>1</mn><mi>n</mi></mfrac></mrow><annotation encoding="application/x-tex">x^2</annotation>'
    '<annotation-xml encoding="MathML-Content"><apply><ci>x</ci></apply></annotation-xml></semantics></math>'
)


def test_formulas_are_text(forest):
    page = ARTICLE.replace("It ends.", f"It ends, {FORMULA} it does.").replace("<p>First", "<p>First <math><mi>y</mi></math>")
    assert html_extract.main_texts([page], forest)[0].split("\n")[1:3] == [
        "First y paragraph here, with words <and> more of them.",
        "Second paragraph runs on, and on, with an é in it. It ends, x2<1n it does.",
    ]


def test_labels_agree_up_and_down(forest):
    page = Page(ARTICLE)
    rng = np.random.default_rng(0)
    nodes = html_extract._nodes(page)
    for _ in range(20):
        main = html_extract.decode(page, nodes, rng.normal(0, 2, len(nodes)))
        assert all(main[e.parent] or not main[n] for n, e in enumerate(page.elements) if e.parent >= 0)


def test_odd_pages(spark, forest):
    odd = [None, "", "<", "<p", "a < b", "<p>x" * 3000, "<div>" * 2000 + "deep", "<!-- open", "<script>x", '<a href="x>y</a>', "<td>a<td>b</tr>"]
    rows = [(n, "http://x", html, "t") for n, html in enumerate(odd)] + [(1, "http://x", "", "t")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html_extract.extract(pages, forest).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    assert got[0].text == "" and html_extract.extract(pages.limit(0), forest).count() == 0
    assert html_extract.sample_words(pages.limit(0)) == []


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, (4000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    forest = trees.boost(x[:3000], y[:3000])
    assert (((forest.log_odds(x[3000:]) > 0) == y[3000:]).mean()) > 0.95
