from bandrisk.llm import url_filter
from bandrisk.sources.store import Scratch

PAGES = "page_id long, url string, html string, host string, rule int"


def judge(spark, rows, redirects=None):
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], PAGES)
    more = spark.createDataFrame(redirects, "source string, target string") if redirects else None
    with Scratch(spark) as scratch:
        got = url_filter.judge_urls(pages, scratch, redirects=more).collect()
    assert len(got) == len(rows)
    return {r.page_id: r for r in got}


def test_rules(spark):
    got = judge(
        spark,
        [
            (1, "http://a.net/x", None),
            (2, "https://www.Example.NET/en/1", ""),
            (3, "http://example.net/de/1", ""),
            (4, "http://example.com/de/1?x=/fr/", ""),
            (5, "http://notexample.com/de/1", ""),
            (6, "http://b.org/fr/2#a", ""),
            (7, "b.net/x", ""),
            (8, None, None),
            (9, "http://net", ""),
            (10, "http://x.com?u=http://a.net/", ""),
            (11, "a://b://c.net/", ""),
        ],
    )
    assert [(got[n].rule, got[n].verdict) for n in range(1, 12)] == [
        ("net/", "block"),
        ("example.net/en/", "allow"),
        ("net/", "block"),
        ("example.com/de/", "block"),
        (None, "allow"),
        ("org/fr/", "allow"),
        (None, "allow"),
        (None, "allow"),
        (None, "allow"),
        (None, "allow"),
        (None, "allow"),
    ]
    assert (got[2].host, got[2].path) == ("www.example.net", "/en/1")
    assert (got[7].host, got[8].path, got[10].host, got[11].host) == ("", "", "x.com", "b:")


def test_block_reaches_aliases_and_allow_goes_first(spark):
    canonical = '<head><LINK href="{}" rel="x canonical"></head>'
    refresh = "<meta http-equiv='Refresh' content='0; URL={}'>"
    got = judge(
        spark,
        [
            (1, "http://one.com/a", canonical.format("http://bad.net/a?x=1&amp;y=2")),
            (2, "https://two.com/b#top", refresh.format("/c")),
            (3, "http://two.com/c", canonical.format("//one.com/a")),
            (4, "http://four.com/", canonical.format("http://bad.net/z")),
            (5, "http://four.com/", canonical.format("http://good.org/fr/z")),
            (6, "http://six.com/d/e", canonical.format("f")),
            (7, "http://six.com/d/f", None),
            (8, None, canonical.format("http://bad.net/a")),
            (9, "http://nine.com/x", '<link rel="stylesheet" href="http://bad.net/a">'),
            (10, "http://ten.com/", ""),
            (10, "http://ten.com/", ""),
        ],
        redirects=[("http://six.com/d/e", "http://else.net/"), (None, "http://a.net/"), ("http://ten.com/", "x")],
    )
    assert {n: r.verdict for n, r in got.items()} == {
        1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "block", 7: "block", 8: "allow", 9: "allow", 10: "allow",
    }


def test_links_that_are_not_what_they_seem(spark):
    link = '<link rel="canonical" href="{}">'
    bad = link.format("http://bad.net/q")
    pages = {
        1: link.format("/login?next=http://bad.net/x"),
        2: f"<!-- {bad} --> <p>x</p>",
        3: f"<script>var a = '{bad}'; // canonical</script>",
        4: '<link title="x href=http://bad.net/q" rel=canonical href="/own">',
        5: link.format("http&#58;//bad&period;net/q"),
        6: '<base href="http://bad.net/dir/">' + link.format("page"),
        7: f"<style>{bad}</style><textarea>{bad}</textarea>",
        8: '<link rel=canonical href=/a href="http://bad.net/">',
        9: "<meta http-equiv=refresh content='5;url=http://bad.net/z'>",
        10: "<meta http-equiv=refresh content=\"5; URL='http://bad.net/z'\">",
        11: link.format("mailto:x@bad.net") + link.format("http://[bad"),
        12: f"<!-- open {bad}",
        13: "<link" + " x" * 50_000 + bad,  # one tag, by its closing sign
        14: "<link rel='canonical\" + " * 3 + bad,
        15: "<meta http-equiv=refresh content=5>" + link.format(""),
    }
    got = judge(spark, [(n, f"http://p{n}.com/d/x", html) for n, html in pages.items()])
    assert {n for n, r in got.items() if r.verdict == "block"} == {5, 6, 9, 10, 13}


def test_time_grows_with_the_page():
    import time

    start = time.perf_counter()
    for html in ("<link " * 100_000, "<link a='" * 50_000, "<!--" * 100_000, "<script>" * 100_000, "<base href=x>" * 50_000):
        url_filter.named_addresses("http://a.com/", html)
    assert time.perf_counter() - start < 10


def test_a_component_of_a_third_of_all_pages(spark):
    """A chain of aliases through a third of the pages carries one verdict to all of them."""
    rows = [(n, f"http://h{n}.com/x", f'<link rel="canonical" href="http://h{n - 1}.com/x">' if 0 < n < 300 else "") for n in range(900)]
    got = judge(spark, rows, redirects=[("http://h150.com/x", "http://bad.net/")])
    assert {n for n, r in got.items() if r.verdict == "block"} == set(range(300))


def test_no_rows(spark):
    assert judge(spark, []) == {}
