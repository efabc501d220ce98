"""Main text of pages: reading of markup, the style tree against brute force, odd rows."""

import math
from collections import Counter, defaultdict

import pytest

from quern.llm import site_style


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""),
        ("", ""),
        ("  \n ", ""),
        ("just words &amp; more", "just words & more"),
        ("<p>a\n\t b</p><p>c<br>d</p>", "a b\n\nc d"),
        ("<p>one<p>two<ul><li>x<li>y</ul>", "one\n\ntwo\n\nx\n\ny"),
        ("<p title='a > b'>in &lt;b&gt; &#233;&#x6F22;</p>", "in <b> é漢"),
        ("<p>be<b>fo</b>re</p><script>var x = '<p>no</p>';</script><style>p{}</style><p>after</p>", "before\n\nafter"),
        ("<p>x<!-- <p>hidden</p> -->y</p>", "xy"),
        ("<body><nav><p>menu</p></nav><main><p>m</p></main><p>out</p></body>", "m"),
        ("<main><p>m</p><article><h1>t</h1><p>a</p><article><p>a reader</p></article></article></main>", "t\n\na"),
        ("<article><p>a</p><div class='ad-slot ad'>buy</div><div id=comments><p>c</p></div><form>f</form></article>", "a"),
        ("<div style='display: none'>no</div><div hidden>no</div><p>yes</p>", "yes"),
        ("<p>end </nosuch> of <em", "end of"),
        ("<script>never closed <p>x</p>", ""),
        ("<table><tr><td>1<td>2<tr><td>3</table>", "1\n\n2\n\n3"),
    ],
)
def test_main_text(page, text):
    assert site_style.main_text(page) == text


def site(n):
    """Pages of one host, with a branch that all show, in no known furniture, and texts of their own."""
    for i in range(n):
        more = f"<div class='list'><p>entry {i} of this page</p><p>another {i * i}</p></div>" if i % 3 else ""
        yield f"<body><div class='strap'><p>The same words on each page</p></div><article><h1>Title {i}</h1><p>Body text number {i}, in its own words.</p>{more}</article></body>"


def slow_tree(pages):
    texts, layouts, shown, inside = defaultdict(list), defaultdict(list), defaultdict(set), {}
    for i, (host, page) in enumerate(pages):
        for path, kind, text, _ in site_style.blocks(page):
            if text is None:
                layouts[host, path].append(kind)
            else:
                texts[host, path].append(text)
                shown[host, path].add(i)
                inside[host, path] = kind == "article"
    out = {}
    for host in {h for h, _ in texts}:
        mine = [p for h, p in texts if h == host]
        length = lambda ps: sum(len(t) for p in ps if inside[host, p] for t in texts[host, p])  # noqa: B023, E731
        for node in {">".join(p.split(">")[:k]) for p in mine for k in range(2, len(p.split(">")) + 1)}:
            below = [p for p in mine if p == node or p.startswith(node + ">")]
            most = max(len(shown[host, p]) for p in below)
            each = [math.log(c) for p in below for c in Counter(texts[host, p]).values() for _ in range(c)]
            content = max(0.0, 1 - sum(each) / len(each) / math.log(most)) if most > 1 else 1.0
            laid = Counter(layouts[host, node])
            n = sum(laid.values())
            presentation = (-sum(c / n * math.log(c / n) for c in laid.values()) / math.log(n) if n > 1 else 1.0) if n else 0.0
            share = length(below) / length(mine) if length(mine) else 0.0
            out[host, site_style.key(node)] = (most, presentation, content, share, all(inside[host, p] for p in below))
    return out


def test_style_tree(spark):
    pages = [("a.org", p) for p in site(13)] + [("b.org", "<div><p>x</p></div>"), ("b.org", "<div><p>x</p><p>y</p></div>"), ("", "<p>alone</p>")]
    urls = {"a.org": "https://user@A.org:80/p", "b.org": "http://b.org?x", "": None}
    df = spark.createDataFrame([(urls[h], p) for h, p in pages], "url string, html string")
    got = {(r.host, r.path): (r.pages, r.presentation, r.content, r.share, r.inside) for r in site_style.style_tree(df).collect()}
    want = slow_tree(pages)
    assert got.keys() == want.keys()
    for k, row in want.items():
        assert got[k][0] == row[0] and got[k][4] == row[4] and got[k][1:4] == pytest.approx(row[1:4], abs=1e-9)


@pytest.mark.parametrize("most", [100_000, 0])
def test_repeated_branches_go(spark, monkeypatch, most):
    """By broadcast and by join alike; article text stays, and so does the branch where a host has few pages."""
    monkeypatch.setattr(site_style, "MOST_BRANCHES", most)
    bare = lambda i: f"<body><div class='strap'><p>The same words on each page</p></div><div class='text'><p>Own words {i} here.</p></div></body>"
    rows = [(i, "http://many.org/x", bare(i)) for i in range(12)] + [(100 + i, "http://few.org/x", bare(i)) for i in range(3)]
    rows += [(200 + i, "http://art.org/x", p) for i, p in enumerate(site(12))]
    got = {r.page_id: r for r in site_style.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got.values())
    assert all(got[i].text == f"Own words {i} here." for i in range(12))
    assert all(got[100 + i].text == f"The same words on each page\n\nOwn words {i} here." for i in range(3))
    assert all(got[200 + i].text.startswith(f"Title {i}\n\nBody text number {i}, in its own words.") for i in range(12))
    assert got[201].text.endswith("entry 1 of this page\n\nanother 1")


def test_odd_pages(spark):
    long = "<article>" + "".join(f"<p>paragraph {i} &amp; more</p>" for i in range(20_000)) + "</article>"
    rows = [(1, None, None, "kept", 5), (2, "", "", "kept", 5), (3, "not a url", "<p>x</p>", None, 5), (3, "not a url", "<p>x</p>", None, 5), (None, None, "<p>y</p>", "z", None), (4, "http://h.org", long, "", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars long")
    out = site_style.extract(df)
    got = sorted(((r.page_id or 0), r.text, r.n_chars) for r in out.collect())
    whole = "\n\n".join(f"paragraph {i} & more" for i in range(20_000))
    assert got == [(0, "y", 1), (1, "", 0), (2, "", 0), (3, "x", 1), (3, "x", 1), (4, whole, len(whole))]
    assert sorted(out.columns) == sorted([*df.columns, "decided_by"]) and site_style.extract(df.limit(0)).count() == 0


def extracted(spark, pages):
    df = spark.createDataFrame([(i, "http://one.org/x", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    return [r.text for r in site_style.extract(df).orderBy("page_id").collect()]


@pytest.mark.parametrize("tag", ["main", "div"])
@pytest.mark.parametrize("change", [False, True])
def test_copies_of_a_page_do_not_remove_it(spark, tag, change):
    """96 copies, or near copies in their last paragraph, and 4 or 12 other pages."""
    page = lambda t, i: f"<body><{tag}><h1>Title {t}</h1><p>Text of page {t}.</p><p>And a much longer last paragraph of it {i}.</p></{tag}></body>"
    want = lambda t, i: f"Title {t}\n\nText of page {t}.\n\nAnd a much longer last paragraph of it {i}."
    all_ = [(0, i * change) for i in range(96)] + [(t, t) for t in range(1, 5 if change else 13)]
    got = extracted(spark, [page(*x) for x in all_])
    if not change:
        assert got == [want(*x) for x in all_]
    else:
        assert all(g.endswith(want(*x).split("\n\n")[2]) for g, x in zip(got, all_, strict=True))


def test_titles_of_near_copies_stay(spark):
    """Their last paragraphs differ, so that they are different pages."""
    page = lambda t, i: f"<body><article><h1>Title {t}</h1><ul><li>Entry of {t}</li></ul><p>{'And a long last paragraph. ' * 9}{i}</p></article></body>"
    got = extracted(spark, [page(0, i) for i in range(196)] + [page(t, t) for t in range(1, 5)])
    assert [g.split("\n\n")[:2] for g in got] == [[f"Title {t}", f"Entry of {t}"] for t in [0] * 196 + [1, 2, 3, 4]]


@pytest.mark.parametrize(
    "page, text",
    [
        ("<div class='layout has-sidebar'><article><h1>t</h1><p>a</p></article></div>", "t\n\na"),
        ("<div class='no-sidebar'><p>a</p></div>", "a"),
        ("<article class='post category-social'><p>a</p></article>", "a"),
        ("<article class='search'><p>a</p></article>", "a"),
        ("<div class='search'><div id=widget><article><p>a</p></article></div></div>", "a"),
        ("<article><div class='entry-header'><h1>t</h1></div><div class='header'><h2>u</h2></div><p>a</p></article>", "t\n\nu\n\na"),
        ("<body><div class='section-header'><h1>t</h1></div><div class='widget'><p>most of the text</p></div><div class='share'>x</div></body>", "t\n\nmost of the text"),
        ("<article><p>a</p><div class='cookie-banner'>b</div><div class='related-posts'>c</div></article><div class='related'><article>d</article></div>", "a"),
    ],
)
def test_names_of_furniture(page, text):
    assert site_style.main_text(page) == text


def test_a_teaser_does_not_replace_the_story():
    page = "<main><h1>t</h1><p>The story of this page</p><article><p>a teaser</p></article><p>Its end</p></main><p>out</p>"
    assert site_style.main_text(page) == "t\n\nThe story of this page\n\na teaser\n\nIts end"
    assert site_style.main_text("<main><h1>t</h1><article><p>story</p></article></main>") == "story"
