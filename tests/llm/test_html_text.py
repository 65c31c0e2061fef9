import html
import random
import re

import pytest
from loomhouse.llm import html_text

LONG = "This is a paragraph of the article with quite enough words to be plain text and nothing else at all."


def one(page):
    return html_text.main_text(page)[0]


def test_tree_fits_its_table():
    x, y = html_text.labelled()
    assert [html_text.decide(html_text.tree(), r) >= 0.5 for r in x.tolist()] == (y == 1).tolist()


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""),
        ("", ""),
        ("   \n ", ""),
        ("just text &amp; no tags", "just text & no tags"),
        (f"<nav><a href=x>Home</a></nav><article><h1>Head line</h1><p>{LONG}<p>Short.</article><footer>&copy; me</footer>", f"Head line\n{LONG}\nShort."),
        (f"<article><p>{LONG}</p><section class='comments'><p>I liked it very much, thank you for it.</p></section></article>", LONG),
        (f"<article><p>a&lt;b &#x41;&#66; &eacute;&nbsp;x\n\t y<br>z</p></article><aside><p>{LONG}</p></aside>", "a<b AB é x y z"),
        (f"<header><p>{LONG}</p></header><main><p>{LONG}</p></main><div class='cookie-notice'>{LONG}</div><div id=\"sidebar\"><p>{LONG}</p></div>", LONG),
        (f"<article><p>{LONG}</p><div class=ad>Buy it now</div><form>Name <input> <button>Go</button></form><script>var a='</p>';</script><style>p{{}}</style><p>End.</p></article>", f"{LONG}\nEnd."),
        (f"<article><!-- <p>no</p> --><p title='a > b'>{LONG}</p><p hidden>no</p><p style='display: none'>no</p><noscript>no</noscript></article>", LONG),
        (f"<article><p><b>Open <i>tags<p>{LONG}</article><!-- never ended <p>no</p>", f"Open tags\n{LONG}"),
        (f"<div><p>{LONG}</p><p>{LONG}</p></div><ul><li><a href=1>One</a></li><li><a href=2>Two</a></li></ul>", f"{LONG}\n{LONG}"),
        (f"<article><ul><li><a href=1>First</a> of them</li><li>Second</li></ul><p>{LONG}</p></article>", f"First of them\nSecond\n{LONG}"),
        (f"<body class=\"has-sidebar\"><div class='content with-sidebar'><p>{LONG}</p><p>1 < 2 and more</p></div></body>", f"{LONG}\n1 < 2 and more"),
        (f"<article><p class=ad>Buy <span class=x>now<p>{LONG}<p class='notice'>Read this<div>{LONG}</div><ul><li class=promo>no<li>yes</ul></article>", f"{LONG}\n{LONG}\nyes"),
        ("<script>never ended", ""),
        ("<nav><a href=1>One</a><a href=2>Two</a></nav>", ""),
    ],
)
def test_pages(page, want):
    assert one(page) == want


W = lambda n: " ".join(f"word{k}" for k in range(n))
LINKS = "<ul>" + "".join(f"<li><a href={k}>Go {k}</a></li>" for k in range(5)) + "</ul>"
MORE = LINKS.replace("Go", "Read also number")

#: Pages without an article element, most without any name of a region, and their main text by hand.
BY_HAND = [
    (f"<h1>{W(5)}</h1><p>{W(60)}</p><p>{W(45)}</p>", [5, 60, 45]),
    (f"{LINKS}<h1>{W(7)}</h1><p>{W(55)}<p>{W(6)}<p>{W(70)}<p>{W(7)}<p>{W(40)}</p>{LINKS}", [7, 55, 6, 70, 7, 40]),
    (f"<table><tr><td>{LINKS}</td><td>{W(80)}<p>{W(3)}<p>{W(64)}</td></tr></table>{LINKS}", [80, 3, 64]),
    (f"{LINKS}<div>{W(4)}</div>{LINKS}<div>{W(3)}</div>{LINKS}", []),
    (f"<div><p>{W(30)}</p><p>{W(12)}</p><p>{W(25)}</p></div>", [30, 12, 25]),
    (f"<p><a href=1>{W(6)}</a></p><p><a href=1>{W(9)}</a></p><p>{W(66)}</p><p><a href=2>{W(8)}</a></p><p><a href=2>{W(7)}</a></p>", [66]),
    (f"<section class=\"more-about-cats\"><p>{W(60)}</p><p>{W(48)}</p></section><div class=related-posts><p>{W(40)}</p></div>", [60, 48]),
    (f"<div class=entry><p>{W(50)}</p><p>{W(2)}</p></div><p>{W(30)}</p><div class='share-buttons'>{W(4)}</div>", [50, 2]),
    (f"<h1 class=post-title>{W(6)}</h1><div><p>{W(60)}</p><p>{W(33)}</p></div>", [6, 60, 33]),
    (f"<h1>{W(8)}</h1><p>{W(60)}</p><p>{W(50)}</p><div>{W(6)}</div>{MORE}", [8, 60, 50]),
    (f"<div>{W(5)}</div>{MORE}<p>{W(44)}</p><p>{W(6)}</p><p>{W(51)}</p><div>{W(7)}</div>{MORE}", [44, 6, 51]),
    (f"<main><p>{W(20)} <math><mi>x</mi></math> {W(2)}</p><audio>{W(3)}</audio><p>{W(9)}<button>{W(2)}</button></main>", [23, 3, 9]),
]


@pytest.mark.parametrize(("page", "sizes"), BY_HAND)
def test_pages_labelled_by_hand(page, sizes):
    assert [len(x.split()) for x in one(page).split("\n") if x] == sizes


def test_neighbours_decide_where_names_are_silent(monkeypatch):
    """Without the features of neighbours, or those of words and links, pages come out otherwise; named pages do not need them."""
    plain = [one(page) for page, _ in BY_HAND]
    real = html_text.features
    for some in (("words_before", "link_density_before", "words_after", "link_density_after"), ("words", "link_density")):
        columns = [html_text.FEATURES.index(f) for f in some]

        def without(own, columns=columns):
            out = real(own)
            out[:, columns] = 0
            return out

        monkeypatch.setattr(html_text, "features", without)
        assert sum(one(page) != was for (page, _), was in zip(BY_HAND, plain)) >= 2


def test_shape_is_asked_before_names():
    def splits(node, depth=0):
        if len(node) == 4:
            yield depth, node[0]
            yield from splits(node[2], depth + 1)
            yield from splits(node[3], depth + 1)

    told = list(splits(html_text.tree()))
    assert not any(f in html_text.REGIONS for depth, f in told if depth < html_text.SHAPE_FIRST)
    assert {html_text.FEATURES[f] for _, f in told} >= {"words", "link_density", "words_before", "words_after", "link_density_after", "content", "chrome"}


def test_tree_against_exhaustive_search():
    """Each split of a small tree is the best of all splits by Gini impurity."""
    x = [[1, 9], [2, 7], [3, 8], [4, 1], [5, 2], [6, 3]]
    y = [0, 1, 0, 1, 1, 1]
    import numpy as np

    impurity = lambda some: 2 * sum(some) * (len(some) - sum(some)) / len(some)
    root = html_text.grow(np.array(x, float), np.array(y))
    every = {(f, t): impurity([v for r, v in zip(x, y) if r[f] <= t]) + impurity([v for r, v in zip(x, y) if r[f] > t]) for f in range(2) for t in (k + 0.5 for k in range(1, 9)) if min(r[f] for r in x) <= t < max(r[f] for r in x)}
    assert every[root[0], root[1]] == min(every.values())
    assert [html_text.decide(root, r) >= 0.5 for r in x] == [v == 1 for v in y]


def test_named_articles_of_all_sizes():
    """Paragraphs, headings, lists and links of any size within an article, with other parts before, within and after."""
    rng = random.Random(1)
    size = lambda: rng.choice([1, 2, 3, 5, 6, 7, 8, 9, 13, 20, 47, 70, 150, 500])
    parts = ["<p>{}</p>", "<p><a href=x>{}</a></p>", "<h2>{}</h2>", "<ul><li>{}</li></ul>"]
    others = ["<nav>{}</nav>", "<div class=ad>{}</div>", "<aside><p>{}</p></aside>", "<footer><p>{}</p></footer>", "<div id=cookie-notice><p>{}</p></div>", "<section class=comments><p>{}</p></section>", "<div class=related-posts><p>{}</p></div>"]
    other = lambda: "".join(rng.choice(others).format(W(size())) for _ in range(rng.randint(0, 3)))
    for _ in range(400):
        sizes = [size() for _ in range(rng.randint(1, 10))]
        page = other() + "<article>" + "".join(rng.choice(parts).format(W(n)) for n in sizes) + other() + "</article>" + other()
        assert [len(x.split()) for x in one(page).split("\n")] == sizes


def test_a_long_broken_page_ends_in_time():
    assert one("<p " + "'a\" " * 50_000) is not None
    assert len(one("<article>" + f"<p>{LONG}</p>" * 20_000 + "</article>")) == 20_000 * (len(LONG) + 1) - 1


def test_pages_of_the_test_data(spark):
    """Against the article element cut out by hand."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    for r in html_text.extract(pages).collect():
        inner = re.search("<article>(.*)</article>", r["html"], re.S)[1]
        cut = [re.sub(r"\s+", " ", html.unescape(re.sub("</?b>", "", x.replace("<br>", " ")))).strip() for x in re.split("</?(?:p|h1)>", inner)]
        assert r["main"]["text"] == "\n".join(x for x in cut if x)


def test_columns_nulls_and_empty_table(spark):
    pages = spark.createDataFrame([(1, None, "m"), (2, "<p>x", None), (2, "<p>x", None)], "page_id bigint, html string, main string")
    out = html_text.extract(pages)
    assert out.columns == ["page_id", "html", "main", "main_"]
    assert [r["main_"]["text"] for r in out.orderBy("page_id").collect()] == ["", "x", "x"]
    assert html_text.extract(pages.limit(0)).collect() == []
