import time

import pytest

from hearsay.llm import html
from hearsay.llm.queries import QUERIES

TREE = html.trained()


def text(page):
    return html.main_text(page, TREE)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script>
</head><body class="has-sidebar"><header><h1>Site</h1><p>The tagline of the site</p></header>
<nav><ul><li><a href="/a">A</a><li><a href="/b">B</a></ul></nav><!-- <p>no</p> -->
<div class="ad">Buy our things now, they are really good.</div>
<main><article><h1>My &amp; title</h1><p><b>First   part
of it.<br>Same block<p>Second&nbsp;with a <a href="x>y">link</a> inside &lt;b&gt;.</p><p>Short.</p>
<ul><li>One<li>Two</ul><form>Name <input><textarea>x</textarea></form>
<section id="comments"><article class="comment"><p>Great post, I really liked it so much.</p>
</article></section></article></main><aside>Related: <a href="z">other pages</a></aside>
<div id="cookie-notice">We use cookies to make this site better for all of you.</div>
<noscript>Enable scripts</noscript><footer>&copy; 2020 Site &middot; all rights</footer></body></html>"""


def test_page():
    assert text(PAGE) == ("My & title\n\nFirst part of it. Same block\n\n"
                          "Second with a link inside <b>.\n\nShort.\n\nOne\n\nTwo")


def test_page_without_article():
    words = " ".join(["word"] * 30)
    page = (f"<body><ul><li><a href=a>Home</a><li><a href=b>News</a></ul><h2>A heading</h2>"
            f"<p>{words}</p><p>{words} end</p><div class=sidebar>{words}</div><p><a href=c>More</a></p>")
    assert text(page) == f"A heading\n\n{words}\n\n{words} end"


@pytest.mark.parametrize("page, expected", [
    (None, ""), ("", ""), ("<", ""), ("<!-- open", ""), ("<p", ""), ("<article>a < b</article>", "a < b"),
    ("<article><p>a</b></i></article>", "a"), ("<article><p>&#65;&unknown;&amp;lt;</article>", "A&unknown;&lt;"),
    ("<script>never closed <p>x", ""), ("<article><p hidden>no</p><p>yes</article>", "yes"),
])
def test_odd_pages(page, expected):
    assert text(page) == expected


def test_last_prose_without_article():
    words = " ".join(["word"] * 30)
    assert text(f"<body><p>{words}</p></body>") == words
    assert text(f"<body><p>{words}</p><p>{words} end</p><a href=a>Top</a>").startswith(f"{words}\n\n{words}")


@pytest.mark.parametrize("inside, expected", [
    ('<h1><a href="/p">A linked title</a></h1><p>Text.</p>', "A linked title\n\nText."),
    ("<p>Sources:</p><ul><li><a href=a>One</a><li><a href=b>Two</a></ul>", "Sources:\n\nOne\n\nTwo"),
    ('<h2 id="discussion">Discussion</h2><p>Text.</p>', "Discussion\n\nText."),
    ('<section id="discussion"><p>Text.</p></section>', "Text."),
    ('<h2 id="related-work">Related work</h2><p>Text.</p>', "Related work\n\nText."),
    ("<p>Let <math><mi>x</mi></math> be.</p>", "Let x be."),
    ("<object><p>In its place.</p></object><p>Text.", "In its place.\n\nText."),
    ("<p>One.</p><canvas><p>Two.</p>", "One.\n\nTwo."),
    ("<p>One.</p><script>x <p>Two.</p>", "One."),
    ('<p>Text.</p><div id="comments"><p>No.</p></div>', "Text."),
])
def test_article_text_stays(inside, expected):
    assert text(f"<body><article>{inside}</article></body>") == expected


def test_broken_pages_take_linear_time():
    start = time.process_time()
    for page in ("<div " * 100_000, '<a "' * 50_000 + ">", "<div>" * 50_000 + "</b>" * 50_000,
                 "<!--" * 50_000, "<p>a <b class=ad>b" * 10_000):
        text(page)
    assert time.process_time() - start < 30


def test_tree_fits_its_table():
    rows = html.labelled()
    assert len(rows) > 300 and 0.3 < rows[:, -1].mean() < 0.7
    assert [html.decide(TREE, r[:-1]) for r in rows] == rows[:, -1].tolist()


def splits(tree):
    if not isinstance(tree, tuple):
        return []
    return [html.FEATURES[tree[0]], *splits(tree[2]), *splits(tree[3])]


def two_terms(row):
    """Not marked, and in an article: what a rule without words and links would say."""
    return int(row[html.FEATURES.index("marked")] < 0.5 and row[html.FEATURES.index("place")] >= 0.5)


def test_words_and_links_decide():
    """The tree looks at link density and at the neighbours, and differs from a rule of two terms."""
    used = set(splits(TREE))
    assert "links" in used and used & {"links_before", "links_after"}
    assert used & {"words", "words_before", "words_after"}
    page = ("<h1>A title</h1><p>" + "word " * 30 + "</p><p>Short.</p><ul><li><a href=a>One more</a>"
            "<li><a href=b>Another one</a></ul><div>Follow us</div><ul><li><a href=c>There</a></ul>")
    rows = html.described(html.blocks(page))
    chosen = [html.decide(TREE, row) for row in rows]
    assert chosen == [1, 1, 1, 0, 0, 0, 0] and [two_terms(row) for row in rows] == [1] * 7


@pytest.mark.parametrize("inside, expected", [
    ('<section id="related-work"><h2>Related work</h2><p>Text.</p></section>', "Related work\n\nText."),
    ('<div class="notice-board"><p>Text.</p></div><p>More.</p>', "Text.\n\nMore."),
    ('<section id="reply"><p>Text.</p></section><p>More.</p>', "Text.\n\nMore."),
    ('<div id="share-of-total"><p>Text.</p></div><p>More.</p>', "Text.\n\nMore."),
    ('<p>Text.</p><div class="related-posts"><p>Other.</p></div>', "Text."),
    ('<p>Text.</p><div class="ad-slot"><p>Buy.</p></div>', "Text."),
    ('<p>Text.</p><div id="cookie-consent-bar"><p>Cookies.</p></div>', "Text."),
    ('<p>Text.</p><section id="comments"><p>No.</p></section>', "Text."),
    ('<p>Text.</p><ul class="comment-list"><li>No.</ul>', "Text."),
])
def test_names_that_are_no_marks(inside, expected):
    assert text(f"<body><article>{inside}</article></body>") == expected


@pytest.mark.parametrize("page, expected", [
    ("<h1>Title</h1><p>{30}</p><p>{12}</p><p>The end.</p>", "Title\n\n{30}\n\n{12}\n\nThe end."),
    ("<p>Yes.</p><p>No.</p><p>Maybe so.</p>", "Yes.\n\nNo.\n\nMaybe so."),
    ("<h1>Title</h1><p>{30}</p>", "Title\n\n{30}"),
    ("<div><a href=a>Home</a></div><h1>Title</h1><p>By me</p><p>{40}</p><div><a href=b>Next</a></div>",
     "Title\n\nBy me\n\n{40}"),
    ("<main><h1><a href=a>Title</a></h1><p>{20}</p><ul><li><a href=b>One</a><li><a href=c>Two</a></ul></main>"
     "<p>{15}</p>", "Title\n\n{20}"),
])
def test_pages_without_an_article(page, expected):
    import re

    fill = lambda x: re.sub(r"{(\d+)}", lambda n: " ".join(["word"] * int(n.group(1))), x)
    assert text(f"<body>{fill(page)}</body>") == fill(expected)


def test_rows(spark):
    frame = spark.createDataFrame(
        [(1, None, PAGE), (2, "u", None), (2, "u", None), (None, "u", "")],
        "page_id bigint, text string, html string",
    )
    found = html.extract(frame)
    assert found.columns == ["page_id", "html", "text", "n_chars"]
    assert sorted((str(r.page_id), r.text, r.n_chars) for r in found.collect()) == sorted(
        [("1", text(PAGE), len(text(PAGE))), ("2", "", 0), ("2", "", 0), ("None", "", 0)]
    )
    assert html.extract(frame.limit(0)).count() == 0


def test_query(spark):
    """The test pages' articles are an h1 and paragraphs, some never closed."""
    import html as references
    import re

    folder = "/root/testdata/sf0.001"
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    for row in QUERIES["op7_html"](spark, folder).collect():
        article = re.search("<article>(.*?)</article>", pages[row.page_id], re.S).group(1)
        parts = [" ".join(references.unescape(re.sub("<[^>]+>", "", p.replace("<br>", " "))).split())
                 for p in re.split("</?(?:p|h1)>", article)]
        assert row.text == "\n\n".join(p for p in parts if p)
        assert row.n_chars == len(row.text)
