"""Main text of pages."""

import pytest
from pyspark.sql import functions as F

from certlens.llm import html_extract as H

P1 = "A first paragraph of the article, with commas, and a full stop."
P2 = "The second one says more; it is longer, has several clauses, and ends here."
PAGE = f"""<!DOCTYPE html><html lang="en"><head><title>T</title><style>p{{x:1}}</style><script>var a="</p><p>no</p>";</script></head><body>
<header><h1>Site name</h1></header><nav><ul><li><a href="/a">Menu one</a></li><li><a href="/b">Menu two</a></li></ul></nav><!-- <p>hidden</p> -->
<div class="cookie-notice">We use cookies, you know, and we want you to accept all of them.</div><div id="ad-1">Buy this, buy that, and buy more today.</div>
<main><article><header><h1>Headline</h1></header><p>{P1}<p>A <b>bold</b> and <a href="x">linked</a> word<br>and&nbsp;an &amp; entity &#233;.</p>
<ul><li>Item one.</li><li>Item two.</ul><p>{P2}</p></article></main>
<aside><p>Related: something else, quite long, with commas, too.</p></aside><section class="comments"><p>Nice article, I liked it, really.</p></section>
<form><label>Name</label><p>Sign up, please.</p></form><footer>&copy; Site, all rights, reserved.</footer></body></html>"""
TEXT = f"Headline\n{P1}\nA bold and linked word and an & entity é.\nItem one.\nItem two.\n{P2}"


def test_article_alone():
    assert H.extract(PAGE) == TEXT


@pytest.mark.parametrize("page, text", [
    ("", ""), ("<html></html>", ""), ("<p>", ""), ("plain text, no tags.", "plain text, no tags."), ("<p>a<p>b", "a\nb"), ("<div><p>unclosed <b>bold", "unclosed bold"),
    ("<p>x</p></div></div><p>y &lt;z&gt;</p>", "x\ny <z>"), ("<script>never ends, alert(1)", ""), ("<p>a < b and c</p>", "a < b and c"), ("<!-- open <p>x</p>", ""),
    ("<p title='a>b'>quoted.</p>", "quoted."), ("<pre>a\n  b</pre>", "a b"), ("<nav>only, a menu.</nav>", ""), ("<body><p hidden>h</p><p>s.</p>", "s."),
    ("<div role='navigation'><p>n, n.</p></div><p>c, c.</p>", "c, c."), ("<P>UP.</P><BR><P>DOWN.", "UP.\nDOWN."),
])
def test_cases(page, text):
    assert H.extract(page) == text


def test_links_count_against_a_path():
    page = "<div><div>" + "".join(f"<span><a href='/{i}'>A long link text number {i}, in a list</a></span>" for i in range(20)) + f"</div></div><p>{P1}</p><p>{P2}</p>"
    assert H.extract(page) == f"{P1}\n{P2}"


def test_unmarked_boxes_beside_a_marked_article():
    box = "<div><p>Some other text of the page, about as long as the article's, with commas.</p></div>"
    assert H.extract(f"<body>{box}<article><h1>Head</h1><p>{P1}</p><p>Yes.</p></article>{box}</body>") == f"Head\n{P1}\nYes."
    assert H.extract(f"<body><main><p>{P1}</p></main>{box}</body>") == P1
    assert H.extract(f"<body><article></article><p>{P1}</p></body>") == P1


LONG = "A sentence of the article, with commas, marks, and a full stop. " * 15


@pytest.mark.parametrize("around", ["<article>{}</article>", "<div class='content has-sidebar'><article>{}</article></div>", "<div class='content has-sidebar'>{}</div>",
                                    "<form id='f'><article>{}</article></form>", "<main>{}</main>", "<div class='widget'><article>{}</article></div>"])
def test_an_article_is_kept_whole(around):
    cells = "<table><tbody>" + "".join(f"<tr><td>c{i:04}</td><td>d{i:04}</td></tr>" for i in range(30)) + "</tbody></table>"
    linked = "<h2><a href='/s'>Linked head</a></h2><ul><li><a href='/1'>First link</a><ul><li>Deep one<ul><li>Deeper</li></ul></li></ul></li></ul>"
    inside = f"<p>{LONG}</p>" * 20 + linked + cells + "<div class='share-price'><p>Up.</p></div>"
    page = f"<html><body><nav><a href='/'>Home</a></nav><div class='main-menu'><p>Menu, menu, menu.</p></div>{around.format(inside)}<div class='page-footer'><p>Foot, foot, foot.</p></div></body></html>"
    cell_lines = [f"{c}{i:04}" for i in range(30) for c in "cd"]
    expected = [LONG.strip()] * 20 + ["Linked head", "First link", "Deep one", "Deeper", *cell_lines, "Up."]
    assert H.extract(page).split("\n") == expected


def test_a_page_of_links_has_no_text():
    assert H.extract("<div><div><ul><li><a href='/a'>One</a></li><li><a href='/b'>Two</a></li></ul></div></div>") == ""


def test_named_containers_go_inside_an_article_too():
    page = f"<article><p>{P1}</p><div class='share'><p>Share this, please.</p></div><section id='comments'><p>{P2}</p></section></article><div class='related'><article><p>{LONG}</p></article></div>"
    assert H.extract(page) == P1
    assert H.extract(f"<div class='related'><article><p>{P2}</p></article></div><div><p>{LONG}</p><p>{P1}</p></div>") == f"{LONG.strip()}\n{P1}"


def test_very_long_page():
    assert H.extract("<p>" + "word, " * 200_000).count("word") == 200_000
    assert H.extract("<div>" * 3000 + "deep, text." + "</div>" * 3000) == "deep, text."


def test_table(spark):
    rows = [(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (2, None, None, None), (3, "v", "", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(H.extract_pages(df).collect(), key=str)
    assert sorted((r.page_id, r.text_, r.n_chars) for r in got) == sorted([(1, TEXT, len(TEXT)), (1, TEXT, len(TEXT)), (2, "", 0), (3, "", 0)])
    assert H.extract_pages(df.limit(0)).count() == 0


def test_given_pages_give_their_article(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    inner = F.regexp_extract("html", "(?s)<article>(.*)</article>", 1)
    bare = F.regexp_replace(F.regexp_replace(inner, "<br>|</?b>", ""), "</?(p|h1)>", "\n")
    got = H.extract_pages(pages.withColumn("bare", bare)).select("bare", "text").collect()
    import html

    for r in got:
        lines = [" ".join(html.unescape(x).split()) for x in r.bare.split("\n")]
        assert r.text == "\n".join(x for x in lines if x)


def test_formulas_and_labels_of_the_article_stay():
    page = "<body><nav>Menu</nav><article><p>We get <math><mi>x</mi><mo>=</mo><mn>4</mn></math> here.</p><p>Pick <label>one</label>, please.</p></article></body>"
    assert H.extract(page) == "We get x=4 here.\nPick one, please."


def test_elements_nested_beyond_the_path_limit():
    """Unclosed tags without end: all text stays, and time follows the page."""
    assert H.extract("<body><article><p>" + "<b>word, " * 20_000 + "</article>").split() == ["word,"] * 20_000
    n = H.DEPTH + 40
    deep = "<div>" * n + f"<p>{P1}</p>" + "</div>" * n
    assert H.extract(f"<body><article><p>{P2}</p>{deep}<p>The end, at last.</p></article></body>") == f"{P2}\n{P1}\nThe end, at last."
