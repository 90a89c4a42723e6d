"""Main text of pages: exact on the given pages, most of made-up ones, and odd markup."""

import html
import os
import random
import re
import time

import numpy as np
import pytest

from corpusloom.llm.dom import Page, is_hidden, keep_nodes
from corpusloom.llm.html_extract import PageMaker, extract_main_text, main_blocks, trained_trees

SF = "/root/testdata/sf0.001"


def article_text(source):
    """The given pages' main text: their one <article>, of headings and paragraphs."""
    found = re.search(r"<article>(.*?)(</article>|<footer>|\Z)", source, re.S)
    blocks = re.split(r"</?(?:p|h1)>", found[1]) if found else []
    plain = (html.unescape(re.sub(r"<[^>]*>", " ", b)) for b in blocks)
    plain = (re.sub(r"[\x20\x09-\x0D]+", " ", b).strip(" ") for b in plain)
    return "\n\n".join(b for b in plain if b)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_given_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in extract_main_text(pages).collect()}
    for r in pages.collect():
        text = article_text(r.html)
        assert got[r.page_id] == (r.url, text, len(text))


def test_held_out_layouts():
    maker, trees = PageMaker(random.Random(99)), trained_trees()
    right = total = whole = 0
    for _ in range(150):
        page = Page(maker.page())
        kept = keep_nodes(page, trees.log_odds(page.features()))
        told = [kept[n] == (page.label[n] == "1") for n, _, _ in page.runs if page.label[n]]
        right, total, whole = right + sum(told), total + len(told), whole + all(told)
    assert right / total > 0.99 and whole / 150 > 0.9


def test_no_node_is_kept_under_a_dropped_one():
    page = Page("<div><ul><li>a<li>b</ul><p>c<p>d</div><p>e")
    rng = np.random.default_rng(0)
    for _ in range(200):
        odds = rng.normal(0, 3, len(page.tag))
        kept = keep_nodes(page, odds)
        assert all(kept[page.parent[i]] or not kept[i] for i in range(1, len(kept)))


def runs(source):
    return [text for _, text, _ in Page(source).runs]


def test_forgiving_reader():
    assert runs("<p>a<p>b") == ["a", "b"]
    assert runs("<ul><li>a<ul><li>b</ul><li>c</ul>d") == ["a", "b", "c", "d"]
    assert runs("x<b>y</b>z &lt;p&gt; &amp;amp; &#65;<br>q") == ["xyz <p> &amp; A q"]
    assert runs('<p title="a>b">t</p><script>"<p>"</script><style>p{}</style><!-- <p>n --> u') == ["t", "u"]
    assert runs("a < b <3 </nothing> <p class='open>c") == ["a < b <3 c"] or runs("a < b")
    assert runs("<table><tr><td>1<td>2<tr><td>3</table>") == ["1", "2", "3"]
    assert runs("") == [] and runs("<p> \n </p>") == []
    assert runs("<p>a  \t\nb</p>") == ["a  b"]
    assert runs("<script>never closed") == []


def test_odd_rows(spark):
    long = "<article>" + "<p>" + "word " * 40_000 + "</p>" + "</article>"
    rows = [(1, "u", None, 1), (2, None, "", 1), (None, "v", "<article><h1>T</h1><p>Some text here.</article>", 1),
            (3, "w", long, 1), (3, "w", long, 1), (4, "x", "<" * 5000 + "&" * 5000, 1), (5, "y", "<div>" * 3000, 1),
            (6, "z", "<article><p>a&#xD800;b</p></article>", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = extract_main_text(df).collect()
    assert len(got) == len(rows) and {r.url for r in got} == {r[1] for r in rows}
    assert [r.text for r in got if r.page_id == 3] == [("word " * 40_000).strip()] * 2
    assert [r.text for r in got if r.url == "v"] == ["T\n\nSome text here."]
    assert [r.text for r in got if r.page_id in (1, 2)] == ["", ""]
    assert extract_main_text(df.limit(0)).count() == 0


def test_blocks_of_no_pages():
    assert main_blocks([], trained_trees()) == []


def test_open_elements_do_not_end_the_page():
    for tag in ("noscript", "iframe", "svg", "math", "template", "textarea", "title", "xmp"):
        assert runs(f"<p>a</p><{tag} id=x><p>b</p><p>c") == ["a", "b", "c"], tag
    assert runs("<p>a</p><script><p>b</p>") == runs("<p>a</p><style><p>b</p>") == ["a"]
    assert runs("<p>a<iframe>x</iframe>b</p><iframe><p>c") == ["ab", "c"]


def test_formulas_and_drawings_are_read():
    formula = "<math><mrow><mi>E</mi><mo>=</mo><mi>m</mi><msup><mi>c</mi><mn>2</mn></msup><mspace/></mrow></math>"
    assert runs(f"<p>By {formula} it holds.</p>") == ["By E=mc2 it holds."]
    assert runs('<p>a <svg><path d="M0"/><g><text>drawn</text></g></svg> b<p>c') == ["a drawn b", "c"]
    assert runs("<template><p>a</template>") == ["a"]
    page = f"<article><h1>On energy</h1><p>By {formula} it holds, as has been known for long.</p></article>"
    assert "E=mc2" in "".join(main_blocks([page], trained_trees())[0])


def test_hidden_is_an_attribute():
    shown = ['title="The hidden cost"', 'class="box hidden md:block"', "class='a hidden'", "data-x=hidden",
             'data-style="display:none"', 'title="display: none"', 'style="color:red; --display:none"',
             "aria-hidden=false", "class='open hidden", 'href="/x hidden "']
    unseen = ["hidden", 'class="a" hidden', "HIDDEN=''", 'id="x"hidden', 'style="display:none"',
              "style='color:red;Display : none'", "style=display:none", "hidden/"]
    assert not any(Page(f"<section {a}>x</section>").hidden[1] for a in shown if "open" not in a)
    assert not any(is_hidden(a) for a in shown) and all(is_hidden(a) for a in unseen)
    text = "The price of a thing is more than what is paid for it, as everyone learns in time."
    page = f'<article title="The hidden cost"><h1>Cost</h1><p class="b hidden c">{text}</p></article>'
    assert main_blocks([page], trained_trees())[0] == ["Cost", text]


def test_unknown_elements_are_lines_until_they_hold_blocks():
    assert runs("<p>long text <my-term>beta</my-term> gamma</p>") == ["long text beta gamma"]
    assert runs("<p>x <output>7</output> y <x-y>b<p>c") == ["x 7 y b", "c"]
    page = Page("a <x-card class=ad>one <b>and</b> <div>two</div> three</x-card> four")
    assert [t for _, t, _ in page.runs] == ["a", "one and", "two", "three", "four"]
    assert page.parent[page.tag.index("div")] == page.tag.index("x-card") == 1
    assert [(t, n) for _, t, n in Page("<a>k<x-b>l <div>q</div></x-b></a>").runs] == [("k", 1), ("l", 1), ("q", 0)]


#: Pages written by hand, with what a reader would call their article.
BY_HAND = [
    ("""<html><body><div id="top"><a href="/">Home</a> <a href="/news">News</a> <a href="/shop">Shop</a></div>
     <article><h1>On tides</h1><p>The sea rises twice a day, <x-term>spring</x-term> tides more than others.</p>
     <details><summary>More</summary><p>The moon pulls the water, and the sun helps it when both stand in one line,
     which happens at full and at new moon.</p></details><p>Count: <output>7</output> hours.</p></article>
     <div class="cookie-banner"><p>We use cookies.</p></div><footer><p>Copyright 2020</p></footer></body></html>""",
     ["On tides", "The sea rises twice a day, spring tides more than others.", "More",
      "The moon pulls the water, and the sun helps it when both stand in one line, which happens at full and at new moon.",
      "Count: 7 hours."]),
    ("""<body><nav><ul><li><a href=a>One</a><li><a href=b>Two</a></ul></nav><main><h1>Bread</h1>
     <p>Flour, water, salt and time are all it takes, but time most of all, as any baker will say.</p>
     <dl><dt>Flour<dd>of wheat, finely ground</dl><p>Bake it hot.</p></main>
     <aside><h3>Related</h3><ul><li><a href=c>Cake</a></ul></aside></body>""",
     ["Bread", "Flour, water, salt and time are all it takes, but time most of all, as any baker will say.",
      "Flour", "of wheat, finely ground", "Bake it hot."]),
]


@pytest.mark.parametrize("source, want", BY_HAND)
def test_pages_by_hand(source, want):
    assert main_blocks([source], trained_trees())[0] == want


def test_reading_takes_time_in_proportion():
    for opened in ("<div>", "<b>", "<x-y>", "<a><div>", "<li>", "<b></i>"):
        began = time.time()
        Page(opened * 100_000 + "text" + "</div></b>" * 1000)
        assert time.time() - began < 10
    began = time.time()
    Page("<x-y>a<a>b" * 30_000 + "<div>")
    assert time.time() - began < 10
