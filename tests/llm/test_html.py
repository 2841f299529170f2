"""Main text of pages: messages against brute force, given pages against their marks, other layouts."""

import html
import itertools
import os
import re
import time

import numpy as np
import pytest

from lakescribe.llm import html_extract as h

SF = "/root/testdata/sf0.01"
given = pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables aren't here")


def test_messages_are_exact():
    rng = np.random.default_rng(0)
    for _ in range(20):
        n = 7
        parents = np.array([-1, *[int(rng.integers(-1, k)) for k in range(1, n)]])
        own, edges = rng.normal(0, 2, n), np.log(rng.dirichlet([1, 1], 2))
        total = np.zeros(n)
        mass = 0.0
        for y in itertools.product((0, 1), repeat=n):
            p = np.exp(sum(own[k] * y[k] for k in range(n)) + sum(edges[y[parents[k]], y[k]] for k in range(n) if parents[k] >= 0))
            mass += p
            total += p * np.array(y)
        assert np.allclose(h.marginals(parents, own, edges), total / mass)


def _truth(page):
    a = page[page.index("<article>") + 9 :]
    a = a[: a.index("</article>")] if "</article>" in a else a
    blocks = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]+>", " ", re.sub(r"</?b>", "", x)))).strip() for x in re.split(r"</?(?:p|h1|li|ul)>", a)]
    return "\n".join(x for x in blocks if x)


@pytest.fixture(scope="module")
def model(spark):
    if not os.path.isdir(SF):
        return h.train([])
    return h.fit(spark.read.parquet(f"{SF}/pages.parquet"))


@given
def test_given_pages(spark, model):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    found = {r["page_id"]: (r["text"], r["n_chars"]) for r in h.extract_text(pages, model).collect()}
    want = {r["page_id"]: _truth(r["html"]) for r in pages.collect()}
    assert found == {k: (t, len(t)) for k, t in want.items()}


CASES = [
    ("", ""),
    ("plain text only, no markup at all here.", "plain text only, no markup at all here."),
    ("<p>One.<p>Two &lt;b&gt;<script>if(a<b){}</script>three", "One.\nTwo <b>three"),
    ("<article><p>a &amp;amp; b&nbsp;c<br>d</p></article>", "a &amp; b c d"),
    (
        "<html><body><header class=top><a href=/>Home</a></header><div id=sidebar><h3>Related</h3><ul><li><a href=x>Link one</a></ul></div><div class='post-content'><h1>Great news</h1><p>This is the first paragraph of the story, "
        "with enough words to be real.<p>Second paragraph, it ends here.<aside>Buy now!</aside><form><label>Email</label></form></div><div class=comments><p>I disagree with this, said a reader in many words, and more.</p></div>"
        "<div class='cookie-notice'>We use cookies to improve your experience on this site.</div><footer>&copy; 2024</footer>",
        "Great news\nThis is the first paragraph of the story, with enough words to be real.\nSecond paragraph, it ends here.",
    ),
    ("<article><p>The value is <math><mi>x</mi><annotation>x</annotation></math> here, as <object>a drawing</object> and <canvas>a curve</canvas> show, in full.</p></article>", "The value is x here, as a drawing and a curve show, in full."),
    (
        "<article><h1>A study</h1><p>It starts with words, and goes on.</p><section id='related-work'><h2>Related work</h2><p>Others have done this before, in other words.</p></section><p class='alert'>Take care of the second step.</p>"
        "<p role=alert>You are offline.</p><div class='ad'>Buy now, and cheap.</div><div class=comments><p>I was first, said a reader of this page.</p></div><noscript>A picture, in words.</noscript></article>",
        "A study\nIt starts with words, and goes on.\nRelated work\nOthers have done this before, in other words.\nTake care of the second step.\nA picture, in words.",
    ),
    ("<article><p title='a > b' class=x>One &#x41;&AMP;B <x-y>two</x-y> < three <!-- > --> four<![CDATA[<five>]]></article>", "One A&B two < three four<five>"),
    ("<table><tr><td class=menu><a>One</a><td>The long text of a page that is laid out by a table, as in old times. It goes on.</table>", "The long text of a page that is laid out by a table, as in old times. It goes on."),
]


@pytest.mark.parametrize(("page", "text"), CASES)
def test_layouts(model, page, text):
    assert h.main_text(page, model) == text


@pytest.mark.parametrize("unit", ["<a", '<p a="', "<p a='", "<!--", "<b>", "<div>", "<i><div><b>", "<li>", "</x>", "<b></i>", "<b><hr>", "<p a=b\"c>", "&", "<script>", "<?", "<x y=\">", "<![CDATA["])
def test_time_is_linear(unit):
    taken = []
    for size in (250_000, 1_000_000):
        began = time.process_time()
        h.parse(unit * (size // len(unit)) + "the end, in words.")
        taken.append(time.process_time() - began)
    assert taken[1] < 12 * taken[0] + 0.5 and taken[1] < 10


def test_time_of_open_elements():
    for page in ("<i><div>" + "<b>" * 150_000 + "</i>" * 150_000, "<ul>" + "<div>" * 600 + "<li></li>" * 50_000, "<li>" + "<div>" * 500 + "<ul></ul><li></li>" * 20_000):
        began = time.process_time()
        h.parse(page)
        assert time.process_time() - began < 10


def test_weights_of_names_are_learned():
    """Where labelled pages mark text of a class as content, it becomes content beside a mark too."""
    page = "<body><main><h1>News</h1>" + "<div class='sponsor'><p>The words of the story, and more of them here.</p></div>" * 6 + "</main></body>"
    nodes = h.parse(page)
    trained = h.train([(*h.rows_of(nodes), h.labels_of(nodes))] * 30)
    k = h.N_FEATURES - 8 - len(h.NAMES) + [n for n, _ in h.NAMES].index("advert")
    assert trained.weights[k] > h.usual_weights()[k] + 0.5


def test_odd_rows(spark, model):
    rows = [(1, None, None, "t"), (None, "u", "<p>" * 3000 + "deep words, and more of them.", "t"), (3, "u", "<" * 20000, "t"), (3, "u", "<a b='" + "x" * 50000, "t"), (5, "u", "<!-- open", "t"), (5, "u", "<!-- open", "t")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    found = h.extract_text(pages, model).collect()
    assert len(found) == 6 and next(r for r in found if r["page_id"] == 1)["text"] == ""
    assert h.extract_text(pages.where("false"), h.fit(pages.where("false"))).count() == 0


WHOLE = [
    ("<article><h1>T</h1><p>A story of some words, and more.</p><table><tr><td>Year<td>Value<tr><td>cell one<td>cell two</table></article>", "T\nA story of some words, and more.\nYear\nValue\ncell one\ncell two"),
    ("<article><p>A story of words.</p><div class='share'>In this section we share our findings, with care.</div><div class='banner'>A long sentence of the story, which goes on.</div></article>", "A story of words.\nIn this section we share our findings, with care.\nA long sentence of the story, which goes on."),
    ("<article><p>Story words, with more.</p><div class=share><a href=1>Twitter</a> <a href=2>Facebook</a></div></article>", "Story words, with more."),
    ("<body><main><p>A story of words here.</p><p><a href=x>Read this</a></p></main>", "A story of words here.\nRead this"),
    ("<p>Shown <span HIDDEN>secret words</span><span STYLE='DISPLAY:NONE'>more</span> and shown again, in words.</p><p ARIA-HIDDEN='True'>Never said, in any words.</p>", "Shown and shown again, in words."),
    ("<p style='" + "color:red;" * 500 + "display:none'>Hidden words are here, in full.</p><p class='" + "x " * 9000 + "'>Shown words are here, in full.</p>", "Shown words are here, in full."),
    ("<article>" + "<div>" * 520 + "<form><p>Your name, please.</p></form><b hidden>no</b><nav><p>The way home, in some words.</p></nav><p>The deep words of a story, in full.</p>" + "</div>" * 520 + "<p>And the words after it.</p></article>", "The deep words of a story, in full.\nAnd the words after it."),
]


@pytest.mark.parametrize(("page", "text"), WHOLE)
def test_nothing_of_an_article_is_lost(model, page, text):
    assert h.main_text(page, model) == text


def _site(marked, k):
    """A page of a site that calls its parts by names of its own."""
    story = f"<h2>Number {k}</h2><p>Short one</p><ul><li>item {k}</li></ul>"
    junk = f"<div class='zq-rail'><p>These are some long words beside the story, number {k}, and they go on.</p></div>"
    return f"<body><div class='zq-top'><p>Also by us, as you know it, in full sentences.</p></div>{'<main>' if marked else ''}<div class='zq-words'>{story}</div>{'</main>' if marked else ''}{junk}</body>"


def test_training_tells_sites_apart(spark):
    """From marked pages of a site its pages without marks are learned; the usual weights alone get them wrong."""
    pages = spark.createDataFrame([(k, _site(True, k)) for k in range(60)], "page_id long, html string")
    trained, usual = h.fit(pages), h.train([])
    right = [f"Number {k}\nShort one\nitem {k}" for k in range(20)]
    assert [h.main_text(_site(False, k), trained) for k in range(20)] == right
    assert all(h.main_text(_site(False, k), usual) != t for k, t in enumerate(right))
