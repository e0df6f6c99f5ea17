from __future__ import annotations

import html
import itertools
import re
import time

import numpy as np
import pytest

from mercato.llm import html_extraction as h
from mercato.llm.html_blocks import blocks_of, plain
from mercato.llm.labelled_pages import labelled_pages
from mercato.llm.queries import LLM_QUERIES


@pytest.fixture(scope="module")
def model():
    return h.trained_model()


def test_whole_table(spark, sf_dir, duck):
    """The test pages hold their text in one article of headings and paragraphs."""
    found = {r.page_id: r for r in LLM_QUERIES["op1_html_extraction"](spark, sf_dir).collect()}
    pages = duck.execute("SELECT page_id, url, html FROM pages").fetchall()
    assert len(found) == len(pages)
    for page_id, url, page in pages:
        article = page[page.index("<article>") + 9 : page.index("</article>")]
        parts = re.split(r"</?(?:p|h1)>", article)
        texts = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", part)).split()) for part in parts)
        want = "\n\n".join(text for text in texts if text)
        row = found[page_id]
        assert (row.text, row.n_chars, row.url) == (want, len(want), url)


def test_pages_of_other_layouts(model):
    wrong = total = 0
    for page, labelled in labelled_pages(150, seed=99):
        blocks = blocks_of(page)
        (_, labels), = h.examples([(page, labelled)])
        assert len(labels) == len(blocks)
        wrong += sum(a != b for a, b in zip(labels, model.labels(blocks)))
        total += len(blocks)
    assert wrong < 0.01 * total


def test_a_page_by_hand(model):
    page = """<html><head><title>T</title><style>p{}</style></head><body>
    <nav><a href=/>Home</a></nav><div class='cookie-consent'>We use cookies to improve.</div>
    <div class='main-content'><h1>Title</h1><p>Some long article text, which goes\n on and on &amp; on. It has &#8220;marks&#8221;.
    <p>Short<br>one.</p><script>if (a < b) x("</p>")</script>
    <section class='comments'><h2>Comments</h2><p>I loved this long article text very much, thanks for all. Great.</p></section></div>
    <div class='sidebar'><p>Related posts are here for you to read.</p></div><footer>c 2020</footer></body></html>"""
    assert model.extract(page) == "Title\n\nSome long article text, which goes on and on & on. It has “marks”.\n\nShort one."


def test_viterbi_finds_the_best_labels():
    pick = np.random.default_rng(2)
    page = "<div class='a'>one</div><p>two words</p><nav>three</nav><li>four</li><p>five.</p>"
    blocks = blocks_of(page)
    for _ in range(20):
        model = h.BlockModel(pick.normal(size=(h.FEATURES, 2)), pick.normal(size=(2, 2)))
        own = [model.weights[h.features_of(b, i, len(blocks))].sum(0) for i, b in enumerate(blocks)]

        def worth(labels):
            return sum(o[x] for o, x in zip(own, labels)) + sum(model.steps[a, b] for a, b in zip(labels, labels[1:]))

        best = max(itertools.product((0, 1), repeat=len(blocks)), key=worth)
        assert tuple(model.labels(blocks)) == best


def test_training_raises_the_likelihood_of_the_labels():
    pages = h.examples(labelled_pages(30, seed=3))
    early, late = h.train(pages, rounds=2), h.train(pages, rounds=80)

    def right(model):
        return sum(
            a == b
            for page, labelled in labelled_pages(30, seed=3)
            for a, b in zip(model.labels(blocks_of(page)), h.examples([(page, labelled)])[0][1])
        )

    assert right(late) > right(early)


@pytest.mark.parametrize(
    ("page", "texts"),
    [
        (None, []),
        ("", []),
        ("<", ["<"]),
        ("a<b and c", ["a"]),
        ("a < b", ["a < b"]),
        ("<p>x &lt;i&gt; y</p>", ["x <i> y"]),
        ("<div>a<p>b<p>c</div>d", ["a", "b", "c", "d"]),
        ("<p>open <b>bold<p>next", ["open bold", "next"]),
        ("<script>a</script>b<style>c", ["b"]),
        ("<!-- x -- > y --><p>z<!-- never closed", ["z"]),
        ("<a title='x > y'>t</a>", ["t"]),
        ("<p title=\"never closed>t</p>", ["t"]),
        ("<td>a<td>b", ["a", "b"]),
    ],
)
def test_blocks(page, texts):
    assert [plain(b.text) for b in blocks_of(page)] == texts


def test_odd_rows(spark, model):
    rows = [(1, "u", None, 1), (None, None, "", 2), (1, "u", None, 1), (2, "u", "<article><p>" + "x y. " * 200_000, 3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    found = sorted((r.n_chars, r.text[:3]) for r in h.extract_pages(pages, model).collect())
    assert found == [(0, ""), (0, ""), (0, ""), (999_999, "x y")]
    assert h.extract_pages(pages.limit(0), model).count() == 0


def test_a_head_without_its_end_tag():
    for page in (
        "<html><head><title>T</title><article><p>Hello</p></article>",
        "<head><meta charset=x><script>a<b</script>Hello",
        "<html><head><title>T</title></head><body><p>Hello",
        "<html><head><link rel=x><body><p>Hello",
    ):
        assert [plain(block.text) for block in blocks_of(page)] == ["Hello"], page


def test_a_telling_id_behind_many_class_words():
    words = " ".join(f"u{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(40))
    (block,) = blocks_of(f'<div class="{words} {words}" id="comments">Hello</div>')
    assert block.marks[-1] == "comments" and len(block.marks) == 41


@pytest.mark.parametrize(
    "piece", ['<a "', "<a '", '<a ">"', "<a", "</title", "<!x", "<b></i>", "<a b='>\"", "<p class=\"x>", "<title></title", "<!--"]
)
def test_odd_markup_takes_time_by_its_length(piece):
    began = time.time()
    blocks_of(piece * (1_000_000 // len(piece)))
    blocks_of("<title>" + piece * (200_000 // len(piece)) + ">")
    assert time.time() - began < 20


def test_quotes_that_never_close_end_at_the_first_bracket():
    assert [b.text for b in blocks_of('<p class="x>one</p><p>two')] == ["one", "two"]
    assert [b.text for b in blocks_of('<p class="a>b">one</p>')] == ["one"]
    far = "x" * 9000
    assert [b.text for b in blocks_of(f'<p class="a>{far}">one</p><p title=">two</p>')] == ["one", "two"]
