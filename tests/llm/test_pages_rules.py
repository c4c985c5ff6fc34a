"""Main text of pages and host rules against plain Python."""

import html
import random
import re
import time
from collections import Counter

import numpy as np
import pytest

from textprep.llm import host_rules, main_text
from textprep.llm.page_tree import Forest


@pytest.fixture(scope="module")
def model():
    return main_text.train([f"{a}{b}" for a in ("wor", "tex", "blu", "stra") for b in ("d", "t.", "m,", "ße", "é", "on")])


def plain(page):
    """The article of the given pages, whose markup is regular."""
    article = re.search(r"<article>(.*?)</article>", page, re.S).group(1)
    blocks = [re.sub(r"</?b>", "", b.replace("<br>", " ")) for b in re.split(r"</?(?:p|h1)>", article)]
    return "\n\n".join(b for b in (" ".join(html.unescape(b).split()) for b in blocks) if b)


def test_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    found = {r.page_id: r for r in main_text.main_texts(spark, pages).collect()}
    rows = pages.collect()
    assert len(found) == len(rows)
    for row in rows:
        assert found[row.page_id].text == plain(row.html) and found[row.page_id].n_chars == len(plain(row.html))


def test_other_layouts(model):
    """Pages of forms that the trees have not seen: nearly all text nodes are judged right."""
    draw, forest = random.Random(12345), Forest()
    for _ in range(150):
        forest.add(main_text._layout(draw, ["some", "other", "words.", "here"]), labelled=True)
    truth, kept = main_text._labels(forest), model.kept(forest)
    nodes = np.unique(forest.text_node)
    nodes = nodes[np.array(forest.depth)[nodes] > 0]
    assert (truth[nodes] == kept[nodes]).mean() > 0.985


def test_decoding_is_consistent(model):
    forest = Forest()
    draw = random.Random(7)
    for _ in range(50):
        forest.add(main_text._layout(draw, ["a", "b"]), labelled=True)
    kept, parent = model.kept(forest), np.array(forest.parent)
    assert not (kept & ~kept[parent]).any()


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body>
<header class="site-header"><h1>Site</h1><nav><ul><li><a href=/>Home</a></li><li><a href="/x">News</a></li></ul></nav></header>
<div id="cookie-notice">We use <b>cookies</b>.<button>OK</button></div>
<main><article class="post"><h1>The &lt;big&gt; title</h1><p>First&nbsp;paragraph,
  with <i>inline</i> marks&#33;<p>Second &eacute; one<br>goes on<ul><li>point one<li>point two</ul>
<div class="advertisement"><p>Buy now, cheap</p></div><script>if (a < b) document.write("<p>no</p>")</script>
<blockquote>A quotation of some length stands here.</blockquote><p style="display: none">hidden</p></article>
<section class="comments"><h3>Comments</h3><div class="comment"><p>I liked it a lot</p></div></section></main>
<aside class="sidebar"><h3>Related</h3><ul><li><a href=/1>One</a></li><li><a href=/2>Two</a></li></ul></aside>
<form class="newsletter"><label>Mail</label><input type=text></form><footer>&copy; Site <!-- <p>x</p> --></footer></body></html>"""


def test_one_page(model):
    assert model.texts([PAGE])[0].split("\n\n") == [
        "The <big> title", "First paragraph, with inline marks!", "Second é one goes on", "point one", "point two",
        "A quotation of some length stands here.",
    ]


def test_hidden_by_attributes_only():
    """Words in attribute values hide nothing; hidden, aria-hidden and display: none do, in any form."""
    seen = [
        'title="The hidden cost of rain"', 'aria-label="A hidden history"', 'class="md hidden lg"', "title='x hidden=1'", 'aria-hidden="false"',
        'data-x="display: none"', 'title="aria-hidden=true"', 'data-hidden="1"', 'style="display: block"', '[hidden]="x"', "",
    ]
    unseen = [
        "hidden", 'class="a" HIDDEN', 'hidden=""', "hidden='hidden' id=x", "aria-hidden=true", 'aria-hidden = "TRUE"', "style=display:none",
        'style="color: red; Display : none"', "title='x' hidden",
    ]
    for tag in ("a", "section", "article"):
        for attributes in (*seen, *unseen):
            forest = Forest()
            forest.add(f"<body>before<{tag} {attributes}>its <b>text</b></{tag}>after</body>")
            assert ("".join(forest.text) == "beforeits textafter") == (attributes in seen), attributes


def test_marks_of_training_are_read_in_training_only():
    for value in ("yes", "", "0", "1.5", "0x1", "-1"):
        forest = Forest()
        forest.add(f"<article data-main='{value}'><p data-main=\"{value}\">text</p></article>")
        assert set(forest.label) == {-1} and forest.text == ["text"]


def test_broken_pages_take_time_by_their_length():
    """100,000 nested elements, a megabyte without a tag's end, quotes that never close, ends of nothing."""
    pages = {
        "nested": "<div>" * 100_000, "mixed": "<p><b><li>" * 40_000, "unterminated": "<a b " * 200_000, "quotes": '<a b=">" ' * 60_000,
        "one quote": "<a b='x>" * 100_000, "ends": "<b>" * 40_000 + "<div>" * 40_000 + "</b>" * 40_000, "of nothing": "<div>" * 20_000 + "</i></zz>" * 60_000,
        "comments": "<!-- " * 100_000, "declared": "<!x " * 100_000,
    }
    for name, page in pages.items():
        start = time.process_time()
        forest = Forest()
        forest.add(page + "end")
        assert time.process_time() - start < 10, name
    assert Forest().pages == 0


def test_text_of_pictures_and_players(model):
    extra = "<svg><text>A label</text></svg><video>no video <track></video><canvas>drawn</canvas><audio>no sound</audio>"
    page = PAGE.replace("<p>Second", f"<p>Shown: {extra} here.<p>Second")
    assert "Shown: A labelno video drawnno sound here." in model.texts([page])[0].split("\n\n")


def test_math_and_object_text(model):
    page = PAGE.replace("<p>Second", "<p>The sum <math><mi>x</mi><mo>+</mo><mn>2</mn></math> is shown, <object data=a><param name=b>a fallback</object> too.<p>Second")
    assert page != PAGE and "The sum x+2 is shown, a fallback too." in model.texts([page])[0].split("\n\n")


def test_odd_pages(spark):
    rows = [
        (1, "u", None), (2, None, ""), (None, "u", PAGE), (4, "u", "<"), (5, "u", "<p"), (6, "u", "plain text, no markup"), (7, "u", "</div></p>"),
        (8, "u", "<article>" + "<div>" * 3000 + "deep down are words of text" + "</div>" * 10), (9, "u", "<article><p>" + "very long. " * 200_000),
        (1, "u", None), (10, "u", "<article><p title='a>b'>x y z are here &#0; &#xD800; &bogus;</article>"), (11, "u", "<!-- open <article><p>no"),
        (12, "u", "<script>never closed <p>x"),
    ]
    pages = spark.createDataFrame([(*r, 1, "t") for r in rows], "page_id bigint, url string, html string, n_chars int, text string")
    found = main_text.main_texts(spark, pages).collect()
    assert len(found) == len(rows) and all(r.n_chars == len(r.text) for r in found)
    of = {r.page_id: r.text for r in found}
    assert of[1] == of[2] == of[7] == of[11] == of[12] == "" and of[6] == "plain text, no markup"
    assert len(of[9]) == 11 * 200_000 - 1 and of[8] == "deep down are words of text"
    assert of[10] == "x y z are here � � &bogus;"
    assert main_text.main_texts(spark, pages.where("false")).count() == 0


def plain_measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows, covered = Counter(zip(words, words[1:], words[2:])), set()
    for k in range(len(words) - 2):
        if windows[tuple(words[k : k + 3])] > 1:
            covered |= {k, k + 1, k + 2}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def test_measures(spark, more_documents, odd_docs, no_docs):
    extra = spark.createDataFrame(
        [(1, "a a a a a"), (2, "a b a b a"), (3, "a b c x a b c y b c x"), (4, "x\n\n \nx\n\tx\nx"), (5, "\x1c\xa0 é|漢 z"), (6, "a b"), (7, "🙂 #🙂")],
        "doc_id bigint, text string",
    ).selectExpr("*", "'h' AS source")
    for table in (more_documents, odd_docs, extra, no_docs):
        found = host_rules.rule_verdicts(table)
        expected = [(r.doc_id, *plain_measures(r.text)) for r in table.select("doc_id", "text").collect()]
        assert sorted((tuple(r) for r in found.select("doc_id", *MEASURES).collect()), key=str) == sorted(expected, key=str)
        assert found.where("kept AND base_failed").count() == 0


def test_hosts(spark):
    """A host of bad texts is rejected as a whole; small and good hosts keep their good texts."""
    good = " ".join(f"w{i}" for i in range(60))
    rows = [(i, good + str(i), "good") for i in range(300)] + [(1000 + i, "bad", "bad") for i in range(95)]
    rows += [(2000 + i, good, "bad") for i in range(5)] + [(3000, "bad", "tiny"), (3001, good, "tiny"), (4000, good, None), (4001, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    found = {r.doc_id: r for r in host_rules.rule_verdicts(docs).collect()}
    assert len(found) == len(rows)
    assert all(found[i].kept for i in [*range(300), 3001, 4000]) and not any(found[2000 + i].kept for i in range(5))
    assert found[0].host_rate < found[3001].host_rate < 0.5 < found[2000].host_rate < 0.95
    plan = host_rules.measures(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
