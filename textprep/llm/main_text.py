"""Main text of web pages: gradient-boosted trees over features of DOM nodes, decoded down the tree.

A node's features are its tag and its ancestors' kinds, the learned weight of its class, id and role names, depth, place among
siblings, and the density of its subtree: text, links, marks, paragraphs, list items. The trees give each node the
probability of holding main text. Decoding chooses the likeliest set of nodes in which a node is kept only
if its parent is, so that no verdict on a node contradicts that on an ancestor or descendant.

Pages carry no labels, so the trees are trained on pages laid out here at random (menus, notices, adverts, sidebars, forms,
comments and articles in many forms of markup) and filled with words of a bounded sample of the given pages.
"""

from __future__ import annotations

import random
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from textprep.llm.annotate import annotated, free_name
from textprep.llm.page_tree import ATTRIBUTE_BUCKETS, N_TAGS, TAGS, Forest

SAMPLE_PAGES = 200  # the bound of the sample whose words fill the training pages
SAMPLE_WORDS = 50  # of each
LAYOUTS = 320
TREES, DEPTH, BINS, RATE = 40, 4, 32, 0.25
PIECE_BYTES = 1 << 20

_KINDS = [["nav"], ["header"], ["footer"], ["aside"], ["form", "button", "select", "label"], ["article", "main"], ["ul", "ol", "dl"], ["table"], ["a"], ["p", "blockquote", "pre"]]
_KIND_OF_TAG = np.zeros((len(_KINDS), N_TAGS), bool)
for _row, _names in enumerate(_KINDS):
    _KIND_OF_TAG[_row, [TAGS.index(n) for n in _names]] = True
_SHOWN_TAGS = [TAGS.index(t) for t in ("div", "section", "article", "main", "p", "h1", "h2", "h3", "li", "a", "span", "blockquote", "pre", "figure", "td", "body", "html")]


def _by_depth(depth: np.ndarray) -> list[np.ndarray]:
    order = np.argsort(depth, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(depth[order])) + 1)


def features(forest: Forest, names: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(nodes x features, nodes by depth); `names` has the weight of each hashed attribute name."""
    parent, tag, depth = (np.array(x) for x in (forest.parent, forest.tag, forest.depth))
    n, levels = len(parent), _by_depth(depth)
    node = np.array(forest.text_node, np.int64)
    texts = forest.text
    own = np.zeros((n, 6))
    measured = np.array([(len(t) - t.count(" "), t.count(" "), t.count(".") + t.count(","), t.count("|"), 1.0) for t in texts]).reshape(-1, 5)
    for k in range(5):
        own[:, k] = np.bincount(node, weights=measured[:, k], minlength=n)
    own[:, 5] = 1  # nodes
    kinds = _KIND_OF_TAG[:, tag].T
    above = kinds.copy()
    weight = np.zeros(n)
    if forest.token:
        weight = np.bincount(np.array(forest.token_node), weights=names[np.array(forest.token)], minlength=n)
    worst = weight.copy()
    for level in levels[1:]:
        above[level] |= above[parent[level]]
        worst[level] = np.minimum(worst[level], worst[parent[level]])
    link = np.where(above[:, 8], own[:, 0], 0)
    within = np.column_stack([own, link, tag == TAGS.index("p"), tag == TAGS.index("li"), tag == TAGS.index("a")]).astype(float)
    for level in reversed(levels[1:]):
        np.add.at(within, parent[level], within[level])
    chars, blanks, marks, bars, pieces, nodes, links, paragraphs, items, anchors = within.T
    page = np.array(forest.page)
    roots = np.flatnonzero(depth == 0)
    total = chars[roots][page]
    before = np.cumsum(own[:, 0]) - own[:, 0]
    start = before - before[roots][page]
    place = np.array(forest.place, float)
    siblings = np.zeros(n)
    np.maximum.at(siblings, parent, place + 1)
    up = parent
    safe = np.maximum(chars, 1)
    columns = [
        *(tag == t for t in _SHOWN_TAGS), *above.T,
        weight, weight[up], worst,
        np.log1p(chars), chars / np.maximum(total, 1), chars / np.maximum(chars[up], 1), links / safe, marks / safe, bars / safe,
        chars / np.maximum(nodes, 1), chars / np.maximum(pieces, 1), np.log1p(blanks), np.log1p(nodes), np.log1p(paragraphs),
        np.log1p(items), anchors / nodes, items / nodes, links[up] / np.maximum(chars[up], 1), np.log1p(paragraphs[up]),
        depth, place, siblings[up], start / np.maximum(total, 1), (start + chars) / np.maximum(total, 1), own[:, 0] / safe,
    ]
    return np.column_stack(columns).astype(np.float32), levels


@dataclass
class Model:
    names: np.ndarray
    feature: np.ndarray  # trees x inner nodes
    limit: np.ndarray
    leaf: np.ndarray  # trees x leaves
    start: float

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.start), np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, limit, leaf in zip(self.feature, self.limit, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[rows, feature[at]] > limit[at])
            total += leaf[at - inner]
        return total

    def kept(self, forest: Forest) -> np.ndarray:
        """Nodes of the likeliest consistent choice; ties are kept. The root of a page is always kept."""
        x, levels = features(forest, self.names)
        odds = np.clip(self.log_odds(x), -12, 12)
        keep, drop = -np.logaddexp(0, -odds), -np.logaddexp(0, odds)
        parent = np.array(forest.parent)
        for level in reversed(levels[1:]):
            np.add.at(keep, parent[level], np.maximum(keep[level], drop[level]))
            np.add.at(drop, parent[level], drop[level])
        chosen = np.ones(len(parent), bool)
        for level in levels[1:]:
            chosen[level] = chosen[parent[level]] & (keep[level] >= drop[level])
        return chosen

    def texts(self, pages: list[str]) -> list[str]:
        forest = Forest()
        for page in pages:
            forest.add(page)
        return forest.blocks(self.kept(forest)) if pages else []


# -- training -------------------------------------------------------------------------------------------------------

# Names that web pages give to the parts in question.
BOILERPLATE = {
    "nav": "nav navbar navigation menu main-menu topnav breadcrumb breadcrumbs pagination pager toolbar tabs skip-links",
    "header": "header site-header masthead page-header top-bar banner logo branding topbar",
    "footer": "footer site-footer page-footer copyright legal colophon credits bottom disclaimer",
    "aside": "sidebar side-bar widget related related-posts recommended trending popular more-stories rail secondary tags tag-cloud archive",
    "notice": "cookie cookie-notice cookie-banner consent gdpr notice alert popup modal overlay paywall notification toast",
    "ad": "ad ads advert advertisement ad-slot sponsor sponsored promo promotion banner-ad adsbygoogle affiliate",
    "form": "newsletter subscribe signup search search-form login contact-form feedback poll survey register",
    "comments": "comments comment-list comment respond discussion replies reader-comments disqus comment-body reactions",
    "share": "share sharing social social-links share-buttons follow toolbox print-links rating",
}
ARTICLE_NAMES = "article post content entry entry-content post-content article-body story main main-content body text article-text page-content hentry".split()
NEUTRAL_NAMES = "container wrapper row col inner page layout grid box wrap block section outer group clearfix".split()


def _layout(draw: random.Random, words: list[str]) -> str:
    """A random page; `data-main` marks what is main text and what is not."""

    def some(low: int, high: int) -> str:
        return " ".join(draw.choice(words) for _ in range(draw.randint(low, high)))

    def named(names: list[str], odds: float = 0.9) -> str:
        if draw.random() > odds:
            return ""
        kind = draw.choice(["class", "class", "class", "id"])
        extra = f" {draw.choice(NEUTRAL_NAMES)}" if kind == "class" and draw.random() < 0.3 else ""
        return f' {kind}="{draw.choice(names)}{extra}"'

    def link(low: int = 1, high: int = 3) -> str:
        return f'<a href="/{draw.choice(words)}">{some(low, high)}</a>'

    def links() -> str:
        return "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(draw.randint(2, 9))) + "</ul>"

    def boilerplate(kind: str) -> str:
        names = BOILERPLATE[kind].split()
        tags = {"nav": ["nav", "nav", "div", "ul"], "header": ["header", "div"], "footer": ["footer", "footer", "div"], "aside": ["aside", "div", "section"],
                "ad": ["div", "div", "aside", "ins", "section"], "form": ["form", "form", "div"], "comments": ["section", "div", "ol"]}
        tag = draw.choice(tags.get(kind, ["div", "section"]))
        always = tag in ("nav", "header", "footer", "aside", "form")
        attributes = named(names, 0.5 if always else 1.0)
        bodies = {
            "nav": lambda: links() if draw.random() < 0.8 else " | ".join(link() for _ in range(draw.randint(2, 8))),
            "header": lambda: draw.choice([f"<h1>{some(1, 4)}</h1>", f"<div>{some(1, 5)}</div>", f"<p>{some(2, 8)}</p>", link()]) + (links() if draw.random() < 0.4 else ""),
            "footer": lambda: draw.choice(["&copy; ", "", "Copyright "]) + some(2, 25) + (links() if draw.random() < 0.4 else "") + (f"<p>{some(3, 25)}</p>" if draw.random() < 0.4 else ""),
            "aside": lambda: draw.choice(["", f"<h3>{some(1, 4)}</h3>"]) + draw.choice([links, lambda: f"<p>{some(5, 40)}</p>", lambda: f"<div>{link(3, 8)}</div><div>{link(3, 8)}</div>"])(),
            "notice": lambda: f"<p>{some(5, 30)}</p><button>{some(1, 2)}</button>" if draw.random() < 0.6 else some(5, 25),
            "ad": lambda: draw.choice([lambda: some(3, 25), lambda: f"<p>{some(3, 25)}</p>", lambda: link(2, 10), lambda: f"<h4>{some(1, 5)}</h4><p>{some(4, 15)}</p>"])(),
            "form": lambda: f"<label>{some(1, 4)}</label><input type=text><button>{some(1, 2)}</button>" + (f"<p>{some(3, 15)}</p>" if draw.random() < 0.4 else ""),
            "comments": lambda: f"<h3>{some(1, 3)}</h3>" + "".join(
                f'<{"li" if tag == "ol" else "div"}{named(names, 0.8)}><b>{some(1, 2)}</b><p>{some(3, 60)}</p>{link(1, 1)}</{"li" if tag == "ol" else "div"}>' for _ in range(draw.randint(1, 5))),
            "share": lambda: links() if draw.random() < 0.5 else "".join(link(1, 1) for _ in range(4)),
        }
        return f'<{tag}{attributes} data-main="0">{bodies[kind]()}</{tag}>'

    def inline(text: str) -> str:
        if draw.random() < 0.3:
            text = f"<{draw.choice(['b', 'i', 'em', 'strong', 'span'])}>{text}" + ("</b>" if draw.random() < 0.5 else "")
        if draw.random() < 0.2:
            text += " " + link() + " " + some(1, 8)
        return text + ("<br>" if draw.random() < 0.2 else "")

    def paragraph() -> str:
        end = "</p>" if draw.random() < 0.85 else ""
        low, high = draw.choice([(1, 1), (1, 6), (10, 60), (20, 120), (30, 200)])
        return f"<p{named(NEUTRAL_NAMES + ['lead', 'intro'], 0.1)}>{inline(some(low, high))}{end}"

    def piece() -> str:
        kind = draw.random()
        if kind < 0.75:
            return paragraph()
        return draw.choice([
            lambda: f"<h2>{some(1, 8)}</h2>", lambda: f"<h3>{some(1, 6)}</h3>",
            lambda: f"<ul>{''.join(f'<li>{inline(some(1, 20))}</li>' for _ in range(draw.randint(1, 6)))}</ul>",
            lambda: f"<ol>{''.join(f'<li>{some(2, 25)}' for _ in range(draw.randint(1, 5)))}</ol>",
            lambda: f"<blockquote>{paragraph() if draw.random() < 0.6 else some(5, 40)}</blockquote>",
            lambda: f"<figure><img src=x><figcaption>{some(2, 12)}</figcaption></figure>",
            lambda: f"<table><tr><th>{some(1, 2)}<th>{some(1, 2)}</tr><tr><td>{some(1, 4)}<td>{some(1, 4)}</table>",
            lambda: f"<pre>{some(5, 40)}</pre>", lambda: f"<div>{some(10, 80)}</div>", lambda: f"<section>{paragraph()}{paragraph()}</section>",
        ])()

    inside = []
    for _ in range(draw.choice([0, 1, 2, 3, 5, 8, 12, 20])):
        inside.append(piece())
        if draw.random() < 0.08:
            inside.append(boilerplate(draw.choice(["ad", "ad", "share", "aside", "form", "notice"])))
    title = f"<h1>{some(1, 9)}</h1>"
    if draw.random() < 0.2:
        title = f'<div class="title">{title}</div>'
    body = (title if draw.random() < 0.85 or not inside else "") + "".join(inside)
    tag = draw.choice(["article", "article", "article", "main", "div", "div", "section"])
    page = f'<{tag}{named(ARTICLE_NAMES, 0.3 if tag in ("article", "main") else 1.0)} data-main="1">{body}</{tag}>'
    if draw.random() < 0.2:
        page = f"<main>{page}{boilerplate('comments') if draw.random() < 0.4 else ''}</main>"
    around = [boilerplate(k) for k in ("ad", "aside", "notice", "share", "form") if draw.random() < 0.3]
    after = [boilerplate(k) for k in ("comments", "aside", "ad", "share", "form") if draw.random() < 0.3]
    page = "".join([*around, page, *after])
    for _ in range(draw.choice([0, 0, 1, 2])):
        page = f"<div{named(NEUTRAL_NAMES, 0.8)}>{page}</div>"
    parts = [boilerplate(k) for k, odds in (("notice", 0.15), ("header", 0.5), ("nav", 0.8), ("ad", 0.3)) if draw.random() < odds]
    parts += [page, *[boilerplate(k) for k, odds in (("aside", 0.3), ("form", 0.15), ("footer", 0.85), ("notice", 0.1)) if draw.random() < odds]]
    return f"<!DOCTYPE html><html><head><title>x</title></head><body>{''.join(parts)}</body></html>"


def _labels(forest: Forest) -> np.ndarray:
    """1 for nodes with main text in or below them, 0 for others."""
    parent, label = np.array(forest.parent), np.array(forest.label)
    levels = _by_depth(np.array(forest.depth))
    for level in levels[1:]:
        label[level] = np.where(label[level] < 0, label[parent[level]], label[level])
    main = (label == 1).astype(int)
    for level in reversed(levels[1:]):
        np.maximum.at(main, parent[level], main[level])
    return main


def _boost(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Trees of a fixed depth on quantile bins, by first and second derivatives of the logistic loss."""
    edges = [np.unique(np.quantile(column, np.linspace(0, 1, BINS)[1:-1])) for column in x.T]
    bins = np.column_stack([np.searchsorted(e, column, side="left") for e, column in zip(edges, x.T, strict=True)])
    flat = bins + np.arange(x.shape[1]) * BINS
    n, width, inner = len(x), x.shape[1] * BINS, 2**DEPTH - 1
    start = float(np.log(y.mean() / (1 - y.mean())))
    total = np.full(n, start)
    features_, limits, leaves = np.zeros((TREES, inner), np.int64), np.full((TREES, inner), np.inf, np.float32), np.zeros((TREES, inner + 1))
    for tree in range(TREES):
        p = 1 / (1 + np.exp(-total))
        gradient, curvature = p - y, np.maximum(p * (1 - p), 1e-6)
        at = np.zeros(n, np.int64)
        for depth in range(DEPTH):
            first, count = 2**depth - 1, 2**depth
            place = ((at - first)[:, None] * width + flat).ravel()
            sums = [
                np.bincount(place, weights=np.repeat(v, x.shape[1]), minlength=count * width).reshape(count, -1, BINS).cumsum(2)
                for v in (gradient, curvature)
            ]
            g, h = sums
            all_g, all_h = g[:, :, -1:], h[:, :, -1:]
            gain = g**2 / (h + 1) + (all_g - g) ** 2 / (all_h - h + 1) - all_g**2 / (all_h + 1)
            gain[(h < 1) | (all_h - h < 1)] = 0
            best = gain.reshape(count, -1).argmax(1)
            for k, b in enumerate(best):
                feature, bin_ = divmod(int(b), BINS)
                if gain[k].ravel()[b] > 1e-9 and bin_ < len(edges[feature]):
                    features_[tree, first + k], limits[tree, first + k] = feature, edges[feature][bin_]
            at = 2 * at + 1 + (x[np.arange(n), features_[tree, at]] > limits[tree, at])
        g, h = (np.bincount(at - inner, weights=v, minlength=inner + 1) for v in (gradient, curvature))
        leaves[tree] = -RATE * g / (h + 1)
        total += leaves[tree][at - inner]
    return features_, limits, leaves, start


def train(words: list[str], seed: int = 17) -> Model:
    """Trees fitted to LAYOUTS random pages filled with `words`; the same words give the same model."""
    draw = random.Random(seed)
    words = sorted(set(words)) or ["text"]
    forest = Forest()
    for _ in range(LAYOUTS):
        forest.add(_layout(draw, words), labelled=True)
    y = _labels(forest)
    token, node = np.array(forest.token), np.array(forest.token_node)
    hits = [np.bincount(token[y[node] == v], minlength=ATTRIBUTE_BUCKETS) + 1.0 for v in (1, 0)]
    names = np.clip(np.log(hits[0] / hits[1]), -3, 3)
    x, _ = features(forest, names)
    inside = np.array(forest.depth) > 0
    return Model(names, *_boost(x[inside].astype(np.float32), y[inside]))


def fit(pages: DataFrame) -> Model:
    """A model for the words of about SAMPLE_PAGES pages (some SAMPLE_WORDS of each), drawn by the hash of the url and id."""
    given = pages.where("html IS NOT NULL")
    n = given.count()
    if not n:
        return train([])
    draw = F.pmod(F.xxhash64("page_id"), F.lit(1 << 40)) / float(1 << 40)
    plain = F.regexp_replace(F.regexp_replace("html", r"(?s)<(script|style).*?</\1>", " "), r"<[^>]*>", " ")
    cut = F.slice(F.array_distinct(F.split(F.regexp_replace(plain, "[<>&\"]", ""), r"\s+")), 1, SAMPLE_WORDS)
    rows = given.where(draw < min(1.0, SAMPLE_PAGES / n)).select(cut.alias("words")).collect()
    return train([w[:40] for r in rows for w in r["words"] if w])


_WORKER: dict[str, Model] = {}


def extracted(spark: SparkSession, pages: DataFrame, model: Model) -> tuple[DataFrame, str]:
    """(`pages` with a struct column, its name): text and n_chars of every page.

    The text of a null, empty or wholly rejected page is empty. Text outside of all elements is kept. Repeated rows
    are extracted each; the model has a fixed size and is broadcast.
    """
    sent, key, name = spark.sparkContext.broadcast(model), uuid.uuid4().hex, free_name(pages, "main_text")

    def work(rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> list:
        if key not in _WORKER:
            _WORKER.clear()
            _WORKER[key] = sent.value
        body = data.tobytes()
        texts = _WORKER[key].texts([body[a:b].decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:], strict=True)])
        return [texts, [len(t) for t in texts]]

    return annotated(pages, name, "text string, n_chars bigint", work, PIECE_BYTES, text="html"), name


def main_texts(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    slim = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))
    found, name = extracted(spark, slim, fit(slim))
    return found.select("page_id", "url", f"{name}.text", f"{name}.n_chars")
