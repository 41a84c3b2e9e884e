"""Main text of web pages by a tree-structured graphical model (operator 9).

Each DOM node, element or text, is open (it leads to main text) or boilerplate. A node's potential comes from its
element, the words of its class, id and role, and its text; a potential of parent and child depends on the child's
kind. Sum-product messages go from the leaves to the root and back, which gives exact marginals. The weights maximise
the likelihood of labelled pages; those are composed here of usual page parts, by a seeded generator, so that learning
needs no column that pages lack. The text nodes whose marginal is 1/2 or more are the main text.
"""

from __future__ import annotations

import re
from functools import cache, lru_cache
from math import exp, log1p
from random import Random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, small_batches
from .dom import BLOCK, Page, attributes, joined, parse

# Words of class, id and role by what they name.
HINTS = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc tabs topnav subnav",
    "header": "header masthead topbar logo branding sitehead hero",
    "footer": "footer foot copyright colophon contentinfo legal imprint",
    "side": "sidebar side aside widget widgets rail related recommended recommendations trending complementary",
    "advert": "ad ads advert adverts advertisement adsense sponsor sponsored promo promotion banner dfp",
    "notice": "notice cookie cookies consent gdpr alert popup modal newsletter subscribe disclaimer announcement toast overlay paywall",
    "comment": "comment comments commentlist disqus reply replies respond discussion",
    "share": "share sharing social follow tags meta byline author",
    "form": "form search login signup input",
    "main": "article content post entry main story body text page prose",
}
HINT = {word: name for name, words in HINTS.items() for word in words.split()}
# Words that say where or how a part is, not what it is about.
MODIFIERS = frozenset(
    "site page main global top bottom left right upper lower primary secondary inner outer wrap wrapper container holder box block panel bar"
    " area section list item items link links row col column grid slot unit zone group icon button btn js is has fixed sticky mobile desktop"
    " mini small large open close closed active reader user posts posting articles no v x".split()
)
# Elements that have a feature of their own.
TAGS = (
    "a article aside b blockquote body button dd div dl dt em fieldset figcaption figure footer form h1 h2 h3 h4 head header"
    " i img label li main menu nav ol option p pre section select span strong table td th tr ul noscript svg address details summary"
).split()
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
NAMES = (
    ["one", "text"]
    + [f"tag {t}" for t in TAGS]
    + ["tag other"]
    + [f"hint {h}" for h in HINTS]
    + [f"part {h}" for h in HINTS]
    + ["long", "short", "linked", "sentences", "blank"]
)
AT = {name: i for i, name in enumerate(NAMES)}
KINDS = 3  # a child that is a block, another element, or text
PAGES, STEPS, RATE, PENALTY = 400, 150, 0.1, 1e-3


@lru_cache(1 << 14)
def named(raw: str) -> tuple[int, ...]:
    """The features of an element's class, id and role: a name that consists of hints and modifiers says what the part is;
    a hint among other words, as in comment-on-policy, may be what its text is about, and is a feature of its own."""
    found, features = attributes(raw), set()
    for key in ("class", "id", "role"):
        for name in found.get(key, "").split():
            words = [w.lower() for w in WORD.findall(name)]
            whole = all(w in HINT or w in MODIFIERS for w in words)
            features |= {AT[f"{'hint' if whole else 'part'} {HINT[w]}"] for w in words if w in HINT}
    return tuple(sorted(features))


def features(page: Page) -> list[tuple[int, ...]]:
    """Of each node. Link density and length are those of the text below an element."""
    n = len(page.parent)
    length, linked, stops = [0] * n, [0] * n, [0] * n
    inside = [False] * n
    for i in range(1, n):
        inside[i] = inside[page.parent[i]] or page.tag[i] == "a"
    for i in range(n - 1, 0, -1):
        if not page.tag[i]:
            text = page.text[i].strip()
            length[i], stops[i] = len(text), text.count(". ") + text.endswith((".", "!", "?"))
            linked[i] = length[i] * inside[i]
        up = page.parent[i]
        length[up] += length[i]
        linked[up] += linked[i]
        stops[up] += stops[i]
    rows = []
    for i in range(n):
        row = [AT["one"]]
        if page.tag[i]:
            row.append(AT.get(f"tag {page.tag[i]}", AT["tag other"]))
            if page.attributes[i]:
                row += named(page.attributes[i]) if len(page.attributes[i]) < 200 else named.__wrapped__(page.attributes[i])
        else:
            row.append(AT["text"])
        if length[i] == 0:
            row.append(AT["blank"])
        else:
            row.append(AT["long" if length[i] > 80 else "short"])
            if 2 * linked[i] > length[i]:
                row.append(AT["linked"])
            if stops[i]:
                row.append(AT["sentences"])
        rows.append(tuple(row))
    return rows


#: Levels of so few nodes, as of very deep pages, are summed node by node.
FEW = 4


def sum_logs(x: float, y: float) -> float:
    return max(x, y) + log1p(exp(-abs(x - y)))


class Forest:
    """The nodes of some pages side by side, by depth."""

    def __init__(self, pages: list[Page]) -> None:
        parent, kind, rows, columns = [], [], [], []
        for page in pages:
            base = len(parent)
            parent += [p + base if p >= 0 else -1 for p in page.parent]
            kind += [2 if not t else 0 if t in BLOCK else 1 for t in page.tag]
            for i, own in enumerate(features(page), base):
                rows += [i] * len(own)
                columns += own
        self.parent, self.kind = np.array(parent), np.array(kind)
        self.rows, self.columns = np.array(rows), np.array(columns)
        depth = np.zeros(len(parent), int)
        for i, p in enumerate(parent):
            if p >= 0:
                depth[i] = depth[p] + 1
        order = np.argsort(depth, kind="stable")
        self.levels = np.split(order, np.cumsum(np.bincount(depth))[:-1])

    def marginals(self, weight: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(probability [node, state], of parent and child [node, parent's state, state]) by sum-product; state 1 is open."""
        n = len(self.parent)
        up = np.zeros((n, 2))  # a node's potential and what its children say
        up[:, 1] = np.bincount(self.rows, weight[self.columns], n)
        said = np.zeros((n, 2))  # what a node says to its parent, by the parent's state
        between = pair[self.kind]
        for level in reversed(self.levels[1:]):
            if len(level) <= FEW:
                for i in level.tolist():
                    (w, x), (y, z), (p, q) = *between[i].tolist(), up[i].tolist()
                    said[i] = sum_logs(w + p, x + q), sum_logs(y + p, z + q)
                    up[self.parent[i]] += said[i]
                continue
            said[level] = np.logaddexp.reduce(between[level] + up[level][:, None, :], axis=2)
            np.add.at(up, self.parent[level], said[level])
        down, both = np.zeros((n, 2)), np.zeros((n, 2, 2))
        for level in self.levels[1:]:
            if len(level) <= FEW:
                for i in level.tolist():
                    p = self.parent[i]
                    (w, x), (y, z), (r, s), (t, u) = *between[i].tolist(), (up[p] + down[p] - said[i]).tolist(), up[i].tolist()
                    down[i] = sum_logs(w + r, y + s), sum_logs(x + r, z + s)
                    both[i] = ((w + r + t, x + r + u), (y + s + t, z + s + u))
                continue
            p = self.parent[level]
            joint = between[level] + (up[p] + down[p] - said[level])[:, :, None]
            down[level] = np.logaddexp.reduce(joint, axis=1)
            both[level] = joint + up[level][:, None, :]
        all_ = up + down
        q = np.exp(all_ - np.logaddexp.reduce(all_, axis=1, keepdims=True))
        both = np.exp(both - np.logaddexp.reduce(both.reshape(n, 4), axis=1)[:, None, None])
        return q, both


@cache
def train() -> tuple[np.ndarray, np.ndarray]:
    """Weights of the features (for open against boilerplate) and of parent and child, by gradient ascent."""
    random = np.random.default_rng(17)
    pages = [parse(labelled_page(random)) for _ in range(PAGES)]
    forest = Forest(pages)
    label = np.concatenate([truth(p) for p in pages])
    weight, pair = np.zeros(len(NAMES)), np.zeros((KINDS, 2, 2))
    child = forest.parent >= 0
    seen = np.zeros_like(pair)
    np.add.at(seen, (forest.kind[child], label[forest.parent[child]], label[child]), 1)
    means = [np.zeros_like(weight), np.zeros_like(pair)]
    squares = [np.zeros_like(weight), np.zeros_like(pair)]
    for step in range(1, STEPS + 1):
        q, both = forest.marginals(weight, pair)
        expected = np.zeros_like(pair)
        np.add.at(expected, forest.kind[child], both[child])
        ascent = [np.bincount(forest.columns, (label - q[:, 1])[forest.rows], len(NAMES)) / PAGES - PENALTY * weight, (seen - expected) / PAGES - PENALTY * pair]
        for w, g, m, s in zip((weight, pair), ascent, means, squares):
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            w += RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    return weight, pair


def truth(page: Page) -> np.ndarray:
    """Labels of a composed page: what lies in a part marked data-main="0" is boilerplate."""
    label = np.ones(len(page.parent), int)
    for i in range(1, len(label)):
        label[i] = 0 if 'data-main="0"' in page.attributes[i] else label[page.parent[i]]
    return label


def labelled_page(random: np.random.Generator) -> str:
    """A page of usual parts in one of many arrangements."""
    own = Random(int(random.integers(1 << 62)))  # much faster for single numbers
    pick = lambda *x: x[own.randrange(len(x))]

    def words(low: int, high: int) -> str:
        out = " ".join("".join(pick("an", "the", "er", "in", "on", "st", "re", "al", "io", "de", "qu", "ém") for _ in range(own.randrange(1, 4))) for _ in range(own.randrange(low, high)))
        return out.capitalize()

    def prose(sentences: int) -> str:
        return " ".join(words(4, 14) + pick(".", ".", "!", "?") for _ in range(sentences))

    def link(low: int = 1, high: int = 4) -> str:
        return f'<a href="/{own.randrange(999)}">{words(low, high)}</a>'

    def about() -> str:
        """A name of content: a word that could also name a part of a page, among others."""
        hint, other = pick(*HINT), lambda: pick("on", "of", "history", "systems", "policy", "guide", "early", "theory", words(1, 2).lower())
        return pick(f"{hint}-{other()}", f"{hint}-{other()}-{other()}", f"{other()}-{hint}", f"{hint}_{other()}", f"{hint}{other().capitalize()}")

    def off(tag: str, name: str, inner: str) -> str:
        if own.random() < 0.03:
            name = f"{name}-{words(1, 2).lower()}"
        if tag in ("header", "footer", "nav", "aside", "form") and own.random() < 0.5:
            name = ""  # the element says it all
        return f'<{tag}{f" class={chr(34)}{name}{chr(34)}" if name else ""} data-main="0">{inner}</{tag}>'

    def text() -> str:
        """Prose of a paragraph, of an article or of what isn't: some is marked up, some of that never closed."""
        part, inline = prose(own.randrange(1, 5)), pick("b", "i", "em", "strong", "span", "a")
        if own.random() < 0.55:
            return part
        return f"{part} {link()} {prose(1)}" if own.random() < 0.4 else f"<{inline}>{words(1, 4)}{pick(f'</{inline}>', '')} {part}"

    def heading(low: int, high: int) -> str:
        tag = pick("h1", "h2", "h3", "h4")
        return f"<{tag}>{words(low, high)}</{tag}>"

    def links() -> str:
        return pick("<ul>{}</ul>", "<ol>{}</ol>", "<div>{}</div>").format("".join(pick("<li>{}</li>", "<li>{}</li>", "<span>{}</span>").format(link()) for _ in range(own.randrange(2, 8))))

    def menu() -> str:
        return pick(off("nav", "", links()), off("nav", "main-nav", links()), off("div", "menu", links()), off("ul", "navbar", f"<li>{link()}</li>" * 4), off("div", "breadcrumbs", f"{link()} &gt; {link()}"))

    def advert() -> str:
        return off(pick("div", "div", "aside", "section", "p"), pick("ad", "ads", "advert", "ad-slot", "sponsored", "promo", "advertisement"), pick(prose(own.randrange(1, 4)), text(), link(2, 6), words(1, 6)))

    def notice() -> str:
        return off(pick("div", "div", "p", "section"), pick("notice", "cookie-notice", "consent", "alert", "newsletter", "popup", "subscribe-box", "disclaimer"), pick(prose(own.randrange(1, 3)), f"{heading(1, 3)}<p>{text()}</p>", f"<p>{prose(1)}</p><button>{words(1, 2)}</button>"))

    def form() -> str:
        return off("form", pick("", "search", "signup"), f"<label>{words(1, 3)}</label><input name=q>{pick('', f'<p>{prose(1)}</p>')}<button>{words(1, 2)}</button><select><option>{words(1, 2)}<option>{words(1, 2)}</select>")

    def comments() -> str:
        one = lambda: pick("<div class='comment'><p>{}</p></div>", "<li>{}</li>", "<p>{}</p>", "<article class='comment'><p>{}</p></article>").replace("{}", text())
        return off(pick("section", "div", "ol", "ul", "aside"), pick("comments", "comment-list", "reader-comments", "discussion", "replies"), pick("", heading(1, 3)) + "".join(one() for _ in range(own.randrange(1, 5))))

    def side() -> str:
        return off(pick("aside", "aside", "div"), pick("sidebar", "widget", "right-rail", "related", "side-bar"), pick("", heading(1, 3)) + pick(links(), f"<p>{text()}</p>", text()))

    def head() -> str:
        return off(pick("header", "div", "header"), pick("site-header", "header", "masthead", "topbar"), pick(f"<h1>{link()}</h1>", heading(1, 4), f"<p>{words(2, 6)}</p>", text(), f"<div class='logo'>{words(1, 3)}</div>") + (menu() if own.random() < 0.5 else ""))

    def foot() -> str:
        return off(pick("footer", "footer", "div"), pick("site-footer", "footer", "copyright"), pick(f"&copy; {words(1, 4)} &middot; {prose(own.randrange(1, 3))}", f"<p>{prose(1)}</p>{links()}", links(), text(), words(2, 6)))

    def share() -> str:
        return off("div", pick("share", "social-links", "sharing"), f"{link(1, 2)} {link(1, 2)}")

    body = [pick(f"<h1>{words(3, 9)}</h1>", heading(3, 9))] if own.random() < 0.85 else []
    for _ in range(own.randrange(1, 9)):
        body.append(
            pick(
                *[f"<p>{text()}</p>"] * 5,
                f"<p>{text()}<br><p>{text()}",
                f"<p>{words(1, 2)}.</p>",
                f"{heading(2, 6)}<p>{text()}</p>",
                f"<section>{heading(1, 5)}<p>{text()}</p></section>",
                f"<ul><li>{prose(1)}</li><li>{words(1, 6)}</li></ul>",
                f"<ol><li>{text()}<li>{words(1, 6)}</ol>",
                f"<blockquote><p>{text()}</p></blockquote>",
                f"<pre>{words(3, 9)}</pre>",
                f"<table><tr><td>{words(1, 3)}<td>{words(1, 3)}<tr><td>{words(1, 2)}</table>",
                f"<figure><img src=x><figcaption>{words(3, 8)}</figcaption></figure>",
                f"<div>{text()}</div>",
                f"{text()}<br>{text()}",
            )
        )
    for i, block in enumerate(body):
        if own.random() < 0.3:  # a part of the article that is named by what it is about
            tag, attribute = pick("div", "section", "div", "section", "aside", "p"), pick("class", "id")
            body[i] = f'<{tag} {attribute}="{about()}">{text() if tag == "p" else block}</{tag}>'
    for part in (advert, notice, share, side, form, comments):
        if own.random() < 0.15:
            body.insert(own.randrange(1, len(body) + 1), part())
    kind, name = pick(("article", ""), ("article", "post"), ("main", ""), ("div", "content"), ("div", "entry-content"), ("section", "story"), ("div", "article-body"), ("div", "x1"), ("section", ""), ("td", ""))
    name = about() if kind in ("div", "section") and own.random() < 0.3 else name
    main = f'<{kind}{f" {pick("class", "id")}={chr(34)}{name}{chr(34)}" if name else ""}>{"".join(body)}</{kind}>'
    main = f"<table><tr>{main}</table>" if kind == "td" else main
    before = [f() for f in (head, menu, advert, notice, form) if own.random() < 0.45]
    after = [f() for f in (side, comments, advert, notice, form, foot, share) if own.random() < 0.4]
    page = "".join(before) + main + "".join(after)
    page = f"<div class='{pick('wrapper', 'container', 'page', 'row', 'layout')}'>{page}</div>" if own.random() < 0.4 else page
    return f"<!DOCTYPE html><html><head><meta charset=utf-8><title>{words(2, 6)}</title><style>p{{}}</style></head><body>{page}</body></html>"


def main_texts(documents: list[str], model: tuple[np.ndarray, np.ndarray]) -> list[str]:
    """The main text of each page."""
    out: list[str] = []
    for at in range(0, len(documents), 64):
        pages = [parse(x) for x in documents[at : at + 64]]
        q = Forest(pages).marginals(*model)[0][:, 1]
        base = 0
        for page in pages:
            n = len(page.parent)
            out.append(joined(page, [i for i in range(n) if not page.tag[i] and q[base + i] >= 0.5]))
            base += n
    return out


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of each row of pages.

    A null html counts as empty; a page without main text has the empty text. Rows that repeat are extracted each; an
    empty table gives none; null ids and addresses pass through. Columns beside page_id, url and html aren't read.
    """
    small_batches(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(train())

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = main_texts([x or "" for x in batch.column("html").to_pylist()], shared.value)
        return pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return map_arrow(rows, run, "page_id long, url string, text string, n_chars long")
