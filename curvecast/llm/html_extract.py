"""HTML extraction by a tree-structured graphical model over the DOM.

Each block element and each run of text between block boundaries is a node that is content or not.
A node has a log-linear potential over its tag, its class and id words (each word a hashed feature
whose weight is learned) and its text; parent and child share a potential by the child's kind, and a page without any content has one of its own. Sum-product messages, upward and then downward, give
every node's content marginal; runs of text with at least one half make up the page's text, in page
order. Training maximises the likelihood of labelled pages, whose gradient the same messages give.
The labelled pages are a bounded sample of the table (SAMPLE pages, those of least hash), labelled
by their ``<article>`` or ``<main>``, and variants of them in other layouts, of which the generator
knows the labels; so the model does not lean on one template.

A null, empty or contentless page gives an empty text; broken markup is read as it comes; repeated
rows are treated alike; an empty table stays empty (the model then learns from generated pages
alone). The whole html is read, however long; a button, video or the like that is never closed ends
with its parent or at the next block that it can't hold. Further columns are not read.
"""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from html.parser import HTMLParser
from math import exp, log, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pages of the table that the model is trained on at most, and their largest html.
SAMPLE, SAMPLE_CHARS = 120, 50_000
STEPS, RATE, DECAY = 300, 0.15, 5e-5
#: Weights of class words are held closer to nought than others, so that no word outweighs the text.
WORD_DECAY = 5e-5

_GROUPS = {
    "root": "html body", "article": "article", "main": "main", "section": "section", "div": "div", "nav": "nav menu", "header": "header", "footer": "footer", "aside": "aside",
    "form": "form fieldset dialog", "list": "ul ol dl", "item": "li dt dd", "p": "p", "heading": "h1 h2 h3 h4 h5 h6 hgroup", "table": "table thead tbody tfoot tr", "cell": "td th caption",
    "quote": "blockquote pre address details summary", "figure": "figure figcaption center", "text": "",
}
_KIND = {tag: i for i, tags in enumerate(_GROUPS.values()) for tag in tags.split()}
_NAMES = list(_GROUPS)
_TEXT = _NAMES.index("text")
_FLOW = frozenset(_NAMES.index(k) for k in ("list", "p", "heading", "table", "quote", "figure", "text"))
_HIDDEN = frozenset("head script style noscript template textarea select button svg math iframe object video audio canvas title".split())
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_CLOSES = {"li": ("li", ("ul", "ol")), "dt": ("dt", ("dl",)), "dd": ("dd", ("dl",)), "tr": ("tr", ("table",)), "td": ("td", ("tr", "table")), "th": ("th", ("tr", "table"))}
_LATER = re.compile(r"</(noscript|template|textarea|select|button|svg|math|iframe|object|video|audio|canvas)\b", re.I)
#: Blocks that no hidden element but noscript, template, object and the media may hold.
_OUTSIDE = frozenset("p article main section nav header footer aside ul ol dl table h1 h2 h3 h4 h5 h6 blockquote form pre".split())
_HOLDERS = frozenset("noscript template object video audio canvas".split())
#: Features: kinds of nodes, hashed class words, then the text's.
WORDS = 512
_LENGTHS = (25, 80, 250)
_TEXT_AT = len(_NAMES) + WORDS
N_FEATURES = _TEXT_AT + 8
_CUT_OFF = re.compile("<[A-Za-z/?!](?!-)")
_OPENER = re.compile("<!-{2,}")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Dom(HTMLParser):
    """Nodes of one page: parents come before children. Text runs are nodes of kind "text"."""

    def __init__(self, later: Counter | None = None):
        super().__init__(convert_charrefs=True)
        self.later = later or Counter()  # end tags still to come, of elements that may be left open
        self.inner: list[str] = []
        self.open_ended = False
        self.parent, self.kind, self.words, self.label = [], [], [], []
        self.text: dict[int, str] = {}
        self.links: dict[int, int] = {}
        self.stack: list[tuple[str, int]] = []
        self.open: dict[str, list[int]] = defaultdict(list)  # where in the stack each tag is
        self.hidden: list[str] = []
        self.run: list[str] = []
        self.linked, self.in_link = 0, 0
        self.loose = 0  # the block that holds what lies in the body itself
        self._add(-1, 0, (), None)
        self.stack.append(("", 0))

    def _add(self, parent, kind, words, label):
        if parent >= 0 and self.kind[parent] == 0 and kind:  # beside no other block: one without a name holds it
            if kind not in _FLOW:
                self.loose = 0
            elif not self.loose:
                self.loose = self._add(parent, _NAMES.index("div"), (), None)
            parent = self.loose if kind in _FLOW else parent
        self.parent.append(parent)
        self.kind.append(kind)
        self.words.append(words)
        self.label.append(label)
        return len(self.parent) - 1

    def flush(self):
        if self.run:
            text = " ".join("".join(self.run).split())
            if text:
                at = self._add(self.stack[-1][1], _TEXT, (), None)
                self.text[at], self.links[at] = text, self.linked
            self.run, self.linked = [], 0

    def _pop_to(self, tag, stops=()):
        at = self.open[tag][-1] if self.open[tag] else 0
        if at and not any(self.open[s] and self.open[s][-1] > at for s in stops):
            self.flush()
            while len(self.stack) > at:
                self.open[self.stack.pop()[0]].pop()

    def _unhide(self):
        self.hidden, self.inner, self.open_ended = [], [], False

    def handle_starttag(self, tag, attrs):
        if tag in _HIDDEN:
            if not self.hidden:
                self.hidden = [tag]
                self.open_ended = tag in _LATER_TAGS and not self.later[tag]
            elif tag == self.hidden[0] and tag != "button":
                self.hidden.append(tag)
            return
        if self.hidden:
            top = self.hidden[0]
            if (top == "head" and tag == "body") or (tag in _KIND and (self.open_ended or (tag in _OUTSIDE and top in _LATER_TAGS and top not in _HOLDERS))):
                self._unhide()
            else:
                if tag in _KIND:
                    self.inner.append(tag)
                return
        if tag == "a":
            self.in_link = 1
        elif tag == "br" or tag == "hr":
            self.run.append(" ")
        if tag not in _KIND:
            return
        self.flush()
        self.in_link = 0
        if tag in _CLOSES:
            self._pop_to(*_CLOSES[tag])
        self._pop_to("p", ("div", "article", "section", "td", "th", "li", "blockquote", "body", "main", "aside", "form"))
        found = dict(attrs)
        words = tuple({w.lower() for w in _WORD.findall(f"{found.get('class') or ''} {found.get('id') or ''} {found.get('role') or ''}")}) if attrs else ()
        label = found.get("data-y")
        self.open[tag].append(len(self.stack))
        self.stack.append((tag, self._add(self.stack[-1][1], _KIND[tag], words, label)))

    def handle_startendtag(self, tag, attrs):
        if tag in _VOID or tag not in _KIND:
            self.handle_starttag(tag, attrs) if tag in ("br", "hr") else None
        else:
            self.handle_starttag(tag, attrs)
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in _LATER_TAGS:
            self.later[tag] -= 1
        if self.hidden:
            if tag == self.hidden[0]:
                self.hidden.pop()
                if not self.hidden:
                    self._unhide()
                return
            if tag in self.inner:
                while self.inner.pop() != tag:
                    pass
                return
            if self.hidden[0] not in _LATER_TAGS or not self.open[tag]:
                return
            self._unhide()  # its parent ends
        if tag == "a":
            self.in_link = 0
        elif tag in _KIND:
            self.flush()
            self.in_link = 0
            self._pop_to(tag)

    def handle_data(self, data):
        if not self.hidden:
            self.run.append(data)
            if self.in_link:
                self.linked += len(data)


_LATER_TAGS = frozenset("noscript template textarea select button svg math iframe object video audio canvas".split())


def _closed(html: str) -> str:
    """Openers of comments that never end are dropped: what follows them is read. So is a tag that the
    end of the page cuts off."""
    cut = _CUT_OFF.search(html, html.rfind(">") + 1)
    html = html[: cut.start()] if cut else html
    last = html.rfind("-->") + 3 if "-->" in html else 0
    return html[:last] + _OPENER.sub(" ", html[last:]) if html.find("<!--", last) >= 0 else html


def parse(html: str) -> Dom:
    html = _closed(html)
    dom = Dom(Counter(t.lower() for t in _LATER.findall(html)))
    dom.feed(html)
    dom.close()
    dom.flush()
    return dom


def _step(n: int) -> int:
    return next((i for i, top in enumerate(_LENGTHS) if n < top), len(_LENGTHS))


def node_features(dom: Dom) -> list[list[int]]:
    """The indexes of the features (all binary) that each node has."""
    out = []
    for i, kind in enumerate(dom.kind):
        on = [kind] + [len(_NAMES) + zlib.crc32(w.encode()) % WORDS for w in dom.words[i]]
        if kind == _TEXT:
            text = dom.text[i]
            on.append(_TEXT_AT + _step(len(text)))
            if 2 * dom.links[i] > len(text):
                on.append(_TEXT_AT + 4)
            if text[-1] in ".!?:;\"')":
                on.append(_TEXT_AT + 5)
            if text[:1] in "©" or "All rights" in text or "Copyright" in text:
                on.append(_TEXT_AT + 6)
            if "http" in text or "@" in text:
                on.append(_TEXT_AT + 7)
        out.append(on)
    return out


def marginals(parent: list[int], kind: list[int], score: list[float], agree: list[float], drop: list[float], empty: float = 0.0) -> list[float]:
    """Log odds of content of each node, by messages to the root and back.

    A child of kind k that agrees with its parent adds agree[k]; one that isn't content under a
    parent that is adds drop[k]; a page without any content adds empty.
    """
    n = len(parent)
    up, total, mass = [0.0] * n, list(score), 0.0  # mass: log of all configurations over the one without content
    for i in range(n - 1, 0, -1):
        a, b, x = agree[kind[i]], drop[kind[i]], min(60.0, max(-60.0, total[i]))
        up[i] = log((exp(b) + exp(a + x)) / (exp(a) + exp(x)))
        total[parent[i]] += up[i]
        mass += log1p(exp(x - a))
    mass += log1p(exp(min(60.0, total[0])))
    for i in range(1, n):
        a, b = agree[kind[i]], drop[kind[i]]
        q = min(60.0, max(-60.0, total[parent[i]] - up[i]))
        total[i] += log((1 + exp(a + q)) / (exp(a) + exp(b + q)))
    if empty:
        # With the page's term every probability grows by one factor: odds p r / (1 - p r).
        r = 1 / (1 - exp(-mass) * (1 - exp(empty)))
        grown = [r / (1 + exp(-max(-60.0, x))) for x in total]
        total = [log(p / (1 - p)) if p < 1 else 60.0 for p in grown]
    return total


def extract(html: str, model: dict) -> str:
    if not html:
        return ""
    dom = parse(html)
    if not dom.text:
        return ""
    w = model["w"]
    score = [sum(w[f] for f in on) for on in node_features(dom)]
    odds = marginals(dom.parent, dom.kind, score, model["agree"], model["drop"], model["empty"])
    return "\n".join(t for i, t in dom.text.items() if odds[i] >= 0)


# Labelled pages ------------------------------------------------------------------------------------

_FILLER = "the river keeps its own time and so does every town along the water where people trade old stories for bread and news of the season".split()
_CHROME = "Home About Contact Products Archive Sign in Help Search Privacy Terms News Sports Weather Shop Subscribe now Read more Share this Accept cookies We use cookies to improve your visit. All rights reserved.".split()


_AFFIXES = "site page box wrap inner left right top block js col row list area story app".split()


def _sentence(rng: random.Random, words: list[str], low: int, high: int) -> str:
    return " ".join(rng.choice(words) for _ in range(rng.randint(low, high))).capitalize() + "."


def _escape(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;")


def variant(rng: random.Random, blocks: list[str], words: list[str], plain: bool = False) -> str:
    """A page in another layout that holds these blocks as its content, or none; data-y marks its labels.
    plain: all blocks are paragraphs."""
    e, pick = _escape, rng.choice
    links = lambda n: "".join(f"<li><a href='/x{i}'>{e(' '.join(rng.sample(_CHROME, 2)))}</a></li>" for i in range(n))
    say = lambda a, b: e(_sentence(rng, words if rng.random() < 0.7 else _CHROME, a, b))
    dress = lambda name: pick([name, name, f"{pick(_AFFIXES)}-{name}", f"{name}_{pick(_AFFIXES)}", f"{name}{pick(_AFFIXES).capitalize()}"])
    bad = lambda tag, names: f"<{tag} {pick(['class', 'class', 'id'])}='{dress(pick(names))}' data-y='0'>"
    top = [
        f"<header data-y='0'><h2>{say(1, 4)}</h2><ul>{links(4)}</ul></header>",
        f"<nav data-y='0'><ul>{links(rng.randint(2, 8))}</ul></nav>",
        f"{bad('div', ['menu', 'navbar', 'top-nav'])}<ul>{links(5)}</ul></div>",
        f"{bad('div', ['header', 'masthead'])}<p>{say(2, 8)}</p></div>",
        f"{bad('div', ['ad', 'ads', 'advert', 'banner', 'sponsored'])}{say(3, 14)}</div>",
        f"{bad('div', ['cookie-notice', 'notice', 'consent', 'gdpr'])}<p>{say(6, 25)}</p></div>",
        f"{bad('div', ['breadcrumbs', 'breadcrumb'])}<a href='/'>{say(1, 2)}</a> <a href='/y'>{say(1, 3)}</a></div>",
    ]
    end = [
        f"<footer data-y='0'><p>&copy; {say(2, 10)}</p></footer>",
        f"{bad('div', ['footer', 'copyright'])}&copy; {say(2, 10)}</div>",
        f"<aside data-y='0'><h3>{say(1, 4)}</h3><p>{say(5, 40)}</p><ul>{links(3)}</ul></aside>",
        f"{bad('div', ['sidebar', 'side', 'widget'])}<h3>{say(1, 4)}</h3><p>{say(5, 40)}</p></div>",
        f"<form data-y='0'><label>{say(1, 5)}</label><p>{say(3, 12)}</p><input><button>OK</button></form>",
        f"{bad(pick(['div', 'section']), ['comments', 'comment-list', 'discussion', 'disqus_thread', 'responses', 'reactions'])}<h3>{say(1, 3)}</h3>" + "".join(f"<div class='comment'><p>{say(3, 60)}</p></div>" for _ in range(rng.randint(1, 4))) + "</div>",
        f"{bad(pick(['div', 'section']), ['comments', 'replies', 'disqus_thread', 'reactions', 'feedback'])}<ul>" + "".join(f"<li><p>{say(3, 60)}</p></li>" for _ in range(rng.randint(1, 4))) + "</ul></div>",
        f"{bad('div', ['related', 'recommended'])}<ul>{links(4)}</ul></div>",
        f"{bad('div', ['share', 'social'])}<a href='/s'>{say(1, 3)}</a></div>",
        f"{bad('div', ['newsletter', 'subscribe', 'popup'])}<p>{say(4, 20)}</p></div>",
    ]
    body, i = [], 0
    if blocks:
        body.append(f"<h1>{e(blocks[0])}</h1>")
        i = 1
    while i < len(blocks):
        x = 1.0 if plain else rng.random()
        if x < 0.1 and i + 2 < len(blocks):
            rows = blocks[i : i + 2]
            body.append("<ul>" + "".join(f"<li>{e(b)}</li>" for b in rows) + "</ul>" if x < 0.06 else "<table>" + "".join(f"<tr><td>{e(b)}</td></tr>" for b in rows) + "</table>")
            i += 2
            continue
        tag = "h2" if x < 0.14 and len(blocks[i]) < 80 else "blockquote" if x < 0.18 else "div" if x < 0.24 else "pre" if x < 0.26 else "p"
        body.append(f"<{tag}>{e(blocks[i])}</{tag}>" if rng.random() < 0.9 or tag != "p" else f"<p>{e(blocks[i])}<br>")
        i += 1
    for extra in rng.sample(top[4:6] + end[5:], rng.randint(0, 2)):
        body.insert(rng.randint(1, len(body)) if body else 0, extra)
    # Names of the content's own wrapper may speak of what is beside it.
    odd = f" class='{pick(['comments-open', 'has-sidebar', 'no-ads', 'with-menu', 'footer-below', 'share-on'])} {pick(['main', 'post', 'story', 'wrap'])}'" if rng.random() < 0.5 else ""
    opened, closed = pick([(f"<article{odd} data-y='1'>", "</article>"), (f"<main{odd} data-y='1'>", "</main>"), (f"<main{odd} data-y='1'><article data-y='1'>", "</article></main>"), (f"<div {pick(['class', 'id'])}='{dress(pick(['content', 'post-body', 'entry-content', 'main', 'article-text', 'story', 'text']))}' data-y='1'>", "</div>"), (f"<section{odd} data-y='1'>", "</section>"), (f"<div data-y='1'><div{odd} data-y='1'>", "</div></div>")])
    head = rng.sample(top, rng.randint(1, 4))
    tail = rng.sample(end, rng.randint(1, 4))
    content = f"{opened}{''.join(body)}{closed}" if blocks else ""
    return f"<html><head><title>{say(1, 5)}</title></head><body data-y='0'>{''.join(head)}{content}{''.join(tail)}</body></html>"


def labels(dom: Dom) -> list[int]:
    """By the nearest data-y above; on a page without any, content is what lies in its article or main."""
    marked = any(x is not None for x in dom.label)
    out: list[int] = []
    for i, p in enumerate(dom.parent):
        own = dom.label[i] if marked else "1" if _NAMES[dom.kind[i]] in ("article", "main") else "0" if _NAMES[dom.kind[i]] in ("nav", "aside", "footer", "form") or "ad" in dom.words[i] else None
        out.append(int(own) if own is not None else out[p] if p >= 0 else 0)
    return out


def labelled_pages(pages: list[str], seed: int = 5) -> list[tuple[Dom, list[int]]]:
    """Each page that has an article or main, and two variants of it; variants of filler if there is none."""
    rng, out = random.Random(seed), []
    for html in pages:
        dom = parse(html)
        y = labels(dom)
        blocks = [t for i, t in dom.text.items() if y[i]]
        if blocks:
            words = [w for i, t in dom.text.items() for w in t.split()[:400]]
            out.append((dom, y))
            out += [(d, labels(d)) for d in (parse(variant(rng, blocks, words)) for _ in range(2))]
            if rng.random() < 0.8:  # a page of very many short lines is content as well
                lines = [rng.choice(blocks).split(" ")[0][:20] + "." for _ in range(rng.randint(1, 4))]
                dom = parse(variant(rng, [*blocks[: rng.randint(0, 2)], *(rng.choice(lines) for _ in range(rng.randint(20, 200)))], words, rng.random() < 0.7))
                out.append((dom, labels(dom)))
            if rng.random() < 0.005:
                dom = parse(variant(rng, [], words))
                out.append((dom, labels(dom)))
    alone = not out
    for _ in range(300 if alone else 60):
        short = alone and rng.random() < 0.4  # without pages to learn from, short articles are shown as well
        blocks = [_sentence(rng, _FILLER, 1, 14 if short else 70) for _ in range(rng.randint(1, 12))]
        dom = parse(variant(rng, blocks, _FILLER, short))
        out.append((dom, labels(dom)))
    return out


def fit(pages: list[tuple[Dom, list[int]]]) -> dict:
    """Maximum likelihood by gradient steps; messages run over all pages at once, level by level."""
    parent, kind, depth, y, rows, cols, page = [], [], [], [], [], [], []
    for number, (dom, own) in enumerate(pages):
        at = len(parent)
        parent += [p + at if p >= 0 else -1 for p in dom.parent]
        kind += dom.kind
        for p in dom.parent:
            depth.append(0 if p < 0 else depth[p + at] + 1)
        y += own
        page += [number] * len(own)
        for i, on in enumerate(node_features(dom)):
            rows += [at + i] * len(on)
            cols += on
    parent, kind, depth, y = (np.array(x) for x in (parent, kind, depth, y))
    rows, cols = np.array(rows), np.array(cols)
    levels = [np.flatnonzero(depth == d) for d in range(1, depth.max() + 1)]
    child = np.flatnonzero(parent >= 0)
    roots = np.flatnonzero(parent < 0)
    yp = y[parent[child]]
    same, lost = (yp == y[child]).astype(float), ((yp == 1) & (y[child] == 0)).astype(float)
    weight = 1 / np.sqrt(np.bincount(page))[page]  # long pages count for more, but less than their nodes
    k = len(_NAMES)
    page, n_pages = np.array(page), len(pages)
    bare = np.bincount(page, y, n_pages) == 0
    theta, moved, spread = np.zeros(N_FEATURES + 2 * k + 1), 0.0, 0.0
    decay = np.full(len(theta), DECAY)
    decay[len(_NAMES) : _TEXT_AT] = WORD_DECAY
    for step in range(1, STEPS + 1):
        w, agree, drop = theta[:N_FEATURES], theta[N_FEATURES : N_FEATURES + k][kind], theta[N_FEATURES + k : -1][kind]
        total, up, down = np.bincount(rows, w[cols], len(parent)), np.zeros(len(parent)), np.zeros(len(parent))
        for level in levels[::-1]:
            a, b, s = agree[level], drop[level], total[level]
            up[level] = np.logaddexp(b, a + s) - np.logaddexp(a, s)
            np.add.at(total, parent[level], up[level])
        below = total.copy()
        for level in levels:
            a, b = agree[level], drop[level]
            q = total[parent[level]] - up[level]
            down[level] = np.logaddexp(0, a + q) - np.logaddexp(a, b + q)
            total[level] += down[level]
        # The page's term: log of all configurations over the one without content, and its factor.
        mass = np.bincount(page[child], np.logaddexp(0, below[child] - agree[child]), n_pages) + np.bincount(page[roots], np.logaddexp(0, below[roots]), n_pages)
        none = np.exp(-mass)
        r = 1 / (1 - none * (1 - np.exp(theta[-1])))
        p = r[page] / (1 + np.exp(-np.clip(total, -50, 50)))
        a, b, s = agree[child], drop[child], below[child]
        q = total[parent[child]] - up[child]
        both = np.stack([a, s, b + q, a + q + s])  # (0,0) (0,1) (1,0) (1,1) of parent, child
        both = np.exp(both - both.max(0))
        both /= both.sum(0)
        wc, rc, left = weight[child], r[page[child]], none * r * np.exp(theta[-1])
        alike = rc * (both[0] + both[3] - none[page[child]]) + left[page[child]]
        grad = np.concatenate([np.bincount(cols, (weight * (y - p))[rows], N_FEATURES), np.bincount(kind[child], wc * (same - alike), k), np.bincount(kind[child], wc * (lost - rc * both[2]), k), [(weight[roots] * (bare - left)).sum()]]) / weight.sum() - decay * theta
        moved = 0.9 * moved + 0.1 * grad
        spread = 0.99 * spread + 0.01 * grad**2
        theta = theta + RATE * (moved / (1 - 0.9**step)) / (np.sqrt(spread / (1 - 0.99**step)) + 1e-6)
    return {"w": theta[:N_FEATURES].tolist(), "agree": theta[N_FEATURES : N_FEATURES + k].tolist(), "drop": theta[N_FEATURES + k : -1].tolist(), "empty": float(theta[-1])}


def train(pages: DataFrame, html: str = "html", sample: int = SAMPLE) -> dict:
    """The model, trained on the pages of least hash (at most `sample` of at most SAMPLE_CHARS).

    Hashes alone are ranked first, so what tasks send to the driver doesn't grow with their pages.
    """
    likely = pages.select(F.col(f"`{html}`").cast("string").alias("h")).where(F.length("h").between(1, SAMPLE_CHARS)).withColumn("k", F.xxhash64("h"))
    least = [r[0] for r in likely.select("k").distinct().orderBy("k").limit(sample).collect()]
    if not least:
        return fit(labelled_pages([]))
    chosen = likely.where(F.col("k").isin(least)).groupBy("k").agg(F.min("h").alias("h")).orderBy("k")
    return fit(labelled_pages([r["h"] for r in chosen.collect()]))


def extract_pages(pages: DataFrame, model: dict | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    model = train(pages) if model is None else model
    shared = pages.sparkSession.sparkContext.broadcast(model)
    narrow = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract(h or "", shared.value) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return narrow.mapInArrow(run, "page_id long, url string, text string, n_chars long")
