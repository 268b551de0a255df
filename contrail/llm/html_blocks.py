"""Main text of web pages: a recurrent labeller of text blocks.

A page becomes a sequence of leaves: stretches of text between block-level tags, each with the path of open elements
(name, class, id and role), its length, link share and words. A bidirectional LSTM in numpy reads the sequence, a
vector per leaf from hashed path parts, hashed words and a few shape numbers, and says for every leaf whether it
belongs to the article, in view of all other leaves of the page. The leaves it keeps are the text.

No page is labelled, so the labeller is trained here on pages made from templates: many layouts (with ``article`` or
only classed ``div`` elements, menus, headers, footers, sidebars, notices, adverts, forms and reader comments before,
after and inside the article, some within one form) filled with random words, whose labels are known. Training takes seconds, is seeded and
does not look at the tables.

Scripts, styles, templates, comments, ``head``, drawings, form controls and their labels (``label``, and bare text of a form on
one line with a control) are never text, by rule; whatever else a form holds is weighed like all leaves, and ``math``
and the content of ``object`` are read. ``/>`` closes a drawing, a frame, an object, a formula and a control; without a
closing tag only the tag itself is skipped, but an unclosed script or style lasts to the end. Character references are
decoded, white space inside a block becomes one space, blocks are trimmed and joined by a blank line. A null or empty
page, and one without a kept leaf, gives an empty text. Broken markup is read as far as it goes: unclosed elements end
with what closes around them. Rows are treated one by one, so repeated ids or pages each get their row.
"""

from __future__ import annotations

import html as entities
import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from contrail.llm.common import Shared, Texts, Words

# Element names by their role in HTML.
BLOCK = frozenset(
    "address article aside blockquote body button canvas caption center dd details dialog dir div dl dt fieldset"
    " figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p"
    " pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template noscript textarea title iframe svg xmp".split())
CODE = frozenset("script style".split())
DROPPED = frozenset("head select button option".split())
CONTROLS = frozenset("input select textarea".split())  # those that have labels
CLOSABLE = frozenset("svg math iframe object label select button option".split())
CLOSES_P = BLOCK - {"body", "html", "button", "option", "optgroup", "caption", "legend", "summary"}
# an opening element ends an open one of the same kind
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}

_TOKEN = re.compile(r"<(?:([a-zA-Z][^\s/>]*)([^>\"']*(?:(?:\"[^\"]*\"|'[^']*')[^>\"']*)*)>|/([a-zA-Z][^\s/>]*)[^>]*>|!--.*?(?:-->|\Z)|[!?][^>]*>)", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_UNLABELLED = re.compile(r"\btype\s*=\s*[\"']?(?:hidden|submit|button|image|reset)\b", re.I)
_PART = re.compile(r"[a-z]+")

PATHS, WORDS, SHAPES, HIDDEN = 1 << 10, 1 << 9, 8, 12


class Leaf:
    __slots__ = ("path", "text", "linked")

    def __init__(self, path: tuple[str, ...], text: str, linked: int):
        self.path, self.text, self.linked = path, text, linked


def _labels(name: str, attributes: str) -> tuple[str, ...]:
    parts = [name]
    if attributes and "=" in attributes:
        for _, a, b, c in _ATTRIBUTE.findall(attributes):
            parts += ["." + p for p in _PART.findall((a or b or c).lower())]
    return tuple(parts)


def leaves(page: str) -> list[Leaf]:
    """The page's text blocks in order, without what is never text."""
    out: list[Leaf] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    held: list[str] = []
    links = linked = dropped = labels = 0
    line = line_linked = 0  # where the line began in held, and what was linked before it
    control = False  # whether the line has one

    def end_line() -> None:
        nonlocal linked, line, line_linked, control
        if control and next((name for name, _ in reversed(stack) if name in BLOCK), "") == "form":
            del held[line:]
            linked = line_linked
        line, line_linked, control = len(held), linked, False

    def hold(text: str) -> None:
        nonlocal linked
        # of a label only what stands in it directly: blocks in one that was left open are not its text
        if not dropped and not (labels and next(name for name, _ in reversed(stack) if name in BLOCK or name == "label") == "label"):
            held.append(text)
            linked += len(text) * (links > 0)

    def flush() -> None:
        nonlocal linked, line, line_linked
        end_line()
        if held:
            text = "".join(held)
            text = " ".join((entities.unescape(text) if "&" in text else text).split())
            if text:
                out.append(Leaf(tuple(p for _, parts in stack for p in parts), text, linked))
            held.clear()
        linked = line = line_linked = 0

    def close(k: int) -> None:
        nonlocal links, dropped, labels
        for name, _ in stack[k:]:
            links -= name == "a"
            labels -= name == "label"
            dropped -= name in DROPPED
        del stack[k:]

    def find(names: tuple[str, ...], stop: tuple[str, ...] = ()) -> int:
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in names:
                return k
            if stack[k][0] in stop:
                break
        return -1

    at, end = 0, len(page)
    lower = ""
    while at < end:
        match = _TOKEN.search(page, at)
        if match is None:
            hold(page[at:])
            break
        if match.start() > at:
            hold(page[at : match.start()])
        at = match.end()
        opened, closed = match.group(1), match.group(3)
        if opened:
            name = opened.lower()
            shut = match.group(2).rstrip().endswith("/")
            if name in CONTROLS and not (name == "input" and _UNLABELLED.search(match.group(2))):
                control = True
            if name in CLOSABLE and shut:
                continue
            if name in RAW:
                lower = lower or page.lower()
                stop = lower.find("</" + name, at)
                flush() if name in BLOCK else None
                if stop < 0 and name in CODE and not shut:
                    break
                if stop < 0:
                    continue
                stop = page.find(">", stop)
                at = end if stop < 0 else stop + 1
                continue
            if name == "br":
                end_line()
                held.append(" ") if not dropped else None
                continue
            if name in BLOCK:
                flush()
                if name in CLOSES_P and (k := find(("p",), ("div", "article", "section", "td", "li", "body"))) >= 0:
                    close(k)
                if name in SIBLINGS and (k := find(SIBLINGS[name], SCOPES[name])) >= 0:
                    close(k)
            if name == "body" and (k := find(("head",))) >= 0:
                close(k)
            if name not in VOID:
                stack.append((name, _labels(name, match.group(2))))
                links += name == "a"
                labels += name == "label"
                dropped += name in DROPPED
        elif closed:
            name = closed.lower()
            if name in BLOCK:
                flush()
            if (k := find((name,))) >= 0:
                close(k)
    flush()
    return out


def _path(parts: tuple[str, ...]) -> tuple[list[int], list[float]]:
    """Buckets and weights of a leaf's path: the inner parts count double."""
    return (
        [zlib.crc32(part.encode("utf-8", "replace")) % PATHS for part in parts],
        [1.0 if depth >= len(parts) - 6 else 0.5 for depth in range(len(parts))],
    )


def describe(pages: list[list[Leaf]]) -> tuple[np.ndarray, ...]:
    """Input of all leaves of all pages: ascending leaf numbers with bucket and weight, and shape numbers per leaf.

    All words of a leaf count, each by its share.
    """
    blocks = [b for page in pages for b in page]
    n = len(blocks)
    words = Words(Texts(pa.array([b.text for b in blocks], pa.string()), 0), lower=True)
    owner = words.document()
    share = 1.0 / np.maximum(np.bincount(owner, minlength=n), 1)
    known: dict[tuple[str, ...], tuple[list[int], list[float]]] = {}
    paths = [known.get(b.path) or known.setdefault(b.path, _path(b.path or ("none",))) for b in blocks]
    depth = np.array([len(p[0]) for p in paths])
    rows = np.concatenate([np.repeat(np.arange(n), depth), owner])
    buckets = np.concatenate([np.array([x for p in paths for x in p[0]], np.int64), PATHS + (words.hashes() % np.uint64(WORDS)).astype(np.int64)])
    weights = np.concatenate([np.array([x for p in paths for x in p[1]]), share[owner]]).astype(np.float32)
    order = np.argsort(rows, kind="stable")
    size = np.array([len(page) for page in pages])
    length = np.array([len(b.text) for b in blocks], float)
    total = np.add.reduceat(length, np.r_[0, np.cumsum(size)[:-1]])
    stops = np.array([b.text.count(".") + b.text.count("!") + b.text.count("?") for b in blocks])
    step = np.concatenate([np.arange(k) for k in size])
    shape = np.stack(
        [
            np.log1p(length) / 8,
            np.minimum(np.array([b.linked for b in blocks]) / length, 1.0),
            length / np.repeat(total, size),
            step / np.repeat(size, size),
            stops * 20 / (length + 20),
            depth / 10,
            length < 40,
            np.ones(n),
        ],
        1,
    ).astype(np.float32)
    return rows[order], buckets[order], weights[order], shape, np.repeat(np.arange(len(pages)), size), step


class Labeller:
    """One-layer bidirectional LSTM over leaf vectors, a logistic output per leaf."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        dim, h = 16, HIDDEN
        self.p = {
            "embed": rng.normal(0, 0.1, (PATHS + WORDS, dim)).astype(np.float32),
            "shape": rng.normal(0, 0.3, (SHAPES, dim)).astype(np.float32),
            "out": rng.normal(0, 0.3, (2 * h + dim, 1)).astype(np.float32),
            "bias": np.zeros(1, np.float32),
        }
        for side in "fb":
            self.p["w" + side] = rng.normal(0, 0.25, (dim + h, 4 * h)).astype(np.float32)
            self.p["c" + side] = np.zeros(4 * h, np.float32)
            self.p["c" + side][h : 2 * h] = 1.0

    def vectors(self, rows: np.ndarray, buckets: np.ndarray, weights: np.ndarray, shape: np.ndarray) -> np.ndarray:
        first = np.searchsorted(rows, np.arange(len(shape)))  # every leaf has a path part
        return shape @ self.p["shape"] + np.add.reduceat(self.p["embed"][buckets] * weights[:, None], first, axis=0)

    def run(self, x: np.ndarray, page: np.ndarray, step: np.ndarray, keep: bool = False):
        """Logits per leaf; with ``keep`` also what back-propagation needs."""
        h, pages, steps = HIDDEN, int(page[-1]) + 1, int(step.max()) + 1
        size = np.bincount(page, minlength=pages)
        states, memory = [], {}
        for side in "fb":
            # backward reads each page from its last leaf
            place = step if side == "f" else size[page] - 1 - step
            grid = np.zeros((steps, pages, x.shape[1]), np.float32)
            grid[place, page] = x
            mask = (np.arange(steps)[:, None] < size[None, :]).astype(np.float32)[:, :, None]
            w, c = self.p["w" + side], self.p["c" + side]
            pre = grid @ w[: x.shape[1]] + c
            hid = np.zeros((steps + 1, pages, h), np.float32)
            cell = np.zeros((steps + 1, pages, h), np.float32)
            gates = np.zeros((steps, pages, 4 * h), np.float32)
            for t in range(steps):
                z = pre[t] + hid[t] @ w[x.shape[1] :]
                g = 1 / (1 + np.exp(-z[:, : 3 * h]))
                u = np.tanh(z[:, 3 * h :])
                cell[t + 1] = (g[:, h : 2 * h] * cell[t] + g[:, :h] * u) * mask[t]
                hid[t + 1] = g[:, 2 * h :] * np.tanh(cell[t + 1]) * mask[t]
                gates[t] = np.concatenate([g, u], 1)
            states.append(hid[1:][place, page])
            memory[side] = (place, grid, mask, hid, cell, gates)
        features = np.concatenate([*states, x], 1)
        logit = (features @ self.p["out"])[:, 0] + self.p["bias"][0]
        return (logit, features, memory) if keep else logit

    def learn(self, pages: list[tuple[list[Leaf], list[int]]], epochs: int = 6, rate: float = 0.01, seed: int = 5) -> Labeller:
        """Adam on the logistic loss of every leaf, in batches of pages."""
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        count, h = 0, HIDDEN
        for _ in range(epochs):
            order = rng.permutation(len(pages))
            for i in range(0, len(order), 32):
                pick = order[i : i + 32]
                rows, buckets, weights, shape, page, step = describe([pages[k][0] for k in pick])
                x = self.vectors(rows, buckets, weights, shape)
                y = np.concatenate([pages[k][1] for k in pick]).astype(np.float32)
                logit, features, memory = self.run(x, page, step, keep=True)
                d = ((1 / (1 + np.exp(-logit))) - y)[:, None] / len(pick)
                grad = {"out": features.T @ d, "bias": d.sum(0)}
                df = d @ self.p["out"].T
                dx = df[:, 2 * h :].copy()
                for k, side in enumerate("fb"):
                    place, grid, mask, hid, cell, gates = memory[side]
                    w = self.p["w" + side]
                    n = x.shape[1]
                    dh_in = np.zeros((len(grid), grid.shape[1], h), np.float32)
                    dh_in[place, page] = df[:, k * h : (k + 1) * h]
                    dz_all = np.zeros((len(grid), grid.shape[1], 4 * h), np.float32)
                    dh, dc = np.zeros_like(dh_in[0]), np.zeros_like(dh_in[0])
                    for t in range(len(grid) - 1, -1, -1):
                        g = gates[t]
                        i_, f_, o_, u_ = g[:, :h], g[:, h : 2 * h], g[:, 2 * h : 3 * h], g[:, 3 * h :]
                        dh = (dh + dh_in[t]) * mask[t]
                        tc = np.tanh(cell[t + 1])
                        dc = (dc + dh * o_ * (1 - tc**2)) * mask[t]
                        dz = np.concatenate(
                            [dc * u_ * i_ * (1 - i_), dc * cell[t] * f_ * (1 - f_), dh * tc * o_ * (1 - o_), dc * i_ * (1 - u_**2)], 1
                        )
                        dz_all[t] = dz
                        dc = dc * f_
                        dh = dz @ w[n:].T
                    flat = dz_all.reshape(-1, 4 * h)
                    grad["w" + side] = np.concatenate([grid.reshape(-1, n).T @ flat, hid[:-1].reshape(-1, h).T @ flat])
                    grad["c" + side] = flat.sum(0)
                    dx += (dz_all @ w[:n].T)[place, page]
                grad["shape"] = shape.T @ dx
                grad["embed"] = np.zeros_like(self.p["embed"])
                np.add.at(grad["embed"], buckets, dx[rows] * weights[:, None])
                count += 1
                for k, g in grad.items():
                    first[k] += 0.1 * (g - first[k])
                    second[k] += 0.001 * (g * g - second[k])
                    self.p[k] -= rate * (first[k] / (1 - 0.9**count)) / (np.sqrt(second[k] / (1 - 0.999**count)) + 1e-8)
        return self

    def keeps(self, pages: list[list[Leaf]]) -> list[np.ndarray]:
        """For each page, which leaves are article; pages of like length are read together."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i]))
        at = 0
        while at < len(order):
            # a bounded grid: fewer pages at once when they are long
            n = max(1, min(256, 20_000 // len(pages[order[min(at + 255, len(order) - 1)]])))
            pick = order[at : at + n]
            at += n
            rows, buckets, weights, shape, page, step = describe([pages[i] for i in pick])
            kept = self.run(self.vectors(rows, buckets, weights, shape), page, step) > 0
            for i, part in zip(pick, np.split(kept, np.cumsum([len(pages[i]) for i in pick])[:-1]), strict=True):
                out[i] = part
        return out


def made_pages(count: int, seed: int = 11) -> list[tuple[list[Leaf], list[int]]]:
    """Template pages with known labels: the training set. A marker in each article block tells the label."""
    rng = random.Random(seed)
    pieces = "ba co di fu ge ha ing jo ka le mon no or pa qui re sa tion un ver wo za th er an en ou ment".split()
    pick = lambda *options: options[rng.randrange(len(options))]
    chance = lambda p: rng.random() < p

    def word() -> str:
        w = "".join(rng.choices(pieces, k=rng.randint(1, 3)))
        style = rng.random()
        return w.upper() if style < 0.03 else w.capitalize() if style < 0.1 else w

    def line(low: int, high: int, stop: str = "") -> str:
        return " ".join(word() for _ in range(rng.randint(low, high))) + stop

    def prose() -> str:
        kind = rng.random()
        if kind < 0.1:
            return line(1, 3, pick(".", "", ","))
        if kind < 0.2:
            return " ".join(word() + pick("***", "&amp;&amp;", "!!", "|", "%%%") for _ in range(rng.randint(2, 29)))
        return " ".join(line(3, 14, ".") for _ in range(rng.randint(1, 8)))

    mark = "\ue000"  # a private-use character, in no word made here

    def article() -> str:
        blocks = []
        if chance(0.85):
            tag = pick("h1", "h1", "h2")
            blocks.append(f"<{tag}>{mark}{line(1, 10)}</{tag}>")
        if chance(0.15):
            blocks.append(f"<p class='{pick('lead', 'intro', 'standfirst')}'>{mark}{prose()}</p>")
        for _ in range(rng.randint(0, 8) if chance(0.9) else rng.randint(9, 39)):
            kind = rng.random()
            if kind < 0.62:
                blocks.append(f"<p>{mark}{prose()}</p>")
            elif kind < 0.68:
                blocks.append(f"<{pick('h2', 'h3')}>{mark}{line(1, 6)}</h2>")
            elif kind < 0.74:
                blocks.append("<ul>" + "".join(f"<li>{mark}{line(2, 14)}</li>" for _ in range(rng.randint(2, 5))) + "</ul>")
            elif kind < 0.78:
                blocks.append(f"<blockquote><p>{mark}{prose()}</p></blockquote>")
            elif kind < 0.81:
                blocks.append("<table>" + "".join(f"<tr><td>{mark}{word()}</td><td>{mark}{line(1, 3)}</td></tr>" for _ in range(3)) + "</table>")
            elif kind < 0.84:
                blocks.append(f"<pre>{mark}{line(3, 20)}</pre>")
            elif kind < 0.87:
                blocks.append(f"<p>{mark}{line(3, 9)} <a href='/x'>{line(1, 4)}</a> {line(2, 8, '.')}</p>")
            elif kind < 0.90:
                blocks.append(f"<p><b>{mark}{prose()}<br><p>{mark}{prose()}</p>")
            elif kind < 0.93:
                blocks.append(f"<div>{mark}{prose()}</div>")
            elif kind < 0.965:
                blocks.append(advert())
            else:
                blocks.append(pick(related(), share(), notice()))
        return "".join(blocks) or f"<p>{mark}{prose()}</p>"

    def menu() -> str:
        items = "".join(f"<li><a href='/{k}'>{line(1, 2)}</a></li>" for k in range(rng.randint(2, 8)))
        inner = pick(f"<ul>{items}</ul>", items.replace("li>", "span>") if chance(0.3) else f"<ul>{items}</ul>")
        name = pick("nav", "menu", "navbar", "navigation", "breadcrumb", "topnav")
        return pick(f"<nav>{inner}</nav>", f"<nav class='{name}'>{inner}</nav>", f"<div class='{name}'>{inner}</div>", f"<div id='{name}'>{inner}</div>", f"<ul class='{name}'>{items}</ul>")

    def advert() -> str:
        name = pick("ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner", "ad-slot", "sponsor")
        body = pick(prose(), f"<p>{prose()}</p>", f"<a href='/buy'>{line(1, 6)}</a>")
        return f"<{pick('div', 'aside', 'section')} {pick('class', 'class', 'id')}='{name}'>{body}</div>".replace("</div>", "</div></aside></section>", 1)

    def header() -> str:
        body = f"<{pick('div', 'p', 'span', 'h2')}>{line(1, 5)}</div>" + (menu() if chance(0.4) else "")
        return pick(f"<header>{body}</header>", f"<div class='{pick('header', 'site-header', 'masthead', 'top', 'logo', 'topbar')}'>{body}</div></div>", f"<div id='header'>{body}</div></div>")

    def footer() -> str:
        body = pick(f"&copy; {line(2, 14)}", f"<p>&copy; {line(1, 6)}</p><p>{line(2, 12, '.')}</p>", prose(), menu())
        return pick(f"<footer>{body}</footer>", f"<footer>{body}</footer>", f"<div class='{pick('footer', 'site-footer', 'bottom', 'copyright', 'legal')}'>{body}</div>", f"<div id='footer'>{body}</div>")

    def sidebar() -> str:
        body = "".join(pick(f"<h3>{line(1, 3)}</h3>", f"<p>{prose()}</p>", f"<ul><li><a href='/y'>{line(1, 5)}</a></li></ul>") for _ in range(rng.randint(1, 4)))
        return pick(f"<aside>{body}</aside>", f"<aside class='sidebar'>{body}</aside>", f"<div class='{pick('sidebar', 'side', 'widget', 'rail', 'related', 'recommended', 'popular', 'trending')}'>{body}</div>", f"<div id='sidebar'>{body}</div>")

    def notice() -> str:
        name = pick("cookie", "cookie-banner", "consent", "gdpr", "notice", "alert", "modal", "popup", "paywall", "overlay", "newsletter", "subscribe", "signup")
        body = pick(prose(), f"<p>{prose()}</p>", f"<p>{line(3, 12, '.')}</p><button>{word()}</button>")
        return pick(f"<div class='{name}'>{body}</div>", f"<div id='{name}'>{body}</div>", f"<section class='{name}'>{body}</section>", f"<div role='{pick('dialog', 'alert')}'>{body}</div>")

    def related() -> str:
        return f"<div class='{pick('related', 'more', 'recommended', 'read-more', 'also')}'><ul>" + "".join(f"<li><a href='/z'>{line(2, 7)}</a></li>" for _ in range(3)) + "</ul></div>"

    def share() -> str:
        return f"<div class='{pick('share', 'social', 'tags', 'meta', 'byline', 'author', 'toolbar')}'>{line(1, 4)} <a href='/s'>{word()}</a></div>"

    def comments() -> str:
        name = pick("comments", "comment-list", "responses", "discussion", "disqus", "replies")
        one = lambda: pick(f"<div class='comment'><p>{prose()}</p></div>", f"<li class='comment'><b>{word()}</b><p>{prose()}</p></li>", f"<p>{prose()}</p>", f"<article class='comment'><p>{prose()}</p></article>")
        body = (f"<h3>{line(1, 2)}</h3>" if chance(0.4) else "") + "".join(one() for _ in range(rng.randint(1, 5)))
        return pick(f"<section class='{name}'>{body}</section>", f"<div class='{name}'>{body}</div>", f"<div id='{name}'>{body}</div>", f"<section id='{name}'>{body}</section>")

    def form() -> str:
        name = pick("", "", f" class='{pick('search', 'login', 'contact', 'newsletter', 'signup', 'filter')}'", f" id='{pick('search', 'login', 'subscribe')}'")
        field = f"<label>{line(1, 3)}</label><input type='text'>"
        body = pick("", "", f"<h3>{line(1, 4)}</h3>", f"<p>{line(3, 14, '.')}</p>", f"<p>{prose()}</p>", f"<legend>{line(1, 3)}</legend>", f"<table><tr><td>{line(1, 2)}</td><td><input></td></tr></table>")
        return f"<form{name}>{body}{field}<button>{word()}</button></form>"

    pages = []
    for _ in range(count):
        core = article()
        if chance(0.12):
            core += comments()  # inside the article element
        body = pick(
            f"<article>{core}</article>",
            f"<article>{core}</article>",
            f"<article class='{pick('post', 'entry', 'story')}'>{core}</article>",
            f"<main>{core}</main>",
            f"<main><article>{core}</article></main>",
            f"<div class='{pick('content', 'article', 'post', 'entry', 'story', 'main', 'article-body', 'post-content', 'text', 'body')}'>{core}</div>",
            f"<div id='{pick('content', 'main', 'article', 'story')}'>{core}</div>",
            f"<section class='{pick('content', 'article', 'post')}'>{core}</section>",
        )
        before = [f() for f in (header, menu, notice, advert, sidebar, form) if chance(0.4)]
        after = [f() for f in (comments, sidebar, related, advert, form, notice, share) if chance(0.25)] + ([footer()] if chance(0.8) else [])
        content = f"{''.join(before)}{body}{''.join(after)}"
        if chance(0.1):
            whole = f"<form{pick('', ' id=aspnetForm', ' id=form1', ' class=page')} method='post'><input type='hidden' name='state'>"
            content = pick(f"{whole}{content}</form>", f"{whole}<div>{content}</div></form>", f"{whole}{content}", f"{''.join(before)}{whole}{body}</form>{''.join(after)}")
        blocks = leaves(f"<html><head><title>{line(1, 4)}</title></head><body>{content}</body></html>")
        labels = []
        for block in blocks:
            labels.append(int(mark in block.text))
            block.text = block.text.replace(mark, "").strip() or "x"
        if blocks:
            pages.append((blocks, labels))
    return pages


def trained(pages: int = 1500, epochs: int = 5) -> Labeller:
    return Labeller().learn(made_pages(pages), epochs)


def extract(pages: DataFrame, labeller: Labeller | None = None, output: str = "text") -> DataFrame:
    """``pages`` (with a column ``html``) without it and with its main text in ``output``; other columns are kept."""
    model = labeller or trained()
    shared = Shared(pages.sparkSession, model)
    names = [c for c in pages.columns if c not in ("html", output)]
    schema = pages.select(*[f"`{c}`" for c in names], pages["html"].cast("string").alias(output)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                read = [leaves(html.as_py() or "") for html in part.column("html")]
                texts = ["\n\n".join(b.text for b, k in zip(blocks, kept, strict=True) if k) for blocks, kept in zip(read, model.keeps(read), strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(texts, pa.string())], [*names, output])

    return pages.select(*[f"`{c}`" for c in names], "html").mapInArrow(run, schema)
