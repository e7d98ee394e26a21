"""Operator 9: main text of pages by a recurrent block labeller.

A page is read into leaf blocks: runs of text between block-level tags, each with the path of tags above it (names, classes, ids, roles). A
bidirectional LSTM in numpy reads, for every block in page order, a hashed tag-path vector, a hashed-word vector of the whole block and its
length, link share and place, and labels each with the whole document as context. It is trained on at most ``SAMPLE`` pages (of ``SAMPLE_BYTES`` at most), picked by hash
order, whose blocks get their labels from article markup or, on pages without any, from length, links and whether other pages hold the same text, and everywhere from names below the page's frame; and on
re-dressed copies of them (other wrappers, menus, notices, adverts, forms, comments), so that no single template decides. Pages are labelled in one pass without a shuffle; only the weights, of fixed size, are broadcast.

Scripts, styles, frames, templates, drawings and comments never become blocks. What is in a script, style or frame is not read as markup: it ends at its own
end tag (a script or style without one at the end of the page, as in browsers; a frame, template or drawing without one is only its tag). A line break inside a block is a space. Null or empty html, or a page without
blocks that the labeller takes for article, gives an empty text; if no page of the sample has any text there is no labeller and what each page says itself decides. Nothing is cut, however long a page is, and reading takes
time in proportion to its length, however its tags are broken or nested. Repeated rows are read alike; extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arrays as A

SAMPLE, SAMPLE_BYTES, EPOCHS, HIDDEN, PATH, WORDS = 200, 1 << 18, 9, 16, 96, 32
QUIET = r"""[^<>"']*+(?:(?:"[^"<>]*+"|'[^'<>]*+')[^<>"']*+)*+"""  # attributes whose quotes hold no < or >; never looks beyond the next of these
TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/><]*+)({QUIET})>|[^<]+|<", re.S)
NAME = re.compile(r"<(/?)([a-zA-Z][^\s/><]*+)")
STOP = re.compile(r"""[>"']""")
ATTRIBUTE = re.compile(r"""(?i)\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
#: Elements of HTML by how they break text.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark noscript object q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup, and ones that hold markup but no text of the page.
RAW = frozenset("script style iframe".split())
INERT = frozenset("template svg".split())
ENDS = {n: re.compile(rf"</{n}(?=[\s/>])[^>]*>?", re.I) for n in RAW}
PAIRS = {n: re.compile(rf"<!--.*?(?:-->|\Z)|<(script|style)(?=[\s/>]).*?(?:</\1(?=[\s/>])|\Z)|<(/?){n}(?=[\s/>])({QUIET})>", re.I | re.S) for n in INERT}
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
BARRIERS = frozenset("ul ol table dl".split())
OUTER, INNER = 64, 192  # steps of a path that are kept at either end
BOILER = frozenset("nav header footer aside form menu button select dialog".split())
HINTS = re.compile(r"(?i)(^|[-_ ])(ad|ads|advert\w*|banner|sponsor\w*|promo|menu|nav\w*|side ?bar|header|footer|foot|comments?|reply|replies|respond|cookie\w*|notice|alert|consent|newsletter|subscribe|signup|login|form|share|social|related|breadcrumbs?|widget|popup|modal|copyright|legal)($|[-_ ])")


def _closed(page: str, name: str, start: int) -> dict[int, int]:
    """Where elements of that name end, by where they begin, from start on; those without an end tag are left out."""
    out, begun = {}, []
    for m in PAIRS[name].finditer(page, start):
        if m[2]:
            if begun:
                out[begun.pop()] = m.end()
        elif m[3] is not None and not m[3].rstrip().endswith("/"):
            begun.append(m.start())
    return out


class _Tags:
    """Where tags end that ``TOKEN`` can't read, as their quotes hold < or > or are not closed; all of a page's in time that grows with the page."""

    def __init__(self, page: str) -> None:
        self.page, self.last = page, page.rfind(">")
        self.open = {'"': len(page), "'": len(page)}  # from here on no quote of this kind is closed
        self.strict = True

    def end(self, start: int) -> int:
        """The place of the > that ends the tag, or -1. A quote that nothing closes is a sign like others; if no > stands outside quotes, quotes don't count from there on."""
        if start > self.last:
            return -1
        at = start
        while self.strict:
            m = STOP.search(self.page, at)
            if m is None:
                self.strict = False
            elif m[0] == ">":
                return m.start()
            elif m.start() >= self.open[m[0]] or (close := self.page.find(m[0], m.end())) < 0:
                self.open[m[0]] = min(self.open[m[0]], m.start())
                at = m.end()
            else:
                at = close + 1
        return self.page.find(">", start)


def blocks_of(page: str | None) -> list[tuple[tuple[str, ...], str, float, tuple[int, ...]]]:
    """(path, text, share of the text inside links, number of each element on the path) of each leaf block that has text. Of a path of more than ``OUTER`` + ``INNER`` steps
    its outermost and innermost ones stand for it."""
    out: list[tuple[tuple[str, ...], str, float, tuple[int, ...]]] = []
    names: list[str] = []  # of open elements, inline ones left out
    steps: list[str] = []
    numbers: list[int] = []
    links: list[int] = []  # links open where each began
    where: dict[str, list[int]] = {}  # places in the stack by name, and of those that keep an open p or li inside them
    barriers: list[int] = []
    path: tuple | None = None
    text: list[str] = []
    linked = link_depth = count = 0
    page, pos = page or "", 0
    tags = _Tags(page)
    closed: dict[str, dict[int, int]] = {}
    endless: set[str] = set()

    def flush():
        nonlocal linked, path
        if text:
            words = entities.unescape("".join(text)).split()
            if words:
                block = " ".join(words)
                if path is None:
                    path = tuple(tuple(x) if len(x) <= OUTER + INNER else (*x[:OUTER], *x[-INNER:]) for x in (steps, numbers))
                out.append((path[0], block, min(1.0, linked / max(1, len(block))), path[1]))
            text.clear()
        linked = 0

    def close(at):
        nonlocal path, link_depth
        link_depth, path = min(link_depth, links[at]), None
        while len(names) > at:
            gone = names.pop()
            where[gone].pop()
            if gone in BARRIERS:
                barriers.pop()
            steps.pop(), numbers.pop(), links.pop()

    while m := TOKEN.match(page, pos):
        pos = m.end()
        ending, name, marks = m[1], m[2], m[3]
        if name is None and m[0] == "<" and (m := NAME.match(page, pos - 1)):
            to = tags.end(m.end())
            if to < 0:
                text.append("<")
                linked += link_depth > 0
                continue
            ending, name, marks, pos = m[1], m[2], page[m.end() : to], to + 1
        elif name is None:
            if m is None or m[0][0] != "<":
                text.append("<" if m is None else m[0])
                linked += len(text[-1]) * (link_depth > 0)
            continue
        begin, name, alone = m.start(), name.lower(), marks.rstrip().endswith("/")
        if name in RAW or name in INERT:
            if not ending and not alone:
                if name in INERT:
                    if name not in closed:
                        closed[name] = _closed(page, name, begin)
                    pos = closed[name].get(begin, pos)
                elif name not in endless:
                    end = ENDS[name].search(page, pos)
                    if end:
                        pos = end.end()
                    elif name == "iframe":
                        endless.add(name)
                    else:
                        break
            continue
        if name == "br":
            text.append(" ")
            continue
        if name in INLINE:
            if name == "a":
                link_depth = max(0, link_depth - 1) if ending else link_depth + 1
            continue
        flush()
        if ending:
            if where.get(name):
                close(where[name][-1])
            continue
        if name in VOID:
            continue
        if name in CLOSES_P or name in ("li", "dt", "dd", "tr", "td", "th", "option"):
            open_ = where.get("p" if name in CLOSES_P else name)
            if open_ and not (barriers and barriers[-1] > open_[-1]):
                close(open_[-1])
        if not alone:
            own = " ".join(sorted(f"{a[0].lower()}={v.lower()}" for a in ATTRIBUTE.findall(marks) for v in (a[1] or a[2] or a[3]).split())) if marks else ""
            where.setdefault(name, []).append(len(names))
            if name in BARRIERS:
                barriers.append(len(names))
            names.append(name), steps.append(f"{name} {own}".rstrip()), numbers.append(count), links.append(link_depth)
            count, path = count + 1, None
    flush()
    return out


#: What a class says of a page's layout is no name of the element: "no-comments", "has-sidebar".
STATES = re.compile(r"(?i)(^|[-_])(no|not|has|have|with|without|is|hide|hidden|show)[-_][-\w]*")


def told(step: str) -> list[str]:
    """The class words, ids and roles of a step that name its element; those of html and body only tell the page's layout."""
    name, *marks = step.split()
    return [] if name in ("html", "body") else [v for v in (STATES.sub("", m.partition("=")[2]) for m in marks) if v]


def _hash(s: str) -> int:
    return zlib.crc32(s.encode()) * 2654435761 % 2**32


_paths: dict[tuple[str, ...], np.ndarray] = {}
_steps: dict[str, np.ndarray] = {}


def _placed(signs: list[str]) -> np.ndarray:
    v = np.zeros(PATH, np.float32)
    for s in signs:
        h = _hash(s)
        for k in range(3):  # three signed places a sign, so two signs rarely look alike
            v[(h >> (9 * k)) % PATH] += 1.0 if (h >> (28 + k)) & 1 else -1.0
    return v


def path_vector(path: tuple[str, ...]) -> np.ndarray:
    """What a path says: its elements and the words of their class names, and again the names of the two next to the text."""
    v = _paths.get(path)
    if v is None:
        v = np.zeros(PATH, np.float32)
        for step in path:
            own = _steps.get(step)
            if own is None:
                if len(_steps) > 20_000:
                    _steps.clear()
                marks = told(step)
                own = _steps[step] = _placed([step.split()[0], *marks, *(w for m in marks for w in re.split(r"[-_]+", m))])
            v += own
        v += _placed([f"{depth}:{step.split()[0]}" for depth, step in enumerate(path[:-3:-1])])
        if len(_paths) > 20_000:
            _paths.clear()
        _paths[path] = v
    return v


def features(pages: list[list[tuple]]) -> list[np.ndarray]:
    """A row of inputs for each block of each page."""
    flat = [b for page in pages for b in page]
    n = len(flat)
    x = np.zeros((n, PATH + WORDS + 4), np.float32)
    if n:
        buf, off = A.flat(pa.array([b[1] for b in flat], pa.large_string()))
        start, end, at = A.words_of(buf, off, ~A.SPACE)
        h = A.span_hashes(buf, start, end)
        doc = np.repeat(np.arange(n), np.diff(at))
        place = doc * WORDS + (h % np.uint64(WORDS)).astype(np.int64)
        sign = np.where((h >> np.uint64(40)) & np.uint64(1), 1.0, -1.0)
        words = np.maximum(np.diff(at), 1)
        x[:, PATH : PATH + WORDS] = np.bincount(place, weights=sign, minlength=n * WORDS).reshape(n, WORDS) / np.sqrt(words)[:, None]
        np.clip(x, -3, 3, out=x)
        x[:, PATH + WORDS] = np.log1p(words) / 4
        x[:, PATH + WORDS + 1] = [b[2] for b in flat]
        x[:, :PATH] = [path_vector(b[0]) for b in flat]
    out, a = [], 0
    for page in pages:
        k = len(page)
        x[a : a + k, -2] = np.arange(k) / max(1, k)
        x[a : a + k, -1] = 1.0
        out.append(x[a : a + k])
        a += k
    return out


def _sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


class BiLSTM:
    """Two LSTMs, one each way, and a logistic output a block; Adam on mean log loss."""

    def __init__(self, inputs: int, hidden: int = HIDDEN, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.hidden = hidden
        self.p = {}
        for d in "fb":
            self.p[f"w{d}"] = (rng.standard_normal((inputs + hidden, 4 * hidden)) / np.sqrt(inputs + hidden)).astype(np.float32)
            bias = np.zeros(4 * hidden, np.float32)
            bias[hidden : 2 * hidden] = 1
            self.p[f"c{d}"] = bias
        self.p["o"] = (rng.standard_normal(2 * hidden + inputs) * 0.05).astype(np.float32)
        self.p["ob"] = np.zeros(1, np.float32)

    def _run(self, x, mask, d, keep):
        """States at each step of padded sequences (steps, rows, inputs); what backward needs if keep."""
        t, n, _ = x.shape
        k = self.hidden
        h, c = np.zeros((n, k), np.float32), np.zeros((n, k), np.float32)
        out, log = np.zeros((t, n, k), np.float32), []
        w, b = self.p[f"w{d}"], self.p[f"c{d}"]
        pre = (x.reshape(t * n, -1) @ w[: x.shape[2]]).reshape(t, n, -1) + b
        for s in range(t) if d == "f" else range(t - 1, -1, -1):
            z = pre[s] + h @ w[x.shape[2] :]
            i, f, o, g = _sigmoid(z[:, :k]), _sigmoid(z[:, k : 2 * k]), _sigmoid(z[:, 2 * k : 3 * k]), np.tanh(z[:, 3 * k :])
            c2 = f * c + i * g
            q = np.tanh(c2)
            h2, m = o * q, mask[s][:, None]
            if keep:
                log.append((s, h, c, i, f, o, g, q))
            h, c = m * h2 + (1 - m) * h, m * c2 + (1 - m) * c
            out[s] = h
        return out, log

    def logits(self, x, mask, keep=False):
        a, la = self._run(x, mask, "f", keep)
        b, lb = self._run(x, mask, "b", keep)
        both = np.concatenate([a, b, x], 2)
        return both @ self.p["o"] + self.p["ob"], both, la, lb

    def step(self, x, mask, y, rate, state):
        z, both, la, lb = self.logits(x, mask, True)
        e = ((_sigmoid(z) - y) * mask / max(1.0, mask.sum())).astype(np.float32)
        g = {"o": np.tensordot(e, both, ([0, 1], [0, 1])), "ob": np.array([e.sum()], np.float32)}
        k, n_in = self.hidden, x.shape[2]
        for d, log, at in (("f", la, 0), ("b", lb, k)):
            w = self.p[f"w{d}"]
            dw, db = np.zeros_like(w), np.zeros(4 * k, np.float32)
            dh, dc = np.zeros((x.shape[1], k), np.float32), np.zeros((x.shape[1], k), np.float32)
            for s, h, c, i, f, o, gg, q in reversed(log):
                m = mask[s][:, None]
                dh = dh + e[s][:, None] * self.p["o"][at : at + k]
                ah, ac = dh * m, dc * m
                dq = ah * o
                ac = ac + dq * (1 - q * q)
                dz = np.concatenate([ac * gg * i * (1 - i), ac * c * f * (1 - f), ah * q * o * (1 - o), ac * i * (1 - gg * gg)], 1)
                dw[:n_in] += x[s].T @ dz
                dw[n_in:] += h.T @ dz
                db += dz.sum(0)
                dh = dh * (1 - m) + dz @ w[n_in:].T
                dc = dc * (1 - m) + ac * f
            g[f"w{d}"], g[f"c{d}"] = dw, db
        norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
        state["t"] = t = state.get("t", 0) + 1
        for name, v in g.items():
            v = v * min(1.0, 1.0 / (norm + 1e-9))
            m1, m2 = state.get(name, (0, 0))
            m1, m2 = 0.9 * m1 + 0.1 * v, 0.99 * m2 + 0.01 * v * v
            state[name] = m1, m2
            self.p[name] = (self.p[name] - rate * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-8)).astype(np.float32)

    @staticmethod
    def pad(xs):
        t = max(len(x) for x in xs)
        out, mask = np.zeros((t, len(xs), xs[0].shape[1]), np.float32), np.zeros((t, len(xs)), np.float32)
        for k, x in enumerate(xs):
            out[: len(x), k], mask[: len(x), k] = x, 1
        return out, mask

    def fit(self, xs, ys, epochs=EPOCHS, rate=0.01, batch=16, seed=3):
        rng, state = np.random.default_rng(seed), {}
        order = np.argsort([len(x) for x in xs], kind="stable")
        parts = [order[a : a + batch] for a in range(0, len(order), batch)]
        for e in range(epochs):
            for k in rng.permutation(len(parts)):
                x, mask = self.pad([xs[i] for i in parts[k]])
                y = np.zeros(mask.shape, np.float32)
                for j, i in enumerate(parts[k]):
                    y[: len(ys[i]), j] = ys[i]
                self.step(x, mask, y, rate * (0.3 if e >= epochs * 2 // 3 else 1.0), state)

    def label(self, xs: list[np.ndarray]) -> list[np.ndarray]:
        """Article or not, for each block of each page; pages of like length go together, a long one alone."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(xs)
        order = [i for i in np.argsort([len(x) for x in xs], kind="stable").tolist() if len(xs[i])]
        a = 0
        while a < len(order):
            b = a + 1
            while b < len(order) and (b - a + 1) * len(xs[order[b]]) <= 8192:
                b += 1
            x, mask = self.pad([xs[i] for i in order[a:b]])
            z = self.logits(x, mask)[0]
            for k, i in enumerate(order[a:b]):
                out[i] = z[: len(xs[i]), k] > 0
            a = b
        return out


WIDE = 0.6  # an element with more of a page's text than this is the page's frame, whatever it is called


def _framing(blocks: list[tuple]) -> set[int]:
    """The elements that hold a page together: around article markup, or around most of the text."""
    size, frames = Counter(), set()
    for path, text, _, numbers in blocks:
        inner = [k for k, s in enumerate(path) if s.split()[0] in ("article", "main")]
        frames.update(numbers[: inner[0]] if inner else ())
        for n in numbers:
            size[n] += len(text)
    whole = sum(len(b[1]) for b in blocks)
    return frames | {n for n, k in size.items() if k > WIDE * whole}


def page_labels(blocks: list[tuple], common: set[str]) -> list[int]:
    """What a page says of its blocks itself: 1 article, 0 not. Names count only below the frame of the page.

    With article markup: what is in it but not in boilerplate inside it, repeated elsewhere or not. Without: text of some length with few links that is on no other
    page, and short blocks between two of those."""
    frames = _framing(blocks)
    able, inside = [], []
    for path, text, links, numbers in blocks:
        names = [s.split()[0] for s in path]
        start = max((k for k, n in enumerate(names) if n in ("article", "main")), default=-1)
        boiler = any(n in BOILER and k > start and numbers[k] not in frames for k, n in enumerate(names))
        hinted = any(HINTS.search(v) for s, n in zip(path, numbers, strict=True) if n not in frames for v in told(s))
        able.append("head" not in names and not boiler and not hinted)
        inside.append(start >= 0)
    if any(a and i for a, i in zip(able, inside, strict=True)):
        return [int(a and i) for a, i in zip(able, inside, strict=True)]
    able = [a and b[2] < 0.5 and b[1] not in common for a, b in zip(able, blocks, strict=True)]
    sure = [a and len(b[1].split()) >= 10 for a, b in zip(able, blocks, strict=True)]
    at = [k for k, s in enumerate(sure) if s]
    return [int(a and bool(at) and (s or max(0, at[0] - 1) <= k <= at[-1])) for k, (a, s) in enumerate(zip(able, sure, strict=True))]


_NOTHING = {
    "nav": ["nav", 'div class="menu"', 'ul class="nav-links"', 'div id="navigation"', 'div class="breadcrumbs"', 'div role="navigation"', 'div class="navbar"', 'div class="main-menu"'],
    "top": ["header", 'div class="header"', 'div id="header"', 'div class="site-header"', 'div role="banner"', 'div class="masthead"', 'div class="topbar"'],
    "foot": ["footer", 'div class="footer"', 'div id="footer"', 'div class="site-footer"', 'div class="copyright"', 'div role="contentinfo"', 'div class="legal"'],
    "side": ["aside", 'div class="sidebar"', 'div id="sidebar"', 'div class="widget"', 'section class="related"', 'div class="related-posts"', 'div class="recommended"', 'div class="share"', 'div class="social"', 'div role="complementary"'],
    "ad": ['div class="ad"', 'div class="ads"', 'div class="advert"', 'div class="advertisement"', 'div class="banner"', 'div class="sponsored"', 'div id="ad-top"', 'div class="promo"', 'ins class="adsbygoogle"'],
    "note": ['div class="cookie-notice"', 'div class="notice"', 'div class="alert"', 'div id="cookie-banner"', 'div class="consent"', 'div class="popup"', 'div class="modal"', 'div role="dialog"', 'div class="newsletter"'],
    "form": ["form", 'form class="search"', 'form id="login"', 'div class="subscribe"', 'form class="signup"'],
    "talk": ['div class="comments"', 'section id="comments"', 'div class="comment"', 'ol class="comment-list"', 'div class="replies"', 'section class="comments"', 'div id="disqus"', 'article class="comment"'],
}
_MAIN = ["article", "main", 'div class="content"', 'div id="content"', 'div class="post"', 'div class="article"', 'div class="entry-content"', 'div class="article-body"', 'div class="post-content"', 'div id="main"', 'section class="story"', 'div class="text"', 'article class="post"', 'div role="main"']


def redressed(good: list[str], bad: list[str], rng: random.Random) -> tuple[str, list[int]]:
    """A page in a made-up template around given texts, and the labels of its blocks."""
    marks: list[int] = []
    bad = bad or ["Home", "More"]

    def wrap(tag, inner):
        return f"<{tag}>{inner}</{tag.split()[0]}>"

    def boiler(kind):
        texts = [rng.choice(bad) for _ in range(rng.randint(1, 5))]
        if kind in ("side", "ad", "note", "talk") and rng.random() < 0.5:
            texts += [rng.choice(good) for _ in range(rng.randint(1, 3))]
        marks.extend([0] * len(texts))
        if kind == "nav" or rng.random() < 0.25:
            return wrap(rng.choice(_NOTHING[kind]), wrap("ul", "".join(f'<li><a href="/">{t}</a></li>' for t in texts)))
        inner = "p" if kind in ("talk", "note", "ad", "side") or rng.random() < 0.6 else "div"
        return wrap(rng.choice(_NOTHING[kind]), "".join(f"<{inner}>{t}</{inner}>" for t in texts))

    parts = []
    if rng.random() < 0.7:
        marks.append(0)
        parts.append(f"<head><title>{rng.choice(good)[:60]}</title></head>")
    parts += [boiler(k) for k in rng.sample(["top", "nav", "ad", "note", "form", "side"], rng.randint(1, 4))]
    body = []
    for k, t in enumerate(good):
        tag = "h1" if k == 0 and rng.random() < 0.6 else rng.choice(["p"] * 8 + ["h2", "blockquote", "li"])
        marks.append(1)
        body.append(f"<ul><li>{t}</li></ul>" if tag == "li" else f"<{tag}>{t}</{tag}>")
        if rng.random() < 0.08:
            body.append(boiler(rng.choice(["ad", "side", "form", "note"])))
    if rng.random() < 0.15:
        body.append(boiler("talk"))
    parts.append(wrap(rng.choice(_MAIN), "".join(body)))
    parts += [boiler(k) for k in rng.sample(["talk", "side", "foot", "ad", "form", "nav"], rng.randint(1, 4))]
    inner = "".join(parts)
    if rng.random() < 0.5:
        inner = wrap(rng.choice(['div class="wrapper"', 'div id="page"', 'div class="container"', 'form id="aspnetForm"', "form", 'div class="has-sidebar"', 'div class="page-with-header"']), inner)
    return f"<html><body>{inner}</body></html>", marks


def train(pages: DataFrame, sample: int = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> BiLSTM | None:
    """A labeller from at most ``sample`` pages of at most ``most_bytes`` each; None if they have no text."""
    fit = F.octet_length("html").between(1, most_bytes)
    rows = pages.where(fit).orderBy(F.xxhash64("page_id", "html")).limit(sample).select("html").toArrow()
    if not len(rows):  # all are larger: the smallest few
        rows = pages.where(F.octet_length("html") > 0).orderBy(F.octet_length("html"), F.xxhash64("page_id", "html")).limit(4).select("html").toArrow()
    found = [b for b in map(blocks_of, rows["html"].to_pylist()) if b]
    seen = Counter(t for page in found for t in {b[1] for b in page})
    common = {t for t, n in seen.items() if n > 2 and n > len(found) // 50}
    rng = random.Random(5)
    xs, ys = [], []
    for blocks in found:
        y = page_labels(blocks, common)
        if not any(y):
            continue
        xs.append(blocks)
        ys.append(y)
        good, bad = ([entities.escape(b[1]) for b, k in zip(blocks, y, strict=True) if k == want][:40] for want in (1, 0))
        for _ in range(3):
            made, marks = redressed(good, bad, rng)
            got = blocks_of(made)
            if len(got) == len(marks):
                xs.append(got)
                ys.append(marks)
    if not xs:
        return None
    x = features(xs)
    model = BiLSTM(x[0].shape[1])
    model.fit(x, ys)
    return model


def extract(pages: DataFrame, model: BiLSTM | None) -> DataFrame:
    """page_id, url, text, n_chars."""
    sent = pages.sparkSession.sparkContext.broadcast(None if model is None else model.p)

    def read(batches):
        net = None
        if sent.value is not None:
            net = BiLSTM(1, 1)
            net.p = sent.value
            net.hidden = net.p["cf"].shape[0] // 4
        for batch in batches:
            for a in range(0, len(batch), 256):
                part = batch.slice(a, 256)
                blocks = [blocks_of(h) for h in part["html"].to_pylist()]
                labels = net.label(features(blocks)) if net else [page_labels(page, set()) for page in blocks]
                texts = ["\n".join(b[1] for b, k in zip(page, keep, strict=True) if k) for page, keep in zip(blocks, labels, strict=True)]
                yield pa.record_batch([part["page_id"], part["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(read, "page_id long, url string, text string, n_chars long")


def op9_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extract(pages, train(pages))
