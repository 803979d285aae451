"""HTML extraction by a recurrent block labeller.

A page is cut into its leaf blocks in order. Each is read as the hashed names on its tag path (tags,
classes, ids, roles), the hashed words of its text and a few measures; a bidirectional LSTM in numpy
goes over the whole sequence, and every block is labelled with what stands before and after it in
view. Blocks labelled as main text, references decoded and white space made one space, are joined.

The labeller is trained here, in a few seconds and from a fixed seed, on pages that training_page()
draws with the label of every block.

Nulls: a null html or one without text gives an empty text and 0 characters. Every row gives one row;
repeated rows each. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import html as html_lib
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

PATH_SLOTS, WORD_SLOTS, MEASURES, HIDDEN = 256, 64, 4, 12
#: Blocks of one batch of pages (padded), so that a batch's memory is bounded but for one page's own.
BATCH_BLOCKS = 20_000
#: Blocks of a page that are read at once.
READ_BLOCKS = 4096

_RAW = "script|style|template|noscript|svg|iframe|textarea|select"
_TOKEN = re.compile(rf"""<!--.*?(?:-->|\Z)|<({_RAW})\b(?:"[^"]*"|'[^']*'|[^'"<>])*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9-]*)((?:"[^"]*"|'[^']*'|[^'"<>])*)>|<![^>]*>""", re.S | re.I)
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr button".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An opening tag closes an open one of its own kind.
_CLOSES_OWN = frozenset("p li dt dd tr td th option".split())


_HOLDERS = frozenset("ul ol dl table div article section aside".split())


class _Open:
    """The open tags, and the path slots that any of them sets, as bits of a number: of one size at any depth."""

    def __init__(self):
        self.tags: list[tuple[str, list[int]]] = []
        self.of_tag: Counter = Counter()
        self._held = [0] * PATH_SLOTS
        self.slots = 0

    def push(self, tag: str, names: list[str]) -> None:
        own = [crc32(n.encode()) % PATH_SLOTS for n in names]
        for k in own:
            self._held[k] += 1
            self.slots |= 1 << k
        self.tags.append((tag, own))
        self.of_tag[tag] += 1

    def pop(self) -> str:
        tag, own = self.tags.pop()
        for k in own:
            self._held[k] -= 1
            if not self._held[k]:
                self.slots &= ~(1 << k)
        self.of_tag[tag] -= 1
        return tag

    def close(self, tag: str) -> None:
        """A closing tag; without an open one it is nothing."""
        while self.of_tag[tag] and self.pop() != tag:
            pass

    def close_own(self, tag: str) -> None:
        """An opening tag ends the one of its kind before it, unless one that holds others lies between."""
        if self.of_tag[tag]:
            nearest = next(t for t, _ in reversed(self.tags) if t == tag or t in _HOLDERS)
            if nearest == tag:
                self.close(tag)


def blocks(page: str) -> list[tuple[int, str, float]]:
    """(slots of the names on the path, text, share of link characters) of every block with text, in page order."""
    out: list = []
    stack = _Open()
    text: list[str] = []
    linked, in_link, at = 0, 0, 0

    def close():
        nonlocal text, linked
        own = " ".join(html_lib.unescape("".join(text)).split()) if text else ""
        if own:
            out.append((stack.slots, own, min(1.0, linked / len(own))))
        text, linked = [], 0

    for m in _TOKEN.finditer(page):
        if m.start() > at:
            text.append(page[at : m.start()])
            linked += (m.start() - at) * bool(in_link)
        at = m.end()
        if not m[3]:
            continue
        tag = m[3].lower()
        if tag in _INLINE:
            if tag == "a":
                in_link = 0 if m[2] else 1
            continue
        if tag == "br":
            text.append(" ")
            continue
        close()
        if tag in _VOID:
            continue
        if m[2]:
            stack.close(tag)
            continue
        if tag in _CLOSES_OWN:
            stack.close_own(tag)
        names = [tag]
        for a in _ATTRIBUTE.finditer(m[4]):
            names += [f"{a[1].lower()}:{w.lower()}" for w in re.split(r"[\s_-]+", a[2] or a[3] or a[4] or "") if w]
        stack.push(tag, names)
    text.append(page[at:])
    close()
    return out


def vectors(found: list) -> np.ndarray:
    """Rows of a page's blocks as the labeller reads them."""
    x = np.zeros((len(found), PATH_SLOTS + WORD_SLOTS + MEASURES), np.float32)
    for row, (path, text, links) in zip(x, found, strict=True):
        row[:PATH_SLOTS] = np.unpackbits(np.frombuffer(path.to_bytes(PATH_SLOTS // 8, "little"), np.uint8), bitorder="little")
        words = text.split(" ")
        slots = np.bincount([crc32(w.encode()) % WORD_SLOTS for w in words], minlength=WORD_SLOTS)
        row[PATH_SLOTS : PATH_SLOTS + WORD_SLOTS] = slots / len(words)
        row[-4:] = np.log1p(len(words)) / 6, links, text[-1] in ".!?", float(len(words) < 4)
    return x


class BlockLabeller:
    """Forward and backward LSTM, one logit a block. Parameters in a dict of arrays."""

    def __init__(self, seed: int = 5, hidden: int = HIDDEN):
        rng, d = np.random.default_rng(seed), PATH_SLOTS + WORD_SLOTS + MEASURES
        self.h = hidden
        self.p = {"v": rng.normal(0, 0.2, 2 * hidden), "c": np.zeros(1)}
        for side in "fb":
            self.p["w" + side] = rng.normal(0, 0.1, (d, 4 * hidden))
            self.p["u" + side] = rng.normal(0, 0.2, (hidden, 4 * hidden))
            self.p["b" + side] = np.repeat([0.0, 1.0, 0.0, 0.0], hidden)
        self.p = {k: a.astype(np.float32) for k, a in self.p.items()}

    def _run(self, z: np.ndarray, mask: np.ndarray, side: str, keep: list | None = None) -> np.ndarray:
        """Hidden states over time; z: batch, time, 4h inputs of the gates. Padding leaves states as they are."""
        n, t, h = len(z), z.shape[1], self.h
        s, c, out = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32), np.zeros((n, t, h), np.float32)
        for k in range(t) if side == "f" else range(t - 1, -1, -1):
            g = z[:, k] + s @ self.p["u" + side]
            g[:, : 3 * h] = 1 / (1 + np.exp(-np.clip(g[:, : 3 * h], -30, 30)))
            g[:, 3 * h :] = np.tanh(g[:, 3 * h :])
            i, f, o, a = (g[:, j * h : (j + 1) * h] for j in range(4))
            m = mask[:, k : k + 1]
            c1 = f * c + i * a
            y = np.tanh(c1)
            if keep is not None:
                keep.append((k, s, c, g, y, m))
            c, s = np.where(m, c1, c), np.where(m, o * y, s)
            out[:, k] = s
        return out

    def scores(self, pages: list[list]) -> list[np.ndarray]:
        """A logit a block of each page. Blocks are read and taken to the gates' inputs some thousand at a time, so a page of
        many costs those inputs alone."""
        w, b = (np.concatenate([self.p[k + side] for side in "fb"], axis=-1) for k in "wb")
        z, mask = padded([np.concatenate([vectors(found[i : i + READ_BLOCKS]) @ w + b for i in range(0, len(found), READ_BLOCKS)]) for found in pages])
        hs = [self._run(z[:, :, k * 4 * self.h : (k + 1) * 4 * self.h], mask, side) for k, side in enumerate("fb")]
        out = self.p["c"] + hs[0] @ self.p["v"][: self.h] + hs[1] @ self.p["v"][self.h :]
        return [row[: len(found)] for row, found in zip(out, pages, strict=True)]

    def logits(self, x: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        out = self.p["c"]
        for n, side in enumerate("fb"):
            trail = None if keep is None else keep.setdefault(side, [])
            hs = self._run(x @ self.p["w" + side] + self.p["b" + side], mask, side, trail)
            if keep is not None:
                keep["h" + side] = hs
            out = out + hs @ self.p["v"][n * self.h : (n + 1) * self.h]
        return out

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy over unpadded blocks."""
        keep: dict = {}
        e = (1 / (1 + np.exp(-self.logits(x, mask, keep))) - y) * mask / mask.sum()
        g, h = {"c": e.sum(keepdims=True).reshape(1)}, self.h
        dv = []
        for n, side in enumerate("fb"):
            hs, v = keep["h" + side], self.p["v"][n * h : (n + 1) * h]
            dv.append(np.einsum("nt,nth->h", e, hs))
            dz, du = np.zeros((*x.shape[:2], 4 * h), np.float32), np.zeros((h, 4 * h), np.float32)
            ds, dc = np.zeros((len(x), h), np.float32), np.zeros((len(x), h), np.float32)
            for k, s, c, gate, tc, m in reversed(keep[side]):
                i, f, o, a = (gate[:, j * h : (j + 1) * h] for j in range(4))
                ds = ds + e[:, k : k + 1] * v
                own, cell = ds * m, dc * m
                cell = cell + own * o * (1 - tc * tc)
                d = np.concatenate([cell * a * i * (1 - i), cell * c * f * (1 - f), own * tc * o * (1 - o), cell * i * (1 - a * a)], axis=1)
                dz[:, k], du = d, du + s.T @ d
                ds, dc = ds * ~m + d @ self.p["u" + side].T, dc * ~m + cell * f
            g |= {"u" + side: du, "b" + side: dz.sum((0, 1)), "w" + side: np.einsum("ntd,ntk->dk", x, dz, optimize=True)}
        return g | {"v": np.concatenate(dv)}

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = 6, batch: int = 24, rate: float = 0.02, seed: int = 2) -> None:
        """Adam over (vectors, labels) of pages."""
        rng, step = np.random.default_rng(seed), 0
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        for _ in range(epochs):
            order = rng.permutation(len(pages))
            for i in range(0, len(order), batch):
                some = [pages[j] for j in order[i : i + batch]]
                x, mask = padded([a for a, _ in some])
                y = np.zeros(mask.shape, np.float32)
                for row, (_, b) in zip(y, some, strict=True):
                    row[: len(b)] = b
                step += 1
                for k, g in self.gradients(x, mask, y).items():
                    m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                    self.p[k] = (self.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-7)).astype(np.float32)


def padded(xs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    t = max(1, max(map(len, xs)))
    x, mask = np.zeros((len(xs), t, xs[0].shape[1]), np.float32), np.zeros((len(xs), t), bool)
    for k, a in enumerate(xs):
        x[k, : len(a)], mask[k, : len(a)] = a, True
    return x, mask


def training_page(rng: random.Random) -> tuple[str, list[int]]:
    """A page and the label of each of its blocks: 1 for main text."""
    labels: list[int] = []
    syllable = lambda: rng.choice("aeiou") + rng.choice("bcdfglmnprst")
    word = lambda: "".join(syllable() for _ in range(rng.randint(1, 4)))
    words = lambda lo, hi: " ".join(word() for _ in range(rng.randint(lo, hi)))
    link = lambda: f'<a href="/{word()}">{words(1, 2)}</a>'
    some = lambda p: rng.random() < p

    def block(tag: str, inner: str, label: int) -> str:
        labels.append(label)
        return f"<{tag}>{inner}</{tag.split()[0]}>"

    def para(label: int) -> str:
        end = rng.choice([".", ".", ".", "", "!"])
        body = words(1, 60) + end
        if some(0.2):
            body = f"<b>{body}" + ("</b>" if some(0.5) else "")
        if some(0.2):
            body += f" {link()} {words(1, 9)}<br>{words(1, 5)}"
        return block("p", body, label)

    def boiler() -> str:
        kind = rng.choice(["nav", "header", "aside", "ad", "notice", "form", "share"])
        box = {"nav": ["nav", 'div class="menu"', 'div id="nav"', 'ul class="navigation"', 'div class="breadcrumb"'], "header": ["header", 'div id="header"', 'div class="masthead"'], "aside": ["aside", 'div class="sidebar"', 'div class="related"', 'aside class="widget"'], "ad": ['div class="ad"', 'div class="advert"', 'div id="banner"', 'div class="sponsored promo"', 'aside class="ads"'], "notice": ['div class="cookie"', 'div class="notice"', 'div role="alert"', 'section class="newsletter"', 'div id="consent"'], "form": ["form", 'form class="search"', 'div class="login"'], "share": ['div class="share"', 'div class="social"', 'ul class="tags"']}[kind]
        tag = rng.choice(box)
        inner = "".join(
            (block("li", link(), 0) if kind in ("nav", "share") else block(rng.choice(["p", "div", "h3", "span-x"]), words(1, 25) + rng.choice(["", ".", " " + link()]), 0))
            for _ in range(rng.randint(1, 6))
        )
        if kind == "ad" and some(0.6):
            del labels[-inner.count("</p>") - inner.count("</div>") - inner.count("</h3>") - inner.count("</span-x>") :]
            labels.append(0)
            inner = words(2, 12) + "."
        return f"<{tag}>{inner}</{tag.split()[0]}>"

    def comments() -> str:
        tag = rng.choice(['section id="comments"', 'div class="comments"', 'div id="disqus"', 'ol class="comment-list"'])
        inner = "".join(f'<div class="comment">{block("p", words(2, 40) + ".", 0)}</div>' for _ in range(rng.randint(1, 4)))
        return f"<{tag}>{inner}</{tag.split()[0]}>"

    def article() -> str:
        tag = rng.choice(["article", "article", "article", "main", 'div class="content"', 'div class="post"', 'div id="article-body"'])
        inner = block("h1", words(2, 9), 1) if some(0.8) else ""
        for _ in range(rng.randint(1, 14)):
            r = rng.random()
            if r < 0.72:
                inner += para(1)
            elif r < 0.8:
                inner += block(rng.choice(["h2", "h3"]), words(1, 6), 1)
            elif r < 0.86:
                inner += "<ul>" + "".join(block("li", words(1, 12), 1) for _ in range(rng.randint(1, 4))) + "</ul>"
            elif r < 0.9:
                inner += block(rng.choice(["blockquote", "pre", "figcaption"]), words(2, 20), 1)
            else:
                inner += boiler()
        if some(0.15):
            inner += comments()
        return f"<{tag}>{inner}</{tag.split()[0]}>"

    labels.append(0)
    out = f"<!DOCTYPE html><html><head><title>{words(1, 8)}</title><style>p{{}}</style></head><body>"
    for _ in range(rng.randint(0, 4)):
        out += boiler()
    if some(0.3):
        out += "<main>" + article() + "</main>"
    else:
        out += article()
    for _ in range(rng.randint(0, 3)):
        out += comments() if some(0.3) else boiler()
    if some(0.8):
        tag = rng.choice(["footer", "footer", 'div id="footer"'])
        labels.append(0)
        out += f"<{tag}>&copy; {words(2, 20)}.</{tag.split()[0]}>"
    return out + ("</body></html>" if some(0.8) else ""), labels


_trained: list[BlockLabeller] = []


def labeller(pages: int = 700, seed: int = 11) -> BlockLabeller:
    """The trained labeller of this process."""
    if not _trained:
        rng, own = random.Random(seed), []
        for _ in range(pages):
            page, labels = training_page(rng)
            found = blocks(page)
            if len(found) != len(labels):
                raise AssertionError("a training page's blocks and labels differ")
            own.append((vectors(found), np.array(labels, np.float32)))
        model = BlockLabeller()
        model.fit(own)
        _trained.append(model)
    return _trained[0]


def main_texts(model: BlockLabeller, pages: list[str | None]) -> list[str]:
    cut = [blocks(p or "") for p in pages]
    order = sorted(range(len(cut)), key=lambda i: len(cut[i]))
    out, i = [""] * len(cut), 0
    while i < len(order):
        j = i + 1
        while j < len(order) and (j - i + 1) * len(cut[order[j]]) <= BATCH_BLOCKS:
            j += 1
        own = [k for k in order[i:j] if cut[k]]
        if own:
            for k, row in zip(own, model.scores([cut[k] for k in own]), strict=True):
                out[k] = " ".join(b[1] for b, s in zip(cut[k], row, strict=True) if s > 0)
        i = j
    return out


def extract(pages: DataFrame, model: BlockLabeller | None = None) -> DataFrame:
    """page_id, url, text and n_chars (code points) of pages (page_id, url, html). No shuffle."""
    model = model or labeller()

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                some = batch.slice(i, 512)
                texts = main_texts(model, some.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    own = pages.selectExpr("cast(page_id as long) as page_id", "url", "html")
    return own.mapInArrow(run, "page_id long, url string, text string, n_chars long")
