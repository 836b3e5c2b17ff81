"""Main text of pages by a recurrent block labeller.

A page is cut into leaf blocks (texts between block-level tags) with the path of elements above each.
A bidirectional LSTM in numpy reads the blocks of a page in order; a block is a hashed vector of its
tag path, a hashed vector of its words and a few figures (length, share of links, place). Every
block is labelled main text or not with the whole page as context, and main blocks are joined.

The labeller is trained on the driver on at most `layouts` made-up pages, which vary the names,
nesting and order of menus, notices, adverts, forms, sidebars, comments and articles, and at most
`samples` pages of the given table, chosen by a hash, whose own `article` element says which blocks
are main text. The words of the made-up pages are taken from the sampled ones. Sampled pages of `most_chars` characters
or `most_blocks` blocks and more teach nothing; every page is labelled whole.

Features read the `NEAR` elements nearest to a block. Below `OPEN` open elements further ones have no part in a block's
path, so such a block is judged by what stands above them; no text is lost. Labelling keeps the states of a
page's blocks (192 bytes each, beside their features) and nothing of the steps between.

Defined cases: a null page is empty; pages without main blocks give the empty text; unclosed and cut
off markup is read as far as it goes; comments, scripts, styles, templates, text areas and frames
have no blocks, and of an unclosed one only its tag (and code up to the next tag) is left out;
formulas, drawings and the fallback text of objects are ordinary text; unknown references stay as they are; repeated rows are labelled alike; other columns are kept.
"""

from __future__ import annotations

import html as references
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import WordHasher, hash_sample, others, pa_schema, packed, small_batches, text_slices, unpacked

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|template|textarea|iframe)(?=[\s/>])[^>]*>"
    r"|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|\Z)", re.S | re.I)
#: Where elements end whose content is not read, and the next tag after one that does not end.
ENDS = {name: re.compile(rf"</{name}\s*>", re.I) for name in ("script", "style", "template", "textarea", "iframe")}
TAG = re.compile(r"<[/!a-zA-Z]|\Z")
NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
#: Elements of HTML, by what they do to blocks; fixed values.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br picture source audio video track"
                   " object canvas noscript svg tspan math maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mroot mrow ms mspace"
                   " msqrt mstyle msub msubsup msup mtext munder munderover semantics annotation".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ENDS_PARAGRAPH = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
PATH, WORDS, FIGURES = 128, 48, 8
WIDTH = PATH + WORDS + FIGURES
NEAR = 8  # elements above a block that its features read
OPEN = 400  # elements kept open at once; deeper ones are counted, not named
STRETCH = 4096  # steps of the network whose inputs are multiplied at once


@dataclass(frozen=True)
class LabellerParams:
    layouts: int = 1000
    samples: int = 200
    most_blocks: int = 300  # of a page to learn from
    most_chars: int = 200_000  # of a page to learn from; longer ones are left out of the sample, never of the result
    hidden: int = 24
    epochs: int = 12
    rate: float = 0.01
    seed: int = 5


@dataclass
class Block:
    text: str
    path: tuple[str, ...]
    linked: int  # characters inside links


def blocks_of(page: str | None, most_open: int = OPEN) -> list[Block]:
    """Leaf blocks in page order; a block below more than `most_open` elements keeps its text, its path ends at the last of them."""
    out: list[Block] = []
    stack: list[tuple[str, str]] = []
    deep: list[str] = []  # elements opened below the deepest one of the stack
    endless: set[str] = set()  # names without a further end tag
    held: list[str] = []
    linked = 0
    begin = 0
    page = page or ""

    def flush() -> None:
        nonlocal linked
        text = " ".join(references.unescape("".join(held)).split())
        if text:
            out.append(Block(text, tuple(x[1] for x in stack if x[0] not in INLINE), linked))
        held.clear()
        linked = 0

    while m := MARKUP.search(page, begin):
        if m.start() > begin:
            piece = page[begin : m.start()]
            held.append(piece)
            if any(x[0] == "a" for x in stack[-4:]):
                linked += len(piece)
        begin = m.end()
        if m[1] and not m[0].endswith("/>"):
            raw = m[1].lower()
            end = ENDS[raw].search(page, begin) if raw not in endless else None
            if end:
                begin = end.end()
            else:
                endless.add(raw)
                begin = TAG.search(page, begin).start() if raw in ("script", "style") else begin
        name = (m[3] or "").lower()
        if not name:
            continue
        if name == "br":
            held.append(" ")
        if name not in INLINE:
            flush()
        if m[2] and name in deep:
            del deep[len(deep) - 1 - deep[::-1].index(name) :]
            continue
        if m[2]:
            at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if at is not None and (name not in INLINE or all(x[0] in INLINE for x in stack[at:])):
                del stack[at:]
                deep.clear()
            continue
        if name in ENDS_PARAGRAPH:
            at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] not in INLINE), None)
            if at is not None and stack[at][0] == "p":
                del stack[at:]
        if name in ("li", "option", "tr", "td", "th", "dt", "dd"):
            at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] not in INLINE), None)
            if at is not None and stack[at][0] in ({"td", "th"} if name in ("td", "th") else {"dt", "dd"} if name in ("dt", "dd") else {name}):
                del stack[at:]
        if name in VOID or m[4].rstrip().endswith("/"):
            continue
        if len(stack) >= most_open:
            deep.append(name)
        else:
            names = " ".join(x[2] or x[3] or x[4] for x in NAMED.finditer(m[4]))
            stack.append((name, f"{name} {names}".strip().lower()))
    held.append(page[begin:])
    flush()
    return out


def path_vector(path: tuple[str, ...]) -> np.ndarray:
    """Elements, their class and id words and parent-child pairs, hashed; nearer elements weigh more."""
    out = np.zeros(PATH, dtype=np.float32)
    above = ""
    for depth, element in enumerate(reversed(path[-NEAR:])):
        parts = element.split()
        words = {parts[0], *(f".{w}" for p in parts[1:] for w in re.split(r"[^a-z]+", p) if w)}
        for w in [*words, f"{parts[0]}>{above}", *(f"@{depth}{w}" for w in words if depth < 2)]:
            h = zlib.crc32(w.encode())
            out[h % PATH] += (1.0 if h >> 16 & 1 else -1.0) * 0.9**depth
        above = parts[0]
    return out


class Features:
    """Vectors of blocks."""

    def __init__(self) -> None:
        self.hasher = WordHasher()
        self.paths: dict[tuple[str, ...], np.ndarray] = {}

    def __call__(self, pages: list[list[Block]]) -> list[np.ndarray]:
        flat = [b for blocks in pages for b in blocks]
        if not flat:
            return [np.zeros((0, WIDTH), dtype=np.float32) for _ in pages]
        words, owner = self.hasher(pa.array([b.text.lower() for b in flat], pa.string()))
        sign = np.where(words >> np.uint64(40) & np.uint64(1), 1.0, -1.0)
        bag = np.bincount(owner * WORDS + (words % np.uint64(WORDS)).astype(np.int64), sign, len(flat) * WORDS).reshape(-1, WORDS)
        n_words = np.bincount(owner, minlength=len(flat))
        bag /= np.maximum(np.sqrt(n_words), 1)[:, None]
        if len(self.paths) > 20_000:
            self.paths = {}
        path = []
        for b in flat:
            if b.path not in self.paths:
                self.paths[b.path] = path_vector(b.path)
            path.append(self.paths[b.path])
        length = np.array([len(b.text) for b in flat], dtype=np.float64)
        place = np.concatenate([np.linspace(0, 1, len(p)) for p in pages if p])
        figures = np.stack([
            np.log1p(length) / 5, np.log1p(n_words) / 3, np.array([min(b.linked / len(b.text), 1) for b in flat]),
            np.array([b.text[-1] in ".!?:;…\"”»" for b in flat]), np.array([b.text.count(",") for b in flat]) / (1 + n_words),
            np.array([sum(c in b.text for c in "©|·»›") for b in flat]), place, (n_words < 4)], axis=1)
        x = np.concatenate((np.array(path), bag, figures), axis=1).astype(np.float32)
        return np.split(x, np.cumsum([len(p) for p in pages])[:-1])


# ---------------------------------------------------------------- the network


class Labeller:
    """A bidirectional LSTM with one output per step, trained by Adam on batches of padded sequences."""

    def __init__(self, hidden: int, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.h = hidden
        self.w: dict[str, np.ndarray] = {}
        for d in "fb":
            self.w[f"x{d}"] = (rng.standard_normal((WIDTH, 4 * hidden)) / np.sqrt(WIDTH)).astype(np.float32)
            self.w[f"h{d}"] = (rng.standard_normal((hidden, 4 * hidden)) / np.sqrt(hidden)).astype(np.float32)
            self.w[f"c{d}"] = np.zeros(4 * hidden, dtype=np.float32)
            self.w[f"c{d}"][hidden : 2 * hidden] = 1
        self.w["o"] = (rng.standard_normal((2 * hidden, 1)) / np.sqrt(2 * hidden)).astype(np.float32)
        self.w["p"] = (rng.standard_normal((WIDTH, 1)) / np.sqrt(WIDTH)).astype(np.float32)
        self.w["c"] = np.zeros(1, dtype=np.float32)

    def one_way(self, x: np.ndarray, mask: np.ndarray, d: str, tape: list | None = None) -> np.ndarray:
        """States of every step (batch, steps, hidden); padded steps keep the state. What learning needs goes on `tape`."""
        n, steps, _ = x.shape
        h, c = np.zeros((n, self.h), np.float32), np.zeros((n, self.h), np.float32)
        out = np.zeros((n, steps, self.h), np.float32)
        begins = range(0, steps, STRETCH)
        for begin in begins if d == "f" else reversed(begins):
            drive = x[:, begin : begin + STRETCH] @ self.w[f"x{d}"] + self.w[f"c{d}"]
            for at in range(drive.shape[1]) if d == "f" else range(drive.shape[1] - 1, -1, -1):
                t = begin + at
                z = drive[:, at] + h @ self.w[f"h{d}"]
                gates = 1 / (1 + np.exp(-np.clip(z[:, : 3 * self.h], -30, 30)))
                i, f, o = gates[:, : self.h], gates[:, self.h : 2 * self.h], gates[:, 2 * self.h :]
                g = np.tanh(z[:, 3 * self.h :])
                m = mask[:, t, None]
                new_c = m * (f * c + i * g) + (1 - m) * c
                tanh_c = np.tanh(new_c)
                new_h = m * (o * tanh_c) + (1 - m) * h
                if tape is not None:
                    tape.append((t, h, c, i, f, o, g, tanh_c, m))
                h, c = new_h, new_c
                out[:, t] = h
        return out

    def scores(self, x: np.ndarray, mask: np.ndarray, tapes: tuple[list, list] | None = None) -> tuple[np.ndarray, np.ndarray]:
        forward, backward = tapes or (None, None)
        both = np.concatenate((self.one_way(x, mask, "f", forward), self.one_way(x, mask, "b", backward)), axis=2)
        return (both @ self.w["o"] + x @ self.w["p"])[:, :, 0] + self.w["c"], both

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        fm, bm = [], []
        z, both = self.scores(x, mask, (fm, bm))
        dz = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * mask / mask.sum()).astype(np.float32)[:, :, None]
        grads = {"o": np.einsum("nth,nto->ho", both, dz), "p": np.einsum("nth,nto->ho", x, dz), "c": dz.sum(axis=(0, 1))}
        dboth = dz @ self.w["o"].T
        for d, memory, part in (("f", fm, dboth[:, :, : self.h]), ("b", bm, dboth[:, :, self.h :])):
            dh, dc = np.zeros_like(part[:, 0]), np.zeros_like(part[:, 0])
            dzs = np.zeros((*x.shape[:2], 4 * self.h), np.float32)
            wh = np.zeros_like(self.w[f"h{d}"])
            for t, h, c, i, f, o, g, tanh_c, m in reversed(memory):
                dh = dh + part[:, t]
                here = dh * m
                dcell = dc * m + here * o * (1 - tanh_c**2)
                step = np.concatenate((dcell * g * i * (1 - i), dcell * c * f * (1 - f), here * tanh_c * o * (1 - o), dcell * i * (1 - g**2)), axis=1)
                dzs[:, t] = step
                wh += h.T @ step
                dh = dh * (1 - m) + step @ self.w[f"h{d}"].T
                dc = dc * (1 - m) + dcell * f
            grads |= {f"x{d}": np.einsum("ntw,ntg->wg", x, dzs), f"h{d}": wh, f"c{d}": dzs.sum(axis=(0, 1))}
        return grads

    def fit(self, pages: list[np.ndarray], labels: list[np.ndarray], p: LabellerParams) -> None:
        rng = np.random.default_rng(p.seed)
        first, second, step = ({k: np.zeros_like(v) for k, v in self.w.items()} for _ in range(3))
        count = 0
        for epoch in range(p.epochs):
            order = rng.permutation(len(pages))
            order = order[np.argsort([len(pages[i]) // 8 for i in order], kind="stable")]
            batches = [order[k : k + 32] for k in range(0, len(order), 32)]
            rate = p.rate * (1 - epoch / p.epochs * 0.9)
            for k in rng.permutation(len(batches)):
                x, mask = padded([pages[i] for i in batches[k]])
                y = np.zeros(mask.shape, np.float32)
                for row, i in enumerate(batches[k]):
                    y[row, : len(labels[i])] = labels[i]
                count += 1
                for name, g in self.gradients(x, mask, y).items():
                    first[name] = 0.9 * first[name] + 0.1 * g
                    second[name] = 0.999 * second[name] + 0.001 * g * g
                    step[name] = (first[name] / (1 - 0.9**count)) / (np.sqrt(second[name] / (1 - 0.999**count)) + 1e-7)
                    self.w[name] = (self.w[name] - rate * step[name]).astype(np.float32)

    def main_blocks(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Which blocks of each page are main text; pages of like length are read together."""
        out = [np.zeros(0, dtype=bool) for _ in pages]
        order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
        while order:
            n = max(1, min(64, 4000 // len(pages[order[0]])))
            some, order = order[:n], order[n:]
            longest = len(pages[some[0]]) * 2 + 16  # padding stays below twice the length
            some, rest = [i for i in some if len(pages[i]) <= longest], [i for i in some if len(pages[i]) > longest]
            order = rest + order
            x, mask = padded([pages[i] for i in some])
            z, _ = self.scores(x, mask)
            for row, i in enumerate(some):
                out[i] = z[row, : len(pages[i])] > 0
        return out


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if len(pages) == 1:  # nothing to pad, and a very long page is not copied
        return pages[0][None], np.ones((1, len(pages[0])), np.float32)
    steps = max(len(p) for p in pages)
    x, mask = np.zeros((len(pages), steps, WIDTH), np.float32), np.zeros((len(pages), steps), np.float32)
    for row, page in enumerate(pages):
        x[row, : len(page)] = page
        mask[row, : len(page)] = 1
    return x, mask


# ---------------------------------------------------------------- pages to learn from

SIDE = {  # names under which pages keep what is not main text
    "menu": ["nav", "div class=menu", "ul class=nav", "div id=navbar", "div class='main-navigation'", "nav class=breadcrumb", "div class=breadcrumbs", "div role=navigation", "div class='toc'", "div class=pagination"],
    "head": ["header", "div class=header", "div id=header", "div id=masthead", "div class=topbar", "header class='site-header'", "div class=logo"],
    "foot": ["footer", "div class=footer", "div id=footer", "footer class='site-footer'", "div class=copyright", "div role=contentinfo"],
    "side": ["aside", "div class=sidebar", "div id=sidebar", "aside class=related", "div class='related-posts'", "div class=widget", "div class=recommended", "section class='more-stories'", "div role=complementary"],
    "advert": ["div class=ad", "div class=ads", "aside class=advert", "div class=sponsored", "ins class=adsbygoogle", "div class=promo", "div class='ad-banner'", "div id=advertisement", "section class=advertisement"],
    "notice": ["div class='cookie-notice'", "div id=cookies", "div class=notice", "div class=alert", "div role=alert", "div class=gdpr", "div class='cookie-banner'", "div class=modal", "div class=popup", "dialog", "section class=disclaimer", "p class=notice"],
    "form": ["form", "form class=subscribe", "div class=newsletter", "form id=search", "div class='signup-form'", "fieldset", "div class=login"],
    "comments": ["section class=comments", "div id=comments", "ol class='comment-list'", "div class=comment", "div class=disqus", "section id=responses", "ul class=replies", "div class='user-comments'", "div class=reviews", "div id=discussion"],
    "share": ["div class=share", "ul class=social", "div class='share-buttons'", "div class=tags", "p class=byline-links"],
}
MAIN = ["article", "main", "div class=content", "div id=content", "div class=post", "div class='entry-content'", "div class='article-body'", "section class=post",
        "main><article", "div id=main><article", "article><div class=body", "div class=container><div class=story", "div role=main", "td class=content", "div", "article class=post", ""]
PHRASES = {
    "menu": ["Home", "About us", "Contact", "News", "Products", "Blog", "Next", "Previous", "Skip to content"], "head": ["Sign in", "Search", "Menu"],
    "foot": ["© 2024 All rights reserved", "Privacy policy", "Terms of use", "Imprint"], "side": ["Related articles", "Most read", "Recent posts", "You may also like"],
    "advert": ["Advertisement", "Sponsored", "Buy now", "Special offer"], "notice": ["We use cookies to improve your experience.", "Accept all", "This site uses cookies"],
    "form": ["Subscribe to our newsletter", "Your email", "Send", "Search", "Name", "Password"], "comments": ["Comments", "3 comments", "Reply", "Leave a comment", "says:"],
    "share": ["Share", "Tweet", "Print", "Filed under"],
}


def made_up(rng: np.random.Generator, words: list[str]) -> tuple[list[Block], list[bool]]:
    """A page with known main blocks: they are marked by a character that is taken out again."""
    mark = "\u2060"  # word joiner

    def sentence(low: int, high: int) -> str:
        return " ".join(words[i] for i in rng.integers(0, len(words), rng.integers(low, high))).capitalize() + rng.choice([".", ".", "", "!"])

    def element(name: str, inside: str) -> str:
        opened = name.split("><")
        return "".join(f"<{x}>" for x in opened) + inside + "".join(f"</{x.split()[0]}>" for x in reversed(opened)) if name else inside

    def side(kind: str) -> str:
        some = [str(rng.choice(PHRASES[kind])) if rng.random() < 0.35 else sentence(1, 9 if kind not in ("comments", "advert", "notice", "side") else 40) for _ in range(rng.integers(1, 7))]
        if kind in ("menu", "share") or kind in ("side", "foot", "head") and rng.random() < 0.5:
            inside = "<ul>" + "".join(f"<li><a href='/x'>{s}</a></li>" for s in some) + "</ul>" if rng.random() < 0.7 else " ".join(f"<a href='/x'>{s}</a>" for s in some)
        elif kind == "form":
            inside = "".join(f"<label>{s}</label><input name=q>" for s in some[:3]) + f"<button>{sentence(1, 3)}</button>"
            inside += "<select>" + "".join(f"<option>{sentence(1, 3)}</option>" for _ in range(3)) + "</select>" if rng.random() < 0.3 else ""
        elif kind == "comments":
            body = rng.choice(["<div class=comment><span class=author>{a}</span><p>{s}</p></div>", "<li><p>{s}</p></li>", "<p>{s}</p>", "<article class=comment><p>{s}</p></article>", "<blockquote>{s}</blockquote>"])
            inside = (f"<h3>{rng.choice(PHRASES[kind])}</h3>" if rng.random() < 0.6 else "") + "".join(str(body).format(a=sentence(1, 3), s=s) for s in some)
        else:
            inside = "".join(f"<p>{s}</p>" if rng.random() < 0.6 else f"<div>{s}</div>" for s in some) if rng.random() < 0.5 else some[0]
        return element(str(rng.choice(SIDE[kind])), inside)

    def article() -> str:
        out = [f"<h1>{mark}{sentence(2, 12)}</h1>"] if rng.random() < 0.8 else []
        if out and rng.random() < 0.2:
            out = [f"<header>{out[0]}</header>"]
        for _ in range(rng.integers(1, 14)):
            kind, s = rng.random(), lambda: mark + sentence(3, 70)
            if kind < 0.66:
                out.append(f"<p>{'<b>' if rng.random() < 0.15 else ''}{s()}{'<br>' if rng.random() < 0.1 else ''}{'</p>' if rng.random() < 0.85 else ''}")
            elif kind < 0.74:
                out.append(f"<h2>{mark}{sentence(1, 8)}</h2><p>{s()}</p>")
            elif kind < 0.8:
                out.append("<ul>" + "".join(f"<li>{mark}{sentence(2, 14)}</li>" for _ in range(3)) + "</ul>")
            elif kind < 0.84:
                out.append(f"<blockquote><p>{s()}</p></blockquote>")
            elif kind < 0.87:
                out.append("<table>" + "".join(f"<tr><td>{mark}{sentence(1, 4)}</td><td>{mark}{sentence(1, 4)}</td></tr>" for _ in range(2)) + "</table>")
            elif kind < 0.9:
                out.append(f"<pre>{s()}</pre>")
            elif kind < 0.93:
                out.append(f"<div>{s()}</div>")
            else:
                out.append(side(str(rng.choice(["advert", "side", "share", "notice", "form"]))))
        if rng.random() < 0.25:
            out.append(side("comments"))
        return element(str(rng.choice(MAIN)), "".join(out))

    before = "".join(side(k) for k in rng.choice(["menu", "head", "notice", "advert", "form", "side"], rng.integers(0, 5)))
    after = "".join(side(k) for k in rng.choice(["comments", "side", "foot", "advert", "form", "share", "notice"], rng.integers(0, 6)))
    page = f"<html><head><title>{sentence(2, 9)}</title></head><body>{before}{article()}{after}</body></html>"
    blocks = blocks_of(page if rng.random() < 0.9 else page[: int(len(page) * 0.9)])
    labels = [b.text.startswith(mark) for b in blocks]
    for b in blocks:
        b.text = b.text.replace(mark, "") or "."
    return blocks, labels


def train(pages: DataFrame, id_column: str = "page_id", html: str = "html", p: LabellerParams = LabellerParams()) -> Labeller:
    """Fit the labeller on made-up pages and a bounded sample of the table's pages that have an article element."""
    chosen = hash_sample(pages.select(F.col(id_column).alias("id"), F.col(html).cast("string").alias("html")), [F.col("id"), F.xxhash64("html")], p.samples)
    marked = chosen.filter(F.contains(F.lower("html"), F.lit("<article")) & (F.length("html") < p.most_chars))
    sample = [blocks_of(r.html) for r in marked.select("html").collect()]
    sample = [b for b in sample if 0 < len(b) <= p.most_blocks]
    away = ("nav", "aside", "footer", "form", "header")

    def main(b: Block) -> bool:
        names = [x.split()[0] for x in b.path]
        return "article" in names and not any(n in away for n in names[names.index("article") :])

    words = sorted({w for blocks in sample for b in blocks for w in b.text.split()})[:5000] or ["lorem", "ipsum", "dolor", "sit", "amet", "word", "text", "line"]
    rng = np.random.default_rng(p.seed)
    made = [made_up(rng, words) for _ in range(p.layouts)]
    made = [(b, y) for b, y in made if b]
    features = Features()([b for b, _ in made] + sample)
    labels = [np.array(y, dtype=np.float32) for _, y in made] + [np.array([main(b) for b in blocks], dtype=np.float32) for blocks in sample]
    labeller = Labeller(p.hidden, p.seed)
    labeller.fit(features, labels, p)
    return labeller


def extract(pages: DataFrame, labeller: Labeller, html: str = "html") -> DataFrame:
    """`pages` without `html`, with `text` (main blocks joined by line feeds) and `n_chars`."""
    small_batches(pages.sparkSession)
    keep = others(pages, html, "text", "n_chars")
    source = pages.select(packed(keep), F.col(html).cast("string").alias("body"))
    schema = StructType([source.schema["rest"], StructField("text", StringType()), StructField("n_chars", LongType())])
    wanted = pa_schema(schema)
    shared = pages.sparkSession.sparkContext.broadcast(labeller)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            for part in text_slices(batch, "body", 1 << 20):
                blocks = [blocks_of(x) for x in part.column(1).to_pylist()]
                chosen = shared.value.main_blocks(features(blocks))
                texts = ["\n".join(b.text for b, yes in zip(bs, ys, strict=True) if yes) for bs, ys in zip(blocks, chosen, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(wanted.field(0).type),
                                                  pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=wanted)

    return source.mapInArrow(run, schema).select(*unpacked(keep), "text", "n_chars")
