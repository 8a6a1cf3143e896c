"""Main text of web pages by a recurrent block labeller.

A page is cut into blocks (runs of text between block-level tags), each with the path of open tags
above it.  A bidirectional LSTM in numpy reads the sequence of blocks, each as a vector of hashed
path elements, hashed words and a few sizes, and labels every block with the whole page in view.
It is fitted here, on a bounded sample of the pages and on made-up pages of other layouts; the
label of a training block follows from the meaning of its tags (inside the article and not inside
navigation, advertisements, comments and the like).  Blocks labelled as main text are joined in
page order.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from math import log1p

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from intakeflow.llm.common import map_texts

TRAIN_PAGES = 200        # pages in the fitting sample ...
TRAIN_CHARS = 100_000    # ... each of at most so many characters
MADE_PAGES = 200         # made-up pages of other layouts
HIDDEN, PATHS, WORDS_DIM = 16, 96, 32
STEPS, BATCH = 80, 24
CELLS = 30_000           # blocks (with padding) read at once

# HTML element names by their role.
INLINE = frozenset("""a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt
ruby s samp small span strike strong sub sup time tt u var wbr object param math mi mn mo ms mtext mspace mrow mfrac
msqrt mroot mstyle merror mpadded mphantom mfenced menclose msub msup msubsup munder mover munderover mmultiscripts
mprescripts mtable mtr mtd semantics annotation annotation-xml""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "textarea", "title")        # skipped up to the end tag or the end of the page
OPAQUE = ("noscript", "template", "svg", "iframe")    # skipped up to their own end tag
SHAPES = frozenset("animate circle ellipse image line path polygon polyline rect stop use".split())  # without text
CLOSES_P = frozenset("""address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4
h5 h6 header hr main menu nav ol p pre section table ul""".split())
SAME = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"),
        "th": ("tr", "table"), "option": ("select",)}  # an element that ends an open one like it, up to its list
MAIN = frozenset(("article", "main"))
APART = frozenset("nav header footer aside form button select dialog menu".split())
APART_NAME = re.compile(r"""(?:^|[-_])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|notice|alert|menu|nav\w*
|sidebar|side|footer|header|comments?|replies|reply|share|social|related|newsletter|subscribe|breadcrumbs?|popup|modal
|widget|pagination|login|search)(?:$|[-_])""".replace("\n", ""), re.I)

_TAG = re.compile(r"""<(?:!--.*?(?:-->|\Z)|[!?][^>]*>|(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)/?>
|(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>)""".replace("\n", ""), re.S)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_END = {t: re.compile(rf"</{t}\b[^>]*>|\Z", re.I) for t in RAW}


class Block:
    """A run of text with the path of elements above it."""

    __slots__ = ("path", "parts", "linked", "text")

    def __init__(self, path: tuple[str, ...]):
        self.path, self.parts, self.linked, self.text = path, [], 0, ""


def opaque_ends(page: str, at: int) -> dict[int, int]:
    """Where the elements of ``OPAQUE`` end, by the starts of their start tags, from ``at`` on: at the end
    tag of equal depth.  Self-closing ones end with their tag; those without an end tag are not listed."""
    ends: dict[int, int] = {}
    open_: dict[str, list[int]] = {name: [] for name in OPAQUE}
    while (m := _TAG.search(page, at)) is not None:
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        closing, empty = m[1] or m[4], m[0].endswith("/>")
        if name in RAW:
            # inside svg only scripts are raw text
            if not closing and not (open_["svg"] and (empty or name != "script")):
                at = _END[name].search(page, at).end()
        elif name in open_:
            if closing:
                if open_[name]:
                    ends[open_[name].pop()] = at
            elif empty:
                ends[m.start()] = at
            else:
                open_[name].append(m.start())
    return ends


def blocks(page: str) -> list[Block]:
    """Blocks with text, in page order.  Tags that are never closed, closed twice or cut off are fine."""
    out: list[Block] = []
    stack: list[tuple[str, str]] = []      # (element, element with its names)
    now: Block | None = None
    links = 0
    ends: dict[int, int] | None = None     # of opaque elements, once there is one
    at, n = 0, len(page)

    def text(s: str) -> None:
        nonlocal now
        if now is None:
            if s.isspace():
                return
            now = Block(tuple(full for name, full in stack if name not in INLINE))
            out.append(now)
        now.parts.append(s)
        if links:
            now.linked += len(s)

    def close(upto: int) -> None:
        nonlocal links
        links -= sum(name == "a" for name, _ in stack[upto:])
        del stack[upto:]

    while at < n:
        m = _TAG.search(page, at)
        if m is None:
            text(page[at:])
            break
        if m.start() > at:
            text(page[at:m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if name == "br":
            text(" ")
            continue
        if name in INLINE:
            if m[1] or m[4]:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == name:
                        links -= name == "a"
                        del stack[i]
                        break
                    if stack[i][0] not in INLINE:
                        break
            elif name not in VOID:
                stack.append((name, name))
                links += name == "a"
            continue
        now = None
        if m[1] or m[4]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    close(i)
                    break
            continue
        if name in RAW:
            at = _END[name].search(page, at).end()
            continue
        if name in OPAQUE:
            if ends is None:
                ends = opaque_ends(page, m.start())
            at = ends.get(m.start(), at)
            continue
        if name in CLOSES_P:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p":
                    close(i)
                    break
                if stack[i][0] in ("table", "button", "td", "th"):
                    break
        if name in SAME:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    close(i)
                    break
                if stack[i][0] in SAME[name]:
                    break
        if name not in VOID and name not in SHAPES:
            names = " ".join(x for t in _NAMES.findall(m[3] or m[6] or "") for x in t if x)
            stack.append((name, f"{name} {names}".strip().lower()))
    kept = []
    for b in out:
        b.text = " ".join(entities.unescape("".join(b.parts)).split())
        if b.text:
            kept.append(b)
    return kept


def meant(path: tuple[str, ...]) -> bool | None:
    """Whether the path's elements mean main text; used for training labels only."""
    inside = False
    for full in path:
        name, *names = full.split()
        if name in MAIN:
            inside = True
        if name in APART or any(APART_NAME.search(x) for x in names):
            return False
    return inside


@lru_cache(1 << 14)
def _path_bits(path: tuple[str, ...]) -> np.ndarray:
    """Positions of a path's hashed elements; those of the innermost one count twice over."""
    on = {0}
    for depth, full in enumerate(reversed(path)):
        for part in full.split():
            on.add(1 + zlib.crc32(part.encode()) % (PATHS - 1))
            if depth == 0:
                on.add(1 + zlib.crc32(b"leaf" + part.encode()) % (PATHS - 1))
    return np.array(sorted(on))


def matrix(bs: list[Block]) -> np.ndarray:
    """One row per block: hashed path elements, hashed words at unit length, and a few sizes."""
    out = np.zeros((len(bs), PATHS + WORDS_DIM + 5), "f4")
    rest = []
    for i, b in enumerate(bs):
        out[i, _path_bits(b.path)] = 1
        words = b.text.lower().encode().split()
        out[i, PATHS:PATHS + WORDS_DIM] = np.bincount([zlib.crc32(w) % WORDS_DIM for w in words], minlength=WORDS_DIM)
        size = len(b.text)
        rest.append((log1p(size) / 5, min(1.0, b.linked / size), min(1.0, 10 * b.text.count(".") / size), i / len(bs),
                     log1p(len(words)) / 5))
    if bs:
        w = out[:, PATHS:PATHS + WORDS_DIM]
        w /= np.maximum(1.0, np.sqrt((w * w).sum(1)))[:, None]
        out[:, PATHS + WORDS_DIM:] = rest
    return out


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Labeller:
    """Bidirectional LSTM over the blocks of a page; small enough to broadcast."""

    def __init__(self, seed: int = 1):
        r = np.random.default_rng(seed)
        d, h = PATHS + WORDS_DIM + 5, HIDDEN
        self.w = {}
        for k in "fb":
            self.w[k + "x"] = r.normal(0, d ** -0.5, (d, 4 * h))
            self.w[k + "h"] = r.normal(0, h ** -0.5, (h, 4 * h))
            self.w[k + "b"] = np.concatenate([np.zeros(h), np.ones(h), np.zeros(2 * h)])
        self.w["o"], self.w["c"] = r.normal(0, 0.1, 2 * h), np.zeros(1)

    def _run(self, k: str, x: np.ndarray, mask: np.ndarray, keep: bool):
        """States [page, block, HIDDEN]; past a page's end the state stays as it is."""
        n, t, _ = x.shape
        h = c = np.zeros((n, HIDDEN))
        zx = x @ self.w[k + "x"] + self.w[k + "b"]
        out, trail = np.empty((n, t, HIDDEN)), []
        for j in range(t):
            z = zx[:, j] + h @ self.w[k + "h"]
            i, f, o = (_sigmoid(z[:, a * HIDDEN:(a + 1) * HIDDEN]) for a in range(3))
            g = np.tanh(z[:, 3 * HIDDEN:])
            c2 = f * c + i * g
            tc = np.tanh(c2)
            on = mask[:, j, None]
            if keep:
                trail.append((h, c, i, f, o, g, tc, on))
            h, c = np.where(on, o * tc, h), np.where(on, c2, c)
            out[:, j] = h
        return out, trail

    def _back(self, k: str, x: np.ndarray, trail, dout: np.ndarray, grad: dict) -> None:
        dh, dc = np.zeros((len(x), HIDDEN)), np.zeros((len(x), HIDDEN))
        wx = np.zeros((len(x), x.shape[1], 4 * HIDDEN))
        for j in range(x.shape[1] - 1, -1, -1):
            h, c, i, f, o, g, tc, on = trail[j]
            dh = dh + dout[:, j]
            a = np.where(on, dh, 0)
            d = np.where(on, dc, 0) + a * o * (1 - tc * tc)
            dz = np.concatenate([d * g * i * (1 - i), d * c * f * (1 - f), a * tc * o * (1 - o),
                                 d * i * (1 - g * g)], 1)
            wx[:, j] = dz
            grad[k + "h"] += h.T @ dz
            dh = np.where(on, dz @ self.w[k + "h"].T, dh)
            dc = np.where(on, d * f, dc)
        grad[k + "x"] += np.einsum("ntd,ntz->dz", x, wx)
        grad[k + "b"] += wx.sum((0, 1))

    @staticmethod
    def _turn(x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Every page's blocks in reverse order, padding still last."""
        at = np.arange(x.shape[1])
        to = np.where(at < sizes[:, None], sizes[:, None] - 1 - at, at)
        return np.take_along_axis(x, to[:, :, None], 1)

    def logits(self, x: np.ndarray, sizes: np.ndarray, keep: bool = False):
        mask = np.arange(x.shape[1]) < sizes[:, None]
        fwd, trail = self._run("f", x, mask, keep)
        turned = self._turn(x, sizes)
        bwd, trail2 = self._run("b", turned, mask, keep)
        both = np.concatenate([fwd, self._turn(bwd, sizes)], 2)
        return both @ self.w["o"] + self.w["c"][0], (mask, turned, both, trail, trail2)

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], seed: int = 2) -> None:
        r = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        v = {k: np.zeros_like(p) for k, p in self.w.items()}
        for step in range(1, STEPS + 1):
            some = [pages[i] for i in r.integers(0, len(pages), BATCH)]
            x, sizes = stack([a for a, _ in some])
            y = np.zeros(x.shape[:2])
            for i, (_, b) in enumerate(some):
                y[i, :len(b)] = b
            z, (mask, turned, both, trail, trail2) = self.logits(x, sizes, True)
            d = np.where(mask, _sigmoid(z) - y, 0) / mask.sum()
            grad = {k: np.zeros_like(p) for k, p in self.w.items()}
            grad["o"], grad["c"] = np.einsum("ntd,nt->d", both, d), np.array([d.sum()])
            dboth = d[:, :, None] * self.w["o"]
            self._back("f", x, trail, dboth[:, :, :HIDDEN], grad)
            self._back("b", turned, trail2, self._turn(dboth[:, :, HIDDEN:], sizes), grad)
            for k, g in grad.items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                self.w[k] -= 0.02 * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.99 ** step)) + 1e-8)

    def labels(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """True for the main blocks of every page; pages of like length are read together."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((i for i, p in enumerate(pages) if len(p)), key=lambda i: len(pages[i]))
        while order:
            some = [order.pop()]
            while order and (len(some) + 1) * len(pages[some[0]]) <= CELLS:
                some.append(order.pop())
            x, sizes = stack([pages[i] for i in some])
            z, _ = self.logits(x, sizes)
            for k, i in enumerate(some):
                out[i] = z[k, :sizes[k]] >= 0
        return out


def stack(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(r) for r in rows])
    x = np.zeros((len(rows), sizes.max(), rows[0].shape[1]))
    for i, r in enumerate(rows):
        x[i, :len(r)] = r
    return x, sizes


def made_up(n: int, seed: int = 4) -> list[str]:
    """Pages of varied layouts with random words, marked up so that ``meant`` knows their main text."""
    r = np.random.default_rng(seed)
    parts = "an be co de en fa ge ho in ka lo mi no or pe ra se ti un ve wa zo".split()

    def words(lo, hi):
        return " ".join("".join(r.choice(parts, r.integers(1, 4))) for _ in range(r.integers(lo, hi)))

    def wrap(tag, body, name=""):
        return f"<{tag}{f' class={chr(34)}{name}{chr(34)}' if name else ''}>{body}</{tag}>"

    def links(k):
        return wrap("ul", "".join(wrap("li", f'<a href="/x">{words(1, 3)}</a>') for _ in range(r.integers(2, k))))

    pages = []
    for _ in range(n):
        body = [wrap("h1", words(2, 9))] if r.random() < 0.8 else []
        for _ in range(r.integers(1, 9)):
            kind = r.random()
            body.append(wrap("h2", words(1, 6)) if kind < 0.15 else links(5).replace("/x", "/y") if kind < 0.2
                        else wrap("blockquote", words(4, 30)) if kind < 0.25 else wrap("p", words(3, 80) + "."))
            if r.random() < 0.15:
                body.append(wrap("div", words(2, 20), str(r.choice(["ad", "share", "notice", "related"]))))
            if r.random() < 0.08:
                body.append(wrap("aside", words(2, 20)))
        if r.random() < 0.25:
            body.append(wrap(str(r.choice(["section", "div"])), "".join(wrap("p", words(3, 30)) for _ in range(
                r.integers(1, 5))), str(r.choice(["comments", "comment-list", "replies"]))))
        main = wrap(str(r.choice(["article", "main"], p=[0.8, 0.2])), "".join(body))
        before = [wrap("nav", links(8))] if r.random() < 0.7 else []
        before += [wrap("header", wrap("p", words(1, 6)))] if r.random() < 0.4 else []
        before += [wrap("div", words(3, 20), str(r.choice(["cookie-notice", "ad", "banner", "menu"])))] if r.random() < 0.6 else []
        after = [wrap("aside", links(6), "sidebar")] if r.random() < 0.4 else []
        after += [wrap("form", wrap("label", words(1, 4)) + "<input>" + wrap("button", words(1, 2)))] if r.random() < 0.3 else []
        after += [wrap("div", "".join(wrap("p", words(3, 30)) for _ in range(r.integers(1, 4))), "comments")] if r.random() < 0.3 else []
        after += [wrap("footer", words(2, 20))] if r.random() < 0.8 else []
        pages.append("<html><body>" + "".join(before) + main + "".join(after) + "</body></html>")
    return pages


def fit(pages: DataFrame, column: str = "html", train_pages: int = TRAIN_PAGES,
        chars: int = TRAIN_CHARS) -> Labeller:
    """A labeller fitted on at most ``train_pages`` pages of at most ``chars`` characters, chosen by a
    hash, and on made-up pages; pages without any element that means main text are left out."""
    texts = pages.select(F.col(column).cast("string").alias("h")).where(F.length("h").between(1, chars))
    share = min(1.0, 3 * train_pages / max(1, pages.count()))
    texts = texts.where(F.pmod(F.xxhash64("h"), F.lit(1 << 30)) <= int(share * (1 << 30)))
    drawn = [r.h for r in texts.orderBy(F.xxhash64("h"), "h").limit(train_pages).collect()]
    rows = []
    for page in drawn + made_up(MADE_PAGES):
        bs = blocks(page)
        y = np.array([meant(b.path) for b in bs], float)
        if y.any():
            rows.append((matrix(bs), y))
    net = Labeller()
    net.fit(rows)
    return net


def main_texts(pages: list[str | None], net: Labeller) -> Iterator[str]:
    found = [blocks(p or "") for p in pages]
    for bs, on in zip(found, net.labels([matrix(b) for b in found])):
        yield " ".join(b.text for b, k in zip(bs, on) if k)


def extract(pages: DataFrame, net: Labeller) -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages``; null html and pages without main text
    have the empty text."""
    shared = pages.sparkSession.sparkContext.broadcast(net)

    def start():
        def run(texts):
            found = list(main_texts(texts, shared.value))
            return {"text": found, "n_chars": [len(t) for t in found]}
        return run

    return map_texts(pages.select("page_id", "url", "html"), start, {"text": "string", "n_chars": "long"}, "html")
