"""Main text of web pages by a recurrent block labeller.

A page becomes the sequence of its leaf blocks (runs of text between
block-level tags).  A block is described by hashed tag-path features (which tags,
classes and ids are open, however often), a hashed bag of its words and a few
counts.  A bidirectional LSTM in numpy reads the whole sequence and labels every
block as main text or not.  It is trained here, on page layouts put together
from common markup around texts of a bounded sample of the real pages.
"""

from __future__ import annotations

import html as html_lib
import re
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_sample

PATH_DIM, WORD_DIM, COUNT_DIM, HIDDEN = 512, 32, 7, 24
SAMPLE_PAGES = 100
SAMPLE_BLOCKS = 200
SAMPLE_CHARS = 4000
TRAIN_PAGES = 2000
EPOCHS = 12
SEED = 17

#: Parts of a page's sequence that are worked on at once.
SEQUENCE_PART = 2048

#: Fixed values of HTML: contents that are no markup and are not shown; that are no markup but text; that are not shown.
RAW = ("script", "style", "noscript", "iframe", "xmp", "noframes")
PLAIN_TEXT = ("textarea", "title")
UNSEEN = frozenset(("template", "datalist"))
FOREIGN = frozenset(("svg", "math"))
FOREIGN_NOTES = frozenset(("title", "desc", "metadata", "annotation", "annotation-xml"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
#: An opening tag of the first kind closes an open element of the second.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
BLOCKS_END_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split()
)

#: One pass: a tag, comment or declaration that does not end reaches to the end of the page.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>=]|=\s*+(?:\"[^\"]*\"|'[^']*')?+)*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)|(?P<text>[^<]++|<)",
    re.S | re.I,
)
_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*+(?:>|\Z)|</{t}\Z", re.I) for t in (*RAW, *PLAIN_TEXT)}
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_NAME = re.compile(r"[a-z]+")
_SPACE = re.compile(r"[ \t\n\x0b\x0c\r]+")


@lru_cache(100_000)
def _bucket(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "replace")) % PATH_DIM


def leaf_blocks(page: str) -> list[tuple[tuple[int, ...], str, int]]:
    """(tag path, text, characters inside links) of every block with text, in page order.

    The path is the hash buckets of the names of all open elements, each once,
    and that of the innermost name as a leaf: how deep a block lies, and how
    many elements of one name are around it, changes nothing.  A raw element
    ends at its own end tag only, or with the page.  Drawings and formulas are
    part of the line they stand in; their notes (title, desc, annotation) are
    not shown.  A tag that the page breaks off is markup.
    """
    stack: list[tuple[str, tuple[int, ...], int]] = []
    depth: Counter = Counter()
    around: Counter = Counter()  # how many open elements have each bucket; never more than PATH_DIM entries
    leaves: list[int] = []
    here: tuple[int, ...] | None = ()
    blocks, parts, linked, path = [], [], 0, ()
    hidden = foreign = 0

    def flush():
        nonlocal linked
        if parts:
            text = _SPACE.sub(" ", "".join(parts)).strip(" ")
            if text:
                blocks.append((path, text, linked))
            parts.clear()
        linked = 0

    def place() -> tuple[int, ...]:
        nonlocal here
        if here is None:
            here = (*sorted(around), *leaves[-1:])
        return here

    def enter(tag: str, names: list[str]):
        nonlocal here
        own, leaf = (), -1
        if tag not in INLINE:
            own, leaf = tuple(map(_bucket, names)), _bucket("leaf " + names[-1])
            leaves.append(leaf)
            around.update(own)
            here = None
        stack.append((tag, own, leaf))

    def leave(own: tuple[int, ...], leaf: int):
        nonlocal here
        if leaf >= 0:
            leaves.pop()
            here = None
            for b in own:
                around[b] -= 1
                if not around[b]:
                    del around[b]

    def add(text: str):
        nonlocal path, linked
        if hidden:
            return
        if "&" in text:
            text = html_lib.unescape(text)
        if not parts:
            path = place()
        parts.append(text)
        if depth["a"]:
            linked += len(text)

    def close(i: int):
        nonlocal hidden, foreign
        for tag, own, leaf in reversed(stack[i:]):
            leave(own, leaf)
            depth[tag] -= 1
            hidden -= tag in UNSEEN or tag.startswith("note ")
            foreign -= tag in FOREIGN
        del stack[i:]

    at, size = 0, len(page)
    while at < size:
        m = _TOKEN.match(page, at)
        at = m.end()
        if m["text"] is not None:
            add(m["text"])
            continue
        if m["tag"] is None:
            continue
        tag = m["tag"].lower()
        if foreign and tag in FOREIGN_NOTES:
            tag = "note " + tag
        inline = tag in INLINE or tag in FOREIGN or "-" in tag or foreign > 0
        if tag in _END and not foreign and not m["close"]:
            end = _END[tag].search(page, at)
            if tag in RAW:
                at = end.end() if end else size
                continue
            if end:  # text without markup: a block of its own
                flush()
                enter(tag, [tag])
                add(page[at : end.start()])
                flush()
                leave(*stack.pop()[1:])
                at = end.end()
                continue
        if not inline:
            flush()
        elif tag == "br":
            add(" ")
        if m["close"]:
            if not depth[tag]:
                continue
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    close(i)
                    break
                if inline and not foreign and stack[i][0] not in INLINE:
                    break
        elif tag not in VOID and not (foreign and m["attrs"].endswith("/")):
            if not foreign:
                if tag in BLOCKS_END_P and depth["p"]:
                    for i in range(len(stack) - 1, -1, -1):
                        if stack[i][0] == "p":
                            close(i)
                            break
                        if stack[i][0] not in INLINE:
                            break
                for other in CLOSES.get(tag, ()):
                    for i in range(len(stack) - 1, -1, -1) if depth[other] else ():
                        if stack[i][0] == other:
                            close(i)
                            break
                        if stack[i][0] in ("ul", "ol", "table", "dl", "select"):
                            break
            own = [tag]
            if m["attrs"]:
                for a in _ATTR.finditer(m["attrs"]):
                    own += ["." + x for x in _NAME.findall((a[2] or a[3] or a[4] or "").lower())]
            if tag in FOREIGN and m["attrs"].endswith("/"):
                continue
            enter(tag, own)
            depth[tag] += 1
            hidden += tag in UNSEEN or tag.startswith("note ")
            foreign += tag in FOREIGN
    flush()
    return blocks


def _path_vector(path: tuple[int, ...]) -> np.ndarray:
    out = np.zeros(PATH_DIM, np.float32)
    out[list(path)] = 1
    return out


def _other_vector(text: str, linked: int, place: float) -> np.ndarray:
    words = text.split()
    bag = np.bincount([zlib.crc32(w.encode("utf-8", "replace")) % WORD_DIM for w in words] or [0], minlength=WORD_DIM) / max(len(words), 1)
    n = max(len(text), 1)
    stops = sum(map(text.count, ".!?,;"))
    return np.concatenate([bag, [np.log1p(len(words)) / 5, linked / n, stops / (len(words) + 1), min(n / (len(words) + 1), 20) / 10, place, float("©" in text), float(len(words) < 4)]]).astype(np.float32)


class BlockLabeller:
    """Bidirectional LSTM over (path, other) block vectors; one logit per block."""

    def __init__(self, weights: dict[str, np.ndarray] | None = None, seed: int = SEED):
        rng = np.random.default_rng(seed)
        dim = PATH_DIM + WORD_DIM + COUNT_DIM
        if weights is None:
            weights = {"o": rng.normal(0, 0.2, (2 * HIDDEN, 1)), "ob": np.zeros(1)}
            for d in "fb":
                weights |= {f"x{d}": rng.normal(0, 0.08, (dim, 4 * HIDDEN)), f"h{d}": rng.normal(0, 0.2, (HIDDEN, 4 * HIDDEN)), f"z{d}": np.repeat([0.0, 1.0, 0.0, 0.0], HIDDEN)}
            weights = {k: v.astype(np.float32) for k, v in weights.items()}
        self.w = weights
        self.paths: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}

    @staticmethod
    def _run(z: np.ndarray, wh: np.ndarray, keep: list | None = None, state: list | None = None) -> np.ndarray:
        """The hidden states; ``state`` (h, c) is started from and left behind."""
        steps, batch, _ = z.shape
        h, c = state or (np.zeros((batch, HIDDEN), np.float32), np.zeros((batch, HIDDEN), np.float32))
        out = np.empty((steps, batch, HIDDEN), np.float32)
        for t in range(steps):
            a = z[t] + h @ wh
            s = 1 / (1 + np.exp(-np.clip(a, -30, 30)))
            i, f, o = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 3 * HIDDEN :]
            g = np.tanh(a[:, 2 * HIDDEN : 3 * HIDDEN])
            if keep is not None:
                keep.append((h, c, i, f, g, o))
            c = f * c + i * g
            h = o * np.tanh(c)
            if keep is not None:
                keep[-1] += (c,)
            out[t] = h
        if state is not None:
            state[:] = h, c
        return out

    @staticmethod
    def _flip(lengths: np.ndarray, steps: int) -> np.ndarray:
        """Row indices that turn each sequence round within its length."""
        t = np.arange(steps)[:, None]
        return np.where(t < lengths, lengths - 1 - t, t)

    def _inputs(self, blocks, lo: int, hi: int, n: int, d: str) -> np.ndarray:
        """What the blocks lo..hi of a page of n feed into the gates of direction ``d``."""
        z = np.empty((hi - lo, 4 * HIDDEN), np.float32)
        rest = np.empty((hi - lo, WORD_DIM + COUNT_DIM), np.float32)
        for t, (path, text, linked) in enumerate(blocks[lo:hi]):
            if path not in self.paths:
                if len(self.paths) > 20_000:
                    self.paths.clear()
                v = _path_vector(path)
                self.paths[path] = {e: v @ self.w[f"x{e}"][:PATH_DIM] for e in "fb"}
            z[t] = self.paths[path][d]
            rest[t] = _other_vector(text, linked, (lo + t) / n)
        return z + rest @ self.w[f"x{d}"][PATH_DIM:] + self.w[f"z{d}"]

    def _long(self, blocks) -> np.ndarray:
        """Logits of one page, a part of its sequence at a time in each direction."""
        n = len(blocks)
        half = self.w["o"][:HIDDEN, 0], self.w["o"][HIDDEN:, 0]
        out = np.full(n, self.w["ob"][0], np.float32)
        cuts = [(lo, min(lo + SEQUENCE_PART, n)) for lo in range(0, n, SEQUENCE_PART)]
        for d, parts, o in (("f", cuts, half[0]), ("b", cuts[::-1], half[1])):
            state = [np.zeros((1, HIDDEN), np.float32), np.zeros((1, HIDDEN), np.float32)]
            for lo, hi in parts:
                z = self._inputs(blocks, lo, hi, n, d)[:, None]
                h = self._run(z if d == "f" else z[::-1], self.w[f"h{d}"], state=state)[:, 0] @ o
                out[lo:hi] += h if d == "f" else h[::-1]
        return out

    def logits(self, pages: list[list[tuple[tuple[str, ...], str, int]]]) -> list[np.ndarray]:
        """One array of logits per page of leaf blocks."""
        out: list[np.ndarray] = [np.zeros(0, np.float32)] * len(pages)
        order = sorted((i for i in range(len(pages)) if pages[i]), key=lambda i: len(pages[i]))
        while order:
            longest = len(pages[order[0]])
            if longest > SEQUENCE_PART:
                for i in order:
                    out[i] = self._long(pages[i])
                break
            n = 1
            while n < min(64, len(order)) and len(pages[order[n]]) <= min(longest * 1.3 + 4, SEQUENCE_PART):
                n += 1
            group, order = order[:n], order[n:]
            lengths = np.array([len(pages[i]) for i in group])
            z = {d: np.zeros((lengths.max(), n, 4 * HIDDEN), np.float32) for d in "fb"}
            for j, i in enumerate(group):
                for d in "fb":
                    z[d][: lengths[j], j] = self._inputs(pages[i], 0, lengths[j], lengths[j], d)
            flip, col = self._flip(lengths, lengths.max()), np.arange(n)
            h = np.concatenate([self._run(z["f"], self.w["hf"]), self._run(z["b"][flip, col], self.w["hb"])[flip, col]], axis=2)
            y = (h @ self.w["o"])[:, :, 0] + self.w["ob"]
            for j, i in enumerate(group):
                out[i] = y[: lengths[j], j]
        return out

    def text(self, blocks, logits: np.ndarray) -> str:
        return "\n".join(b[1] for b, y in zip(blocks, logits, strict=True) if y > 0)

    def train(self, pages, labels, epochs: int = EPOCHS, batch: int = 32, rate: float = 1.2e-2, seed: int = SEED) -> None:
        """Adam on the mean cross-entropy of all blocks, with steps that shrink to none."""
        rng = np.random.default_rng(seed)
        data = []
        for blocks, y in zip(pages, labels, strict=True):
            x = np.stack([np.concatenate([_path_vector(p), _other_vector(t, k, i / len(blocks))]) for i, (p, t, k) in enumerate(blocks)])
            data.append((x, np.asarray(y, np.float32)))
        data.sort(key=lambda d: len(d[0]))
        groups = [data[i : i + batch] for i in range(0, len(data), batch)]
        m, v = ({k: np.zeros_like(a) for k, a in self.w.items()} for _ in range(2))
        step, last = 0, epochs * len(groups)
        for _ in range(epochs):
            for g in rng.permutation(len(groups)):
                grads, step = self._gradients(groups[g]), step + 1
                norm = np.sqrt(sum(float((a * a).sum()) for a in grads.values()))
                for k, a in grads.items():
                    a = a * min(1.0, 5.0 / (norm + 1e-9))
                    m[k] = 0.9 * m[k] + 0.1 * a
                    v[k] = 0.999 * v[k] + 0.001 * a * a
                    self.w[k] -= (rate * (1 - (step - 1) / last) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        self.paths.clear()

    def _gradients(self, group) -> dict[str, np.ndarray]:
        lengths = np.array([len(x) for x, _ in group])
        steps, n = lengths.max(), len(group)
        x = np.zeros((steps, n, PATH_DIM + WORD_DIM + COUNT_DIM), np.float32)
        y, mask = np.zeros((steps, n), np.float32), np.zeros((steps, n), np.float32)
        for j, (xs, ys) in enumerate(group):
            x[: len(xs), j], y[: len(xs), j], mask[: len(xs), j] = xs, ys, 1
        flip, col = self._flip(lengths, steps), np.arange(n)
        runs = {}
        for d in "fb":
            xd = x if d == "f" else x[flip, col]
            keep: list = []
            h = self._run(xd @ self.w[f"x{d}"] + self.w[f"z{d}"], self.w[f"h{d}"], keep)
            runs[d] = xd, keep, h
        h = np.concatenate([runs["f"][2], runs["b"][2][flip, col]], axis=2)
        logit = (h @ self.w["o"])[:, :, 0] + self.w["ob"]
        err = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y) * mask / mask.sum()
        grads = {"o": np.einsum("tbh,tb->h", h, err)[:, None], "ob": np.array([err.sum()], np.float32)}
        dh_all = err[:, :, None] * self.w["o"][:, 0]
        for d, part in (("f", dh_all[:, :, :HIDDEN]), ("b", dh_all[:, :, HIDDEN:][flip, col])):
            xd, keep, _ = runs[d]
            wh = self.w[f"h{d}"]
            dz = np.empty((steps, n, 4 * HIDDEN), np.float32)
            gh = np.zeros_like(wh)
            dh, dc = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
            for t in range(steps - 1, -1, -1):
                h0, c0, i, f, g, o, c = keep[t]
                tc = np.tanh(c)
                dh = dh + part[t]
                dc = dc + dh * o * (1 - tc * tc)
                dz[t] = np.concatenate([dc * g * i * (1 - i), dc * c0 * f * (1 - f), dc * i * (1 - g * g), dh * tc * o * (1 - o)], axis=1)
                gh += h0.T @ dz[t]
                dh, dc = dz[t] @ wh.T, dc * f
            flat = dz.reshape(-1, 4 * HIDDEN)
            grads |= {f"x{d}": xd.reshape(len(flat), -1).T @ flat, f"h{d}": gh, f"z{d}": flat.sum(0)}
        return grads


# --------------------------------------------------------------------------
# Training layouts
# --------------------------------------------------------------------------

#: Common markup of main text and of what surrounds it.
MAIN = ("article", "main", "div.content", "div.article-body", "div.post-content", "div.entry-content", "div.story", "div.main-text", "section.article", "div#content", "div.post", "article.post", "div.body-text")
AROUND = {
    "nav": ("nav", "div.menu", "div.nav", "ul.navigation", "div.navbar", "div.breadcrumb", "div.breadcrumbs", "ul.menu", "div#menu", "div.pagination", "nav.toc"),
    "header": ("header", "div.header", "div#header", "div.masthead", "div.top-bar", "div.site-title", "header.site-header"),
    "footer": ("footer", "div.footer", "div#footer", "div.copyright", "footer.site-footer", "div.legal"),
    "aside": ("aside", "div.sidebar", "div#sidebar", "div.related", "div.widget", "aside.sidebar", "div.recommended", "div.popular", "div.trending", "div.author-box"),
    "ad": ("div.ad", "div.ads", "div.advert", "div.advertisement", "div.banner", "div.sponsored", "div.promo", "div.ad-box", "div.ad-slot", "section.promotion"),
    "notice": ("div.notice", "div.cookie-notice", "div.cookie-banner", "div.consent", "div.gdpr", "div.alert", "div.newsletter", "div.subscribe", "div.popup", "div.modal", "div.paywall", "div.disclaimer"),
    "form": ("form", "form.search", "form.login", "form.signup", "div.search"),
    "comments": ("div.comments", "section.comments", "div#comments", "ul.comment-list", "div.comment", "div.reader-comments", "div.discussion", "div.replies", "section#disqus", "ol.commentlist"),
    "share": ("div.share", "div.social", "ul.share-buttons", "div.tags"),
    "reply": ("div#respond", "div.respond", "div.comment-respond", "div.comment-form", "form.comment-form", "form#commentform", "div.leave-reply", "div#reply", "section.add-comment"),
}


def _open(spec: str) -> tuple[str, str]:
    tag, mark, name = re.fullmatch(r"(\w+)([.#]?)(.*)", spec).groups()
    return f"<{tag}{f' class={chr(34)}{name}{chr(34)}' if mark == '.' else f' id={chr(34)}{name}{chr(34)}' if mark else ''}>", f"</{tag}>"


def layouts(texts: list[str], n: int, seed: int = SEED) -> list[tuple[str, list[int]]]:
    """n pages of markup around ``texts``, each with the labels of its leaf blocks."""
    rng = np.random.default_rng(seed)
    words = [w for t in texts for w in t.split()] or ["text"]
    texts = [t for t in texts if t.strip()] or ["text"]
    pick = lambda xs: xs[int(rng.integers(len(xs)))]

    def some(lo: int, hi: int) -> str:
        at = int(rng.integers(max(1, len(words) - hi)))
        gap = " " if rng.random() < 0.95 else pick((" | ", " - ", ", "))
        return html_lib.escape(gap.join(words[at : at + int(rng.integers(lo, hi + 1))])) or "text"

    def wrapped(parts: list[tuple[str, int | None]]) -> list[tuple[str, int | None]]:
        """The parts within some bare elements, often none."""
        u = rng.random()
        depth = 0 if u < 0.45 else int(rng.integers(1, 4)) if u < 0.8 else int(rng.integers(4, 10))
        tags = [pick(("div", "div", "div", "section", "center")) for _ in range(depth)]
        return [(f"<{t}>", None) for t in tags] + parts + [(f"</{t}>", None) for t in tags[::-1]]

    def links(tag: str) -> list[tuple[str, int | None]]:
        """Links side by side in one block."""
        gap = pick(("", " ", " | ", " &middot; "))
        return [(f"<{tag}>", None), (gap.join(f'<a href="/x">{some(1, 3)}</a>' for _ in range(int(rng.integers(1, 8)))), 0), (f"</{tag}>", None)]

    def around(kind: str) -> list[tuple[str, int | None]]:
        if kind == "nav" and rng.random() < 0.25:
            return wrapped(links(pick(("div", "p", "nav", "center"))))
        a, b = _open(pick(AROUND[kind]))
        inside = surroundings(kind)
        return wrapped([(a, None), *(wrapped(inside) if rng.random() < 0.4 else inside), (b, None)])

    def surroundings(kind: str) -> list[tuple[str, int | None]]:
        out: list[tuple[str, int | None]] = []
        if kind in ("nav", "share") or kind == "aside" and rng.random() < 0.5:
            if kind == "aside":
                out += [("<h3>", None), (some(1, 4), 0), ("</h3>", None)]
            out.append(("<ul>", None))
            for _ in range(int(rng.integers(2, 8))):
                out += [("<li>", None), (f'<a href="/x">{some(1, 5)}</a>', 0), ("</li>", None)]
            out.append(("</ul>", None))
        elif kind == "form":
            for _ in range(int(rng.integers(1, 4))):
                out += [("<p>", None), (f"<label>{some(1, 3)}</label><input>", 0), ("</p>", None)]
            out += [("<button>", None), (some(1, 2), 0), ("</button>", None)]
        elif kind == "reply":
            out += [("<p>" if rng.random() < 0.6 else "<h3>", None), (some(1, 14), 0), ("</p>", None)]
            for _ in range(int(rng.integers(0, 4))):
                out += [("<p>", None), (f"<label>{some(1, 3)}</label><input>", 0), ("</p>", None)]
            if rng.random() < 0.5:
                out += [("<button>", None), (some(1, 3), 0), ("</button>", None)]
        elif kind in ("footer", "header") and rng.random() < 0.7:
            out.append((("&copy; " if kind == "footer" else "") + some(1, 12), 0))
        elif rng.random() < 0.4:
            out.append((some(2, 30), 0))
        else:
            if rng.random() < 0.4:
                out += [("<h3>", None), (some(1, 5), 0), ("</h3>", None)]
            for _ in range(int(rng.integers(1, 6 if kind == "comments" else 3))):
                inner = pick((("<p>", "</p>"), ("<div>", "</div>"), ("<li>", "</li>"), ('<div class="comment">', "</div>"))) if kind == "comments" else ("<p>", "</p>")
                out += [(inner[0], None), (some(3, 60), 0), (inner[1], None)]
        return out

    def main(bare: str | None = None) -> list[tuple[str, int | None]]:
        a, b = (f"<{bare}>", f"</{bare}>") if bare else _open(pick(MAIN))
        title: list[tuple[str, int | None]] = []
        if rng.random() < 0.6:
            title = [("<h1>", None), (some(2, 14), 1), ("</h1>", None)]
            if rng.random() < 0.2:
                title = [("<header>", None), *title, ("</header>", None)]
        inside = body()
        if rng.random() < 0.5:
            return wrapped([(a, None), *wrapped([*title, *inside]), (b, None)])
        return wrapped([(a, None), *title, *wrapped(inside), (b, None)])

    def body() -> list[tuple[str, int | None]]:
        out: list[tuple[str, int | None]] = []
        for _ in range(int(rng.integers(1, 14 if rng.random() < 0.7 else 3))):
            u = rng.random()
            if u < 0.62:
                broken = rng.random() < 0.15
                out += [("<p><b>" if broken else "<p>", None), (html_lib.escape(pick(texts)) if rng.random() < 0.6 else some(1, 80), 1), ("<br>" if broken else "</p>", None)]
            elif u < 0.72:
                h = pick(("h2", "h3", "h4"))
                out += [(f"<{h}>", None), (some(1, 8), 1), (f"</{h}>", None)]
            elif u < 0.82:
                out.append(("<ul>", None))
                for _ in range(int(rng.integers(1, 6))):
                    out += [("<li>", None), (some(1, 25), 1), ("</li>", None)]
                out.append(("</ul>", None))
            elif u < 0.88:
                q = pick((("<blockquote>", "</blockquote>"), ("<pre>", "</pre>"), ("<blockquote><p>", "</p></blockquote>"), ("<figure><figcaption>", "</figcaption></figure>"), ("<div>", "</div>"), ("<section><p>", "</p></section>")))
                out += [(q[0], None), (some(2, 60), 1), (q[1], None)]
            elif u < 0.93:
                out.append(("<table>", None))
                for _ in range(int(rng.integers(1, 4))):
                    out += [("<tr><td>", None), (some(1, 6), 1), ("</td><td>", None), (some(1, 6), 1), ("</td></tr>", None)]
                out.append(("</table>", None))
            else:
                out += around(pick(("ad", "aside", "share", "notice", "form", "nav")))
        if rng.random() < 0.15:
            out += around("comments")
        if rng.random() < 0.1:
            out += around("reply")
        return out

    def columns() -> list[tuple[str, int | None]]:
        """A table that lays out the page: links in a cell, the text in another, perhaps links again."""
        side = [("<td>", None), *(links(pick(("div", "p", "li"))) if rng.random() < 0.5 else [links("td")[1]]), ("</td>", None)]
        parts = [("<table><tr>", None), *side, *main("td" if rng.random() < 0.7 else None)]
        if rng.random() < 0.3:
            parts += [("<td>", None), links("td")[1], ("</td>", None)]
        return [*parts, ("</tr></table>", None)]

    pages = []
    for _ in range(n):
        parts: list[tuple[str, int | None]] = [("<html><head><title>", None), (some(2, 12), 0), ("</title></head><body>", None)]
        wrap = rng.random() < 0.3
        parts += [('<div class="wrapper">', None)] * wrap
        for kind in ("notice", "header", "nav", "ad", "form", "aside", "share"):
            if rng.random() < {"nav": 0.7, "header": 0.5, "ad": 0.5}.get(kind, 0.25):
                parts += around(kind)
        u = rng.random()
        parts += columns() if u < 0.1 else main("div") if u < 0.16 else main()
        for kind in ("share", "comments", "reply", "aside", "ad", "nav", "form", "notice", "footer"):
            if rng.random() < {"comments": 0.45, "footer": 0.75, "reply": 0.15}.get(kind, 0.25):
                parts += around(kind)
        parts += [("</div>", None)] * wrap + [("</body></html>", None)]
        pages.append(("".join(p for p, _ in parts), [y for _, y in parts if y is not None]))
    return pages


def labelled_layouts(texts: list[str], n: int, seed: int = SEED) -> tuple[list, list]:
    """Leaf blocks and labels of n layouts.

    A text that is blank once decoded, or that itself looks like markup, makes a
    layout whose blocks are not those it was labelled by; such texts are left
    out first, so every layout counts.
    """
    fit = [t for t in texts if len(leaf_blocks(f"<p>{html_lib.escape(t)}</p>")) == 1]
    made = [(leaf_blocks(page), labels) for page, labels in layouts(fit, n, seed)]
    if any(len(b) != len(y) for b, y in made):
        raise ValueError("a layout's blocks do not match its labels")
    return [b for b, _ in made], [y for _, y in made]


def train_labeller(
    pages: DataFrame, sample: int = SAMPLE_PAGES, n: int = TRAIN_PAGES, blocks: int = SAMPLE_BLOCKS, chars: int = SAMPLE_CHARS, html_col: str = "html", id_col: str = "page_id"
) -> BlockLabeller:
    """Fit on ``n`` layouts filled with texts of at most ``sample`` pages, taken in hash order of their ids.

    ``blocks`` bounds how many blocks of a page lend their texts, ``chars`` how
    much of each: the driver gets no more than that.  Null and empty pages lend
    none; without any text (no rows), the layouts repeat a single word.
    """

    def lent(batches):
        for batch in batches:
            texts = [t[:chars] for page in batch.column(0).to_pylist() for _, t, _ in leaf_blocks(page)[:blocks]]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])

    rows = hash_sample(pages, id_col, sample, F.col(html_col)).mapInArrow(lent, "text string").collect()
    model = BlockLabeller()
    model.train(*labelled_layouts([r.text for r in rows], n))
    return model


def extract_text(pages: DataFrame, model: BlockLabeller, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every page, read whole.

    Blocks are joined by newlines; null, empty and text-free pages have empty
    text.  Repeated rows come back each; no rows give no rows.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model.w)

    def run(batches):
        local = BlockLabeller(shared.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                blocks = [leaf_blocks(h or "") for h in part.column(2).to_pylist()]
                texts = [local.text(b, y) for b, y in zip(blocks, local.logits(blocks), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [id_col, url_col, "text", "n_chars"])

    return pages.select(F.col(id_col).cast("long").alias(id_col), url_col, html_col).mapInArrow(run, f"{id_col} long, {url_col} string, text string, n_chars long")
