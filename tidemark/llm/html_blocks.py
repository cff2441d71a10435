"""Main text of web pages by a recurrent block labeller.

A page becomes the sequence of its text blocks in page order: the text between
block-level tags, with character references decoded and white space joined. Each
block is read as hashed vectors of its tag path (tags, classes, ids and roles of the
elements around it) and of its words, and a few densities. A bidirectional LSTM in
numpy reads the whole sequence, so what stands anywhere in the page can bear on each
block; a logistic output marks the blocks of the main text.

There is no table of labelled blocks, so training is by distant supervision: pages
that mark their article (article, main) label their own blocks, and a bounded sample
of them is also rewritten into other layouts (no semantic tags; side bars, notices,
forms, adverts, comments and link lists around and inside the article), which keep the
labels. So the labeller can't lean on one tag. Training draws `SALTS * PER_SALT` pages.

Defined cases: null or empty html gives an empty text. Scripts, styles, comments and
the like are no text, raw text (scripts, styles, titles) also if it is not closed. Without any page to learn from,
only the built-in layouts over made-up words are learned. Repeated rows give a row each.
Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_sample

PATH_DIM, WORD_DIM, DENSE = 48, 32, 6
INPUT = PATH_DIM + WORD_DIM + DENSE
HIDDEN = 20
SALTS, PER_SALT = 40, 4
EPOCHS = 6
#: Steps (blocks times pages) in one batch of sequences.
BATCH_STEPS = 8192

_TOKEN = re.compile(
    # Raw text runs to its end tag or the end of the page; the rest only goes where it is closed, and nothing goes after "/>".
    r"<!--.*?(?:-->|\Z)|<(script|style|textarea|iframe|title)(?=[\s/>])[^>]*>.*?(?:</\1\s*>|\Z)|<(noscript|template|select|svg)(?=[\s/>])[^>]*(?<!/)>.*?</\2\s*>|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>|<[!?/a-zA-Z][^>]*(?:>|\Z)|[^<]+|<",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br input button".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SPACE = re.compile(r"\s+")
#: Elements that an opening tag closes, if one of them is the innermost block.
_CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}


def blocks(page: str) -> list[tuple[tuple[str, ...], str, float]]:
    """(tag path, text, share of linked characters) of every block with text, in page order."""
    out: list[tuple[tuple[str, ...], str, float]] = []
    path: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    linked, in_link = 0, 0

    def end() -> None:
        nonlocal linked
        if parts:
            text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                out.append((tuple(x for _, names in path for x in names), text, min(1.0, linked / len(text))))
        parts.clear()
        linked = 0

    for m in _TOKEN.finditer(page):
        tag = m.group(4)
        if tag is None:
            token = m.group()
            if token[0] != "<" or token == "<":
                parts.append(token)
                linked += len(token) if in_link else 0
            continue
        tag = tag.lower()
        if tag in _INLINE:
            if tag == "a":
                in_link = 0 if m.group(3) else 1
            elif tag == "br":
                parts.append(" ")
            continue
        end()
        in_link = 0
        if m.group(3):
            for k in range(len(path) - 1, -1, -1):
                if path[k][0] == tag:
                    del path[k:]
                    break
            continue
        while path and path[-1][0] in _CLOSES.get(tag, {"p"}):
            path.pop()
        if tag not in _VOID and not m.group(5).rstrip().endswith("/"):
            names = [tag]
            for name, *values in _ATTRIBUTE.findall(m.group(5)):
                names += [f"{name.lower()}:{x}" for v in values for x in re.split(r"[\s_-]+", v.lower()) if x]
            path.append((tag, tuple(names)))
    end()
    return out


@lru_cache(maxsize=200_000)
def _slot(token: str, size: int) -> tuple[int, float]:
    h = zlib.crc32(token.encode("utf-8", "surrogatepass"))
    return h % size, 1.0 if (h >> 20) & 1 else -1.0


@lru_cache(maxsize=50_000)
def _path_vector(path: tuple[str, ...]) -> bytes:
    v = np.zeros(PATH_DIM, np.float32)
    for k, x in enumerate(path):
        slot, sign = _slot(x, PATH_DIM)
        v[slot] += sign
        if k + 1 == len(path):
            slot, sign = _slot("last:" + x, PATH_DIM)
            v[slot] += sign
    return v.tobytes()


def features(page: list[tuple[tuple[str, ...], str, float]]) -> np.ndarray:
    x = np.zeros((len(page), INPUT), np.float32)
    for i, (path, text, linked) in enumerate(page):
        x[i, :PATH_DIM] = np.frombuffer(_path_vector(path), np.float32)
        words = text.lower().split(" ")
        slots = [_slot(w, WORD_DIM) for w in words]
        x[i, PATH_DIM : PATH_DIM + WORD_DIM] = np.bincount([k for k, _ in slots], weights=[v for _, v in slots], minlength=WORD_DIM) / len(words) ** 0.5
        stops = text.count(".") + text.count(",") + text.count("!") + text.count("?")
        x[i, PATH_DIM + WORD_DIM :] = (np.log1p(len(words)) / 3, linked, min(1.0, stops / len(words)), len(text) / len(words) / 10, i / len(page), float(text[-1] in ".!?:;\"'"))
    return x


class Net:
    """A bidirectional LSTM with a logistic output for every step."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.w = [rng.normal(0, (INPUT + HIDDEN) ** -0.5, (INPUT + HIDDEN, 4 * HIDDEN)).astype(np.float32) for _ in range(2)]
        self.b = [np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)]).astype(np.float32) for _ in range(2)]
        self.out = rng.normal(0, 0.2, 2 * HIDDEN).astype(np.float32)
        self.bias = np.zeros(1, np.float32)

    def _run(self, x: np.ndarray, mask: np.ndarray, side: int, keep: bool) -> tuple[np.ndarray, list]:
        """x is (steps, pages, INPUT); a masked step leaves the state at zero, so padding may come first."""
        steps, pages, _ = x.shape
        w, b = self.w[side], self.b[side]
        fed = (x.reshape(-1, INPUT) @ w[:INPUT] + b).reshape(steps, pages, -1)
        h, c = np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32)
        hs, kept = np.zeros((steps, pages, HIDDEN), np.float32), []
        for t in range(steps) if side == 0 else range(steps - 1, -1, -1):
            z = fed[t] + h @ w[INPUT:]
            i, f, o = (1 / (1 + np.exp(-z[:, k * HIDDEN : (k + 1) * HIDDEN])) for k in range(3))
            g = np.tanh(z[:, 3 * HIDDEN :])
            before_h, before_c = h, c
            m = mask[t][:, None]
            c = (f * before_c + i * g) * m
            tc = np.tanh(c)
            h = o * tc * m
            hs[t] = h
            if keep:
                kept.append((t, i, f, o, g, tc, before_h, before_c, m))
        return hs, kept

    def logits(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        both = np.concatenate([self._run(x, mask, 0, False)[0], self._run(x, mask, 1, False)[0]], axis=2)
        return both @ self.out + self.bias

    def step(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        """Gradients of the mean cross-entropy, in the order of `weights`."""
        runs = [self._run(x, mask, side, True) for side in (0, 1)]
        both = np.concatenate([r[0] for r in runs], axis=2)
        error = (1 / (1 + np.exp(-(both @ self.out + self.bias))) - y) * mask / mask.sum()
        grads = [(both * error[:, :, None]).sum(axis=(0, 1)), error.sum(keepdims=True).reshape(1)]
        for side, (_, kept) in enumerate(runs):
            w = self.w[side]
            gw, gb = np.zeros_like(w), np.zeros_like(self.b[side])
            dh = np.zeros((x.shape[1], HIDDEN), np.float32)
            dc = np.zeros_like(dh)
            for t, i, f, o, g, tc, before_h, before_c, m in reversed(kept):
                d = (dh + error[t][:, None] * self.out[side * HIDDEN : (side + 1) * HIDDEN]) * m
                dcell = (dc + d * o * (1 - tc * tc)) * m
                dz = np.concatenate([dcell * g * i * (1 - i), dcell * before_c * f * (1 - f), d * tc * o * (1 - o), dcell * i * (1 - g * g)], axis=1)
                gw[:INPUT] += x[t].T @ dz
                gw[INPUT:] += before_h.T @ dz
                gb += dz.sum(axis=0)
                dh = dz @ w[INPUT:].T
                dc = dcell * f
            grads += [gw, gb]
        return grads

    def weights(self) -> list[np.ndarray]:
        return [self.out, self.bias, self.w[0], self.b[0], self.w[1], self.b[1]]


def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(len(p) for p in pages)
    x, mask = np.zeros((steps, len(pages), INPUT), np.float32), np.zeros((steps, len(pages)), np.float32)
    for k, p in enumerate(pages):
        x[: len(p), k], mask[: len(p), k] = p, 1
    return x, mask


def batches_of(pages: list[np.ndarray]) -> Iterator[list[int]]:
    """Pages of like length together, about BATCH_STEPS padded steps at once."""
    own: list[int] = []
    for k in sorted(range(len(pages)), key=lambda k: len(pages[k])):
        if not len(pages[k]):
            continue
        if own and (len(own) + 1) * len(pages[k]) > BATCH_STEPS:
            yield own
            own = []
        own.append(k)
    if own:
        yield own


def main_mask(net: Net, pages: list[list[tuple[tuple[str, ...], str, float]]]) -> list[np.ndarray]:
    """Which blocks of each page are main text: a block's own score and the mean score of its tag path decide together."""
    read = [features(p) for p in pages]
    out = [np.zeros(len(p), bool) for p in pages]
    for own in batches_of(read):
        x, mask = _padded([read[k] for k in own])
        z = net.logits(x, mask)
        for j, k in enumerate(own):
            paths: dict[tuple[str, ...], int] = {}
            which = np.array([paths.setdefault(p, len(paths)) for p, _, _ in pages[k]])
            score = np.clip(z[: len(which), j], -6, 6)
            out[k] = score + (np.bincount(which, weights=score) / np.bincount(which))[which] >= 0
    return out


_BOILER = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "role:navigation", "role:banner", "role:complementary", "class:comment", "class:comments", "id:comments", "class:ad", "class:sidebar"}


def _own_labels(page: list[tuple[tuple[str, ...], str, float]]) -> np.ndarray | None:
    """Labels that a page gives itself by article or main; None if it has neither."""
    inside = [("article" in p or "main" in p or "role:main" in p) for p, _, _ in page]
    if not any(inside):
        return None
    y = []
    for (path, _, _), own in zip(page, inside, strict=True):
        k = max((i for i, x in enumerate(path) if x in ("article", "main", "role:main")), default=-1)
        y.append(float(own and not any(x in _BOILER for x in path[k + 1 :])))
    return np.array(y, np.float32)


def _layout(article: list[str], other: list[str], rng: np.random.Generator) -> tuple[str, list[float]]:
    """A page around `article` in a random layout, and the labels of its blocks."""
    page: list[str] = []
    labels: list[float] = []

    def pick(*xs: str) -> str:
        return xs[int(rng.integers(len(xs)))]

    def some(low: int, high: int) -> str:
        words = pick(*other).split(" ")
        a = int(rng.integers(max(1, len(words))))
        return html.escape(" ".join(words[a : a + int(rng.integers(low, high + 1))]) or "x")

    def block(markup: str, count: int = 1) -> None:
        page.append(markup)
        labels.extend([0.0] * count)

    def links(wrap: str, name: str) -> None:
        n = int(rng.integers(2, 9))
        body = "".join(f"<li><a href='/{k}'>{some(1, 3)}</a></li>" for k in range(n))
        block(f"<{wrap}{name}><ul>{body}</ul></{wrap}>", n)

    def attribute(*names: str) -> str:
        return f' {pick("class", "id")}="{pick(*names)}"'

    def comments() -> None:
        page.append(f"<{pick('div', 'section', 'ul')}{attribute('comments', 'comment-list', 'user-comments', 'replies', 'discussion', 'responses')}>")
        if rng.random() < 0.5:
            block(f"<h3>{pick('Comments', 'Leave a reply', some(1, 2))}</h3>")
        for _ in range(int(rng.integers(1, 5))):
            block(f'<div class="{pick("comment", "reply", "comment-body", "comment-text")}"><p>{some(4, 40)}</p></div>')
        page.append("</div></section></ul>")

    if rng.random() < 0.8:
        links(pick("nav", "div", "header"), pick("", attribute("menu", "nav", "navbar", "main-menu", "top")))
    if rng.random() < 0.4:
        block(f"<{pick('header', 'div')}{attribute('header', 'masthead', 'banner', 'site-title')}><p>{some(1, 8)}</p></header></div>")
    if rng.random() < 0.4:
        block(f"<div{attribute('cookie-notice', 'notice', 'cookie-banner', 'consent', 'alert', 'popup')}><p>{some(4, 30)}</p></div>")
    if rng.random() < 0.6:
        block(f"<div{attribute('ad', 'ads', 'advert', 'sponsored', 'promo', 'banner-ad')}>{some(3, 25)}</div>")
    if rng.random() < 0.3:
        block(f"<aside{pick('', attribute('sidebar', 'widget', 'related'))}><p>{some(3, 40)}</p></aside>")
    wrap, name = [("article", ""), ("main", ""), ("div", attribute("content", "post", "article-body", "entry-content", "story", "main-content", "post-body")), ("section", attribute("content", "article", "text", "post")), ("div", ""), ("td", "")][int(rng.integers(6))]
    page.append(f"<{wrap}{name}>")
    for k, text in enumerate(article):
        page.append(f"<{pick('h1', 'h2')}>{html.escape(text)}</h1></h2>" if k == 0 else f"<{pick('p', 'p', 'p', 'p', 'div', 'blockquote', 'li', 'h2')}>{html.escape(text)}")
        page.append("" if rng.random() < 0.2 else "</p></div></blockquote></li></h2>" if wrap != "div" else "</p>")
        labels.append(1.0)
        if rng.random() < 0.06:
            block(f"<div{attribute('ad', 'advert', 'promo', 'newsletter', 'share', 'related')}>{some(2, 20)}</div>")
    if rng.random() < 0.2:
        comments()
    page.append(f"</{wrap}>")
    if rng.random() < 0.35:
        comments()
    if rng.random() < 0.3:
        block(f"<form><p>{some(2, 12)}</p></form>")
    if rng.random() < 0.4:
        links(pick("aside", "div", "section"), attribute("sidebar", "related", "more", "recommended", "widget"))
    if rng.random() < 0.8:
        block(f"<{pick('footer', 'div')}{pick('', attribute('footer', 'copyright', 'bottom', 'legal'))}>{pick('&copy; ', '')}{some(2, 20)}</footer></div>")
    return "<html><body>" + "".join(page) + "</body></html>", labels


def train(pages: list[str], epochs: int = EPOCHS, seed: int = 11) -> Net:
    rng = np.random.default_rng(seed)
    xs: list[np.ndarray] = []
    ys: list[np.ndarray] = []
    articles: list[list[str]] = []
    for page in pages:
        found = blocks(page)
        y = _own_labels(found)
        if y is None or not y.any():
            continue
        xs.append(features(found))
        ys.append(y)
        articles.append([t for (_, t, _), own in zip(found, y, strict=True) if own][:30])
    if not articles:
        made = ["".join(chr(97 + int(c)) for c in rng.integers(0, 26, int(n))) for n in rng.integers(2, 9, 500)]
        articles = [[" ".join(made[int(k)] for k in rng.integers(0, 500, int(n))) + "." for n in rng.integers(5, 60, 6)] for _ in range(40)]
    other = [t for a in articles for t in a]
    for k in range(2 * len(articles)):
        page, y = _layout(articles[k % len(articles)], other, rng)
        found = blocks(page)
        if len(found) == len(y):  # markup that joins or splits blocks has no labels
            xs.append(features(found))
            ys.append(np.array(y, np.float32))
    net = Net()
    weights = net.weights()
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in weights]
    count = 0
    groups = [own[k : k + 16] for own in batches_of(xs) for k in range(0, len(own), 16)]
    for epoch in range(epochs):
        for g in rng.permutation(len(groups)):
            own = groups[g]
            x, mask = _padded([xs[k] for k in own])
            y = np.zeros_like(mask)
            for j, k in enumerate(own):
                y[: len(ys[k]), j] = ys[k]
            count += 1
            rate = 0.01 * (1 - epoch / epochs) + 0.001
            for w, gr, (m, v) in zip(weights, net.step(x, mask, y), moments, strict=True):
                gr = np.clip(gr, -1, 1)
                m += 0.1 * (gr - m)
                v += 0.01 * (gr * gr - v)
                w -= rate * (m / (1 - 0.9**count)) / (np.sqrt(v / (1 - 0.99**count)) + 1e-8)
    return net


def fit(pages: DataFrame, salts: int = SALTS, per_salt: int = PER_SALT) -> Net:
    """A labeller from a bounded sample of pages, chosen by a hash of their ids."""
    from pyspark.sql import functions as F

    ids = bounded_sample(pages.select("page_id", F.lit(1).alias("all")), "all", "page_id", salts, per_salt)
    rows = pages.where(F.col("page_id").isin([i for _, i in ids])).select("page_id", "html").collect() if ids else []
    return train([h for _, h in sorted((r.page_id, r.html) for r in rows if r.html)])


def extract(pages: DataFrame, net: Net) -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 200):
                part = batch.slice(k, 200)
                found = [blocks(x) for x in part.column(2).to_pylist()]
                texts = []
                for page, keep in zip(found, main_mask(net, found), strict=True):
                    texts.append("\n".join(t for (_, t, _), own in zip(page, keep, strict=True) if own))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    got = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).mapInArrow(run, "page_id long, url string, text string")
    return got.withColumn("n_chars", F.length("text").cast("long"))
