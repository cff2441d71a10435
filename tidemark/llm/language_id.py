"""Language identification by a byte convolutional network.

A text is cut into windows of `WINDOW` bytes. Every byte becomes a short vector;
filters of several widths slide over the window, each keeps its greatest response,
and a softmax over these maxima gives the window's language. A text's language is
the one with the greatest mean log-probability over all its windows, weighted by
their length. Training (Adam on cross-entropy, plain numpy) uses a bounded,
deterministic sample of labelled texts, from the part of the ids that `fold` does
not hold out.

Windows go through the network in batches of fixed size, so memory does not
depend on the length of a text.

Defined cases: null text, or text without a letter, is `und` with score 0. Rows
whose language is null are not learned from. If there is nothing to learn from,
every text is `und`. Repeated rows give a row each. Other columns are ignored. An
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import textvec
from tidemark.llm.common import bounded_sample, fold

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 12
DIM = 6
#: Bound of the training sample: SALTS * PER_SALT rows a language, and TRAIN_WINDOWS windows a row.
SALTS, PER_SALT = 64, 6
TRAIN_WINDOWS = 4
BATCH = 512


@dataclass
class Net:
    """Weights; `tables[k][j]` maps a byte at place j of a filter of width WIDTHS[k] to responses."""

    languages: list[str]
    embed: np.ndarray
    filters: list[np.ndarray]
    biases: list[np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray

    def maxima(self, codes: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """(greatest response of each filter, its place), for windows of bytes (n, length); 0 pads."""
        x = self.embed[codes]
        flat, n, length = x.reshape(len(codes), -1), *codes.shape
        tops, places = [], []
        for width, w, b in zip(WIDTHS, self.filters, self.biases, strict=True):
            view = np.lib.stride_tricks.as_strided(flat, (n, length - width + 1, width * DIM), (flat.strides[0], DIM * flat.strides[1], flat.strides[1]))
            response = view @ w
            place = response.argmax(axis=1)
            tops.append(np.take_along_axis(response, place[:, None, :], 1)[:, 0] + b)
            places.append(place)
        return np.maximum(np.concatenate(tops, axis=1), 0), places

    def log_probabilities(self, codes: np.ndarray) -> np.ndarray:
        """As `maxima`, without the places and with less memory traffic."""
        x = self.embed[codes]
        n, length = codes.shape
        flat = x.reshape(n * length, DIM)
        tops = []
        for width, w, b in zip(WIDTHS, self.filters, self.biases, strict=True):
            response = flat @ w.reshape(width, DIM, FILTERS)[0]
            response = response.reshape(n, length, FILTERS)[:, : length - width + 1].copy()
            for j in range(1, width):
                response += (flat @ w.reshape(width, DIM, FILTERS)[j]).reshape(n, length, FILTERS)[:, j : length - width + 1 + j]
            tops.append(response.max(axis=1) + b)
        z = np.maximum(np.concatenate(tops, axis=1), 0) @ self.out + self.out_bias
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def window_batches(data: np.ndarray, at: np.ndarray, batch: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(codes, rows, sizes): all bytes of all rows as windows of WINDOW codes, `batch` at a time; a code is the byte + 1, 0 pads."""
    counts = -(-np.diff(at) // WINDOW)
    rows = np.repeat(np.arange(len(counts)), counts)
    start = at[:-1][rows] + WINDOW * (np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts))
    sizes = np.minimum(WINDOW, at[1:][rows] - start)
    padded = np.concatenate([data, np.zeros(WINDOW, np.uint8)])
    for k in range(0, max(1, len(rows)), batch):
        codes = padded[start[k : k + batch, None] + np.arange(WINDOW)].astype(np.int16) + 1
        codes[np.arange(WINDOW) >= sizes[k : k + batch, None]] = 0
        yield codes, rows[k : k + batch], sizes[k : k + batch]


def windows_of(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows at once, for few texts."""
    return next(window_batches(data, at, len(data) + 1))


def train(texts: list[str], labels: list[str], epochs: int = 8, seed: int = 5) -> Net:
    languages = sorted(set(labels))
    data, at = textvec.column_bytes(pa.array(texts, pa.large_string()))
    codes, rows, _ = windows_of(data, at)
    first = np.searchsorted(rows, rows)
    use = np.arange(len(rows)) - first < TRAIN_WINDOWS
    codes, y = codes[use], np.array([languages.index(x) for x in labels])[rows[use]]
    rng = np.random.default_rng(seed)
    total = FILTERS * len(WIDTHS)
    net = Net(languages, rng.normal(0, 0.5, (257, DIM)).astype(np.float32), [rng.normal(0, (w * DIM) ** -0.5, (w * DIM, FILTERS)).astype(np.float32) for w in WIDTHS], [np.zeros(FILTERS, np.float32) for _ in WIDTHS], rng.normal(0, total**-0.5, (total, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32))
    weights = [net.embed, *net.filters, *net.biases, net.out, net.out_bias]
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in weights]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(codes))
        for k in range(0, len(order), 64):
            own = order[k : k + 64]
            c, n = codes[own], len(own)
            # Short pieces are as common in use as whole windows: mask the end of some.
            short = rng.random(n) < 0.3
            c = np.where(short[:, None] & (np.arange(WINDOW) >= rng.integers(16, WINDOW, n)[:, None]), 0, c)
            top, places = net.maxima(c)
            z = top @ net.out + net.out_bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(n), y[own]] -= 1
            p /= n
            grads = {"out": top.T @ p, "bias": p.sum(axis=0)}
            back = (p @ net.out.T) * (top > 0)
            g_embed, g_filters, g_biases = np.zeros_like(net.embed), [], []
            for j, (width, w, place) in enumerate(zip(WIDTHS, net.filters, places, strict=True)):
                own_back = back[:, j * FILTERS : (j + 1) * FILTERS]
                seen = c[np.arange(n)[:, None, None], place[:, :, None] + np.arange(width)]
                x = net.embed[seen].reshape(n, FILTERS, width * DIM)
                g_filters.append(np.einsum("nfd,nf->df", x, own_back))
                g_biases.append(own_back.sum(axis=0))
                np.add.at(g_embed, seen, (own_back[:, :, None] * w.T[None]).reshape(n, FILTERS, width, DIM))
            step += 1
            for w, g, (m, v) in zip(weights, [g_embed, *g_filters, *g_biases, grads["out"], grads["bias"]], moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def sampled_windows(text: Column) -> Column:
    """TRAIN_WINDOWS windows of a text, joined, chosen and ordered by a hash over all its windows; all of a shorter text."""
    starts = F.sequence(F.lit(0), F.ceil(F.length(text) / WINDOW).cast("int") - 1)
    order = F.array_sort(F.transform(starts, lambda i: F.struct(F.xxhash64(text, i).alias("h"), i.alias("i"))))
    parts = F.transform(F.slice(order, 1, TRAIN_WINDOWS), lambda e: F.substr(text, e["i"] * WINDOW + 1, F.lit(WINDOW)))
    return F.when(F.length(text) > WINDOW * TRAIN_WINDOWS, F.array_join(parts, "")).otherwise(text)


def fit(docs: DataFrame, salts: int = SALTS, per_salt: int = PER_SALT) -> Net | None:
    """A network from a bounded sample of labelled texts that `fold` does not hold out."""
    ids = bounded_sample(docs.where(fold() != 0), "lang", "doc_id", salts, per_salt)
    if not ids:
        return None
    wanted = docs.where(F.col("doc_id").isin([i for _, i in ids])).where("lang is not null")
    got = wanted.select("doc_id", "lang", sampled_windows(F.coalesce("text", F.lit(""))).alias("text")).collect()
    got = sorted({(r.lang, r.doc_id, r.text) for r in got})
    return train([r[2] for r in got], [r[0] for r in got])


def identify(docs: DataFrame, net: Net | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; only the text is looked at."""

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, at in textvec.slices(batch, "text", 1 << 20):
                n = part.num_rows
                total = np.zeros((n, len(net.languages))) if net else np.zeros((n, 1))
                weight = np.zeros(n)
                if net and len(data):
                    for codes, rows, sizes in window_batches(data, at, BATCH):
                        np.add.at(total, rows, net.log_probabilities(codes) * sizes[:, None])
                        np.add.at(weight, rows, sizes)
                p = np.exp(total / np.maximum(weight, 1)[:, None])
                p /= p.sum(axis=1, keepdims=True)
                known = part.column(2).to_numpy(zero_copy_only=False).astype(bool) & (net is not None)
                names = np.array(net.languages if net else ["und"], dtype=object)[p.argmax(axis=1)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.where(known, names, "und").tolist(), pa.string()), pa.array(np.where(known, p.max(axis=1), 0.0))],
                    names=["doc_id", "lang_pred", "score"],
                )

    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), letters.alias("letters")).mapInArrow(predict, "doc_id long, lang_pred string, score double")
    return found.select("doc_id", (fold() == 0).alias("held_out"), "lang_pred", "score")
