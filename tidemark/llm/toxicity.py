"""Toxic passages by maximum-scoring segments.

A token's score is its log-odds of standing in a toxic text, with Dirichlet priors
that form a chain: the prior of a word is the posterior of its six-byte prefix, whose
prior is that of its five-byte prefix, and so on to the whole corpus. An unseen form
of a known stem so gets the stem's score. A drift is taken off every token, so that
clean text scores below zero on average; the linear-time scan of Ruzzo and Tompa then
finds all maximal segments of positive score in a document.

Under the clean model the best segment of n words follows an extreme-value law with
parameter lambda, the root of E[exp(lambda * s)] = 1. A segment of score S has
E = n * exp(-lambda * S) expected rivals; a document's evidence is -log E of its best
segment and the sum of lambda * S over all its segments. A logistic curve, fitted on a
part of the sample that the token scores have not seen, turns the evidence into the
score. Fitting uses a bounded sample of labelled rows (`SALTS * PER_SALT` a class).

Defined cases: null and empty texts have no segment and get the score of no evidence.
Labels that are null, or whose document is missing, are not learned from; a document
with several labels counts as toxic if one of them is. Without labels of both classes
every score is 0. Repeated rows give a row each. Other columns, among them lang and
source, are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import textvec
from tidemark.llm.common import bounded_sample, fold

#: Prefix lengths of the chain of priors; 0 stands for the whole word.
LEVELS = (3, 4, 5, 6, 0)
PRIOR = 50.0
DRIFT = 1.5
#: A token is worth a look if it or a longer form of it scores above this.
HOT = 1.5
SALTS, PER_SALT = 64, 60
SIGNIFICANT = 0.05


@dataclass
class Model:
    hashes: list[np.ndarray]  # a level each, ascending
    scores: list[np.ndarray]
    background: float
    rate: float  # lambda
    weights: np.ndarray  # of the logistic curve: 1, best evidence, sum statistic

    def token_scores(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, scores) of the words that any level knows; all others score `background`."""
        places = np.arange(len(starts))
        scores = np.full(len(starts), self.background)
        for k, level in enumerate(LEVELS):
            s, e = starts[places], ends[places]
            value = textvec.word_hashes(data, s, np.minimum(e, s + level) if level else e, lower=True)
            at = np.minimum(np.searchsorted(self.hashes[k], value), max(len(self.hashes[k]) - 1, 0))
            known = self.hashes[k][at] == value if len(self.hashes[k]) else np.zeros(len(value), bool)
            places, at = places[known], at[known]
            scores[places] = self.scores[k][at]
            if k == 0:
                looked = places
        return looked, scores[looked]


def maximal_segments(places: np.ndarray, scores: np.ndarray, background: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first word, end, score) when words not in `places` score `background` (< 0).

    Ruzzo and Tompa's scan, over positive words only: the sum before and through each
    of them comes from one cumulative sum.
    """
    through = np.cumsum(scores - background) + background * (places + 1)
    positive = np.flatnonzero(scores > 0)
    stack: list[tuple[int, int, float, float]] = []  # first, end, sum before, sum through
    for k in positive:
        first, end, left, right = int(places[k]), int(places[k]) + 1, float(through[k] - scores[k]), float(through[k])
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= left:
                j -= 1
            if j < 0 or stack[j][3] >= right:
                break
            first, left = stack[j][0], stack[j][2]
            del stack[j:]
        stack.append((first, end, left, right))
    return [(a, b, right - left) for a, b, left, right in stack]


def evidence(segments: list[tuple[int, int, float]], words: int, rate: float) -> tuple[float, float]:
    """-log E of the best segment (0 without any), and the sum statistic: all segments' scores in units of 1 / lambda."""
    return max([0.0, *(rate * s - math.log(max(words, 1)) for _, _, s in segments)]), rate * sum(s for _, _, s in segments)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, data, at in textvec.slices(batch, "text"):
            starts, ends, first = textvec.word_spans(data, at)
            toxic = np.repeat(part.column(part.schema.get_field_index("toxic")).to_numpy().astype(np.int64), np.diff(first))
            chain = np.zeros((len(starts), len(LEVELS)), np.uint64)
            for k, level in enumerate(LEVELS):
                chain[:, k] = textvec.word_hashes(data, starts, np.minimum(ends, starts + level) if level else ends, lower=True)
            # A word counts once a document. With all its prefixes it is one row; the chain is what the priors follow.
            owner = np.repeat(np.arange(part.num_rows), np.diff(first))
            _, once = np.unique(textvec.mix(chain[:, -1] ^ textvec.mix(owner.astype(np.uint64) + np.uint64(1))), return_index=True)
            chain, toxic = chain[once], toxic[once]
            whole, index, back = np.unique(chain[:, -1], return_index=True, return_inverse=True)
            bad = np.bincount(back, weights=toxic, minlength=len(whole)).astype(np.int64)
            all_ = np.bincount(back, minlength=len(whole)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*(pa.array(chain[index, k].view(np.int64)) for k in range(len(LEVELS))), pa.array(bad), pa.array(all_ - bad)], names=[*(f"h{k}" for k in range(len(LEVELS))), "bad", "good"])


def _scores(rows: list[np.ndarray], bad: np.ndarray, good: np.ndarray) -> Model:
    """Posterior log-odds along the chain, kept for what lies on a path to a hot token."""
    total_bad, total_good = max(float(bad.sum()), 1.0), max(float(good.sum()), 1.0)
    root = total_bad / (total_bad + total_good)
    prior = np.full(len(bad), root)
    odds, groups = [], []
    for chain in rows:
        values, back = np.unique(chain, return_inverse=True)
        a, b = (np.bincount(back, weights=x, minlength=len(values)) for x in (bad, good))
        first = np.zeros(len(values), np.int64)
        first[back] = np.arange(len(back))
        q = (a + PRIOR * prior[first]) / (a + b + PRIOR)
        prior = q[back]
        odds.append(np.log(q / (1 - q)) - math.log(root / (1 - root)))
        groups.append((values, back))
    hot = np.zeros(len(bad), bool)
    for (_, back), s in zip(groups, odds, strict=True):
        hot |= s[back] >= HOT
    cold = np.concatenate([odds[-1][groups[-1][1]][~hot], [0.0]])
    weight = np.concatenate([good[~hot], [1.0]])
    background = min(float(np.average(cold, weights=weight)) - DRIFT, -0.1)
    hashes, scores = [], []
    on_path = hot.copy()
    for k, ((values, back), s) in enumerate(zip(groups, odds, strict=True)):
        kept = np.zeros(len(values), bool)
        kept[back[hot]] = True
        if k:  # a longer form below a kept one answers for itself
            kept[back[on_path]] = True
        on_path = kept[back]
        hashes.append(values[kept])
        scores.append(s[kept] - DRIFT)
    # Lambda: the positive root of E[exp(lambda s)] = 1 over clean tokens.
    s = np.where(on_path, odds[-1][groups[-1][1]] - DRIFT, background)
    p = (good + 1e-3) / (good + 1e-3).sum() if len(good) else np.ones(0)
    low, high = 1e-3, 20.0
    for _ in range(60):
        middle = (low + high) / 2
        if len(s) and float(np.exp(np.minimum(middle * s, 50)) @ p) < 1:
            low = middle
        else:
            high = middle
    return Model(hashes, scores, background, low, np.zeros(3))


def _segments(model: Model, data: np.ndarray, at: np.ndarray) -> Iterator[tuple[list[tuple[int, int, float]], int]]:
    starts, ends, first = textvec.word_spans(data, at)
    places, scores = model.token_scores(data, starts, ends)
    edges = np.searchsorted(places, first)
    for i in range(len(first) - 1):
        a, b = edges[i], edges[i + 1]
        n = int(first[i + 1] - first[i])
        yield (maximal_segments(places[a:b] - first[i], scores[a:b], model.background) if b > a else []), n


def fit(docs: DataFrame, labels: DataFrame, salts: int = SALTS, per_salt: int = PER_SALT) -> Model | None:
    """A model from a bounded sample of labelled documents that `fold` does not hold out."""
    marks = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).where(fold() != 0)
    chosen = bounded_sample(marks, "toxic", "doc_id", salts, per_salt)
    if len({t for t, _ in chosen}) < 2:
        return None
    spark = docs.sparkSession
    side = F.broadcast(spark.createDataFrame([(i, int(t), k % 2) for k, (t, i) in enumerate(chosen)], "doc_id long, toxic int, half int"))  # salts * per_salt rows a class
    sample = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(side, "doc_id").select("text", "toxic", "half")
    names = [f"h{k}" for k in range(len(LEVELS))]
    counts = sample.where("half = 0").select("text", "toxic").mapInArrow(_counts, ", ".join(f"{x} long" for x in names) + ", bad long, good long")
    got = counts.groupBy(*names).agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).orderBy(*names).toArrow()
    if not got.num_rows:
        return None
    model = _scores([got.column(x).to_numpy().view(np.uint64) for x in names], got.column("bad").to_numpy().astype(float), got.column("good").to_numpy().astype(float))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, at in textvec.slices(batch, "text"):
                x = [evidence(s, n, model.rate) for s, n in _segments(model, data, at)]
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array([a for a, _ in x], pa.float64()), pa.array([b for _, b in x], pa.float64())], names=["toxic", "best", "total"])

    got = sample.where("half = 1").select("text", "toxic").mapInArrow(measure, "toxic int, best double, total double").toArrow().sort_by([(c, "ascending") for c in ("toxic", "best", "total")])
    y = got.column("toxic").to_numpy().astype(float)
    rate = marks.agg(F.avg("toxic")).first()[0]
    model.weights = _logistic(_features(got.column("best").to_numpy(), got.column("total").to_numpy()), y, np.where(y > 0, rate / max(y.mean(), 1e-9), (1 - rate) / max(1 - y.mean(), 1e-9)))
    return model


def _features(best: np.ndarray, total: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(best)), np.log1p(np.maximum(best, 0)), np.log1p(np.maximum(total, 0))], axis=1)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - y)) + ridge * w
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w = w - np.linalg.solve(curve, slope)
    return w


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, score, predicted, n_passages and passages of every document.

    `passages` holds first word, end word and expected number of rivals of each significant segment.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limit = -math.log(SIGNIFICANT)
        for batch in batches:
            for part, data, at in textvec.slices(batch, "text"):
                if model is None:
                    values, spans = np.zeros(part.num_rows), [[]] * part.num_rows
                else:
                    best, total, spans = [], [], []
                    for segments, n in _segments(model, data, at):
                        b, t = evidence(segments, n, model.rate)
                        best.append(b)
                        total.append(t)
                        spans.append([{"first": a, "end": e, "rivals": max(n, 1) * math.exp(-model.rate * s)} for a, e, s in segments if model.rate * s - math.log(max(n, 1)) >= limit])
                    values = 1 / (1 + np.exp(-np.clip(_features(np.array(best), np.array(total)) @ model.weights, -30, 30)))
                kind = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("rivals", pa.float64())]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(values), pa.array([len(x) for x in spans], pa.int64()), pa.array(spans, kind)], names=["doc_id", "score", "n_passages", "passages"])

    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "doc_id long, score double, n_passages long, passages array<struct<first: long, end: long, rivals: double>>")
    return found.select("doc_id", (fold() == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int").alias("predicted"), "n_passages", "passages")
