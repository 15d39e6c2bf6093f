"""Operator 2, toxicity: maximum-scoring segments of token log-odds.

A token's score is its log-odds between toxic and other training documents
with an informative Dirichlet prior (the frequencies of both together), moved
towards zero by ``SURE`` standard errors, less a drift. Inflected forms are
rare, so the same is done for the tokens' first ``PREFIX`` bytes, and a token
takes the surer of the two. Unsure tokens have the drift alone, so the expected
score is negative. One linear scan finds all maximal scoring segments of a
text: no prefix or suffix of one is negative, and none can be extended.

Under the null model the best segment of a clean text of n tokens follows an
extreme-value law, P(S >= x) = 1 - exp(-K n e^(-lambda x)). lambda solves
sum p e^(lambda s) = 1 over the clean tokens' scores, with one token's mass on
the positive scores of toxic texts (``null_model``); K is the maximum-likelihood
value over the clean training texts, those without a segment included
(``solve_k``). Each segment has the expectation E = K n e^(-lambda S); a text
is summed up by -ln E of its best segment and of its significant segments
together, and a logistic fit on the training rows turns them into a probability.

The labels are learned from at most ``sample`` labelled documents (ids by hash
order). Of near copies, which share the least hash of their shingles, one
counts, with the largest label of all. Tokens and prefixes are hashed to tables of fixed size.

Defined results: null and empty texts have no segment and a score; without
training rows of both kinds the score is 0; several labels of a document count
as the largest; repeated rows are scored one by one; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockbook.llm.common import (
    WORD_TABLE,
    RecentCache,
    crc32_mod,
    kept,
    labelled_sample,
    map_docs,
    stored,
    word_bytes,
)
from stockbook.llm.dart_minhash import mix, shingles

BUCKETS = 1 << 20
SURE = 2.5
PREFIX = 4
DRIFT = 0.25
PRIOR_MASS = 20_000.0
SIGNIFICANT = 0.05  # expectation below which a segment counts
THRESHOLD = 0.3
CACHE_WORDS = 200_000


def buckets(word: bytes) -> tuple[int, int]:
    """Places of a token and of its prefix in the two tables."""
    head = b"^" + word[:PREFIX] if len(word) > PREFIX else b"^^" + word
    return zlib.crc32(word) & (BUCKETS - 1), zlib.crc32(head) & (BUCKETS - 1)


def maximal_segments(at: np.ndarray, low: np.ndarray, high: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments, linear time.

    ``at``: places of the positive scores; ``low``, ``high``: sum of all scores
    before and up to each of them. Returns (first, last, score).
    """
    first, last, lo, hi, link = [], [], [], [], []  # link: nearest earlier with a lower ``lo``
    for p, left, right in zip(at.tolist(), low.tolist(), high.tolist(), strict=True):
        start = p
        while True:
            k = len(lo) - 1
            while k >= 0 and lo[k] >= left:
                k = link[k]
            if k < 0 or hi[k] >= right:
                first.append(start)
                last.append(p)
                lo.append(left)
                hi.append(right)
                link.append(k)
                break
            start, left = first[k], lo[k]
            del first[k:], last[k:], lo[k:], hi[k:], link[k:]
    return [(a, b, h - x) for a, b, x, h in zip(first, last, lo, hi, strict=True)]


def text_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    at = np.flatnonzero(scores > 0)
    if not len(at):
        return []
    total = np.cumsum(scores)
    return maximal_segments(at, total[at] - scores[at], total[at])


@dataclass
class Model:
    table: np.ndarray  # (2, BUCKETS): shrunk log-odds of tokens and of prefixes, float32
    name: str
    lam: float = 1.0
    k: float = 1.0
    weights: np.ndarray | None = None

    def scores(self, data: bytes | None) -> np.ndarray:
        """Score of every token of a text."""
        words = word_bytes(data)
        cache = kept(f"scores {self.name}", lambda: RecentCache(CACHE_WORDS))
        for w in cache.missing(words):
            a, b = (float(self.table[i][at]) for i, at in enumerate(buckets(w)))
            cache.young[w] = (a if abs(a) >= abs(b) else b) - DRIFT
        out = np.fromiter(map(cache.young.__getitem__, words), np.float64, len(words))
        cache.trim()
        return out

    def features(self, n: int, found: list[float]) -> list[float]:
        """Summary of a text of ``n`` tokens from its segments' scores."""
        size = math.log(max(self.k * n, 1e-9)) if n else 0.0
        surprise = [self.lam * s - size for s in found]  # -ln E
        more = sum(x for x in surprise if x > -math.log(SIGNIFICANT))
        return [1.0, max(min(max(surprise, default=-5.0), 60.0), -10.0), math.log1p(more),
                float(bool(found))]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(x @ self.weights, -30, 30)))


def log_odds(toxic: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Shrunk log-odds of each bucket from its document frequencies."""
    both = toxic + other
    prior = PRIOR_MASS * (both + 0.01) / (both + 0.01).sum()
    a, b = toxic + prior, other + prior
    delta = (np.log(a) - np.log(toxic.sum() + PRIOR_MASS - a)
             - np.log(b) + np.log(other.sum() + PRIOR_MASS - b))
    sure = np.abs(delta) - SURE * np.sqrt(1 / a + 1 / b)
    return (np.sign(delta) * np.maximum(sure, 0.0)).astype(np.float32)


def solve_lambda(scores: np.ndarray, p: np.ndarray) -> float:
    """The positive root of sum p e^(lambda s) = 1 (scores of negative mean, some
    of them positive; without any there is no segment and the value is not used)."""
    keep = p > 0
    s, p = scores[keep], p[keep] / p.sum()
    if not (s > 0).any() or float(s @ p) >= 0:
        return 1.0
    low, high = 1e-6, 1.0
    while float(p @ np.exp(high * s)) < 1 and high < 64:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if float(p @ np.exp(mid * s)) < 1 else (low, mid)
    return high


def null_model(clean: dict[float, int], toxic: dict[float, int]) -> tuple[np.ndarray, np.ndarray]:
    """(scores, weights) of the tokens of clean texts, with a floor on what is positive.

    One token more than were seen is spread over the positive scores of toxic
    texts, so that scores which no clean token of the sample has are rare, not
    impossible.
    """
    positive = sum(n for at, n in toxic.items() if at > 0)
    weights = {at: float(n) for at, n in clean.items()}
    for at, n in toxic.items():
        if at > 0:
            weights[at] = weights.get(at, 0.0) + n / positive
    places = sorted(weights)
    return np.array(places), np.array([weights[at] for at in places])


def solve_k(lam: float, texts: list[tuple[int, float]], least: float) -> float:
    """K of the extreme-value law, by maximum likelihood, from (tokens, best segment)
    of clean texts.

    A text's best segment is above x with probability 1 - exp(-K n e^(-lambda x)).
    A text without a segment tells that its best is below ``least``, the smallest
    positive score; half a text with a segment is added, so K is positive.
    """
    seen = sum(1 for _, best in texts if best > 0) + 0.5
    mass = sum(n * math.exp(-lam * (best if best > 0 else least)) for n, best in texts)
    return seen / mass if mass > 0 else 1.0


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return w


def _sample(docs: DataFrame, labels: DataFrame, keep: Column | None, sample: int) -> DataFrame:
    """(text, y) of the training documents, one of those with the same least shingle
    hash: that with the largest label (a labelled copy is toxic if one of them is),
    the last text in byte order among equals."""
    def run(batches):
        for b in batches:
            keys = []
            for data in b.column(0).to_pylist():
                s = shingles(data)
                keys.append(int(mix(s).min().view(np.int64)) if len(s) else 0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(keys, pa.int64())],
                                             names=["text", "y", "key"])

    part = labelled_sample(docs, labels, "toxic", sample, keep).select("text", "y")
    return stored(part.mapInArrow(run, "text binary, y int, key bigint").groupBy("key")
                  .agg(F.max(F.struct("y", "text")).alias("r")).select("r.text", "r.y"), "toxic-sample")


def _frequencies(part: DataFrame) -> DataFrame:
    """(y, kind, bucket, n): documents of each label that hold a token or prefix of the bucket."""
    def run(batches):
        total = np.zeros((2, 2, BUCKETS), np.int32)
        for b in batches:
            for data, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                places = [buckets(w) for w in set(word_bytes(data))]
                for kind in (0, 1):
                    total[int(y > 0), kind, list({p[kind] for p in places})] += 1
        for y in (0, 1):
            for kind in (0, 1):
                at = np.flatnonzero(total[y, kind])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), y), pa.int32()), pa.array(np.full(len(at), kind), pa.int32()),
                     pa.array(at, pa.int32()), pa.array(total[y, kind][at], pa.int64())],
                    names=["y", "kind", "bucket", "n"])

    return (part.select("text", "y").mapInArrow(run, "y int, kind int, bucket int, n bigint")
            .groupBy("y", "kind", "bucket").agg(F.sum("n").alias("n")))


def _histogram(part: DataFrame, model: Model) -> dict[int, dict[float, int]]:
    """Label -> rounded token score -> tokens, summed up on the executors."""
    shared = part.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        total: Counter = Counter()
        for b in batches:
            for data, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                at, n = np.unique(np.round(shared.value.scores(data), 2), return_counts=True)
                for k, c in zip(at.tolist(), n.tolist(), strict=True):
                    total[int(y > 0), k] += c
        yield pa.RecordBatch.from_arrays(
            [pa.array([y for y, _ in total], pa.int32()), pa.array([k for _, k in total], pa.float64()),
             pa.array(list(total.values()), pa.int64())], names=["y", "at", "n"])

    out: dict[int, dict[float, int]] = {0: {}, 1: {}}
    counted = part.select("text", "y").mapInArrow(run, "y int, at double, n bigint")
    for r in counted.groupBy("y", "at").agg(F.sum("n").alias("n")).collect():  # a few thousand scores
        out[r.y][r["at"]] = r.n
    return out


def _segments(part: DataFrame, model: Model) -> list:
    """(y, n, segment scores) of the bounded sample."""
    shared = part.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            rows = []
            for data in b.column(0).to_pylist():
                s = shared.value.scores(data)
                rows.append((len(s), [x for _, _, x in text_segments(s)]))
            yield pa.RecordBatch.from_arrays(
                [b.column(1), pa.array([n for n, _ in rows], pa.int64()),
                 pa.array([x for _, x in rows], pa.list_(pa.float64()))], names=["y", "n", "s"])

    return part.select("text", "y").mapInArrow(run, "y int, n bigint, s array<double>").collect()


def train(docs: DataFrame, labels: DataFrame, keep: Column | None = None,
          sample: int = 20_000) -> Model | None:
    """Model from at most ``sample`` labelled documents; None without both labels."""
    part = _sample(docs, labels, keep, sample)
    counted = _frequencies(part).toArrow()  # four rows a bucket at most
    y, kind, bucket, n = (c.to_numpy() for c in counted.columns)
    freq = np.zeros((2, 2, BUCKETS))
    freq[y, kind, bucket] = n
    if not freq[0].any() or not freq[1].any():
        return None
    table = np.stack([log_odds(freq[1, i], freq[0, i]) for i in (0, 1)])
    model = Model(table, hashlib.sha256(table.tobytes()).hexdigest())
    tokens = _histogram(part, model)
    model.lam = solve_lambda(*null_model(tokens[0], tokens[1]))
    rows = sorted(_segments(part, model), key=lambda r: (r.y, r.n, r.s))
    positive = [at for found in tokens.values() for at in found if at > 0]
    if positive:
        model.k = solve_k(model.lam, [(r.n, max(r.s, default=0.0)) for r in rows if not r.y and r.n],
                          min(positive))
    x = np.array([model.features(r.n, r.s) for r in rows])
    model.weights = logistic(x, np.array([float(r.y > 0) for r in rows]))
    return model


def passages(data: bytes, found: list[tuple[int, int, float]], model: Model) -> list[dict]:
    """Significant segments as byte offsets of the text."""
    spaced = data.translate(WORD_TABLE)
    edge = np.flatnonzero(np.diff(np.concatenate(
        ([False], np.frombuffer(spaced, np.uint8) != 0x20, [False])).astype(np.int8)))
    size = model.k * (len(edge) // 2)
    out = []
    for a, b, s in found:
        e = size * math.exp(-model.lam * s)
        if e < SIGNIFICANT:
            out.append({"start": int(edge[2 * a]), "end": int(edge[2 * b + 1]), "expected": e})
    return out


def score_toxicity(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, score, predicted, passages) of every document, from its text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(ids, texts, m):
        if m is None or not texts:
            return {"doc_id": ids, "score": [0.0] * len(ids), "predicted": [0] * len(ids),
                    "passages": [[] for _ in ids]}
        scores = [m.scores(t) for t in texts]
        found = [text_segments(s) for s in scores]
        score = m.probability(np.array([m.features(len(s), [x for _, _, x in f])
                                        for s, f in zip(scores, found, strict=True)]))
        return {"doc_id": ids, "score": score, "predicted": (score >= THRESHOLD).astype(np.int32),
                "passages": [passages(t, f, m) if f else [] for t, f in zip(texts, found, strict=True)]}

    return map_docs(docs, run, "doc_id bigint, score double, predicted int, "
                    "passages array<struct<start: bigint, end: bigint, expected: double>>",
                    setup=lambda: shared.value)


def score_held_out(docs: DataFrame, labels: DataFrame, folds: int = 4, fold: int = 2,
                   **options) -> DataFrame:
    """Learn outside one fold of the ids, score everywhere: the registered query."""
    model = train(docs, labels, crc32_mod("doc_id", folds) != fold, **options)
    out = score_toxicity(docs, model)
    held = F.coalesce(crc32_mod("doc_id", folds) == fold, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", "predicted", "passages")
