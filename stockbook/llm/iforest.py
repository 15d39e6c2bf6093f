"""Operator 9, quality rules: an isolation forest on rule statistics.

Each document is reduced to a few rule statistics, which are written once. The
cuts of the random trees are drawn from the range that the statistics of all
labelled documents have; then every good labelled document goes down every
tree, and the nodes' counts, scaled to ``psi`` rows a tree, take the place of
the subsample that an isolation forest is usually grown on (its mean over all
subsamples, so none is drawn). A document's anomaly score is 2^(-E[path] / c)
as in isolation forests. The threshold is the one that best separates all
labelled good from all labelled bad rows (a lost good row weighs ten times) and
rejects at most ``max_false`` of the good ones, among ``STEPS`` values. Ranges,
counts and the histogram of scores are sums over Spark's partitions: no labelled
row is left out, and the driver gets at most one number per leaf or step.

Defined results: null and empty texts have no words and fail the base rule;
without labelled rows of both kinds there is no threshold, and only the base
rule decides; repeated rows are scored one by one; other columns are ignored
(``score_quality``) or passed on (``keep_good``).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockbook.llm.common import WHITE, forget, map_docs, record_batch, stored

# Fixed values of the base rules.
SYMBOLS = b"#*$%&|<>"
WINDOW, MIN_WORDS, REPEAT_PERCENT = 8, 20, 30

_CONT = bytes(range(0x80, 0xC0))  # UTF-8 continuation bytes: not the start of a code point
_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))
_DIGITS = bytes(range(48, 58))
_PLAIN = _UPPER + _LOWER + _DIGITS + bytes(range(0x80, 0x100))
_MIX = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) | 1 for k in range(WINDOW)], np.uint64)

GOOD_COST = 10.0
STEPS = 1 << 16  # values that a threshold may have
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = [f"x{k}" for k in range(9)]
_STATS = ("doc_id bigint, " + ", ".join(f"{c} bigint" for c in BASE) + ", base_failed boolean, "
          + ", ".join(f"{c} double" for c in FEATURES))


def _without(data: bytes, drop: bytes) -> int:
    return len(data.translate(None, drop))


def rule_stats(data: bytes | None) -> tuple[list[int], list[float]]:
    """The five base counts and the forest's features of one UTF-8 text.

    Repeated lines count by their share of the text, which one more license line
    hardly moves. Digits are no feature: clean texts with a telephone number
    would look odd.
    """
    data = data or b""
    words = data.split()
    n = len(words)
    word_chars = _without(data, WHITE + _CONT)
    n_symbols = len(data) - _without(data, SYMBOLS)
    lines = [x for x in data.split(b"\n") if x.strip()]
    unique = set(lines)
    n_dup = len(lines) - len(unique)
    repeated = sum(map(len, lines)) - sum(map(len, unique)) if n_dup else 0
    n_repeat, adjacent = 0, 0.0
    if n > 1:
        h = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
        adjacent = float(np.mean(h[1:] == h[:-1]))
        if n > WINDOW:
            m = n - WINDOW + 1
            win = np.zeros(m, np.uint64)
            for k in range(WINDOW):
                win += h[k:k + m] * _MIX[k]
            _, inverse, counts = np.unique(win, return_inverse=True, return_counts=True)
            if len(counts) < m:
                starts = np.flatnonzero(counts[inverse] > 1)
                cover = np.zeros(n + 1, np.int64)
                np.add.at(cover, starts, 1)
                np.add.at(cover, starts + WINDOW, -1)
                n_repeat = int(np.count_nonzero(np.cumsum(cover[:n])))
    size = max(len(data), 1)
    upper, lower = len(data) - _without(data, _UPPER), len(data) - _without(data, _LOWER)
    bare = sum(1 for w in words if not w.strip(SYMBOLS + b"!?.,;:-")) if n_symbols else 0
    plain = size - _without(data, _PLAIN)
    features = [
        n_symbols / max(n, 1),
        bare / max(n, 1),
        upper / max(upper + lower, 1),
        adjacent,
        n_repeat / max(n, 1),
        (len(data) - _without(data, b"!")) / max(n, 1),
        1 - plain / max(_without(data, WHITE), 1),
        min(word_chars / max(n, 1), 30.0),
        repeated / size,
    ]
    return [n, word_chars, n_symbols, n_dup, n_repeat], features


def base_failed(n_words: int, n_repeat: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat > REPEAT_PERCENT * n_words


@dataclass
class Forest:
    """Trees as arrays of shape (trees, nodes); a leaf has feature -1 and its path length."""

    feature: np.ndarray
    split: np.ndarray
    left: np.ndarray
    right: np.ndarray
    path: np.ndarray
    norm: float
    threshold: float = math.inf

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly score in (0, 1) of each row of ``x``."""
        rows = np.arange(len(x))
        total = np.zeros(len(x))
        for t in range(len(self.feature)):
            node = np.zeros(len(x), np.int64)
            while True:
                f = self.feature[t][node]
                inner = f >= 0
                if not inner.any():
                    break
                low = x[rows, np.maximum(f, 0)] < self.split[t][node]
                node = np.where(inner, np.where(low, self.left[t][node], self.right[t][node]), node)
            total += self.path[t][node]
        return 2.0 ** (-total / len(self.feature) / self.norm)


def _average_path(n: np.ndarray) -> np.ndarray:
    """Mean path length of an unsuccessful search among ``n`` points (any number above 2 or below)."""
    n = np.asarray(n, float)
    m = np.maximum(n, 2)
    far = 2.0 * (np.log(m - 1) + 0.5772156649015329) - 2.0 * (m - 1) / m
    return np.where(n < 2, 0.0, np.where(n > 2, far, 1.0))


@dataclass
class Cuts:
    """Random trees without rows, of equal depth: node k has the children 2k + 1
    and 2k + 2. ``usable`` is False where no feature is left to cut."""

    feature: np.ndarray  # (trees, nodes)
    split: np.ndarray
    usable: np.ndarray
    depth: int

    @property
    def leaves(self) -> int:
        return 1 << self.depth

    def counts(self, x: np.ndarray) -> np.ndarray:
        """(tree, leaf) numbers of the rows of ``x``."""
        rows, out = np.arange(len(x)), np.zeros((len(self.feature), self.leaves), np.int64)
        for t in range(len(self.feature)):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, self.feature[t][node]] >= self.split[t][node])
            out[t] = np.bincount(node - (self.leaves - 1), minlength=self.leaves)
        return out


def draw(low: np.ndarray, high: np.ndarray, trees: int, depth: int, seed: int) -> Cuts:
    """Trees whose cuts are drawn from each node's part of the box, not from rows:
    a region without rows is cut off as well, so a dense group of anomalies is as
    far out as a single one."""
    rng = np.random.default_rng(seed)
    lo = np.broadcast_to(low, (trees, 1, len(low))).astype(float)
    hi = np.broadcast_to(high, (trees, 1, len(high))).astype(float)
    feature, split, usable = [], [], []
    for _ in range(depth):
        may = hi > lo
        some = may.any(axis=2)
        nth = np.floor(rng.random(some.shape) * may.sum(axis=2)).astype(int)
        k = np.argmax(may & (may.cumsum(axis=2) == nth[:, :, None] + 1), axis=2)
        at = k[:, :, None]
        l, h = (np.take_along_axis(e, at, 2)[:, :, 0] for e in (lo, hi))
        cut = l + (h - l) * rng.random(some.shape)
        cut = np.where(l < cut, cut, h)  # at the lower edge one side would be empty for good
        feature.append(np.where(some, k, 0))
        split.append(np.where(some, cut, np.inf))
        usable.append(some)
        below, above = hi.copy(), lo.copy()
        np.put_along_axis(below, at, np.where(some, cut, h)[:, :, None], 2)
        np.put_along_axis(above, at, np.where(some, cut, l)[:, :, None], 2)
        shape = (trees, -1, len(low))
        lo, hi = (np.stack(e, 2).reshape(shape) for e in ((lo, above), (below, hi)))
    return Cuts(*(np.concatenate(e, 1) for e in (feature, split, usable)), depth)


def weigh(cuts: Cuts, counts: np.ndarray, psi: int) -> Forest:
    """The forest of ``cuts`` for the (tree, leaf) ``counts`` of all rows: a node
    that holds fewer than two of ``psi`` rows, by its share, is a leaf."""
    n = int(counts[0].sum())
    psi = min(psi, n)
    levels = [counts]
    while levels[-1].shape[1] > 1:
        levels.append(levels[-1].reshape(len(counts), -1, 2).sum(axis=2))
    mass = np.concatenate(levels[::-1], 1) * (psi / max(n, 1))
    deep = np.repeat(np.arange(cuts.depth + 1), 1 << np.arange(cuts.depth + 1))
    path = deep + _average_path(mass)
    inner = np.zeros(mass.shape, bool)
    inner[:, :cuts.usable.shape[1]] = cuts.usable
    inner &= mass >= 2
    reached = np.zeros(mass.shape, bool)
    reached[:, 0] = True
    for d in range(cuts.depth):
        at = np.flatnonzero(deep == d)
        go = reached[:, at] & inner[:, at]
        reached[:, 2 * at + 1], reached[:, 2 * at + 2] = go, go
    place = reached.cumsum(axis=1) - 1
    size = int(place.max()) + 1
    shape = (len(counts), size)
    out = Forest(np.full(shape, -1, np.int32), np.zeros(shape), np.zeros(shape, np.int32),
                 np.zeros(shape, np.int32), np.zeros(shape), max(float(_average_path(psi)), 1e-9))
    for t in range(len(counts)):
        old = np.flatnonzero(reached[t])
        out.path[t, :len(old)] = path[t, old]
        split = np.flatnonzero(inner[t, old])
        old = old[split]
        out.feature[t, split], out.split[t, split] = cuts.feature[t, old], cuts.split[t, old]
        out.left[t, split], out.right[t, split] = place[t, 2 * old + 1], place[t, 2 * old + 2]
    return out


def _depth(psi: int) -> int:
    return max(1, math.ceil(math.log2(max(psi, 2)))) + 2


def grow(x: np.ndarray, trees: int, psi: int, seed: int, box: np.ndarray | None = None) -> Forest:
    """A forest on the rows of ``x``, cut in the range of ``box`` (default ``x``)."""
    wide = x if box is None else box
    cuts = draw(wide.min(axis=0), wide.max(axis=0), trees, _depth(min(psi, len(x))), seed)
    return weigh(cuts, cuts.counts(x), psi)


def steps(score: np.ndarray) -> np.ndarray:
    return np.floor(score * STEPS).astype(np.int64)


def calibrate(step: np.ndarray, good: np.ndarray, bad: np.ndarray, max_false: float) -> float:
    """The threshold of the best trade, from the numbers of ``good`` and ``bad``
    rows at each ``step`` (ascending): a share of good rows rejected costs
    ``GOOD_COST`` times as much as the same share of bad rows kept."""
    if not good.sum() or not bad.sum():
        return math.inf
    bad_at, good_at = (v[::-1].cumsum()[::-1] / v.sum() for v in (bad, good))
    gain = np.where(good_at <= max_false, bad_at - GOOD_COST * good_at, -1.0)
    best = int(np.argmax(gain))
    if gain[best] <= 0:
        return math.inf
    # half-way to the next lower score
    return float(step[best] + step[best - 1] + 1 if best else 2 * step[best]) / (2 * STEPS)


def _features(batch: pa.RecordBatch) -> np.ndarray:
    return np.column_stack([batch.column(c).to_numpy() for c in FEATURES])


def _summed(rows: DataFrame, size: int, add) -> np.ndarray:
    """The sum of the arrays of ``size`` numbers that ``add(batch)`` gives."""
    def run(batches):
        total = np.zeros(size, np.int64)
        for b in batches:
            total += add(b)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "n"])

    out = np.zeros(size, np.int64)
    parts = rows.mapInArrow(run, "at bigint, n bigint")
    for r in parts.groupBy("at").agg(F.sum("n").alias("n")).collect():
        out[r["at"]] = r["n"]
    return out


def train(stats: DataFrame, labels: DataFrame, trees: int = 100, psi: int = 256,
          max_false: float = 0.01, seed: int = 9) -> Forest | None:
    """Forest and threshold from all labelled documents of a written ``stats``
    (``statistics``); None without any. Several labels of one document count as
    the largest."""
    marks = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
    marks = marks.groupBy(F.col("doc_id").cast("bigint").alias("k")).agg(
        F.max(F.col("quality").cast("int")).alias("y"))
    rows = stored(stats.join(marks, F.col("doc_id") == F.col("k")).select(
        (F.col("y") == 1).alias("good"), "base_failed", *FEATURES), "quality-labelled")
    judged = rows.where(~F.col("base_failed"))  # the base rules settle the others
    box = rows.agg(F.count(F.lit(1)).alias("n"),
                   F.count(F.when(F.col("good") & ~F.col("base_failed"), 1)).alias("normal"),
                   *[f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in FEATURES]).first()
    if not box["n"]:
        return None
    low, high = (np.array([box[f"{f}_{c}"] for c in FEATURES]) for f in ("min", "max"))
    normal, n = (judged.where("good"), box["normal"]) if box["normal"] else (rows, box["n"])
    cuts = draw(low, high, trees, _depth(min(psi, n)), seed)
    counts = _summed(normal, trees * cuts.leaves, lambda b: cuts.counts(_features(b)).ravel())
    forest = weigh(cuts, counts.reshape(trees, -1), psi)

    def at_steps(b: pa.RecordBatch) -> np.ndarray:
        good = np.asarray(b.column("good").to_numpy(zero_copy_only=False), bool)
        return np.bincount(2 * steps(forest.score(_features(b))) + good, minlength=2 * STEPS + 2)

    found = _summed(judged, 2 * STEPS + 2, at_steps).reshape(-1, 2)
    step = np.flatnonzero(found.any(axis=1))
    forest.threshold = calibrate(step, found[step, 1], found[step, 0], max_false)
    return forest


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed and the forest's features of every document."""
    def run(ids, texts, _):
        out = [rule_stats(t) for t in texts]
        cols = {c: [r[0][k] for r in out] for k, c in enumerate(BASE)}
        cols |= {c: [r[1][k] for r in out] for k, c in enumerate(FEATURES)}
        return cols | {"doc_id": ids, "base_failed": [base_failed(r[0][0], r[0][4]) for r in out]}

    return map_docs(docs, run, _STATS)


def _verdicts(x: np.ndarray, failed: np.ndarray, forest: Forest | None) -> tuple[np.ndarray, np.ndarray]:
    """(kept, anomaly score) of documents."""
    if forest is None or not len(x):
        return ~failed, np.zeros(len(x))
    score = forest.score(x)
    return ~failed & (score < forest.threshold), score


def score_quality(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and the anomaly score of every document."""
    stats = stored(statistics(docs), "quality-stats")
    forest = train(stats, labels, **options)
    target = docs.sparkSession.createDataFrame(
        [], _STATS[:_STATS.index(", x0")] + ", kept boolean, anomaly double").schema

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(target)
        for b in batches:
            failed = np.asarray(b.column("base_failed").to_numpy(zero_copy_only=False), bool)
            kept, score = _verdicts(_features(b), failed, forest)
            yield record_batch({c: b.column(c) for c in ("doc_id", *BASE, "base_failed")}
                               | {"kept": pa.array(kept), "anomaly": pa.array(np.round(score, 9))}, schema)

    return stats.mapInArrow(run, target)


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are kept, all columns; texts are never shuffled,
    so the statistics are made once for the forest and once for the verdicts."""
    forest = train(stored(statistics(docs), "quality-stats"), labels, **options)
    at = docs.columns.index("text")

    def run(batches):
        forget()
        for b in batches:
            out = [rule_stats(t) for t in b.column(at).cast(pa.binary()).to_pylist()]
            failed = np.array([base_failed(c[0], c[4]) for c, _ in out], bool)
            kept, _ = _verdicts(np.array([x for _, x in out]), failed, forest)
            yield b.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
