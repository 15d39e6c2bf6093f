"""Operator 1, language identification by error-correcting output codes.

Every language has a codeword; a binary classifier for each bit tells the
languages with the bit from those without. A classifier is the log-odds of
hashed byte trigrams, counted over all training rows: a table of fixed size
per language. A text's bit margin is its mean log-odds, scaled by its length
up to ``EVIDENCE`` trigrams. Decoding is loss-weighted: the language whose
codeword has the least logistic loss, each bit weighted by its accuracy on a
bounded sample of the training rows (``sample`` documents by hash order). A
result whose best two losses are close is flagged ``ambiguous``.

Up to six languages get the exhaustive code (2^(k-1) - 1 bits), more get the
best of some seeded random codes of about 10 log2(k) bits. The model grows with
the number of bits; a table per language never comes to the driver.

Defined results: ``und`` with score 0 if the text is null or has no letter, or
if nothing could be learned; training skips rows with a null doc_id, lang or
text; repeated rows count and are scored one by one; other columns are ignored.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockbook.llm.common import crc32_mod, map_docs, segments, stored

BUCKETS = 1 << 15
EVIDENCE = 60.0
PRIOR = 0.5
CHUNK = 1 << 21  # trigrams that are looked up together
_LETTERS = bytes(b if 97 <= b <= 122 or b >= 128 else 0x20 for b in range(256))


def trigrams(text: str | None) -> np.ndarray:
    """Buckets of the byte trigrams of the lower-cased words, blanks between them."""
    if not text:
        return np.zeros(0, np.uint32)
    b = b" " + b" ".join(text.lower().encode().translate(_LETTERS).split()) + b" "
    x = np.frombuffer(b, np.uint8).astype(np.uint32)
    if len(x) < 3:
        return np.zeros(0, np.uint32)
    h = (x[:-2] | x[1:-1] << np.uint32(8) | x[2:] << np.uint32(16)) * np.uint32(2654435761)
    return h >> np.uint32(17)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def code_matrix(k: int, seed: int = 1) -> np.ndarray:
    """(languages, bits) of -1 and 1."""
    if k <= 1:
        return np.ones((k, 1), np.int8)
    if k <= 6:
        rows = [(1, *bits) for bits in itertools.product((1, -1), repeat=k - 1)]
        return np.array([r for r in rows if -1 in r], np.int8).T
    rng, best, far = np.random.default_rng(seed), None, -1
    for _ in range(60 if k <= 1000 else 4):
        m = rng.choice(np.array([-1, 1], np.int8), (k, math.ceil(10 * math.log2(k))))
        m = m[:, (m != m[0]).any(axis=0)]
        d = least_distance(m)
        if d > far:
            best, far = m, d
    return best


def least_distance(m: np.ndarray) -> int:
    """Smallest number of bits in which two rows differ."""
    x, least = m.astype(np.float32), m.shape[1]
    for lo in range(0, len(x), 1024):
        same = x[lo:lo + 1024] @ x.T
        same[np.arange(len(same)), np.arange(lo, lo + len(same))] = -np.inf
        least = min(least, int((m.shape[1] - same.max()) / 2))
    return least


@dataclass
class Model:
    langs: list[str]
    code: np.ndarray      # (languages, bits)
    odds: np.ndarray      # (bits, buckets), float32
    weight: np.ndarray    # (bits,)

    def margins(self, texts: list[str | None]) -> np.ndarray:
        """Scaled margin of each text and bit."""
        grams = [trigrams(t) for t in texts]
        out = np.zeros((len(texts), len(self.odds)))
        at = 0
        while at < len(grams):
            end, total = at, 0
            while end < len(grams) and (end == at or total + len(grams[end]) <= CHUNK):
                total += len(grams[end])
                end += 1
            sizes = np.array([len(g) for g in grams[at:end]], np.int64)
            full = np.flatnonzero(sizes) + at
            if len(full):
                idx = np.concatenate(grams[at:end])
                starts = segments(sizes)[:-1][sizes > 0]
                for b, odds in enumerate(self.odds):
                    out[full, b] = np.add.reduceat(odds[idx], starts, dtype=np.float64)
            n = np.maximum(sizes, 1)
            out[at:end] *= (np.minimum(n, EVIDENCE) / n)[:, None]
            at = end
        return out

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language number, probability, ambiguous) by loss-weighted decoding."""
        one, zero = (self.code.T > 0).astype(float), (self.code.T < 0).astype(float)
        loss = ((np.logaddexp(0.0, -margins) * self.weight) @ one
                + (np.logaddexp(0.0, margins) * self.weight) @ zero)
        best = loss.argmin(axis=1)
        rel = np.exp(loss.min(axis=1, keepdims=True) - loss)
        score = rel.max(axis=1) / rel.sum(axis=1)
        if loss.shape[1] < 2:
            return best, score, np.zeros(len(best), bool)
        two = np.partition(loss, 1, axis=1)
        return best, score, two[:, 1] - two[:, 0] < 0.5


def _count(rows: DataFrame) -> DataFrame:
    """(lang, bucket, n) over all rows (text, lang)."""
    def run(batches):
        total: dict[str, np.ndarray] = {}
        for b in batches:
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                t = total.setdefault(lang, np.zeros(BUCKETS, np.int64))
                t += np.bincount(trigrams(text), minlength=BUCKETS)
        for lang, t in total.items():
            at = np.flatnonzero(t)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(t[at])],
                names=["lang", "bucket", "n"])

    return (rows.select("text", "lang").mapInArrow(run, "lang string, bucket int, n bigint")
            .groupBy("lang", "bucket").agg(F.sum("n").alias("n")))


def _bit_odds(counted: DataFrame, langs: list[str], totals: np.ndarray, code: np.ndarray) -> np.ndarray:
    """(bits, buckets): log-odds of a trigram under the languages of either side.

    Languages weigh the same: the shares of each are summed up per side on the
    executors, and two numbers a bit and bucket come to the driver, whatever the
    number of languages.
    """
    number = {lang: k for k, lang in enumerate(langs)}
    mass = totals + PRIOR * BUCKETS

    def run(batches):
        total = np.zeros((2, code.shape[1], BUCKETS))
        for b in batches:
            at = np.array([number[x] for x in b.column(0).to_pylist()], np.int64)
            bucket = b.column(1).to_numpy()
            share = b.column(2).to_numpy() / mass[at]
            for bit in range(code.shape[1]):
                one = code[at, bit] > 0
                for side, keep in ((0, one), (1, ~one)):
                    total[side, bit] += np.bincount(bucket[keep], weights=share[keep], minlength=BUCKETS)
        for side in (0, 1):
            for bit in range(code.shape[1]):
                at = np.flatnonzero(total[side, bit])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), side, np.int32)), pa.array(np.full(len(at), bit, np.int32)),
                     pa.array(at.astype(np.int32)), pa.array(total[side, bit][at])],
                    names=["side", "bit", "bucket", "p"])

    summed = (counted.select("lang", "bucket", "n")
              .mapInArrow(run, "side int, bit int, bucket int, p double")
              .groupBy("side", "bit", "bucket").agg(F.sum("p").alias("p")).toArrow())
    side, bit, bucket, p = (c.to_numpy() for c in summed.columns)
    share = np.zeros((2, code.shape[1], BUCKETS))
    share[side, bit, bucket] = p
    odds = np.zeros((code.shape[1], BUCKETS))
    for k in range(code.shape[1]):
        one, zero = code[:, k] > 0, code[:, k] < 0
        if zero.any():  # every language also has the prior's share of every bucket
            odds[k] = (np.log((share[0, k] + (PRIOR / mass[one]).sum()) / one.sum())
                       - np.log((share[1, k] + (PRIOR / mass[zero]).sum()) / zero.sum()))
    return odds


def train(rows: DataFrame, sample: int = 4000) -> Model | None:
    """Model from training rows (doc_id, text, lang), none of them null."""
    counted = stored(_count(rows), "lang-counts")  # languages x buckets at most
    sizes = {r.lang: r.n for r in counted.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return None
    number = {lang: k for k, lang in enumerate(langs)}
    code = code_matrix(len(langs))
    odds = _bit_odds(counted, langs, np.array([sizes[x] for x in langs], float), code)
    model = Model(langs, code, np.array(odds, np.float32), np.ones(code.shape[1]))
    if len(langs) > 1:
        model.weight = _bit_weights(rows, model, number, sample)
    return model


def _bit_weights(rows: DataFrame, model: Model, number: dict[str, int], sample: int) -> np.ndarray:
    """Weight of each bit: log-odds of its accuracy on the sample, mean 1."""
    ids = (rows.select(F.col("doc_id").alias("k")).distinct()
           .orderBy(F.xxhash64("k"), "k").limit(sample))
    part = rows.join(F.broadcast(ids), rows.doc_id == ids.k).select("text", "lang")

    def run(batches):
        right = np.zeros((2, len(model.weight)), np.int64)
        for b in batches:
            known = [k for k, x in enumerate(b.column(1).to_pylist()) if x in number]  # some have no trigram
            part = b.take(pa.array(known, pa.int64()))
            truth = model.code[np.array([number[x] for x in part.column(1).to_pylist()], np.int64)]
            m = model.margins(part.column(0).to_pylist())
            right[0] += (np.sign(m) == truth).sum(axis=0)
            right[1] += len(truth)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(len(model.weight)), pa.int32()), pa.array(right[0]), pa.array(right[1])],
            names=["bit", "ok", "n"])

    got = (part.mapInArrow(run, "bit int, ok bigint, n bigint").groupBy("bit")
           .agg(F.sum("ok").alias("ok"), F.sum("n").alias("n")).collect())
    w = np.ones(len(model.weight))
    for r in got:
        p = (r.ok + 1) / (r.n + 2)
        w[r.bit] = max(math.log(p / (1 - p)), 0.05)
    return w / w.mean()


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, lang_pred, score, ambiguous) of every document, from its text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(ids, texts, _):
        m = shared.value
        known = [m is not None and has_letter(t) for t in texts]
        if m is None or not texts:
            best, score, close = (np.zeros(len(texts), t) for t in (int, float, bool))
        else:
            best, score, close = m.decode(m.margins(texts))
        return {"doc_id": ids,
                "lang_pred": [m.langs[i] if k else "und" for i, k in zip(best, known, strict=True)],
                "score": np.where(known, score, 0.0), "ambiguous": [
                    bool(c) or not k for c, k in zip(close, known, strict=True)]}

    return map_docs(docs, run, "doc_id bigint, lang_pred string, score double, ambiguous boolean",
                    text="string")


def identify_held_out(docs: DataFrame, folds: int = 3, fold: int = 1, **options) -> DataFrame:
    """Learn outside one fold of the ids, predict everywhere: the registered query."""
    held = crc32_mod("doc_id", folds) == fold
    rows = (docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held)
            .select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "lang"))
    out = identify(docs, train(rows, **options))
    return out.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred",
                      "score", "ambiguous")
