from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np

from stockbook.llm import iforest as Q
from tests.llm import corpus


def brute(text):
    white = " \t\n\x0b\x0c\r"
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if x.strip(white)]
    seen = Counter(tuple(words[k:k + 8]) for k in range(len(words) - 7))
    hit = {k + j for k in range(len(words) - 7) if seen[tuple(words[k:k + 8])] > 1 for j in range(8)}
    n, rep = len(words), len(hit)
    return [n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""),
            len(lines) - len(set(lines)), rep], n < 20 or 100 * rep > 30 * n


def texts():
    rng = random.Random(4)
    out = [t for _, t in corpus.ODD]
    for k in range(60):
        t = corpus.words(rng, rng.randrange(0, 90))
        if k % 4 == 0:
            t = t + "\n" + " ".join(t.split()[:15]) + "\n \n" + t[:20] + "\n" + t[:20]
        if k % 5 == 0:
            t = t.replace(" ", " ##|| ", 9) + " é 漢"
        out.append(t)
    return out + ["a b c d e f g h a b c d e f g h " * 4]


def test_base_counts_equal_brute_force(spark):
    rows = list(enumerate(texts()))
    out = Q.score_quality(corpus.frame(spark, rows),
                          spark.createDataFrame([], "doc_id bigint, quality int, toxic int")).collect()
    got = {r.doc_id: ([r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words], r.base_failed)
           for r in out}
    assert got == {i: brute(t) for i, t in rows}
    assert all(r.kept == (not r.base_failed) for r in out)  # nothing to calibrate on


def labelled(spark, n=400):
    rng = random.Random(7)
    rows, marks = [], []
    for i in range(n):
        t = corpus.words(rng, 40 + rng.randrange(60), 3000)
        bad = i % 6 == 0
        if bad:
            t = (" ".join(w + rng.choice(["###", "%%%"]) for w in t.split()) if i % 4 else
                 t.upper().replace(" ", "!! "))
        rows.append((i, t))
        marks.append((i, 0 if bad else 1, 0))
    marks += [(None, 1, 0), (5, None, 0), (10**6, 0, 0)]
    return corpus.frame(spark, rows), spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int")


def test_anomalies_are_rejected_and_good_texts_stay(spark):
    docs, labels = labelled(spark)
    out = {r.doc_id: r.kept for r in Q.score_quality(docs, labels).collect()}
    good = [k for i, k in out.items() if i % 6]
    assert sum(good) >= 0.99 * len(good)
    assert sum(not k for i, k in out.items() if i % 6 == 0) >= 0.97 * (len(out) - len(good))
    kept = Q.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, k in out.items() if k}


def test_path_lengths_equal_a_recursive_walk():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 4))
    x[:, 3] = np.round(x[:, 3])
    f = Q.grow(x, 20, 64, 1)

    def walk(t, row):
        node = 0
        while f.feature[t, node] >= 0:
            low = row[f.feature[t, node]] < f.split[t, node]
            node = f.left[t, node] if low else f.right[t, node]
        return f.path[t, node]

    want = [2 ** (-np.mean([walk(t, r) for t in range(20)]) / f.norm) for r in x]
    assert np.allclose(f.score(x), want)
    far = f.score(np.array([[9.0, 9, 9, 9]]))[0]
    assert far > np.quantile(f.score(x), 0.98)


def test_empty_table(spark):
    _, labels = labelled(spark, 20)
    assert Q.score_quality(corpus.empty(spark), labels).count() == 0
    assert Q.keep_good(corpus.empty(spark), labels).count() == 0


def test_repeated_short_lines_between_unique_ones_are_rejected(spark):
    """The only fault of the bad texts; a single license line is none."""
    rng = random.Random(11)
    rows, marks = [], []
    for i in range(300):
        w = corpus.words(rng, 60, 5000).split()
        lines = [" ".join(w[k:k + 3]) for k in range(0, 60, 3)]
        bad = i % 5 == 0
        if bad:
            lines = [x for line in lines for x in (line, "Home page and contact")]
        elif i % 5 == 1:
            lines += ["all rights reserved"] * 2
        rows.append((i, "\n".join(lines)))
        marks.append((i, 0 if bad else 1, 0))
    docs = corpus.frame(spark, rows)
    labels = spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int")
    out = Q.score_quality(docs, labels).collect()
    assert not any(r.base_failed for r in out)
    kept = {r.doc_id: r.kept for r in out}
    assert not any(kept[i] for i in range(0, 300, 5))
    assert sum(kept.values()) >= 0.99 * 240


def test_long_texts_repeated_rows_and_clashing_columns(spark):
    docs, labels = labelled(spark, 120)
    long = " ".join(f"w{k}" for k in range(200_000))
    rows = [(9001, long), (9001, long), (9002, "one " * 100_000)]
    docs = docs.select("doc_id", "text").unionByName(
        spark.createDataFrame(rows, "doc_id bigint, text string")).selectExpr("*", "'k' AS kept", "1 AS anomaly")
    out = [(r.doc_id, r.n_words, r.kept) for r in Q.score_quality(docs, labels).collect() if r.doc_id > 9000]
    assert sorted(out)[0] == sorted(out)[1] and sorted(out)[0][1] == 200_000
    assert sorted(out)[2] == (9002, 100_000, False)
    kept = Q.keep_good(docs, labels)
    assert kept.columns == docs.columns and {r.kept for r in kept.collect()} == {"k"}


def test_all_labelled_rows_count(spark, monkeypatch):
    """Counts, ranges and the threshold follow every labelled row, however many there are."""
    rng = np.random.default_rng(2)
    n = 30_000  # more than any fixed sample took
    good = np.arange(n) % 5 > 0
    x = rng.normal(size=(n, 9)) * 0.1 + np.where(good, 0.0, 1.0)[:, None]
    x[777] = 50.0  # one far row of all: it makes the range
    failed = np.arange(n) % 11 == 0
    stats = spark.createDataFrame([(i, *[1] * 5, bool(failed[i]), *map(float, x[i])) for i in range(n)], Q._STATS)
    labels = spark.createDataFrame([(i, int(good[i])) for i in range(n)], "doc_id bigint, quality int")
    seen = []
    monkeypatch.setattr(Q, "weigh", lambda cuts, counts, psi, made=Q.weigh: (
        seen.append((cuts, counts)), made(cuts, counts, psi))[1])
    forest = Q.train(stats.repartition(5), labels, trees=10)
    cuts, counts = seen[0]
    assert (counts == cuts.counts(x[good & ~failed])).all()
    assert (counts.sum(axis=1) == (good & ~failed).sum()).all()
    again = Q.draw(x.min(axis=0), x.max(axis=0), 10, cuts.depth, 9)
    assert (again.split == cuts.split).all() and (again.feature == cuts.feature).all()
    step = Q.steps(forest.score(x[~failed]))
    at = np.unique(step)
    g, b = (np.array([np.sum((step == s) & (good[~failed] == y)) for s in at]) for y in (True, False))
    assert forest.threshold == Q.calibrate(at, g, b, 0.01)
    more = Q.train(stats, labels, trees=10)  # any partitions, the same forest
    assert more.threshold == forest.threshold and (more.path == forest.path).all()
