from __future__ import annotations

import random
import zlib

import numpy as np

from stockbook.llm import toxicity as T
from tests.llm import corpus


def best_by_brute(scores):
    """All maximal scoring segments by repeated search (Ruzzo and Tompa's definition)."""
    def search(a, b):
        best = None
        for i in range(a, b):
            total = 0.0
            for j in range(i, b):
                total += scores[j]
                if total > 1e-12 and (best is None or total > best[2] + 1e-12):
                    best = (i, j, total)
        if best is None:
            return []
        return search(a, best[0]) + [best] + search(best[1] + 1, b)

    return search(0, len(scores))


def test_segments_equal_recursive_search():
    rng = random.Random(2)
    for _ in range(300):
        s = np.array([rng.choice([-1.3, -0.7, -0.2, 1.1, 2.7, 0.4]) + rng.random() * 1e-3
                      for _ in range(rng.randrange(0, 25))])
        got = [(a, b, round(x, 6)) for a, b, x in T.text_segments(s)]
        assert got == [(a, b, round(x, 6)) for a, b, x in best_by_brute(s.tolist())]


def data(spark, n=600):
    rng = random.Random(3)
    rows, marks = [], []
    for i in range(n):
        w = corpus.words(rng, 30 + rng.randrange(120), 4000).split()
        bad = i % 5 == 0
        if bad:
            at = rng.randrange(len(w))
            for _ in range(4):
                w.insert(at + rng.randrange(3), rng.choice(["vilea", "vileb", "vilec", "Nasty"]))
        rows.append((i, " ".join(w)))
        marks.append((i, 1, int(bad)))
    marks += [(None, 1, 1), (10**6, 1, 1), (3, 1, None), (4, 1, 0)]
    return corpus.frame(spark, rows + corpus.ODD), spark.createDataFrame(
        marks, "doc_id bigint, quality int, toxic int")


def test_held_out_documents(spark):
    docs, labels = data(spark)
    out = {r.doc_id: r for r in T.score_held_out(docs, labels).collect()}
    held = [i for i, r in out.items() if r.held_out and i < 600]
    for i, r in out.items():
        assert r.held_out == (i is not None and zlib.crc32(str(i).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    assert len(held) > 100
    assert all(out[i].predicted == (i % 5 == 0) for i in held)
    assert out[901].predicted == out[902].predicted == 0


def test_passages_point_at_the_words(spark):
    docs, labels = data(spark)
    model = T.train(docs, labels)
    text = "Quite fine words here. VILEA vileb, nasty! and calm again for long " + "fine " * 50
    r = T.score_toxicity(corpus.frame(spark, [(1, text)]), model).first()
    spans = [text.encode()[p.start:p.end].decode() for p in r.passages]
    assert spans == ["VILEA vileb, nasty"] and r.predicted == 1


def test_no_labels_and_empty_table(spark):
    docs, labels = data(spark, 40)
    none = T.score_held_out(docs, labels.where("toxic = 0")).collect()
    assert {r.score for r in none} == {0.0}
    assert T.score_held_out(corpus.empty(spark), labels).count() == 0


def test_lambda_solves_its_equation():
    s, p = np.array([-0.5, 2.0, 4.0]), np.array([0.97, 0.02, 0.01])
    lam = T.solve_lambda(s, p)
    assert abs(float(p @ np.exp(lam * s)) - 1) < 1e-6


def test_null_model_without_positive_clean_tokens():
    """Scores that no clean token has are rare, not impossible."""
    places, weights = T.null_model({-0.25: 1000}, {-0.25: 50, 1.0: 6, 3.0: 2})
    assert weights[places > 0].sum() == 1.0 and weights[places < 0].sum() == 1000
    lam = T.solve_lambda(places, weights)
    assert lam > 1.5 and abs(float(weights @ np.exp(lam * places)) / weights.sum() - 1) < 1e-6
    assert T.null_model({-0.25: 3}, {-0.25: 1})[0].tolist() == [-0.25]


def test_k_is_the_maximum_likelihood_value():
    rng = np.random.default_rng(5)
    lam, k = 1.3, 0.04
    n = rng.integers(20, 400, 4000)
    best = (np.log(k * n) - np.log(-np.log(rng.random(4000)))) / lam
    least = 0.5  # smaller best segments are not seen
    seen = [(int(a), float(b) if b >= least else 0.0) for a, b in zip(n, best, strict=True)]
    assert 0 < sum(b == 0 for _, b in seen) < 4000
    assert abs(T.solve_k(lam, seen, least) / k - 1) < 0.06
    assert T.solve_k(lam, [(100, 0.0)], least) > 0 and T.solve_k(lam, [], least) == 1.0


def test_the_largest_label_of_near_copies_counts(spark):
    text = "one and the same text of more than five words in all"
    docs = corpus.frame(spark, [(1, text), (2, text), (3, "another text that has other words in it")])
    labels = spark.createDataFrame([(1, 1, 1), (2, 1, 0), (3, 1, 0)], "doc_id bigint, quality int, toxic int")
    got = {bytes(r.text).decode()[:3]: r.y for r in T._sample(docs, labels, None, 100).collect()}
    assert got == {"one": 1, "ano": 0}


def test_long_texts_repeated_rows_and_clashing_columns(spark):
    docs, labels = data(spark, 200)
    long = " ".join(f"w{k % 3999}x{k % 9}" for k in range(150_000))
    rows = [(9001, long), (9001, long), (9002, f"{long} vilea vileb nasty vilec vilea")]
    docs = docs.select("doc_id", "text").unionByName(
        spark.createDataFrame(rows, "doc_id bigint, text string")).selectExpr(
        "*", "'s' AS score", "1 AS predicted", "'p' AS passages", "2 AS y")
    out = [r for r in T.score_held_out(docs, labels).collect() if (r.doc_id or 0) > 9000]
    score = sorted((r.doc_id, r.score) for r in out)
    assert len(score) == 3 and score[0] == score[1] and score[2][1] > score[0][1]
