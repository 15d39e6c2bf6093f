"""Operator 11 against a plain scoring of all documents."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from stockbook.llm import ball_tree as B
from tests.llm import corpus

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {a: a + 32 for a in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=10):
    counted = [(i, Counter(terms(t))) for i, t in docs]
    n_docs = sum(bool(c) for _, c in counted)
    total = sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        found = []
        for doc, c in counted:
            n = sum(c.values())
            score = 0
            for t in set(terms(text)):
                if c[t]:
                    m = 10 + 90 * n * n_docs // total
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * (10**9 * c[t] // (1000 * c[t] + 8 * m))
            if score > 0:
                found.append((-score, doc is not None, doc or 0, doc))
        out += [(item, r + 1, doc, -s) for r, (s, _, _, doc) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def result(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=str)


def data(n=300, seed=3):
    rng = random.Random(seed)
    docs = [*corpus.ODD, *((i, corpus.words(rng, rng.randrange(0, 90), 60)) for i in range(n))]
    docs += [(1000 + i, docs[30][1]) for i in range(40)]  # copies: equal scores
    docs += [(77, docs[31][1]), (77, docs[31][1]), (88, "Été ÉTÉ w1x1 " * 3)]
    items = [(i, corpus.words(rng, rng.randrange(1, 25), 60)) for i in range(25)]
    items += [(30, docs[30][1]), (31, None), (32, ""), (33, "?!"), (34, "nowhere found"), (35, "W1X1 w1x1 été"),
              (3, "w5x5 w6x6")]
    return docs, items


def bench(spark, items):
    return spark.createDataFrame([(i, t, 9) for i, t in items], "item_id bigint, text string, rank int")


@pytest.mark.parametrize("options", [{}, {"subtree": 7, "sample": 16}, {"subtree": 40, "sample": 1},
                                     {"max_items": 4}, {"max_terms": 30}])
def test_equals_plain_scoring(spark, options):
    """Any deal, sample and block size gives the ten best of every item."""
    docs, items = data()
    got = result(B.search(corpus.frame(spark, docs), bench(spark, items), **options))
    assert got == brute(docs, items)


def sparse(rng, rows=200, width=30):
    term, value, start = [], [], [0]
    for _ in range(rows):
        t = np.sort(rng.choice(width, rng.integers(0, 9), replace=False))
        term.append(t)
        value.append(rng.integers(1, 10**9, len(t)))
        start.append(start[-1] + len(t))
    return B.Sparse(list(range(rows)), np.concatenate(term), np.concatenate(value), np.array(start))


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(1)
    docs = sparse(rng)
    items = B.Items(list(range(20)), {}, np.concatenate([np.sort(rng.choice(40, 6, replace=False)) for _ in range(20)]),
                    np.arange(0, 126, 6))
    tree = B.BallTree(docs, leaf=4)
    bounds = tree.bounds(items)
    for i in range(20):
        wanted = np.zeros(len(tree.terms), bool)
        term = items.term[items.start[i]:items.start[i + 1]]
        wanted[np.isin(tree.terms, term)] = True
        score = B.item_scores(tree.docs, wanted)
        for node, (lo, hi) in enumerate(tree.span):
            assert bounds[node, i] >= score[lo:hi].max(initial=0)
        got = tree.search(bounds[:, i], wanted, 0, 5)
        want = sorted(((int(s), d) for s, d in zip(score, tree.docs.ids, strict=True) if s > 0),
                      key=lambda x: (-x[0], x[1]))[:5]
        assert got == want
        # a threshold leaves out what is below it and nothing else
        if len(want) == 5:
            least = want[2][0]
            assert tree.search(bounds[:, i], wanted, least, 5) == [x for x in want if x[0] >= least]
    inner = [k for k, c in enumerate(tree.children) if c]
    assert inner and sorted(sum((list(tree.children[k]) for k in inner), [])) == list(range(1, len(tree.span)))


def test_equal_documents_make_a_shallow_tree():
    docs = B.Sparse(list(range(1000)), np.tile([1, 5], 1000), np.tile([3, 4], 1000), np.arange(0, 2001, 2))
    tree = B.BallTree(docs)
    assert len(tree.span) < 200 and max(hi - lo for k, (lo, hi) in enumerate(tree.span)
                                        if not tree.children[k]) <= B.LEAF


def test_empty_tables_and_long_texts(spark):
    docs, items = data(60)
    assert B.search(corpus.empty(spark), bench(spark, items)).count() == 0
    assert B.search(corpus.frame(spark, docs), bench(spark, [])).count() == 0
    assert B.search(corpus.frame(spark, [(1, None), (2, " ")]), bench(spark, items)).count() == 0
    long = [(1, "w1x1 " * 300_000 + "w2x2"), (2, "w1x1 w2x2 w3x3"), (3, "w9x1")]
    items = [(1, "w2x2"), (2, "w1x1 " * 100_000)]
    assert result(B.search(corpus.frame(spark, long), bench(spark, items))) == brute(long, items)
