"""Operator 12: exact scores, recall against brute force, and the parts of the index."""

from __future__ import annotations

import numpy as np
import pytest

from stockbook.llm import multi_index as M

SCHEMA = "vec_id bigint, embedding array<float>, label int, rank int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1) for i, v in rows], SCHEMA)


def clustered(n=1500, dim=16, seed=2):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    x = centres[rng.integers(0, 12, n)] + 0.4 * rng.normal(size=(n, dim))
    return [(i, np.float32(v).astype(float).tolist()) for i, v in enumerate(x)]


def brute(rows, is_query, k=10):
    rows = [(i, np.array(v, float)) for i, v in rows
            if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    out = {}
    for i in sorted(set(ids[[is_query(i) for i in ids]].tolist())):
        q = min(v.tolist() for j, v in rows if j == i)
        d = np.sqrt(((x - np.array(q)) ** 2).sum(axis=1))
        keep = np.flatnonzero(ids != i)
        order = keep[np.lexsort((ids[keep], d[keep]))][:k]
        out[i] = [(int(ids[j]), float(d[j])) for j in order]
    return out


def result(df):
    out: dict[int, list] = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def recall(got, want):
    hit = sum(len({i for i, _ in got[q]} & {i for i, _ in w}) for q, w in want.items())
    return hit / sum(map(len, want.values()))


@pytest.mark.parametrize("options", [{}, {"block": 50, "query_block": 7}])
def test_recall_and_exact_scores(spark, options):
    rows = clustered()
    got = result(M.nearest_neighbours(frame(spark, rows), lambda i: i % 20 == 0, **options))
    want = brute(rows, lambda i: i % 20 == 0)
    assert got.keys() == want.keys() and recall(got, want) >= 0.9
    by_id = {i: np.array(v) for i, v in rows}
    for q, hits in got.items():
        assert len(hits) == 10 and hits == sorted(hits, key=lambda h: (h[1], h[0]))
        for i, score in hits:
            assert i != q and score == np.sqrt(((by_id[i] - by_id[q]) ** 2).sum())


def test_everything_is_found_when_all_cells_are_visited(spark):
    rows = clustered(300, 5)  # an odd length: the halves differ
    got = result(M.nearest_neighbours(frame(spark, rows), lambda i: i % 10 == 0, target=1.0))
    want = brute(rows, lambda i: i % 10 == 0)
    assert got == {q: [(i, pytest.approx(s, abs=0)) for i, s in w] for q, w in want.items()}


def test_odd_rows_ties_and_a_hot_cell(spark):
    one = [1.0, 0.5, 0.25, 0.125]
    rows = [(i, one) for i in range(200)]  # copies: a third and more of all rows in one cell
    rows += [(500 + i, [float(i), 1.0, -1.0, 2.0]) for i in range(60)]
    odd = [(900, None), (901, []), (902, [0.0] * 4), (903, [1.0, None, 2.0, 3.0]), (None, one),
           (1000, [float("nan")] * 4), (1100, [float("inf"), 1.0, 1.0, 1.0]), (1200, [1.0, 2.0])]
    rows += [(7, [9.0, 9.0, 9.0, 9.0])]  # repeats an id with another vector
    got = result(M.nearest_neighbours(frame(spark, rows + odd), lambda i: i % 100 == 0, block=16))
    assert set(got) == {0, 100, 500}
    assert got[0] == [(i, 0.0) for i in range(1, 11)] and got[100] == [(i, 0.0) for i in range(10)]
    repeated = [(100, [1.0, 1.0]), (100, [5.0, 5.0]), (1, [1.0, 2.0]), (2, [4.0, 5.0]), (1, [1.0, 1.0])]
    got = result(M.nearest_neighbours(frame(spark, repeated), lambda i: i % 100 == 0))
    assert got == {100: [(1, 0.0), (1, 1.0), (2, 5.0)]}


def test_empty_tables_and_no_query(spark):
    assert M.nearest_neighbours(frame(spark, []), lambda i: i % 100 == 0).count() == 0
    assert M.nearest_neighbours(frame(spark, [(1, None)]), lambda i: i % 100 == 0).count() == 0
    assert M.nearest_neighbours(frame(spark, clustered(50)), lambda i: i < 0).count() == 0
    alone = M.nearest_neighbours(frame(spark, [(100, [1.0, 2.0])]), lambda i: i % 100 == 0)
    assert alone.count() == 0


def test_traversal_visits_cells_in_order_of_summed_distances():
    rng = np.random.default_rng(4)
    for _ in range(20):
        d1, d2 = rng.random(rng.integers(1, 9)), rng.random(rng.integers(1, 9))
        counts = rng.integers(0, 3, (len(d1), len(d2)))
        cells = M.traverse(d1, d2, counts, counts.sum())
        sums = [d1[a] + d2[b] for a, b in cells]
        assert sums == sorted(sums)
        held = [(a, b) for a in range(len(d1)) for b in range(len(d2)) if counts[a, b]]
        assert len(cells) == len(set(cells)) and set(cells) <= set(held)
        assert sum(counts[c] for c in cells) == counts.sum()
        some = M.traverse(d1, d2, counts, 3)
        assert some == cells[:len(some)] and (sum(counts[c] for c in some) >= 3 or len(some) == len(cells))
