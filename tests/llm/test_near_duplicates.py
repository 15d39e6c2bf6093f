from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from stockbook.llm import dart_minhash as M
from tests.llm import corpus


def brute(rows, share=0.8):
    """Smallest id of each connected component of weighted Jaccard >= share."""
    sets = {i: Counter(M.shingles(t.encode() if t else None).tolist()) for i, t in rows if i is not None}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                low = sum((sets[a] & sets[b]).values())
                if low >= share * (sum(sets[a].values()) + sum(sets[b].values()) - low) - 1e-9:
                    parent[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in ids}


def edited(rng, text, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10 ** 6)}"
    return " ".join(w)


def rows_with_copies():
    rng = random.Random(5)
    rows = list(corpus.ODD) + [(910, "!!! ### ???"), (911, "One two, three FOUR.")]
    at = 0
    for n in (60, 120, 300):
        base = corpus.words(rng, n)
        rows += [(at, base), (at + 1, base), (at + 2, base.upper())]
        at += 3
        for edits in range(1, 9):
            rows.append((at, edited(rng, base, edits)))
            at += 1
        chain = base
        for _ in range(6):
            chain = edited(rng, chain, max(1, n // 60))
            rows.append((at, chain))
            at += 1
    rows += [(at + k, corpus.words(rng, 80)) for k in range(20)]
    return rows


def test_equals_brute_force(spark):
    rows = rows_with_copies()
    got = {r.doc_id: r.class_id for r in M.near_duplicates(corpus.frame(spark, rows)).collect()}
    assert got.pop(None) is None
    assert got == brute(rows)


def test_many_near_copies_are_one_class_without_all_pairs(spark):
    rng = random.Random(8)
    base = corpus.words(rng, 200)
    rows = [(i, edited(rng, base, 1)) for i in range(150)]
    out = M.near_duplicates(corpus.frame(spark, rows))
    assert {r.class_id for r in out.collect()} == {0}


def scattered(rng, n=90):
    """Copies of one text with few to many edits: some are alone, the others one class."""
    base = corpus.words(rng, 120)
    return [(i, edited(rng, base, rng.randrange(0, 9))) for i in range(n)]


@pytest.mark.parametrize("small,block", [(32, 256), (2, 7), (10**6, 5)])
def test_groups_in_blocks_or_by_pairs(spark, monkeypatch, small, block):
    monkeypatch.setattr(M, "SMALL", small)
    monkeypatch.setattr(M, "BLOCK", block)
    rows = scattered(random.Random(12))
    got = {r.doc_id: r.class_id for r in M.near_duplicates(corpus.frame(spark, rows)).collect()}
    assert got == brute(rows)
    assert 1 < len(set(got.values())) < len(rows)


def test_dissimilar_nodes_of_a_bucket_are_all_compared(spark):
    """Two pairs that share a bucket with a foreign pivot must still be linked."""
    rng = random.Random(2)
    common = corpus.words(rng, 60)
    rows = []
    for k in range(12):
        own = corpus.words(rng, 12)
        rows += [(3 * k, common + " " + own), (3 * k + 1, common + " " + own + " tail"),
                 (3 * k + 2, corpus.words(rng, 3) + " " + common + " " + own)]
    got = {r.doc_id: r.class_id for r in M.near_duplicates(corpus.frame(spark, rows)).collect()}
    assert got == brute(rows)


def brute_of_texts(rows):
    """As ``brute``, with the rows of an id as one document that has all their texts."""
    class_of = brute([(k, t) for k, (_, t) in enumerate(rows)])
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, _) in enumerate(rows):
        a, b = find(i), find(rows[class_of[k]][0])
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in parent}


def rows_that_repeat_ids():
    rng = random.Random(31)
    first, third = corpus.words(rng, 104), corpus.words(rng, 80)
    rows = [(7, first), (7, corpus.words(rng, 204)), (3, edited(rng, first, 1)),  # text 1 of 7 is near 3
            (20, third), (21, third), (21, corpus.words(rng, 50)),  # 21 has a copy of 20, and is not smallest
            (19, "x " + third + " y"), (19, None), (19, ""), (30, None), (30, None)]
    meet = [corpus.words(rng, 90) for _ in range(2)]  # 42 has both, the smallest ids are others
    rows += [(40, meet[0]), (41, meet[1]), (42, meet[0]), (42, meet[1]), (42, meet[1])]
    rows += [(50, corpus.words(rng, 70)) for _ in range(6)]  # only its own texts
    rows += [(60 + k, edited(rng, rows[-1][1], 1)) for k in range(3)]
    return rows


@pytest.mark.parametrize("small,block", [(32, 256), (2, 7)])
def test_ids_with_different_texts(spark, monkeypatch, small, block):
    monkeypatch.setattr(M, "SMALL", small)
    monkeypatch.setattr(M, "BLOCK", block)
    rows = rows_that_repeat_ids()
    rng = random.Random(6)
    rows += [(100 + i % 40, t) for i, (_, t) in enumerate(scattered(rng, 70))]
    docs = corpus.frame(spark, rows)
    got = M.near_duplicates(docs).select("doc_id", "class_id").collect()
    want = brute_of_texts(rows)
    assert sorted((r.doc_id, r.class_id) for r in got) == sorted((i, want[i]) for i, _ in rows)
    assert want[7] == 3 and want[42] == 40 and want[41] == 40
    kept = sorted(r.doc_id for r in M.keep_one(docs).collect())
    assert kept == sorted(i for i, _ in rows if want[i] == i)


def test_salt_of_open_entries_is_made_of_their_values(spark, monkeypatch):
    """Rows of a hot bucket that come out of a shuffle keep their salt in a repeated task."""
    plans, write = [], M.stored

    def watched(df, label):
        plans.append((label, df._jdf.queryExecution().optimizedPlan().toString()))
        return write(df, label)

    monkeypatch.setattr(M, "stored", watched)
    members = spark.range(300).selectExpr("id as node", "0 as band", "7L as h", "100 as n", "0L as u")
    labels = spark.range(300).selectExpr("id as node", "id as comp")
    live = M._open(members, labels, 8)
    assert sorted(r.node for r in live.collect()) == list(range(300))
    plan = dict(plans)["dart-open"]
    assert "__salt" in plan and "monotonically_increasing_id" not in plan


def test_block_gives_fewer_links_than_nodes():
    """Near copies that are all components of their own: no row for each pair."""
    import pandas as pd

    sets = [np.append(np.arange(100, dtype=np.int32), np.int32(1000 + k)) for k in range(40)]
    sets += [np.append(np.arange(200, 300, dtype=np.int32), np.int32(1000 + k)) for k in range(40, 60)]
    group = pd.DataFrame({"node": range(60), "comp": range(60), "block": 0, "regions": sets})
    out = M._block_links(group, 8)
    assert len(out) == 39 + 19 and (out.a < out.b).all()
    assert set(zip(out.a >= 40, out.b >= 40, strict=True)) == {(False, False), (True, True)}
    near = np.zeros((60, 60), bool)
    near[out.a, out.b] = near[out.b, out.a] = True
    assert len(M.spanning(near)[0]) == 58
    two = group.assign(block=[k % 2 for k in range(60)])
    assert len(M._block_links(two, 8)) == 58


def test_signature_agreement_estimates_weighted_similarity():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**63, 300).astype(np.uint64)
    wx, wy = rng.uniform(0.2, 3, 300), rng.uniform(0.2, 3, 300)
    k = 2048
    a, b = (M.dart_signature(*M.regions(x, w), k) for w in (wx, wy))
    true = np.minimum(wx, wy).sum() / np.maximum(wx, wy).sum()
    assert abs((a == b).mean() - true) < 0.04


def test_signature_of_one_region_and_of_many():
    for n in (1, 2, 5000):
        s = M.dart_signature(*M.regions(np.arange(n, dtype=np.uint64)), 96)
        assert len(s) == 96 and len(set(s.tolist())) == 96


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a bigint, b bigint")
    got = {r.node: r.comp for r in M.components(links).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}


def test_keep_one_and_empty_table(spark):
    rows = rows_with_copies()
    docs = corpus.frame(spark, rows)
    kept = M.keep_one(docs)
    want = {i for i, c in brute(rows).items() if i == c}
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == docs.columns and set(ids) - {None} == want and ids.count(None) == 1
    assert M.near_duplicates(corpus.empty(spark)).count() == 0
    assert M.keep_one(corpus.empty(spark)).count() == 0


def test_columns_named_like_helpers_pass_through(spark):
    text = " ".join(f"word{k}" for k in range(60))
    rows = [(k, text if k < 3 else f"own text number {k} with more words", f"i{k}", k, "s") for k in range(6)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, __id string, __at long, __salt string")
    kept = M.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r["__id"], r["__at"], r["__salt"]) for r in kept.collect()) == [
        (k, f"i{k}", k, "s") for k in (0, 3, 4, 5)]
