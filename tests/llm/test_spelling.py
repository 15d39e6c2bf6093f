"""Operator 13 against brute force over deletion neighbourhoods."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest

from stockbook.llm import spelling

LOWER = {a: a + 32 for a in range(65, 91)}


def brute(rows):
    count: Counter = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = run.translate(LOWER)
            h = crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if h % 97 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            count[w] += 1
    words = {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}
    holes = defaultdict(set)
    for w in words:
        for i in range(len(w)):
            holes[i, w[:i] + "*" + w[i + 1:]].add(w)
    near = {w: set() for w in words}
    for group in holes.values():
        for w in group:
            near[w] |= group - {w}
    for w in words:
        for i in range(len(w)):
            v = w[:i] + w[i + 1:]
            if v in words:
                near[w].add(v)
                near[v].add(w)
    form = {}
    for w, others in near.items():
        if others:
            best = min(others, key=lambda v: (-words[v], v))
            if words[best] >= 2 * words[w]:
                form[w] = best
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), words[form[w]] if w in form else None))
    return sorted(out)


def result(df):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect())


def text_rows(seed=5, docs=40):
    rng = random.Random(seed)
    bases = ["".join(rng.choice("aeinrstloéü") for _ in range(rng.randint(4, 9))) for _ in range(60)]
    rows = []
    for i in range(docs):
        words = []
        for _ in range(150):
            w = rng.choice(bases)
            if rng.random() < 0.3:
                p = rng.randrange(len(w))
                w = rng.choice([w[:p] + w[p + 1:], w[:p] + "e" + w[p:], w[:p] + "s" + w[p + 1:]])
            words.append(w.title() if rng.random() < 0.1 else w)
        rows.append((i, rng.choice([" ", ", ", "\n", "1"]).join(words)))
    return rows


@pytest.mark.parametrize("block, tile", [(1024, 2048), (40, 30), (10_000, 5)])
def test_equals_brute_force(spark, block, tile):
    """One block; blocks dealt again by other letters; tiles."""
    rows = text_rows()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = brute(rows)
    assert len(want) > 200 and sum(r[1] is not None for r in want) > 50
    assert result(spelling.variants(docs, block=block, tile=tile)) == want


def test_nulls_repeats_long_texts_and_other_columns(spark):
    long = "ba" * 3000
    rows = [(1, None), (2, ""), (None, "Woodland woodland woodland"), (3, "woodlands " * 4), (3, "woodlands"),
            (4, f"{long} {long} {long} {long}c {long}c {long}c"), (5, "Étés×÷ " * 3), (6, "-- 12 中文")]
    docs = spark.createDataFrame([(a, b, "x", 1) for a, b in rows],
                                 "doc_id bigint, text string, word string, n int")
    assert result(spelling.variants(docs)) == brute(rows)


def test_ties_take_the_smallest_word(spark):
    rows = [(1, "carts " * 3 + "parts " * 9 + "darts " * 9)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.word: r.form for r in spelling.variants(docs).collect()}
    assert got == {r[0]: r[1] for r in brute(rows)} and got["carts"] == "darts"


def test_chains_lead_to_a_root(spark):
    steps = ["aaaaab", "aaaabb", "aaabbb", "aabbbb", "abbbbb"]
    rows = [(1, " ".join(w for k, w in enumerate(steps) for _ in range(3 * 2 ** k)))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = result(spelling.variants(docs))
    assert got == brute(rows) and {r[2] for r in got} == {"abbbbb"}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert result(spelling.variants(docs)) == []


def test_one_edit():
    def at(*words):
        return np.array([list(w.encode()) for w in words], np.uint8)

    assert spelling.one_edit(at("abc", "abc", "abc"), at("abd", "abc", "bac")).tolist() == [True, False, False]
    assert spelling.one_edit(at("abc", "abc", "aab", "abc"), at("xabc", "abcx", "aaab", "acbx")).tolist() == [
        True, True, True, False]


@pytest.mark.parametrize("group", [0, 5, 10**6])
def test_groups_compare_only_words_that_can_be_near(monkeypatch, group):
    """Every near pair is found at any group size, and few others are compared."""
    rng = np.random.default_rng(5)
    words = sorted({bytes(rng.choice(list(b"abcdefgh"), rng.integers(5, 9)).tolist()) for _ in range(1500)})
    monkeypatch.setattr(spelling, "GROUP", group)
    made, compared = spelling._candidates, []
    monkeypatch.setattr(spelling, "_candidates", lambda counts, at, size: (
        compared.append(int((np.bincount(at) ** 2).sum())), made(counts, at, size))[1])
    sets = spelling.LetterSets(spelling.letter_counts(words).sum(axis=0))
    got = set()
    for s in range(spelling.SETS):
        i, j = spelling.near_pairs(words, None, sets.levels((s,)))
        pairs = {frozenset((words[a], words[b])) for a, b in zip(i.tolist(), j.tolist(), strict=True)}
        assert len(pairs) == len(i) and not pairs & got
        got |= pairs
    known = set(words)
    want = set()
    for w in words:
        edits = {w[:k] + w[k + 1:] for k in range(len(w))}
        edits |= {w[:k] + bytes([c]) + w[k + 1:] for k in range(len(w)) for c in b"abcdefgh"}
        want |= {frozenset((w, e)) for e in edits & known if e != w}
    assert got == want and want
    assert sum(compared) < 0.3 * spelling.SETS * len(words) ** 2


@pytest.mark.parametrize("group", [0, 128])
def test_halves_compare_few_words_of_common_letter_counts(spark, monkeypatch, group):
    """Words of the same few letters: every near pair is found once, few others are compared."""
    rng = np.random.default_rng(8)
    words = sorted({bytes(rng.choice(list(b"abcdefgh"), rng.integers(5, 10)).tolist()) for _ in range(1500)})
    rows = spark.createDataFrame([(w.decode(), 3) for w in words], "word string, n bigint")
    placed = spelling._halved(rows, 1).collect()
    assert len(placed) == 3 * len(words) and {r.block for r in placed} == {0}
    monkeypatch.setattr(spelling, "GROUP", group)
    made, compared = spelling._candidates, []
    monkeypatch.setattr(spelling, "_candidates", lambda counts, at, *rest: (
        compared.append(int((np.bincount(at) ** 2).sum())), made(counts, at, *rest))[1])
    got = []
    for half in range(spelling.HALVES):
        here = [(r.word.encode(), r.part) for r in placed if r.path == half]
        i, j = spelling.near_pairs([w for w, _ in here], None, [], half, np.array([p for _, p in here]))
        got += [frozenset((here[a][0], here[b][0])) for a, b in zip(i.tolist(), j.tolist(), strict=True)]
    known, want = set(words), set()
    for w in words:
        edits = {w[:k] + w[k + 1:] for k in range(len(w))}
        edits |= {w[:k] + bytes([c]) + w[k + 1:] for k in range(len(w)) for c in b"abcdefgh"}
        want |= {frozenset((w, e)) for e in edits & known if e != w}
    assert len(got) == len(set(got)) and set(got) == want and want
    assert sum(compared) < 0.1 * len(words) ** 2
