from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest

from stockbook.llm import radix_windows as W
from tests.llm import corpus


def brute(rows, depth):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[s:s + depth] for t in texts for s in range(len(t) - depth + 1))
    out = []
    for (i, _), t in zip(rows, texts, strict=True):
        gone = bytearray(len(t))
        for s in range(len(t) - depth + 1):
            if seen[t[s:s + depth]] > 1:
                gone[s:s + depth] = b"\1" * depth
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1]))
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def rows_with_passages():
    rng = random.Random(4)
    passage = [corpus.words(rng, 40) for _ in range(4)]
    rows = list(corpus.ODD) + [(920, "ab" * 900), (921, "é" * 700)]
    for i in range(40):
        parts = [corpus.words(rng, rng.randrange(1, 60))]
        for p in passage:
            if rng.random() < 0.3:
                cut = rng.randrange(0, 40)
                parts += [p[cut:len(p) - rng.randrange(0, 40)], corpus.words(rng, rng.randrange(1, 8))]
        rows.append((i, " ".join(parts)))
    rows += [(50, rows[15][1]), (51, rows[15][1]), rows[16], (52, rows[17][1] + " " + rows[17][1])]
    return rows


@pytest.mark.parametrize("depth,digit", [(400, 160), (120, 48), (30, 12)])
def test_equals_brute_force(spark, depth, digit):
    rows = rows_with_passages()
    out = W.remove_repeats(corpus.frame(spark, rows), depth, digit)
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out.collect()),
                 key=str)
    assert got == brute(rows, depth)


def test_blocks_of_a_long_text(spark, monkeypatch):
    """Texts longer than a block: the cut must not change the result."""
    rng = random.Random(6)
    long = corpus.words(rng, 50_000)
    rows = [(1, long), (2, corpus.words(rng, 30) + long[200_000:290_000]), (3, corpus.words(rng, 90))]
    out = {r.doc_id: (r.n_removed, r.n_spans) for r in W.remove_repeats(corpus.frame(spark, rows)).collect()}
    assert out == {1: (90_000, 1), 2: (90_000, 1), 3: (0, 0)} or (
        out[1][0] >= 90_000 and out[1][1] == 1 and out[1][0] == out[2][0])


def test_empty_table(spark):
    assert W.remove_repeats(corpus.empty(spark)).count() == 0
