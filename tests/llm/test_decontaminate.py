from __future__ import annotations

import hashlib
import random
import re

from stockbook.llm import decontaminate as D
from tests.llm import corpus

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    windows = {}
    for i, t in items:
        w = split(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k:k + 10]), set()).add("" if i is None else str(i))
    out = []
    for d, t in docs:
        w, hit, found = split(t), set(), set()
        for win, ids in windows.items():
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k:k + len(win)]) == win:
                    hit.update(range(k, k + len(win)))
                    found |= ids
        out.append((d, len(w), len(hit), len(found),
                    hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def data():
    rng = random.Random(9)
    items = [(k, corpus.words(rng, n, 60)) for k, n in enumerate((3, 9, 10, 11, 25, 60))]
    items += [(7, None), (8, ""), (9, "?!"), (None, corpus.words(rng, 12)), (4, items[4][1]), (10, "Été déjà")]
    docs = list(corpus.ODD) + [(930, "an ÉTÉ déjà vu, Été DÉJÀ"), (931, "été_déjà")]
    for i in range(40):
        parts = [corpus.words(rng, rng.randrange(0, 20), 60)]
        for _, t in items:
            if t and rng.random() < 0.2:
                w = t.split()
                a = rng.randrange(0, max(1, len(w) - 9))
                parts += [", ".join(w[a:a + rng.randrange(5, 30)]).upper(), corpus.words(rng, 4, 60)]
        docs.append((i, "\n".join(parts)))
    return docs, items


def bench(spark, items):
    return spark.createDataFrame(items, "item_id bigint, text string")


def test_equals_brute_force(spark):
    docs, items = data()
    out = D.contamination(corpus.frame(spark, docs), bench(spark, items))
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated)
                  for r in out.collect()), key=str)
    assert got == brute(docs, items)


def test_spans_point_into_the_original(spark):
    text = "Intro -- The  quick, BROWN fox!\njumps over the lazy dog today; outro"
    item = "the quick brown fox jumps over the lazy dog today"
    out = D.contamination(corpus.frame(spark, [(1, text)]), bench(spark, [(1, item)])).first()
    a, b = out.spans[0].start, out.spans[0].end
    assert text.encode()[a:b].decode() == "The  quick, BROWN fox!\njumps over the lazy dog today"


def test_filter_and_empty_tables(spark):
    docs, items = data()
    frame = corpus.frame(spark, docs)
    kept = D.keep_clean(frame, bench(spark, items))
    assert kept.columns == frame.columns
    assert kept.count() == sum(not r[-1] for r in brute(docs, items))
    assert D.keep_clean(frame, bench(spark, [])).count() == len(docs)
    assert D.contamination(corpus.empty(spark), bench(spark, items)).count() == 0


def test_a_benchmark_in_many_blocks(spark):
    """Blocks far smaller than the benchmark: hits and items of all blocks count."""
    docs, items = data()
    frame, items_df = corpus.frame(spark, docs), bench(spark, items)
    assert len(D.write_windows(items_df, block_bytes=400)) > 5
    out = D.contamination(frame, items_df, block_bytes=400)
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated)
                  for r in out.collect()), key=str)
    assert got == brute(docs, items)
    one = {r.doc_id: r.spans for r in D.contamination(frame, items_df).collect()}
    assert {r.doc_id: r.spans for r in out.collect()} == one
    kept = D.keep_clean(frame, items_df, block_bytes=2000)
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(
        str(r[0]) for r in brute(docs, items) if not r[-1])


def test_very_long_texts_and_clashing_columns(spark):
    words = [f"w{k % 977}x{k % 13}" for k in range(120_000)]
    text, item = " ".join(words), " ".join(words[70_000:70_012])
    rows = [(1, text), (1, text), (2, " ".join(words[:50_000]))]
    frame = corpus.frame(spark, rows).selectExpr("*", "1 AS spans", "2 AS n_hit", "'x' AS items")
    got = sorted((r.doc_id, r.n_words, r.n_hit > 0) for r in D.contamination(frame, bench(spark, [(5, item)])).collect())
    assert got[0] == got[1] == (1, 120_000, True)
    assert D.keep_clean(frame, bench(spark, [(5, item)])).columns == frame.columns
