from __future__ import annotations

import hashlib
import random
from collections import defaultdict

from stockbook.llm import line_runs as L
from tests.llm import corpus


def brute(rows, min_chars=40, min_docs=5):
    white = " \t\n\x0b\x0c\r"
    low = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    docs = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            k = line.strip(white).translate(low)
            if len(k) >= min_chars and i is not None:
                docs[k].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (
            i is not None and len(docs[k := x.strip(white).translate(low)]) >= min_docs
            and i != max(docs[k]))]
        out.append((i, len(lines), len(lines) - len(kept),
                    hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def rows_with_shared_lines():
    rng = random.Random(3)
    shared = [corpus.words(rng, 12) for _ in range(6)] + ["Ünï " * 12, "x" * 39, "y" * 40]
    rows = list(corpus.ODD)
    for i in range(60):
        part = [corpus.words(rng, 10)]
        for k, s in enumerate(shared):
            if rng.random() < (k + 1) / 12:
                part.append(rng.choice([s, s.upper(), "  " + s + "\t\r"]))
        rng.shuffle(part)
        rows.append((i, "\n".join(part)))
    rows.append((7, rows[9][1]))  # repeats an id with another text
    rows.append(rows[10])
    return rows


def got(df):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in df.collect()), key=str)


def test_equals_brute_force(spark):
    rows = rows_with_shared_lines()
    for batches in (1, 3, 5):
        assert got(L.dedup_lines(corpus.frame(spark, rows), batches=batches)) == brute(rows)


def test_runs_are_compacted_and_keys_are_in_one_run(spark):
    store = L.LineRuns(spark, fanout=2)
    for b in range(5):
        store.add(spark.range(b * 10, b * 10 + 30).selectExpr("id AS h1", "id AS h2", f"{9 - b} AS doc_id"))
    assert all(len(level) < 2 for level in store.levels) and len(store.levels) > 1
    runs = store.runs()
    assert runs.count() == runs.select("h1").distinct().count() == 70
    n = {r.h1: r.n_docs for r in store.frequent(1).collect()}
    assert n[0] == 1 and n[25] == 3 and n[69] == 1


def test_drop_lines_keeps_columns_and_nulls(spark):
    rows = rows_with_shared_lines()
    docs = corpus.frame(spark, rows)
    out = L.drop_lines(docs)
    assert out.schema.names == docs.schema.names and out.count() == len(rows)
    by = {r.doc_id: r for r in out.collect()}
    assert by[901].text is None and by[902].text == ""
    assert all(r.n_chars == len(r.text) for r in out.collect() if r.text is not None)


def test_empty_table(spark):
    assert L.dedup_lines(corpus.empty(spark)).count() == 0


def test_columns_named_like_helpers_pass_through(spark):
    line = "a line of more than forty characters that many documents share"
    rows = [(k, f"own {k}\n{line}", f"d{k}", k, "x", 1) for k in range(6)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, drops string, drop_id long, "
                                       "drop_row string, n_lines int")
    out = {r.doc_id: r for r in L.drop_lines(docs).collect()}
    assert L.drop_lines(docs).columns == docs.columns
    assert [out[k].text for k in range(6)] == [*(f"own {k}" for k in range(5)), f"own 5\n{line}"]
    assert all((out[k].drops, out[k].drop_id, out[k].drop_row, out[k].n_lines) == (f"d{k}", k, "x", 1)
               for k in range(6))


def test_very_long_texts(spark):
    line = "b" * 50
    long = "\n".join([line, *(f"{k} " + "c" * 60 for k in range(20_000)), "x" * 300_000])
    docs = spark.createDataFrame([(k, long if k == 0 else line) for k in range(5)], "doc_id bigint, text string")
    got = {r.doc_id: (r.n_lines, r.n_dropped) for r in L.dedup_lines(docs).collect()}
    assert got == {0: (20_002, 1), 1: (1, 1), 2: (1, 1), 3: (1, 1), 4: (1, 0)}
