"""The queries and the pipeline on the smallest test tables, against brute force and DuckDB."""

from __future__ import annotations

import os

import duckdb
import pytest

import corpus_pipeline as C
from stockbook.llm.common import table
from stockbook.llm.oracle import ORACLE
from stockbook.llm.queries import QUERIES
from tests.llm.test_decontaminate import brute as brute_hits
from tests.llm.test_line_runs import brute as brute_lines
from tests.llm.test_near_duplicates import brute as brute_classes

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")


def test_ten_queries_are_registered():
    assert sorted({int(k[2:].split("_")[0]) for k in QUERIES}) == list(range(1, 11))
    assert set(ORACLE) <= set(QUERIES)
    import __spark_entry__ as e

    assert set(QUERIES) | {"pipeline"} <= set(e.queries())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({ORACLE[name]})").fetchall()
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_gives_a_row_for_each_input_row(spark, name):
    of = "pages" if name.startswith("op3") else "documents"
    assert QUERIES[name](spark, SF).count() == table(spark, SF, of).count()


def test_each_stage_on_what_the_last_one_kept(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    for k, (name, stage) in enumerate(C.STAGES):
        before = sorted(((r.doc_id, r.text) for r in docs.collect()), key=str)
        docs = C.stored(stage(spark, docs, SF), f"test-{k}")
        after = docs.collect()
        if name != C.STAGES[-1][0]:
            assert docs.columns == columns
        if name == "line dedup":
            want = {i: n for i, _, n, _ in brute_lines(before)}
            assert {r.doc_id for r in after} == set(want)
            texts = dict(before)
            for r in after:
                assert len(texts[r.doc_id].split("\n")) - want[r.doc_id] == max(
                    len(r.text.split("\n")) - (r.text == "" and want[r.doc_id] > 0), 0)
        elif name == "MinHash near-dedup":
            assert {r.doc_id for r in after} == {i for i, c in brute_classes(before).items() if i == c}
        elif name == "benchmark decontamination":
            assert {r.doc_id for r in after} == {r[0] for r in brute_hits(before, items) if not r[-1]}
        elif name == C.STAGES[-1][0]:
            assert {r.doc_id for r in after} == {i for i, _ in before} and all(r.round_trip for r in after)
    assert sorted((r.doc_id, r.ids) for r in C.run(spark, SF).collect()) == sorted(
        (r.doc_id, r.ids) for r in docs.collect())
