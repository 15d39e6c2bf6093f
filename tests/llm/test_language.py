from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from stockbook.llm import language as L
from tests.llm import corpus

SYLLABLES = {"aa": "ka ro mi te su no ha", "bb": "sch ber ung ein keit ver lich", "cc": "eau oi ent ais que ment ré"}


def docs(spark, n=240):
    rng = random.Random(1)
    rows = []
    for i in range(n):
        lang = sorted(SYLLABLES)[i % 3]
        s = SYLLABLES[lang].split()
        text = " ".join("".join(rng.choice(s) for _ in range(3)) for _ in range(rng.randrange(3, 30)))
        rows.append((i, text.upper() if i % 7 == 0 else text, lang))
    rows += [(900, None, "aa"), (901, "", "bb"), (902, "12 34 !!", "cc"), (903, "karo mite sunoha", None),
             (None, "berung einkeit", "bb"), (904, "漢字 漢字", None)]
    return spark.createDataFrame([(*r, "src", "clash", 0.0) for r in rows],
                                 "doc_id bigint, text string, lang string, source string, lang_pred string, "
                                 "score double")


def test_held_out_accuracy_and_defined_results(spark):
    frame = docs(spark)
    truth = {r.doc_id: r.lang for r in frame.collect()}
    out = {r.doc_id: r for r in L.identify_held_out(frame).collect()}
    for i, r in out.items():
        assert r.held_out == (i is not None and zlib.crc32(str(i).encode()) % 3 == 1)
        assert 0 <= r.score <= 1
    held = [i for i, r in out.items() if r.held_out and i < 900]
    assert len(held) > 50 and all(out[i].lang_pred == truth[i] for i in held)
    assert [out[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3
    assert out[903].lang_pred == "aa" and out[904].lang_pred in SYLLABLES


def test_labels_of_the_held_out_fold_are_not_used(spark):
    frame = docs(spark)
    held = L.crc32_mod("doc_id", 3) == 1
    from pyspark.sql import functions as F
    lied = frame.withColumn("lang", F.when(held, F.lit("zz")).otherwise(F.col("lang")))
    a = sorted((str(r.doc_id), r.lang_pred, r.score) for r in L.identify_held_out(frame).collect())
    b = sorted((str(r.doc_id), r.lang_pred, r.score) for r in L.identify_held_out(lied).collect())
    assert a == b


@pytest.mark.parametrize("k", [1, 2, 3, 4, 6, 9, 20])
def test_codewords_differ(k):
    m = L.code_matrix(k)
    assert len({tuple(r) for r in m.tolist()}) == k
    if k > 2:
        least = min(int((m[i] != m[j]).sum()) for i in range(k) for j in range(i))
        assert least >= 2  # a wrong bit can be noticed


def test_a_wrong_bit_is_corrected():
    m = L.Model(["a", "b", "c", "d"], L.code_matrix(4), np.zeros((7, 1), np.float32), np.ones(7))
    margins = 3.0 * m.code.astype(float)
    for bit in range(7):
        wrong = margins.copy()
        wrong[:, bit] *= -1
        assert m.decode(wrong)[0].tolist() == [0, 1, 2, 3]
    assert m.decode(np.zeros((1, 7)))[2].tolist() == [True]


def test_nothing_to_learn(spark):
    out = L.identify_held_out(docs(spark).withColumn("lang", L.F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in out} == {"und"} and {r.score for r in out} == {0.0}
    assert L.identify_held_out(docs(spark).limit(0)).count() == 0
    assert corpus.SCHEMA


def test_more_than_four_hundred_languages(spark):
    """The model has some ninety bits, whatever the number of languages."""
    rng = random.Random(8)
    own = [["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(12)]
           for _ in range(430)]
    rows = [(k * 430 + i, " ".join(rng.choice(own[i]) for _ in range(15)), f"l{i}")
            for k in range(4) for i in range(430)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    out = {r.doc_id: r for r in L.identify_held_out(docs).collect()}
    held = [i for i, r in out.items() if r.held_out]
    right = sum(out[i].lang_pred == f"l{i % 430}" for i in held)
    assert len(held) > 400 and right >= 0.95 * len(held)


def test_loss_weighted_decoding_equals_the_sum_over_bits():
    rng = np.random.default_rng(2)
    code = L.code_matrix(9)
    m = L.Model([str(k) for k in range(9)], code, np.zeros((code.shape[1], 4), np.float32),
                rng.random(code.shape[1]) + 0.5)
    margins = rng.normal(size=(50, code.shape[1])) * 4
    z = code[None, :, :] * margins[:, None, :]
    loss = (np.log1p(np.exp(-z)) * m.weight).sum(axis=2)
    best, score, _ = m.decode(margins)
    assert (best == loss.argmin(axis=1)).all() and ((0 < score) & (score <= 1)).all()


def test_ties_long_texts_and_a_language_without_letters(spark):
    rows = [(i, f"alpha beta {i}" if i % 2 else f"gamma delta {i}", "a" if i % 2 else "b") for i in range(60)]
    rows += [(i, "123 456", "c") for i in range(60, 70)]
    rows += [(100, "alpha beta gamma delta", None), (101, "alpha " * 200_000, None), (102, "789", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    out = {r.doc_id: r for r in L.identify_held_out(docs).collect()}
    assert out[101].lang_pred == "a" and out[102].lang_pred == "und" and out[100].lang_pred in "ab"
    assert {r.lang_pred for r in out.values()} == {"a", "b", "und"}
