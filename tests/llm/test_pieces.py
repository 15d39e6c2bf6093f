from __future__ import annotations

import random

import numpy as np

from stockbook.llm import pieces as P
from stockbook.llm.queries import tokenizer_path
from tests.llm import corpus

NAME = "piece_bpe_32k.model"
ALPHABET = list("aabcdeinth  \n\t.!1290<>/xé▁ñüö漢字🙂́\x00​") + [
    "the", " ing", " 20", "    ", "        ", "▁▁", "<0x41>", "<s>"]


def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(NAME))


def ids_of(t, text):
    return np.frombuffer(t.encode(text), "<i4").tolist()


def test_shortest_path_equals_the_library():
    t, s = P.transducer(tokenizer_path(NAME)), library()
    rng = random.Random(1)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(30))) for _ in range(5000)]
    texts += [f"{a}{' ' * n}{b}" for n in range(1, 40) for a in ("", "a") for b in ("", "the")]
    for x in texts:
        ids = s.encode(x)
        assert ids_of(t, x) == ids
        assert t.decode(ids) == s.decode(ids)


def test_broken_byte_runs_decode_to_the_replacement_character():
    t = P.transducer(tokenizer_path(NAME))
    assert t.decode([t.byte[0xE6], t.byte[0xBC], t.ids["a"]]) == "�a"


def test_documents_and_back(spark):
    t, s = P.transducer(tokenizer_path(NAME)), library()
    rng = random.Random(2)
    rows = [*corpus.ODD, *((i, corpus.words(rng, rng.randrange(60))) for i in range(30)), (3, "again"),
            (940, "marked▁text")]
    encoded = P.encode_documents(corpus.frame(spark, rows), tokenizer_path(NAME))
    out = sorted(encoded.collect(), key=lambda r: str((r.doc_id, r.ids)))
    want = sorted(((i, s.encode(x or "")) for i, x in rows), key=str)
    assert [(r.doc_id, r.ids) for r in out] == want
    assert {r.doc_id for r in out if not r.round_trip} == {940}
    assert all(r.n_ids == len(r.ids) for r in out)
    back = sorted(((r.doc_id, r.text) for r in P.decode_documents(encoded, tokenizer_path(NAME)).collect()),
                  key=str)
    assert back == sorted(((i, (x or "").replace("▁", " ")) for i, x in rows), key=str)
    assert t.ids["a"] and P.encode_documents(corpus.empty(spark), tokenizer_path(NAME)).count() == 0
