from __future__ import annotations

import io
import random
import zlib

import numpy as np
import pytest

from stockbook.llm import token_store as T
from stockbook.llm.queries import tokenizer_path
from stockbook.session import scratch_path
from tests.llm import corpus

NAME = "word_bpe_49k.json"
ALPHABET = list("aabcdeinth  \n\t.,!1290<>/xé▁ñüöÉ漢字🙂́\x00​\x85   ") + [
    "the", "ing", "<|endoftext|>", "<|", "'s", "'ll", "İ", "Σ", "ẞ", "\r"]


def library(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path(NAME))
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def test_word_encoder_equals_the_library():
    rng = random.Random(1)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(40))) for _ in range(4000)]
    encoder = T.WordEncoder(tokenizer_path(NAME))
    assert [np.frombuffer(encoder.encode(x.encode()), encoder.dtype).tolist() for x in texts] == library(texts)


def test_file_round_trip_and_random_access(monkeypatch):
    monkeypatch.setattr(T, "FRAME_IDS", 50)
    rng = np.random.default_rng(2)
    docs = [(None, rng.integers(0, 9, 3)), (-5, rng.integers(0, 9, 0)), (7, rng.integers(0, 60000, 400)),
            *[(i, rng.integers(0, 60000, int(n))) for i, n in enumerate(rng.integers(1, 40, 50), 10)]]
    out = io.BytesIO()
    w = T.FileWriter(out, 2)
    for i, ids in docs:
        w.add(i, ids.astype("<u2").tobytes())
    w.close()

    class Source(io.BytesIO):
        def size(self):
            return len(self.getvalue())

    reader = T.FileReader(Source(out.getvalue()))
    got = list(reader.documents())
    assert [(i, ids.tolist()) for i, _, ids in got] == [(i, ids.tolist()) for i, ids in docs]
    assert [s for _, s, _ in got] == [sum(len(x) for _, x in docs[:k]) for k in range(len(docs))]
    frames = []
    monkeypatch.setattr(reader, "frame", lambda k, f=reader.frame: frames.append(k) or f(k))
    assert [(i, ids.tolist()) for i, _, ids in reader.documents([20])] == [(20, docs[13][1].tolist())]
    assert len(frames) == 1 < len(reader.seek)
    broken = bytearray(out.getvalue())
    broken[int(reader.offset[1]) + 12] ^= 1
    with pytest.raises(Exception):  # noqa: B017 - the frame's own checksum or the table's
        list(T.FileReader(Source(bytes(broken))).documents())


def test_frames_are_plain_zstandard():
    import zstandard

    out = io.BytesIO()
    w = T.FileWriter(out, 4)
    w.add(1, b"\1\0\0\0" * 10)
    w.close()
    data = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(out.getvalue())).read()
    assert data == b"\1\0\0\0" * 10


def test_table_round_trip(spark):
    rng = random.Random(3)
    rows = [*corpus.ODD, *((i, corpus.words(rng, rng.randrange(50))) for i in range(80)), (5, "same id")]
    out = T.token_round_trip(corpus.frame(spark, rows), tokenizer_path(NAME)).collect()
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want, start = [], 0
    for (i, _), ids in zip(rows, library([t for _, t in rows]), strict=True):
        ids = np.array([*ids, 1], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in out), key=lambda r: r[1])
    assert got == want


def test_files_that_are_not_in_the_manifest_are_ignored(spark):
    path = scratch_path(spark, "tokens")
    docs = corpus.frame(spark, [(1, "a b"), (2, "c")])
    T.write_token_files(docs, tokenizer_path(NAME), path)
    manifest = T.write_token_files(docs, tokenizer_path(NAME), path)
    assert T.read_token_files(manifest, path).count() == 2
    assert T.token_round_trip(corpus.empty(spark), tokenizer_path(NAME)).count() == 0
