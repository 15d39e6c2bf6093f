"""Operator 8, SentencePiece encoding and decoding as a weighted finite-state transducer.

Three machines are compiled from a BPE model with byte fallback, all weights in
the tropical semiring (paths add, alternatives take the least):

* the normaliser: one arc from the start that writes U+2581, an arc that writes
  U+2581 for a blank, and an arc of weight 0 that copies any other character;
* the piece machine, a trie: an arc of weight 0 for each piece, and for a
  character without a piece an arc that writes its bytes, ``BYTE`` each;
* the pair machine, whose states are pieces: the arc from piece to piece has
  weight 0 if the merge rules leave the two side by side, else it is infinite.

A sequence is the model's encoding exactly if each piece and each pair of
neighbours is its own encoding, so the shortest path through the composition of
the three with an input is the encoding that the merge rules define. Distances
are relaxed position by position (all arcs lead forward); arcs of infinite
weight lead to no state, and of the states at a position the nearest is kept:
a prefix has one encoding, so at most one has a finite distance.

Where no piece holds two neighbouring characters, the composition has a single
state, and the text may be cut: before every run of U+2581, and between letters
and other characters as far as the model's pieces allow (``cuts``). Each
distinct chunk is solved and decoded once per worker (the last ``CACHE_CHUNKS``
or more are remembered).

Defined results: null and empty texts have no ids and decode to ""; U+2581 in
a text is read as a blank, so such a text does not round-trip; repeated rows
are encoded one by one; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from stockbook.llm.common import RecentCache, kept, map_docs, segments

MARK = "▁"
BYTE = 1.0  # weight of a byte in place of a piece
CACHE_CHUNKS, CACHE_PAIRS = 80_000, 300_000
CHUNK = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
INF = float("inf")
_SPAN = 1 << 32


def cuts(pieces: list[str]) -> re.Pattern:
    """Chunks of a text that no piece reaches across.

    Letters are parted from other characters. A character next to which a piece
    holds the other kind does not count as a letter; if that does not help,
    texts are cut before runs of U+2581 only.
    """
    other = ""
    for _ in range(2):
        letter = f"[^\\W\\d_{re.escape(other)}]" if other else r"[^\W\d_]"
        rest = rf"(?:(?!{letter})[^{MARK}])"
        chunk = re.compile(f"{MARK}*{letter}+|{MARK}+{rest}*|{rest}+")
        across = [p for p in pieces if len(chunk.findall(p)) > 1]
        if not across:
            return chunk
        other = "".join(sorted({c for p in across for c in p if re.match(r"[^\W\d_]", c)}))
    return CHUNK


class PieceTransducer:
    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        plain = [i for i in range(n) if not (
            model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.text = {i: model.id_to_piece(i) for i in plain}
        self.score = {t: model.get_score(i) for i, t in self.text.items()}
        # an arc is a piece that the merge rules make of its own text
        self.ids = {t: i for i, t in self.text.items() if self.merged(t) == [t]}
        self.byte = {int(model.id_to_piece(i)[3:5], 16): i for i in range(n) if model.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte.items()}
        self.marked = {t for t in self.ids if MARK in t.lstrip(MARK)}
        self.normal = {" ": MARK}  # the normaliser's arcs that do not copy
        self.trie: dict = {}  # character -> (id of the piece that ends here or -1, next characters)
        for t, i in self.ids.items():
            at, node = self.trie, None
            for c in t:
                node = at.setdefault(c, [-1, {}])
                at = node[1]
            node[0] = i
        self.chunk = cuts(list(self.ids))
        self.pairs: dict[int, float] = {}
        self.chunks = RecentCache(CACHE_CHUNKS)

    def merged(self, text: str) -> list[str]:
        """The merge rules on a short text: best score first, leftmost among equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = -INF, -1
            for k in range(len(parts) - 1):
                s = self.score.get(parts[k] + parts[k + 1], -INF)
                if s > best:
                    best, at = s, k
            if at < 0:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def pair(self, a: int, b: int) -> float:
        """Weight of the pair machine's arc from piece ``a`` to piece ``b``."""
        key = a * _SPAN + b
        w = self.pairs.get(key)
        if w is None:
            if len(self.pairs) > CACHE_PAIRS:
                self.pairs.clear()
            left, right = self.text[a], self.text[b]
            w = self.pairs[key] = 0.0 if self.merged(left + right) == [left, right] else INF
        return w

    def solve(self, chunk: str) -> tuple[list[int], float]:
        """Ids on the shortest path that reads ``chunk``, and its length.

        Best-first: arcs leave the heap by distance, then by how far they reach;
        an arc whose pair arc is infinite leads nowhere (the others add 0). No
        weight is negative, so the first path that is taken up at a position is
        the shortest one to it.
        """
        n, pairs, trie = len(chunk), self.pairs, self.trie
        back: list = [None] * (n + 1)  # (start, piece) of the arc on the shortest path to a position
        back[0] = (0, -1)
        length = [0.0] * (n + 1)
        heap: list = []
        at, d = 0, 0.0
        while at < n:
            arcs = trie
            if chunk[at] not in arcs:  # byte arcs; nothing merges with such a character
                heappush(heap, (d + BYTE * len(chunk[at].encode()), -(at + 1), at, -1))
            else:
                for end in range(at, n):
                    node = arcs.get(chunk[end])
                    if node is None:
                        break
                    piece, arcs = node
                    if piece >= 0 and back[end + 1] is None:
                        heappush(heap, (d, -(end + 1), at, piece))
            while True:
                d, end, start, piece = heappop(heap)
                if back[-end] is not None:
                    continue
                left = back[start][1]
                if left >= 0 and piece >= 0:
                    w = pairs.get(left * _SPAN + piece)
                    if w is None:
                        w = self.pair(left, piece)
                    if w == INF:
                        continue
                at = -end
                back[at] = (start, piece)
                length[at] = d
                break
        out: list[int] = []
        while at > 0:
            start, piece = back[at]
            if piece >= 0:
                out.append(piece)
            else:
                out.extend(self.byte[b] for b in reversed(chunk[start:at].encode()))
            at = start
        return out[::-1], length[n]

    def _solved(self, text: str) -> list[tuple[bytes, str]]:
        """(ids, their text) of each chunk of a normalised text."""
        cache = self.chunks
        chunks = self.chunk.findall(text)
        for c in cache.missing(chunks):
            ids, _ = self.solve(c)
            written = self._written(ids)
            cache.young[c] = array("i", ids).tobytes(), c if written == c else written  # nearly always c
        out = list(map(cache.young.__getitem__, chunks))
        cache.trim()
        return out

    def normalise(self, text: str) -> str:
        """What the normaliser writes for ``text``."""
        for read, written in self.normal.items():
            text = text.replace(read, written)
        return MARK + text

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian 32-bit integers."""
        return b"".join([ids for ids, _ in self._solved(self.normalise(text))]) if text else b""

    def encode_and_decode(self, text: str | None) -> tuple[bytes, str]:
        """Ids, and the text that they decode to, chunk by chunk: a chunk's byte
        runs are whole characters, so they are read without their neighbours."""
        if not text:
            return b"", ""
        found = self._solved(self.normalise(text))
        return (b"".join([ids for ids, _ in found]),
                "".join([t for _, t in found]).removeprefix(MARK).replace(MARK, " "))

    def _written(self, ids) -> str:
        """What the inverse of the piece machine writes; broken byte runs give U+FFFD."""
        out, run = [], bytearray()
        for i in ids:
            b = self.byte_of.get(i)
            if b is not None:
                run.append(b)
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run.clear()
            out.append(self.text.get(i, ""))
        if run:
            out.append(run.decode("utf-8", "replace"))
        return "".join(out)

    def decode(self, ids) -> str:
        """Text of the ids: the inverse machines."""
        return self._written(ids).removeprefix(MARK).replace(MARK, " ")


def transducer(path: str) -> PieceTransducer:
    def load() -> PieceTransducer:
        made = PieceTransducer(path)
        if made.marked:
            raise ValueError("pieces with an inner word mark: the text can't be cut at blanks")
        return made

    return kept(f"pieces {path}", load)


def encode_documents(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, ids, n_ids, ids_crc32, round_trip) of every document.

    ``round_trip`` tells whether decoding the ids gives the text again.
    """
    def run(ids, texts, t):
        both = [t.encode_and_decode(x) for x in texts]
        packed = [ids for ids, _ in both]
        flat = np.frombuffer(b"".join(packed), "<i4")
        counts = np.array([len(p) // 4 for p in packed], np.int64)
        lists = pa.ListArray.from_arrays(segments(counts).astype(np.int32), pa.array(flat))
        same = [back == (x or "") for (_, back), x in zip(both, texts, strict=True)]
        return {"doc_id": ids, "ids": lists, "n_ids": counts.tolist(),
                "ids_crc32": [zlib.crc32(p) for p in packed], "round_trip": same}

    return map_docs(docs, run, "doc_id bigint, ids array<int>, n_ids bigint, ids_crc32 bigint, "
                    "round_trip boolean", text="string", setup=lambda: transducer(model))


def decode_documents(encoded: DataFrame, model: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids)."""
    def run(batches):
        t = transducer(model)
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([t.decode(i or []) for i in b.column(1).to_pylist()], pa.string())],
                names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")
