"""Operator 4, token-ID output: independent zstandard frames with a seek table.

A token file holds the ids of documents in ascending ``doc_id`` order:

* zstandard frames, each with the ids of whole documents (little-endian, 2 or
  4 bytes an id) and its own content checksum; a frame is closed when it has
  ``FRAME_IDS`` ids, so a longer document is a frame of its own;
* one skippable frame with the document index (doc_id, number of ids, frame);
* one skippable frame with the seek table of the public seekable format: the
  compressed size, the size and the checksum of every frame, and a footer.

A reader loads the two tables and decompresses only the frames of the
documents it wants. Tasks write files under names of their own; a file counts
only if it is in the manifest, so a lost or repeated task leaves no trace.

Texts are split at blanks and line feeds, which no token of the vocabulary
crosses, and a worker remembers the ids of the words it met last
(``CACHE_WORDS`` in each of two generations).

Defined results: null text is empty and has the end id alone; a null doc_id
sorts first; rows that repeat a doc_id are ordered by text; other columns are
ignored; an empty table gives no files.
"""

from __future__ import annotations

import json
import os
import struct
import unicodedata
import uuid
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockbook.llm.common import RecentCache, id_and_text, stored
from stockbook.session import scratch_path

END_ID = 1
FRAME_IDS = 1 << 16
CACHE_WORDS = 300_000
LETTERS = frozenset(range(97, 123))
MARKS = frozenset(b"!\"#$%&()*+,-./:;=>?@[\\]^_`{|}~")
#: A-Z to lower case, line feeds to blanks.
LOWER = bytes(b + 32 if 65 <= b <= 90 else 0x20 if b == 10 else b for b in range(256))
# Fixed values of the public seekable format.
SEEK_MAGIC, INDEX_MAGIC, FOOT_MAGIC = 0x184D2A5E, 0x184D2A50, 0x8F92EAB1
LATIN_END = "\u0250"
#: Byte-level vocabularies write bytes that are no printable Latin-1 as U+0100 and up.
_SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_LETTERS = {b: 0x100 + k for k, b in enumerate(b for b in range(256) if b not in _SHOWN)}

_encoders: dict[str, tuple] = {}  # of this worker, by tokenizer file


def file_system(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri)


class WordEncoder:
    """Ids of a text by a ``tokenizers`` file, without special tokens.

    The normaliser of the vocabulary lower-cases and its splitter drops white
    space and ends a token between a letter and a punctuation mark other than
    the apostrophe, so words may be encoded on their own, in lower case, and
    without the mark they end in.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if path not in _encoders:
            _encoders[path] = Tokenizer.from_file(path), RecentCache(CACHE_WORDS)
        self.tokenizer, self.cache = _encoders[path]
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.dtype = np.dtype(f"<u{self.width}")
        self.code = "H" if self.width == 2 else "I"

    def _library(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word: whole Latin words by the library's model, others by its pipeline."""
        model, out, rest = self.tokenizer.model, [b""] * len(words), []
        for k, w in enumerate(words):
            if not w.isascii():
                text = w.decode()
                plain = (text.isalpha() and max(text) < LATIN_END and text == text.lower()
                         and unicodedata.is_normalized("NFC", text))
            else:
                plain = w.isalpha()
            if plain:  # one word for the splitter, already normal
                out[k] = array(self.code, [
                    t.id for t in model.tokenize(w.decode("latin-1").translate(BYTE_LETTERS))]).tobytes()
            else:
                rest.append(k)
        found = self.tokenizer.encode_batch_fast([words[k].decode() for k in rest],
                                                 add_special_tokens=False)
        for k, e in zip(rest, found, strict=True):
            out[k] = array(self.code, e.ids).tobytes()
        return out

    def encode(self, text: bytes | None) -> bytes:
        if not text:
            return b""
        if b"<|" in text:  # may be a special token, which is found before lower-casing
            return self._library([text])[0]
        words = text.translate(LOWER).split(b" ")
        cache = self.cache
        new = cache.missing(words)
        if new:
            marked = [w for w in new if len(w) > 1 and w[-1] in MARKS and w[-2] in LETTERS]
            bare = cache.missing({w[:-1] for w in marked}.union({w[-1:] for w in marked}, new)
                                 .difference(marked))
            cache.young.update(zip(bare, self._library(bare), strict=True))
            for w in marked:
                cache.young[w] = cache.young[w[:-1]] + cache.young[w[-1:]]
        get = cache.young.__getitem__
        out = b"".join(map(get, words))
        cache.trim()
        return out


class FileWriter:
    """Appends documents to a token file; ``close`` writes the tables."""

    def __init__(self, out, width: int):
        self.out, self.width = out, width
        self.coder = zstandard.ZstdCompressor(level=3, write_checksum=True)
        self.ids: list[int | None] = []
        self.counts: list[int] = []
        self.frames: list[int] = []
        self.seek: list[tuple[int, int, int]] = []
        self.open: list[bytes] = []
        self.open_ids = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        n = len(ids) // self.width
        if self.open_ids and self.open_ids + n > FRAME_IDS:
            self._frame()
        self.ids.append(doc_id)
        self.counts.append(n)
        self.frames.append(len(self.seek))
        self.open.append(ids)
        self.open_ids += n

    def _frame(self) -> None:
        raw = b"".join(self.open)
        packed = self.coder.compress(raw)
        self.out.write(packed)
        self.seek.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.open, self.open_ids = [], 0

    def close(self) -> None:
        if self.open:
            self._frame()
        n = len(self.ids)
        head = json.dumps({"n": n, "width": self.width}).encode()
        index = b"".join([
            struct.pack("<I", len(head)), head,
            np.array([i is None for i in self.ids], np.uint8).tobytes(),
            np.array([i or 0 for i in self.ids], "<i8").tobytes(),
            np.array(self.counts, "<u8").tobytes(), np.array(self.frames, "<u4").tobytes()])
        self.out.write(struct.pack("<II", INDEX_MAGIC, len(index)) + index)
        table = b"".join(struct.pack("<III", *e) for e in self.seek)
        foot = struct.pack("<IBI", len(self.seek), 0x80, FOOT_MAGIC)
        self.out.write(struct.pack("<II", SEEK_MAGIC, len(table) + len(foot)) + table + foot)


class FileReader:
    """Random access to a token file opened with ``open_input_file``."""

    def __init__(self, src):
        self.src = src
        size = src.size()
        n, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != FOOT_MAGIC or flags != 0x80:
            raise ValueError("not a token file")
        table = self._at(size - 9 - 12 * n, 12 * n)
        self.seek = [struct.unpack_from("<III", table, 12 * k) for k in range(n)]
        self.offset = np.concatenate(([0], np.cumsum([e[0] for e in self.seek], dtype=np.int64)))
        at = int(self.offset[-1])
        magic, length = struct.unpack("<II", self._at(at, 8))
        if magic != INDEX_MAGIC:
            raise ValueError("the document index is missing")
        index = self._at(at + 8, length)
        h = struct.unpack_from("<I", index)[0]
        head = json.loads(index[4:4 + h])
        m, p = head["n"], 4 + h
        self.dtype = np.dtype(f"<u{head['width']}")
        null = np.frombuffer(index, np.uint8, m, p)
        ids = np.frombuffer(index, "<i8", m, p + m)
        self.ids = [None if z else i for z, i in zip(null.tolist(), ids.tolist(), strict=True)]
        self.counts = np.frombuffer(index, "<u8", m, p + 9 * m).astype(np.int64)
        self.frames = np.frombuffer(index, "<u4", m, p + 17 * m)
        self.coder = zstandard.ZstdDecompressor()

    def _at(self, offset: int, n: int) -> bytes:
        self.src.seek(offset)
        data = self.src.read(n)
        if len(data) != n:
            raise ValueError("the file ends early")
        return data

    def frame(self, k: int) -> np.ndarray:
        packed, size, check = self.seek[k]
        raw = self.coder.decompress(self._at(int(self.offset[k]), packed), max_output_size=size)
        if len(raw) != size or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k} is damaged")
        return np.frombuffer(raw, self.dtype)

    def documents(self, wanted: Iterable[int] | None = None) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, ids of all documents of the file before it, ids); only the
        frames that hold a wanted document are read."""
        keep = None if wanted is None else set(wanted)
        starts = np.concatenate(([0], np.cumsum(self.counts)))
        at, k, data, used = -1, -1, None, 0
        for i, doc in enumerate(self.ids):
            if self.frames[i] != at:
                at, used = int(self.frames[i]), 0
            n = int(self.counts[i])
            if keep is None or doc in keep:
                if k != at:
                    k, data = at, self.frame(at)
                yield doc, int(starts[i]), data[used:used + n]
            used += n


def write_token_files(docs: DataFrame, tokenizer: str, path: str, end_id: int = END_ID) -> DataFrame:
    """Write the token files below ``path``; the manifest (part, file, n_docs, n_tokens)."""
    ordered = (id_and_text(docs).repartitionByRange("doc_id")
               .sortWithinPartitions("doc_id", "text"))

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encoder = WordEncoder(tokenizer)
        end = np.array([end_id], encoder.dtype).tobytes()
        out = writer = None
        for b in batches:
            if not b.num_rows:
                continue
            if out is None:
                fs, base = file_system(path)
                fs.create_dir(base, recursive=True)
                name = f"{base}/part-{part:06d}-{uuid.uuid4().hex}.tok.zst"
                out = fs.open_output_stream(name, compression=None)
                writer = FileWriter(out, encoder.width)
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                writer.add(doc_id, encoder.encode(text) + end)
        if out is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "file": [name.rpartition("/")[2]],
                "n_docs": pa.array([len(writer.ids)], pa.int64()),
                "n_tokens": pa.array([sum(writer.counts)], pa.int64())})

    rows = ordered.mapInArrow(run, "part int, file string, n_docs bigint, n_tokens bigint")
    return stored(rows, "token-manifest")


def read_token_files(manifest: DataFrame, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read from the files."""
    spark = manifest.sparkSession
    files, start = [], 0  # one row per file, not per document
    for r in sorted(manifest.collect(), key=lambda r: r.part):
        files.append((r.file, start))
        start += r.n_tokens
    listed = spark.createDataFrame(files, "file string, start bigint")

    def run(batches):
        for b in batches:
            for name, first in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                fs, base = file_system(path)
                with fs.open_input_file(f"{base}/{name}") as src:
                    out: list[tuple] = []
                    for doc, at, ids in FileReader(src).documents():
                        out.append((doc, first + at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    cols = list(zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, pa.int64()) for c in cols],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return listed.repartition(max(1, len(files)), F.col("file")).mapInArrow(
        run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def token_round_trip(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Write ``docs`` as token files in the shared folder and read them back."""
    path = scratch_path(docs.sparkSession, "tokens")
    return read_token_files(write_token_files(docs, tokenizer, path, end_id), path)
