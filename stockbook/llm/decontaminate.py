"""Operator 6, benchmark decontamination: one Aho-Corasick automaton.

Texts are normalised to lower-cased words joined by single blanks. The
patterns are the windows of ``n`` consecutive words of every benchmark item (a
shorter item is one window), each with a blank at both ends, so a match begins
and ends at word borders. One automaton over all windows scans each document
once; matches are mapped to word numbers and, on request, to byte offsets of
the original text.

The windows are dealt by hash into blocks of about ``block_bytes`` of window
text and written to the shared folder; a worker reads the block that it scans
for and builds its automaton, so neither the driver nor a broadcast holds the
benchmark, and any size is served: the documents are scanned once per block
(nearly always there is one), and the hits of a document are merged.

Defined results: null or word-less texts have no words and no hits; item rows
that repeat an id are one item; items with a null id are scanned for (their
words count as hit) and named "" in the digest; other columns are ignored or
passed on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.dataset as dataset
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from stockbook.llm.common import (
    WORD_TABLE,
    id_and_text,
    kept,
    map_docs,
    record_batch,
    stored,
    word_bytes,
)
from stockbook.llm.token_store import file_system
from stockbook.session import scratch_path

WINDOW = 10

BLOCK_BYTES = 2 << 20  # of window text in an automaton (which takes some fifty times as much)


def windows_of(text: bytes | None, n: int = WINDOW) -> list[bytes]:
    """The windows of an item, blanks between words."""
    words = word_bytes(text)
    return [b" ".join(words[k:k + n]) for k in range(max(1, len(words) - n + 1) if words else 0)]


class Patterns:
    """The windows of a block with the items that hold them, and their automaton."""

    def __init__(self, pairs: Iterable[tuple[bytes, str]]):
        by_window: dict[bytes, set[str]] = {}
        for window, item in pairs:
            by_window.setdefault(window, set()).add(item)
        self.windows = sorted((w, tuple(sorted(s))) for w, s in by_window.items())
        self.automaton = ahocorasick.Automaton()
        for k, (w, _) in enumerate(self.windows):
            self.automaton.add_word(f" {w.decode('latin-1')} ", k)
        if self.windows:
            self.automaton.make_automaton()

    def scan(self, data: bytes | None) -> tuple[int, np.ndarray, set[str]]:
        """(number of words, hit flags of the words or an empty array, items found)."""
        words = word_bytes(data)
        if not words or not self.windows:
            return len(words), np.zeros(0, bool), set()
        joined = f" {b' '.join(words).decode('latin-1')} "
        ends = list(self.automaton.iter(joined))
        if not ends:
            return len(words), np.zeros(0, bool), set()
        # word k begins at starts[k], one past its blank
        starts = np.cumsum(np.fromiter((len(w) + 1 for w in words), np.int64, len(words)))
        after = starts + 1  # position one past the blank behind word k
        cover = np.zeros(len(words) + 1, np.int64)
        items: set[str] = set()
        last = np.searchsorted(after, np.array([e + 1 for e, _ in ends]))
        for (_, k), end in zip(ends, last.tolist(), strict=True):
            window, found = self.windows[k]
            cover[end - window.count(b" ")] += 1
            cover[end + 1] -= 1
            items.update(found)
        return len(words), np.cumsum(cover[:-1]) > 0, items


def write_windows(benchmark: DataFrame, n: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> list[str]:
    """Write the windows in blocks; returns the folder of each block."""
    spark = benchmark.sparkSession
    rows = benchmark.where(F.col("text").isNotNull()).select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"),
        F.col("text").cast("binary").alias("text"))

    def run(batches):
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = windows_of(text, n)
                for lo in range(0, len(found), 10_000):
                    part = found[lo:lo + 10_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(part, pa.binary()), pa.array([item] * len(part), pa.string())],
                        names=["window", "item"])

    pairs = stored(rows.mapInArrow(run, "window binary, item string").distinct(), "leak-windows")
    size = pairs.select("window").distinct().agg(F.sum(F.octet_length("window")).alias("n")).first()["n"]
    if size is None:
        return []
    blocks = -(-size // block_bytes)
    path = scratch_path(spark, "leak-blocks")
    (pairs.withColumn("block", F.pmod(F.xxhash64("window"), F.lit(blocks)))
     .repartition("block").write.partitionBy("block").parquet(path))
    used = spark.read.parquet(path).select("block").distinct().collect()  # one number per block
    return [f"{path}/block={r['block']}" for r in sorted(used)]


def block_patterns(folder: str) -> Patterns:
    """The patterns of a block, read by the worker that needs them (one at a time)."""
    def load() -> Patterns:
        fs, path = file_system(folder)
        table = dataset.dataset(path, filesystem=fs, format="parquet").to_table(["window", "item"])
        return Patterns(zip(table.column(0).to_pylist(), table.column(1).to_pylist(), strict=True))

    return kept(f"patterns {folder}", load)


def word_spans(data: bytes) -> list[tuple[int, int]]:
    """Byte offsets of the words in the original text, in order."""
    flags = np.frombuffer(data.translate(WORD_TABLE), np.uint8) != 0x20
    edge = np.flatnonzero(np.diff(np.concatenate(([False], flags, [False])).astype(np.int8)))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def hit_spans(data: bytes, hit: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of hit words as byte offsets of the original text."""
    if not len(hit):
        return []
    spans = word_spans(data)
    edge = np.flatnonzero(np.diff(np.concatenate(([False], hit, [False])).astype(np.int8)))
    return [(spans[a][0], spans[b - 1][1]) for a, b in zip(edge[::2], edge[1::2], strict=True)]


_RESULT = ("n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, "
           "spans array<struct<start: bigint, end: bigint>>")


def _answer(data: bytes | None, n_words: int, hit: np.ndarray, items: Iterable[str]) -> tuple:
    found = sorted(set(items))
    return (n_words, int(hit.sum()), len(found), hashlib.sha256(",".join(found).encode()).hexdigest(),
            bool(hit.any()), [{"start": int(a), "end": int(b)} for a, b in hit_spans(data, hit)])


def _columns(ids: list, answers: list[tuple]) -> dict:
    names = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"]
    return {"doc_id": ids} | {name: [x[k] for x in answers] for k, name in enumerate(names)}


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW,
                  block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: counts, digest of the item ids, verdict and the spans hit."""
    folders = write_windows(benchmark, n, block_bytes)
    if len(folders) > 1:
        return _merged(docs, folders)

    def run(ids, texts, patterns):
        return _columns(ids, [_answer(data, *patterns.scan(data)) for data in texts])

    return map_docs(docs, run, f"doc_id bigint, {_RESULT}",
                    setup=lambda: block_patterns(folders[0]) if folders else Patterns([]))


def _merged(docs: DataFrame, folders: list[str]) -> DataFrame:
    """``contamination`` over several blocks: a scan of the documents for each, then
    the hit words and items of every document together."""
    rows = stored(id_and_text(docs).withColumn("row", F.monotonically_increasing_id()), "leak-docs")
    hits = None
    for folder in folders:
        part = _block_hits(rows, folder)
        hits = part if hits is None else hits.unionByName(part)
    found = hits.groupBy("row").agg(F.flatten(F.collect_list("words")).alias("words"),
                                    F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    target = docs.sparkSession.createDataFrame([], f"doc_id bigint, {_RESULT}").schema

    def run(batches):
        out_schema = to_arrow_schema(target)
        for batch in batches:
            answers = []
            for data, words, items in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                n_words = len(word_bytes(data))
                hit = np.zeros(n_words if words else 0, bool)
                hit[words or []] = True
                answers.append(_answer(data, n_words, hit, items or []))
            yield record_batch(_columns(batch.column(0).to_pylist(), answers), out_schema)

    return (rows.join(found, "row", "left").select("doc_id", "text", "words", "items")
            .mapInArrow(run, target))


def _block_hits(rows: DataFrame, folder: str) -> DataFrame:
    """(row, words, items) of the documents that a block hits: numbers of the hit words."""
    def run(batches):
        patterns = block_patterns(folder)
        for batch in batches:
            found = [patterns.scan(data) for data in batch.column(1).to_pylist()]
            at = [k for k, (_, hit, _) in enumerate(found) if len(hit)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())),
                 pa.array([np.flatnonzero(found[k][1]) for k in at], pa.list_(pa.int32())),
                 pa.array([sorted(found[k][2]) for k in at], pa.list_(pa.string()))],
                names=["row", "words", "items"])

    return rows.select("row", "text").mapInArrow(run, "row bigint, words array<int>, items array<string>")


def keep_clean(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW,
               block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents without a hit, all columns: one scan per block of windows."""
    at, folders = docs.columns.index("text"), write_windows(benchmark, n, block_bytes)

    def without(docs: DataFrame, folder: str) -> DataFrame:
        def run(batches):
            patterns = block_patterns(folder)
            for b in batches:
                texts = b.column(at).cast(pa.binary()).to_pylist()
                yield b.filter(pa.array([not patterns.scan(t)[1].any() for t in texts], pa.bool_()))

        return docs.mapInArrow(run, docs.schema)

    for k, folder in enumerate(folders):
        # written in between: the scans of a chain would hold all automata at once
        docs = without(docs if k == 0 else stored(docs, "leak-clean"), folder)
    return docs
