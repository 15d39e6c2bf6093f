"""Operator 10, repeated windows: a depth-limited radix sort of suffixes.

Suffixes are ordered through their first ``depth`` bytes only, by passes over
digits, most significant first; a pass keeps the groups that still have two
members. After the last digit a group holds suffixes that agree in ``depth``
bytes: the repeated windows. The digits are read in an order that a window's
own bytes decide, so equal windows have equal digits, and one record can stand
for a run of neighbouring suffixes:

1. the first digit is the window's minimizer: of its ``digit``-byte strings the
   one with the least hash. On average about a hundred neighbouring windows
   have the same one, and the run of them is one record;
2. the second digit is the text under the whole run. Runs that agree in it are
   groups of equal windows already, copies of any number being settled here;
3. where runs agree in the first digit but not in the second, one run of each
   kind is opened into pieces of ``PIECE`` windows, dealt by their distance to
   the minimizer. The third digit of a piece is the text that all its windows
   share, the fourth the text under the whole piece; as above, pieces that are
   alone in the third go, those that agree in the fourth are settled;
4. of what is left, one piece of each kind is opened, and the fifth digit is
   each window's full text.

Digits are compared by 64-bit hashes; a group is told by two of them (128 bits).
Long texts are cut into blocks of windows, so a task's memory is bounded by the
longest text itself. Nothing is emitted for pairs: groups are counted.

Defined results: null text is empty; matches never cross rows; rows that repeat
a doc_id or have none are documents of their own; texts shorter than ``depth``
bytes keep all; what is left of a text may be cut inside a character, so it is
given as bytes; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockbook.llm.common import hot_join, segments, split_by_keys, stored
from stockbook.llm.dart_minhash import mix

DEPTH, DIGIT = 400, 160
BLOCK = 1 << 18  # windows of a text that are looked at together
PIECE = 16
_BASE = 0x9E3779B97F4A7C15 | 1
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base & (2**64 - 1)))
    out[0] = 1
    return np.multiply.accumulate(out)


_UP = _powers(_BASE, BLOCK + 4 * DEPTH + 1)
_DOWN = _powers(pow(_BASE, -1, 1 << 64), BLOCK + 4 * DEPTH + 1)


class Hashes:
    """Hash of any stretch of ``data`` (a block and the windows that begin in it)."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTES[data] * _UP[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * _DOWN[start])

    def all(self, length: int) -> np.ndarray:
        m = len(self.sums) - length
        return mix((self.sums[length:] - self.sums[:m]) * _DOWN[:m])


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every ``w`` neighbours."""
    n = len(x)
    blocks = -(-n // w)
    pad = np.full(blocks * w, np.iinfo(np.uint64).max, np.uint64)
    pad[:n] = x
    rows = pad.reshape(blocks, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n - w + 1], ahead[w - 1:n])


def runs_of(text: bytes, depth: int = DEPTH, digit: int = DIGIT):
    """(first digit, second digit, first window, last window, minimizer) of every run of a text."""
    data = np.frombuffer(text, np.uint8)
    out = []
    for at in range(0, len(data) - depth + 1, BLOCK):
        part = data[at:at + BLOCK + depth - 1]
        h = Hashes(part)
        grams = h.all(digit)
        # the place in the low bits: the leftmost of equal grams, and where it is
        place = np.arange(len(grams), dtype=np.uint64)
        least = sliding_min((grams & ~np.uint64(0xFFFFF)) | place, depth - digit + 1)
        anchor = (least & np.uint64(0xFFFFF)).astype(np.int64)
        lo = np.concatenate(([0], np.flatnonzero(np.diff(anchor)) + 1))
        hi = np.concatenate((lo[1:] - 1, [len(anchor) - 1]))
        anchor = anchor[lo]
        shape = ((hi - lo).astype(np.uint64) << np.uint64(32)) | (anchor - lo).astype(np.uint64)
        out.append((grams[anchor], mix(h.of(lo, hi + depth) ^ mix(shape)), lo + at, hi + at,
                    anchor + at))
    if not out:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def pieces_of(text: bytes, lo: np.ndarray, hi: np.ndarray, anchor: np.ndarray, width: int,
              depth: int = DEPTH):
    """The runs cut into pieces of ``width`` windows, counted from the minimizer:
    (run, piece, third digit, fourth digit, first window, last window)."""
    data, out = np.frombuffer(text, np.uint8), []
    for block in np.unique(lo // BLOCK):
        mine = np.flatnonzero(lo // BLOCK == block)
        base = int(block) * BLOCK
        h = Hashes(data[base:base + BLOCK + 4 * depth])
        near, far = anchor[mine] - hi[mine], anchor[mine] - lo[mine]  # distances to the minimizer
        count = far // width - near // width + 1
        run = np.repeat(mine, count)
        first = np.repeat(near // width, count)
        piece = first + np.arange(len(run)) - np.repeat(segments(count)[:-1], count)
        start = np.maximum(anchor[run] - piece * width - width + 1, lo[run]) - base
        end = np.minimum(anchor[run] - piece * width, hi[run]) - base
        core = anchor[run] - piece * width - base  # the last window of the full piece begins here
        shape = ((anchor[run] - base - start).astype(np.uint64) << np.uint64(32)) | (
            end - start).astype(np.uint64)
        out.append((run, piece, h.of(core, core + depth - width + 1),
                    mix(h.of(start, end + depth) ^ mix(shape)), start + base, end + base))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _rows(docs: DataFrame) -> DataFrame:
    """(doc_id, k1, k2, text): k1, k2 name the row; rows with equal names have equal texts."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text")).select(
        "doc_id", F.coalesce("doc_id", F.lit(-1)).alias("k1"), F.xxhash64("text").alias("k2"), "text")


def _i64(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x, pa.int64())


def _runs(rows: DataFrame, depth: int, digit: int) -> DataFrame:
    names = ["k1", "k2", "g", "f", "lo", "hi", "a"]

    def run(batches):
        for b in batches:
            k1, k2 = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            found = [runs_of(t, depth, digit) for t in b.column(2).to_pylist()]
            size = [len(r[0]) for r in found]
            cols = [np.repeat(k1, size), np.repeat(k2, size),
                    *(np.concatenate([r[i] for r in found]) if found else np.zeros(0, np.int64)
                      for i in range(5))]
            yield pa.RecordBatch.from_arrays([_i64(c) for c in cols], names=names)

    return rows.where(F.octet_length("text") >= depth).select("k1", "k2", "text").mapInArrow(
        run, ", ".join(f"{c} bigint" for c in names))


def _opened(rows: DataFrame, chosen: DataFrame, width: int, depth: int) -> DataFrame:
    """The pieces of the chosen runs: (k1, k2, g, f, lo, hi, a, settled), where g
    now stands for the run's first digit with the piece and its third digit, f
    for the fourth."""
    per_row = stored(chosen.groupBy("k1", "k2").agg(
        F.collect_list(F.struct("g", "lo", "hi", "a", "settled")).alias("runs")), "radix-chosen")
    maybe, _ = split_by_keys(rows, per_row, ["k1", "k2"])
    both = maybe.select("k1", "k2", "text").join(per_row, ["k1", "k2"])

    def run(batches):
        for b in batches:
            out = []
            for k1, k2, text, runs in zip(*(c.to_pylist() for c in b.columns), strict=True):
                g, lo, hi, a, settled = (np.array([r[c] for r in runs])
                                         for c in ("g", "lo", "hi", "a", "settled"))
                of, piece, core, whole, start, end = pieces_of(text, lo, hi, a, width, depth)
                key = mix(g[of].view(np.uint64) + mix(piece.astype(np.uint64))) ^ core
                n = len(of)
                out.append((np.full(n, k1), np.full(n, k2), mix(key), whole, start, end, a[of],
                            settled[of]))
            if out:
                cols = [np.concatenate(c) for c in zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*(_i64(c) for c in cols[:7]), pa.array(cols[7], pa.bool_())],
                    names=["k1", "k2", "g", "f", "lo", "hi", "a", "settled"])

    return stored(both.mapInArrow(
        run, "k1 bigint, k2 bigint, g bigint, f bigint, lo bigint, hi bigint, a bigint, settled boolean"),
        "radix-piece")


def _pass(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One pass over runs or pieces (k1, k2, g, f, lo, hi, a, settled).

    Returns (k1, k2, lo, hi) of those not settled before whose whole text f
    occurs twice, and, from the groups of equal g with different f, one of each
    kind to be opened.
    """
    first = stored(items.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min("f").alias("f0"),
                                          F.max("f").alias("f1")).where(F.col("n") > 1)
                   .select("g", "n", (F.col("f0") != F.col("f1")).alias("mixed")), "radix-first")
    live = stored(hot_join(items, first, ["g"], rows="n", how="inner"), "radix-live")
    second = stored(live.groupBy("g", "f").agg(
        F.count(F.lit(1)).alias("n"), F.first("mixed").alias("mixed"), F.max("settled").alias("settled"),
        F.min(F.struct("k1", "k2", "lo", "hi", "a")).alias("r")), "radix-second")
    again = second.where(F.col("n") > 1)
    whole = hot_join(live.where(~F.col("settled")).drop("mixed", "settled"), again.select("g", "f", "n"),
                     ["g", "f"], rows="n", how="inner").select("k1", "k2", "lo", "hi")
    chosen = second.where("mixed").select("r.*", "g", (F.col("settled") | (F.col("n") > 1)).alias("settled"))
    return whole, chosen


def repeated_windows(rows: DataFrame, depth: int = DEPTH, digit: int = DIGIT) -> DataFrame:
    """(k1, k2, lo, hi): runs of starts of windows that occur elsewhere too."""
    runs = stored(_runs(rows, depth, digit), "radix-run").withColumn("settled", F.lit(False))
    found, chosen = _pass(runs)
    more, chosen = _pass(_opened(rows, chosen, min(PIECE, depth), depth))
    windows = _opened(rows, chosen, 1, depth)  # a piece of one window: g and f say the same
    last, _ = _pass(windows)
    return found.unionByName(more).unionByName(last)


def cut(text: bytes, runs: list, depth: int) -> tuple[int, int, bytes]:
    """(bytes removed, removed stretches, bytes left)."""
    if not runs:
        return 0, 0, text
    n = len(text)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, [r["lo"] for r in runs], 1)
    np.add.at(edge, [r["hi"] + depth for r in runs], -1)
    gone = np.cumsum(edge[:-1]) > 0
    spans = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1]))
    return int(gone.sum()), spans, np.frombuffer(text, np.uint8)[~gone].tobytes()


def remove_repeats(docs: DataFrame, depth: int = DEPTH, digit: int = DIGIT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept), one row per row of ``docs``."""
    rows = _rows(docs)
    per_row = stored(repeated_windows(rows, depth, digit).groupBy("k1", "k2")
                     .agg(F.collect_set(F.struct("lo", "hi")).alias("runs")), "radix-marks")
    maybe, clean = split_by_keys(rows, per_row, ["k1", "k2"])
    none = F.lit(None).cast(per_row.schema["runs"].dataType).alias("runs")
    both = (maybe.join(per_row, ["k1", "k2"], "left").select("doc_id", "text", "runs")
            .unionByName(clean.select("doc_id", "text", none)))

    def run(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            out = [cut(t, r, depth) for t, r in zip(texts, b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(c, pa.int64()) for c in (
                    [len(t) for t in texts], [o[0] for o in out], [o[1] for o in out])),
                 pa.array([hashlib.sha256(o[2]).hexdigest() for o in out], pa.string()),
                 pa.array([o[2] for o in out], pa.binary())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return both.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, "
                           "kept_sha256 string, kept binary")
