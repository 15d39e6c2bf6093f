"""Operator 13, spelling variants: words that differ by one edit, by blocked Gram matrices.

Words are counted over all documents. A word is the vector of its letter
counts; one inserted, deleted or replaced letter changes at most two of them
by one, so the squared distance of two near words is at most two. Distances
come from products of blocks of such vectors (the Gram matrix, |a|^2 + |b|^2 -
2ab), only between words of equal or adjacent lengths; pairs at most two apart
are verified letter by letter.

Which words meet: an edit leaves the first or the second half of a word alone.
A pair is halved by its shorter word (of l letters: the first l // 2, and the
last of the rest), so a word goes to three blocks: two lengths have it as the
shorter or the longer one, with a first half of the same length or a second one.
In a block only words of the same half are compared. The number of blocks
follows the number of words (``BLOCK`` rows each), so the products grow in
proportion to them. A block of more than ``TILE`` rows (a common half) is dealt
again: the letters are dealt to three sets by frequency, and an edit leaves the
counts of at least one of them alone, so its words meet by their counts in a set.
What is still larger then is cut into tiles, and each pair of tiles is a unit. A
pair is given out only where its first agreeing half and set lead, so once.

The form of a word has at least twice its count, so forms lead to a root in at
most 63 steps; roots are found by pointer doubling.

Defined results: null and empty texts have no words; for a null doc_id
the hashed text begins with the colon. Rows that repeat an id are
counted each. Very long runs are words like others. Equal counts among near
words: the smallest in code-point order is the form. Empty tables give no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockbook.llm.common import hot_join, id_and_text, segments, stored

LEAST_LETTERS, LEAST_COUNT = 5, 3
DROP = 97  # a run loses a letter if this divides its hash
SETS = 3
HALVES = 2  # the first and the second
BLOCK, TILE = 4096, 8192
GROUP, PRODUCTS = 128, 1 << 20  # words of a small group; entries of Gram matrices made at once
KEPT_WORDS = 200_000  # words that a counting task keeps before it gives them out

# The letters of a run are A-Z, a-z and U+00C0 to U+00FF; only A-Z are lower-cased.
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 0x20 for b in range(256))
_LETTERS = [*range(97, 123), *range(0xC0, 0x100)]
_PLACE = np.full(256, -1, np.int64)
_PLACE[_LETTERS] = np.arange(len(_LETTERS))
_SEED = np.random.default_rng(20).integers(1, 2**63, len(_LETTERS), dtype=np.int64).view(np.uint64) | np.uint64(1)


def runs(text: str | None) -> list[bytes]:
    """The lower-cased letter runs, in Latin-1 (which holds all their letters)."""
    return text.encode("latin-1", "replace").translate(_LOWER).split() if text else []


def altered(doc_id: int | None, words: set[bytes]) -> dict[bytes, bytes]:
    """The words of a document that lose a letter, and what they become."""
    start = crc32(b"" if doc_id is None else str(doc_id).encode())
    start = crc32(b":", start)
    out = {}
    for w in words:
        h = crc32(w if w.isascii() else w.decode("latin-1").encode(), start)
        if h % DROP == 0:
            p = h % len(w)
            out[w] = w[:p] + w[p + 1:]
    return out


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) of all words of at least ``LEAST_LETTERS`` letters, any count."""
    base = id_and_text(docs, "string")
    target = base.sparkSession.createDataFrame([], "word string, n bigint").schema

    def given(total: Counter) -> pa.RecordBatch:
        kept = [(w, n) for w, n in total.items() if n > 0 and len(w) >= LEAST_LETTERS]
        return pa.RecordBatch.from_arrays(
            [pa.array([w.decode("latin-1") for w, _ in kept], pa.string()),
             pa.array([n for _, n in kept], pa.int64())], names=["word", "n"])

    def run(batches):
        total: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = runs(text.as_py())
                total.update(words)
                for w, new in altered(doc_id, set(words)).items():
                    n = words.count(w)
                    total[w] -= n
                    total[new] += n
                if len(total) > KEPT_WORDS:
                    yield given(total)
                    total = Counter()
        yield given(total)

    counted = base.mapInArrow(run, target)
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def letter_counts(words: list[bytes]) -> np.ndarray:
    """(word, letter) counts."""
    size = np.array([len(w) for w in words], np.int64)
    letter = _PLACE[np.frombuffer(b"".join(words), np.uint8)]
    flat = np.repeat(np.arange(len(words)) * len(_LETTERS), size) + letter
    return np.bincount(flat, minlength=len(words) * len(_LETTERS)).reshape(len(words), len(_LETTERS))


class LetterSets:
    """Three sets of letters."""

    def __init__(self, totals: np.ndarray):
        """Letters are dealt back and forth from the most frequent on."""
        turn = [*range(SETS), *reversed(range(SETS))]
        self.first = np.zeros(len(_LETTERS), np.int64)
        self.first[np.lexsort((np.arange(len(totals)), -totals))] = [
            turn[k % len(turn)] for k in range(len(totals))]

    def levels(self, path: tuple[int, ...]) -> list[tuple[np.ndarray, int]]:
        """The (sets, chosen set) that lead to a block: none, or one pair."""
        return [(self.first, s) for s in path]


def signatures(counts: np.ndarray, sets: np.ndarray) -> np.ndarray:
    """(set, word) hashes of the counts in each set of letters."""
    out = []
    for s in range(SETS):
        at = np.flatnonzero(sets == s)
        h = (counts[:, at].astype(np.uint64) * _SEED[at]).sum(axis=1, dtype=np.uint64)
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        out.append(h ^ (h >> np.uint64(29)))
    return np.array(out)


def first_agreeing(a: np.ndarray, b: np.ndarray, levels: list[tuple[np.ndarray, int]]) -> np.ndarray:
    """Which rows of counts agree in the chosen set of each level and in no set before it."""
    keep = np.ones(len(a), bool)
    for sets, chosen in levels:
        for s in range(chosen + 1):
            same = (a[:, sets == s] == b[:, sets == s]).all(axis=1)
            keep &= same if s == chosen else ~same
    return keep


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of ``a`` become those of ``b`` by one replaced letter, or, where
    ``b`` is one letter longer, by one inserted letter."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(axis=1) == 1
    head = (a == b[:, :-1]).cumprod(axis=1).sum(axis=1)  # letters that agree from the start
    tail = (a == b[:, 1:])[:, ::-1].cumprod(axis=1).sum(axis=1)
    return head + tail >= a.shape[1]


class _ByLength:
    """The letters of words as one matrix for each length."""

    def __init__(self, words: list[bytes], size: np.ndarray):
        self.row = np.zeros(len(words), np.int64)
        self.of = {}
        for length, lo, hi in _runs_of(np.sort(size)):
            at = np.flatnonzero(size == length)
            self.row[at] = np.arange(hi - lo)
            self.of[int(length)] = np.frombuffer(
                b"".join([words[k] for k in at.tolist()]), np.uint8).reshape(hi - lo, int(length))

    def __call__(self, at: np.ndarray, length: int) -> np.ndarray:
        return self.of[length][self.row[at]]


def near_pairs(words: list[bytes], tile: np.ndarray | None, levels: list[tuple[np.ndarray, int]],
               half: int | None = None, part: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of near words whose first agreeing half and sets are ``half`` and those of ``levels``.

    Words meet that have the same first (``half`` 0) or last ``part`` letters and
    the same counts in the chosen sets: a block holds many such groups. Without
    ``half`` only the sets count. With ``tile`` only pairs between words of
    different tiles are looked for.
    """
    size = np.array([len(w) for w in words], np.int64)
    counts = letter_counts(words)
    sign = np.zeros(len(words), np.uint64)
    for sets, chosen in levels:
        sign = sign * _SEED[0] + signatures(counts, sets)[chosen]
    same = np.zeros(len(words), np.int64)
    if half is not None:
        known: dict[bytes, int] = {}
        same[:] = [known.setdefault(w[:p] if half == 0 else w[len(w) - p:], len(known))
                   for w, p in zip(words, part.tolist(), strict=True)]
    order = np.lexsort((size, sign, same))
    words, size, counts = [words[i] for i in order.tolist()], size[order], counts[order]
    group = np.cumsum((np.diff(sign[order], prepend=sign[order[:1]]) != 0)
                      | (np.diff(same[order], prepend=same[order[:1]]) != 0))
    differ = counts.any(axis=0)  # letters whose counts may differ in a group
    for sets, chosen in levels:
        differ &= sets != chosen
    # with halves, the longest words of a group meet there only shorter ones
    shorter = () if half is None else (size // 2 <= part[order] if half == 0 else (size + 1) // 2 <= part[order],)
    letters = _ByLength(words, size)
    left, right = [], []
    for i, j in _candidates(counts[:, differ], group, size, *shorter):
        if tile is not None:
            keep = tile[order[i]] != tile[order[j]]
            i, j = i[keep], j[keep]
        shape = np.lexsort((size[j], size[i]))
        i, j = i[shape], j[shape]
        for _, lo, hi in _runs_of(2 * size[i] + (size[j] > size[i])):
            length, other = int(size[i[lo]]), int(size[j[lo]])
            step = max(1, 4_000_000 // other)  # bounded copies of very long words
            for at in range(lo, hi, step):
                u, v = i[at:min(at + step, hi)], j[at:min(at + step, hi)]
                a, b = letters(u, length), letters(v, other)
                ok = one_edit(a, b)
                if half:
                    ok &= (a[:, :length // 2] != b[:, :length // 2]).any(axis=1)
                u, v = u[ok], v[ok]
                if levels:
                    ok = first_agreeing(counts[u], counts[v], levels)
                    u, v = u[ok], v[ok]
                left.append(order[u])
                right.append(order[v])
    none = [np.zeros(0, np.int64)]
    return np.concatenate(left or none), np.concatenate(right or none)


def _candidates(counts: np.ndarray, group: np.ndarray, size: np.ndarray, shorter: np.ndarray | None = None):
    """Parts of the pairs (i, j) of rows of one group, ``j`` as long as ``i`` or one
    letter longer, at squared distance two or less; only rows of ``shorter`` are an
    ``i``. Rows are in order of group and size. The rows of a group and a size and
    those behind them, one letter longer, make a Gram matrix; small ones are made together."""
    longest = int(size.max(initial=0))
    key = group * (longest + 2) + size
    kind = np.float32 if longest < 1000 else np.float64  # exact: halves of whole numbers below 2^24 or 2^53
    x = counts.astype(kind)
    norm = (x * x).sum(axis=1, keepdims=True) / 2
    one = np.ones_like(norm)
    a, b = np.hstack([x, one, -norm]), np.hstack([x, -norm, one])  # a row of a by one of b: -1/2 of the distance
    first = np.flatnonzero(np.diff(key, prepend=-1))
    rows = np.diff(first, append=len(key))
    wide = np.searchsorted(key, key[first] + 1, side="right") - first
    use = wide > 1
    if shorter is not None:
        use &= shorter[first]
    first, rows, wide = first[use], rows[use], wide[use]
    small = np.flatnonzero(wide <= GROUP)
    pad = np.zeros(len(wide), np.int64)
    pad[small] = 1 << np.ceil(np.log2(wide[small])).astype(np.int64)
    for width in np.unique(pad[small]).tolist():
        these = np.flatnonzero(pad == width)
        step = max(1, PRODUCTS // (width * max(width, a.shape[1])))
        ahead = np.triu(np.ones((width, width), bool), 1)
        place = np.arange(width)
        for lo in range(0, len(these), step):
            at = these[lo:lo + step]
            where = np.minimum(first[at, None] + place, len(x) - 1)
            near = a[where] @ b[where].transpose(0, 2, 1) >= -1
            near &= ahead
            near &= (place < rows[at, None])[:, :, None]
            near &= (place < wide[at, None])[:, None, :]
            c, i, j = np.nonzero(near)
            yield first[at[c]] + i, first[at[c]] + j
    for at in np.flatnonzero(wide > GROUP).tolist():
        lo, end, last = int(first[at]), int(first[at] + rows[at]), int(first[at] + wide[at])
        while lo < end:
            till = min(end, lo + max(1, PRODUCTS // (last - lo)))
            i, j = np.nonzero(a[lo:till] @ b[lo:last].T >= -1)
            keep = j > i
            yield i[keep] + lo, j[keep] + lo
            lo = till


def _runs_of(ascending: np.ndarray):
    edges = np.flatnonzero(np.diff(ascending)) + 1
    bounds = [0, *edges.tolist(), len(ascending)]
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        if hi > lo:
            yield ascending[lo], lo, hi


def letter_sets(words: DataFrame) -> LetterSets:
    """The sets for a written ``words``; one number per letter comes to the driver."""
    def run(batches):
        total = np.zeros(len(_LETTERS), np.int64)
        for batch in batches:
            text = b"".join(w.encode("latin-1") for w in batch.column(0).to_pylist())
            total += np.bincount(_PLACE[np.frombuffer(text, np.uint8)], minlength=len(_LETTERS))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(_LETTERS))), pa.array(total)],
                                         names=["letter", "n"])

    totals = np.zeros(len(_LETTERS), np.int64)
    counted = words.select("word").mapInArrow(run, "letter bigint, n bigint")
    for r in counted.groupBy("letter").agg(F.sum("n").alias("n")).collect():
        totals[r["letter"]] = r["n"]
    return LetterSets(totals)


def _halved(words: DataFrame, blocks: int) -> DataFrame:
    """(word, n, part, path, block): each word with its halves, ``part`` letters
    of the first (path 0) or the second, as the shorter word of a pair or the longer."""
    size = F.length("word")
    first = F.array_distinct(F.array((size / 2).cast("int"), ((size - 1) / 2).cast("int")))
    second = F.array_distinct(F.array(((size + 1) / 2).cast("int"), (size / 2).cast("int")))
    rows = words.select("word", "n", F.explode(F.concat(
        F.transform(first, lambda p: F.struct(p.alias("part"), F.lit(0).alias("path"))),
        F.transform(second, lambda p: F.struct(p.alias("part"), F.lit(1).alias("path"))))).alias("h"))
    rows = rows.select("word", "n", "h.part", "h.path")
    half = F.when(F.col("path") == 0, F.expr("left(word, part)")).otherwise(F.expr("right(word, part)"))
    return rows.withColumn("block", F.pmod(F.xxhash64(half), F.lit(blocks)))


def _dealt(rows: DataFrame, sets: LetterSets, blocks: int) -> DataFrame:
    """Rows of halves once per set of letters: (word, n, part, path, block), the
    path now of half and set, the block by the half and the counts in the set."""
    target = rows.sparkSession.createDataFrame(
        [], "word string, n bigint, part int, path int, block bigint").schema

    def run(batches):
        for batch in batches:
            words = [w.encode("latin-1") for w in batch.column(0).to_pylist()]
            part, path = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            same = [crc32(w[:p] if h == 0 else w[len(w) - p:])
                    for w, p, h in zip(words, part.tolist(), path.tolist(), strict=True)]
            sign = signatures(letter_counts(words), sets.first) ^ (np.array(same, np.uint64) * _SEED[0])
            for s in range(SETS):
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:3], pa.array((path * SETS + s).astype(np.int32)),
                     pa.array((sign[s] % np.uint64(blocks)).astype(np.int64))], names=target.names)

    return rows.select("word", "n", "part", "path").mapInArrow(run, target)


def _paired(units: DataFrame, sets: LetterSets | None = None) -> DataFrame:
    """The near pairs of each unit (path, block, x, y): one block, or two tiles."""
    def compare(key, table):
        half, *path = divmod(key[0].as_py(), SETS) if sets else (key[0].as_py(),)
        word, n = table.column("word").combine_chunks(), table.column("n").combine_chunks()
        tile = table.column("tile").to_numpy() if key[2].as_py() != key[3].as_py() else None
        i, j = near_pairs([w.encode("latin-1") for w in word.to_pylist()], tile,
                          sets.levels(tuple(path)) if sets else [], half, table.column("part").to_numpy())
        return pa.table({"word": word.take(pa.array(i)), "n": n.take(pa.array(i)),
                         "other": word.take(pa.array(j)), "other_n": n.take(pa.array(j))})

    return units.groupBy("path", "block", "x", "y").applyInArrow(
        compare, "word string, n bigint, other string, other_n bigint")


def _large(placed: DataFrame, limit: int) -> DataFrame:
    """(path, block, rows) of the blocks with more than ``limit`` words."""
    sizes = placed.groupBy("path", "block").agg(F.count(F.lit(1)).alias("rows"))
    return stored(sizes.where(F.col("rows") > limit), "spell-large")


def near_words(words: DataFrame, block: int = BLOCK, tile: int = TILE) -> DataFrame:
    """(word, n, other, other_n): each near pair of a written ``words`` (word, n), once."""
    unit, row = ["path", "block"], ["part", "word", "n"]
    placed = stored(_halved(words, max(1, -(-3 * words.count() // (HALVES * block)))), "spell-block")
    large = _large(placed, tile)
    marked = stored(hot_join(placed, large.withColumn("again", F.lit(True)), unit), "spell-marked")
    zero = F.lit(0).alias
    whole = marked.where(F.col("again").isNull()).select(*unit, zero("x"), zero("y"), zero("tile"), *row)
    pairs = _paired(whole)
    again = marked.where(F.col("again"))
    n_again = again.count()
    if not n_again:
        return pairs
    sets = letter_sets(words)
    deeper = stored(_dealt(again, sets, max(1, -(-n_again // (HALVES * block)))), "spell-deeper")
    tiles = _large(deeper, 2 * tile).withColumn("tiles", F.ceil(F.col("rows") / tile).cast("int"))
    dealt = (hot_join(deeper, tiles, unit).withColumn("tiles", F.coalesce("tiles", F.lit(1)))
             .withColumn("tile", F.pmod(F.xxhash64("word"), "tiles").cast("int"))
             .withColumn("with", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))))
    units = dealt.select(*unit, F.least("tile", "with").alias("x"), F.greatest("tile", "with").alias("y"),
                         "tile", *row)
    return pairs.unionByName(_paired(units, sets))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): where the forms of each word end."""
    at = stored(forms.select("word", F.col("form").alias("root")), "spell-root")
    while True:
        named = at.groupBy(F.col("root").alias("word")).agg(F.count(F.lit(1)).alias("rows"))
        onward = stored(named.join(at, "word").select(
            F.col("word").alias("root"), F.col("root").alias("next"), "rows"), "spell-onward")
        if onward.isEmpty():
            return at
        at = stored(hot_join(at, onward, ["root"]).select(
            "word", F.coalesce("next", "root").alias("root")), "spell-root")


def variants(docs: DataFrame, block: int = BLOCK, tile: int = TILE) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of ``docs``."""
    words = stored(word_counts(docs), "spell-words")
    pairs = stored(near_words(words, block, tile), "spell-pairs")
    both = pairs.select("word", "n", "other", "other_n").union(
        pairs.select(F.col("other"), F.col("other_n"), F.col("word"), F.col("n")))
    best = F.min(F.struct((-F.col("other_n")).alias("m"), F.col("other").alias("w")))
    near = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("b"))
    formed = F.coalesce(-F.col("b.m") >= 2 * F.col("n"), F.lit(False))
    judged = stored(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(formed, F.col("b.w")).alias("form"),
        F.when(formed, -F.col("b.m")).alias("form_n")), "spell-judged")
    ends = roots(judged.where(F.col("form").isNotNull()))
    return judged.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
