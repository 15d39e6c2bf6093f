"""Operator 11, ranked lexical search: exact inner products in sparse ball trees.

A document is the sparse vector of ``weight * x`` over the terms of the items
(both factors are integers, see ``term_scores``), an item the indicator of its
terms, so the score is their inner product. Documents are dealt to pivots
(sampled documents) by cosine and cut into bounded subtrees; a task builds the
ball tree of a subtree (centroid and radius of every node, split between two
far documents) and searches it for every item, best bound first:

    score <= item . centroid + sqrt(terms of the item that the node holds) * radius

The bound is computed in doubles and rounded up by more than the rounding
errors, so a node is left out only if no document in it can reach the item's
threshold. Leaves are scored with 64-bit integers. The threshold starts at the
tenth best score in a sample of documents (a valid lower bound whatever the
sample) and rises with the subtree's own best.

Bounds: items are taken in blocks of at most ``MAX_ITEMS`` items and about
``MAX_TERMS`` terms (one item may exceed it), each searched in a pass of its
own; a block's terms and weights are broadcast. ``SAMPLE`` documents give
thresholds and ``PIVOTS`` (fewer when the block has many terms) the deal. A
subtree holds about ``SUBTREE`` documents or ``NONZEROS`` entries. Counts and
document frequencies cover all documents.

Defined results: null and empty texts have no terms, so they count in no
statistic and are never found. Every row is a document, also those that repeat
an id (equal rows take ranks one after the other); a null doc_id is found like
any other and ranked first among equal scores. Every benchmark row is an item;
an item without terms, or whose terms no document has, gives no row. Equal
scores are ranked by doc_id. Empty tables give no rows; other columns are
ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stockbook.llm.common import map_docs, segments, stored, word_bytes

TOP = 10
MAX_ITEMS, MAX_TERMS = 1000, 200_000
SAMPLE, PIVOTS = 2048, 64
SUBTREE, NONZEROS, LEAF = 1024, 1_000_000, 32
SCALE = 1_000_000_000


# ------------------------------------------------------------------ items

@dataclass
class Items:
    """A block of items: their ids, and the terms of item k at term[start[k]:start[k + 1]]."""

    ids: list
    vocabulary: dict[bytes, int]
    term: np.ndarray
    start: np.ndarray


def item_blocks(items: DataFrame, key: str = "item_id", text: str = "text",
                max_items: int = MAX_ITEMS, max_terms: int = MAX_TERMS) -> Iterator[Items]:
    """Blocks of the rows that have terms; the driver holds one at a time."""
    rows = items.select(F.col(key).cast("bigint").alias("k"), F.col(text).cast("binary").alias("t"))
    ids, lists, vocabulary, held = [], [], {}, 0

    def block() -> Items:
        return Items(ids, vocabulary, np.array([t for x in lists for t in x], np.int64),
                     segments(np.array([len(x) for x in lists], np.int64)))

    for row in rows.orderBy("k", "t").toLocalIterator():
        words = dict.fromkeys(word_bytes(row["t"]))
        if not words:
            continue
        if ids and (len(ids) >= max_items or held + len(words) > max_terms):
            yield block()
            ids, lists, vocabulary, held = [], [], {}, 0
        ids.append(row["k"])
        lists.append([vocabulary.setdefault(w, len(vocabulary)) for w in words])
        held += len(words)
    if ids:
        yield block()


# ------------------------------------------------------------------ documents

def term_counts(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, t, f) of every row: its number of terms, and the ascending
    numbers and frequencies of those in ``vocabulary``."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(ids, texts, known):
        sizes, terms, counts = [], [], []
        for data in texts:
            words = word_bytes(data)
            sizes.append(len(words))
            found = [x for x in map(known, words) if x is not None]
            t, f = np.unique(np.array(found, np.int64), return_counts=True)
            terms.append(t)
            counts.append(f)
        at = segments(np.array([len(t) for t in terms], np.int64)).astype(np.int32)

        def lists(parts):
            return pa.ListArray.from_arrays(at, pa.array(np.concatenate(parts) if parts else [], pa.int64()))

        return {"doc_id": ids, "n": sizes, "t": lists(terms), "f": lists(counts)}

    return map_docs(docs, run, "doc_id bigint, n bigint, t array<bigint>, f array<bigint>",
                    setup=lambda: shared.value.get)


@dataclass
class Corpus:
    """Statistics of all documents: N, L and the weight of each term of the block."""

    documents: int
    length: int
    weight: np.ndarray


def corpus_statistics(counted: DataFrame, terms: int) -> Corpus:
    """From a written table of ``term_counts``; one number per term of the block
    comes to the driver."""
    row = counted.agg(F.count(F.when(F.col("n") > 0, F.lit(1))).alias("d"),
                      F.coalesce(F.sum("n"), F.lit(0)).alias("l")).first()
    weight = np.zeros(terms, np.int64)
    for r in counted.select(F.explode("t").alias("t")).groupBy("t").count().toLocalIterator():
        weight[r["t"]] = math.floor(1000 * math.log((2 * row["d"] + 2) / (2 * r["count"] + 1)))
    return Corpus(row["d"], row["l"], weight)


def term_scores(corpus: Corpus, n: int, t: np.ndarray, f: np.ndarray) -> np.ndarray:
    """Integer score of each term ``t`` that occurs ``f`` times in a document of ``n`` terms."""
    m = 100 - 90 + (90 * n * corpus.documents) // corpus.length
    return corpus.weight[t] * ((SCALE * f) // (1000 * f + 8 * m))


@dataclass
class Sparse:
    """Documents as rows of a sparse integer matrix."""

    ids: list
    term: np.ndarray
    value: np.ndarray
    start: np.ndarray

    def rows(self, order: np.ndarray) -> Sparse:
        size = np.diff(self.start)[order]
        start = segments(size)
        at = np.arange(start[-1]) + np.repeat(self.start[:-1][order] - start[:-1], size)
        return Sparse([self.ids[i] for i in order], self.term[at], self.value[at], start)

    def row_sums(self, entries: np.ndarray) -> np.ndarray:
        """Sums of ``entries`` (one per stored entry) of each row."""
        total = np.concatenate((np.zeros(1, entries.dtype), np.cumsum(entries)))
        return total[self.start[1:]] - total[self.start[:-1]]


def sparse_rows(table: pa.Table, corpus: Corpus) -> Sparse:
    ids, sizes = table.column("doc_id").to_pylist(), table.column("n").to_pylist()
    terms, counts = table.column("t"), table.column("f")
    found, values = [], []
    for i, n in enumerate(sizes):
        t, f = terms[i].values.to_numpy(), counts[i].values.to_numpy()
        v = term_scores(corpus, n, t, f) if len(t) else t
        found.append(t[v > 0])
        values.append(v[v > 0])
    none = [np.zeros(0, np.int64)]
    return Sparse(ids, np.concatenate(found or none), np.concatenate(values or none),
                  segments(np.array([len(t) for t in found], np.int64)))


def item_scores(docs: Sparse, wanted: np.ndarray) -> np.ndarray:
    """64-bit integer scores of ``docs`` for an item (``wanted`` flags its terms)."""
    return docs.row_sums(np.where(wanted[docs.term], docs.value, 0))


# ------------------------------------------------------------------ the tree

class BallTree:
    """Nodes of a subtree; the documents of a leaf are neighbours in ``docs``."""

    def __init__(self, docs: Sparse, leaf: int = LEAF):
        self.terms, local = np.unique(docs.term, return_inverse=True)
        docs = Sparse(docs.ids, local, docs.value, docs.start)
        order = np.arange(len(docs.ids))
        self.children: list[tuple[int, int] | None] = []
        self.span: list[tuple[int, int]] = []
        self._balls: list[tuple[np.ndarray, np.ndarray, float]] = []
        stack = [(0, len(order), -1, 0)]
        while stack:
            lo, hi, parent, side = stack.pop()
            me = len(self.span)
            if parent >= 0:
                left, right = self.children[parent]
                self.children[parent] = (me, right) if side == 0 else (left, me)
            part = docs.rows(order[lo:hi])
            far = self._ball(part)
            self.span.append((lo, hi))
            self.children.append(None)
            if hi - lo > leaf:
                cut, turn = self._split(part, far)
                order[lo:hi] = order[lo:hi][turn]
                self.children[me] = (-1, -1)
                stack += [(lo, lo + cut, me, 0), (lo + cut, hi, me, 1)]
        self.docs = docs.rows(order)

    def _ball(self, part: Sparse) -> int:
        """Adds centroid, held terms and a safely rounded radius; returns the farthest row."""
        m, width = len(part.ids), len(self.terms)
        value = part.value.astype(np.float64)
        centre = np.bincount(part.term, weights=value, minlength=width) / max(m, 1)
        norm, middle = part.row_sums(value * value), float((centre * centre).sum())
        square = norm - 2.0 * part.row_sums(value * centre[part.term]) + middle
        # cancellation may lose some 1e-13 of the squares; 1e-10 of them is added
        radius = math.sqrt(max(float(square.max(initial=0.0)), 0.0)
                           + 1e-10 * (float(norm.sum()) + middle) + 1e-3)
        held = np.zeros(width, bool)
        held[part.term] = True
        self._balls.append((centre, held, radius))
        return int(square.argmax()) if m else 0

    def _split(self, part: Sparse, a: int) -> tuple[int, np.ndarray]:
        """(size of the first half, order): rows nearer to the row farthest from
        the centre, then those nearer to the row farthest from that one."""
        value = part.value.astype(np.float64)
        norm = part.row_sums(value * value)

        def to(row: int) -> np.ndarray:
            dense = np.zeros(len(self.terms))
            at = slice(part.start[row], part.start[row + 1])
            dense[part.term[at]] = value[at]
            return norm - 2.0 * part.row_sums(value * dense[part.term]) + norm[row]

        first = to(a)
        lean = first - to(int(first.argmax()))
        turn = np.argsort(lean, kind="stable")
        cut = int(np.count_nonzero(lean < 0))
        least = max(1, len(turn) // 8)
        if not least <= cut <= len(turn) - least:
            cut = len(turn) // 2  # also equal rows: a lopsided cut would make a deep tree
        return cut, turn

    def bounds(self, items: Items) -> np.ndarray:
        """(node, item): no document of the node scores more for the item."""
        place = np.searchsorted(self.terms, items.term)
        place[place == len(self.terms)] = 0
        known = self.terms[place] == items.term if len(self.terms) else np.zeros(len(place), bool)
        owner = np.repeat(np.arange(len(items.ids)), np.diff(items.start))[known]
        place = place[known]
        out = np.zeros((len(self._balls), len(items.ids)))
        for node, (centre, held, radius) in enumerate(self._balls):
            shared = np.bincount(owner, weights=held[place], minlength=len(items.ids))
            along = np.bincount(owner, weights=centre[place], minlength=len(items.ids))
            out[node] = np.where(shared > 0, (along + np.sqrt(shared) * radius) * (1 + 1e-9) + 1.0, 0.0)
        return out

    def search(self, bounds: np.ndarray, wanted: np.ndarray, least: int, k: int) -> list[tuple[int, object]]:
        """The (score, doc_id) of at most ``k`` documents of positive score that
        reach ``least``, best first; ``bounds`` are those of the item."""
        best: list[tuple[int, object]] = []
        heap = [(-bounds[0], 0)]
        while heap and -heap[0][0] >= max(least, 1):
            _, node = heapq.heappop(heap)
            if self.children[node]:
                for child in self.children[node]:
                    if bounds[child] >= max(least, 1):
                        heapq.heappush(heap, (-bounds[child], child))
                continue
            lo, hi = self.span[node]
            at = slice(self.docs.start[lo], self.docs.start[hi])
            value = np.where(wanted[self.docs.term[at]], self.docs.value[at], 0)
            total = np.concatenate((np.zeros(1, np.int64), np.cumsum(value)))
            edge = self.docs.start[lo:hi + 1] - self.docs.start[lo]
            score = total[edge[1:]] - total[edge[:-1]]
            good = np.flatnonzero(score >= max(least, 1))
            if len(good):
                best += [(int(score[i]), self.docs.ids[lo + i]) for i in good.tolist()]
                best.sort(key=_rank)
                del best[k:]
                if len(best) == k:
                    least = max(least, best[-1][0])
        return best


def _rank(hit: tuple[int, object]) -> tuple:
    """Order of hits: higher scores first, then a null id, then smaller ids."""
    score, doc = hit
    return -score, doc is not None, doc if doc is not None else 0


def search_documents(docs: Sparse, items: Items, least: np.ndarray, k: int) -> list[tuple]:
    """(item number, doc_id, score) of what a subtree of ``docs`` has for each item."""
    if not len(docs.term):
        return []
    tree = BallTree(docs)
    bounds = tree.bounds(items)
    wanted = np.zeros(len(tree.terms), bool)
    out = []
    for k_item in np.flatnonzero(bounds[0] >= np.maximum(least, 1)).tolist():
        term = items.term[items.start[k_item]:items.start[k_item + 1]]
        at = np.searchsorted(tree.terms, term)
        at = at[at < len(tree.terms)]
        at = at[np.isin(tree.terms[at], term)]
        wanted[at] = True
        for score, doc in tree.search(bounds[:, k_item], wanted, int(least[k_item]), k):
            out.append((k_item, doc, score))
        wanted[at] = False
    return out


# ------------------------------------------------------------------ the job

def _thresholds(sample: Sparse, items: Items, terms: int, k: int) -> np.ndarray:
    """The k-th best score of each item in the sample (0 if fewer are positive)."""
    out = np.zeros(len(items.ids), np.int64)
    if len(sample.ids) < k:
        return out
    wanted = np.zeros(terms, bool)
    for i in range(len(items.ids)):
        term = items.term[items.start[i]:items.start[i + 1]]
        wanted[term] = True
        out[i] = np.partition(item_scores(sample, wanted), -k)[-k]
        wanted[term] = False
    return out


def _pivots(sample: Sparse, terms: int, most: int) -> np.ndarray:
    """(term, pivot): unit vectors of the first sampled documents that have terms."""
    most = max(1, min(most, 4_000_000 // max(terms, 1)))
    rows = np.flatnonzero(np.diff(sample.start) > 0)[:most]
    out = np.zeros((terms, max(len(rows), 1)), np.float32)
    for k, i in enumerate(rows.tolist()):
        at = slice(sample.start[i], sample.start[i + 1])
        v = sample.value[at].astype(np.float64)
        out[sample.term[at], k] = v / math.sqrt(float((v * v).sum()))
    return out


def _dealt(counted: DataFrame, corpus: Corpus, pivots: np.ndarray) -> DataFrame:
    """The documents that have item terms, with the number of their nearest pivot."""
    shared = counted.sparkSession.sparkContext.broadcast((corpus, pivots))
    rows = counted.where(F.size("t") > 0)
    target = counted.sparkSession.createDataFrame(
        [], "doc_id bigint, n bigint, t array<bigint>, f array<bigint>, pivot int").schema

    def run(batches):
        corpus, pivots = shared.value
        for batch in batches:
            docs = sparse_rows(pa.Table.from_batches([batch]), corpus)
            at = []
            for i in range(len(docs.ids)):
                s = slice(docs.start[i], docs.start[i + 1])
                at.append(int((docs.value[s].astype(np.float32) @ pivots[docs.term[s]]).argmax()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int32())],
                                             names=target.names)

    return rows.mapInArrow(run, target)


def _search_block(docs: DataFrame, items: Items, k: int, subtree: int, sample: int) -> DataFrame:
    """(item, doc_id, score): candidates of a block of items, every item's best among them."""
    spark = docs.sparkSession
    terms = len(items.vocabulary)
    counted = stored(term_counts(docs, items.vocabulary), "lex-docs")
    corpus = corpus_statistics(counted, terms)
    schema = "item bigint, doc_id bigint, score bigint"
    if corpus.documents == 0:
        return spark.createDataFrame([], schema)
    few = (counted.where(F.size("t") > 0).orderBy(F.xxhash64("doc_id", "n"), "doc_id", "n", "t", "f")
           .limit(sample).toArrow())
    sampled = sparse_rows(few, corpus)
    dealt = stored(_dealt(counted, corpus, _pivots(sampled, terms, PIVOTS)), "lex-dealt")
    sizes = dealt.groupBy("pivot").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("t")).alias("z")).collect()
    cuts = {r["pivot"]: max(1, -(-r["n"] // subtree), -(-r["z"] // NONZEROS)) for r in sizes}
    parts = F.element_at(F.array(*[F.lit(cuts.get(p, 1)) for p in range(max(cuts, default=0) + 1)]),
                         F.col("pivot") + 1)
    # by the place in the written table, so that rows which repeat an id are dealt too
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64(F.monotonically_increasing_id()), parts).cast("int"))
    shared = spark.sparkContext.broadcast((corpus, items, _thresholds(sampled, items, terms, k)))

    def unit(table: pa.Table) -> pa.Table:
        corpus, items, least = shared.value
        found = search_documents(sparse_rows(table.combine_chunks(), corpus), items, least, k)
        return pa.table({"item": pa.array([x[0] for x in found], pa.int64()),
                         "doc_id": pa.array([x[1] for x in found], pa.int64()),
                         "score": pa.array([x[2] for x in found], pa.int64())})

    return dealt.groupBy("pivot", "part").applyInArrow(unit, schema)


def search(docs: DataFrame, items: DataFrame, k: int = TOP, subtree: int = SUBTREE,
           sample: int = SAMPLE, max_items: int = MAX_ITEMS, max_terms: int = MAX_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of every item."""
    spark: SparkSession = docs.sparkSession
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), "doc_id")
    out = spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    for block in item_blocks(items, max_items=max_items, max_terms=max_terms):
        ranked = (_search_block(docs, block, k, subtree, sample)
                  .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))
        names = spark.createDataFrame(list(enumerate(block.ids)), "item bigint, item_id bigint")
        out = out.unionByName(ranked.join(F.broadcast(names), "item").select(
            "item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
    return out
