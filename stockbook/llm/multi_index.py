"""Operator 12, approximate nearest neighbours: an inverted multi-index.

A vector is cut into two halves, and each half has a codebook of its own
(k-means on a bounded sample); a vector's cell is the pair of its two nearest
centroids, so ``k`` centroids a half give ``k * k`` cells. Every vector is
written to the list of its cell. A query visits cells in the order of the
summed squared distances of its halves to the centroid pairs, taken from a
heap (multi-sequence traversal), until the lists hold ``share`` of all
vectors. The vectors of the visited lists are reranked by exact distances.

``share`` is found at fitting time: sampled queries are searched in the rest
of the sample, and the share is the one within which ``target`` of their true
neighbours lie. The search is done in units of a shard (all cells of one first
centroid) cut into blocks of vectors, against a block of queries; both are
bounded, so a cell with a third of all vectors is many units. A query's best
distances to visited sample vectors bound what a unit gives out for it.

Bounds: ``SAMPLE`` vectors are fitted on, on the driver; ``MAX_CENTROIDS``
centroids a half. The cell counts (``k * k`` numbers at most) and the sample
are broadcast. Everything else stays in tables.

Defined results: a vector that is null or empty, is zero, or holds a null or
non-finite component takes no part, nor does a row without an id. Vectors of
another length than most have no distance and take no part (ties: the smaller
length counts). Rows that repeat an id are candidates of their own; they are
one query (the smallest vector in array order), whose own rows are all of that
id. Equal distances are ranked by the smaller id. No query, no vector: no row.
Other columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stockbook.llm.common import stored

SAMPLE = 20_000
MAX_CENTROIDS = 512
CELL = 16  # vectors that a cell holds on average, up to MAX_CENTROIDS
TARGET = 0.98
BLOCK, QUERIES = 4096, 512  # vectors and queries of a unit
_SLACK = 1e-9


def usable(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, v) of the rows that take part, still of any length."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (vectors.select(F.col(key).cast("bigint").alias("vec_id"), v.alias("v"))
            .where(F.col("vec_id").isNotNull() & (F.size("v") > 0) & F.coalesce(finite, F.lit(False)))
            .where(F.exists("v", lambda x: x != 0.0)))


def kmeans(points: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """At most ``k`` centroids of ``points``; empty ones move to far points."""
    if points.shape[1] == 0:
        return np.zeros((1, 0))
    distinct = np.unique(points, axis=0)
    if len(distinct) <= k:
        return distinct
    rng = np.random.default_rng(seed)
    cents = distinct[rng.permutation(len(distinct))[:k]].copy()
    for _ in range(rounds):
        near, dist = nearest(points, cents)
        sums = np.zeros_like(cents)
        np.add.at(sums, near, points)
        n = np.bincount(near, minlength=len(cents))
        full = n > 0
        cents[full] = sums[full] / n[full, None]
        lost = np.flatnonzero(~full)
        cents[lost] = points[np.argsort(-dist, kind="stable")[:len(lost)]]
    return cents


def square_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All squared distances (rounded: for ordering, not for results)."""
    d = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)
    return np.maximum(d, 0.0)


def nearest(points: np.ndarray, cents: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, dist = [], []
    for lo in range(0, len(points), 4096):
        d = square_distances(points[lo:lo + 4096], cents)
        at.append(d.argmin(1))
        dist.append(d.min(1))
    none = [np.zeros(0)]
    return np.concatenate(at or none).astype(np.int64), np.concatenate(dist or none)


def exact(q: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Euclidean distances of one query to ``rows`` in double precision."""
    diff = rows - q
    return np.sqrt((diff * diff).sum(axis=1))


def traverse(d1: np.ndarray, d2: np.ndarray, counts: np.ndarray, enough: float) -> list[tuple[int, int]]:
    """Non-empty cells (i, j) by ascending ``d1[i] + d2[j]`` until they hold
    ``enough`` vectors: the multi-sequence traversal with a heap."""
    o1, o2 = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
    s1, s2 = d1[o1].tolist(), d2[o2].tolist()
    held = counts[np.ix_(o1, o2)].tolist()
    o1, o2 = o1.tolist(), o2.tolist()
    seen, out = 0, []
    heap = [(s1[0] + s2[0], 0, 0)]
    while heap and seen < enough:
        _, a, b = heapq.heappop(heap)
        if b == 0 and a + 1 < len(s1):  # each pair is pushed once: along a row, rows down the first column
            heapq.heappush(heap, (s1[a + 1] + s2[0], a + 1, 0))
        if b + 1 < len(s2):
            heapq.heappush(heap, (s1[a] + s2[b + 1], a, b + 1))
        if held[a][b]:
            seen += held[a][b]
            out.append((o1[a], o2[b]))
    return out


class Codebooks:
    """Centroids of both halves, the share of vectors to visit, and the sample."""

    def __init__(self, ids: np.ndarray, sample: np.ndarray, total: int, target: float = TARGET):
        self.cut = sample.shape[1] // 2
        k = int(min(MAX_CENTROIDS, max(1, round((total / CELL) ** 0.5))))
        self.first = kmeans(sample[:, :self.cut], k)
        self.second = kmeans(sample[:, self.cut:], k)
        self.ids, self.sample = ids, sample
        self.codes = self.assign(sample)
        self.share = self._share(target)

    def assign(self, rows: np.ndarray) -> np.ndarray:
        """Cell numbers: first centroid * number of second centroids + second one."""
        a, _ = nearest(rows[:, :self.cut], self.first)
        b, _ = nearest(rows[:, self.cut:], self.second)
        return a * len(self.second) + b

    def halves(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (square_distances(rows[:, :self.cut], self.first),
                square_distances(rows[:, self.cut:], self.second))

    def _share(self, target: float, queries: int = 300, k: int = 10) -> float:
        """Share of the vectors that must be visited to meet ``target`` of the
        true neighbours of sampled queries within the sample."""
        n = len(self.sample)
        if n <= 2 * k:
            return 1.0
        counts = np.bincount(self.codes, minlength=len(self.first) * len(self.second))
        step, need = max(1, n // queries), []
        for q in range(0, n, step):
            d = exact(self.sample[q], self.sample)
            d[q] = np.inf
            best = np.argpartition(d, k)[:k]
            d1, d2 = self.halves(self.sample[q:q + 1])
            order = np.argsort((d1[0][:, None] + d2[0][None, :]).ravel(), kind="stable")
            upto = np.empty(len(order))
            upto[order] = np.cumsum(counts[order])
            need.append(upto[self.codes[best]] / n)
        return float(min(1.0, np.quantile(np.concatenate(need), target)))


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _bound(book: Codebooks, q: np.ndarray, qid: int, visited: np.ndarray, k: int) -> float:
    """A distance that ``k`` visited vectors do not exceed (infinite if unknown)."""
    rows = visited[book.codes] & (book.ids != qid)
    if np.count_nonzero(rows) < k:
        return float("inf")
    d = exact(q, book.sample[rows])
    return float(np.partition(d, k - 1)[k - 1])


def best_of(q: np.ndarray, ids: np.ndarray, rows: np.ndarray, near: np.ndarray, k: int):
    """The ``k`` nearest (ids, distances) of ``rows``; ``near`` are rounded squared distances."""
    if len(ids) > k:
        limit = np.partition(near, k - 1)[k - 1]
        keep = near <= limit + _SLACK * (1.0 + limit + (q * q).sum())
        ids, rows = ids[keep], rows[keep]
    d = exact(q, rows)
    order = np.lexsort((ids, d))[:k]
    return ids[order], d[order]


def search_unit(ids, cells, rows, qids, queries, visits, bounds, k: int) -> list[tuple]:
    """(query_id, ids, distances) of a block of queries in a block of one shard.

    ``cells`` are the second centroids of the rows, ``visits`` those that each
    query visits in this shard, ``bounds`` the distances beyond which it needs none.
    """
    out = []
    near = square_distances(queries, rows)
    width = int(cells.max()) + 1
    for i, qid in enumerate(qids.tolist()):
        seen = np.zeros(width, bool)
        v = visits[i]
        seen[v[v < width]] = True
        q = queries[i]
        limit = bounds[i] ** 2
        take = np.flatnonzero(seen[cells] & (ids != qid)
                              & (near[i] <= limit + _SLACK * (1.0 + limit + (q * q).sum())))
        if len(take):
            a, d = best_of(q, ids[take], rows[take], near[i][take], k)
            out.append((qid, a, d))
    return out


def fit(vectors: DataFrame, sample: int = SAMPLE, target: float = TARGET) -> Codebooks | None:
    """Codebooks from a uniform sample by hash order of a written ``vectors`` (vec_id, v)."""
    rows = vectors.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(sample).toArrow()
    if not rows.num_rows:
        return None
    dim = len(rows.column("v")[0])
    return Codebooks(rows.column("vec_id").to_numpy(), _matrix(rows.column("v"), dim),
                     vectors.count(), target)


def index(vectors: DataFrame, book: Codebooks) -> DataFrame:
    """(vec_id, v, shard, cell): every vector in the list of its cell, as a written table."""
    cell_of, width, dim = book.assign, len(book.second), book.sample.shape[1]
    target = vectors.sparkSession.createDataFrame(
        [], "vec_id bigint, v array<double>, shard int, cell int").schema

    def run(batches):
        for batch in batches:
            code = cell_of(_matrix(batch.column(1), dim))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array((code // width).astype(np.int32)),
                 pa.array((code % width).astype(np.int32))], names=["vec_id", "v", "shard", "cell"])

    return stored(vectors.select("vec_id", "v").mapInArrow(run, target), "imi-index")


def probes(queries: DataFrame, book: Codebooks, counts: np.ndarray, k: int) -> DataFrame:
    """(query_id, v, bound, shard, cells): the cells that each of ``queries``
    (query_id, v, own = rows with its id) visits, a row per shard."""
    dim, total = book.sample.shape[1], int(counts.sum())
    shared = queries.sparkSession.sparkContext.broadcast((book, counts))
    target = queries.sparkSession.createDataFrame(
        [], "query_id bigint, v array<double>, bound double, shard int, cells array<int>").schema

    def run(batches):
        book, counts = shared.value
        for batch in batches:
            ids, own = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            rows = _matrix(batch.column(1), dim)
            d1, d2 = book.halves(rows)
            out: tuple[list, ...] = ([], [], [], [], [])
            for i, qid in enumerate(ids.tolist()):
                enough = max(book.share * total, k + own[i])
                cells = traverse(d1[i], d2[i], counts, enough)
                visited = np.zeros(counts.size, bool)
                visited[[a * counts.shape[1] + b for a, b in cells]] = True
                bound = _bound(book, rows[i], qid, visited, k)
                shards: dict[int, list[int]] = {}
                for a, b in cells:
                    shards.setdefault(a, []).append(b)
                for a, bs in shards.items():
                    for column, value in zip(out, (qid, rows[i], bound, a, bs), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, type=t) for c, t in zip(out, (
                    pa.int64(), pa.list_(pa.float64()), pa.float64(), pa.int32(), pa.list_(pa.int32())),
                    strict=True)], names=target.names)

    return queries.select("query_id", "v", "own").mapInArrow(run, target)


def nearest_neighbours(vectors: DataFrame, is_query, k: int = 10, sample: int = SAMPLE,
                       target: float = TARGET, block: int = BLOCK, query_block: int = QUERIES,
                       key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each row of
    ``vectors`` whose id ``is_query`` (a function of the id column) takes."""
    spark = vectors.sparkSession
    base = stored(usable(vectors, key, vector), "imi-vectors")
    sizes = base.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n"))
    most = sizes.orderBy(F.col("n").desc(), "dim").first()
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    if most is None:
        return spark.createDataFrame([], schema)
    base = base.where(F.size("v") == most["dim"])
    dim = most["dim"]
    book = fit(base, sample, target)
    listed = index(base, book)
    counts = np.zeros((len(book.first), len(book.second)), np.int64)
    for r in listed.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("n")).collect():
        counts[r["shard"], r["cell"]] = r["n"]

    own = (base.where(is_query(F.col("vec_id"))).groupBy(F.col("vec_id").alias("query_id"))
           .agg(F.min("v").alias("v"), F.count(F.lit(1)).alias("own")))
    asked = stored(probes(own, book, counts, k), "imi-probes")
    # blocks: of queries by their id, of a shard's vectors by theirs
    n_queries = asked.select(F.count_distinct("query_id").alias("n")).first()["n"]
    deals = max(1, -(-n_queries // query_block))
    per_shard = counts.sum(1)
    blocks = F.element_at(F.array(*[F.lit(int(max(1, -(-n // block)))) for n in per_shard]),
                          F.col("shard") + 1)
    dealt = F.pmod(F.xxhash64("vec_id", "v"), blocks).cast("int")
    entries = (listed.withColumn("part", dealt)
               .withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(deals - 1)))))
    turns = (asked.withColumn("deal", F.pmod(F.xxhash64("query_id"), F.lit(deals)).cast("int"))
             .withColumn("part", F.explode(F.sequence(F.lit(0), blocks - 1))))

    def unit(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            visits = [np.asarray(v, np.int64) for v in right.column("cells").to_pylist()]
            found = search_unit(
                left.column("vec_id").to_numpy(), left.column("cell").to_numpy(),
                _matrix(left.column("v"), dim), right.column("query_id").to_numpy(),
                _matrix(right.column("v"), dim), visits, right.column("bound").to_numpy(), k)
        none = [np.zeros(0)]
        n = [len(a) for _, a, _ in found]
        return pa.table({
            "query_id": pa.array(np.repeat([q for q, _, _ in found], n).astype(np.int64)),
            "vec_id": pa.array(np.concatenate([a for _, a, _ in found] or none).astype(np.int64)),
            "score": pa.array(np.concatenate([d for _, _, d in found] or none).astype(np.float64))})

    units = ["shard", "part", "deal"]
    hits = (entries.groupBy(*units).cogroup(turns.groupBy(*units))
            .applyInArrow(unit, "query_id bigint, vec_id bigint, score double"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
