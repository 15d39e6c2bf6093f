"""Operator 5, near-duplicate detection: DartMinHash signatures in banded joins.

A document is the multiset of its five-word shingles. Each unit of a shingle's
weight is a region into which hashed darts fall along a rank axis as a Poisson
process (the gaps are exponential variates of hashes), so equal regions of two
documents get equal darts. A dart has a coordinate; the earliest dart of each
coordinate is the signature, and two signatures agree in a coordinate with the
weighted Jaccard similarity as probability. Darts are thrown up to a rank that
gives about ``k (ln k + 4)`` of them, however many shingles there are, and
farther when a coordinate is still empty.

24 bands of 4 coordinates make the candidates: a pair of similarity 0.8 shares
no band with probability 3e-6. Documents with equal shingles are one node (numbered
when the nodes are written, so that a repeated doc_id has a node for each of its
texts), and copies never meet each other. Candidates are checked on the shingle sets
themselves. A bucket of many nodes is not expanded into its pairs:

1. what a node alone holds (among all nodes that share a band with another) is
   in no other set, so with u such regions of n the overlap with any node is at
   most n - u. That bounds the similarity of a pair from four numbers, and of a
   node with anything in its bucket; what can't reach the threshold goes;
2. each node is compared with the pivot (smallest node) it shares most bands with;
3. nodes that share a bucket with another component, and may have a partner
   there, form groups (connected by their buckets). Small groups are compared
   pair by pair where a bucket is shared. Large ones are dealt into blocks of
   ``BLOCK`` nodes; a task compares two blocks by their common regions and gives
   out a spanning forest of the links between components (fewer than its nodes).

No bucket is left with two nodes that could be similar and were neither
compared nor joined otherwise, so no link between components is lost.

Defined results: classes are the connected components of similarity >=
``threshold``; ``class_id`` is the smallest doc_id. A text of one to four words
is one shingle; a text without words but not empty is its own only shingle;
null and empty texts are alone. Rows with a null doc_id have no class (and
stay, in ``keep_one``). Rows that repeat a doc_id are one document: what is
similar to one of them is in the class, all of them (also null and empty ones)
have that class, and they stay or go together. Other columns are ignored or
passed on.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockbook.llm.common import (
    hot_join,
    map_docs,
    own_names,
    segments,
    split_by_keys,
    stored,
    word_bytes,
)

SHINGLE, BANDS, ROWS = 5, 24, 4
THRESHOLD_TENTHS = 8
SMALL, BLOCK = 32, 256  # nodes of a group that is compared by pairs; nodes of a block

_G = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (splitmix)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_PLACE = mix(np.arange(1, SHINGLE + 1, dtype=np.uint64) * _G) | np.uint64(1)


def shingles(data: bytes | None) -> np.ndarray:
    """Hashes of the five-word shingles, with repeats."""
    words = word_bytes(data)
    if not words:
        return np.array([xxhash.xxh64_intdigest(data, seed=1)] if data else [], np.uint64)
    h = np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)
    m = max(1, len(h) - SHINGLE + 1)
    out = np.zeros(m, np.uint64)
    for k in range(min(SHINGLE, len(h))):
        out += h[k:k + m] * _PLACE[k]
    return mix(out)


def regions(elements: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(hash, width) of the unit regions of weighted elements; repeats add weight."""
    unique, inverse = np.unique(elements, return_inverse=True)
    total = np.bincount(inverse, weights=weights, minlength=len(unique))
    units = np.ceil(total).astype(np.int64)
    start = segments(units)
    nth = np.arange(start[-1]) - np.repeat(start[:-1], units)
    width = np.minimum(np.repeat(total, units) - nth, 1.0)
    return mix(np.repeat(unique, units) + nth.astype(np.uint64) * _G), width


def dart_signature(region: np.ndarray, width: np.ndarray, k: int) -> np.ndarray:
    """The earliest dart of each of ``k`` coordinates (its hash)."""
    mass = float(width.sum())
    limit = k * (math.log(k) + 4) / mass
    whole = bool((width == 1.0).all())
    while True:
        darts, ranks = [], []
        live, last, d = region, np.zeros(len(region)), 0
        wide = width
        while len(live):
            n = int(limit + 3 * math.sqrt(limit) + 2) if d == 0 else 8
            n = min(n, max(4, 4_000_000 // len(live)))  # bounded block
            nth = np.arange(d, d + n, dtype=np.uint64) * _G
            h = mix(live[:, None] + nth[None, :])
            gap = -np.log(((h >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0 ** -53)
            rank = last[:, None] + np.cumsum(gap, axis=1)
            hit = rank < limit
            if not whole:  # the dart's height must be inside the region
                height = (mix(h ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(11)) * 2.0 ** -53
                inside = hit & (height < wide[:, None])
            else:
                inside = hit
            darts.append(h[inside])
            ranks.append(rank[inside])
            more = hit[:, -1]
            live, last, wide, d = live[more], rank[more, -1], wide[more], d + n
        dart, rank = np.concatenate(darts), np.concatenate(ranks)
        dart = dart[np.argsort(rank, kind="stable")]
        at, first = np.unique(mix(dart + _G) % np.uint64(k), return_index=True)
        if len(at) == k:
            return dart[first]
        limit *= 2


def band_hashes(signature: np.ndarray) -> np.ndarray:
    rows = signature.reshape(BANDS, ROWS)
    out = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        out = mix(out * _G + rows[:, k])
    return out


def _multiset(s: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums that name a multiset of shingles."""
    if not len(s):
        return 0, 0
    return tuple(int(mix(x).sum(dtype=np.uint64).view(np.int64)) for x in (s, s ^ _G))


def _sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, c1, c2, n, bands) of the documents with an id; c1, c2 name the multiset."""
    def run(ids, texts, _):
        c1, c2, sizes, bands = [], [], [], []
        for data in texts:
            s = shingles(data)
            sizes.append(len(s))
            a, b = _multiset(s)
            c1.append(a)
            c2.append(b)
            if len(s):
                bands.append(band_hashes(dart_signature(*regions(s), BANDS * ROWS)).view(np.int64))
            else:
                bands.append(np.zeros(0, np.int64))
        flat = np.concatenate(bands) if bands else np.zeros(0, np.int64)
        offsets = segments(np.array([len(b) for b in bands], np.int64)).astype(np.int32)
        return {"doc_id": ids, "c1": c1, "c2": c2, "n": sizes,
                "bands": pa.ListArray.from_arrays(offsets, pa.array(flat))}

    return map_docs(docs.where(F.col("doc_id").isNotNull()), run,
                    "doc_id bigint, c1 bigint, c2 bigint, n bigint, bands array<bigint>")


def _regions_of(docs: DataFrame) -> DataFrame:
    """(doc_id, c1, c2, regions): distinct 32-bit names of the unit regions of each text."""
    def run(ids, texts, _):
        c1, c2, sets = [], [], []
        for t in texts:
            s = shingles(t)
            a, b = _multiset(s)
            c1.append(a)
            c2.append(b)
            sets.append(np.unique((regions(s)[0] >> np.uint64(32)).astype(np.uint32).view(np.int32)))
        offsets = segments(np.array([len(x) for x in sets], np.int64)).astype(np.int32)
        flat = np.concatenate(sets) if sets else np.zeros(0, np.int32)
        return {"doc_id": ids, "c1": c1, "c2": c2,
                "regions": pa.ListArray.from_arrays(offsets, pa.array(flat))}

    return map_docs(docs, run, "doc_id bigint, c1 bigint, c2 bigint, regions array<int>")


def _region_sets(docs: DataFrame, wanted: DataFrame, again: DataFrame | None) -> DataFrame:
    """(node, regions), one row per node of ``wanted`` (node, doc_id, c1, c2).

    A doc_id that is not in ``again`` has one text; the texts of the others are
    told apart by their multisets.
    """
    once = wanted if again is None else wanted.join(again, "doc_id", "left_anti")
    texts = (split_by_keys(docs, wanted, ["doc_id"])[0].join(once.select("doc_id", "node"), "doc_id")
             .select(F.col("node").alias("doc_id"), "text"))
    sets = _regions_of(texts).select(F.col("doc_id").alias("node"), "regions")
    if again is None:
        return sets
    often = stored(wanted.join(again, "doc_id", "left_semi"), "dart-often")
    texts = split_by_keys(docs, often, ["doc_id"])[0].join(again, "doc_id", "left_semi")
    found = _regions_of(texts).groupBy("c1", "c2").agg(F.first("regions").alias("regions"))
    return sets.unionByName(found.join(often, ["c1", "c2"]).select("node", "regions"))


def _same_document(sketches: DataFrame, nodes: DataFrame, again: DataFrame) -> DataFrame:
    """The links (a, b) of the nodes that hold texts of one doc_id."""
    texts = (sketches.where(F.col("n") > 0).join(again, "doc_id", "left_semi")
             .select("doc_id", "c1", "c2").distinct())
    held = stored(texts.join(nodes.select("c1", "c2", "node"), ["c1", "c2"]).select("doc_id", "node"),
                  "dart-held")
    first = stored(held.groupBy("doc_id").agg(F.min("node").alias("a"), F.count(F.lit(1)).alias("rows"))
                   .where(F.col("rows") > 1), "dart-first")
    links = hot_join(held, first, ["doc_id"], how="inner").where(F.col("a") != F.col("node"))
    return stored(links.select("a", F.col("node").alias("b")).distinct(), "dart-same")


def components(links: DataFrame) -> DataFrame:
    """(node, comp) of every node of ``links`` (a, b): the smallest node it reaches."""
    edges = stored(links.select("a", "b").union(links.select("b", "a")).distinct(), "cc-edges")
    labels = stored(edges.groupBy(F.col("a").alias("node"))
                    .agg(F.least(F.min("b"), F.first("a")).alias("comp")), "cc-labels")
    while True:
        near = (edges.join(labels, edges.b == labels.node)
                .groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("seen")))
        step = (labels.join(near, "node")
                .select("node", F.col("comp").alias("was"), F.least("comp", "seen").alias("mid")))
        root = labels.select(F.col("node").alias("mid"), F.col("comp").alias("up"))
        moved = stored(step.join(root, "mid").select("node", "was", F.col("up").alias("comp")), "cc-labels")
        labels = moved.select("node", "comp")
        if moved.where(F.col("was") != F.col("comp")).isEmpty():
            return labels


def _similar(pairs: DataFrame, sets: DataFrame, tenths: int) -> DataFrame:
    """The (a, b) of ``pairs`` whose weighted Jaccard similarity is tenths / 10 or more."""
    left = sets.select(F.col("node").alias("a"), F.col("regions").alias("ra"))
    right = sets.select(F.col("node").alias("b"), F.col("regions").alias("rb"))
    both = F.size("ra") + F.size("rb")
    shared = F.size(F.array_intersect("ra", "rb"))
    return (pairs.join(right, "b").join(left, "a")
            .where(shared * (10 + tenths) >= both * tenths).select("a", "b"))


def _alone(sets: DataFrame) -> DataFrame:
    """(node, u): regions of each node that no other node of ``sets`` holds."""
    return (sets.select("node", F.explode("regions").alias("r")).groupBy("r")
            .agg(F.min("node").alias("node"), F.max("node").alias("other"))
            .where(F.col("node") == F.col("other")).groupBy("node").agg(F.count(F.lit(1)).alias("u")))


def _may_reach(overlap: Column, together: Column, tenths: int) -> Column:
    """Whether ``overlap`` common regions of two sets of ``together`` in sum are enough."""
    return overlap * (10 + tenths) >= together * tenths


def _pairs(met: DataFrame, tenths: int) -> DataFrame:
    """(a, b, bands) with a < b of nodes that met a pivot and may be similar."""
    most = F.least(F.col("n") - F.col("u"), F.col("pn") - F.col("pu"))
    return (met.where((F.col("node") != F.col("pivot"))
                      & _may_reach(most, F.col("n") + F.col("pn"), tenths))
            .groupBy(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b"))
            .agg(F.count(F.lit(1)).alias("bands")))


def _pivot(struct: str) -> list[Column]:
    return ["band", "h", F.col(f"{struct}.node").alias("pivot"), F.col(f"{struct}.n").alias("pn"),
            F.col(f"{struct}.u").alias("pu")]


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (node, comp) after the components that ``links`` (a, b) join became one."""
    left = labels.select(F.col("node").alias("a"), F.col("comp").alias("ca"))
    right = labels.select(F.col("node").alias("b"), F.col("comp").alias("cb"))
    between = (links.join(left, "a").join(right, "b").where(F.col("ca") != F.col("cb"))
               .select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    new = components(between).select(F.col("node").alias("comp"), F.col("comp").alias("into"))
    return stored(labels.join(new, "comp", "left").select("node", F.coalesce("into", "comp").alias("comp")),
                  "dart-label")


def _open(members: DataFrame, labels: DataFrame, tenths: int) -> DataFrame:
    """The entries of buckets with nodes of different components that may have a
    partner there."""
    comp = members.join(labels, "node")
    mixed = (comp.groupBy("band", "h").agg(
        F.min("comp").alias("low"), F.max("comp").alias("high"), F.min("n").alias("least"),
        F.count(F.lit(1)).alias("members")).where(F.col("low") != F.col("high")).drop("low", "high"))
    own = F.col("n") - F.col("u")
    live = hot_join(comp, stored(mixed, "dart-mixed"), ["band", "h"], rows="members", how="inner",
                    by=["node"]).where(
        _may_reach(own, F.col("n") + F.greatest("least", own), tenths))
    return stored(live.drop("least"), "dart-open")


def spanning(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the symmetric matrix ``near``."""
    new, i, j = np.ones(len(near), bool), [], []
    for root in range(len(near)):
        if not new[root]:
            continue
        new[root] = False
        queue = [root]
        while queue:
            at = queue.pop()
            seen = np.flatnonzero(near[at] & new)
            new[seen] = False
            i.append(np.full(len(seen), at))
            j.append(seen)
            queue.extend(seen.tolist())
    none = [np.zeros(0, np.int64)]
    return np.concatenate(i or none), np.concatenate(j or none)


def _block_links(group, tenths: int):
    """Spanning forest of the links between the two blocks of a unit (or inside one).

    (a, b) rows: they reach what all links reach, with fewer rows than nodes.
    """
    import pandas as pd

    nodes, comp = group["node"].to_numpy(), group["comp"].to_numpy()
    side = group["block"].to_numpy()
    sizes = np.array([len(r) for r in group["regions"]], np.int64)
    flat = np.concatenate(list(group["regions"])) if len(group) else np.zeros(0, np.int32)
    owner = np.repeat(np.arange(len(group)), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    cut = np.flatnonzero(np.diff(flat)) + 1
    starts, ends = np.concatenate(([0], cut)), np.concatenate((cut, [len(flat)]))
    common = np.zeros((len(group), len(group)), np.int32)
    for lo, hi in zip(starts.tolist(), ends.tolist(), strict=True):
        if hi - lo > 1:
            at = owner[lo:hi]
            common[at[:, None], at] += 1
    near = common * (10 + tenths) >= (sizes[:, None] + sizes[None, :]) * tenths
    near &= comp[:, None] != comp[None, :]
    if (side != side[0]).any():  # blocks meet themselves in a unit of their own
        near &= side[:, None] != side[None, :]
    i, j = spanning(near)
    return pd.DataFrame({"a": np.minimum(nodes[i], nodes[j]), "b": np.maximum(nodes[i], nodes[j])})


def _group_links(live: DataFrame, sets: DataFrame, compared: DataFrame, tenths: int) -> DataFrame:
    """The links (a, b) between components among the open entries."""
    first = live.groupBy("band", "h").agg(F.min("node").alias("b"))
    near = live.join(first, ["band", "h"]).where(F.col("node") != F.col("b"))
    groups = components(near.select(F.col("node").alias("a"), "b")).withColumnRenamed("comp", "grp")
    sized = groups.groupBy("grp").agg(F.count(F.lit(1)).alias("m"))
    groups = stored(groups.join(sized, "grp"), "dart-group")

    small = live.join(groups.where(F.col("m") <= SMALL).select("node"), "node", "left_semi")
    other = small.select("band", "h", F.col("node").alias("pivot"), F.col("n").alias("pn"),
                         F.col("u").alias("pu"), F.col("comp").alias("pc"))
    met = small.join(other, ["band", "h"]).where(
        (F.col("node") < F.col("pivot")) & (F.col("comp") != F.col("pc")))
    pairs = stored(_pairs(met, tenths).select("a", "b").join(compared, ["a", "b"], "left_anti"), "dart-pair")
    links = _similar(pairs, sets, tenths)

    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    big = (live.select("node", "comp").distinct()
           .join(groups.where(F.col("m") > SMALL), "node").join(sets, "node")
           .withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int"))
           .withColumn("with", F.explode(F.sequence(F.lit(0), blocks - 1))))
    units = big.select("grp", F.least("block", "with").alias("x"), F.greatest("block", "with").alias("y"),
                       "node", "comp", "block", "regions")
    more = units.groupBy("grp", "x", "y").applyInPandas(
        lambda g: _block_links(g, tenths), "a bigint, b bigint")
    return links.unionByName(more)


def near_duplicates(docs: DataFrame, tenths: int = THRESHOLD_TENTHS) -> DataFrame:
    """(doc_id, class_id, n_shingles), one row per row of ``docs``."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    sketches = stored(_sketches(docs), "dart-sketch")
    again = stored(sketches.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col("n") == 0, F.lit(1))).alias("blank"))
        .where(F.col("rows") > 1), "dart-again")
    repeated = None if again.isEmpty() else again.select("doc_id")
    # one node for each multiset of shingles
    nodes = stored(sketches.where(F.col("n") > 0).groupBy("c1", "c2")
                   .agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"),
                        F.first("bands").alias("bands"), F.count(F.lit(1)).alias("copies"))
                   .withColumn("node", F.monotonically_increasing_id()), "dart-node")
    banded = nodes.select("node", F.posexplode("bands").alias("band", "h"))
    buckets = stored(banded.groupBy("band", "h").agg(F.count(F.lit(1)).alias("members"))
                     .where(F.col("members") > 1), "dart-bucket")
    entries = stored(hot_join(banded, buckets, ["band", "h"], rows="members", how="inner"), "dart-entry")
    wanted = stored(nodes.join(entries.select("node").distinct(), "node", "left_semi")
                    .select("node", "doc_id", "c1", "c2"), "dart-wanted")
    sets = stored(_region_sets(docs, wanted, repeated), "dart-region")
    measured = stored(sets.select("node", F.size("regions").alias("n"))
                      .join(_alone(sets), "node", "left")
                      .select("node", "n", F.coalesce("u", F.lit(0)).alias("u")), "dart-size")
    members = stored(entries.join(measured, "node"), "dart-member")

    first = members.groupBy("band", "h").agg(F.min(F.struct("node", "n", "u")).alias("p")).select(*_pivot("p"))
    compared = stored(_pairs(members.join(first, ["band", "h"]), tenths).groupBy("b")
                      .agg(F.max(F.struct("bands", F.negative("a").alias("a"))).alias("m"))
                      .select((-F.col("m.a")).alias("a"), "b"), "dart-pair")
    names, links = measured.select("node"), _similar(compared, sets, tenths)
    if repeated is not None:
        same = _same_document(sketches, nodes, repeated)
        names = names.union(same.select("a")).union(same.select("b")).distinct()
        links = links.unionByName(same)
    labels = _merged(stored(names.withColumn("comp", F.col("node")), "dart-label"), links)
    live = _open(members, labels, tenths)
    labels = _merged(labels, stored(_group_links(live, sets, compared, tenths), "dart-link"))

    placed = stored(nodes.join(labels, "node", "left").select(
        "c1", "c2", "doc_id", "copies", F.coalesce("comp", "node").alias("comp")), "dart-placed")
    lowest = stored(placed.groupBy("comp").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("rows"))
                    .where(F.col("rows") > 1), "dart-lowest")
    named = hot_join(placed, lowest, ["comp"]).select(
        "c1", "c2", F.coalesce("class_id", "doc_id").alias("class_id"), "copies")
    found = hot_join(sketches.where(F.col("n") > 0).select("doc_id", "n", "c1", "c2"),
                     stored(named, "dart-named"), ["c1", "c2"], rows="copies", how="left")
    alone = sketches.where(F.col("n") == 0).select("doc_id", "n")
    if repeated is None:
        alone = alone.withColumn("class_id", F.col("doc_id"))
    else:  # blank rows of an id that also has a text
        mixed = again.where((F.col("blank") > 0) & (F.col("blank") < F.col("rows")))
        known = (found.join(mixed.select("doc_id", F.col("blank").alias("blanks")), "doc_id")
                 .groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.first("blanks").alias("rows")))
        alone = (hot_join(alone, stored(known, "dart-known"), ["doc_id"])
                 .select("doc_id", "n", F.coalesce("class_id", "doc_id").alias("class_id")))
    without = docs.where(F.col("doc_id").isNull()).select(
        "doc_id", F.lit(0).cast("bigint").alias("n"), F.lit(None).cast("bigint").alias("class_id"))
    return (found.select("doc_id", "n", "class_id").unionByName(alone).unionByName(without)
            .select("doc_id", "class_id", F.col("n").alias("n_shingles")))


def keep_one(docs: DataFrame, tenths: int = THRESHOLD_TENTHS) -> DataFrame:
    """The documents, all columns, without those whose class has a smaller doc_id."""
    classes = near_duplicates(docs, tenths)
    gone = stored(classes.where(F.col("class_id") < F.col("doc_id")).select("doc_id").distinct(),
                  "dart-gone")
    (name,) = own_names(docs.columns, "__id")
    typed = docs.withColumn(name, F.col("doc_id").cast("bigint"))
    gone = gone.withColumnRenamed("doc_id", name)
    maybe, kept = split_by_keys(typed, gone, [name])
    return kept.unionByName(maybe.join(gone, name, "left_anti").select(*typed.columns)).drop(name)
