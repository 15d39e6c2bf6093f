"""Operator 7, line dedup: levelled sorted runs of line hashes.

A ``LineRuns`` store keeps what earlier batches have shown as sorted runs in
the shared folder. Each new batch of line keys is merge-anti-joined with the
runs: keys that no run holds are the batch's *first* keys and become a new
sorted run at level 0; keys that are known go to the *repeats*, with only a
document count. When a level has ``fanout`` runs, they are merged into one run
of the next level, so a key is rewritten once per level.

``dedup_lines`` feeds the batches in descending ``doc_id`` order. The run that
first takes a key then holds its largest document, which is the one that keeps
the line, and first count plus repeats is its document frequency.

Defined results: null text is one empty line; null ``doc_id`` rows keep all
lines and are counted nowhere; rows that repeat a ``doc_id`` count as one
document and, if it is the keeper, all of them keep the line; extra columns
are ignored (``dedup_lines``) or passed on (``drop_lines``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stockbook.llm.common import hot_join, own_names, stored
from stockbook.session import scratch_path

# The white space [\x20\x09-\x0D] and letter case of a line's key.
STRIPPED = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_CHARS, MIN_DOCS = 40, 5
KEY = ["h1", "h2"]  # 128 bits of hash stand for a line's key


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(STRIPPED)), UPPER, LOWER)


def line_table(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, row, pos, h1, h2) of every line whose key has ``min_chars`` code points.

    ``row`` tells apart rows that share a doc_id but not the text.
    """
    return (docs.where(F.col("doc_id").isNotNull())
            .select(F.col("doc_id").cast("bigint").alias("doc_id"),
                    F.xxhash64("text").alias("row"),
                    F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
            .select("doc_id", "row", "pos", line_key(F.col("line")).alias("key"))
            .where(F.length("key") >= min_chars)
            .select("doc_id", "row", "pos", F.xxhash64("key").alias("h1"),
                    F.xxhash64(F.lit("line"), F.col("key")).alias("h2")))


class LineRuns:
    """Sorted runs of (h1, h2, n_docs, keeper), by level, and the repeats."""

    SCHEMA = "h1 bigint, h2 bigint, n_docs bigint, keeper bigint"

    def __init__(self, spark: SparkSession, fanout: int = 3):
        self.spark, self.fanout = spark, fanout
        self.levels: list[list[str]] = []
        self.repeats: list[str] = []

    def _read(self, paths: list[str]) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).parquet(*paths)

    def runs(self) -> DataFrame:
        """All first keys; a key is in exactly one run."""
        return self._read([p for level in self.levels for p in level])

    def _write(self, rows: DataFrame, label: str) -> str:
        path = scratch_path(self.spark, label)
        rows.sortWithinPartitions(*KEY).write.parquet(path)
        return path

    def add(self, batch: DataFrame) -> None:
        """Take a batch of (h1, h2, doc_id), distinct within a document."""
        keys = batch.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_docs"),
                                       F.max("doc_id").alias("keeper"))
        if not any(self.levels):
            self._push(0, self._write(keys, "line-run"))
            return
        keys = stored(keys, "line-batch")
        known = self.runs().select(*KEY)
        self._push(0, self._write(keys.join(known, KEY, "left_anti"), "line-run"))
        self.repeats.append(self._write(keys.join(known, KEY, "left_semi"), "line-repeats"))

    def _push(self, level: int, path: str) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(path)
        if len(self.levels[level]) >= self.fanout:  # compaction: the runs' keys are disjoint
            merged = self._read(self.levels[level]).repartition(*KEY)
            self.levels[level] = []
            self._push(level + 1, self._write(merged, "line-run"))

    def frequent(self, min_docs: int) -> DataFrame:
        """(h1, h2, keeper, n_docs) of the keys found in at least ``min_docs`` documents."""
        again = self._read(self.repeats).groupBy(*KEY).agg(F.sum("n_docs").alias("more"))
        return (self.runs().join(again, KEY, "left")
                .withColumn("n_docs", F.col("n_docs") + F.coalesce("more", F.lit(0)))
                .where(F.col("n_docs") >= min_docs).select(*KEY, "keeper", "n_docs"))


def dropped_positions(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS,
                      batches: int = 3) -> DataFrame:
    """(drop_id, drop_row, drops): for each row that loses lines, their positions."""
    spark = docs.sparkSession
    lines = stored(line_table(docs, min_chars), "lines")
    cuts = lines.agg(F.percentile_approx(
        "doc_id", F.lit([i / batches for i in range(1, batches)]), 1000).alias("c")
    ).first()["c"] if batches > 1 else None
    edges = [None, *sorted(set(cuts or []), reverse=True), None]  # high ids first
    store = LineRuns(spark)
    for high, low in zip(edges, edges[1:], strict=False):
        part = lines
        if high is not None:
            part = part.where(F.col("doc_id") <= high)
        if low is not None:
            part = part.where(F.col("doc_id") > low)
        store.add(part.select(*KEY, "doc_id").distinct())
    frequent = stored(store.frequent(min_docs), "line-frequent")
    hits = hot_join(lines, frequent, KEY, rows="n_docs", how="inner")
    return (hits.where(F.col("doc_id") != F.col("keeper"))
            .groupBy(F.col("doc_id").alias("drop_id"), F.col("row").alias("drop_row"))
            .agg(F.collect_set("pos").alias("drops")))


def _with_kept(docs: DataFrame, **options) -> tuple[DataFrame, str, str, str]:
    """``docs`` with three more columns, and their names: n_lines, n_dropped, kept."""
    own = own_names(docs.columns, "drop_id", "drop_row", "drops", "lines", "n_lines", "n_dropped", "kept")
    drop_id, drop_row, drops, split, n_lines, n_dropped, kept = own
    found = dropped_positions(docs.select("doc_id", "text"), **options).toDF(drop_id, drop_row, drops)
    mine = (F.col("doc_id") == F.col(drop_id)) & (F.xxhash64("text") == F.col(drop_row))
    # a column of its own: inside the lambda below the split must not run again
    joined = (docs.join(found, mine, "left").drop(drop_id, drop_row)
              .withColumn(split, lines_of(F.col("text"))))
    lines = F.col(split)
    last = F.size(lines) - 1
    # array_except is a hash set difference: linear in the number of lines
    text = F.when(F.col(drops).isNull(), F.coalesce(F.col("text"), F.lit(""))).otherwise(
        F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), last), F.col(drops)),
                                 lambda i: F.get(lines, i)), "\n"))
    out = (joined.withColumn(n_lines, F.size(lines).cast("bigint"))
           .withColumn(n_dropped, F.coalesce(F.size(drops), F.lit(0)).cast("bigint"))
           .withColumn(kept, text).drop(drops, split))
    return out, n_lines, n_dropped, kept


def dedup_lines(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256, kept_text), one row per document."""
    out, n_lines, n_dropped, kept = _with_kept(docs.select("doc_id", "text"), **options)
    return out.select("doc_id", F.col(n_lines).alias("n_lines"), F.col(n_dropped).alias("n_dropped"),
                      F.sha2(F.col(kept).cast("binary"), 256).alias("kept_sha256"),
                      F.col(kept).alias("kept_text"))


def drop_lines(docs: DataFrame, **options) -> DataFrame:
    """The documents, all columns, with repeated lines taken out of ``text``.

    ``n_chars``, where present, follows the text. A document that loses no line
    is returned as it is, null text included.
    """
    out, _, n_dropped, kept = _with_kept(docs, **options)
    changed = F.col(n_dropped) > 0
    cols = []
    for name in docs.columns:
        c = F.col(f"`{name}`")
        if name == "text":
            c = F.when(changed, F.col(kept)).otherwise(c)
        elif name == "n_chars":
            c = F.when(changed, F.length(kept).cast(docs.schema[name].dataType)).otherwise(c)
        cols.append(c.alias(name))
    return out.select(*cols)
