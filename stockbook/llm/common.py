"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from stockbook.session import scratch_path

# Fixed values of the word rules that the queries share.
WHITE = b" \t\n\r\x0b\x0c"
# [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ on lower-cased text: digits, a-z and all non-ASCII
_KEPT = bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
WORD_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b in _KEPT else 0x20 for b in range(256))

#: A key with more than 1 / HOT_SHARE of the rows is dealt over several tasks;
#: there are at most HOT_SHARE such keys, so their list may be broadcast.
HOT_SHARE = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str, schema: StructType | None = None) -> DataFrame:
    """``df`` written to the shared folder and read again (cuts the lineage)."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(schema or df.schema).parquet(path)


def own_names(columns: Iterable[str], *names: str) -> list[str]:
    """``names``, each with as many underscores behind it as make it differ from
    all ``columns`` (in any case), for helper columns next to a user's."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def word_bytes(data: bytes | None) -> list[bytes]:
    """Lower-cased words of UTF-8 ``data`` (none for null)."""
    return data.translate(WORD_TABLE).split() if data else []


def crc32_mod(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; null for a null id."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string").cast("binary")) % n


def id_and_text(docs: DataFrame, text: str = "binary") -> DataFrame:
    """(doc_id, text) only; other columns never reach Python."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                       F.col("text").cast(text).alias("text"))


def map_docs(docs: DataFrame, fn: Callable[[Iterable[tuple]], dict], schema: str,
             text: str = "binary", setup: Callable[[], object] | None = None) -> DataFrame:
    """Run ``fn(ids, texts, state) -> {column: values}`` on Arrow batches of documents.

    ``setup`` runs once per task and its result is given to ``fn``; a worker that
    runs a task without one lets go of what it kept. Values may be lists or
    Arrow arrays.
    """
    base = id_and_text(docs, text)
    target = base.sparkSession.createDataFrame([], schema).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out_schema = to_arrow_schema(target)
        if setup is None:
            forget()
        state = setup() if setup else None
        for batch in batches:
            out = fn(batch.column(0).to_pylist(), batch.column(1).to_pylist(), state)
            yield record_batch(out, out_schema)

    return base.mapInArrow(run, target)


def record_batch(out: dict, schema: pa.Schema) -> pa.RecordBatch:
    cols = []
    for f in schema:
        v = out[f.name]
        cols.append(v.cast(f.type) if isinstance(v, pa.Array) else pa.array(v, type=f.type))
    return pa.RecordBatch.from_arrays(cols, schema=schema)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, n: int,
                    keep: Column | None = None) -> DataFrame:
    """(doc_id, text, y) of at most ``n`` labelled documents.

    The ids are a uniform sample by hash order, so the broadcast side has at
    most ``n`` rows whatever the size of the tables. Several labels of one
    document count as the largest.
    """
    ids = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    if keep is not None:
        ids = ids.where(keep)
    ids = (ids.groupBy(F.col("doc_id").cast("bigint").alias("k"))
           .agg(F.max(F.col(label).cast("int")).alias("y"))
           .orderBy(F.xxhash64("k"), "k").limit(n))
    d = id_and_text(docs)
    return d.join(F.broadcast(ids), d.doc_id == ids.k, "inner").drop("k")


def hot_join(left: DataFrame, right: DataFrame, keys: list[str], rows: str = "rows",
             how: str = "left", salts: int = 64, by: list[str] | None = None) -> DataFrame:
    """Join ``left`` to ``right`` (one row per key) with hot keys dealt over ``salts`` tasks.

    ``right[rows]`` counts the left rows of each key. Keys above 1/HOT_SHARE
    of the total are salted on the left and repeated on the right; at most
    HOT_SHARE keys can be that frequent, so the driver may hold the hashes that
    tell them. The column ``rows`` is dropped. ``right`` should be a written
    table: it is read three times. The salt is a row's place in its partition,
    which a lost task repeats only if ``left`` reads written tables; where
    ``left`` comes out of a shuffle, ``by`` names the columns that tell the rows
    of a key apart, and the salt is made of their values.
    """
    total = right.agg(F.sum(rows).alias("n")).first()["n"] or 0
    name = F.xxhash64(*keys)
    often = right.where(F.col(rows) * HOT_SHARE > F.lit(int(total)))
    hashes = [r.h for r in often.select(name.alias("h")).collect()]
    if not hashes:
        return left.join(right.drop(rows), keys, how)
    hot = name.isin(hashes)
    (salt,) = own_names([*left.columns, *right.columns], "__salt")
    told = F.xxhash64(*by) if by else F.xxhash64(F.monotonically_increasing_id())
    salted = left.withColumn(salt, F.when(hot, F.pmod(told, F.lit(salts)))
        .otherwise(F.lit(0)).cast("int"))
    spread = right.withColumn(salt, F.explode(F.when(
        hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))).drop(rows)
    return salted.join(spread, [*keys, salt], how).drop(salt)


def split_by_keys(rows: DataFrame, keys: DataFrame, cols: list[str],
                  buckets: int = 1 << 20) -> tuple[DataFrame, DataFrame]:
    """(rows that may have a key in ``keys``, rows that have none), without a shuffle.

    The buckets that the keys hash to are broadcast: ``buckets`` numbers at most,
    however many keys there are. The first part still has to be joined; it is
    small where few rows have a key. Read ``keys`` from a written table.
    """
    (name,) = own_names(rows.columns, "__at")
    at = F.pmod(F.xxhash64(*cols), F.lit(buckets))
    used = F.broadcast(keys.select(at.alias(name)).distinct())
    marked = rows.withColumn(name, at)
    return (marked.join(used, name, "left_semi").drop(name),
            marked.join(used, name, "left_anti").drop(name))


def segments(lengths: np.ndarray) -> np.ndarray:
    """Start offsets of consecutive segments with the given lengths."""
    out = np.zeros(len(lengths) + 1, dtype=np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


_kept: dict[str, object] = {}  # tables of this Python worker, by the operator that uses them


def kept(owner: str, make: Callable[[], object]):
    """The object that ``make`` gave for ``owner`` in this worker.

    A worker is used again for other operators; what those kept is let go, so
    it holds the tables and caches of one operator at a time.
    """
    if owner not in _kept:
        forget()
        _kept[owner] = make()
    return _kept[owner]


def forget() -> None:
    """Let go of what operators before kept in this worker."""
    _kept.clear()


class RecentCache:
    """Bounded memory of a worker in two generations.

    A hit in the old generation moves to the young one; a full young
    generation becomes the old one, so what is used stays and what is not goes.
    """

    def __init__(self, size: int):
        self.size = size
        self.young: dict = {}
        self.old: dict = {}

    def missing(self, keys: Iterable) -> list:
        """The distinct keys that are not kept; the others are young afterwards."""
        young, old, out = self.young, self.old, []
        for k in set(keys).difference(young):
            v = old.get(k)
            if v is None:
                out.append(k)
            else:
                young[k] = v
        return out

    def trim(self) -> None:
        """To be called between texts, not between ``missing`` and the look-up."""
        if len(self.young) > self.size:
            self.old, self.young = self.young, {}
