"""The ledger and the running stock delta over a stream of changes.

The same T1/T2 column logic as the batch jobs runs on a streaming DataFrame.

X1 gives every ledger row its movement id. A micro-batch starts above the high
mark of the ones before, which each leaves as a small file when its rows are
written; ids are dense, and a micro-batch that is run again starts from the
same mark and writes the same rows to the same folder.

X2 keeps one running sum per (product, location) in the state store (bounded by
the number of stock keys) and writes the updated keys of each micro-batch to a
folder of its own. Every ``FANOUT`` folders of a level are merged into one of
the next level (the latest row of each key), so a reader opens fewer than
``FANOUT`` folders a level, however long the stream has run. The merges of a
micro-batch depend on its number alone, so a replay repeats them.

Sinks and checkpoints live under the shared checkpoint folder.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockbook.operators.keys import allocate_keys
from stockbook.operators.ledger import change_delta, ledger_rows
from stockbook.session import scratch_path
from stockbook.sources.schemas import MOVEMENT

#: Update folders of a level that are merged into one of the next level.
FANOUT = 8
#: Folder without rows: readers find it, and the columns, before there is any input.
EMPTY = "empty"
#: Ledger rows of the stream: those of the model and the change they come from.
LEDGER_SCHEMA = T.StructType([*MOVEMENT.fields, T.StructField("seq", T.LongType())])

EVENTS_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
])


def stream_ledger(changes: DataFrame, movement_date: _dt.datetime | str | Column) -> DataFrame:
    """Ledger rows (keyed by change ``seq``) of a change stream."""
    return ledger_rows(change_delta(changes), movement_date)


def stream_stock(changes: DataFrame) -> DataFrame:
    """Running net delta per (product, location) of a change stream."""
    return change_delta(changes).groupBy("product_id", "location_id").agg(
        F.sum("delta").cast("bigint").alias("net_delta"))


def read_change_stream(spark: SparkSession, source_dir: str, file_glob: str, to_feed,
                       max_files_per_trigger: int | None = None) -> DataFrame:
    """Stream the parquet files of ``source_dir`` matching ``file_glob`` and map
    them to the change-feed schema with ``to_feed(spark, df)``. By default a
    micro-batch takes all files that are there."""
    reader = spark.readStream.schema(EVENTS_SCHEMA).option("pathGlobFilter", file_glob)
    if max_files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return to_feed(spark, reader.parquet(source_dir))


def run_ledger_stream(changes: DataFrame, movement_date, sink: str | None = None,
                      first_id: int = 1) -> str:
    """Run X1 until the available input is processed; returns the sink path.

    The ledger rows lie under ``<sink>/data/batch=<n>``, with ``movement_id``
    dense from ``first_id`` on: by micro-batch, and by ``seq`` within one.
    """
    spark = changes.sparkSession
    sink = sink or scratch_path(spark, "ledger-stream")
    data = f"{sink}/data"
    # an empty first part: readers find the folder and its columns without input
    spark.createDataFrame([], LEDGER_SCHEMA).write.mode("overwrite").parquet(f"{data}/{EMPTY}")

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        base = _mark_before(spark, sink, batch_id, first_id - 1)
        rows = allocate_keys(stream_ledger(batch, movement_date), "movement_id", ["seq"], base=base)
        path = f"{data}/{_batch_folder(batch_id)}"
        rows.select(*LEDGER_SCHEMA.names).write.mode("overwrite").parquet(path)
        top = spark.read.schema(LEDGER_SCHEMA).parquet(path).agg(F.max("movement_id").alias("m")).first()["m"]
        _leave_mark(spark, sink, batch_id, base if top is None else int(top))

    q = (changes.writeStream.outputMode("append").option("checkpointLocation", f"{sink}/_checkpoint")
         .foreachBatch(write_batch).trigger(availableNow=True).start())
    q.awaitTermination()
    return data


_MARK_SCHEMA = "batch_id bigint, high bigint"


def _batch_folder(batch_id: int) -> str:
    return f"batch-{batch_id}"


def _mark_before(spark: SparkSession, sink: str, batch_id: int, start: int) -> int:
    """The highest id that the micro-batches before ``batch_id`` gave out."""
    if batch_id == 0:
        return start
    # a micro-batch starts only after the one before has left its mark
    marks = spark.read.schema(_MARK_SCHEMA).json(f"{sink}/marks/{_batch_folder(batch_id - 1)}")
    return int(marks.first()["high"])


def _leave_mark(spark: SparkSession, sink: str, batch_id: int, high: int) -> None:
    spark.createDataFrame([(batch_id, high)], _MARK_SCHEMA).coalesce(1).write.mode("overwrite").json(
        f"{sink}/marks/{_batch_folder(batch_id)}")


def read_ledger_stream(spark: SparkSession, data: str) -> DataFrame:
    """The ledger rows of a run of X1."""
    return spark.read.schema(LEDGER_SCHEMA).option("recursiveFileLookup", "true").parquet(data)


def run_stock_stream(changes: DataFrame, sink: str | None = None,
                     opening: DataFrame | None = None) -> str:
    """Run X2 until the available input is processed; returns the sink path.

    With ``opening`` (stock rows), each micro-batch's updated keys are joined
    to the opening quantities inside ``foreachBatch`` and written with the
    current stock ``quantity = opening - net_delta``.
    """
    spark = changes.sparkSession
    sink = sink or scratch_path(spark, "stock-stream")
    data = f"{sink}/data"
    base = None
    if opening is not None:
        # summed up and written once, not in every micro-batch
        opened = f"{sink}/opening"
        opening.groupBy("product_id", "location_id").agg(
            F.sum("quantity").cast("bigint").alias("_open")).write.mode("overwrite").parquet(opened)
        base = spark.read.schema("product_id bigint, location_id bigint, _open bigint").parquet(opened)
    # an empty first part: readers find the folder and its columns without input
    spark.createDataFrame([], _update_schema(opening is not None)).write.mode("overwrite").parquet(
        f"{data}/{EMPTY}")

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        if base is not None:
            batch = batch.join(base, ["product_id", "location_id"], "left").select(
                "product_id", "location_id", "net_delta",
                (F.coalesce("_open", F.lit(0)) - F.col("net_delta")).cast("int").alias("quantity"))
        (batch.withColumn("batch_id", F.lit(batch_id).cast("bigint"))
         .write.mode("overwrite").parquet(_part(data, 0, batch_id, batch_id)))
        _merge_levels(spark, data, batch_id, _update_schema(base is not None))

    q = (stream_stock(changes).writeStream.outputMode("update")
         .option("checkpointLocation", f"{sink}/_checkpoint")
         .foreachBatch(write_batch).trigger(availableNow=True).start())
    q.awaitTermination()
    return data


def _update_schema(with_stock: bool) -> str:
    stock = "quantity int, " if with_stock else ""
    return f"product_id bigint, location_id bigint, net_delta bigint, {stock}batch_id bigint"


def _part(data: str, level: int, low: int, high: int) -> str:
    """Folder with the latest rows of the micro-batches ``low`` to ``high``."""
    return f"{data}/level-{level}/part-{low}-{high}"


def _latest(updates: DataFrame) -> DataFrame:
    """The latest row of each key, columns as they are."""
    own = [c for c in updates.columns if c not in ("product_id", "location_id", "batch_id")]
    return updates.groupBy("product_id", "location_id").agg(
        *[F.max_by(c, "batch_id").alias(c) for c in own], F.max("batch_id").alias("batch_id"))


def _merge_levels(spark: SparkSession, data: str, batch_id: int, schema: str) -> None:
    """Merge the levels that are full after micro-batch ``batch_id``."""
    level, width = 0, 1
    while (batch_id + 1) % (width * FANOUT) == 0:
        low = batch_id + 1 - width * FANOUT
        parts = [_part(data, level, low + k * width, low + (k + 1) * width - 1) for k in range(FANOUT)]
        _latest(spark.read.schema(schema).parquet(*parts)).write.mode("overwrite").parquet(
            _part(data, level + 1, low, batch_id))
        level, width = level + 1, width * FANOUT


def stock_parts(spark: SparkSession, data: str) -> list[str]:
    """The folders that a reader needs: of every range of micro-batches the
    widest finished one."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(data).getFileSystem(spark._jsc.hadoopConfiguration())
    found: list[tuple[int, int, str]] = []
    for level in fs.listStatus(hadoop(data)):
        if not level.getPath().getName().startswith("level-"):
            continue
        for part in fs.listStatus(level.getPath()):
            name = part.getPath().getName()
            if fs.exists(hadoop(part.getPath(), "_SUCCESS")):
                low, high = name.removeprefix("part-").split("-")
                found.append((int(low), int(high), f"{data}/{level.getPath().getName()}/{name}"))
    out, after = [], -1
    for low, high, folder in sorted(found, key=lambda f: (f[0], -f[1])):
        if low > after:
            out.append(folder)
            after = high
    return out


def compact_stock_stream(spark: SparkSession, data: str) -> str:
    """Write the latest row of every key to a new folder, which can be read in
    place of a finished run. Returns that folder."""
    columns = spark.read.parquet(f"{data}/{EMPTY}").columns
    schema = _update_schema("quantity" in columns)
    path = scratch_path(spark, "stock-stream-compact")
    spark.createDataFrame([], schema).write.parquet(f"{path}/{EMPTY}")
    out = read_stock_stream(spark, data).withColumn("batch_id", F.lit(0).cast("bigint"))
    out.write.parquet(_part(path, 0, 0, 0))
    return path


def read_stock_stream(spark: SparkSession, data: str) -> DataFrame:
    """Latest running delta (and current stock, when written) per key, from the
    widest part of every range of micro-batches."""
    columns = spark.read.parquet(f"{data}/{EMPTY}").columns
    schema = _update_schema("quantity" in columns)
    updates = spark.read.schema(schema).parquet(f"{data}/{EMPTY}", *stock_parts(spark, data))
    return _latest(updates).drop("batch_id")
