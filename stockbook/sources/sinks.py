"""Appending, bulk loading and publishing table versions.

Parquet has no MERGE, so changed tables are written to new folders and become
current by one numbered pointer, a small JSON file that lists the folders of
every table. A table that only grew keeps its folders and gets one more, so an
append rewrites nothing. A job never overwrites a folder that it may be reading.

Several writers: the pointer file of a number is created only if it does not
exist (an exclusive create, which the file system decides), so two writers
never share a number; the loser takes the next one, or gets ``Conflict`` when
it named the version that its new tables were computed from. Readers take the
highest pointer that has its content. The file system must offer that create
(local and HDFS do; an object store needs its conditional put switched on).
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable, Mapping

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stockbook.sources.schemas import TABLES

# Constant column defaults of the model.
DEFAULTS: dict[str, dict[str, object]] = {
    "order_line": {"quantity": 1},
    "inventory": {"quantity": 0},
}


def defaults_for(name: str, now: object | Column | None = None,
                 today: object | Column | None = None) -> dict[str, object | Column]:
    """All defaults of a table: the constants above plus the time defaults
    (movement_date = now, order_date = today). Pass ``now`` / ``today`` to make
    a run repeatable; otherwise the query's current time is used."""
    out: dict[str, object | Column] = dict(DEFAULTS.get(name, {}))
    if name == "inventory_movement":
        out["movement_date"] = _as_column(now, "timestamp_ntz", F.localtimestamp())
    if name == "orders":
        out["order_date"] = _as_column(today, "date", F.current_date())
    return out


def _as_column(value: object | Column | None, dtype: str, default: Column) -> Column:
    if value is None:
        return default
    if isinstance(value, Column):
        return value
    return F.lit(str(value)).cast(dtype)


def with_defaults(df: DataFrame, defaults: Mapping[str, object | Column]) -> DataFrame:
    """Fill NULLs of the given columns with their defaults (literal or column)."""
    out = []
    for c in df.columns:
        if c in defaults:
            d = defaults[c]
            fill = d if isinstance(d, Column) else F.lit(d)
            out.append(F.coalesce(F.col(c), fill.cast(df.schema[c].dataType)).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


def append(batch: DataFrame, table: DataFrame,
           defaults: Mapping[str, object | Column] | None = None) -> DataFrame:
    """The table with the batch appended (by column name, defaults filled)."""
    filled = with_defaults(batch.select(*table.columns), defaults or {})
    return table.unionByName(filled)


def append_to(batch: DataFrame, path: str, name: str,
              defaults: Mapping[str, object | Column] | None = None) -> None:
    """S2 to storage: ``write.mode('append')`` with the model schema."""
    cols = [f.name for f in TABLES[name].fields]
    with_defaults(batch.select(*cols), defaults or defaults_for(name)).write.mode(
        "append").parquet(path)


def bulk_load(df: DataFrame, path: str, name: str) -> None:
    """S3: plain load of existing rows; no change feed, no ledger entries."""
    cols = [f.name for f in TABLES[name].fields]
    df.select(*cols).write.mode("append").parquet(path)


_POINTERS = "pointers"
#: How long a pointer may be without content before its writer counts as lost.
CLAIM_SECONDS = 10.0


class Conflict(RuntimeError):
    """Another writer published after the version that a change was made from."""


def _fs(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark._jsc.hadoopConfiguration())


def _pointer_numbers(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the pointer files, ascending, with or without content."""
    folder, fs = _fs(spark, f"{root.rstrip('/')}/{_POINTERS}")
    if not fs.exists(folder):
        return []
    names = [status.getPath().getName() for status in fs.listStatus(folder)]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def _read_pointer(spark: SparkSession, root: str, n: int) -> dict | None:
    """Content of a pointer; None while its writer has not finished it (or never will)."""
    path, fs = _fs(spark, f"{root.rstrip('/')}/{_POINTERS}/{n:012d}.json")
    stream = fs.open(path)
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    try:
        return json.loads(text)
    except ValueError:
        return None


def _create(spark: SparkSession, path: str, text: str) -> bool:
    """Create ``path`` with ``text`` unless it exists; False if it does.

    The check and the creation are one step of the file system: an exclusive
    open on a local folder, ``create(overwrite = false)`` elsewhere.
    """
    hadoop, fs = _fs(spark, path)
    if fs.getScheme() == "file":
        local = hadoop.toUri().getPath()
        os.makedirs(os.path.dirname(local), exist_ok=True)
        try:
            handle = os.open(local, os.O_CREAT | os.O_EXCL | os.O_WRONLY, 0o644)
        except FileExistsError:
            return False
        with os.fdopen(handle, "w") as f:
            f.write(text)
        return True
    try:
        out = fs.create(hadoop, False)
    except Py4JJavaError as e:
        if "FileAlreadyExists" in str(e.java_exception.getClass().getName()):
            return False
        raise
    try:
        out.write(bytearray(text, "utf-8"))
    finally:
        out.close()
    return True


def _current(spark: SparkSession, root: str) -> tuple[int, dict] | None:
    """(number, content) of the highest finished pointer."""
    for n in reversed(_pointer_numbers(spark, root)):
        content = _read_pointer(spark, root, n)
        if content is not None:
            return n, content
    return None


def _settled(spark: SparkSession, root: str) -> tuple[int, int, dict]:
    """(last number, number and content of the highest finished pointer).

    A last pointer without content is waited for; after ``CLAIM_SECONDS`` its
    writer counts as lost and the pointer as empty.
    """
    until = time.monotonic() + CLAIM_SECONDS
    while True:
        numbers = _pointer_numbers(spark, root)
        found = _current(spark, root)
        n, content = found if found else (0, {})
        if not numbers or numbers[-1] == n or time.monotonic() > until:
            return (numbers[-1] if numbers else 0), n, content
        time.sleep(0.05)


def _commit(spark: SparkSession, root: str, make: Callable[[dict], dict], based_on: int | None) -> int:
    """Publish ``make(content of the version before)`` under the next number.

    The number follows the last one that was seen, and its file is created
    exclusively, so no other version can come between; if one does, the content
    is made again from it, unless ``based_on`` forbids that.
    """
    while True:
        last, n, before = _settled(spark, root)
        if based_on is not None and n != based_on:
            raise Conflict(f"{root}: version {n} was published after version {based_on}")
        path = f"{root.rstrip('/')}/{_POINTERS}/{last + 1:012d}.json"
        if _create(spark, path, json.dumps(make(before))):
            return last + 1


def current_number(spark: SparkSession, root: str) -> int:
    """Number of the current version of ``root`` (0: nothing published yet)."""
    found = _current(spark, root)
    return found[0] if found else 0


def publish(df: DataFrame, table_root: str, based_on: int | None = None) -> str:
    """Write ``df`` as a new version under ``table_root`` and point to it.

    Returns the version folder. The pointer is written after the data, so
    readers see either the old or the new version, never a mix. Writers may
    publish at once: every one gets a version of its own. With ``based_on``
    (the number that ``df`` was computed from) a version in between raises
    ``Conflict`` instead.
    """
    version = f"{table_root.rstrip('/')}/v-{uuid.uuid4().hex}"
    df.write.mode("error").parquet(version)
    _commit(df.sparkSession, table_root, lambda before: {"version": version}, based_on)
    return version


def current_version(spark: SparkSession, table_root: str) -> str:
    """The folder ``publish`` last pointed to."""
    found = _current(spark, table_root)
    if found is None:
        raise FileNotFoundError(f"nothing is published under {table_root}")
    return found[1]["version"]


def publish_tables(tables: Mapping[str, DataFrame], root: str,
                   added: Mapping[str, DataFrame] | None = None,
                   based_on: int | None = None) -> str:
    """S4 for several tables that must change together (e.g. stock and ledger).

    ``tables`` replace the tables of their names, ``added`` are rows that the
    tables of their names get more; the other tables of ``root`` stay. All are
    written below one new folder, then one pointer write makes them current at
    once. Returns the folder. ``based_on`` as for ``publish``.
    """
    added = added or {}
    if not tables and not added:
        raise ValueError("nothing to publish")
    spark = next(iter([*tables.values(), *added.values()])).sparkSession
    version = f"{root.rstrip('/')}/v-{uuid.uuid4().hex}"
    for name, df in [*tables.items(), *added.items()]:
        df.write.mode("error").option("compression", "zstd").parquet(f"{version}/{name}")

    def folders(before: dict) -> dict:
        now = dict(before.get("tables", {}))
        now.update({name: [f"{version}/{name}"] for name in tables})
        now.update({name: [*now.get(name, []), f"{version}/{name}"] for name in added})
        return {"version": version, "tables": now}

    _commit(spark, root, folders, based_on)
    return version


def current_tables(spark: SparkSession, root: str, names: list[str]) -> dict[str, DataFrame]:
    """The tables of the version ``publish_tables`` last pointed to."""
    found = _current(spark, root)
    if found is None:
        raise FileNotFoundError(f"nothing is published under {root}")
    return {n: read_folders(spark, found[1]["tables"][n], n) for n in names}


def read_folders(spark: SparkSession, folders: list[str], name: str) -> DataFrame:
    """The rows of all folders of a table, in the model's schema if it is a model table."""
    reader = spark.read if name not in TABLES else spark.read.schema(TABLES[name])
    return reader.parquet(*folders)
