"""Write gate: the model's rules applied to a batch before it is appended.

A database refuses a row that breaks NOT NULL, a varchar limit, a key or a
reference; the gate gives every row of a batch the first rule it breaks, so
that the append writes only the others (``append_checked``). NOT NULL and
lengths are one projection; keys and references are one join each against the
keys the batch can meet. Rows without a usable key are dealt (``joins``).

The order of the rules is: NOT NULL, lengths, references, keys already stored,
keys of earlier rows of the batch. An earlier row counts if it passes all
rules but the last kind, in the order of ``order_by``.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockbook.operators.joins import left_join_present
from stockbook.session import stored
from stockbook.sources import schemas as S
from stockbook.sources import sinks


def _keys_of(name: str) -> list[list[str]]:
    """The primary key and the unique keys of a table."""
    return [S.PRIMARY_KEYS[name], *[cols for table, cols in S.UNIQUE_KEYS if table == name]]


def _first(reasons: list[Column]) -> Column:
    return F.coalesce(*reasons, F.lit(None).cast("string"))


def column_refusal(name: str) -> Column:
    """The first NOT NULL or length rule that a row breaks (NULL: none)."""
    reasons = [F.when(F.col(c).isNull(), F.lit(f"{c} is NULL")) for c in S.NOT_NULL[name]]
    reasons += [F.when(F.length(c) > n, F.lit(f"{c} longer than {n}"))
                for c, n in S.VARCHAR_LIMITS.get(name, {}).items()]
    return _first(reasons)


def judged(batch: DataFrame, name: str, tables: Mapping[str, DataFrame], order_by: str) -> DataFrame:
    """``batch`` with ``refusal``: the first rule of table ``name`` that a row breaks.

    ``tables`` holds the stored table itself and the tables it refers to; a
    reference to a table that is not given is not checked. ``order_by`` is a
    column that tells the rows of the batch apart.
    """
    columns = batch.columns
    out = batch.withColumn("refusal", column_refusal(name))
    for child, col, parent, pcol, _ in S.FOREIGN_KEYS:
        if child != name or parent not in tables:
            continue
        known = tables[parent].select(F.col(pcol).alias(col), F.lit(True).alias("_known")).distinct()
        out = left_join_present(out, known, col, F.col("refusal").isNull())
        missing = F.col("refusal").isNull() & F.col(col).isNotNull() & F.col("_known").isNull()
        out = out.withColumn("refusal", F.when(missing, F.lit(f"{col} not in {parent}"))
                             .otherwise(F.col("refusal"))).drop("_known")
    for key in _keys_of(name):
        text = ", ".join(key)
        if name in tables:
            taken = tables[name].select(_key(key).alias("_key"), F.lit(True).alias("_taken")).distinct()
            out = left_join_present(out.withColumn("_key", _key(key)), taken, "_key",
                                    F.col("refusal").isNull())
            hit = F.col("refusal").isNull() & F.col("_taken")
            out = out.withColumn("refusal", F.when(hit, F.lit(f"{text} already stored"))
                                 .otherwise(F.col("refusal"))).drop("_key", "_taken")
    for key in _keys_of(name):
        text = ", ".join(key)
        out = stored(out.withColumn("_key", _key(key)), f"gate-{name}")  # read twice
        firsts = (out.where(F.col("refusal").isNull() & F.col("_key").isNotNull())
                  .groupBy("_key").agg(F.min(order_by).alias("_first"), F.count(F.lit(1)).alias("_n"))
                  .where(F.col("_n") > 1).select("_key", "_first"))
        out = left_join_present(out, firsts, "_key", F.col("refusal").isNull())
        later = F.col("refusal").isNull() & (F.col(order_by) > F.col("_first"))
        out = out.withColumn("refusal", F.when(later, F.lit(f"{text} in an earlier row"))
                             .otherwise(F.col("refusal"))).drop("_key", "_first")
    return out.select(*columns, "refusal")


def _key(cols: list[str]) -> Column:
    """One value for a key (NULL if a part is NULL): rows meet only on equal parts."""
    if len(cols) == 1:
        return F.col(cols[0])
    return F.when(~F.greatest(*[F.col(c).isNull() for c in cols]),
                  F.concat_ws(":", *[F.concat(F.length(F.col(c).cast("string")), F.lit("."),
                                              F.col(c).cast("string")) for c in cols]))


def append_checked(batch: DataFrame, path: str, name: str, tables: Mapping[str, DataFrame],
                   order_by: str, defaults: Mapping[str, object | Column] | None = None) -> DataFrame:
    """S2 through the gate: fill defaults, append the rows that break no rule to
    ``path``, and return the refused ones with their ``refusal``.

    The judged batch is written once, so that both parts are of one judgement.
    """
    filled = sinks.with_defaults(batch, defaults if defaults is not None else sinks.defaults_for(name))
    checked = stored(judged(filled, name, tables, order_by), f"gate-{name}")
    sinks.bulk_load(checked.where(F.col("refusal").isNull()), path, name)
    return checked.where(F.col("refusal").isNotNull())
