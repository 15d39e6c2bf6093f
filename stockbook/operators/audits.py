"""Integrity audits: the model's constraints, checked as jobs.

Spark enforces no key, uniqueness, reference or NOT NULL rule, so each rule is
a distributed query returning what violates it (or, for C4/C5, a one-pass
per-column report).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockbook.session import stored


def _key_text(cols: Sequence[str]):
    return F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("NULL")) for c in cols])


def audit_unique(df: DataFrame, cols: Sequence[str], table: str,
                 nulls_distinct: bool = False) -> DataFrame:
    """Duplicated keys (and, for primary keys, NULL keys).

    Output: table_name, key_value, problem ('duplicate' / 'null key'), row_count.
    One scan: the rows are counted per key, NULLs included, and the counts of
    the keys with a NULL part are summed up. With ``nulls_distinct`` (unique constraints) rows with a NULL key part are
    ignored, as NULLs never collide.
    """
    any_null = F.lit(False)
    for c in cols:
        any_null = any_null | F.col(c).isNull()
    counted = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n")).select(
        F.when(any_null, F.lit(None)).otherwise(_key_text(cols)).alias("key_value"),
        F.when(any_null, F.lit("null key")).when(F.col("n") > 1, F.lit("duplicate")).alias("problem"),
        "n")
    if nulls_distinct:
        found = counted.where(F.col("problem") == "duplicate")
    else:
        found = (counted.where(F.col("problem").isNotNull()).groupBy("key_value", "problem")
                 .agg(F.sum("n").alias("n")))
    return found.select(F.lit(table).alias("table_name"), "key_value", "problem",
                        F.col("n").cast("bigint").alias("row_count"))


def audit_fk(child: DataFrame, col: str, parent: DataFrame, pcol: str,
             child_name: str, parent_name: str) -> DataFrame:
    """Child rows whose (non-NULL) reference has no parent row.

    Output: child_table, column_name, parent_table, key_value, row_count.
    """
    refs = child.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("_k")).agg(
        F.count(F.lit(1)).alias("row_count"))
    keys = parent.select(F.col(pcol).alias("_k")).distinct()
    orphans = refs.join(keys, "_k", "left_anti")
    return orphans.select(
        F.lit(child_name).alias("child_table"), F.lit(col).alias("column_name"),
        F.lit(parent_name).alias("parent_table"), F.col("_k").cast("string").alias("key_value"),
        F.col("row_count").cast("bigint"))


def audit_foreign_keys(tables: Mapping[str, DataFrame],
                       fks: Sequence[tuple[str, str, str, str]]) -> DataFrame:
    """C3 for many references at once: every table is scanned once.

    ``fks`` = [(child table, column, parent table, parent column)]. The
    reference columns of each child are unpivoted into (column, key) pairs and
    counted per key (partial aggregation, so a hot key is one row per task);
    the parent keys of all references form one key table; one anti-join then
    finds the orphans. Same output as ``audit_fk``.
    """
    by_child: dict[str, list[tuple[str, str]]] = {}
    for child, col, parent, _ in fks:
        by_child.setdefault(child, []).append((col, parent))
    refs = None
    for child, cols in by_child.items():
        pairs = F.explode(F.array(*[
            F.struct(F.lit(col).alias("column_name"), F.lit(parent).alias("parent_table"),
                     F.col(col).cast("bigint").alias("_k"))
            for col, parent in cols]))
        part = tables[child].select(pairs.alias("r")).select(
            F.lit(child).alias("child_table"), "r.*").where(F.col("_k").isNotNull())
        refs = part if refs is None else refs.unionByName(part)
    counted = refs.groupBy("child_table", "column_name", "parent_table", "_k").agg(
        F.count(F.lit(1)).alias("row_count"))
    parents = {(parent, pcol) for _, _, parent, pcol in fks}
    keys = None
    for parent, pcol in sorted(parents):
        part = tables[parent].select(F.lit(parent).alias("parent_table"),
                                     F.col(pcol).cast("bigint").alias("_k"))
        keys = part if keys is None else keys.unionByName(part)
    orphans = counted.join(keys.distinct(), ["parent_table", "_k"], "left_anti")
    return orphans.select("child_table", "column_name", "parent_table",
                          F.col("_k").cast("string").alias("key_value"),
                          F.col("row_count").cast("bigint"))


def audit_not_null(df: DataFrame, cols: Sequence[str], table: str) -> DataFrame:
    """C4: NULL count of each NOT NULL column, all columns in one scan.

    Output: table_name, column_name, null_count (0 = rule holds).
    """
    counts = df.agg(*[F.count(F.when(F.col(c).isNull(), F.lit(1))).alias(c) for c in cols])
    return counts.unpivot([], list(cols), "column_name", "null_count").select(
        F.lit(table).alias("table_name"), "column_name",
        F.col("null_count").cast("bigint"))


def audit_lengths(df: DataFrame, limits: Mapping[str, int], table: str) -> DataFrame:
    """Per varchar(n) column, rows longer than n and the longest length.

    Output: table_name, column_name, max_length, limit, too_long (row count).
    """
    cols = list(limits)
    aggs = []
    for c in cols:
        n = F.length(F.col(c))
        aggs += [F.max(n).alias(f"{c}__max"),
                 F.count(F.when(n > limits[c], F.lit(1))).alias(f"{c}__bad")]
    row = df.agg(*aggs)
    packed = F.array(*[F.struct(F.lit(c).alias("column_name"),
                                 F.col(f"{c}__max").cast("bigint").alias("max_length"),
                                 F.lit(limits[c]).cast("bigint").alias("limit"),
                                 F.col(f"{c}__bad").cast("bigint").alias("too_long"))
                       for c in cols])
    return row.select(F.explode(packed).alias("r")).select(
        F.lit(table).alias("table_name"), "r.*")


# ------------------------------------------------------------------ after a change

def audit_unique_changed(df: DataFrame, cols: Sequence[str], table: str, changed: DataFrame,
                         nulls_distinct: bool = False) -> DataFrame:
    """C1 / C2 for the keys in ``changed`` only (a frame with the columns ``cols``).

    Rows of other keys are dropped by a semi-join before anything is shuffled
    for counting (a runtime filter when the change is small). If the table
    kept the rule before, this is all that ``audit_unique`` would find after
    the rows of ``changed`` were added or altered.
    """
    keys = changed.select(*cols).distinct()
    same = None
    for c in cols:
        one = df[c].eqNullSafe(keys[c])
        same = one if same is None else same & one
    return audit_unique(df.join(keys, same, "left_semi"), cols, table, nulls_distinct)


def audit_foreign_keys_changed(tables: Mapping[str, DataFrame],
                               fks: Sequence[tuple[str, str, str, str]],
                               written: Mapping[str, DataFrame],
                               deleted: Mapping[str, DataFrame]) -> DataFrame:
    """C3 after a change: the orphans among ``written`` rows (child rows added or
    altered) and among the rows that refer to ``deleted`` keys (parent rows gone).

    ``tables`` are the tables after the change. If all references held before,
    the keys are those that ``audit_foreign_keys`` finds; a key's row count is
    that of the whole child table.
    """
    pairs = None
    for child, col, parent, pcol in fks:
        parts = []
        if child in written:
            parts.append(written[child].select(F.col(col).cast("bigint").alias("_k")))
        if parent in deleted:
            parts.append(deleted[parent].select(F.col(pcol).cast("bigint").alias("_k")))
        for part in parts:
            part = part.where(F.col("_k").isNotNull()).select(
                F.lit(child).alias("child_table"), F.lit(col).alias("column_name"),
                F.lit(parent).alias("parent_table"), "_k")
            pairs = part if pairs is None else pairs.unionByName(part)
    at = ["child_table", "column_name", "parent_table", "_k"]
    if pairs is None:
        some = next(iter(tables.values()))
        return some.sparkSession.createDataFrame(
            [], "child_table string, column_name string, parent_table string, key_value string, row_count bigint")
    suspects = stored(pairs.distinct(), "audit-suspects")
    keys = None
    for parent, pcol in sorted({(parent, pcol) for _, _, parent, pcol in fks}):
        part = tables[parent].select(F.lit(parent).alias("parent_table"), F.col(pcol).cast("bigint").alias("_k"))
        keys = part if keys is None else keys.unionByName(part)
    gone = suspects.join(keys, ["parent_table", "_k"], "left_anti").select(*at)
    refs = None
    for child in dict.fromkeys(c for c, _, _, _ in fks):
        own = [(col, parent) for c, col, parent, _ in fks if c == child]
        found = F.explode(F.array(*[F.struct(F.lit(col).alias("column_name"), F.lit(parent).alias("parent_table"),
                                             F.col(col).cast("bigint").alias("_k")) for col, parent in own]))
        part = tables[child].select(found.alias("r")).select(F.lit(child).alias("child_table"), "r.*")
        refs = part if refs is None else refs.unionByName(part)
    counted = refs.join(gone, at, "left_semi").groupBy(*at).agg(F.count(F.lit(1)).alias("row_count"))
    return counted.select("child_table", "column_name", "parent_table",
                          F.col("_k").cast("string").alias("key_value"),
                          F.col("row_count").cast("bigint"))


def audit_not_null_changed(tables: Mapping[str, DataFrame], required: Mapping[str, Sequence[str]]) -> DataFrame:
    """C4 for written rows only: ``tables`` holds the rows added or altered."""
    out = None
    for name, rows in tables.items():
        part = audit_not_null(rows, required[name], name)
        out = part if out is None else out.unionByName(part)
    return out
