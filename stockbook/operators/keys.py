"""Dense key allocation above the current maximum, in parallel at every size.

``row_number() OVER (ORDER BY ...)`` with no partition would pull every new
row into one task. Instead:

1. the rows are written once to the shared folder, so that the steps below
   scan a table and do not repeat the plan that made it (unless the caller says
   that they are read from written tables);
2. one aggregate counts the rows to be numbered and takes quantiles of the
   leading order column: ``MIN_BUCKETS`` parts, or one per ``rows_per_bucket``
   rows where that is more (without an upper bound);
3. the quantiles are literals of a bucket column, so a row's bucket depends on
   its own values only; rows are counted per bucket and summed up in order;
4. key = base + rows in earlier buckets + ``row_number`` within the bucket.

Rows that get no number never reach the window. Any bounds give the same keys:
they only decide how evenly the work is dealt.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockbook.session import stored

#: Parts of a batch that is worth less than this many buckets by its size.
MIN_BUCKETS = 8


def current_max(existing: DataFrame | None, key: str) -> int:
    """COALESCE(MAX(key), 0) of an existing table (one scalar)."""
    if existing is None:
        return 0
    value = existing.agg(F.max(key).alias("m")).first()["m"]
    return int(value) if value is not None else 0


def quantile_bounds(rows: DataFrame, lead: Column, buckets: int) -> tuple[int, list[int]]:
    """Number of rows, and at most ``buckets - 1`` ascending values that cut
    ``lead`` into even parts."""
    shares = F.lit([i / buckets for i in range(1, buckets)] or [0.5])
    row = rows.agg(F.count(F.lit(1)).alias("n"),
                   F.percentile_approx(lead, shares, max(10_000, 20 * buckets)).alias("q")).first()
    return row["n"], sorted(set(row["q"] or [])) if buckets > 1 else []


def _longs(values: Sequence[int]) -> str:
    return "array(" + ", ".join(f"{v}L" if v > -2**63 else "-9223372036854775807L"
                                for v in values) + ")"


def bucket_of(lead: Column, bounds: Sequence[int]) -> Column:
    """Number of ``bounds`` below ``lead`` (0 for NULL), found in two steps of
    about the square root of their count each."""
    if not bounds:  # not a literal: a window over a literal key is one task's
        return F.when(lead.isNull(), F.lit(0)).otherwise(F.least(F.lit(0), F.lit(0) * lead)).cast("int")
    step = math.isqrt(len(bounds) - 1) + 1
    parts = [bounds[i:i + step] for i in range(0, len(bounds), step)]

    def below(values: Column) -> Column:
        return F.size(F.filter(values, lambda b: b < lead))

    tops = F.expr(_longs([p[-1] for p in parts[:-1]])) if len(parts) > 1 else None
    which = below(tops) if tops is not None else F.lit(0)
    inner = F.expr("array(" + ", ".join(_longs(p) for p in parts) + ")")
    place = which * step + below(F.element_at(inner, which + 1))
    return F.when(lead.isNull(), F.lit(0)).otherwise(place)


def allocate_keys(rows: DataFrame, key: str, order_by: Sequence[str],
                  existing: DataFrame | None = None, base: int | None = None,
                  where: Column | None = None, buckets: int | None = None,
                  rows_per_bucket: int = 1_000_000, above_kept: bool = False,
                  written: bool = False) -> DataFrame:
    """Number rows ``base + 1, base + 2, ...`` into ``key`` in ``order_by`` order.

    ``order_by`` must be a total order of the rows (ties would make the
    numbering depend on the run) whose first column is an integer. ``base``
    defaults to the maximum of ``key`` in ``existing`` (0 when empty or
    absent); with ``above_kept`` it is the maximum of ``key`` among the rows
    that get no number. With ``where`` only the rows satisfying it are
    numbered; the others are returned too, keeping their own ``key`` value if
    they have that column (else NULL). ``buckets`` overrides their number.
    ``written`` rows are projections of written tables and not written again.
    """
    lead = F.col(order_by[0]).cast("bigint")
    own = F.col(key) if key in rows.columns else F.lit(None).cast("bigint")
    chosen = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    cols = [c for c in rows.columns if c != key]
    rows = rows.select(*cols, own.cast("bigint").alias(key), chosen.alias("_take"))
    if not written:
        rows = stored(rows, f"keys-{key}")
    kept = rows.where(~F.col("_take"))
    picked = rows.where(F.col("_take"))
    if base is None:
        base = current_max(kept if above_kept else existing, key)
    total, bounds = quantile_bounds(picked, lead, buckets or MIN_BUCKETS)
    if buckets is None and total > MIN_BUCKETS * rows_per_bucket:
        _, bounds = quantile_bounds(picked, lead, -(-total // rows_per_bucket))
    placed = picked.withColumn("_bucket", bucket_of(lead, bounds))
    sizes = {r["_bucket"]: r["n"] for r in placed.groupBy("_bucket").agg(
        F.count(F.lit(1)).alias("n")).collect()}  # one number per bucket
    before, starts = int(base), []
    for b in range(len(bounds) + 1):
        starts.append(before)
        before += sizes.get(b, 0)
    offset = F.element_at(F.expr(_longs(starts)), F.col("_bucket") + 1)
    position = F.row_number().over(Window.partitionBy("_bucket").orderBy(*order_by))
    numbered = placed.withColumn(key, (offset + position).cast("bigint")).select(*cols, key)
    out = numbered if where is None else numbered.unionByName(kept.select(*cols, key))
    return out
