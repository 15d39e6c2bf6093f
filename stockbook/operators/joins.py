"""Left join that deals rows without a usable key over all tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def spread_key(key: str, ok: Column, dtype: T.DataType, cols: list[str]) -> Column:
    """``key`` where ``ok``, else a value made of a hash of the row."""
    code = F.xxhash64(*cols)
    if isinstance(dtype, T.StringType):
        filler = code.cast("string")
    else:  # fits an int
        filler = F.pmod(code, F.lit(2**31 - 1)).cast(dtype)
    return F.when(ok, F.col(key)).otherwise(filler)


def left_join_present(left: DataFrame, right: DataFrame, key: str,
                      present: Column | None = None) -> DataFrame:
    """``left`` LEFT JOIN ``right`` USING (key); rows without a usable key match nothing.

    A row is usable when its key is not NULL and ``present`` (if given) holds.
    In a shuffle join all NULL keys hash to one task, so an unusable row joins
    under a filler made of its own values and is kept from matching by a flag
    in the join condition. ``left`` is read once: no split and union.
    """
    ok = F.col(key).isNotNull()
    if present is not None:
        ok = ok & F.coalesce(present, F.lit(False))
    dtype = left.schema[key].dataType
    added = [f.name for f in right.schema.fields if f.name != key]
    lhs = left.withColumn("_usable", ok)
    lhs = lhs.withColumn("_at", spread_key(key, F.col("_usable"), dtype, left.columns))
    rhs = right.select(F.col(key).cast(dtype).alias("_rk"), *added)
    joined = lhs.join(rhs, (F.col("_at") == F.col("_rk")) & F.col("_usable"), "left")
    return joined.select(*left.columns, *added)
