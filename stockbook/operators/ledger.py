"""Stock ledger (the order-line change trigger, set-at-a-time) and stock import.

T1 turns each change of an order line into (product, location, delta);
T2 writes one ledger row per non-zero delta; T3 applies the summed deltas to
stock. Because addition commutes, T3 needs no ordering: a partial aggregation
per (product, location) joined to the stock table once; only the keys that the
stock table lacks become new, numbered rows.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockbook.functions import expressions as X
from stockbook.operators.joins import left_join_present
from stockbook.operators.keys import allocate_keys
from stockbook.session import scratch_path, stored

KEY = ["product_id", "location_id"]


def change_delta(feed: DataFrame) -> DataFrame:
    """Per change, the affected (product, location), old/new quantity and delta.

    INSERT: old = 0. DELETE: new = 0. UPDATE: NEW values over OLD ones (so a
    line moved to another product/location posts only the quantity change to
    the new place). Changes without product or location drop out.
    """
    op = F.col("op")
    ins, upd, dele = op == "INSERT", op == "UPDATE", op == "DELETE"
    loc = (F.when(ins, F.col("new_location"))
            .when(upd, F.coalesce("new_location", "old_location"))
            .when(dele, F.col("old_location")))
    prod = (F.when(ins, F.col("new_product"))
             .when(upd, F.coalesce("new_product", "old_product"))
             .when(dele, F.col("old_product")))
    old = (F.when(ins, F.lit(0)).when(upd, F.coalesce("old_qty", F.lit(0)))
            .when(dele, F.col("old_qty")))
    new = (F.when(ins, F.col("new_qty")).when(upd, F.coalesce("new_qty", F.lit(0)))
            .when(dele, F.lit(0)))
    out = feed.select("seq", "op", "order_id", prod.alias("product_id"),
                      loc.alias("location_id"), old.cast("int").alias("old_qty"),
                      new.cast("int").alias("new_qty"))
    out = out.withColumn("delta", (F.col("new_qty") - F.col("old_qty")).cast("int"))
    return out.where(F.col("product_id").isNotNull() & F.col("location_id").isNotNull())


def _ts(value: _dt.datetime | str | Column) -> Column:
    if isinstance(value, Column):
        return value.cast("timestamp_ntz")
    if isinstance(value, _dt.datetime):
        value = value.strftime("%Y-%m-%d %H:%M:%S.%f")
    return F.to_timestamp_ntz(F.lit(value))


def ledger_rows(deltas: DataFrame, movement_date: _dt.datetime | str | Column, keep: str = "seq") -> DataFrame:
    """T2 without keys: one row per change with delta != 0 (keeps ``seq``, or the column ``keep``)."""
    moved = deltas.where(F.col("delta") != 0)
    reference = F.concat(F.lit("order "), F.coalesce(F.col("order_id").cast("string"), F.lit("")))
    return moved.select(
        keep,
        "product_id",
        F.col("location_id").alias("from_location_id"),
        F.lit(None).cast("bigint").alias("to_location_id"),
        F.abs("delta").cast("int").alias("quantity"),
        X.movement_type("op", "delta").alias("movement_type"),
        _ts(movement_date).alias("movement_date"),
        reference.alias("reference"))


def movement_ledger(deltas: DataFrame, movement_date: _dt.datetime | str | Column,
                    existing: DataFrame | None = None, written: bool = False) -> DataFrame:
    """Ledger rows with movement ids allocated above the existing ledger,
    in change order (``seq``). The deltas are numbered, so that no text travels;
    ``written`` as for ``allocate_keys``."""
    moved = deltas.where(F.col("delta") != 0).select(
        "seq", "op", "order_id", "product_id", "location_id", "delta")
    keyed = allocate_keys(moved, "movement_id", ["seq"], existing=existing, written=written)
    return ledger_rows(keyed, movement_date, "movement_id")


def net_deltas(deltas: DataFrame) -> DataFrame:
    """Summed delta per (product, location), zero sums included."""
    return deltas.groupBy(*KEY).agg(F.sum("delta").cast("bigint").alias("net_delta"))


INVENTORY_COLUMNS = ["inventory_id", "product_id", "location_id", "h_bin_num", "h_rack_num",
                     "quantity", "parcel_qty", "halstan_code"]


def apply_deltas(inventory: DataFrame, deltas: DataFrame, assign_ids: bool = True) -> DataFrame:
    """Stock -= delta per (product, location).

    A row is created for every key the changes touch, even when the summed
    delta is 0; new rows get inventory ids above the current maximum (left
    NULL with ``assign_ids=False`` when only quantities are needed).
    """
    both = with_matches(inventory, net_deltas(deltas))
    qty = (F.coalesce(F.col("quantity").cast("bigint"), F.lit(0))
           - F.coalesce(F.col("net_delta"), F.lit(0))).cast("int")
    after = both.select(*[qty.alias(c) if c == "quantity" else F.col(c) for c in INVENTORY_COLUMNS],
                        "_new")
    if assign_ids:
        after = allocate_keys(after, "inventory_id", KEY, where=F.col("_new"), above_kept=True)
    return after.select(*INVENTORY_COLUMNS)


def with_matches(inventory: DataFrame, fold: DataFrame) -> DataFrame:
    """Stock with the fold of its key next to it, and the keys of ``fold`` that
    it lacks as further rows (``_new``): one join, each side read once."""
    marked = inventory.withColumn("_old", F.lit(True))
    return marked.join(fold, KEY, "full").withColumn("_new", F.col("_old").isNull()).drop("_old")


def reconcile(opening: DataFrame, ledger: DataFrame, inventory: DataFrame) -> DataFrame:
    """T5: expected stock (opening - signed ledger) against actual stock.

    Returns only the (product, location) keys whose actual quantity differs;
    such differences are unlogged replenishments (or changes whose direction
    the unsigned ledger cannot show).
    """
    open_q = opening.groupBy(*KEY).agg(F.sum("quantity").cast("bigint").alias("opening_qty"))
    led = ledger.select(
        "product_id", F.col("from_location_id").alias("location_id"),
        X.signed_ledger_qty("movement_type", "quantity").alias("_s"))
    led = led.groupBy(*KEY).agg(F.sum("_s").cast("bigint").alias("ledger_net"))
    actual = inventory.groupBy(*KEY).agg(F.sum("quantity").cast("bigint").alias("actual_qty"))
    joined = open_q.join(led, KEY, "full").join(actual, KEY, "full")
    expected = F.coalesce("opening_qty", F.lit(0)) + F.coalesce("ledger_net", F.lit(0))
    out = joined.select(
        *KEY,
        F.coalesce("opening_qty", F.lit(0)).cast("bigint").alias("opening_qty"),
        F.coalesce("ledger_net", F.lit(0)).cast("bigint").alias("ledger_net"),
        expected.cast("bigint").alias("expected_qty"),
        F.coalesce("actual_qty", F.lit(0)).cast("bigint").alias("actual_qty"))
    out = out.withColumn("difference", (F.col("actual_qty") - F.col("expected_qty")).cast("bigint"))
    return out.where(F.col("difference") != 0)


_AFTER = "~"  # sorts behind every character of a normalised title


def _matching_titles(texts: DataFrame, titles: DataFrame) -> DataFrame:
    """(_norm, _title_n, _title_pid): number of titles that begin with each text
    of ``texts`` (_norm, distinct), and the product if it is a single one.

    Titles and texts are sorted together. The titles that begin with a text are
    one contiguous range, from the text itself to the text with a last
    character behind it, so their number is a difference of two ranks, and the
    single match is the title at the first rank. Equal titles are one row with
    a weight. Ranks are cumulative weights within range partitions, which are
    written once (the range partitioner draws its bounds anew in every job),
    plus the weights of the partitions before.
    """
    spark = titles.sparkSession
    weights = titles.where(F.length("_t") > 0).groupBy("_t").agg(
        F.count(F.lit(1)).alias("w"), F.min("product_id").alias("pid"))
    none = F.lit(None).cast("bigint")
    keyed = weights.select(F.col("_t").alias("text"), F.lit(1).alias("kind"), "w", "pid",
                           F.lit(None).cast("string").alias("_norm"))
    for kind, at in ((0, F.col("_norm")), (2, F.concat("_norm", F.lit(_AFTER)))):
        keyed = keyed.unionByName(texts.select(at.alias("text"), F.lit(kind).alias("kind"),
                                               F.lit(0).cast("bigint").alias("w"), none.alias("pid"), "_norm"))
    path = scratch_path(spark, "staged-titles")
    (keyed.repartitionByRange("text", "kind").withColumn("part", F.spark_partition_id())
     .write.parquet(path))
    placed = spark.read.schema("text string, kind int, w bigint, pid bigint, _norm string, part int"
                               ).parquet(path)
    before = Window.partitionBy("part").orderBy("text", "kind").rowsBetween(
        Window.unboundedPreceding, -1)
    starts, seen = {}, 0
    for r in placed.groupBy("part").agg(F.sum("w").alias("n")).orderBy("part").collect():
        starts[r["part"]], seen = seen, seen + r["n"]  # one number per range partition
    first = F.array(*[F.lit(starts.get(k, 0)).cast("bigint") for k in range(max(starts, default=0) + 1)])
    ranked = placed.withColumn("rank", F.element_at(first, F.col("part") + 1)
                               + F.coalesce(F.sum("w").over(before), F.lit(0)))
    spans = ranked.where(F.col("kind") != 1).groupBy("_norm").agg(
        F.min("rank").alias("rank"), (F.max("rank") - F.min("rank")).alias("_title_n"))
    single = spans.where(F.col("_title_n") == 1).join(
        ranked.where(F.col("kind") == 1).select("rank", F.col("pid").alias("_title_pid")), "rank")
    return single.select("_norm", "_title_n", "_title_pid")


def resolve_staging(staging: DataFrame, products: DataFrame) -> DataFrame:
    """Find the product of each staged stock row.

    Pass 1: the staged code equals the code of exactly one product.
    Pass 2 (rows pass 1 left open): the staged title, lower-cased and reduced
    to ASCII letters and digits, is a prefix of exactly one product title
    treated alike; see ``_matching_titles``. Rows without a code or without a
    title skip the join of that pass. Rows with no or several candidates are
    quarantined.
    """
    code = X.blank_to_null("halstan_code")
    codes = (products.select(code.alias("_code"), "product_id")
             .where(F.col("_code").isNotNull())
             .groupBy("_code").agg(F.count(F.lit(1)).alias("_code_n"),
                                  F.min("product_id").alias("_code_pid")))
    norm = X.normalise_title("title_raw")
    staged = staging.withColumn("_code", code).withColumn(
        "_norm", F.when(F.length(norm) > 0, norm))
    staged = stored(left_join_present(staged, codes, "_code"), "staged-codes")
    by_code = F.when(F.col("_code_n") == 1, F.col("_code_pid"))
    open_ = by_code.isNull()
    texts = staged.where(open_ & F.col("_norm").isNotNull()).select("_norm").distinct()
    titles = products.select("product_id", X.normalise_title("title").alias("_t"))
    staged = left_join_present(staged, _matching_titles(texts, titles), "_norm", present=open_)
    by_title = F.col("_title_pid")
    match = (F.when(by_code.isNotNull(), F.lit("code"))
             .when(by_title.isNotNull(), F.lit("title")))
    cols = [c for c in staging.columns if c != "product_id"]
    return staged.select(
        *cols,
        F.coalesce(by_code, by_title).alias("product_id"),
        match.alias("match"),
        F.when(match.isNull(), F.lit("quarantined")).otherwise(F.lit("resolved")).alias("status"))


def staging_to_inventory(resolved: DataFrame, location_id: int = 1) -> DataFrame:
    """Roll resolved staged rows up to opening stock at one location.

    Quantities add; bin, rack, code and parcel size come from the row with the
    highest staging id.
    """
    ok = resolved.where(F.col("status") == "resolved")
    agg = ok.groupBy("product_id").agg(
        F.sum("quantity").cast("int").alias("quantity"),
        F.max_by("h_bin_num", "staging_id").alias("h_bin_num"),
        F.max_by("rack_num", "staging_id").alias("h_rack_num"),
        F.max_by("parcel_qty", "staging_id").alias("parcel_qty"),
        F.max_by("halstan_code", "staging_id").alias("halstan_code"))
    return agg.select("product_id", F.lit(location_id).cast("bigint").alias("location_id"),
                      "quantity", "h_bin_num", "h_rack_num", "parcel_qty", "halstan_code")


def normalise_duration(products: DataFrame) -> DataFrame:
    """T8: '[8:00; 7:30; 7:00]' -> 3 movements, 1350 s, '22:30'.

    ``malformed`` marks texts with a part that is no time (or does not fit):
    their seconds are NULL and they are not ``consistent``. Otherwise
    ``consistent`` tells whether the stored columns agree (a NULL stored value
    is not a disagreement).
    """
    parts = X.duration_parts("duration")
    # try_add: neither a NULL part nor a huge sum stops the job
    total = F.aggregate(parts, F.lit(0).cast("bigint"), lambda a, x: F.try_add(a, x))
    d = products.where(F.col("duration").isNotNull()).select(
        "product_id", "duration", "no_of_movements", "duration_seconds", "duration_formatted",
        F.size(parts).cast("int").alias("movements"), total.alias("seconds"))
    d = d.withColumn("formatted", X.format_seconds("seconds"))
    d = d.withColumn("malformed", F.col("seconds").isNull())

    def agrees(stored: str, computed: str) -> Column:
        return F.col(stored).isNull() | F.coalesce(F.col(stored) == F.col(computed), F.lit(False))

    ok = (~F.col("malformed") & agrees("no_of_movements", "movements")
          & agrees("duration_seconds", "seconds") & agrees("duration_formatted", "formatted"))
    return d.select("product_id", "duration", "movements", "seconds", "formatted", "malformed",
                    ok.alias("consistent"))
