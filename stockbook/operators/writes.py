"""Set-based writes: inserts with key allocation, upserts, replacements, deletes.

Every write takes a batch of requests and returns new table states (plus a
per-request report) as DataFrames; publishing them is ``sources.sinks``.
Several requests for one key are folded in request order (``seq``):
quantities add (commutative), "last value wins" fields use ``max_by(value,
seq)``. Both are partial aggregations, so a hot key is combined map-side
before the shuffle.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockbook.functions import expressions as X
from stockbook.operators import validate as V
from stockbook.operators.joins import left_join_present
from stockbook.operators.keys import allocate_keys
from stockbook.operators.ledger import INVENTORY_COLUMNS, with_matches
from stockbook.session import stored
from stockbook.sources import schemas as S

KEY = ["product_id", "location_id"]


def _known(table: DataFrame, col: str, flag: str, as_col: str | None = None) -> DataFrame:
    """Distinct keys of ``table`` with a TRUE flag column (for existence checks)."""
    return table.select(F.col(col).alias(as_col or col)).distinct().withColumn(flag, F.lit(True))


def _add_reason(df: DataFrame, checks: Sequence[tuple[Column, str]]) -> DataFrame:
    """Keep an existing reason, else the first failing extra check."""
    expr = F.col("reason")
    for cond, text in checks:
        expr = F.when(expr.isNotNull(), expr).when(cond, F.lit(text))
    return df.withColumn("reason", expr)


def _date(value: _dt.date | str | Column) -> Column:
    if isinstance(value, Column):
        return value.cast("date")
    return F.lit(str(value)).cast("date")


# ------------------------------------------------------------------ W2

def create_orders(requests: DataFrame, orders: DataFrame, customers: DataFrame,
                  today: _dt.date | str | Column) -> tuple[DataFrame, DataFrame]:
    """New orders dated ``today`` for valid, existing customers.

    Returns (new order rows, report(seq, customer_id, order_id, reason)).
    """
    checked = V.validate_keys(requests, "customer_id", "customer_id")
    checked = left_join_present(checked, _known(customers, "customer_id", "_kc"), "customer_id")
    checked = _add_reason(checked, [(F.col("_kc").isNull(), "unknown customer")])
    keyed = allocate_keys(checked.select("seq", "customer_id", "reason"), "order_id", ["seq"],
                          existing=orders, where=F.col("reason").isNull())
    new = keyed.where(F.col("reason").isNull())
    null_s = F.lit(None).cast("string")
    new_orders = new.select(
        "order_id", _date(today).alias("order_date"), "customer_id",
        F.lit(None).cast("date").alias("inv_pull_date"), null_s.alias("billing_address"),
        null_s.alias("billing_country"), null_s.alias("billing_street"),
        null_s.alias("billing_zip"))
    return new_orders, keyed.select("seq", "customer_id", "order_id", "reason")


# ------------------------------------------------------------------ W3

def add_order_lines(requests: DataFrame, lines: DataFrame, products: DataFrame,
                    orders: DataFrame, locations: DataFrame, numbered: DataFrame | None = None
                    ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Validated new order lines, their INSERT change feed, and a report.

    Returns (new lines with line_total, change feed, report). Rejected: any V1
    failure, or an order / product / location that does not exist. Ids go on
    above ``numbered`` (default: ``lines``). The judged requests are written
    once; only those that pass V1, whose keys are not NULL, are joined, so none
    of the others travels.
    """
    place = "fulfilled_from_location_id"
    cols = ["order_id", "product_id", "product_price", "quantity", place]
    judged = stored(V.validate_order_lines(requests).select("seq", *cols, "reason"), "judged-lines")
    checked = judged.where(F.col("reason").isNull())
    for table, key, flag, at in ((orders, "order_id", "_ko", "order_id"), (products, "product_id", "_kp", "product_id"),
                                 (locations, "location_id", "_kl", place)):
        checked = checked.join(_known(table, key, flag, at), at, "left")
    fits = (F.col("product_price") * F.col("quantity")).try_cast(S.MONEY).isNotNull()
    checked = _add_reason(checked, [(~fits, "line total out of range"),
                                    (F.col("_ko").isNull(), "unknown order"),
                                    (F.col("_kp").isNull(), "unknown product"),
                                    (F.col("_kl").isNull(), "unknown location")])
    accepted = F.col("reason").isNull()
    keyed = allocate_keys(checked.select("seq", *cols, "reason"), "order_line_id", ["seq"],
                          existing=lines if numbered is None else numbered, where=accepted)
    keyed = keyed.withColumn("line_total", F.when(accepted, X.line_total()))
    new = keyed.where(accepted)
    new_lines = new.select("order_line_id", *cols, "line_total")
    nl, ni = F.lit(None).cast("bigint"), F.lit(None).cast("int")
    feed = new.select("seq", F.lit("INSERT").alias("op"), "order_id",
                      nl.alias("old_product"), nl.alias("old_location"), ni.alias("old_qty"),
                      F.col("product_id").alias("new_product"),
                      F.col("fulfilled_from_location_id").alias("new_location"),
                      F.col("quantity").alias("new_qty"))
    refused = judged.where(F.col("reason").isNotNull()).withColumns(
        {c: F.lit(None).cast(keyed.schema[c].dataType) for c in ("order_line_id", "line_total")})
    report = keyed.select("seq", "order_line_id", *cols, "line_total", "reason").unionByName(refused)
    return new_lines, feed, report


# ------------------------------------------------------------------ W4

def add_customers(requests: DataFrame, customers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Validated new customers with ids above the current maximum.

    Returns (new customer rows, report(seq, customer_id, reason)).
    """
    checked = V.validate_customers(requests)
    keyed = allocate_keys(checked, "customer_id", ["seq"], existing=customers,
                          where=F.col("reason").isNull())
    rows = keyed.where(F.col("reason").isNull()).select("customer_id", *V.CUSTOMER_FIELDS)
    return rows, keyed.select("seq", "customer_id", "first_name", "last_name", "reason")


# ------------------------------------------------------------------ W5-W7

PRODUCT_FIELDS = [f.name for f in S.PRODUCT.fields if f.name != "product_id"]


def _product_forms(requests: DataFrame, category: DataFrame) -> DataFrame:
    """V3 plus category names resolved to ids (unknown name -> request rejected)."""
    checked = V.validate_products(requests)
    names = checked.select("seq", F.explode("categories").alias("category_name"))
    named = names.join(category.select("category_id", "category_name"), "category_name", "left")
    unknown = named.where(F.col("category_id").isNull()).groupBy("seq").agg(
        F.min("category_name").alias("_unknown"))
    checked = checked.join(unknown, "seq", "left")
    return _add_reason(checked, [(F.col("_unknown").isNotNull(), "unknown category")])


def _links(forms: DataFrame, category: DataFrame) -> DataFrame:
    """(product_id, category_id) for the chosen names of accepted forms."""
    names = forms.select("product_id", F.explode("categories").alias("category_name"))
    return names.join(category.select("category_id", "category_name"), "category_name"
                      ).select("product_id", "category_id").distinct()


def add_products(requests: DataFrame, products: DataFrame, category: DataFrame
                 ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New products (ids above the maximum) and one link per chosen category.

    Returns (new product rows, new link rows, report(seq, product_id, title,
    category_count, reason)).
    """
    reqs = requests.drop("product_id") if "product_id" in requests.columns else requests
    forms = _product_forms(reqs, category).drop("_unknown")
    keyed = allocate_keys(forms, "product_id", ["seq"], existing=products,
                          where=F.col("reason").isNull())
    new = keyed.where(F.col("reason").isNull())
    rows = new.select("product_id", *PRODUCT_FIELDS)
    links = _links(new, category)
    report = keyed.select("seq", "product_id", "title",
                          F.size("categories").cast("int").alias("category_count"), "reason")
    return rows, links, report


def judged_product_edits(requests: DataFrame, products: DataFrame,
                         category: DataFrame) -> DataFrame:
    """Every edit request with its fate: all form columns, product_id, reason and status.

    status: 'rejected' (see reason: the form first, then the id), 'not found',
    'superseded' (a later accepted edit of the same product in the batch) or
    'updated'. The raw id travels through form validation, so the key is
    validated on the same rows (no join of the batch with itself).
    """
    forms = _product_forms(requests, category).withColumnRenamed("reason", "_form_reason")
    forms = V.validate_keys(forms, "product_id", "product_id")
    forms = forms.withColumn("reason", F.coalesce("_form_reason", "reason")).drop("_form_reason")
    good = F.col("reason").isNull()
    # the last accepted edit of each product: a partial aggregation, no window
    last = forms.where(good).groupBy("product_id").agg(F.max("seq").alias("_last"))
    last = last.join(_known(products, "product_id", "_hit"), "product_id", "left")
    forms = left_join_present(forms, last, "product_id", present=good)
    status = (F.when(~good, F.lit("rejected")).when(F.col("_hit").isNull(), F.lit("not found"))
              .when(F.col("seq") < F.col("_last"), F.lit("superseded")).otherwise(F.lit("updated")))
    return forms.withColumn("status", status).drop("_last", "_hit", "_unknown")


def edit_report(judged: DataFrame) -> DataFrame:
    """One answer per request (seq, product_id, status, reason)."""
    return judged.select("seq", "product_id", "status", "reason")


def update_products(requests: DataFrame, products: DataFrame, category: DataFrame
                    ) -> tuple[DataFrame, DataFrame]:
    """Replace all non-key columns of matched products (NULL overwrites).

    Returns (products after the update, report(seq, product_id, status, reason)).
    """
    judged = judged_product_edits(requests, products, category)
    new_vals = judged.where(F.col("status") == "updated").select(
        "product_id", *[F.col(c).alias(f"_n_{c}") for c in PRODUCT_FIELDS], F.lit(True).alias("_hit"))
    joined = products.join(new_vals, "product_id", "left")
    after = joined.select("product_id", *[
        F.when(F.col("_hit"), F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c)
        for c in PRODUCT_FIELDS])
    return after, edit_report(judged)


def replace_categories(requests: DataFrame, products: DataFrame, junction: DataFrame,
                       category: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For each updated (existing) product, drop all links and insert the
    chosen set; an empty choice leaves the product without categories.

    Returns (links after the change, report(seq, product_id, status, reason)).
    """
    judged = judged_product_edits(requests, products, category)
    edits = judged.where(F.col("status") == "updated")
    kept = junction.join(edits.select("product_id"), "product_id", "left_anti")
    after = kept.select("product_id", "category_id").unionByName(_links(edits, category))
    return after, edit_report(judged)


# ------------------------------------------------------------------ W8 / W9

def _upsert_stock(inventory: DataFrame, fold: DataFrame, overwrite_place: bool,
                  assign_ids: bool = True) -> DataFrame:
    """Stock with the folded requests of each (product, location) applied.

    One join; existing rows keep their id, the requests that hit no row become
    new rows, which alone are numbered, in order of their first request.
    """
    both = with_matches(inventory, fold.withColumn("_req", F.lit(True)))
    old = F.coalesce(F.col("quantity").cast("bigint"), F.lit(0))
    qty = (old + F.coalesce(F.col("_add"), F.lit(0))).cast("int")
    if overwrite_place:
        bin_ = F.when(F.col("_req"), F.col("_bin")).otherwise(F.col("h_bin_num"))
        rack = F.when(F.col("_req"), F.col("_rack")).otherwise(F.col("h_rack_num"))
        code = F.coalesce(F.col("_code"), F.col("halstan_code"))
    else:
        bin_, rack, code = F.col("h_bin_num"), F.col("h_rack_num"), F.col("halstan_code")
    after = both.select("inventory_id", *KEY, bin_.alias("h_bin_num"), rack.alias("h_rack_num"),
                        qty.alias("quantity"), "parcel_qty", code.alias("halstan_code"),
                        "_first", "_new")
    if assign_ids:
        after = allocate_keys(after, "inventory_id", ["_first", *KEY], where=F.col("_new"),
                              above_kept=True)
    return after.select(*INVENTORY_COLUMNS)


def replenish(requests: DataFrame, inventory: DataFrame, assign_ids: bool = True) -> DataFrame:
    """Upsert validated replenishments (seq, product_id, location_id,
    quantity, h_bin_num, h_rack_num, halstan_code) into stock.

    Per key: quantity += sum; bin and rack = those of the last request (even
    NULL); code = last non-NULL code, else the existing one; parcel_qty kept
    (NULL on a new row). New rows are numbered in order of first request.
    """
    code_seq = F.when(F.col("halstan_code").isNotNull(), F.col("seq"))
    fold = requests.groupBy(*KEY).agg(
        F.sum("quantity").cast("bigint").alias("_add"),
        F.max_by("h_bin_num", "seq").alias("_bin"),
        F.max_by("h_rack_num", "seq").alias("_rack"),
        F.max_by("halstan_code", code_seq).alias("_code"),
        F.min("seq").alias("_first"))
    return _upsert_stock(inventory, fold, overwrite_place=True, assign_ids=assign_ids)


def undo_replenish(undo_ids: DataFrame, replenish_log: DataFrame,
                   inventory: DataFrame, id_col: str = "replenish_seq") -> DataFrame:
    """Take back the named replenishments (each id at most once).

    Only quantities change; a missing row is created with the negative amount.
    """
    named = undo_ids.select(F.col(id_col).alias("seq")).distinct()
    hits = replenish_log.join(named, "seq", "left_semi")
    fold = hits.groupBy(*KEY).agg((-F.sum("quantity")).cast("bigint").alias("_add"),
                                  F.min("seq").alias("_first"))
    return _upsert_stock(inventory, fold, overwrite_place=False)


def undo_batch(requests: DataFrame, replenish_log: DataFrame, inventory: DataFrame,
               undone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """W9 with a memory: each replenishment can be taken back once, ever.

    ``requests`` has ``seq`` and ``replenish_seq``; ``undone`` is the log of the
    replenishments taken back by earlier batches (``replenish_seq``). Returns
    (stock after, report(seq, replenish_seq, status), the ids to add to the log). status: 'undone', 'already undone' (in an earlier batch, or by
    an earlier request of this one), 'unknown replenishment' or 'nothing to
    undo' (no id). To be published together (``sinks.publish_tables``).
    """
    ids = requests.select("seq", F.col("replenish_seq").cast("bigint").alias("replenish_seq"))
    first = ids.where(F.col("replenish_seq").isNotNull()).groupBy("replenish_seq").agg(
        F.min("seq").alias("_first"))
    before = undone.select("replenish_seq").distinct().withColumn("_before", F.lit(True))
    known = replenish_log.select(F.col("seq").alias("replenish_seq"), F.lit(True).alias("_known")).distinct()
    judged = stored(first.join(before, "replenish_seq", "left")
                    .join(known, "replenish_seq", "left"), "undo-judged")
    good = judged.where(F.col("_known") & F.col("_before").isNull()).select("replenish_seq")
    report = left_join_present(ids, judged, "replenish_seq")
    status = (F.when(F.col("replenish_seq").isNull(), F.lit("nothing to undo"))
              .when(F.col("_known").isNull(), F.lit("unknown replenishment"))
              .when(F.col("_before") | (F.col("seq") > F.col("_first")), F.lit("already undone"))
              .otherwise(F.lit("undone")))
    report = report.select("seq", "replenish_seq", status.alias("status"))
    after = undo_replenish(good, replenish_log, inventory)
    return after, report, good


# ------------------------------------------------------------------ W10-W13

def delete_lines(ids: DataFrame, lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Remove lines; each removed line becomes a DELETE change.

    Returns (remaining lines, change feed keyed by the line id).
    """
    keys = ids.select("order_line_id").distinct()
    return (lines.join(keys, "order_line_id", "left_anti"),
            delete_feed(lines.join(keys, "order_line_id", "left_semi")))


def delete_feed(gone: DataFrame) -> DataFrame:
    """DELETE changes of removed order lines, keyed by the line id."""
    nl, ni = F.lit(None).cast("bigint"), F.lit(None).cast("int")
    return gone.select(F.col("order_line_id").alias("seq"), F.lit("DELETE").alias("op"),
                       "order_id", F.col("product_id").alias("old_product"),
                       F.col("fulfilled_from_location_id").alias("old_location"),
                       F.col("quantity").alias("old_qty"), nl.alias("new_product"),
                       nl.alias("new_location"), ni.alias("new_qty"))


def delete_orders(ids: DataFrame, orders: DataFrame, lines: DataFrame, by_line: bool = False
                  ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Deleting orders deletes their lines (cascade), which return stock.

    Returns (remaining orders, remaining lines, DELETE feed of the lines).
    ``by_line`` is for a batch that also deletes lines by their key: the lines
    that go are found from two columns and written, then deleted by key, so
    that whole lines are dealt by one key for both deletions.
    """
    keys = ids.select("order_id").distinct()
    if by_line:
        gone = stored(lines.select("order_line_id", "order_id").join(keys, "order_id", "left_semi")
                      .select("order_line_id"), "gone-lines")
        return (orders.join(keys, "order_id", "left_anti"), *delete_lines(gone, lines))
    return (orders.join(keys, "order_id", "left_anti"),
            lines.join(keys, "order_id", "left_anti"),
            delete_feed(lines.join(keys, "order_id", "left_semi")))


def delete_customers(ids: DataFrame, customers: DataFrame, orders: DataFrame
                     ) -> tuple[DataFrame, DataFrame]:
    """Remove customers; their orders keep existing with customer_id NULL."""
    keys = ids.select("customer_id").distinct()
    remaining = customers.join(keys, "customer_id", "left_anti")
    hit = keys.withColumn("_gone", F.lit(True))
    after = left_join_present(orders, hit, "customer_id").select(
        *[F.when(F.col("_gone"), F.lit(None).cast("bigint")).otherwise(F.col(c)).alias(c)
          if c == "customer_id" else F.col(c) for c in orders.columns])
    return remaining, after


def deletable(ids: DataFrame, key: str,
              references: Sequence[tuple[str, DataFrame, str]]) -> DataFrame:
    """Deletions refused while a row elsewhere still refers to the key.

    ``references`` = [(table name, table, referring column)]; a table may be
    named for several columns. Returns (key, referenced_by, deletable):
    ``referenced_by`` lists the referring tables in the given order.
    """
    return deletable_rows({key: (ids.select(F.col(key)), references)}).select(
        F.col("key_value").alias(key), "referenced_by", "deletable")


def deletable_rows(parents: Mapping[str, tuple[DataFrame, Sequence[tuple[str, DataFrame, str]]]]
                   ) -> DataFrame:
    """W13 for the keys of several parent tables in one aggregation and one join.

    ``parents`` = {parent name: (one-column frame of keys, references as for
    ``deletable``)}. Every referring table is read once: its referring columns
    are unpivoted into (parent, key) pairs, which are reduced to one row per
    key. Returns (table_name, key_value, referenced_by, deletable).
    """
    columns: dict[str, tuple[DataFrame, list[tuple[str, str]]]] = {}
    ordered: dict[str, list[str]] = {}
    for parent, (_, refs) in parents.items():
        ordered[parent] = list(dict.fromkeys(n for n, _, _ in refs))
        for name, table, col in refs:
            columns.setdefault(name, (table, []))[1].append((parent, col))
    names = list(columns)
    pairs = None
    for name, (table, cols) in columns.items():
        found = F.explode(F.array(*[F.struct(F.lit(parent).alias("table_name"),
                                             F.col(col).cast("bigint").alias("key_value"))
                                    for parent, col in cols]))
        part = table.select(found.alias("r")).select("r.*", F.lit(name).alias("_t")).where(
            F.col("key_value").isNotNull())
        pairs = part if pairs is None else pairs.unionByName(part)
    at = ["table_name", "key_value"]
    hits = pairs.groupBy(*at).agg(*[F.max(F.when(F.col("_t") == n, F.lit(n))).alias(f"_r{i}")
                                    for i, n in enumerate(names)])
    keys = None
    for parent, (ids, _) in parents.items():
        part = ids.select(F.lit(parent).alias("table_name"),
                          F.col(ids.columns[0]).cast("bigint").alias("key_value")).distinct()
        keys = part if keys is None else keys.unionByName(part)
    text = None
    for parent, listed in ordered.items():
        by = F.concat_ws(",", *[F.col(f"_r{names.index(n)}") for n in listed])
        is_it = F.col("table_name") == parent
        text = F.when(is_it, by) if text is None else text.when(is_it, by)
    out = keys.join(hits, at, "left").select(*at, text.alias("referenced_by"))
    return out.withColumn("deletable", F.col("referenced_by") == "")


def restricting_references(tables: Mapping[str, DataFrame], parent: str
                           ) -> list[tuple[str, DataFrame, str]]:
    """The references of the model that forbid deleting rows of ``parent``."""
    return [(child, tables[child], col) for child, col, p, _, action in S.FOREIGN_KEYS
            if p == parent and action == "restrict"]
