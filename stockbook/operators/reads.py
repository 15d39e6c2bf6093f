"""Read-side operators: lookups, filters, joins, aggregates, pick-one, sort.

Join strategy is left to Catalyst and AQE: small sides (category, location,
per-partition offsets) are broadcast by Spark's own size check, large sides
shuffle on the join key. Aggregations are written as "aggregate by key, then
join" so only narrow keys are shuffled and partial (map-side) aggregation
absorbs hot keys.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockbook.functions import expressions as X
from stockbook.operators.joins import left_join_present
from stockbook.sources.schemas import TOTAL


# ---------------------------------------------------------------- F: filters

def apply_filters(df: DataFrame, params: Mapping[str, str | None]) -> DataFrame:
    """AND of equality predicates whose parameter is set.

    A parameter is unset when it is None, blank, or one of the "(Any ...)"
    placeholders. With nothing set the DataFrame is returned unchanged.
    """
    cond = None
    for col, value in params.items():
        if value is None:
            continue
        v = value.strip()
        if not v or v in X.ANY_SENTINELS:
            continue
        term = F.col(col) == F.lit(v)
        cond = term if cond is None else cond & term
    return df if cond is None else df.where(cond)


def where_present(df: DataFrame, col: str) -> DataFrame:
    """rows where ``col`` is not NULL."""
    return df.where(F.col(col).isNotNull())


def blank_nulls(df: DataFrame, cols: Sequence[str] | None = None,
                none_label: Mapping[str, str] | None = None) -> DataFrame:
    """display form of looked-up rows.

    Text and numbers become text with NULL shown as '' (or the given label,
    e.g. '(None)' for a choice field); booleans show NULL as false.
    """
    labels = dict(none_label or {})
    kinds = dict(df.dtypes)
    targets = list(cols) if cols is not None else list(df.columns)
    out = []
    for c in df.columns:
        if c not in targets:
            out.append(F.col(c))
        elif kinds[c] == "boolean":
            out.append(F.coalesce(F.col(c), F.lit(False)).alias(c))
        else:
            out.append(F.coalesce(F.col(c).cast("string"), F.lit(labels.get(c, ""))).alias(c))
    return df.select(*out)


def lookup(keys: DataFrame, table: DataFrame, key: str, cols: Sequence[str],
           raw_key: str = "key") -> DataFrame:
    """fetch rows for requested keys and report the keys not found.

    ``keys`` holds ``seq`` and the raw (text) key in ``raw_key``; the key is
    validated first (V7), then left-joined to ``table``. Output: seq, the typed
    key, ``found``, ``reason`` (why a key could not be used) and ``cols``.
    """
    from stockbook.operators.validate import validate_keys

    checked = validate_keys(keys, raw_key, key)
    right = table.select(F.col(key), F.lit(True).alias("_hit"), *[F.col(c) for c in cols])
    joined = left_join_present(checked, right, key)
    return joined.select(
        "seq", key,
        F.coalesce(F.col("_hit"), F.lit(False)).alias("found"),
        F.when(F.col("reason").isNotNull(), F.col("reason"))
         .when(F.col("_hit").isNull(), F.lit("not found")).alias("reason"),
        *cols)


# ----------------------------------------------------------------- J: joins

def order_lines_detail(lines: DataFrame, products: DataFrame,
                       order_ids: DataFrame | None = None) -> DataFrame:
    """Lines with product titles, optionally only for some orders, by line id."""
    return line_titles(lines, products, order_ids).orderBy("order_line_id")


def line_titles(lines: DataFrame, products: DataFrame,
                order_ids: DataFrame | None = None) -> DataFrame:
    """J1 without the final order (what other operators build on)."""
    lines = X.with_line_total(lines)
    if order_ids is not None:
        lines = lines.join(order_ids.select("order_id").distinct(), "order_id", "left_semi")
    detail = lines.join(products.select("product_id", "title"), "product_id")
    return detail.select("order_line_id", "order_id", "title", "product_id", "quantity",
                         "product_price", "line_total")


def order_header(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Order with its bill-to customer; orders without customer are kept."""
    cust = customers.select("customer_id", "first_name", "last_name", "street_address",
                            "town", "zip", "country")
    return left_join_present(orders.select("order_id", "order_date", "customer_id"),
                             cust, "customer_id").select(
        "order_id", "order_date", "customer_id", "first_name", "last_name",
        "street_address", "town", "zip", "country")


def inventory_with_location(inv: DataFrame, products: DataFrame,
                            locations: DataFrame) -> DataFrame:
    """J3 (view): inventory joined to product title and location name."""
    return (inv.join(products.select("product_id", "title"), "product_id")
               .join(locations.select("location_id", "location_name"), "location_id")
               .select("inventory_id", "product_id", "title", "location_id", "location_name",
                       "quantity", "h_bin_num", "h_rack_num", "halstan_code"))


def product_categories(products: DataFrame, junction: DataFrame,
                       category: DataFrame) -> DataFrame:
    """Category names of each product (sorted array; products without one vanish).

    A product's list is bounded by the category table (the link table's key is
    (product, category)), so collecting it per product is safe.
    """
    named = junction.join(category.select("category_id", "category_name"), "category_id")
    named = named.join(products.select("product_id"), "product_id", "left_semi")
    return named.groupBy("product_id").agg(
        F.array_sort(F.collect_list("category_name")).alias("categories"))


def in_category(products: DataFrame, junction: DataFrame, category: DataFrame,
                name: str | None) -> DataFrame:
    """Only products linked to the named category (no join when unset)."""
    if name is None or not name.strip() or name.strip() in X.ANY_SENTINELS:
        return products
    cat_ids = category.where(F.col("category_name") == F.lit(name.strip())).select("category_id")
    members = junction.join(cat_ids, "category_id", "left_semi").select("product_id")
    return products.join(members, "product_id", "left_semi")


def customer_orders_lines(customers: DataFrame, orders: DataFrame,
                          lines: DataFrame) -> DataFrame:
    """J5 (helper): customer LEFT JOIN orders LEFT JOIN order lines, keeping
    customers without orders and orders without lines (one row per line).

    A2 does not need this row-level form (it aggregates lines per order
    first); it is the direct form the two-level result is checked against.
    """
    o = orders.select("order_id", "customer_id")
    return (customers.select("customer_id", "first_name", "last_name")
            .join(o, "customer_id", "left")
            .join(X.with_line_total(lines).select("order_id", "order_line_id", "line_total"),
                  "order_id", "left"))


# ------------------------------------------------------------ A: aggregates

def _order_sums(lines: DataFrame) -> DataFrame:
    """Per-order total of line_total, pre-aggregated before any join."""
    return X.with_line_total(lines).groupBy("order_id").agg(
        F.sum("line_total").alias("_sum"))


def orders_with_total(orders: DataFrame, lines: DataFrame) -> DataFrame:
    """A1 (view): every order with COALESCE(SUM(line_total), 0)."""
    joined = orders.join(_order_sums(lines), "order_id", "left")
    return joined.select(*orders.columns,
                         F.coalesce(F.col("_sum"), F.lit(0)).cast(TOTAL).alias("order_total"))


def invoice_total(orders: DataFrame, lines: DataFrame) -> DataFrame:
    """Total of an order's lines, 0 when it has none (decimal, never float)."""
    joined = orders.select("order_id").join(_order_sums(lines), "order_id", "left")
    return joined.select("order_id",
                         F.coalesce(F.col("_sum"), F.lit(0)).cast(TOTAL).alias("invoice_total"))


def customer_order_summary(customers: DataFrame, orders: DataFrame,
                           lines: DataFrame) -> DataFrame:
    """A2 (view): per customer, number of orders and total spent.

    Two-level: line totals per order, then per customer. order_id is the
    orders key (audited by C1), so counting order rows equals COUNT(DISTINCT).
    """
    per_order = orders.where(F.col("customer_id").isNotNull()).select(
        "order_id", "customer_id").join(_order_sums(lines), "order_id", "left")
    per_customer = per_order.groupBy("customer_id").agg(
        F.count("order_id").alias("_n"), F.sum("_sum").alias("_spent"))
    joined = customers.select("customer_id", "first_name", "last_name").join(
        per_customer, "customer_id", "left")
    return joined.select(
        "customer_id", "first_name", "last_name",
        F.coalesce(F.col("_n"), F.lit(0)).cast("bigint").alias("order_count"),
        F.coalesce(F.col("_spent"), F.lit(0)).cast(TOTAL).alias("total_spent"))


def product_search(products: DataFrame, inv: DataFrame, junction: DataFrame,
                   category: DataFrame, category_name: str | None = None,
                   composer: str | None = None, media: str | None = None,
                   product_type: str | None = None) -> DataFrame:
    """A3: catalogue search with optional filters, stock summed over locations."""
    found = apply_filters(products, {"composer": composer, "media": media,
                                     "product_type": product_type})
    found = in_category(found, junction, category, category_name)
    stock = inv.join(found.select("product_id"), "product_id", "left_semi").groupBy("product_id").agg(F.sum("quantity").alias("_qty"))
    out = found.select("product_id", "title", "composer", "media", "product_type",
                       "price").join(stock, "product_id", "left")
    return out.select("product_id", "title", "composer", "media", "product_type", "price",
                      F.coalesce(F.col("_qty"), F.lit(0)).cast("bigint").alias("qty")
                      ).orderBy("title", "product_id")


# The product columns offered as search / form choices.
FACET_COLUMNS: tuple[str, ...] = ("composer", "media", "product_type", "librettist_1",
                                  "librettist_2", "score_type")


def facets(products: DataFrame, category: DataFrame | None = None,
           cols: Sequence[str] = FACET_COLUMNS) -> DataFrame:
    """A4: sorted distinct non-NULL values of several columns in one scan.

    The columns are unpivoted into (facet, value) pairs, so a single partial
    aggregation deduplicates all of them; category names are added as facet
    'category_name'.
    """
    long = products.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot(
        [], list(cols), "facet", "value")
    out = long.where(F.col("value").isNotNull())
    if category is not None:
        out = out.unionByName(category.select(F.lit("category_name").alias("facet"),
                                              F.col("category_name").alias("value"))
                              .where(F.col("value").isNotNull()))
    return out.distinct().orderBy("facet", "value")


def next_key(df: DataFrame, col: str) -> DataFrame:
    """A5: COALESCE(MAX(col), 0) + 1 as a one-row DataFrame."""
    return df.agg((F.coalesce(F.max(col), F.lit(0)) + 1).cast("bigint").alias("next_key"))


def update_report(requests: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """Which keyed updates hit a row ('updated') and which hit nothing."""
    keys = requests.select(key).where(F.col(key).isNotNull()).distinct()
    hits = target.select(key).distinct().withColumn("_hit", F.lit(True))
    return keys.join(hits, key, "left").select(
        key, F.when(F.col("_hit"), F.lit("updated")).otherwise(F.lit("not found"))
        .alias("status"))


# ------------------------------------------------------- M: pick one per group

def with_category_rank(junction: DataFrame) -> DataFrame:
    """M2 applied to the link table."""
    return junction.withColumn("category_rank", X.category_rank("category_id"))


# The product columns of the view with the primary category.
PRIMARY_CATEGORY_COLUMNS: tuple[str, ...] = (
    "product_id", "title", "duration", "no_of_movements", "duration_seconds",
    "duration_formatted", "price", "ismn", "is_duplicate", "work_id", "not_difficult",
    "rentable", "halstan_code", "composer", "librettist_1", "librettist_2", "media",
    "sheet_music_plus_sku", "score_type", "publication_year")


def primary_category(products: DataFrame, junction: DataFrame,
                     category: DataFrame) -> DataFrame:
    """M1 (view): each product with its highest-priority category.

    One hash aggregation per product (``min_by`` over (rank, id)) instead of a
    sort-based DISTINCT ON; ties between equally ranked ids go to the lower id.
    Products without a (valid) category do not appear.
    """
    links = with_category_rank(junction.join(category.select("category_id"), "category_id"))
    best = links.groupBy("product_id").agg(
        F.min_by("category_id", F.struct("category_rank", "category_id"))
        .alias("primary_category_id"))
    return products.select(*PRIMARY_CATEGORY_COLUMNS).join(best, "product_id")


# ------------------------------------------------------------------ O: sort

def sort_rows(df: DataFrame, *cols: str) -> DataFrame:
    """O1: total sort (binary string order); add a key column to break ties."""
    return df.orderBy(*cols)

