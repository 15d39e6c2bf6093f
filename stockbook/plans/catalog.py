"""Registered queries: one per operator key of SURVEY section 2.

Each entry takes (spark, sf_dir), binds the driver's test tables to the model
(``sources.bindings``) and runs the library operator over the whole tables.
Outputs contain only scalar columns (nested results are shown as text) so
they can be compared value by value with the DuckDB oracle in
``plans.oracle``. Fixed parameters of the checks are below.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockbook.functions import expressions as X
from stockbook.operators import audits as C
from stockbook.operators import changes as G
from stockbook.operators import documents as D
from stockbook.operators import gate as GT
from stockbook.operators import ledger as L
from stockbook.operators import reads as R
from stockbook.operators import validate as V
from stockbook.operators import writes as W
from stockbook.operators.keys import allocate_keys
from stockbook.session import scratch_path, stored
from stockbook.sources import bindings as B
from stockbook.sources import schemas as S
from stockbook.sources import sinks
from stockbook.streaming import streams as X_

MOVEMENT_DATE = "2024-01-01 00:00:00"
TODAY = "2024-01-02"
SEARCH = {"category_name": "Opera", "composer": "", "media": "print",
          "product_type": "(Any type)"}
SEARCH_COMPOSER = {"category_name": "(Any category)", "composer": "Brand#3", "media": "",
                   "product_type": None}
FILTERS = {"composer": "Brand#1", "media": "(Any media)", "product_type": "SMALL"}
SEMI_CATEGORY = "Strings"
BIG_LINE_QTY = 48

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query | None = None, *, name: str | None = None):
    """Register a query under its function name (or ``name``)."""
    def register(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        return f
    return register(fn) if fn is not None else register


class Tables:
    """Lazily bound model tables of one sf directory."""

    def __init__(self, spark: SparkSession, d: str):
        self.spark, self.d = spark, d

    def __getattr__(self, name: str) -> DataFrame:
        fn = getattr(B, name)
        df = fn(self.spark, self.d)
        setattr(self, name, df)
        return df


def _t(spark: SparkSession, d: str) -> Tables:
    return Tables(spark, d)


def deltas(t: Tables) -> DataFrame:
    return L.change_delta(t.change_feed)


def _arr_text(col: str, sep: str) -> F.Column:
    return F.array_join(F.col(col), sep)


# ------------------------------------------------------------- sources

@query
def scan_tables(spark: SparkSession, d: str) -> DataFrame:
    """Row count of each of the ten model tables."""
    t = _t(spark, d)
    tables = {
        "category": t.category, "customer": t.customer, "orders": t.orders,
        "order_line": t.order_line, "music_product": t.music_product,
        "product_category_junction": t.product_category_junction, "location": t.location,
        "inventory": t.inventory,
        "inventory_movement": L.ledger_rows(deltas(t), MOVEMENT_DATE),
        "inventory_halstan_staging": t.staging,
    }
    parts = [df.agg(F.count(F.lit(1)).alias("row_count")).select(
        F.lit(name).alias("table_name"), F.col("row_count").cast("bigint"))
        for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query
def append_rows(spark: SparkSession, d: str) -> DataFrame:
    """Customer table with the accepted new customers appended."""
    t = _t(spark, d)
    new, _ = W.add_customers(t.customer_requests, t.customer)
    return sinks.append(new, t.customer)


# ------------------------------------------------------------- F

@query
def lookup_by_key(spark: SparkSession, d: str) -> DataFrame:
    """product lookups by (raw) id: found flag, reason, display fields."""
    t = _t(spark, d)
    return R.lookup(t.lookup_requests, t.music_product, "product_id",
                    ["title", "price", "composer"])


@query
def lookup_customer(spark: SparkSession, d: str) -> DataFrame:
    """customer lookups by (raw) id with all contact fields."""
    t = _t(spark, d)
    return R.lookup(t.order_requests, t.customer, "customer_id", list(V.CUSTOMER_FIELDS),
                    raw_key="customer_id")


@query
def lookup_product_form(spark: SparkSession, d: str) -> DataFrame:
    """F1 + J4: product lookups by (raw) id with every field and the category names."""
    t = _t(spark, d)
    named = R.product_categories(t.music_product, t.product_category_junction, t.category).select(
        "product_id", _arr_text("categories", "|").alias("categories"))
    full = t.music_product.join(named, "product_id", "left")
    return R.lookup(t.lookup_requests, full, "product_id", [*W.PRODUCT_FIELDS, "categories"])


@query
def null_to_blank(spark: SparkSession, d: str) -> DataFrame:
    """customer rows in display form (NULL shown as '')."""
    t = _t(spark, d)
    return R.blank_nulls(t.customer, list(V.CUSTOMER_FIELDS))


@query
def optional_filters(spark: SparkSession, d: str) -> DataFrame:
    """products matching only the filters that are set."""
    t = _t(spark, d)
    return R.apply_filters(t.music_product, FILTERS).select(
        "product_id", "title", "composer", "media", "product_type")


@query
def not_null_filter(spark: SparkSession, d: str) -> DataFrame:
    """products with a media value."""
    t = _t(spark, d)
    return R.where_present(t.music_product, "media").select("product_id", "media")


@query
def line_total(spark: SparkSession, d: str) -> DataFrame:
    """generated line totals of all order lines."""
    t = _t(spark, d)
    return X.with_line_total(t.order_line).select(
        "order_line_id", "product_price", "quantity", "line_total")


# ------------------------------------------------------------- J

@query
def order_lines_detail(spark: SparkSession, d: str) -> DataFrame:
    t = _t(spark, d)
    return R.order_lines_detail(t.order_line, t.music_product)


@query
def order_lines_of_orders(spark: SparkSession, d: str) -> DataFrame:
    """J1 for given orders only."""
    t = _t(spark, d)
    return R.order_lines_detail(t.order_line, t.music_product, t.order_line_lookups)


@query
def order_header(spark: SparkSession, d: str) -> DataFrame:
    t = _t(spark, d)
    return R.order_header(t.orders, t.customer)


@query
def inventory_with_location(spark: SparkSession, d: str) -> DataFrame:
    t = _t(spark, d)
    return R.inventory_with_location(t.inventory, t.music_product, t.location)


@query
def product_categories(spark: SparkSession, d: str) -> DataFrame:
    """Category names per product, shown as 'a|b' text."""
    t = _t(spark, d)
    pc = R.product_categories(t.music_product, t.product_category_junction, t.category)
    return pc.select("product_id", _arr_text("categories", "|").alias("categories"))


@query
def category_semi_filter(spark: SparkSession, d: str) -> DataFrame:
    t = _t(spark, d)
    return R.in_category(t.music_product, t.product_category_junction, t.category,
                         SEMI_CATEGORY).select("product_id", "title")


# ------------------------------------------------------------- A

@query
def orders_with_total(spark: SparkSession, d: str) -> DataFrame:
    t = _t(spark, d)
    return R.orders_with_total(t.orders, t.order_line)


@query
def customer_order_summary(spark: SparkSession, d: str) -> DataFrame:
    t = _t(spark, d)
    return R.customer_order_summary(t.customer, t.orders, t.order_line)


@query
def product_search(spark: SparkSession, d: str) -> DataFrame:
    t = _t(spark, d)
    return R.product_search(t.music_product, t.inventory, t.product_category_junction,
                            t.category, **SEARCH)


@query
def product_search_composer(spark: SparkSession, d: str) -> DataFrame:
    """A3 with a composer and no category."""
    t = _t(spark, d)
    return R.product_search(t.music_product, t.inventory, t.product_category_junction,
                            t.category, **SEARCH_COMPOSER)


@query
def product_search_all(spark: SparkSession, d: str) -> DataFrame:
    """A3 with nothing set: the whole catalogue with its stock."""
    t = _t(spark, d)
    return R.product_search(t.music_product, t.inventory, t.product_category_junction, t.category)


@query
def facet_values(spark: SparkSession, d: str) -> DataFrame:
    t = _t(spark, d)
    return R.facets(t.music_product, t.category)


@query
def next_key(spark: SparkSession, d: str) -> DataFrame:
    """A5: next free key of each keyed table."""
    t = _t(spark, d)
    parts = [R.next_key(df, col).select(F.lit(name).alias("table_name"), "next_key")
             for name, df, col in [("orders", t.orders, "order_id"),
                                   ("order_line", t.order_line, "order_line_id"),
                                   ("customer", t.customer, "customer_id"),
                                   ("music_product", t.music_product, "product_id"),
                                   ("inventory", t.inventory, "inventory_id")]]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query
def invoice_total(spark: SparkSession, d: str) -> DataFrame:
    t = _t(spark, d)
    return R.invoice_total(t.orders, t.order_line)


@query
def affected_keys(spark: SparkSession, d: str) -> DataFrame:
    """Which product ids of the edit batch hit an existing product."""
    t = _t(spark, d)
    keyed = V.validate_keys(t.product_requests.withColumnRenamed("product_id", "raw"),
                            "raw", "product_id")
    return R.update_report(keyed.where(F.col("reason").isNull()), t.music_product,
                           "product_id")


# ------------------------------------------------------------- M / O

@query
def primary_category(spark: SparkSession, d: str) -> DataFrame:
    t = _t(spark, d)
    return R.primary_category(t.music_product, t.product_category_junction, t.category)


@query
def category_rank(spark: SparkSession, d: str) -> DataFrame:
    t = _t(spark, d)
    return R.with_category_rank(t.product_category_junction)


@query
def sort_rows(spark: SparkSession, d: str) -> DataFrame:
    t = _t(spark, d)
    return R.sort_rows(t.music_product.select("product_id", "title"), "title", "product_id")


# ------------------------------------------------------------- W

@query(name="allocate_keys")
def allocate_line_keys(spark: SparkSession, d: str) -> DataFrame:
    """Line ids for every add-line request, above the current maximum."""
    t = _t(spark, d)
    keyed = allocate_keys(t.raw_order_line_requests.select("seq"), "order_line_id", ["seq"],
                          existing=t.order_line)
    return keyed.select("seq", "order_line_id")


@query
def create_orders(spark: SparkSession, d: str) -> DataFrame:
    t = _t(spark, d)
    _, report = W.create_orders(t.order_requests, t.orders, t.customer, TODAY)
    return report


@query
def create_orders_rows(spark: SparkSession, d: str) -> DataFrame:
    """The new order rows."""
    t = _t(spark, d)
    return W.create_orders(t.order_requests, t.orders, t.customer, TODAY)[0]


@query
def add_order_lines(spark: SparkSession, d: str) -> DataFrame:
    t = _t(spark, d)
    return _added_lines(t)[2]


def _added_lines(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    return W.add_order_lines(t.raw_order_line_requests, t.order_line, t.music_product,
                             t.orders, t.location)


@query
def add_order_lines_rows(spark: SparkSession, d: str) -> DataFrame:
    """The new order lines."""
    return _added_lines(_t(spark, d))[0]


@query
def add_order_lines_feed(spark: SparkSession, d: str) -> DataFrame:
    """The INSERT changes of the new lines."""
    return _added_lines(_t(spark, d))[1]


@query
def add_customers(spark: SparkSession, d: str) -> DataFrame:
    t = _t(spark, d)
    _, report = W.add_customers(t.customer_requests, t.customer)
    return report


@query
def add_products(spark: SparkSession, d: str) -> DataFrame:
    t = _t(spark, d)
    return W.add_products(t.product_requests, t.music_product, t.category)[2]


@query
def add_products_rows(spark: SparkSession, d: str) -> DataFrame:
    """The new products."""
    t = _t(spark, d)
    return W.add_products(t.product_requests, t.music_product, t.category)[0]


@query
def add_products_links(spark: SparkSession, d: str) -> DataFrame:
    """The category links of the new products."""
    t = _t(spark, d)
    return W.add_products(t.product_requests, t.music_product, t.category)[1]


@query
def update_products(spark: SparkSession, d: str) -> DataFrame:
    t = _t(spark, d)
    after, _ = W.update_products(t.product_requests, t.music_product, t.category)
    return after


@query
def update_products_report(spark: SparkSession, d: str) -> DataFrame:
    """What became of each edit request."""
    t = _t(spark, d)
    return W.update_products(t.product_requests, t.music_product, t.category)[1]


@query
def replace_categories(spark: SparkSession, d: str) -> DataFrame:
    t = _t(spark, d)
    return W.replace_categories(t.product_requests, t.music_product,
                                t.product_category_junction, t.category)[0]


@query
def replace_categories_report(spark: SparkSession, d: str) -> DataFrame:
    """What became of each edit request."""
    t = _t(spark, d)
    return W.replace_categories(t.product_requests, t.music_product,
                                t.product_category_junction, t.category)[1]


def _replenished(t: Tables) -> tuple[DataFrame, DataFrame]:
    checked = V.validate_replenish(t.replenish_requests, t.music_product, t.location)
    ok, _ = V.split_valid(checked)
    ok = stored(ok, "replenish-valid")  # read by the fold and by an undo
    return ok, W.replenish(ok, t.inventory)


@query
def replenish_stock(spark: SparkSession, d: str) -> DataFrame:
    t = _t(spark, d)
    return _replenished(t)[1]


@query
def undo_replenish(spark: SparkSession, d: str) -> DataFrame:
    """W9 after W8: the 'error' events take back the replenishment before them."""
    t = _t(spark, d)
    ok, after = _replenished(t)
    return W.undo_replenish(t.undo_requests, ok, after)


@query
def undo_report(spark: SparkSession, d: str) -> DataFrame:
    """W9 with a memory: the 'error' events ask twice; what became of each request.

    A first batch takes back what every second request names; the second batch
    has all requests, so those ids are undone already.
    """
    t = _t(spark, d)
    ok, after = _replenished(t)
    asked = t.undo_requests.select((F.col("replenish_seq") + 1).alias("seq"), "replenish_seq")
    none = spark.createDataFrame([], "replenish_seq bigint")
    after, _, undone = W.undo_batch(asked.where(F.col("seq") % 2 == 0), ok, after, none)
    return W.undo_batch(asked, ok, after, undone)[1]


@query
def delete_lines(spark: SparkSession, d: str) -> DataFrame:
    """Delete the largest lines; their DELETE changes."""
    t = _t(spark, d)
    ids = t.order_line.where(F.col("quantity") >= BIG_LINE_QTY).select("order_line_id")
    _, feed = W.delete_lines(ids, t.order_line)
    return feed


@query
def delete_lines_remaining(spark: SparkSession, d: str) -> DataFrame:
    """The lines that stay."""
    t = _t(spark, d)
    ids = t.order_line.where(F.col("quantity") >= BIG_LINE_QTY).select("order_line_id")
    return W.delete_lines(ids, t.order_line)[0]


@query
def cascade_delete_orders(spark: SparkSession, d: str) -> DataFrame:
    """Delete orders without a customer; the DELETE changes of their lines."""
    t = _t(spark, d)
    return _deleted_orders(t)[2]


def _deleted_orders(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    ids = t.orders.where(F.col("customer_id").isNull()).select("order_id")
    return W.delete_orders(ids, t.orders, t.order_line)


@query
def cascade_delete_remaining_orders(spark: SparkSession, d: str) -> DataFrame:
    """The orders that stay."""
    return _deleted_orders(_t(spark, d))[0].select("order_id", "order_date", "customer_id")


@query
def cascade_delete_remaining_lines(spark: SparkSession, d: str) -> DataFrame:
    """The lines that stay."""
    return _deleted_orders(_t(spark, d))[1]


@query
def null_customer_on_delete(spark: SparkSession, d: str) -> DataFrame:
    """Delete customers without a first name; orders after."""
    t = _t(spark, d)
    ids = t.customer.where(F.col("first_name").isNull()).select("customer_id")
    _, after = W.delete_customers(ids, t.customer, t.orders)
    return after.select("order_id", "customer_id")


@query
def delete_customers_remaining(spark: SparkSession, d: str) -> DataFrame:
    """The customers that stay."""
    t = _t(spark, d)
    ids = t.customer.where(F.col("first_name").isNull()).select("customer_id")
    return W.delete_customers(ids, t.customer, t.orders)[0]


@query
def restrict_delete(spark: SparkSession, d: str) -> DataFrame:
    """Which products, categories and locations could be deleted, and what
    refers to the others."""
    t = _t(spark, d)
    m = _model(t)
    m["inventory_movement"] = L.ledger_rows(deltas(t), MOVEMENT_DATE)  # its ids do not matter
    parents = {}
    for parent in ("music_product", "category", "location"):
        key = S.PRIMARY_KEYS[parent][0]
        parents[parent] = (m[parent].select(key), W.restricting_references(m, parent))
    return W.deletable_rows(parents)


# ------------------------------------------------------------- one change batch

def _changed(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """W3, W10 and W11 with T1 to T3 as one published change, applied twice."""
    t = _t(spark, d)
    root = scratch_path(spark, "change-state")
    numbered = stored(B.numbered_lines(spark, d), "numbered-lines")  # lines, deletions and requests read it
    lines = B.order_line(spark, d, numbered).select(*S.ORDER_LINE.names)
    ledger = spark.createDataFrame([], S.MOVEMENT)
    G.open_state(spark, root, t.orders, lines, t.inventory, ledger)
    # moves no row: it keeps the making and the judging of the texts in two generated
    # methods, because one of both is too large for the JIT compiler (26 s against 11 at 6 x sf0.1)
    requests = B.raw_order_line_requests(spark, d, numbered).coalesce(1 << 20)
    batch = G.ChangeBatch(
        "batch-1", new_lines=requests,
        deleted_lines=lines.where(F.col("quantity") >= BIG_LINE_QTY).select("order_line_id"),
        deleted_orders=t.orders.where(F.col("customer_id").isNull()).select("order_id"))
    for _ in range(2):  # the second time is a replay, which changes nothing
        G.apply_batch(spark, root, batch, t.music_product, t.location, MOVEMENT_DATE)
    return sinks.current_tables(spark, root, ["order_line", "inventory", "inventory_movement"])


@query
def change_batch_ledger(spark: SparkSession, d: str) -> DataFrame:
    """The ledger after deleted orders, deleted lines and new lines in one batch."""
    return _changed(spark, d)["inventory_movement"]


@query
def change_batch_stock(spark: SparkSession, d: str) -> DataFrame:
    """Stock after the same batch."""
    return _changed(spark, d)["inventory"]


@query
def change_batch_lines(spark: SparkSession, d: str) -> DataFrame:
    """Order lines after the same batch."""
    return _changed(spark, d)["order_line"]


# ------------------------------------------------------------- write gate

def _stock_batch(t: Tables) -> DataFrame:
    """Every replenishment as a stock row to be inserted as it is, unchecked."""
    number = "CASE WHEN trim({0}) RLIKE '^[0-9]+$' THEN try_cast(trim({0}) AS {1}) END"
    return t.replenish_requests.selectExpr(
        "seq + 100000000 AS inventory_id", f"{number.format('product_id', 'BIGINT')} AS product_id",
        f"{number.format('location_id', 'BIGINT')} AS location_id", "bin AS h_bin_num", "rack AS h_rack_num",
        f"{number.format('quantity', 'INT')} AS quantity", "CAST(NULL AS INT) AS parcel_qty",
        "concat(code, bin) AS halstan_code")


@query
def gate_stock_rows(spark: SparkSession, d: str) -> DataFrame:
    """Write gate: which rule of the stock table each row of a batch breaks."""
    t = _t(spark, d)
    tables = {"inventory": t.inventory, "music_product": t.music_product, "location": t.location}
    return GT.judged(_stock_batch(t), "inventory", tables, "inventory_id").select(
        "inventory_id", "product_id", "location_id", "quantity", "halstan_code", "refusal")


# ------------------------------------------------------------- V

@query
def validate_order_lines(spark: SparkSession, d: str) -> DataFrame:
    t = _t(spark, d)
    return V.validate_order_lines(t.raw_order_line_requests)


@query
def validate_customers(spark: SparkSession, d: str) -> DataFrame:
    t = _t(spark, d)
    return V.validate_customers(t.customer_requests)


@query
def validate_products(spark: SparkSession, d: str) -> DataFrame:
    t = _t(spark, d)
    v = V.validate_products(t.product_requests.drop("product_id"))
    return v.withColumn("categories", _arr_text("categories", ";"))


@query
def validate_replenish(spark: SparkSession, d: str) -> DataFrame:
    t = _t(spark, d)
    return V.validate_replenish(t.replenish_requests, t.music_product, t.location)


@query
def validate_keys(spark: SparkSession, d: str) -> DataFrame:
    t = _t(spark, d)
    return V.validate_keys(t.order_requests, "customer_id", "customer_id_value",
                           label="customer_id").select(
        "seq", "customer_id", "customer_id_value", "reason")


@query
def clean_price(spark: SparkSession, d: str) -> DataFrame:
    t = _t(spark, d)
    return V.clean_prices(t.music_product.select("product_id", "price"))


@query
def clean_text(spark: SparkSession, d: str) -> DataFrame:
    t = _t(spark, d)
    return V.clean_text(t.replenish_requests.select("seq", "bin", "rack", "code"),
                        ["bin", "rack", "code"])


# ------------------------------------------------------------- T

@query
def change_delta(spark: SparkSession, d: str) -> DataFrame:
    return deltas(_t(spark, d))


@query
def movement_ledger(spark: SparkSession, d: str) -> DataFrame:
    return L.movement_ledger(deltas(_t(spark, d)), MOVEMENT_DATE)


@query
def apply_stock_deltas(spark: SparkSession, d: str) -> DataFrame:
    t = _t(spark, d)
    return L.apply_deltas(t.inventory, deltas(t))


@query
def movement_type(spark: SparkSession, d: str) -> DataFrame:
    return deltas(_t(spark, d)).select(
        "seq", "op", "delta", X.movement_type("op", "delta").alias("movement_type"))


@query
def stock_reconcile(spark: SparkSession, d: str) -> DataFrame:
    """T5: opening stock, the ledger of the change feed, and stock after the
    feed and the (unlogged) replenishments: the keys that do not add up."""
    t = _t(spark, d)
    dl = deltas(t)
    after_feed = L.apply_deltas(t.inventory, dl, assign_ids=False)
    checked = V.validate_replenish(t.replenish_requests, t.music_product, t.location)
    ok, _ = V.split_valid(checked)
    actual = W.replenish(ok, after_feed, assign_ids=False)
    return L.reconcile(t.inventory, L.ledger_rows(dl, MOVEMENT_DATE), actual)


@query
def resolve_staging(spark: SparkSession, d: str) -> DataFrame:
    t = _t(spark, d)
    return L.resolve_staging(t.staging, t.music_product).select(
        "staging_id", "title_raw", "halstan_code", "product_id", "match", "status")


@query
def stage_to_inventory(spark: SparkSession, d: str) -> DataFrame:
    t = _t(spark, d)
    return L.staging_to_inventory(L.resolve_staging(t.staging, t.music_product))


@query
def normalise_duration(spark: SparkSession, d: str) -> DataFrame:
    return L.normalise_duration(_t(spark, d).music_product)


# ------------------------------------------------------------- D

@query
def invoice_documents(spark: SparkSession, d: str) -> DataFrame:
    t = _t(spark, d)
    return D.invoices(t.orders, t.customer, t.order_line, t.music_product)


@query
def invoice_items(spark: SparkSession, d: str) -> DataFrame:
    """The item rows of all invoices."""
    t = _t(spark, d)
    return D.invoice_items(t.order_line, t.music_product)


@query
def invoice_text(spark: SparkSession, d: str) -> DataFrame:
    t = _t(spark, d)
    return D.invoice_text(t.orders, t.customer, t.order_line, t.music_product)


# ------------------------------------------------------------- C

def _model(t: Tables) -> dict[str, DataFrame]:
    """The stored tables; the ledger is added by the queries that need it."""
    return {
        "category": t.category, "customer": t.customer, "orders": t.orders,
        "order_line": t.order_line, "music_product": t.music_product,
        "product_category_junction": t.product_category_junction, "location": t.location,
        "inventory": t.inventory, "inventory_halstan_staging": t.staging,
    }


def _all_tables(t: Tables) -> dict[str, DataFrame]:
    """All ten tables, the ledger with its allocated ids."""
    return _model(t) | {"inventory_movement": L.movement_ledger(deltas(t), MOVEMENT_DATE)}


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query
def audit_primary_keys(spark: SparkSession, d: str) -> DataFrame:
    m = _all_tables(_t(spark, d))
    return _union([C.audit_unique(m[n], cols, n) for n, cols in S.PRIMARY_KEYS.items()])


@query
def audit_uniques(spark: SparkSession, d: str) -> DataFrame:
    t = _t(spark, d)
    m = _model(t)
    return _union([C.audit_unique(m[n], cols, n, nulls_distinct=True)
                   for n, cols in S.UNIQUE_KEYS])


@query
def audit_foreign_keys(spark: SparkSession, d: str) -> DataFrame:
    """C3 over the model tables plus the ledger of the change feed."""
    t = _t(spark, d)
    m = _model(t)
    m["inventory_movement"] = L.ledger_rows(deltas(t), MOVEMENT_DATE)
    return C.audit_foreign_keys(m, [fk[:4] for fk in S.FOREIGN_KEYS])


@query
def audit_not_null(spark: SparkSession, d: str) -> DataFrame:
    m = _all_tables(_t(spark, d))
    return _union([C.audit_not_null(m[n], cols, n) for n, cols in S.NOT_NULL.items() if cols])


@query
def audit_lengths(spark: SparkSession, d: str) -> DataFrame:
    m = _all_tables(_t(spark, d))
    return _union([C.audit_lengths(m[n], lim, n) for n, lim in S.VARCHAR_LIMITS.items()])


def _deleted_products(t: Tables) -> DataFrame:
    return t.music_product.where(F.col("product_id") % 10 == 0)


@query
def audit_foreign_keys_after_delete(spark: SparkSession, d: str) -> DataFrame:
    """C3 for a change only: every tenth product is gone, the lines stay."""
    t = _t(spark, d)
    m = _model(t)
    m["inventory_movement"] = L.ledger_rows(deltas(t), MOVEMENT_DATE)
    gone = _deleted_products(t)
    m["music_product"] = t.music_product.join(gone.select("product_id"), "product_id", "left_anti")
    return C.audit_foreign_keys_changed(m, [fk[:4] for fk in S.FOREIGN_KEYS],
                                        written={"order_line": t.order_line}, deleted={"music_product": gone})


@query
def audit_uniques_after_insert(spark: SparkSession, d: str) -> DataFrame:
    """C2 for a change only: stock rows inserted without the gate."""
    t = _t(spark, d)
    batch = _stock_batch(t)
    return C.audit_unique_changed(t.inventory.unionByName(batch), ["product_id", "location_id"],
                                  "inventory", batch, nulls_distinct=True)


# ------------------------------------------------------------- X

def _stream_feed(spark: SparkSession, d: str) -> DataFrame:
    return X_.read_change_stream(spark, d, "events.parquet", B.stream_feed_source)


@query
def stream_movement_ledger(spark: SparkSession, d: str) -> DataFrame:
    """Ledger of the event change stream (run to completion, then read)."""
    path = X_.run_ledger_stream(_stream_feed(spark, d), MOVEMENT_DATE)
    return X_.read_ledger_stream(spark, path)


@query
def stream_stock_delta(spark: SparkSession, d: str) -> DataFrame:
    """Running net delta per (product, location) of the event change stream."""
    data = X_.run_stock_stream(_stream_feed(spark, d))
    return X_.read_stock_stream(spark, data)
