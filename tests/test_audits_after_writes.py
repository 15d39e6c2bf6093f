"""Property: the integrity audits find nothing in tables produced by the writers."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from stockbook.operators import audits as C
from stockbook.operators import ledger as L
from stockbook.operators import writes as W
from stockbook.sources import bindings as B
from stockbook.sources import schemas as S
from stockbook.sources import sinks
from tests import seed


def test_audits_are_empty_after_write_jobs(spark):
    orders, lines, customers = seed.orders_df(spark), seed.lines_df(spark), seed.customers_df(spark)
    products, locations, category = (seed.products_for_lines(spark), seed.locations_df(spark),
                                     B.category(spark))
    inventory = seed.inventory_df(spark, [(1, 44, 1, None, None, 5, None, None),
                                          (2, 76, 1, None, None, 3, None, None)])

    new_orders, _ = W.create_orders(
        spark.createDataFrame([(1, "2"), (2, "x"), (3, "5")], "seq bigint, customer_id string"),
        orders, customers, dt.date(2025, 12, 6))
    orders2 = sinks.append(new_orders, orders)
    raw = spark.createDataFrame(
        [(1, "23", "44", "2", "$9.50", "1"), (2, "24", "76", "1", "18", "2"),
         (3, "23", "999", "1", "1", "1"), (4, "13", "59", "3", "none", "1")],
        "seq bigint, order_id string, product_id string, quantity string, price string,"
        " location_id string")
    new_lines, feed, _ = W.add_order_lines(raw, lines, products, orders2, locations)
    lines2 = sinks.append(new_lines.drop("line_total"), lines)
    deltas = L.change_delta(feed)
    inventory2 = L.apply_deltas(inventory, deltas)
    ledger = L.movement_ledger(deltas, "2025-12-06 10:00:00")
    req = spark.createDataFrame(
        [(1, 44, 1, 4, "B", None, None), (2, 59, 3, 2, None, None, "C"), (3, 59, 3, 1, "Z", None, None)],
        "seq bigint, product_id bigint, location_id bigint, quantity int, h_bin_num string,"
        " h_rack_num string, halstan_code string")
    inventory3 = W.replenish(req, inventory2)

    tables = {"orders": orders2, "order_line": lines2, "customer": customers,
              "music_product": products, "location": locations, "category": category,
              "inventory": inventory3, "inventory_movement": ledger,
              "product_category_junction": spark.createDataFrame([], S.PRODUCT_CATEGORY)}
    for name, df in tables.items():
        assert C.audit_unique(df, S.PRIMARY_KEYS[name], name).count() == 0, name
        nulls = C.audit_not_null(df, S.NOT_NULL[name], name).where(F.col("null_count") > 0)
        assert nulls.count() == 0, name
    for name, cols in S.UNIQUE_KEYS:
        assert C.audit_unique(tables[name], cols, name, nulls_distinct=True).count() == 0, name
    assert C.audit_foreign_keys(tables, [fk[:4] for fk in S.FOREIGN_KEYS]).count() == 0
    assert inventory3.count() == 4 and ledger.count() == 2 and new_orders.count() == 2
