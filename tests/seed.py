"""Seed fixtures: ``ORDERS`` and ``LINES`` are fixed values, the rest is invented."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from stockbook.sources import schemas as S

D = Decimal

# Fixed values (golden totals depend on them): (order_id, order_date, customer_id)
ORDERS = [
    (3, "2025-12-03", 1), (4, "2025-12-03", 2), (5, "2025-12-03", 1), (6, "2025-12-04", 3),
    (7, "2025-12-04", 3), (8, "2025-12-04", 3), (9, "2025-12-04", 3), (10, "2025-12-04", 1),
    (11, "2025-12-04", 1), (12, "2025-12-04", 1), (13, "2025-12-04", 2), (14, "2025-12-04", 2),
    (15, "2025-12-04", 2), (16, "2025-12-04", 2), (17, "2025-12-05", 5), (18, "2025-12-05", 5),
    (19, "2025-12-05", 5), (20, "2025-12-05", 5), (21, "2025-12-05", 3), (22, "2025-12-05", 3),
]

# Fixed values: (order_line_id, order_id, product_id, product_price, quantity, location)
LINES = [
    (6, 6, 59, D("19.95"), 1, 1), (7, 7, 54, D("21.37"), 1, 1), (8, 12, 44, D("9.50"), 1, 1),
    (9, 13, 76, D("18.00"), 1, 1), (10, 13, 44, D("18.00"), 1, 1), (11, 14, 44, D("9.50"), 1, 1),
    (12, 15, 76, D("9.50"), 1, 1), (13, 15, 44, D("9.50"), 1, 1), (14, 15, 54, D("9.50"), 2, 1),
    (15, 16, 65, D("13.00"), 1, 1), (16, 16, 91, D("50.00"), 1, 1), (17, 18, 31, D("3.00"), 1, 1),
    (18, 20, 52, D("8.00"), 1, 1), (19, 20, 52, D("8.00"), 1, 1), (20, 20, 48, D("13.00"), 1, 1),
    (21, 21, 78, D("13.00"), 1, 1), (22, 22, 69, D("11.00"), 1, 1), (23, 22, 69, D("11.00"), 1, 1),
]

# Invented people; the ids are what the orders above refer to.
CUSTOMERS = [
    (1, "Orla", None, "orla@example.org", None, "Lime Kiln Lane 40", "Norrvik", "N-1180", "Norland"),
    (2, None, "Pemberly", None, "+00 17 2244", None, "Old Harbour", None, "Norland"),
    (3, "Tavi", "Okonjo-Reyes", "t.o@example.org", "+00 90 1", "Mill Row 7b", None, "55-2", None),
    (4, "Wen", "Sato", None, None, None, None, None, None),
    (5, "Ezra", "Quill", "quill@example.org", "", "", "Saltmarsh", "9", "Sudland"),
]


def orders_df(spark):
    rows = [(o, dt.date.fromisoformat(d), c, None, None, None, None, None) for o, d, c in ORDERS]
    return spark.createDataFrame(rows, S.ORDERS)


def lines_df(spark, rows=LINES):
    return spark.createDataFrame(rows, S.ORDER_LINE)


def customers_df(spark):
    return spark.createDataFrame(CUSTOMERS, S.CUSTOMER)


def product_row(pid, title, **kw):
    base = {f.name: None for f in S.PRODUCT.fields}
    base.update(product_id=pid, title=title, **kw)
    return tuple(base[f.name] for f in S.PRODUCT.fields)


def products_df(spark, rows):
    return spark.createDataFrame([product_row(*r[:2], **(r[2] if len(r) > 2 else {}))
                                  for r in rows], S.PRODUCT)


def products_for_lines(spark):
    ids = sorted({r[2] for r in LINES})
    return products_df(spark, [(i, f"Title {i}") for i in ids])


def feed_df(spark, rows):
    """rows: (seq, op, order_id, old_p, old_l, old_q, new_p, new_l, new_q)."""
    return spark.createDataFrame(rows, S.CHANGE_FEED)


def locations_df(spark):
    return spark.createDataFrame([(1, "Front shelf"), (2, "Attic"), (3, "Van"), (4, "Annex")], S.LOCATION)


def inventory_df(spark, rows):
    """rows: (inventory_id, product_id, location_id, bin, rack, quantity, parcel, code)."""
    return spark.createDataFrame(rows, S.INVENTORY)
