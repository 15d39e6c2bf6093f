from __future__ import annotations

from decimal import Decimal

from stockbook.operators import audits as C
from stockbook.operators import documents as D
from tests import seed


LONG = "A very long title that certainly goes past the fifty character cut"
BLANK, RULE = "", "-" * 80
HEADING = "Title                                                Qty      Price      Total"

PRINTED = {
    13: [
        "Shop", "Invoice #: 13", "Date: 2025-12-04", BLANK, "Bill To:", "(no name)", "Town", BLANK,
        HEADING, RULE,
        "A very long title that certainly goes past the ...     2       9.50      19.00",
        "Short                                              123456       1.00  123456.00",
        RULE,
        "                                                                 TOTAL  123475.00",
    ],
    15: [
        "Shop", "Invoice #: 15", "Date: 2025-12-04", BLANK, "Bill To:", "(no name)", "Town", BLANK,
        HEADING, RULE,
        "XXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXX     1       0.05       0.05",
        RULE,
        "                                                                 TOTAL       0.05",
    ],
    20: [
        "Shop", "Invoice #: 20", "Date: 2025-12-05", BLANK, "Bill To:", "Ezra Quill", "Pier 3", "123",
        "Sudland", BLANK, HEADING, RULE, RULE,
        "                                                                 TOTAL       0.00",
    ],
}


def test_printed_invoices(spark):
    products = seed.products_df(spark, [(1, LONG), (2, "Short"), (3, "X" * 50)])
    lines = seed.lines_df(spark, [(1, 13, 1, Decimal("9.50"), 2, 1),
                                  (2, 13, 2, Decimal("1.00"), 123456, 1),
                                  (3, 15, 3, Decimal("0.05"), 1, 2)])
    orders = seed.orders_df(spark)
    customers = spark.createDataFrame(
        [(2, "", None, "", "", "", "Town", "", ""), (5, "Ezra", "Quill", "", "", "Pier 3", None, "123", "Sudland")],
        seed.S.CUSTOMER)
    printed = {}
    rows = D.invoice_text(orders, customers, lines, products, shop_name="Shop").collect()
    for r in sorted(rows, key=lambda r: (r.order_id, r.section, r.line_key)):
        printed.setdefault(r.order_id, []).append(r.text)
    for order, text in PRINTED.items():
        assert printed[order] == text
    head = {r.order_id: (r.line_count, r.total) for r in D.invoices(
        orders, customers, lines, products).collect()}
    assert head[15] == (1, Decimal("0.05")) and head[3] == (0, Decimal("0.00"))


def test_audits_find_planted_violations(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c"), (2, None), (3, None)],
                               "id bigint, name string")
    pk = {(r.key_value, r.problem, r.row_count) for r in C.audit_unique(df, ["id"], "t").collect()}
    assert pk == {("1", "duplicate", 2), (None, "null key", 1)}
    uq = C.audit_unique(df, ["name"], "t", nulls_distinct=True).collect()
    assert uq == []
    parent = spark.createDataFrame([(1,), (2,)], "id bigint")
    fk = {(r.key_value, r.row_count) for r in C.audit_fk(df, "id", parent, "id", "t", "p").collect()}
    assert fk == {("3", 1)}
    nn = {r.column_name: r.null_count for r in C.audit_not_null(df, ["id", "name"], "t").collect()}
    assert nn == {"id": 1, "name": 2}
    ln = C.audit_lengths(spark.createDataFrame([("x" * 14,), ("ok",)], "isbn string"),
                         {"isbn": 13}, "music_product").collect()[0]
    assert (ln.max_length, ln.limit, ln.too_long) == (14, 13, 1)


def test_audit_foreign_keys_many_at_once(spark):
    child = spark.createDataFrame([(1, 10, 7), (2, 11, None), (3, 99, 8), (4, 99, 9)],
                                  "id bigint, a bigint, b bigint")
    pa = spark.createDataFrame([(10,), (11,)], "k bigint")
    pb = spark.createDataFrame([(7,), (8,)], "k bigint")
    tables = {"c": child, "pa": pa, "pb": pb}
    fks = [("c", "a", "pa", "k"), ("c", "b", "pb", "k")]
    got = {(r.column_name, r.parent_table, r.key_value, r.row_count)
           for r in C.audit_foreign_keys(tables, fks).collect()}
    assert got == {("a", "pa", "99", 2), ("b", "pb", "9", 1)}
    single = {(r.key_value, r.row_count) for r in C.audit_fk(child, "a", pa, "k", "c", "pa").collect()}
    assert single == {("99", 2)}
