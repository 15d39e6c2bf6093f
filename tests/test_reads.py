from __future__ import annotations

from decimal import Decimal

from pyspark.sql import functions as F

from stockbook.operators import reads as R
from stockbook.sources import bindings as B
from tests import seed


def test_orders_with_total_golden(spark):
    out = R.orders_with_total(seed.orders_df(spark), seed.lines_df(spark))
    got = {r.order_id: r.order_total for r in out.collect()}
    assert len(got) == 20
    for oid, total in {13: "36.00", 15: "38.00", 16: "63.00", 20: "29.00", 22: "22.00"}.items():
        assert got[oid] == Decimal(total)
    for oid in (3, 4, 5, 8, 9, 10, 11, 17, 19):
        assert got[oid] == Decimal("0.00")
    assert dict(out.dtypes)["order_total"] == "decimal(18,2)"


def test_customer_order_summary_golden(spark):
    out = R.customer_order_summary(seed.customers_df(spark), seed.orders_df(spark),
                                   seed.lines_df(spark))
    got = {r.customer_id: (r.order_count, r.total_spent) for r in out.collect()}
    assert got == {1: (5, Decimal("9.50")), 2: (5, Decimal("146.50")),
                   3: (6, Decimal("76.32")), 4: (0, Decimal("0.00")), 5: (4, Decimal("32.00"))}


def test_customer_summary_two_level_equals_count_distinct(spark):
    customers, orders, lines = (seed.customers_df(spark), seed.orders_df(spark),
                                seed.lines_df(spark))
    direct = (R.customer_orders_lines(customers, orders, lines)
              .groupBy("customer_id").agg(F.countDistinct("order_id").alias("n"),
                                          F.coalesce(F.sum("line_total"), F.lit(0)).alias("s")))
    a = {r.customer_id: (r.n, Decimal(r.s)) for r in direct.collect()}
    b = {r.customer_id: (r.order_count, r.total_spent) for r in R.customer_order_summary(
        customers, orders, lines).collect()}
    assert a == b


def _category(spark):
    return B.category(spark)


def test_primary_category_priority(spark):
    products = seed.products_df(spark, [(1, "One"), (2, "Two"), (3, "Three"), (31, "Encore"),
                                        (40, "No category"), (41, "Other only")])
    junction = spark.createDataFrame(
        [(1, 1), (1, 5), (2, 1), (2, 5), (3, 1), (31, 2), (31, 3), (41, 6)],
        "product_id bigint, category_id bigint")
    out = R.primary_category(products, junction, _category(spark))
    got = {r.product_id: r.primary_category_id for r in out.collect()}
    assert got == {1: 5, 2: 5, 3: 1, 31: 3, 41: 6}
    assert "isbn" not in out.columns and "product_type" not in out.columns


def test_category_rank_values(spark):
    df = spark.createDataFrame([(i,) for i in range(1, 8)], "category_id bigint")
    got = {r.category_id: r.r for r in df.select(
        "category_id", R.X.category_rank("category_id").alias("r")).collect()}
    assert got == {4: 1, 5: 2, 3: 3, 1: 4, 2: 5, 6: 99, 7: 99}


def test_search_filters_and_sentinels(spark):
    products = seed.products_df(spark, [
        (1, "B", {"composer": "X", "media": "print", "product_type": "Book"}),
        (2, "A", {"composer": "X", "media": "audio", "product_type": "Book"}),
        (3, "C", {"composer": "Y", "media": "print", "product_type": "Sheet Music"})])
    inv = seed.inventory_df(spark, [(1, 1, 1, None, None, 5, None, None),
                                    (2, 1, 2, None, None, 7, None, None)])
    junction = spark.createDataFrame([(1, 4), (3, 4), (3, 1)], "product_id bigint, category_id bigint")
    cat = _category(spark)
    res = R.product_search(products, inv, junction, cat, "Opera", "", "print", "(Any type)")
    assert [(r.product_id, r.qty) for r in res.collect()] == [(1, 12), (3, 0)]
    res = R.product_search(products, inv, junction, cat, "(Any category)", "X", "(Any media)", "")
    assert [r.product_id for r in res.collect()] == [2, 1]  # sorted by title


def test_facets_one_pass(spark):
    products = seed.products_df(spark, [
        (1, "a", {"composer": "Quillon Ashby", "media": "print", "product_type": "Sheet Music"}),
        (2, "b", {"composer": "J.S. Bach", "media": "print", "product_type": "Book"}),
        (3, "c", {"composer": "Quillon Ashby"})])
    out = R.facets(products, _category(spark)).collect()
    by = {}
    for r in out:
        by.setdefault(r.facet, []).append(r.value)
    assert by["composer"] == ["J.S. Bach", "Quillon Ashby"]
    assert by["media"] == ["print"]
    assert by["product_type"] == ["Book", "Sheet Music"]
    assert "score_type" not in by
    assert len(by["category_name"]) == 6


def test_lookup_reports_missing_and_invalid(spark):
    products = seed.products_df(spark, [(5, "Five"), (7, "Seven")])
    keys = spark.createDataFrame([(1, " 5 "), (2, "9"), (3, ""), (4, "x1"), (5, "1_0")],
                                 "seq bigint, key string")
    got = {r.seq: (r.product_id, r.found, r.reason, r.title)
           for r in R.lookup(keys, products, "product_id", ["title"]).collect()}
    assert got[1] == (5, True, None, "Five")
    assert got[2] == (9, False, "not found", None)
    assert got[3][1:3] == (False, "product_id required")
    assert got[4][1:3] == (False, "product_id not an integer")
    assert got[5][0] == 10  # Python int() accepts digit-group underscores


def test_blank_nulls_display_form(spark):
    df = spark.createDataFrame([(1, None, None, None)], "id bigint, a string, n int, b boolean")
    r = R.blank_nulls(df, ["a", "n", "b"], none_label={"a": "(None)"}).collect()[0]
    assert (r.a, r.n, r.b) == ("(None)", "", False)


def test_next_key_and_update_report(spark):
    df = spark.createDataFrame([(3,), (9,)], "k bigint")
    assert R.next_key(df, "k").collect()[0].next_key == 10
    assert R.next_key(df.where("k > 100"), "k").collect()[0].next_key == 1
    req = spark.createDataFrame([(9,), (4,), (9,)], "k bigint")
    got = {r.k: r.status for r in R.update_report(req, df, "k").collect()}
    assert got == {9: "updated", 4: "not found"}
