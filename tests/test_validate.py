from __future__ import annotations

from decimal import Decimal

from stockbook.operators import validate as V
from tests import seed


def _raw_lines(spark, rows):
    return spark.createDataFrame(
        [(i, *r) for i, r in enumerate(rows, 1)],
        "seq bigint, order_id string, product_id string, quantity string, price string,"
        " location_id string")


def test_validate_order_lines_first_failure_wins(spark):
    rows = [
        ("", "", "", "", ""),                       # order id first
        ("1", " ", "x", "", ""),                    # product blank before qty not int
        ("1", "2", "", "", ""),
        ("1", "2", "3", "\t", ""),                  # white space other than blanks is blank
        ("1", "2", "3", " NoNe ", ""),
        ("1", "2", "3", "4", ""),
        ("1.5", "2", "3", "4", "1"),
        ("1", "abc", "3", "4", "1"),
        ("1", "2", "12.5", "4", "1"),
        ("1", "2", "3", "four", "1"),
        ("1", "2", "3", "4", "1e1"),
        ("1", "2", "3", "nan", "1"),
        ("1", "2", "3", "123456789.00", "1"),
        ("9" * 20, "2", "3", "4", "1"),
        ("1", "9" * 20, "3", "4", "1"),
        ("1", "2", "3", "4", "9" * 20),
    ]
    got = [r.reason for r in V.validate_order_lines(_raw_lines(spark, rows)).orderBy("seq").collect()]
    assert got == ["order_id required", "product_id required", "quantity required",
                   "price required", "price not set in catalogue", "location_id required",
                   "order_id not an integer", "product_id not an integer",
                   "quantity not an integer", "price not a number",
                   "location_id not an integer", "price not a number", "price out of range",
                   "order_id out of range", "product_id out of range", "location_id out of range"]


def test_validate_order_lines_python_int_and_float_forms(spark):
    rows = [
        ("\t7\n", "+5", "1_000", "$1,004.50 ", " 3 "),
        ("007", "-2", "2", "19.995", "1"),
        ("1", "2", "3", "1e3", "1"),
        ("1", "2", "3", ".5", "1"),
        ("1", "2", "1__0", "1", "1"),
    ]
    out = V.validate_order_lines(_raw_lines(spark, rows)).orderBy("seq").collect()
    a, b, c, d, e = out
    assert (a.order_id, a.product_id, a.quantity, a.product_price,
            a.fulfilled_from_location_id, a.reason) == (7, 5, 1000, Decimal("1004.50"), 3, None)
    assert (b.order_id, b.product_id, b.product_price, b.reason) == (7, -2, Decimal("20.00"), None)
    assert c.product_price == Decimal("1000.00") and c.reason is None
    assert d.product_price == Decimal("0.50")
    assert e.reason == "quantity not an integer"


def test_validate_customers_keeps_blanks(spark):
    raw = spark.createDataFrame(
        [(1, "", "Smith", None, "", "", "", "", ""), (2, " ", "\n", "", "", "", "", "", "")],
        "seq bigint, first_name string, last_name string, email_addr string, phone string,"
        " street_address string, town string, zip string, country string")
    out = V.validate_customers(raw).orderBy("seq").collect()
    assert (out[0].first_name, out[0].last_name, out[0].email_addr, out[0].reason) == \
        ("", "Smith", "", None)
    assert out[1].reason == "first or last name required"


def test_validate_products_conversions(spark):
    names = ["seq", "title", "duration", "no_of_movements", "duration_seconds",
             "duration_formatted", "price", "ismn", "is_duplicate", "work_id", "not_difficult",
             "rentable", "halstan_code", "composer", "librettist_1", "librettist_2", "media",
             "sheet_music_plus_sku", "score_type", "publication_year", "isbn", "product_type",
             "categories"]
    base = {n: "" for n in names}
    rows = [
        dict(base, seq=1, title=" T ", composer="(None)", media=" print ", no_of_movements=" 3 ",
             is_duplicate="true", rentable="", price=" $4.50 ", categories=" Winds ; ;Opera"),
        dict(base, seq=2, title="T", work_id="12a"),
        dict(base, seq=3, title=" "),
        dict(base, seq=4, title="T", publication_year="99999999999"),
    ]
    schema = ", ".join(f"{n} {'bigint' if n == 'seq' else 'string'}" for n in names)
    raw = spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schema)
    out = V.validate_products(raw).orderBy("seq").collect()
    a = out[0]
    assert (a.title, a.composer, a.media, a.no_of_movements, a.is_duplicate, a.rentable,
            a.price, a.duration, a.categories, a.reason) == \
        ("T", None, "print", 3, True, False, "$4.50", None, ["Winds", "Opera"], None)
    assert [r.reason for r in out[1:]] == ["work_id not an integer", "title required",
                                           "publication_year out of range"]


def test_validate_replenish_and_keys(spark):
    products = seed.products_df(spark, [(1, "One")])
    raw = spark.createDataFrame([
        (1, "1", "2", "5", " b ", "", None),
        (2, "1", "", "5", None, None, None),
        (3, "x", "2", "5", None, None, None),
        (4, "9", "2", "5", None, None, None),
        (5, "1", "7", "5", None, None, None),
        (6, "7", "2", "abc", None, None, None),       # the product is looked up first
        (7, "1", "9" * 20, "5", None, None, None),
        (8, "1", "2", "9" * 12, None, None, None),
        (9, "1", "2", "abc", None, None, None),
    ], "seq bigint, product_id string, location_id string, quantity string, bin string,"
       " rack string, code string")
    out = {r.seq: r for r in V.validate_replenish(raw, products, seed.locations_df(spark)).collect()}
    assert (out[1].product_id, out[1].location_id, out[1].quantity, out[1].h_bin_num,
            out[1].h_rack_num, out[1].reason) == (1, 2, 5, "b", None, None)
    assert out[2].reason == "product_id, location_id and quantity required"
    assert out[3].reason == out[4].reason == out[6].reason == "unknown product"
    assert out[5].reason == "unknown location"
    assert out[7].reason == "location_id out of range"
    assert out[8].reason == "quantity out of range"
    assert out[9].reason == "location_id and quantity must be integers"
    open_ = {r.seq: r.reason for r in V.validate_replenish(raw, products).collect()}
    assert open_[7] == "location_id out of range" and open_[5] is None
    keys = spark.createDataFrame([(1, " 42 "), (2, None), (3, "4.0"), (4, "9" * 20)],
                                 "seq bigint, k string")
    got = {r.seq: (r.k, r.reason) for r in V.validate_keys(keys, "k", "k").collect()}
    assert got == {1: (42, None), 2: (None, "k required"), 3: (None, "k not an integer"),
                   4: (None, "k out of range")}


def test_clean_text_and_price(spark):
    df = spark.createDataFrame([(" a ", "$1,234.5 "), ("\t", None)], "t string, p string")
    out = V.clean_prices(V.clean_text(df, ["t"]), "p", "v").collect()
    assert [(r.t, r.v) for r in out] == [("a", Decimal("1234.50")), (None, None)]
    kept = V.clean_text(df, ["t"], blank_to_null=False).collect()
    assert [r.t for r in kept] == ["a", ""]
