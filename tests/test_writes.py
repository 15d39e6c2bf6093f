from __future__ import annotations

import datetime as dt
import random
from decimal import Decimal

from pyspark.sql import functions as F

from stockbook.operators import writes as W
from stockbook.operators.keys import allocate_keys, bucket_of
from stockbook.sources import bindings as B
from stockbook.sources import sinks
from tests import seed


def test_allocate_keys_dense_in_order_across_partitions(spark):
    rng = random.Random(3)
    seqs = rng.sample(range(1, 100000), 997)
    df = spark.createDataFrame([(s, s % 3) for s in seqs], "seq bigint, g int").repartition(7)
    existing = spark.createDataFrame([(41,), (17,)], "id bigint")
    for buckets in (1, 3, 50):  # the buckets only deal the work
        out = allocate_keys(df, "id", ["seq"], existing=existing, buckets=buckets)
        assert out.columns == ["seq", "g", "id"]
        got = sorted((r.seq, r.id) for r in out.collect())
        assert [i for _, i in got] == list(range(42, 42 + 997))


def test_allocate_keys_without_rows_and_with_ties_in_the_leading_column(spark):
    df = spark.createDataFrame([(i % 4, i) for i in range(200)], "a bigint, b bigint")
    out = allocate_keys(df, "id", ["a", "b"], base=0, buckets=6).collect()
    assert [r.id for r in sorted(out, key=lambda r: (r.a, r.b))] == list(range(1, 201))
    assert allocate_keys(df.limit(0), "id", ["a", "b"], base=0).count() == 0


def test_bucket_of_equals_counting_the_bounds_below(spark):
    rng = random.Random(1)
    for n in (1, 2, 5, 50, 211):
        bounds = sorted(set(rng.sample(range(1000), n)))
        got = spark.range(-1, 1001).select("id", bucket_of(F.col("id"), bounds).alias("b")).collect()
        assert all(r.b == sum(x < r.id for x in bounds) for r in got)


def test_allocate_keys_where_numbers_only_chosen_rows(spark):
    df = spark.createDataFrame([(i, i % 4 == 0, 1000 + i) for i in range(1, 60)],
                               "seq bigint, ok boolean, id bigint")
    out = allocate_keys(df, "id", ["seq"], base=0, where=F.col("ok"), buckets=3).collect()
    chosen = sorted((r.seq, r.id) for r in out if r.ok)
    assert [i for _, i in chosen] == list(range(1, len(chosen) + 1))
    assert all(r.id == 1000 + r.seq for r in out if not r.ok)
    assert len(out) == 59


def _requests(spark, rows):
    return spark.createDataFrame(rows, "seq bigint, product_id bigint, location_id bigint,"
                                       " quantity int, h_bin_num string, h_rack_num string,"
                                       " halstan_code string")


def test_replenish_fold_semantics(spark):
    inv = seed.inventory_df(spark, [(5, 1, 1, "B0", "R0", 10, 3, "C0")])
    req = _requests(spark, [
        (1, 1, 1, 4, "B1", "R1", "C1"),
        (2, 1, 1, 6, None, "R2", None),     # bin overwritten by NULL, code kept from seq 1
        (3, 2, 1, 7, "B3", None, None),     # new row
        (4, 2, 1, -1, "B4", None, "C4"),
    ])
    out = {(r.product_id, r.location_id): r for r in W.replenish(req, inv).collect()}
    a = out[(1, 1)]
    assert (a.inventory_id, a.quantity, a.h_bin_num, a.h_rack_num, a.halstan_code, a.parcel_qty) \
        == (5, 20, None, "R2", "C1", 3)
    b = out[(2, 1)]
    assert (b.inventory_id, b.quantity, b.h_bin_num, b.halstan_code, b.parcel_qty) \
        == (6, 6, "B4", "C4", None)


def test_replenish_then_undo_restores_quantities(spark):
    inv = seed.inventory_df(spark, [(1, 1, 1, "B", None, 10, 2, "C"),
                                    (2, 2, 2, None, None, 0, None, None)])
    req = _requests(spark, [(10, 1, 1, 5, "X", None, None), (11, 2, 2, 3, None, None, None),
                            (12, 3, 1, 9, None, None, None)])
    after = W.replenish(req, inv)
    undo = spark.createDataFrame([(10,), (11,), (12,)], "replenish_seq bigint")
    back = {(r.product_id, r.location_id): r.quantity
            for r in W.undo_replenish(undo, req, after).collect()}
    assert back == {(1, 1): 10, (2, 2): 0, (3, 1): 0}


def test_undo_of_missing_row_creates_negative_row(spark):
    inv = seed.inventory_df(spark, [(1, 1, 1, None, None, 10, None, None)])
    log = _requests(spark, [(7, 9, 2, 4, None, None, None)])
    out = {(r.product_id, r.location_id): (r.inventory_id, r.quantity) for r in W.undo_replenish(
        spark.createDataFrame([(7,)], "replenish_seq bigint"), log, inv).collect()}
    assert out == {(1, 1): (1, 10), (9, 2): (2, -4)}


def _product_requests(spark, rows):
    cols = ["seq", "product_id", "title", "composer", "media", "no_of_movements", "categories"]
    full = []
    for r in rows:
        d = dict(zip(cols, r))
        full.append(d)
    names = ["seq", "product_id", "title", "duration", "no_of_movements", "duration_seconds",
             "duration_formatted", "price", "ismn", "is_duplicate", "work_id", "not_difficult",
             "rentable", "halstan_code", "composer", "librettist_1", "librettist_2", "media",
             "sheet_music_plus_sku", "score_type", "publication_year", "isbn", "product_type",
             "categories"]
    data = [tuple(d.get(n, "") for n in names) for d in full]
    schema = ", ".join(f"{n} {'bigint' if n == 'seq' else 'string'}" for n in names)
    return spark.createDataFrame(data, schema)


def test_update_products_null_overwrites_and_latest_wins(spark):
    products = seed.products_df(spark, [(1, "Old one", {"composer": "A", "media": "print"}),
                                        (2, "Old two", {"composer": "B"})])
    req = _product_requests(spark, [
        (1, "1", "First edit", "Z", "print", "2", "Winds"),
        (2, "1", "Second edit", "(None)", "", "", "Opera"),
        (3, "9", "Missing", "Q", "", "", ""),
        (4, "2", " ", "Q", "", "", ""),  # rejected: no title
        (5, "x", "T", "Q", "", "", ""),
        (6, "99999999999999999999", "T", "Q", "", "", ""),
    ])
    after, report = W.update_products(req, products, B.category(spark))
    got = {r.product_id: (r.title, r.composer, r.media, r.no_of_movements) for r in after.collect()}
    assert got == {1: ("Second edit", None, None, None), 2: ("Old two", "B", None, None)}
    answers = {1: ("superseded", None), 2: ("updated", None), 3: ("not found", None),
               4: ("rejected", "title required"), 5: ("rejected", "product_id not an integer"),
               6: ("rejected", "product_id out of range")}
    assert {r.seq: (r.status, r.reason) for r in report.collect()} == answers
    links, report = W.replace_categories(req, products, spark.createDataFrame(
        [(1, 1), (1, 2), (2, 3)], "product_id bigint, category_id bigint"), B.category(spark))
    assert sorted((r.product_id, r.category_id) for r in links.collect()) == [(1, 4), (2, 3)]
    assert {r.seq: (r.status, r.reason) for r in report.collect()} == answers


def test_add_products_rejects_unknown_category(spark):
    products = seed.products_df(spark, [(7, "Seven")])
    req = _product_requests(spark, [
        (1, "", "New A", "X", "print", "1", "Winds;Opera;Winds"),
        (2, "", "New B", "X", "print", "1", "Winds;Nope"),
        (3, "", "New C", "X", "print", "x", ""),
    ])
    rows, links, report = W.add_products(req, products, B.category(spark))
    rep = {r.seq: (r.product_id, r.category_count, r.reason) for r in report.collect()}
    assert rep == {1: (8, 2, None), 2: (None, 2, "unknown category"),
                   3: (None, 0, "no_of_movements not an integer")}
    assert sorted((r.product_id, r.category_id) for r in links.collect()) == [(8, 1), (8, 4)]
    assert [r.title for r in rows.collect()] == ["New A"]


def test_create_orders_and_customers(spark):
    orders, customers = seed.orders_df(spark), seed.customers_df(spark)
    req = spark.createDataFrame([(1, " 2 "), (2, ""), (3, "77"), (4, "5")],
                                "seq bigint, customer_id string")
    new, report = W.create_orders(req, orders, customers, dt.date(2025, 12, 6))
    assert sorted((r.order_id, r.customer_id, str(r.order_date)) for r in new.collect()) == \
        [(23, 2, "2025-12-06"), (24, 5, "2025-12-06")]
    assert {r.seq: r.reason for r in report.collect()} == {
        1: None, 2: "customer_id required", 3: "unknown customer", 4: None}
    creq = spark.createDataFrame(
        [(1, " Al ", "", "", "", "", "", "", ""), (2, " ", "\t", "", "", "", "", "", "")],
        "seq bigint, first_name string, last_name string, email_addr string, phone string,"
        " street_address string, town string, zip string, country string")
    rows, rep = W.add_customers(creq, customers)
    assert [(r.customer_id, r.first_name, r.last_name, r.zip) for r in rows.collect()] == \
        [(6, "Al", "", "")]
    assert {r.seq: r.reason for r in rep.collect()}[2] == "first or last name required"


def test_add_order_lines_feed_and_rejects(spark):
    orders, lines = seed.orders_df(spark), seed.lines_df(spark)
    products, locations = seed.products_for_lines(spark), seed.locations_df(spark)
    raw = spark.createDataFrame([
        (1, "13", "44", "2", "$9.50 ", "1"),
        (2, "13", "44", "2", "none", "1"),
        (3, "99", "44", "2", "9.50", "1"),
        (4, "13", "44", "1_000_000", "99999.00", "1"),
        (5, "13", "44", "1", "$1,004.50", "2"),
    ], "seq bigint, order_id string, product_id string, quantity string, price string,"
       " location_id string")
    new, feed, report = W.add_order_lines(raw, lines, products, orders, locations)
    got = sorted((r.order_line_id, r.quantity, r.product_price, r.line_total)
                 for r in new.collect())
    assert got == [(24, 2, Decimal("9.50"), Decimal("19.00")),
                   (25, 1, Decimal("1004.50"), Decimal("1004.50"))]
    reasons = {r.seq: r.reason for r in report.collect()}
    assert reasons == {1: None, 2: "price not set in catalogue", 3: "unknown order",
                       4: "line total out of range", 5: None}
    assert {(r.op, r.new_qty) for r in feed.collect()} == {("INSERT", 2), ("INSERT", 1)}


def test_deletes_cascade_set_null_and_restrict(spark):
    orders, lines = seed.orders_df(spark), seed.lines_df(spark)
    ids = spark.createDataFrame([(15,), (16,)], "order_id bigint")
    left_orders, left_lines, feed = W.delete_orders(ids, orders, lines)
    assert left_orders.count() == 18 and left_lines.count() == 13
    assert sorted((r.seq, r.op, r.old_qty) for r in feed.collect()) == [
        (12, "DELETE", 1), (13, "DELETE", 1), (14, "DELETE", 2), (15, "DELETE", 1),
        (16, "DELETE", 1)]
    cust = spark.createDataFrame([(2,)], "customer_id bigint")
    remaining, after = W.delete_customers(cust, seed.customers_df(spark), orders)
    assert remaining.count() == 4
    assert after.where(F.col("customer_id").isNull()).count() == 5
    prods = spark.createDataFrame([(44,), (500,)], "product_id bigint")
    out = W.deletable(prods, "product_id", [("order_line", lines, "product_id")])
    assert sorted(map(tuple, out.collect())) == [(44, "order_line", False), (500, "", True)]


def test_delete_protection_uses_every_restricting_reference(spark):
    from stockbook.sources import schemas as S
    tables = {n: spark.createDataFrame([], s) for n, s in S.TABLES.items()}
    assert sum(len(W.restricting_references(tables, p)) for p in S.TABLES) == 9
    tables["inventory_movement"] = spark.createDataFrame(
        [(1, 70, 3, 4, 1, "sale", None, None)], "movement_id bigint, product_id bigint,"
        " from_location_id bigint, to_location_id bigint, quantity int, movement_type string,"
        " movement_date timestamp_ntz, reference string")
    ids = spark.createDataFrame([(3,), (4,), (5,)], "location_id bigint")
    out = W.deletable(ids, "location_id", W.restricting_references(tables, "location"))
    assert sorted(map(tuple, out.collect())) == [
        (3, "inventory_movement", False), (4, "inventory_movement", False), (5, "", True)]
    prods = spark.createDataFrame([(70,)], "product_id bigint")
    only = W.deletable(prods, "product_id", W.restricting_references(tables, "music_product"))
    assert only.first().deletable is False


def test_append_fills_defaults_and_publish_versions(spark, tmp_dir):
    lines = seed.lines_df(spark)
    batch = spark.createDataFrame([(99, 3, 44, Decimal("1.00"), None, 1)],
                                  "order_line_id bigint, order_id bigint, product_id bigint,"
                                  " product_price decimal(10,2), quantity int,"
                                  " fulfilled_from_location_id bigint")
    out = sinks.append(batch, lines, sinks.DEFAULTS["order_line"])
    assert out.where("order_line_id = 99").collect()[0].quantity == 1
    v1 = sinks.publish(out, f"{tmp_dir}/order_line")
    assert sinks.current_version(spark, f"{tmp_dir}/order_line") == v1
    v2 = sinks.publish(spark.read.parquet(v1).where("quantity > 1"), f"{tmp_dir}/order_line")
    assert v2 != v1 and sinks.current_version(spark, f"{tmp_dir}/order_line") == v2
    assert spark.read.parquet(v2).count() == 1
    # nothing is overwritten: the older pointer is still there
    assert sinks._pointer_numbers(spark, f"{tmp_dir}/order_line") == [1, 2]


def test_store_and_read_with_the_declared_schema(spark, tmp_dir):
    from stockbook.sources.schemas import ORDER_LINE, read_table
    lines = seed.lines_df(spark)
    path = f"{tmp_dir}/order_line"
    sinks.bulk_load(lines.limit(5).withColumn("extra", F.lit(1)), path, "order_line")
    batch = lines.limit(2).withColumn("quantity", F.lit(None).cast("int"))
    sinks.append_to(batch, path, "order_line")
    back = read_table(spark, tmp_dir, "order_line")
    assert back.columns == [f.name for f in ORDER_LINE.fields] and back.count() == 7
    assert back.where("quantity IS NULL").count() == 0


def test_allocate_keys_many_rows(spark):
    n = 300_000
    df = (spark.range(0, n, numPartitions=8)
          .select(((F.col("id") * 7919) % n).alias("seq"), (F.col("id") % 2 == 0).alias("ok")))
    out = allocate_keys(df, "k", ["seq"], base=100, where=F.col("ok"), rows_per_bucket=10_000)
    chosen = out.where(F.col("ok")).select("seq", "k").toPandas().sort_values("seq")
    assert len(chosen) == n // 2
    assert list(chosen["k"]) == list(range(101, 101 + len(chosen)))


def test_time_defaults(spark):
    from stockbook.sources.schemas import MOVEMENT, ORDERS
    led = spark.createDataFrame([(1, 5, 1, None, 2, "sale", None, "order 1")], MOVEMENT.simpleString()
                                .replace("struct<", "").rstrip(">").replace(":", " "))
    out = sinks.with_defaults(led, sinks.defaults_for("inventory_movement",
                                                      now="2025-12-06 10:00:00")).collect()[0]
    assert str(out.movement_date) == "2025-12-06 10:00:00"
    o = spark.createDataFrame([(1, None, 2, None, None, None, None, None)], ORDERS)
    r = sinks.with_defaults(o, sinks.defaults_for("orders")).collect()[0]
    assert r.order_date is not None
    assert sinks.defaults_for("order_line") == {"quantity": 1}


def test_publish_tables_switches_together(spark, tmp_dir):
    from stockbook.operators import ledger as L
    inv = seed.inventory_df(spark, [(1, 44, 1, None, None, 5, None, None)])
    feed = seed.feed_df(spark, [(1, "INSERT", 13, None, None, None, 44, 1, 2)])
    d = L.change_delta(feed)
    root = f"{tmp_dir}/state"
    v1 = sinks.publish_tables({"inventory": L.apply_deltas(inv, d),
                               "inventory_movement": L.movement_ledger(d, "2025-12-06 00:00:00")},
                              root)
    cur = sinks.current_tables(spark, root, ["inventory", "inventory_movement"])
    assert sinks.current_version(spark, root) == v1
    assert [r.quantity for r in cur["inventory"].collect()] == [3]
    assert [(r.movement_type, r.quantity) for r in cur["inventory_movement"].collect()] == [("sale", 2)]
