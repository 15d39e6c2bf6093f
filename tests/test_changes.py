"""Change batches, safe publishing, the undo log, the write gate and the audits of a change."""

from __future__ import annotations

import random
import threading

import pytest
from pyspark.sql import functions as F

from stockbook.operators import audits as C
from stockbook.operators import changes as G
from stockbook.operators import gate as GT
from stockbook.operators import ledger as L
from stockbook.operators import writes as W
from stockbook.session import stored
from stockbook.sources import schemas as S
from stockbook.sources import sinks
from tests import seed

DAY = "2024-01-01 00:00:00"


def _requests(spark, rows):
    return spark.createDataFrame(rows, "seq bigint, order_id string, product_id string, quantity string,"
                                       " price string, location_id string")


def _opened(spark, root):
    orders = spark.createDataFrame([(1, None, 7), (2, None, None), (3, None, 7)],
                                   "order_id bigint, order_date date, customer_id bigint")
    orders = orders.select(*[F.col(f.name) if f.name in orders.columns else F.lit(None).cast(f.dataType).alias(f.name)
                             for f in S.ORDERS.fields])
    lines = spark.createDataFrame([(10, 1, 44, 5, 1), (11, 2, 44, 3, 1), (12, 2, 45, 2, 2), (13, 3, 46, 9, 1)],
                                  "order_line_id bigint, order_id bigint, product_id bigint, quantity int, loc bigint")
    lines = lines.select("order_line_id", "order_id", "product_id",
                         F.lit("2.00").cast("decimal(10,2)").alias("product_price"), "quantity",
                         F.col("loc").alias("fulfilled_from_location_id"))
    inv = seed.inventory_df(spark, [(1, 44, 1, None, None, 50, None, None), (2, 45, 2, None, None, 20, None, None)])
    G.open_state(spark, root, orders, lines, inv, spark.createDataFrame([], S.MOVEMENT))
    products = seed.products_df(spark, [(44, "a"), (45, "b"), (46, "c")])
    locations = spark.createDataFrame([(1, "x"), (2, "y")], "location_id bigint, location_name string")
    return products, locations


def _stock(spark, root):
    inv = sinks.current_tables(spark, root, ["inventory"])["inventory"]
    return {(r.product_id, r.location_id): r.quantity for r in inv.collect()}


def test_a_batch_is_one_unit_and_a_replay_changes_nothing(spark, tmp_dir):
    root = f"{tmp_dir}/state"
    products, locations = _opened(spark, root)
    batch = G.ChangeBatch(
        "b1", new_lines=_requests(spark, [(1, "3", "44", "4", "1.5", "2"), (2, "2", "44", "1", "1", "1"),
                                          (3, "1", "45", "x", "1", "1"), (4, "1", "45", "6", "$3", "2")]),
        deleted_lines=spark.createDataFrame([(13,), (99,)], "order_line_id bigint"),
        deleted_orders=spark.createDataFrame([(2,)], "order_id bigint"))
    assert G.apply_batch(spark, root, batch, products, locations, DAY)
    now = sinks.current_tables(spark, root, [*G.TABLES, G.APPLIED, G.REFUSED])
    assert sorted(r.order_id for r in now["orders"].collect()) == [1, 3]
    assert sorted((r.order_line_id, r.product_id, r.quantity) for r in now["order_line"].collect()) == [
        (10, 44, 5), (14, 44, 4), (15, 45, 6)]
    ledger = [(r.movement_id, r.product_id, r.movement_type, r.quantity)
              for r in now["inventory_movement"].orderBy("movement_id").collect()]
    assert ledger == [(1, 44, "sale_cancel", 3), (2, 45, "sale_cancel", 2), (3, 46, "sale_cancel", 9),
                      (4, 44, "sale", 4), (5, 45, "sale", 6)]
    assert _stock(spark, root) == {(44, 1): 53, (45, 2): 16, (46, 1): 9, (44, 2): -4}
    assert sorted((r.seq, r.reason) for r in now[G.REFUSED].collect()) == [
        (2, "unknown order"), (3, "quantity not an integer")]
    number = sinks.current_number(spark, root)
    assert not G.apply_batch(spark, root, batch, products, locations, DAY)
    assert sinks.current_number(spark, root) == number

    more = G.ChangeBatch("b2", new_lines=_requests(spark, [(1, "1", "46", "2", "1", "1")]))
    folders = sinks._current(spark, root)[1]["tables"]["order_line"]
    assert G.apply_batch(spark, root, more, products, locations, DAY)
    after = sinks._current(spark, root)[1]["tables"]
    assert after["order_line"][:-1] == folders  # an append rewrites nothing
    now = sinks.current_tables(spark, root, G.TABLES)
    assert now["inventory_movement"].agg(F.max("movement_id").alias("m")).first().m == 6
    assert _stock(spark, root)[46, 1] == 7
    assert now["order_line"].count() == 4


def test_a_batch_without_changes_and_one_without_rows(spark, tmp_dir):
    root = f"{tmp_dir}/state"
    products, locations = _opened(spark, root)
    assert not G.apply_batch(spark, root, G.ChangeBatch("none"), products, locations, DAY)
    empty = G.ChangeBatch("empty", new_lines=_requests(spark, []))
    before = _stock(spark, root)
    assert G.apply_batch(spark, root, empty, products, locations, DAY)
    assert _stock(spark, root) == before


def test_a_lost_race_is_computed_again(spark, tmp_dir, monkeypatch):
    root = f"{tmp_dir}/state"
    products, locations = _opened(spark, root)
    other = G.ChangeBatch("other", deleted_lines=spark.createDataFrame([(10,)], "order_line_id bigint"))
    mine = G.ChangeBatch("mine", deleted_lines=spark.createDataFrame([(13,)], "order_line_id bigint"))
    made, seen = G.change_feed, []

    def first_the_other(*args):
        out = made(*args)
        if not seen:
            seen.append(1)
            G.apply_batch(spark, root, other, products, locations, DAY)
        return out

    monkeypatch.setattr(G, "change_feed", first_the_other)
    assert G.apply_batch(spark, root, mine, products, locations, DAY)
    now = sinks.current_tables(spark, root, [*G.TABLES, G.APPLIED])
    assert {r.batch_id for r in now[G.APPLIED].collect()} == {"other", "mine"}
    assert {r.order_line_id for r in now["order_line"].collect()} == {11, 12}
    assert sorted(r.movement_id for r in now["inventory_movement"].collect()) == [1, 2]


def test_writers_at_once_get_versions_of_their_own(spark, tmp_dir):
    root = f"{tmp_dir}/t"
    frames = [spark.range(k + 1) for k in range(6)]
    made: list[str] = []
    threads = [threading.Thread(target=lambda df=df: made.append(sinks.publish(df, root))) for df in frames]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(set(made)) == 6
    assert sinks._pointer_numbers(spark, root) == [1, 2, 3, 4, 5, 6]
    listed = [sinks._read_pointer(spark, root, n)["version"] for n in range(1, 7)]
    assert sorted(listed) == sorted(made) and sinks.current_version(spark, root) == listed[-1]


def test_conflict_and_lost_writers(spark, tmp_dir, monkeypatch):
    root = f"{tmp_dir}/t"
    sinks.publish(spark.range(1), root)
    sinks.publish(spark.range(2), root, based_on=1)
    with pytest.raises(sinks.Conflict):
        sinks.publish(spark.range(3), root, based_on=1)
    # a writer that made its pointer and was lost before it wrote the content
    monkeypatch.setattr(sinks, "CLAIM_SECONDS", 0.2)
    assert sinks._create(spark, f"{root}/pointers/{3:012d}.json", "")
    assert sinks.current_number(spark, root) == 2
    v = sinks.publish(spark.range(4), root, based_on=2)
    assert sinks.current_version(spark, root) == v and sinks.current_number(spark, root) == 4
    with pytest.raises(FileNotFoundError):
        sinks.current_version(spark, f"{tmp_dir}/nothing")


def test_undo_remembers(spark):
    log = spark.createDataFrame([(1, 44, 1, 5), (2, 44, 1, 7), (3, 45, 2, 1)],
                                "seq bigint, product_id bigint, location_id bigint, quantity int")
    inv = seed.inventory_df(spark, [(1, 44, 1, None, None, 12, None, None), (2, 45, 2, None, None, 1, None, None)])
    none = spark.createDataFrame([], "replenish_seq bigint")
    asked = spark.createDataFrame([(1, 2), (2, 2), (3, 9), (4, None)], "seq bigint, replenish_seq bigint")
    after, report, more = W.undo_batch(asked, log, inv, none)
    assert {(r.seq, r.status) for r in report.collect()} == {
        (1, "undone"), (2, "already undone"), (3, "unknown replenishment"), (4, "nothing to undo")}
    assert {r.product_id: r.quantity for r in after.collect()} == {44: 5, 45: 1}
    assert [r.replenish_seq for r in more.collect()] == [2]
    again = spark.createDataFrame([(5, 2), (6, 1)], "seq bigint, replenish_seq bigint")
    last, report, more = W.undo_batch(again, log, after, none.unionByName(more))
    assert {(r.seq, r.status) for r in report.collect()} == {(5, "already undone"), (6, "undone")}
    assert {r.product_id: r.quantity for r in last.collect()} == {44: 0, 45: 1}


def test_gate_refuses_what_a_database_would(spark, tmp_dir):
    stock = seed.inventory_df(spark, [(1, 44, 1, None, None, 5, None, None)])
    tables = {"inventory": stock, "music_product": seed.products_df(spark, [(44, "a"), (45, "b")]),
              "location": spark.createDataFrame([(1, "x"), (2, "y")], "location_id bigint, location_name string")}
    rows = [(2, 45, 1, None, None, 3, None, "ok"), (3, None, 1, None, None, 3, None, None),
            (4, 44, 1, None, None, 3, None, None), (5, 45, 2, None, None, 1, None, "x" * 11),
            (6, 45, 1, None, None, 1, None, None), (7, 46, 2, None, None, 1, None, None),
            (8, 45, 2, None, None, 1, None, None), (1, 44, 2, None, None, 1, None, None),
            (9, 44, 3, None, None, 1, None, None)]
    batch = spark.createDataFrame(rows, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in S.INVENTORY.fields))
    got = {r.inventory_id: r.refusal for r in GT.judged(batch, "inventory", tables, "inventory_id").collect()}
    assert got == {2: None, 3: "product_id is NULL", 4: "product_id, location_id already stored",
                   5: "halstan_code longer than 10", 6: "product_id, location_id in an earlier row",
                   7: "product_id not in music_product", 8: None, 1: "inventory_id already stored",
                   9: "location_id not in location"}
    path = f"{tmp_dir}/inventory"
    refused = GT.append_checked(batch, path, "inventory", tables, "inventory_id")
    kept = S.read_table(spark, tmp_dir, "inventory")
    assert {r.inventory_id for r in kept.collect()} == {2, 8}
    assert refused.count() == 7
    # what passed keeps every rule
    whole = stock.unionByName(kept)
    assert C.audit_unique(whole, ["product_id", "location_id"], "inventory").isEmpty()
    nothing = GT.judged(batch.limit(0), "inventory", tables, "inventory_id")
    assert nothing.count() == 0 and nothing.columns[-1] == "refusal"


def test_keys_of_two_parts_do_not_run_together(spark):
    df = spark.createDataFrame([(1, 11, 1), (2, 1, 11), (3, None, 1)], "id int, a bigint, b bigint")
    keys = {r.id: r.k for r in df.select("id", GT._key(["a", "b"]).alias("k")).collect()}
    assert keys[1] != keys[2] and keys[3] is None


def test_audits_of_a_change_equal_the_full_audits(spark):
    rng = random.Random(4)
    products = seed.products_df(spark, [(i, f"t{i}") for i in range(1, 40)])
    lines = [(i, rng.randint(1, 20), rng.randint(1, 39), rng.randint(1, 4)) for i in range(1, 200)]
    schema = "order_line_id bigint, order_id bigint, product_id bigint, fulfilled_from_location_id bigint"
    base = spark.createDataFrame(lines, schema)
    parents = {"orders": spark.range(1, 21).withColumnRenamed("id", "order_id"),
               "location": spark.range(1, 5).withColumnRenamed("id", "location_id")}
    fks = [fk[:4] for fk in S.FOREIGN_KEYS if fk[0] == "order_line"]
    assert C.audit_foreign_keys({"order_line": base, "music_product": products, **parents}, fks).isEmpty()
    for _ in range(3):
        gone = products.where(F.col("product_id").isin(rng.sample(range(1, 40), 5)))
        left = products.join(gone, "product_id", "left_anti")
        new = spark.createDataFrame([(rng.randint(190, 220), rng.randint(1, 25), rng.randint(1, 45),
                                      rng.choice([1, 2, 9, None])) for _ in range(30)], schema)
        after = {"order_line": stored(base.unionByName(new), "lines"), "music_product": left, **parents}
        full = sorted(map(tuple, C.audit_foreign_keys(after, fks).collect()))
        part = sorted(map(tuple, C.audit_foreign_keys_changed(
            after, fks, written={"order_line": new}, deleted={"music_product": gone}).collect()))
        assert part == full and full
        keys = ["order_line_id"]
        full = sorted(map(tuple, C.audit_unique(after["order_line"], keys, "order_line").collect()))
        part = sorted(map(tuple, C.audit_unique_changed(after["order_line"], keys, "order_line", new).collect()))
        assert part == full and full
        nulls = C.audit_not_null_changed({"order_line": new}, {"order_line": ["order_id", "product_id"]})
        assert {r.null_count for r in nulls.collect()} == {0}
    assert C.audit_foreign_keys_changed({"order_line": base}, fks, {}, {}).isEmpty()


def test_stock_keys_are_numbered_above_the_kept_ones(spark):
    inv = seed.inventory_df(spark, [(7, 44, 1, None, None, 5, None, None)])
    feed = seed.feed_df(spark, [(1, "INSERT", 13, None, None, None, 45, 1, 2),
                                (2, "INSERT", 13, None, None, None, 44, 1, 1),
                                (3, "INSERT", 13, None, None, None, 44, 2, 1)])
    out = L.apply_deltas(inv, L.change_delta(feed))
    assert sorted((r.inventory_id, r.product_id, r.location_id, r.quantity) for r in out.collect()) == [
        (7, 44, 1, 4), (8, 44, 2, -1), (9, 45, 1, -2)]


def test_a_batch_writes_and_moves_each_row_a_bounded_number_of_times(spark, tmp_dir, monkeypatch):
    """The parts of a batch are planned once: the caller's frames are read a single
    time each, refused requests never reach a join, and ledger rows are not written twice."""
    root = f"{tmp_dir}/state"
    products, locations = _opened(spark, root)
    from stockbook import session
    from stockbook.operators import keys, writes

    labels, columns = [], {}

    def noted(df, label):
        labels.append(label)
        columns[label] = df.columns
        return session.stored(df, label)

    for module in (G, W, keys, writes):
        monkeypatch.setattr(module, "stored", noted)
    requests = _requests(spark, [(1, "3", "44", "4", "1.5", "2"), (2, "77", "44", "1", "1", "1"),
                                 (3, "1", "45", "x", "1", "1"), (4, "1", "45", "6", "$3", "2")])
    batch = G.ChangeBatch("b1", new_lines=requests,
                          deleted_lines=spark.createDataFrame([(13,), (11,)], "order_line_id bigint"),
                          deleted_orders=spark.createDataFrame([(2,)], "order_id bigint"))
    assert G.apply_batch(spark, root, batch, products, locations, DAY)
    assert sorted(labels) == ["change-feed", "gone-lines", "judged-lines", "keys-inventory_id", "keys-order_line_id"]
    assert columns["gone-lines"] == ["order_line_id"]
    now = sinks.current_tables(spark, root, [*G.TABLES, G.REFUSED, G.APPLIED])
    assert sorted((r.order_line_id, r.quantity) for r in now["order_line"].collect()) == [(10, 5), (14, 4), (15, 6)]
    # line 11 went with its order: one change, not two
    assert [(r.movement_id, r.reference, r.quantity) for r in
            now["inventory_movement"].orderBy("movement_id").collect()] == [
        (1, "order 2", 3), (2, "order 2", 2), (3, "order 3", 9), (4, "order 3", 4), (5, "order 1", 6)]
    assert sorted((r.seq, r.reason) for r in now[G.REFUSED].collect()) == [
        (2, "unknown order"), (3, "quantity not an integer")]
    assert now[G.APPLIED].first().changes == 5
