from __future__ import annotations

import random

from pyspark.sql import functions as F

from stockbook.operators import ledger as L
from tests import seed

MOVED = "2025-12-04 00:00:00"


def _inserts_from_seed():
    return [(lid, "INSERT", oid, None, None, None, pid, loc, qty)
            for lid, oid, pid, _, qty, loc in seed.LINES]


def test_seed_lines_give_seed_ledger(spark):
    feed = seed.feed_df(spark, _inserts_from_seed())
    led = L.movement_ledger(L.change_delta(feed), MOVED).orderBy("movement_id").collect()
    assert len(led) == 18
    assert [r.movement_id for r in led] == list(range(1, 19))
    assert {r.movement_type for r in led} == {"sale"}
    assert all(r.from_location_id == 1 and r.to_location_id is None for r in led)
    by_ref = [(r.product_id, r.quantity, r.reference) for r in led]
    assert by_ref[0] == (59, 1, "order 6")
    assert (54, 2, "order 15") in by_ref
    assert by_ref[-1] == (69, 1, "order 22")


def test_trigger_oddities(spark):
    rows = [
        # (i) moved to another product: only the quantity change, at the new product
        (1, "UPDATE", 100, 1, 1, 3, 2, 1, 5),
        # (ii) location cleared on update: still posted to the old location
        (2, "UPDATE", 101, 3, 2, 1, 3, None, 4),
        # (iii) negative insert: typed 'sale' with a positive quantity
        (3, "INSERT", 102, None, None, None, 4, 1, -2),
        # (iv) delete of a negative line: 'sale_cancel'
        (4, "DELETE", 103, 5, 1, -1, None, None, None),
        # (v) update without quantity change: no ledger row, but a stock row
        (5, "UPDATE", 104, 6, 3, 2, 6, 3, 2),
        # no location at all: ignored
        (6, "INSERT", 105, None, None, None, 7, None, 9),
    ]
    feed = seed.feed_df(spark, rows)
    d = L.change_delta(feed)
    led = {r.seq: (r.product_id, r.from_location_id, r.quantity, r.movement_type)
           for r in L.ledger_rows(d, MOVED).collect()}
    assert led == {1: (2, 1, 2, "sale_adjust_increase"), 2: (3, 2, 3, "sale_adjust_increase"),
                   3: (4, 1, 2, "sale"), 4: (5, 1, 1, "sale_cancel")}
    inv = seed.inventory_df(spark, [(1, 1, 1, None, None, 10, None, None)])
    after = {(r.product_id, r.location_id): r.quantity
             for r in L.apply_deltas(inv, d).collect()}
    assert after == {(1, 1): 10, (2, 1): -2, (3, 2): -3, (4, 1): 2, (5, 1): -1, (6, 3): 0}


# One change each: what it posts to the ledger (product, place, amount, kind) and to stock.
CASES = [
    # (op, old image, new image) -> ledger entry or None, ((product, place), stock change) or None
    (("INSERT", (None, None, None), (1, 1, 4)), (1, 1, 4, "sale"), ((1, 1), -4)),
    (("INSERT", (None, None, None), (1, 1, -3)), (1, 1, 3, "sale"), ((1, 1), 3)),
    (("INSERT", (None, None, None), (1, 1, 0)), None, ((1, 1), 0)),
    (("INSERT", (None, None, None), (1, None, 4)), None, None),
    (("UPDATE", (1, 1, 2), (1, 1, 5)), (1, 1, 3, "sale_adjust_increase"), ((1, 1), -3)),
    (("UPDATE", (1, 1, 5), (1, 1, 2)), (1, 1, 3, "sale_adjust_decrease"), ((1, 1), 3)),
    (("UPDATE", (1, 1, 5), (2, 2, 5)), None, ((2, 2), 0)),
    (("UPDATE", (1, 1, 5), (2, 2, 6)), (2, 2, 1, "sale_adjust_increase"), ((2, 2), -1)),
    (("UPDATE", (1, 1, 5), (None, None, 6)), (1, 1, 1, "sale_adjust_increase"), ((1, 1), -1)),
    (("UPDATE", (1, None, 5), (1, None, 6)), None, None),
    (("UPDATE", (1, 1, None), (1, 1, 6)), (1, 1, 6, "sale_adjust_increase"), ((1, 1), -6)),
    (("UPDATE", (1, 1, 6), (1, 1, None)), (1, 1, 6, "sale_adjust_decrease"), ((1, 1), 6)),
    (("DELETE", (1, 1, 5), (None, None, None)), (1, 1, 5, "sale_cancel"), ((1, 1), 5)),
    (("DELETE", (1, 1, -5), (None, None, None)), (1, 1, 5, "sale_cancel"), ((1, 1), -5)),
    (("DELETE", (1, 1, 0), (None, None, None)), None, ((1, 1), 0)),
    (("DELETE", (None, 1, 5), (None, None, None)), None, None),
]


def test_each_kind_of_change(spark):
    feed = seed.feed_df(spark, [(k, op, 9, *old, *new) for k, ((op, old, new), _, _) in enumerate(CASES, 1)])
    d = L.change_delta(feed)
    posted = {r.seq: (r.product_id, r.from_location_id, r.quantity, r.movement_type)
              for r in L.ledger_rows(d, MOVED).collect()}
    assert posted == {k: entry for k, (_, entry, _) in enumerate(CASES, 1) if entry}
    moved = {r.seq: ((r.product_id, r.location_id), -r.delta) for r in d.collect()}
    assert moved == {k: change for k, (_, _, change) in enumerate(CASES, 1) if change}


def test_random_batches_keep_the_invariants(spark):
    rng = random.Random(7)
    rows, want = [], {(1, 1): 50, (2, 2): 5}
    for seq in range(1, 400):  # any mix of the cases above adds up, in any order
        (op, old, new), _, change = rng.choice(CASES)
        rows.append((seq, op, seq % 7, *old, *new))
        if change:
            want[change[0]] = want.get(change[0], 0) + change[1]
    rng.shuffle(rows)
    inv = seed.inventory_df(spark, [(1, 1, 1, None, None, 50, None, None), (2, 2, 2, None, None, 5, None, None)])
    d = L.change_delta(seed.feed_df(spark, rows))
    after = L.apply_deltas(inv, d).collect()
    assert {(r.product_id, r.location_id): r.quantity for r in after} == want
    assert len({r.inventory_id for r in after}) == len(after)
    ledger = L.ledger_rows(d, MOVED)
    assert ledger.where("quantity <= 0").count() == 0
    assert ledger.count() == d.where("delta <> 0").count()


def test_new_stock_rows_get_dense_ids(spark):
    inv = seed.inventory_df(spark, [(10, 1, 1, None, None, 5, None, None)])
    rows = [(i, "INSERT", 1, None, None, None, p, 1, 1) for i, p in enumerate([3, 2, 1, 4], 1)]
    out = L.apply_deltas(inv, L.change_delta(seed.feed_df(spark, rows))).collect()
    ids = {r.product_id: r.inventory_id for r in out}
    assert ids == {1: 10, 2: 11, 3: 12, 4: 13}


def test_reconcile_lists_unlogged_changes(spark):
    opening = seed.inventory_df(spark, [(1, 1, 1, None, None, 10, None, None),
                                        (2, 2, 1, None, None, 5, None, None)])
    ledger = spark.createDataFrame(
        [(1, 1, 1, None, 3, "sale", None, "order 1"), (2, 1, 1, None, 1, "sale_cancel", None, "x")],
        "movement_id bigint, product_id bigint, from_location_id bigint, to_location_id bigint,"
        " quantity int, movement_type string, movement_date timestamp_ntz, reference string")
    actual = seed.inventory_df(spark, [(1, 1, 1, None, None, 8, None, None),
                                       (2, 2, 1, None, None, 6, None, None)])
    out = [(r.product_id, r.expected_qty, r.actual_qty, r.difference)
           for r in L.reconcile(opening, ledger, actual).collect()]
    assert out == [(2, 5, 6, 1)]


def _staging(spark, rows):
    from stockbook.sources.schemas import STAGING
    return spark.createDataFrame(rows, STAGING)


def test_resolve_staging_and_roll_up(spark):
    products = seed.products_df(spark, [
        (18, "Sextet for Winds 1011-1110 (score & parts)", {"halstan_code": "W1 15"}),
        (76, "*Concerto for trumpet & viola 1001-0000 – strings full score",
         {"halstan_code": "W1 83"}),
        (30, "Trio No. 1", {"halstan_code": "W1 50"}),
        (31, "Trio No. 2", {"halstan_code": "W1 50"}),
    ])
    staging = _staging(spark, [
        ("Sextet for Wind", "W1 77", 180, 12, "4", None, 69, None),
        ("Jonah - score & parts", "W1 15", 110, 3, "2", None, 15, None),
        ("Concerto for Trumpet & Viola", "W1 20", 35, 1, "3", None, 19, None),
        ("Concerto for Trumpet & Viola", "W1 83", 270, 7, "4", None, 75, None),
        ("Trio", "W1 50", 5, 1, "1", None, 80, None),       # code and title both ambiguous
        ("Nothing like it", None, 1, 1, "1", None, 81, None),
    ])
    res = {r.staging_id: (r.product_id, r.match, r.status)
           for r in L.resolve_staging(staging, products).collect()}
    assert res == {69: (18, "title", "resolved"), 15: (18, "code", "resolved"),
                   19: (76, "title", "resolved"), 75: (76, "code", "resolved"),
                   80: (None, None, "quarantined"), 81: (None, None, "quarantined")}
    inv = {r.product_id: (r.quantity, r.h_bin_num, r.parcel_qty, r.halstan_code)
           for r in L.staging_to_inventory(L.resolve_staging(staging, products)).collect()}
    assert inv == {18: (290, "4", 12, "W1 77"), 76: (305, "4", 7, "W1 83")}


def test_normalise_duration(spark):
    products = seed.products_df(spark, [
        (44, "x", {"duration": "[8:00; 7:30; 7:00]", "no_of_movements": 3,
                   "duration_seconds": 1350, "duration_formatted": "22:30"}),
        (31, "y", {"duration": "[0:55]", "no_of_movements": 1, "duration_seconds": 55}),
        (5, "z", {"duration": "[1:02:03]", "duration_seconds": 10}),
        (6, "w"),
        (7, "v", {"duration": "[99999999:00]"}),
        (8, "u", {"duration": "[x:00]"}),
        (9, "t", {"duration": "[1:00; 99999999999999999999:00]"}),
    ])
    got = {r.product_id: (r.movements, r.seconds, r.formatted, r.consistent)
           for r in L.normalise_duration(products).collect()}
    assert got == {44: (3, 1350, "22:30", True), 31: (1, 55, "0:55", True),
                   5: (1, 3723, "62:03", False), 7: (1, 5999999940, "99999999:00", True),
                   8: (1, None, None, False), 9: (2, None, None, False)}
    bad = L.normalise_duration(products).where("malformed").collect()
    assert {r.product_id for r in bad} == {8, 9}


def test_titles_that_begin_alike(spark):
    """Equal titles, a title that is the beginning of others, hot beginnings, characters in order."""
    titles = ["Ab", "Abc", "Abc", "abd 1", "ABD 2", "b", "zz9", "zz", "", "???", "a0", "9"]
    titles += [f"hot start {i:03d}" for i in range(60)]
    products = seed.products_df(spark, list(enumerate(titles, 1)))
    asked = ["ab", "abc", "abd", "abd1", "b", "z", "zz", "zz9", "", "!", "hot start 0", "hot start 017",
             "hot", "a", "9", "c", "abc", None]
    staging = _staging(spark, [(t, None, 1, 1, None, None, k, None) for k, t in enumerate(asked)])

    def norm(t):
        return "".join(c for c in (t or "").lower() if c in "abcdefghijklmnopqrstuvwxyz0123456789")

    want = {}
    for k, t in enumerate(asked):
        hits = [i for i, x in enumerate(titles, 1) if norm(t) and norm(x).startswith(norm(t))]
        want[k] = hits[0] if len(hits) == 1 else None
    got = {r.staging_id: r.product_id for r in L.resolve_staging(staging, products).collect()}
    assert got == want


def test_net_deltas_skew_uses_partial_aggregation(spark):
    rows = [(i, "INSERT", 1, None, None, None, 1, 1, 1) for i in range(1, 200)]
    d = L.change_delta(seed.feed_df(spark, rows))
    plan = L.net_deltas(d)._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum" in plan
    assert L.net_deltas(d).collect()[0].net_delta == 199
    assert d.where(F.col("delta") != 1).count() == 0
