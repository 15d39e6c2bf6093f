from __future__ import annotations

import datetime as dt
import os
import random

import pyarrow as pa
import pyarrow.parquet as pq

from stockbook.operators import ledger as L
from stockbook.sources import bindings as B
from stockbook.streaming import streams as X


def _write_event_files(folder: str, n_files: int, per_file: int, seed: int = 5) -> None:
    rng = random.Random(seed)
    eid = 0
    for f in range(n_files):
        rows = {"event_id": [], "ts": [], "user_id": [], "event_type": [], "value": [], "props": []}
        for _ in range(per_file):
            rows["event_id"].append(eid)
            rows["ts"].append(dt.datetime(2024, 1, 1) + dt.timedelta(seconds=eid))
            rows["user_id"].append(rng.randint(0, 5))
            rows["event_type"].append(rng.choice(["purchase", "view", "error", "click", "signup"]))
            rows["value"].append(rng.uniform(0, 9))
            rows["props"].append("{}")
            eid += 1
        table = pa.table(rows, schema=pa.schema([
            ("event_id", pa.int64()), ("ts", pa.timestamp("us")), ("user_id", pa.int64()),
            ("event_type", pa.string()), ("value", pa.float64()), ("props", pa.string())]))
        pq.write_table(table, os.path.join(folder, f"events-{f}.parquet"))
    # a file the glob must skip
    pq.write_table(pa.table({"x": [1]}), os.path.join(folder, "other.parquet"))


def test_stream_results_equal_batch(spark, tmp_dir):
    src = os.path.join(tmp_dir, "src")
    os.makedirs(src)
    _write_event_files(src, n_files=3, per_file=40)
    batch_feed = B.stream_feed_source(
        spark, spark.read.schema(X.EVENTS_SCHEMA).parquet(*[
            os.path.join(src, f"events-{i}.parquet") for i in range(3)]))

    stream = X.read_change_stream(spark, src, "events-*.parquet", B.stream_feed_source)
    ledger_path = X.run_ledger_stream(stream, "2024-01-01 00:00:00",
                                      sink=os.path.join(tmp_dir, "ledger"))
    rows = X.read_ledger_stream(spark, ledger_path)
    got = sorted(tuple(r) for r in rows.drop("seq").collect())
    want = sorted(tuple(r) for r in L.movement_ledger(L.change_delta(batch_feed),
                                                      "2024-01-01 00:00:00").collect())
    assert got == want and len(got) > 0  # the ids included

    stream = X.read_change_stream(spark, src, "events-*.parquet", B.stream_feed_source,
                                  max_files_per_trigger=1)
    data = X.run_stock_stream(stream, sink=os.path.join(tmp_dir, "stock"))
    assert len(X.stock_parts(spark, data)) == 3  # one micro-batch per file, because asked for
    got = {(r.product_id, r.location_id): r.net_delta
           for r in X.read_stock_stream(spark, data).collect()}
    want = {(r.product_id, r.location_id): r.net_delta
            for r in L.net_deltas(L.change_delta(batch_feed)).collect()}
    assert got == want
    small = X.compact_stock_stream(spark, data)
    assert {(r.product_id, r.location_id): r.net_delta
            for r in X.read_stock_stream(spark, small).collect()} == want
    assert [p.split("/")[-1] for p in X.stock_parts(spark, small)] == ["part-0-0"]


def test_stream_without_input(spark, tmp_dir):
    src = os.path.join(tmp_dir, "src")
    os.makedirs(src)
    stream = X.read_change_stream(spark, src, "events-*.parquet", B.stream_feed_source)
    data = X.run_stock_stream(stream, sink=os.path.join(tmp_dir, "stock"))
    assert X.read_stock_stream(spark, data).count() == 0


def test_stream_stock_with_opening_equals_batch_apply(spark, tmp_dir):
    from tests import seed
    src = os.path.join(tmp_dir, "src")
    os.makedirs(src)
    _write_event_files(src, n_files=2, per_file=30, seed=11)
    opening = seed.inventory_df(spark, [(1, 1, 2, None, None, 40, None, None),
                                        (2, 3, 1, None, None, 9, None, None)])
    stream = X.read_change_stream(spark, src, "events-*.parquet", B.stream_feed_source)
    data = X.run_stock_stream(stream, sink=os.path.join(tmp_dir, "stock"), opening=opening)
    got = {(r.product_id, r.location_id): r.quantity for r in X.read_stock_stream(spark, data).collect()}
    batch_feed = B.stream_feed_source(spark, spark.read.schema(X.EVENTS_SCHEMA).parquet(
        *[os.path.join(src, f"events-{i}.parquet") for i in range(2)]))
    want = {(r.product_id, r.location_id): r.quantity
            for r in L.apply_deltas(opening, L.change_delta(batch_feed)).collect()}
    # keys untouched by the stream keep their opening stock and are not rewritten
    assert {k: v for k, v in want.items() if k in got} == got
    assert set(want) - set(got) <= {(1, 2), (3, 1)}


def test_ledger_ids_go_on_from_batch_to_batch(spark, tmp_dir):
    src = os.path.join(tmp_dir, "src")
    os.makedirs(src)
    _write_event_files(src, n_files=4, per_file=30)
    feed = B.stream_feed_source(spark, spark.read.schema(X.EVENTS_SCHEMA).parquet(
        *[os.path.join(src, f"events-{i}.parquet") for i in range(4)]))
    stream = X.read_change_stream(spark, src, "events-*.parquet", B.stream_feed_source,
                                  max_files_per_trigger=1)
    sink = os.path.join(tmp_dir, "ledger")
    data = X.run_ledger_stream(stream, "2024-01-01 00:00:00", sink=sink, first_id=101)
    got = {r.seq: r.movement_id for r in X.read_ledger_stream(spark, data).collect()}
    want = [r.seq for r in L.ledger_rows(L.change_delta(feed), "2024-01-01 00:00:00").orderBy("seq").collect()]
    assert sorted(got.values()) == list(range(101, 101 + len(want))) and set(got) == set(want)
    # files may come in any order, but a batch's ids are one run in the order of its changes
    for n in range(4):
        rows = spark.read.parquet(f"{data}/batch-{n}").orderBy("seq").collect()
        ids = [r.movement_id for r in rows]
        assert ids == list(range(ids[0], ids[0] + len(ids)))
    # a lost last commit: the micro-batch is run again and repeats its ids
    for name in ("3", ".3.crc"):
        os.remove(os.path.join(sink, "_checkpoint", "commits", name))
    X.run_ledger_stream(stream, "2024-01-01 00:00:00", sink=sink, first_id=101)
    assert {r.seq: r.movement_id for r in X.read_ledger_stream(spark, data).collect()} == got


def test_stock_updates_are_merged_by_levels(spark, tmp_dir, monkeypatch):
    monkeypatch.setattr(X, "FANOUT", 2)
    src = os.path.join(tmp_dir, "src")
    os.makedirs(src)
    _write_event_files(src, n_files=7, per_file=12)
    feed = B.stream_feed_source(spark, spark.read.schema(X.EVENTS_SCHEMA).parquet(
        *[os.path.join(src, f"events-{i}.parquet") for i in range(7)]))
    stream = X.read_change_stream(spark, src, "events-*.parquet", B.stream_feed_source,
                                  max_files_per_trigger=1)
    data = X.run_stock_stream(stream, sink=os.path.join(tmp_dir, "stock"))
    parts = [p.split("/")[-2:] for p in X.stock_parts(spark, data)]
    assert parts == [["level-2", "part-0-3"], ["level-1", "part-4-5"], ["level-0", "part-6-6"]]
    got = {(r.product_id, r.location_id): r.net_delta for r in X.read_stock_stream(spark, data).collect()}
    assert got == {(r.product_id, r.location_id): r.net_delta
                   for r in L.net_deltas(L.change_delta(feed)).collect()}
