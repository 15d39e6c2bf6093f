"""Order-line changes as one unit: lines, ledger and stock are published together.

A batch (new lines, deleted lines, deleted orders) is turned into one change
feed, the feed into ledger rows and stock, and all of it becomes current with
one pointer (``sources.sinks``). Refused requests are kept with their reason.
The batches that were applied are a table of the same version, so a batch that is run again finds its id there and changes
nothing; a batch that lost a race is computed again from the newer version.

The order of a batch is the one in which a database would apply its parts:
deleted orders (with their lines), deleted lines, then new lines in request
order. New lines and ledger rows are appended to their tables; lines are
rewritten only by a batch that deletes some, stock always (it is bounded by
the stock keys).
"""

from __future__ import annotations

import datetime as _dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stockbook.operators import ledger as L
from stockbook.operators import writes as W
from stockbook.session import stored
from stockbook.sources import sinks

TABLES = ["orders", "order_line", "inventory", "inventory_movement"]
APPLIED = "applied_batches"
REFUSED = "refused_requests"
_APPLIED_SCHEMA = "batch_id string, changes bigint"
_REFUSED_SCHEMA = "batch_id string, seq bigint, reason string"
#: Changes of a later part of a batch come after all of an earlier one; line ids
#: and request numbers are below this.
_PART = 2**61


@dataclass
class ChangeBatch:
    """What a batch changes; any part may be absent.

    ``new_lines`` are raw add-line requests (W3), ``deleted_lines`` has
    ``order_line_id`` and ``deleted_orders`` has ``order_id``.
    """

    batch_id: str
    new_lines: DataFrame | None = None
    deleted_lines: DataFrame | None = None
    deleted_orders: DataFrame | None = None


def open_state(spark: SparkSession, root: str, orders: DataFrame, order_line: DataFrame,
               inventory: DataFrame, inventory_movement: DataFrame) -> str:
    """Publish the first version of the tables that change together."""
    return sinks.publish_tables(
        {"orders": orders, "order_line": order_line, "inventory": inventory,
         "inventory_movement": inventory_movement,
         APPLIED: spark.createDataFrame([], _APPLIED_SCHEMA),
         REFUSED: spark.createDataFrame([], _REFUSED_SCHEMA)}, root)


def change_feed(batch: ChangeBatch, state: dict[str, DataFrame], products: DataFrame,
                locations: DataFrame) -> dict[str, DataFrame | None]:
    """The tables after the deletions, the new lines, the feed of all changes in
    order of ``seq`` (read from written tables) and the report of the add-line requests."""
    orders, lines = state["orders"], state["order_line"]
    parts: list[DataFrame] = []
    gone_orders = batch.deleted_orders is not None
    gone_lines = gone_orders or batch.deleted_lines is not None
    if gone_orders:
        orders, lines, feed = W.delete_orders(batch.deleted_orders, orders, lines,
                                              by_line=batch.deleted_lines is not None)
        parts.append(feed.withColumn("_part", F.lit(0)))
    if batch.deleted_lines is not None:
        lines, feed = W.delete_lines(batch.deleted_lines, lines)
        parts.append(feed.withColumn("_part", F.lit(1)))
    new, report = None, None
    if batch.new_lines is not None:
        # ids go on above all lines, those that this batch deletes included
        new, feed, report = W.add_order_lines(batch.new_lines, lines, products, orders, locations,
                                              numbered=state["order_line"])
        new = new.select(*lines.columns)  # line_total is derived on read
        parts.append(feed.withColumn("_part", F.lit(2)))
    feed = None
    if gone_lines:  # written once; the feed of the new lines reads a written table already
        feed = stored(_union(parts[:-1] if batch.new_lines is not None else parts), "change-feed")
    if batch.new_lines is not None:
        feed = parts[-1] if feed is None else feed.unionByName(parts[-1])
    feed = feed.withColumn("seq", F.col("seq") + F.col("_part") * F.lit(_PART)).drop("_part")
    return {"orders": orders if gone_orders else None, "order_line": lines if gone_lines else None,
            "new_lines": new, "feed": feed, "report": report}


def _union(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def apply_batch(spark: SparkSession, root: str, batch: ChangeBatch, products: DataFrame,
                locations: DataFrame, movement_date: _dt.datetime | str | Column,
                attempts: int = 5) -> bool:
    """Apply ``batch`` to the current version under ``root`` and publish the next one.

    Returns False, and changes nothing, if a batch of this id was applied
    before. When another writer publishes in between, the batch is computed
    again from that version, up to ``attempts`` times.
    """
    for attempt in range(attempts):
        number = sinks.current_number(spark, root)
        state = sinks.current_tables(spark, root, [*TABLES, APPLIED])
        if not state[APPLIED].where(F.col("batch_id") == batch.batch_id).isEmpty():
            return False
        if all(x is None for x in (batch.new_lines, batch.deleted_lines, batch.deleted_orders)):
            return False
        made = change_feed(batch, state, products, locations)
        feed = made["feed"]
        deltas = L.change_delta(feed)
        ledger = L.movement_ledger(deltas, movement_date, existing=state["inventory_movement"], written=True)
        replaced = {"inventory": L.apply_deltas(state["inventory"], deltas)}
        replaced |= {n: made[n] for n in ("orders", "order_line") if made[n] is not None}
        added = {"inventory_movement": ledger,
                 APPLIED: spark.createDataFrame([(batch.batch_id, feed.count())], _APPLIED_SCHEMA)}
        if made["report"] is not None:
            added[REFUSED] = made["report"].where(F.col("reason").isNotNull()).select(
                F.lit(batch.batch_id).alias("batch_id"), "seq", "reason")
        if made["new_lines"] is not None:
            if "order_line" in replaced:
                replaced["order_line"] = replaced["order_line"].unionByName(made["new_lines"])
            else:
                added["order_line"] = made["new_lines"]
        try:
            sinks.publish_tables(replaced, root, added=added, based_on=number)
            return True
        except sinks.Conflict:
            if attempt + 1 == attempts:
                raise
    return False

