"""Invoice documents.

An order may have any number of lines, so a document is never gathered into
one row: D1 gives one header row per order (bill-to, line count, total) and
the line items as their own rows; D2 prints the invoice as rows of text keyed
by (order_id, section, line_key), which sort into the printed order. Totals
are partial aggregations per order, so one huge order does not stall a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockbook.operators import reads as R
from stockbook.sources.schemas import TOTAL

# The printed layout (column widths, title cut, rule width).
TITLE_WIDTH, QTY_WIDTH, MONEY_WIDTH, RULE_WIDTH = 50, 5, 10, 80
TITLE_CUT, TOTAL_LABEL_WIDTH = 47, 70
NO_NAME = "(no name)"


def invoice_items(lines: DataFrame, products: DataFrame) -> DataFrame:
    """Item rows of every invoice (J1 without the order filter, unsorted)."""
    return R.line_titles(lines, products)


def invoices(orders: DataFrame, customers: DataFrame, lines: DataFrame,
             products: DataFrame) -> DataFrame:
    """One header row per order with line count and total (0 without lines)."""
    return _with_sums(orders, customers, invoice_items(lines, products))


def _with_sums(orders: DataFrame, customers: DataFrame, items: DataFrame) -> DataFrame:
    sums = items.groupBy("order_id").agg(F.count(F.lit(1)).alias("_n"),
                                         F.sum("line_total").alias("_t"))
    head = R.order_header(orders, customers).join(sums, "order_id", "left")
    return head.select(
        "order_id", "order_date", "customer_id", "first_name", "last_name", "street_address",
        "town", "zip", "country",
        F.coalesce("_n", F.lit(0)).cast("bigint").alias("line_count"),
        F.coalesce("_t", F.lit(0)).cast(TOTAL).alias("total"))


def _nonempty(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit("")) != "", c)


def _left(text: Column, width: int) -> Column:
    """Python '{:width}' for text: pad on the right, never cut."""
    return F.when(F.length(text) < width, F.rpad(text, width, " ")).otherwise(text)


def _right(text: Column, width: int) -> Column:
    """Python '{:>width}': pad on the left, never cut."""
    return F.when(F.length(text) < width, F.lpad(text, width, " ")).otherwise(text)


def _money(c: Column) -> Column:
    """'%.2f' of a two-decimal amount."""
    return c.cast(TOTAL).cast("string")


def invoice_text(orders: DataFrame, customers: DataFrame, lines: DataFrame,
                 products: DataFrame, shop_name: str = "Music Shop") -> DataFrame:
    """Printed invoices as (order_id, section, line_key, text) rows.

    Section 0 is the header (line_key 0..11, empty parts skipped), section 1
    the items (line_key = order_line_id), section 2 the rule and total.
    """
    items = invoice_items(lines, products)
    doc = _with_sums(orders, customers, items)
    name = F.concat_ws(" ", _nonempty(F.col("first_name")), _nonempty(F.col("last_name")))
    city = F.concat_ws(", ", _nonempty(F.col("town")), _nonempty(F.col("zip")))
    rule = "-" * RULE_WIDTH
    head_row = (f"{'Title':{TITLE_WIDTH}} {'Qty':>{QTY_WIDTH}} "
                f"{'Price':>{MONEY_WIDTH}} {'Total':>{MONEY_WIDTH}}")
    lit = F.lit
    header_parts = [
        (0, lit(shop_name)),
        (1, F.concat(lit("Invoice #: "), F.col("order_id").cast("string"))),
        (2, F.concat(lit("Date: "), F.coalesce(F.col("order_date").cast("string"), lit("None")))),
        (3, lit("")),
        (4, lit("Bill To:")),
        (5, F.when(name != "", name).otherwise(lit(NO_NAME))),
        (6, _nonempty(F.col("street_address"))),
        (7, F.when(city != "", city)),
        (8, _nonempty(F.col("country"))),
        (9, lit("")),
        (10, lit(head_row)),
        (11, lit(rule)),
    ]
    # header (section 0) and footer (section 2) come from one pass over doc
    total_line = F.concat(lit(" " * (TOTAL_LABEL_WIDTH - len("TOTAL")) + "TOTAL "),
                          _right(_money(F.col("total")), MONEY_WIDTH))
    parts = [(0, k, t) for k, t in header_parts] + [(2, 0, lit(rule)), (2, 1, total_line)]
    entries = F.array(*[F.struct(lit(sec).alias("section"), lit(k).cast("bigint").alias("line_key"),
                                 t.alias("text")) for sec, k, t in parts])
    framing = doc.select("order_id", F.explode(entries).alias("e")).select(
        "order_id", "e.section", "e.line_key", "e.text").where(F.col("text").isNotNull())

    title = F.col("title")
    short = F.when(F.length(title) > TITLE_WIDTH,
                   F.concat(F.substring(title, 1, TITLE_CUT), lit("..."))).otherwise(title)
    item_text = F.concat_ws(" ", _left(short, TITLE_WIDTH),
                            _right(F.col("quantity").cast("string"), QTY_WIDTH),
                            _right(_money(F.col("product_price")), MONEY_WIDTH),
                            _right(_money(F.col("line_total")), MONEY_WIDTH))
    body = items.select("order_id", lit(1).alias("section"),
                        F.col("order_line_id").alias("line_key"), item_text.alias("text"))

    return framing.unionByName(body).select(
        "order_id", F.col("section").cast("int").alias("section"),
        F.col("line_key").cast("bigint").alias("line_key"), "text")
