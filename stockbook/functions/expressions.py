"""Column expressions shared by the operators.

All of these are built-in Catalyst expressions (no Python UDF), so they stay
inside whole-stage code generation wherever they are used.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockbook.sources.schemas import MONEY

ColumnLike = Column | str

# Priority of category ids when one product has several
# categories (first = highest priority); every other id ranks 99.
CATEGORY_PRIORITY: tuple[int, ...] = (4, 5, 3, 1, 2)
OTHER_CATEGORY_RANK = 99

# Movement types written to the stock ledger.
SALE = "sale"
SALE_ADJUST_INCREASE = "sale_adjust_increase"
SALE_ADJUST_DECREASE = "sale_adjust_decrease"
SALE_CANCEL = "sale_cancel"

# Placeholder choices that mean "no filter" in a search form,
# and the "no value" choice of a product form.
ANY_SENTINELS: tuple[str, ...] = ("(Any category)", "(Any media)", "(Any type)")
NONE_CHOICE = "(None)"

# Python's int() accepts an optional sign, ASCII digits and single
# underscores between digits, surrounded by white space.
_INT_PATTERN = r"^[+-]?[0-9]+(_[0-9]+)*$"
# Python's float() for finite decimal text (no inf / nan: they cannot be
# stored in a numeric(10,2) column).
_DEC_PATTERN = (r"^[+-]?([0-9]+(_[0-9]+)*(\.([0-9]+(_[0-9]+)*)?)?|\.[0-9]+(_[0-9]+)*)"
                r"([eE][+-]?[0-9]+(_[0-9]+)*)?$")


def _c(col: ColumnLike) -> Column:
    return F.col(col) if isinstance(col, str) else col


# The characters Python's str.strip() removes, derived from str.isspace().
PY_WHITESPACE = "".join(ch for ch in map(chr, range(0x110000)) if ch.isspace())


def strip(col: ColumnLike) -> Column:
    """Python's str.strip(): remove leading/trailing white space of every kind
    (Spark's one-argument trim only removes blanks). A set trim, no regex."""
    return F.btrim(_c(col), F.lit(PY_WHITESPACE))


def is_blank(col: ColumnLike) -> Column:
    """NULL or only white space."""
    return F.coalesce(strip(col) == F.lit(""), F.lit(True))


def blank_to_null(col: ColumnLike) -> Column:
    """V6 for product / bin / rack / code fields: stripped, '' becomes NULL."""
    s = strip(col)
    return F.when(s == F.lit(""), F.lit(None).cast("string")).otherwise(s)


def choice_to_null(col: ColumnLike) -> Column:
    """Form choice: stripped, '' and '(None)' become NULL."""
    s = blank_to_null(col)
    return F.when(s == F.lit(NONE_CHOICE), F.lit(None).cast("string")).otherwise(s)


def parses_as_int(col: ColumnLike) -> Column:
    """True when the text is an integer by Python's int() rules."""
    return F.coalesce(strip(col).rlike(_INT_PATTERN), F.lit(False))


def parse_int(col: ColumnLike, dtype: str = "bigint") -> Column:
    """Integer value of text accepted by ``parses_as_int`` (else NULL)."""
    s = strip(col)
    return F.when(s.rlike(_INT_PATTERN),
                  F.regexp_replace(s, "_", "").try_cast(dtype))


def clean_price_text(col: ColumnLike) -> Column:
    """V5 first half: drop '$' and ',' then strip."""
    return strip(F.regexp_replace(_c(col), r"[$,]", ""))


def parses_as_number(col: ColumnLike) -> Column:
    return F.coalesce(clean_price_text(col).rlike(_DEC_PATTERN), F.lit(False))


def decimal_from_text(text: ColumnLike) -> Column:
    """Number text (already matching the decimal pattern) -> DECIMAL(10,2).

    Plain decimals are parsed exactly (half-up rounding). Text with an
    exponent goes through a double first, as Python's float() does: a direct
    cast rejects forms such as '0E38' whose exponent exceeds the scale."""
    t = F.regexp_replace(_c(text), "_", "")
    return (F.when(t.rlike("[eE]"), t.try_cast("double").try_cast(MONEY))
            .otherwise(t.try_cast(MONEY)))


def clean_price(col: ColumnLike) -> Column:
    """V5: price text -> DECIMAL(10,2); NULL when not a number or too large."""
    s = clean_price_text(col)
    return F.when(s.rlike(_DEC_PATTERN), decimal_from_text(s))


def line_total(price: ColumnLike = "product_price", qty: ColumnLike = "quantity") -> Column:
    """generated column price * quantity as numeric(10,2) (overflow raises)."""
    return (_c(price).cast(MONEY) * _c(qty)).cast(MONEY)


def with_line_total(lines: DataFrame) -> DataFrame:
    return lines.withColumn("line_total", line_total())


def category_rank(col: ColumnLike = "category_id",
                  order: Sequence[int] = CATEGORY_PRIORITY) -> Column:
    """M2: rank of a category id in the priority list, 99 when absent."""
    pos = F.array_position(F.array(*[F.lit(int(x)) for x in order]), _c(col))
    return F.when(pos == 0, F.lit(OTHER_CATEGORY_RANK)).otherwise(pos.cast("int"))


def movement_type(op: ColumnLike, delta: ColumnLike) -> Column:
    """T4: ledger movement type from the change kind and the quantity delta."""
    op, delta = _c(op), _c(delta)
    return (F.when((op == "INSERT") & (delta > 0), F.lit(SALE))
            .when((op == "UPDATE") & (delta > 0), F.lit(SALE_ADJUST_INCREASE))
            .when((op == "UPDATE") & (delta < 0), F.lit(SALE_ADJUST_DECREASE))
            .when(op == "DELETE", F.lit(SALE_CANCEL))
            .otherwise(F.lit(SALE)))


def signed_ledger_qty(movement: ColumnLike, qty: ColumnLike) -> Column:
    """Stock effect of a ledger row: sales and increases take stock out."""
    m = _c(movement)
    out = m.isin(SALE, SALE_ADJUST_INCREASE)
    back = m.isin(SALE_ADJUST_DECREASE, SALE_CANCEL)
    return (F.when(out, -_c(qty)).when(back, _c(qty)).otherwise(F.lit(0))).cast("bigint")


def normalise_title(col: ColumnLike) -> Column:
    """Lower-case, keep only ASCII letters and digits (staging title matching)."""
    return F.regexp_replace(F.lower(_c(col)), "[^a-z0-9]", "")


def duration_parts(col: ColumnLike) -> Column:
    """'[8:00; 7:30]' -> array of per-movement seconds (NULL entries if malformed
    or beyond 64 bits)."""
    body = F.regexp_replace(_c(col), r"^\s*\[|\]\s*$", "")
    parts = F.filter(F.split(body, ";"), lambda p: strip(p) != F.lit(""))

    def seconds(p: Column) -> Column:
        units = F.split(strip(p), ":")
        zero, sixty = F.lit(0).cast("bigint"), F.lit(60).cast("bigint")
        return F.aggregate(units, zero, lambda acc, u: F.try_add(
            F.try_multiply(acc, sixty), strip(u).try_cast("bigint")))

    return F.transform(parts, seconds)


def format_seconds(total: ColumnLike) -> Column:
    """Seconds -> 'm:ss' (minutes not padded, seconds two digits)."""
    t = _c(total)
    return F.concat(F.floor(t / F.lit(60)).cast("string"), F.lit(":"),
                    F.lpad((t % F.lit(60)).cast("string"), 2, "0"))
