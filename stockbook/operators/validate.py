"""Validation and cleaning: raw text requests -> typed rows with a reject reason.

Each validator adds a ``reason`` column (NULL = accepted) computed in one
projection: the first failing check wins, in the order the form checks them.
Splitting accepted from rejected rows is two filters over the same plan
(``split_valid``); nothing is collected.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockbook.functions import expressions as X
from stockbook.operators.joins import left_join_present


def _first_failure(checks: Sequence[tuple[Column, str]]) -> Column:
    """CASE WHEN c1 THEN r1 WHEN c2 THEN r2 ... END (NULL when all pass)."""
    expr = None
    for cond, reason in checks:
        expr = F.when(cond, F.lit(reason)) if expr is None else expr.when(cond, F.lit(reason))
    return expr if expr is not None else F.lit(None).cast("string")


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted rows without ``reason``, rejected rows with it)."""
    ok = df.where(F.col("reason").isNull()).drop("reason")
    bad = df.where(F.col("reason").isNotNull())
    return ok, bad


_INT_RE = X._INT_PATTERN
_DEC_RE = X._DEC_PATTERN


def _stripped(raw: DataFrame, fields: Sequence[str], keep: Sequence[str] = ("seq",)) -> DataFrame:
    """One projection that strips every field once (``_s_<field>``)."""
    return raw.select(*keep, *[X.strip(c).alias(f"_s_{c}") for c in fields])


def _s(c: str) -> Column:
    return F.col(f"_s_{c}")


def _blank(c: str) -> Column:
    return F.coalesce(_s(c) == F.lit(""), F.lit(True))


def _int_ok(c: str) -> Column:
    return F.coalesce(_s(c).rlike(_INT_RE), F.lit(False))


def _int_value(c: str, ok: Column, dtype: str = "bigint") -> Column:
    return F.when(ok, F.regexp_replace(_s(c), "_", "").try_cast(dtype))


def validate_keys(raw: DataFrame, raw_col: str, out_col: str,
                  label: str | None = None) -> DataFrame:
    """V7: a key field must be present, an integer, and fit 64 bits.

    Adds the typed key as ``out_col`` (replacing a column of that name) and
    ``reason``; both are computed from the raw text column.
    """
    name = label or out_col
    keep = [c for c in raw.columns if c not in (out_col, "reason")]
    st = raw.select(*keep, X.strip(raw_col).alias("_s_key"))
    flags = st.select("*", _int_ok("key").alias("_ok_key"))
    typed = flags.select("*", _int_value("key", F.col("_ok_key")).alias("_v_key"))
    reason = _first_failure([
        (_blank("key"), f"{name} required"),
        (~F.col("_ok_key"), f"{name} not an integer"),
        (F.col("_v_key").isNull(), f"{name} out of range"),
    ])
    return typed.select(*keep, F.col("_v_key").alias(out_col), reason.alias("reason"))


def validate_order_lines(raw: DataFrame) -> DataFrame:
    """V1: raw add-line requests (order_id, product_id, quantity, price,
    location_id as text) -> typed columns + reason.

    Three narrow projections: strip each field once, test each pattern once,
    then pick the first failing check from plain boolean columns.
    """
    ints = ["order_id", "product_id", "quantity", "location_id"]
    st = _stripped(raw, [*ints, "price"]).withColumn(
        "_p", X.strip(F.regexp_replace(_s("price"), "[$,]", "")))
    flags = st.select(
        "*", *[_int_ok(c).alias(f"_ok_{c}") for c in ints],
        F.coalesce(F.col("_p").rlike(_DEC_RE), F.lit(False)).alias("_ok_price"))
    typed = flags.select(
        "*",
        _int_value("order_id", F.col("_ok_order_id")).alias("order_id"),
        _int_value("product_id", F.col("_ok_product_id")).alias("product_id"),
        _int_value("quantity", F.col("_ok_quantity"), "int").alias("quantity"),
        F.when(F.col("_ok_price"), X.decimal_from_text("_p"))
         .alias("product_price"),
        _int_value("location_id", F.col("_ok_location_id")).alias("fulfilled_from_location_id"))
    reason = _first_failure([
        (_blank("order_id"), "order_id required"),
        (_blank("product_id"), "product_id required"),
        (_blank("quantity"), "quantity required"),
        (_blank("price"), "price required"),
        (F.lower(_s("price")) == F.lit("none"), "price not set in catalogue"),
        (_blank("location_id"), "location_id required"),
        (~F.col("_ok_order_id"), "order_id not an integer"),
        (~F.col("_ok_product_id"), "product_id not an integer"),
        (~F.col("_ok_quantity"), "quantity not an integer"),
        (~F.col("_ok_price"), "price not a number"),
        (~F.col("_ok_location_id"), "location_id not an integer"),
        (F.col("product_price").isNull(), "price out of range"),
        (F.col("quantity").isNull(), "quantity out of range"),
        (F.col("order_id").isNull(), "order_id out of range"),
        (F.col("product_id").isNull(), "product_id out of range"),
        (F.col("fulfilled_from_location_id").isNull(), "location_id out of range"),
    ])
    return typed.select("seq", "order_id", "product_id", "quantity", "product_price",
                        "fulfilled_from_location_id", reason.alias("reason"))


CUSTOMER_FIELDS: tuple[str, ...] = ("first_name", "last_name", "email_addr", "phone",
                                    "street_address", "town", "zip", "country")


def validate_customers(raw: DataFrame) -> DataFrame:
    """V2: at least a first or a last name; blank fields stay '' (not NULL)."""
    cleaned = [F.coalesce(X.strip(c), F.lit("")).alias(c) for c in CUSTOMER_FIELDS]
    reason = _first_failure([
        (X.is_blank("first_name") & X.is_blank("last_name"), "first or last name required"),
    ])
    return raw.select("seq", *cleaned, reason.alias("reason"))


PRODUCT_TEXT_FIELDS: tuple[str, ...] = ("duration", "duration_formatted", "price", "ismn",
                                        "halstan_code", "sheet_music_plus_sku", "isbn")
PRODUCT_CHOICE_FIELDS: tuple[str, ...] = ("composer", "librettist_1", "librettist_2", "media",
                                          "score_type", "product_type")
PRODUCT_INT_FIELDS: tuple[str, ...] = ("no_of_movements", "duration_seconds", "work_id",
                                       "publication_year")
PRODUCT_FLAG_FIELDS: tuple[str, ...] = ("is_duplicate", "not_difficult", "rentable")
# Texts read as a ticked box.
TRUE_WORDS: tuple[str, ...] = ("true", "t", "1", "yes", "y", "on")


def validate_products(raw: DataFrame) -> DataFrame:
    """V3: product form -> typed product columns (+ ``categories`` array when
    the request carries a ';'-separated ``categories`` text) and reason.

    Every field is stripped once and every integer pattern tested once."""
    fields = ["title", *PRODUCT_TEXT_FIELDS, *PRODUCT_CHOICE_FIELDS, *PRODUCT_INT_FIELDS,
              *PRODUCT_FLAG_FIELDS]
    keep = [c for c in ("seq", "product_id") if c in raw.columns]
    extra = ["categories"] if "categories" in raw.columns else []
    st = _stripped(raw, fields, keep=[*keep, *extra])
    flags = st.select("*", *[_int_ok(c).alias(f"_ok_{c}") for c in PRODUCT_INT_FIELDS])
    typed = flags.select("*", *[
        F.when(_blank(c), F.lit(None).cast("int"))
         .otherwise(_int_value(c, F.col(f"_ok_{c}"), "int")).alias(f"_v_{c}")
        for c in PRODUCT_INT_FIELDS])
    checks: list[tuple[Column, str]] = [(_blank("title"), "title required")]
    checks += [(~_blank(c) & ~F.col(f"_ok_{c}"), f"{c} not an integer") for c in PRODUCT_INT_FIELDS]
    checks += [(~_blank(c) & F.col(f"_v_{c}").isNull(), f"{c} out of range")
               for c in PRODUCT_INT_FIELDS]
    cols = [_s("title").alias("title")]
    cols += [F.when(_s(c) == F.lit(""), F.lit(None).cast("string")).otherwise(_s(c)).alias(c)
             for c in PRODUCT_TEXT_FIELDS]
    cols += [F.when(_s(c).isin("", X.NONE_CHOICE), F.lit(None).cast("string"))
             .otherwise(_s(c)).alias(c) for c in PRODUCT_CHOICE_FIELDS]
    cols += [F.col(f"_v_{c}").alias(c) for c in PRODUCT_INT_FIELDS]
    cols += [F.coalesce(F.lower(_s(c)).isin(*TRUE_WORDS), F.lit(False)).alias(c)
             for c in PRODUCT_FLAG_FIELDS]
    if extra:
        names = F.transform(F.split(F.coalesce(F.col("categories"), F.lit("")), ";"),
                            lambda v: X.strip(v))
        cols.append(F.array_distinct(F.filter(names, lambda v: v != F.lit("")))
                    .alias("categories"))
    return typed.select(*keep, *cols, _first_failure(checks).alias("reason"))


def validate_replenish(raw: DataFrame, products: DataFrame,
                       locations: DataFrame | None = None) -> DataFrame:
    """V4: product, location and quantity required; the product must be a known
    one (an id that is no integer or does not fit 64 bits is not); location
    and quantity must be integers in range; the location, when its table is
    given, must exist. Checked in this order: the product is looked up before
    the numbers are read.

    Fields are stripped and tested once; only flags travel through the
    existence joins, not the raw texts. Unusable keys skip the joins."""
    ints = ["product_id", "location_id", "quantity"]
    st = _stripped(raw, [*ints, "bin", "rack", "code"])
    flags = st.select("*", *[_int_ok(c).alias(f"_ok_{c}") for c in ints])

    def to_null(c: str) -> Column:
        return F.when(_s(c) == F.lit(""), F.lit(None).cast("string")).otherwise(_s(c))

    typed = flags.select(
        "seq",
        _int_value("product_id", F.col("_ok_product_id")).alias("product_id"),
        _int_value("location_id", F.col("_ok_location_id")).alias("location_id"),
        _int_value("quantity", F.col("_ok_quantity"), "int").alias("quantity"),
        to_null("bin").alias("h_bin_num"), to_null("rack").alias("h_rack_num"),
        to_null("code").alias("halstan_code"),
        (_blank("product_id") | _blank("location_id") | _blank("quantity")).alias("_missing"),
        (~F.col("_ok_location_id") | ~F.col("_ok_quantity")).alias("_not_int"))
    known_p = products.select("product_id").distinct().withColumn("_kp", F.lit(True))
    typed = left_join_present(typed, known_p, "product_id")
    checks = [
        (F.col("_missing"), "product_id, location_id and quantity required"),
        (F.col("_kp").isNull(), "unknown product"),
        (F.col("_not_int"), "location_id and quantity must be integers"),
        (F.col("location_id").isNull(), "location_id out of range"),
        (F.col("quantity").isNull(), "quantity out of range"),
    ]
    if locations is not None:
        known_l = locations.select("location_id").distinct().withColumn("_kl", F.lit(True))
        typed = left_join_present(typed, known_l, "location_id")
        checks.append((F.col("_kl").isNull(), "unknown location"))
    return typed.select("seq", "product_id", "location_id", "quantity", "h_bin_num",
                        "h_rack_num", "halstan_code", _first_failure(checks).alias("reason"))


def clean_text(df: DataFrame, cols: Sequence[str], blank_to_null: bool = True) -> DataFrame:
    """V6: strip the given columns; '' becomes NULL unless ``blank_to_null`` is False."""
    conv = X.blank_to_null if blank_to_null else (lambda c: F.coalesce(X.strip(c), F.lit("")))
    return df.select(*[conv(c).alias(c) if c in cols else F.col(c) for c in df.columns])


def clean_prices(df: DataFrame, col: str = "price", out: str = "price_value") -> DataFrame:
    """V5 on a column: '$1,004.50 ' -> 1004.50 (DECIMAL(10,2), NULL if not a number)."""
    return df.withColumn(out, X.clean_price(col))
