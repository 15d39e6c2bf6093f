"""Fixed schemas of the ten model tables, and the typed reader.

Keys are BIGINT (the test data's keys are 64-bit); money is DECIMAL(10,2);
``price`` of a product stays text on purpose, as in the catalogue it models.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

MONEY = T.DecimalType(10, 2)
# Sums and totals are reported in one wider decimal so that every engine
# agrees on the result type.
TOTAL = T.DecimalType(18, 2)


def _f(name: str, dtype: T.DataType, nullable: bool = True) -> T.StructField:
    return T.StructField(name, dtype, nullable)


S, L, I, B, D = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType(), T.DateType()

CATEGORY = T.StructType([_f("category_id", L, False), _f("category_name", S)])

CUSTOMER = T.StructType([
    _f("customer_id", L, False), _f("first_name", S), _f("last_name", S),
    _f("email_addr", S), _f("phone", S), _f("street_address", S), _f("town", S),
    _f("zip", S), _f("country", S),
])

ORDERS = T.StructType([
    _f("order_id", L, False), _f("order_date", D), _f("customer_id", L),
    _f("inv_pull_date", D), _f("billing_address", S), _f("billing_country", S),
    _f("billing_street", S), _f("billing_zip", S),
])

# line_total is a generated column: it is not stored by writers, it is
# derived on read by ``functions.expressions.with_line_total``.
ORDER_LINE = T.StructType([
    _f("order_line_id", L, False), _f("order_id", L, False), _f("product_id", L, False),
    _f("product_price", MONEY, False), _f("quantity", I, False),
    _f("fulfilled_from_location_id", L),
])

PRODUCT = T.StructType([
    _f("product_id", L, False), _f("title", S, False), _f("duration", S),
    _f("no_of_movements", I), _f("duration_seconds", I), _f("duration_formatted", S),
    _f("price", S), _f("ismn", S), _f("is_duplicate", B), _f("work_id", I),
    _f("not_difficult", B), _f("rentable", B), _f("halstan_code", S), _f("composer", S),
    _f("librettist_1", S), _f("librettist_2", S), _f("media", S),
    _f("sheet_music_plus_sku", S), _f("score_type", S), _f("publication_year", I),
    _f("isbn", S), _f("product_type", S),
])

PRODUCT_CATEGORY = T.StructType([_f("product_id", L, False), _f("category_id", L, False)])

LOCATION = T.StructType([_f("location_id", L, False), _f("location_name", S, False)])

INVENTORY = T.StructType([
    _f("inventory_id", L, False), _f("product_id", L, False), _f("location_id", L, False),
    _f("h_bin_num", S), _f("h_rack_num", S), _f("quantity", I, False),
    _f("parcel_qty", I), _f("halstan_code", S),
])

MOVEMENT = T.StructType([
    _f("movement_id", L, False), _f("product_id", L, False), _f("from_location_id", L),
    _f("to_location_id", L), _f("quantity", I, False), _f("movement_type", S, False),
    _f("movement_date", T.TimestampNTZType(), False), _f("reference", S),
])

STAGING = T.StructType([
    _f("title_raw", S), _f("halstan_code", S), _f("quantity", I), _f("parcel_qty", I),
    _f("h_bin_num", S), _f("rack_num", S), _f("staging_id", L, False), _f("product_id", L),
])

# Change feed of order lines: one row per INSERT / UPDATE / DELETE with the
# old and new images flattened (old_* NULL for INSERT, new_* NULL for DELETE).
CHANGE_FEED = T.StructType([
    _f("seq", L, False), _f("op", S, False), _f("order_id", L),
    _f("old_product", L), _f("old_location", L), _f("old_qty", I),
    _f("new_product", L), _f("new_location", L), _f("new_qty", I),
])

TABLES: dict[str, T.StructType] = {
    "category": CATEGORY,
    "customer": CUSTOMER,
    "orders": ORDERS,
    "order_line": ORDER_LINE,
    "music_product": PRODUCT,
    "product_category_junction": PRODUCT_CATEGORY,
    "location": LOCATION,
    "inventory": INVENTORY,
    "inventory_movement": MOVEMENT,
    "inventory_halstan_staging": STAGING,
}

# Declared varchar(n) limits of the model (checked by audit C5).
VARCHAR_LIMITS: dict[str, dict[str, int]] = {
    "category": {"category_name": 100},
    "customer": {"first_name": 100, "last_name": 100, "email_addr": 255, "phone": 20,
                 "street_address": 255, "town": 100, "zip": 20, "country": 100},
    "orders": {"billing_country": 100, "billing_street": 255, "billing_zip": 20},
    "inventory": {"h_bin_num": 50, "h_rack_num": 50, "halstan_code": 10},
    "inventory_halstan_staging": {"h_bin_num": 50},
    "inventory_movement": {"movement_type": 30},
    "location": {"location_name": 50},
    "music_product": {"isbn": 13},
}

# NOT NULL columns of the model (checked by audit C4).
NOT_NULL: dict[str, list[str]] = {
    name: [f.name for f in schema.fields if not f.nullable]
    for name, schema in TABLES.items()
}

# Primary keys (C1), unique keys (C2) and foreign keys.
PRIMARY_KEYS: dict[str, list[str]] = {
    "category": ["category_id"],
    "customer": ["customer_id"],
    "orders": ["order_id"],
    "order_line": ["order_line_id"],
    "music_product": ["product_id"],
    "product_category_junction": ["product_id", "category_id"],
    "location": ["location_id"],
    "inventory": ["inventory_id"],
    "inventory_movement": ["movement_id"],
    "inventory_halstan_staging": ["staging_id"],
}

UNIQUE_KEYS: list[tuple[str, list[str]]] = [
    ("category", ["category_name"]),
    ("location", ["location_name"]),
    ("inventory", ["product_id", "location_id"]),
]

# (child table, child column, parent table, parent column, on-delete action)
FOREIGN_KEYS: list[tuple[str, str, str, str, str]] = [
    ("inventory", "location_id", "location", "location_id", "restrict"),
    ("inventory_movement", "from_location_id", "location", "location_id", "restrict"),
    ("inventory_movement", "product_id", "music_product", "product_id", "restrict"),
    ("inventory_movement", "to_location_id", "location", "location_id", "restrict"),
    ("inventory", "product_id", "music_product", "product_id", "restrict"),
    ("order_line", "fulfilled_from_location_id", "location", "location_id", "restrict"),
    ("order_line", "order_id", "orders", "order_id", "cascade"),
    ("order_line", "product_id", "music_product", "product_id", "restrict"),
    ("orders", "customer_id", "customer", "customer_id", "set null"),
    ("product_category_junction", "category_id", "category", "category_id", "restrict"),
    ("product_category_junction", "product_id", "music_product", "product_id", "restrict"),
]


def read_table(spark: SparkSession, base_dir: str, name: str) -> DataFrame:
    """Read a stored model table with its declared schema (never inferred)."""
    return spark.read.schema(TABLES[name]).parquet(f"{base_dir.rstrip('/')}/{name}")


def read_jdbc_table(spark: SparkSession, url: str, name: str,
                    partition_column: str | None = None, lower_bound: int | None = None,
                    upper_bound: int | None = None, num_partitions: int | None = None,
                    properties: dict[str, str] | None = None) -> DataFrame:
    """Read a model table from a database over JDBC, split into parallel range
    reads on ``partition_column``, and cast to the declared schema.

    Not exercised by the tests (no database runs here); same result shape as
    ``read_table``.
    """
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", name)
    if partition_column is not None:
        reader = (reader.option("partitionColumn", partition_column)
                  .option("lowerBound", str(lower_bound)).option("upperBound", str(upper_bound))
                  .option("numPartitions", str(num_partitions or 1)))
    for k, v in (properties or {}).items():
        reader = reader.option(k, v)
    df = reader.load()
    return df.select(*[df[f.name].cast(f.dataType).alias(f.name) for f in TABLES[name].fields])
