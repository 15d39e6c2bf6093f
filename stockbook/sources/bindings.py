"""Test-data bindings: the driver's TPC-H-like tables viewed as model tables.

These only reshape rows of the test tables into the model's schemas (see
FIXTURES.md section 3); they do none of the operators' work. The same
bindings are written in DuckDB SQL in ``stockbook.plans.duck`` so that every
registered query can be checked against an independent engine.

Every binding is lazy; Catalyst prunes unused columns and pushes filters into
the parquet scans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stockbook.sources import schemas as S

# The category table of the catalogue (ids 1-6).
CATEGORIES: list[tuple[int, str]] = [
    (1, "Winds"),
    (2, "Keyboard"),
    (3, "Strings"),
    (4, "Opera"),
    (5, "Orchestral and Chamber works"),
    (6, "Other"),
]

# A number text that no key type holds.
HUGE = "99999999999999999999"

LONG_TITLE_MIDDLE = " - complete edition with full score and all parts"


# Declared schemas of the driver's test tables (never inferred: no footer
# reads for schema discovery, and a changed file type fails loudly).
RAW_SCHEMAS: dict[str, str] = {
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int,"
            " p_retailprice double",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double,"
                " c_mktsegment string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,"
              " o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int,"
                " l_quantity double, l_extendedprice double, l_discount double, l_tax double,"
                " l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string,"
              " value double, props string",
}


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(RAW_SCHEMAS[name]).parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _literal_table(spark: SparkSession, rows: list[tuple], schema) -> DataFrame:
    """A small fixed table as an inline VALUES relation: its exact size is known
    to the optimizer, so joins with it are broadcast when planned (a
    DataFrame built from a Python list is an RDD of unknown size)."""
    def sql(v: object) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, int):
            return str(v)
        return "'" + str(v).replace("'", "''") + "'"

    body = ", ".join("(" + ", ".join(sql(v) for v in r) + ")" for r in rows)
    names = [f.name for f in schema.fields]
    df = spark.sql(f"SELECT * FROM VALUES {body} AS t({', '.join(names)})")
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def category(spark: SparkSession, sf_dir: str | None = None) -> DataFrame:
    return _literal_table(spark, CATEGORIES, S.CATEGORY)


def location(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One stock location per region; lines and stock use the first four."""
    return _read(spark, sf_dir, "region").selectExpr(
        "CAST(r_regionkey + 1 AS BIGINT) AS location_id", "r_name AS location_name")


def _s(c: Column) -> Column:
    return c.cast("string")


def _location_of(suppkey: Column) -> Column:
    return F.when(suppkey % 11 == 0, F.lit(None).cast("bigint")).otherwise(1 + suppkey % 4)


# The projections below are Spark SQL expressions: one parse per column on the
# JVM side instead of hundreds of small Python-to-JVM calls per binding.
_TITLE_SQL = ("concat(p_name, CASE WHEN p_partkey % 5 = 0 THEN '" + LONG_TITLE_MIDDLE
              + "' ELSE '' END, ' No. ', CAST(p_partkey AS STRING))")
_TOTAL_SQL = ("((p_size % 12 + 1) * 60 + p_partkey % 60"
              " + CASE WHEN 1 + p_size % 3 >= 2 THEN (p_size % 7 + 2) * 60 + 30 ELSE 0 END"
              " + CASE WHEN 1 + p_size % 3 >= 3 THEN (p_partkey % 9 + 1) * 60 + 5 ELSE 0 END)")
_LOC_SQL = "CASE WHEN l_suppkey % 11 = 0 THEN CAST(NULL AS BIGINT) ELSE 1 + l_suppkey % 4 END"
_CODE_SQL = "CASE WHEN p_partkey % 2 = 0 THEN concat('W', CAST(p_partkey AS STRING)) END"


def music_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    no_duration = "p_partkey % 29 = 0"
    return _read(spark, sf_dir, "part").selectExpr(
        "p_partkey AS product_id",
        f"{_TITLE_SQL} AS title",
        f"""CASE WHEN p_partkey % 101 = 7 THEN '[x:00]' WHEN p_partkey % 107 = 5 THEN '[99999999:00]'
              WHEN NOT ({no_duration}) THEN concat(
              '[', CAST(p_size % 12 + 1 AS STRING), ':', lpad(CAST(p_partkey % 60 AS STRING), 2, '0'),
              CASE WHEN 1 + p_size % 3 >= 2 THEN concat('; ', CAST(p_size % 7 + 2 AS STRING), ':30') ELSE '' END,
              CASE WHEN 1 + p_size % 3 >= 3 THEN concat('; ', CAST(p_partkey % 9 + 1 AS STRING), ':05') ELSE '' END,
              ']') END AS duration""",
        f"CAST(CASE WHEN NOT ({no_duration}) THEN 1 + p_size % 3 END AS INT) AS no_of_movements",
        f"""CAST(CASE WHEN NOT ({no_duration}) THEN {_TOTAL_SQL}
              + CASE WHEN p_partkey % 13 = 0 THEN 60 ELSE 0 END END AS INT) AS duration_seconds""",
        f"""CASE WHEN NOT ({no_duration}) AND p_partkey % 17 <> 0 THEN concat(
              CAST({_TOTAL_SQL} div 60 AS STRING), ':', lpad(CAST({_TOTAL_SQL} % 60 AS STRING), 2, '0'))
              END AS duration_formatted""",
        """CASE WHEN p_partkey % 23 <> 0 THEN
              concat('$', CAST(CAST(p_retailprice AS DECIMAL(10,2)) AS STRING), ' ') END AS price""",
        "CAST(NULL AS STRING) AS ismn",
        "p_partkey % 37 = 0 AS is_duplicate",
        "CAST(p_partkey AS INT) AS work_id",
        "p_size < 10 AS not_difficult",
        "false AS rentable",
        f"{_CODE_SQL} AS halstan_code",
        "p_brand AS composer",
        "CASE WHEN p_size % 10 = 0 THEN concat('Editor ', p_brand) END AS librettist_1",
        "CAST(NULL AS STRING) AS librettist_2",
        "CASE WHEN p_size % 3 = 0 THEN 'print' WHEN p_size % 3 = 1 THEN 'audio' END AS media",
        "CAST(NULL AS STRING) AS sheet_music_plus_sku",
        "CAST(NULL AS STRING) AS score_type",
        "CAST(1950 + p_size AS INT) AS publication_year",
        "CAST(NULL AS STRING) AS isbn",
        "p_type AS product_type",
    )


def product_category_junction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of most products; every tenth has none, to have uncategorised products."""
    p = _read(spark, sf_dir, "part").where(F.col("p_partkey") % 10 != 0)
    a = p.select(F.col("p_partkey").alias("product_id"),
                 (1 + F.col("p_partkey") % 6).cast("bigint").alias("category_id"))
    b = p.select(F.col("p_partkey").alias("product_id"),
                 (1 + F.col("p_size") % 6).cast("bigint").alias("category_id"))
    return a.union(b).distinct()


def customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _read(spark, sf_dir, "customer")
    n = _read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return c.join(n, c.c_nationkey == n.n_nationkey, "left").selectExpr(
        "c_custkey AS customer_id",
        "CASE WHEN c_custkey % 7 <> 0 THEN c_mktsegment END AS first_name",
        "c_name AS last_name",
        "concat('c', CAST(c_custkey AS STRING), '@example.com') AS email_addr",
        "CASE WHEN c_custkey % 3 <> 0 THEN concat('555-', lpad(CAST(c_custkey % 10000 AS STRING), 4, '0')) END AS phone",
        "concat(CAST(c_custkey AS STRING), ' Main Street') AS street_address",
        "concat('Town ', CAST(c_nationkey AS STRING)) AS town",
        "CASE WHEN c_custkey % 9 = 0 THEN '' ELSE lpad(CAST(c_custkey % 100000 AS STRING), 5, '0') END AS zip",
        "n_name AS country",
    )


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS order_id",
        "CAST(o_orderdate AS DATE) AS order_date",
        "CASE WHEN o_custkey % 10 <> 0 THEN o_custkey END AS customer_id",
        "CAST(NULL AS DATE) AS inv_pull_date",
        "CAST(NULL AS STRING) AS billing_address",
        "CAST(NULL AS STRING) AS billing_country",
        "CAST(NULL AS STRING) AS billing_street",
        "CAST(NULL AS STRING) AS billing_zip",
    )


_VERSION_ORDER = ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
                  "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


def line_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem rows numbered as successive versions of one order line.

    The window is partitioned by the line key, so each task only sorts the
    few versions of its own lines.
    """
    li = _read(spark, sf_dir, "lineitem")
    w = Window.partitionBy("l_orderkey", "l_linenumber").orderBy(*_VERSION_ORDER)
    wall = Window.partitionBy("l_orderkey", "l_linenumber")
    return (li.withColumn("version", F.row_number().over(w))
              .withColumn("n_versions", F.count(F.lit(1)).over(wall))
              .withColumn("first_partkey", F.first("l_partkey").over(w)))


_NUMBERED = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]


def numbered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``line_versions`` for lines and requests: the columns those need.

    Versions that agree in the first five order columns agree in all of these,
    so the other order columns, which would only settle such ties, stay out of
    the shuffle.
    """
    w = Window.partitionBy("l_orderkey", "l_linenumber").orderBy(*_VERSION_ORDER[:5])
    return _read(spark, sf_dir, "lineitem").select(*_NUMBERED, F.row_number().over(w).alias("version"))


def order_line(spark: SparkSession, sf_dir: str, numbered: DataFrame | None = None) -> DataFrame:
    """Every lineitem row is a line of its own (``numbered``: ``numbered_lines``, written before)."""
    return (numbered_lines(spark, sf_dir) if numbered is None else numbered).selectExpr(
        "(l_orderkey * 10 + l_linenumber) * 16 + version AS order_line_id",
        "l_orderkey AS order_id",
        "l_partkey AS product_id",
        "CAST(l_extendedprice AS DECIMAL(10,2)) AS product_price",
        "CAST(l_quantity AS INT) AS quantity",
        f"{_LOC_SQL} AS fulfilled_from_location_id",
    )


def change_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """INSERT for a line's first version, UPDATE for each later one, and a
    DELETE after the last version when it is a returned line ('R').

    A version yields one or two changes, so lineitem is scanned once."""
    v = line_versions(spark, sf_dir)
    w = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("version")
    k = F.col("l_suppkey")
    prod = F.when(k % 5 == 0, F.col("l_partkey")).otherwise(F.col("first_partkey"))
    qty = (F.col("l_quantity").cast("int") % 8 - 1).cast("int")
    v = v.select(
        "l_orderkey", "l_linenumber", "version", "n_versions", "l_returnflag",
        prod.alias("p"), _location_of(k).alias("loc"), qty.alias("q"))
    v = (v.withColumn("prev_p", F.lag("p").over(w))
          .withColumn("prev_loc", F.lag("loc").over(w))
          .withColumn("prev_q", F.lag("q").over(w)))
    line_id = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    nl, ni = F.lit(None).cast("bigint"), F.lit(None).cast("int")
    upsert = F.struct(
        (line_id * 16 + F.col("version")).alias("seq"),
        F.when(F.col("version") == 1, F.lit("INSERT")).otherwise(F.lit("UPDATE")).alias("op"),
        F.col("l_orderkey").alias("order_id"),
        F.col("prev_p").alias("old_product"), F.col("prev_loc").alias("old_location"),
        F.col("prev_q").alias("old_qty"),
        F.col("p").alias("new_product"), F.col("loc").alias("new_location"),
        F.col("q").alias("new_qty"))
    delete = F.struct(
        (line_id * 16 + F.col("n_versions") + 1).alias("seq"),
        F.lit("DELETE").alias("op"),
        F.col("l_orderkey").alias("order_id"),
        F.col("p").alias("old_product"), F.col("loc").alias("old_location"),
        F.col("q").alias("old_qty"),
        nl.alias("new_product"), nl.alias("new_location"), ni.alias("new_qty"))
    gone = (F.col("version") == F.col("n_versions")) & (F.col("l_returnflag") == "R")
    changes = F.when(gone, F.array(upsert, delete)).otherwise(F.array(upsert))
    return v.select(F.explode(changes).alias("c")).select("c.*")


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Opening stock: location 1 for most products, location 2 for some; the
    others have none, so that changes must create their rows."""
    p = _read(spark, sf_dir, "part")

    def at(loc: int, qty: str, rack: str) -> DataFrame:
        return p.selectExpr(
            f"p_partkey * 10 + {loc} AS inventory_id", "p_partkey AS product_id",
            f"CAST({loc} AS BIGINT) AS location_id", "CAST(p_size % 9 AS STRING) AS h_bin_num",
            f"{rack} AS h_rack_num", f"CAST({qty} AS INT) AS quantity",
            "CAST(1 + p_size % 3 AS INT) AS parcel_qty", f"{_CODE_SQL} AS halstan_code")

    first = at(1, "p_size * 10", "CAST(NULL AS STRING)").where("product_id % 3 <> 0")
    second = at(2, "p_size", "concat('R', CAST(p_size % 4 AS STRING))").where("product_id % 4 = 0")
    return first.unionByName(second)


def replenish_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw replenishment requests (all text), one per event."""
    return _read(spark, sf_dir, "events").selectExpr(
        "event_id AS seq",
        f"""CASE WHEN event_id % 97 = 0 THEN 'abc' WHEN event_id % 89 = 0 THEN ''
                WHEN event_id % 73 = 0 THEN '{HUGE}'
                ELSE CAST(user_id * 14 AS STRING) END AS product_id""",
        f"""CASE WHEN event_id % 79 = 0 THEN '{HUGE}' WHEN event_id % 67 = 0 THEN 'x'
                WHEN event_id % 61 = 0 THEN '9' ELSE CAST(1 + event_id % 4 AS STRING) END AS location_id""",
        """CASE WHEN event_id % 83 = 0 THEN ' ' WHEN event_id % 71 = 0 THEN '9999999999'
                ELSE CAST(CAST(floor(value) AS INT) AS STRING) END AS quantity""",
        "CASE WHEN event_type = 'view' THEN CAST(NULL AS STRING) ELSE event_type END AS bin",
        "CASE WHEN event_type = 'click' THEN concat('R', CAST(event_id % 7 AS STRING)) END AS rack",
        "CASE WHEN event_type = 'signup' THEN concat('S', CAST(user_id AS STRING)) END AS code",
    )


def undo_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each 'error' event asks to undo the replenishment just before it."""
    e = _read(spark, sf_dir, "events").where(F.col("event_type") == "error")
    return e.select((F.col("event_id") - 1).alias("replenish_seq"))


def raw_order_line_requests(spark: SparkSession, sf_dir: str, numbered: DataFrame | None = None) -> DataFrame:
    """One raw (all text) add-line request per lineitem row, some malformed."""
    return (numbered_lines(spark, sf_dir) if numbered is None else numbered).selectExpr(
        "(l_orderkey * 10 + l_linenumber) * 16 + version AS seq",
        """CASE l_partkey % 40 WHEN 0 THEN '' WHEN 1 THEN 'abc' WHEN 2 THEN '12.5'
             WHEN 3 THEN concat(' ', CAST(l_orderkey AS STRING), ' ')
             WHEN 19 THEN CAST(l_orderkey + 100000000 AS STRING)
             WHEN 21 THEN '99999999999999999999'
             ELSE CAST(l_orderkey AS STRING) END AS order_id""",
        """CASE l_partkey % 40 WHEN 4 THEN '' WHEN 5 THEN 'abc'
             WHEN 6 THEN concat('+', CAST(l_partkey AS STRING))
             WHEN 20 THEN CAST(l_partkey + 100000000 AS STRING)
             WHEN 22 THEN '99999999999999999999'
             ELSE CAST(l_partkey AS STRING) END AS product_id""",
        """CASE l_partkey % 40 WHEN 7 THEN '' WHEN 8 THEN '12.5' WHEN 9 THEN '1_000'
             WHEN 10 THEN ' 7 ' ELSE CAST(CAST(l_quantity AS INT) AS STRING) END AS quantity""",
        """CASE l_partkey % 40 WHEN 11 THEN '' WHEN 12 THEN 'none' WHEN 13 THEN 'NONE'
             WHEN 14 THEN '$1,004.50 ' WHEN 15 THEN 'abc'
             ELSE concat('$', CAST(CAST(l_extendedprice AS DECIMAL(10,2)) AS STRING)) END AS price""",
        """CASE l_partkey % 40 WHEN 16 THEN '' WHEN 17 THEN 'abc' WHEN 18 THEN '9'
             WHEN 23 THEN '99999999999999999999'
             ELSE CAST(1 + l_suppkey % 4 AS STRING) END AS location_id""",
    )


def staging(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier stock list, one row per part: found by its code, by a re-typed
    title, by the beginning of a title (of one product or of several), or not
    at all."""
    kind = ("CASE WHEN p_partkey % 7 = 3 THEN 3 WHEN p_partkey % 2 = 0 THEN 1"
            " WHEN p_partkey % 3 = 0 THEN 4 ELSE 2 END")
    return _read(spark, sf_dir, "part").selectExpr("*", f"{kind} AS kind").selectExpr(
        f"""CASE kind WHEN 1 THEN p_name WHEN 3 THEN concat('Unlisted item ', CAST(p_partkey AS STRING))
              WHEN 4 THEN p_name
              ELSE concat('  ', replace(upper({_TITLE_SQL}), ' ', '  '), ' ') END AS title_raw""",
        """CASE kind WHEN 1 THEN concat('W', CAST(p_partkey AS STRING))
              WHEN 3 THEN concat('Z', CAST(p_partkey AS STRING)) END AS halstan_code""",
        "CAST(p_size * 3 AS INT) AS quantity", "CAST(1 + p_size % 4 AS INT) AS parcel_qty",
        "CAST(p_size % 5 AS STRING) AS h_bin_num", "CAST(NULL AS STRING) AS rack_num",
        "p_partkey * 10 + kind AS staging_id", "CAST(NULL AS BIGINT) AS product_id")


def order_line_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose lines are asked for: one request per event."""
    return _read(spark, sf_dir, "events").selectExpr("user_id AS order_id")


def customer_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw new-customer requests (all text), some without any name."""
    return _read(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS seq",
        "CASE WHEN c_custkey % 7 = 0 THEN '' ELSE concat(' ', c_mktsegment) END AS first_name",
        "CASE WHEN c_custkey % 5 = 0 THEN '  ' ELSE c_name END AS last_name",
        "concat('new', CAST(c_custkey AS STRING), '@example.com') AS email_addr",
        "'' AS phone",
        "concat(CAST(c_custkey AS STRING), ' High Street ') AS street_address",
        "concat('Town ', CAST(c_nationkey AS STRING)) AS town",
        "'' AS zip",
        "'USA' AS country",
    )


def order_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw new-order requests (customer id as text), one per event."""
    e = _read(spark, sf_dir, "events")
    eid = F.col("event_id")
    cust = (F.when(eid % 13 == 0, F.lit("")).when(eid % 17 == 0, F.lit("abc"))
            .when(eid % 19 == 0, _s(F.col("user_id") + 100000000))
            .when(eid % 23 == 0, F.lit(HUGE))
            .otherwise(_s(F.col("user_id"))))
    return e.select(eid.alias("seq"), cust.alias("customer_id"))


def product_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw product form submissions (all text) built from part rows.

    Used both as new products (W5) and as edits of existing ids (W6/W7).
    """
    return _read(spark, sf_dir, "part").selectExpr(
        "p_partkey AS seq",
        # the id an edit applies to: a few point past the catalogue, at the product
        # before (an earlier edit of which is superseded), or are no usable id
        f"""CASE WHEN p_partkey % 41 = 0 THEN 'abc' WHEN p_partkey % 43 = 0 THEN '{HUGE}'
                ELSE CAST(CASE WHEN p_partkey % 11 = 0 THEN p_partkey + 100000000
                               WHEN p_partkey % 13 = 5 THEN p_partkey - 1 ELSE p_partkey END AS STRING)
                END AS product_id""",
        "CASE WHEN p_partkey % 19 = 0 THEN '  ' ELSE concat(p_name, ' (2nd ed.)') END AS title",
        "'' AS duration",
        """CASE WHEN p_partkey % 23 = 0 THEN 'many'
                ELSE CAST(1 + p_size % 3 AS STRING) END AS no_of_movements""",
        "CASE WHEN p_partkey % 3 = 0 THEN '' ELSE CAST(p_size * 60 AS STRING) END AS duration_seconds",
        "'' AS duration_formatted",
        "concat('$', CAST(CAST(p_retailprice AS DECIMAL(10,2)) AS STRING)) AS price",
        "'' AS ismn",
        "CASE WHEN p_partkey % 2 = 0 THEN 'true' ELSE 'false' END AS is_duplicate",
        "CASE WHEN p_partkey % 29 = 0 THEN 'x1' ELSE CAST(p_partkey AS STRING) END AS work_id",
        "'false' AS not_difficult",
        "CASE WHEN p_size % 2 = 0 THEN 'true' ELSE '' END AS rentable",
        "concat('W', CAST(p_partkey AS STRING)) AS halstan_code",
        "CASE WHEN p_size % 4 = 0 THEN '(None)' ELSE p_brand END AS composer",
        "'(None)' AS librettist_1",
        "'' AS librettist_2",
        "CASE WHEN p_size % 3 = 0 THEN 'print' ELSE '(None)' END AS media",
        "'' AS sheet_music_plus_sku",
        "'(None)' AS score_type",
        """CASE WHEN p_partkey % 31 = 0 THEN '19 84'
                ELSE CAST(1990 + p_size % 30 AS STRING) END AS publication_year""",
        "'' AS isbn",
        "p_type AS product_type",
        """CASE p_size % 6 WHEN 0 THEN '' WHEN 1 THEN 'Winds' WHEN 2 THEN 'Opera;Strings'
             WHEN 3 THEN 'Keyboard;Other;Winds' WHEN 4 THEN 'Orchestral and Chamber works'
             ELSE 'Strings;Percussion' END AS categories""",
    )


def stream_feed_source(spark: SparkSession, events: DataFrame) -> DataFrame:
    """Order-line changes carried by events (batch or streaming DataFrame):
    purchase inserts, signup inserts without a location, view and click update,
    error deletes."""
    t = F.col("event_type")
    q = F.floor(F.col("value")).cast("int")
    nl, ni = F.lit(None).cast("bigint"), F.lit(None).cast("int")
    prod, loc = F.col("user_id"), (1 + F.col("event_id") % 4).cast("bigint")
    insert, delete = t.isin("purchase", "signup"), t == "error"
    return events.select(
        F.col("event_id").alias("seq"),
        F.when(insert, F.lit("INSERT")).when(delete, F.lit("DELETE"))
         .otherwise(F.lit("UPDATE")).alias("op"),
        F.col("event_id").alias("order_id"),
        F.when(insert, nl).otherwise(prod).alias("old_product"),
        F.when(insert, nl).otherwise(loc).alias("old_location"),
        F.when(insert, ni).when(t == "view", F.lit(1)).otherwise(q).alias("old_qty"),
        F.when(delete, nl).otherwise(prod).alias("new_product"),
        F.when(delete | (t == "signup"), nl).otherwise(loc).alias("new_location"),
        F.when(delete, ni).when(t == "click", F.lit(1)).otherwise(q).alias("new_qty"),
    )


def lookup_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product lookups by raw id text; error events send a blank id."""
    e = _read(spark, sf_dir, "events")
    t = F.col("event_type")
    key = (F.when(t == "error", F.lit(""))
           .when((t == "click") & (F.col("event_id") % 5 == 0), F.lit("abc"))
           .when((t == "signup") & (F.col("event_id") % 5 == 1), F.lit(HUGE))
           .otherwise(_s(F.col("user_id") * 14)))
    return e.select(F.col("event_id").alias("seq"), key.alias("key"))


def events_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "events")


BINDINGS = {
    "category": category,
    "location": location,
    "music_product": music_product,
    "product_category_junction": product_category_junction,
    "customer": customer,
    "orders": orders,
    "order_line": order_line,
    "inventory": inventory,
    "inventory_halstan_staging": staging,
}
