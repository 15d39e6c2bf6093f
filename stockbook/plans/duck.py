"""The test-data bindings of ``stockbook.sources.bindings`` written in DuckDB SQL.

Each entry is the body of one CTE; ``with_bindings(sql)`` prepends the CTEs a
query mentions (and what they depend on). The driver pre-registers the raw
test tables as views, so these read ``part``, ``lineitem`` ... directly.
"""

from __future__ import annotations

import re

_TITLE = ("p_name || CASE WHEN p_partkey % 5 = 0 THEN "
          "' - complete edition with full score and all parts' ELSE '' END "
          "|| ' No. ' || CAST(p_partkey AS VARCHAR)")

_LOC = "CASE WHEN l_suppkey % 11 = 0 THEN NULL ELSE 1 + l_suppkey % 4 END"

_TOTAL = ("((p_size % 12 + 1) * 60 + p_partkey % 60"
          " + CASE WHEN 1 + p_size % 3 >= 2 THEN (p_size % 7 + 2) * 60 + 30 ELSE 0 END"
          " + CASE WHEN 1 + p_size % 3 >= 3 THEN (p_partkey % 9 + 1) * 60 + 5 ELSE 0 END)")

BINDINGS: dict[str, str] = {}

BINDINGS["b_category"] = """
SELECT * FROM (VALUES (1::BIGINT, 'Winds'), (2, 'Keyboard'), (3, 'Strings'), (4, 'Opera'),
  (5, 'Orchestral and Chamber works'), (6, 'Other')) t(category_id, category_name)"""

BINDINGS["b_location"] = """
SELECT CAST(r_regionkey + 1 AS BIGINT) AS location_id, r_name AS location_name FROM region"""

BINDINGS["b_music_product"] = f"""
SELECT p_partkey AS product_id,
  {_TITLE} AS title,
  CASE WHEN p_partkey % 101 = 7 THEN '[x:00]' WHEN p_partkey % 107 = 5 THEN '[99999999:00]'
    WHEN p_partkey % 29 = 0 THEN NULL ELSE
    '[' || CAST(p_size % 12 + 1 AS VARCHAR) || ':' || lpad(CAST(p_partkey % 60 AS VARCHAR), 2, '0')
    || CASE WHEN 1 + p_size % 3 >= 2 THEN '; ' || CAST(p_size % 7 + 2 AS VARCHAR) || ':30' ELSE '' END
    || CASE WHEN 1 + p_size % 3 >= 3 THEN '; ' || CAST(p_partkey % 9 + 1 AS VARCHAR) || ':05' ELSE '' END
    || ']' END AS duration,
  CAST(CASE WHEN p_partkey % 29 = 0 THEN NULL ELSE 1 + p_size % 3 END AS INTEGER) AS no_of_movements,
  CAST(CASE WHEN p_partkey % 29 = 0 THEN NULL ELSE
    {_TOTAL} + CASE WHEN p_partkey % 13 = 0 THEN 60 ELSE 0 END END AS INTEGER) AS duration_seconds,
  CASE WHEN p_partkey % 29 <> 0 AND p_partkey % 17 <> 0 THEN
    CAST({_TOTAL} // 60 AS VARCHAR) || ':' || lpad(CAST({_TOTAL} % 60 AS VARCHAR), 2, '0')
  END AS duration_formatted,
  CASE WHEN p_partkey % 23 = 0 THEN NULL ELSE
    '$' || CAST(CAST(p_retailprice AS DECIMAL(10,2)) AS VARCHAR) || ' ' END AS price,
  CAST(NULL AS VARCHAR) AS ismn,
  p_partkey % 37 = 0 AS is_duplicate,
  CAST(p_partkey AS INTEGER) AS work_id,
  p_size < 10 AS not_difficult,
  false AS rentable,
  CASE WHEN p_partkey % 2 = 0 THEN 'W' || CAST(p_partkey AS VARCHAR) END AS halstan_code,
  p_brand AS composer,
  CASE WHEN p_size % 10 = 0 THEN 'Editor ' || p_brand END AS librettist_1,
  CAST(NULL AS VARCHAR) AS librettist_2,
  CASE p_size % 3 WHEN 0 THEN 'print' WHEN 1 THEN 'audio' END AS media,
  CAST(NULL AS VARCHAR) AS sheet_music_plus_sku,
  CAST(NULL AS VARCHAR) AS score_type,
  CAST(1950 + p_size AS INTEGER) AS publication_year,
  CAST(NULL AS VARCHAR) AS isbn,
  p_type AS product_type
FROM part"""

BINDINGS["b_product_category_junction"] = """
SELECT p_partkey AS product_id, CAST(1 + p_partkey % 6 AS BIGINT) AS category_id
FROM part WHERE p_partkey % 10 <> 0
UNION
SELECT p_partkey, CAST(1 + p_size % 6 AS BIGINT) FROM part WHERE p_partkey % 10 <> 0"""

BINDINGS["b_customer"] = """
SELECT c_custkey AS customer_id,
  CASE WHEN c_custkey % 7 <> 0 THEN c_mktsegment END AS first_name,
  c_name AS last_name,
  'c' || CAST(c_custkey AS VARCHAR) || '@example.com' AS email_addr,
  CASE WHEN c_custkey % 3 <> 0 THEN '555-' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') END AS phone,
  CAST(c_custkey AS VARCHAR) || ' Main Street' AS street_address,
  'Town ' || CAST(c_nationkey AS VARCHAR) AS town,
  CASE WHEN c_custkey % 9 = 0 THEN '' ELSE lpad(CAST(c_custkey % 100000 AS VARCHAR), 5, '0') END AS zip,
  n_name AS country
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey"""

BINDINGS["b_orders"] = """
SELECT o_orderkey AS order_id, CAST(o_orderdate AS DATE) AS order_date,
  CASE WHEN o_custkey % 10 <> 0 THEN o_custkey END AS customer_id,
  CAST(NULL AS DATE) AS inv_pull_date, CAST(NULL AS VARCHAR) AS billing_address,
  CAST(NULL AS VARCHAR) AS billing_country, CAST(NULL AS VARCHAR) AS billing_street,
  CAST(NULL AS VARCHAR) AS billing_zip
FROM orders"""

BINDINGS["b_line_versions"] = """
SELECT *,
  row_number() OVER w AS version,
  count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n_versions,
  first_value(l_partkey) OVER w AS first_partkey
FROM lineitem
WINDOW w AS (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey,
  l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus)"""

BINDINGS["b_order_line"] = f"""
SELECT (l_orderkey * 10 + l_linenumber) * 16 + version AS order_line_id, l_orderkey AS order_id,
  l_partkey AS product_id, CAST(l_extendedprice AS DECIMAL(10,2)) AS product_price,
  CAST(l_quantity AS INTEGER) AS quantity, {_LOC} AS fulfilled_from_location_id
FROM b_line_versions"""

BINDINGS["b_change_src"] = f"""
SELECT l_orderkey, l_linenumber, version, n_versions, l_returnflag,
  CASE WHEN l_suppkey % 5 = 0 THEN l_partkey ELSE first_partkey END AS p,
  {_LOC} AS loc,
  CAST(CAST(l_quantity AS INTEGER) % 8 - 1 AS INTEGER) AS q
FROM b_line_versions"""

BINDINGS["b_change_feed"] = """
SELECT (l_orderkey * 10 + l_linenumber) * 16 + version AS seq,
  CASE WHEN version = 1 THEN 'INSERT' ELSE 'UPDATE' END AS op,
  l_orderkey AS order_id,
  lag(p) OVER w AS old_product, lag(loc) OVER w AS old_location, lag(q) OVER w AS old_qty,
  p AS new_product, loc AS new_location, q AS new_qty
FROM b_change_src
WINDOW w AS (PARTITION BY l_orderkey, l_linenumber ORDER BY version)
UNION ALL
SELECT (l_orderkey * 10 + l_linenumber) * 16 + n_versions + 1, 'DELETE', l_orderkey,
  p, loc, q, CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS INTEGER)
FROM b_change_src WHERE version = n_versions AND l_returnflag = 'R'"""

BINDINGS["b_inventory"] = """
SELECT p_partkey * 10 + 1 AS inventory_id, p_partkey AS product_id, CAST(1 AS BIGINT) AS location_id,
  CAST(p_size % 9 AS VARCHAR) AS h_bin_num, CAST(NULL AS VARCHAR) AS h_rack_num,
  CAST(p_size * 10 AS INTEGER) AS quantity, CAST(1 + p_size % 3 AS INTEGER) AS parcel_qty,
  CASE WHEN p_partkey % 2 = 0 THEN 'W' || CAST(p_partkey AS VARCHAR) END AS halstan_code
FROM part WHERE p_partkey % 3 <> 0
UNION ALL
SELECT p_partkey * 10 + 2, p_partkey, CAST(2 AS BIGINT), CAST(p_size % 9 AS VARCHAR),
  'R' || CAST(p_size % 4 AS VARCHAR), CAST(p_size AS INTEGER), CAST(1 + p_size % 3 AS INTEGER),
  CASE WHEN p_partkey % 2 = 0 THEN 'W' || CAST(p_partkey AS VARCHAR) END
FROM part WHERE p_partkey % 4 = 0"""

BINDINGS["b_replenish_requests"] = """
SELECT event_id AS seq,
  CASE WHEN event_id % 97 = 0 THEN 'abc' WHEN event_id % 89 = 0 THEN ''
       WHEN event_id % 73 = 0 THEN '99999999999999999999'
       ELSE CAST(user_id * 14 AS VARCHAR) END AS product_id,
  CASE WHEN event_id % 79 = 0 THEN '99999999999999999999' WHEN event_id % 67 = 0 THEN 'x'
       WHEN event_id % 61 = 0 THEN '9' ELSE CAST(1 + event_id % 4 AS VARCHAR) END AS location_id,
  CASE WHEN event_id % 83 = 0 THEN ' ' WHEN event_id % 71 = 0 THEN '9999999999' ELSE CAST(CAST(floor(value) AS INTEGER) AS VARCHAR) END AS quantity,
  CASE WHEN event_type = 'view' THEN NULL ELSE event_type END AS bin,
  CASE WHEN event_type = 'click' THEN 'R' || CAST(event_id % 7 AS VARCHAR) END AS rack,
  CASE WHEN event_type = 'signup' THEN 'S' || CAST(user_id AS VARCHAR) END AS code
FROM events"""

BINDINGS["b_undo_requests"] = """
SELECT event_id - 1 AS replenish_seq FROM events WHERE event_type = 'error'"""

BINDINGS["b_raw_order_line_requests"] = """
SELECT (l_orderkey * 10 + l_linenumber) * 16 + version AS seq,
  CASE l_partkey % 40 WHEN 0 THEN '' WHEN 1 THEN 'abc' WHEN 2 THEN '12.5'
    WHEN 3 THEN ' ' || CAST(l_orderkey AS VARCHAR) || ' '
    WHEN 19 THEN CAST(l_orderkey + 100000000 AS VARCHAR) WHEN 21 THEN '99999999999999999999'
    ELSE CAST(l_orderkey AS VARCHAR) END AS order_id,
  CASE l_partkey % 40 WHEN 4 THEN '' WHEN 5 THEN 'abc' WHEN 6 THEN '+' || CAST(l_partkey AS VARCHAR)
    WHEN 20 THEN CAST(l_partkey + 100000000 AS VARCHAR) WHEN 22 THEN '99999999999999999999'
    ELSE CAST(l_partkey AS VARCHAR) END AS product_id,
  CASE l_partkey % 40 WHEN 7 THEN '' WHEN 8 THEN '12.5' WHEN 9 THEN '1_000' WHEN 10 THEN ' 7 '
    ELSE CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) END AS quantity,
  CASE l_partkey % 40 WHEN 11 THEN '' WHEN 12 THEN 'none' WHEN 13 THEN 'NONE'
    WHEN 14 THEN '$1,004.50 ' WHEN 15 THEN 'abc'
    ELSE '$' || CAST(CAST(l_extendedprice AS DECIMAL(10,2)) AS VARCHAR) END AS price,
  CASE l_partkey % 40 WHEN 16 THEN '' WHEN 17 THEN 'abc' WHEN 18 THEN '9'
    WHEN 23 THEN '99999999999999999999' ELSE CAST(1 + l_suppkey % 4 AS VARCHAR) END AS location_id
FROM b_line_versions"""

BINDINGS["b_staging"] = f"""
SELECT CASE kind WHEN 3 THEN 'Unlisted item ' || CAST(p_partkey AS VARCHAR)
    WHEN 2 THEN '  ' || replace(upper({_TITLE}), ' ', '  ') || ' ' ELSE p_name END AS title_raw,
  CASE kind WHEN 1 THEN 'W' || CAST(p_partkey AS VARCHAR) WHEN 3 THEN 'Z' || CAST(p_partkey AS VARCHAR)
    END AS halstan_code,
  CAST(p_size * 3 AS INTEGER) AS quantity, CAST(1 + p_size % 4 AS INTEGER) AS parcel_qty,
  CAST(p_size % 5 AS VARCHAR) AS h_bin_num, CAST(NULL AS VARCHAR) AS rack_num,
  p_partkey * 10 + kind AS staging_id, CAST(NULL AS BIGINT) AS product_id
FROM (SELECT *, CASE WHEN p_partkey % 7 = 3 THEN 3 WHEN p_partkey % 2 = 0 THEN 1
        WHEN p_partkey % 3 = 0 THEN 4 ELSE 2 END AS kind FROM part)"""

BINDINGS["b_customer_requests"] = """
SELECT c_custkey AS seq,
  CASE WHEN c_custkey % 7 = 0 THEN '' ELSE ' ' || c_mktsegment END AS first_name,
  CASE WHEN c_custkey % 5 = 0 THEN '  ' ELSE c_name END AS last_name,
  'new' || CAST(c_custkey AS VARCHAR) || '@example.com' AS email_addr,
  '' AS phone, CAST(c_custkey AS VARCHAR) || ' High Street ' AS street_address,
  'Town ' || CAST(c_nationkey AS VARCHAR) AS town, '' AS zip, 'USA' AS country
FROM customer"""

BINDINGS["b_order_requests"] = """
SELECT event_id AS seq,
  CASE WHEN event_id % 13 = 0 THEN '' WHEN event_id % 17 = 0 THEN 'abc'
       WHEN event_id % 19 = 0 THEN CAST(user_id + 100000000 AS VARCHAR)
       WHEN event_id % 23 = 0 THEN '99999999999999999999'
       ELSE CAST(user_id AS VARCHAR) END AS customer_id
FROM events"""

BINDINGS["b_order_line_lookups"] = "SELECT user_id AS order_id FROM events"

BINDINGS["b_product_requests"] = """
SELECT p_partkey AS seq,
  CASE WHEN p_partkey % 41 = 0 THEN 'abc' WHEN p_partkey % 43 = 0 THEN '99999999999999999999'
    ELSE CAST(CASE WHEN p_partkey % 11 = 0 THEN p_partkey + 100000000
      WHEN p_partkey % 13 = 5 THEN p_partkey - 1 ELSE p_partkey END AS VARCHAR) END AS product_id,
  CASE WHEN p_partkey % 19 = 0 THEN '  ' ELSE p_name || ' (2nd ed.)' END AS title,
  '' AS duration,
  CASE WHEN p_partkey % 23 = 0 THEN 'many' ELSE CAST(1 + p_size % 3 AS VARCHAR) END AS no_of_movements,
  CASE WHEN p_partkey % 3 = 0 THEN '' ELSE CAST(p_size * 60 AS VARCHAR) END AS duration_seconds,
  '' AS duration_formatted,
  '$' || CAST(CAST(p_retailprice AS DECIMAL(10,2)) AS VARCHAR) AS price,
  '' AS ismn,
  CASE WHEN p_partkey % 2 = 0 THEN 'true' ELSE 'false' END AS is_duplicate,
  CASE WHEN p_partkey % 29 = 0 THEN 'x1' ELSE CAST(p_partkey AS VARCHAR) END AS work_id,
  'false' AS not_difficult,
  CASE WHEN p_size % 2 = 0 THEN 'true' ELSE '' END AS rentable,
  'W' || CAST(p_partkey AS VARCHAR) AS halstan_code,
  CASE WHEN p_size % 4 = 0 THEN '(None)' ELSE p_brand END AS composer,
  '(None)' AS librettist_1, '' AS librettist_2,
  CASE WHEN p_size % 3 = 0 THEN 'print' ELSE '(None)' END AS media,
  '' AS sheet_music_plus_sku, '(None)' AS score_type,
  CASE WHEN p_partkey % 31 = 0 THEN '19 84' ELSE CAST(1990 + p_size % 30 AS VARCHAR) END AS publication_year,
  '' AS isbn, p_type AS product_type,
  CASE p_size % 6 WHEN 0 THEN '' WHEN 1 THEN 'Winds' WHEN 2 THEN 'Opera;Strings'
    WHEN 3 THEN 'Keyboard;Other;Winds' WHEN 4 THEN 'Orchestral and Chamber works'
    ELSE 'Strings;Percussion' END AS categories
FROM part"""

BINDINGS["b_stream_feed"] = """
SELECT event_id AS seq, op, event_id AS order_id,
  CASE WHEN op <> 'INSERT' THEN user_id END AS old_product,
  CASE WHEN op <> 'INSERT' THEN place END AS old_location,
  CASE WHEN op <> 'INSERT' THEN CASE event_type WHEN 'view' THEN 1 ELSE q END END AS old_qty,
  CASE WHEN op <> 'DELETE' THEN user_id END AS new_product,
  CASE WHEN op <> 'DELETE' AND event_type <> 'signup' THEN place END AS new_location,
  CASE WHEN op <> 'DELETE' THEN CASE event_type WHEN 'click' THEN 1 ELSE q END END AS new_qty
FROM (SELECT event_id, user_id, event_type, CAST(1 + event_id % 4 AS BIGINT) AS place,
        CAST(floor(value) AS INTEGER) AS q,
        CASE WHEN event_type IN ('purchase', 'signup') THEN 'INSERT' WHEN event_type = 'error'
          THEN 'DELETE' ELSE 'UPDATE' END AS op FROM events)"""


# Reusable oracle fragments built on the bindings (same semantics as the
# Spark operators, written independently in SQL).
BINDINGS["o_line"] = """
SELECT *, CAST(product_price * quantity AS DECIMAL(10,2)) AS line_total FROM b_order_line"""

BINDINGS["o_delta"] = """
SELECT seq, op, order_id,
  CASE op WHEN 'INSERT' THEN new_product WHEN 'UPDATE' THEN coalesce(new_product, old_product)
    ELSE old_product END AS product_id,
  CASE op WHEN 'INSERT' THEN new_location WHEN 'UPDATE' THEN coalesce(new_location, old_location)
    ELSE old_location END AS location_id,
  CAST(CASE op WHEN 'INSERT' THEN 0 WHEN 'UPDATE' THEN coalesce(old_qty, 0) ELSE old_qty END AS INTEGER) AS old_qty,
  CAST(CASE op WHEN 'INSERT' THEN new_qty WHEN 'UPDATE' THEN coalesce(new_qty, 0) ELSE 0 END AS INTEGER) AS new_qty
FROM b_change_feed"""

BINDINGS["o_deltas"] = """
SELECT *, CAST(new_qty - old_qty AS INTEGER) AS delta FROM o_delta
WHERE product_id IS NOT NULL AND location_id IS NOT NULL"""

BINDINGS["o_ledger"] = """
SELECT seq, product_id, location_id AS from_location_id, CAST(NULL AS BIGINT) AS to_location_id,
  CAST(abs(delta) AS INTEGER) AS quantity,
  CASE WHEN op = 'INSERT' AND delta > 0 THEN 'sale'
       WHEN op = 'UPDATE' AND delta > 0 THEN 'sale_adjust_increase'
       WHEN op = 'UPDATE' AND delta < 0 THEN 'sale_adjust_decrease'
       WHEN op = 'DELETE' THEN 'sale_cancel' ELSE 'sale' END AS movement_type,
  'order ' || coalesce(CAST(order_id AS VARCHAR), '') AS reference
FROM o_deltas WHERE delta <> 0"""

BINDINGS["o_stock_after"] = """
SELECT coalesce(i.product_id, d.product_id) AS product_id,
  coalesce(i.location_id, d.location_id) AS location_id,
  i.inventory_id, i.h_bin_num, i.h_rack_num, i.parcel_qty, i.halstan_code,
  CAST(coalesce(i.quantity, 0) - coalesce(d.net_delta, 0) AS INTEGER) AS quantity
FROM b_inventory i FULL JOIN
  (SELECT product_id, location_id, sum(delta) AS net_delta FROM o_deltas GROUP BY 1, 2) d
  ON i.product_id = d.product_id AND i.location_id = d.location_id"""

_NAME = re.compile(r"\b([bo]_[a-z0-9_]+)\b")


def _deps(name: str) -> set[str]:
    return {m for m in _NAME.findall(BINDINGS[name]) if m in BINDINGS and m != name}


def with_bindings(sql: str) -> str:
    """Prefix ``sql`` with the binding CTEs it uses, dependencies first."""
    needed: list[str] = []

    def visit(n: str) -> None:
        if n in needed:
            return
        for d in sorted(_deps(n)):
            visit(d)
        needed.append(n)

    for m in sorted(set(_NAME.findall(sql))):
        if m in BINDINGS:
            visit(m)
    body = sql.strip()
    if not needed:
        return body
    ctes = ",\n".join(f"{n} AS ({BINDINGS[n].strip()})" for n in needed)
    own = re.match(r"(?is)^WITH\s+(.*)$", body)
    if own:
        return f"WITH {ctes},\n{own.group(1)}"
    return f"WITH {ctes}\n{body}"
