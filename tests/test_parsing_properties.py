"""Property tests: Spark-side parsing agrees with Python's int() / float().

The form values were parsed with Python's int() and float() (the price then
stored as numeric(10,2): the float goes through 15 significant digits and is
rounded half away from zero). Random texts are checked against that.
"""

from __future__ import annotations

import math
from decimal import ROUND_HALF_UP, Decimal, InvalidOperation

from hypothesis import given, settings
from hypothesis import strategies as st

from stockbook.functions import expressions as X

ALPHABET = "0123456789+-_ .eE$,\t　\x85a"
texts = st.text(alphabet=ALPHABET, min_size=0, max_size=12)


def py_int(s: str):
    try:
        return int(s.strip())
    except ValueError:
        return None


def py_price(s: str):
    """What a price field means: its characters but for currency signs and commas, as a number."""
    kept = "".join(c for c in s if c not in "$,").strip()
    try:
        f = float(kept)
    except ValueError:
        return None
    if not math.isfinite(f):
        return None
    try:
        d = Decimal(format(f, ".15g")).quantize(Decimal("0.01"), rounding=ROUND_HALF_UP)
    except InvalidOperation:
        return None
    return d if abs(d) < Decimal("100000000") else None


@settings(max_examples=6, deadline=None)
@given(st.lists(texts, min_size=300, max_size=300))
def test_int_and_price_parsing_match_python(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "s string")
    rows = df.select("s", X.parse_int("s").alias("i"), X.parses_as_int("s").alias("ok"),
                     X.clean_price("s").alias("p")).collect()
    for r in rows:
        want = py_int(r.s)
        if want is not None and abs(want) >= 2 ** 63:
            want = None
        assert r.i == want, r.s
        assert r.ok == (py_int(r.s) is not None), r.s
        assert r.p == py_price(r.s), r.s


def test_strip_matches_python(spark):
    samples = [" a ", "\t\n7\r\x0b\x0c", "　x ", "\x85y\xa0", "", "  ", "a b"]
    df = spark.createDataFrame([(s,) for s in samples], "s string")
    got = [r.t for r in df.select(X.strip("s").alias("t")).collect()]
    assert got == [s.strip() for s in samples]


def test_exponent_prices(spark):
    samples = ["0E38", "1e3", "1.5e-3", "2.5E1", "1e400", "$1_0e1"]
    df = spark.createDataFrame([(s,) for s in samples], "s string")
    got = [r.p for r in df.select(X.clean_price("s").alias("p")).collect()]
    assert got == [py_price(s) for s in samples]
