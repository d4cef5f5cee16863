"""Truth tables of the text functions."""

import pytest
from pyspark.sql import functions as F

from terrasift.functions import text as T

CASES = {
    "canonical": (T.canonical_name, [("BP Pulse (AU)", "BP"), ("(Unknown Operator)", None), ("Tesla   Motors ", "Tesla"), ("tesla", "tesla"), ("BP (AU) (x)", "BP (AU)"), (None, None), ("", None), (" Evie Networks\x1c", "Evie")]),
    "rating": (T.rating_kw, [("22 kW", 22.0), ("22", 22.0), ("2x350kW & 2x175kW", 350.0), ("2 x 50", 50.0), ("AC", None), (None, None), ("1.2.3", None), ("Max. 22 kW", 22.0), ("approx .5kW", 5.0)]),
    "postcode": (T.postcode, [("NSW 2630", "2630"), ("12345", "1234"), ("abc", None), (None, None)]),
    "price": (
        T.price_per_kwh,
        [("FREE", 0.0), ("no charge", 0.0), ("0.00", 0.0), ("55c/kWh", 0.55), ("$0.55/kWh", 0.55), ("AUD 0.55 per kWh", 0.55), ("59c-68c/kWh", None), ("50c/kWh or $0.60/kWh", None), ("50c/kWh, $0.50/kWh", 0.5), ("$5 per session", None), ("  ", None), (None, None),
         ("00", None), ("0.", None), ("free charging", 0.0), ("freedom", None), ("59c - 68c/kWh", None), ("$0.30–$0.40/kWh", None), ("aud0.5/kwh $0.5 per kWh", 0.5), ("$ 1.2.5/kWh", None), ("12.3.4c/kWh", 0.034), ("$55c/kWh", 0.55), ("5 CENTS/kwh", 0.05), ("$5 super kwh", None), ("a-b $1/kWh", 1.0)],
    ),
    "squash": (T.squash, [(" a  b ", "a b"), ("  ", None), (None, None)]),
    "one_line": (T.one_line, [("1 Main St \n Town  X", "1 Main St, Town  X"), ("", None)]),
    "number": (T.number, [("1d", None), ("nan", None), (" 1.5 ", 1.5), ("-2e3", -2000.0), ("", None), (None, None)]),
    "low": (lambda c: T.number_range(c)["low"], [("27-33 Oaks Ave", 27), ("12 Smith St", 12), ("33-27 A", 27), ("5/12 B", 5), ("27 - 33 C", 27), ("Cnr X", None), (None, None), (" 7 /9 x", 7), ("007", 7)]),
    "whole": (T.whole, [("696.0", 696), ("2.0", 2), ("2.5", None), ("7", 7), ("9007199254740993", 9007199254740993), ("x", None), (None, None)]),
    "high": (lambda c: T.number_range(c)["high"], [("27-33 Oaks Ave", 33), ("12 Smith St", 12), ("33-27 A", 33), ("5/12 B", 12), ("27 - 33 C", 27), ("Cnr X", None)]),
}


@pytest.mark.parametrize("name", CASES)
def test_truth_table(spark, name):
    f, rows = CASES[name]
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(rows)], "i int, a string")
    got = [r[0] for r in df.orderBy("i").select(f(F.col("a"))).collect()]
    assert got == [b for _, b in rows]


def test_pairs(spark):
    rows = [("12 A", "22 B", False), ("12 A", "23 B", True), ("x", "23 B", False), (None, None, False)]
    df = spark.createDataFrame(rows, "a string, b string, c boolean")
    assert df.where(T.address_conflict(F.col("a"), F.col("b")) != F.col("c")).isEmpty()
    rows = [("Shop", "12 A St", "12 A St"), ("1 B St", "2 C St", "2 C St"), ("Shop", "Mall", "Shop, Mall"), (None, None, None), ("", "Mall", "Mall")]
    df = spark.createDataFrame(rows, "a string, b string, c string")
    assert df.where(~T.street_address(F.col("a"), F.col("b")).eqNullSafe(F.col("c"))).isEmpty()
