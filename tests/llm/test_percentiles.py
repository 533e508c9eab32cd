import math
import random
import struct
from fractions import Fraction

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skein.llm import percentiles as P

SHARES = (0.0, 0.5, 0.9, 0.99, 1.0)


def nearest(values, share):
    ordered = sorted(values)
    return ordered[max(1, math.ceil(round(share * len(ordered), 9))) - 1]


def bits_of(value):
    raw = struct.unpack("<q", struct.pack("<d", value or 0.0))[0]
    return raw if raw >= 0 else -(raw & (2**63 - 1)) - 1


NUMBERS = [0.0, -0.0, 1.0, -1.0, 0.1, 2.0**31 - 1, 2**53 + 2.0, 5e-324, -5e-324, 2.2250738585072014e-308, 1.7976931348623157e308, float("inf"), float("-inf"), 1 - 2**-53, 1 + 2**-52, 3.0, 1e-310, 1023.9999999999999]


def test_bits_keep_order_and_value(spark):
    random.seed(3)
    numbers = NUMBERS + [random.uniform(-1, 1) * 10 ** random.randint(-300, 300) for _ in range(3000)] + [2.0**n for n in range(-1074, 1024, 7)]
    frame = spark.createDataFrame([(x,) for x in numbers], "x double").select("x", P.ordered_bits(F.col("x")).alias("b"))
    for x, b, back in frame.select("x", "b", P.value_of(F.col("b"))).collect():
        assert b == bits_of(x) and back == x


def test_selection_is_exact(spark):
    random.seed(5)
    data = [(random.choice(["a", "b", None]), random.choice([random.randint(-5, 5), random.expovariate(1e-3), random.gauss(0, 1e9), 2147483647, -0.0])) for _ in range(4000)]
    data += [("hot", float(n % 97)) for n in range(5000)] + [("one", 7.5), ("none", None), ("none", float("nan"))]
    frame = spark.createDataFrame([(g, None if v is None else float(v), "x", 1) for g, v in data], "g string, v double, n string, records int")
    for row in P.radix_select(frame, ["g"], "v", SHARES).collect():
        mine = [v for g, v in data if g == row.g and v is not None and v == v]
        assert row.n == len(mine)
        assert [row[f"p{round(s * 100)}"] for s in SHARES] == [nearest(mine, s) for s in SHARES]
    exact = P.radix_select(frame, ["g"], "v", SHARES)
    divided = P.radix_select(frame, ["g"], "v", SHARES, at_once=3)  # nearly every digit is divided by a second one
    assert sorted(map(tuple, divided.collect()), key=repr) == sorted(map(tuple, exact.collect()), key=repr)
    assert P.radix_select(frame.limit(0), ["g"], "v").count() == 0
    assert {x.g for x in P.radix_select(frame, ["g"], "v").collect()} == {"a", "b", None, "hot", "one"}


def test_repeated_rows_count_once_where_rows_have_names(spark):
    data = [(n, n % 3, "x", float(n % 50)) for n in range(600)] * 2 + [(None, 0, None, 3.0), (None, 0, None, 3.0)]
    frame = spark.createDataFrame(data, "id long, g int, h string, v double")
    found = {(x.g, x.h): (x.n, x.p50) for x in P.radix_select(frame, ["g", "h"], "v", unique=["id"]).collect()}
    assert found == {(0, "x"): (200, 24.0), (1, "x"): (200, 24.0), (2, "x"): (200, 24.0), (0, None): (1, 3.0)}


def test_ranks_are_exact_for_any_number_of_values(spark):
    shares = (1 / 3, 0.07, 0.55, 0.5, 0.9, 0.99, 0.999, 0.1, 0.0, 1.0)
    sizes = [1, 10, 61_008_040, 479_349_000, 10**12 + 1, 2**53 + 1, 10**17 + 3]
    for row in spark.createDataFrame([(x,) for x in sizes], "n long").select("n", P._ranks(shares).alias("ranks")).collect():
        assert [x["rank"] for x in row.ranks] == [max(1, -(-row.n * Fraction(str(x)).numerator // Fraction(str(x)).denominator)) for x in shares]


def test_combined_days_keep_the_bound(spark):
    random.seed(7)
    data = [(d, g, random.lognormvariate(3, 2) * random.choice([1, 1, -1])) for d in range(9) for g in "xy" for _ in range(random.randint(0, 400))]
    frame = spark.createDataFrame(data, "d int, g string, v double")
    daily = None
    for day in range(9):  # each day on its own, as tables written on different days
        part = P.histogram(frame.where(F.col("d") == day), ["g"], "v")
        daily = part if daily is None else daily.unionByName(part)
    for row in P.percentiles_of(P.combine(daily, ["g"]), ["g"]).collect():
        for share, name in ((0.5, "p50"), (0.9, "p90"), (0.99, "p99")):
            exact = nearest([v for _, g, v in data if g == row.g], share)
            assert row[f"{name}_low"] <= exact <= row[f"{name}_high"]
            assert row[f"{name}_high"] - row[f"{name}_low"] <= abs(exact) * 2.0 ** -(P.SKETCH_BITS - 12)


@settings(max_examples=300, deadline=None)
@given(st.floats(allow_nan=False), st.floats(allow_nan=False))
def test_order_of_bits(a, b):
    assert (bits_of(a) < bits_of(b)) == (a < b)
