import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tensorloom.functions import rational as R


def pair(x):
    return (x.numerator, x.denominator)


def test_arithmetic(spark):
    rng = random.Random(7)
    draw = lambda: rng.choice([0, 1, -1, 2, 6, rng.randrange(-50, 50), rng.randrange(-(10**9), 10**9)])
    rows = [(k, draw(), rng.choice([1, -3, 12, 10**9 - 7]), draw(), rng.choice([1, -8, 9, 10**8])) for k in range(400)]
    df = spark.createDataFrame(rows, "k long, an long, ad long, bn long, bd long").select("k", R.rational(F.col("an"), F.col("ad")).alias("a"), R.rational(F.col("bn"), F.col("bd")).alias("b"))
    a, b = F.col("a"), F.col("b")
    nonzero = F.when(b["num"] != 0, b)
    got = df.select("k", a, R.add(a, b).alias("add"), R.subtract(a, b).alias("sub"), R.multiply(a, b).alias("mul"), R.divide(a, nonzero).alias("div"), R.modulo(a, nonzero).alias("mod"), R.floor(a).alias("floor"), R.ceil(a).alias("ceil"), R.truncate(a).alias("trunc"), R.absolute(a).alias("abs"), R.compare(a, b).alias("cmp"), R.equal(a, b).alias("eq"), R.sign(a).alias("sign"), R.to_double(a).alias("double"), R.pretty(a).alias("text"), R.is_int(a).alias("int")).collect()
    assert len(got) == len(rows)
    for r in got:
        x, y = Fraction(*rows[r.k][1:3]), Fraction(*rows[r.k][3:])
        assert tuple(r.a) == pair(x)
        assert (tuple(r["add"]), tuple(r["sub"]), tuple(r["mul"])) == (pair(x + y), pair(x - y), pair(x * y))
        assert y == 0 and r["div"] is None and r["mod"] is None or (tuple(r["div"]), tuple(r["mod"])) == (pair(x / y), pair(x - y * math.trunc(x / y)))
        assert (tuple(r["floor"]), tuple(r["ceil"]), tuple(r["trunc"]), tuple(r["abs"])) == ((math.floor(x), 1), (math.ceil(x), 1), (math.trunc(x), 1), pair(abs(x)))
        assert (r["cmp"], r["eq"], r["sign"]) == ((x > y) - (x < y), x == y, (x > 0) - (x < 0))
        assert r["double"] == pytest.approx(float(x)) and r["text"] == str(x) and r["int"] == (x.denominator == 1)


def test_special_values(spark):
    names = {"inf": (5, 0), "ninf": (-2, 0), "nan": (0, 0), "two": (2, 1), "null": (None, 1)}
    df = spark.createDataFrame([(x, y, *names[x], *names[y]) for x in names for y in names], "x string, y string, an long, ad long, bn long, bd long")
    a, b = R.rational(F.col("an"), F.col("ad")), R.rational(F.col("bn"), F.col("bd"))
    got = {(r.x, r.y): r for r in df.select("x", "y", R.pretty(R.add(a, b)).alias("add"), R.pretty(R.multiply(a, b)).alias("mul"), R.pretty(R.divide(a, b)).alias("div"), R.compare(a, b).alias("cmp"), R.equal(a, b).alias("eq"), R.to_double(a).alias("double")).collect()}
    assert [got[p]["add"] for p in (("inf", "ninf"), ("inf", "two"), ("two", "ninf"), ("nan", "two"), ("inf", "inf"), ("null", "two"))] == ["NaN", "Inf", "-Inf", "NaN", "Inf", None]
    assert [got[p]["mul"] for p in (("inf", "ninf"), ("nan", "two"), ("ninf", "two"))] == ["-Inf", "NaN", "-Inf"]
    assert [got[p]["div"] for p in (("inf", "inf"), ("two", "inf"), ("inf", "two"))] == ["NaN", "0", "Inf"]
    order = ["nan", "ninf", "two", "inf"]
    for i, x in enumerate(order):
        for j, y in enumerate(order):
            assert got[x, y]["cmp"] == (i > j) - (i < j) and got[x, y]["eq"] == (i == j and x != "nan")
    assert got["null", "two"]["cmp"] is None and math.isnan(got["nan", "two"]["double"]) and got["ninf", "two"]["double"] == -math.inf
    assert spark.range(1).select(R.pretty(R.divide(R.rational(F.lit(3)), R.rational(F.lit(0))))).first()[0] == "Inf"


def test_too_large_is_an_error(spark):
    big = R.rational(F.lit(2**62))
    one = spark.range(1)
    assert one.select(R.to_long(R.divide(R.multiply(big, R.rational(F.lit(2), 4)), R.rational(F.lit(2**31))))).first()[0] == 2**30
    with pytest.raises(Exception):
        one.select(R.multiply(big, big)).collect()
    with pytest.raises(Exception, match="whole"):
        one.select(R.to_long(R.rational(F.lit(1), 2))).collect()
