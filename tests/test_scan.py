import numpy as np
import pytest
from pyspark.sql import functions as F

from tensorloom.operators import scan


@pytest.mark.parametrize("decay", [0.0, 1e-12, 0.5, 0.9, 1.0, -0.7])
def test_decayed_sums_over_many_blocks(spark, decay):
    """Three levels of blocks, small decays and 0."""
    rng = np.random.default_rng(2)
    rows = [(s, k, float(x)) for s, n in (("a", 1), ("b", 70), (None, 9)) for k, x in enumerate(rng.normal(size=n))]
    df = spark.createDataFrame(rows, "s string, k long, x double").repartition(3)
    got = {(r.s, r.k): r.y for r in scan.exponential_scan(df, "s", ["k"], "x", decay, "y", block=4).collect()}
    state = {}
    for s, k, x in rows:
        state[s] = state.get(s, 0.0) * decay + x
        assert got[s, k] == pytest.approx(state[s], abs=1e-12)
    assert len(got) == len(rows)


def test_interpolation_outside_and_large_tables(spark):
    table = np.arange(6.0) ** 2
    df = spark.createDataFrame([(float(x),) for x in (-1, 0, 0.5, 2.25, 5, 7)], "x double")
    near, zero = scan.Interpolator(table, [0.0], [5.0]), scan.Interpolator(table, [0.0], [5.0], "zero")
    got = df.select(near(F.col("x")).alias("a"), zero(F.col("x")).alias("b")).collect()
    assert [r.a for r in got] == [0, 0, 0.5, 5.25, 25, 25] and [r.b for r in got] == [0, 0, 0.5, 5.25, 0, 0]
    big = np.add.outer(np.arange(300.0), 2 * np.arange(200.0))
    two = scan.Interpolator(big, [0.0, 0.0], [299.0, 199.0])
    with pytest.raises(ValueError):
        two(F.col("x"), F.col("x"))
    assert [r.y for r in two.on(df, "y", F.col("x"), F.col("x")).collect()] == pytest.approx([0, 0, 1.5, 6.75, 15, 21])
    given = scan.Interpolator(np.full(6, 7.0), [0.0], [5.0])
    assert scan.Interpolator(table, [0.0], [5.0], slopes={0: given}).derivative(0) is given
    assert [r.d for r in df.select(near.derivative(0)(F.col("x")).alias("d")).collect()] == [0, 1, 1, 5, 0, 0]
