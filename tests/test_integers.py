"""The integer queries on keys whose products with the queries' factors don't fit 64 bits."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tensorloom import queries
from tensorloom.functions import scalar
from tensorloom.operators.frame import FEW_GROUPS, PRODUCT_SHORT, TensorFrame

SMALL = "/root/testdata/sf0.001"


def _wide(sql: str) -> str:
    """A query's SQL with the keys multiplied as HUGEINT and then reduced to 64 bits, as its BIGINT would be an error."""
    for product in ("CAST(l_orderkey AS BIGINT) * 7000000000000", "-CAST(l_partkey AS BIGINT) * 90000000000000"):
        assert sql.count(product) == 1
        sql = sql.replace(product, queries._WRAP.format(f"({product.replace('BIGINT', 'HUGEINT')})"))
    return sql


@pytest.mark.parametrize("name", ["integer_elements", "integer_product", "integer_reductions"])
def test_on_large_keys(spark, tmp_path, name):
    duckdb = pytest.importorskip("duckdb")
    small = spark.read.parquet(f"{SMALL}/lineitem.parquet")
    large = small.withColumns({"l_orderkey": F.col("l_orderkey") + 8_000_000, "l_partkey": F.col("l_partkey") + 1_000_000})
    small.unionByName(large).write.parquet(str(tmp_path / "lineitem.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    with pytest.raises(duckdb.OutOfRangeException):
        con.execute(entry.oracle_sql()[name]).fetchall()
    got = entry.queries()[name](spark, str(tmp_path))
    want = con.execute(_wide(entry.oracle_sql()[name]))
    columns = [c[0] for c in want.description]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(want.fetchall())


def _wrapped(n: int) -> int:
    return (n + 2**63) % 2**64 - 2**63


def test_multiply_wraps(spark):
    edges = [0, 1, -1, 3, 2**16 - 1, -(2**31), 2**32 - 1, 2**32, -(2**48) + 1, 2**62, 2**63 - 1, -(2**63)]
    frame = spark.createDataFrame([(a, b) for a in edges for b in edges], "a long, b long")
    rows = frame.select("a", "b", scalar.binary("multiply", F.col("a"), F.col("b"), "bigint").alias("v")).collect()
    assert len(rows) == len(edges) ** 2 and all(r["v"] == _wrapped(r["a"] * r["b"]) for r in rows)


@pytest.mark.parametrize("n", [1, 2, 3, PRODUCT_SHORT, PRODUCT_SHORT + 1])
def test_products_of_short_axes(spark, n):
    x = np.random.default_rng(n).integers(-(2**63), 2**63 - 1, (4, n))
    t = TensorFrame.of_numpy(spark, x)
    want = [_wrapped(math.prod(map(int, row))) for row in x]
    assert t.reduce("product", 1).to_list() == want and t.transpose().reduce("product", 0).to_list() == want
    assert t.slice(0).reduce("product").element() == want[0] and t.reduce("product", 1, keep=True).shape == (4, 1)
    assert t.convert("int").reduce("product", 1).dtype == "int"


@pytest.mark.parametrize("name", ["integer_elements", "integer_product", "integer_reductions"])
@pytest.mark.parametrize("kind", ["decimal(38,0)", "decimal(20,0)", "int"])
def test_on_keys_of_other_types(spark, tmp_path, name, kind):
    duckdb = pytest.importorskip("duckdb")
    small = spark.read.parquet(f"{SMALL}/lineitem.parquet")
    small.withColumns({c: F.col(c).cast(kind) for c in ("l_orderkey", "l_partkey")}).write.parquet(str(tmp_path / "lineitem.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    got = entry.queries()[name](spark, str(tmp_path))
    want = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(want.fetchall())


@pytest.mark.parametrize("groups", [1, FEW_GROUPS, FEW_GROUPS + 1])
def test_places_of_few_groups(spark, groups):
    names = ["sum", "min", "max", "mean", "arg_min", "arg_max"]
    x = np.random.default_rng(groups).integers(-(2**63) + 1, 2**63 - 1, (40, groups))
    x[[3, 30], 0] = 2**63 - 2  # a tie of integers that doubles can't tell from their neighbours
    x[20, 0], x[0, -1] = 2**63 - 3, -(2**63)
    want = [(k, _wrapped(sum(map(int, c))), int(c.min()), int(c.max()), int(np.argmin(c)), int(np.argmax(c))) for k, c in enumerate(x.T)]
    for t, axis in ((TensorFrame.of_numpy(spark, x), 0), (TensorFrame.of_numpy(spark, x).transpose(), 1)):
        found = t.summary(names, axis)
        assert sorted(map(tuple, found.drop("mean").collect())) == want
        assert [c for c, _ in found.dtypes] == ["i0", *names] and {k for _, k in found.dtypes} == {"bigint"}
        assert t.arg("max", axis).to_list() == [r[-1] for r in want]
        # Spark sorts all rows for such places by group; where groups are few, none are sorted.
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert ("Sort [" in plan) == (groups > FEW_GROUPS)


def test_places_of_few_groups_of_reals(spark):
    nan = math.nan
    x = np.array([[nan, 2.0, nan], [1.0, 2.0, nan], [-3.0, -math.inf, nan]])
    rows = TensorFrame.of_numpy(spark, x).summary(["arg_min", "arg_max", "max"], 0).orderBy("i0").collect()
    assert [tuple(r) for r in rows][:2] == [(0, 2, 1, 1.0), (1, 2, 0, 2.0)] and tuple(rows[2])[:3] == (2, scalar.NOT_FOUND, scalar.NOT_FOUND)
