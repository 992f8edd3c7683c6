import datetime as dt
import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tensorloom.streaming.slots import slot_totals

SMALL = "/root/testdata/sf0.001"


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_without_the_corpus_operators(tmp_path):
    """In a copy without them, all other queries, their SQL and the benchmark's list are there."""
    root = Path(entry.__file__).parent
    copy = tmp_path / "copy"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "spark-warehouse"))
    (copy / "tensorloom" / "llm" / "__pycache__").mkdir(parents=True)  # as a run leaves it behind
    code = "import __spark_entry__ as e, bench; q = e.queries(); o = e.oracle_sql(); assert set(o) <= set(q) and len(q) > 40; assert not [n for n in q if n.startswith('op') or n == 'pipeline']; print('fine')"
    said = subprocess.run([sys.executable, "-B", "-c", code], cwd=copy, env=os.environ | {"PYTHONPATH": str(copy)}, capture_output=True, text=True)
    assert said.stdout.strip() == "fine", said.stderr


@pytest.mark.parametrize("name", ["generators", "elem_binary", "reduce_axis0", "mask_get", "scatter", "slot_batches", "true_idx", "loop_scan", "rationals", "element_sums", "element_gradient", "loop_gradient", "loop_channels", "integer_elements", "integer_reductions", "integer_product", "search_all", "expression_gradient", "perceptron_gradient", "mask_set_vector", "cut_sequences", "padded_batches", "covariance", "zca_whitening", "pca_whitening", "svd_inverse", "diff_flat"])
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("orders", "customer", "lineitem", "events", "embeddings", "documents", "part", "supplier", "nation"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    got, want = entry.queries()[name](spark, SMALL).toPandas(), con.execute(entry.oracle_sql()[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    key = lambda table: sorted(map(str, table[sorted(table.columns)].astype(object).where(table.notna(), None).values.tolist()))
    assert len(got) == len(want)
    assert [x.replace(".0", "") for x in key(got)] == [x.replace(".0", "") for x in key(want)]


@pytest.mark.parametrize("name", ["replicate", "diag_mat", "dot_batched", "tensor_product"])
def test_on_rows_that_leave_a_rest(spark, tmp_path, name):
    """On 213 rows, so that the last batch of ten is not full."""
    duckdb = pytest.importorskip("duckdb")
    small = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    n = small.count()
    rows = small.unionByName(small.withColumn("vec_id", F.col("vec_id") + n)).unionByName(small.withColumn("vec_id", F.col("vec_id") + 2 * n)).unionByName(small.withColumn("vec_id", F.col("vec_id") + 3 * n)).unionByName(small.withColumn("vec_id", F.col("vec_id") + 4 * n))
    rows.where("vec_id < 213").write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    got, want = entry.queries()[name](spark, str(tmp_path)).toPandas(), con.execute(entry.oracle_sql()[name]).fetchdf()
    keys = sorted(c for c in want.columns if c != "v")
    got, want = (t.sort_values(keys).reset_index(drop=True) for t in (got, want))
    assert len(got) == len(want) and (got[keys] == want[keys]).all(axis=None) and (got["v"] - want["v"]).abs().max() < 3e-6


def test_stream(spark, tmp_path):
    rows = [(dt.datetime(2024, 1, 1, 0, k), "a" if k % 2 else "b", float(k)) for k in range(30)]
    df = spark.createDataFrame(rows, "ts timestamp, event_type string, value double")
    df.write.parquet(str(tmp_path / "in"))
    stream = slot_totals(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("slots").start()
    q.processAllAvailable()
    q.stop()
    got = {(r.slot, r.event_type): (r.n, r.total) for r in spark.table("slots").collect()}
    want = {(r.slot, r.event_type): (r.n, r.total) for r in slot_totals(df).collect()}
    assert got == want and sum(n for n, _ in got.values()) == 30 and spark.table("slots").agg(F.sum("total")).first()[0] == sum(range(30))
