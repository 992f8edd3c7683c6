import gzip
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tensorloom.operators import dataset as D
from tensorloom.operators.frame import TensorFrame
from tensorloom.sources import tensors as S


@pytest.fixture(scope="module")
def sequences(spark):
    rows = [(s, k, float(100 * s + k)) for s in range(3) for k in range(98)]
    return D.Dataset.of_sequences(spark.createDataFrame(rows, "key long, at long, x double"), "key", ["at"])


def test_batches(spark):
    data = D.Dataset.of_samples(spark.createDataFrame([(float(x),) for x in range(25)], "x double").repartition(5), ["x"])
    assert sorted((r.sample_id, r.x) for r in data.df.collect()) == [(k, float(k)) for k in range(25)]
    assert {r.batch_id: r["count"] for r in data.batches(11).groupBy("batch_id").count().collect()} == {0: 11, 1: 11, 2: 3}
    padded = data.padded_batches(11)
    assert padded.count() == 33 and padded.where("sample_id >= 25").agg(F.sum("x")).first()[0] == 0
    assert [p.n_samples for p in data.partition([0.8, 0.1, 0.1])] == [20, 2, 3]
    assert [r.x for r in data.split()["tst"].df.orderBy("sample_id").collect()] == [22.0, 23.0, 24.0]
    assert data.part(3, 5).df.count() == 3


def test_sequences(sequences):
    assert (sequences.n_samples, sequences.n_steps) == (3, 98)
    tiles = {(r.batch_id, r.slot_id): r["count"] for r in sequences.slot_batches(2, 4).groupBy("batch_id", "slot_id").count().collect()}
    assert tiles[0, 0] == 8 and tiles[1, 24] == 2 and len(tiles) == 50
    cut = sequences.cut_to_min_samples(15)
    assert (cut.n_steps, cut.n_samples) == (19, 18) and cut.df.count() == 18 * 19
    values = {(r.sample_id, r.step): r.x for r in cut.df.collect()}
    assert values[7, 2] == 100 + 19 + 2 and values[5, 18] == 0.0


def test_ragged_sequences_keep_every_step(spark, tmp_path):
    lengths = [1, 9, 4, 30]
    rows = [(s, k, float(100 * s + k + 1)) for s, n in enumerate(lengths) for k in range(n)]
    df = spark.createDataFrame(rows, "key long, at long, x double").repartition(5)
    data = D.Dataset.of_sequences(df, "key", ["at"])
    assert (data.n_samples, data.n_steps, data.df.count()) == (4, 30, 44)
    tiles = {(r.batch_id, r.slot_id): r["count"] for r in data.slot_batches(2, 4).groupBy("batch_id", "slot_id").count().collect()}
    assert tiles == {(0, 0): 5, (0, 1): 4, (0, 2): 1, (1, 0): 8, **{(1, k): 4 for k in range(1, 7)}, (1, 7): 2}
    data.save(str(tmp_path / "d"))
    for one in (data, D.Dataset.load(spark, str(tmp_path / "d"))):
        cut = one.cut_sequences(4)
        assert (cut.n_samples, cut.n_steps, cut.ragged) == (1 + 3 + 1 + 8, 4, False)
        got = {(r.sample_id, r.step): r.x for r in cut.df.collect()}
        want, at = {}, 0
        for s, n in enumerate(lengths):
            for first in range(0, n, 4):
                want |= {(at, k): float(100 * s + first + k + 1) if first + k < n else 0.0 for k in range(4)}
                at += 1
        assert got == want
    assert data.cut_to_min_samples(12).n_samples >= 12
    asked = D.Dataset.of_sequences(df, "key", ["at"], 4)
    assert asked.n_steps == 4 and asked.ragged and asked.df.count() == 1 + 4 + 4 + 4


def test_normalizers(spark):
    x = np.random.default_rng(1).normal(size=(50, 2)) * 4 + 2
    df = spark.createDataFrame([(*map(float, r), float(k % 2), 5.0) for k, r in enumerate(x)], "a double, b double, c double, d double")
    for n in (D.Rescaling(), D.Standardization(), D.Standardization(True), D.Normalizer()):
        n.fit(df, ["a", "b", "c", "d"])
        y = n.transform(df)
        np.testing.assert_allclose(n.inverse(y).toPandas(), df.toPandas(), atol=1e-9)
    y = D.Standardization(True).fit(df, ["a", "c"]).transform(df).toPandas()
    np.testing.assert_allclose(y["a"], (x[:, 0] - x[:, 0].mean()) / (x[:, 0].std() + 1e-5))
    assert set(y["c"]) == {0.0, 1.0}
    for zca in (False, True):
        w = D.WhiteningNormalizer(zca=zca).fit(df, ["a", "b"])
        y = w.transform(df)
        np.testing.assert_allclose(np.cov(y.toPandas()[["a", "b"]].to_numpy().T, bias=True), np.eye(2), atol=1e-9)
        np.testing.assert_allclose(w.inverse(y).toPandas()[["a", "b"]].to_numpy(), x, atol=1e-9)
    one = D.WhiteningNormalizer(1).fit(df, ["a", "b"])
    assert one.transform(df).columns == ["c", "d", "a"] and set(one.inverse(one.transform(df)).columns) == {"a", "b", "c", "d"}
    u = D.unit_length(df, ["a", "b"]).toPandas()[["a", "b"]].to_numpy()
    np.testing.assert_allclose(u, x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-5))


def test_csv(spark, tmp_path):
    with gzip.open(tmp_path / "a.csv.gz", "wt") as f:
        f.write('yes,1,0.5,red\nno,2,?,blue\nyes,3,1.5,"green"\nno,1,2,red\n')
    cells = D.read_cells(spark, str(tmp_path / "a.csv.gz"))
    columns = D.infer_columns(cells)
    assert [(c.numerical, c.categories) for c in columns] == [(False, ["no", "yes"]), (False, ["1", "2", "3"]), (True, []), (False, ["blue", "green", "red"])]
    rows = {(tuple(r.input), tuple(r.target)) for r in D.encode(cells, columns).collect()}
    assert rows == {((1, 0, 0, 0.5, 0, 0, 1), (0, 1)), ((0, 0, 1, 1.5, 0, 1, 0), (0, 1)), ((1, 0, 0, 2.0, 0, 0, 1), (1, 0))}
    assert D.encode(cells, columns, D.CsvParams(missing_as_zero=True)).count() == 4
    text = tmp_path / "b.txt"
    text.write_text('1 2 3\n"x,y",4 5\n\n"a ""b""",?,?\n')
    assert [r["cells"] for r in D.read_cells(spark, str(text)).collect()] == [["1", "2", "3"], ["x,y", "4", "5"], ['a "b"', None, None]]
    text.write_text("".join(f"w{k:03d},{k % 3},{k / 2}\n" for k in range(100)))
    wide = D.read_cells(spark, str(text))
    typed = D.infer_columns(wide)
    assert (typed[0].n_categories, typed[0].table is not None, typed[1].categories, typed[2].numerical) == (100, True, ["0", "1", "2"], True)
    coded = D.encode(wide, typed).collect()
    assert sorted(r.target.index(1.0) for r in coded) == list(range(100)) and all(sum(r.target) == 1 and len(r.input) == 4 for r in coded)
    assert "column 2: numerical" in D.csv_info(wide, typed) and D.load_csv(spark, str(text)).count() == 100
    text.write_text("1.5,a\nword,b\n")
    with pytest.raises(ValueError, match="words and numbers"):
        D.infer_columns(D.read_cells(spark, str(text)))
    text.write_text("1,2\n3\n")
    with pytest.raises(ValueError, match="cells"):
        D.infer_columns(D.read_cells(spark, str(text)))
    numbers = D.CsvParams(int_as_numerical=True)
    assert D.infer_columns(cells, numbers)[1].numerical


def test_files(spark, tmp_path):
    x = np.arange(24.0).reshape(2, 3, 4)
    t = TensorFrame.of_numpy(spark, x)
    S.save_tensor(t, str(tmp_path / "t"), {"unit": "m"})
    np.testing.assert_array_equal(S.load_tensor(spark, str(tmp_path / "t"), "double").numpy(), x)
    assert S.tensor_meta(spark, str(tmp_path / "t"))["attributes"] == {"unit": "m"}
    with pytest.raises(TypeError):
        S.load_tensor(spark, str(tmp_path / "t"), "bigint")
    np.save(tmp_path / "f.npy", np.asfortranarray(x))
    np.savez(tmp_path / "z.npz", a=x, b=np.array([True, False]))
    np.testing.assert_array_equal(S.tensor_of(S.read_numpy(spark, str(tmp_path / "f.npy"))).numpy(), x)
    archive = S.read_numpy(spark, str(tmp_path / "z.npz"))
    assert sorted(r.entry for r in archive.select("entry").collect()) == ["a", "b"]
    np.testing.assert_array_equal(S.tensor_of(archive, "a").numpy(), x)
    (tmp_path / "i.gz").write_bytes(gzip.compress(struct.pack(">HBBII", 0, 8, 2, 2, 3) + bytes(range(6))))
    np.testing.assert_array_equal(S.tensor_of(S.read_idx(spark, str(tmp_path / "i.gz"))).numpy(), np.arange(6).reshape(2, 3))
    S.save_numpy(t, str(tmp_path / "o.npy"))
    np.testing.assert_array_equal(np.load(tmp_path / "o.npy"), x)


def test_splits_rows_and_templates(spark, tmp_path, sequences):
    data = D.Dataset.of_samples(spark.createDataFrame([(k, float(k)) for k in range(20)], "k long, x double"), ["k"])
    D.save_split(data.split(), str(tmp_path / "s"))
    parts = D.map_split(D.load_split(spark, str(tmp_path / "s")), lambda p: p.map(lambda c, v: v + 1))
    assert {n: p.n_samples for n, p in parts.items()} == {"trn": 16, "val": 2, "tst": 2} and [r.x for r in parts["tst"].rows()] == [19.0, 20.0]
    blank = sequences.template_batch(4)
    assert blank.count() == 4 * 98 and blank.agg(F.sum("x")).first()[0] == 0


def test_one_long_sequence_among_short_ones(spark, monkeypatch):
    """Steps are numbered across buckets, so no sequence is one task's work."""
    from tensorloom.operators import frame

    monkeypatch.setattr(frame, "BUCKET_ROWS", 500)
    rows = spark.range(5000).selectExpr("CASE WHEN id % 10 < 6 THEN 0 ELSE id % 10 END AS s", "id AS k", "id * 1.0 AS x").repartition(7)
    data = D.Dataset.of_sequences(rows, "s", ["k"])
    found = data.df.groupBy("sample_id").agg(F.count("step").alias("n"), F.countDistinct("step").alias("d"), F.max("step").alias("m"), F.min("s").alias("s")).collect()
    assert {(r.s, r.n) for r in found} == {(0, 3000), *((s, 500) for s in (6, 7, 8, 9))} and all(r.d == r.n == r.m + 1 for r in found)
    assert data.n_steps == 3000 and data.ragged


def test_exact_integers_and_images(spark, tmp_path):
    big = np.array([[2**53 + 1, -(2**63)], [2**63 - 1, 0]])
    np.savez(tmp_path / "z.npz", big=big, flags=np.array([True, False]), small=np.array([1, 2], np.uint8))
    rows = S.read_numpy(spark, str(tmp_path / "z.npz"))
    assert S.tensor_of(rows, "big").to_list() == big.tolist() and S.tensor_of(rows, "flags").to_list() == [True, False] and S.tensor_of(rows, "small").to_list() == [1, 2]
    pixels = np.arange(24, dtype=np.uint8) * 10
    (tmp_path / "x.gz").write_bytes(gzip.compress(struct.pack(">HBBIII", 0, 8, 3, 4, 2, 3) + pixels.tobytes()))
    (tmp_path / "y").write_bytes(struct.pack(">HBBI", 0, 8, 1, 4) + bytes([3, 0, 9, 3]))
    got = S.read_labelled_images(spark, str(tmp_path / "x.gz"), str(tmp_path / "y")).orderBy("record").collect()
    np.testing.assert_allclose([r.image for r in got], pixels.reshape(4, 6) / 255)
    assert [r.label.index(1.0) for r in got] == [3, 0, 9, 3] and all(sum(r.label) == 1 for r in got)


def test_store(spark, tmp_path):
    import dataclasses

    @dataclasses.dataclass
    class Setup:
        rate: float
        names: list

    store = S.TensorStore(spark, str(tmp_path / "s"))
    x = TensorFrame.of_numpy(spark, np.arange(6).reshape(2, 3))
    store.write("a/b/x", x)
    assert store.exists("a/b") and store.exists("a/b/x") and not store.exists("c") and store.names("a/b") == ["x"]
    assert store.read("a/b/x", "bigint").to_list() == x.to_list() and store.data_type("a/b/x") == "bigint"
    with pytest.raises(FileExistsError):
        store.write("a/b/x", x)
    with pytest.raises(TypeError):
        store.read("a/b/x", "double")
    store.create_groups("empty/group")
    store.set_attribute("a/b/x", "unit", "m"), store.set_attribute("a/b/x", "scale", [1, 2])
    assert store.get_attribute("a/b/x", "scale") == [1, 2] and store.attributes("a/b/x")["unit"] == "m" and store.exists("empty/group")
    store.set_record("a", Setup(0.5, ["p", "q"]))
    assert store.get_record("a", Setup) == Setup(0.5, ["p", "q"])
    S.dump_tensors(spark, str(tmp_path / "d"), {"y": np.ones(2)})
    assert S.TensorStore(spark, str(tmp_path / "d")).read("y").to_list() == [1.0, 1.0]
    assert S.TensorStore(spark, str(tmp_path / "s"), overwrite=True).names() == []
    S.save_json({"setup": Setup(1.0, []), "loss": np.float64(2.5), "x": np.arange(2)}, str(tmp_path / "j"))
    assert S.load_json(str(tmp_path / "j")) == {"setup": {"rate": 1.0, "names": []}, "loss": 2.5, "x": [0, 1]}
