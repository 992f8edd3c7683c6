"""Tensors in files: Parquet with a shape sidecar, NumPy .npy and .npz, and IDX image or label files."""

from __future__ import annotations

import dataclasses
import gzip
import io
import json
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorloom.operators.frame import TensorFrame


def save_tensor(t: TensorFrame, path: str, attributes: dict | None = None, mode: str = "errorifexists") -> None:
    """Elements under ``path/data``; shape, type and attributes as one JSON row under ``path/meta``."""
    t.df.write.mode(mode).parquet(f"{path}/data")
    meta = json.dumps({"shape": t.shape, "dtype": t.dtype, "attributes": attributes or {}})
    t.spark.createDataFrame([(meta,)], "value string").coalesce(1).write.mode(mode).text(f"{path}/meta")


def tensor_meta(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/meta").first()[0])


def load_tensor(spark: SparkSession, path: str, dtype: str | None = None) -> TensorFrame:
    """A saved tensor; ``dtype``: the type it must have."""
    meta = tensor_meta(spark, path)
    if dtype is not None and dtype != meta["dtype"]:
        raise TypeError(f"{path} holds {meta['dtype']}, not {dtype}")
    return TensorFrame(spark.read.parquet(f"{path}/data"), meta["shape"])


def _rows(name: str, entry: str, a: np.ndarray) -> dict:
    flat, whole = a.reshape(-1), a.dtype.kind in "iu"
    if a.dtype.kind == "u" and flat.size and int(flat.max()) > 2**63 - 1:
        raise ValueError(f"{name} {entry} has numbers beyond 64 signed bits")
    return {"path": name, "entry": entry, "shape": list(a.shape), "dtype": str(a.dtype), "values": None if whole else flat.astype(float).tolist(), "longs": flat.astype(np.int64).tolist() if whole else None}


#: Integers stay exact in ``longs``; all other numbers are in ``values``.
_SCHEMA = "path string, entry string, shape array<long>, dtype string, values array<double>, longs array<bigint>"
_COLUMNS = ["path", "entry", "shape", "dtype", "values", "longs"]


def read_numpy(spark: SparkSession, path: str) -> DataFrame:
    """One row per array of .npy and .npz files (folders and globs too): path, entry, shape, dtype, row-major values or longs."""

    def parse(tables: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for table in tables:
            out = []
            for name, content in zip(table["path"], table["content"], strict=True):
                found = np.load(io.BytesIO(content), allow_pickle=False)
                if isinstance(found, np.ndarray):
                    out.append(_rows(name, "", found))
                else:
                    out += [_rows(name, k, found[k]) for k in found.files]
            yield pd.DataFrame(out, columns=_COLUMNS)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, _SCHEMA)


def read_idx(spark: SparkSession, path: str) -> DataFrame:
    """IDX files, gzipped or not, as rows like ``read_numpy``."""

    def parse(tables: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for table in tables:
            out = []
            for name, content in zip(table["path"], table["content"], strict=True):
                data = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
                zero, kind, rank = struct.unpack(">HBB", data[:4])
                if zero or kind != 8:
                    raise ValueError(f"{name} is not an IDX file of bytes")
                shape = struct.unpack(f">{rank}I", data[4 : 4 + 4 * rank])
                out.append(_rows(name, "", np.frombuffer(data, np.uint8, offset=4 + 4 * rank).reshape(shape)))
            yield pd.DataFrame(out, columns=_COLUMNS)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, _SCHEMA)


def read_image_records(spark: SparkSession, path: str, shape: tuple[int, ...] = (3, 32, 32)) -> DataFrame:
    """Binary files of fixed records, a label byte and then an image's bytes: path, record, label, image (row-major)."""
    size = int(np.prod(shape))

    def parse(tables: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for table in tables:
            for name, content in zip(table["path"], table["content"], strict=True):
                if len(content) % (size + 1):
                    raise ValueError(f"{name} doesn't hold whole records")
                rows = np.frombuffer(content, np.uint8).reshape(-1, size + 1)
                for at in range(0, len(rows), 1000):
                    part = rows[at : at + 1000]
                    yield pd.DataFrame({"path": name, "record": np.arange(at, at + len(part)), "label": part[:, 0].astype(int), "image": list(part[:, 1:].astype(np.int16))})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, "path string, record long, label int, image array<smallint>")


def read_scaled_records(spark: SparkSession, path: str, shape: tuple[int, ...] = (3, 32, 32), classes: int = 10) -> DataFrame:
    """(path, record, image, label) of ``read_image_records``: values divided by 255, labels as one of ``classes``."""
    rows = read_image_records(spark, path, shape)
    one = F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda k: (k == F.col("label")).cast("double"))
    return rows.select("path", "record", F.transform("image", lambda v: v / 255.0).alias("image"), one.alias("label"))


def save_parameters(spark: SparkSession, parameters: dict[str, np.ndarray | float], path: str, mode: str = "errorifexists") -> None:
    """Named parameters of a model as one Parquet row each: name, shape, row-major values."""
    rows = [(k, list(np.shape(v)), np.asarray(v, float).reshape(-1).tolist()) for k, v in parameters.items()]
    spark.createDataFrame(rows, "name string, shape array<int>, values array<double>").coalesce(1).write.mode(mode).parquet(path)


def load_parameters(spark: SparkSession, path: str) -> dict[str, np.ndarray]:
    return {r.name: np.array(r["values"]).reshape(r.shape) for r in spark.read.parquet(path).collect()}


def tensor_of(rows: DataFrame, entry: str = "") -> TensorFrame:
    """The tensor of one entry of ``read_numpy`` or ``read_idx``; integers and booleans keep their kind."""
    one = rows.where(F.col("entry") == entry)
    first = one.select("shape", "dtype").first()
    cells = "longs" if first["dtype"].startswith(("int", "uint")) else "values"
    flat = TensorFrame(one.select(F.posexplode(cells).alias("i0", "v")).withColumn("i0", F.col("i0").cast("long")), (int(np.prod(first["shape"])),))
    return (flat.map(lambda v: v != 0) if first["dtype"] == "bool" else flat).reshape(first["shape"])


def read_labelled_images(spark: SparkSession, images: str, labels: str, classes: int = 10) -> DataFrame:
    """(record, image, label) of a pair of IDX files: grey values divided by 255 (row-major), labels as one of ``classes``."""
    x = read_idx(spark, images).select(F.col("shape"), "longs")
    size = F.aggregate(F.slice("shape", F.lit(2), F.size("shape") - 1), F.lit(1).cast("long"), lambda a, n: a * n)
    records = F.transform(F.sequence(F.lit(0).cast("long"), F.col("shape")[0] - 1), lambda k: F.slice("longs", (k * size + 1).cast("int"), size.cast("int")))
    shown = x.select(F.posexplode(records).alias("record", "image")).withColumn("image", F.transform("image", lambda v: v / 255.0))
    named = read_idx(spark, labels).select(F.posexplode("longs").alias("record", "label"))
    one = F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda k: (k == F.col("label")).cast("double"))
    return shown.join(named, "record").select(F.col("record").cast("long").alias("record"), "image", one.alias("label"))


class TensorStore:
    """A folder of named tensors in groups, with attributes and records beside them.

    Names are paths like ``group/sub/name``.  A tensor is a Parquet table with its shape and type; attributes and records
    are one JSON row, replaced as a whole.  The folder may be in any file system that Spark reaches.
    """

    def __init__(self, spark: SparkSession, path: str, overwrite: bool = False):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._system = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if overwrite:
            self._system.delete(self._path(self.path), True)

    def exists(self, name: str) -> bool:
        """Whether there is a tensor or a group of this name."""
        return self._system.exists(self._path(f"{self.path}/{name}"))

    def create_groups(self, name: str) -> None:
        self._system.mkdirs(self._path(f"{self.path}/{name}"))

    def names(self, group: str = "") -> list[str]:
        """Names of the tensors and groups within a group."""
        at = self._path(f"{self.path}/{group}".rstrip("/"))
        return sorted(f.getPath().getName() for f in self._system.listStatus(at) if f.isDirectory()) if self._system.exists(at) else []

    def write(self, name: str, tensor: TensorFrame) -> None:
        """FileExistsError where the name is taken."""
        if self.exists(f"{name}/meta"):
            raise FileExistsError(name)
        save_tensor(tensor, f"{self.path}/{name}")

    def read(self, name: str, dtype: str | None = None) -> TensorFrame:
        return load_tensor(self.spark, f"{self.path}/{name}", dtype)

    def data_type(self, name: str) -> str:
        return tensor_meta(self.spark, f"{self.path}/{name}")["dtype"]

    def attributes(self, name: str) -> dict:
        """Attributes of a tensor or a group."""
        if not self.exists(f"{name}/attributes"):
            return {}
        return json.loads(self.spark.read.text(f"{self.path}/{name}/attributes").first()[0])

    def set_attribute(self, name: str, key: str, value) -> None:
        found = self.attributes(name) | {key: value}
        self.spark.createDataFrame([(json.dumps(found),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/{name}/attributes")

    def get_attribute(self, name: str, key: str):
        return self.attributes(name)[key]

    def set_record(self, name: str, record) -> None:
        """One attribute for each field of a dataclass or a dict."""
        fields = record if isinstance(record, dict) else dataclasses.asdict(record)
        for key, value in fields.items():
            self.set_attribute(name, key, value)

    def get_record(self, name: str, kind: type):
        """The dataclass whose fields are the attributes."""
        found = self.attributes(name)
        return kind(**{f.name: found[f.name] for f in dataclasses.fields(kind)})


def dump_tensors(spark: SparkSession, path: str, tensors: dict[str, np.ndarray]) -> None:
    """What expressions dumped while they were evaluated, one tensor each in a store."""
    store = TensorStore(spark, path)
    for name, x in tensors.items():
        store.write(name, TensorFrame.of_numpy(spark, np.asarray(x)))


def save_json(value, path: str) -> None:
    """A configuration or a result on the driver's file system; dataclasses become objects, arrays lists."""

    def plain(x):
        if dataclasses.is_dataclass(x):
            return dataclasses.asdict(x)
        return x.tolist() if isinstance(x, (np.ndarray, np.generic)) else str(x)

    with open(path, "w", encoding="utf-8") as f:
        json.dump(value, f, default=plain, indent=1)


def load_json(path: str):
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def save_numpy(t: TensorFrame, path: str) -> None:
    """A small tensor as .npy on the driver's file system."""
    np.save(path, t.numpy())
