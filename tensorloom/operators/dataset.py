"""Record datasets: rows with a dense 0-based ``sample_id`` (and ``step`` for sequences), one column per field.

Positions are what batches, splits and cuts are defined by, so ids come from an explicit order.  Everything below is
arithmetic on these ids: filters and projections without a shuffle, but for padding, which adds a few rows by a union,
and for cuts of sequences of different lengths, whose chunks are numbered anew.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tensorloom.operators.frame import BROADCAST_ELEMENTS, _numbered


def _zero(kind: str) -> Column:
    return F.lit(None).cast(kind) if kind.startswith(("string", "timestamp", "date", "array", "struct", "map", "binary")) else F.lit(0).cast(kind)


@dataclass
class Dataset:
    df: DataFrame
    n_samples: int
    #: Steps of the longest sequence; None where samples aren't sequences.
    n_steps: int | None = None
    #: Whether some sequences are shorter than others.
    ragged: bool = False

    @classmethod
    def of_samples(cls, df: DataFrame, order: Sequence[str]) -> Dataset:
        """Rows numbered in the order of some columns; rows with equal ones go by a hash of all their columns."""
        out, n = _numbered(df, list(order))
        return cls(out.withColumnRenamed("n", "sample_id"), n)

    @classmethod
    def of_sequences(cls, df: DataFrame, sample: str, order: Sequence[str], n_steps: int | None = None) -> Dataset:
        """Rows of a table as steps of sequences; samples are numbered by their key, steps by an order.

        All rows are numbered by key and order, and a step is a row's number less its sequence's first, so no sequence is
        one task's work.  All steps stay, also of sequences of different lengths; only ``n_steps``, if given, cuts every
        sequence to that many steps.
        """
        rows, _ = _numbered(df, [sample, *order])
        ids, n = _numbered(rows.groupBy(sample).agg(F.min("n").alias("_first"), F.count(F.lit(1)).alias("_steps")), [sample])
        ids = ids.withColumnRenamed("n", "sample_id")
        steps = rows.join(ids.drop("_steps"), df[sample].eqNullSafe(ids[sample])).drop(ids[sample]).withColumn("step", F.col("n") - F.col("_first")).drop("n", "_first")
        if n_steps is not None:
            steps = steps.where(F.col("step") < n_steps)
        least, most = ids.agg(F.min("_steps"), F.max("_steps")).first()
        if n_steps is not None and n:
            least, most = min(least, n_steps), min(most, n_steps)
        return cls(steps, n, most or 0, least != most)

    @property
    def fields(self) -> list[str]:
        return [c for c in self.df.columns if c not in ("sample_id", "step")]

    def samples(self, first: int, last: int) -> DataFrame:
        """Samples in an inclusive range."""
        if not 0 <= first <= last < self.n_samples:
            raise IndexError((first, last))
        return self.df.where(F.col("sample_id").between(first, last))

    def steps(self, first: int, last: int) -> DataFrame:
        return self.df.where(F.col("step").between(first, last))

    def part(self, first: int, last: int) -> Dataset:
        return Dataset(self.samples(first, last).withColumn("sample_id", F.col("sample_id") - first), last - first + 1, self.n_steps, self.ragged)

    def batches(self, size: int) -> DataFrame:
        """``batch_id``: contiguous batches, the last one smaller."""
        return self.df.withColumn("batch_id", F.floor(F.col("sample_id") / size))

    def padded_batches(self, size: int) -> DataFrame:
        """As ``batches``, the last one filled with samples of zeros."""
        total = math.ceil(self.n_samples / size) * size
        blank = self._blank(self.n_samples, total)
        return Dataset(self.df.unionByName(blank), total, self.n_steps, self.ragged).batches(size)

    def slot_batches(self, batch: int, slot: int) -> DataFrame:
        """Tiles of batches and time slots: ``batch_id`` outer, ``slot_id`` inner; the last ones are smaller."""
        return self.batches(batch).withColumn("slot_id", F.floor(F.col("step") / slot))

    def partition(self, ratios: Sequence[float]) -> list[Dataset]:
        """Contiguous parts of sizes trunc(ratio / sum * n); the last takes the rest."""
        out, at = [], 0
        for k, r in enumerate(ratios):
            n = self.n_samples - at if k == len(ratios) - 1 else int(r / sum(ratios) * self.n_samples)
            rows = self.df.where((F.col("sample_id") >= at) & (F.col("sample_id") < at + n)).withColumn("sample_id", F.col("sample_id") - at)
            out.append(Dataset(rows, n, self.n_steps, self.ragged))
            at += n
        return out

    def split(self, train: float = 0.8, validation: float = 0.1, test: float = 0.1) -> dict[str, Dataset]:
        return dict(zip(("trn", "val", "tst"), self.partition((train, validation, test)), strict=True))

    def cut_sequences(self, chunk: int) -> Dataset:
        """Each sequence cut into chunks of ``chunk`` steps, its last one filled with zeros; chunks follow their sample."""
        if self.ragged:
            return self._cut_ragged(chunk)
        cuts = math.ceil(self.n_steps / chunk)
        moved = self.df.withColumn("sample_id", F.col("sample_id") * cuts + F.floor(F.col("step") / chunk)).withColumn("step", F.col("step") % chunk)
        if self.n_steps % chunk:
            spark = self.df.sparkSession
            blank = spark.range(self.n_samples).select((F.col("id") * cuts + cuts - 1).alias("sample_id"), F.explode(F.sequence(F.lit(self.n_steps % chunk).cast("long"), F.lit(chunk - 1).cast("long"))).alias("step"))
            moved = moved.unionByName(blank.select(*(F.col(c) if c in ("sample_id", "step") else _zero(self.df.schema[c].dataType.simpleString()).alias(c) for c in self.df.columns)))
        return Dataset(moved, self.n_samples * cuts, chunk)

    def _cut_ragged(self, chunk: int) -> Dataset:
        """A shorter sequence has fewer chunks, so that a single long one doesn't fill up all the others."""
        at = self.df.withColumn("_cut", F.floor(F.col("step") / chunk)).withColumn("step", F.col("step") % chunk).withColumnRenamed("sample_id", "_sample")
        counts = at.groupBy("_sample", "_cut").agg(F.count(F.lit(1)).alias("_n"))
        cuts, n = _numbered(counts, ["_sample", "_cut"])
        cuts = cuts.withColumnRenamed("n", "sample_id")
        moved = at.join(cuts.drop("_n"), ["_sample", "_cut"]).select(*self.df.columns)
        blank = cuts.where(F.col("_n") < chunk).select("sample_id", F.explode(F.sequence(F.col("_n"), F.lit(chunk - 1).cast("long"))).alias("step"))
        moved = moved.unionByName(blank.select(*(F.col(c) if c in ("sample_id", "step") else _zero(self.df.schema[c].dataType.simpleString()).alias(c) for c in self.df.columns)))
        return Dataset(moved, n, chunk)

    def cut_to_min_samples(self, least: int) -> Dataset:
        cuts = math.ceil(least / self.n_samples)
        chunk = max(1, self.n_steps // cuts)
        if self.ragged:
            # Shorter sequences give fewer chunks: the largest size that still makes enough of them.
            steps = self.df.groupBy("sample_id").count()
            low, high = 1, chunk
            while low < high:
                middle = (low + high + 1) // 2
                enough = steps.agg(F.sum(F.ceil(F.col("count") / middle))).first()[0] >= least
                low, high = (middle, high) if enough else (low, middle - 1)
            chunk = low
        return self.cut_sequences(chunk)

    def rows(self) -> Iterator[Row]:
        """All rows by sample and step, one partition at a time."""
        return self.df.orderBy("sample_id", *(["step"] if self.n_steps is not None else [])).toLocalIterator()

    def template_batch(self, size: int) -> DataFrame:
        """A batch of zeros with this dataset's fields, as ``padded_batches`` fills up with."""
        return self._blank(0, size)

    def _blank(self, first: int, stop: int) -> DataFrame:
        more = self.df.sparkSession.range(first, stop).withColumnRenamed("id", "sample_id")
        if self.n_steps is not None:
            more = more.withColumn("step", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(self.n_steps - 1).cast("long"))))
        return more.select(*(F.col(c) if c in ("sample_id", "step") else _zero(self.df.schema[c].dataType.simpleString()).alias(c) for c in self.df.columns))

    def persist(self) -> Dataset:
        """This dataset, kept by the executors once it has been computed."""
        self.df.persist()
        return self

    def map(self, fn: Callable[[str, Column], Column]) -> Dataset:
        return Dataset(self.df.select("sample_id", *(["step"] if self.n_steps is not None else []), *(fn(c, F.col(c)).alias(c) for c in self.fields)), self.n_samples, self.n_steps, self.ragged)

    def save(self, path: str) -> None:
        self.df.write.parquet(path)

    @classmethod
    def load(cls, spark, path: str) -> Dataset:
        df = spark.read.parquet(path)
        row = df.agg((F.max("sample_id") + 1).alias("n"), F.count(F.lit(1)).alias("rows"), *([(F.max("step") + 1).alias("s")] if "step" in df.columns else [])).first()
        return cls(df, row["n"] or 0, row["s"] if "step" in df.columns else None, "step" in df.columns and row["rows"] != (row["n"] or 0) * (row["s"] or 0))


# -- normalisers -------------------------------------------------------------------------------------------------------
class Normalizer:
    """A column transform learned from a frame, with its inverse.  This one changes nothing."""

    def fit(self, df: DataFrame, columns: Sequence[str]) -> Normalizer:
        self.columns = list(columns)
        self.stats = df.agg(*(a for c in columns for a in self._stats(c))).first().asDict() if self._stats(columns[0]) else {}
        return self

    def _stats(self, c: str) -> list[Column]:
        return []

    def _forward(self, c: str) -> Column:
        return F.col(c)

    def _backward(self, c: str) -> Column:
        return F.col(c)

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: self._forward(c) for c in self.columns})

    def inverse(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: self._backward(c) for c in self.columns})


class Rescaling(Normalizer):
    """To 0..1; the span is 1e-5 at least."""

    def _stats(self, c):
        return [F.min(c).cast("double").alias(f"lo_{c}"), F.max(c).cast("double").alias(f"hi_{c}")]

    def _span(self, c: str) -> float:
        lo = self.stats[f"lo_{c}"]
        return max(self.stats[f"hi_{c}"], lo + 1e-5) - lo

    def _forward(self, c):
        return (F.col(c) - self.stats[f"lo_{c}"]) / self._span(c)

    def _backward(self, c):
        return F.col(c) * self._span(c) + self.stats[f"lo_{c}"]


class Standardization(Normalizer):
    """(x - mean) / (population deviation + 1e-5); optionally columns of only 0 and 1 stay."""

    def __init__(self, keep_zero_one: bool = False):
        self.keep_zero_one = keep_zero_one

    def _stats(self, c):
        return [F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"), F.bool_and(F.col(c).isin(0, 1)).alias(f"b_{c}")]

    def _pair(self, c: str) -> tuple[float, float]:
        return (0.0, 1.0) if self.keep_zero_one and self.stats[f"b_{c}"] else (self.stats[f"m_{c}"], self.stats[f"s_{c}"] + 1e-5)

    def _forward(self, c):
        mean, scale = self._pair(c)
        return (F.col(c) - mean) / scale

    def _backward(self, c):
        mean, scale = self._pair(c)
        return F.col(c) * scale + mean


class WhiteningNormalizer(Normalizer):
    """PCA or ZCA whitening of numerical columns together; with fewer components, the last columns go and come back by ``inverse``."""

    def __init__(self, n_comps: int | None = None, zca: bool = False):
        self.n_comps, self.zca = n_comps, zca

    def fit(self, df: DataFrame, columns: Sequence[str]) -> WhiteningNormalizer:
        from tensorloom.operators.linalg import Whitening

        self.columns = list(columns)
        self.whitening = Whitening.fit(df.select(self._packed(self.columns).alias("_w")), "_w", self.n_comps, self.zca)
        return self

    @staticmethod
    def _packed(columns: Sequence[str]) -> Column:
        return F.array(*(F.col(c).cast("double") for c in columns))

    def _kept(self) -> list[str]:
        return self.columns if self.zca else self.columns[: len(self.whitening.variances)]

    def transform(self, df: DataFrame) -> DataFrame:
        moved = self.whitening.transform(df.withColumn("_w", self._packed(self.columns)).drop(*self.columns), "_w")
        return moved.withColumns({c: F.col("_w")[k] for k, c in enumerate(self._kept())}).drop("_w")

    def inverse(self, df: DataFrame) -> DataFrame:
        kept = self._kept()
        moved = self.whitening.inverse(df.withColumn("_w", self._packed(kept)).drop(*kept), "_w")
        return moved.withColumns({c: F.col("_w")[k] for k, c in enumerate(self.columns)}).drop("_w")


def unit_length(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Each row's columns divided by their Euclidean norm plus 1e-5."""
    norm = F.sqrt(sum((F.col(c) * F.col(c) for c in columns), F.lit(0.0))) + 1e-5
    return df.withColumns({c: F.col(c) / norm for c in columns})


# -- typed tables from text --------------------------------------------------------------------------------------------
@dataclass(frozen=True)
class CsvParams:
    separators: str = " \t,"
    int_as_numerical: bool = False
    ordered_int: bool = False
    missing_as_zero: bool = False
    target_columns: tuple[int, ...] = (0,)


#: Categories up to which a column's table is written into the plan; larger ones are joined.
PLAN_CATEGORIES = 64


@dataclass
class CsvColumn:
    numerical: bool
    #: All of them, sorted, where there are at most ``PLAN_CATEGORIES``.
    categories: list[str]
    n_categories: int = 0
    #: (category, id) where there are more.
    table: DataFrame | None = None


def read_cells(spark, path: str, params: CsvParams = CsvParams()) -> DataFrame:
    """Lines of a headerless file (gzip too) as arrays of cells; ``?`` is missing.

    Every separator character ends a cell; one within double quotes doesn't, and two quotes there are one.
    """
    signs = "".join("\\" + c if c in "\\]^-" else c for c in params.separators)
    found = F.regexp_extract_all("line", F.lit(f'(?:^|[{signs}])("(?:[^"]|"")*"|[^{signs}]*)'), 1)
    plain = lambda c: F.when(c.startswith('"') & c.endswith('"') & (F.length(c) > 1), F.replace(c.substr(F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))).otherwise(c)
    cells = F.transform(F.transform(found, plain), lambda c: F.trim(c))
    lines = spark.read.text(path).select(F.trim("value").alias("line")).where("line <> ''")
    return lines.select(F.transform(cells, lambda c: F.when(c != "?", c)).alias("cells"))


def infer_columns(cells: DataFrame, params: CsvParams = CsvParams()) -> list[CsvColumn]:
    """The type of every column from one pass over all rows; category tables are sorted.

    A column of words and numbers is an error; whole numbers beside real ones are numbers, and beside words they are
    categories unless whole numbers were asked to be numbers.  Rows of different widths are an error.
    """
    whole, real = "^[+-]?[0-9]+$", r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
    least, width = cells.select(F.min(F.size("cells")), F.max(F.size("cells"))).first()
    if least != width:
        raise ValueError(f"rows have from {least} to {width} cells")
    flat = cells.select(F.posexplode("cells").alias("k", "c")).where("c IS NOT NULL")
    c = F.col("c")
    kinds = flat.groupBy("k").agg(F.bool_or(c.rlike(whole)).alias("whole"), F.bool_or(c.rlike(real) & ~c.rlike(whole)).alias("real"), F.bool_or(~c.rlike(real)).alias("word")).collect()
    for r in kinds:
        if r.word and (r.real or (r.whole and params.int_as_numerical)):
            raise ValueError(f"column {r.k} has both words and numbers")
    numerical = {r.k: not r.word and (r.real or params.int_as_numerical) for r in kinds}
    named = [k for k, n in numerical.items() if not n]
    different = flat.where(F.col("k").isin(named)).distinct()
    counts = {r.k: r["count"] for r in different.groupBy("k").count().collect()} if named else {}
    small = [k for k, n in counts.items() if n <= PLAN_CATEGORIES]
    lists = {r.k: r.s for r in different.where(F.col("k").isin(small)).groupBy("k").agg(F.sort_array(F.collect_list("c")).alias("s")).collect()} if small else {}
    out = []
    for k in range(width or 0):
        many = counts.get(k, 0)
        table = _numbered(different.where(F.col("k") == k).select("c"), ["c"])[0].withColumnRenamed("n", "id") if many > PLAN_CATEGORIES else None
        out.append(CsvColumn(numerical.get(k, False), lists.get(k, []), many, table))
    return out


def encode(cells: DataFrame, columns: list[CsvColumn], params: CsvParams = CsvParams()) -> DataFrame:
    """(input, target): arrays of the encoded columns; rows with a missing cell are left out unless missing counts as zero."""
    rows = cells if params.missing_as_zero else cells.where(~F.exists("cells", lambda c: c.isNull()))
    for k, column in enumerate(columns):
        if column.table is not None:
            table = column.table.select(F.col("c").alias(f"_c{k}"), F.col("id").alias(f"_id{k}"))
            table = F.broadcast(table) if column.n_categories <= BROADCAST_ELEMENTS else table
            rows = rows.withColumn(f"_at{k}", F.get("cells", F.lit(k))).join(table, F.col(f"_at{k}") == F.col(f"_c{k}"), "left")

    def one(k: int, column: CsvColumn) -> Column:
        c = F.get("cells", F.lit(k))
        if column.numerical:
            return F.array(F.coalesce(c.cast("double"), F.lit(0.0)))
        n, target = column.n_categories, k in params.target_columns
        at = F.col(f"_id{k}") if column.table is not None else F.array_position(F.array(*map(F.lit, column.categories)), c) - 1 if n else F.lit(0)
        at = F.coalesce(at, F.lit(0))
        if params.ordered_int or (n == 2 and not target):
            return F.array(at.cast("double"))
        if n <= 1:
            return F.array().cast("array<double>")
        return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda x: (x == at).cast("double"))

    join = lambda ks: F.concat(*(one(k, columns[k]) for k in ks)) if ks else F.array().cast("array<double>")
    inputs = [k for k in range(len(columns)) if k not in params.target_columns]
    return rows.select(join(inputs).alias("input"), join(list(params.target_columns)).alias("target"))


def csv_info(cells: DataFrame, columns: list[CsvColumn], params: CsvParams = CsvParams()) -> str:
    """The columns' types and the first five rows, as text."""
    lines = []
    for k, c in enumerate(columns):
        kind = "numerical" if c.numerical else f"categorical with {c.n_categories} values" + (f": {', '.join(c.categories)}" if c.categories else "")
        lines.append(f"{'target' if k in params.target_columns else 'column'} {k}: {kind}")
    lines.append("|".join(f"{f'*{k}*' if k in params.target_columns else k:^17}" for k in range(len(columns))))
    for r in cells.limit(5).collect():
        lines.append("|".join(f"{'?' if x is None else x[:17]:^17}" for x in r["cells"]))
    return "\n".join(lines)


def load_csv(spark, path: str, params: CsvParams = CsvParams()) -> DataFrame:
    """(input, target) of a file, typed and encoded."""
    cells = read_cells(spark, path, params)
    return encode(cells, infer_columns(cells, params), params)


# -- splits ------------------------------------------------------------------------------------------------------------
def save_split(parts: dict[str, Dataset], path: str) -> None:
    """Each part under its name."""
    for name, part in parts.items():
        part.save(f"{path}/{name}")


def load_split(spark, path: str, names: Sequence[str] = ("trn", "val", "tst")) -> dict[str, Dataset]:
    return {name: Dataset.load(spark, f"{path}/{name}") for name in names}


def map_split(parts: dict[str, Dataset], fn: Callable[[Dataset], Dataset]) -> dict[str, Dataset]:
    return {name: fn(part) for name, part in parts.items()}
