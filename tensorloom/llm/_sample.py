"""A bounded sample of rows for each class, the same at every rerun."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Shares in which a class is ranked, coarser each time, so that a class with most of the rows isn't ranked in one task.
SHARES = (64, 8, 1)


def held_out(doc_id: str):
    """Whether crc32 of the id's decimal text leaves 2 when divided by 4; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def sample_per_class(rows: DataFrame, doc_id: str, key: str, per_class: int) -> DataFrame:
    """Up to ``per_class`` rows (doc_id, key) of each non-null class, those with the smallest hash of the id."""
    narrow = rows.select(F.col(doc_id).alias("doc_id"), F.col(key).alias("key")).where("doc_id IS NOT NULL AND key IS NOT NULL")
    left = narrow.select("*", F.xxhash64("doc_id").alias("h"))
    for shares in SHARES:
        own = Window.partitionBy("key", F.pmod("h", F.lit(shares))).orderBy("h", "doc_id")
        left = left.withColumn("r", F.row_number().over(own)).where(F.col("r") <= per_class).drop("r")
    return left.select("doc_id", "key")


def sampled_rows(docs: DataFrame, ids: DataFrame, doc_id: str, text: str, max_bytes: int | None = None) -> DataFrame:
    """(doc_id, key, whole text) of a sample of ids, whose bound is proven; without texts of more than ``max_bytes``."""
    small = docs.sparkSession.createDataFrame([(r.doc_id, str(r.key)) for r in ids.collect()], "doc_id long, key string")
    body = F.coalesce(F.col(text), F.lit("")).alias("text")
    rows = docs.where(F.octet_length(F.col(text)) <= max_bytes) if max_bytes is not None else docs
    return rows.select(F.col(doc_id).cast("long").alias("doc_id"), body).join(F.broadcast(small), "doc_id").select("doc_id", "key", "text")


def sample_texts(docs: DataFrame, ids: DataFrame, doc_id: str, text: str, max_bytes: int) -> list[tuple[int, object, str]]:
    """(id, class, whole text) of a sample, ordered by id, on the driver: bounded in rows by ``ids`` and in bytes a text."""
    return sorted({(r.doc_id, r.key, r.text) for r in sampled_rows(docs, ids, doc_id, text, max_bytes).collect()})
