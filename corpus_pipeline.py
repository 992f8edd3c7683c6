"""A corpus pipeline over documents: quality, language, near duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs.  All but the last return the columns of documents; the last returns packed pieces.

Defined results, from the operators': a null or empty text goes in the first stage; null ids, languages and sources are
carried through (a null source is a source of its own); of rows that repeat an id and text one stays; an empty table gives
an empty table; where no document has a language, none can be told apart and only texts without letters go.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tensorloom.llm import langid, mixing, neardup, packing, quality
from tensorloom.llm._shared import discard, materialise


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules keep."""
    return quality.quality_filter(docs)


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; the classifier learns from these documents themselves."""
    return langid.language_filter(docs, langid.fit_documents(docs))


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: those that share at least 80 % of their five-word shingles."""
    return neardup.keep_one_of_each(docs, neardup.NearDupParams(percent=80))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, packed into sequences of 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", keep_good),
    ("language", keep_known_languages),
    ("near_duplicates", keep_one_copy),
    ("mix", mix_sources),
    ("pack", pack_sequences),
]

#: The classifiers, signatures, tilts and packing are beyond SQL; tests compare the stages' operators with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents in ``sf_dir``."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
