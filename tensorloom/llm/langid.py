"""Language identification by the nearest of several clustered centroids per language.

A text is a TF-IDF vector of hashed byte n-grams (2 to 4) of its lower-cased letters, scaled to unit length.  Spherical
k-means gives each language a few centroids; a text gets the language of the centroid with the largest cosine.  A text
whose cosine distance to it is beyond the language's radius is ``rejected``: it still names the nearest language.

A text of few different n-grams has a small cosine even in its own language, and long gibberish a large one, so the
radius depends on their number n: a language's usual cosine is fitted as 1 / sqrt(base + slope / n) to training texts
held back from its centroids, and the radius is set from a low quantile of these texts' cosines over the usual one.

The classifier is fit on at most ``per_language`` documents of each language (a documented bound); every document is
then judged on its whole text.  Executors turn the sampled texts into sparse counts, at most one number a bucket however
long a text is, so that is all the driver gets; it holds the dense vectors of one language at a time.  Scoring is one pass
without a shuffle; the model is a few hundred kilobytes.

Defined results: a null text, or one without a letter, is ``und`` with score 0 and rejected; without labelled rows nothing
can be told apart, so every text is ``und`` with score 0, and only texts without a letter are rejected; equal cosines
(also of 0, where a text shares no n-gram with any centroid) go to the language that is first by code point; equal texts
get equal answers; rows that repeat an id and text are learned once; a null doc_id is carried through and isn't learned
from; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tensorloom.llm import _tables
from tensorloom.llm._blocks import U64, byte_blocks, text_column
from tensorloom.llm._grams import lowered, plain, rolling
from tensorloom.llm._sample import held_out, sample_per_class, sampled_rows

UNKNOWN = "und"
#: Bytes that one pass covers: its arrays stay within a core's cache.
_BLOCK = 1 << 18


@dataclass(frozen=True)
class LangIdParams:
    per_language: int = 500
    centroids: int = 4
    lengths: tuple[int, ...] = (2, 3, 4)
    #: At most 2**15, as buckets travel as 16-bit numbers.
    buckets: int = 1 << 13
    rounds: int = 12
    #: The least cosine of a language, over its usual one: ``slack`` times this quantile of its held-back texts'.
    quantile: float = 0.01
    slack: float = 0.55


@dataclass
class LangIdModel:
    params: LangIdParams
    idf: np.ndarray
    centroids: np.ndarray
    owner: list[str]
    #: Of each centroid's language: base, slope and least cosine over the usual one.
    radius: np.ndarray

    def floors(self, near: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The least cosine that a text of ``n`` different n-grams needs with its centroid."""
        base, slope, least = self.radius[near].T
        return least / np.sqrt(base + slope / np.maximum(n, 1))


def _grams_of(texts: pa.Array, params: LangIdParams) -> Iterator[list[np.ndarray]]:
    """The buckets of all n-grams of each text, one array per length."""
    for _, _, data, offsets in byte_blocks(lowered(texts), _BLOCK):
        data, offsets = plain(data, offsets)
        grams = [((h >> U64(20)) & U64(params.buckets - 1)).astype(np.int32) for _, h in rolling(data, params.lengths)]
        for r in range(len(offsets) - 1):
            yield [g[offsets[r] : max(offsets[r], offsets[r + 1] - n + 1)] for g, n in zip(grams, params.lengths, strict=True)]


def counts(texts: pa.Array, params: LangIdParams) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of each text the buckets of its n-grams, ascending, and how often each occurs."""
    for grams in _grams_of(texts, params):
        many = np.bincount(np.concatenate(grams), minlength=params.buckets)
        bucket = np.flatnonzero(many)
        yield bucket.astype(np.int16), many[bucket].astype(np.int32)


def vectors(texts: pa.Array, params: LangIdParams, idf: np.ndarray) -> Iterator[np.ndarray]:
    """Unit TF-IDF vectors (rows x buckets) of up to 256 texts at a time."""
    out = np.zeros((256, params.buckets), np.float32)
    n = 0
    for grams in _grams_of(texts, params):
        out[n] = np.bincount(np.concatenate(grams), minlength=params.buckets)
        n += 1
        if n == len(out):
            yield _unit(out, idf)
            n = 0
    if n:
        yield _unit(out[:n], idf)


def _unit(x: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Counts as unit TF-IDF vectors, in place."""
    np.log1p(x, out=x)
    x *= idf
    x /= np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), 1e-12)[:, None]
    return x


def _cluster(x: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """Spherical k-means from a farthest-first start."""
    mean = x.mean(0)
    chosen = [int(np.argmax(x @ mean))]
    while len(chosen) < min(k, len(x)):
        chosen.append(int(np.argmin((x @ x[chosen].T).max(1))))
    centres = x[chosen].copy()
    for _ in range(rounds):
        near = (x @ centres.T).argmax(1)
        for j in range(len(centres)):
            if (near == j).any():
                centres[j] = x[near == j].mean(0)
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    return centres


def _held_back(x: np.ndarray, params: LangIdParams) -> np.ndarray:
    """Cosine of each text with the nearest centroid of the other half of its language's texts."""
    out = np.zeros(len(x))
    for k in (0, 1):
        # A language with a single text has nothing to hold back.
        own = _cluster(x[k::2] if len(x) > 1 else x, params.centroids, params.rounds)
        out[1 - k :: 2] = (x[1 - k :: 2] @ own.T).max(1, initial=0.0)
    return out


def _radius(cos: np.ndarray, n: np.ndarray, params: LangIdParams) -> tuple[float, float, float]:
    """base, slope and the least cosine over the usual one, 1 / sqrt(base + slope / n)."""
    inverse, terms = 1 / np.maximum(cos, 0.02) ** 2, np.stack([np.ones(len(n)), 1 / np.maximum(n, 1)], 1)
    weight, base, slope = np.ones(len(n)), 1.0, 0.0
    for _ in range(10):  # reweighted, so that a few odd texts don't bend the curve
        scale = weight / inverse
        base, slope = np.linalg.lstsq(terms * scale[:, None], inverse * scale, rcond=None)[0]
        weight = np.maximum(np.abs(terms @ [base, slope] - inverse) / inverse, 0.05) ** -0.5
    base, slope = max(float(base), 0.5), max(float(slope), 0.0)
    return base, slope, params.slack * float(np.quantile(cos * np.sqrt(terms @ [base, slope]), params.quantile))


def fit_counts(rows: list[tuple[str, np.ndarray, np.ndarray]], params: LangIdParams = LangIdParams()) -> LangIdModel | None:
    """A model from (language, buckets, counts) of texts; None without texts."""
    if not rows:
        return None
    held = np.zeros(params.buckets, np.int64)
    for _, bucket, _ in rows:
        held[bucket] += 1
    idf = (np.log((1 + len(rows)) / (1 + held)) + 1).astype(np.float32)
    centres, owner, radius = [], [], []
    for lang in sorted({lang for lang, _, _ in rows}):
        own = [(bucket, many) for name, bucket, many in rows if name == lang]
        x = np.zeros((len(own), params.buckets), np.float32)
        for r, (bucket, many) in enumerate(own):
            x[r, bucket] = many
        _unit(x, idf)
        centre = _cluster(x, params.centroids, params.rounds)
        centres.append(centre)
        owner += [lang] * len(centre)
        radius += [_radius(_held_back(x, params), np.array([len(bucket) for bucket, _ in own]), params)] * len(centre)
    return LangIdModel(params, idf, np.concatenate(centres), owner, np.array(radius))


def _lettered(texts: pa.Array) -> np.ndarray:
    return pc.match_substring_regex(texts, r"\p{L}").to_numpy(zero_copy_only=False).astype(bool)


def fit(rows: list[tuple[str, str]], params: LangIdParams = LangIdParams()) -> LangIdModel | None:
    """A model from (language, text) pairs; None where no text has a letter."""
    texts = pa.array([text for _, text in rows], pa.large_string())
    lettered = _lettered(texts) if rows else []
    return fit_counts([(lang, *found) for (lang, _), found, ok in zip(rows, counts(texts, params), lettered, strict=True) if ok], params)


def predict(texts: pa.Array, model: LangIdModel | None) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and rejection of each text of an Arrow string column without nulls."""
    letters = _lettered(texts)
    if model is None or not len(texts):
        return [UNKNOWN] * len(texts), np.zeros(len(texts)), ~letters
    best, near, grams = [], [], []
    for x in vectors(texts, model.params, model.idf):
        cos = x @ model.centroids.T
        near.append(cos.argmax(1))
        best.append(cos.max(1))
        grams.append(np.count_nonzero(x, axis=1))
    near, score = np.concatenate(near), np.clip(np.concatenate(best).astype(float), 0, 1)
    langs = [model.owner[k] if ok else UNKNOWN for k, ok in zip(near, letters, strict=True)]
    return langs, np.where(letters, score, 0.0), ~letters | (score < model.floors(near, np.concatenate(grams)))


def fit_documents(docs: DataFrame, params: LangIdParams = LangIdParams(), doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> LangIdModel | None:
    """Learn from documents that aren't held out and have a language."""
    ids = sample_per_class(docs.where(~held_out(doc_id)), doc_id, lang, params.per_language)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _tables.enter("langid")
        for batch in batches:
            batch = batch.filter(pa.array(_lettered(text_column(batch, "text"))))
            for lo in range(0, batch.num_rows, 100):
                part = batch.slice(lo, 100)
                found = list(counts(text_column(part, "text"), params))
                lists = [pa.array([x[k] for x in found], pa.list_(kind)) for k, kind in ((0, pa.int16()), (1, pa.int32()))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *lists], names=["doc_id", "key", "bucket", "many"])

    rows = sampled_rows(docs, ids, doc_id, text).mapInArrow(count, "doc_id long, key string, bucket array<smallint>, many array<int>").toArrow()
    if not rows.num_rows:
        return None
    # In a fixed order, repeated rows once: the model is the same at every rerun.
    columns = [rows.column(c).combine_chunks() for c in ("doc_id", "key", "bucket", "many")]
    found = {(d, k): i for i, (d, k) in enumerate(zip(columns[0].to_pylist(), columns[1].to_pylist(), strict=True))}
    if len(found) < rows.num_rows:
        found = {(d, k, b.as_py() and tuple(b.as_py()), tuple(m.as_py())): i for i, (d, k, b, m) in enumerate(zip(columns[0].to_pylist(), columns[1].to_pylist(), columns[2], columns[3], strict=True))}
    model = fit_counts([(key[1], columns[2][i].values.to_numpy(), columns[3][i].values.to_numpy()) for key, i in sorted(found.items())], params)
    del rows, columns
    _tables.trim()
    return model


def identify(docs: DataFrame, model: LangIdModel | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected of every document."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _tables.enter("langid")
        for batch in batches:
            if batch.num_rows:
                langs, score, rejected = predict(text_column(batch, "text"), model)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(score), pa.array(rejected)], names=["doc_id", "held_out", "lang_pred", "score", "rejected"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), held_out(doc_id).alias("held_out"), F.col(text).alias("text")).mapInArrow(judge, f"doc_id {kind}, held_out boolean, lang_pred string, score double, rejected boolean")


def language_filter(docs: DataFrame, model: LangIdModel | None, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that aren't rejected, with all their columns."""
    at = docs.columns.index(text)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _tables.enter("langid")
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(~predict(batch.column(at).cast(pa.large_string()).fill_null(""), model)[2]))

    return docs.mapInArrow(keep, docs.schema)
