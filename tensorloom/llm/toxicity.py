"""Toxicity by subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of its whole self and its byte n-grams (3 to 6, with its ends marked); n-grams are hashed to rows of an
embedding table, so a misspelling that was never seen shares most of its vectors with the word it comes from.  The bags
of a window of words are averaged, a linear softmax gives the window's score, and a text scores as its worst window:
one insult in a long text isn't thinned out.  Table and softmax are trained together by Adagrad on log loss, first on
averages of whole texts, then on each text's worst window.

The classifier is fit on at most ``per_class`` labelled documents of each class, none of more than ``max_text_bytes`` (both
documented bounds).  A trained model
needs one number per bucket (embedding times the difference of the two softmax rows), half a megabyte, so scoring is a
table look-up over all bytes of every whole text in one pass without a shuffle.

Defined results: an empty or null text, or one without letters, scores ``EMPTY`` (0); without labelled rows every score
is 0; equal texts score alike; labels with a null id or value are ignored; labels that contradict each other for one id
count as toxic; rows that repeat an id and text are learned once; a null doc_id is carried through; an empty table gives an
empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tensorloom.llm import _tables
from tensorloom.llm._blocks import U64, RangeHash, byte_blocks, text_column
from tensorloom.llm._grams import lowered, plain, rolling
from tensorloom.llm._sample import held_out, sample_per_class, sample_texts

EMPTY = 0.0


@dataclass(frozen=True)
class ToxicityParams:
    per_class: int = 800
    #: Labelled texts of more bytes than this aren't learned from (they are scored like all others).
    max_text_bytes: int = 1 << 17
    lengths: tuple[int, ...] = (3, 4, 5, 6)
    buckets: int = 1 << 17
    dim: int = 8
    window: int = 12
    stride: int = 6
    warm_epochs: int = 6
    epochs: int = 20
    rate: float = 0.5
    threshold: float = 0.3


@dataclass
class ToxicityModel:
    params: ToxicityParams
    #: Of each bucket, embedding times (softmax row of 1 - row of 0); and the difference of the biases.
    weight: np.ndarray
    bias: float


def _features(data: np.ndarray, offsets: np.ndarray, params: ToxicityParams):
    """Plain bytes' features: (place, bucket) arrays per kind, then word starts and the first word of each row."""
    data, offsets = plain(data, offsets)
    blank = data == 0x20
    sums = np.zeros(len(data) + 1, np.int64)
    np.cumsum(blank, out=sums[1:])
    begin = np.zeros(len(data), bool)
    begin[1:] = ~blank[1:] & blank[:-1]
    start = np.flatnonzero(begin)
    # A row ends with a space, so each word has one behind it.
    gaps = np.flatnonzero(blank)
    end = gaps[np.searchsorted(gaps, start)] if len(start) else start
    mask = U64(params.buckets - 1)
    found = []
    for n, h in rolling(data, params.lengths):
        at = np.arange(max(len(data) - n + 1, 0))
        at = at[sums[at + n - 1] == sums[at + 1]] if n > 1 else at
        found.append((at, ((h[at] >> U64(24)) & mask).astype(np.int32)))
    found.append((start - 1, (RangeHash(data)(start, end) & mask).astype(np.int32)))
    return found, start, end, np.searchsorted(start, offsets), len(data)


def _windows(start: np.ndarray, end: np.ndarray, first: np.ndarray, params: ToxicityParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and last place of each window; a row without words has none."""
    counts = np.diff(first)
    per_row = np.where(counts > 0, 1 + np.maximum(0, -(-(counts - params.window) // params.stride)), 0)
    row = np.repeat(np.arange(len(counts)), per_row)
    k = np.arange(len(row)) - np.repeat(np.cumsum(per_row) - per_row, per_row)
    lo = first[row] + k * params.stride
    hi = np.minimum(lo + params.window, first[row + 1])
    return row, start[lo] - 1, end[hi - 1]


def _logits(found, n: int, lo: np.ndarray, hi: np.ndarray, model: ToxicityModel) -> np.ndarray:
    total, count = np.zeros(n + 1), np.zeros(n + 1)
    here, many = np.zeros(n), np.zeros(n)
    for at, bucket in found:  # places of one kind are distinct
        here[at] += model.weight[bucket]
        many[at] += 1
    np.cumsum(here, out=total[1:])
    np.cumsum(many, out=count[1:])
    return (total[hi] - total[lo]) / np.maximum(count[hi] - count[lo], 1) + model.bias


def score(texts: pa.Array, model: ToxicityModel | None) -> np.ndarray:
    """The score of each text of an Arrow string column without nulls."""
    if model is None or not len(texts):
        return np.full(len(texts), EMPTY)
    parts = []
    for _, _, data, offsets in byte_blocks(lowered(texts)):
        found, start, end, first, n = _features(data, offsets, model.params)
        row, lo, hi = _windows(start, end, first, model.params)
        worst = np.full(len(offsets) - 1, -np.inf)
        np.maximum.at(worst, row, _logits(found, n, lo, hi, model))
        parts.append(np.where(np.isinf(worst), EMPTY, 1 / (1 + np.exp(-np.clip(worst, -500, 500)))))
    return np.concatenate(parts)


def fit(rows: list[tuple[int, str]], params: ToxicityParams = ToxicityParams()) -> ToxicityModel | None:
    """A model from (label, text) pairs; None unless both labels occur with words."""
    texts = pa.array([text for _, text in rows], pa.large_string())
    label = np.array([y for y, _ in rows])
    buckets, los, his, owners, base, n_rows = [], [], [], [], 0, 0
    for _, _, data, offsets in byte_blocks(lowered(texts)) if len(rows) else ():
        found, start, end, first, _ = _features(data, offsets, params)
        row, lo, hi = _windows(start, end, first, params)
        place = np.concatenate([at for at, _ in found])
        order = np.argsort(place, kind="stable")
        place = place[order]
        buckets.append(np.concatenate([b for _, b in found])[order])
        los.append(np.searchsorted(place, lo) + base), his.append(np.searchsorted(place, hi) + base), owners.append(row + n_rows)
        base, n_rows = base + len(place), n_rows + len(offsets) - 1
    owner = np.concatenate(owners) if owners else np.zeros(0, int)
    if len(set(label[np.unique(owner)].tolist())) < 2:
        return None
    bucket, lo, hi = np.concatenate(buckets), np.concatenate(los), np.concatenate(his)
    del buckets
    docs, first = np.unique(owner, return_index=True)
    last = np.append(first[1:], len(owner))
    y = (label[docs] == 1).astype(float)
    weigh = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))

    rng = np.random.default_rng(7)
    table = rng.normal(0, 0.05, (params.buckets, params.dim))
    soft = rng.normal(0, 0.5, (params.dim, 2))
    bias = np.zeros(2)
    square_table, square_soft, square_bias = np.full_like(table, 1e-9), np.full_like(soft, 1e-9), np.full(2, 1e-9)
    for epoch in range(params.warm_epochs + params.epochs):
        if epoch < params.warm_epochs:
            a, b = lo[first], hi[last - 1]
        else:
            slope = (table @ (soft[:, 1] - soft[:, 0])).astype(np.float32)
            ends = np.stack([lo, hi], 1).reshape(-1)
            logit = np.add.reduceat(np.append(slope[bucket], np.float32(0)), ends)[::2] / np.maximum(hi - lo, 1)
            peak = np.maximum.reduceat(logit, first)
            at = np.flatnonzero(logit == np.repeat(peak, last - first))
            worst = at[np.unique(owner[at], return_index=True)[1]]
            a, b = lo[worst], hi[worst]
        grad_table, grad_soft, grad_bias = np.zeros_like(table), np.zeros_like(soft), np.zeros(2)
        for part in range(0, len(docs), 100):  # a bounded part of the batch at a time
            own = slice(part, part + 100)
            size = b[own] - a[own]
            n = len(size)
            doc = np.repeat(np.arange(n), size)
            cells = bucket[np.repeat(a[own] - np.cumsum(size) + size, size) + np.arange(size.sum())]
            mean = np.stack([np.bincount(doc, table[cells, d], n) for d in range(params.dim)], 1) / np.maximum(size, 1)[:, None]
            z = mean @ soft + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            error = (p - np.stack([1 - y[own], y[own]], 1)) * weigh[own, None]
            back = (error @ soft.T) / np.maximum(size, 1)[:, None]
            grad_soft += mean.T @ error
            grad_bias += error.sum(0)
            for d in range(params.dim):
                grad_table[:, d] += np.bincount(cells, back[doc, d], params.buckets)
        for x, square, grad, rate in ((soft, square_soft, grad_soft, 0.2), (bias, square_bias, grad_bias, 0.2), (table, square_table, grad_table, 1.0)):
            square += grad**2
            x -= params.rate * rate * grad / np.sqrt(square)
    return ToxicityModel(params, (table @ (soft[:, 1] - soft[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def fit_documents(docs: DataFrame, labels: DataFrame, params: ToxicityParams = ToxicityParams(), doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> ToxicityModel | None:
    """Learn from labelled documents that aren't held out."""
    known = labels.where(~held_out(doc_id) & F.col(label).isin(0, 1)).groupBy(doc_id).agg(F.max(label).alias(label))
    ids = sample_per_class(known, doc_id, label, params.per_class)
    model = fit([(int(key), body) for _, key, body in sample_texts(docs, ids, doc_id, text, params.max_text_bytes)], params)
    _tables.trim()
    return model


def score_documents(docs: DataFrame, model: ToxicityModel | None, doc_id: str = "doc_id", text: str = "text", threshold: float = ToxicityParams.threshold) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = score(text_column(batch, "text"), model)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found), pa.array((found >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), held_out(doc_id).alias("held_out"), F.col(text).alias("text")).mapInArrow(judge, f"doc_id {kind}, held_out boolean, score double, predicted int")
