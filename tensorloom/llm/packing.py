"""Best-two-fit packing of tokenised documents into sequences of a fixed length.

Only lengths matter for packing, so the plan is made on a histogram of piece lengths, which has at most one entry per
length whatever the corpus: a bin is filled greedily with the largest piece that fits, then its smallest piece gives way
to two unpacked pieces if these fill the widened gap more tightly; the bin is repeated while its pieces last.  A
repetition ends when some length has too few pieces left, so there are at most sum(capacity / length) different bins.

Pieces are then ranked within their length and looked up in the plan.  Ranks are counted within shares of a length and
offset by the shares before, so a length that a third of all pieces have is no single task's work, whatever their ids
and texts: shares are dealt in turn when pieces are cut, and stay in the table of pieces.

Defined results: a null or empty text is the end mark alone; equal rows are packed each on its own; a null doc_id is
carried through; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import re
import secrets
import zlib
from collections import defaultdict
from collections.abc import Collection, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from tensorloom.llm import _tables
from tensorloom.llm._shared import materialise

#: Entries of a worker's table of words at most; it only saves time.  When half of them are new, words not met since the
#: last time are forgotten.
TABLE_LIMIT = 600_000
#: Shares in which the pieces of a length are ranked.
SHARES = 1024
#: White space on which this tokenizer's library and ``str.split`` agree; texts with other white space take the slow way.
_ODD = "\x1c\x1d\x1e\x1f"
#: The layout whose words are independent: the normalisers, the pattern that cuts texts, what follows the pattern.
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_PATTERN = {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}
_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
#: The same pattern for Python, for lower-cased words of Latin-1 characters.
_CUT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼-¾]|[^a-zªµºß-öø-ÿ0-9²³¹¼-¾]+")


class WordIds:
    """Token ids of texts under a tokenizers ``.json`` file that works word by word, with a table of words met before."""

    _loaded: dict[str, WordIds] = {}

    @classmethod
    def load(cls, path: str) -> WordIds:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def __init__(self, path: str):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.added = [t["content"] for t in spec["added_tokens"]]
        #: Words are independent only if white space never reaches the model and nothing is put around a text.
        split = {"type": "Split", "pattern": _PATTERN, "behavior": "Removed", "invert": True}
        self.by_word = spec["post_processor"] is None and spec["normalizer"] == {"type": "Sequence", "normalizers": _NORMALIZERS} and spec["pre_tokenizer"] == {"type": "Sequence", "pretokenizers": [split, _BYTES]} and spec["model"].get("end_of_word_suffix") == "</w>"
        if self.by_word:
            # Both share the library's model.  A text's added tokens are looked for before it is lower-cased, so lower-cased
            # words have none.
            self.words = Tokenizer(self.library.model)
            self.words.normalizer, self.words.pre_tokenizer = self.library.normalizer, self.library.pre_tokenizer
            #: For lower-cased words of letters only, which the pattern leaves whole.
            self.letters = Tokenizer(self.library.model)
            self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            vocab = spec["model"]["vocab"]
            #: Whether an id is the last of a word of letters.
            self.ending = np.zeros(max(vocab.values()) + 1, bool)
            self.ending[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        #: Words of the texts at hand that are not in the table, with the ids they are given.
        self.unmet: defaultdict[str, bytearray] = defaultdict(bytearray)
        #: A dictionary that answers for words it lacks with their places in ``unmet``, without a call of Python code.
        self.Table = type("Table", (dict,), {"__missing__": self.unmet.__getitem__})
        self.forget()

    def forget(self) -> None:
        self.table, self.older = self.Table(), {}
        self.unmet.clear()

    def _simple(self, text: str) -> bool:
        """Whether lower-casing and cutting at white space is all that happens before single words are encoded."""
        if not self.by_word or any(t in text for t in self.added) or any(c in text for c in _ODD):
            return False
        if text.isascii():
            return True
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return False
        return True

    def _learn(self, words: Collection[str]) -> None:
        """Enter words in the table, and in their places: those of letters only many at a time, others singly."""
        table, unmet = self.table, self.unmet
        other = [w for w in words if not w.isalpha()]
        words = [w for w in words if w.isalpha()]
        for k in range(0, len(words), 300):
            own = words[k : k + 300]
            ids = np.array(self.letters.encode_batch_fast([" ".join(own)], add_special_tokens=False)[0].ids, "<u4")
            ends = (np.flatnonzero(self.ending[ids]) + 1) * 4
            if len(ends) != len(own):  # a word without its last token
                other += own
                continue
            raw, first = ids.tobytes(), 0
            for word, end in zip(own, ends.tolist(), strict=True):
                table[word] = ids = raw[first:end]
                place = unmet.get(word)
                if place is not None:
                    place += ids
                first = end
        for word, found in zip(other, self.words.encode_batch_fast(other, add_special_tokens=False), strict=True):
            table[word] = ids = np.array(found.ids, "<u4").tobytes()
            place = unmet.get(word)
            if place is not None:
                place += ids

    def _fill(self) -> None:
        """Find the ids of words that are not in the table.

        Words are cut as the pattern cuts them, and their parts are entered in the table.  A word of several parts is
        entered itself only if all of them were known, as most are not met again.
        """
        if len(self.table) + len(self.unmet) > TABLE_LIMIT // 2:
            self.table, self.older = self.Table(), self.table
        table, older = self.table, self.older
        parts_of, new = {}, set()
        for word, place in self.unmet.items():
            if word in older:
                table[word] = ids = older[word]
                place += ids
            elif word.isalpha():
                new.add(word)
            else:
                parts_of[word] = parts = _CUT.findall(word)
                for part in parts:
                    if part not in table:
                        if part in older:
                            table[part] = older[part]
                        else:
                            new.add(part)
        self._learn(new)
        for word, parts in parts_of.items():
            ids = b"".join([table[p] for p in parts])
            self.unmet[word][:] = ids
            if new.isdisjoint(parts):
                table[word] = ids

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        self.unmet.clear()
        look = self.table.__getitem__
        rows = [list(map(look, text.lower().split())) if self._simple(text) else [np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()] for text in texts]
        self._fill()
        return [b"".join(ids) for ids in rows]


def pieces_of(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, doc_id: str, text: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and a share of every piece of every document; shares go round in turn."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = WordIds.load(tokenizer)
        _tables.enter("words", coder.forget)
        tail = np.array([end_id], "<u4").tobytes()
        turn = secrets.randbelow(SHARES)  # tasks begin with different shares
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                owner, piece, start, length, crc, share = [], [], [], [], [], []
                for i, ids in enumerate(coder.encode([t or "" for t in part.column(1).to_pylist()])):
                    ids += tail
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[at : at + 4 * capacity]
                        owner.append(i), piece.append(k), start.append(at // 4), length.append(len(own) // 4), crc.append(zlib.crc32(own)), share.append(turn % SHARES)
                        turn += 1
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(owner, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc)), pa.array(share, pa.int32())], names=["doc_id", "piece", "start", "length", "ids_crc32", "share"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, share int")


@dataclass
class Plan:
    """Slots of the planned bins: of each entry the length, the first rank of it, the first bin, pieces of this length per bin, and the place of the first of these."""

    length: np.ndarray
    rank: np.ndarray
    bin: np.ndarray
    each: np.ndarray
    place: np.ndarray
    bins: int


def _fill(free: np.ndarray, capacity: int) -> dict[int, int]:
    """One bin: pieces by length, greedily, then the smallest exchanged for two that fit more tightly."""
    bin_: dict[int, int] = {}
    lengths = np.flatnonzero(free)
    gap = capacity
    while gap > 0 and len(lengths):
        k = int(np.searchsorted(lengths, gap, "right")) - 1
        if k < 0:
            break
        n = int(lengths[k])
        take = min(gap // n, int(free[n]))
        bin_[n] = take
        gap -= take * n
        lengths = lengths[:k]
    if gap == 0:
        return bin_
    small = min(bin_)
    room = gap + small
    left = free[: room + 1].copy()
    for n, many in bin_.items():
        if n <= room:
            left[n] -= many
    a = np.flatnonzero(left > 0)
    if not len(a):
        return bin_
    at_most = np.zeros(room + 1, np.int64)  # the largest free length up to each number
    at_most[a] = a
    at_most = np.maximum.accumulate(at_most)
    first = a[a < room]
    second = at_most[np.minimum(first, room - first)]
    twin = (second == first) & (left[first] < 2)
    second = np.where(twin, at_most[np.maximum(first - 1, 0)], second)
    total = np.where(second > 0, first + second, 0)
    if len(total) and total.max() > small:
        best = int(total.argmax())
        bin_[small] -= 1
        for n in (int(first[best]), int(second[best])):
            bin_[n] = bin_.get(n, 0) + 1
    return {n: many for n, many in bin_.items() if many}


def plan_bins(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> Plan:
    """Bins for a histogram of piece lengths."""
    free = np.zeros(capacity + 1, np.int64)
    free[lengths] = counts
    used = np.zeros(capacity + 1, np.int64)
    rows, bins = [], 0
    while free.any():
        bin_ = _fill(free, capacity)
        times = min(int(free[n]) // many for n, many in bin_.items())
        place = 0
        for n in sorted(bin_, reverse=True):
            rows.append((n, used[n], bins, bin_[n], place))
            used[n] += times * bin_[n]
            free[n] -= times * bin_[n]
            place += n * bin_[n]
        bins += times
    table = np.array(rows, np.int64).reshape(-1, 5)
    table = table[np.lexsort((table[:, 1], table[:, 0]))]
    return Plan(*table.T, bins)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece.

    ``tokenizer`` is the path of a tokenizers ``.json`` file on every executor; its ids are taken without added tokens.
    """
    pieces = materialise(pieces_of(docs, tokenizer, capacity, end_id, doc_id, text), "pieces")
    shared = pieces.groupBy("length", "share").agg(F.count(F.lit(1)).alias("n"))
    # At most one row per length, so at most ``capacity`` of them.
    histogram = shared.groupBy("length").agg(F.sum("n").alias("n")).collect()
    plan = plan_bins(np.array([r.length for r in histogram], np.int64), np.array([r.n for r in histogram], np.int64), capacity)
    before = Window.partitionBy("length").orderBy("share").rowsBetween(Window.unboundedPreceding, -1)
    offsets = shared.select("length", "share", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "share").orderBy("doc_id", "piece", "ids_crc32")
    ranked = pieces.hint("merge").join(offsets, ["length", "share"]).withColumn("rank", F.col("before") + F.row_number().over(within) - 1)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (plan.length << 48) + plan.rank
        for batch in batches:
            length, rank = (batch.column(k).to_numpy(zero_copy_only=False) for k in (3, 5))
            at = np.searchsorted(key, (length << 48) + rank, "right") - 1
            nth = rank - plan.rank[at]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(plan.bin[at] + nth // plan.each[at]), pa.array(plan.place[at] + nth % plan.each[at] * length)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    kind = pieces.schema["doc_id"].dataType.simpleString()
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(assign, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
