"""URL rules looked up in a sorted digest array.

Every rule is a (host, path) string.  The array of the rules' 64-bit xxhash values is sorted and written once to a file
in the shared folder; Spark hands the file to the executors, where each Python worker maps it into memory, so the rules
take no memory of their own there however many they are.  A url's candidates are its host and each of its parent
domains with as many labels as some rule's host, joined with the prefixes of its path that have the length of some
rule's path; they are probed by one vectorised binary search per batch, and what hits is compared with the stored full
strings, so a collision can't judge.

Defined results: a null url, or one without ``://``, has an empty host and path and gets the default verdict; equal urls
get equal answers; a null page_id is carried through; without rules every url gets the default verdict; of rules of
equal length that fit one url, the first by code points counts; other columns, whatever their names, are left out.
"""

from __future__ import annotations

import hashlib
import io
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame

from tensorloom.llm._shared import new_path

#: (host, path, verdict)
Rule = tuple[str, str, str]
_UPPER = {c: c + 32 for c in range(0x41, 0x5B)}
_HOST_END = re.compile(r"[/?#]")
_PATH_END = re.compile(r"[?#]")


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a url."""
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = _HOST_END.search(rest)
    host, rest = (rest[: cut.start()], rest[cut.start() :]) if cut else (rest, "")
    cut = _PATH_END.search(rest)
    return host.translate(_UPPER), rest[: cut.start()] if cut else rest


class DigestArray:
    """Sorted digests with the strings they stand for, in one buffer that can be a memory map."""

    MAGIC = b"LOOMDIG2"
    _mapped: dict[str, DigestArray] = {}

    def __init__(self, buffer):
        n, n_lengths, n_labels = np.frombuffer(buffer, "<u8", 3, 8).tolist()
        at = 32
        self.digests = np.frombuffer(buffer, "<u8", n, at)
        self.offsets = np.frombuffer(buffer, "<u8", n + 1, at + 8 * n)
        self.verdicts = np.frombuffer(buffer, np.uint8, n, at + 16 * n + 8)
        at += 17 * n + 8
        at += -at % 8
        self.lengths = np.frombuffer(buffer, "<u8", n_lengths, at).tolist()
        self.labels = np.frombuffer(buffer, "<u8", n_labels, at + 8 * n_lengths).tolist()
        self.strings = memoryview(buffer)[at + 8 * (n_lengths + n_labels) :]

    @classmethod
    def build(cls, rules: Sequence[Rule]) -> bytes:
        """The array of rules as bytes; of equal (host, path), the last one counts."""
        last = {host + path: (path, verdict) for host, path, verdict in rules}
        keyed = sorted((xxhash.xxh64_intdigest(s.encode()), s.encode(), v) for s, (_, v) in last.items())
        ends = np.cumsum([0, *(len(s) for _, s, _ in keyed)]).astype("<u8")
        lengths = np.array(sorted({len(path) for path, _ in last.values()}), "<u8")
        labels = np.array(sorted({host.count(".") + 1 for host, _, _ in rules}), "<u8")
        out = io.BytesIO()
        out.write(cls.MAGIC + np.array([len(keyed), len(lengths), len(labels)], "<u8").tobytes())
        out.write(np.array([d for d, _, _ in keyed], "<u8").tobytes() + ends.tobytes() + bytes(v == "block" for _, _, v in keyed))
        out.write(b"\0" * (-out.tell() % 8) + lengths.tobytes() + labels.tobytes() + b"".join(s for _, s, _ in keyed))
        return out.getvalue()

    @classmethod
    def open(cls, path: str) -> DigestArray:
        """The array of a file, mapped once in each Python worker."""
        if path not in cls._mapped:
            cls._mapped[path] = cls(np.memmap(path, np.uint8, "r"))
        return cls._mapped[path]

    def find(self, keys: list[bytes]) -> np.ndarray:
        """The place of each key, or -1."""
        if not keys or not len(self.digests):
            return np.full(len(keys), -1)
        probe = np.array([xxhash.xxh64_intdigest(k) for k in keys], np.uint64)
        at = np.searchsorted(self.digests, probe)
        found = np.full(len(keys), -1)
        for i in np.flatnonzero(self.digests[np.minimum(at, len(self.digests) - 1)] == probe):
            k = int(at[i])
            while k < len(self.digests) and self.digests[k] == probe[i]:  # equal digests stand together
                if self.text(k) == keys[i]:
                    found[i] = k
                    break
                k += 1
        return found

    def text(self, k: int) -> bytes:
        return bytes(self.strings[int(self.offsets[k]) : int(self.offsets[k + 1])])


def candidates(host: str, path: str, lengths: list[int], labels: list[int]) -> list[bytes]:
    """Every rule string that could fit, the longest first."""
    if not host:
        return []
    parts = host.split(".")
    hosts = [".".join(parts[-k:]) for k in labels if k <= len(parts)]
    found = {h + path[:n] for h in hosts for n in lengths if n <= len(path)}
    return [s.encode() for s in sorted(found, key=lambda s: (-len(s), s))]


def judge_urls(urls: Sequence[str | None], rules: DigestArray, default: str) -> tuple[list[str], list[str], list[str | None], list[str]]:
    """Hosts, paths, rules and verdicts of some urls."""
    split = [split_url(u) for u in urls]
    probes = [candidates(h, p, rules.lengths, rules.labels) for h, p in split]
    hits = rules.find([k for ks in probes for k in ks])
    names: list[str | None] = []
    verdicts, at = [], 0
    for ks in probes:
        own = hits[at : at + len(ks)]
        at += len(ks)
        k = next((int(x) for x in own if x >= 0), -1)
        names.append(rules.text(k).decode() if k >= 0 else None)
        verdicts.append(default if k < 0 else "block" if rules.verdicts[k] else "allow")
    return [h for h, _ in split], [p for _, p in split], names, verdicts


#: (application, file) that were given to the executors.
_given: set[tuple[str, str]] = set()


def _distribute(spark, data: bytes) -> str:
    """Write the array once in the shared folder and have Spark give the file to every executor; its name there.

    The name follows the content, so an application holds each set of rules once however often it is used.
    """
    name = f"rules-{hashlib.sha256(data).hexdigest()}.dig"
    if (spark.sparkContext.applicationId, name) in _given:
        return name
    target = f"{new_path(spark, 'urlrules')}/{name}"
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(target)
    stream = path.getFileSystem(conf).create(path)
    stream.write(bytearray(data))
    stream.close()
    spark.sparkContext.addFile(path.getFileSystem(conf).makeQualified(path).toString())
    _given.add((spark.sparkContext.applicationId, name))
    return name


def filter_urls(pages: DataFrame, rules: Sequence[Rule], default: str = "allow", page_id: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, rule and verdict of every page.  ``default``: the verdict where no rule fits."""
    name = _distribute(pages.sparkSession, DigestArray.build(rules))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        array = DigestArray.open(SparkFiles.get(name))
        for batch in batches:
            found = judge_urls(batch.column(1).to_pylist(), array, default)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.string()) for c in found)], names=["page_id", "host", "path", "rule", "verdict"])

    kind = pages.schema[page_id].dataType.simpleString()
    return pages.select(pages[page_id].alias("page_id"), pages[url].alias("url")).mapInArrow(judge, f"page_id {kind}, host string, path string, rule string, verdict string")
