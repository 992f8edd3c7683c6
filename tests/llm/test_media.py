import hashlib
import zlib
from pathlib import Path

import numpy as np
import pytest

from tensorloom.llm.media import ArchiveReader, decode_png, encode_png, feature, media_features, read_media, store_texts


def payload_of(text):
    data = (text or "").encode()
    return data + b" " * (max(192, -(-len(data) // 192) * 192) - len(data))


def test_png_round_trip():
    for data in (bytes(range(192)), b"\0" * 384, np.random.default_rng(1).integers(0, 256, 192 * 50, np.uint8).tobytes()):
        assert decode_png(encode_png(data)) == data


def test_rows(spark):
    texts = ["", None, "é" * 96, "a" * 192, "b" * 193, "long " * 60000, "same", "same"]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, "same", "y"), (3, "a" * 192, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_bytes string").repartition(3)
    folder = store_texts(df)
    got = media_features(read_media(spark, folder, rangeBytes="700")).collect()
    want = []
    for i, t, _ in rows:
        p = payload_of(t)
        m = encode_png(p)
        want.append((i, len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(m), hashlib.sha256(m).hexdigest(), feature(np.frombuffer(p, np.uint8))))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert media_features(read_media(spark, store_texts(df.limit(0)))).count() == 0


def test_damage_and_retry(spark, monkeypatch):
    folder = store_texts(spark.createDataFrame([(i, f"text {i}") for i in range(6)], "doc_id long, text string").coalesce(1))
    path = next(Path(folder.removeprefix("file://")).glob("*.zip"))
    plain, calls = ArchiveReader._member, []

    def flaky(self, system, p, info, file):
        calls.append(info.header_offset)
        if len(calls) == 3:
            raise OSError("once")
        return plain(self, system, p, info, file)

    monkeypatch.setattr(ArchiveReader, "_member", flaky)
    reader = ArchiveReader({"path": folder})
    rows = [r for part in reader.partitions() for b in reader.read(part) for r in b.to_pylist()]
    assert sorted(r["doc_id"] for r in rows) == list(range(6)) and sorted(r["attempts"] for r in rows) == [1] * 5 + [2]
    assert len(calls) == 7  # the others were not read again
    monkeypatch.undo()
    data = bytearray(path.read_bytes())
    at = data.index(b"IDAT") + 8
    data[at] ^= 0xFF
    path.write_bytes(data)
    bad = [r for r in read_media(spark, folder, permissive="true").collect() if r.error]
    assert len(bad) == 1 and bad[0].attempts == 3 and bad[0].payload is None
    with pytest.raises(Exception, match="damaged"):
        read_media(spark, folder).collect()


def test_only_named_archives_are_read(spark, tmp_path):
    """Archives of a job that never ended, or of tasks that ran twice, are not read; a finished job removes its own."""
    from tensorloom.llm.media import ArchiveWriter, Written

    df = spark.createDataFrame([(i, f"text {i}") for i in range(20)], "doc_id long, text string").repartition(3)
    folder = store_texts(df, str(tmp_path / "m"))
    before = {p.name for p in Path(folder).iterdir()}
    writer = ArchiveWriter({"path": folder})
    import pyarrow as pa

    batch = pa.RecordBatch.from_pylist([{"doc_id": 99, "n_bytes": 1, "payload": b" " * 192}])
    first, again = writer.write(iter([batch])), writer.write(iter([batch]))
    assert sorted(r.doc_id for r in read_media(spark, folder).collect()) == list(range(20))  # the driver is lost here
    writer.commit([first, None, Written([])])
    assert sorted(r.doc_id for r in read_media(spark, folder).collect()) == [*range(20), 99]
    assert {p.name for p in Path(folder).iterdir()} - before == {first.files[0][0], f"{writer.job}.manifest"}
    assert again.files[0][0] not in {p.name for p in Path(folder).iterdir()}
    other = ArchiveWriter({"path": folder})
    other.write(iter([batch]))
    other.abort([])
    assert sorted(r.doc_id for r in read_media(spark, folder).collect()) == [*range(20), 99]
