"""The pipeline's stages on rows with nulls, repeats, copies and empty texts, each against a plain version on its input."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from test_mixing import brute_targets
from test_neardup import shingles
from test_quality import WORD
from test_quality import brute as brute_quality
from tokenizers import Tokenizer

import corpus_pipeline
from tensorloom.llm import langid
from tensorloom.llm._shared import materialise

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = {"en": ["the", "house", "water", "there", "thing", "and", "with", "other"], "de": ["der", "und", "schicht", "haus", "wasser", "nicht", "über"]}


def made():
    rng, rows = random.Random(12), []
    for i in range(160):
        lang = rng.choice(["en", "de"])
        text = " ".join(rng.choice(WORDS[lang]) + rng.choice("abcdefgh") + rng.choice(["", "s", "en", "ing"]) for _ in range(rng.randrange(12, 120)))
        rows.append((i, text, rng.choice([lang, lang, None]), rng.choice(["s1", "s2", "s2", "s2", None])))
    for k in range(15):
        rows.append((300 + k, rows[k][1], rows[k][2], "s1"))  # copies
        words = rows[20 + k][1].split()
        words[0] = "changed"
        rows.append((330 + k, " ".join(words), None, "s3"))
    rows += [(400, None, "en", "s1"), (401, "", "de", None), (402, "same words " * 50, "en", "s2"), (403, "12 34 56 78 90 11 22 33 44 55 66", None, "s1"), (404, "x" * 4000 + " " + rows[3][1], "en", "s1")]
    rows += [(None, rows[7][1] + " without an id", "en", "s2")] * 2 + [rows[5]] * 2
    return [(*r, len(r[1] or "")) for r in rows]


def near(rows):
    """Which ids stay when every group of documents of similarity 0.8 keeps its smallest id."""
    sets = {i: shingles(t) for i, t, *_ in rows if i is not None}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i for i in sets if root(i) == i}


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.createDataFrame(made(), SCHEMA).repartition(3), []
    for name, stage in corpus_pipeline.STAGES:
        after = materialise(stage(spark, docs, ""), f"test-{name}")
        out.append((name, [tuple(r) for r in docs.collect()], after))
        docs = after
    return {name: (before, after) for name, before, after in out}


def test_every_stage_against_a_plain_version(stages):
    assert list(stages) == ["quality", "language", "near_duplicates", "mix", "pack"]
    for name in ("quality", "language", "near_duplicates", "mix"):
        assert stages[name][1].dtypes == [(f, k) for f, k in stages["quality"][1].dtypes] and stages[name][1].columns == ["doc_id", "text", "lang", "source", "n_chars"]

    before, after = stages["quality"]
    assert Counter(map(tuple, after.collect())) == Counter(r for r in before if brute_quality(r[1])["kept"])

    before, after = stages["language"]
    learned = sorted({(r[0], r[2], r[1]) for r in before if r[0] is not None and r[2] is not None and zlib.crc32(str(r[0]).encode()) % 4 != 2})
    model = langid.fit([(lang, text) for _, lang, text in learned])
    bad = langid.predict(pa.array([r[1] or "" for r in before], pa.large_string()), model)[2]
    assert Counter(map(tuple, after.collect())) == Counter(r for r, b in zip(before, bad) if not b)

    before, after = stages["near_duplicates"]
    keep = near(before)
    want = Counter({r: 1 for r in before if r[0] in keep}) + Counter(r for r in before if r[0] is None)
    assert Counter(map(tuple, after.collect())) == want and len(keep) < len({r[0] for r in before})

    before, after = stages["mix"]
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in before:
        sizes[r[3]] += len(WORD.findall(r[1]))
    copies = Counter(map(tuple, after.collect()))
    own = Counter(before)
    assert set(copies) <= set(own) and all(n <= 2 * own[r] for r, n in copies.items())
    for r, n in copies.items():
        taken[r[3]] += n * len(WORD.findall(r[1]))
    order = [*sorted(s for s in sizes if s is not None), *([None] if None in sizes else [])]
    target = brute_targets(sizes, order)
    assert all(abs(taken[s] - target[s]) <= 6 for s in order)

    before, after = stages["pack"]
    library, pieces = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), []
    for r in before:
        ids = library.encode(r[1], add_special_tokens=False).ids + [0]
        pieces += [(r[0], k, at, len(ids[at : at + 2048]), zlib.crc32(np.array(ids[at : at + 2048], "<u4").tobytes())) for k, at in enumerate(range(0, len(ids), 2048))]
    got = after.collect()
    assert sorted(map(str, pieces)) == sorted(str(tuple(r)[:5]) for r in got)
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for own_places in places.values():
        at = 0
        for offset, length in sorted(own_places):
            assert offset == at
            at += length
        assert at <= 2048


def test_empty_and_unlabelled_tables(spark, tmp_path):
    docs = spark.createDataFrame(made(), SCHEMA)
    docs.limit(0).write.parquet(str(tmp_path / "empty" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "empty")).count() == 0
    plain = docs.withColumn("lang", docs["lang"].substr(10, 1)).selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang", "source", "n_chars")
    kept = corpus_pipeline.keep_known_languages(spark, plain, "")
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in plain.collect() if any(c.isalpha() for c in r.text or "")}
