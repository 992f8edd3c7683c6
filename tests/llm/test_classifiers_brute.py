"""Scores of the two classifiers against plain loops over bytes, and their odd inputs."""

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tensorloom.llm import langid, toxicity
from tensorloom.llm._blocks import _BASE, BYTE_VALUE, splitmix64
from tensorloom.llm._grams import _SEED

M = (1 << 64) - 1
TEXTS = ["The house, the HOUSE!", "Über Ähren & Öl 12", "x", "", "?!", "años señor ñandú " * 30, "word " * 400 + "idiot", "日本語 text 日本", "a  b\n\nc\td", "ein haus und noch ein haus"]


def plain_bytes(text):
    """Lower-cased letters with single spaces around words, as bytes."""
    data = bytes(b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in f" {text.lower()} ".encode())
    return re.sub(rb" +", b" ", data)


def gram_hash(data):
    h = 0
    for b in data:
        h = (h + int(_SEED[b])) * 0x9FB21C651E98DF25 & M
        h ^= h >> 32
    return h


def word_hash(data):
    raw = sum(int(BYTE_VALUE[b]) * pow(_BASE, i, 1 << 64) for i, b in enumerate(data)) & M
    return int(splitmix64(np.array([raw ^ (len(data) << 48) & M], np.uint64))[0])


def brute_language(text, model):
    p, data = model.params, plain_bytes(text)
    counts = [0] * p.buckets
    for n in p.lengths:
        for i in range(len(data) - n + 1):
            counts[gram_hash(data[i : i + n]) >> 20 & p.buckets - 1] += 1
    x = [math.log1p(c) * float(w) if c else 0.0 for c, w in zip(counts, model.idf)]
    norm = max(math.sqrt(sum(v * v for v in x)), 1e-12)
    cosines = [sum(v * float(c) for v, c in zip(x, row) if v) / norm for row in model.centroids]
    best = max(cosines)
    near = cosines.index(best)
    base, slope, floor = model.radius[near]
    low = best < floor / math.sqrt(base + slope / max(sum(c > 0 for c in counts), 1))
    lettered = any(c.isalpha() for c in text)
    return (model.owner[near] if lettered else "und"), (best if lettered else 0.0), low or not lettered


def test_language_by_loops():
    rng = random.Random(4)
    made = [(lang, " ".join(rng.choice(words) for _ in range(rng.randrange(3, 60)))) for lang, words in {"en": ["the", "house", "and", "water"], "de": ["das", "haus", "über", "wasser"], "es": ["la", "casa", "señor", "agua"]}.items() for _ in range(30)]
    model = langid.fit(made, langid.LangIdParams(buckets=1 << 11))
    langs, scores, rejected = langid.predict(pa.array(TEXTS, pa.large_string()), model)
    for text, lang, score, bad in zip(TEXTS, langs, scores, rejected, strict=True):
        want = brute_language(text, model)
        assert (lang, bad) == (want[0], want[2]) and score == pytest.approx(want[1], abs=1e-4), text
    for row in model.centroids:
        assert np.linalg.norm(row) == pytest.approx(1, abs=1e-5)


def test_language_ties_and_repeats(spark):
    same = langid.fit([("bb", "one text"), ("aa", "one text")])
    assert langid.predict(pa.array(["one text"], pa.large_string()), same)[0] == ["aa"]
    rows = [(i, f"das haus {i}", "de") for i in range(40)] + [(100 + i, f"the house {i}", "en") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    one, two = langid.fit_documents(df), langid.fit_documents(df.union(df).union(df))
    np.testing.assert_array_equal(one.centroids, two.centroids)
    empty = df.limit(0)
    assert langid.fit_documents(empty) is None and langid.identify(empty, None).count() == 0 and langid.language_filter(empty, None).count() == 0
    odd = spark.createDataFrame([(1, None, None), (2, "12 !", None), (3, "words", None)], df.schema)
    assert [r.doc_id for r in langid.language_filter(odd, langid.fit_documents(odd)).collect()] == [3]
    clash = df.withColumn("score", F.lit("x")).withColumn("held_out", F.lit("y"))
    assert langid.identify(clash, one).count() == 80


def brute_toxicity(text, model):
    p, data = model.params, plain_bytes(text)
    words = [(m.start(), m.end()) for m in re.finditer(rb"[^ ]+", data)]
    if not words:
        return 0.0
    starts = list(range(0, max(1, len(words) - p.window + p.stride), p.stride)) if len(words) > p.window else [0]
    worst = -math.inf
    for k in starts:
        own = words[k : k + p.window]
        lo, hi = own[0][0] - 1, own[-1][1]
        found = []
        for s, e in own:
            found.append(word_hash(data[s:e]) & p.buckets - 1)
        for n in p.lengths:
            for i in range(lo, hi):
                gram = data[i : i + n]
                if len(gram) == n and b" " not in gram[1:-1]:
                    found.append(gram_hash(gram) >> 24 & p.buckets - 1)
        worst = max(worst, sum(float(model.weight[b]) for b in found) / max(len(found), 1) + model.bias)
    return 1 / (1 + math.exp(-max(-500, min(500, worst))))


def test_toxicity_by_loops():
    rng = random.Random(9)
    made = [(int(k % 3 == 0), " ".join(rng.choice(["the", "house", "water", "über"]) for _ in range(rng.randrange(5, 80))) + (" you idiot" if k % 3 == 0 else "")) for k in range(60)]
    model = toxicity.fit(made, toxicity.ToxicityParams(buckets=1 << 12, epochs=8))
    got = toxicity.score(pa.array(TEXTS, pa.large_string()), model)
    for text, score in zip(TEXTS, got, strict=True):
        assert score == pytest.approx(brute_toxicity(text, model), abs=1e-5), text


def test_toxicity_odd_inputs(spark):
    clean, bad = "a plain sentence about the water and the house " * 3, "you are an idiot and a moron " * 3
    rows = [(i, (bad if i % 2 else clean) + str(i)) for i in range(120)]
    df = spark.createDataFrame(rows + [(500, "x" * 300_000), (501, clean * 1000 + bad * 2)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows] + [(500, 1), (501, 0)], "doc_id long, toxic int")
    params = toxicity.ToxicityParams(buckets=1 << 14)
    model = toxicity.fit_documents(df, labels, params)
    again = toxicity.fit_documents(df.union(df), labels.union(labels), params)  # rows that repeat are learned once
    np.testing.assert_array_equal(model.weight, again.weight)
    both = labels.union(spark.createDataFrame([(i, 0) for i in range(1, 120, 2)], labels.schema))  # contradictions count as toxic
    np.testing.assert_array_equal(model.weight, toxicity.fit_documents(df, both, params).weight)
    got = {r.doc_id: r for r in toxicity.score_documents(df, model).collect()}
    assert got[501].predicted == 1 and all(0 <= r.score <= 1 for r in got.values())  # whole texts, also very long ones
    assert toxicity.fit_documents(df.limit(0), labels) is None and toxicity.fit_documents(df, labels.limit(0)) is None
