import random
import re

import numpy as np
import pytest

import corpus_pipeline
from tensorloom.llm import neardup
from tensorloom.llm.neardup import NearDupParams, keep_one_of_each, near_duplicates, superminhash, union_find

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {(i, len(s), root(i), root(i) == i) for i, s in sets.items()}


def corpus(rng):
    vocabulary = [f"w{i}" for i in range(300)] + ["É", "ÉA", "Zz"]
    texts = ["", " \n", "one", "One", "one two", "ONE two", None, "a b c d e", "a b c d e f"]
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(20, 200))]
        texts.append(" ".join(base))
        walk = list(base)
        for _ in range(rng.randrange(0, 8)):  # chains of small edits
            for _ in range(rng.randrange(1, 4)):
                walk[rng.randrange(len(walk))] = rng.choice(vocabulary)
            texts.append("  ".join(walk) + "\n")
    passage = " ".join(rng.choice(vocabulary) for _ in range(100))
    texts += [passage + " " + " ".join(rng.choice(vocabulary) for _ in range(k)) for k in range(0, 120, 4)]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("local", [0, 10**6])
def test_against_brute_force(spark, monkeypatch, local):
    monkeypatch.setattr(neardup.union_find, "__defaults__", (60, local))
    rows = corpus(random.Random(11))
    df = spark.createDataFrame([(i, t, "x", 9) for i, t in rows], "doc_id long, text string, component_id string, n long").repartition(5)
    got = near_duplicates(df)
    assert {tuple(r) for r in got.collect()} == brute(rows)
    kept = keep_one_of_each(df)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, _, root, _ in brute(rows) if i == root}


def test_odd_rows(spark):
    text = " ".join(f"t{i}" for i in range(40))
    df = spark.createDataFrame([(None, text), (None, text), (3, text), (3, text), (5, text), (6, None), (7, "y " * 50000)], "doc_id long, text string")
    got = sorted((tuple(r) for r in near_duplicates(df).collect()), key=str)
    assert got == sorted([(None, 36, None, True)] * 2 + [(3, 36, 3, True)] * 2 + [(5, 36, 3, False), (6, 0, 6, True), (7, 1, 7, True)], key=str)
    assert sorted((r.doc_id or -1) for r in keep_one_of_each(df).collect()) == [-1, -1, 3, 6, 7]
    other = df.union(spark.createDataFrame([(3, "quite another text under an id that is taken")], df.schema))
    assert sorted(r.text[:5] for r in keep_one_of_each(other).where("doc_id = 3").collect()) == ["quite", "t0 t1"]
    assert near_duplicates(df.limit(0)).count() == 0


def test_signature_estimates_similarity():
    rng = np.random.default_rng(3)
    errors = []
    for _ in range(60):
        both = rng.integers(0, 1 << 63, 300).astype(np.uint64)
        a, b = np.sort(both[:240]), np.sort(both[60:])
        sig = superminhash(np.concatenate([a, b]), np.repeat([0, 1], 240), 2, 128)
        errors.append((sig[0] == sig[1]).mean() - 180 / 300)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.05
    tiny = superminhash(np.array([5, 6], np.uint64), np.array([0, 1]), 2, 160)
    assert (tiny != np.iinfo(np.uint64).max).all()


def test_union_find_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501)], "a long, b long")
    for local in (0, 10**6):
        got = {tuple(r) for r in union_find(edges, local_edges=local).collect()}
        assert got == {(i, 0) for i in range(1, 201)} | {(501, 500)}
        assert union_find(edges.limit(0), local_edges=local).count() == 0


def test_pipeline_stage_links_from_four_fifths(spark):
    base = [f"w{i}" for i in range(104)]  # 100 shingles
    near, far = base[:94] + [f"x{i}" for i in range(10)], base[:91] + [f"y{i}" for i in range(13)]
    for words, shared in ((near, 90), (far, 87)):
        assert len(shingles(" ".join(base)) & shingles(" ".join(words))) == shared
    # Alike to 90 / 110 = 0.82 with the first; 87 / 113 = 0.77 with both.
    df = spark.createDataFrame([(1, " ".join(base), "x"), (2, " ".join(near), "x"), (3, " ".join(far), "x")], "doc_id long, text string, source string")
    kept = corpus_pipeline.keep_one_copy(spark, df, "")
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3]
    assert sorted(r.doc_id for r in near_duplicates(df).where("kept").collect()) == [1, 2, 3]  # op5's contract is 85 %


def test_words_that_polynomial_hashes_confuse(spark):
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    two = one.translate(str.maketrans("ab", "ba"))
    rows = [(1, f"{one} x y z u v"), (2, f"{two} x y z u v"), (3, f"{one.upper()}  x y z u v")]
    got = {tuple(r) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows) == {(1, 2, 1, True), (2, 2, 2, True), (3, 2, 1, False)}


def test_passage_shared_by_unlinked_classes(spark):
    """Every document shares most of its words with all others and is linked with few: nothing is lost, whatever meets."""
    rng = random.Random(5)
    passage = [f"p{i}" for i in range(60)]
    rows = [(i, " ".join(passage + [f"o{i}_{k}" for k in range(rng.choice([3, 8, 9, 10, 11, 14]))])) for i in range(60)]
    rows += [(100 + i, " ".join(passage[: rng.randrange(50, 60)])) for i in range(20)]
    got = {tuple(r) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == brute(rows)


def test_whole_table_loses_no_link(spark):
    """Every document of a whole table against links counted over all pairs that share a shingle."""
    import duckdb

    from tensorloom.llm.queries import ORACLE_SQL, QUERIES

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    want = {tuple(r) for r in con.execute(ORACLE_SQL["op5_superminhash"]).fetchall()}
    assert {tuple(r) for r in QUERIES["op5_superminhash"](spark, folder).collect()} == want
