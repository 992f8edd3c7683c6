import random
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from tensorloom.llm.quality import QualityRules, measure, quality_filter, quality_measures

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text, rules=QualityRules()):
    words = WORD.findall(text or "")
    out = {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text or ""))}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    later = [x for i, x in enumerate(lines) if x in lines[:i]]
    out["n_dup_lines"] = len(later)
    out["covered_lines"] = sum(len(w) for x in later for w in WORD.findall(x))
    for n in {5, *rules.ngram_lengths}:
        grams = Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
        hit = {j for i in range(len(words) - n + 1) if grams[tuple(words[i : i + n])] > 1 for j in range(i, i + n)}
        out[f"covered_{n}"] = sum(len(words[j]) for j in hit)
        if n == 5:
            out["n_repeat_words"] = len(hit)
    out["base_failed"] = len(words) < 10 or 100 * out["n_repeat_words"] > 20 * len(words)
    bad = 100 * out["covered_lines"] > rules.max_line_percent * out["word_chars"]
    bad |= any(100 * out[f"covered_{n}"] > m * out["word_chars"] for n, m in zip(rules.ngram_lengths, rules.max_ngram_percent))
    out["kept"] = not out["base_failed"] and not bad
    return out


def texts():
    rng = random.Random(5)
    made = ["", " ", "\n", "\n\n a\n a\n", "a", "é ü\tñ # $", "a b\n\n", "x" * 5000, "same line here\n" * 40, "w " * 3000]
    for _ in range(400):
        made.append("".join(rng.choice(["a", "bé", "c", " ", " ", "\n", "\t", "|", " ", "日"]) for _ in range(rng.randrange(0, 300))))
        made.append(" ".join(rng.choice(["one", "two", "drei", "vier", "cinq\n", "six"]) for _ in range(rng.randrange(0, 120))))
    return made


def test_against_brute_force():
    made = texts()
    found = measure(pa.array(made, pa.large_string()), QualityRules())
    for i, text in enumerate(made):
        assert {k: v[i] for k, v in found.items()} == brute(text), text


def test_frame(spark):
    good = " ".join(f"word{i}" for i in range(30))
    rows = [(1, good, "x"), (1, good, "x"), (None, None, None), (2, "", "y"), (3, "a b c d e " * 9, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words string")
    got = {(r.doc_id, r.n_words, r.kept) for r in quality_measures(df).collect()}
    assert got == {(1, 30, True), (None, 0, False), (2, 0, False), (3, 45, False)}
    kept = quality_filter(df)
    assert kept.columns == df.columns and [r.n_words for r in kept.collect()] == ["x", "x"]
    assert quality_measures(df.filter(F.lit(False))).count() == 0


def test_coverage_rejects_what_the_base_rules_pass():
    rng = random.Random(8)
    fresh = iter(range(10**6))

    def words(n):
        return " ".join(f"w{next(fresh):05d}" for _ in range(n))

    passage, line = words(10), words(4)
    repeated = " ".join([passage, words(48), passage, words(45)])  # 20 of 113 words
    long_passage = words(12)
    ten = " ".join([long_passage, words(96), long_passage, words(96)])  # 24 of 216: only 10-grams are beyond their limit
    lines = "\n".join(x for _ in range(12) for x in (line, words(rng.randrange(7, 10))))
    clean = [words(200), "\n".join(words(12) for _ in range(30)), " ".join([passage, words(300), passage])]
    made = [repeated, ten, lines, *clean]
    found = measure(pa.array(made, pa.large_string()), QualityRules())
    assert not found["base_failed"].any()
    assert found["kept"].tolist() == [False] * 3 + [True] * 3
    for i, text in enumerate(made):
        assert {k: v[i] for k, v in found.items()} == brute(text)


def test_exact_beyond_hashes(monkeypatch):
    """Counts don't rest on hashes: with one that is the same for all, and on words that a polynomial modulo 2**64 confuses."""
    import numpy as np

    from tensorloom.llm import quality

    one, other = colliding_words()
    made = [f"{one}\n{other}\n" + " ".join(f"w{i}" for i in range(20)), " ".join([one, *"abcd", other, *"abcd", *map(str, range(30))])] + texts()[:120]
    monkeypatch.setattr(quality, "_hashed", lambda values: np.zeros(len(values[0]), np.uint64) if len(values[0]) < 400 else (values[-1] % 7).astype(np.uint64))
    found = measure(pa.array(made, pa.large_string()), QualityRules())
    for i, text in enumerate(made):
        assert {k: v[i] for k, v in found.items()} == brute(text), text[:60]
    assert found["n_dup_lines"][0] == 0


def colliding_words():
    """The Thue-Morse word of 2048 letters and its complement."""
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    return word, word.translate(str.maketrans("ab", "ba"))
