import random
import time

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tensorloom.llm.token_prefix import PrefixCounter, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def both():
    return PrefixCounter(PATH), Tokenizer.from_file(PATH)


def made():
    rng = random.Random(2)
    bits = ["the", "ing", " ", " ", "\n", "  ", "é", "ñ", "don't", "'ll", "'re", "12", "3", "!", "…", "日本", "\t", "\xa0", "<|endoftext|>", "<|endo", "ß", "THE", "antidis", "  \n\n ", " ", "'", "😀", "á", "-" * 5, "\x1c", "\x85", " \n"]
    return ["", " ", "\n", " a", "a ", "x" * 3000, " " * 50, "<|endoftext|>" * 3] + ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 40))) for _ in range(1500)] + [" ".join("".join(rng.choice("abcdeétionrsth,.") for _ in range(rng.randrange(1, 14))) for _ in range(200)) for _ in range(20)]


def test_counts_equal_the_library(both):
    counter, library = both
    for text in made():
        assert counter.count(text) == len(library.encode(text, add_special_tokens=False).ids), repr(text)


def test_every_prefix(both):
    counter, library = both
    for text in [t for t in made() if len(t) < 120][:250]:
        table = counter.prefixes(text)
        exact = [len(library.encode(text[:n], add_special_tokens=False).ids) for n in range(len(text) + 1)]
        assert [counter.count_prefix(text, n, table) for n in range(len(text) + 1)] == exact, repr(text)
        for budget in (0, 1, 3, 8):
            assert counter.fit(text, budget) == max(n for n, c in enumerate(exact) if c <= budget), (text, budget)


def test_frame(spark):
    rows = [(1, "hello wörld"), (1, "hello wörld"), (None, None), (2, ""), (3, "tok " * 5000)]
    got = sorted((tuple(r) for r in token_counts(spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, n_tokens int"), PATH, 1024).collect()), key=str)
    library = Tokenizer.from_file(PATH)
    want = []
    for i, t in rows:
        n = len(library.encode(t or "").ids)
        fits = len(t or "") if n <= 1024 else max(k for k in range(0, 6000) if len(library.encode(t[:k]).ids) <= 1024)
        want.append((i, len((t or "").encode()), n, n > 1024, fits))
    assert got == sorted(want, key=str)
    assert token_counts(spark.createDataFrame(rows, "doc_id long, text string").limit(0), PATH, 1024).count() == 0


def test_neighbours_are_what_merging_gives(both):
    counter, _ = both
    rng = random.Random(8)
    tokens = sorted(counter.tokens)
    for _ in range(4000):
        a, b = rng.choice(tokens), rng.choice(tokens)
        for one, two in ((a, b), (a, a)):
            parts = [(one + two)[i : i + 1] for i in range(len(one + two))]
            for left, right in counter._merged(one + two):
                at = next(i for i in range(len(parts)) if parts[i : i + 2] == [left, right])
                parts[at : at + 2] = [left + right]
            assert counter._neighbours(one, two) == (parts == [one, two]), (one, two)


def test_long_unbroken_texts(both):
    """Pieces of any length: counts and cuts as the library has them, in time that grows with the length alone."""
    counter, library = both
    rng = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz"
    texts = ["".join(rng.choice(letters) for _ in range(1_000_000)), "-" * 200_000, " " * 300_000 + "x", "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(100_000)), "".join(chr(rng.randrange(0xE01, 0xE2E)) for _ in range(50_000))]
    for text in texts:
        began = time.process_time()
        assert counter.count(text) == len(library.encode(text, add_special_tokens=False).ids)
        cut = counter.fit(text, 1024)
        assert time.process_time() - began < 30
        exact = [len(library.encode(text[:n], add_special_tokens=False).ids) for n in range(cut, cut + 4)]
        assert exact[0] <= 1024 < min(exact[1:]), text[:10]
    half = texts[3][:300]
    table = counter.prefixes(half)
    assert [counter.count_prefix(half, n, table) for n in range(301)] == [len(library.encode(half[:n], add_special_tokens=False).ids) for n in range(301)]
