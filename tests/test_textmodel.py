import math

import numpy as np
import pytest

from tensorloom.operators.learn import Adam
from tensorloom.operators.textmodel import GatedUnit, Vocabulary


def test_vocabulary_and_windows(spark):
    docs = spark.createDataFrame([("b a A",), ("c\ta",), (None,), ("  ",), ("a b",)], "text string")
    found = Vocabulary.of(docs, "text", 2)
    assert found.ids == {"a": 1, "b": 2} and found.size == 4
    got = sorted(tuple(r.ids) for r in found.windows(docs, "text", 2).collect())
    assert got == sorted([(2, 1, 1), (1, 0), (3, 1, 0), (1, 2, 0)])
    with pytest.raises(ValueError):
        Vocabulary.of(docs, "text", 10**9)
    nothing = Vocabulary.of(docs.limit(0), "text", 5)
    unit = GatedUnit(nothing.size, 2)
    assert math.isnan(unit.gradient(nothing.windows(docs.limit(0), "text", 3), unit.start())[0])


def test_gradient_is_exact():
    unit, rng = GatedUnit(5, 3), np.random.default_rng(4)
    flat = unit.start(1) + rng.normal(0, 0.1, unit.start().shape)
    rows = [np.array(r) for r in ([1, 2, 3, 4, 0], [3, 0], [2, 2, 1])]
    _, n, g = unit.loss(flat, rows)
    assert n == 4 + 1 + 2
    for k in range(len(flat)):
        step = np.zeros_like(flat)
        step[k] = 1e-6
        assert g[k] == pytest.approx((unit.loss(flat + step, rows)[0] - unit.loss(flat - step, rows)[0]) / 2e-6, abs=1e-6)


def test_padding_changes_nothing():
    unit = GatedUnit(5, 3)
    flat = unit.start(1)
    rows = [np.array(r) for r in ([1, 2, 3, 4, 0], [3, 0])]
    both, first, second = unit.loss(flat, rows), unit.loss(flat, rows[:1]), unit.loss(flat, rows[1:])
    assert both[0] == pytest.approx(first[0] + second[0])
    np.testing.assert_allclose(both[2], first[2] + second[2], atol=1e-12)


def test_learns_sentences(spark):
    docs = spark.createDataFrame([("the cat sat on a mat",), ("one dog ran in my park",)] * 20, "text string").repartition(3)
    vocabulary = Vocabulary.of(docs, "text", 50)
    windows = vocabulary.windows(docs, "text", 8).cache()
    unit = GatedUnit(vocabulary.size, 8)
    flat, log = unit.train(windows, Adam(rate=0.05), 40)
    assert log[-1] < 0.35 < log[0]
    names = {k: w for w, k in vocabulary.ids.items()}
    assert [names[k] for k in unit.next_words(flat, [vocabulary.ids["the"], vocabulary.ids["cat"]], 10)[:-1]] == ["sat", "on", "a", "mat"]
