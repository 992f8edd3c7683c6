import random
import re
from collections import Counter, defaultdict

import pytest

from tensorloom.llm.mixing import mix, mixed_documents


def brute_targets(sizes, order):
    weights = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    left, target, capped = 1.5 * sum(sizes.values()), {}, set()
    while True:
        open_ = [s for s in order if s not in capped]
        free = left - sum(2 * sizes[s] for s in capped)
        target = {s: 2 * sizes[s] if s in capped else free * weights[s] / sum(weights[x] for x in open_) for s in order}
        above = {s for s in open_ if target[s] > 2 * sizes[s]}
        if not above:
            return target
        capped |= above


def table():
    rng = random.Random(3)
    rows = []
    for i in range(3000):
        source = rng.choice(["b"] * 6 + ["a", "c", "é", None, "Z"])
        text = rng.choice([None, "", " "]) if rng.random() < 0.03 else "w " * int(rng.lognormvariate(4.5, 1) + 1)
        rows.append((i, text, source, "x"))
    return rows + [(5000, "one two", "a", "y")] * 3 + [(None, "three", "a", None)]


def test_targets_and_copies(spark):
    rows = table()
    got = mix(spark.createDataFrame(rows, "doc_id long, text string, source string, size string").repartition(4))
    got = got.collect()
    size_of, source_of = {}, {}
    for i, text, source, _ in rows:
        size_of[i], source_of[i] = len(re.findall(r"[^\x20\x09-\x0D]+", text or "")), source
    sizes = defaultdict(int)
    for i, text, source, _ in rows:
        sizes[source] += size_of[i]
    order = [*sorted(s for s in sizes if s is not None), None]
    target = brute_targets(sizes, order)
    taken = defaultdict(int)
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    for r in got:
        s = source_of[r.doc_id]
        assert (r.size, r.source_size) == (size_of[r.doc_id], sizes[s])
        assert r.target == pytest.approx(target[s], rel=1e-12)
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size
        taken[s] += r.taken
        # the tilt: within a source the rate is min(2, exp(lambda * size)) for one lambda
    for s in order:
        assert abs(taken[s] - target[s]) <= max(3, 0.001 * target[s]), (s, taken[s], target[s])
    again = mix(spark.createDataFrame(rows, "doc_id long, text string, source string, size string").repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_rates_are_exponential_tilts(spark):
    import math

    got = mix(spark.createDataFrame(table(), "doc_id long, text string, source string, size string")).collect()
    by_target = defaultdict(set)
    for r in got:
        if r.size and 0 < r.rate < 2:
            by_target[r.target].add(round(math.log(r.rate) / r.size, 9))
    assert all(len(x) == 1 for x in by_target.values())


def test_documents(spark):
    df = spark.createDataFrame(table(), "doc_id long, text string, source string, _copies string")
    out = mixed_documents(df)
    assert out.columns == df.columns
    want = Counter()
    for r in mix(df).collect():
        want[r.doc_id] += r.copies
    assert Counter(r.doc_id for r in out.collect()) == +want
    assert mix(df.limit(0)).count() == 0 and mixed_documents(df.limit(0)).count() == 0


def test_a_missed_target_is_an_error(spark):
    from tensorloom.llm.mixing import MixParams

    df = spark.createDataFrame(table(), "doc_id long, text string, source string, size string")
    with pytest.raises(RuntimeError, match="misses a target"):
        mix(df, MixParams(max_iterations=1))


def test_no_document_could_bring_a_source_nearer(spark):
    """Very long texts beside short ones: each source ends within half its smallest document that could still change."""
    rows = [(0, "w " * 300_000, "a"), (1, "w " * 7, "a"), (2, "w " * 7, "a"), (3, "w " * 50_000, "b"), (4, "w", "b"), (5, "", None)] + [(10 + i, "w " * (i + 1), "c") for i in range(50)]
    got = mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    source = {i: s for i, _, s in rows}
    for s in ("a", "b", "c"):
        own = [r for r in got if source[r.doc_id] == s]
        miss = own[0].target - sum(r.taken for r in own)
        steps = [r.size for r in own if r.size and (r.copies < 2 if miss > 0 else r.copies > 0)]
        assert all(abs(miss) <= x / 2 + 1e-6 for x in steps), (s, miss, steps)


@pytest.mark.parametrize("sizes", [[100 + k % 7 for k in range(20)], [10, 1000, 1000, 20, 500, 500, 5, 700], [1, 1, 1, 1000], [50] * 3])
def test_targets_of_many_sources(spark, sizes):
    """Some sources stop at their caps, most don't."""
    rows = [(i, "w " * n, f"s{k:02d}") for k, n in enumerate(sizes) for i in range(20 * k, 20 * k + 3)]
    got = {r.doc_id // 20: r.target for r in mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    order = [f"s{k:02d}" for k in range(len(sizes))]
    want = brute_targets({s: 3 * n for s, n in zip(order, sizes)}, order)
    assert [got[k] for k in range(len(sizes))] == pytest.approx([want[s] for s in order])
