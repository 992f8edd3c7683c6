"""Near-duplicate groups: SuperMinHash signatures, banding, verification on full sets, union-find.

1. One pass over the texts gives each document's set of word shingles (hashes of 64 bits, built on xxHash of each word), a
   fingerprint of the set (a cryptographic digest of all its shingles with 128 bits each, so that equal fingerprints are
   equal sets), and a SuperMinHash signature: an element proposes one value per round, in an order drawn from a permutation of its
   own, so values of different positions are correlated and vary less than with independent hashes; a document stops as
   soon as every position has a value of an earlier round (early stopping; one or two rounds for usual texts).
2. Documents with equal fingerprints form one class, represented by its smallest id.  All that follows sees classes.
3. Signatures are cut into bands; classes that share a band's value are candidates.  The defaults (32 bands of 5) miss a
   pair of similarity 0.85 with probability 7e-9.
4. A bucket is not expanded into pairs.  First each bucket's most central class is compared with its other members (a
   star), on full sets; union-find merges what is linked.  Then the classes of buckets that still hold several
   components are joined on the rare elements that similar sets must share (an exact prefix filter), and only pairs in
   different components are compared.  Pairs inside one component can't change a group, so leaving them out loses
   nothing; no other pair is left out and nothing is capped.
5. Union-find runs as rounds of joins over an edge table (hook to the smallest neighbour, compress); a table of at most
   ``LOCAL_EDGES`` edges, which is counted, is joined by one task instead; nothing of it comes to the driver.

Intermediate tables lie in the shared checkpoint folder.  Aggregations of buckets combine on the map side, so a bucket
with a third of all rows arrives as one row per task; joins on bucket keys are left to adaptive skew splitting.

Defined results: a null or empty text, or one without words, has an empty set and is linked with nothing; a text of fewer
words than a shingle has its whole word sequence as its only element; rows that repeat a ``doc_id`` count as one
document with its copies (each row is returned); a row with a null id is linked with nothing, has a null component and
is kept; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from tensorloom.llm import _tables
from tensorloom.llm._blocks import U64, byte_blocks, numbered, splitmix64, text_column, words_of
from tensorloom.llm._shared import discard, materialise

_STEP = splitmix64(np.arange(1, 65, dtype=U64) + U64(1 << 50)) | U64(1)
#: Edges that one task may join: 16 bytes each, and a few times that while it works.
LOCAL_EDGES = 1_000_000
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


@dataclass(frozen=True)
class NearDupParams:
    """``percent``: documents are linked where 100 * |intersection| >= percent * |union|."""

    shingle: int = 5
    percent: int = 85
    bands: int = 32
    rows: int = 5


def _word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit halves of the 128-bit xxHash of each word; each different word of a block is hashed once."""
    number, words = numbered(data, start, end)
    halves = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words.to_pylist())), U64).reshape(-1, 2)
    return halves[number, 0], halves[number, 1]


def _distinct(key: np.ndarray, row: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys ascending and distinct within their rows (which ascend already), and the rows."""
    bounds = np.searchsorted(row, np.arange(n_rows + 1))
    for r in range(n_rows):  # rows are few and each row's keys many
        key[bounds[r] : bounds[r + 1]].sort()
    fresh = np.ones(len(key), bool)
    fresh[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
    return key[fresh], row[fresh]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int, both: bool = False) -> tuple[np.ndarray, ...]:
    """Distinct shingle hashes of all rows, ascending within a row, and the row of each.

    ``both``: the same once more from the other halves of the words' hashes, so that a shingle has 128 bits in all.
    """
    n_rows = len(offsets) - 1
    data = _LOWER[data]
    start, end, first = words_of(data, offsets)
    counts = np.diff(first)
    per_row = np.where(counts >= n, counts - n + 1, 0)
    row = np.repeat(np.arange(n_rows), per_row)
    at = np.arange(len(row)) - np.repeat(np.cumsum(per_row) - per_row, per_row) + first[row]
    short = np.flatnonzero((counts > 0) & (counts < n))
    rows = np.concatenate([row, short])
    # Each row's shingles stand together, and a row has either long or short ones.
    order = np.argsort(rows, kind="stable") if len(short) else None
    rows = rows if order is None else rows[order]
    out: list[np.ndarray] = []
    for word in _word_hashes(data, start, end)[: 1 + both]:
        key = np.zeros(len(at), U64)
        for j in range(n):
            key = splitmix64(key ^ word[at + j])
        small = counts[short].astype(U64)
        for j in range(n - 1):
            live = counts[short] > j
            small[live] = splitmix64(small[live] ^ word[first[short[live]] + j])
        key = np.concatenate([key, small])
        out += _distinct(key if order is None else key[order], rows, n_rows)
    return tuple(out)


def superminhash(key: np.ndarray, row: np.ndarray, n_rows: int, m: int) -> np.ndarray:
    """SuperMinHash signatures (n_rows x m) of the rows' sets; a row without elements keeps the largest value everywhere.

    Round j: every element puts the value j + (a fraction of its own) at the j-th place of its own permutation of the m
    places; a place keeps the least value.  Round values grow, so a place that has a value is final after its round, and
    a row whose places are all filled is done.  The value is stored as round * 2**55 + fraction.
    """
    empty = U64(np.iinfo(np.uint64).max)
    sig = np.full(n_rows * m, empty, U64)
    swaps: list[np.ndarray] = []
    for j in range(m):
        if not len(key):
            break
        draw = splitmix64(key ^ splitmix64(np.full(1, j, U64) + U64(1 << 45)))
        place = j + ((draw >> U64(32)) * U64(m - j) >> U64(32)).astype(np.int64)
        swaps.append(place)
        # The element's place j after the swaps of a Fisher-Yates shuffle, followed backwards.
        target = place.copy()
        for i in range(j - 1, -1, -1):
            target = np.where(swaps[i] == target, i, target)
        value = (splitmix64(draw) >> U64(9)) + U64(j << 55)
        np.minimum.at(sig, row * m + target, value)
        open_rows = (sig.reshape(n_rows, m) == empty).any(1)
        stay = open_rows[row]
        key, row = key[stay], row[stay]
        swaps = [s[stay] for s in swaps]
    return sig.reshape(n_rows, m)


def band_keys(sig: np.ndarray, params: NearDupParams) -> np.ndarray:
    """A 64-bit key of each band (rows x bands); the band's number is part of it."""
    parts = sig[:, : params.bands * params.rows].reshape(len(sig), params.bands, params.rows)
    key = np.broadcast_to(splitmix64(np.arange(params.bands, dtype=U64) + U64(1 << 52)), parts.shape[:2]).copy()
    for j in range(params.rows):
        key = splitmix64(key ^ (parts[:, :, j] * _STEP[j]))
    return key


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def signatures(docs: DataFrame, params: NearDupParams) -> DataFrame:
    """doc_id, n_shingles, fp1, fp2 (fingerprint of the set) and band keys of every row."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _tables.enter("neardup")
        for batch in batches:
            for lo, hi, data, offsets in byte_blocks(text_column(batch, "text")):
                n = hi - lo
                key, row, other, other_row = shingle_sets(data, offsets, params.shingle, both=True)
                count = np.bincount(row, minlength=n)
                one, two = (np.searchsorted(r, np.arange(n + 1)) for r in (row, other_row))
                digests = [hashlib.blake2b(key[one[r] : one[r + 1]].tobytes() + other[two[r] : two[r + 1]].tobytes(), digest_size=16).digest() for r in range(n)]
                prints = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2).T.copy()
                keys = _signed(band_keys(superminhash(key, row, n, params.bands * params.rows), params).reshape(-1))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * params.bands), pa.array(keys))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, n), pa.array(count.astype(np.int64)), pa.array(prints[0]), pa.array(prints[1]), lists], names=["doc_id", "n_shingles", "fp1", "fp2", "bands"])

    return docs.select("doc_id", "text").mapInArrow(sign, "doc_id long, n_shingles long, fp1 long, fp2 long, bands array<long>")


def _sets(docs: DataFrame, params: NearDupParams) -> DataFrame:
    """doc_id and its full set as an array."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _tables.enter("neardup")
        for batch in batches:
            for lo, hi, data, offsets in byte_blocks(text_column(batch, "text")):
                key, row = shingle_sets(data, offsets, params.shingle)
                bound = np.searchsorted(row, np.arange(hi - lo + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(bound), pa.array(_signed(key)))], names=["doc_id", "elements"])

    return docs.select("doc_id", "text").mapInArrow(build, "doc_id long, elements array<long>")


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    with_b = pairs.hint("merge").join(sets.select(F.col("doc_id").alias("b"), F.col("elements").alias("eb")), "b")
    both = with_b.hint("merge").join(sets.select(F.col("doc_id").alias("a"), F.col("elements").alias("ea")), "a")
    shared = F.size(F.array_intersect("ea", "eb"))
    return both.select("a", "b", shared.alias("shared"), (F.size("ea") + F.size("eb")).alias("total")).where(F.lit(100) * F.col("shared") >= F.lit(percent) * (F.col("total") - F.col("shared"))).select("a", "b")


def _local_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of some edges and the smallest node of each one's component, by hooking and pointer jumping in numpy."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while len(u):
        least = np.minimum(root[u], root[v])
        np.minimum.at(root, root[u], least)
        np.minimum.at(root, root[v], least)
        while (root[root] != root).any():
            root = root[root]
        apart = root[u] != root[v]
        u, v = u[apart], v[apart]
    return nodes, nodes[root]


def union_find(edges: DataFrame, max_rounds: int = 60, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """node, root (its component's smallest node) for every node of ``edges`` (a, b).

    Rounds of hooking every node's larger neighbours to its smallest one and of compressing paths, until stars are left.
    Up to ``local_edges`` edges, a number that is counted first, are instead gone through by one task.
    """
    size = Observation()
    plain = edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u"))
    now, state = materialise(plain.distinct().observe(size, F.count(F.lit(1)).alias("n")), "edges"), None
    if size.get["n"] <= local_edges:

        def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts = list(batches)
            if parts:
                nodes, root = _local_roots(*(np.concatenate([p.column(k).to_numpy() for p in parts]) for k in (0, 1)))
                moved = nodes != root
                yield pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(root[moved])], names=["node", "root"])

        found = materialise(now.coalesce(1).mapInArrow(join, "node long, root long"), "roots")
        discard(now)
        return found
    for _ in range(max_rounds):
        both = now.select(F.col("v").alias("x"), F.col("u").alias("y")).union(now.select(F.col("u").alias("x"), F.col("v").alias("y")))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        # Larger neighbours of x hang on x's least neighbour.
        large = both.where("y > x").join(least, "x").select(F.col("y").alias("v"), F.col("m").alias("u")).where("v <> u").distinct()
        # All smaller neighbours of v, and v itself, hang on v's least neighbour.
        below = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(below, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).where("v <> u").union(below.select("v", F.col("m").alias("u"))).distinct()
        seen = Observation()
        after = materialise(small.observe(seen, F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")), "edges")
        discard(now)
        now = after
        found = (seen.get["n"], seen.get["x"])
        if found == state:
            break
        state = found
    else:
        raise RuntimeError("union-find did not settle")
    return now.select(F.col("v").alias("node"), F.col("u").alias("root"))


def _joined_further(roots: DataFrame, more: DataFrame) -> DataFrame:
    """``roots`` (node, root) after further edges ``more`` (a, b): only the components that these touch are gone through again."""
    own = roots.select(F.col("node").alias("x"), "root")
    at = more.join(own.withColumnRenamed("x", "a"), "a", "left").select(F.coalesce("root", "a").alias("a"), "b")
    at = at.join(own.withColumnRenamed("x", "b"), "b", "left").select("a", F.coalesce("root", "b").alias("b"))
    over = union_find(at).select(F.col("node").alias("root"), F.col("root").alias("top"))
    moved = roots.join(over, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return moved.union(over.select(F.col("root").alias("node"), F.col("top").alias("root")))


def _cross_pairs(rest: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Every pair (a, b) of the classes ``rest`` (rep, n, root) that can be similar enough and lies in two components.

    The prefix filter of set-similarity joins, which is exact: order elements from rare to common; a set of n elements
    shares at least ceil(percent * n / 100) of them with any similar set, so two similar sets share one of their first
    n - that + 1.  With a set that isn't smaller it even shares ceil(2 * percent * n / (100 + percent)), so of each pair
    the smaller set need only be looked up by its first n - that + 1 (its ``core``).  Elements of one class alone count in
    the order but can't be shared, so they never become rows.  The places of a shared element bound the overlap further.
    Holders of an element meet by component: pairs of components are formed first, so that a component with most of an
    element's holders meets the others' holders but never itself.
    """
    own = sets.hint("merge").join(rest.select(F.col("rep").alias("doc_id"), "n", "root"), "doc_id").select("doc_id", "n", "root", F.explode("elements").alias("e"))
    common = own.groupBy("e").agg(F.count(F.lit(1)).alias("c"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("c > 1")
    held = own.hint("merge").join(common, "e").select("doc_id", "n", "root", "e", "c", (F.col("lo") != F.col("hi")).alias("mixed"))
    by_doc = Window.partitionBy("doc_id")
    ranked = held.withColumn("alone", F.col("n") - F.count(F.lit(1)).over(by_doc)).withColumn("r", F.row_number().over(by_doc.orderBy("c", "e")))
    needed = F.expr(f"n - (n * {percent} + 99) div 100 + 1")
    core = F.expr(f"place <= n - (2 * {percent} * n + {99 + percent}) div {100 + percent} + 1")
    prefix = ranked.withColumn("place", F.col("alone") + F.col("r")).where((F.col("place") <= needed) & F.col("mixed")).select("e", F.col("doc_id").alias("rep"), "n", "root", "place", core.alias("core"))
    prefix = materialise(prefix, "prefix")
    # One row for each element and component that holds it, with whether a core does.
    holders = prefix.groupBy("e", "root").agg(F.bool_or("core").alias("core"))
    looked = holders.where("core").select("e", F.col("root").alias("rootb"))
    met = holders.select("e", F.col("root").alias("roota")).hint("merge").join(looked, "e").where("roota <> rootb")
    a, b = (prefix.where("core") if s == "b" else prefix for s in "ab")
    a, b = (t.select("e", *(F.col(c).alias(c + s) for c in ("rep", "n", "root", "place"))) for t, s in ((a, "a"), (b, "b")))
    # If e is the first element they share, they share at most it and what comes after it in the shorter rest.
    reach = F.expr(f"1 + least(na - placea, nb - placeb) >= ({percent} * (na + nb) + {99 + percent}) div {100 + percent}")
    fits = (F.col("nb") <= F.col("na")) & (F.lit(100) * F.col("nb") >= F.lit(percent) * F.col("na")) & reach
    both = a.hint("merge").join(met, ["e", "roota"]).hint("merge").join(b, ["e", "rootb"]).where(fits)
    return both.select(F.least("repa", "repb").alias("a"), F.greatest("repa", "repb").alias("b")).distinct()


def near_duplicates(docs: DataFrame, params: NearDupParams = NearDupParams(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of ``docs``."""
    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    signed = materialise(signatures(narrow, params), "signatures")
    known = signed.where("doc_id IS NOT NULL AND n_shingles > 0")
    classes = known.groupBy("fp1", "fp2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.min("bands").alias("bands"))

    reps = materialise(classes, "classes")
    banded = reps.select("rep", F.col("n_shingles").alias("n"), F.explode("bands").alias("key"))
    buckets = banded.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.bit_xor(F.xxhash64("rep")).alias("who"), F.sum(F.xxhash64("rep", F.lit(1)).cast("decimal(38,0)")).alias("who2")).where("members > 1")
    # Bands with the same members make one bucket.
    buckets = materialise(buckets.groupBy("members", "who", "who2").agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("bands")).select("key", ((F.col("members") - 1) * F.col("bands")).alias("weight")), "buckets")
    joined = banded.hint("merge").join(buckets, "key").select("key", "rep", "n", "weight")
    # The class that meets most others is the middle of a group of copies: it leads its buckets.
    central = joined.groupBy("rep").agg(F.sum("weight").alias("weight"))
    scored = joined.drop("weight").hint("merge").join(central, "rep")
    leaders = scored.groupBy("key").agg(F.max_by("rep", F.struct("weight", -F.col("rep"))).alias("leader"))
    members = materialise(scored.hint("merge").join(leaders, "key").select("key", "leader", "rep", "n"), "members")
    involved = members.select(F.col("rep").alias("doc_id")).distinct()
    # One row of text per id even where rows repeat.
    texts = narrow.hint("merge").join(involved, "doc_id").dropDuplicates(["doc_id"])
    sets = materialise(_sets(texts, params), "sets")

    star = members.where("rep <> leader").select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct()
    roots = union_find(verify(star, sets, params.percent))

    where = members.hint("merge").join(roots, members["rep"] == roots["node"], "left").select("key", "rep", "n", F.coalesce("root", "rep").alias("root"))
    mixed = where.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    rest = where.hint("merge").join(mixed, "key").select("rep", "n", "root").distinct()
    roots = _joined_further(roots, verify(_cross_pairs(rest, sets, params.percent), sets, params.percent))
    for done in (buckets, members, sets):
        discard(done)

    class_of = known.join(reps.select("fp1", "fp2", "n_shingles", "rep"), ["fp1", "fp2", "n_shingles"]).select("doc_id", "rep")
    rooted = class_of.join(roots, class_of["rep"] == roots["node"], "left").select("doc_id", F.coalesce("root", "rep").alias("component_id")).groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    out = signed.select("doc_id", "n_shingles").join(rooted, "doc_id", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one_of_each(docs: DataFrame, params: NearDupParams = NearDupParams(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that near-duplicate grouping keeps, with all columns: one row of each group.

    Rows that repeat an id and text are copies, so one of them stays; rows that repeat an id with another text all stay
    where the id does, as do rows with a null id.
    """
    kept = near_duplicates(docs, params, doc_id, text).where("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_kept_id")).distinct()
    named = docs.where(F.col(doc_id).isNotNull()).join(kept, F.col(doc_id).cast("long") == F.col("_kept_id"), "left_semi")
    named = named.withColumn("_kept_text", F.xxhash64(F.col(text), F.octet_length(F.col(text)))).dropDuplicates([doc_id, "_kept_text"]).drop("_kept_text")
    return named.unionByName(docs.where(F.col(doc_id).isNull()))
