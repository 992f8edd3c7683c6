"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Each document has a rate, how often the mix takes it.  Among all rates between 0 and ``max_copies`` that give every
source its target number of words, entropy balancing takes those nearest to 1 in relative entropy; they are
exponentially tilted, rate = min(max_copies, exp(lambda * size / mean size)), with one multiplier per source.  The
multipliers solve a convex dual by Newton's method on the logarithm of the words taken, kept inside a bracket.

Rates depend on source and size alone, so Newton iterations are aggregations over a histogram of (source, size), joined
with a table of multipliers; documents are read once to make it.  Rates are rounded into whole copies by systematic
sampling over sizes in order, then copies are added or dropped until no document's change brings a source nearer to its
target.  Within a (source, size) the documents with the smallest hashes get the odd copies, ranked in hash shares, so
a source or a size with a third of all rows is nobody's single task.  The targets are one window over one row a source.

Defined results: a null text has size 0 and so takes 0 words; null sources are a source of their own, the last; a source
without words has target 0; a source that can't be brought to its target is an error, never a silent miss; equal rows are ranked each on its own, in any order among themselves; an empty table gives
an empty table; all choices depend on the rows alone, so reruns agree.  Other columns are not read by ``mix``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from tensorloom.llm._shared import discard, materialise

SHARES = 64
#: Sources up to which a table of one short row each is broadcast: about a hundred bytes a row.
BROADCAST_SOURCES = 20_000
_WORD = "[^\\x20\\x09-\\x0D]+"


@dataclass(frozen=True)
class MixParams:
    #: Weights of the sources in code point order, repeating; a null source is the last.
    weights: tuple[int, ...] = (3, 1, 2)
    #: Words of the mix as a part of all words, in percent.
    total_percent: int = 150
    max_copies: int = 2
    #: Newton's method takes a few; a source that hasn't reached its target after so many is an error.
    max_iterations: int = 200
    tolerance: float = 1e-9


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def _key(source: Column) -> Column:
    """A source as a non-null string; null sorts last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def _targets(histogram: DataFrame, params: MixParams) -> DataFrame:
    """key, source_size and target of every source: shares by weight, filled up to the cap of each source in turn."""
    sizes = histogram.groupBy("key").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum(F.when(F.col("size") > 0, F.col("n")).otherwise(0)).alias("with_words"), F.coalesce(F.min(F.when(F.col("size") > 0, F.col("size"))), F.lit(1)).alias("least"))
    turn = (F.row_number().over(Window.orderBy("key")) - 1) % len(params.weights)
    weigh = F.element_at(F.array(*map(F.lit, params.weights)), (turn + 1).cast("int"))
    cap = F.lit(float(params.max_copies)) * F.col("source_size")
    weighed = sizes.withColumn("weight", weigh.cast("double")).withColumn("cap", cap)
    all_, before = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), Window.orderBy(F.col("cap") / F.col("weight"), "key").rowsBetween(Window.unboundedPreceding, -1)
    # In order of cap by weight, sources stop at their caps until the level that the rest would get is below the next cap.
    # Past that source, levels that count it as capped only fall, so the level is the largest of those that fit.
    level = (F.sum("source_size").over(all_) * (params.total_percent / 100.0) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(all_) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    levelled = weighed.withColumn("level", level)
    final = F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(all_)
    return levelled.withColumn("final", final).select("key", "source_size", "with_words", "least", F.coalesce(F.least("cap", F.col("final") * F.col("weight")), F.col("cap")).alias("target"))


def _rate(params: MixParams) -> Column:
    return F.when(F.col("full"), F.lit(float(params.max_copies))).otherwise(F.least(F.lit(float(params.max_copies)), F.exp(F.col("lambda") * F.col("size") / F.col("mean"))))


def _beside(rows: DataFrame, small: DataFrame, sources: int, how: str = "inner") -> DataFrame:
    """``rows`` with a table of at most one row a source: it is broadcast where the sources, which were counted, are few."""
    return rows.join(F.broadcast(small), "key", how) if sources <= BROADCAST_SOURCES else rows.hint("merge").join(small, "key", how)


def _multipliers(histogram: DataFrame, targets: DataFrame, params: MixParams) -> tuple[DataFrame, int]:
    """key, target, source_size, mean, full and the multiplier ``lambda`` of every source, and the number of sources."""
    ratio = F.col("target") / F.col("source_size")
    full = (F.col("source_size") == 0) | (F.col("target") >= params.max_copies * F.col("source_size"))
    slope = F.col("mean") / F.col("least")
    start = targets.withColumn("mean", F.when(F.col("with_words") > 0, F.col("source_size") / F.col("with_words")).otherwise(1.0)).withColumn("full", full)
    # At these ends the tilt of the shortest document alone gives too few words, or the cap of every document too many.
    state = start.select("key", "source_size", "target", "mean", "full", F.lit(0.0).alias("lambda"), F.when(full, 0.0).otherwise(F.least(F.lit(0.0), F.log(ratio) * slope)).alias("lo"), (F.lit(1.000001) * F.log(F.lit(float(params.max_copies))) * slope).alias("hi"))
    size = Observation()
    state = materialise(state.withColumn("miss", F.lit(1.0)).observe(size, F.count(F.lit(1)).alias("n")), "multipliers")
    sources = size.get["n"]
    mass = F.col("n") * F.col("size") * F.col("rate")
    live = F.when(F.col("rate") < params.max_copies, mass * F.col("size") / F.col("mean")).otherwise(0.0)
    for _ in range(params.max_iterations):
        sums = _beside(histogram, state.where("NOT full").select("key", "mean", "full", "lambda"), sources).withColumn("rate", _rate(params)).groupBy("key").agg(F.sum(mass).alias("got"), F.sum(live).alias("bend"))
        at = _beside(state, sums, sources, "left")
        over = F.col("got") > F.col("target")
        lo, hi = F.when(over, F.col("lo")).otherwise(F.col("lambda")), F.when(over, F.col("lambda")).otherwise(F.col("hi"))
        newton = F.col("lambda") - F.when(F.col("bend") > 0, F.log(F.col("got") / F.col("target")) * F.col("got") / F.col("bend"))
        step = F.when((newton > F.col("lo2")) & (newton < F.col("hi2")), newton).otherwise((F.col("lo2") + F.col("hi2")) / 2)
        miss = F.coalesce(F.abs(F.col("got") / F.col("target") - 1), F.lit(0.0))
        moved = at.withColumns({"lo2": lo, "hi2": hi, "miss2": miss}).withColumn("next", step)
        settled = F.col("full") | (F.col("miss2") <= params.tolerance)
        worst = Observation()
        new = materialise(moved.select("key", "source_size", "target", "mean", "full", F.when(settled, F.col("lambda")).otherwise(F.col("next")).alias("lambda"), F.when(settled, F.col("lo")).otherwise(F.col("lo2")).alias("lo"), F.when(settled, F.col("hi")).otherwise(F.col("hi2")).alias("hi"), F.when(F.col("full"), 0.0).otherwise(F.col("miss2")).alias("miss")).observe(worst, F.max("miss").alias("miss")), "multipliers")
        discard(state)
        state = new
        if (worst.get["miss"] or 0.0) <= params.tolerance:
            return state, sources
    raise RuntimeError(f"the mix misses a target after {params.max_iterations} iterations")


def _group_copies(histogram: DataFrame, state: DataFrame, sources: int, params: MixParams) -> DataFrame:
    """key, size, n, copies (of all n documents together), rate, source_size and target."""
    with_rate = _beside(histogram, state.select("key", "source_size", "target", "mean", "full", F.round("lambda", 9).alias("lambda")), sources).withColumn("rate", _rate(params))
    # Rounded: sums come in any order, and reruns must agree to the last copy.
    run = Window.partitionBy("key").orderBy(F.col("size").desc()).rowsBetween(Window.unboundedPreceding, 0)
    total = with_rate.withColumn("upto", F.sum(F.col("n") * F.col("rate")).over(run))
    copies = F.floor(F.col("upto") + 0.5) - F.floor(F.coalesce(F.lag("upto").over(Window.partitionBy("key").orderBy(F.col("size").desc())), F.lit(0.0)) + 0.5)
    most = F.lit(params.max_copies) * F.col("n")
    groups = materialise(total.select("key", "size", "n", F.least(most, F.greatest(F.lit(0), copies)).cast("long").alias("copies"), "rate", "source_size", "target"), "groups")
    while True:  # each round brings every source that it changes nearer to its target, by whole words
        short = groups.groupBy("key").agg((F.first("target") - F.sum(F.col("copies") * F.col("size"))).alias("short"))
        at = _beside(groups, short, sources)
        free = F.when(F.col("short") > 0, most - F.col("copies")).otherwise(F.col("copies"))
        usable = (F.col("size") > 0) & (F.col("size") <= F.abs("short") + 0.5) & (F.col("size") < 2 * F.abs("short")) & (free > 0)
        picks = at.where(usable).groupBy("key").agg(F.max("size").alias("pick"))
        times = F.least(free, F.greatest(F.lit(1), F.floor(F.abs("short") / F.col("size"))))
        change = F.when(F.col("size") == F.col("pick"), F.signum("short") * times).otherwise(0)
        moves = Observation()
        fixed = materialise(_beside(at, picks, sources, "left").select("key", "size", "n", (F.col("copies") + F.coalesce(change, F.lit(0))).cast("long").alias("copies"), "rate", "source_size", "target", F.col("pick").isNotNull().alias("changed")).observe(moves, F.count_if("changed").alias("n")), "groups")
        discard(groups)
        groups = fixed.drop("changed")
        groups._loom_path = fixed._loom_path
        if not moves.get["n"]:
            return groups


def _assign(rows: DataFrame, params: MixParams) -> DataFrame:
    """``rows`` has _id, _key, _size and any other columns; adds _copies, _rate, _source_size and _target."""
    share = F.pmod(F.xxhash64("_id"), F.lit(SHARES)).cast("int")
    counts = materialise(rows.select(F.col("_key").alias("key"), F.col("_size").alias("size"), share.alias("share")).groupBy("key", "size", "share").agg(F.count(F.lit(1)).alias("n")), "counts")
    histogram = materialise(counts.groupBy("key", "size").agg(F.sum("n").alias("n")), "histogram")
    groups = _group_copies(histogram, *_multipliers(histogram, _targets(histogram, params), params), params)
    before = Window.partitionBy("key", "size").orderBy("share").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("key", "size", "share", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    cells = offsets.hint("merge").join(groups, ["key", "size"]).select(F.col("key").alias("_key"), F.col("size").alias("_size"), F.col("share").alias("_share"), F.col("before").alias("_before"), F.expr("copies div n").alias("_base"), F.expr("copies % n").alias("_odd"), F.col("rate").alias("_rate"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"))
    placed = rows.withColumn("_share", share).hint("merge").join(cells, ["_key", "_size", "_share"])
    rank = F.col("_before") + F.row_number().over(Window.partitionBy("_key", "_size", "_share").orderBy(F.xxhash64("_id", F.lit(7)), "_id")) - 1
    return placed.withColumn("_copies", F.col("_base") + F.when(rank < F.col("_odd"), 1).otherwise(0))


def mix(docs: DataFrame, params: MixParams = MixParams(), doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, size, source_size, target, taken, copies and rate of every document."""
    rows = docs.select(F.col(doc_id).alias("_id"), _key(F.col(source)).alias("_key"), word_count(F.col(text)).alias("_size"))
    out = _assign(materialise(rows, "sizes"), params)
    return out.select(F.col("_id").alias("doc_id"), F.col("_size").alias("size"), F.col("_source_size").cast("long").alias("source_size"), F.col("_target").alias("target"), (F.col("_copies") * F.col("_size")).cast("long").alias("taken"), F.col("_copies").cast("int").alias("copies"), F.col("_rate").alias("rate"))


def mixed_documents(docs: DataFrame, params: MixParams = MixParams(), doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows of ``docs`` as the mix takes them: each as often as it has copies, with all its columns."""
    packed = docs.select(F.struct(*docs.columns).alias("_row"), F.col(doc_id).alias("_id"), _key(F.col(source)).alias("_key"), word_count(F.col(text)).alias("_size"))
    out = _assign(packed, params).where("_copies > 0")
    return out.select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select("_row.*")
