"""Chat formatting of reply trees.

Messages form trees by parent links.  Iterative self-joins double, in each round, how far a message's pointer reaches up
its tree, so a tree of depth d takes about log2(d) rounds; on the way every message learns its depth and the sum of the
scores above it.  Leaves are then ranked per tree by their branch's mean score, and only the chosen branches are
expanded, again by joins that halve the distance left, into exactly one row per message of a chosen path.  Joins are on
(tree, message), so a tree with a third of all messages is spread over all tasks; only a finished conversation is put
together in one place, in order, as it is one string.

The template marks turns with control strings.  Where such a string stands in a text, a backslash is put after its first
character; backslashes are doubled.  So no text can end its turn, and reading a conversation back gives every role and
text exactly.  The loss mask is the spans of assistant texts.

Defined results: a null text or role is empty; a message whose parent is missing starts a path; messages that only reach
a cycle have no root and are left out; rows with a null tree are one tree of their own; rows that repeat a (tree, node)
are one message, of which the row with the least parent (null first), score, role and text counts; a row with a null node
can't be placed in its tree and is left out; equal messages of a flat conversation are ordered by turn, role and text, and
each stays; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tensorloom.llm._shared import discard, materialise

#: The control strings of the template.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[ROLE]", "[NAME]", "[/ROLE]")
_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(r"\[INST\] (?P<user>.*?) \[/INST\]|\[SYS\] (?P<system>.*?) \[/SYS\]|\[ROLE\] (?P<role>.*?)\[NAME\](?P<other>.*?) \[/ROLE\]|(?P<assistant>.*?)</s>", re.DOTALL)
_FLUSH = 4 << 20


def escape(text: str) -> str:
    """A text without control strings, from which ``unescape`` restores it."""
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def format_turns(turns: Iterable[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """One conversation as a string, and the spans of it that are under the loss mask."""
    parts, spans, at = ["<s>"], [], 3
    for role, text in turns:
        body = escape(text)
        if role == "assistant":
            spans.append((at, at + len(body)))
            part = body + "</s>"
        elif role == "user":
            part = f"[INST] {body} [/INST]"
        elif role == "system":
            part = f"[SYS] {body} [/SYS]"
        else:
            part = f"[ROLE] {escape(role)}[NAME]{body} [/ROLE]"
        parts.append(part)
        at += len(part)
    return "".join(parts), spans


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation."""
    at, turns = 3, []
    if not formatted.startswith("<s>"):
        raise ValueError("a conversation begins with <s>")
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        kind = m.lastgroup
        turns.append((unescape(m["role"]), unescape(m["other"])) if kind == "other" else (kind, unescape(m[kind])))
        at = m.end()
    return turns


def flat_messages(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(tree, node, parent, score, role, text) of conversations without branches: each row replies to the one before it."""
    rows = conversations.select(F.col(conv_id).alias("tree"), F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    numbered = rows.withColumn("node", F.row_number().over(Window.partitionBy("tree").orderBy("turn", "role", "text")).cast("long"))
    return numbered.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), F.lit(0.0).alias("score"), "role", "text")


def single_messages(messages: DataFrame) -> DataFrame:
    """One row for each (tree, node) that isn't null, and all columns: the least row by parent, score, role and text."""
    rest = [c for c in ("parent", "score", "role", "text") if c in messages.columns]
    least = messages.where("node IS NOT NULL").groupBy("tree", "node").agg(F.min(F.struct(*rest)).alias("least"))
    return least.select("tree", "node", "least.*")


def branches(messages: DataFrame, top: int | None = 1) -> DataFrame:
    """(tree, leaf, rank, place, node): the messages of each tree's ``top`` best branches (all: None), in order from the root.

    ``messages``: tree, node, parent (null at a root), score.  Branches rank by mean score, ties by leaf.
    """
    return _branches(single_messages(messages.select("tree", "node", "parent", "score")), top)


def _branches(messages: DataFrame, top: int | None) -> DataFrame:
    links = materialise(messages.select("tree", "node", "parent", F.coalesce("score", F.lit(0.0)).cast("double").alias("score")), "links")
    largest = links.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    rounds = max(1, math.ceil(math.log2(max(2, largest))))
    here = links.select("tree", "node", F.col("parent").alias("up"), "score", F.lit(1).cast("long").alias("depth"), F.array("parent").alias("jumps"))
    for k in range(rounds + 1):
        live = here.where("up IS NOT NULL")
        if live.isEmpty():
            break
        above = here.select(F.col("tree").alias("t2"), F.col("node").alias("n2"), F.col("up").alias("up2"), F.col("score").alias("s2"), F.col("depth").alias("d2"))
        met = live.hint("merge").join(above, F.col("tree").eqNullSafe(F.col("t2")) & (F.col("up") == F.col("n2")), "left")
        moved = met.select("tree", "node", F.col("up2").alias("up"), (F.col("score") + F.coalesce("s2", F.lit(0.0))).alias("score"), (F.col("depth") + F.coalesce("d2", F.lit(0))).alias("depth"), F.concat("jumps", F.array("up2")).alias("jumps"))
        # Pointers that are still set after the last round go round a cycle.
        new = materialise(here.where("up IS NULL").union(moved), "pointers")
        discard(here)
        here = new
    rooted = here.where("up IS NULL")
    parents = links.where("parent IS NOT NULL").select(F.col("tree").alias("t2"), F.col("parent").alias("p2")).distinct()
    leaves = rooted.hint("merge").join(parents, F.col("tree").eqNullSafe(F.col("t2")) & (F.col("node") == F.col("p2")), "left_anti")
    ranked = leaves.withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy((F.col("score") / F.col("depth")).desc(), "node")))
    chosen = ranked if top is None else ranked.where(F.col("rank") <= top)
    # Each row stands for ``span`` messages that end at ``node``; it is split until it stands for one.
    row = chosen.select("tree", F.col("node").alias("leaf"), "rank", "node", F.col("depth").alias("span"), (F.col("depth") - 1).alias("place"))
    jumps = here.select(F.col("tree").alias("t2"), F.col("node").alias("n2"), "jumps")
    for k in range(rounds - 1, -1, -1):
        step = 1 << k
        met = row.hint("merge").join(jumps, F.col("tree").eqNullSafe(F.col("t2")) & (F.col("node") == F.col("n2")))
        near = F.struct("node", F.least("span", F.lit(step)).alias("span"), "place")
        far = F.struct(F.get("jumps", F.lit(k)).alias("node"), (F.col("span") - step).alias("span"), (F.col("place") - step).alias("place"))
        row = met.select("tree", "leaf", "rank", F.explode(F.when(F.col("span") > step, F.array(near, far)).otherwise(F.array(near))).alias("x")).select("tree", "leaf", "rank", "x.*")
    return row.select("tree", "leaf", "rank", "place", "node")


def format_conversations(messages: DataFrame, top: int | None = 1, unique: bool = False) -> DataFrame:
    """(tree, leaf, rank, formatted, loss_spans): one string per chosen branch.  ``messages``: tree, node, parent, score, role, text.

    ``unique``: the caller knows that no (tree, node) repeats, as in ``flat_messages``, so repeats needn't be looked for.
    """
    messages = messages if unique else single_messages(messages)
    paths = _branches(messages, top)
    texts = messages.select(F.col("tree").alias("t2"), F.col("node").alias("n2"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = paths.hint("merge").join(texts, F.col("tree").eqNullSafe(F.col("t2")) & (F.col("node") == F.col("n2"))).select("tree", "leaf", "rank", "place", "role", "text")
    ordered = turns.repartition("tree", "leaf").sortWithinPartitions("tree", "leaf", "place")

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, turns, done, size = None, [], [], 0

        def flush() -> pa.RecordBatch:
            spans = pa.array([[{"start": a, "stop": b} for a, b in s] for _, (_, s) in done], pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))
            columns = [pa.array([k[0] for k, _ in done], pa.int64()), pa.array([k[1] for k, _ in done], pa.int64()), pa.array([k[2] for k, _ in done], pa.int32()), pa.array([f for _, (f, _) in done], pa.string()), spans]
            return pa.RecordBatch.from_arrays(columns, names=["tree", "leaf", "rank", "formatted", "loss_spans"])

        for batch in batches:
            for tree, leaf, rank, role, text in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2, 4, 5)), strict=True):
                if (tree, leaf, rank) != key:
                    if key is not None:
                        done.append((key, format_turns(turns)))
                        size += len(done[-1][1][0])
                        if size > _FLUSH:
                            yield flush()
                            done, size = [], 0
                    key, turns = (tree, leaf, rank), []
                turns.append((role, text))
        if key is not None:
            done.append((key, format_turns(turns)))
            yield flush()

    return ordered.mapInArrow(assemble, "tree long, leaf long, rank int, formatted string, loss_spans array<struct<start: long, stop: long>>")


def digests(formatted: DataFrame) -> DataFrame:
    """What is read back from each formatted conversation: its turns, and the texts under the loss mask."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                turns = read_turns(text)
                whole, loss, chars = hashlib.sha256(), hashlib.sha256(), 0
                for role, body in turns:
                    whole.update(f"{role}\n{body}\n".encode("utf-8", "surrogatepass"))
                for s in spans:
                    body = unescape(text[s["start"] : s["stop"]])
                    chars += len(body)
                    loss.update(body.encode("utf-8", "surrogatepass"))
                rows.append((len(turns), whole.hexdigest(), chars, loss.hexdigest(), len(text)))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.select(F.col("tree").alias("conv_id"), "formatted", "loss_spans").mapInArrow(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
