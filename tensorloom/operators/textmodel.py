"""A recurrent text model: vocabulary, word ids, and a gated recurrent unit that predicts each next word.

Texts are cut to windows of ``steps`` words in one pass without a shuffle.  A training step is one pass over the windows:
every partition runs the unit forward and backward over small batches and gives one row of sums, which Spark adds up by
parameter, so what reaches the driver has the size of the model, whatever the data's.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The largest vocabulary that is handed to every worker.
MAX_WORDS = 200_000


def words(text: Column) -> Column:
    """Lower-cased words between blanks; null and blank texts have none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != "")


@dataclass(frozen=True)
class Vocabulary:
    """Id 0 marks the end of a text; words have ids from 1 by frequency, ties by word; all others share the last id."""

    ids: dict[str, int]

    @property
    def size(self) -> int:
        return len(self.ids) + 2

    @classmethod
    def of(cls, docs: DataFrame, text: str, limit: int) -> Vocabulary:
        if limit > MAX_WORDS:
            raise ValueError(f"a vocabulary has at most {MAX_WORDS} words")
        counts = docs.select(F.explode(words(F.col(text))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
        return cls({r.w: k for k, r in enumerate(counts.orderBy(F.col("n").desc(), "w").limit(limit).collect(), 1)})

    def windows(self, docs: DataFrame, text: str, steps: int) -> DataFrame:
        """Ids of each text and its end mark, in windows of steps + 1 that share one word with the next; the last is shorter."""
        ids, unknown = self.ids, len(self.ids) + 1

        def cut(tables: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for table in tables:
                found = [[*(ids.get(w, unknown) for w in row), 0] for row in table["w"]]
                yield pd.DataFrame({"ids": pd.Series([f[at : at + steps + 1] for f in found for at in range(0, len(f) - 1, steps)], dtype=object)})

        return docs.select(words(F.col(text)).alias("w")).mapInPandas(cut, "ids array<int>")


@dataclass(frozen=True)
class GatedUnit:
    """z and r are sigmoid gates, c = tanh(x C + (r h) D + d), h' = (1 - z) h + z c, and the next word softmax(h' O + o)."""

    size: int
    hidden: int = 16

    def shapes(self) -> dict[str, tuple[int, ...]]:
        v, h = self.size, self.hidden
        gates = {f"{kind}{gate}": (h,) if kind == "b" else (h, h) for gate in "zrc" for kind in "wub"}
        return {"embed": (v, h), **gates, "out": (h, v), "bias": (v,)}

    def start(self, seed: int = 0) -> np.ndarray:
        """Weights between +-sqrt(6 / (in + out)), biases 0, in one flat vector."""
        rng = np.random.default_rng(seed)
        return np.concatenate([np.zeros(s[0]) if len(s) == 1 else rng.uniform(-1, 1, s).reshape(-1) * np.sqrt(6 / sum(s)) for s in self.shapes().values()])

    def unpack(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for name, shape in self.shapes().items():
            n = int(np.prod(shape))
            out[name] = flat[at : at + n].reshape(shape)
            at += n
        return out

    def _forward(self, p: dict[str, np.ndarray], inputs: np.ndarray, here: np.ndarray):
        h, kept = np.zeros((len(inputs), self.hidden)), []
        for t in range(inputs.shape[1]):
            x = p["embed"][inputs[:, t]]
            z, r = (1 / (1 + np.exp(-(x @ p[f"w{g}"] + h @ p[f"u{g}"] + p[f"b{g}"]))) for g in "zr")
            c = np.tanh(x @ p["wc"] + (r * h) @ p["uc"] + p["bc"])
            new = np.where(here[:, t, None], (1 - z) * h + z * c, h)
            kept.append((h, x, z, r, c, new))
            h = new
        return kept

    def loss(self, flat: np.ndarray, rows: list[np.ndarray]) -> tuple[float, int, np.ndarray]:
        """Summed cross entropy of all next words of some windows, their number, and the gradient of the sum."""
        p, longest = self.unpack(flat), max(len(r) for r in rows)
        ids, here = np.zeros((len(rows), longest), int), np.zeros((len(rows), longest), bool)
        for k, r in enumerate(rows):
            ids[k, : len(r)], here[k, : len(r)] = r, True
        inputs, targets, here = ids[:, :-1], ids[:, 1:], here[:, 1:]
        kept = self._forward(p, inputs, here)
        total, g, back = 0.0, {n: np.zeros_like(a) for n, a in p.items()}, np.zeros((len(rows), self.hidden))
        for t in reversed(range(inputs.shape[1])):
            h, x, z, r, c, new = kept[t]
            logit = new @ p["out"] + p["bias"]
            logit -= logit.max(1, keepdims=True)
            chance = np.exp(logit)
            norm = chance.sum(1)
            each = np.arange(len(rows))
            total += float(((np.log(norm) - logit[each, targets[:, t]]) * here[:, t]).sum())
            error = chance / norm[:, None]
            error[each, targets[:, t]] -= 1
            error *= here[:, t, None]
            g["out"] += new.T @ error
            g["bias"] += error.sum(0)
            d = (back + error @ p["out"].T) * here[:, t, None]
            dc, dz = d * z * (1 - c**2), d * (c - h) * z * (1 - z)
            held = dc @ p["uc"].T
            dr = held * h * r * (1 - r)
            dx = dc @ p["wc"].T + dz @ p["wz"].T + dr @ p["wr"].T
            for name, slope, state in (("c", dc, r * h), ("z", dz, h), ("r", dr, h)):
                g[f"w{name}"] += x.T @ slope
                g[f"u{name}"] += state.T @ slope
                g[f"b{name}"] += slope.sum(0)
            np.add.at(g["embed"], inputs[:, t], dx)
            back = back * ~here[:, t, None] + d * (1 - z) + held * r + dz @ p["uz"].T + dr @ p["ur"].T
        return total, int(here.sum()), np.concatenate([g[n].reshape(-1) for n in p])

    def gradient(self, windows: DataFrame, flat: np.ndarray, batch: int = 64) -> tuple[float, np.ndarray]:
        """Mean loss of a next word over all windows, and its gradient; (nan, zeros) without windows."""

        def sums(tables: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            found = np.zeros(len(flat) + 2)
            for table in tables:
                rows = [np.asarray(r) for r in table["ids"]]
                for at in range(0, len(rows), batch):
                    loss, n, g = self.loss(flat, rows[at : at + batch])
                    found += np.concatenate([[loss, n], g])
            yield pd.DataFrame({"s": [found]})

        rows = windows.mapInPandas(sums, "s array<double>").select(F.posexplode("s").alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v")).collect()
        out = np.zeros(len(flat) + 2)
        for r in rows:
            out[r.k] = r.v
        return (out[0] / out[1], out[2:] / out[1]) if out[1] else (float("nan"), out[2:])

    def train(self, windows: DataFrame, optimizer, iterations: int, seed: int = 0) -> tuple[np.ndarray, list[float]]:
        """The parameters after some steps over all windows, and the loss before each."""
        flat, log = self.start(seed), []
        for _ in range(iterations):
            loss, g = self.gradient(windows, flat)
            log.append(loss)
            if not np.isfinite(loss):
                break
            flat = optimizer.step(flat, g)
        return flat, log

    def next_words(self, flat: np.ndarray, ids: list[int], n: int) -> list[int]:
        """The likeliest continuation, up to ``n`` words or the end mark."""
        p, out = self.unpack(flat), list(ids)
        for _ in range(n):
            inputs = np.array([out])
            h = self._forward(p, inputs, np.ones(inputs.shape, bool))[-1][-1]
            out.append(int((h @ p["out"] + p["bias"]).argmax()))
            if out[-1] == 0:
                break
        return out[len(ids) :]
