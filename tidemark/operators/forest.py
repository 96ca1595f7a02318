"""Boosted trees for all month ends of a walk-forward side by side, a level at a time, from added histograms.

No group holds a window. Rows stay in their partitions, each with what is fitted to it so far in each window that it is in;
a task adds up histograms of residuals by (window, node, feature, bin), these are added by window, and
the splits chosen, a few numbers for each node, go back to all tasks. What is shuffled grows with tasks, windows and bins,
not with rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.model import FEATURES, train_sets
from tidemark.sources.kept import kept

#: Values are told apart by a fixed grid that is even in the inverse hyperbolic sine: steps of 4e-7 about nought, of 0.4 % further out.
UNIT, STEPS, MOST = 1e-4, 256, 4096
#: Trees after which what is fitted is written anew.
WRITE = 10


def fine(value: str) -> Column:
    """The cell of a value in the fixed grid, from 0 to 2 * MOST."""
    return (F.least(F.lit(MOST), F.greatest(F.lit(-MOST), F.floor(F.asinh(F.col(value) / UNIT) * STEPS))) + MOST).cast("int")


def cuts(counts: np.ndarray, bins: int) -> np.ndarray:
    """The last cell of each bin but the last: the cells at which counts reach equal shares."""
    upto = np.cumsum(counts)
    return np.unique(np.searchsorted(upto, np.ceil(np.arange(1, bins) / bins * upto[-1]), "left"))


def best_splits(n: np.ndarray, s: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of histograms (node, feature, bin): feature and last bin that goes left for each node, and counts and sums of its two sides. Without a gain all go left."""
    n, s = n.cumsum(2), s.cumsum(2)
    rest, total = n[:, :, -1:] - n, s[:, :, -1:]
    gain = s**2 / np.maximum(n, 1) + (total - s) ** 2 / np.maximum(rest, 1) - total**2 / np.maximum(n[:, :, -1:], 1)
    gain = np.where((n >= least) & (rest >= least), gain, 0.0)
    nodes, bins = np.arange(n.shape[0]), n.shape[2]
    cut = gain.argmax(2)
    reached = np.take_along_axis(gain, cut[:, :, None], 2)[:, :, 0]
    feature = reached.argmax(1)
    at = np.where(reached[nodes, feature] > 0, cut[nodes, feature], bins - 1)
    left = np.stack([n[nodes, feature, at], s[nodes, feature, at]], 1)
    whole = np.stack([n[nodes, feature, -1], s[nodes, feature, -1]], 1)
    return feature, at, left, whole - left


class Windows:
    """The month ends of a walk-forward, by number, with their bins and trees. ``of`` a day are those whose training rows it gives."""

    def __init__(self, spans: list, features: int):
        self.rebal, self.start, self.end = (np.array([r[k] for r in spans], "datetime64[D]") for k in range(3))
        self.bins = np.zeros((len(spans), features, 2 * MOST + 1), np.uint8)
        self.base, self.trees = np.zeros(len(spans)), []

    def of(self, days: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and window of each pair; windows begin and end in their order."""
        first, last = np.searchsorted(self.end, days, "left"), np.searchsorted(self.start, days, "right")
        many = np.maximum(last - first, 0)
        row = np.repeat(np.arange(len(days)), many)
        return row, np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)

    def leaf(self, tree: list, window: np.ndarray, bins: np.ndarray) -> np.ndarray:
        """The node that each pair reaches in as many levels as the tree has so far."""
        node = np.zeros(len(window), np.int64)
        for feature, cut in tree:
            f = feature[window, node]
            node = 2 * node + (bins[np.arange(len(window)), f] > cut[window, node])
        return node


def _columns(batch: pa.RecordBatch, features: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    days = batch.column(0).to_numpy(zero_copy_only=False).astype("datetime64[D]")
    codes = np.stack([batch.column(2 + k).to_numpy(zero_copy_only=False) for k in range(features)], 1)
    return days, codes, batch.column(2 + features).to_numpy(zero_copy_only=False)


def walk_forward(panel: DataFrame, features: tuple[str, ...] = FEATURES, trees: int = 100, depth: int = 4, least: int = 50, rate: float = 0.05, bins: int = 64, **protocol) -> DataFrame:
    """date, ticker, prediction for the rows of each month end, by trees boosted on the rows of its window; no rows where no month end has rows enough."""
    spark = panel.sparkSession
    spans = sorted(tuple(r) for r in train_sets(panel, **protocol).select("rebal", "train_start", "train_end").collect())  # one for each month
    rows = kept(panel.select("date", "ticker", *[fine(f).alias(f) for f in features], F.col("target").cast("double")))
    out = "date date, ticker string, prediction double"
    if not spans:
        return spark.createDataFrame([], out)
    known, width = Windows(spans, len(features)), len(features)

    def summed(of, source: DataFrame, shape: tuple[int, ...], finish, kind: str) -> list:
        """Rows of ``finish`` (window, array), where an array of ``shape`` for each window is the sum of those that ``of`` adds up over batches."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(spans), *shape))
            for batch in batches:
                of(batch, total)
            some = np.flatnonzero(total.reshape(len(spans), -1).any(1))
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([total[w].tobytes() for w in some], pa.binary())], ["w", "part"])

        def one(pdf):
            import pandas as pd

            whole = sum(np.frombuffer(x) for x in pdf["part"]).reshape(shape)
            return pd.DataFrame([(int(pdf["w"].iloc[0]), finish(whole))], columns=["w", "found"])

        return source.mapInArrow(run, "w long, part binary").groupBy("w").applyInPandas(one, f"w long, found {kind}").collect()

    def count(batch: pa.RecordBatch, total: np.ndarray) -> None:
        days, codes, y = _columns(batch, width)
        row, w = known.of(days)
        for f in range(width):
            np.add.at(total, (w, f, codes[row, f]), 1)
        np.add.at(total, (w, width, 0), y[row])

    def edges(whole: np.ndarray) -> list[float]:
        said = [cuts(whole[f], bins) for f in range(width)]
        return [float(whole[width, 0] / whole[0].sum()), *[float(x) for f in range(width) for x in (len(said[f]), *said[f])]]

    for r in summed(count, rows, (width + 1, 2 * MOST + 1), edges, "array<double>"):
        known.base[r.w], at = r.found[0], 1
        for f in range(width):
            n = int(r.found[at])
            known.bins[r.w, f] = np.searchsorted(r.found[at + 1 : at + 1 + n], np.arange(2 * MOST + 1), "left")
            at += 1 + n
    shared, written, state = spark.sparkContext.broadcast(known.bins), 0, rows.withColumn("fitted", F.lit(None).cast("array<double>"))

    def fitted_of(batch: pa.RecordBatch, row: np.ndarray, w: np.ndarray, codes: np.ndarray, done: list) -> tuple[np.ndarray, np.ndarray]:
        b = shared.value[w[:, None], np.arange(width), codes[row]]
        held = batch.column(3 + width)
        fitted = known.base[w] if held.null_count else np.array(held.flatten().to_numpy(zero_copy_only=False))
        for tree, leaves in done:
            fitted = fitted + leaves[w, known.leaf(tree, w, b)]
        return b, fitted

    def rewritten(source: DataFrame, done: list) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                days, codes, _ = _columns(batch, width)
                row, w = known.of(days)
                _, fitted = fitted_of(batch, row, w, codes, done)
                edge = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(days)))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(edge), pa.array(fitted))
                yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(3 + width)], lists], names=batch.schema.names)

        return kept(source.mapInArrow(run, source.schema))

    all_trees: list = []
    for t in range(trees):
        tree: list = []
        done = all_trees[written:]
        for level in range(depth):
            nodes = 1 << level

            def add(batch: pa.RecordBatch, total: np.ndarray, tree=tuple(tree), nodes=nodes, done=done) -> None:
                days, codes, y = _columns(batch, width)
                row, w = known.of(days)
                b, fitted = fitted_of(batch, row, w, codes, done)
                node, left = known.leaf(tree, w, b), y[row] - fitted
                for f in range(width):
                    place = ((w * nodes + node) * width + f) * bins + b[:, f]
                    size = len(spans) * nodes * width * bins
                    total[:, 0] += np.bincount(place, minlength=size).reshape(len(spans), nodes, width, bins)
                    total[:, 1] += np.bincount(place, left, size).reshape(len(spans), nodes, width, bins)

            def choose(whole: np.ndarray) -> list[float]:
                feature, cut, left, right = best_splits(whole[0], whole[1], least)
                return [*feature.astype(float), *cut.astype(float), *np.stack([left, right], 1).ravel()]

            feature, cut, sides = np.zeros((len(spans), nodes), np.int64), np.full((len(spans), nodes), bins, np.int64), np.zeros((len(spans), 2 * nodes, 2))
            for r in summed(add, state, (2, nodes, width, bins), choose, "array<double>"):
                x = np.array(r.found)
                feature[r.w], cut[r.w], sides[r.w] = x[:nodes], x[nodes : 2 * nodes], x[2 * nodes :].reshape(2 * nodes, 2)
            tree.append((feature, cut))
        all_trees.append((tree, rate * sides[:, :, 1] / np.maximum(sides[:, :, 0], 1)))
        if (t + 1) % WRITE == 0 and t + 1 < trees:
            state, written = rewritten(state, all_trees[written:]), t + 1
    place = {d: k for k, d in enumerate(known.rebal.tolist())}
    asked = rows.where(F.col("date").isin(list(place)))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            days, codes, _ = _columns(batch, width)
            w = np.array([place[d] for d in days.tolist()], np.int64)
            b = shared.value[w[:, None], np.arange(width), codes]
            got = known.base[w]
            for tree, leaves in all_trees:
                got = got + leaves[w, known.leaf(tree, w, b)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(got)], ["date", "ticker", "prediction"])

    return asked.mapInArrow(predict, out)
