"""Nearest neighbours by inner product: one hierarchical navigable small-world graph for each shard.

Vectors are dealt to shards of bounded size by a hash. A shard's graph is one row: its
ids and vectors, and for each level a flat array of neighbours, so many places for each
node, into which nodes are inserted by searching it. Every block of queries comes to every shard, whose graph stays
where it is; a block's queries are walked through the graph in step, and the shards' best are merged.

Inner products become distances by one more coordinate that brings all vectors of a
shard to one length (queries have 0 there), so that lengths may differ.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import durable

#: Vectors in a shard; queries in a block.
SHARD, BLOCK = 16_384, 512
#: Neighbours chosen for a node (twice as many are kept at the lowest level); candidates they are chosen from; width of the search.
LINKS, CANDIDATES, WIDTH = 16, 64, 256
#: Nodes that a walk opens at once.
AT_ONCE = 4
#: Nodes of a level that are all compared; nodes inserted together; more nodes that a search takes than it was asked for.
EXACT, BATCH, MARGIN = 4096, 256, 12
#: Width of the walk for a node that is inserted.
BUILD_WIDTH = 160


def _chosen(near: np.ndarray, among: np.ndarray, most: int) -> np.ndarray:
    """Which candidates to link to, for each row of candidates sorted by nearness: those nearer to the
    node than to any chosen before, then the nearest others, ``most`` in all. ``among`` has the candidates' nearness to each other."""
    rows, n = near.shape
    real = near > -np.inf
    chosen = np.zeros((rows, n), bool)
    for c in range(n):
        chosen[:, c] = real[:, c] & (chosen.sum(1) < most) & ~(chosen & (among[:, c, :] >= near[:, c, None])).any(1)
    rank = np.where(chosen, np.arange(n), np.where(real, n, 2 * n) + np.arange(n))
    order = np.argsort(rank, axis=1)[:, :most]
    keep = np.zeros((rows, n), bool)
    np.put_along_axis(keep, order, True, 1)
    return keep & real


def _pick(x: np.ndarray, near: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Rows of ``most`` chosen neighbours, -1 where there are fewer."""
    order = np.argsort(-near, axis=1, kind="stable")
    near, ids = np.take_along_axis(near, order, 1), np.take_along_axis(ids, order, 1)
    vectors = x[np.maximum(ids, 0)]
    keep = _chosen(near, vectors @ vectors.transpose(0, 2, 1), most)
    out = np.full((len(ids), most), -1, np.int32)
    place = np.cumsum(keep, 1) - 1
    r, c = np.nonzero(keep)
    out[r, place[r, c]] = ids[r, c]
    return out


def _best(near: np.ndarray, k: int) -> np.ndarray:
    k = min(k, near.shape[1])
    return np.argpartition(-near, k - 1, axis=1)[:, :k]


@dataclass
class Graph:
    """``levels``: nodes of each level and their neighbours, as node numbers, the lowest level first."""

    vectors: np.ndarray
    levels: list[tuple[np.ndarray, np.ndarray]]
    single: np.ndarray | None = None

    @staticmethod
    def build(vectors: np.ndarray) -> Graph:
        """Nodes of higher levels come first in the order of insertion. The first EXACT nodes of a level are linked by comparing all, which is
        faster up to there; the others are inserted a batch at a time, by searching what there is so far."""
        n = len(vectors)
        lengths = (vectors**2).sum(1)
        level = np.floor(-np.log(1 - np.random.default_rng(n).random(n)) / math.log(LINKS)).astype(int)
        order = np.argsort(-level, kind="stable")
        x = np.c_[vectors, np.sqrt(np.maximum(lengths.max() - lengths, 0))].astype(np.float32)[order]
        sizes = [int((level >= k).sum()) for k in range(int(level.max()) + 1)]
        levels: list[tuple[np.ndarray, np.ndarray]] = []
        for k in range(len(sizes) - 1, -1, -1):
            most = 2 * LINKS if k == 0 else LINKS
            links = Graph._level(x[: sizes[k]], most) if sizes[k] <= EXACT else Graph._grown(x, sizes[k], most, levels)
            levels.insert(0, (np.arange(sizes[k], dtype=np.int32), links))
        named = [(order[nodes].astype(np.int32), np.where(links >= 0, order[np.maximum(links, 0)], -1).astype(np.int32)) for nodes, links in levels]
        return Graph(vectors, [(nodes[by], links[by]) for nodes, links in named for by in [np.argsort(nodes)]])

    @staticmethod
    def _grown(x: np.ndarray, n: int, most: int, above: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Links of the first n nodes: of EXACT by comparing all, those of ``above`` among them, then a batch at a time."""
        links, at = np.full((n, most), -1, np.int32), min(n, EXACT)
        links[:at] = Graph._level(x[:at], most)
        while at < n:
            stop = min(n, at + min(BATCH, at))
            graph = Graph(x[:at], [(np.arange(at, dtype=np.int32), links[:at]), *above])
            ids, near = graph.walk(x[at:stop], BUILD_WIDTH)
            inside = x[at:stop] @ x[at:stop].T  # those of the batch before it
            inside[np.arange(stop - at)[None, :] >= np.arange(stop - at)[:, None]] = -np.inf
            some = _best(inside, LINKS)
            near = np.c_[near, np.take_along_axis(inside, some, 1)]
            ids = np.c_[ids, np.where(near[:, -some.shape[1] :] > -np.inf, some + at, -1)]
            mine = _pick(x, near, ids, LINKS)
            links[at:stop, :LINKS] = mine
            r, c = np.nonzero(mine >= 0)
            Graph._link_back(x, links, mine[r, c].astype(np.int64), r + at)
            at = stop
        return links

    @staticmethod
    def _link_back(x: np.ndarray, links: np.ndarray, node: np.ndarray, to: np.ndarray) -> None:
        """Adds links from ``node`` to ``to``; a node that has too many then chooses among all."""
        most = links.shape[1]
        order = np.argsort(node, kind="stable")
        node, to = node[order], to[order]
        nodes, first, count = np.unique(node, return_index=True, return_counts=True)
        have = (links[nodes] >= 0).sum(1)
        rank = np.arange(len(node)) - np.repeat(first, count)
        wide = np.full((len(nodes), most + int(count.max())), -1, np.int64)
        wide[:, :most] = np.take_along_axis(links[nodes], np.argsort(links[nodes] < 0, axis=1, kind="stable"), 1)
        row = np.repeat(np.arange(len(nodes)), count)
        wide[row, have[row] + rank] = to
        full = have + count > most
        links[nodes[~full]] = wide[~full, :most]
        for at in range(0, int(full.sum()), 256):
            own, those = nodes[full][at : at + 256], wide[full][at : at + 256]
            near = np.where(those >= 0, np.einsum("ijk,ik->ij", x[np.maximum(those, 0)], x[own]), -np.inf)
            links[own] = _pick(x, near, those, most)

    @staticmethod
    def _level(x: np.ndarray, most: int) -> np.ndarray:
        """Each of a few nodes links to chosen ones of the nearest before it, and those link back."""
        links = np.full((len(x), most), -1, np.int32)
        near = x @ x.T
        near[np.arange(len(x))[None, :] >= np.arange(len(x))[:, None]] = -np.inf
        ids = _best(near, CANDIDATES)
        mine = _pick(x, np.take_along_axis(near, ids, 1), ids, min(most, LINKS))
        links[:, : mine.shape[1]] = mine
        r, c = np.nonzero(mine >= 0)
        if len(r):
            Graph._link_back(x, links, mine[r, c].astype(np.int64), r)
        return links

    def search(self, queries: np.ndarray, k: int, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
        """The k nodes found nearest to each query, nearest first, and inner products in double precision; -1 and -inf where there are fewer.
        Some more are walked to than k, as the walk reckons in single precision."""
        ids = self.walk(queries, max(width, k + MARGIN))[0]
        score = np.where(ids >= 0, np.einsum("ijk,ik->ij", self.vectors[np.maximum(ids, 0)], queries), -np.inf)
        order = np.argsort(-score, axis=1, kind="stable")[:, :k]
        score = np.take_along_axis(score, order, 1)
        return np.where(score > -np.inf, np.take_along_axis(ids, order, 1), -1), score

    def walk(self, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Up to ``width`` nodes for each query, in no order, and inner products in single precision; -1 and -inf where there are fewer."""
        if self.single is None:
            self.single = self.vectors.astype(np.float32, copy=False)
        x, q = self.single, queries.astype(np.float32, copy=False)
        n, rows = len(x), np.arange(len(q))
        here = np.full(len(q), self.levels[-1][0][0])
        score = np.einsum("ij,ij->i", x[here], q)
        place = np.zeros(n, np.int32)
        for nodes, links in self.levels[:0:-1]:
            place[nodes] = np.arange(len(nodes))
            moving = np.ones(len(q), bool)
            while moving.any():
                m = rows[moving]
                to = links[place[here[m]]]
                near = np.where(to >= 0, np.einsum("ijk,ik->ij", x[np.maximum(to, 0)], q[m]), -np.inf)
                best = near.argmax(1)
                top = near[np.arange(len(m)), best]
                better = top > score[m]
                here[m[better]], score[m[better]] = to[better, best[better]], top[better]
                moving[m[~better]] = False
        ids, near = np.full((len(q), width), -1, np.int64), np.full((len(q), width), -np.inf, np.float32)
        ids[:, 0], near[:, 0] = here, score
        opened, seen = np.ones((len(q), width), bool), np.zeros((len(q), n), bool)
        opened[:, 0], seen[rows, here] = False, True
        links, active = self.levels[0][1], rows
        while len(active):
            waiting = np.where(opened[active], -np.inf, near[active])
            pick = _best(waiting, AT_ONCE)
            valid = np.take_along_axis(waiting, pick, 1) > -np.inf
            some = valid.any(1)
            active, pick, valid = active[some], pick[some], valid[some]
            if not len(active):
                break
            opened[active[:, None], pick] |= valid
            to = np.where(valid[:, :, None], links[np.maximum(ids[active[:, None], pick], 0)], -1).reshape(len(active), -1)
            to = np.sort(to, axis=1)
            fresh = (to >= 0) & np.concatenate([np.ones((len(to), 1), bool), to[:, 1:] != to[:, :-1]], 1)
            fresh &= ~seen[active[:, None], np.maximum(to, 0)]
            r, c = np.nonzero(fresh)
            seen[active[r], to[r, c]] = True
            value = np.full(to.shape, -np.inf, np.float32)
            value[r, c] = np.einsum("ij,ij->i", x[to[r, c]], q[active[r]])
            both, whose = np.concatenate([near[active], value], 1), np.concatenate([ids[active], to], 1)
            open_ = np.concatenate([opened[active], ~fresh], 1)
            keep = _best(both, width)
            near[active], ids[active], opened[active] = (np.take_along_axis(v, keep, 1) for v in (both, whose, open_))
        return np.where(near > -np.inf, ids, -1), near


#: A row is a shard's graph (kind 0), or a block of queries that comes to the shard (kind 1).
ROW = "dim int, shard int, kind int, ids binary, vectors binary, nodes array<binary>, links array<binary>"


def _built(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("vec_id")
    graph = Graph.build(np.stack(group["v"].to_numpy()).astype(np.float64))
    nodes, links = ([a[k].tobytes() for a in graph.levels] for k in (0, 1))
    return pd.DataFrame([(group["dim"].iloc[0], group["shard"].iloc[0], 0, group["vec_id"].to_numpy(np.int64).tobytes(), graph.vectors.tobytes(), nodes, links)], columns=["dim", "shard", "kind", "ids", "vectors", "nodes", "links"])


def _blocked(group: pd.DataFrame) -> pd.DataFrame:
    vectors = np.stack(group["v"].to_numpy()).astype(np.float64)
    return pd.DataFrame([(group["dim"].iloc[0], group["vec_id"].to_numpy(np.int64).tobytes(), vectors.tobytes())], columns=["dim", "ids", "vectors"])


def _searched(k: int, width: int):
    """Rows sorted by shard, its graph before the blocks: one graph and one block are held at a time."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, graph, ids = None, None, None
        for batch in batches:
            for row in batch.itertuples():
                mine = np.frombuffer(row.ids, np.int64)
                vectors = np.frombuffer(row.vectors, np.float64).reshape(len(mine), -1)
                if row.kind == 0:
                    nodes = [np.frombuffer(b, np.int32) for b in row.nodes]
                    links = [np.frombuffer(b, np.int32).reshape(len(a), -1) for a, b in zip(nodes, row.links)]
                    shard, graph, ids = (row.dim, row.shard), Graph(vectors, list(zip(nodes, links))), mine
                elif shard == (row.dim, row.shard):  # else the shard has no vectors
                    found, score = graph.search(vectors, min(k, len(ids)), width)
                    r, c = np.nonzero(found >= 0)
                    yield pd.DataFrame({"query_id": mine[r], "first_id": ids[found[r, c]], "score": score[r, c]})

    return run


def usable(v: str | Column) -> Column:
    """Neither null, empty nor zero, and without null or non-finite components."""
    return F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, shard: int = SHARD, width: int = WIDTH) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of ``vectors`` (vec_id, v) for each of ``queries`` (vec_id, v), but the query's own id.

    Vectors that aren't usable and rows without an id take no part; of different vectors with one id the
    least one does. Vectors only meet queries of their dimension. Equal vectors are one node,
    which stands for the k + 1 smallest of its ids, all that can be among the nearest; so any number of copies makes no hot group.
    """
    all_ = durable(vectors.where(usable("v") & F.col("vec_id").isNotNull()).groupBy("vec_id").agg(F.min(F.col("v").cast("array<double>")).alias("v")))
    of = F.row_number().over(W.partitionBy("v").orderBy("vec_id"))
    copies = durable(all_.withColumn("copy", of).where(F.col("copy") <= k + 1).withColumn("first_id", F.first("vec_id").over(W.partitionBy("v").orderBy("vec_id"))))
    nodes = copies.where("copy = 1").select("vec_id", "v", F.size("v").alias("dim"))
    shards = max(1, math.ceil(nodes.count() / shard))
    graphs = nodes.withColumn("shard", F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int")).groupBy("dim", "shard").applyInPandas(_built, ROW)
    asked = queries.where(usable("v") & F.col("vec_id").isNotNull()).groupBy("vec_id").agg(F.min(F.col("v").cast("array<double>")).alias("v"))
    blocks = max(1, math.ceil(queries.count() / BLOCK))
    asked = asked.withColumn("dim", F.size("v")).groupBy("dim", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("block")).applyInPandas(_blocked, "dim int, ids binary, vectors binary")
    none = F.lit(None).cast("array<binary>")
    sent = asked.select("dim", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("kind"), "ids", "vectors", none.alias("nodes"), none.alias("links"))
    # blocks come to the graphs: they are smaller
    met = graphs.unionByName(sent).repartition(max(shards, graphs.sparkSession.sparkContext.defaultParallelism), "dim", "shard").sortWithinPartitions("dim", "shard", "kind")
    found = met.mapInPandas(_searched(k + 1, width), "query_id long, first_id long, score double")
    best = found.withColumn("n", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "first_id"))).where(F.col("n") <= k + 1).drop("n")
    each = best.join(copies.select("first_id", "vec_id"), "first_id").where("vec_id <> query_id")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return each.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def query(spark: SparkSession, embeddings: DataFrame) -> DataFrame:
    rows = embeddings.select("vec_id", F.col("embedding").alias("v"))
    return search(rows, rows.where("vec_id % 20 = 0"))
