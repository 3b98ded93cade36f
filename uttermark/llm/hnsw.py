"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard.

Equal vectors are one node.  Nodes are dealt into shards by hash; a shard's graph is kept as flat
arrays (vectors, neighbours of the ground layer, neighbours of the upper layers) in one row of the
index table.  Every query visits every shard, and the shards' nearest are merged.
"""

from __future__ import annotations

import math
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from uttermark.llm.common import stored

SHARD = 8192  # nodes
LINKS = 12  # per node and layer; twice as many on the ground
BUILD_WIDTH = 64
SEARCH_WIDTH = 200
BLOCK = 256  # queries that travel together


class Graph:
    """One shard.  ``ground`` is n x 2 LINKS neighbours, -1 where none; ``upper[l]`` maps nodes of
    layer l + 1 to their neighbours."""

    def __init__(self, vectors: np.ndarray):
        self.x = np.ascontiguousarray(vectors, dtype=np.float64)
        self.square = np.einsum("ij,ij->i", self.x, self.x)
        self.ground = np.full((len(self.x), 2 * LINKS), -1, dtype=np.int32)
        self.degree = np.zeros(len(self.x), dtype=np.int32)
        self.upper: list[dict[int, np.ndarray]] = []
        self.entry = -1
        self.stamp = np.zeros(len(self.x), dtype=np.int64)
        self.turn = 0

    def build(self, seed: int) -> Graph:
        heights = np.random.default_rng(seed).random(len(self.x))
        heights = np.floor(-np.log(1 - heights) / math.log(LINKS)).astype(int)
        for node, height in enumerate(heights.tolist()):
            self._insert(node, height)
        return self

    def around(self, node: int, layer: int) -> np.ndarray:
        if layer == 0:
            return self.ground[node, : self.degree[node]]
        return self.upper[layer - 1][node]

    def _insert(self, node: int, height: int) -> None:
        if self.entry < 0:
            self.upper = [{node: np.empty(0, dtype=np.int32)} for _ in range(height)]
            self.entry = node
            return
        q, top = self.x[node], len(self.upper)
        near = [(self._distance(q, self.square[node], np.array([self.entry]))[0], self.entry)]
        for layer in range(top, height, -1):
            near = self._near(q, near, 1, layer)
        for layer in range(min(top, height), -1, -1):
            near = self._near(q, near, BUILD_WIDTH, layer)
            ids = np.array([i for _, i in near])
            chosen = ids[self._spread(np.array([d for d, _ in near]), ids, LINKS)]
            self._set(node, layer, chosen)
            most = 2 * LINKS if layer == 0 else LINKS
            for other in chosen.tolist():
                mine = self.around(other, layer)
                if len(mine) < most:
                    self._set(other, layer, np.append(mine, node))
                else:
                    all_ = np.append(mine, node)
                    d = self._distance(self.x[other], self.square[other], all_)
                    order = np.argsort(d, kind="stable")
                    self._set(other, layer, all_[order][self._spread(d[order], all_[order], most)])
        for _ in range(top, height):
            self.upper.append({node: np.empty(0, dtype=np.int32)})
            self.entry = node

    def _set(self, node: int, layer: int, ids: np.ndarray) -> None:
        if layer == 0:
            self.ground[node, : len(ids)] = ids
            self.degree[node] = len(ids)
        else:
            self.upper[layer - 1][node] = ids.astype(np.int32)

    def _distance(self, q, qq, ids):
        return np.maximum(self.square[ids] - 2 * (self.x[ids] @ q) + qq, 0)

    def _spread(self, d: np.ndarray, ids: np.ndarray, most: int) -> list[int]:
        """Places of the neighbours to keep: near ones that are no nearer to a kept one than to
        the node, then the nearest of the rest."""
        x = self.x[ids]
        between = self.square[ids][:, None] - 2 * (x @ x.T) + self.square[ids]
        good, rest = [], []
        closest = np.full(len(ids), np.inf)
        for i in range(len(ids)):
            if len(good) == most:
                break
            if closest[i] > d[i]:
                good.append(i)
                np.minimum(closest, between[i], out=closest)
            else:
                rest.append(i)
        return (good + rest)[:most]

    def _near(self, q, start, width: int, layer: int) -> list[tuple[float, int]]:
        """The ``width`` nearest found from ``start``, nearest first."""
        self.turn += 1
        stamp, turn = self.stamp, self.turn
        qq = float(q @ q)
        for _, i in start:
            stamp[i] = turn
        todo = list(start)
        heapify(todo)
        best = [(-d, i) for d, i in start]
        heapify(best)
        while todo:
            d, node = heappop(todo)
            if d > -best[0][0] and len(best) >= width:
                break
            ids = self.around(node, layer)
            ids = ids[stamp[ids] != turn]
            if not len(ids):
                continue
            stamp[ids] = turn
            far = -best[0][0]
            for d2, i in zip(self._distance(q, qq, ids).tolist(), ids.tolist(), strict=True):
                if len(best) < width:
                    heappush(best, (-d2, i))
                    heappush(todo, (d2, i))
                    far = -best[0][0]
                elif d2 < far:
                    heappush(todo, (d2, i))
                    heappush(best, (-d2, i))
                    heappop(best)
                    far = -best[0][0]
        return sorted((-d, i) for d, i in best)

    def search(self, q: np.ndarray, k: int, width: int = SEARCH_WIDTH) -> np.ndarray:
        """About the k nearest nodes."""
        if self.entry < 0:
            return np.empty(0, dtype=np.int64)
        q = q.astype(np.float64)
        near = [(self._distance(q, float(q @ q), np.array([self.entry]))[0], self.entry)]
        for layer in range(len(self.upper), 0, -1):
            near = self._near(q, near, 1, layer)
        near = self._near(q, near, max(width, k), 0)
        return np.array([i for _, i in near], dtype=np.int64)

    # The flat form: for each upper layer its nodes, the ends of their lists, and the lists.

    def flat(self) -> dict[str, bytes]:
        parts = []
        for layer in self.upper:
            nodes = np.fromiter(layer, dtype=np.int32)
            ends = np.cumsum([len(v) for v in layer.values()]).astype(np.int32)
            lists = np.concatenate(list(layer.values())).astype(np.int32)
            parts += [np.array([len(nodes), len(lists)], dtype=np.int32), nodes, ends, lists]
        upper = np.concatenate(parts) if parts else np.empty(0, dtype=np.int32)
        return {
            "vectors": self.x.tobytes(),
            "ground": self.ground.tobytes(),
            "upper": upper.astype(np.int32).tobytes(),
            "entry": int(self.entry),
        }

    @classmethod
    def from_flat(cls, dim: int, vectors: bytes, ground: bytes, upper: bytes, entry: int) -> Graph:
        g = cls(np.frombuffer(vectors, dtype=np.float64).reshape(-1, dim))
        g.ground = np.frombuffer(ground, dtype=np.int32).reshape(len(g.x), -1)
        g.degree = (g.ground >= 0).sum(axis=1)
        g.entry = entry
        a, at = np.frombuffer(upper, dtype=np.int32), 0
        while at < len(a):
            n, m = a[at : at + 2].tolist()
            nodes, ends = a[at + 2 : at + 2 + n], a[at + 2 + n : at + 2 + 2 * n]
            lists = a[at + 2 + 2 * n : at + 2 + 2 * n + m]
            g.upper.append(dict(zip(nodes.tolist(), np.split(lists, ends[:-1]), strict=True)))
            at += 2 + 2 * n + m
        return g


def usable(v: Column) -> Column:
    """Whether a vector takes part: not null, not zero, all components finite."""
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.coalesce(v.isNotNull() & fine & F.exists(v, lambda c: c != 0), F.lit(False))


def valid(vectors: DataFrame) -> DataFrame:
    """``vec_id, v`` of the vectors that take part."""
    d = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return d.where(F.col("vec_id").isNotNull() & usable(F.col("v")))


_INDEX = "dim int, shard int, ids binary, ends binary, vectors binary, ground binary, upper binary, entry int"


def build_index(vectors: DataFrame, k: int, shard_size: int = SHARD) -> DataFrame:
    """One row per shard.  A node keeps its k + 1 smallest ids: with ties going to small ids, no
    others can be among the k nearest of a query, its own id left out."""
    ranked = valid(vectors).distinct().withColumn(
        "r", F.row_number().over(W.Window.partitionBy("v").orderBy("vec_id"))
    )
    nodes = ranked.where(F.col("r") <= k + 1).groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    nodes = stored(nodes, "vectors")
    shards = max(1, math.ceil(nodes.count() / shard_size))
    dealt = nodes.select(
        F.size("v").alias("dim"), F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int").alias("shard"), "v", "ids"
    )

    def build(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.iloc[np.argsort([i[0] for i in frame["ids"]], kind="stable")]
        graph = Graph(np.vstack(frame["v"].to_list())).build(seed=int(key[1]))
        ids = np.concatenate(frame["ids"].to_list()).astype(np.int64)
        ends = np.cumsum([len(i) for i in frame["ids"]]).astype(np.int64)
        row = {"dim": key[0], "shard": key[1], "ids": ids.tobytes(), "ends": ends.tobytes(), **graph.flat()}
        return pd.DataFrame([row])

    return dealt.groupBy("dim", "shard").applyInPandas(build, _INDEX)


def search(index: DataFrame, queries: DataFrame, k: int, width: int = SEARCH_WIDTH) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest found of each query (``vec_id, v``)."""
    shards = index.select("dim", "shard")
    blocks = max(1, math.ceil(queries.count() / BLOCK))
    asked = (
        queries.groupBy(F.size("v").alias("dim"), F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("block"))
        .agg(F.collect_list(F.struct("vec_id", "v")).alias("q"))
        .join(shards, "dim")  # the stated queries, in blocks, against every shard
    )
    none = lambda *names: [F.lit(None).cast("binary").alias(n) for n in names]
    kind = asked.schema["q"].dataType
    rows = index.select("dim", "shard", F.lit(0).alias("step"), "ids", "ends", "vectors", "ground", "upper", "entry", F.lit(None).cast(kind).alias("q"))
    asked = asked.select("dim", "shard", F.lit(1).alias("step"), *none("ids", "ends", "vectors", "ground", "upper"), F.lit(None).cast("int").alias("entry"), "q")
    both = rows.unionByName(asked).repartition("dim", "shard").sortWithinPartitions("dim", "shard", "step")

    def run(batches):
        graph = None
        for batch in batches:
            for row in range(len(batch)):
                r = {n: batch.column(n)[row] for n in batch.schema.names}
                if r["step"].as_py() == 0:
                    parts = [r[n].as_py() for n in ("vectors", "ground", "upper", "entry")]
                    graph = Graph.from_flat(r["dim"].as_py(), *parts)
                    ids = np.frombuffer(r["ids"].as_py(), dtype=np.int64)
                    ends = np.frombuffer(r["ends"].as_py(), dtype=np.int64)
                    continue
                yield _answers(graph, ids, ends, r["q"].as_py())

    def _answers(graph, ids, ends, queries):
        out = []
        for q in queries:
            v = np.array(q["v"], dtype=np.float64)
            nodes = graph.search(v, k + 1, width)
            score = np.sqrt(((graph.x[nodes] - v) ** 2).sum(axis=1))
            found = [
                (s, i)
                for s, n in zip(score.tolist(), nodes.tolist(), strict=True)
                for i in ids[ends[n - 1] if n else 0 : ends[n]].tolist()
                if i != q["vec_id"]
            ]
            out += [(q["vec_id"], i, s) for s, i in sorted(found)[:k]]
        cols = list(zip(*out, strict=True)) or [[]] * 3
        kinds = [pa.int64(), pa.int64(), pa.float64()]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, type=t) for c, t in zip(cols, kinds, strict=True)], names=["query_id", "vec_id", "score"]
        )

    near = both.mapInArrow(run, "query_id long, vec_id long, score double")
    order = W.Window.partitionBy("query_id").orderBy("score", "vec_id")
    near = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return near.select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, k: int = 10, every: int = 100, shard_size: int = SHARD) -> DataFrame:
    """The k nearest of every row whose id is divisible by ``every``, among all other rows.

    Vectors that are null, zero, or hold null or non-finite components take no part, and neither do
    rows without an id; vectors only meet those of their own length.  Equal vectors are at distance
    0 of each other; repeated rows are one.  An empty table gives no rows.  Only ``vec_id`` and
    ``embedding`` are looked at.
    """
    index = stored(build_index(vectors, k, shard_size), "hnsw")
    queries = stored(valid(vectors).where(F.col("vec_id") % every == 0).distinct(), "queries")
    return search(index, queries, k)
