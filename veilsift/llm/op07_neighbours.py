"""Approximate nearest neighbours (7): a navigable small-world graph for each shard.

Equal vectors are one *point* that keeps its ``k + 1`` least ids: no other id of it can be
among the k nearest of any query (ties go to the smaller id).  Points are dealt by hash to
shards of bounded size; each shard's graph is built by insertion with beams, layer by
layer, and stored as flat arrays of neighbours.  Queries are cut into blocks; each block
meets each shard in one task, which walks down the layers and returns the shard's best
points by exact distance.  Merging keeps the k best ids of all shards.

Vectors that are null, empty, zero or hold null or non-finite components take no part;
vectors are compared with those of the same length only.  Rows that share an id but not a
vector are separate candidates and queries; equal rows are one.  Null ids take no part, extra columns are
ignored, an empty table gives no rows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import written

GRAPH = "shard long, dims int, vectors binary, neighbours binary, tops binary, points array<long>"


class Graph:
    """A hierarchical small-world graph over float64 rows.

    ``links[layer]`` is an array of neighbours, -1 where there is none; ``tops`` has the
    highest layer of each point.  Layers follow from a fixed seed, so a retried task builds
    the same graph.
    """

    def __init__(self, vectors: np.ndarray, degree: int = 16, beam: int = 96):
        self.vectors, self.degree, self.beam = vectors, degree, beam
        draws = np.random.default_rng(7).random(max(len(vectors), 1))[: len(vectors)]
        self.tops = np.minimum((-np.log(np.maximum(draws, 1e-12)) / np.log(degree)).astype(np.int32), 5)
        self.norms = (vectors * vectors).sum(axis=1)
        layers = int(self.tops.max()) + 1 if len(vectors) else 0
        self.links = [np.full((len(vectors), degree * (2 if not layer else 1)), -1, np.int32) for layer in range(layers)]
        self.entry = -1

    def build(self) -> Graph:
        for point in range(len(self.vectors)):
            self._insert(point)
        return self

    def _far(self, query: np.ndarray, own: float, points) -> np.ndarray:
        return self.norms[points] - 2.0 * (self.vectors[points] @ query) + own

    def _beam(self, query, own, starts: list[tuple[float, int]], layer: int, beam: int) -> list[tuple[float, int]]:
        """The best ``beam`` points reached from ``starts`` in one layer, nearest first."""
        links, seen = self.links[layer], np.zeros(len(self.vectors), bool)
        waiting, best = list(starts), [(-d, p) for d, p in starts]
        heapq.heapify(waiting)
        heapq.heapify(best)
        seen[[p for _, p in starts]] = True
        while waiting:
            d, point = heapq.heappop(waiting)
            if len(best) >= beam and d > -best[0][0]:
                break
            around = links[point]
            around = around[around >= 0]
            around = around[~seen[around]]
            if not len(around):
                continue
            seen[around] = True
            far = self._far(query, own, around)
            if len(best) >= beam:
                near = far < -best[0][0]
                around, far = around[near], far[near]
            for f, p in zip(far.tolist(), around.tolist()):
                if len(best) < beam:
                    heapq.heappush(best, (-f, p))
                elif f < -best[0][0]:
                    heapq.heapreplace(best, (-f, p))
                else:
                    continue
                heapq.heappush(waiting, (f, p))
        return sorted((-d, p) for d, p in best)

    def _spread(self, found: list[tuple[float, int]], most: int) -> list[int]:
        """Neighbours that are nearer to the point than to one another, then the nearest others."""
        points = np.array([p for _, p in found])
        rows = self.vectors[points]
        between = self.norms[points][:, None] + self.norms[points][None, :] - 2.0 * (rows @ rows.T)
        kept, rest = [], []
        for i, (d, _) in enumerate(found):
            if len(kept) < most and (not kept or between[i, kept].min() > d):
                kept.append(i)
            else:
                rest.append(i)
        return points[kept + rest[: most - len(kept)]].tolist()

    def _link(self, layer: int, a: int, b: int) -> None:
        row = self.links[layer][a]
        free = np.flatnonzero(row < 0)
        if len(free):
            row[free[0]] = b
            return
        around = np.append(row, b)
        far = self._far(self.vectors[a], self.norms[a], around)
        order = np.argsort(far, kind="stable")
        chosen = self._spread([(float(far[i]), int(around[i])) for i in order], len(row))
        row[:] = -1
        row[: len(chosen)] = chosen

    def _insert(self, point: int) -> None:
        if self.entry < 0:
            self.entry = point
            return
        query, own, top = self.vectors[point], self.norms[point], int(self.tops[point])
        found = [(float(self._far(query, own, np.array([self.entry]))[0]), self.entry)]
        for layer in range(int(self.tops[self.entry]), -1, -1):
            found = self._beam(query, own, found[:1] if layer > top else found, layer, 1 if layer > top else self.beam)
            if layer <= top:
                for other in self._spread(found, self.degree):
                    self._link(layer, point, other)
                    self._link(layer, other, point)
        if top > self.tops[self.entry]:
            self.entry = point

    def search(self, query: np.ndarray, most: int, beam: int) -> list[int]:
        if self.entry < 0:
            return []
        own = float(query @ query)
        found = [(float(self._far(query, own, np.array([self.entry]))[0]), self.entry)]
        for layer in range(int(self.tops[self.entry]), -1, -1):
            found = self._beam(query, own, found[:1], layer, max(beam, most) if layer == 0 else 1)
        return [p for _, p in found[:most]]

    def flat(self) -> tuple[bytes, bytes]:
        return np.concatenate([x.ravel() for x in self.links]).astype("<i4").tobytes(), self.tops.astype("<i4").tobytes()

    @staticmethod
    def of(vectors: np.ndarray, neighbours: bytes, tops: bytes, degree: int) -> Graph:
        graph = Graph(vectors, degree)
        graph.tops, flat, at = np.frombuffer(tops, "<i4"), np.frombuffer(neighbours, "<i4"), 0
        for layer, links in enumerate(graph.links):
            graph.links[layer] = flat[at : at + links.size].reshape(links.shape)
            at += links.size
        graph.entry = int(np.argmax(graph.tops)) if len(vectors) else -1
        return graph


def usable(vectors: DataFrame, column: str) -> DataFrame:
    """``vec_id, v`` (doubles) of the rows that take part."""
    v = F.col(column).cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & (F.size("v") > 0) & finite & F.exists("v", lambda x: x != 0))


def points_of(rows: DataFrame, k: int) -> DataFrame:
    """``point, dims, v, ids``: distinct vectors with their k + 1 least ids.

    Rows of one vector and id are one; of the ids of a vector every task passes on no more than
    k + 1, so a hot vector shrinks before it meets.
    """
    least = Window.partitionBy("v").orderBy("vec_id")
    few = rows.select("v", "vec_id").distinct().withColumn("at", F.row_number().over(least)).where(F.col("at") <= k + 1)
    whole = few.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    return whole.select(F.xxhash64("v").alias("point"), F.size("v").alias("dims"), "v", "ids")


def build_graphs(points: DataFrame, shard_size: int = 4096, degree: int = 16, beam: int = 96) -> DataFrame:
    """``GRAPH``: one row per shard with its vectors and flat neighbour arrays."""
    sizes = {r["dims"]: r["n"] for r in points.groupBy("dims").agg(F.count("*").alias("n")).collect()}
    shards = F.lit(1)
    for dims, n in sizes.items():
        shards = F.when(F.col("dims") == dims, F.lit(max(1, -(-n // shard_size)))).otherwise(shards)
    dealt = points.withColumn("shard", F.pmod(F.xxhash64(F.col("point"), F.lit("shard")), shards))

    def build(key, table):
        ids = table.column("point").to_numpy()
        order = np.argsort(ids, kind="stable")
        dims = table.column("dims")[0].as_py()
        values = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)[order]
        neighbours, tops = Graph(values, degree, beam).build().flat()
        return pa.table(
            {
                "shard": pa.array([key[0].as_py()], pa.int64()),
                "dims": pa.array([dims], pa.int32()),
                "vectors": pa.array([values.tobytes()], pa.binary()),
                "neighbours": pa.array([neighbours], pa.binary()),
                "tops": pa.array([tops], pa.binary()),
                "points": pa.array([ids[order].tolist()], pa.list_(pa.int64())),
            }
        )

    return dealt.select("shard", "dims", "point", "v").groupBy("shard", "dims").applyInArrow(build, GRAPH)


def nearest(
    vectors: DataFrame,
    query: F.Column,
    k: int = 10,
    column: str = "embedding",
    shard_size: int = 4096,
    degree: int = 16,
    beam: int = 96,
    search_beam: int = 128,
    block: int = 512,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest other rows of every row where ``query`` holds."""
    rows = usable(vectors, column)
    points = written(points_of(rows, k), "ann-points")
    graphs = written(build_graphs(points, shard_size, degree, beam), "ann-graphs")
    asked = rows.where(query).select("vec_id", F.xxhash64("v").alias("point"), F.size("v").alias("dims"), "v")
    asked = written(asked.dropDuplicates(["vec_id", "point"]), "ann-queries")
    # equal query vectors are searched once
    distinct = asked.select("point", "dims", "v").dropDuplicates(["point", "dims"])
    blocks = max(1, -(-distinct.count() // block))
    distinct = distinct.withColumn("block", F.pmod(F.col("point"), F.lit(blocks)))
    blocked = distinct.groupBy("dims", "block").agg(F.collect_list(F.struct("point", "v")).alias("q"))
    tasks = graphs.join(blocked, "dims").repartition(F.col("shard"), F.col("dims"), F.col("block"))

    def search(frames):
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                vectors = np.frombuffer(r.vectors, np.float64).reshape(-1, r.dims)
                graph = Graph.of(vectors, r.neighbours, r.tops, degree)
                for asked in r.q:
                    wanted = np.array(asked["v"], np.float64)
                    found = graph.search(wanted, k + 1, search_beam)
                    exact = np.sqrt(((vectors[found] - wanted) ** 2).sum(axis=1))
                    out += [(asked["point"], r.points[p], d) for p, d in zip(found, exact.tolist())]
            yield pd.DataFrame(out, columns=["of", "point", "score"])

    found = tasks.mapInPandas(search, "of long, point long, score double")
    # k + 1 points hold at least k other ids; points at the same distance all count
    near = F.rank().over(Window.partitionBy("of").orderBy("score"))
    found = found.withColumn("at", near).where(F.col("at") <= k + 1).drop("at")
    ids = found.join(points.select("point", F.explode("ids").alias("vec_id")), "point").select("of", "vec_id", "score")
    pairs = asked.select(F.col("vec_id").alias("query_id"), F.col("point").alias("of")).join(ids, "of")
    order = Window.partitionBy("query_id", "of").orderBy("score", "vec_id")
    ranked = pairs.where("vec_id <> query_id").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest embeddings of every hundredth one."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, F.col("vec_id") % 100 == 0)
