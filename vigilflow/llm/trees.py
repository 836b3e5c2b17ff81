"""Nearest neighbours by a forest of random-projection trees.

The trees are fitted on the driver on at most `sample` vectors, which fixes a few hundred leaves per
tree whatever the table's size. Every vector is listed in its leaf of every tree. A query walks all
trees through one priority queue: the branch with the smallest margin against it, over all trees, is
entered next, until its leaves hold `inspect` of the fitted vectors (counted per tree). Candidates
of these leaves are ranked exactly, by cosine in double precision.

Leaves are dealt in a grid of bounded parts of candidates and of queries, by counts taken first. A
part returns its best `k` distinct ids per query; bests are merged by query. Nothing is cut before
that but candidates below the k-th best score and, of equal vectors, those after the k + 1 smallest ids.

Defined cases: null or empty vectors, vectors with null or non-finite components and zero vectors
take no part; so do vectors of another length than most of the sample's; equal vectors are
neighbours of each other and ties go to the smaller id; rows without id are left out; an id's
repeated rows are one candidate, the nearest; fewer than `k` candidates are all returned.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .common import BROADCAST_ROWS, hash_sample, key_chunks
from .lattice import unit_rows, usable

#: Products of unit vectors differ by less than this from their exact scores.
ROUNDING = 1e-9


@dataclass(frozen=True)
class ForestParams:
    trees: int = 4
    sample: int = 8192  # vectors the trees are fitted on
    leaf: int = 64  # fitted vectors in a leaf, at most
    inspect: float = 0.35  # share of the fitted vectors whose leaves a query visits
    part: int = 4096  # rows of a leaf compared in one step
    seed: int = 11


class Forest:
    """Trees as arrays: node -> direction, cut, children; leaves are negative."""

    def __init__(self, unit: np.ndarray, p: ForestParams) -> None:
        rng = np.random.default_rng(p.seed)
        self.dim = unit.shape[1]
        self.directions: list[np.ndarray] = []
        self.cuts: list[float] = []
        self.children: list[tuple[int, int]] = []
        self.sizes: list[int] = []
        self.roots = [self.grow(unit, np.arange(len(unit)), rng, p.leaf) for _ in range(p.trees)]
        self.normals = np.array(self.directions).reshape(-1, self.dim)
        self.budget = p.inspect * len(unit) * p.trees

    def grow(self, unit: np.ndarray, rows: np.ndarray, rng: np.random.Generator, leaf: int) -> int:
        """Split by a random direction at the median of the projections; equal vectors stay together."""
        if len(rows) > leaf:
            for _ in range(4):
                direction = rng.standard_normal(self.dim)
                direction /= np.linalg.norm(direction)
                at = unit[rows] @ direction
                cut = float(np.median(at))
                right = at > cut
                if right.any() and not right.all():
                    node = len(self.cuts)
                    self.directions.append(direction)
                    self.cuts.append(cut)
                    self.children.append((0, 0))
                    self.children[node] = (self.grow(unit, rows[~right], rng, leaf), self.grow(unit, rows[right], rng, leaf))
                    return node
        self.sizes.append(len(rows))
        return -len(self.sizes)

    def leaves(self, unit: np.ndarray) -> np.ndarray:
        """The leaf of each vector in each tree."""
        out = np.empty((len(unit), len(self.roots)), dtype=np.int32)
        for t, root in enumerate(self.roots):
            todo = [(root, np.arange(len(unit)))]
            while todo:
                node, rows = todo.pop()
                if node < 0:
                    out[rows, t] = -node - 1
                elif len(rows):
                    right = unit[rows] @ self.normals[node] > self.cuts[node]
                    todo += [(self.children[node][0], rows[~right]), (self.children[node][1], rows[right])]
        return out

    def search(self, unit: np.ndarray) -> list[list[int]]:
        """The leaves that each query visits, by one queue over all trees."""
        out = []
        for margins in unit @ self.normals.T - np.array(self.cuts) if len(self.cuts) else np.zeros((len(unit), 0)):
            queue = [(0.0, root) for root in self.roots]
            heapq.heapify(queue)
            visited: list[int] = []
            seen = 0
            while queue and seen < self.budget:
                far, node = heapq.heappop(queue)
                while node >= 0:
                    margin = margins[node]
                    left, right = self.children[node]
                    near, other = (right, left) if margin > 0 else (left, right)
                    heapq.heappush(queue, (max(far, abs(margin)), other))
                    node = near
                visited.append(-node - 1)
                seen += self.sizes[-node - 1]
            out.append(visited)
        return out


def fit(vectors: DataFrame, p: ForestParams) -> Forest | None:
    """Trees over a bounded sample of vectors (id, v): those with the smallest hashes of their ids."""
    sample = hash_sample(vectors, [F.col("id")], p.sample).select("v").collect()
    if not sample:
        return None
    lengths = [len(r.v) for r in sample]
    dim = max(set(lengths), key=lambda n: (lengths.count(n), -n))
    return Forest(unit_rows(np.array([r.v for r in sample if len(r.v) == dim])), p)


def distinct(ids: np.ndarray, raw: np.ndarray, k: int) -> np.ndarray:
    """Places, by id, of the rows that can be among the k nearest: of equal vectors the k + 1 smallest ids, once each."""
    rows = np.ascontiguousarray(raw)
    same = np.unique(rows.view(np.dtype((np.void, rows.itemsize * rows.shape[1])))[:, 0], return_inverse=True)[1]
    order = np.lexsort((ids, same))
    fresh = np.append(True, same[order][1:] != same[order][:-1])
    new = fresh | np.append(True, ids[order][1:] != ids[order][:-1])
    order, fresh = order[new], fresh[new]
    nth = np.arange(len(order)) - np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))
    order = order[nth <= k]  # one more than k, as a query is no neighbour of itself
    return order[np.argsort(ids[order], kind="stable")]


def leading(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best distinct ids of each query, each with its best score; ties go to the smaller id."""
    order = np.lexsort((-score, ids, query))
    query, ids, score = query[order], ids[order], score[order]
    new = np.ones(len(query), dtype=bool)
    new[1:] = (query[1:] != query[:-1]) | (ids[1:] != ids[:-1])
    query, ids, score = query[new], ids[new], score[new]
    order = np.lexsort((ids, -score, query))
    query, ids, score = query[order], ids[order], score[order]
    fresh = np.ones(len(query), dtype=bool)
    fresh[1:] = query[1:] != query[:-1]
    first = np.arange(len(query)) - np.maximum.accumulate(np.where(fresh, np.arange(len(query)), 0)) < k
    return query[first], ids[first], score[first]


def best_of(asked: np.ndarray, asked_ids: np.ndarray, there: np.ndarray, there_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, id, exact score) of the k nearest distinct ids of each query row; candidates come in the order of ids."""
    score = asked @ there.T
    score[asked_ids[:, None] == there_ids[None, :]] = -2.0
    starts = np.flatnonzero(np.append(True, there_ids[1:] != there_ids[:-1]))
    best = np.maximum.reduceat(score, starts, axis=1) if len(starts) < len(there_ids) else score
    floor = np.partition(best, -k, axis=1)[:, -k] if best.shape[1] > k else np.full(len(asked), -2.0)
    one, two = np.nonzero(score >= np.maximum(floor - ROUNDING, -1.5)[:, None])
    step = max(1, (1 << 21) // there.shape[1])
    exact = [np.einsum("ij,ij->i", asked[one[low : low + step]], there[two[low : low + step]]) for low in range(0, len(one), step)]
    row, ids, exact = leading(one, there_ids[two], np.concatenate(exact) if exact else np.zeros(0), k)
    return asked_ids[row], ids, exact


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, id_column: str = "vec_id", vector: str = "embedding",
            p: ForestParams = ForestParams()) -> DataFrame:
    """(query_id, rank, id, score): the k nearest found of each row with `is_query`, among all other rows."""
    spark = vectors.sparkSession
    single = vectors.schema[vector].dataType.simpleString() == "array<float>"
    kind, sql_type = (np.float32, "array<float>") if single else (np.float64, "array<double>")
    rows = vectors.select(F.col(id_column).cast("bigint").alias("id"), F.col(vector).cast(sql_type).alias("v"), F.coalesce(is_query, F.lit(False)).alias("query"))
    rows = rows.filter(F.col("id").isNotNull() & usable(F.col("v")))
    fitted = fit(rows, p)
    schema = "query_id bigint, id bigint, score double"
    if fitted is None:
        return spark.createDataFrame([], f"query_id bigint, rank int, {id_column} bigint, score double")
    forest = spark.sparkContext.broadcast(fitted)  # a few hundred nodes per tree

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each row in its leaves, each query in the leaves it visits."""
        trees = forest.value
        for batch in batches:
            for begin in range(0, batch.num_rows, 512):
                piece = batch.slice(begin, 512)
                piece = piece.filter(pa.compute.equal(pa.compute.list_value_length(piece.column(1)), trees.dim))
                if not piece.num_rows:
                    continue
                ids, query = piece.column(0).to_numpy(), piece.column(2).to_numpy(zero_copy_only=False)
                raw = piece.column(1).flatten().to_numpy().astype(kind).reshape(-1, trees.dim)
                unit = unit_rows(raw)
                leaves = trees.leaves(unit)
                asked = np.flatnonzero(query)
                visits = trees.search(unit[asked])
                counts = [len(v) for v in visits]
                at = np.concatenate((np.repeat(np.arange(len(ids)), leaves.shape[1]), np.repeat(asked, counts)))
                leaf = np.concatenate((leaves.reshape(-1), np.array([x for v in visits for x in v], dtype=np.int32)))
                flags = np.arange(len(at)) >= leaves.size
                blobs = pa.array([x.tobytes() for x in raw], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(leaf), pa.array(flags), pa.array(ids[at]), blobs.take(pa.array(at))],
                                                 names=["leaf", "query", "id", "blob"])

    placed = rows.mapInArrow(place, "leaf int, query boolean, id bigint, blob binary")
    sizes = cut(placed.groupBy("leaf").agg(
        F.ceil(F.count_if(~F.col("query")) / p.part).cast("int").alias("parts"),
        F.ceil(F.count_if("query") / p.part).cast("int").alias("asks")))  # one row per leaf
    sizes = F.broadcast(sizes) if sizes.count() <= BROADCAST_ROWS else sizes
    dealt = placed.join(sizes, "leaf").filter("parts > 0 and asks > 0")
    mine = F.pmod(F.xxhash64("id"), F.when(F.col("query"), F.col("asks")).otherwise(F.col("parts"))).cast("int")
    others = F.sequence(F.lit(0), F.when(F.col("query"), F.col("parts")).otherwise(F.col("asks")) - 1)
    dealt = dealt.withColumn("own", mine).withColumn("other", F.explode(others)).withColumns({
        "part": F.when(F.col("query"), F.col("other")).otherwise(F.col("own")),
        "ask": F.when(F.col("query"), F.col("own")).otherwise(F.col("other"))})

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in key_chunks(batches, ("leaf", "part", "ask"), p.part):
            leaf, part, ask = (chunk.column(c).to_numpy() for c in ("leaf", "part", "ask"))
            query, ids = chunk.column("query").to_numpy(), chunk.column("id").to_numpy()
            raw = np.frombuffer(b"".join(chunk.column("blob").to_pylist()), dtype=kind).reshape(len(ids), -1)
            unit = unit_rows(raw)
            new = (leaf[1:] != leaf[:-1]) | (part[1:] != part[:-1]) | (ask[1:] != ask[:-1])
            cuts = [0, *(np.flatnonzero(new) + 1), len(ids)]
            for begin, end in zip(cuts, cuts[1:], strict=False):
                asked = begin + np.flatnonzero(query[begin:end])
                there = begin + np.flatnonzero(~query[begin:end])
                if not len(asked) or not len(there):
                    continue
                there = there[distinct(ids[there], raw[there], k)]
                out = [best_of(unit[some], ids[some], unit[there], ids[there], k) for some in np.split(asked, range(256, len(asked), 256))]
                q, i, s = leading(*(np.concatenate(x) for x in zip(*out, strict=True)), k)
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(i), pa.array(s)], names=["query_id", "id", "score"])

    keys = ["leaf", "part", "ask"]
    found = dealt.select(*keys, "query", "id", "blob").repartition(*keys).sortWithinPartitions(*keys).mapInArrow(rank, schema)
    once = found.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", F.col("id").alias(id_column), "score")
