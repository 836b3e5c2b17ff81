"""Near copies of vectors by lattice hashing.

Each table projects unit vectors to a few blocks of eight random directions and decodes every block
to the nearest point of the E8 lattice; the points of the blocks are the vector's cell. A vector is
listed in its own cell and probes the neighbouring cells nearest to its projection. Vectors that
meet in a cell are compared by cosine in double precision.

Vectors with equal components are one class, compared once through their smallest id. The rows of a
cell are dealt in a grid of bounded parts. A pair that meets in several tables or cells counts in
the first only, which each task can tell by placing the pair's vectors again. No pairs leave a task: it returns how many vectors each one is linked with and one link towards the smallest
it is connected with.

Defined cases: null or empty vectors, vectors with null or non-finite components and zero vectors
link with nothing and are their own component; vectors of another length than the first valid one's
are compared with vectors of their own length only; rows without id are left out; repeated rows are
copies of each other.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .common import block_pairs, classes, forest, key_chunks, mix


@dataclass(frozen=True)
class LatticeParams:
    """Defaults: a pair at cosine 0.95 is missed with probability 2e-5, random vectors meet with 1e-3 per table."""

    tables: int = 10
    blocks: int = 2
    scale: float = 2.3  # edge of the lattice against projections of unit variance
    probes: int = 4
    seed: int = 20


def decode(x: np.ndarray) -> np.ndarray:
    """The nearest E8 lattice point of each row of eight, in doubled coordinates (integers)."""

    def even(y: np.ndarray) -> np.ndarray:  # nearest point with integer coordinates of even sum
        point = np.rint(y)
        off = y - point
        worst = np.abs(off).argmax(axis=1)
        odd = np.flatnonzero(point.sum(axis=1) % 2)
        point[odd, worst[odd]] += np.where(off[odd, worst[odd]] >= 0, 1, -1)
        return point

    whole, half = even(x), even(x - 0.5) + 0.5
    nearer = ((x - whole) ** 2).sum(axis=1) <= ((x - half) ** 2).sum(axis=1)
    return np.where(nearer[:, None], 2 * whole, 2 * half).astype(np.int64)


def neighbours() -> np.ndarray:
    """The 240 shortest lattice vectors, in doubled coordinates."""
    out = []
    for i in range(8):
        for j in range(i):
            for a in (-2, 2):
                for b in (-2, 2):
                    v = [0] * 8
                    v[i], v[j] = a, b
                    out.append(v)
    for bits in range(256):
        v = [1 if bits >> i & 1 else -1 for i in range(8)]
        if sum(x < 0 for x in v) % 2 == 0:
            out.append(v)
    return np.array(out, dtype=np.int64)


def cells(unit: np.ndarray, p: LatticeParams) -> tuple[np.ndarray, np.ndarray]:
    """(own cell by table, probed cells by table and probe) of unit vectors, as 64-bit names."""
    n, dim = unit.shape
    rng = np.random.default_rng([p.seed, dim])
    near = neighbours()
    own, probed = np.empty((n, p.tables), dtype=np.uint64), np.empty((n, p.tables, p.probes), dtype=np.uint64)
    weights = mix(np.arange(1, 8 * p.blocks + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(p.blocks, 8)
    for t in range(p.tables):
        directions = np.linalg.qr(rng.standard_normal((dim, max(dim, 8 * p.blocks))))[0] if dim >= 8 * p.blocks else rng.standard_normal((dim, 8 * p.blocks)) / np.sqrt(dim)
        y = (unit @ directions[:, : 8 * p.blocks]).reshape(n, p.blocks, 8) * (np.sqrt(dim) / p.scale)
        sums, shifts, gains = np.zeros(n, dtype=np.uint64), [], []
        for b in range(p.blocks):
            point = decode(y[:, b])
            sums += (point.view(np.uint64) * weights[b]).sum(axis=1, dtype=np.uint64)
            gains.append((y[:, b] - point / 2) @ near.T)  # larger: nearer to that neighbour
            shifts.append((near.view(np.uint64) * weights[b]).sum(axis=1, dtype=np.uint64))
        gain, shift = np.concatenate(gains, axis=1), np.concatenate(shifts)
        best = np.argpartition(-gain, p.probes, axis=1)[:, : p.probes]
        salt = np.uint64((t + 1) * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF)
        own[:, t] = mix(sums + salt)
        probed[:, t] = mix(sums[:, None] + shift[best] + salt)
    return own, probed


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null, all components finite, not all zero."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.coalesce(F.forall(vector, finite) & F.exists(vector, lambda x: x != 0), F.lit(False))


def unit_rows(raw: np.ndarray) -> np.ndarray:
    """Vectors of length one, in double precision."""
    unit = raw.astype(np.float64)
    unit /= np.abs(unit).max(axis=1, keepdims=True)
    return unit / np.sqrt((unit * unit).sum(axis=1, keepdims=True))


def links(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding", least: float = 0.95,
          p: LatticeParams = LatticeParams(), part: int = 1024) -> DataFrame:
    """(id, n_links, component_id) of every row with an id."""
    single = vectors.schema[vector].dataType.simpleString() == "array<float>"
    kind, sql_type = (np.float32, "array<float>") if single else (np.float64, "array<double>")
    rows = vectors.select(F.col(id_column).cast("bigint").alias("id"), F.col(vector).cast(sql_type).alias("v")).filter("id is not null")
    sets = cut(rows.filter(usable(F.col("v"))).groupBy("v").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")))
    listed_at = p.tables * (1 + p.probes)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 1024):
                piece = batch.slice(begin, 1024)
                lengths = pa.compute.list_value_length(piece.column(0)).to_numpy()
                for dim in np.unique(lengths):
                    some = piece.filter(pa.array(lengths == dim))
                    raw = some.column(0).flatten().to_numpy().astype(kind).reshape(-1, dim)
                    names = all_cells(unit_rows(raw), p)
                    rows_at = pa.array(np.repeat(np.arange(len(raw)), listed_at))
                    blobs = pa.array([x.tobytes() for x in raw], pa.binary())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(names.reshape(-1).view(np.int64)), pa.array(np.tile(np.arange(listed_at, dtype=np.int32), len(raw))),
                         some.column(1).take(rows_at), some.column(2).take(rows_at), blobs.take(rows_at)],
                        names=["cell", "place", "rep", "copies", "blob"])

    listed = sets.select("v", "rep", "copies").mapInArrow(place, "cell bigint, place int, rep bigint, copies bigint, blob binary")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in key_chunks(batches, ("cell", "p", "q"), 16_384):
            cell, place_no, reps, copies, part_no, low, high = (
                chunk.column(c).to_numpy() for c in ("cell", "place", "rep", "copies", "part", "p", "q"))
            new = np.ones(len(cell), dtype=bool)
            new[1:] = (cell[1:] != cell[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])
            group = np.cumsum(new) - 1
            crowded = np.bincount(group)[group] > 1
            chosen = np.flatnonzero(crowded)
            if not len(chosen):
                continue
            blobs = chunk.column("blob").combine_chunks().take(pa.array(chosen)).to_pylist()
            lengths = np.array([len(x) for x in blobs])
            dim = int(lengths.max()) // np.dtype(kind).itemsize
            raw = np.zeros((len(chosen), dim), dtype=kind)
            for size in np.unique(lengths):
                at = np.flatnonzero(lengths == size)
                raw[at, : size // np.dtype(kind).itemsize] = np.frombuffer(b"".join(blobs[i] for i in at), dtype=kind).reshape(len(at), -1)
            unit, group = unit_rows(raw), group[chosen]
            place_no, reps, copies, part_no, cell = place_no[chosen], reps[chosen], copies[chosen], part_no[chosen], cell[chosen]
            across = (low != high)[chosen]
            a, b = close_pairs(unit, group, least)
            own = place_no % (1 + p.probes) == 0
            fits = (reps[a] != reps[b]) & (own[a] | own[b]) & (lengths[a] == lengths[b]) & (~across[a] | (part_no[a] != part_no[b]))
            a, b = a[fits], b[fits]
            exact = np.einsum("ij,ij->i", unit[a], unit[b]) >= least
            a, b = a[exact], b[exact]
            if not len(a):
                continue
            swap = reps[a] > reps[b]  # the meeting is named from the smaller id
            a, b = np.where(swap, b, a), np.where(swap, a, b)
            used, at = np.unique(np.concatenate((a, b)), return_inverse=True)
            names = np.empty((len(used), p.tables, 1 + p.probes), dtype=np.uint64)
            for size in np.unique(lengths[used]):
                same = np.flatnonzero(lengths[used] == size)
                names[same] = all_cells(unit[used[same], : size // np.dtype(kind).itemsize], p)
            first = first_meeting(names, at[: len(a)], at[len(a) :])
            table = place_no[a] // (1 + p.probes)
            mine = first == 3 * table + np.where(own[a] & own[b], 0, np.where(own[a], 1, 2))
            a, b = a[mine], b[mine]
            n = np.bincount(a, copies[b], len(reps)) + np.bincount(b, copies[a], len(reps))
            root = forest(len(reps), np.minimum(a, b), np.maximum(a, b))
            smallest = reps.copy()
            np.minimum.at(smallest, root, reps)
            met = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(reps[met]), pa.array(n[met].astype(np.int64)), pa.array(smallest[root[met]])],
                                             names=["rep", "n", "root"])

    keys = ["cell", "p", "q"]
    dealt = block_pairs(listed, ["cell"], "rep", part).repartition(*keys).sortWithinPartitions(*keys)
    found = dealt.mapInArrow(compare, "rep bigint, n bigint, root bigint")
    members = rows.join(sets, rows["v"] == sets["v"], "left").select(
        "id", F.coalesce("rep", "id").alias("rep"), F.coalesce("copies", F.lit(1)).alias("copies"))
    return classes(members, found, "id").withColumnRenamed("id", id_column)


def all_cells(unit: np.ndarray, p: LatticeParams) -> np.ndarray:
    """Names by row, table and listing: the own cell first, then the probed ones; other dimensions, other names."""
    own, probed = cells(unit, p)
    return np.concatenate((own[:, :, None], probed), axis=2) ^ mix(np.array([unit.shape[1]], dtype=np.uint64))[0]


def close_pairs(unit: np.ndarray, group: np.ndarray, least: float, small: int = 48) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one group (rows of a group stand together) that are near `least` or above."""
    sizes = np.bincount(group)
    begins = np.cumsum(sizes) - sizes
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for g in np.flatnonzero(sizes > small):
        rows = unit[begins[g] : begins[g] + sizes[g]]
        a, b = np.nonzero(np.triu(rows @ rows.T >= least - 1e-9, 1))
        out.append((a + begins[g], b + begins[g]))
    few = np.flatnonzero(sizes[group] <= small)
    for step in range(1, small):
        few = few[few + step < len(group)]
        few = few[group[few] == group[few + step]]
        if not len(few):
            break
        near = np.einsum("ij,ij->i", unit[few], unit[few + step]) >= least - 1e-9
        out.append((few[near], few[near] + step))
    return np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])


def first_meeting(names: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """3 * table + kind of the first meeting of rows a and b; kind 0: one own cell, 1: a's own cell, 2: b's."""
    tables = names.shape[1]
    met = np.empty((len(a), tables, 3), dtype=bool)
    for t in range(tables):
        own_a, own_b = names[a, t, 0], names[b, t, 0]
        met[:, t, 0] = own_a == own_b
        met[:, t, 1] = (names[b, t, 1:] == own_a[:, None]).any(axis=1)
        met[:, t, 2] = (names[a, t, 1:] == own_b[:, None]).any(axis=1)
    return met.reshape(len(a), -1).argmax(axis=1)
