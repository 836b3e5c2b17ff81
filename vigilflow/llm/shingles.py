"""Jaccard join of word shingles with Bayesian pruning of candidates.

Documents are sets of `k`-word shingles. Documents with the same set are one class and are compared
once, through a representative (their smallest id).

1. Representatives get MinHash values; groups of `rows` of them (bands) are looked up. The ones that
   share a band value are connected, star-wise, with the smallest id of it.
2. Connected representatives form neighbourhoods. Each is dealt in a grid of bounded parts; a cell of
   the grid compares its pairs. MinHash values are compared a few at a time, and a pair is dropped
   once the posterior probability that its Jaccard similarity reaches the threshold falls below
   `tolerance` (uniform prior). Survivors are verified exactly on their shingles.
3. A cell returns, for each representative, how many documents it is linked with there and one link
   towards the smallest one it is connected with; no pairs leave a cell.

Pairs at the threshold meet in some band with probability 1 - (1 - 0.8**5)**30, which is above
0.99999, and connection through third documents finds more.

Defined cases: texts with fewer than `k` words have one shingle, all their words; null texts and
texts without words link with nothing; rows without id are left out; repeated rows are copies of
each other; an id with several texts is linked wherever one of them is; long texts are read whole;
other columns are kept by `deduplicate`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.campaigns import component_labels
from ..session import cut
from .common import WordHasher, block_pairs, bloom, by_key, classes, forest, in_bloom, mix, packed, runs_of, small_batches, text_slices, unpacked

BANDS, ROWS = 30, 5


def shingle_sets(words: np.ndarray, owner: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of the distinct shingles of n texts, sorted by text and hash."""
    hashes, whole = runs_of(words, owner, k)
    texts = owner[: len(hashes)][whole]
    hashes = hashes[whole]
    sizes = np.bincount(owner, minlength=n)
    short = np.flatnonzero((sizes > 0) & (sizes < k))
    if len(short):
        begins = np.searchsorted(owner, short)
        extra = [mix(np.array([np.bitwise_xor.reduce(mix(words[b : b + sizes[t]] + np.arange(1, sizes[t] + 1, dtype=np.uint64)))], dtype=np.uint64))[0]
                 for b, t in zip(begins, short, strict=True)]
        hashes, texts = np.concatenate((hashes, np.array(extra, dtype=np.uint64))), np.concatenate((texts, short))
    order = np.lexsort((hashes, texts))
    hashes, texts = hashes[order], texts[order]
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (texts[1:] != texts[:-1])
    return hashes[new], texts[new]


def minhashes(hashes: np.ndarray, starts: np.ndarray, count: int = BANDS * ROWS) -> np.ndarray:
    """`count` 32-bit MinHash values of each set hashes[start : next start]."""
    low = hashes.astype(np.uint32)
    high = (hashes >> np.uint64(32)).astype(np.uint32)
    seeds = mix(np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    out = np.empty((len(starts), count), dtype=np.uint32)
    for i, s in enumerate(seeds):
        a, b = np.uint32(int(s) & 0xFFFFFFFF | 1), np.uint32(int(s) >> 32 | 1)
        out[:, i] = np.minimum.reduceat((low * a) ^ (high * b) + np.uint32(i), starts)
    return out


def least_matches(threshold: float, tolerance: float, upto: int) -> np.ndarray:
    """By number n of compared values: the fewest matches m with P(similarity >= threshold | m of n) >= tolerance.

    With a uniform prior the posterior is Beta(m + 1, n - m + 1), whose upper tail is a binomial sum.
    """
    out = np.zeros(upto + 1, dtype=np.int64)
    for n in range(1, upto + 1):
        tail = 0.0
        for m in range(n + 1):  # P(Bin(n + 1, t) <= m)
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= tolerance:
                out[n] = m
                break
    return out


def overlaps(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets a[i] and b[i]."""
    if len(a) < 4 * len(sets):
        return np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(a, b, strict=True)], dtype=np.int64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    common = np.bincount(ids) > 1  # shingles of one set only are in no intersection
    owner, ids = owner[common[ids]], (np.cumsum(common) - 1)[ids[common[ids]]]
    total = np.zeros((len(sets), len(sets)), dtype=np.float32)
    order = np.argsort(ids, kind="stable")
    owner, ids = owner[order], ids[order]
    for begin in range(0, int(common.sum()), 8192):
        lo, hi = np.searchsorted(ids, (begin, begin + 8192))
        block = np.zeros((len(sets), 8192), dtype=np.float32)
        block[owner[lo:hi], ids[lo:hi] - begin] = 1
        total += block @ block.T
    return total[a, b].astype(np.int64)


def surviving(sig: np.ndarray, a: np.ndarray, b: np.ndarray, least: np.ndarray, step: int = 10) -> np.ndarray:
    """Which pairs of rows of `sig` are never improbable while their values are compared step by step."""
    live = np.arange(len(a))
    matches = np.zeros(len(a), dtype=np.int64)
    for begin in range(0, sig.shape[1], step):
        end = begin + step
        matches[live] += (sig[a[live], begin:end] == sig[b[live], begin:end]).sum(axis=1)
        live = live[matches[live] >= least[end]]
    return live


def join(docs: DataFrame, id_column: str = "doc_id", text: str = "text", threshold: float = 0.8, k: int = 5,
         tolerance: float = 1e-6, part: int = 256, named: bool = False) -> DataFrame:
    """(id, n_links, component_id) of every document with an id.

    n_links counts the other documents with a similarity of at least `threshold`; component_id is
    the smallest id reachable by links, the document's own included. With `named`, the columns
    `text_hash` and `set_hash` (the text's, and its set of shingles' or the text's if it has none) come along.
    """
    small_batches(docs.sparkSession)
    base = docs.select(F.col(id_column).cast("bigint").alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("body")).filter("id is not null")
    body_hash = F.xxhash64("body").alias("text_hash")

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            for rows in text_slices(batch, "body"):
                words, owner = hasher(rows.column(1))
                hashes, texts = shingle_sets(words, owner, rows.num_rows, k)
                n = np.bincount(texts, minlength=rows.num_rows)
                some = np.flatnonzero(n)
                starts = np.concatenate(([0], np.cumsum(n[some])[:-1])).astype(np.int64) if len(some) else np.zeros(0, np.int64)
                one, two = np.zeros(rows.num_rows, dtype=np.uint64), np.zeros(rows.num_rows, dtype=np.uint64)
                bands = np.zeros((rows.num_rows, BANDS), dtype=np.int64)
                if len(some):
                    one[some], two[some] = np.add.reduceat(mix(hashes), starts), np.bitwise_xor.reduceat(mix(hashes + np.uint64(7)), starts)
                    sig = minhashes(hashes, starts).astype(np.uint64).reshape(len(some), BANDS, ROWS)
                    value = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(some), BANDS))
                    for r in range(ROWS):
                        value = mix(value * np.uint64(0x9E3779B97F4A7C15) + sig[:, :, r])
                    bands[some] = value.view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), rows.column(2), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(n.astype(np.int64)),
                     pa.FixedSizeListArray.from_arrays(pa.array(bands.reshape(-1)), BANDS).cast(pa.list_(pa.int64()))],
                    names=["id", "text_hash", "one", "two", "n", "bands"])

    sketches = cut(base.select("*", body_hash).mapInArrow(sketch, "id bigint, text_hash bigint, one bigint, two bigint, n bigint, bands array<bigint>"))
    worded = sketches.filter("n > 0")
    # written down: read three times, and joins to it can then be split where one set has very many copies
    reps = cut(worded.groupBy("one", "two").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.any_value("bands").alias("bands")))
    banded = reps.select("rep", F.explode("bands").alias("band"))
    hubs = banded.groupBy("band").agg(F.min("rep").alias("hub"), F.count(F.lit(1)).alias("size")).filter("size > 1").drop("size")
    met = banded.join(hubs, "band").groupBy("rep").agg(F.collect_set("hub").alias("hubs"))  # one per band at most
    least_hub = F.array_min("hubs")  # a representative links with its smallest hub, and its other hubs link with that
    edges = met.select(F.explode(F.concat(F.array("rep"), "hubs")).alias("a"), least_hub.alias("b")).filter("a <> b").distinct()
    near = cut(component_labels(edges).select(F.col("node").alias("rep"), F.col("label").alias("hood")))
    chosen = base.sparkSession.sparkContext.broadcast(bloom(near.select(scattered(F.col("rep")).alias("rep")), "rep"))

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Shingles and MinHash values of documents that may be in a neighbourhood."""
        hasher = WordHasher()
        for batch in batches:
            may = in_bloom(chosen.value, scattered(batch.column(0).to_numpy()).view(np.uint64))
            for rows in text_slices(batch.filter(pa.array(may)), "body"):
                words, owner = hasher(rows.column(1))
                hashes, texts = shingle_sets(words, owner, rows.num_rows, k)
                n = np.bincount(texts, minlength=rows.num_rows)
                some = np.flatnonzero(n)
                if not len(some):
                    continue
                ends = np.cumsum(n[some])
                starts = ends - n[some]
                sig = minhashes(hashes, starts)
                one = np.add.reduceat(mix(hashes), starts).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0).take(pa.array(some)), pa.array(one), pa.array([hashes[s:e].tobytes() for s, e in zip(starts, ends, strict=True)], pa.binary()),
                     pa.array([x.tobytes() for x in sig], pa.binary())], names=["rep", "one", "shingles", "sig"])

    found = base.mapInArrow(candidates, "rep bigint, one bigint, shingles binary, sig binary")
    placed = near.join(reps.select("rep", "one", "copies"), "rep")
    rows = found.join(placed, ["rep", "one"])
    least = least_matches(threshold, tolerance, BANDS * ROWS)

    def compare(cell: pd.DataFrame) -> pd.DataFrame | None:
        cell = cell.sort_values(["rep", "one"]).drop_duplicates(["rep", "one"])  # repeated rows
        if len(cell) < 2:
            return None
        sig = np.frombuffer(b"".join(cell["sig"]), dtype=np.uint32).reshape(len(cell), -1)
        sets = [np.frombuffer(x, dtype=np.uint64) for x in cell["shingles"]]
        a, b = np.triu_indices(len(cell), 1)
        parts = cell["part"].to_numpy()
        if (cell["p"] != cell["q"]).any():  # pairs inside one part meet in that part's own cell
            across = parts[a] != parts[b]
            a, b = a[across], b[across]
        reps, copies = cell["rep"].to_numpy(), cell["copies"].to_numpy()
        sizes = np.array([len(s) for s in sets])
        fits = (reps[a] != reps[b]) & (np.minimum(sizes[a], sizes[b]) >= threshold * np.maximum(sizes[a], sizes[b]) - 1e-9)
        a, b = a[fits], b[fits]
        live = surviving(sig, a, b, least)
        a, b = a[live], b[live]
        if not len(a):
            return None
        both = overlaps(sets, a, b)
        linked = both >= threshold * (sizes[a] + sizes[b] - both) - 1e-9
        a, b = a[linked], b[linked]
        if not len(a):
            return None
        n = np.bincount(a, copies[b], len(cell)) + np.bincount(b, copies[a], len(cell))
        root = forest(len(cell), a, b)
        met = np.flatnonzero(n)
        return pd.DataFrame({"rep": reps[met], "n": n[met].astype(np.int64), "root": reps[root[met]]})

    dealt = block_pairs(rows.select("hood", "rep", "one", "copies", "shingles", "sig"), ["hood"], "rep", part)
    links = by_key(dealt, ["hood", "p", "q"], compare, "rep bigint, n bigint, root bigint")
    members = sketches.join(reps.drop("bands"), ["one", "two"], "left").select(
        "id", F.when(F.col("n") > 0, F.col("rep")).otherwise(F.col("id")).alias("rep"),
        F.when(F.col("n") > 0, F.col("copies")).otherwise(1).alias("copies"),
        *[F.col("text_hash"), F.when(F.col("n") > 0, F.col("one")).otherwise(F.col("text_hash")).alias("set_hash")] * named)
    return classes(members, links, "id", ["text_hash", "set_hash"] * named).withColumnRenamed("id", id_column)


def scattered(ident):
    """Spreads ids over 64 bits; the same with columns and numbers."""
    if isinstance(ident, np.ndarray):
        x = ident.view(np.uint64)
        for shift in (1, 3, 7, 13, 29):
            x = x ^ (x << np.uint64(2 * shift)) ^ (x >> np.uint64(shift))
        return x.view(np.int64)
    for shift in (1, 3, 7, 13, 29):
        ident = ident.bitwiseXOR(F.shiftleft(ident, 2 * shift)).bitwiseXOR(F.shiftrightunsigned(ident, shift))
    return ident


def deduplicate(docs: DataFrame, id_column: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """`docs` with one document of each group of near copies, the one with the smallest id.

    Rows of one id are told apart by their texts: each of them stays unless a document with a smaller id is
    connected with it. Rows of one id whose texts have the same shingles stay once, the one with the
    smallest hash, whatever the order of rows. Rows without id stay.
    """
    found = join(docs, id_column, text, named=True, **options).filter(F.col("component_id") == F.col(id_column))
    kept = found.groupBy(id_column, "set_hash").agg(F.min("text_hash").alias("text_hash")).select(F.col(id_column).alias("_id"), F.col("text_hash").alias("_hash"))
    keep = docs.columns
    hashed = F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))
    rows = docs.filter(F.col(id_column).isNotNull()).select(packed(keep), F.col(id_column).cast("bigint").alias("_id"), hashed.alias("_hash"))
    once = rows.join(kept, ["_id", "_hash"], "left_semi").groupBy("_id", "_hash").agg(F.min_by("rest", F.xxhash64("rest")).alias("rest"))
    return once.select(*unpacked(keep)).unionByName(docs.filter(F.col(id_column).isNull()))
