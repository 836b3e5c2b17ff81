"""What the operators of this folder share: words as hashes, bounded filters, groups of rows in a stream, links to classes."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.campaigns import component_labels
from ..session import cut

WORD = r"[^\x20\x09-\x0D]+"
SLICE_BYTES = 1 << 18
BROADCAST_ROWS = 50_000
BLOOM_BLOCK = 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Have Spark hand rows to Python a thousand at a time where the session leaves its default of ten
    thousand, as rows here hold whole texts and both sides keep a batch in memory.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, "1000")


# ---------------------------------------------------------------- other columns, whatever their names


def others(df: DataFrame, *but: str) -> list[str]:
    """The columns that an operator carries along."""
    return [c for c in df.columns if c.lower() not in {b.lower() for b in but}]


def packed(names: Sequence[str]) -> Column:
    """Carried columns as one struct `rest`, so that no name of theirs can meet one of the operator's."""
    return F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`") for c in names)).alias("rest")


def unpacked(names: Sequence[str]) -> list[Column]:
    return [F.col("rest").getField(c).alias(c) for c in names]


def hash_sample(df: DataFrame, key: Sequence[Column], rows: int) -> DataFrame:
    """At most `rows` rows, those with the smallest hashes of their key.

    Rows are first thinned to about twice as many by a bound on the hash, so that what tasks send
    for the final choice does not grow with their number.
    """
    total = df.count()
    spot = F.pmod(F.xxhash64(*key), F.lit(1 << 40))
    thinned = df.withColumn("_spot", spot).filter(F.col("_spot") <= min(1 << 40, (2 << 40) * rows // max(1, total)))
    return thinned.orderBy("_spot", *key).limit(rows).drop("_spot")


# ---------------------------------------------------------------- words of Arrow strings as 64-bit hashes


def text_slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Row slices of a batch with about `limit` bytes of text each; a longer text is a slice of its own."""
    at = batch.schema.get_field_index(column)
    sizes = np.cumsum(np.nan_to_num(pa.compute.binary_length(batch.column(at)).to_numpy(zero_copy_only=False).astype("float64")))
    begin = 0
    while begin < batch.num_rows:
        base = sizes[begin - 1] if begin else 0.0
        end = max(begin + 1, int(np.searchsorted(sizes, base + limit, side="right")))
        yield batch.slice(begin, end - begin)
        begin = end


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHasher:
    """Hashes of the words of a slice of texts, from the bytes of the whole slice at once."""

    BASE = 0x9E3779B97F4A7C15 | 1

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)
        self.gap = np.zeros(256, dtype=bool)
        self.gap[[0x20, 9, 10, 11, 12, 13]] = True

    def powers(self, n: int) -> None:
        if len(self.up) < n:
            inverse = pow(self.BASE, -1, 1 << 64)
            self.up, self.down = np.ones(n + 1, dtype=np.uint64), np.ones(n + 1, dtype=np.uint64)
            self.up[1:], self.down[1:] = self.BASE, inverse
            np.multiply.accumulate(self.up, out=self.up)
            np.multiply.accumulate(self.down, out=self.down)

    def bounds(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(bytes, start of each word, end of each word, text of each word)."""
        if pa.types.is_large_string(texts.type):
            texts = texts.cast(pa.string())
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, dtype=np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        inside = ~self.gap[data]
        cutting = np.zeros(len(data) + 1, dtype=bool)
        cutting[offsets] = True
        before, after = np.ones(len(data), dtype=bool), np.ones(len(data), dtype=bool)
        if len(data):
            before[1:] = ~inside[:-1] | cutting[1:-1]
            after[:-1] = ~inside[1:] | cutting[1:-1]
        starts = np.flatnonzero(inside & before)
        ends = np.flatnonzero(inside & after) + 1
        return data, starts, ends, np.searchsorted(offsets, starts, side="right") - 1

    def pieces(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of each piece data[start:end]."""
        self.powers(len(data) + 1)
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(hash, text number) of each word of the texts, in order; nulls have no words."""
        data, starts, ends, owner = self.bounds(texts)
        return self.pieces(data, starts, ends), owner


def runs_of(words: np.ndarray, owner: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, whether all words are of one text) of k consecutive words, by the first of them."""
    n = max(0, len(words) - k + 1)
    out = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        out = out * np.uint64(0xD6E8FEB86659FD93) + words[i : i + n]
    return mix(out), owner[:n] == owner[k - 1 : k - 1 + n] if n else np.zeros(0, dtype=bool)


# ---------------------------------------------------------------- a filter of bounded size


def bloom(keys: DataFrame, column: str, bits: int = 25, some: Column | None = None) -> np.ndarray:
    """A Bloom filter of 2**bits bits over a long column: 4 MB whatever the table's size; with `some`,
    a second one beside it that holds only the keys of rows with `some`.

    Only the filter is collected. It never misses a key; when more keys come than it is made for
    it lets more strangers pass, so users must be right with any stranger.
    """
    first = F.col(column).bitwiseAND(F.lit((1 << bits) - 1))
    second = F.shiftrightunsigned(F.col(column), 64 - bits)
    places = F.array(first, second)
    if some is not None:
        places = F.when(some, F.concat(places, F.array(first + (1 << bits), second + (1 << bits)))).otherwise(places)
    at = keys.select(F.explode(places).alias("at"))
    words = at.groupBy(F.shiftrightunsigned("at", 5).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(at & 31 as int))")).alias("set"))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The filter's words as blocks of bytes."""
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            block, word, bits_of = (batch.column(i).to_numpy() for i in range(3))
            for b in np.unique(block).tolist():
                mine = block == b
                held.setdefault(b, np.zeros(BLOOM_BLOCK, dtype=np.uint32))[word[mine] % BLOOM_BLOCK] |= bits_of[mine].astype(np.uint32)
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([x.tobytes() for x in held.values()], pa.binary())], names=["block", "bytes"])

    dealt = words.select(F.expr(f"word div {BLOOM_BLOCK}").alias("block"), "word", "set").repartition("block")
    out = np.zeros((1 if some is None else 2) << (bits - 5), dtype=np.uint32)
    for row in dealt.mapInArrow(blocks, "block bigint, bytes binary").collect():
        out[row["block"] * BLOOM_BLOCK : (row["block"] + 1) * BLOOM_BLOCK] = np.frombuffer(row["bytes"], dtype=np.uint32)
    return out if some is None else out.reshape(2, -1)


def in_bloom(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which uint64 keys may be in the filter."""
    bits = np.uint64(int(np.log2(len(bitmap))) + 5)
    out = np.ones(len(keys), dtype=bool)
    for at in (keys & ((np.uint64(1) << bits) - np.uint64(1)), keys >> (np.uint64(64) - bits)):
        out &= (bitmap[(at >> np.uint64(5)).astype(np.int64)] >> (at & np.uint64(31)).astype(np.uint32)) & np.uint32(1) > 0
    return out


# ---------------------------------------------------------------- rows of one key, out of sorted batches


def groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pd.DataFrame]:
    """Frames with all rows of a key, from batches in which equal keys stand together."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        frame = batch.to_pandas()
        if frame.empty:
            continue
        changes = np.zeros(len(frame), dtype=bool)
        for k in keys:
            values = frame[k].to_numpy()
            changes[1:] |= values[1:] != values[:-1]
        if held and any(held[-1][k].iloc[-1] != frame[k].iloc[0] for k in keys):
            changes[0] = True
        cuts = [0, *np.flatnonzero(changes), len(frame)]
        for begin, end in zip(cuts, cuts[1:], strict=False):
            if begin and held or changes[0] and begin == 0 and held:
                yield pd.concat(held, ignore_index=True) if len(held) > 1 else held[0].reset_index(drop=True)
                held = []
            if end > begin:
                held.append(frame.iloc[begin:end])
    if held:
        yield pd.concat(held, ignore_index=True) if len(held) > 1 else held[0].reset_index(drop=True)


def key_chunks(batches: Iterator[pa.RecordBatch], keys: Sequence[str], rows: int) -> Iterator[pa.Table]:
    """Tables of about `rows` rows or more that hold whole keys, from batches in which equal keys stand together."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size < rows:
            continue
        whole = pa.Table.from_batches(held)
        same = np.ones(whole.num_rows, dtype=bool)
        for k in keys:
            values = whole.column(k).to_numpy()
            same &= values == values[-1]
        cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0  # the last key may go on
        if cut:
            yield whole.slice(0, cut)
            held, size = whole.slice(cut).to_batches(), whole.num_rows - cut
    if size:
        yield pa.Table.from_batches(held)


def by_key(df: DataFrame, keys: Sequence[str], step: Callable[[pd.DataFrame], pd.DataFrame | None], schema: str, flush: int = 20_000) -> DataFrame:
    """Apply `step` to all rows of each key; rows are dealt and sorted by Spark and read as a stream."""
    from pyspark.sql.types import StructType

    wanted = pa_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[pd.DataFrame] = []
        rows = 0
        for frame in groups(batches, keys):
            made = step(frame)
            if made is not None and len(made):
                out.append(made)
                rows += len(made)
            if rows >= flush:
                yield pa.RecordBatch.from_pandas(pd.concat(out, ignore_index=True), schema=wanted, preserve_index=False)
                out, rows = [], 0
        if out:
            yield pa.RecordBatch.from_pandas(pd.concat(out, ignore_index=True), schema=wanted, preserve_index=False)

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def pa_schema(struct) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(struct)


# ---------------------------------------------------------------- links between representatives to classes


def block_pairs(rows: DataFrame, group: Sequence[str], spread: str, size: int) -> DataFrame:
    """Deal the rows of each group to a grid of parts of about `size` rows.

    Adds `part` (the row's own), `p` and `q` (p <= q, a cell of the grid). Every pair of rows of a
    group meets in one cell, (smaller part, larger part); a group of up to `size` rows is one cell.
    No row of a group of n rows is copied more than n / size + 1 times.
    """
    sizes = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > size)
    large = cut(sizes.select(*group, F.ceil(F.col("_n") / size).cast("int").alias("_parts")))
    large = F.broadcast(large) if large.count() <= BROADCAST_ROWS else large  # else a join that can be split
    parted = rows.join(large, list(group), "left").withColumn("_parts", F.coalesce("_parts", F.lit(1)))
    parted = parted.withColumn("part", F.pmod(F.xxhash64(spread), F.col("_parts")).cast("int"))
    grid = parted.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    return grid.withColumns({"p": F.least("part", "_other"), "q": F.greatest("part", "_other")}).drop("_other", "_parts")


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n rows the smallest row it is connected with by links (a, b)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def classes(members: DataFrame, links: DataFrame, id_column: str, carried: Sequence[str] = ()) -> DataFrame:
    """(id, n_links, component_id) and the `carried` columns from `members` (id, rep, copies) and `links` (rep, n, root).

    `links` has, for each block in which a representative met others, the number of rows linked to
    it there and the smallest representative it was connected with. Components are found among
    representatives; copies follow theirs.
    """
    links = cut(links)
    counts = links.groupBy("rep").agg(F.sum("n").alias("_linked"))
    edges = links.filter("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b")).distinct()
    labels = component_labels(edges).select(F.col("node").alias("rep"), F.col("label").alias("_label"))
    # one written table per representative: the join to it can be split where one has very many copies
    found = cut(counts.join(labels, "rep", "full"))
    return members.join(found, "rep", "left").select(
        id_column,
        (F.col("copies") - 1 + F.coalesce("_linked", F.lit(0))).cast("long").alias("n_links"),
        F.coalesce("_label", "rep").alias("component_id"), *carried,
    )


def sha(column: Column) -> Column:
    return F.sha2(column, 256)
