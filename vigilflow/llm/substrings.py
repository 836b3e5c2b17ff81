"""Substring removal with suffix automata of reference shards.

A window is `length` consecutive words. Words of a window that also starts in a document with a
smaller id are removed.

* Every window is keyed by the smallest hash of its runs of `seed` words (its minimiser), which
  depends on the window's words only, so equal windows have equal keys. Consecutive windows of one
  key form a passage of at most 2 * length words.
* Keys held by two documents are found by a combined aggregate and kept as a filter of fixed size.
  Passages of other keys are not moved; strangers that the filter lets through change nothing.
* The same aggregate sketches the number of distinct passages of a key: a passage sets bit j of a
  mask with probability 2**-(j + 1), by its hash. A key that has the lowest `CROWD` bits is crowded
  (a stock phrase among thousands of neighbours); a second filter keeps these. Their passages are cut
  into single windows named by their own hashes, in every document alike, so no task holds such a key.
* Each distinct passage is sent once, from its smallest document, as the reference (another such
  filter says which). Spark deals the reference by key; a shard is a run of whole keys. Each shard
  builds a suffix automaton over words whose states know the smallest document that holds them, and
  its passages are streamed through it: the matching statistics name, for each window, the smallest
  document in which it starts. A key with a single passage needs none.
* The answers go back to the documents by passage, and each document drops its covered words.

The words of a reference shard are bounded by `shard_words` plus one key, which has at most 5,000
distinct passages of 2 * length - 1 words (with more it would miss a bit with probability 3e-9).

Defined cases: null and empty texts have no words; texts shorter than a window keep all words; a
document without id removes nothing and is no reference; rows of one id are one document, whatever
their texts; repeated passages inside one document stay; other columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..session import cut
from .common import WordHasher, bloom, in_bloom, mix, others, pa_schema, packed, runs_of, small_batches, text_slices, unpacked

#: Bytes of a word's hash in a passage.
SYMBOL = 5
#: Bits of the sketch of a crowded key; 250 distinct passages set them in half the cases, 1,000 in 98 %.
CROWD = 8
NO_DOC = np.iinfo(np.int64).max


class SuffixAutomaton:
    """All substrings of added strings; each state knows the smallest document of its substrings."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link: list[int] = [-1]
        self.size: list[int] = [0]
        self.doc: list[int] = [NO_DOC]

    def add(self, symbols: list[int], doc: int) -> None:
        """Add a string that stands in `doc`."""
        nexts, links, sizes, docs = self.next, self.link, self.size, self.doc
        last = 0
        for c in symbols:
            have = nexts[last].get(c)
            if have is not None and sizes[have] == sizes[last] + 1:
                if doc < docs[have]:
                    docs[have] = doc
                last = have
                continue
            if have is None:
                cur = len(sizes)
                nexts.append({})
                sizes.append(sizes[last] + 1)
                links.append(0)
                docs.append(doc)
                p = last
                while p != -1 and c not in nexts[p]:
                    nexts[p][c] = cur
                    p = links[p]
                if p == -1:
                    last = cur
                    continue
                q = nexts[p][c]
                if sizes[q] == sizes[p] + 1:
                    links[cur] = q
                    last = cur
                    continue
            else:
                cur, p, q = -1, last, have
            copy = len(sizes)
            nexts.append(nexts[q].copy())
            sizes.append(sizes[p] + 1)
            links.append(links[q])
            docs.append(docs[q])
            while p != -1 and nexts[p].get(c) == q:
                nexts[p][c] = copy
                p = links[p]
            links[q] = copy
            if cur == -1:
                docs[copy] = min(docs[copy], doc)
                last = copy
            else:
                links[cur] = copy
                last = cur

    def close(self) -> None:
        """Pass each state's smallest document to the shorter substrings that end where it does."""
        docs, links = self.doc, self.link
        for state in np.argsort(np.array(self.size), kind="stable")[:0:-1].tolist():
            up = links[state]
            if docs[state] < docs[up]:
                docs[up] = docs[state]

    def windows(self, symbols: list[int], length: int) -> list[int]:
        """For each window of `length` symbols, the smallest document that holds it."""
        nexts, links, sizes, docs = self.next, self.link, self.size, self.doc
        state = matched = 0
        out = []
        for i, c in enumerate(symbols):
            while state and c not in nexts[state]:
                state = links[state]
                matched = sizes[state]
            if c in nexts[state]:
                state = nexts[state][c]
                matched += 1
            while state and sizes[links[state]] >= length:
                state = links[state]
                matched = sizes[state]
            if i >= length - 1:
                out.append(docs[state] if matched >= length else NO_DOC)
        return out


def passages(words: np.ndarray, owner: np.ndarray, length: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, first window, number of windows) of the passages of a slice of texts."""
    grams, _ = runs_of(words, owner, seed)
    n = max(0, len(words) - length + 1)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    valid = owner[:n] == owner[length - 1 : length - 1 + n]
    low, span = grams, 1
    width = length - seed + 1
    while span < width:  # smallest of `width` neighbours, by doubling
        step = min(span, width - span)
        low = np.minimum(low[: len(low) - step], low[step:])
        span += step
    low = low[:n]
    at = np.flatnonzero(valid)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    fresh = np.ones(len(at), dtype=bool)
    fresh[1:] = (low[at[1:]] != low[at[:-1]]) | (at[1:] != at[:-1] + 1) | (owner[at[1:]] != owner[at[:-1]])
    begin = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
    fresh |= (np.arange(len(at)) - begin) % length == 0  # at most `length` windows in a passage
    first = np.flatnonzero(fresh)
    counts = np.diff(np.append(first, len(at)))
    return low[at[first]], at[first], counts


def sketch(hasher: WordHasher, words: np.ndarray, first: np.ndarray, counts: np.ndarray, length: int) -> np.ndarray:
    """One bit of each passage, by a hash of its words."""
    hasher.powers(len(words) + 1)
    sums = np.zeros(len(words) + 1, dtype=np.uint64)
    np.cumsum(words * hasher.up[: len(words)], out=sums[1:])
    hashes = mix((sums[first + counts + length - 1] - sums[first]) * hasher.down[first]) | np.uint64(1 << CROWD)
    return (hashes & (~hashes + np.uint64(1))).astype(np.int32)


def single_windows(key: np.ndarray, first: np.ndarray, counts: np.ndarray, crowded: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Passages, those of crowded keys as their windows one by one; the last array marks these."""
    pieces = np.where(crowded, counts, 1)
    of = np.repeat(np.arange(len(key)), pieces)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    return key[of], first[of] + nth, np.where(crowded, 1, counts)[of], crowded[of]


def binary(raw: np.ndarray, ends: np.ndarray) -> pa.Array:
    offsets = np.concatenate(([0], ends)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw.tobytes())])


def owned(passage, ident):
    """Names a passage of a document; the same with columns and numbers."""
    if isinstance(passage, np.ndarray):
        return passage ^ (ident << 7) ^ (ident.view(np.uint64) >> np.uint64(57)).view(np.int64)
    return passage.bitwiseXOR(F.shiftleft(ident, 7)).bitwiseXOR(F.shiftrightunsigned(ident, 57))


class Cutter:
    """Cuts texts into passages, in tasks."""

    def __init__(self, length: int, seed: int) -> None:
        self.length, self.seed = length, seed

    def each(self, batches: Iterator[pa.RecordBatch]):
        """Per slice of texts: its rows, words, their owners, and key, first window and windows of each passage."""
        hasher = WordHasher()
        for batch in batches:
            for part in text_slices(batch, "body"):
                words, owner = hasher(part.column(2))
                yield hasher, part, words, owner, *passages(words, owner, self.length, self.seed)

    def keys(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for hasher, part, words, owner, key, first, counts in self.each(batches):
            ids = part.column(0).to_numpy()[owner[first]]
            order = np.lexsort((ids, key))
            bits = sketch(hasher, words, first, counts, self.length)[order]
            key, ids = key[order].view(np.int64), ids[order]
            new = np.ones(len(key), dtype=bool)
            new[1:] = (key[1:] != key[:-1]) | (ids[1:] != ids[:-1])
            bits = np.bitwise_or.reduceat(bits, np.flatnonzero(new)) if len(key) else bits
            yield pa.RecordBatch.from_arrays([pa.array(key[new]), pa.array(ids[new]), pa.array(bits)], names=["key", "id", "bits"])

    def candidates(self, shared: np.ndarray, batches: Iterator[pa.RecordBatch]):
        """Passages whose keys may be shared: key, words as bytes, hash, row, first window in the row."""
        for hasher, part, words, owner, key, first, counts in self.each(batches):
            held = in_bloom(shared[0], key)
            key, first, counts, alone = single_windows(key[held], first[held], counts[held], in_bloom(shared[1], key[held]))
            sizes = counts + self.length - 1
            ends = np.cumsum(sizes)
            places = np.repeat(first - (ends - sizes), sizes) + np.arange(int(sizes.sum()))
            raw = np.ascontiguousarray(words[places].view(np.uint8).reshape(-1, 8)[:, :SYMBOL]).reshape(-1)
            ends = ends * SYMBOL
            hashes = hasher.pieces(raw, ends - sizes * SYMBOL, ends).view(np.int64)
            starts = np.searchsorted(owner, np.arange(part.num_rows))
            yield part, np.where(alone, hashes, key.view(np.int64)), raw, ends, hashes, owner[first], first - starts[owner[first]]

    def places(self, shared, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, key, _, _, hashes, row, first in self.candidates(shared.value, batches):
            yield pa.RecordBatch.from_arrays(
                [pa.array(key), pa.array(hashes), pa.array(part.column(0).to_numpy()[row]), pa.array(part.column(1).to_numpy()[row]),
                 pa.array(first.astype(np.int32))], names=["key", "passage", "id", "body_hash", "first"])

    def reference(self, shared, owners, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, key, raw, ends, hashes, row, _ in self.candidates(shared.value, batches):
            ids = part.column(0).to_numpy()[row]
            mine = in_bloom(owners.value, owned(hashes, ids).view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(key), binary(raw, ends), pa.array(hashes), pa.array(ids)],
                                             names=["key", "words", "passage", "id"]).filter(pa.array(mine))

    def answers(self, shard_words: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Solve shards of whole keys, in the order of keys."""
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.column(1).nbytes // SYMBOL
            if size < shard_words:
                continue
            rows = pa.Table.from_batches(held).combine_chunks()
            keys = rows.column("key").to_numpy()
            cut = int(np.searchsorted(keys, keys[-1]))  # the last key may go on in the next batch
            if cut:
                yield from self.solve(rows.slice(0, cut), shard_words)
                held = pa.Table.to_batches(rows.slice(cut).combine_chunks())
            size = sum(b.column(1).nbytes for b in held) // SYMBOL if cut else 0
        if held:
            yield from self.solve(pa.Table.from_batches(held).combine_chunks(), shard_words)

    def solve(self, rows: pa.Table, shard_words: int) -> Iterator[pa.RecordBatch]:
        """The smallest document of each window of each distinct passage; shards end between keys."""
        keys, hashes, ids = (rows.column(c).to_numpy() for c in ("key", "passage", "id"))
        order = np.lexsort((ids, hashes, keys))
        new = np.ones(len(order), dtype=bool)
        new[1:] = (keys[order][1:] != keys[order][:-1]) | (hashes[order][1:] != hashes[order][:-1])
        chosen = order[new]
        first = np.append(True, keys[chosen][1:] != keys[chosen][:-1])
        last = np.append(first[1:], True)
        alone = chosen[first & last]  # nothing else has windows of this key: they start in the passage's smallest document
        words = pa.concat_arrays(rows.column("words").chunks)
        counts = pa.compute.binary_length(words.take(pa.array(alone))).to_numpy() // SYMBOL - self.length + 1
        offsets = pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32))
        yield pa.RecordBatch.from_arrays([pa.array(keys[alone]), pa.array(hashes[alone]), pa.ListArray.from_arrays(offsets, pa.array(np.repeat(ids[alone], counts)))],
                                         names=["key", "passage", "smallest"])
        crowded = ~(first & last)
        chosen, last = chosen[crowded], last[crowded]
        if not len(chosen):
            return
        texts = words.take(pa.array(chosen))
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[: len(texts) + 1] // SYMBOL
        raw = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[: offsets[-1] * SYMBOL].reshape(-1, SYMBOL).astype(np.int64)
        symbols = sum(raw[:, i] << (8 * i) for i in range(SYMBOL)).tolist()
        keys, hashes, ids = keys[chosen], hashes[chosen], ids[chosen].tolist()
        begin = 0
        while begin < len(chosen):
            end = begin
            while True:
                end += 1
                if last[end - 1] and offsets[end] - offsets[begin] >= shard_words or end == len(chosen):
                    break
            automaton = SuffixAutomaton()
            strings = [symbols[offsets[i] : offsets[i + 1]] for i in range(begin, end)]
            for string, doc in zip(strings, ids[begin:end], strict=True):
                automaton.add(string, doc)
            automaton.close()
            found = [automaton.windows(s, self.length) for s in strings]
            yield pa.RecordBatch.from_arrays([pa.array(keys[begin:end]), pa.array(hashes[begin:end]), pa.array(found, pa.list_(pa.int64()))],
                                             names=["key", "passage", "smallest"])
            begin = end


def remove(docs: DataFrame, id_column: str = "doc_id", text: str = "text", length: int = 13, seed: int = 5,
           shard_words: int = 50_000) -> DataFrame:
    """`docs` without `text`, with `kept` (its kept words joined by one space), `n_words`, `n_removed`."""
    small_batches(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    body = F.col(text).cast("string")
    base = docs.select(F.col(id_column).cast("bigint").alias("id"), F.xxhash64(body).alias("body_hash"), body.alias("body")).filter(
        "id is not null and body is not null")
    cutter = Cutter(length, seed)
    held = base.mapInArrow(cutter.keys, "key bigint, id bigint, bits int").groupBy("key").agg(
        F.min("id").alias("a"), F.max("id").alias("b"), F.bit_or("bits").alias("bits"))
    crowded = F.col("bits").bitwiseAND((1 << CROWD) - 1) == (1 << CROWD) - 1
    shared = sc.broadcast(bloom(held.filter("a < b"), "key", some=crowded))
    places = base.mapInArrow(lambda b: cutter.places(shared, b), "key bigint, passage bigint, id bigint, body_hash bigint, first int")
    firsts = places.groupBy("key", "passage").agg(F.min("id").alias("id"))
    owners = sc.broadcast(bloom(firsts.select(owned(F.col("passage"), F.col("id")).alias("owned")), "owned"))
    reference = base.mapInArrow(lambda b: cutter.reference(shared, owners, b), "key bigint, words binary, passage bigint, id bigint")
    answers = reference.repartition("key").sortWithinPartitions("key").mapInArrow(
        lambda b: cutter.answers(shard_words, b), "key bigint, passage bigint, smallest array<bigint>")
    late = F.aggregate("smallest", F.struct(F.lit(1).alias("bit"), F.lit(0).alias("mask")), lambda a, d: F.struct(
        F.shiftleft(a["bit"], 1).alias("bit"), a["mask"].bitwiseOR(F.when(d < F.col("id"), a["bit"]).otherwise(0)).alias("mask")),
        lambda a: a["mask"])
    hits = places.join(answers, ["key", "passage"]).select("id", "body_hash", "first", late.alias("mask")).filter("mask <> 0")
    marks = hits.groupBy("id", "body_hash").agg(F.collect_set(F.struct("first", "mask")).alias("marks"))  # as long as the document
    return drop_marked(docs, cut(marks), id_column, text, length)


def drop_marked(docs: DataFrame, marks: DataFrame, id_column: str, text: str, length: int) -> DataFrame:
    """Drop the words that the marked windows of a row cover; only rows that may have marks move to meet them."""
    touched = docs.sparkSession.sparkContext.broadcast(bloom(marks, "body_hash"))
    keep = others(docs, text, "kept", "n_words", "n_removed")
    body = F.col(text).cast("string")
    rows = docs.select(packed(keep), F.col(id_column).cast("bigint").alias("row_id"), F.xxhash64(body).alias("hash"), body.alias("body"))
    schema = StructType([rows.schema["rest"], StructField("kept", StringType()), StructField("n_words", LongType()), StructField("n_removed", LongType())])
    wanted = pa_schema(schema)

    def split(marked: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            may = in_bloom(touched.value, batch.column(2).to_numpy().view(np.uint64))
            yield batch.filter(pa.array(may if marked else ~may))

    def finish(batches: Iterator[pa.RecordBatch], marked: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "body"):
                kept, n_words, n_removed = [], [], []
                found = part.column(4).to_pylist() if marked else [None] * part.num_rows
                for text_of, spots in zip(part.column(3).cast(pa.binary()).to_pylist(), found, strict=True):
                    words = (text_of or b"").split()  # bytes are split at the six white-space characters
                    n_words.append(len(words))
                    if spots:
                        edge = np.zeros(len(words) + length + 1, dtype=np.int32)
                        for spot in spots:
                            at = spot["first"] + np.flatnonzero([spot["mask"] >> i & 1 for i in range(length)])
                            edge[at] += 1
                            edge[at + length] -= 1
                        words = [w for w, n in zip(words, np.cumsum(edge).tolist(), strict=False) if n <= 0]
                    n_removed.append(n_words[-1] - len(words))
                    kept.append(b" ".join(words))
                yield pa.RecordBatch.from_arrays([part.column(0).cast(wanted.field(0).type),
                                                  pa.array(kept, pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())], schema=wanted)

    met = rows.mapInArrow(lambda b: split(True, b), rows.schema)
    met = met.join(marks, (met["row_id"] == marks["id"]) & (met["hash"] == marks["body_hash"]), "left").select("rest", "row_id", "hash", "body", "marks")
    changed = met.mapInArrow(lambda b: finish(b, True), schema)
    plain = rows.mapInArrow(lambda b: finish(split(False, b), False), schema)
    return plain.unionByName(changed).select(*unpacked(keep), "kept", "n_words", "n_removed")
