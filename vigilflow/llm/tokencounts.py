"""Token counts of texts of any length by overlapping chunks that are spliced where they agree.

A huge text is cut into chunks that overlap at every cut. Chunks are encoded in different tasks,
with offsets. At a cut the encodings of both sides are compared: where both start a pre-token at
the same place, everything after it is the same for both, as the byte-level pattern never looks
back, and everything before it is final in the left chunk, as long as that chunk goes on for
`margin` characters (the pattern looks ahead by one character beyond a match, and by three for a
contraction; a special string must be in sight). Such a place is a proven boundary: the left
chunk's tokens before it and the right chunk's tokens from it on are those of the whole text. Where
two chunks share no boundary (a word or a gap longer than the overlap) the overlap is widened
eightfold and, once it would reach half a chunk, the cut is given up and both chunks become one.

Other texts are counted in place. Pre-tokens are encoded on their own, so each distinct one of a text of common
letters goes through the library once and is remembered; texts with other characters or special
strings go through it whole.

Defined cases: null and empty texts have no tokens and no bytes; strings of special tokens are those
tokens; other columns are kept, columns named as the outputs are replaced; repeated huge texts are
encoded once; an empty table gives an empty table.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..operators.salted import checked
from ..session import cut
from .common import others, pa_schema, packed, small_batches, text_slices, unpacked

CHUNK, OVERLAP, WIDER = 1 << 15, 256, 8
LOOK_AHEAD = 4  # characters beyond a pre-token that may decide where it ends


def margin_of(path: str) -> int | None:
    """How far a chunk must go on behind a boundary; None where the tokenizer allows no proof.

    There is one for byte-level BPE without a normaliser whose special strings neither overlap nor
    take white space beside them.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    before, added = spec["pre_tokenizer"] or {}, spec["added_tokens"]
    if spec["normalizer"] or before.get("type") != "ByteLevel" or not before.get("use_regex") or before.get("add_prefix_space"):
        return None
    names = [t["content"] for t in added]
    meet = any(a.endswith(b[:n]) and (a is not b or n < len(a)) for a in names for b in names for n in range(1, len(b) + 1))
    inside = any(a is not b and a in b for a in names for b in names)
    if meet or inside or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
        return None
    return LOOK_AHEAD + max(map(len, names), default=0)


@dataclass(frozen=True)
class Piece:
    """text[begin:end]; `left` and `right` are the numbers of the cuts it lies between, -1 at the text's ends."""

    begin: int
    end: int
    left: int
    right: int


def pieces(length: int, chunk: int, overlap: int, widths: dict[int, int]) -> list[Piece]:
    """Chunks of a text of `length` characters; `widths` has the overlaps of cuts that need another than `overlap`."""
    cuts = [i for i in range(1, length // chunk + 1) if i * chunk <= length - chunk // 2 and widths.get(i, overlap) < chunk // 2]
    begins = [0, *(i * chunk - widths.get(i, overlap) for i in cuts)]
    ends = [*(i * chunk + widths.get(i, overlap) for i in cuts), length]
    return [Piece(*p) for p in zip(begins, ends, [-1, *cuts], [*cuts, -1], strict=True)]


def boundaries(encoding, begin: int) -> tuple[np.ndarray, np.ndarray]:
    """(place in the text, tokens before it) of every pre-token of a chunk that begins at `begin`."""
    words = np.array([-1 if w is None else w for w in encoding.word_ids], dtype=np.int64)
    first = np.flatnonzero(np.diff(words, prepend=-2) != 0)
    starts = np.array([a for a, _ in encoding.offsets], dtype=np.int64)
    return starts[first] + begin, first


def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks already take the cores
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.no_truncation()
    made.no_padding()
    return made


#: The library's byte-level pre-tokens: contractions, words, numbers, marks and gaps, in this order. Fixed values.
PRE_TOKENS = "'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+"
COMMON = 0x250  # characters below are of the same class in every version of Unicode that the library may know
SPACES = " \t-\r\x85\xa0"
REMEMBERED = 300_000


class Counter:
    """Numbers of tokens of texts; with `split`, from the tokens of their distinct pre-tokens."""

    def __init__(self, path: str, split: bool) -> None:
        self.tok = tokenizer(path)
        self.split = split
        self.known: dict[str, int] = {}
        kinds = {k: "".join(re.escape(chr(c)) for c in range(COMMON) if unicodedata.category(chr(c))[0] == k) for k in "LN"}
        self.pre_token = re.compile(PRE_TOKENS.format(letter=kinds["L"], number=kinds["N"], space=SPACES))
        specials = "|".join(re.escape(t.content) for t in self.tok.get_added_tokens_decoder().values())
        self.uncommon = re.compile(f"[^\0-{chr(COMMON - 1)}]" + (f"|{specials}" if specials else ""))

    def encoded(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def __call__(self, texts: list[str]) -> list[int]:
        whole = [not self.split or self.uncommon.search(t) is not None for t in texts]
        counts = iter(self.encoded([t for t, w in zip(texts, whole, strict=True) if w]))
        parts = [None if w else self.pre_token.findall(t) for t, w in zip(texts, whole, strict=True)]
        if len(self.known) > REMEMBERED:
            self.known = {}
        fresh = list(set().union(*(p for p in parts if p)) - self.known.keys())
        self.known.update(zip(fresh, self.encoded(fresh), strict=True))
        known = self.known.__getitem__
        return [next(counts) if p is None else sum(map(known, p)) for p in parts]


def _chunks(chunk: int, overlap: int):
    """mapInArrow function: (key, body, widths) to (key, no, left, right, begin, zones, piece)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, body, widths in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                known = {w["cut"]: w["width"] for w in widths or []}
                parts = pieces(len(body), chunk, overlap, known)
                wide = lambda c: known.get(c, overlap)  # noqa: B023, E731
                for at in range(0, len(parts), 64):
                    some = parts[at : at + 64]
                    yield pa.RecordBatch.from_pydict({
                        "key": [key] * len(some), "begin": [p.begin for p in some],
                        "left": [p.left for p in some], "right": [p.right for p in some],
                        "left_end": [p.left * chunk + wide(p.left) for p in some], "right_begin": [p.right * chunk - wide(p.right) for p in some],
                        "piece": [body[p.begin : p.end] for p in some],
                    }, schema=pa.schema([("key", pa.string()), *((c, pa.int64()) for c in ("begin", "left", "right", "left_end", "right_begin")), ("piece", pa.string())]))

    return run


def _borders(path: str, margin: int):
    """mapInArrow function: chunks to their boundaries beside cuts; the last chunk also gives its number of tokens."""
    schema = pa.schema([("key", pa.string()), ("cut", pa.int64()), ("ends", pa.bool_()), ("at", pa.list_(pa.int64())), ("before", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)
        for batch in batches:
            for row in (r for part in text_slices(batch, "piece", 1 << 20) for r in part.to_pylist()):
                encoding = tok.encode(row["piece"], add_special_tokens=False)
                at, before = boundaries(encoding, row["begin"])
                out = []
                if row["left"] >= 0:
                    some = at <= row["left_end"]
                    out.append((row["key"], row["left"], False, at[some].tolist(), before[some].tolist()))
                if row["right"] >= 0:
                    some = (at >= row["right_begin"]) & (at <= row["begin"] + len(row["piece"]) - margin)
                    out.append((row["key"], row["right"], True, at[some].tolist(), before[some].tolist()))
                else:
                    out.append((row["key"], -1, True, [0], [len(encoding)]))
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in out], schema=schema)

    return run


def spliced(texts: DataFrame, path: str, margin: int, chunk: int, overlap: int) -> DataFrame:
    """(key, n_tokens, widened) of texts given as (key, body); equal keys have equal bodies."""
    chunked, borders = _chunks(chunk, overlap), _borders(path, margin)
    widths = None
    done: DataFrame | None = None
    width = overlap
    todo = texts.withColumn("widths", F.expr("cast(null as array<struct<cut: bigint, width: bigint>>)"))
    while True:
        cutted = todo.mapInArrow(chunked, "key string, begin bigint, left bigint, right bigint, left_end bigint, right_begin bigint, piece string")
        dealt = cutted.dropDuplicates(["key", "left"])  # copies of a text meet before they move; chunks of one text part
        zones = dealt.mapInArrow(borders, "key string, cut bigint, ends boolean, at array<bigint>, before array<bigint>")
        side = lambda ends: F.max(F.when(F.col("ends") == ends, F.struct("at", "before")))
        met = zones.groupBy("key", "cut").agg(side(True).alias("l"), side(False).alias("r"))
        spot = F.array_min(F.array_intersect("l.at", "r.at"))
        tokens = lambda s: F.element_at(f"{s}.before", F.array_position(f"{s}.at", F.col("spot")).cast("int"))
        gained = F.when(F.col("cut") == -1, F.col("l.before")[0]).when(F.col("spot").isNotNull(), tokens("l") - tokens("r"))
        met = cut(met.withColumn("spot", spot).select("key", "cut", gained.alias("gained")))
        whole = met.groupBy("key").agg(F.sum("gained").alias("n_tokens"), F.count_if(F.col("gained").isNull()).alias("open"))
        fine = whole.filter("open = 0").select("key", "n_tokens")
        done = fine if done is None else done.unionByName(fine)
        failed = met.filter("gained is null").select("key", "cut")
        if failed.isEmpty():
            return done
        width = width * WIDER if width * WIDER < chunk // 2 else chunk  # a width of half a chunk or more gives the cut up
        fresh = failed.withColumn("width", F.lit(width).cast("bigint"))
        widths = cut((fresh if widths is None else fresh.unionByName(widths)).groupBy("key", "cut").agg(F.max("width").alias("width")))
        again = failed.select("key").distinct()
        wide = widths.join(again, "key", "left_semi").groupBy("key").agg(F.collect_list(F.struct("cut", "width")).alias("widths"))  # cuts of one text
        todo = texts.join(checked(cut(wide)), "key").select("key", "body", "widths")


def count(docs: DataFrame, path: str, text: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """`docs` without `text`, with `n_bytes` (UTF-8) and `n_tokens`, as the tokenizers library counts them."""
    if not 0 < overlap < chunk // 2:
        raise ValueError("an overlap is positive and shorter than half a chunk")
    small_batches(docs.sparkSession)
    margin = margin_of(path)
    keep = others(docs, text, "n_bytes", "n_tokens")
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    source = docs.select(packed(keep), body.alias("body")).withColumn("n_bytes", F.octet_length("body").cast("long"))
    huge = F.length("body") >= chunk + chunk // 2 if margin is not None else F.lit(False)
    schema = StructType([source.schema["rest"], StructField("n_bytes", LongType()), StructField("n_tokens", LongType())])
    wanted = pa_schema(schema)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path, margin is not None)
        for batch in batches:
            for part in text_slices(batch, "body", 1 << 20):
                sizes = counter(part.column("body").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("rest").cast(wanted.field(0).type), part.column("n_bytes"), pa.array(sizes, pa.int64())], schema=wanted)

    short = source.filter(~huge).mapInArrow(whole, schema)
    names = [*unpacked(keep), "n_bytes", "n_tokens"]
    if margin is None:
        return short.select(*names)
    keyed = source.filter(huge).withColumn("key", F.sha2("body", 256))
    counts = spliced(keyed.select("key", "body"), path, margin, chunk, overlap)
    long = keyed.select("key", "rest", "n_bytes").join(counts, "key").select("rest", "n_bytes", "n_tokens")
    return short.unionByName(long).select(*names)
