"""BPE encoding and decoding with an index of pair occurrences.

The words of a slice of texts are split into symbols once per distinct word. An index maps each
rank of the merge table to the places where its pair stands. Active ranks are taken in ascending
order; a rank merges all its places at once and the pairs that arise join the lists of their ranks.

Defined cases: a null or empty text has no tokens and decodes to the empty text; strings of the
special tokens in a text are those tokens; very long texts are encoded whole; repeated rows are
encoded alike; other columns are kept, and columns named as the outputs are replaced.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from .common import others, pa_schema, packed, small_batches, text_slices, unpacked

#: Code points that the tokenizer's white-space class holds (Unicode White_Space); fixed values.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
CACHE_WORDS = 150_000


@dataclass(frozen=True)
class Merges:
    """The merge table as arrays, for lookups of many pairs at once."""

    tokens: list[str]
    keys: np.ndarray  # left id * size + right id, ascending
    ranks: np.ndarray  # rank of each key
    left: np.ndarray  # by rank
    right: np.ndarray
    made: np.ndarray
    early: np.ndarray  # by rank: whether a pair with the token it makes has a lower rank
    inner: np.ndarray  # id of each byte inside a word
    last: np.ndarray  # id of each byte at a word's end
    specials: dict[str, int]
    pattern: str


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable, else 256 and up."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def load(path: str) -> Merges:
    """Read a tokenizer file of byte-level BPE with word ends."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab, suffix = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
    specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
    size = max(max(vocab.values()), *specials.values()) + 1
    tokens = [""] * size
    for token, i in [*vocab.items(), *specials.items()]:
        tokens[i] = token
    pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
    left = np.array([vocab[a] for a, _ in pairs], dtype=np.int64)
    right = np.array([vocab[b] for _, b in pairs], dtype=np.int64)
    made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
    first = np.full(size, len(pairs), dtype=np.int64)
    np.minimum.at(first, left, np.arange(len(pairs)))
    np.minimum.at(first, right, np.arange(len(pairs)))
    keys = left * size + right
    order = np.argsort(keys)
    letters = byte_letters()
    split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
    return Merges(tokens, keys[order], order, left, right, made, first[made] < np.arange(len(pairs)),
                  np.array([vocab[c] for c in letters]), np.array([vocab[c + suffix] for c in letters]),
                  specials, split["pattern"]["Regex"].replace(r"\s", " "))


def ranks_of(m: Merges, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rank of each pair; the number of merges where there is none."""
    want = a * len(m.tokens) + b
    at = np.minimum(np.searchsorted(m.keys, want), len(m.keys) - 1)
    return np.where(m.keys[at] == want, m.ranks[at], len(m.ranks))


def merge_words(m: Merges, words: list[bytes]) -> list[np.ndarray]:
    """Token ids of each word."""
    lengths = np.array([len(w) for w in words], dtype=np.int64)
    if not len(lengths) or not lengths.sum():
        return [np.zeros(0, dtype="<u4") for _ in words]
    data = np.frombuffer(b"".join(words), dtype=np.uint8)
    n = len(data)
    ends = np.cumsum(lengths)
    sym = m.inner[data].astype(np.int64)
    sym[ends[lengths > 0] - 1] = m.last[data[ends[lengths > 0] - 1]]
    word = np.repeat(np.arange(len(words)), lengths)
    after = np.arange(1, n + 1)
    after[ends[lengths > 0] - 1] = n  # n: no neighbour
    before = np.arange(-1, n - 1)
    before[(ends - lengths)[lengths > 0]] = -1
    after, before, sym = np.append(after, n), np.append(before, -1), np.append(sym, -1)
    none = len(m.ranks)

    index: dict[int, list[np.ndarray]] = {}
    active: list[int] = []

    def add(places: np.ndarray) -> None:
        """Put pairs, by their left places, into the lists of their ranks."""
        r = ranks_of(m, sym[places], sym[after[places]])
        places, r = places[r < none], r[r < none]
        if not len(places):
            return
        order = np.argsort(r, kind="stable")
        places, r = places[order], r[order]
        cuts = np.flatnonzero(r[1:] != r[:-1]) + 1
        for rank, part in zip(r[np.concatenate(([0], cuts))].tolist(), np.split(places, cuts) if len(cuts) else [places], strict=True):
            if rank in index:
                index[rank].append(part)
            else:
                index[rank] = [part]
                heapq.heappush(active, rank)

    add(np.flatnonzero(after[:-1] < n))
    while active:
        rank = heapq.heappop(active)
        lists = index.pop(rank)
        at = np.unique(np.concatenate(lists)) if len(lists) > 1 else lists[0]
        a, b = m.left[rank], m.right[rank]
        at = at[(sym[at] == a) & (sym[after[at]] == b)]
        if not len(at):
            continue
        if a == b and len(at) > 1:  # of overlapping places, every second from the left
            fresh = np.ones(len(at), dtype=bool)
            fresh[1:] = after[at[:-1]] != at[1:]
            begin = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - begin) % 2 == 0]
        if m.early[rank]:  # a lower rank may arise: the leftmost place of each word first
            firsts = np.ones(len(at), dtype=bool)
            firsts[1:] = word[at[1:]] != word[at[:-1]]
            if not firsts.all():
                index[rank] = [at[~firsts]]
                heapq.heappush(active, rank)
                at = at[firsts]
        gone = after[at]
        beyond = after[gone]
        sym[at] = m.made[rank]
        sym[gone] = -1
        after[at] = beyond
        before[beyond] = at
        before[n] = -1
        after[n] = n
        lefts = before[at]
        add(np.unique(np.concatenate((lefts[lefts >= 0], at[beyond < n]))))
    alive = sym[:-1] >= 0
    kept = sym[:-1][alive].astype("<u4")
    counts = np.bincount(word[alive], minlength=len(words))
    return np.split(kept, np.cumsum(counts)[:-1])


class Encoder:
    """Encodes texts slice by slice; words met before are remembered up to a bound."""

    def __init__(self, m: Merges) -> None:
        import regex

        self.m = m
        self.known: dict[str, bytes] = {}
        self.spaces = regex.compile(f"[{SPACES}]+")
        self.words = regex.compile(m.pattern)
        self.special = regex.compile("(" + "|".join(regex.escape(s) for s in m.specials) + ")")
        self.names = np.array(m.tokens, dtype=object)

    def plain(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return self.words.findall(self.spaces.sub(" ", text).lower())

    def split(self, text: str | None) -> list[str]:
        if not text:
            return []
        if "<|" not in text:
            return self.plain(text)
        out: list[str] = []
        for piece in self.special.split(text):
            if piece in self.m.specials:
                out.append("\0" + piece)  # no word of the pattern begins with this and a special's name
            else:
                out.extend(self.plain(piece))
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        parts = [self.split(t) for t in texts]
        if len(self.known) > CACHE_WORDS:
            self.known = {}
        fresh = list(set().union(*parts) - self.known.keys())
        names = [w for w in fresh if w[0] == "\0" and w[1:] in self.m.specials]
        for w in names:
            self.known[w] = np.array([self.m.specials[w[1:]]], dtype="<u4").tobytes()
        words = [w for w in fresh if w not in self.known]
        for w, ids in zip(words, merge_words(self.m, [w.encode() for w in words]), strict=True):
            self.known[w] = ids.tobytes()
        known = self.known.__getitem__
        return [b"".join(map(known, p)) for p in parts]

    def decode(self, ids: bytes) -> str:
        """The tokens joined by one space, as a tokenizer without a decoder gives them."""
        return " ".join(self.names[np.frombuffer(ids, dtype="<u4")])


def encode(docs: DataFrame, path: str, text: str = "text", decoded: bool = True) -> DataFrame:
    """`docs` without `text`, with `ids` (binary, little-endian unsigned 32-bit), `n_tokens` and `decoded` text."""
    small_batches(docs.sparkSession)
    merges = docs.sparkSession.sparkContext.broadcast(load(path))  # 49 thousand merges whatever the corpus
    keep = others(docs, text, "ids", "n_tokens", *["decoded"] * decoded)
    source = docs.select(packed(keep), F.col(text).cast("string").alias("body"))
    schema = StructType([source.schema["rest"], StructField("ids", BinaryType()), StructField("n_tokens", LongType()),
                         *[StructField("decoded", StringType())] * decoded])
    wanted = pa_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(merges.value)
        for batch in batches:
            for part in text_slices(batch, "body", 4 << 20):
                ids = encoder.encode(part.column(1).to_pylist())
                made = [pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())]
                if decoded:
                    made.append(pa.array([encoder.decode(x) for x in ids], pa.string()))
                yield pa.RecordBatch.from_arrays([part.column(0).cast(wanted.field(0).type), *made], schema=wanted)

    return source.mapInArrow(run, schema).select(*unpacked(keep), "ids", "n_tokens", *["decoded"] * decoded)


def digests(encoded: DataFrame) -> list[Column]:
    return [F.col("n_tokens"), F.sha2(F.col("ids"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")]
