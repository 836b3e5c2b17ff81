"""Language identification by sparse multinomial logistic regression on TF-IDF character n-grams.

Texts are lower-cased, everything but letters becomes one space, and runs of one to three characters
are hashed to `size` features. Document frequencies come from all training documents. The model is
fitted by follow-the-regularised-leader (proximal, per-coordinate rates, elastic-net penalties) on at
most `per_language` documents of each language, chosen by a hash; a fifth of them is kept apart to
calibrate the temperature of the probabilities. Predictions read whole texts.

Defined cases: a null text and one without a letter are `und` with score 0; without training
documents every prediction is `und`; documents without language or id teach nothing; ties go to the
first language in order; repeated rows are predicted alike; other columns are kept, and columns
named as the outputs are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from ..session import cut
from .common import mix, others, pa_schema, packed, small_batches, text_slices, unpacked

UNKNOWN = "und"


@dataclass(frozen=True)
class LanguageParams:
    size: int = 8192
    longest: int = 3
    per_language: int = 800
    epochs: int = 3
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.1
    rows: int = 256  # texts whose features are held at a time


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    weights: np.ndarray  # feature, language; the inverse document frequencies are multiplied in
    idf: np.ndarray
    bias: np.ndarray
    temperature: float


def gram_counts(texts: list[str | None], p: LanguageParams) -> tuple[np.ndarray, np.ndarray]:
    """(counts by text and feature, number of letters by text)."""
    padded = [f" {t.lower()} " if t else " " for t in texts]
    codes = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in padded])
    present = np.flatnonzero(np.bincount(codes, minlength=1))
    letter = np.zeros(present[-1] + 1 if len(present) else 1, dtype=bool)
    letter[[c for c in present.tolist() if chr(c).isalpha()]] = True
    is_letter = letter[codes]
    kept = is_letter.copy()
    kept[1:] |= ~is_letter[1:] & (is_letter[:-1] | (owner[1:] != owner[:-1]))
    kept[:1] = True
    codes = np.where(is_letter, codes, 32)[kept].astype(np.uint64)
    owner, is_letter = owner[kept], is_letter[kept]
    out = np.zeros(len(texts) * p.size, dtype=np.int64)
    rolled = np.zeros(len(codes), dtype=np.uint64)
    for n in range(1, p.longest + 1):
        if len(codes) < n:
            break
        rolled = rolled[: len(codes) - n + 1] * np.uint64(0x100000001B3) + codes[n - 1 :]
        inside = owner[: len(rolled)] == owner[n - 1 :]
        if n == 1:
            inside &= is_letter
        at = (mix(rolled[inside] + np.uint64(n * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) % np.uint64(p.size)).astype(np.int64)
        out += np.bincount(owner[: len(inside)][inside] * p.size + at, minlength=len(out))
    return out.reshape(len(texts), p.size), np.bincount(owner, weights=is_letter, minlength=len(texts))


def pieces(batches: Iterator[pa.RecordBatch], column: str, rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in text_slices(batch, column, 1 << 20):
            for begin in range(0, part.num_rows, rows):
                yield part.slice(begin, rows)


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit TF-IDF vectors; plain term frequencies, so that the language of most of a text decides."""
    x = counts.astype(np.float32) * idf.astype(np.float32)
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.maximum(norm, 1e-12)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, classes: int, size: int, p: LanguageParams) -> tuple[np.ndarray, np.ndarray]:
    """(weights, bias) of multinomial regression on sparse rows (features, values)."""
    z, n = np.zeros((size + 1, classes)), np.zeros((size + 1, classes))

    def weights(at: np.ndarray) -> np.ndarray:
        sign = np.sign(z[at])
        shrunk = np.where(np.abs(z[at]) <= p.l1, 0.0, sign * p.l1 - z[at])
        return shrunk / ((p.beta + np.sqrt(n[at])) / p.alpha + p.l2)

    rng = np.random.default_rng(3)
    for _ in range(p.epochs):
        for i in rng.permutation(len(rows)):
            at, x = rows[i]
            at, x = np.append(at, size), np.append(x, 1.0)
            w = weights(at)
            error = softmax(x @ w)
            error[labels[i]] -= 1.0
            g = x[:, None] * error[None, :]
            rate = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / p.alpha
            z[at] += g - rate * w
            n[at] += g * g
    all_weights = weights(np.arange(size + 1))
    return all_weights[:size], all_weights[size]


def temperature_of(scores: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least negative log-likelihood on held-back rows, by golden sections of its logarithm."""
    if not len(labels):
        return 1.0

    def loss(log_t: float) -> float:
        p = softmax(scores / np.exp(log_t))
        return float(-np.log(np.maximum(p[np.arange(len(labels)), labels], 1e-12)).mean())

    low, high, ratio = -3.0, 3.0, (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def held_out(id_column: str):
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 3 == 1, F.lit(True))


def train(docs: DataFrame, id_column: str = "doc_id", text: str = "text", language: str = "lang", p: LanguageParams = LanguageParams()) -> LanguageModel:
    """Fit on documents that are not held out and have a language."""
    small_batches(docs.sparkSession)
    rows = docs.filter(~held_out(id_column) & F.col(language).isNotNull() & F.col(text).isNotNull()).select(
        F.col(id_column).cast("string").alias("id"), F.col(language).cast("string").alias("lang"), F.col(text).cast("string").alias("body"))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, total = np.zeros(p.size, dtype=np.int64), 0
        for part in pieces(batches, "body", p.rows):
            seen += (gram_counts(part.column(0).to_pylist(), p)[0] > 0).sum(axis=0)
            total += part.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, p.size)), pa.array(np.append(total, seen))], names=["feature", "n"])

    found = rows.select("body").mapInArrow(frequencies, "feature bigint, n bigint").groupBy("feature").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(p.size + 1)
    for r in found:
        df[r.feature] = r.n  # feature -1, the number of documents, is the last
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 1.0

    counts = cut(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")))
    spot = F.pmod(F.xxhash64("id", "body"), F.lit(1 << 40))
    likely = rows.join(F.broadcast(counts), "lang").withColumn("spot", spot).filter(
        F.col("spot") < F.lit(float(1 << 40)) * 2 * p.per_language / F.col("n") + (1 << 20))  # about twice as many as wanted
    order = F.row_number().over(_window("lang", "spot", "id"))
    sample = likely.withColumn("nth", order).filter(F.col("nth") <= p.per_language).select("lang", "nth", "body")

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "body", p.rows):
            counts, _ = gram_counts(part.column(2).to_pylist(), p)
            x = vectors(counts, idf)
            at = [np.flatnonzero(row) for row in x]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array([a.astype(np.uint16).tobytes() for a in at], pa.binary()),
                 pa.array([row[a].tobytes() for row, a in zip(x, at, strict=True)], pa.binary())], names=["lang", "nth", "at", "x"])

    taken = sample.mapInArrow(sparse, "lang string, nth int, at binary, x binary").collect()
    taken.sort(key=lambda r: (r.nth, r.lang))
    languages = sorted({r.lang for r in taken})
    if not languages:
        return LanguageModel([], np.zeros((p.size, 0), dtype=np.float32), idf, np.zeros(0), 1.0)
    label = np.array([languages.index(r.lang) for r in taken])
    data = [(np.frombuffer(r["at"], dtype=np.uint16).astype(np.int64), np.frombuffer(r.x, dtype=np.float32).astype(np.float64)) for r in taken]
    apart = np.array([r.nth % 5 == 0 for r in taken])
    fitted = np.flatnonzero(~apart)
    weights, bias = fit_ftrl([data[i] for i in fitted], label[fitted], len(languages), p.size, p)
    scores = np.array([data[i][1] @ weights[data[i][0]] + bias for i in np.flatnonzero(apart)]).reshape(-1, len(languages))
    return LanguageModel(languages, weights.astype(np.float32), idf, bias, temperature_of(scores, label[apart]))


def _window(by: str, *order: str):
    from pyspark.sql import Window

    return Window.partitionBy(by).orderBy(*order)


def predict(docs: DataFrame, model: LanguageModel, text: str = "text", p: LanguageParams = LanguageParams()) -> DataFrame:
    """`docs` with `lang_pred` and `score`, the calibrated probability of the predicted language."""
    small_batches(docs.sparkSession)
    keep = others(docs, "lang_pred", "score")
    source = docs.select(packed(keep), F.col(text).cast("string").alias("body"))
    schema = StructType([source.schema["rest"], StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    wanted = pa_schema(schema)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.array([*m.languages, UNKNOWN], dtype=object)
        for part in pieces(batches, "body", p.rows):
            counts, letters = gram_counts(part.column(1).to_pylist(), p)
            known = (letters > 0) & bool(m.languages)
            best, score = np.full(part.num_rows, len(m.languages)), np.zeros(part.num_rows)
            if m.languages:
                probability = softmax((vectors(counts, m.idf) @ m.weights + m.bias).astype(np.float64) / m.temperature)
                best = np.where(known, probability.argmax(axis=1), len(m.languages))
                score = np.where(known, probability.max(axis=1), 0.0)
            yield pa.RecordBatch.from_arrays([part.column(0).cast(wanted.field(0).type),
                                              pa.array(names[best], pa.string()), pa.array(score, pa.float64())], schema=wanted)

    return source.mapInArrow(run, schema).select(*unpacked(keep), "lang_pred", "score")
