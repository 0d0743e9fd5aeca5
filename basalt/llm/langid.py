"""Language identification by the nearest of several centroids per language, by cosine of TF-IDF character n-grams.

Texts are lower-cased; what is no letter or mark ends a word. N-grams of 1 to 3 characters, with the word's ends, are
hashed to 2^12 places; a text's vector is log(1 + count) * idf, of length 1. Document frequencies come from all training
texts. Centroids come from spherical k-means in each language, on a sample of at most SAMPLE different texts of it, taken
by hash (one task a language, bounded by that). A text gets the language of the centroid with the greatest cosine; it is
rejected where that is below the centroid's least usual cosine, a quantile over all training texts of its language that
are nearest to it.

The model holds CENTROIDS vectors of 4096 floats for each language, and grows with nothing else. Whole texts are read, in
pieces of a bounded number of characters. Null texts and texts without a letter are `und` with score 0, and so is every
text if there is nothing to learn from; training rows with a null text or language are left out. Ties go to the first
language in order. Rows of the same id are rows of their own.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Stash

BITS = 12
DIM = 1 << BITS
SAMPLE, CENTROIDS, LLOYD = 1500, 4, 12
#: Share of a centroid's training texts whose cosine may lie below its bar.
OUTSIDE = 0.002
#: Characters and texts that are laid end to end.
PIECE_CHARS, PIECE_TEXTS = 500_000, 256
UNKNOWN = "und"
#: Odd multipliers of a character by its place in the n-gram, salts by length.
MIX = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)]
SALT = [np.uint32(x) for x in (0x27D4EB2F, 0x165667B1, 0x2545F491)]
_KINDS: list[np.ndarray] = []


def kinds() -> np.ndarray:
    """2 for letters, 1 for marks, 0 for all other code points; made once a process."""
    if not _KINDS:
        first = {"L": 2, "M": 1}
        _KINDS.append(np.fromiter((first.get(unicodedata.category(chr(c))[0], 0) for c in range(sys.maxunicode + 1)), dtype=np.uint8, count=sys.maxunicode + 1))
    return _KINDS[0]


def _hash(parts: list[np.ndarray]) -> np.ndarray:
    h = np.full(len(parts[0]), SALT[len(parts) - 1], dtype=np.uint32)
    for part, mix in zip(parts, MIX, strict=False):
        h = (h ^ part) * mix
        h ^= h >> np.uint32(15)
    return (h * MIX[0]) >> np.uint32(32 - BITS)


def _add(out: np.ndarray, codes: np.ndarray, row: np.ndarray) -> None:
    """Counts the n-grams of a stream of words (codes) and gaps (0, never two in a row) into out[row, place]."""
    n = len(out)
    flat = out.reshape(-1)
    letter = codes != 0
    at = row.astype(np.int64) << BITS
    one = np.flatnonzero(letter)
    places = [at[one] | _hash([codes[one]])]
    if len(codes) > 1:
        owner = np.where(letter[:-1], at[:-1], at[1:])
        places.append(owner | _hash([codes[:-1], codes[1:]]))
    if len(codes) > 2:
        mid = np.flatnonzero(letter[1:-1]) + 1
        places.append(at[mid] | _hash([codes[mid - 1], codes[mid], codes[mid + 1]]))
    flat += np.bincount(np.concatenate(places), minlength=n << BITS).astype(out.dtype)


def _stream(low: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes with one gap before, between and after words, row of each code, has a row a letter?)"""
    text = np.frombuffer("\n".join(["", *low, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    row = np.repeat(np.arange(len(low) + 1), [1, *[len(t) + 1 for t in low]])  # a text's last gap is its own
    kind = kinds()[text]
    lettered = np.bincount(row[kind == 2], minlength=len(low) + 1)[1:] > 0
    keep = kind > 0
    keep[1:] |= kind[:-1] > 0  # a gap stays where a word ends
    keep[0] = True
    codes, row = np.where(kind > 0, text, 0).astype(np.uint32)[keep], row[keep]
    return codes, np.maximum(row - 1, 0), lettered


def _cuts(t: str) -> list[str]:
    """Pieces of bounded size, cut at gaps where there are any."""
    out, first = [], 0
    while len(t) - first > PIECE_CHARS:
        end = first + PIECE_CHARS
        gap = max(t.rfind(c, first, end) for c in " \n\t")
        end = gap if gap > first else end
        out.append(t[first:end])
        first = end
    return [*out, t[first:]]


def count_grams(texts: list[str | None]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """(places in `texts`, counts of n-grams, has it a letter?) in bounded lots."""
    def counted(lot: list[tuple[int, str]]) -> tuple[list[int], np.ndarray, np.ndarray]:
        out = np.zeros((len(lot), DIM), dtype=np.float32)
        codes, row, lettered = _stream([t for _, t in lot])
        _add(out, codes, row)
        return [k for k, _ in lot], out, lettered

    lot, held = [], 0
    for k, t in enumerate(texts):
        low = (t or "").lower()
        if len(low) > PIECE_CHARS:
            total, some = np.zeros((1, DIM), dtype=np.float32), False
            for piece in _cuts(low):
                _, part, lettered = counted([(k, piece)])
                total, some = total + part, some or bool(lettered[0])
            yield [k], total, np.array([some])
            continue
        lot.append((k, low))
        held += len(low)
        if held >= PIECE_CHARS or len(lot) == PIECE_TEXTS:
            yield counted(lot)
            lot, held = [], 0
    if lot:
        yield counted(lot)


def unit(x: np.ndarray) -> np.ndarray:
    length = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, length, out=np.zeros_like(x), where=length > 0)


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return unit(np.log1p(counts) * idf)


def spherical_means(x: np.ndarray, k: int, rounds: int = LLOYD) -> np.ndarray:
    """Unit centroids of unit rows, seeded by the farthest from those before; the order of rows decides ties."""
    seeds = [int((x @ x.mean(axis=0)).argmax())]
    near = x @ x[seeds[0]]
    while len(seeds) < min(k, len(x)):
        far = int(near.argmin())
        if near[far] > 1 - 1e-6:
            break
        seeds.append(far)
        near = np.maximum(near, x @ x[far])
    c = x[seeds]
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        sums = np.stack([x[own == j].sum(axis=0) if (own == j).any() else c[j] for j in range(len(c))])
        c = unit(sums.astype(np.float32))
    return c


@dataclass
class Model:
    """langs: of each centroid, in order; centroids: unit rows; idf: by place."""

    langs: list[str]
    centroids: np.ndarray
    idf: np.ndarray

    def cosines(self, texts: list[str | None]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
        for places, counts, lettered in count_grams(texts):
            yield places, np.clip(vectors(counts, self.idf) @ self.centroids.T, 0.0, 1.0), lettered


def _idf(learn: DataFrame) -> np.ndarray:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(DIM, dtype=np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for _, counts, _ in count_grams(batch.column(0).to_pylist()):
                seen += (counts > 0).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(np.arange(DIM), -1), pa.int32()), pa.array(np.append(seen, n), pa.int64())], names=["place", "n"])

    rows = learn.select("text").mapInArrow(task, "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).collect()  # DIM + 1 rows
    seen = {r["place"]: r["n"] for r in rows}
    n = seen.pop(-1, 0)
    return np.array([np.log((1 + n) / (1 + seen.get(p, 0))) + 1 for p in range(DIM)], dtype=np.float32)


def train(learn: DataFrame, text: str = "text", lang: str = "lang", sample: int = SAMPLE, centroids: int = CENTROIDS) -> Model | None:
    """A model of all rows of learn; None without any row that has both text and language."""
    rows = learn.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).where("text is not null and lang is not null and text rlike '\\\\p{L}'")
    rows = rows.withColumn("h", F.xxhash64("text"))
    sizes = rows.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n")).collect()  # a row per language
    if not sizes:
        return None
    idf = _idf(rows)
    span = 1 << 30
    bars = learn.sparkSession.createDataFrame([(r["lang"], min(span, int(span * 0.9 * sample / max(1, r["n"])))) for r in sizes], "lang string, bar long")
    picked = rows.join(F.broadcast(bars), "lang").where(F.pmod(F.xxhash64("h"), F.lit(span)) < F.col("bar")).dropDuplicates(["lang", "h"]).select("lang", "h", "text")

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("h").head(sample)
        x = np.concatenate([vectors(counts, idf) for _, counts, _ in count_grams(frame["text"].tolist())])
        found = spherical_means(x, centroids).astype(np.float32)
        return pd.DataFrame({"lang": frame["lang"].iloc[0], "k": range(len(found)), "c": [row.tobytes() for row in found]})

    got = sorted(picked.groupBy("lang").applyInPandas(fit, "lang string, k int, c binary").collect(), key=lambda r: (r["lang"], r["k"]))
    return Model([r["lang"] for r in got], np.stack([np.frombuffer(r["c"], dtype=np.float32) for r in got]), idf)


def identify(docs: DataFrame, model: Model | None, key: list[str], learnt: Column, text: str = "text", lang: str = "lang", outside: float = OUTSIDE, stash: Stash | None = None) -> DataFrame:
    """key columns, nearest (a language, or und), score (greatest cosine), rejected, and language: nearest, or und where
    rejected. learnt: which rows the model comes from; their languages set the bars of rejection and nothing else."""
    spark = docs.sparkSession
    stash = stash or Stash(spark, "langid")
    keys = [docs.schema[c] for c in key]
    if model is None:
        return docs.select(*key, F.lit(UNKNOWN).alias("nearest"), F.lit(0.0).alias("score"), F.lit(False).alias("rejected"), F.lit(UNKNOWN).alias("language"))
    names = np.array(model.langs, dtype=object)
    shared = spark.sparkContext.broadcast(model)  # CENTROIDS * DIM floats a language
    schema = T.StructType([*keys, T.StructField("nearest", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("__c", T.IntegerType()), T.StructField("__own", T.IntegerType()), T.StructField("__cos", T.DoubleType())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        columns = {name: np.flatnonzero(names == name) for name in set(m.langs)}
        for batch in batches:
            n = batch.num_rows
            texts, langs = batch.column(len(key)).to_pylist(), batch.column(len(key) + 1).to_pylist()
            best, score, own, own_cos = np.full(n, -1), np.zeros(n), [None] * n, [None] * n
            for places, cos, lettered in m.cosines(texts):
                top = cos.argmax(axis=1)
                best[places] = np.where(lettered, top, -1)
                score[places] = np.where(lettered, cos[np.arange(len(top)), top], 0.0)
                for k, row, ok in zip(places, cos, lettered.tolist(), strict=True):
                    mine = columns.get(langs[k])
                    if ok and mine is not None:
                        own[k] = int(mine[row[mine].argmax()])
                        own_cos[k] = float(row[own[k]])
            nearest = [m.langs[b] if b >= 0 else UNKNOWN for b in best.tolist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(key)], pa.array(nearest, pa.string()), pa.array(score, pa.float64()), pa.array(best, pa.int32()), pa.array(own, pa.int32()), pa.array(own_cos, pa.float64())],
                names=schema.names,
            )

    rows = docs.select(*key, F.col(text).alias("__text"), F.when(learnt, F.col(lang).cast("string")).alias("__lang"))
    seen = stash.put(rows.mapInArrow(task, schema).hint("rebalance"), "cosines")  # a few numbers a text: few files
    bars = seen.where("__own is not null").groupBy(F.col("__own").alias("__c")).agg(F.percentile_approx("__cos", outside, 10_000).alias("__bar"))
    known = seen.join(F.broadcast(bars), "__c", "left")  # a row per centroid
    rejected = F.coalesce(F.col("score") < F.col("__bar"), F.lit(False))
    return known.select(*key, "nearest", "score", rejected.alias("rejected"), F.when(rejected, UNKNOWN).otherwise(F.col("nearest")).alias("language"))
