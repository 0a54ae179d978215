"""Quality scores: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader updates.

Three n-gram streams are hashed into one space: words as they stand, word shapes (runs of one character class are one
letter, so that ``EDTH!!`` is ``A!``), and pairs of neighbouring shapes, marked when the word repeats. A text's
features are its n-gram counts divided by their number; a score is the sparse dot product through the logistic
function.

Training reads a bounded, seeded sample (``sample`` labelled rows) in one task; the model, ``2**bits`` weights, is
all that reaches the driver. Scoring reads every text whole, once, without a shuffle.

Defined results: a null or empty text is scored by the bias alone; without labelled rows every score is 0.5; a null
label is not learned from; a null id is not held out and not learned from; repeated rows are scored alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textvec import mix, slices, span_hashes, text_bytes, text_sums, word_spans

# byte classes of a shape: lower case and non-ASCII letters, upper case, digits; punctuation is itself
CLASS = np.arange(256, dtype=np.uint8)
CLASS[0x61:0x7B] = ord("a")
CLASS[0x80:] = ord("a")
CLASS[0x41:0x5B] = ord("A")
CLASS[0x30:0x3A] = ord("0")


def shape_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of every word's shape."""
    kind = CLASS[data]
    new = np.ones(len(data), dtype=bool)
    new[1:] = kind[1:] != kind[:-1]
    new[start] = True
    inside = np.zeros(len(data) + 1, dtype=np.int64)  # shape letters before each byte
    np.cumsum(new, out=inside[1:])
    return span_hashes(kind[new], inside[start], inside[end], seed=3)


def ngrams(data: np.ndarray, off: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams, text by text, and each text's bounds among them."""
    start, end, bounds = word_spans(data, off)
    shift = np.uint64(64 - bits)
    word, shape = span_hashes(data, start, end), shape_hashes(data, start, end)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    before = np.zeros(len(start), dtype=np.uint64)  # pair with the word before; none at a text's start
    again = np.zeros(len(start), dtype=np.uint64)
    if len(start) > 1:
        joined = text[1:] == text[:-1]
        before[1:] = np.where(joined, shape[:-1], 0)
        again[1:] = joined & (word[1:] == word[:-1])
    pair = mix(before * np.uint64(3) + shape + (again << np.uint64(17)))
    found = np.stack([word >> shift, mix(shape) >> shift, pair >> shift], axis=1)
    return found.ravel().astype(np.int64), bounds * 3


def ftrl(
    rows: list, labels: np.ndarray, bits: int, alpha: float, beta: float, l1: float, l2: float, epochs: int, seed: int
) -> np.ndarray:
    """Weights after per-coordinate follow-the-regularised-leader updates; the last one is the bias."""
    size = (1 << bits) + 1
    z, n = np.zeros(size), np.zeros(size)

    def weights(ids: np.ndarray) -> np.ndarray:
        zi = z[ids]
        return np.where(np.abs(zi) <= l1, 0.0, (np.sign(zi) * l1 - zi) / ((beta + np.sqrt(n[ids])) / alpha + l2))

    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            ids, x = rows[i]
            w = weights(ids)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - labels[i]) * x
            more = g * g
            z[ids] += g - (np.sqrt(n[ids] + more) - np.sqrt(n[ids])) / alpha * w
            n[ids] += more
    return weights(np.arange(size))


def fit(
    docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "quality",
    sample: int = 8000, bits: int = 18, alpha: float = 0.5, beta: float = 1.0, l1: float = 1e-3, l2: float = 1e-3,
    scale: float = 8.0, epochs: int = 3, seed: int = 9,
) -> np.ndarray:
    """Weights learned from at most ``sample`` of the labelled rows."""
    place = F.xxhash64(F.lit(seed), F.col(id_col))
    chosen = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("_lid"), F.col(label_col).cast("double").alias("y"), place.alias("place")
    ).orderBy("place", "_lid", "y").limit(sample)
    texts = docs.select(F.col(id_col).alias("_did"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(chosen), F.col("_did") == F.col("_lid"))  # at most ``sample`` short rows
    rows = rows.select("text", "y", "place", F.lit(True).alias("all"))

    def train(table: pd.DataFrame) -> pd.DataFrame:
        table = table.sort_values(["place", "text", "y"])
        data, off = text_bytes(pa.array(table["text"], pa.large_string()))
        out = []
        for i, j in slices(off):
            part = off[i : j + 1]
            ids, bounds = ngrams(data[part[0] : part[-1]], part - part[0], bits)
            for a, b in zip(bounds, bounds[1:], strict=False):
                u, c = np.unique(ids[a:b], return_counts=True)
                out.append((np.append(u, 1 << bits), np.append(c * scale / max(1, b - a), 1.0)))
        w = ftrl(out, table["y"].to_numpy(float), bits, alpha, beta, l1, l2, epochs, seed)
        w[:-1] *= scale
        return pd.DataFrame({"w": [w.astype("<f4").tobytes()]})

    found = rows.groupBy("all").applyInPandas(train, "w binary").collect()  # one row: the model
    return np.frombuffer(found[0]["w"], "<f4") if found else np.zeros((1 << bits) + 1, np.float32)


def score(docs: DataFrame, weights: np.ndarray, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1 as column ``name``, which must be new."""
    bits = int(len(weights) - 1).bit_length() - 1
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # 2**bits weights, whatever the data
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for b in batches:
            data, off = text_bytes(b.column(at))
            got = np.zeros(len(off) - 1)
            for i, j in slices(off):
                part = off[i : j + 1]
                ids, bounds = ngrams(data[part[0] : part[-1]], part - part[0], bits)
                got[i:j] = text_sums(w[ids], bounds) / np.maximum(1, np.diff(bounds))
            got = 1 / (1 + np.exp(-np.clip(got + w[-1], -30, 30)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got)], [*b.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))
