"""Language identification in two steps: the family first, then the language within the family.

Linear support vector machines on hashed letter n-grams, one versus one: every pair of families has a machine, and
so has every pair of languages within a family. Each votes with its margin; the family with the most votes wins, then
the language within it. A text is scored as a whole: a decision is the mean weight of its n-grams.

Training takes a bounded, seeded sample (``sample`` rows, shared equally by the languages) in one task; the model
(``2**bits`` weights per pair) is all that reaches the driver. Scoring reads every row once, without a shuffle.

Defined results: a null text or one without a letter is ``und`` with score 0, and so is every text when no labelled
row was seen; with a single language the score is 1; a null id is not held out and not learned from; repeated rows
are scored alike; all input columns pass through, so ``lang_pred`` and ``score`` must not be among them (``names``
chooses others).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textvec import release, slices, text_bytes

# Families of common language codes. A code not listed is a family of its own.
FAMILIES = {
    "germanic": ["af", "da", "de", "en", "is", "nb", "nl", "nn", "no", "sv"],
    "romance": ["ca", "es", "fr", "gl", "it", "pt", "ro"],
    "slavic": ["bg", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"],
}
UNDETERMINED = "und"
ORDERS = (2, 3, 5)  # bytes of an n-gram


def family_of(lang: str) -> str:
    return next((f for f, members in FAMILIES.items() if lang in members), lang)


# letters keep their place, A-Z in lower case; anything else below 0x80 is a gap
FOLD = np.where(np.arange(256) >= 0x80, np.arange(256), 0x20).astype(np.uint64)
FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)


def grams(data: np.ndarray, bits: int) -> list[np.ndarray]:
    """Bucket of the n-gram that starts at each byte, for each order."""
    letters, out = FOLD[data], []
    code = letters.copy()
    for n in range(2, max(ORDERS) + 1):
        code = (code[:-1] << np.uint64(8)) | letters[n - 1 :]
        if n in ORDERS:
            out.append(((code * np.uint64(0x9E3779B97F4A7C15 + 2 * n)) >> np.uint64(64 - bits)).astype(np.int32))
    return out




def features(data: np.ndarray, off: np.ndarray, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sparse n-gram shares of each text: buckets and values that add up to 1 per order."""
    out = []
    for i in range(len(off) - 1):
        found = grams(data[off[i] : off[i + 1]], bits) if off[i + 1] > off[i] + max(ORDERS) else []
        where, share = [], []
        for g in found:
            ids, count = np.unique(g, return_counts=True)
            where.append(ids)
            share.append((count / len(g)).astype(np.float32))
        out.append((np.concatenate(where), np.concatenate(share)) if found else (np.zeros(0, np.int32), np.zeros(0, np.float32)))
    return out


def train_svm(rows: list, sign: np.ndarray, bits: int, epochs: int, seed: int) -> np.ndarray:
    """Averaged stochastic subgradient of the hinge loss; the last weight is the bias."""
    size = 1 << bits
    w, total = np.zeros(size + 1), np.zeros(size + 1)
    order, rate, step = np.random.default_rng(seed), 20.0, 0
    balance = len(sign) / (2 * np.array([max(1, (sign < 0).sum()), max(1, (sign > 0).sum())]))
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            ids, share = rows[i]
            step += 1
            if sign[i] * (w[ids] @ share + w[size]) < 1:
                move = sign[i] * rate * balance[int(sign[i] > 0)]
                w[ids] += move * share
                w[size] += 0.01 * move
                total[ids] += step * move * share
                total[size] += step * 0.01 * move
    return w - total / max(1, step)


class Model:
    """Machines of all pairs; ``pairs`` names both sides, ``weights`` has a column per pair."""

    def __init__(self, langs: list[str], pairs: list[tuple[str, str]], weights: np.ndarray, bias: np.ndarray, bits: int):
        self.langs, self.pairs, self.weights, self.bias, self.bits = langs, pairs, weights, bias, bits

    def decide(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Decision of every machine for every text."""
        out = np.tile(self.bias, (len(off) - 1, 1))
        for g, n in zip(grams(data, self.bits), ORDERS, strict=True):
            first = np.minimum(off[:-1], len(g))
            end = np.maximum(first, np.minimum(off[1:] - n + 1, len(g)))  # n-grams within the text only
            sums = np.zeros(len(g) + 1)
            for k in range(len(self.pairs)):
                np.cumsum(self.weights[:, k][g], out=sums[1:])
                out[:, k] += (sums[end] - sums[first]) / np.maximum(1, end - first)
        return out

    def choose(self, decisions: np.ndarray, names: list[str], prefix: str) -> tuple[np.ndarray, np.ndarray]:
        """Winner among ``names`` (place in the list) and its confidence, by the votes of their pairs."""
        votes = np.zeros((len(decisions), len(names)))
        soft = np.ones((len(decisions), len(names)))
        for k, (a, b) in enumerate(self.pairs):
            if a.startswith(prefix) and a[len(prefix) :] in names and b[len(prefix) :] in names:
                i, j = names.index(a[len(prefix) :]), names.index(b[len(prefix) :])
                p = 1 / (1 + np.exp(-np.clip(3 * decisions[:, k], -30, 30)))
                votes[:, i] += (p >= 0.5) + p * 1e-3
                votes[:, j] += (p < 0.5) + (1 - p) * 1e-3
                soft[:, i] = np.minimum(soft[:, i], p)
                soft[:, j] = np.minimum(soft[:, j], 1 - p)
        best = votes.argmax(axis=1)
        return best, soft[np.arange(len(best)), best]

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        data, off = text_bytes(texts)
        langs = np.full(len(texts), UNDETERMINED, dtype=object)
        score = np.zeros(len(texts))
        if not self.langs:
            return langs.tolist(), score
        families = sorted({family_of(x) for x in self.langs})
        for i, j in slices(off):
            part = off[i : j + 1]
            decisions = self.decide(data[part[0] : part[-1]], part - part[0])
            family, sure = self.choose(decisions, families, "family:")
            for f, name in enumerate(families):
                members = [x for x in self.langs if family_of(x) == name]
                mine = np.flatnonzero(family == f)
                best, inner = self.choose(decisions[mine], members, "lang:")
                langs[i + mine] = np.array(members, dtype=object)[best]
                score[i + mine] = sure[mine] * inner
        for i, text in enumerate(texts.to_pylist()):
            if not text or not any(map(str.isalpha, text)):
                langs[i], score[i] = UNDETERMINED, 0.0
        return langs.tolist(), score


def fit(
    docs: DataFrame, text_col: str, lang_col: str, id_col: str, sample: int = 3000, bits: int = 16, epochs: int = 4,
    seed: int = 7, most_langs: int = 200,
) -> Model:
    """Train on at most ``sample`` labelled rows of ``docs``, for the ``most_langs`` commonest languages at most."""
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = labelled.groupBy(F.col(lang_col).alias("_lang")).agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.orderBy(F.desc("_n"), "_lang").limit(most_langs)
    langs = counts.agg(F.count(F.lit(1)).alias("k")).scalar()
    place = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(1 << 40)) / float(1 << 40)
    picked = labelled.join(F.broadcast(counts), F.col(lang_col) == F.col("_lang")).where(  # ``most_langs`` rows
        place <= F.lit(float(sample)) / langs / F.col("_n")
    )
    rows = picked.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), place.alias("place"))
    rows = rows.orderBy("place", "text").limit(sample).withColumn("all", F.lit(True))

    def train(table: pd.DataFrame) -> pd.DataFrame:
        table = table.sort_values(["place", "text"])
        data, off = text_bytes(pa.array(table["text"], pa.large_string()))
        rows, lang = features(data, off, bits), table["lang"].to_numpy(object)
        family = np.array([family_of(x) for x in lang], dtype=object)
        out = []

        def machine(labels: np.ndarray, a: str, b: str, prefix: str) -> None:
            use = np.flatnonzero((labels == a) | (labels == b))
            w = train_svm([rows[i] for i in use], np.where(labels[use] == a, 1.0, -1.0), bits, epochs, seed)
            out.append((prefix + a, prefix + b, w.astype("<f4").tobytes()))

        for a, b in combinations(sorted(set(family)), 2):
            machine(family, a, b, "family:")
        for a, b in combinations(sorted(set(lang)), 2):
            if family_of(a) == family_of(b):
                machine(lang, a, b, "lang:")
        out += [(x, "", b"") for x in sorted(set(lang))]
        del rows
        release()
        return pd.DataFrame(out, columns=["a", "b", "w"])

    found = rows.groupBy("all").applyInPandas(train, "a string, b string, w binary").collect()  # the model only
    machines = [r for r in found if r["b"]]
    w = np.array([np.frombuffer(r["w"], "<f4") for r in machines]).reshape(len(machines), (1 << bits) + 1)
    return Model(
        sorted(r["a"] for r in found if not r["b"]), [(r["a"], r["b"]) for r in machines],
        np.asfortranarray(w[:, :-1].T), w[:, -1].astype(float), bits,
    )


def identify(
    docs: DataFrame, model: Model, text_col: str = "text", names: tuple[str, str] = ("lang_pred", "score")
) -> DataFrame:
    """``docs`` with the predicted language and a score from 0 to 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**bits weights per pair, whatever the data
    at = docs.columns.index(text_col)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, score = shared.value.predict(b.column(at))
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*b.schema.names, *names]
            )
        release()

    added = [T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())]
    return docs.mapInArrow(predict, T.StructType([*docs.schema.fields, *added]))


def held_out(id_col: str = "doc_id", folds: int = 5, fold: int = 0):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == fold, F.lit(False))
