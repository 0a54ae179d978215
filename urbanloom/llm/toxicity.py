"""Toxicity by a weighted lexicon, matched by Aho-Corasick in folded text, with exception phrases.

Folding makes disguised spellings equal: compatibility forms and lower case, letters of other scripts that look Latin,
characters without width, and digits or signs that stand for letters inside a word. A folded text is its words with
one space between; terms and phrases are matched as whole words, all in one pass over the text. A term inside an
exception phrase does not count. The weights of the terms that do are summed and set against the number of words; a
logistic function of both gives the score.

The lexicon is learned from a bounded, seeded sample of labelled rows (``sample``), equal texts once: terms whose
log-odds between toxic and clean texts exceed their standard error ``z`` times. A phrase of a term and its neighbour
becomes an exception where it is toxic clearly less often than the term elsewhere. The counts are Spark aggregates; the
driver gets the lexicon, and two numbers per sampled row. Scoring reads every text whole, once, without a shuffle.

Defined results: a null or empty text has no terms and gets the score of such texts; without labelled rows every score
is 0.5, with labels of one kind only it is that kind's smoothed share; null labels and null ids are not learned from;
repeated rows are scored alike; an empty table gives an empty result. New columns must not clash (``blocks.fresh``).
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from urbanloom.scale import round_table

from .blocks import fresh

# fixed values: letters of other scripts that look like Latin ones, after lower-casing
LOOKALIKE = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "һ": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m",
    "о": "o", "р": "p", "с": "c", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ɩ": "i",
}
# fixed values: characters without width
HIDDEN = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
# fixed values: digits and signs that stand for letters
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b"}
SIGNS = {"$": "s", "@": "a"}

_LETTERS = str.maketrans(LOOKALIKE | dict.fromkeys(HIDDEN, ""))
_DIGITS = str.maketrans(DIGITS)
_SIGNS = re.compile(r"[$@]+(?=[^\W\d_])")
_SIGN_TABLE = str.maketrans(SIGNS)
_WORD = re.compile(r"[^\W_]+")


def fold(text: str | None) -> list[str]:
    """Words of a text as they are compared."""
    text = text or ""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text).lower().translate(_LETTERS)
    else:
        text = text.lower()
    if "$" in text or "@" in text:  # only before a letter; a trailing sign is no letter
        text = _SIGNS.sub(lambda m: m[0].translate(_SIGN_TABLE), text)
    return [w if w.isalpha() or w.isdigit() else w.translate(_DIGITS) for w in _WORD.findall(text)]


@dataclass
class Lexicon:
    """Weights of folded terms (one or more words), phrases that excuse a term inside them, and the score's terms."""

    terms: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    bias: float = 0.0
    density: float = 0.0  # coefficient of the weight per word
    amount: float = 0.0  # coefficient of the summed weight

    def logit(self, weight: np.ndarray, words: np.ndarray) -> np.ndarray:
        per_word, summed = features(weight, words)
        return self.bias + self.density * per_word + self.amount * summed


def features(weight: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.log(weight / (words + 10) + 1e-3), np.log1p(weight)


class Matcher:
    """Terms of a folded text that no exception covers."""

    def __init__(self, terms: list[str], exceptions: list[str]) -> None:
        self.machine = ahocorasick.Automaton()
        kinds: dict[str, list] = {}
        for t in terms:
            kinds.setdefault(f" {t} ", [None, False])[0] = t
        for e in exceptions:
            kinds.setdefault(f" {e} ", [None, False])[1] = True
        for pattern, (term, excuses) in kinds.items():
            self.machine.add_word(pattern, (len(pattern), term, excuses))
        self.some = bool(kinds)
        if self.some:
            self.machine.make_automaton()

    def hits(self, words: list[str]) -> list[str]:
        if not self.some or not words:
            return []
        found, shields = [], []
        for end, (length, term, excuses) in self.machine.iter(f" {' '.join(words)} "):
            if term is not None:
                found.append((end - length, end, term))
            if excuses:
                shields.append((end - length, end))
        if shields:
            # shields come by end; for each hit the first that ends at or after it decides with its start
            ends = [s[1] for s in shields]
            first = np.minimum.accumulate([s[0] for s in reversed(shields)])[::-1]  # smallest start from here on
            at = np.searchsorted(ends, [h[1] for h in found])
            found = [h for h, k in zip(found, at, strict=True) if k == len(ends) or first[k] > h[0]]
        return [h[2] for h in found]


def _lists(table: pa.RecordBatch, name: str) -> Iterator[list[str]]:
    return (text.split(" ") if text else [] for text in table.column(name).to_pylist())


def _sampled(docs: DataFrame, labels: DataFrame, text_col: str, id_col: str, label_col: str, sample: int, seed: int) -> DataFrame:
    """``(toxic, words)`` of the sampled rows, folded, equal texts once per label."""
    chosen = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("_lid"), (F.col(label_col).cast("double") > 0).alias("toxic"), F.xxhash64(F.lit(seed), F.col(id_col)).alias("place")
    ).orderBy("place", "_lid", "toxic").limit(sample)
    texts = docs.select(F.col(id_col).alias("_did"), F.col(text_col).cast("string").alias("text"))
    rows = texts.join(F.broadcast(chosen), F.col("_did") == F.col("_lid")).select("toxic", "text")  # at most ``sample`` short rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = pa.array([" ".join(fold(t)) for t in b.column("text").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([b.column("toxic"), words], ["toxic", "words"])

    return rows.mapInArrow(run, "toxic boolean, words string").dropDuplicates()


def _counted(rows: DataFrame, found) -> DataFrame:
    """``(item, toxic, clean)``: texts of both kinds in which ``found(words)`` gives the item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            toxic, items = [], []
            for y, words in zip(b.column("toxic").to_pylist(), _lists(b, "words"), strict=True):
                own = set(found(words))
                items += own
                toxic += [y] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(toxic, pa.bool_())], ["item", "y"])

    return rows.mapInArrow(run, "item string, y boolean").groupBy("item").agg(
        F.count_if("y").alias("toxic"), F.count_if(~F.col("y")).alias("clean")
    )


def _log_odds(a: Column, b: Column, c: Column, d: Column) -> tuple[Column, Column]:
    """Logarithm of the odds ratio of ``a : b`` against ``c : d``, smoothed, and its standard error."""
    a, b, c, d = (x + 0.5 for x in (a, b, c, d))
    return F.log(a / b) - F.log(c / d), F.sqrt(1 / a + 1 / b + 1 / c + 1 / d)


def learn(
    docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "toxic",
    sample: int = 20_000, z: float = 3.3, least: int = 3, seed: int = 12,
) -> Lexicon:
    """Lexicon from at most ``sample`` labelled rows; a term stands in at least ``least`` toxic texts."""
    rows = round_table(_sampled(docs, labels, text_col, id_col, label_col, sample, seed))
    n = rows.agg(F.count_if("toxic").alias("toxic"), F.count_if(~F.col("toxic")).alias("clean")).first()
    if not n["toxic"] or not n["clean"]:
        return Lexicon(bias=math.log((n["toxic"] + 0.5) / (n["clean"] + 0.5)))
    share = {"toxic": F.lit(n["toxic"]), "clean": F.lit(n["clean"])}

    def weighed(counts: DataFrame, cut: float) -> dict[str, float]:
        w, error = _log_odds(F.col("toxic"), F.col("clean"), share["toxic"] - F.col("toxic"), share["clean"] - F.col("clean"))
        return dict(counts.where(F.col("toxic") >= least).select("item", w.alias("w"), error.alias("e")).where(
            F.col("w") > cut * F.col("e")
        ).select("item", "w").collect())

    known = set(weighed(_counted(rows, lambda words: words), z / 2))  # with exceptions a term may still rise

    def neighbours(words: list[str]) -> Iterator[str]:
        for i, w in enumerate(words):
            if w in known:
                yield f"{w}\t{w}"
                if i:
                    yield f"{w}\t{words[i - 1]} {w}"
                if i + 1 < len(words):
                    yield f"{w}\t{w} {words[i + 1]}"

    pairs = _counted(rows, neighbours).select(F.split("item", "\t").alias("s"), "toxic", "clean")
    pairs = round_table(pairs.select(F.col("s")[0].alias("term"), F.col("s")[1].alias("item"), "toxic", "clean"))
    whole = pairs.where("term = item").select("term", F.col("toxic").alias("t"), F.col("clean").alias("c"))
    odds, error = _log_odds(F.col("toxic"), F.col("clean"), F.col("t") - F.col("toxic"), F.col("c") - F.col("clean"))
    excused = pairs.where("term <> item").join(whole, "term").where(
        (F.col("clean") >= least) & (F.col("clean") > F.col("toxic")) & (odds < -z * error)
    )
    exceptions = sorted(r["item"] for r in excused.select("item").distinct().collect())
    matcher = _Once(sorted(known), exceptions)
    terms = weighed(_counted(rows, lambda words: matcher.get().hits(words)), z)
    made = Lexicon(terms, exceptions)
    sums = np.array(
        [tuple(r) for r in _summed(rows, made, "words", True).select(F.col("toxic").cast("double"), "weight", "n").collect()]
    )  # two numbers and a label per sampled row
    made.bias, made.density, made.amount = _logistic(np.stack(features(sums[:, 1], sums[:, 2]), axis=1), sums[:, 0])
    return made


class _Once:
    """A matcher that is built where it is used, once per worker."""

    def __init__(self, terms: list[str], exceptions: list[str]) -> None:
        self.parts, self.made = (terms, exceptions), None

    def get(self) -> Matcher:
        self.made = self.made or Matcher(*self.parts)
        return self.made

    def __getstate__(self):
        return {"parts": self.parts, "made": None}


def _logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-2, steps: int = 50) -> tuple[float, float, float]:
    """Bias and two coefficients by Newton's method on standardised columns."""
    mean, width = x.mean(axis=0), x.std(axis=0) + 1e-9
    rows = np.column_stack([np.ones(len(x)), (x - mean) / width])
    w = np.zeros(3)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(rows @ w, -30, 30)))
        step = np.linalg.solve((rows * (p * (1 - p))[:, None]).T @ rows + l2 * np.eye(3), rows.T @ (p - y) + l2 * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    w[1:] /= width
    return float(w[0] - w[1:] @ mean), float(w[1]), float(w[2])


def _summed(docs: DataFrame, lexicon: Lexicon, text_col: str, is_folded: bool = False, names=("weight", "n", "hits")) -> DataFrame:
    """``docs`` with the summed weight, the number of words, and the different terms found."""
    shared = docs.sparkSession.sparkContext.broadcast((lexicon.terms, lexicon.exceptions))  # as large as the lexicon
    at = docs.columns.index(text_col)
    kinds = (T.DoubleType(), T.LongType(), T.ArrayType(T.StringType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, exceptions = shared.value
        matcher = Matcher(list(weights), exceptions)
        for b in batches:
            weight, n, hits = [], [], []
            for text in b.column(at).to_pylist():
                words = (text.split(" ") if text else []) if is_folded else fold(text)
                found = matcher.hits(words)
                weight.append(math.fsum(weights[t] for t in found))
                n.append(len(words))
                hits.append(sorted(set(found)))
            new = [pa.array(weight, pa.float64()), pa.array(n, pa.int64()), pa.array(hits, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], [*b.schema.names, *names])

    fields = [T.StructField(c, k) for c, k in zip(names, kinds, strict=True)]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *fields]))


def score(docs: DataFrame, lexicon: Lexicon, text_col: str = "text", names: tuple[str, str] = ("score", "hits")) -> DataFrame:
    """``docs`` with a score from 0 to 1 and the different terms found, in columns whose names must be new."""
    w, n = fresh(docs, "_weight"), fresh(docs, "_n")
    found = _summed(docs, lexicon, text_col, names=(w, n, names[1]))
    per_word = F.log(F.col(w) / (F.col(n) + 10) + 1e-3)
    logit = F.lit(lexicon.bias) + F.lit(lexicon.density) * per_word + F.lit(lexicon.amount) * F.log1p(w)
    kept = [F.col(f"`{c}`") for c in docs.columns]
    return found.select(*kept, (1 / (1 + F.exp(-logit))).alias(names[0]), names[1])
