"""Quality rules: robust multivariate outliers of text statistics, per language and source.

Every text gives a vector of transformed statistics. Per group of language and source the minimum covariance
determinant (MCD) is approached by concentration steps: start from medians and spreads of several halves, keep the
``share`` of distinct vectors with the smallest Mahalanobis distance, estimate mean and covariance from those, and repeat
until the determinant settles; the lowest one is taken, then one reweighting step. A row whose distance from its group's estimate lies beyond the chi-squared ``cutoff`` is
rejected.

DataFrame functions only. Texts are read once; the vectors (eight numbers a row) are written to the shared folder and
every step is a partial aggregate over them, so a group of any size never meets in one task. Quantiles within the
steps are mergeable sketches.

Defined results: a null text has no words and fails the base rules; a null language or source is a value of its own;
a group with under ``least`` rows shares the estimate of the other small groups of its language, and those under it one
for all; variances have fixed floors, so constant statistics are no outliers; ties of the distance stay together;
repeated rows are judged each,
but equal vectors weigh once in an estimate; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urbanloom.scale import round_table

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
GAP = "[\\x20\\x09-\\x0D]+"
#: smallest standard deviation of each transformed statistic
FLOORS = {"length": 0.25, "word": 0.03, "symbol": 0.06, "line": 0.08, "repeat": 0.12}
STATS = list(FLOORS)


def chi2_cdf(x: float, df: int) -> float:
    """Chi-squared distribution function by the series of the incomplete gamma function."""
    if x <= 0:
        return 0.0
    a, z = df / 2, x / 2
    term = total = 1 / a
    k = 0
    while term > 1e-16 * total:
        k += 1
        term *= z / (a + k)
        total += term
    return total * math.exp(a * math.log(z) - z - math.lgamma(a))


def chi2_quantile(p: float, df: int) -> float:
    low, high = 0.0, 20.0 * df + 200
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, df) < p else (low, mid)
    return high


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_words(words: Column, n: int = 5) -> Column:
    """Words that lie in a window of ``n`` words found twice or more in the same list."""

    def grams(hashes: Column) -> Column:
        heads = F.slice(hashes, 1, F.greatest(F.lit(0), F.size(hashes) - (n - 1)))
        return F.transform(heads, lambda x, i: F.xxhash64(x, *[F.get(hashes, i + k) for k in range(1, n)]))

    def covered(sorted_grams: Column) -> Column:
        def twin(x: Column, k: Column) -> Column:
            before = F.get(sorted_grams, k - 1)["h"] == x["h"]
            after = F.get(sorted_grams, k + 1)["h"] == x["h"]
            return F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False))

        places = F.array_sort(F.transform(F.filter(sorted_grams, twin), lambda x: x["i"]))
        return _let(places, lambda p: F.aggregate(
            F.transform(p, lambda x, k: F.least(F.lit(n), F.coalesce(F.get(p, k + 1) - x, F.lit(n)))),
            F.lit(0), lambda a, b: a + b,
        ))

    def count(g: Column) -> Column:
        placed = F.array_sort(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(g)) < F.size(g), _let(placed, covered)).otherwise(F.lit(0))

    return _let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: _let(grams(h), count)).cast("long")


def text_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words``."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    bare = F.translate(text, SPACES, "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, SPACES, "") != "")
    words = F.array_remove(F.split(text, GAP), "")
    return docs.withColumns({
        "n_words": F.size(words).cast("long"),
        "word_chars": F.char_length(bare).cast("long"),
        "n_symbols": (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeated_words(words),
    })


def vectors(stats: DataFrame) -> DataFrame:
    """``stats`` with the transformed statistics. Shares are damped by a page of about 50 ordinary words, so that the
    chance deviations of short texts stay small."""
    mean = stats.agg((F.sum("word_chars") / F.greatest(F.sum("n_words"), F.lit(1))).alias("m")).scalar()
    pad = F.lit(50.0)
    return stats.withColumns({
        "length": F.log1p("n_words"),
        "word": F.log((F.col("word_chars") + 2 * pad * mean) / (F.col("n_words") + 2 * pad)),
        "symbol": F.sqrt(F.col("n_symbols") / (F.col("word_chars") + 6 * pad)),
        "line": F.sqrt(10 * F.col("n_dup_lines") / (F.col("n_words") + pad)),
        "repeat": F.sqrt(F.col("n_repeat_words") / (F.col("n_words") + pad)),
    })


def _factored(moments: DataFrame, scale: float) -> DataFrame:
    """Mean columns ``m_*``, Cholesky columns ``l_i_j`` and the log determinant from ``m_*`` and ``c_i_j``."""
    out = moments
    for i, a in enumerate(STATS):
        for j in range(i):
            dot = sum((F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}") for k in range(j)), F.lit(0.0))
            out = out.withColumn(f"l_{i}_{j}", (F.col(f"c_{i}_{j}") * scale - dot) / F.col(f"l_{j}_{j}"))
        dot = sum((F.col(f"l_{i}_{k}") * F.col(f"l_{i}_{k}") for k in range(i)), F.lit(0.0))
        floor = FLOORS[a] ** 2
        # the floor is added, so the matrix stays positive definite
        out = out.withColumn(f"l_{i}_{i}", F.sqrt(F.greatest(F.col(f"c_{i}_{i}") * scale + floor - dot, F.lit(floor / 4))))
    logdet = sum((F.log(F.col(f"l_{i}_{i}")) for i in range(len(STATS))), F.lit(0.0)) * 2
    names = ["key", *[f"m_{a}" for a in STATS], *[f"l_{i}_{j}" for i in range(len(STATS)) for j in range(i + 1)]]
    return out.select(*names, logdet.alias("logdet"))


def _moments(rows: DataFrame) -> DataFrame:
    return rows.groupBy("key").agg(
        *[F.avg(a).alias(f"m_{a}") for a in STATS],
        *[F.covar_pop(a, STATS[j]).alias(f"c_{i}_{j}") for i, a in enumerate(STATS) for j in range(i + 1)],
    )


def _distances(rows: DataFrame, estimate: DataFrame) -> DataFrame:
    """``rows`` with the squared Mahalanobis distance from their group's estimate."""
    out = rows.join(estimate, "key")
    for i, a in enumerate(STATS):
        dot = sum((F.col(f"l_{i}_{k}") * F.col(f"z_{k}") for k in range(i)), F.lit(0.0))
        out = out.withColumn(f"z_{i}", (F.col(a) - F.col(f"m_{a}") - dot) / F.col(f"l_{i}_{i}"))
    squares = sum((F.col(f"z_{i}") * F.col(f"z_{i}") for i in range(len(STATS))), F.lit(0.0))
    return out.select(*rows.columns, squares.alias("distance"))


#: halves of a group that a search starts from: the middle one, the lower one, the shortest one of each statistic
STARTS = ("middle", "lower", "shortest")


def _start(quantiles: Column, start: str) -> Column:
    """``(centre, spread)`` of one half of a statistic, from its 21 quantiles 0, 0.05, ... 1."""
    width = [quantiles[i + 10] - quantiles[i] for i in range(11)]
    half = lambda i: F.struct(quantiles[i + 5].alias("centre"), (width[i] / 1.349).alias("spread"))
    if start == "shortest":
        return F.array_min(F.array(*[F.struct(width[i].alias("width"), half(i).alias("half")) for i in range(11)]))["half"]
    return half({"middle": 5, "lower": 0}[start])


def mcd(rows: DataFrame, share: float = 0.5, steps: int = 12, tolerance: float = 1e-3, accuracy: int = 5000) -> DataFrame:
    """Estimates per ``key`` of ``rows`` (columns ``key`` and the statistics): one row per key.

    Equal vectors count once, so copies have no weight of their own. Every start is a search by itself; the lowest
    determinant wins. Stops when no log determinant moves by more than ``tolerance``, or after ``steps`` steps.
    """
    p = len(STATS)
    rows = round_table(rows.select("key", *STATS).distinct())
    grid = [i / 20 for i in range(21)]
    middle = rows.groupBy("key").agg(*[F.percentile_approx(a, grid, accuracy).alias(a) for a in STATS])
    tried = F.explode(F.array(*[F.struct(
        F.concat(F.lit(f"{k}|"), "key").alias("key"), *[_start(F.col(a), start).alias(a) for a in STATS]
    ) for k, start in enumerate(STARTS)])).alias("_start")
    start = middle.select(tried).select("_start.*").select(
        "key", *[F.col(a)["centre"].alias(f"m_{a}") for a in STATS],
        *[(F.pow(F.col(a)["spread"], 2) if i == j else F.lit(0.0)).alias(f"c_{i}_{j}")
          for i, a in enumerate(STATS) for j in range(i + 1)],
    )
    estimate = round_table(_factored(start, 1.0))
    every = rows.withColumn("key", F.explode(F.array(*[F.concat(F.lit(f"{k}|"), "key") for k in range(len(STARTS))])))
    kept_scale = share / chi2_cdf(chi2_quantile(share, p), p + 2)
    for _ in range(steps):
        far = _distances(every, estimate)
        cut = far.groupBy("key").agg(F.percentile_approx("distance", share, accuracy).alias("cut"))
        inner = far.join(cut, "key").where("distance <= cut")
        nxt = round_table(_factored(_moments(inner), kept_scale))
        moved = nxt.join(estimate.select("key", F.col("logdet").alias("was")), "key").agg(
            F.max(F.abs(F.col("logdet") - F.col("was"))).alias("d")).first()["d"]
        estimate = nxt
        if moved is None or moved <= tolerance:
            break
    found = F.struct(*[c for c in estimate.columns if c != "key"])
    best = estimate.groupBy(F.substring("key", 3, 1 << 30).alias("key")).agg(F.min_by(found, F.struct("logdet", "key")).alias("e"))
    estimate = round_table(best.select("key", "e.*"))
    weight = 0.975
    near = _distances(rows, estimate).where(F.col("distance") <= chi2_quantile(weight, p))
    final = _factored(_moments(near), weight / chi2_cdf(chi2_quantile(weight, p), p + 2))
    return final.unionByName(estimate.join(final.select("key"), "key", "left_anti"))  # no row near: the step before


def judge(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
    cutoff: float = 0.999, least: int = 50, share: float = 0.5,
) -> DataFrame:
    """``(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, distance, kept)`` per row."""
    base = docs.select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"),
        F.col(source_col).cast("string").alias("source"),
    )
    stats = text_statistics(base).drop("text")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    stats = round_table(stats.withColumn("base_failed", failed))
    rows = vectors(stats)
    part = {c: F.coalesce(F.concat(F.length(c), F.lit(":"), F.col(c)), F.lit("-")) for c in ("lang", "source")}
    both, lang = F.concat(F.lit("s|"), part["lang"], F.lit("|"), part["source"]), F.concat(F.lit("l|"), part["lang"])
    good = rows.where(~F.col("base_failed"))
    big = good.groupBy(both.alias("key")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("key")
    tagged = rows.withColumns({"_both": both, "_lang": lang})
    tagged = tagged.join(big.select(F.col("key").alias("_big")), F.col("_both") == F.col("_big"), "left")
    pooled = tagged.where(F.col("_big").isNull() & ~F.col("base_failed")).groupBy("_lang").agg(F.count(F.lit(1)).alias("n"))
    pooled = pooled.where(F.col("n") >= least).select(F.col("_lang").alias("_pool"))
    tagged = tagged.join(pooled, F.col("_lang") == F.col("_pool"), "left").withColumn(
        "key", F.coalesce("_big", "_pool", F.lit("all"))
    )
    columns = ["id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    table = round_table(tagged.select(*columns, "key", *STATS))
    sound = table.where(~F.col("base_failed"))
    estimate = mcd(sound.select("key", *STATS), share)
    seen = _distances(sound, estimate).select(*columns, "distance")
    out = seen.unionByName(table.where("base_failed").select(*columns, F.lit(None).cast("double").alias("distance")))
    limit = chi2_quantile(cutoff, len(STATS))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("distance") <= limit)).withColumnRenamed("id", id_col)
