"""Language identification, quality classifier and quality rules: held-out accuracy and defined cases."""

import math
import random
from collections import Counter

import pytest
from cases import WORD, texts
from pyspark.sql import functions as F

from urbanloom.llm import language_id, quality_classifier, quality_rules

SYLLABLES = {
    "en": ["th", "ing", "er", "the", "wh", "ou", "ly"], "de": ["sch", "ung", "ein", "pf", "keit", "zu", "ü"],
    "fr": ["eau", "oi", "é", "tion", "que", "ê", "ou"], "es": ["ción", "ñ", "rr", "ado", "ll", "ue", "ja"],
}


def prose(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def corpus(seed=5, n=240):
    rng = random.Random(seed)
    return [(i, prose(rng, lang, rng.randint(5, 60)), lang, f"s{i % 3}") for i in range(n) for lang in [list(SYLLABLES)[i % 4]]]


def test_language(documents):
    rows = corpus()
    df = documents(rows).withColumn("score", F.lit(3))
    learn = df.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    model = language_id.fit(learn, "text", "lang", "doc_id", sample=150)
    assert {family for p in model.pairs for family in p if family.startswith("family:")} == {"family:germanic", "family:romance"}
    extra = [(900, None), (901, ""), (902, "12 -- 34 !"), (903, "sch"), (None, prose(random.Random(1), "de", 30)), (904, prose(random.Random(2), "fr", 20_000))]
    full = df.unionByName(documents([(*r, None, None) for r in extra]).withColumn("score", F.lit(3)))
    got = {r["doc_id"]: r for r in language_id.identify(full, model, names=("guess", "sure")).collect()}
    held = [r for r in rows if got[r[0]]]
    assert sum(got[r[0]]["guess"] == r[2] for r in held) >= 0.98 * len(held)
    assert [got[i]["guess"] for i in (900, 901, 902)] == ["und"] * 3 and got[900]["sure"] == 0
    assert got[None]["guess"] == "de" and got[904]["guess"] == "fr"
    assert all(0 <= r["sure"] <= 1 for r in got.values())
    assert language_id.held_out().alias("h") is not None


def test_language_without_examples(documents):
    model = language_id.fit(documents([(1, "abc", None, None)]), "text", "lang", "doc_id")
    got = language_id.identify(documents([(1, "abc")]), model).first()
    assert got["lang_pred"] == "und" and got["score"] == 0
    one = language_id.fit(documents([(1, "abc", "en", "s"), (2, "abd", "en", "s")]), "text", "lang", "doc_id")
    got = language_id.identify(documents([(1, "abc")]), one).first()
    assert got["lang_pred"] == "en" and got["score"] == 1
    assert language_id.identify(documents([]), one).count() == 0


def test_quality_classifier(llm, documents):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(300):
        text, good = prose(rng, "en", rng.randint(20, 80)), i % 3
        if good == 0:
            text = " ".join(f"{w.upper()}!!" for w in text.split())
        rows.append((i, text))
        labels.append((i, int(good > 0), None))
    labels += [(5000, 1, 0), (7, None, 0)]
    marks = llm.createDataFrame(labels, "doc_id long, quality int, toxic int")
    df = documents([*rows, (600, None), (601, ""), (None, "THE!! END!!")])
    crc = F.crc32(F.col("doc_id").cast("string")) % 3
    weights = quality_classifier.fit(df, marks.where(crc != 1), sample=150, bits=14)
    got = {r["doc_id"]: r["score"] for r in quality_classifier.score(df, weights).collect()}
    import zlib

    held = [(got[i], q) for i, q, _ in labels[:300] if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum((s >= 0.5) == bool(q) for s, q in held) >= 0.97 * len(held)
    assert got[600] == got[601] and got[None] < 0.5
    blank = quality_classifier.fit(df, marks.limit(0), bits=14)
    assert {r["score"] for r in quality_classifier.score(df, blank).collect()} == {0.5}
    assert quality_classifier.score(documents([]), weights).count() == 0


def test_text_statistics(documents):
    rows = texts(7) + [(3000, "a b c d e\na b c d e\n\n \na b c d e x"), (3001, "#*$%&|<> a#"), (3002, "x " * 5000)]
    got = {r["doc_id"]: r for r in quality_rules.text_statistics(documents(rows)).collect()}
    for i, t in rows:
        t = t or ""
        w = WORD.findall(t)
        grams = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        again = [False] * len(w)
        for k in range(len(w) - 4):
            if grams[tuple(w[k : k + 5])] > 1:
                again[k : k + 5] = [True] * 5
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), sum(again))
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, (i, t[:80])


def test_rules_reject_outliers_only(documents):
    rng = random.Random(8)
    rows = [(i, prose(rng, lang or "en", rng.randint(20, 300)), lang, src) for i in range(400)
            for lang, src in [(rng.choice(["en", "de", None]), rng.choice(["s", "s", None]))]]
    odd = [(1000 + i, " ".join(w + "***" for w in prose(rng, "en", 80).split()), "en", "s") for i in range(20)]
    few = [(2000, "one two", "en", "s"), (2001, None, "en", "s"), (2002, "word " * 60, "xx", "rare"), (2003, prose(rng, "fr", 60), "fr", "rare")]
    got = {r["doc_id"]: r for r in quality_rules.judge(documents(rows + odd + few)).collect()}
    assert len(got) == 424
    assert all(got[r[0]]["kept"] for r in rows)
    assert not any(got[r[0]]["kept"] or got[r[0]]["base_failed"] for r in odd)
    assert all(got[i]["base_failed"] and not got[i]["kept"] for i in (2000, 2001, 2002))
    assert quality_rules.judge(documents([])).count() == 0


def test_a_third_of_junk_copies_does_not_mask_itself(documents):
    rng = random.Random(8)
    rows = [(i, prose(rng, "en", rng.randint(20, 300)), "en", "s") for i in range(400)]
    junk = " ".join(w + "***" if k % 3 == 0 else w for k, w in enumerate(prose(rng, "en", 120).split()))
    copies = [(1000 + i, junk, "en", "s") for i in range(205)]
    near = [(2000 + i, junk + " " + prose(rng, "en", 1 + i % 9), "en", "t") for i in range(200)]
    other = [(3000 + i, prose(rng, "en", rng.randint(20, 300)), "en", "t") for i in range(400)]
    got = {r["doc_id"]: r for r in quality_rules.judge(documents(rows + copies + near + other)).collect()}
    assert not any(got[r[0]]["kept"] or got[r[0]]["base_failed"] for r in copies + near)
    assert sum(got[r[0]]["kept"] for r in rows + other) >= 0.99 * 800


def test_estimate_matches_plain_moments_on_clean_data(llm):
    rng = random.Random(9)
    rows = [("k", *[rng.gauss(0, 3) for _ in quality_rules.STATS]) for _ in range(3000)]
    df = llm.createDataFrame(rows, "key string, " + ", ".join(f"{s} double" for s in quality_rules.STATS)).cache()
    got = quality_rules.mcd(df).first()
    assert all(abs(got[f"m_{s}"]) < 0.3 for s in quality_rules.STATS)
    assert all(abs(got[f"l_{i}_{i}"] - 3) < 0.3 for i in range(5))


@pytest.mark.parametrize(("p", "df", "x"), [(0.95, 1, 3.8415), (0.975, 5, 12.8325), (0.5, 7, 6.3458)])
def test_chi_squared(p, df, x):
    assert math.isclose(quality_rules.chi2_quantile(p, df), x, rel_tol=1e-4)
    assert math.isclose(quality_rules.chi2_cdf(x, df), p, rel_tol=1e-4)
