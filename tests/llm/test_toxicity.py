"""Folding, matching with exceptions, and held-out accuracy of the toxicity lexicon."""

import random

import pytest
from pyspark.sql import functions as F

from urbanloom.llm import catalog, toxicity
from urbanloom.llm.toxicity import Lexicon, Matcher, fold

LABELS = "doc_id long, toxic int"


@pytest.mark.parametrize(("text", "words"), [
    ("Idiot 1D10T ｉｄｉｏｔ іdіоt id​iot", ["idiot"] * 5),
    ("$tupid a$$et 100 5 $$$ word$$$ @t", ["stupid", "asset", "100", "5", "word", "at"]),
    ("über_été straße", ["über", "été", "straße"]),
    (None, []), ("", []), (" \n\t$$", []),
])
def test_fold(text, words):
    assert fold(text) == words


def brute_hits(words, terms, exceptions):
    """Every place of every term, but those inside a place of an exception."""
    def places(items):
        out = []
        for x in items:
            p = x.split(" ")
            out += [(i, i + len(p), x) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
        return out

    shields = places(exceptions)
    return sorted(t for i, j, t in places(terms) if not any(a <= i and j <= b for a, b, _ in shields))


def test_matcher():
    rng = random.Random(5)
    for _ in range(300):
        vocabulary = "a b c d ab".split()
        make = lambda k: " ".join(rng.choices(vocabulary, k=rng.randint(1, k)))
        terms, exceptions = sorted({make(2) for _ in range(3)}), sorted({make(4) for _ in range(rng.randint(0, 4))})
        words = rng.choices(vocabulary, k=rng.randint(0, 30))
        assert sorted(Matcher(terms, exceptions).hits(words)) == brute_hits(words, terms, exceptions)
    assert Matcher([], []).hits(["a"]) == []


def corpus(n=600):
    """A toxic text holds several of the bad words; ``kill`` is bad but in ``kill process``."""
    rng = random.Random(3)
    plain, bad = [f"word{c}{d}" for c in "abcdefgh" for d in "klmnop"], ["awful", "nasty", "kill"]
    docs, labels = [], []
    for i in range(n):
        w, toxic = rng.choices(plain, k=rng.randint(20, 80)), i % 4 == 0
        if toxic:
            for _ in range(4):
                w.insert(rng.randrange(len(w)), rng.choice(bad))
        elif i % 4 == 1:
            at = rng.randrange(len(w))
            w[at:at] = ["kill", "process"]
        docs.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    return docs, labels


def test_learning(documents, llm):
    docs, labels = corpus()
    disguised = [(9000, "wordak nаsty AWFUL k1ll " * 3), (9001, "kill process " * 10), (9002, None), (9003, ""), (9004, "wordak " * 60_000)]
    df = documents(docs + disguised + [(None, "awful nasty")]).withColumn("weight", F.lit("clash")).withColumn("n", F.lit("clash"))
    known = llm.createDataFrame(labels[:480] + labels[:5] + [(None, 1), (7, None)], LABELS)
    made = toxicity.learn(df, known)
    assert {"awful", "nasty", "kill"} <= set(made.terms) and "kill process" in made.exceptions
    found = toxicity.score(df, made)
    assert found.columns == [*df.columns, "score", "hits"]
    got = {r["doc_id"]: r for r in found.collect()}
    assert all((got[i]["score"] >= 0.5) == bool(y) for i, y in labels)
    assert got[9000]["score"] >= 0.5 and set(got[9000]["hits"]) == {"awful", "kill", "nasty"}
    assert [got[i]["score"] < 0.5 for i in (9001, 9002, 9003, 9004)] == [True] * 4 and got[9001]["hits"] == []
    assert got[9002]["score"] == got[9003]["score"] and got[None]["score"] >= 0.5
    assert toxicity.learn(df, known) == made


def test_without_labels_or_rows(documents, llm):
    df = documents([(1, "a b"), (2, None)])
    none = toxicity.learn(df, llm.createDataFrame([], LABELS))
    assert none == Lexicon() and {r["score"] for r in toxicity.score(df, none).collect()} == {0.5}
    one = toxicity.learn(df, llm.createDataFrame([(1, 0), (2, 0)], LABELS))
    assert all(r["score"] < 0.5 for r in toxicity.score(df, one).collect())
    assert toxicity.score(documents([]), none).collect() == []


def test_query_learns_from_training_rows_only(documents, llm, tmp_path):
    docs, labels = corpus()
    documents(docs).write.parquet(f"{tmp_path}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    frame = llm.createDataFrame(labels, LABELS)
    frame.withColumn("quality", F.lit(1)).write.parquet(f"{tmp_path}/labels.parquet")
    got = {r["doc_id"]: tuple(r) for r in catalog.op12_toxicity(llm, str(tmp_path)).collect()}
    assert all(bool(p) == bool(labels[i][1]) and p == (s >= 0.5) for i, _, s, p in got.values())
    assert 0 < sum(h for _, h, _, _ in got.values()) < len(docs) / 2
    # labels of held-out rows change nothing
    frame.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic"))).write.parquet(f"{tmp_path}/b/labels.parquet")
    documents(docs).write.parquet(f"{tmp_path}/b/documents.parquet")
    again = {r["doc_id"]: tuple(r) for r in catalog.op12_toxicity(llm, f"{tmp_path}/b").collect()}
    assert again == got
