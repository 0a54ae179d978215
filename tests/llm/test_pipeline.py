"""The pipeline's stages against brute force, and its registration."""

import random
from collections import Counter, defaultdict

import corpus_pipeline
from cases import WORD
from pyspark.sql import functions as F
from test_dedup import fold, near_classes

from urbanloom.llm import catalog, mixing, packing


def corpus():
    rng = random.Random(21)
    vocabulary = ["".join(rng.choice(["the", "ing", "wh", "er", "ly", "ou"]) for _ in range(3)) for _ in range(3000)]
    rows = []
    for i in range(120):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([3, 40, 120]))]
        rows.append((i, " ".join(words), "en", f"s{i % 4}"))
        if i % 10 == 0:
            rows.append((500 + i, " ".join(words).upper(), "en", "s1"))
        if i % 10 == 5 and len(words) > 100:
            words[4] = "changed"
            rows.append((700 + i, " ".join(words), "en", None))
    return [*rows, (900, None, "en", "s0"), (901, "12 !? 3", None, "s0"), (902, "", "en", None), (903, "word " * 3000, "en", "s2")]


def test_stages(llm, documents, tmp_path):
    rows = corpus()
    docs = documents(rows).withColumn("lang_pred", F.lit("clash")).withColumn("gone", F.lit(1))
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = str(tmp_path / name.replace(" ", "-"))
        stage(llm, docs, str(tmp_path)).write.parquet(out)
        docs = llm.read.parquet(out)
        seen[name] = docs
        assert name == "packing" or docs.columns == columns
    ids = {k: sorted(r["doc_id"] for r in d.select("doc_id").collect()) for k, d in seen.items()}
    text = {r[0]: r[1] for r in rows}
    assert ids["language ID"] == sorted(set(text) - {900, 901, 902})
    groups = defaultdict(list)
    for i in ids["language ID"]:
        groups[fold(text[i])].append(i)
    assert ids["exact dedup"] == sorted(max(g) for g in groups.values())
    classes = near_classes([(i, text[i]) for i in ids["exact dedup"]], 0.05)
    assert ids["near-dedup"] == sorted(set(classes.values()))
    assert len(ids["near-dedup"]) < len(ids["exact dedup"]) < len(ids["language ID"])
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(seen["near-dedup"]).collect() if r["taken"]}
    drawn = Counter()
    for r in seen["mixing"].collect():
        drawn[r["doc_id"]] += len(WORD.findall(r["text"]))
        assert text[r["doc_id"]].startswith(r["text"])
    assert dict(drawn) == taken
    tokens = Counter()
    encoder = packing.TextEncoder(catalog_tokenizer())
    for r in seen["mixing"].collect():
        tokens[r["doc_id"]] += len(encoder.plain(r["text"])) + 1
    pieces = Counter()
    for r in seen["packing"].collect():
        pieces[r["doc_id"]] += r["length"]
    assert pieces == tokens


def catalog_tokenizer():
    import public_tokenizers

    return public_tokenizers.path(packing.TOKENIZER_FILE)


def test_run_takes_an_empty_table(llm, documents, tmp_path):
    documents([]).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(llm, str(tmp_path)).count() == 0


def test_one_query_per_operator():
    import __spark_entry__

    names = list(catalog.QUERIES)
    assert [int(n.split("_")[0][2:]) for n in names] == list(range(1, 14))
    assert {*names, "pipeline"} <= set(__spark_entry__.queries())
    assert set(catalog.ORACLE_SQL) <= set(names)
