"""The entry points stand without the folders that may be taken away."""

import importlib
import sys


def test_queries_without_the_corpus_operators(monkeypatch):
    import __spark_entry__ as entry

    full = entry.queries()
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    try:
        bare = importlib.reload(entry)
        assert not any(n.startswith("op") and n[2].isdigit() for n in bare.queries())
        assert set(bare.oracle_sql()) <= set(bare.queries()) <= set(full)
    finally:
        monkeypatch.undo()
        importlib.reload(entry)


def test_workers_find_the_package_from_another_folder(spark, monkeypatch, tmp_path):
    from urbanloom.scale import ship_package

    monkeypatch.chdir(tmp_path)
    ship_package(spark)

    def names(batches):
        import urbanloom.scale

        for b in batches:
            yield b.assign(id=len(urbanloom.scale.__name__))

    assert spark.range(2).mapInPandas(names, "id long").first()["id"] == len("urbanloom.scale")
