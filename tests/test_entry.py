"""The registered queries with and without the training-data package."""

import sys

import __spark_entry__ as entry


def test_other_queries_without_the_training_data_package(monkeypatch):
    for name in [m for m in sys.modules if m == "corpus_pipeline" or m.startswith("seqprep.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "seqprep.llm", None)
    found, sql = entry.queries(), entry.oracle_sql()
    assert len(found) >= 206 and "pipeline" not in found
    assert not [n for n in found if n.startswith("op") and n[2:3].isdigit()]
    assert set(sql) <= set(found)


def test_other_queries_without_the_pipeline(monkeypatch):
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    found = entry.queries()
    assert "pipeline" not in found and len(found) >= 206
