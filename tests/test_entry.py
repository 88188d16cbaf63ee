"""The entry file works with and without the optional operators."""

import sys

import __spark_entry__


def test_without_optional_operators(monkeypatch):
    for name in [n for n in sys.modules if n == "corpus_pipeline" or n.startswith("crewlake.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "crewlake.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    found = __spark_entry__.queries()
    assert len(found) > 200 and "timesheet_summary" in found and not any(n.startswith("op") and n[2].isdigit() for n in found) and "pipeline" not in found
    assert set(__spark_entry__.oracle_sql()) <= set(found)
