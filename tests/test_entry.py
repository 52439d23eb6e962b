import importlib
import importlib.util
import sys

import newsloom.plans


def test_entry_without_the_subpackage(monkeypatch, spark):
    real = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda name, *a: None if name == "newsloom.llm" else real(name, *a))
    sys.modules.pop("__spark_entry__", None)
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.queries()) == set(newsloom.plans.QUERIES) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns[0] == "user_id"
    sys.modules.pop("__spark_entry__", None)
