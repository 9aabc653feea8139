import importlib
import sys

import pytest

import __spark_entry__ as registry


@pytest.mark.parametrize("absent", ["xxhash", "corpus_pipeline", "recordmill.llm.queries"])
@pytest.mark.filterwarnings("ignore:training-data operators")
def test_core_queries_without_what_the_others_need(monkeypatch, absent):
    core = set(importlib.import_module("verification.queries").QUERIES)
    assert core <= set(registry.queries())
    for name in [m for m in sys.modules if m.startswith(("recordmill.llm", "corpus_pipeline"))]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, absent, None)
    assert set(registry.queries()) == core
    assert set(registry.oracle_sql()) <= core
