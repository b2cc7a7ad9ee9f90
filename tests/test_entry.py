import importlib
import sys

import __spark_entry__


def test_every_query_is_callable_and_sql_belongs_to_one():
    found = __spark_entry__.queries()
    assert found and all(map(callable, found.values()))
    assert set(__spark_entry__.oracle_sql()) <= set(found)


def test_entry_works_without_the_optional_subpackage(monkeypatch):
    for name in [n for n in sys.modules if n.startswith("garimpo.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "garimpo.llm", None)
    module = importlib.reload(__spark_entry__)
    try:
        assert "search_relevance" in module.queries() and not any(n[:2] in ("p1", "p5") for n in module.queries())
    finally:
        monkeypatch.undo()
        importlib.reload(__spark_entry__)
