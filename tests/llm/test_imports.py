"""Only a missing subpackage hides its queries; a missing library is an error."""

import sys

import pytest

import __spark_entry__ as entry


def test_missing_library_is_raised(monkeypatch):
    import gridloom.llm

    monkeypatch.delitem(sys.modules, "gridloom.llm.queries", raising=False)
    monkeypatch.delattr(gridloom.llm, "queries", raising=False)
    monkeypatch.delitem(sys.modules, "gridloom.llm.packing", raising=False)
    monkeypatch.delattr(gridloom.llm, "packing", raising=False)
    monkeypatch.setitem(sys.modules, "numpy", None)
    with pytest.raises(ImportError):
        entry.queries()
