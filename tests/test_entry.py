"""The list of queries."""

from __future__ import annotations

import importlib
import sys

import pytest

import __spark_entry__ as driver


def test_the_core_problems_are_listed():
    assert {"p1_found", "p3_found", "p5_found", "p6_found", "q_revisit_gaps"} <= driver.queries().keys()
    assert driver.oracle_sql().keys() <= driver.queries().keys()


def test_the_library_works_without_the_text_package(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("skyloom.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "skyloom.llm", None)  # as if it were deleted
    monkeypatch.delitem(sys.modules, "__spark_entry__")
    found = importlib.import_module("__spark_entry__").queries()
    assert "p1_found" in found and "p7_ids" not in found


def test_a_fault_inside_the_text_package_shows(monkeypatch):
    monkeypatch.setitem(sys.modules, "skyloom.llm.queries", None)  # importing it raises ModuleNotFoundError
    package = sys.modules.get("skyloom.llm")
    if package is None:
        pytest.skip("no text package here")
    monkeypatch.delattr(package, "queries", raising=False)
    monkeypatch.delitem(sys.modules, "__spark_entry__")
    with pytest.raises(ImportError):
        importlib.import_module("__spark_entry__")
