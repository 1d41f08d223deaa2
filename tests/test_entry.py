import importlib
import sys

import pytest

import __spark_entry__


def test_entry_has_rows(spark):
    out = __spark_entry__.entry(spark)
    assert out.columns == ["document_id", "same_sentence", "shared_ngrams"] and out.count() > 0


def test_every_oracle_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_without_the_subpackage_the_core_remains(monkeypatch):
    def gone(name):
        raise ModuleNotFoundError("No module", name="lexmill.llm")

    monkeypatch.setattr(__spark_entry__.importlib, "import_module", gone)
    assert set(__spark_entry__.queries()) == set(__spark_entry__._queries.QUERIES)


def test_a_module_that_does_not_import_is_not_passed_over(monkeypatch):
    def broken(name):
        raise ModuleNotFoundError("No module", name="xxhash")

    monkeypatch.setattr(__spark_entry__.importlib, "import_module", broken)
    with pytest.raises(ModuleNotFoundError):
        __spark_entry__.queries()


def test_the_core_does_not_import_the_subpackage():
    from pathlib import Path

    root = Path(__spark_entry__.__file__).parent / "lexmill"
    assert not [p for p in root.rglob("*.py") if "llm" not in p.parts and "lexmill.llm" in p.read_text()]
    assert importlib.import_module("lexmill.plans.queries") and sys.version_info >= (3, 11)
