"""The driver contract."""

import re
from pathlib import Path

import pytest

import __spark_entry__ as entry

DATA = Path("/root/testdata/sf0.001")


def test_registry_is_consistent():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and all(callable(f) for f in q.values()) and all(isinstance(s, str) for s in o.values())


def test_only_the_entry_guards_the_training_package():
    root = Path(entry.__file__).parent / "roostwright"
    users = [p for p in root.rglob("*.py") if "llm" not in p.parts and re.search(r"import.*\bllm\b|from.*\bllm\b", p.read_text())]
    assert not users


@pytest.mark.skipif(not DATA.exists(), reason="driver tables are not here")
def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["ordinal", "url", "price", "rooms", "sqm", "area"]
    prices = [r.price for r in df.collect()]
    assert prices == sorted(prices)
