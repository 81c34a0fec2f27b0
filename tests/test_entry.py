"""The driver contract in __spark_entry__.py."""

import importlib.util
import os

from fleetspark.catalog import ORACLES, QUERIES, load_all

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _entry_module():
    spec = importlib.util.spec_from_file_location("spark_entry", os.path.join(ROOT, "__spark_entry__.py"))
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    return mod


def test_entry_contract(spark):
    mod = _entry_module()
    df = mod.entry(spark)
    assert df.columns == ["snapshot", "line"]
    assert df.count() > 0
    q, o = mod.queries(), mod.oracle_sql()
    load_all()
    assert set(QUERIES) <= set(q) and set(ORACLES) <= set(o) <= set(q) and len(QUERIES) >= 100
    assert all(callable(f) for f in q.values()) and all(isinstance(s, str) and s.strip() for s in o.values())
