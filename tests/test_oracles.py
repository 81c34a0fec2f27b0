"""Every registered query against its DuckDB oracle on the smallest tables."""

import pytest

from fleetspark.catalog import ORACLES, QUERIES, load_all
from fleetspark.verify import compare

from .conftest import SF_SMALL

load_all()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, name):
    rec = compare(spark, SF_SMALL, [name], verbose=False)[name]
    assert "error" not in rec, rec.get("error")
    if name in ORACLES:
        assert rec["match"], rec
