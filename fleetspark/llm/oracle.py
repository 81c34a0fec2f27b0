"""Compare registered queries with their DuckDB SQL (as ``fleetspark.verify`` does)."""

from __future__ import annotations

import sys

from ..verify import _digest, duck
from . import registry


def compare(spark, sf_dir: str, name: str) -> dict:
    registry.load_all()
    df = registry.QUERIES[name](spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    out = {"rows": len(rows), "cols": sorted(df.columns), "hash": _digest(df.columns, rows)}
    if name in registry.ORACLES:
        res = duck(sf_dir).execute(registry.ORACLES[name])
        cols = [d[0] for d in res.description]
        theirs = res.fetchall()
        out |= {"oracle_rows": len(theirs), "oracle_cols": sorted(cols), "oracle_hash": _digest(cols, theirs)}
        out["match"] = (out["rows"], out["cols"], out["hash"]) == (len(theirs), sorted(cols), out["oracle_hash"])
    return out


if __name__ == "__main__":
    from ..session import get_spark
    session = get_spark("local[8]")
    for query in sys.argv[2:]:
        print(query, compare(session, sys.argv[1], query))
