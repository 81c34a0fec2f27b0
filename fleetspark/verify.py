"""Compare registered Spark queries with their DuckDB oracles.

Mirrors the external correctness gate: row count, column names, and an
order-insensitive hash of normalised values.
"""

from __future__ import annotations

import datetime as dt
import decimal
import hashlib
import math
import sys
import time

import duckdb

from .sources.tables import TABLES


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6) + 0.0
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return _norm(v.asDict())
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    return v


def _digest(cols: list[str], rows: list[tuple]) -> str:
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted(repr(tuple(_norm(r[i]) for i in order)) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()[:16]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(spark, sf_dir: str, names: list[str] | None = None, verbose: bool = True) -> dict:
    from .catalog import ORACLES, QUERIES, load_all
    load_all()
    con = duck(sf_dir)
    out = {}
    for name in names or list(QUERIES):
        t0 = time.time()
        rec = {"name": name}
        try:
            df = QUERIES[name](spark, sf_dir)
            rows = [tuple(r) for r in df.collect()]
            cols = df.columns
            rec.update(spark_rows=len(rows), spark_hash=_digest(cols, rows), cols=sorted(cols))
        except Exception as e:  # report, keep going
            rec.update(error=f"spark: {type(e).__name__}: {str(e)[:400]}")
            out[name] = rec
            if verbose:
                print(name, rec["error"], file=sys.stderr)
            continue
        if name in ORACLES:
            try:
                res = con.execute(ORACLES[name])
                ocols = [d[0] for d in res.description]
                orows = res.fetchall()
                rec.update(oracle_rows=len(orows), oracle_hash=_digest(ocols, orows), ocols=sorted(ocols))
                rec["match"] = (rec["spark_rows"] == rec["oracle_rows"] and rec["cols"] == rec["ocols"]
                                and rec["spark_hash"] == rec["oracle_hash"])
            except Exception as e:
                rec.update(error=f"oracle: {type(e).__name__}: {str(e)[:400]}", match=False)
        rec["secs"] = round(time.time() - t0, 2)
        out[name] = rec
        if verbose:
            status = "OK " if rec.get("match") else ("-- " if name not in ORACLES else "BAD")
            print(f"{status} {name:38s} rows={rec.get('spark_rows')}/{rec.get('oracle_rows')} "
                  f"{rec['secs']}s {rec.get('error', '')}", file=sys.stderr)
            if rec.get("match") is False and rec["cols"] != rec.get("ocols"):
                print("    cols", rec["cols"], rec.get("ocols"), file=sys.stderr)
    return out


if __name__ == "__main__":
    from .session import get_spark
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or None
    spark = get_spark("local[8]")
    res = compare(spark, sf, names)
    bad = [n for n, r in res.items() if r.get("match") is False or "error" in r]
    print(f"{len(res) - len(bad)}/{len(res)} ok; bad: {bad}")
