"""Small DuckDB SQL fragments shared by the oracle texts."""

from __future__ import annotations


def finite_nn(x: str) -> str:
    """Oracle form of P1."""
    return f"CASE WHEN NOT isnan({x}) AND {x} >= 0 AND {x} < 'inf'::DOUBLE THEN {x} END"


def nearest_rank_cte(name: str, src: str, keys: list[str], value: str, p: float) -> str:
    """CTE ``name(keys..., value)`` holding the nearest-rank percentile."""
    k = ", ".join(keys)
    part = f"PARTITION BY {k}" if keys else ""
    return f"""{name} AS (
  SELECT {k}{',' if keys else ''} v AS {value} FROM (
    SELECT {k}{',' if keys else ''} v, row_number() OVER ({part} ORDER BY v) AS rn,
           count(*) OVER ({part}) AS cnt
    FROM {src} WHERE v IS NOT NULL) r
  WHERE rn = greatest(1, CAST(ceil({p}::DOUBLE * cnt) AS BIGINT)))"""
