"""Alert state transitions (T-1) and the alert message (P24 cut).

Batch form: findings full-outer-joined with the saved state.  The state is
a small table (one row per active finding key), saved per run as Parquet
(see ``sources.state``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .topk import top_k
from ..fixed import MESSAGE_CHARS  # noqa: F401


def alert_transitions(findings: DataFrame, state: DataFrame, now_epoch: float, realert_secs: int) -> DataFrame:
    """(key, text, status, last_alert).

    ``findings`` has (key, text); ``state`` has (key, last_alert epoch).
    A current finding is ``fresh`` when ``now - last >= realert`` (last = 0
    when unseen) and then gets ``last_alert = now``; otherwise
    ``suppressed`` and keeps its time.  A state key no longer found is
    ``recovered`` and leaves the state (last_alert null).
    """
    f = findings.select("key", "text", F.lit(True).alias("_cur"))
    s = state.select("key", F.col("last_alert").cast("double").alias("_last"))
    j = f.join(s, "key", "full_outer")
    last = F.coalesce(F.col("_last"), F.lit(0.0))
    fresh = F.lit(float(now_epoch)) - last >= F.lit(float(realert_secs))
    status = (F.when(F.col("_cur").isNull(), "recovered").when(fresh, "fresh").otherwise("suppressed"))
    new_last = (F.when(F.col("_cur").isNull(), F.lit(None).cast("double"))
                .when(fresh, F.lit(float(now_epoch))).otherwise(last))
    return j.select("key", "text", status.alias("status"), new_last.alias("last_alert"))


def next_state(transitions: DataFrame) -> DataFrame:
    """The state to save: current findings only, with their alert times."""
    return transitions.filter(F.col("status") != "recovered").select("key", "last_alert")


def alert_message(transitions: DataFrame, order_col: str = "key") -> DataFrame:
    """One row when any finding is fresh: the count and the findings text
    (newline-joined, cut at 3500 characters).  Every finding adds at least its
    line break, so the first 3501 decide the whole body."""
    cur = transitions.filter(F.col("status") != "recovered")
    stats = cur.agg(F.count(F.lit(1)).alias("findings"), F.count_if(F.col("status") == "fresh").alias("fresh"))
    head = top_k(cur.select(order_col, "text"), [], [F.col(order_col)], MESSAGE_CHARS + 1)
    body = head.agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("_t")).select(
        F.left(F.concat_ws("\n", F.transform("_t", lambda x: x["text"])), F.lit(MESSAGE_CHARS)).alias("body"))
    return stats.filter(F.col("fresh") > 0).crossJoin(body).select("findings", "fresh", "body")


def recovered_message(transitions: DataFrame, order_col: str = "key") -> DataFrame:
    """One row when any finding recovered: how many, and their previous keys,
    newline-joined and cut at 3500 characters (the text of a recovered
    finding is its key when keyed by text)."""
    rec = transitions.filter(F.col("status") == "recovered")
    count = rec.agg(F.count(F.lit(1)).alias("recovered")).filter("recovered > 0")
    head = top_k(rec.select(order_col), [], [F.col(order_col)], MESSAGE_CHARS + 1)
    body = head.agg(F.array_sort(F.collect_list(F.struct("rank", order_col))).alias("_t")).select(
        F.left(F.concat_ws("\n", F.transform("_t", lambda x: x[order_col])), F.lit(MESSAGE_CHARS)).alias("body"))
    return count.crossJoin(body)
