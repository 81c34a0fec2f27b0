"""One watchdog pass: findings from every check, then alert transitions
against the saved state, and the next state written for the following pass."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import alerts as al
from ..operators.health import all_findings
from ..session import stored
from ..sources.state import load_alert_state, save_alert_state


def finding_keys(findings: DataFrame, key: str = "entity") -> DataFrame:
    """(key, text).  ``key='text'`` reproduces the reference (the text is the
    key, so a finding embedding minutes never suppresses); ``'entity'``
    keys by (instance, check, entity) and is the default."""
    if key == "text":
        k = F.col("text")
    else:
        k = F.concat_ws("|", "instance", "check", "entity")
    # one text per key, chosen deterministically
    return findings.groupBy(k.alias("key")).agg(F.min("text").alias("text"))


def run_checks(spark: SparkSession, checks: dict[str, Callable[[], DataFrame]]) -> DataFrame:
    """The findings of every instance; one that fails becomes a finding and
    does not hide the others.  Each instance's findings are computed and
    stored on their own, so that a failure at run time is caught here."""
    out = []
    for instance, check in checks.items():
        try:
            out.append(stored(spark, all_findings(check()), "findings"))
        except Exception as error:  # whatever it is, it is reported
            text = f"[{instance}] watchdog check errored: {type(error).__name__}: {str(error).splitlines()[0] if str(error) else ''}"
            out.append(spark.createDataFrame([(instance, "error", "", text)],
                                             "instance string, check string, entity string, text string"))
    return all_findings(*out)


def health_check(checks: list[DataFrame], state_base: str, run_id: int, now_epoch: float,
                 realert_secs: int, key: str = "entity") -> tuple[DataFrame, DataFrame]:
    """Returns (transitions, message) and saves state ``run_id``; the
    previous state is ``run_id - 1`` (missing = empty)."""
    findings = finding_keys(all_findings(*checks), key)
    spark = findings.sparkSession
    prev = load_alert_state(spark, state_base, run_id - 1)
    transitions = al.alert_transitions(findings, prev, now_epoch, realert_secs)
    save_alert_state(al.next_state(transitions), state_base, run_id)
    return transitions, al.alert_message(transitions)
