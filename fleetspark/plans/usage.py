"""Usage report from journal lines (``read.text`` or a table)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import telemetry as tm
from ..sources.journal import parse_cycle_telemetry, scan_journal


def usage_report_from_journal(instances: DataFrame, journal: DataFrame, as_of: str | None = None,
                              since_secs: int | None = None, line_col: str = "line",
                              checkpoint: bool = False) -> DataFrame:
    """(instance, line_no, text).  ``journal`` has (instance, line[, ts]);
    with ``as_of``/``since_secs`` lines are first bounded to the window.

    The journal is read and its JSON parsed once, when this is called: one
    aggregate of the parsed lines is stored, the report comes from it.  With
    ``checkpoint`` the parsed lines themselves are kept in
    ``spark.checkpoint.dir`` as well; the report does not need it.
    """
    if as_of is not None and since_secs is not None:
        journal = scan_journal(journal, as_of, since_secs)
    parsed = parse_cycle_telemetry(journal, line_col, keep=["instance"], keep_all=True)
    if checkpoint:
        parsed = parsed.checkpoint(eager=True)
    return tm.usage_report(instances, parsed, line_col)
