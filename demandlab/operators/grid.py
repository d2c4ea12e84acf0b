"""Series x calendar grids.

The reference completes each series' weeks with a right/outer merge against
a calendar inside a Python loop over groups.  Here the grid is built once for
all series: every series row explodes the Saturday sequence between two
calendar bounds (known from the run parameters, no action needed), and an
equi-join with the calendar keeps exactly the calendar weeks.  The calendar is
bounded (at most 53 weeks per year), so broadcasting it is always safe; the
grid is partitioned like the series keys, so no row pairs are enumerated
beyond the output itself.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def week_sequence(start: _dt.date, end: _dt.date):
    return F.explode(F.sequence(F.lit(start), F.lit(end), F.expr("INTERVAL 7 DAYS")))


def series_grid(keys: DataFrame, calendar: DataFrame, start: _dt.date, end: _dt.date,
                date_col: str = "week_ending_date") -> DataFrame:
    """One row per (series key row, calendar week) for calendar weeks in
    [start, end].  ``calendar`` must carry ``date_col`` (one row per week)."""
    exploded = keys.withColumn(date_col, week_sequence(start, end))
    return exploded.join(F.broadcast(calendar), date_col, "inner")

