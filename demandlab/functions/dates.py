"""Date expressions: week-ending rules, ISO week/year, date parts, parsing.

All are native Catalyst expressions (no Python UDF), so they stay inside
whole-stage codegen and can be pushed around by the optimizer.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from demandlab.functions.scalar import as_col

# Three week-ending rules are used on purpose by different stages:
#   "next"        strictly-next Saturday; a Saturday moves a week forward.
#   "same_or_next" the Saturday that closes a Sun..Sat week (Saturday stays).
#   "monday_week" the Saturday of the Mon..Sun ISO week (Sunday goes back).
WEEK_RULES = ("next", "same_or_next", "monday_week")


def week_ending(c, rule: str = "same_or_next") -> Column:
    d = F.to_date(as_col(c))
    if rule == "next":
        return F.next_day(d, "Sat")
    if rule == "same_or_next":
        # dayofweek: 1 = Sunday .. 7 = Saturday
        return F.date_add(d, 7 - F.dayofweek(d))
    if rule == "monday_week":
        return F.date_add(F.to_date(F.date_trunc("week", d)), 5)
    raise ValueError(f"unknown week rule {rule!r}; expected one of {WEEK_RULES}")


def week_of_year(c) -> Column:
    """ISO week number."""
    return F.weekofyear(as_col(c))


def calendar_year(c) -> Column:
    return F.year(as_col(c))


_DATE_PARTS = {
    "year": F.year,
    "quarter": F.quarter,
    "month": F.month,
    "weekofyear": F.weekofyear,
    "dayofmonth": F.dayofmonth,
    "dayofweek": F.dayofweek,
    "dayofyear": F.dayofyear,
}


def with_date_part(df, date_col: str, part: str, out: str | None = None, drop_source: bool = False):
    """Add ``part`` of ``date_col`` as a column (allow-listed dispatch by name)."""
    if part not in _DATE_PARTS:
        raise ValueError(f"unsupported date part {part!r}; allowed: {sorted(_DATE_PARTS)}")
    df = df.withColumn(out or part, _DATE_PARTS[part](F.col(date_col)))
    return df.drop(date_col) if drop_source else df


def with_date_meta(df, date_col: str = "date"):
    """quarter as 'q<n>', month and year of ``date_col``."""
    d = F.col(date_col)
    return df.withColumns({
        "quarter": F.concat(F.lit("q"), F.quarter(d).cast("string")),
        "month": F.month(d),
        "year": F.year(d),
    })


def parse_date(c, fmt: str | None = None) -> Column:
    """Lenient string -> date: unparseable values become NULL."""
    c = as_col(c)
    if fmt is None:
        return F.try_to_date(c)
    return F.try_to_date(c, fmt)


def month_number(name_col) -> Column:
    """'January' -> 1 ... (full English month names)."""
    return F.month(F.try_to_date(as_col(name_col), "MMMM"))


def weeks_between(later, earlier) -> Column:
    """Whole weeks from ``earlier`` to ``later`` (both Saturdays)."""
    return F.floor(F.datediff(as_col(later), as_col(earlier)) / F.lit(7)).cast("int")
