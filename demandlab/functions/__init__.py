"""Column-level functions (native Spark expressions only)."""

from demandlab.functions.dates import (  # noqa: F401
    week_ending, week_of_year, calendar_year, with_date_part, with_date_meta,
    parse_date, month_number, weeks_between, WEEK_RULES,
)
from demandlab.functions.scalar import (  # noqa: F401
    growth, decay_multiplier, per_million, null_flag,
    composite_key, key_part, r4, as_col,
)
