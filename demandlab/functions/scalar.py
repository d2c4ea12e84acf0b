"""Scalar column expressions shared by the plans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def growth(ty, ly) -> Column:
    """(ty - ly) / ly; NULL when ly is 0 or NULL (never +-inf)."""
    ty, ly = as_col(ty), as_col(ly)
    return F.try_divide(ty - ly, ly)



def decay_multiplier(g) -> Column:
    """Step function from peak growth to a decay multiplier.

    Fixed values (must equal the reference's ladder):
      growth < 0            -> 0.8
      0   <= 100*g <= 50    -> 0.2
      50  <  100*g <= 100   -> 0.15
      100 <  100*g <= 500   -> 0.1
      500 <  100*g <= 1000  -> 0.08
      otherwise (incl NULL) -> 0.05
    """
    g = as_col(g)
    p = g * 100
    return (F.when(g < 0, 0.8)
            .when((p >= 0) & (p <= 50), 0.2)
            .when((p > 50) & (p <= 100), 0.15)
            .when((p > 100) & (p <= 500), 0.1)
            .when((p > 500) & (p <= 1000), 0.08)
            .otherwise(0.05))


def per_million(x, pop) -> Column:
    return F.round(F.try_divide(as_col(x) * F.lit(1_000_000.0), as_col(pop)), 4)


def null_flag(c) -> Column:
    return F.when(as_col(c).isNull(), 1).otherwise(0)


def composite_key(*cols, sep: str = "_", null_literal: str = "None") -> Column:
    """'_'-joined key.  NULL parts become a literal so positions are stable
    (``concat_ws`` alone would silently skip them)."""
    return F.concat_ws(sep, *[F.coalesce(as_col(c).cast("string"), F.lit(null_literal)) for c in cols])


def key_part(key, index: int, sep: str = "_") -> Column:
    """0-based part of a composite key (breaks if a part itself holds ``sep``)."""
    return F.element_at(F.split(as_col(key), sep), index + 1)


def r4(c) -> Column:
    """Round a double to 4 places for stable comparison/reporting."""
    return F.round(as_col(c), 4)


def pad_id(c, width: int) -> Column:
    """Left-pad an id with zeros to ``width`` (longer ids are truncated, as
    ``lpad`` does; callers keep ids within the width)."""
    return F.lpad(as_col(c).cast("string"), width, "0")
