"""Run parameters of the weekly pipeline.

Every date the reference hard-codes in its notebooks (latest actual week,
peak weeks, pre-event window, training cut-offs, forecast horizon) is a field
here, so a weekly refresh changes one object instead of editing code.

The defaults map the reference's 2019/2020 calendar onto the driver tables:
this year (TY) = 1998, last year (LY) = 1997.  Both years have 52 Saturdays
numbered ISO W1..W52, so (year, ISO week) is a unique key on Saturday week
ends and the YoY join cannot fan out.
"""

from __future__ import annotations

import datetime as _dt
from dataclasses import dataclass, field


def _d(s: str) -> _dt.date:
    return _dt.date.fromisoformat(s)


@dataclass(frozen=True)
class FactColumns:
    """Where each domain column of the sales fact comes from.

    The domain names (retailer, state, business, category, brand, ppg,
    channel, qty, dollars) are used everywhere downstream; only this mapping
    knows the physical tables.
    """

    retailer: str = "c_mktsegment"
    state: str = "n_name"
    business: str = "r_name"
    category: str = "p_type"
    brand: str = "p_brand"
    ppg: str = "p_name"
    qty: str = "l_quantity"
    dollars: str = "l_extendedprice"
    ship_date: str = "l_shipdate"


@dataclass(frozen=True)
class ModelConfig:
    ty_year: int = 1998
    ly_year: int = 1997
    # Rows with week_ending_date > history_start are modelled.
    history_start: _dt.date = _d("1997-01-01")
    # Latest week of actuals (L).  A Saturday.
    latest_week: _dt.date = _d("1998-04-18")
    # Weeks of year that hold the demand peak.
    peak_week_from: int = 11
    peak_week_to: int = 12
    # Pre-event window for the baseline median growth: [from, to).
    pre_event_from: _dt.date = _d("1998-01-01")
    pre_event_to: _dt.date = _d("1998-03-01")
    # Forecast calendar: TY weeks up to this ISO week.
    horizon_week: int = 31
    # Completeness: LY weeks required (POS) / LY weeks up to a cut (shipments).
    ly_full_weeks: int = 52
    ship_ly_weeks: int = 32
    # Categories removed by the business filter.
    excluded_categories: tuple = ()
    # Seasonal model: cap/floor come from training rows on/before this date.
    cap_floor_until: _dt.date = _d("1997-08-01")
    seasonal_horizon_weeks: int = 25
    # Seasonal high-growth flag averages forecast-vs-LY from this week on.
    high_growth_from: _dt.date = _d("1998-04-25")
    high_growth_threshold: float = 0.5
    # "Today" for policy exposure (FE7) and freshness checks.
    as_of: _dt.date = _d("1998-04-18")
    # Projections behind the milestones: their window, and the share of its
    # peak that a state's projection must fall below.
    projection_from: _dt.date = _d("1998-04-18")
    projection_to: _dt.date = _d("1998-08-01")
    fall_share: float = 0.3
    columns: FactColumns = field(default_factory=FactColumns)
    # Ledger-level filters on raw line columns (SQL predicates, pushed to the
    # scan): the non-zero value rule.
    ledger_filters: tuple = ("l_quantity <> 0",)
    # Series excluded from the reporting table (known-broken keys), as
    # (state, category) pairs; applied with an anti join.
    excluded_series: tuple = (("EUROPE", "ECONOMY"),)
    # > 0: salt the ledger's customer and part joins over this many buckets
    # (explicit skew handling); 0 leaves hot keys to adaptive skew-join
    # splitting.
    hot_key_salt_buckets: int = 0
    # Projection scenario feeding the projection master: "current", "best"
    # or "worst" (all three are merged side by side in ``scenario_merge``).
    scenario: str = "current"

    @property
    def ty_start(self) -> _dt.date:
        return _dt.date(self.ty_year, 1, 1)

    @property
    def ship_promo_from(self) -> _dt.date:
        """Shipments book promo uplift from two weeks after the training end."""
        return self.latest_week + _dt.timedelta(days=14)


DEFAULT_CONFIG = ModelConfig()
