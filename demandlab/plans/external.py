"""External state-level series and the forecast calendar.

Driver-table analogs (declared here only):
  daily epidemic / projection table  := orders per nation per day
  population per state               := customers per nation
  quarterly / monthly macro series   := order aggregates by (year, quarter) / (year, month)
  policy start / end dates           := per-nation first / last order date per order priority
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandlab.config import DEFAULT_CONFIG, ModelConfig
from demandlab.functions.dates import week_ending
from demandlab.sources.literals import iso_week_saturday
from demandlab.session import shared
from demandlab.sources.tables import Tables


def state_lookup(t: Tables) -> DataFrame:
    """Geography lookup (state, state_initial, location_id); 25 rows."""
    return t.nation.select(
        F.col("n_name").alias("state"),
        F.concat(F.lit("N"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias("state_initial"),
        F.col("n_nationkey").alias("location_id"),
        F.col("n_regionkey").alias("region_key"),
    )


def _ts(d: _dt.date):
    return F.lit(d.isoformat()).cast("timestamp_ntz")


def projections_daily(t: Tables, cfg: ModelConfig = DEFAULT_CONFIG,
                      date_from: _dt.date | None = None, date_to: _dt.date | None = None) -> DataFrame:
    """(state, date, n_orders, order_value) per nation per day."""
    o = t.orders.select("o_custkey", "o_orderdate", "o_totalprice")
    if date_from is not None:
        o = o.filter(F.col("o_orderdate") >= _ts(date_from))
    if date_to is not None:
        o = o.filter(F.col("o_orderdate") < _ts(date_to + _dt.timedelta(days=1)))
    cust = t.customer.select("c_custkey", "c_nationkey")
    nation = F.broadcast(t.nation.select("n_nationkey", F.col("n_name").alias("state")))
    j = (o.join(cust, o.o_custkey == cust.c_custkey, "inner")
          .join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "inner"))
    return (j.groupBy("state", F.to_date("o_orderdate").alias("date"))
             .agg(F.count(F.lit(1)).alias("n_orders"), F.sum("o_totalprice").alias("order_value")))


def forecast_calendar(t: Tables, cfg: ModelConfig = DEFAULT_CONFIG) -> DataFrame:
    """(week_ending_date, week_of_year, n_states): TY weeks up to the horizon
    week, from the weekly projections (Monday-based weeks).  At most 53 rows,
    so it is broadcast wherever it is joined."""
    return shared(t, ("forecast_calendar", cfg),
                  lambda: build_forecast_calendar(t, cfg))


def build_forecast_calendar(t: Tables, cfg: ModelConfig = DEFAULT_CONFIG) -> DataFrame:
    last = iso_week_saturday(cfg.ty_year, cfg.horizon_week) + _dt.timedelta(days=1)
    daily = projections_daily(t, cfg, _dt.date(cfg.ty_year, 1, 1), min(last, _dt.date(cfg.ty_year, 12, 31)))
    weekly = (daily.groupBy("state", week_ending("date", "monday_week").alias("week_ending_date"),
                            F.weekofyear("date").alias("week_of_year"), F.year("date").alias("year"))
                   .agg(F.sum("n_orders").alias("n_orders")))
    return (weekly.filter((F.col("year") == cfg.ty_year) & (F.col("week_of_year") <= cfg.horizon_week))
                  .groupBy("week_ending_date", "week_of_year")
                  .agg(F.count("state").alias("n_states")))


# ------------------------------------------------------ state-level sources ----

# The order-priority domain of the driver tables; each priority
# plays the role of one policy.
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


def policy_name(priority: str) -> str:
    """'4-NOT SPECIFIED' -> 'not_specified'."""
    import re
    return re.sub(r"[^a-z0-9]+", "_", priority.split("-", 1)[-1].lower()).strip("_")


POLICIES = sorted(policy_name(p) for p in PRIORITIES)


def geography(t: Tables) -> DataFrame:
    """state, state_initial (two letters), location_id, country (region name)."""
    n = t.nation
    r = F.broadcast(t.region.select("r_regionkey", F.col("r_name").alias("country")))
    return n.join(r, n.n_regionkey == r.r_regionkey, "left").select(
        F.col("n_name").alias("state"),
        F.concat(F.expr("chr(65 + CAST(floor(n_nationkey / 26) AS INT))"),
                 F.expr("chr(65 + n_nationkey % 26)")).alias("state_initial"),
        F.col("n_nationkey").alias("location_id"),
        "country",
    )


def state_orders(t: Tables) -> DataFrame:
    """(state, state_initial, date, status, priority) order counts and values:
    the run's only orders-customer join, over all dates.  Partial aggregation
    comes before the shuffle of the result; the geography side is the 25-row
    nation table (fixed size): broadcast.  Every state-level table is a small
    aggregate of it."""
    def build():
        o = t.orders.select("o_custkey", "o_orderdate", "o_totalprice", "o_orderpriority", "o_orderstatus")
        cust = t.customer.select("c_custkey", "c_nationkey")
        geo = F.broadcast(geography(t).select("location_id", "state", "state_initial"))
        j = (o.join(cust, o.o_custkey == cust.c_custkey, "inner")
              .join(geo, F.col("c_nationkey") == F.col("location_id"), "inner"))
        return (j.groupBy("state", "state_initial", F.to_date("o_orderdate").alias("date"),
                          F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
                 .agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("value"),
                      F.count("o_totalprice").alias("n_value")))
    return shared(t, ("state_orders",), build)


def state_daily(t: Tables, cfg: ModelConfig = DEFAULT_CONFIG, status: str | None = None) -> DataFrame:
    """Per (state, state_initial, date) order measures, all dates."""
    o = state_orders(t)
    if status is not None:
        o = o.filter(F.col("status") == status)
    return (o.groupBy("state", "state_initial", "date")
             .agg(F.sum("n").alias("n_orders"), F.sum("value").alias("order_value"),
                  F.coalesce(F.sum(F.when(F.col("priority") == PRIORITIES[0], F.col("n"))), F.lit(0)).alias("urgent_orders"),
                  (F.sum("value") / F.sum("n_value")).alias("avg_value")))


def mobility(t: Tables, cfg: ModelConfig = DEFAULT_CONFIG) -> DataFrame:
    d = state_daily(t, cfg)
    return d.select("state", "state_initial", "date",
                    F.col("urgent_orders").cast("double").alias("urgent_orders_baseline"),
                    F.col("n_orders").cast("double").alias("orders_baseline"))


def rolling_mean_by_state(t: Tables, cfg: ModelConfig = DEFAULT_CONFIG, k: int = 6) -> DataFrame:
    """Trailing k-day mean of every '*baseline*' column by state (NULL until
    k observations); one window pass for all columns."""
    from demandlab.operators.reshape import columns_with
    from demandlab.operators.windows import rolling_many
    m = mobility(t, cfg)
    return rolling_many(m, ["state"], "date", columns_with(m, "baseline"), k, "mean")


def population(t: Tables) -> DataFrame:
    """Customers per state (population analog), at most one row per nation."""
    c = t.customer.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("state_pop"))
    geo = geography(t).select("location_id", "state", "state_initial")
    return F.broadcast(geo).join(c, geo.location_id == c.c_nationkey, "left").select(
        "state", "state_initial", F.coalesce("state_pop", F.lit(0)).cast("long").alias("state_pop"))


def case_tracking(t: Tables, cfg: ModelConfig = DEFAULT_CONFIG) -> DataFrame:
    d = state_daily(t, cfg)
    return d.select("state", "state_initial", "date",
                    F.col("n_orders").cast("double").alias("orders_increase"),
                    F.col("urgent_orders").cast("double").alias("urgent_increase"),
                    "order_value")


def per_million_features(t: Tables, cfg: ModelConfig = DEFAULT_CONFIG, validate: bool = False) -> DataFrame:
    """Population join (m:1, checked), population in millions, per-million
    versions of every '*increase*' column, and date meta."""
    from demandlab.functions.dates import with_date_meta
    from demandlab.functions.scalar import per_million
    from demandlab.operators.joins import validated_join
    from demandlab.operators.reshape import columns_with
    c = case_tracking(t, cfg)
    pop = population(t)
    j = (validated_join(c, pop, ["state", "state_initial"], "left", "m:1") if validate
         else c.join(pop, ["state", "state_initial"], "left"))
    j = j.withColumn("state_pop_mil", F.round(F.col("state_pop") / 1_000_000.0, 4))
    j = j.withColumns({f"{x}_per_mil": per_million(x, "state_pop") for x in columns_with(c, "increase")})
    return with_date_meta(j, "date")


def policy_summary(t: Tables, cfg: ModelConfig = DEFAULT_CONFIG) -> DataFrame:
    """Per state: <policy>_start_date / <policy>_end_date (first / last order
    date of that priority) -- one conditional aggregation, no pivot."""
    aggs = []
    for p in PRIORITIES:
        name = policy_name(p)
        hit = F.col("priority") == p
        aggs += [F.min(F.when(hit, F.col("date"))).alias(f"{name}_start_date"),
                 F.max(F.when(hit, F.col("date"))).alias(f"{name}_end_date")]
    return state_orders(t).groupBy("state", "state_initial").agg(*aggs)


def policies_from_columns(columns) -> list[str]:
    """Policy names from '<policy>_start_date' / '<policy>_end_date' columns,
    sorted (deterministic order)."""
    from demandlab.operators.quality import assert_column_count
    se = [c for c in columns if c.endswith("_start_date") or c.endswith("_end_date")]
    names = sorted({c.rsplit("_", 2)[0] for c in se})
    assert_column_count(se, 2 * len(names), "policy start/end columns")
    return names


def policy_duration(t: Tables, cfg: ModelConfig = DEFAULT_CONFIG) -> DataFrame:
    """<policy>_duration = end - start in days (NULL unless both exist)."""
    s = policy_summary(t, cfg)
    return s.withColumns({f"{p}_duration": F.datediff(f"{p}_end_date", f"{p}_start_date")
                          for p in policies_from_columns(s.columns)})


def policy_exposure(t: Tables, cfg: ModelConfig = DEFAULT_CONFIG) -> DataFrame:
    """Per state and day: days_on_<policy> (days since start; 0 before the
    start, after the end, or after ``as_of``; NULL without a start) and
    on_<policy> (1 iff days_on > 0)."""
    from demandlab.functions.dates import with_date_meta
    from demandlab.operators.reshape import front_columns
    days = state_daily(t, cfg, scenario_status(cfg)).select("state", "state_initial", "date")
    s = policy_summary(t, cfg)
    j = with_policy_exposure(days.join(s, ["state", "state_initial"], "left"),
                             policies_from_columns(s.columns), cfg.as_of)
    return front_columns(with_date_meta(j, "date"), ["year", "quarter", "state_initial", "state", "date"])


def with_policy_exposure(df: DataFrame, policies, as_of: _dt.date, date_col: str = "date") -> DataFrame:
    """days_on_<p> / on_<p> from <p>_start_date / <p>_end_date columns."""
    dt = F.col(date_col)
    days = {}
    for p in policies:
        raw = F.datediff(dt, F.col(f"{p}_start_date"))
        zero = (dt > F.col(f"{p}_end_date")) | (raw < 0) | (dt > F.lit(as_of))
        days[f"days_on_{p}"] = F.when(zero, F.lit(0)).otherwise(raw)
    df = df.withColumns(days)
    return df.withColumns({f"on_{p}": F.when(F.col(f"days_on_{p}") > 0, 1).otherwise(0) for p in policies})


def monthly_orders(t: Tables) -> DataFrame:
    """(y, m, total, n) of all orders: both macro series are small aggregates of
    this one pass."""
    def build():
        o = t.orders.select("o_orderdate", "o_totalprice")
        return (o.groupBy(F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m"))
                 .agg(F.sum("o_totalprice").alias("total"), F.count("o_totalprice").alias("n")))
    return shared(t, ("monthly_orders",), build)


def quarterly_series(t: Tables, cfg: ModelConfig = DEFAULT_CONFIG) -> DataFrame:
    """(year, quarter 'qN', avg_order_value_q): the quarterly macro analog."""
    return (monthly_orders(t).groupBy(F.col("y").alias("year"),
                                      F.concat(F.lit("q"), F.ceil(F.col("m") / 3).cast("string")).alias("quarter"))
            .agg((F.sum("total") / F.sum("n")).alias("avg_order_value_q")))


def price_index_raw(t: Tables, cfg: ModelConfig = DEFAULT_CONFIG) -> DataFrame:
    """Monthly series as landed text: year, period 'Mnn', periodName, latest,
    value, footnotes (all strings)."""
    m = monthly_orders(t).select("y", "m", (F.col("total") / F.col("n")).alias("v"))
    return m.select(
        F.col("y").cast("string").alias("year"),
        F.concat(F.lit("M"), F.lpad(F.col("m").cast("string"), 2, "0")).alias("period"),
        F.date_format(F.make_date("y", "m", F.lit(1)), "MMMM").alias("periodName"),
        F.lit("").alias("latest"),
        F.round("v", 2).cast("string").alias("value"),
        F.lit("[{}]").alias("footnotes"),
    )


def price_index_clean(t: Tables, cfg: ModelConfig = DEFAULT_CONFIG) -> DataFrame:
    """Numeric year/value, month number from the month name, drop footnotes
    and the month name."""
    from demandlab.functions.dates import month_number
    r = price_index_raw(t, cfg)
    return (r.withColumns({"year": F.col("year").cast("int"), "value": F.col("value").cast("double"),
                           "month": month_number("periodName")})
             .drop("footnotes", "periodName"))


# Weekly-claims field codes and their names.
CLAIMS_CODES = {
    "c1": "wk_num", "c2": "refl_wk_date", "c3": "IC", "c4": "FIC", "c5": "XIC", "c6": "WSIC",
    "c7": "WSEIC", "c8": "CW", "c9": "FCW", "c10": "XCW", "c11": "WSCW", "c12": "WSECW",
    "c13": "EBT", "c14": "EBUI", "c15": "ABT", "c16": "ABUI", "c17": "AT", "c18": "CE",
    "c19": "R", "c20": "AR", "c21": "P", "c22": "status", "c23": "status_chg_date",
}
# Landed claims columns that are not kept.
CLAIMS_DROP = ["refl_wk_date", "rptdate", "status_chg_date", "curdate", "priorwk_pub", "priorwk"]


def claims_raw(t: Tables, cfg: ModelConfig = DEFAULT_CONFIG) -> DataFrame:
    """Weekly per-state report with coded columns (c1..c8) as landed."""
    d = state_daily(t, cfg)
    w = (d.withColumn("week_ending_date", week_ending("date", "same_or_next"))
          .groupBy("state_initial", "week_ending_date")
          .agg(F.sum("n_orders").alias("n"), F.sum("urgent_orders").alias("u"),
               F.sum("order_value").alias("v"), F.count(F.lit(1)).alias("days")))
    return w.select(
        F.col("state_initial").alias("st"),
        F.date_format("week_ending_date", "M/d/yyyy").alias("rptdate"),
        F.weekofyear("week_ending_date").alias("c1"),
        F.date_format(F.date_sub("week_ending_date", 7), "M/d/yyyy").alias("c2"),
        F.col("n").cast("long").alias("c3"), F.col("u").cast("long").alias("c4"),
        (F.col("n") - F.col("u")).cast("long").alias("c5"), F.col("days").cast("long").alias("c6"),
        F.round("v", 2).alias("c7"), (F.col("n") / F.col("days")).alias("c8"),
        F.date_format("week_ending_date", "M/d/yyyy").alias("curdate"),
        F.lit("").alias("priorwk_pub"), F.lit("").alias("priorwk"),
    )


def claims_renamed(t: Tables, cfg: ModelConfig = DEFAULT_CONFIG) -> DataFrame:
    """Coded columns renamed, reflecting-week date parsed, landed-only
    columns dropped, state name attached from the geography lookup."""
    from demandlab.operators.reshape import drop_tolerant, rename
    r = rename(claims_raw(t, cfg), CLAIMS_CODES)
    r = r.withColumn("date", F.try_to_date(F.col("refl_wk_date"), "M/d/yyyy"))
    r = drop_tolerant(r, CLAIMS_DROP).withColumnRenamed("st", "state_initial")
    geo = F.broadcast(geography(t).select("state", "state_initial"))
    return r.join(geo, "state_initial", "inner")


# Order status that defines each projection scenario (current = all orders).
SCENARIO_STATUS = {"current": None, "best": "F", "worst": "O"}


def scenario_status(cfg: ModelConfig) -> str | None:
    if cfg.scenario not in SCENARIO_STATUS:
        raise ValueError(f"unknown scenario {cfg.scenario!r}; expected one of {sorted(SCENARIO_STATUS)}")
    return SCENARIO_STATUS[cfg.scenario]


def scenario_frames(t: Tables, cfg: ModelConfig = DEFAULT_CONFIG):
    keep = ["state", "state_initial", "date", "n_orders", "order_value"]
    return tuple(state_daily(t, cfg, status=SCENARIO_STATUS[n]).select(*keep) for n in ("current", "best", "worst"))


def scenario_merge(t: Tables, cfg: ModelConfig = DEFAULT_CONFIG,
                   keys=("state", "date", "state_initial")) -> DataFrame:
    """current + best + worst scenarios on (state, date, state_initial);
    columns shared by all three are suffixed _bes / _wor on the alternatives."""
    cur, bes, wor = scenario_frames(t, cfg)
    overlap = (set(cur.columns) & set(bes.columns) & set(wor.columns)) - set(keys)
    bes = bes.withColumnsRenamed({c: f"{c}_bes" for c in overlap})
    wor = wor.withColumnsRenamed({c: f"{c}_wor" for c in overlap})
    return cur.join(bes, list(keys), "left").join(wor, list(keys), "left")


def master_current(t: Tables, cfg: ModelConfig = DEFAULT_CONFIG, validate: bool = False) -> DataFrame:
    """Case features + mobility + weekly claims on (state, state_initial,
    date); quarterly series on (year, quarter); monthly index on (year, month).

    Every right side is an aggregate grouped by exactly its join keys, so the
    left row count is preserved by construction; ``validate=True`` (used by
    the production pipeline) additionally checks each right side's key
    uniqueness before joining.  Materialized once: the projection master
    reads it too.
    """
    return shared(t, ("master_current", cfg, validate),
                  lambda: _master_current(t, cfg, validate))


def _merge(validate: bool):
    """A left merge; with ``validate``, the right side's keys must be unique and
    the sides share no other column.  (The left side's rows are kept by that,
    so it isn't run again for a check.)"""
    from demandlab.operators.joins import validated_join
    from demandlab.operators.quality import assert_no_overlap

    def merge(left: DataFrame, right: DataFrame, on) -> DataFrame:
        if not validate:
            return left.join(right, on, "left")
        assert_no_overlap(left, right, on)
        return validated_join(left, right, on, "left", "m:1")
    return merge


def _master_current(t: Tables, cfg: ModelConfig, validate: bool) -> DataFrame:
    J = _merge(validate)
    keys = ["state", "state_initial", "date"]
    base = per_million_features(t, cfg, validate=validate)
    mob = rolling_mean_by_state(t, cfg)
    claims = claims_renamed(t, cfg)
    q = quarterly_series(t, cfg)
    price = price_index_clean(t, cfg).select("year", "month", F.col("value").alias("price_index"))
    if validate:
        from demandlab.operators.joins import assert_unique
        assert_unique(base, keys, "left")
    m = J(base, mob, keys)
    m = J(m, claims, keys)
    m = J(m, q, ["year", "quarter"])
    return J(m, price, ["year", "month"])


def master_projection(t: Tables, cfg: ModelConfig = DEFAULT_CONFIG, validate: bool = False) -> DataFrame:
    """Policy exposure (projections) + current features, then the quarterly
    series for every projection row."""
    keys = ["state", "state_initial", "date"]
    cur = master_current(t, cfg, validate=validate).drop("year", "quarter", "month", "avg_order_value_q")
    p = policy_exposure(t, cfg).drop("month")
    cur = cur.drop(*[c for c in cur.columns if c in p.columns and c not in keys])
    J = _merge(validate)
    return J(J(p, cur, keys), quarterly_series(t, cfg), ["year", "quarter"])


# ------------------------------------------------------------- geography ----

def geo_filter(df: DataFrame, geo: DataFrame, state_col: str, country_col: str | None = None,
               country_value: str | None = None, initial_len: int = 2) -> DataFrame:
    """Keep rows of known states, add the other state form.

    Whether ``state_col`` holds codes or names is inferred from the modal
    string length (NULL has none; ties -> shortest): one tiny aggregation.  The lookup is
    the fixed-size geography table, broadcast.
    """
    mode_len = (df.filter(F.col(state_col).isNotNull()).groupBy(F.length(state_col).alias("len")).count()
                  .orderBy(F.desc("count"), F.asc("len")).first())
    form = "state_initial" if mode_len is not None and mode_len["len"] == initial_len else "state"
    out = df.withColumnRenamed(state_col, form)
    if country_col is not None:
        out = out.filter(F.col(country_col) == F.lit(country_value))
    look = F.broadcast(geo.select("state", "state_initial"))
    out = out.join(look, form, "inner")
    rest = [c for c in out.columns if c not in ("state", "state_initial")]
    return out.select("state", "state_initial", *rest)


def validate_geo_filter(out: DataFrame, geo: DataFrame, country_col: str | None = None,
                        expected_states: int | None = None) -> None:
    """Post-conditions of ``geo_filter``: the output's states are those of the
    lookup ``geo`` (pass the expected part of it); their number, if given; one
    country and no NULL one.  Raises on failure."""
    from demandlab.operators.quality import assert_coverage, assert_distinct_count, assert_no_nulls
    assert_coverage(out, geo, "state")
    if expected_states is not None:
        assert_distinct_count(out, "state", expected_states)
    if country_col is not None and country_col in out.columns:
        assert_no_nulls(out, country_col)
        assert_distinct_count(out, country_col, 1)


def geo_filtered(t: Tables, cfg: ModelConfig = DEFAULT_CONFIG, country: str = "AMERICA") -> DataFrame:
    geo = geography(t)
    d = state_daily(t, cfg).drop("state_initial")
    d = d.join(F.broadcast(geo.select("state", "country")), "state", "left")
    return geo_filter(d, geo, "state", "country", country)


def geo_filtered_codes(t: Tables, cfg: ModelConfig = DEFAULT_CONFIG) -> DataFrame:
    """``geo_filter`` on the code form: priority x nation order counts with a
    two-letter code that is NULL for urgent orders and unknown for low ones."""
    o = state_orders(t).groupBy("state_initial", "priority").agg(F.sum("n").alias("n_orders"))
    code = F.when(F.col("priority") == PRIORITIES[0], F.lit(None).cast("string")) \
        .when(F.col("priority") == PRIORITIES[4], F.lit("??")).otherwise(F.col("state_initial"))
    return geo_filter(o.select(code.alias("code"), "priority", "n_orders"), geography(t), "code")


def wide_quarterly(t: Tables, cfg: ModelConfig = DEFAULT_CONFIG) -> DataFrame:
    """One row per order priority, one column per 'yYYYY_qN' that the orders
    have (as landed: the header grows with the history, a column a quarter)."""
    o = t.orders.select("o_orderpriority", "o_orderdate", "o_totalprice").withColumn(
        "label", F.concat(F.lit("y"), F.year("o_orderdate").cast("string"), F.lit("_q"),
                          F.quarter("o_orderdate").cast("string")))
    return o.filter(F.col("label").isNotNull()).groupBy("o_orderpriority").pivot("label").agg(F.avg("o_totalprice"))


def wide_to_long_quarters(t: Tables, cfg: ModelConfig = DEFAULT_CONFIG) -> DataFrame:
    """Long form of ``wide_quarterly``; years and quarters come from its header."""
    from demandlab.operators.reshape import wide_to_long
    w = wide_quarterly(t, cfg)
    long = wide_to_long(w, ["o_orderpriority"], [c for c in w.columns if c.startswith("y")], "label", "avg_value")
    return long.filter(F.col("avg_value").isNotNull()).select(
        F.col("o_orderpriority").alias("priority"),
        F.regexp_extract("label", r"^y(-?\d+)_", 1).cast("int").alias("year"),
        F.regexp_extract("label", r"_(q\d)$", 1).alias("quarter"),
        "avg_value")


def flatten_props(t: Tables, cfg: ModelConfig = DEFAULT_CONFIG) -> DataFrame:
    """Event JSON properties parsed with an explicit schema; rows whose
    document does not parse to a value are dropped."""
    e = t.events.select("event_id", "event_type", "value",
                        F.from_json("props", "k long").alias("p"))
    return e.filter(F.col("p.k").isNotNull()).select("event_id", "event_type", "value", F.col("p.k").alias("k"))


def series_responses(t: Tables, cfg: ModelConfig = DEFAULT_CONFIG) -> DataFrame:
    """(series, value): monthly mean order values per order priority as the API
    documents that a download would land, an array of data points each (as many
    as the history has months).  The request for the last priority failed, and
    the one before it has no series."""
    m = t.orders.where(F.col("o_orderdate").isNotNull()).groupBy(
        F.col("o_orderpriority").alias("series"), F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m")).agg(
        F.round(F.avg("o_totalprice"), 2).alias("v"))
    point = F.struct(F.col("y").cast("string").alias("year"), F.concat(F.lit("M"), F.lpad(F.col("m").cast("string"), 2, "0")).alias("period"),
                     F.date_format(F.make_date("y", "m", F.lit(1)), "MMMM").alias("periodName"), F.lit("").alias("latest"),
                     F.col("v").cast("decimal(18,2)").cast("string").alias("value"),
                     F.array(F.create_map(F.lit("code"), F.lit("R"))).alias("footnotes"))
    docs = m.groupBy("series").agg(F.collect_list(point).alias("data"))
    failed, empty = PRIORITIES[4], PRIORITIES[3]
    status = F.when(F.col("series") == failed, "REQUEST_FAILED").otherwise("REQUEST_SUCCEEDED").alias("status")
    found = F.array(F.struct(F.lit("S").alias("seriesID"), F.col("data")))
    body = F.struct(F.when(F.col("series") != empty, found).otherwise(F.slice(found, 1, 0)).alias("series")).alias("Results")
    return docs.select("series", F.to_json(F.struct(status, body)).alias("value"))


def series_points(t: Tables, cfg: ModelConfig = DEFAULT_CONFIG) -> DataFrame:
    """Data points of the successful responses: series, year, period, month, value."""
    from demandlab.functions.dates import month_number
    from demandlab.sources.files import flatten_series_response
    points = flatten_series_response(series_responses(t, cfg), keep=["series"])
    return points.select("series", F.col("year").cast("int").alias("year"), "period", month_number("periodName").alias("month"),
                         F.col("value").cast("double").alias("value"))


def land_two_row_header(t: Tables, path: str, cfg: ModelConfig = DEFAULT_CONFIG) -> None:
    """The quarterly means per order priority as a wide CSV file with two header
    rows: each year once over its four columns, quarters below.  A row per
    priority (a fixed domain), so the file is small however large the orders are."""
    span = t.orders.agg(F.min(F.year("o_orderdate")).alias("a"), F.max(F.year("o_orderdate")).alias("b")).first()
    labels = [(y, q) for y in range(span["a"], span["b"] + 1) for q in range(1, 5)] if span["a"] is not None else []
    label = F.year("o_orderdate") * 10 + F.quarter("o_orderdate")
    wide = (t.orders.withColumn("label", label).groupBy("o_orderpriority").pivot("label", [y * 10 + q for y, q in labels])
            .agg(F.round(F.avg("o_totalprice"), 4)))
    rows = [(0, ",".join(["priority", "unit", *[str(y) if q == 1 else "" for y, q in labels]])),
            (1, ",".join(["priority", "unit", *[f"q{q}" for _, q in labels]]))]
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (str(y * 10 + q) for y, q in labels)]
    lines = wide.select(F.lit(2).alias("line"), F.concat_ws(",", F.col("o_orderpriority"), F.lit("level"), *cells).alias("value"))
    (t.spark.createDataFrame(rows, "line int, value string").unionByName(lines).coalesce(1).sortWithinPartitions("line", "value")
     .select("value").write.text(path))


# ---------------------------------------------------------- preprocessors ----

def basic_preproc(df: DataFrame, geo: DataFrame, state_col: str, country_col: str | None = None,
                  country_value: str | None = None, exclude_location_id: int | None = None,
                  drop=("V1",)) -> DataFrame:
    """Drop an accidental index column, drop a homonym location id, keep known
    states (adding the other state form), cast date-token columns to dates,
    spaces in names -> '_'.  (Row order is left to the sink.)"""
    from demandlab.operators.reshape import cast_date_columns, drop_tolerant, normalise_names
    out = drop_tolerant(df, drop)
    if exclude_location_id is not None and "location_id" in out.columns:
        out = out.filter(~F.col("location_id").eqNullSafe(F.lit(exclude_location_id)))
    out = geo_filter(out, geo, state_col, country_col, country_value)
    return normalise_names(cast_date_columns(out, "date"))


def mobility_preproc(df: DataFrame, expected_baselines: int = 6) -> DataFrame:
    """State-level rows only (no sub-region), sub-region columns dropped, and
    the expected number of baseline columns checked."""
    from demandlab.operators.quality import assert_column_count, assert_columns
    from demandlab.operators.reshape import columns_with, drop_tolerant
    assert_columns(df, ["sub_region_2"])
    out = df.filter(F.col("sub_region_2").isNull())
    out = drop_tolerant(out, ["sub_region_2", "census_fips_code"])
    assert_column_count(columns_with(out, "baseline"), expected_baselines, "baseline columns")
    return out


# Landed case columns that are not kept.
CASE_HARD_DROP = ["hash", "total", "dateChecked", "fips", "checkTimeEt"]


def case_tracking_preproc(df: DataFrame, as_of: _dt.date):
    """Returns (frame, freshness row): single-valued columns and a fixed list
    dropped, all-NULL rows dropped; freshness = latest update vs ``as_of``."""
    from demandlab.operators.quality import freshness_lag_days
    from demandlab.operators.reshape import drop_all_null_rows, drop_constant_columns, drop_tolerant
    fresh = freshness_lag_days(df, "lastUpdateEt", as_of) if "lastUpdateEt" in df.columns else None
    out = drop_tolerant(drop_constant_columns(df), CASE_HARD_DROP)
    return drop_all_null_rows(out), fresh
