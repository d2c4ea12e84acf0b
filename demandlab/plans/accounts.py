"""Forecasts by account (retailer, state, channel, category) and the corrections
that a rules table holds for some of them."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandlab.config import DEFAULT_CONFIG, ModelConfig
from demandlab.operators.rules import with_rules
from demandlab.operators.windows import running_total
from demandlab.plans.facts import weekly_fact
from demandlab.plans.forecast import state_milestones
from demandlab.sources.literals import account_rules, iso_week_saturday
from demandlab.sources.tables import Tables

ACCOUNT = ["retailer", "state", "channel", "category"]


def account_forecast(t: Tables, cfg: ModelConfig = DEFAULT_CONFIG) -> DataFrame:
    """Rate of sale per account: the weeks from L to the horizon with last year's
    quantity of the same ISO week.  forecast_quantity is the actual at L, then
    the mean weekly quantity of this year up to L.

    Two aggregations, no join: an account's last-year weeks (53 at most) are
    kept as a map and looked up by its forecast weeks.
    """
    wf = weekly_fact(t, cfg).where(F.col("year").isin(cfg.ly_year, cfg.ty_year) & (F.col("week_ending_date") <= F.lit(cfg.latest_week)))
    account = [F.col("business").alias("state") if k == "state" else F.col(k) for k in ACCOUNT]
    weekly = wf.groupBy(*account, "week_of_year").agg(
        F.sum(F.when(F.col("year") == cfg.ly_year, F.col("qty"))).alias("qty_ly"),
        F.sum(F.when(F.col("year") == cfg.ty_year, F.col("qty"))).alias("qty_ty"))
    latest = int(cfg.latest_week.strftime("%V"))
    per = weekly.groupBy(*ACCOUNT).agg(
        F.map_from_entries(F.collect_list(F.struct("week_of_year", "qty_ly"))).alias("ly"),
        (F.coalesce(F.sum("qty_ty"), F.lit(0.0)) / latest).alias("rate"),
        F.coalesce(F.max(F.when(F.col("week_of_year") == latest, F.col("qty_ty"))), F.lit(0.0)).alias("last_week_qty"))
    weeks = (iso_week_saturday(cfg.ty_year, cfg.horizon_week) - cfg.latest_week).days // 7
    k = F.explode(F.sequence(F.lit(0), F.lit(weeks))).alias("k")
    out = per.select(*ACCOUNT, "ly", "rate", "last_week_qty", k).withColumn("week_ending_date", F.date_add(F.lit(cfg.latest_week), F.col("k") * 7))
    return out.select(*ACCOUNT, "week_ending_date", F.element_at("ly", F.weekofyear("week_ending_date")).alias("qty_ly"), "last_week_qty",
                      F.when(F.col("k") == 0, F.col("last_week_qty")).otherwise(F.col("rate")).alias("forecast_quantity"))


def account_corrections(t: Tables, cfg: ModelConfig = DEFAULT_CONFIG, rules: DataFrame | None = None) -> DataFrame:
    """``account_forecast`` after the rules, in this order: hold_last (the actual
    at L until the state's third milestone), scale (by the factor, after L),
    set_ly (last year's quantity), close_gap (the factor's share of the gap to
    last year, after L), cumulative (running total).  A factor of 0 switches an
    action off, so a more specific rule can exempt an account; for scale it
    means zero.  Columns ``<action>_rule`` name the rule of each action."""
    rows = with_rules(account_forecast(t, cfg), rules if rules is not None else account_rules(t.spark), ACCOUNT)
    third = state_milestones(t, cfg).select("state", F.col("ship_third_milestone_date").alias("third"))
    rows = rows.join(F.broadcast(third), "state", "left")  # a row per state
    after = F.col("week_ending_date") > F.lit(cfg.latest_week)
    factor = lambda action: F.col("rules").getItem(action)["factor"]
    on = lambda action: F.coalesce(factor(action) != 0, F.lit(False))
    fq, ly = F.col("forecast_quantity"), F.col("qty_ly")
    steps = [F.when(on("hold_last") & (F.col("week_ending_date") < F.col("third")), F.col("last_week_qty")).otherwise(fq),
             F.when(factor("scale").isNotNull() & after, fq * factor("scale")).otherwise(fq),
             F.when(on("set_ly"), ly).otherwise(fq),
             F.when(on("close_gap") & after, fq - (fq - ly) * factor("close_gap")).otherwise(fq)]
    for step in steps:
        rows = rows.withColumn("forecast_quantity", step)
    rows = rows.withColumn("forecast_quantity", F.when(on("cumulative"), running_total("forecast_quantity", ACCOUNT, "week_ending_date")).otherwise(fq))
    return rows.select(*ACCOUNT, "week_ending_date", "qty_ly", "forecast_quantity",
                       *[F.col("rules").getItem(a)["rule_id"].alias(f"{a}_rule") for a in ("hold_last", "scale", "set_ly", "close_gap", "cumulative")])
