"""Sales facts: the ledger join and the weekly roll-ups.

Physical plan notes (for a cluster and a fact table in the TB range):

* Nation and region are fixed-size (25 / 5 rows) and are broadcast explicitly.
  customer, part and orders grow with the data, so no hint is given for them:
  AQE turns a join into a broadcast at run time only when the measured side
  is under ``spark.sql.adaptive.autoBroadcastJoinThreshold`` and otherwise
  keeps a sort-merge join.
* Date windows are applied to the raw ship-date column as well as to the
  derived week, so the predicate reaches the parquet scan (row-group skipping)
  instead of being evaluated after the join.
* Lines go through the joins with keys and numbers only; place names are added
  after the last shuffle, and the weekly sums are made and written there.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandlab.config import DEFAULT_CONFIG, ModelConfig
from demandlab.functions.dates import week_ending
from demandlab.functions.scalar import composite_key
from demandlab.session import shared
from demandlab.sources.literals import channel_mapping
from demandlab.sources.tables import Tables

FACT_KEYS = ["retailer", "state", "business", "category", "brand", "ppg"]
LINES_PER_TASK = 250_000  # ledger lines that a task of the weekly sums gets


def _ts(d: _dt.date):
    return F.lit(d.isoformat()).cast("timestamp_ntz")


def ledger_lines(t: Tables, cfg: ModelConfig = DEFAULT_CONFIG,
                 ship_from: _dt.date | None = None, ship_to: _dt.date | None = None) -> DataFrame:
    """Daily ledger lines with their retailer, the customer's nation key and the
    product hierarchy.  What every line carries through the two large joins is
    narrow: the date, one channel text, and a key instead of the place names
    (``with_places`` adds these)."""
    c = cfg.columns
    li = t.lineitem
    for pred in cfg.ledger_filters:
        li = li.filter(F.expr(pred))
    li = li.select("l_orderkey", "l_partkey", F.concat("l_returnflag", "l_linestatus").alias("channel"),
                   F.col(c.qty).alias("qty"), F.col(c.dollars).alias("dollars"),
                   F.col(c.ship_date).alias("ship_ts"))
    if ship_from is not None:
        li = li.filter(F.col("ship_ts") >= _ts(ship_from))
    if ship_to is not None:
        li = li.filter(F.col("ship_ts") < _ts(ship_to + _dt.timedelta(days=1)))
    li = li.withColumn("sale_date", F.to_date("ship_ts")).drop("ship_ts")

    cust = t.customer.select("c_custkey", "c_nationkey", F.col(c.retailer).alias("retailer"))
    orders = t.orders.select("o_orderkey", "o_custkey")
    part = t.part.select("p_partkey", F.col(c.category).alias("category"),
                         F.col(c.brand).alias("brand"), F.col(c.ppg).alias("ppg"))
    if cfg.hot_key_salt_buckets > 0:
        from demandlab.operators.joins import salted_join
        n = cfg.hot_key_salt_buckets
        order_cust = salted_join(orders, cust.withColumnRenamed("c_custkey", "o_custkey"), "o_custkey", "left", n,
                                 ["o_orderkey"]).select("o_orderkey", "c_nationkey", "retailer")
        joined = salted_join(li.join(order_cust, li.l_orderkey == order_cust.o_orderkey, "left"),
                             part.withColumnRenamed("p_partkey", "l_partkey"), "l_partkey", "left", n,
                             ["l_orderkey", "sale_date", "qty", "dollars"])
    else:
        order_cust = orders.join(cust, orders.o_custkey == cust.c_custkey, "left").select("o_orderkey", "c_nationkey", "retailer")
        joined = (li.join(order_cust, li.l_orderkey == order_cust.o_orderkey, "left")
                    .join(part, li.l_partkey == part.p_partkey, "left"))
    return joined.select("sale_date", "retailer", "c_nationkey", "category", "brand", "ppg", "channel", "qty", "dollars")


def with_places(lines: DataFrame, t: Tables, cfg: ModelConfig = DEFAULT_CONFIG) -> DataFrame:
    """State and business of each line's nation key (25 and 5 rows, broadcast)."""
    c = cfg.columns
    nation = F.broadcast(t.nation.select("n_nationkey", "n_regionkey", F.col("n_name")))
    region = F.broadcast(t.region.select("r_regionkey", F.col("r_name")))
    geo = nation.join(region, nation.n_regionkey == region.r_regionkey, "left")
    return (lines.join(F.broadcast(geo), F.col("c_nationkey") == F.col("n_nationkey"), "left")
            .withColumns({"state": F.col(c.state), "business": F.col(c.business)})
            .drop("c_nationkey", *geo.columns))


def sales_fact(t: Tables, cfg: ModelConfig = DEFAULT_CONFIG,
               ship_from: _dt.date | None = None, ship_to: _dt.date | None = None) -> DataFrame:
    """Daily ledger lines with their customer/product hierarchy.

    Columns: sale_date, retailer, state, business, category, brand, ppg,
    channel, qty, dollars.  ``ship_from``/``ship_to`` (inclusive) prune the
    line-item scan.
    """
    return with_places(ledger_lines(t, cfg, ship_from, ship_to), t, cfg).select(
        "sale_date", *FACT_KEYS, "channel", "qty", "dollars")


def with_week_fields(df: DataFrame, date_col: str = "week_ending_date") -> DataFrame:
    """ISO week of year and calendar year of the week-ending date."""
    return df.withColumns({
        "week_of_year": F.weekofyear(date_col),
        "year": F.year(date_col),
    })


def weekly_fact(t: Tables, cfg: ModelConfig = DEFAULT_CONFIG, week_rule: str = "same_or_next") -> DataFrame:
    """Daily ledger -> product x state x retailer x channel x week sums (+ line
    count).  This is the run's only ledger join.  Materialized once as a
    year-partitioned table in the checkpoint folder: it is the shared input of
    the reporting queries and of the modelling series (which read only the
    two model years' partitions).

    Lines meet for the sums by product and year, still narrow: the lines of a
    product come together from its join, so its names cost a shuffle next to
    nothing, a product that sells most is spread over the years, and the result
    is written from there without another shuffle.  The number of these tasks
    follows the number of lines, so that a task's hash tables stay in memory.
    """
    def build():
        lines = ledger_lines(t, cfg).withColumn("week_ending_date", week_ending("sale_date", week_rule)).drop("sale_date")
        tasks = -(-t.lineitem.count() // LINES_PER_TASK) or 1
        lines = lines.repartition(tasks, "category", "brand", "ppg", F.year("week_ending_date"))
        weekly = (with_places(with_week_fields(lines), t, cfg)
                  .groupBy("week_ending_date", *FACT_KEYS, "channel", "week_of_year", "year")
                  .agg(F.sum("qty").alias("qty"), F.sum("dollars").alias("dollars"),
                       F.count(F.lit(1)).alias("n_lines")))
        return weekly.select("week_ending_date", *FACT_KEYS, "channel", "qty", "dollars", "n_lines", "week_of_year", "year")
    return shared(t, ("weekly_fact", cfg, week_rule), build, partition_by=["year"])


def weekly_sales(t: Tables, cfg: ModelConfig = DEFAULT_CONFIG, with_channel: bool = True,
                 week_rule: str = "same_or_next") -> DataFrame:
    """Weekly sums by product x state x retailer (x channel)."""
    w = weekly_fact(t, cfg, week_rule)
    if with_channel:
        return w.drop("n_lines")
    return (w.groupBy("week_ending_date", *FACT_KEYS, "week_of_year", "year")
             .agg(F.sum("qty").alias("qty"), F.sum("dollars").alias("dollars")))


def channel_totals(t: Tables, cfg: ModelConfig = DEFAULT_CONFIG) -> DataFrame:
    """Yearly totals per channel with the channel description attached
    (the 6-row channel map is broadcast)."""
    totals = (weekly_fact(t, cfg).groupBy("year", "channel")
              .agg(F.sum("qty").alias("qty"), F.sum("dollars").alias("dollars"),
                   F.sum("n_lines").alias("n_lines")))
    return totals.join(channel_mapping(t.spark), "channel", "left")


def business_filter(df: DataFrame, cfg: ModelConfig = DEFAULT_CONFIG, *, shipments: bool = False,
                    excluded_categories=None, keep_null: bool = False) -> DataFrame:
    """Business filters on weekly rows.

    POS keeps strictly positive sales; shipments keep zeros (returns removed)
    and only weeks up to the training end.  ``keep_null=True`` follows the
    pandas semantics where a NULL category/hierarchy survives ``NOT IN`` /
    ``NOT (a AND b)``; the default is SQL three-valued logic.
    """
    excluded = list(cfg.excluded_categories if excluded_categories is None else excluded_categories)
    wk = F.col("week_ending_date")
    cond = wk > F.lit(cfg.history_start)
    if shipments:
        cond = cond & (wk <= F.lit(cfg.latest_week))
    if excluded:
        not_excluded = ~F.col("category").isin(excluded)
        cond = cond & (F.coalesce(not_excluded, F.lit(True)) if keep_null else not_excluded)
    cond = cond & ~((F.col("ppg") == "") | F.col("ppg").isNull())
    blank_hier = ((F.col("business") == "") & (F.col("category") == "")
                  & (F.col("brand") == "") & (F.col("ppg") != ""))
    cond = cond & (~F.coalesce(blank_hier, F.lit(False)) if keep_null else ~blank_hier)
    if shipments:
        cond = cond & (F.col("dollars") >= 0) & (F.col("qty") >= 0)
    else:
        cond = cond & (F.col("dollars") > 0) & (F.col("qty") > 0)
    cond = cond & ~(F.col("dollars").isNull() & F.col("qty").isNull())
    return df.filter(cond)


def business_filtered_sales(t: Tables, cfg: ModelConfig = DEFAULT_CONFIG,
                            excluded_categories=("PROMO",)) -> DataFrame:
    weekly = weekly_sales(t, cfg, with_channel=False)
    out = business_filter(weekly, cfg, excluded_categories=excluded_categories)
    return out.withColumn("sell_id", composite_key("business", "category", "brand", "ppg", "state", "retailer"))


FILTER_STEPS = ["history_start", "training_end", "category", "ppg_blank",
                "blank_hierarchy", "returns", "null_sales"]
POS_FILTER_STEPS = ["history_start", "category", "ppg_blank", "blank_hierarchy", "returns", "null_sales"]


def filter_loss_report(t: Tables, cfg: ModelConfig = DEFAULT_CONFIG,
                       excluded_categories=("PROMO",), shipments: bool = True) -> DataFrame:
    """Rows / quantity / revenue lost at each filter step.

    Shipments: weekly rows by channel, training-end step, zeros kept.  POS:
    weekly rows without channel, no training-end step, strictly positive
    sales.  One pass: each step's cumulative predicate becomes a conditional
    sum, so the whole report is a single aggregation (one shuffle of one row
    per map task), then the wide row is unpivoted to one row per step.
    """
    w = weekly_sales(t, cfg, with_channel=shipments)
    wk = F.col("week_ending_date")
    sign_ok = ((F.col("dollars") >= 0) & (F.col("qty") >= 0)) if shipments else \
        ((F.col("dollars") > 0) & (F.col("qty") > 0))
    preds = [
        wk > F.lit(cfg.history_start),
        wk <= F.lit(cfg.latest_week),
        ~F.col("category").isin(list(excluded_categories)) if excluded_categories else F.lit(True),
        ~((F.col("ppg") == "") | F.col("ppg").isNull()),
        ~((F.col("business") == "") & (F.col("category") == "") & (F.col("brand") == "") & (F.col("ppg") != "")),
        sign_ok,
        ~(F.col("dollars").isNull() & F.col("qty").isNull()),
    ]
    steps = FILTER_STEPS
    if not shipments:
        preds.pop(1)
        steps = POS_FILTER_STEPS
    aggs = [F.count(F.lit(1)).alias("rows_0"), F.sum("qty").alias("qty_0"), F.sum("dollars").alias("dollars_0")]
    cum = F.lit(True)
    for i, p in enumerate(preds, start=1):
        cum = cum & F.coalesce(p, F.lit(False))
        aggs += [F.count(F.when(cum, 1)).alias(f"rows_{i}"),
                 F.sum(F.when(cum, F.col("qty"))).alias(f"qty_{i}"),
                 F.sum(F.when(cum, F.col("dollars"))).alias(f"dollars_{i}")]
    wide = w.agg(*aggs)
    stack = ", ".join(
        f"{i}, '{name}', rows_{i - 1}, rows_{i}, qty_{i - 1}, qty_{i}, dollars_{i - 1}, dollars_{i}"
        for i, name in enumerate(steps, start=1))
    long = wide.selectExpr(
        f"stack({len(steps)}, {stack}) as (step, filter_name, rows_before, rows_after, "
        "qty_before, qty_after, dollars_before, dollars_after)")
    pct = lambda a, b: F.round(F.coalesce(F.try_divide(100.0 * (F.col(a) - F.col(b)), F.col(a)), F.lit(0.0)), 4)
    return long.select(
        "step", "filter_name",
        F.col("rows_before").cast("long").alias("rows_before"),
        F.col("rows_after").cast("long").alias("rows_after"),
        pct("rows_before", "rows_after").alias("pct_rows_lost"),
        pct("qty_before", "qty_after").alias("pct_qty_lost"),
        pct("dollars_before", "dollars_after").alias("pct_dollars_lost"),
    )
