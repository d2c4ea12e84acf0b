"""Ledger lines as landed: two tables (history and current), business filters,
and the product hierarchy join on padded id and channel.

Driver-table analogs (declared here only): history / current := line items
shipped before / from the first day of this year; material := part key as
text, blank for one supplier in eleven; version := line status; bill date :=
ship date, missing on seventh lines (the creation date then counts); account
:= supplier group; value := extended price, zero where no discount was given;
channel := return flag; fiscal period := yyyymm of the creation date.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandlab.config import DEFAULT_CONFIG, ModelConfig
from demandlab.functions.scalar import pad_id
from demandlab.sources.tables import Tables

ACCOUNT_LEFT_OUT, VERSION = "C3", "F"
ID_WIDTH = 10


def _ts(d: _dt.date) -> Column:
    return F.lit(d.isoformat()).cast("timestamp_ntz")


def _landed(lines: DataFrame) -> DataFrame:
    day = F.to_date("l_shipdate")
    return lines.select(
        F.when(F.pmod("l_suppkey", F.lit(11)) == 0, "").otherwise(F.col("l_partkey").cast("string")).alias("material"),
        F.concat(F.lit("C"), F.pmod("l_suppkey", F.lit(7)).cast("string")).alias("account"),
        F.col("l_linestatus").alias("version"), F.when(F.col("l_linenumber") != 7, day).alias("bill_date"), day.alias("created"),
        F.when(F.col("l_discount") == 0, 0.0).otherwise(F.col("l_extendedprice")).alias("value"),
        F.col("l_quantity").alias("qty"), F.col("l_returnflag").alias("channel"),
        (F.year(day) * 100 + F.month(day)).alias("period"))


def ledger_tables(t: Tables, cfg: ModelConfig = DEFAULT_CONFIG) -> tuple[DataFrame, DataFrame]:
    """(history, current); the cut is a plain predicate that reaches the scan."""
    cut = _ts(cfg.ty_start)
    return _landed(t.lineitem.filter(F.col("l_shipdate") < cut)), _landed(t.lineitem.filter(F.col("l_shipdate") >= cut))


def fiscal_periods(cfg: ModelConfig) -> list[int]:
    """The twelve periods of last year and of this year."""
    return [y * 100 + m for y in (cfg.ly_year, cfg.ty_year) for m in range(1, 13)]


def ledger_rules(cfg: ModelConfig = DEFAULT_CONFIG) -> dict[str, Column]:
    """Business filters by name.  The bill-date rule takes lines billed in the
    two years or, without a bill date, created in them up to the latest week."""
    lo, hi = F.lit(_dt.date(cfg.ly_year, 1, 1)), F.lit(cfg.latest_week)
    bill, made = F.col("bill_date"), F.col("created")
    return {
        "material": F.col("material") != "",
        "version": F.col("version") == VERSION,
        "bill_date": ((bill >= lo) & (bill <= hi)) | (bill.isNull() & (made >= lo) & (made <= hi)),
        "account": F.col("account") != ACCOUNT_LEFT_OUT,
        "value": F.col("value") != 0,
        "period": F.col("period").isin(fiscal_periods(cfg)),
    }


def ledger_lines(t: Tables, cfg: ModelConfig = DEFAULT_CONFIG) -> DataFrame:
    """Filtered lines of both tables."""
    keep = F.lit(True)
    for rule in ledger_rules(cfg).values():
        keep = keep & rule
    history, current = ledger_tables(t, cfg)
    return history.filter(keep).unionByName(current.filter(keep))


def ledger_filtered(t: Tables, cfg: ModelConfig = DEFAULT_CONFIG) -> DataFrame:
    return (ledger_lines(t, cfg).groupBy("period", "channel", pad_id("material", ID_WIDTH).alias("material_id"))
            .agg(F.count(F.lit(1)).alias("n_lines"), F.sum("qty").alias("qty"), F.sum("value").alias("value")))


def ledger_filter_loss(t: Tables, cfg: ModelConfig = DEFAULT_CONFIG) -> DataFrame:
    """How many lines each rule fails on its own (NULL fails, as in a filter)."""
    history, current = ledger_tables(t, cfg)
    rules = ledger_rules(cfg)
    counts = history.unionByName(current).agg(
        *[F.count(F.when(~F.coalesce(r, F.lit(False)), 1)).alias(n) for n, r in rules.items()])
    return counts.selectExpr(f"stack({len(rules)}, " + ", ".join(f"'{n}', {n}" for n in rules) + ") as (rule, n_removed)")


def product_hierarchy(t: Tables) -> DataFrame:
    """(material_id, channel) -> category, management_group: the channels a part
    was sold in; one part in five is unknown, size 1 has no management group."""
    sold = t.lineitem.select("l_partkey", F.col("l_returnflag").alias("channel")).distinct()
    part = t.part.filter(F.pmod("p_partkey", F.lit(5)) != 0)
    return sold.join(part, sold.l_partkey == part.p_partkey, "inner").select(
        pad_id("p_partkey", ID_WIDTH).alias("material_id"), "channel", F.col("p_type").alias("category"),
        F.when(F.col("p_size") != 1, F.col("p_brand")).alias("management_group"))


def hierarchy_sales(t: Tables, cfg: ModelConfig = DEFAULT_CONFIG) -> DataFrame:
    """Filtered ledger lines left-joined to the hierarchy on (id, channel)."""
    lines = ledger_lines(t, cfg).withColumn("material_id", pad_id("material", ID_WIDTH))
    return (lines.join(product_hierarchy(t), ["material_id", "channel"], "left")
            .groupBy("period", "channel", "category", "management_group")
            .agg(F.count(F.lit(1)).alias("n_lines"), F.sum("qty").alias("qty"), F.sum("value").alias("value")))


def managed_sales(t: Tables, cfg: ModelConfig = DEFAULT_CONFIG) -> DataFrame:
    """Last year's sales by management group, lines without a group left out."""
    h = hierarchy_sales(t, cfg)
    ly = F.floor(F.col("period") / 100) == cfg.ly_year
    return h.filter(ly & F.col("management_group").isNotNull()).groupBy("management_group") \
        .agg(F.sum("n_lines").alias("n_lines"), F.sum("qty").alias("qty"), F.sum("value").alias("value"))
