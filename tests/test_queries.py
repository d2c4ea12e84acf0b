"""Registered queries: smoke entry, oracle agreement on the small fixture,
and model invariants."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from tools.check_oracle import TABLES, rows_of

from conftest import SF_SMALL, SF_ORACLE

ORACLE_KEYS = ["weekly_sales", "yoy_growth", "lifespan_split", "peak_growth", "naive_rate_of_sale",
               "milestone_forecast_pos", "forecast_adjusted", "promo_dampened", "actual_forecast_stitch",
               "policy_exposure", "master_current", "filter_loss_report"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        p = f"{SF_ORACLE}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def test_entry_runs_on_smoke_fixture(spark):
    df = E.entry(spark)
    assert df.columns[:3] == ["sell_id", "state", "category"]
    assert df.count() >= 0


def test_every_query_has_an_oracle_or_is_listed():
    q, s = E.queries(), E.oracle_sql()
    assert set(s) <= set(q)
    assert len(q) >= 40


@pytest.mark.parametrize("key", ORACLE_KEYS)
def test_query_matches_oracle(spark, duck, key):
    spark_rows = rows_of(E.queries()[key](spark, SF_ORACLE).toPandas())
    oracle_rows = rows_of(duck.sql(E.oracle_sql()[key]).df())
    assert spark_rows[0] == oracle_rows[0]
    assert spark_rows[1] == oracle_rows[1]


def test_invariants(spark):
    q = E.queries()
    naive = q["naive_rate_of_sale"](spark, SF_ORACLE)
    assert naive.filter(F.col("forecast_quantity") < 0).count() == 0
    grid = q["weekly_grid"](spark, SF_ORACLE)
    n_series = grid.select("sell_id").distinct().count()
    n_weeks = grid.select("week_ending_date").distinct().count()
    assert grid.count() == n_series * n_weeks
    stitch = q["actual_forecast_stitch"](spark, SF_ORACLE)
    products = stitch.filter("sell_id IS NOT NULL")
    assert products.groupBy("sell_id", "week_ending_date").count().filter("count > 1").count() == 0
    # one marker row per state and milestone
    markers = stitch.filter("sell_id IS NULL")
    assert markers.count() == 3 * markers.select("state").distinct().count()
    comb = q["promo_dampened"](spark, SF_ORACLE)
    # dampening never touches complete series
    assert comb.filter((F.col("common_product") == 1) & (F.col("dampen_multiplier") != 1.0)).count() == 0


def test_grouped_seasonal_fit_invariants(spark):
    fit = E.queries()["seasonal_fit_grouped"](spark, SF_ORACLE)
    per = fit.groupBy("sell_id").count().collect()
    assert per and all(r["count"] == 24 for r in per)
    assert fit.filter(F.col("seasonal_forecast").isNull()).count() == 0


def test_ship_stitch_excludes_broken_series_and_keeps_keys_unique(spark):
    s = E.queries()["ship_actual_forecast_stitch"](spark, SF_ORACLE)
    assert s.filter((F.col("state") == "EUROPE") & (F.col("category") == "ECONOMY")).count() == 0
    assert s.groupBy("sell_id", "week_ending_date").count().filter("count > 1").count() == 0


def test_pipeline_writes_every_stage(spark):
    import tempfile
    from demandlab.pipeline import STAGES, run
    out = tempfile.mkdtemp(prefix="demandlab-pipe-")
    written = run(spark, SF_SMALL, out)
    assert set(written) == set(STAGES)
    assert spark.read.parquet(written["pos_reporting"]).count() > 0
    assert spark.read.parquet(written["weekly_sales"]).count() > 0


def test_scenario_parameter_selects_projection_days(spark):
    import dataclasses
    from demandlab.config import DEFAULT_CONFIG
    from demandlab.plans.external import policy_exposure
    from demandlab.sources.tables import Tables
    t = Tables(spark, SF_SMALL)
    cur = policy_exposure(t, DEFAULT_CONFIG).count()
    best = policy_exposure(t, dataclasses.replace(DEFAULT_CONFIG, scenario="best")).count()
    assert 0 < best <= cur
    with pytest.raises(ValueError):
        policy_exposure(t, dataclasses.replace(DEFAULT_CONFIG, scenario="bogus"))


def test_pipeline_cli_stage_subset(spark, capsys):
    import tempfile
    from demandlab.pipeline import main
    out = tempfile.mkdtemp(prefix="demandlab-cli-")
    main(["--source", SF_SMALL, "--out", out, "--stages", "pos_lifespan,state_milestones"])
    printed = capsys.readouterr().out.strip().splitlines()
    assert [line.split("\t")[0] for line in printed] == ["pos_lifespan", "state_milestones"]
    assert spark.read.parquet(f"{out}/state_milestones").count() == 5
