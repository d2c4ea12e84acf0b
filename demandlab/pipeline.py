"""End-to-end weekly run: every chain, written as stage tables.

    python -m demandlab.pipeline --source /path/to/tables --out /shared/out [--stages a,b]

Each stage is a lazy plan; writing it is the only action.  Shared inputs
(weekly series, weekly fact, per-state daily table, model outputs) are
materialized once per run into ``spark.checkpoint.dir`` and reused by every
stage that reads them, so a lost executor restarts from those files, not from
the ledger join; they are deleted when the run ends.
"""

from __future__ import annotations

import argparse
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from demandlab.config import DEFAULT_CONFIG, ModelConfig
from demandlab.session import Run
from demandlab.plans import external, facts, forecast, report, series
from demandlab.sources.files import write_stage
from demandlab.sources.tables import Tables

def _q():
    from demandlab.operators import quality
    return quality


STAGES: dict[str, Callable[[Tables, ModelConfig], DataFrame]] = {
    # sales facts and YoY
    "weekly_sales": lambda t, c: facts.weekly_sales(t, c),
    "yoy_full_outer": lambda t, c: series.yoy_full_outer(t, c),
    "filter_loss_report": lambda t, c: facts.filter_loss_report(t, c),
    # external features
    "master_current": lambda t, c: external.master_current(t, c, validate=True),
    "master_projection": lambda t, c: external.master_projection(t, c, validate=True),
    "scenario_merge": lambda t, c: external.scenario_merge(t, c),
    "policy_duration": lambda t, c: external.policy_duration(t, c),
    # POS chain
    "pos_fact": lambda t, c: report.pos_fact_with_markers(t, c),
    "pos_lifespan": lambda t, c: series.lifespan_split(t, c),
    "pos_seasonal": lambda t, c: forecast.trend_seasonal_model(t, c),
    "pos_results": lambda t, c: report.pos_forecasts(t, c),
    "pos_reporting": lambda t, c: report.actual_forecast_stitch(t, c),
    "pos_null_key_rejects": lambda t, c: _q().null_key_rejects(report.pos_forecasts(t, c), ["state", "category"]),
    "pos_series_count": lambda t, c: _q().distinct_count(series.model_weekly(t, c), ["sell_id"]),
    # shipment chain
    "ship_lifespan": lambda t, c: series.lifespan_split(t, c, shipments=True),
    "ship_results": lambda t, c: report.running_total_correction(t, c),
    "ship_reporting": lambda t, c: report.ship_actual_forecast_stitch(t, c),
    "ship_coverage": lambda t, c: report.ship_coverage(t, c),
    "filter_loss_pos": lambda t, c: facts.filter_loss_report(t, c, shipments=False),
    "state_milestones": lambda t, c: forecast.state_milestones(t, c),
}


def run(spark: SparkSession, source: str | None, out: str, cfg: ModelConfig = DEFAULT_CONFIG,
        stages=None, fmt: str = "parquet", database: str | None = None, landed: str | None = None) -> dict[str, str]:
    """``landed``: folder of external file drops; they become the stage landed_master."""
    written = {}
    with Run(spark) as held:  # intermediates go when the run ends
        t = Tables(spark, source, database, held)
        for name in (stages or list(STAGES)):
            written[name] = write_stage(STAGES[name](t, cfg), out, name, fmt)
        if landed is not None:
            from demandlab.plans.landed import landed_master
            written["landed_master"] = write_stage(landed_master(t, landed, cfg), out, "landed_master", fmt)
    return written


def main(argv=None) -> None:
    ap = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    ap.add_argument("--source", help="directory of <table>.parquet (omit to read catalog tables)")
    ap.add_argument("--database", help="catalog database when --source is omitted")
    ap.add_argument("--out", required=True, help="shared output directory")
    ap.add_argument("--landed", help="folder of external file drops (one sub-folder a source)")
    ap.add_argument("--stages", help="comma-separated subset of: " + ",".join(STAGES))
    a = ap.parse_args(argv)
    from demandlab.session import build_session
    spark = SparkSession.getActiveSession() or build_session()
    res = run(spark, a.source, a.out, stages=a.stages.split(",") if a.stages else None, database=a.database, landed=a.landed)
    for k, v in res.items():
        print(f"{k}\t{v}")


if __name__ == "__main__":
    main()
