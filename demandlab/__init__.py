"""demandlab — weekly demand-impact analytics as lazy Spark plans.

Layers:

* ``sources``   — table/CSV/JSON readers, literal lookup tables, sinks.
* ``functions`` — column expressions (week-ending rules, growth, decay ladder).
* ``operators`` — reusable DataFrame operators (validated joins, rolling
  windows, fills, grids, data-quality checks, reshaping).
* ``plans``     — the domain chains: sales facts, YoY, lifespan split,
  external features, forecasts, corrections and the reporting stitch.
* ``streaming`` — intentionally empty: the pipeline is a weekly batch.

Every public ``build_*`` / plan function takes DataFrames (or a ``Tables``
handle) and returns a DataFrame; nothing is collected to the driver except
calendar- or lookup-sized values.
"""

from demandlab.config import ModelConfig, DEFAULT_CONFIG  # noqa: F401
