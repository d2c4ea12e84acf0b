"""Independent DuckDB SQL for each registered query (the correctness oracle).

Written from the operator semantics, not generated from the Spark plans.
Dialect notes: DuckDB ``dayofweek`` is 0 = Sunday (Spark: 1 = Sunday), so
the same-or-next Saturday is ``d + (6 - dayofweek(d))``; division by zero
yields inf in DuckDB, so ratios use ``/ nullif(x, 0)``; ``week()`` is the
ISO week like Spark's ``weekofyear``.
"""

from __future__ import annotations

import datetime as _dt

from demandlab.config import DEFAULT_CONFIG, ModelConfig


def d(x: _dt.date) -> str:
    return f"DATE '{x.isoformat()}'"


def wk(x: str) -> str:
    """Same-or-next Saturday of a DATE expression."""
    return f"CAST({x} + CAST(6 - dayofweek({x}) AS INTEGER) AS DATE)"


def wk_monday(x: str) -> str:
    """Saturday of the Mon..Sun ISO week of a DATE expression."""
    return f"CAST(date_trunc('week', {x}) + INTERVAL 5 DAY AS DATE)"


FACT = """fact AS (
  SELECT CAST(l.l_shipdate AS DATE) AS sale_date,
         c.c_mktsegment AS retailer, n.n_name AS state, r.r_name AS business,
         p.p_type AS category, p.p_brand AS brand, p.p_name AS ppg,
         l.l_returnflag || l.l_linestatus AS channel,
         l.l_quantity AS qty, l.l_extendedprice AS dollars
  FROM lineitem l
  LEFT JOIN orders o ON l.l_orderkey = o.o_orderkey
  LEFT JOIN customer c ON o.o_custkey = c.c_custkey
  LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
  LEFT JOIN region r ON n.n_regionkey = r.r_regionkey
  LEFT JOIN part p ON l.l_partkey = p.p_partkey
  WHERE l.l_quantity <> 0
)"""


def weekly_cte(name: str = "wsales", channel: bool = True) -> str:
    ch = ", channel" if channel else ""
    return f"""{name} AS (
  SELECT week_ending_date, retailer, state, business, category, brand, ppg{ch}, qty, dollars,
         CAST(week(week_ending_date) AS INTEGER) AS week_of_year,
         CAST(year(week_ending_date) AS INTEGER) AS year
  FROM (SELECT {wk('sale_date')} AS week_ending_date, retailer, state, business, category, brand, ppg{ch},
               sum(qty) AS qty, sum(dollars) AS dollars
        FROM fact GROUP BY ALL) x
)"""


def model_weekly_cte(cfg: ModelConfig = DEFAULT_CONFIG, shipments: bool = False) -> str:
    """Modelling grain (state := region, category := product type), filtered."""
    cmp = ">=" if shipments else ">"
    excl = ""
    if cfg.excluded_categories:
        excl = "AND category NOT IN (" + ", ".join(f"'{c}'" for c in cfg.excluded_categories) + ")"
    return f"""mw AS (
  SELECT week_ending_date, state, category, qty, dollars,
         CAST(week(week_ending_date) AS INTEGER) AS week_of_year,
         CAST(year(week_ending_date) AS INTEGER) AS year,
         coalesce(category, 'None') || '_' || coalesce(state, 'None') AS sell_id
  FROM (SELECT {wk('sale_date')} AS week_ending_date, business AS state, category,
               sum(qty) AS qty, sum(dollars) AS dollars
        FROM fact
        WHERE NOT (ppg = '' OR ppg IS NULL)
          AND NOT (business = '' AND category = '' AND brand = '' AND ppg <> '') {excl}
        GROUP BY ALL) x
  WHERE week_ending_date > {d(cfg.history_start)} AND week_ending_date <= {d(cfg.latest_week)}
    AND qty {cmp} 0 AND dollars {cmp} 0 AND NOT (qty IS NULL AND dollars IS NULL)
)"""


def yoy_cte(cfg: ModelConfig = DEFAULT_CONFIG) -> str:
    return f"""yoy AS (
  SELECT t.sell_id, t.state, t.category, t.week_ending_date, t.week_of_year,
         t.qty AS qty_ty, t.dollars AS dollars_ty, l.qty AS qty_ly, l.dollars AS dollars_ly,
         (t.qty - l.qty) / nullif(l.qty, 0) AS growth_qty,
         (t.dollars - l.dollars) / nullif(l.dollars, 0) AS growth_sales
  FROM (SELECT * FROM mw WHERE year = {cfg.ty_year}) t
  LEFT JOIN (SELECT * FROM mw WHERE year = {cfg.ly_year}) l
    ON t.state IS NOT DISTINCT FROM l.state AND t.category IS NOT DISTINCT FROM l.category
   AND t.week_of_year = l.week_of_year
)"""


def lifespan_cte(cfg: ModelConfig = DEFAULT_CONFIG, shipments: bool = False) -> str:
    if shipments:
        target = f"(SELECT count(DISTINCT week_ending_date) FROM mw WHERE year = {cfg.ty_year})"
        ly_filter = f"year = {cfg.ly_year} AND week_of_year <= {cfg.ship_ly_weeks}"
        ly_target = cfg.ship_ly_weeks
    else:
        target = f"(SELECT max(week_of_year) FROM mw WHERE year = {cfg.ty_year})"
        ly_filter = f"year = {cfg.ly_year}"
        ly_target = cfg.ly_full_weeks
    return f"""per_ty AS (
  SELECT sell_id, state, category, count(DISTINCT week_ending_date) AS weeks_ty
  FROM mw WHERE year = {cfg.ty_year} GROUP BY sell_id, state, category
),
per_ly AS (
  SELECT sell_id, count(DISTINCT week_ending_date) AS weeks_ly FROM mw WHERE {ly_filter} GROUP BY sell_id
),
lifespan AS (
  SELECT p.sell_id, p.state, p.category, CAST(p.weeks_ty AS BIGINT) AS weeks_ty,
         CAST(coalesce(l.weeks_ly, 0) AS BIGINT) AS weeks_ly,
         CASE WHEN p.weeks_ty = {target} AND coalesce(l.weeks_ly = {ly_target}, false) THEN 'complete'
              WHEN p.weeks_ty < {target} THEN 'incomplete'
              ELSE 'missing' END AS status
  FROM per_ty p LEFT JOIN per_ly l ON p.sell_id = l.sell_id
)"""


def peak_cte(cfg: ModelConfig = DEFAULT_CONFIG, src: str = "yoy_c") -> str:
    """Per-series peak/baseline statistics over ``src`` (yoy rows)."""
    return f"""pk_rank AS (
  SELECT sell_id, growth_qty, qty_ly,
         row_number() OVER (PARTITION BY sell_id ORDER BY growth_qty DESC, week_of_year ASC) AS rn
  FROM {src}
  WHERE week_of_year BETWEEN {cfg.peak_week_from} AND {cfg.peak_week_to} AND growth_qty IS NOT NULL
),
base AS (
  SELECT sell_id,
         quantile_cont(growth_qty, 0.5) FILTER (WHERE week_ending_date >= {d(cfg.pre_event_from)}
                                                AND week_ending_date < {d(cfg.pre_event_to)}) AS median_baseline,
         avg(growth_qty) FILTER (WHERE week_ending_date >= {d(cfg.pre_event_from)}
                                 AND week_ending_date < {d(cfg.pre_event_to)}) AS mean_baseline,
         max(growth_qty) FILTER (WHERE week_ending_date = {d(cfg.latest_week)}) AS latest_growth,
         max(qty_ty) FILTER (WHERE week_ending_date = {d(cfg.latest_week)}) AS latest_qty
  FROM {src} GROUP BY sell_id
),
peak AS (
  SELECT b.sell_id, k.growth_qty AS peak_max_growth, k.qty_ly AS max_qty_ly,
         CASE WHEN k.growth_qty < 0 THEN 1 ELSE 0 END AS negative_impact,
         b.median_baseline, b.mean_baseline, b.latest_growth, b.latest_qty
  FROM base b LEFT JOIN (SELECT * FROM pk_rank WHERE rn = 1) k ON b.sell_id = k.sell_id
)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


# ------------------------------------------------------------ forecasting ----

def iso_w1_saturday(year: int) -> _dt.date:
    jan4 = _dt.date(year, 1, 4)
    return jan4 - _dt.timedelta(days=jan4.weekday()) + _dt.timedelta(days=5)


def cal_cte(cfg: ModelConfig = DEFAULT_CONFIG) -> str:
    return f"""proj_daily AS (
  SELECT n.n_name AS state, CAST(o.o_orderdate AS DATE) AS date, count(*) AS n_orders, sum(o.o_totalprice) AS order_value
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
  GROUP BY ALL
),
cal AS (
  SELECT week_ending_date, week_of_year, count(state) AS n_states
  FROM (SELECT state, {wk_monday('date')} AS week_ending_date, CAST(week(date) AS INTEGER) AS week_of_year,
               year(date) AS year, sum(n_orders) AS n_orders
        FROM proj_daily GROUP BY ALL) x
  WHERE year = {cfg.ty_year} AND week_of_year <= {cfg.horizon_week}
  GROUP BY ALL
)"""


def projection_cte(cfg: ModelConfig = DEFAULT_CONFIG) -> str:
    """CTE ``pm0``: peak and fall of each state's projection, ``pn``: the country's peak."""
    a, b = d(cfg.projection_from), d(cfg.projection_to)
    return f"""pj AS (
  SELECT r.r_name AS state, CAST(o.o_orderdate AS DATE) AS day, count(*) AS n
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
  WHERE CAST(o.o_orderdate AS DATE) BETWEEN {a} AND {b} GROUP BY ALL
),
pday AS (SELECT CAST(unnest(generate_series({a}, {b}, INTERVAL 1 DAY)) AS DATE) AS day),
pseries AS (
  SELECT s.state, p.day, coalesce(pj.n, 0) AS n
  FROM (SELECT DISTINCT state FROM pj) s CROSS JOIN pday p LEFT JOIN pj ON pj.state = s.state AND pj.day = p.day
),
ppeak AS (SELECT state, day AS peak_day, n AS peak_value FROM pseries
          QUALIFY row_number() OVER (PARTITION BY state ORDER BY n DESC, day) = 1),
pn AS (SELECT day AS national_peak_day FROM (SELECT day, sum(n) AS n FROM pseries GROUP BY day) x ORDER BY n DESC, day LIMIT 1),
pm0 AS (
  SELECT k.state, k.peak_day, k.peak_value, coalesce(min(s.day), {b}) AS fall_day, count(s.day) > 0 AS crossed
  FROM ppeak k LEFT JOIN pseries s ON s.state = k.state AND s.day > k.peak_day AND s.n < {cfg.fall_share} * k.peak_value
  GROUP BY ALL
)"""


def ms_cte(cfg: ModelConfig = DEFAULT_CONFIG) -> str:
    L = d(cfg.latest_week)
    return f"""{projection_cte(cfg)},
ms0 AS (
  SELECT state, {wk('national_peak_day')} AS first_milestone_date, {wk('fall_day')} AS thirty_pct_week FROM pm0 CROSS JOIN pn
),
ms1 AS (
  SELECT *, CASE WHEN datediff('day', {L}, thirty_pct_week) / 7.0 >= 6 THEN CAST(thirty_pct_week - 28 AS DATE)
                 ELSE thirty_pct_week END AS pos_second_milestone_date
  FROM ms0
),
ms AS (
  SELECT state, first_milestone_date, thirty_pct_week, pos_second_milestone_date,
         CAST(pos_second_milestone_date + 14 AS DATE) AS pos_third_milestone_date,
         CAST(datediff('day', {L}, pos_second_milestone_date) // 7 AS INTEGER) AS pos_weeks_to_second,
         CASE WHEN datediff('day', {L}, pos_second_milestone_date) / 7.0 <= 2 THEN 1
              WHEN datediff('day', {L}, pos_second_milestone_date) / 7.0 = 3 THEN 2
              WHEN datediff('day', {L}, pos_second_milestone_date) / 7.0 > 3 THEN 3 END AS fc_type,
         CASE WHEN thirty_pct_week <= first_milestone_date THEN CAST(first_milestone_date + 21 AS DATE)
              ELSE thirty_pct_week END AS ship_second_milestone_date,
         CAST(CASE WHEN thirty_pct_week <= first_milestone_date THEN CAST(first_milestone_date + 21 AS DATE)
              ELSE thirty_pct_week END + 14 AS DATE) AS ship_third_milestone_date
  FROM ms1
)"""


def model_base(cfg: ModelConfig = DEFAULT_CONFIG, shipments: bool = False) -> list[str]:
    """CTEs: fact, mw, yoy, lifespan, cal, ms."""
    return [FACT, model_weekly_cte(cfg, shipments), yoy_cte(cfg), lifespan_cte(cfg, shipments), cal_cte(cfg), ms_cte(cfg)]


def milestone_ctes(cfg: ModelConfig = DEFAULT_CONFIG, shipments: bool = False) -> list[str]:
    """CTE ``mp``: milestone forecast rows (before post-processing)."""
    L = d(cfg.latest_week)
    head = [
        "yoy_c AS (SELECT * FROM yoy WHERE sell_id IN (SELECT sell_id FROM lifespan WHERE status = 'complete'))",
        peak_cte(cfg, "yoy_c"),
        f"""mg AS (
  SELECT k.sell_id, k.state, k.category, c.week_ending_date, c.week_of_year,
         y.qty_ty, y.dollars_ty, y.growth_qty, y.growth_sales,
         p.latest_growth AS gl, p.latest_qty AS ql, p.median_baseline, p.negative_impact,
         p.peak_max_growth, p.max_qty_ly,
         m.first_milestone_date, m.thirty_pct_week, m.pos_second_milestone_date, m.pos_third_milestone_date,
         m.pos_weeks_to_second AS w, m.fc_type, m.ship_second_milestone_date,
         CAST(datediff('day', {L}, c.week_ending_date) // 7 AS INTEGER) AS k
  FROM (SELECT sell_id, state, category FROM lifespan WHERE status = 'complete' AND state IS NOT NULL) k
  CROSS JOIN cal c
  LEFT JOIN yoy y ON y.sell_id = k.sell_id AND y.week_ending_date = c.week_ending_date
  JOIN peak p ON p.sell_id = k.sell_id
  JOIN ms m ON m.state = k.state
)"""]
    if not shipments:
        body = """mp AS (
  SELECT sell_id, state, category, week_ending_date, week_of_year, qty_ty, dollars_ty, growth_qty, growth_sales,
         CASE WHEN k < 0 THEN 0.0 WHEN k = 0 THEN gl
              WHEN w <= 2 THEN median_baseline
              WHEN w = 3 THEN CASE WHEN k >= 5 THEN median_baseline ELSE gl * pow(0.5, k) END
              ELSE CASE WHEN k >= w + 2 THEN median_baseline WHEN k <= w THEN gl * pow(0.9, k)
                        ELSE gl * pow(0.9, w) * pow(0.5, k - w) END END AS forecast1,
         CASE WHEN k < 0 THEN 0.0 WHEN k = 0 THEN ql
              WHEN w > 3 AND k < w THEN CASE WHEN negative_impact = 0 THEN ql * pow(0.9, k) ELSE ql / pow(0.9, k) END
              ELSE 0.0 END AS forecast_quantity,
         fc_type, first_milestone_date, pos_second_milestone_date AS second_milestone_date,
         pos_third_milestone_date AS third_milestone_date, median_baseline, negative_impact,
         peak_max_growth, max_qty_ly
  FROM mg
)"""
    else:
        body = f"""mgs AS (
  SELECT *, CAST(datediff('day', {L}, first_milestone_date) // 7 AS INTEGER) + 1 AS a_w,
         CASE WHEN datediff('day', {L}, thirty_pct_week) // 7 > datediff('day', {L}, first_milestone_date) // 7
              THEN datediff('day', {L}, thirty_pct_week) // 7
              ELSE datediff('day', {L}, first_milestone_date) // 7 + 3 END + 1 AS b_w,
         (CASE WHEN peak_max_growth < 0 THEN 0.8
               WHEN peak_max_growth * 100 >= 0 AND peak_max_growth * 100 <= 50 THEN 0.2
               WHEN peak_max_growth * 100 > 50 AND peak_max_growth * 100 <= 100 THEN 0.15
               WHEN peak_max_growth * 100 > 100 AND peak_max_growth * 100 <= 500 THEN 0.1
               WHEN peak_max_growth * 100 > 500 AND peak_max_growth * 100 <= 1000 THEN 0.08
               ELSE 0.05 END) * peak_max_growth AS start_g
  FROM mg
),
mp AS (
  SELECT sell_id, state, category, week_ending_date, week_of_year, qty_ty, dollars_ty, growth_qty, growth_sales,
         CASE WHEN k < 0 THEN 0.0 WHEN k = 0 THEN gl WHEN k < a_w THEN 0.0
              WHEN k >= b_w + 2 THEN median_baseline
              WHEN k <= b_w THEN start_g * pow(0.9, k - a_w)
              ELSE start_g * pow(0.9, b_w - a_w) * pow(0.5, k - b_w) END AS forecast1,
         CASE WHEN k < 0 THEN 0.0 WHEN k = 0 THEN ql WHEN k < a_w THEN 0.0
              WHEN k < b_w THEN CASE WHEN negative_impact = 0 THEN ql * pow(0.9, k - a_w + 1)
                                     ELSE ql / pow(0.9, k - a_w + 1) END
              ELSE 0.0 END AS forecast_quantity,
         first_milestone_date, ship_second_milestone_date AS second_milestone_date,
         CAST(ship_second_milestone_date + 21 AS DATE) AS third_milestone_date,
         median_baseline, negative_impact, peak_max_growth, max_qty_ly
  FROM mgs
)"""
    return head + [body]


def seasonal_ctes(cfg: ModelConfig = DEFAULT_CONFIG) -> list[str]:
    """CTEs ``fit``, ``season``, ``sfc`` (seasonal forecast), ``hgf`` (flags)."""
    origin = d(iso_w1_saturday(cfg.ly_year))
    L = d(cfg.latest_week)
    return [
        f"""tw AS (SELECT *, CAST(datediff('day', {origin}, week_ending_date) // 7 AS DOUBLE) AS t_idx FROM mw)""",
        f"""fit AS (
  SELECT sell_id, regr_slope(qty, t_idx) AS slope, regr_intercept(qty, t_idx) AS intercept,
         min(qty) FILTER (WHERE week_ending_date <= {d(cfg.cap_floor_until)}) AS floor_v,
         max(qty) FILTER (WHERE week_ending_date <= {d(cfg.cap_floor_until)}) AS cap_v
  FROM tw GROUP BY sell_id
)""",
        """season AS (
  SELECT tw.sell_id, tw.week_of_year, avg(tw.qty - (f.intercept + f.slope * tw.t_idx)) AS season
  FROM tw JOIN fit f ON f.sell_id = tw.sell_id GROUP BY tw.sell_id, tw.week_of_year
)""",
        f"""sfc AS (
  SELECT u.sell_id, u.week_ending_date, u.week_of_year,
         least(greatest(u.intercept + u.slope * u.t_idx + coalesce(s.season, 0.0), u.floor_v), u.cap_v) AS seasonal_forecast
  FROM (SELECT f.*, CAST({L} + CAST(7 * r.k AS INTEGER) AS DATE) AS week_ending_date,
               CAST(week(CAST({L} + CAST(7 * r.k AS INTEGER) AS DATE)) AS INTEGER) AS week_of_year,
               CAST(datediff('day', {origin}, CAST({L} + CAST(7 * r.k AS INTEGER) AS DATE)) // 7 AS DOUBLE) AS t_idx
        FROM fit f CROSS JOIN range(1, {cfg.seasonal_horizon_weeks}) r(k)) u
  LEFT JOIN season s ON s.sell_id = u.sell_id AND s.week_of_year = u.week_of_year
)""",
        f"""hgf AS (
  SELECT s.sell_id, avg((s.seasonal_forecast - l.qty) / nullif(l.qty, 0)) AS mean_pct_diff,
         abs(avg((s.seasonal_forecast - l.qty) / nullif(l.qty, 0))) > {cfg.high_growth_threshold} AS high_growth_decline
  FROM sfc s LEFT JOIN (SELECT * FROM mw WHERE year = {cfg.ly_year}) l
    ON l.sell_id = s.sell_id AND l.week_of_year = s.week_of_year
  WHERE s.week_ending_date >= {d(cfg.high_growth_from)}
  GROUP BY s.sell_id
)""",
    ]


def adjusted_ctes(cfg: ModelConfig = DEFAULT_CONFIG, shipments: bool = False) -> list[str]:
    """CTE ``adj``: post-processed milestone forecasts (rules 4-7)."""
    L = d(cfg.latest_week)
    bound = "second_milestone_date" if shipments else "third_milestone_date"
    if shipments:
        promo = (f"CASE WHEN week_ending_date >= {d(cfg.ship_promo_from)} THEN "
                 "CASE WHEN qty_ly - roll > 0 THEN qty_ly - roll ELSE 0.0 END ELSE 0.0 END")
    else:
        promo = "CASE WHEN week_ending_date >= second_milestone_date THEN qty_ly - roll ELSE 0.0 END"
    nul = (lambda c: f"CASE WHEN week_ending_date < {L} THEN NULL ELSE {c} END") if not shipments else (lambda c: c)
    return milestone_ctes(cfg, shipments) + seasonal_ctes(cfg) + [
        f"""lyr AS (
  SELECT sell_id, week_of_year, qty AS qty_ly, dollars AS dollars_ly,
         CASE WHEN count(qty) OVER w6 = 6 THEN quantile_cont(qty, 0.5) OVER w6 END AS ly_med
  FROM mw WHERE year = {cfg.ly_year}
  WINDOW w6 AS (PARTITION BY sell_id ORDER BY week_of_year ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)
)""",
        """smed AS (
  SELECT sfc.sell_id, sfc.week_ending_date,
         CASE WHEN count(seasonal_forecast) OVER w6 = 6 THEN quantile_cont(seasonal_forecast, 0.5) OVER w6 END AS s_med,
         hgf.high_growth_decline
  FROM sfc JOIN hgf ON hgf.sell_id = sfc.sell_id
  WINDOW w6 AS (PARTITION BY sfc.sell_id ORDER BY sfc.week_ending_date ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)
)""",
        """ab AS (
  SELECT mp.*, lyr.qty_ly, lyr.dollars_ly, coalesce(smed.s_med, lyr.ly_med) AS roll,
         smed.high_growth_decline
  FROM mp
  LEFT JOIN lyr ON lyr.sell_id = mp.sell_id AND lyr.week_of_year = mp.week_of_year
  LEFT JOIN smed ON smed.sell_id = mp.sell_id AND smed.week_ending_date = mp.week_ending_date
)""",
        f"""a1 AS (
  SELECT * REPLACE (
    CASE WHEN week_ending_date > {L} THEN
      CASE WHEN negative_impact = 0 THEN CASE WHEN forecast1 < median_baseline THEN median_baseline ELSE forecast1 END
           ELSE CASE WHEN forecast1 > median_baseline THEN median_baseline ELSE forecast1 END END
    ELSE forecast1 END AS forecast1)
  FROM ab
)""",
        f"""a2 AS (
  SELECT * REPLACE (
    CASE WHEN negative_impact = 0 THEN
      CASE WHEN week_ending_date = {L} THEN qty_ty
           WHEN week_ending_date > {L} AND week_ending_date < second_milestone_date THEN forecast_quantity
           WHEN week_ending_date >= second_milestone_date AND high_growth_decline = true THEN roll
           WHEN week_ending_date >= second_milestone_date THEN (1 + forecast1) * roll END
    ELSE
      CASE WHEN week_ending_date = {L} THEN qty_ty
           WHEN week_ending_date > {L} AND week_ending_date < second_milestone_date THEN forecast_quantity
           WHEN week_ending_date >= second_milestone_date AND week_ending_date < third_milestone_date THEN (1 + forecast1) * max_qty_ly
           WHEN week_ending_date >= third_milestone_date AND high_growth_decline = true THEN roll
           WHEN week_ending_date >= third_milestone_date THEN (1 + forecast1) * roll END
    END AS forecast_quantity)
  FROM a1
)""",
        "a3 AS (SELECT *, (forecast_quantity - qty_ly) / nullif(qty_ly, 0) AS forecast_growth FROM a2)",
        f"""a4 AS (
  SELECT * REPLACE (
    CASE WHEN negative_impact = 0 THEN
      CASE WHEN (week_ending_date > {L} AND week_ending_date < {bound} AND NOT coalesce(high_growth_decline, false))
                AND forecast_growth < forecast1 THEN (1 + forecast1) * roll ELSE forecast_quantity END
    ELSE
      CASE WHEN (week_ending_date > {L} AND week_ending_date < {bound} AND NOT coalesce(high_growth_decline, false))
                AND forecast_growth > forecast1 THEN (1 + forecast1) * roll ELSE forecast_quantity END
    END AS forecast_quantity),
    {promo} AS promo_uplift
  FROM a3
)""",
        f"""adj AS (
  SELECT sell_id, state, category, week_ending_date, week_of_year, qty_ty, qty_ly, dollars_ly,
         roll AS qty_rolling_6_week_med, max_qty_ly,
         {nul('forecast1')} AS forecast1, {nul('forecast_quantity')} AS forecast_quantity,
         {nul('forecast_growth')} AS forecast_growth, {nul('promo_uplift')} AS promo_uplift,
         first_milestone_date, second_milestone_date, third_milestone_date, median_baseline,
         negative_impact, high_growth_decline
  FROM a4
)""",
    ]


def naive_ship_cte(cfg: ModelConfig = DEFAULT_CONFIG) -> str:
    L = d(cfg.latest_week)
    first = d(iso_w1_saturday(cfg.ty_year))
    return f"""nweeks AS (
  SELECT week_ending_date, CAST(week(week_ending_date) AS INTEGER) AS week_of_year
  FROM (SELECT DISTINCT week_ending_date FROM mw WHERE year = {cfg.ty_year}
        UNION ALL SELECT week_ending_date FROM cal WHERE week_ending_date > {L}) x
),
ng AS (
  SELECT k.sell_id, k.state, k.category, w.week_ending_date, w.week_of_year,
         CASE WHEN w.week_ending_date <= {L} THEN coalesce(y.qty_ty, 0.0) ELSE y.qty_ty END AS qty_ty,
         CASE WHEN w.week_ending_date <= {L} THEN coalesce(y.dollars_ty, 0.0) ELSE y.dollars_ty END AS dollars_ty,
         coalesce(l.qty, 0.0) AS qty_ly,
         w.week_ending_date = {first} AS excluded
  FROM (SELECT sell_id, state, category FROM lifespan WHERE status IN ('incomplete', 'missing')) k
  CROSS JOIN nweeks w
  LEFT JOIN yoy y ON y.sell_id = k.sell_id AND y.week_ending_date = w.week_ending_date
  LEFT JOIN (SELECT * FROM mw WHERE year = {cfg.ly_year}) l ON l.sell_id = k.sell_id AND l.week_of_year = w.week_of_year
),
npre AS (
  SELECT sell_id, quantile_cont((qty_ty - qty_ly) / nullif(qty_ly, 0), 0.5) AS med
  FROM yoy WHERE week_ending_date < {d(cfg.pre_event_to)} GROUP BY sell_id
),
nsc AS (
  SELECT g.sell_id, g.state, g.category, g.week_ending_date, g.week_of_year, g.qty_ty, g.dollars_ty, g.qty_ly,
         g.roll AS qty_ly_centered7_mean, coalesce(p.med, 0.0) AS med_qty_diff,
         CASE WHEN g.week_ending_date = {L} THEN g.qty_ty WHEN g.week_ending_date < {L} THEN NULL
              ELSE coalesce(g.roll, 0.0) END AS forecast_quantity,
         0 AS common_product
  FROM (SELECT *, CASE WHEN NOT excluded THEN avg(qty_ly) OVER (PARTITION BY sell_id, excluded ORDER BY week_ending_date
                                                                ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) END AS roll
        FROM ng) g
  LEFT JOIN npre p ON p.sell_id = g.sell_id
)"""


def combined_cte(cfg: ModelConfig = DEFAULT_CONFIG) -> str:
    L = d(cfg.latest_week)
    return f"""cu AS (
  SELECT sell_id, state, category, week_ending_date, week_of_year, qty_ty, qty_ly, qty_rolling_6_week_med,
         forecast_quantity, 1 AS common_product FROM adj
  UNION ALL
  SELECT sell_id, state, category, week_ending_date, week_of_year, qty_ty, qty_ly,
         qty_ly_centered7_mean AS qty_rolling_6_week_med, forecast_quantity, common_product FROM nsc
),
comb AS (
  SELECT u.sell_id, u.state, u.category, u.week_ending_date, u.week_of_year, u.qty_ty, u.qty_ly,
         u.qty_rolling_6_week_med, u.common_product,
         m.ship_third_milestone_date AS state_third_milestone_date,
         CASE WHEN u.week_ending_date >= {L} THEN u.forecast_quantity END AS forecast_quantity,
         CASE WHEN u.week_ending_date >= {d(cfg.ship_promo_from)} THEN
              CASE WHEN u.qty_ly - u.qty_rolling_6_week_med > 0 THEN u.qty_ly - u.qty_rolling_6_week_med ELSE 0.0 END
              ELSE 0.0 END AS promo_uplift,
         CASE WHEN u.common_product = 1 THEN 1.0
              ELSE 1 - count(CASE WHEN u.qty_ly = 0 THEN 1 END) OVER (PARTITION BY u.sell_id ORDER BY u.week_ending_date
                                                                    ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) / 7.0 END
           AS dampen_multiplier
  FROM cu u LEFT JOIN ms m ON m.state = u.state
)"""


def rule_sql(rules, action: str) -> str:
    conds = []
    for state, category, act in rules:
        if act != action:
            continue
        parts = []
        if state is not None:
            parts.append(f"state = '{state}'")
        if category is not None:
            parts.append(f"category = '{category}'")
        conds.append("(" + (" AND ".join(parts) or "true") + ")")
    return "coalesce(" + (" OR ".join(conds) if conds else "false") + ", false)"


def corrections_cte(cfg: ModelConfig, rules) -> str:
    L = d(cfg.latest_week)
    return f"""c0 AS (
  SELECT *, promo_uplift * dampen_multiplier AS promo_uplift_new,
         last_value(CASE WHEN week_ending_date = {L} THEN qty_ty END IGNORE NULLS)
           OVER (PARTITION BY sell_id ORDER BY week_ending_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_week_qty
  FROM comb
),
c1 AS (SELECT * REPLACE (CASE WHEN {rule_sql(rules, 'hold_last')} AND common_product = 0 AND week_ending_date >= {L}
                              AND week_ending_date < state_third_milestone_date THEN last_week_qty
                              ELSE forecast_quantity END AS forecast_quantity) FROM c0),
c2 AS (SELECT * REPLACE (CASE WHEN {rule_sql(rules, 'double')} AND week_ending_date > {L} THEN forecast_quantity * 2
                              ELSE forecast_quantity END AS forecast_quantity) FROM c1),
c3 AS (SELECT * REPLACE (CASE WHEN {rule_sql(rules, 'set_ly')} THEN qty_ly ELSE forecast_quantity END AS forecast_quantity) FROM c2),
c4 AS (SELECT * REPLACE (CASE WHEN week_ending_date < {L} THEN NULL ELSE forecast_quantity END AS forecast_quantity) FROM c3),
c5 AS (SELECT * REPLACE (CASE WHEN {rule_sql(rules, 'halve_gap')} AND week_ending_date > {L}
                              THEN forecast_quantity - (forecast_quantity - qty_ly) / 2 ELSE forecast_quantity END AS forecast_quantity) FROM c4),
corr AS (SELECT * FROM c5)"""


def naive_pos_cte(cfg: ModelConfig = DEFAULT_CONFIG) -> str:
    L = d(cfg.latest_week)
    return f"""np0 AS (
  SELECT k.sell_id, k.state, k.category, c.week_ending_date, c.week_of_year,
         CASE WHEN c.week_ending_date <= {L} THEN coalesce(y.qty_ty, 0.0) ELSE y.qty_ty END AS qty_ty,
         CASE WHEN c.week_ending_date <= {L} THEN coalesce(y.dollars_ty, 0.0) ELSE y.dollars_ty END AS dollars_ty
  FROM (SELECT sell_id, state, category FROM lifespan WHERE status IN ('incomplete', 'missing') AND state IS NOT NULL) k
  CROSS JOIN cal c
  LEFT JOIN yoy y ON y.sell_id = k.sell_id AND y.week_ending_date = c.week_ending_date
),
np AS (
  SELECT g.*, l.qty AS qty_ly, l.dollars AS dollars_ly,
         CASE WHEN g.week_ending_date = {L} THEN g.qty_ty
              WHEN g.week_ending_date > {L} AND g.state <> '' THEN g.pos_actuals_avg
              WHEN g.week_ending_date > {L} AND g.state = '' THEN l.qty END AS forecast_quantity
  FROM (SELECT *, avg(CASE WHEN week_ending_date <= {L} THEN qty_ty END) OVER (PARTITION BY sell_id) AS pos_actuals_avg
        FROM np0) g
  LEFT JOIN (SELECT * FROM mw WHERE year = {cfg.ly_year}) l ON l.sell_id = g.sell_id AND l.week_of_year = g.week_of_year
)"""


def round_select(cols_double, cols_other, src: str) -> str:
    parts = [f"round({c}, 4) AS {c}" for c in cols_double] + list(cols_other)
    return "SELECT " + ", ".join(parts) + f" FROM {src}"


# --------------------------------------------------------------- external ----

PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
POLICY_OF = {"1-URGENT": "urgent", "2-HIGH": "high", "3-MEDIUM": "medium", "4-NOT SPECIFIED": "not_specified",
             "5-LOW": "low"}

GEO = """geo AS (
  SELECT n.n_name AS state,
         chr(CAST(65 + floor(n.n_nationkey / 26) AS INTEGER)) || chr(CAST(65 + n.n_nationkey % 26 AS INTEGER)) AS state_initial,
         n.n_nationkey AS location_id, r.r_name AS country
  FROM nation n LEFT JOIN region r ON n.n_regionkey = r.r_regionkey
)"""


def sd_cte(cfg: ModelConfig = DEFAULT_CONFIG, name: str = "sd", status: str | None = None) -> str:
    st = f" AND o.o_orderstatus = '{status}'" if status else ""
    return f"""{name} AS (
  SELECT g.state, g.state_initial, CAST(o.o_orderdate AS DATE) AS date, count(*) AS n_orders,
         sum(o.o_totalprice) AS order_value,
         count(*) FILTER (WHERE o.o_orderpriority = '{PRIORITIES[0]}') AS urgent_orders,
         avg(o.o_totalprice) AS avg_value
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN geo g ON c.c_nationkey = g.location_id
  WHERE TRUE{st}
  GROUP BY ALL
)"""


POP = """pop AS (
  SELECT g.state, g.state_initial, CAST(coalesce(c.n, 0) AS BIGINT) AS state_pop
  FROM geo g LEFT JOIN (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey) c
    ON g.location_id = c.c_nationkey
)"""


def pm_cte() -> str:
    return """pm AS (
  SELECT s.state, s.state_initial, s.date, CAST(s.n_orders AS DOUBLE) AS orders_increase,
         CAST(s.urgent_orders AS DOUBLE) AS urgent_increase, s.order_value,
         p.state_pop, round(p.state_pop / 1000000.0, 4) AS state_pop_mil,
         round(CAST(s.n_orders AS DOUBLE) * 1000000.0 / nullif(p.state_pop, 0), 4) AS orders_increase_per_mil,
         round(CAST(s.urgent_orders AS DOUBLE) * 1000000.0 / nullif(p.state_pop, 0), 4) AS urgent_increase_per_mil,
         'q' || CAST(quarter(s.date) AS VARCHAR) AS quarter, CAST(month(s.date) AS INTEGER) AS month,
         CAST(year(s.date) AS INTEGER) AS year
  FROM sd s LEFT JOIN pop p ON p.state = s.state AND p.state_initial = s.state_initial
)"""


def rm_cte() -> str:
    return """rm AS (
  SELECT state, state_initial, date, CAST(urgent_orders AS DOUBLE) AS urgent_orders_baseline,
         CAST(n_orders AS DOUBLE) AS orders_baseline,
         CASE WHEN count(urgent_orders) OVER w = 6 THEN avg(CAST(urgent_orders AS DOUBLE)) OVER w END
           AS urgent_orders_baseline_6_roll_mean,
         CASE WHEN count(n_orders) OVER w = 6 THEN avg(CAST(n_orders AS DOUBLE)) OVER w END AS orders_baseline_6_roll_mean
  FROM sd
  WINDOW w AS (PARTITION BY state ORDER BY date ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)
)"""


def ps_cte(cfg: ModelConfig = DEFAULT_CONFIG) -> str:
    cols = []
    for p in PRIORITIES:
        n = POLICY_OF[p]
        cols.append(f"min(CAST(o.o_orderdate AS DATE)) FILTER (WHERE o.o_orderpriority = '{p}') AS {n}_start_date")
        cols.append(f"max(CAST(o.o_orderdate AS DATE)) FILTER (WHERE o.o_orderpriority = '{p}') AS {n}_end_date")
    return f"""ps AS (
  SELECT g.state, g.state_initial, {", ".join(cols)}
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN geo g ON c.c_nationkey = g.location_id
  GROUP BY g.state, g.state_initial
)"""


def pe_cte(cfg: ModelConfig = DEFAULT_CONFIG) -> str:
    parts = []
    for p in sorted(POLICY_OF.values()):
        raw = f"datediff('day', ps.{p}_start_date, d.date)"
        days = (f"CASE WHEN d.date > ps.{p}_end_date OR {raw} < 0 OR d.date > {d(cfg.as_of)} THEN 0 ELSE {raw} END")
        parts.append(f"CAST({days} AS INTEGER) AS days_on_{p}")
        parts.append(f"CASE WHEN {days} > 0 THEN 1 ELSE 0 END AS on_{p}")
    return f"""pe AS (
  SELECT d.state, d.state_initial, d.date, ps.* EXCLUDE (state, state_initial), {", ".join(parts)},
         'q' || CAST(quarter(d.date) AS VARCHAR) AS quarter, CAST(month(d.date) AS INTEGER) AS month,
         CAST(year(d.date) AS INTEGER) AS year
  FROM (SELECT state, state_initial, date FROM sd) d LEFT JOIN ps ON ps.state = d.state AND ps.state_initial = d.state_initial
)"""


CLAIMS = f"""cw AS (
  SELECT state_initial, {wk('date')} AS week_ending_date, sum(n_orders) AS n, sum(urgent_orders) AS u,
         sum(order_value) AS v, count(*) AS days
  FROM sd GROUP BY ALL
),
cr AS (
  SELECT c.state_initial, CAST(week(c.week_ending_date) AS INTEGER) AS wk_num, CAST(c.n AS BIGINT) AS IC,
         CAST(c.u AS BIGINT) AS FIC, CAST(c.n - c.u AS BIGINT) AS XIC, CAST(c.days AS BIGINT) AS WSIC,
         round(c.v, 2) AS WSEIC, c.n / c.days AS CW, CAST(c.week_ending_date - 7 AS DATE) AS date, g.state
  FROM cw c JOIN geo g ON g.state_initial = c.state_initial
)"""

QUARTERLY = """q AS (
  SELECT CAST(year(o_orderdate) AS INTEGER) AS year, 'q' || CAST(quarter(o_orderdate) AS VARCHAR) AS quarter,
         avg(o_totalprice) AS avg_order_value_q
  FROM orders GROUP BY ALL
)"""

PRICE = """pr AS (
  SELECT CAST(year(o_orderdate) AS INTEGER) AS year, 'M' || lpad(CAST(month(o_orderdate) AS VARCHAR), 2, '0') AS period,
         '' AS latest, round(avg(o_totalprice), 2) AS value, CAST(month(o_orderdate) AS INTEGER) AS month
  FROM orders GROUP BY ALL
)"""


def master_current_ctes(cfg: ModelConfig = DEFAULT_CONFIG) -> list[str]:
    return [GEO, sd_cte(cfg), POP, pm_cte(), rm_cte(), CLAIMS, QUARTERLY, PRICE, """mc AS (
  SELECT pm.*, rm.urgent_orders_baseline, rm.orders_baseline, rm.urgent_orders_baseline_6_roll_mean,
         rm.orders_baseline_6_roll_mean, cr.wk_num, cr.IC, cr.FIC, cr.XIC, cr.WSIC, cr.WSEIC, cr.CW,
         q.avg_order_value_q, pr.value AS price_index
  FROM pm
  LEFT JOIN rm ON rm.state = pm.state AND rm.state_initial = pm.state_initial AND rm.date = pm.date
  LEFT JOIN cr ON cr.state = pm.state AND cr.state_initial = pm.state_initial AND cr.date = pm.date
  LEFT JOIN q ON q.year = pm.year AND q.quarter = pm.quarter
  LEFT JOIN pr ON pr.year = pm.year AND pr.month = pm.month
)"""]


def ship_actuals_dated_cte(cfg: ModelConfig = DEFAULT_CONFIG) -> str:
    return f"""sad0 AS (
  SELECT coalesce(c.year, p.year) AS year, coalesce(c.week_of_year, p.week_of_year) AS week_of_year,
         coalesce(c.sell_id, p.sell_id) AS sell_id, coalesce(c.state, p.state) AS state,
         coalesce(c.category, p.category) AS category, c.week_ending_date, c.qty, c.dollars,
         p.qty AS stly_qty, p.dollars AS stly_dollars
  FROM (SELECT year - 1 AS year, week_of_year, sell_id, state, category, week_ending_date, qty, dollars FROM mw) c
  FULL OUTER JOIN (SELECT year, week_of_year, sell_id, state, category, qty, dollars FROM mw) p
    ON c.year = p.year AND c.week_of_year = p.week_of_year AND c.sell_id = p.sell_id
   AND c.state = p.state AND c.category = p.category
),
sad AS (
  SELECT s.sell_id, s.state, s.category, s.week_of_year, coalesce(s.week_ending_date, k.week_ending_date) AS week_ending_date,
         s.qty, s.dollars, s.stly_qty, s.stly_dollars
  FROM sad0 s JOIN cal k ON k.week_of_year = s.week_of_year
  WHERE s.year = {cfg.ly_year}
)"""


def ship_stitch_ctes(cfg: ModelConfig = DEFAULT_CONFIG) -> list[str]:
    L = d(cfg.latest_week)
    excl = " OR ".join(f"(state = '{s}' AND category = '{c}')" for s, c in cfg.excluded_series) or "false"
    return [ship_actuals_dated_cte(cfg), f"""fcs AS (
  SELECT sell_id, state, category, week_ending_date, forecast_quantity, qty_ly AS qty_ly_filled,
         promo_uplift_new AS promo_uplift FROM rt
),
fnp AS (SELECT * FROM fcs WHERE week_ending_date >= {L} AND state IS NOT NULL AND category IS NOT NULL),
pa AS (
  SELECT a.sell_id, a.state, a.category, a.week_ending_date, a.qty, a.dollars, f.forecast_quantity, 0.0 AS promo_uplift
  FROM (SELECT * FROM sad WHERE week_ending_date <= {L}) a
  LEFT JOIN (SELECT * FROM fnp WHERE week_ending_date = {L}) f
    ON f.sell_id = a.sell_id AND f.week_ending_date = a.week_ending_date
),
pb AS (
  SELECT f.sell_id, f.state, f.category, f.week_ending_date, a.qty, a.dollars, f.forecast_quantity, f.promo_uplift
  FROM (SELECT * FROM fnp WHERE week_ending_date > {L}) f
  LEFT JOIN (SELECT * FROM sad WHERE week_ending_date < {L}) a
    ON a.sell_id = f.sell_id AND a.week_ending_date = f.week_ending_date
),
s0 AS (
  SELECT sell_id, state, category, week_ending_date, qty, dollars,
         CASE WHEN week_ending_date = {L} THEN qty ELSE forecast_quantity END AS forecast_quantity,
         coalesce(promo_uplift, 0.0) AS promo_uplift
  FROM (SELECT * FROM pa UNION ALL SELECT * FROM pb) u
),
sst AS (
  SELECT * FROM (
    SELECT coalesce(s.sell_id, l.sell_id) AS sell_id, coalesce(s.state, l.state) AS state,
           coalesce(s.category, l.category) AS category,
           coalesce(s.week_ending_date, l.week_ending_date) AS week_ending_date,
           s.qty, s.dollars, s.forecast_quantity, coalesce(s.promo_uplift, 0.0) AS promo_uplift,
           l.stly_qty AS ly_qty, l.stly_dollars AS ly_dollars
    FROM s0 s FULL OUTER JOIN sad l
      ON s.sell_id = l.sell_id AND s.state = l.state AND s.category = l.category
     AND s.week_ending_date = l.week_ending_date) x
  WHERE NOT coalesce({excl}, false)
)"""]


PFM = """pfm AS (
  SELECT sell_id, state, category, week_of_year, week_ending_date, qty_ty, dollars_ty, qty_ly, dollars_ly,
         CAST(NULL AS DOUBLE) AS marker_first, CAST(NULL AS DOUBLE) AS marker_second, CAST(NULL AS DOUBLE) AS marker_third
  FROM yoy
  UNION ALL
  SELECT NULL, state, NULL, NULL, first_milestone_date, NULL, NULL, NULL, NULL, 2.0, NULL, NULL FROM ms
  UNION ALL
  SELECT NULL, state, NULL, NULL, pos_second_milestone_date, NULL, NULL, NULL, NULL, NULL, 2.0, NULL FROM ms
  UNION ALL
  SELECT NULL, state, NULL, NULL, pos_third_milestone_date, NULL, NULL, NULL, NULL, NULL, NULL, 2.0 FROM ms
)"""


# ---------------------------------------------------------------- seasonal fit ----

def fourier_ctes(cfg: ModelConfig = DEFAULT_CONFIG) -> list[str]:
    """CTE ``ff``: Gaussian elimination of each series' normal equations, a CTE a
    pivot, then back substitution."""
    from demandlab.plans.forecast import HARMONICS, SEASONAL_RIDGE
    n, origin = 2 + 2 * HARMONICS, f"DATE '{cfg.ly_year}-01-01'"

    def terms(day):
        angle = f"(dayofyear({day}) * (2 * pi() / 365.25))"
        return ["CAST(1 AS DOUBLE)", f"datediff('day', {origin}, {day}) / 364.0",
                *[f"{f}({h} * {angle})" for h in range(1, HARMONICS + 1) for f in ("sin", "cos")]]

    xs = ", ".join(f"{x} AS x{i}" for i, x in enumerate(terms("week_ending_date")))
    sums = ", ".join([f"sum(x{i} * x{j}){f' + {SEASONAL_RIDGE}' if i == j and i >= 2 else ''} AS a{i}{j}" for i in range(n) for j in range(n)]
                     + [f"sum(x{i} * qty) AS b{i}" for i in range(n)])
    ctes = [f"fx AS (SELECT sell_id, week_ending_date, qty, {xs} FROM mw WHERE qty IS NOT NULL)",
            f"f0 AS MATERIALIZED (SELECT sell_id, {sums}, min(CASE WHEN week_ending_date <= {d(cfg.cap_floor_until)} THEN qty END) AS lo, "
            f"max(CASE WHEN week_ending_date <= {d(cfg.cap_floor_until)} THEN qty END) AS hi FROM fx GROUP BY sell_id)"]
    for k in range(n):
        ok = f"a{k}{k} > 1e-9 * o{k}" if k else "a00 > 0"
        row = lambda i: f"(CASE WHEN {ok} THEN a{i}{k} / a{k}{k} ELSE 0 END)"  # noqa: E731, B023
        new = [f"a{i}{j} - {row(i)} * a{k}{j} AS a{i}{j}" for i in range(k + 1, n) for j in range(k + 1, n)]
        new += [f"b{i} - {row(i)} * b{k} AS b{i}" for i in range(k + 1, n)]
        first = ", ".join(f"a{i}{i} AS o{i}" for i in range(1, n)) + ", " if k == 0 else ""
        replace = f" REPLACE ({', '.join(new)})" if new else ""
        ctes.append(f"f{k + 1} AS MATERIALIZED (SELECT {first}*{replace} FROM f{k})")
    last = f"f{n}"
    for k in reversed(range(n)):
        rest = "".join(f" - a{k}{j} * beta{j}" for j in range(k + 1, n))
        ok = f"a{k}{k} > 1e-9 * o{k}" if k else "a00 > 0"
        ctes.append(f"g{k} AS MATERIALIZED (SELECT *, CASE WHEN {ok} THEN (b{k}{rest}) / a{k}{k} ELSE 0 END AS beta{k} FROM {last})")
        last = f"g{k}"
    value = " + ".join(f"beta{i} * {x}" for i, x in enumerate(terms("day")))
    ctes.append(f"""ff AS (
  SELECT sell_id, day AS week_ending_date, least(greatest({value}, lo), hi) AS seasonal_forecast
  FROM g0 CROSS JOIN (SELECT CAST({d(cfg.latest_week)} + CAST(7 * unnest(range(1, {cfg.seasonal_horizon_weeks})) AS INTEGER) AS DATE) AS day) h)""")
    return ctes


# ------------------------------------------------------------ account corrections ----

def account_ctes(cfg: ModelConfig, rules) -> list[str]:
    """CTE ``ac``: account forecasts after the rules table."""
    L = d(cfg.latest_week)
    value = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)
    table = ", ".join("(" + ", ".join(value(v) for v in r) + ")" for r in rules)
    keys = ("retailer", "state", "channel", "category")
    fits = " AND ".join(f"(r.{k} IS NULL OR r.{k} = a.{k})" for k in keys)
    named = " + ".join(f"CAST(r.{k} IS NOT NULL AS INTEGER)" for k in keys)
    order = ", ".join(f"r.{k} IS NOT NULL DESC" for k in keys)
    same = " AND ".join(f"{{0}}.{k} IS NOT DISTINCT FROM {{1}}.{k}" for k in keys)
    pick = ", ".join(f"max(CASE WHEN action = '{a}' THEN {c} END) AS {a}_{c}" for a in ("hold_last", "scale", "set_ly", "close_gap", "cumulative")
                     for c in ("rule_id", "factor"))
    latest = int(cfg.latest_week.strftime("%V"))
    return [f"""aw AS (
  SELECT retailer, business AS state, channel, category, week_of_year,
         sum(CASE WHEN year = {cfg.ly_year} THEN qty END) AS qty_ly, sum(CASE WHEN year = {cfg.ty_year} THEN qty END) AS qty_ty
  FROM w WHERE year IN ({cfg.ly_year}, {cfg.ty_year}) AND week_ending_date <= {L} GROUP BY ALL)""",
            f"""aa AS (
  SELECT retailer, state, channel, category, coalesce(sum(qty_ty), 0.0) / {latest} AS rate,
         coalesce(max(CASE WHEN week_of_year = {latest} THEN qty_ty END), 0.0) AS last_week_qty FROM aw GROUP BY ALL)""",
            f"ar AS (SELECT * FROM (VALUES {table}) r(rule_id, {', '.join(keys)}, action, factor))",
            f"""am AS (
  SELECT a.retailer, a.state, a.channel, a.category, r.action, r.rule_id, r.factor FROM aa a JOIN ar r ON {fits}
  QUALIFY row_number() OVER (PARTITION BY a.retailer, a.state, a.channel, a.category, r.action ORDER BY {named} DESC, {order}, r.rule_id) = 1)""",
            f"ap AS (SELECT retailer, state, channel, category, {pick} FROM am GROUP BY ALL)",
            f"""af AS (
  SELECT a.*, h.day AS week_ending_date, aw.qty_ly, CASE WHEN h.day = {L} THEN a.last_week_qty ELSE a.rate END AS fq0, ms.ship_third_milestone_date AS third,
         ap.* EXCLUDE (retailer, state, channel, category)
  FROM aa a CROSS JOIN (SELECT CAST(unnest(generate_series({L}, {L} + {7 * (cfg.horizon_week - latest)}, INTERVAL 7 DAY)) AS DATE) AS day) h
  LEFT JOIN aw ON {same.format('aw', 'a')} AND aw.week_of_year = week(h.day)
  LEFT JOIN ap ON {same.format('ap', 'a')} LEFT JOIN ms ON ms.state = a.state)""",
            f"a1 AS (SELECT *, CASE WHEN hold_last_factor <> 0 AND week_ending_date < third THEN last_week_qty ELSE fq0 END AS fq1 FROM af)",
            f"a2 AS (SELECT *, CASE WHEN scale_factor IS NOT NULL AND week_ending_date > {L} THEN fq1 * scale_factor ELSE fq1 END AS fq2 FROM a1)",
            f"a3 AS (SELECT *, CASE WHEN set_ly_factor <> 0 THEN qty_ly ELSE fq2 END AS fq3 FROM a2)",
            f"""a4 AS (SELECT *, CASE WHEN close_gap_factor <> 0 AND week_ending_date > {L} THEN fq3 - (fq3 - qty_ly) * close_gap_factor
                           ELSE fq3 END AS fq4 FROM a3)""",
            f"""ac AS (SELECT retailer, state, channel, category, week_ending_date, qty_ly,
  CASE WHEN cumulative_factor <> 0 THEN sum(fq4) OVER (PARTITION BY retailer, state, channel, category ORDER BY week_ending_date)
       ELSE fq4 END AS forecast_quantity,
  hold_last_rule_id AS hold_last_rule, scale_rule_id AS scale_rule, set_ly_rule_id AS set_ly_rule, close_gap_rule_id AS close_gap_rule,
  cumulative_rule_id AS cumulative_rule FROM a4)"""]
