
import pytest
from pyspark.sql import functions as F

from demandlab.operators.joins import JoinValidationError, attach_scalars, null_safe_join, validated_join
from demandlab.operators.quality import (CoverageError, DataQualityError, assert_column_contract, assert_coverage,
                                         assert_distinct_count, assert_no_nulls)
from demandlab.operators.reshape import drop_constant_columns, front_columns, suffix_overlap
from demandlab.operators.windows import (back_fill, centered_count, centered_mean, forward_fill, rolling_expr,
                                         running_total)


def test_rolling_guard_nulls_window_with_missing_observation(spark):
    vals = [1.0, 2.0, 3.0, None, 5.0, 6.0, 7.0]
    df = spark.createDataFrame([("s", i, v) for i, v in enumerate(vals)], "k string, i int, v double")
    got = [r.m for r in df.select("i", rolling_expr("v", ["k"], "i", 6, "mean").alias("m")).orderBy("i").collect()]
    assert got == [None] * 7


def test_rolling_median_matches_trailing_window(spark):
    vals = [5.0, 1.0, 4.0, 2.0, 3.0, 6.0, 10.0]
    df = spark.createDataFrame([("s", i, v) for i, v in enumerate(vals)], "k string, i int, v double")
    got = [r.m for r in df.select("i", rolling_expr("v", ["k"], "i", 6, "median").alias("m")).orderBy("i").collect()]
    assert got[:5] == [None] * 5
    assert got[5] == 3.5 and got[6] == 3.5


def test_centered_fill_and_running_total(spark):
    df = spark.createDataFrame([("s", i, v) for i, v in enumerate([None, 1.0, None, 0.0, 4.0])],
                               "k string, i int, v double")
    r = df.select("i", centered_mean("v", ["k"], "i", 7).alias("cm"),
                  centered_count(F.col("v") == 0, ["k"], "i", 7).alias("zc"),
                  forward_fill("v", ["k"], "i").alias("ff"), back_fill("v", ["k"], "i").alias("bf"),
                  running_total("v", ["k"], "i").alias("rt")).orderBy("i").collect()
    assert [x.ff for x in r] == [None, 1.0, 1.0, 0.0, 4.0]
    assert [x.bf for x in r] == [1.0, 1.0, 0.0, 0.0, 4.0]
    assert [x.rt for x in r] == [None, 1.0, 1.0, 1.0, 5.0]
    assert r[0].cm == pytest.approx(0.5) and r[0].zc == 1


def test_validated_join_rejects_duplicate_keys(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b")], "k int, x string")
    right = spark.createDataFrame([(1, "p"), (1, "q")], "k int, y string")
    with pytest.raises(JoinValidationError):
        validated_join(left, right, "k", "left", "m:1")
    ok = spark.createDataFrame([(1, "p")], "k int, y string")
    assert validated_join(left, ok, "k", "left", "m:1").count() == 2


def test_null_safe_join_matches_null_keys(spark):
    a = spark.createDataFrame([(None, 1), ("x", 2)], "k string, a int")
    b = spark.createDataFrame([(None, 10), ("y", 20)], "k string, b int")
    rows = null_safe_join(a, b, ["k"], "full").orderBy("a").collect()
    assert len(rows) == 3
    assert [(r.k, r.a, r.b) for r in rows if r.a == 1] == [(None, 1, 10)]


def test_attach_scalars(spark):
    df = spark.createDataFrame([(1,), (2,)], "x int")
    one = df.agg(F.max("x").alias("mx"))
    assert sorted((r.x, r.mx) for r in attach_scalars(df, one).collect()) == [(1, 2), (2, 2)]


def test_state_coverage_errors(spark):
    lookup = spark.createDataFrame([(s,) for s in ["CA", "OH", "FL", "WA", "NY", "TX"]], "state string")
    data = spark.createDataFrame([(s,) for s in ["CA", "OH", "FL", "WA"]], "state string")
    with pytest.raises(CoverageError):
        assert_coverage(data, lookup, "state")
    with_null = lookup.unionByName(spark.createDataFrame([(None,)], "state string"))
    with pytest.raises(CoverageError):
        assert_coverage(lookup, with_null, "state")
    assert_coverage(lookup, lookup, "state")


def test_null_and_distinct_checks(spark):
    df = spark.createDataFrame([("US", 1), (None, 2)], "country string, v int")
    with pytest.raises(DataQualityError):
        assert_no_nulls(df, "country")
    assert_no_nulls(df.filter("country IS NOT NULL"), "country")
    with pytest.raises(DataQualityError):
        assert_distinct_count(df, "v", 3)
    with pytest.raises(DataQualityError):
        assert_column_contract(df, ["country"])


def test_reshape_helpers(spark):
    df = spark.createDataFrame([(1, "c", None), (2, "c", None)], "b int, a string, z string")
    assert drop_constant_columns(df).columns == ["b", "z"]
    assert front_columns(df, ["z"]).columns == ["z", "a", "b"]
    r = suffix_overlap(df, spark.createDataFrame([(1, 2)], "b int, q int"), ["k"], "_bes")
    assert r.columns == ["b_bes", "q"]


def test_salted_join_equals_plain_join_on_hot_key(spark):
    from demandlab.operators.joins import key_shares, salted_join
    big = spark.createDataFrame([(i, 1 if i % 3 else i % 7) for i in range(300)], "id int, k int")
    small = spark.createDataFrame([(k, f"v{k}") for k in range(5)], "k int, v string")
    plain = sorted(tuple(r) for r in big.join(small, "k", "left").select("id", "k", "v").collect())
    salted = sorted(tuple(r) for r in salted_join(big, small, "k", "left", 8, ["id"]).select("id", "k", "v").collect())
    assert plain == salted and len(salted) == 300
    top = key_shares(big, "k", 1).first()
    hot = sum(1 for i in range(300) if (1 if i % 3 else i % 7) == 1)
    assert top.k == 1 and top.share == pytest.approx(hot / 300)


def test_salted_ledger_join_matches_default(spark):
    import dataclasses
    from demandlab.config import DEFAULT_CONFIG
    from demandlab.plans.facts import sales_fact
    from demandlab.sources.tables import Tables
    t = Tables(spark, "/root/testdata/sf0.001")
    cols = ["sale_date", "retailer", "state", "business", "category", "brand", "ppg", "channel", "qty", "dollars"]
    a = sales_fact(t, DEFAULT_CONFIG).select(*cols)
    b = sales_fact(t, dataclasses.replace(DEFAULT_CONFIG, hot_key_salt_buckets=4)).select(*cols)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0 and a.count() == b.count()


def test_null_key_rejects_and_distinct_count(spark):
    from demandlab.operators.quality import distinct_count, null_key_rejects
    df = spark.createDataFrame([("a", "x"), (None, "x"), ("a", None), ("a", "x")], "s string, c string")
    r = null_key_rejects(df, ["s", "c"]).first()
    assert (r.rejected_null_keys, r.rows) == (2, 4)
    assert distinct_count(df, ["s", "c"]).first().n_distinct == 3


def test_validate_geo_filter(spark):
    from demandlab.operators.quality import CoverageError, DataQualityError
    from demandlab.plans.external import geo_filter, validate_geo_filter
    geo = spark.createDataFrame([("Ohio", "OH"), ("Texas", "TX")], "state string, state_initial string")
    df = spark.createDataFrame([("OH", "US", 1), ("TX", "US", 2), ("ZZ", "US", 3)], "st string, country string, v int")
    out = geo_filter(df, geo, "st", "country", "US")
    validate_geo_filter(out, geo, "country")
    validate_geo_filter(out, geo, "country", expected_states=2)
    with pytest.raises(CoverageError):
        validate_geo_filter(out.filter("state = 'Ohio'"), geo, "country")
    with pytest.raises(DataQualityError):
        validate_geo_filter(out, geo, "country", expected_states=3)


def ledger_of(spark, folder):
    """Ledger tables of our own: rows that come twice, NULL and unknown keys, one product that sells most."""
    import datetime as dt
    day = dt.datetime(1997, 3, 1)
    rows = {
        "region": ([(0, "NORTH"), (1, None)], "r_regionkey int, r_name string"),
        "nation": ([(0, "N0", 0), (1, "N1", 1), (2, "N0", 0), (3, None, 9), (1, "N1", 1)], "n_nationkey int, n_name string, n_regionkey int"),
        "customer": ([(i, [0, 1, 2, 3, 7, None][i % 6], "SEG" if i % 4 else None) for i in range(1, 13)] + [(None, 0, "SEG"), (5, 0, "TWICE")],
                     "c_custkey long, c_nationkey int, c_mktsegment string"),
        "part": ([(i, f"part {i % 3}" if i % 5 else None, "Brand", "BIG" if i % 2 else "SMALL") for i in range(8)] + [(2, "part 2", "Brand", "SMALL"), (None, "x", "y", "z")],
                 "p_partkey long, p_name string, p_brand string, p_type string"),
        "orders": ([(i, i % 14 if i % 9 else None) for i in range(40)] + [(3, 4), (None, 1)], "o_orderkey long, o_custkey long"),
        "lineitem": ([(i % 43 if i % 17 else None, 2 if i % 3 else i % 11, [None, "A", "R"][i % 3], "F", float(i % 5), float(i), day + dt.timedelta(days=i * 3) if i % 19 else None)
                      for i in range(300)], "l_orderkey long, l_partkey long, l_returnflag string, l_linestatus string, l_quantity double, l_extendedprice double, l_shipdate timestamp"),
    }
    for name, (data, schema) in rows.items():
        spark.createDataFrame(data, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return folder


def test_weekly_fact_moves_narrow_lines(spark, tmp_path, monkeypatch):
    from demandlab.plans import facts
    from demandlab.session import Run
    from demandlab.sources.tables import Tables
    folder = ledger_of(spark, str(tmp_path / "ledger"))
    t = Tables(spark, folder, run=Run(spark, materialized=False))
    monkeypatch.setattr(facts, "LINES_PER_TASK", 100, raising=False)
    plan = facts.weekly_fact(t)._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    # no line is dealt by place or by week: three tasks get the products' lines, sum and write them
    assert dealt and not any("retailer" in x or "week_ending_date#" in x.split("year(")[0] for x in dealt)
    assert sum("category" in x and ", 3)" in x for x in dealt) == 1
    with Run(spark) as run:
        got = facts.weekly_fact(Tables(spark, folder, run=run))
        for name in ("region", "nation", "customer", "part", "orders", "lineitem"):
            spark.read.parquet(f"{folder}/{name}.parquet").createOrReplaceTempView(f"own_{name}")
        want = spark.sql("""
            WITH l AS (SELECT date_add(to_date(l_shipdate), 7 - dayofweek(to_date(l_shipdate))) AS week_ending_date, c_mktsegment AS retailer,
                              n_name AS state, r_name AS business, p_type AS category, p_brand AS brand, p_name AS ppg,
                              concat(l_returnflag, l_linestatus) AS channel, l_quantity, l_extendedprice
                       FROM own_lineitem LEFT JOIN own_orders ON l_orderkey = o_orderkey LEFT JOIN own_customer ON o_custkey = c_custkey
                       LEFT JOIN own_nation ON c_nationkey = n_nationkey LEFT JOIN own_region ON n_regionkey = r_regionkey
                       LEFT JOIN own_part ON l_partkey = p_partkey WHERE l_quantity <> 0)
            SELECT week_ending_date, retailer, state, business, category, brand, ppg, channel, sum(l_quantity) AS qty,
                   sum(l_extendedprice) AS dollars, count(*) AS n_lines, weekofyear(week_ending_date) AS week_of_year, year(week_ending_date) AS year
            FROM l GROUP BY ALL""")
        assert got.columns == want.columns
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() > 100
