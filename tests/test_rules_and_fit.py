"""Rules by specificity, and least squares per group against numpy."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from demandlab.operators import rules as rules_module
from demandlab.operators.least_squares import fit_groups
from demandlab.operators.rules import with_rules

KEYS = ["retailer", "state", "channel"]
RULES = "rule_id int, retailer string, state string, channel string, action string, factor double"


def plain(row, rules):
    out = {}
    for action in {r[4] for r in rules}:
        fit = [r for r in rules if r[4] == action and all(r[1 + i] is None or r[1 + i] == row[i] for i in range(3))]
        if fit:
            best = min(fit, key=lambda r: (-sum(x is not None for x in r[1:4]), [x is None for x in r[1:4]], r[0]))
            out[action] = (best[0], best[5])
    return out


@pytest.mark.parametrize("few", [True, False])
def test_most_specific_rule_wins(spark, monkeypatch, few):
    if not few:  # beyond the broadcast bound: joins by key
        monkeypatch.setattr(rules_module, "BROADCAST_RULES", 1)
    r = random.Random(3)
    pick = lambda c: r.choice([None, f"{c}1", f"{c}2", f"{c}3"])
    rules = [(i, pick("r"), pick("s"), pick("c"), r.choice(["scale", "zero", "hold"]), r.choice([0.0, 0.5, 2.0])) for i in range(60)]
    rows = list(itertools.product([None, "r1", "r2", "r9"], [None, "s1", "s3"], [None, "c1", "c2", "x"])) * 2
    df = spark.createDataFrame(rows, "retailer string, state string, channel string")
    got = with_rules(df, spark.createDataFrame(rules, RULES), KEYS)
    found = got.collect()
    assert len(found) == len(rows)
    for x in found:
        assert {k: tuple(v) for k, v in x.rules.items()} == plain((x.retailer, x.state, x.channel), rules)
    if few:
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan and "SortMergeJoin" not in plan


def test_no_rules(spark):
    df = spark.createDataFrame([("a", "b", "c")], "retailer string, state string, channel string")
    assert with_rules(df, spark.createDataFrame([], RULES), KEYS).first().rules == {}


def test_fit_equals_numpy(spark):
    rng = np.random.default_rng(2)
    rows, want = [], {}
    for g in range(6):
        n = [60, 30, 5, 2, 1, 40][g]
        t = np.sort(rng.uniform(0, 2, n)) if g != 5 else np.full(n, 0.5)   # the last one can't tell trend from constant
        y = 100 + 30 * t + 20 * np.sin(2 * math.pi * t) + rng.standard_normal(n)
        x = np.stack([np.ones(n), t, np.sin(2 * math.pi * t), np.cos(2 * math.pi * t)], 1)
        root = np.sqrt([0, 0, 0.5, 0.5])
        coef = np.linalg.lstsq(np.vstack([x, np.diag(root)]), np.r_[y, np.zeros(4)], rcond=None)[0]
        want[g] = (x @ coef, coef if g < 2 else None)
        rows += [(g, float(a), float(b)) for a, b in zip(t, y)]
    df = spark.createDataFrame(rows + [(0, 0.3, None), (7, 0.3, None)], "g int, t double, y double")
    angle = F.col("t") * (2 * math.pi)
    fit = fit_groups(df, ["g"], [F.lit(1.0), F.col("t"), F.sin(angle), F.cos(angle)], "y", [0, 0, 0.5, 0.5], {"n": F.count("*")})
    got = {r.g: r for r in fit.collect()}
    assert set(got) == set(want) and got[0].n == 60
    for g, (values, coef) in want.items():
        beta = np.array([got[g][f"beta{j}"] for j in range(4)])
        t = np.array([r[1] for r in rows if r[0] == g])
        x = np.stack([np.ones(len(t)), t, np.sin(2 * math.pi * t), np.cos(2 * math.pi * t)], 1)
        if coef is not None:
            assert np.allclose(beta, coef, rtol=1e-7, atol=1e-7)
        if g not in (3, 4):  # fewer rows than free terms: any exact solution will do, only a finite one is asked for
            assert np.allclose(x @ beta, values, rtol=1e-5, atol=1e-4)
        assert np.isfinite(beta).all()
