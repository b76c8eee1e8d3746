import math

import pytest
from pyspark.sql import functions as F

from themeloom.functions import special


@pytest.mark.parametrize(
    "x, psi",
    [(1.0, -0.5772156649015329), (0.5, -1.9635100260214235), (5.0, 1.5061176684318003), (0.1, -10.423754940411076), (100.0, 4.600161852738087)],
)
def test_digamma(spark, x, psi):
    got = spark.range(1).select(special.digamma(F.lit(x))).first()[0]
    assert got == pytest.approx(psi, abs=1e-8)


def test_dirichlet_expectation(spark):
    rows = [(0, 0, 1.0), (0, 1, 1.0), (0, 2, 1.0), (1, 0, 0.1), (1, 1, 5.0), (1, 2, 2.0)]
    frame = spark.createDataFrame(rows, "row_id INT, k INT, alpha DOUBLE")
    got = {(r.row_id, r.k): r.e_log_theta for r in special.dirichlet_expectation(frame).collect()}
    assert got[0, 0] == pytest.approx(-1.5, abs=1e-8)
    assert got[1, 1] - got[1, 2] == pytest.approx(1 / 2 + 1 / 3 + 1 / 4, abs=1e-8)
    assert len(got) == 6


def test_log_sum_exp(spark):
    inf = float("inf")
    groups = {
        0: [1.0, 2.0, 3.0],
        1: [1000.0, 1000.0],
        2: [-1000.0, -1001.0],
        3: [-inf, 0.0],
        4: [i * 10.0 for i in range(100)],
        5: [-0.5],
        6: [63.999, 64.0, 0.0, -64.0],
        7: [1e300, 5.0],
    }
    rows = [(g, x) for g, values in groups.items() for x in values]
    got = {
        r.g: r.log_sum_exp
        for r in special.log_sum_exp(
            spark.createDataFrame(rows, "g INT, x DOUBLE"), "g", "x"
        ).collect()
    }
    for g, values in groups.items():
        top = max(values)
        expected = top + math.log(sum(math.exp(x - top) for x in values))
        assert got[g] == pytest.approx(expected, rel=1e-12), g


def test_log_sum_exp_of_minus_infinity_only(spark):
    rows = spark.createDataFrame([(0, float("-inf"))], "g INT, x DOUBLE")
    assert math.isnan(special.log_sum_exp(rows, "g", "x").first()[1])


def test_log_sum_exp_over_many_bands(spark):
    inf = float("inf")
    groups = {
        "one": [3.0, 3.5],
        "six": [64.0 * i + 1 for i in range(6)],
        "thousand": [64.0 * i - 32000 for i in range(1000)],
        "equal": [-7.0] * 1000 + [-7.0 - 64 * 5],
        "high": [inf, 0.0, -inf],
        "low": [-inf, -inf],
    }
    rows = [(g, x) for g, values in groups.items() for x in values] + [(None, 1.0), (None, 2.0)]
    frame = special.log_sum_exp(spark.createDataFrame(rows, "g STRING, x DOUBLE"), "g", "x")
    got = {r.g: r.log_sum_exp for r in frame.collect()}
    for g, values in [*groups.items(), (None, [1.0, 2.0])]:
        top = max(values)
        if top in (inf, -inf):
            assert got[g] == inf if top > 0 else math.isnan(got[g])
        else:
            told = top + math.log(math.fsum(math.exp(x - top) for x in values))
            assert got[g] == pytest.approx(told, rel=1e-14)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    for forbidden in ("Window", "collect_list", "Python"):
        assert forbidden not in plan
