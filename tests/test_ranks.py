import numpy as np
import pytest
from pyspark.sql import functions as F

from panelkit.operators import alerts, audit, clean, ranks

SHARES = [0.0, 0.13, 0.5, 0.85, 1.0]


def frame(spark, groups):
    return spark.createDataFrame([(k, x) for k, xs in groups.items() for x in xs], "k string, v double").repartition(5)


@pytest.fixture(scope="module")
def groups():
    draw = np.random.default_rng(2)
    return {
        "hot": draw.normal(size=6000).round(3).tolist() + [0.25] * 3000, "equal": [7.0] * 4000, "two": [1.0] * 2500 + [2.0] * 2500, "heavy": np.exp(draw.normal(0, 9, 5000)).tolist(),
        "small": [3.0, 1.0, None, 2.0], "none": [None, None], "one": [5.0],
    }


def wanted(xs):
    xs = [x for x in xs if x is not None]
    return np.quantile(xs, SHARES).tolist() if xs else None


@pytest.mark.parametrize("limit", [3, 100, 10**6])
def test_percentiles_by_group_are_exact_whatever_is_buffered(spark, groups, limit):
    got = {r.k: r.found for r in ranks.percentiles(frame(spark, groups), "v", SHARES, by=["k"], limit=limit).collect()}
    assert got.keys() == groups.keys()
    for k, xs in groups.items():
        assert got[k] == (pytest.approx(wanted(xs), rel=1e-12) if wanted(xs) else None), k


@pytest.mark.parametrize("limit", [20, 10**6])
def test_percentiles_of_a_column(spark, groups, limit):
    every = [x for xs in groups.values() for x in xs if x is not None]
    (row,) = ranks.percentiles(frame(spark, groups), "v", SHARES, limit=limit).collect()
    assert row.found == pytest.approx(np.quantile(every, SHARES).tolist(), rel=1e-12)
    (row,) = ranks.percentiles(frame(spark, {"none": [None]}), "v", SHARES).collect()
    assert row.found is None


def test_no_buffer_holds_more_than_the_limit(spark, groups, monkeypatch):
    seen = []
    real = F.collect_list
    monkeypatch.setattr(ranks.F, "collect_list", lambda c: seen.append(c) or real(c))
    df = frame(spark, {"hot": groups["hot"]})
    ranks.percentiles(df, "v", [0.5], by=["k"], limit=50).collect()
    assert len(seen) == 1  # one list for each share, of what is strictly inside a bracket with at most 50 values


def test_operators_on_a_hot_entity(spark, groups, monkeypatch):
    rows = frame(spark, {"hot": groups["hot"], "small": groups["small"]}).select(F.col("k").alias("entity"), F.col("v").alias("deviation"), F.lit("2000-01-01").alias("date"))

    def found():
        return [
            sorted(map(tuple, alerts.entity_thresholds(rows).collect())),
            sorted(map(str, clean.remove_outliers(rows, "deviation", factor=1.5).collect())),
            sorted(map(str, audit.audit_outliers_iqr(rows, "deviation", 1.0).collect())),
            sorted(map(str, alerts.true_events(rows).collect())),
        ]

    plain = found()
    monkeypatch.setattr(ranks, "LIMIT", 40)
    assert found() == plain
