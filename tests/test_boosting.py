"""Boosted trees against a plain refit of the same trees, one model at a time and row by row."""

from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelkit.operators import backtest, boosting
from panelkit.operators.boosting import Settings

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def panel(spark):
    draw = np.random.default_rng(4)
    rows = [(f"e{e}", f"{2000 + m // 12}-{m % 12 + 1:02d}-01", float(draw.integers(0, 9)), float(draw.normal()), float(e % 3)) for e in range(12) for m in range(30)]
    rows = [(*r, r[2] / 3 + (r[3] > 0) * r[4] + float(draw.normal(0, 0.1)) + 1) for r in rows]
    df = spark.createDataFrame(rows, "entity string, date string, a double, b double, c double, y double").withColumn("date", F.col("date").cast("date"))
    return boosting.written(df.repartition(3))


def gain_of(g, h, s):
    t = lambda x: np.sign(x) * max(abs(x) - s.l1, 0)
    return t(g) ** 2 / (h + s.l2)


def plain_fit(x, y, uid, edges, s):
    """(base, predict): trees grown row by row, by recursion over the rows of each node."""
    base, trees = y.mean(), []

    def grow(rows, g, depth, listed):
        best = (1e-12, None)
        if depth:
            for f in listed:
                for cut in edges[f]:
                    left = x[rows, f] <= cut
                    hl, hr = left.sum(), (~left).sum()
                    if min(hl, hr) >= max(s.min_weight, 1):
                        gl, gr = g[rows][left].sum(), g[rows][~left].sum()
                        gain = (gain_of(gl, hl, s) + gain_of(gr, hr, s) - gain_of(gl + gr, hl + hr, s)) / 2
                        if gain > best[0] + 1e-9:
                            best = (gain, (f, cut))
        if best[1] is None:
            total = g[rows].sum()
            return -np.sign(total) * max(abs(total) - s.l1, 0) / (len(rows) + s.l2) * s.rate
        f, cut = best[1]
        left = x[rows, f] <= cut
        return f, cut, grow(rows[left], g, depth - 1, listed), grow(rows[~left], g, depth - 1, listed)

    def value(tree, row):
        while isinstance(tree, tuple):
            tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
        return tree

    now = np.full(len(y), base)
    for k in range(s.trees):
        seen = np.flatnonzero(boosting.sampled_rows(s, k, uid))
        tree = grow(seen, now - y, s.depth, boosting.sampled_features(s, k, range(x.shape[1])))
        trees.append(tree)
        now = now + [value(tree, r) for r in x]
    return lambda rows: np.array([base + sum(value(t, r) for t in trees) for r in rows])


@pytest.mark.parametrize("settings,collected", [(Settings(trees=3, depth=2, subsample=1.0, min_weight=3), 0), (Settings(trees=10, depth=3, subsample=0.7, columns=0.7, l1=0.5, l2=2.0, min_weight=2, rate=0.3), 1 << 25)])
def test_walk_forward_equals_plain_refits(spark, panel, settings, collected, monkeypatch):
    monkeypatch.setattr(boosting, "COLLECTED", collected)
    got = boosting.walk_forward(panel, FEATURES, "y", [0, 2], settings, min_months=20).toPandas()
    rows = boosting.Boosting(boosting.written(panel.select("entity", "date", *FEATURES, "y")), FEATURES, "y", [boosting.Model(settings)])
    table = rows.rows.toPandas()
    x, y, months, uid = table[FEATURES].to_numpy(), table["y"].to_numpy(), table["__m"].to_numpy(), table["__h"].to_numpy()
    listed = sorted(set(months))
    assert len(got) == 12 * (10 + 8)
    for gap in (0, 2):
        for origin in listed[20 + gap :]:
            train, test = months < origin - gap, months == origin
            want = np.maximum(plain_fit(x[train], y[train], uid[train], rows.edges, settings)(x[test]), 0)
            part = got[(got["gap"] == gap) & (pd.to_datetime(got["date"]).dt.year * 12 + pd.to_datetime(got["date"]).dt.month == origin)].set_index("entity")
            assert part.loc[table["entity"][test], "predicted"].to_numpy() == pytest.approx(want, abs=1e-9)


def test_models_in_several_passes_and_sets_of_features(spark, panel, monkeypatch):
    settings = Settings(trees=2, depth=2, subsample=1.0)
    sets = {"with": FEATURES, "without": ["a"]}
    whole = boosting.walk_forward(panel, FEATURES, "y", settings=settings, min_months=24, sets=sets).toPandas()
    monkeypatch.setattr(boosting, "TOGETHER", 5)
    parts = boosting.walk_forward(panel, FEATURES, "y", settings=settings, min_months=24, sets=sets).toPandas()
    keys = ["features", "entity", "date"]
    pd.testing.assert_frame_equal(whole.sort_values(keys).reset_index(drop=True), parts.sort_values(keys).reset_index(drop=True))
    alone = boosting.walk_forward(panel.drop("b", "c"), ["a"], "y", settings=settings, min_months=24).toPandas()
    one = whole[whole["features"] == "without"].sort_values(["entity", "date"])
    assert one["predicted"].to_numpy() == pytest.approx(alone.sort_values(["entity", "date"])["predicted"].to_numpy())
    assert boosting.walk_forward(panel, FEATURES, "y", min_months=500).count() == 0


def test_leaf_values_and_gains_by_hand(spark):
    s = Settings(l1=1.0, l2=2.0, rate=0.5, min_weight=1)
    assert boosting.leaf_value(-7.0, 4.0, s) == pytest.approx(0.5 * 6 / 6) and boosting.leaf_value(0.5, 4.0, s) == 0
    # cut after the first bin: gl=-4, hl=2, gr=3, hr=2; (9/4 + 4/4 - 0) / 2
    assert boosting.split_gains(np.array([-4.0, 3.0]), np.array([2.0, 2.0]), s) == pytest.approx([1.625])
    assert boosting.split_gains(np.array([-4.0, 3.0]), np.array([2.0, 2.0]), replace(s, min_weight=3))[0] == -np.inf
    rows = spark.createDataFrame([("e", "2000-01-01", 0.0, 1.0), ("f", "2000-01-01", 0.0, 1.0), ("g", "2000-01-01", 1.0, 5.0), ("h", "2000-01-01", 1.0, 7.0)], "entity string, date string, x double, y double")
    model = boosting.train(rows, ["x"], "y", Settings(trees=1, depth=1, rate=1.0, subsample=1.0, l2=1.0, l1=0.0, min_weight=1))
    # base 3.5; gradients 2.5, 2.5, -1.5, -3.5; leaves -5/3 and 5/3
    assert sorted(r.p for r in rows.select(model.column().alias("p")).collect()) == pytest.approx([3.5 - 5 / 3] * 2 + [3.5 + 5 / 3] * 2)
    with pytest.raises(ValueError):
        Settings(subsample=0)


def test_a_model_survives_its_table(spark, panel):
    settings = Settings(trees=5, depth=3)
    model = boosting.train(panel, FEATURES, "y", settings)
    again = boosting.Trees.from_table(model.table(spark), FEATURES, settings, model.base)
    x = panel.select(*FEATURES).toPandas().to_numpy()
    assert again.predict(x) == pytest.approx(model.predict(x))
    names, shares = zip(*model.importance())
    assert set(names) == set(FEATURES) and sum(shares) == pytest.approx(1) and list(shares) == sorted(shares, reverse=True)
    plain = panel.select("y", model.column().alias("p"), *FEATURES).toPandas()
    assert plain["p"].to_numpy() == pytest.approx(np.maximum(model.predict(plain[FEATURES].to_numpy()), 0))
    assert ((plain["p"] - plain["y"]) ** 2).mean() < 0.5 * plain["y"].var()


def test_halving_finds_what_exhaustive_search_finds(spark, panel):
    candidates = [Settings(trees=9, depth=d, rate=r, subsample=1.0, min_weight=2) for d in (1, 3) for r in (0.02, 0.1, 0.4)]
    months = sorted(r.m for r in panel.select(backtest.month_number(F.col("date")).alias("m")).distinct().collect())
    fast = boosting.halving(panel, FEATURES, "y", candidates, months[15], months[-1] + 1)
    whole = boosting.halving(panel, FEATURES, "y", candidates, months[15], months[-1] + 1, rungs=(1.0,), keep=1.0)
    assert fast[0]["candidate"] == whole[0]["candidate"] and fast[0]["mae"] == pytest.approx(whole[0]["mae"])
    assert len(whole) == len(fast) == 6 and sum(x["trees"] for x in fast) < sum(x["trees"] for x in whole)


def test_tune_searches_a_grid_around_the_best(spark, panel):
    searched = {"trees": (6, 8), "depth": (2, 3), "rate": (0.1, 0.3), "subsample": (0.8, 1.0)}
    found = boosting.tune(panel, FEATURES, "y", n=3, searched=searched, steps=(1, 1, 0.02)).toPandas()
    assert found["mae"].is_monotonic_increasing and set(found["stage"]) == {1, 2}
    best = found[found["stage"] == 1].iloc[0]
    around = found[found["stage"] == 2]
    assert len(around) <= 27 and set(around["trees"] - best["trees"]) == {-1, 0, 1} and around["min_weight"].nunique() == 1
