"""Small cases worked out by hand, one for each rule that is easy to get wrong."""

import datetime as dt
import math
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelkit.functions import columns, numeric
from panelkit.operators import alerts, audit, backtest, clean, features, metrics, panel, ranks, signals, stattests
from panelkit.plans import registry


def month(k):
    return dt.date(2020 + k // 12, k % 12 + 1, 1)


def series(spark, values, entity="x", column="apps"):
    return spark.createDataFrame([(entity, month(k), None if v is None else float(v)) for k, v in enumerate(values)], f"entity string, date date, {column} double")


def values(df, column, order="date"):
    return [r[column] for r in df.orderBy(order).collect()]


def test_interpolation_carries_the_end_and_fills_the_start_with_the_mean(spark):
    got = clean.interpolate_series(series(spark, [None, 1.0, None, 3.0, None, None]))
    assert values(got, "apps") == pytest.approx([2.4, 1, 2, 3, 3, 3])
    assert values(got, "fill") == ["mean", "observed", "interpolated", "observed", "carried", "carried"]
    assert values(clean.interpolate_series(series(spark, [None, 1.0, None, 3.0, None, None]), trailing="mean"), "apps") == pytest.approx([2, 1, 2, 3, 2, 2])
    assert values(clean.interpolate_series(series(spark, [None, None])), "apps") == [None, None]


def test_rolling_and_smoothing(spark):
    got = features.add_rolling(series(spark, [1.0, None, 3.0, 5.0], column="s"), ["s"])
    assert values(got, "s_roll3") == [None, None, 2, 4]
    smooth = metrics.smooth_centered(series(spark, [1.0, 2, 4, 8, 16, 32, 64, 128], column="v"), "v")
    assert values(smooth, "smoothed") == pytest.approx([7 / 3, 3.75, 6.2, 10.5, 21, 42, 49.6, 60])


def test_momentum_needs_lags(spark):
    with pytest.raises(ValueError):
        features.add_momentum(series(spark, [1.0], column="s"), ["s"])


def test_percentiles_and_thresholds(spark):
    rows = spark.createDataFrame([("a", d) for d in (1.0, 2.0, 4.0, 9.0, -1.0)] + [("b", float(d)) for d in range(1, 6)], "entity string, deviation double")
    got = {(r.entity, r.percentile): r.threshold for r in alerts.entity_thresholds(rows, (50, 85)).collect()}
    assert got == {("a", 50): math.inf, ("a", 85): math.inf, ("b", 50): 3.0, ("b", 85): pytest.approx(4.4)}
    assert spark.createDataFrame([(1.0,), (2.0,), (4.0,), (9.0,)], "x double").agg(F.percentile("x", 0.85)).first()[0] == pytest.approx(6.75)


def test_quintile_closes_on_the_right_and_merges_equal_edges(spark):
    x = [1, 2, 2, 3, 4, 5, 5, 9, 10, 11]
    df = spark.createDataFrame([(str(k), float(v)) for k, v in enumerate(x)], "entity string, income double")
    got = {r.entity: r.income_quintile for r in features.add_quintile(df, "income").collect()}
    assert [got[str(k)] for k in range(10)] == [1, 1, 1, 2, 3, 3, 3, 4, 5, 5]
    same = spark.createDataFrame([(str(k), 7.0) for k in range(4)] + [("n", None)], "entity string, income double")
    assert {r.entity: r.income_quintile for r in features.add_quintile(same, "income").collect()} == {"0": 1, "1": 1, "2": 1, "3": 1, "n": None}


def test_rounding_is_half_even(spark):
    r = spark.range(1).select(columns.half_even(F.lit(2.5)).alias("a"), columns.half_even(F.lit(0.125), 2).alias("b")).first()
    assert (r.a, r.b) == (2, 0.12)


def chunk_rows(spark, chunks):
    return spark.createDataFrame([("k", "m", name, month(d), float(v)) for name, part in chunks.items() for d, v in part.items()], "keyword string, market string, chunk string, date date, value double")


def test_suffix_product_passes_zeros(spark):
    order = spark.createDataFrame([("k", "m", s) for s in (1, 2, 3, 4)], "keyword string, market string, seq int")
    ratios = spark.createDataFrame([("k", "m", 3, 4.0), ("k", "m", 2, 0.0), ("k", "m", 1, 2.0)], "keyword string, market string, seq int, ratio double")
    assert values(signals.chunk_scales(order, ratios), "scale", "seq") == [0, 0, 4, 1]


def test_small_overlaps_and_zero_means_keep_ratio_one(spark):
    few = chunk_rows(spark, {"a": {0: 1, 1: 2, 2: 3}, "b": {0: 10, 1: 20, 2: 30, 3: 5}})
    zero = chunk_rows(spark, {"a": dict.fromkeys(range(4), 0), "b": dict.fromkeys(range(5), 9)})
    for rows in (few, zero):
        assert signals.overlap_ratios(rows.join(signals.order_chunks(rows), ["keyword", "market", "chunk"])).first()["ratio"] == 1


def test_stitching_gives_back_a_cut_and_rescaled_series(spark):
    whole = {k: 20 + 7 * math.sin(k) + k for k in range(30)}
    cut = {"c1": {k: 3 * whole[k] for k in range(12)}, "c2": {k: 0.5 * whole[k] for k in range(7, 22)}, "c3": {k: whole[k] for k in range(17, 30)}}
    got = values(signals.stitch_signals(chunk_rows(spark, cut)), "value")
    top = max(whole.values())
    assert got == pytest.approx([100 * v / top for v in whole.values()], abs=0.006)


def test_parsing(spark):
    df = spark.createDataFrame([("Jan 2023", "1,234"), ("January 2023", " * "), ("*", "x"), (None, "nan")], "m string, c string")
    got = df.select(columns.parse_month(F.col("m")).alias("m"), columns.parse_count(F.col("c")).alias("c")).collect()
    assert [tuple(r) for r in got] == [(dt.date(2023, 1, 1), 1234.0), (dt.date(2023, 1, 1), None), (None, None), (None, None)]
    keys = spark.createDataFrame([("San Benito",), ("Alpine County",)], "k string").select(columns.normalize_key(columns.strip_suffix(F.col("k"))).alias("k")).collect()
    assert [r.k for r in keys] == ["SanBenito", "Alpine"]


def test_outliers_drop_nulls_too(spark):
    assert values(clean.remove_outliers(series(spark, [10.0, None, 12.0, 100.0]), "apps"), "apps") == [10, 12]


def test_a_feature_that_is_null_throughout_drops_nothing(spark):
    df = series(spark, [1.0, None, 3.0]).withColumn("gone", F.lit(None).cast("double"))
    assert clean.drop_incomplete(df, ["gone", "absent"], "apps").count() == 2


def test_dedupe_takes_the_order_seriously(spark):
    df = spark.createDataFrame([("k", 2, "b"), ("k", 1, "a")], "key string, rank int, v string")
    assert clean.dedupe_by(df, ["key"], ["rank"]).first()["v"] == "a" and clean.dedupe_by(df, ["key"], ["rank"], "last").first()["v"] == "b"


def test_smape_variants(spark):
    df = spark.createDataFrame([(0.0, 0.0), (1.0, 3.0)], "actual double, predicted double")
    got = {m: metrics.regression_metrics(df, smape=m).first()["smape"] for m in metrics.SMAPE_MODES}
    assert got == {"zero": pytest.approx(50), "drop": pytest.approx(100), "eps": pytest.approx(50)}
    flat = spark.createDataFrame([(1.0, 2.0), (1.0, 1.0)], "actual double, predicted double")
    assert metrics.regression_metrics(flat).first()["r2"] is None


def test_diebold_mariano_against_the_formula(spark):
    d = [0.3, -0.1, 0.4, 0.2, 0.5, -0.2]
    c = np.array(d) - np.mean(d)
    lrv = c @ c / 6 + 2 * 0.5 * (c[1:] @ c[:-1]) / 6
    want = np.mean(d) / math.sqrt(lrv / 6) * math.sqrt(5 / 6)
    got = stattests.diebold_mariano(series(spark, d, column="squared_diff")).first()
    assert got.dm_stat == pytest.approx(want) and got.p_value == pytest.approx(numeric.t_two_sided(want, 5))
    assert stattests.diebold_mariano(series(spark, d[:2], column="squared_diff")).first().dm_stat is None


def test_tails():
    assert numeric.t_two_sided(2.228138852, 10) == pytest.approx(0.05, abs=1e-6)
    assert numeric.t_two_sided(0.0, 5) == pytest.approx(1)
    assert numeric.signed_rank_p(21, 6) == pytest.approx(2 / 64) and numeric.signed_rank_p(21, 6, alternative="greater") == pytest.approx(1 / 64)
    assert numeric.signed_rank_p(1400, 60) == pytest.approx(0.0003989, rel=0.2)


def test_wilcoxon_and_spearman(spark):
    got = stattests.wilcoxon_signed_rank(series(spark, [1.0, 2.0, -3.0, 0.0, 4.0, 4.0], column="absolute_diff")).first()
    assert (got.n, got.w_plus, got.stat) == (5, 12.0, 3.0)
    rows = spark.createDataFrame([(k, float(k * k)) for k in range(6)], "x int, y double")
    assert stattests.spearman(rows, "x", "y").first().rho == pytest.approx(1)


def test_walk_forward_equals_refitting(spark):
    rng = np.random.default_rng(0)
    rows = [(f"e{e}", month(m), float(x), float(2 * x + 1 + rng.normal() / 10), float(z)) for m in range(20) for e in range(4) for x, z in [rng.uniform(0, 5, 2)]]
    df = spark.createDataFrame(rows, "entity string, date date, x double, y double, z double")
    for gap in (0, 3):
        got = {(r.entity, r.date): r.predicted for r in backtest.walk_forward(df, ["x", "z"], "y", [gap], penalty=0.0).collect()}
        line = {(r.entity, r.date): r.predicted for r in backtest.walk_forward_ols(df, "x", "y", gap).collect()}
        want, plain = {}, {}
        for m in range(20):
            past = [r for r in rows if r[1] < month(max(0, m - gap))] if m >= gap else []
            if len({r[1] for r in past}) < 12:
                continue
            y = np.array([r[3] for r in past])
            full = np.linalg.lstsq(np.array([[1, r[2], r[4]] for r in past]), y, rcond=None)[0]
            one = np.linalg.lstsq(np.array([[1, r[2]] for r in past]), y, rcond=None)[0]
            for r in rows:
                if r[1] == month(m):
                    want[r[0], r[1]], plain[r[0], r[1]] = max(0, full @ [1, r[2], r[4]]), max(0, one @ [1, r[2]])
        assert got == pytest.approx(want) and line == pytest.approx(plain) and want


def test_folds_and_split(spark):
    df = series(spark, range(20)).withColumn("apps", F.col("apps").cast("double"))
    folds = backtest.walk_forward_folds(df, gap=2).orderBy("origin").collect()
    assert [f.n_train for f in folds] == list(range(12, 18)) and folds[0].origin == month(14)
    parts = backtest.temporal_split(df, 0.7).groupBy("part").count().collect()
    assert {r.part: r["count"] for r in parts} == {"train": 14, "test": 6}


def test_sweep_counts_every_test_row_and_ties_go_low(spark):
    rng = np.random.default_rng(1)
    rows = spark.createDataFrame([(f"e{k % 5}", month(k // 5), float(rng.normal())) for k in range(300)], "entity string, date date, deviation double")
    sweep = alerts.threshold_sweep(rows.where("month(date) < 7"), rows.where("month(date) >= 7"))
    n = rows.where("month(date) >= 7").count()
    assert all(r.tp + r.fp + r.fn + r.tn == n for r in sweep.collect()) and sweep.count() == 10
    tied = spark.createDataFrame([(50, None, None), (55, 0.5, 0.1), (60, 0.5, 0.2)], "percentile int, f1 double, youden_j double")
    assert tuple(alerts.pick_thresholds(tied).first()) == (55, 45, 60)


def test_labels(spark):
    rows = spark.createDataFrame([("a", 3.0), ("a", 2.0), ("a", 1.0), ("a", None), ("b", 99.0)], "entity string, deviation double")
    red, yellow = (spark.createDataFrame([("a", x)], "entity string, threshold double") for x in (2.0, 1.0))
    assert sorted(r.label for r in alerts.label_alerts(rows, red, yellow).collect()) == ["Gray", "Green", "Green", "Red", "Yellow"]


def test_asof_and_lagged_rates(spark):
    rates = spark.createDataFrame([("a", month(k), v) for k, v in enumerate([1.0, 2.0, None, 4.0])], "entity string, date date, rate double")
    history = spark.createDataFrame([("b", month(0), 7.0), ("b", month(1), None)], "entity string, date date, rate double")
    got = {r.entity: (r.asof_1, r.asof_2) for r in panel.asof_last(rates, history, "2020-04-01").collect()}
    assert got == {"a": (2.0, 2.0), "b": (7.0, 7.0)}
    joined = panel.join_lagged_rate(series(spark, [0.0] * 4, "a"), rates)
    assert values(joined, "unemployment_rate") == [None, 1, 2, None] and panel.join_lagged_rate(joined, rates) is joined


def test_audit_finds_what_is_wrong(spark):
    rows = spark.createDataFrame([("a", month(0), "m", 1.0, 0.1, 5.0), ("a", month(0), "m", 1.0, 0.1, 5.0), ("a", month(3), "m", None, None, 6.0), ("b", month(1), "m", -1.0, 0.1, 0.0)], "entity string, date date, market string, apps double, rate double, population double")
    mapping = spark.createDataFrame([("a", "other")], "entity string, market string")
    found = {(r.category, r.entity) for r in audit.audit_all(rows, mapping).collect()}
    assert {("missing", "apps"), ("coverage", "a"), ("coverage", "b"), ("duplicates", "a"), ("mapping", "a"), ("mapping", "b"), ("values", "a"), ("values", "b")} <= found
    assert audit.duplicate_rows(rows).first()["n_copies"] == 2


def test_histogram_keeps_the_right_edge(spark):
    df = spark.createDataFrame([(float(k),) for k in range(61)], "residual double")
    got = {r.bin: r.n for r in metrics.residual_histogram(df).collect()}
    assert got[60] == 2 and sum(got.values()) == 61


def test_qq_fit_of_normal_residuals(spark):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([(float(x),) for x in rng.normal(3, 2, 5000)], "residual double")
    r = metrics.qq_fit(df).first()
    assert (r.slope, r.intercept) == pytest.approx((2, 3), abs=0.15) and r.r > 0.99


def test_tuning_and_trees(spark):
    rng = np.random.default_rng(0)
    rows = [(f"e{e}", month(m), float(x), float(x + 1)) for m in range(18) for e in range(3) for x in [rng.uniform(0, 5)]]
    df = spark.createDataFrame(rows, "entity string, date date, x double, y double")
    best = backtest.tune(df, ["x"], "y", n=5).first()
    assert best.mae < 0.01
    model = backtest.train_regressor(df, ["x"], "y", trees=3, depth=3)
    assert backtest.predict(model, df, ["x"]).count() == len(rows) and backtest.feature_importance(model, ["x"], spark).first().importance == 1


def test_forecast_uses_the_whole_model(spark, monkeypatch):
    fitted, used = [], {}
    train, score = backtest.train_regressor, registry.forecast.forecast_next
    monkeypatch.setattr(backtest, "train_regressor", lambda rows, names, target, **size: fitted.append((names, size)) or train(rows, names, target, trees=2, depth=2))
    monkeypatch.setattr(registry.forecast, "forecast_next", lambda model, rows, names, mae: used.update(rows=rows, mae=mae) or score(model, rows, names, mae))
    sf = "/root/testdata/sf0.01"
    assert registry.QUERIES["forecast_next"](spark, sf).count() > 0
    made = set(used["rows"].columns) - {"entity", "market", "date"}
    assert [(set(names), size) for names, size in fitted] == [(made, {})]
    assert used["mae"] != 0.001 and used["mae"] > 0


def test_forecast_sums_up_the_large_tables_once(spark, monkeypatch):
    made, train = [], backtest.train_regressor
    for name in ("weekly", "rates", "counts", "population"):
        monkeypatch.setattr(registry.I, name, lambda *x, name=name, made_of=getattr(registry.I, name): made.append(name) or made_of(*x))
    monkeypatch.setattr(backtest, "train_regressor", lambda *x: train(*x, trees=1, depth=1))
    monkeypatch.setattr(registry, "_band", lambda rows: 0.1)
    forecast = registry.QUERIES["forecast_next"](spark, "/root/testdata/sf0.001")
    assert sorted(made) == ["counts", "population", "rates", "weekly"]
    assert not [f for f in forecast.inputFiles() if f.endswith(("lineitem.parquet", "orders.parquet", "customer.parquet"))]


@pytest.mark.parametrize("name", ["train_and_predict", "feature_importance"])
def test_queries_fit_the_production_model(spark, monkeypatch, name):
    fitted = []
    train = backtest.train_regressor
    monkeypatch.setattr(backtest, "train_regressor", lambda rows, names, target, **size: fitted.append((names, size)) or train(rows, names, target, trees=2, depth=2))
    assert registry.QUERIES[name](spark, "/root/testdata/sf0.01").count() > 0
    assert fitted == [(registry.FEATURES, {})]


def test_qq_fit_uses_every_residual(spark):
    rng = np.random.default_rng(1)
    for x in ([1.0, 2.0, 2.0, 7.0, -3.0], [*rng.standard_t(2, 6000), *[0.0] * 500, 900.0, -1500.0]):
        n = len(x)
        place = (np.arange(1, n + 1) - 0.3175) / (n + 0.365)
        place[0], place[-1] = 1 - 0.5 ** (1 / n), 0.5 ** (1 / n)
        z, q = np.array([statistics.NormalDist().inv_cdf(p) for p in place]), np.sort(x)
        slope = np.cov(z, q)[0, 1] / np.var(z, ddof=1)
        got = metrics.qq_fit(spark.createDataFrame([(float(v),) for v in x] + [(None,)], "residual double").repartition(5)).first()
        assert (got.slope, got.intercept, got.r) == pytest.approx((slope, q.mean() - slope * z.mean(), np.corrcoef(z, q)[0, 1]), rel=1e-9)


def test_exact_percentiles_of_a_column(spark):
    rng = np.random.default_rng(3)
    for values in ([5.0], [1.0, 2.0, 4.0, 9.0], rng.integers(0, 50, 999).astype(float).tolist()):
        rows = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double")
        got = ranks.percentiles(rows, "x", [0.0, 0.2, 0.85, 1.0]).first()["found"]
        assert got == pytest.approx(np.quantile(values, [0, 0.2, 0.85, 1]).tolist())
        assert sorted((r.i, r.q, r.n) for r in ranks.numbered(rows, "x").collect()) == [(k + 1, v, len(values)) for k, v in enumerate(sorted(values))]
    assert ranks.percentiles(spark.createDataFrame([], "x double"), "x", [0.5]).first()["found"] is None


def test_ties_of_the_latest_rows(spark):
    rows = spark.createDataFrame([("a", 1, 5), ("a", 2, 9), ("a", 2, 3), ("a", 2, 7), ("b", None, 1)], "entity string, date int, x int")
    assert sorted(map(tuple, audit.latest_n(rows, 2).collect())) == [("a", 2, 3), ("a", 2, 7), ("b", None, 1)]


def test_search_over_boosted_trees(spark):
    rows = spark.createDataFrame([(f"e{k % 5}", dt.date(2020 + k // 60, 1 + k // 5 % 12, 1), float(k % 7), float(k % 3), float(k % 7) * 2 + 1) for k in range(180)], "entity string, date date, a double, b double, y double")
    found = backtest.tune_regressor(rows, ["a", "b"], "y", n=2, steps=(1.0,)).collect()
    assert len(found) == 3 and found[0].mae == min(r.mae for r in found) and all(3 <= r.depth <= 9 for r in found)


def test_forecast_beside_history(spark):
    history = spark.createDataFrame([("Alpine County", 1.0), ("Kern", 2.0)], "entity string, apps double")
    ahead = spark.createDataFrame([("Alpine", dt.date(2025, 1, 1), 1234)], "entity string, date date, predicted_applications long")
    assert sorted((r.entity, r.next_count, r.shown_next) for r in alerts.attach_forecast(history, ahead).collect()) == [("Alpine County", 1234, "1,234"), ("Kern", None, "No data")]
