"""Back-tests by walk-forward refits, from prefix sums instead of repeated passes over the data.

Least squares needs nothing of its training rows but sums of products. These are added up once for each
month; the sums of all months before a forecast origin, less a gap, are a window over that small table. So
every origin, gap and feature set comes from one pass over the panel.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from itertools import combinations_with_replacement, product

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.pipeline import Pipeline
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelkit.functions import numeric
from panelkit.functions.columns import at_least
from panelkit.operators.metrics import regression_metrics
from panelkit.operators.months import month_number
from panelkit.operators.stattests import diebold_mariano, paired_monthly_losses, spearman, wilcoxon_signed_rank
from panelkit.session import written

MIN_MONTHS, MIN_ROWS = 12, 10


def _before(gap: int):
    """All months that are over `gap` months before the present row's; the window is for tables with a row per month."""
    return Window.orderBy("m").rangeBetween(Window.unboundedPreceding, -1 - gap)


def _latest_month(date: str) -> Column:
    return F.trunc(date, "MM").alias("origin")


def walk_forward_folds(panel: DataFrame, gap: int = 0, min_months: int = MIN_MONTHS, date: str = "date") -> DataFrame:
    """(origin, n_train, n_test): every month with at least min_months different months before its cut-off."""
    months = panel.groupBy(_latest_month(date)).agg(F.count("*").alias("n_test")).withColumn("m", month_number(F.col("origin")))
    w = _before(gap)
    sized = months.select("origin", F.sum("n_test").over(w).alias("n_train"), "n_test", F.count("*").over(w).alias("n_months"))
    return sized.where(F.col("n_months") >= min_months).drop("n_months")


def gram_by_month(panel: DataFrame, x: str, y: str, date: str = "date") -> DataFrame:
    """(origin, n, sx, sy, sxx, sxy): sums by month over the complete rows."""
    rows = panel.dropna(subset=[x, y])
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    return rows.groupBy(_latest_month(date)).agg(F.count("*").alias("n"), F.sum(a).alias("sx"), F.sum(b).alias("sy"), F.sum(a * a).alias("sxx"), F.sum(a * b).alias("sxy"))


def ols_by_origin(panel: DataFrame, x: str, y: str, gap: int = 0, min_months: int = MIN_MONTHS, min_rows: int = MIN_ROWS, date: str = "date") -> DataFrame:
    """(origin, n_train, slope, intercept) of y on x over the months before each origin; slope 0 for a constant x."""
    sums = gram_by_month(panel, x, y, date).withColumn("m", month_number(F.col("origin")))
    w = _before(gap)
    total = sums.select("origin", *[F.sum(c).over(w).alias(c) for c in ("n", "sx", "sy", "sxx", "sxy")], F.count("*").over(w).alias("n_months"))
    total = total.where((F.col("n_months") >= min_months) & (F.col("n") >= min_rows))
    spread = F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")
    slope = F.when(spread > 0, (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / spread).otherwise(0.0)
    fitted = total.withColumn("slope", slope)
    return fitted.select("origin", F.col("n").alias("n_train"), "slope", ((F.col("sy") - F.col("slope") * F.col("sx")) / F.col("n")).alias("intercept"))


def walk_forward_ols(panel: DataFrame, x: str, y: str, gap: int = 0, min_months: int = MIN_MONTHS, date: str = "date") -> DataFrame:
    """(entity, date, predicted, actual) of each month by the line fitted on the months before it, not below 0."""
    fits = ols_by_origin(panel, x, y, gap, min_months, date=date)
    rows = panel.dropna(subset=[x, y]).withColumn("origin", F.trunc(date, "MM")).join(fits, "origin")
    return rows.select("entity", date, at_least(F.col("intercept") + F.col("slope") * F.col(x), 0.0).alias("predicted"), F.col(y).cast("double").alias("actual"))


def _pairs(features: Sequence[str]) -> list[tuple[int, int]]:
    """All pairs of places among 1, the features and the target, in order."""
    return list(combinations_with_replacement(range(len(features) + 2), 2))


def _pair_sums(panel: DataFrame, features: Sequence[str], y: str, by: Sequence[Column]) -> DataFrame:
    """(by..., n, sums): the rows, and the sums of products of all pairs among 1, the features and y as an array in the order of _pairs()."""
    z = [F.lit(1.0), *[F.col(f).cast("double") for f in features], F.col(y).cast("double")]
    sums = F.array(*[F.sum(z[i] * z[j]) for i, j in _pairs(features)])
    return panel.dropna(subset=[*features, y]).groupBy(*by).agg(F.count("*").alias("n"), sums.alias("sums"))


def _solved(features: Sequence[str], penalties: Sequence[float]) -> Callable[[Column], Column]:
    """An array of coefficients for each penalty, the intercept first, from an array of sums."""
    size, (i, j) = len(features) + 2, zip(*_pairs(features))

    @F.pandas_udf("array<array<double>>")
    def solve(sums: pd.Series) -> pd.Series:
        def of(s: np.ndarray) -> list[list[float]]:
            full = np.zeros((size, size))
            full[i, j] = full[j, i] = s
            return [numeric.ridge(full[0, 0], full[0, 1:], full[1:, 1:], p).tolist() for p in penalties]

        return sums.map(of)

    return solve


def fits_by_origin(panel: DataFrame, features: Sequence[str], y: str, gaps: Sequence[int] = (0,), penalties: Sequence[float] = (1e-6,), min_months: int = MIN_MONTHS, date: str = "date") -> DataFrame:
    """(origin, gap, n_train, penalty, coefficients): ridge fits for every origin, gap and penalty; the intercept comes first.

    The sums of a month count from the month after it and the gap on. So one window over origins and sums in that order, for each gap
    and pair, adds up what every origin may know.
    """
    sums = written(_pair_sums(panel, features, y, [_latest_month(date)]).withColumn("m", month_number(F.col("origin"))))
    each = sums.withColumn("gap", F.explode(F.array(*[F.lit(g) for g in gaps]))).select("origin", "m", "gap", "n", F.posexplode("sums").alias("pair", "s"))
    nothing = F.lit(None)
    known = each.select(nothing.cast("date").alias("origin"), (F.col("m") + F.col("gap") + 1).alias("at"), "gap", "pair", "s", "n")
    asked = each.select("origin", F.col("m").alias("at"), "gap", "pair", nothing.cast("double").alias("s"), nothing.cast("long").alias("n"))
    so_far = Window.partitionBy("gap", "pair").orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    total = known.unionByName(asked).select("origin", "gap", "pair", F.sum("s").over(so_far).alias("s"), F.sum("n").over(so_far).alias("n"), F.count("n").over(so_far).alias("n_months"))
    total = total.where(F.col("origin").isNotNull() & (F.col("n_months") >= min_months) & (F.col("n") >= MIN_ROWS))
    by_origin = total.groupBy("origin", "gap").agg(F.max("n").alias("n_train"), F.transform(F.array_sort(F.collect_list(F.struct("pair", "s"))), lambda x: x["s"]).alias("sums"))
    solved = by_origin.select("origin", "gap", "n_train", _solved(features, penalties)("sums").alias("found"))
    named = F.arrays_zip(F.array(*[F.lit(float(p)) for p in penalties]).alias("penalty"), F.col("found").alias("coefficients"))
    return solved.select("origin", "gap", "n_train", F.inline(named).alias("penalty", "coefficients"))


def linear_prediction(coefficients: Column, features: Sequence[str]) -> Column:
    terms = [F.lit(1.0), *[F.col(f).cast("double") for f in features]]
    return sum((coefficients[k] * t for k, t in enumerate(terms[1:], 1)), coefficients[0] * terms[0])


def walk_forward(panel: DataFrame, features: Sequence[str], target: str, gaps: Sequence[int] = (0,), penalty: float = 1e-6, min_months: int = MIN_MONTHS, date: str = "date") -> DataFrame:
    """(entity, date, gap, predicted, actual): each month by ridge over all features, refitted on what is known then."""
    fits = fits_by_origin(panel, features, target, gaps, (penalty,), min_months, date)
    rows = panel.dropna(subset=[*features, target]).withColumn("origin", F.trunc(date, "MM")).join(fits, "origin")
    return rows.select("entity", date, "gap", at_least(linear_prediction(F.col("coefficients"), features), 0.0).alias("predicted"), F.col(target).cast("double").alias("actual"))


def align_predictions(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("entity", "date")) -> DataFrame:
    """(keys..., actual, predicted_a, predicted_b) of the rows that both have."""
    left = a.select(*keys, "actual", F.col("predicted").alias("predicted_a"))
    return left.join(b.select(*keys, F.col("predicted").alias("predicted_b")), list(keys)).dropna(subset=["actual", "predicted_a", "predicted_b"])


def gap_predictions(panel: DataFrame, without: Sequence[str], with_signals: Sequence[str], target: str, gaps: Sequence[int] = range(13), min_months: int = MIN_MONTHS) -> DataFrame:
    """(gap, entity, date, actual, predicted_a, predicted_b) of both feature sets for every gap."""
    panel = written(panel.select("entity", "date", *dict.fromkeys([*without, *with_signals, target])))
    a, b = (walk_forward(panel, f, target, list(gaps), min_months=min_months) for f in (without, with_signals))
    return written(align_predictions(a, b, ("gap", "entity", "date")))


def gap_comparison(aligned: DataFrame, smape: str = "drop", hac_lags: int = 1, p_value: bool = True) -> DataFrame:
    """For each gap: n, r2, mae and smape of both, their differences, and the tests of b against a."""
    a, b = (regression_metrics(aligned, ["gap"], "actual", f"predicted_{x}", smape) for x in "ab")
    names = ("r2", "mae", "smape")
    both = a.select("gap", "n", *[F.col(c).alias(f"no_{c}") for c in names]).join(b.select("gap", *[F.col(c).alias(f"with_{c}") for c in names]), "gap")
    both = both.withColumns({f"delta_{c}": F.col(f"with_{c}") - F.col(f"no_{c}") for c in names})
    losses = paired_monthly_losses(aligned, "predicted_a", "predicted_b", by=["gap"])
    dm = diebold_mariano(losses, by=["gap"], hac_lags=hac_lags, p_value=p_value).withColumnsRenamed({"n": "n_months", "p_value": "dm_p"}).drop("mean_diff")
    w = wilcoxon_signed_rank(losses, by=["gap"], p_value=p_value).drop("n").withColumnRenamed("stat", "wilcoxon_stat")
    return both.join(dm, "gap", "left").join(w, "gap", "left")


def gap_trend(comparison: DataFrame, p_value: bool = True) -> DataFrame:
    """Spearman's correlation of the gap and the gain in r2, with the mean gain."""
    mean = comparison.agg(F.avg("delta_r2").alias("mean_delta_r2"))
    return spearman(comparison, "gap", "delta_r2", p_value=p_value).crossJoin(mean)


def ablation(panel: DataFrame, without: Sequence[str], with_signals: Sequence[str], target: str, period: tuple[str, str] | None = None, min_months: int = MIN_MONTHS, p_value: bool = True) -> DataFrame:
    """One row: gap_comparison() at gap 0, on the rows outside the excluded period."""
    from panelkit.operators.clean import exclude_period

    aligned = gap_predictions(panel, without, with_signals, target, (0,), min_months)
    return gap_comparison(exclude_period(aligned, *period) if period else aligned, smape="eps", p_value=p_value)


def temporal_split(rows: DataFrame, share: float, date: str = "date", name: str = "part") -> DataFrame:
    """rows with `name` train or test: the first int(n x share) of the n different dates are train."""
    dates = rows.select(date).distinct()
    ranked = dates.withColumn("__rank", F.row_number().over(Window.orderBy(date))).crossJoin(F.broadcast(dates.agg(F.count("*").alias("__n"))))
    part = F.when(F.col("__rank") <= F.floor(F.col("__n") * F.lit(share)), "train").otherwise("test")
    return rows.join(ranked.select(date, part.alias(name)), date)


def pick_candidate(scored: DataFrame, by: str = "mae", order: str = "candidate") -> DataFrame:
    """The one row with the lowest error; of equal ones the first."""
    return scored.orderBy(F.asc_nulls_last(by), order).limit(1)


def random_penalties(n: int = 60, seed: int = 42, low: float = -8, high: float = 2) -> list[float]:
    return (10 ** np.random.default_rng(seed).uniform(low, high, n)).tolist()


def score_penalties(panel: DataFrame, features: Sequence[str], target: str, penalties: Sequence[float], share: float = 0.78, date: str = "date") -> DataFrame:
    """(candidate, penalty, mae): hold-out error of each penalty. One table of sums serves all fits; the candidates meet the rows as one array."""
    parts = temporal_split(panel.dropna(subset=[*features, target]), share, date)
    sums = _pair_sums(parts.where("part = 'train'"), features, target, [])
    listed = sums.select(_solved(features, penalties)("sums").alias("fits"))  # one row of len(penalties) short arrays
    rows = parts.where("part = 'test'").crossJoin(F.broadcast(listed))
    errors = [F.avg(F.abs(at_least(linear_prediction(F.col("fits")[k], features), 0.0) - F.col(target))) for k in range(len(penalties))]
    table = F.array(*[F.struct(F.lit(k).alias("candidate"), F.lit(p).alias("penalty"), e.alias("mae")) for k, (p, e) in enumerate(zip(penalties, errors))])
    return rows.agg(table.alias("t")).select(F.inline("t"))


def tune(panel: DataFrame, features: Sequence[str], target: str, n: int = 60, seed: int = 42, share: float = 0.78, date: str = "date") -> DataFrame:
    """The best penalty: first of n random ones, then of a grid of 27 around that."""
    panel = written(panel.select(date, *dict.fromkeys([*features, target])))
    first = pick_candidate(score_penalties(panel, features, target, random_penalties(n, seed), share)).first()
    grid = [first["penalty"] * 10 ** (k / 13) for k in range(-13, 14)]
    return pick_candidate(score_penalties(panel, features, target, grid, share))


def train_regressor(panel: DataFrame, features: Sequence[str], target: str, trees: int = 50, depth: int = 5, rate: float = 0.1, min_rows: int = 5, subsample: float = 0.8, seed: int = 42) -> PipelineModel:
    """Boosted trees on the whole panel: the production model. Targets below 0 count as 0."""
    gbt = GBTRegressor(featuresCol="features", labelCol="__y", maxIter=trees, maxDepth=depth, stepSize=rate, minInstancesPerNode=min_rows, subsamplingRate=subsample, seed=seed)
    rows = panel.dropna(subset=[*features, target]).withColumn("__y", F.greatest(F.col(target), F.lit(0.0)))
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features"), gbt]).fit(rows)


#: What the random search of tune_regressor() draws from.
SEARCHED = {"trees": (20, 200), "depth": (3, 9), "rate": (0.02, 0.3), "subsample": (0.6, 1.0), "min_rows": (2, 12)}


def tune_regressor(panel: DataFrame, features: Sequence[str], target: str, n: int = 60, steps: Sequence[float] = (0.75, 1.0, 1.25), seed: int = 42, share: float = 0.78, date: str = "date") -> DataFrame:
    """(candidate, mae, trees, depth, rate, subsample, min_rows), the best first: boosted trees scored on the latest dates.

    First n random candidates, then a grid around the best one: its trees, depth and rate times each of the steps.
    """
    parts = written(temporal_split(panel.dropna(subset=[*features, target]), share, date))
    train, test = (parts.where(F.col("part") == x) for x in ("train", "test"))

    def scored(found: Mapping[str, float]) -> dict:
        settings = {k: v if k in ("rate", "subsample") else max(1, round(v)) for k, v in found.items()}
        model = train_regressor(train, features, target, seed=seed, **settings)
        return {"mae": predict(model, test, features).agg(F.avg(F.abs(F.col("predicted") - F.col(target)))).first()[0], **settings}

    draw = np.random.default_rng(seed)
    tried = [scored({k: float(draw.uniform(*v)) for k, v in SEARCHED.items()}) for _ in range(n)]
    best = min(tried, key=lambda x: x["mae"])
    around = [{"trees": best["trees"] * a, "depth": best["depth"] * b, "rate": best["rate"] * c} for a, b, c in product(steps, repeat=3)]
    tried += [scored({k: v for k, v in best.items() if k != "mae"} | x) for x in around]
    schema = "candidate long, mae double, trees long, depth long, rate double, subsample double, min_rows long"
    rows = [(k, x["mae"], x["trees"], x["depth"], x["rate"], x["subsample"], x["min_rows"]) for k, x in enumerate(tried)]
    return panel.sparkSession.createDataFrame(rows, schema).orderBy("mae", "candidate")


def predict(model: Transformer, rows: DataFrame, features: Sequence[str], name: str = "predicted") -> DataFrame:
    """rows that are complete in the features, with the model's prediction, not below 0."""
    scored = model.transform(rows.dropna(subset=list(features)))
    return scored.withColumn(name, F.greatest(F.col("prediction"), F.lit(0.0))).drop("features", "prediction")


def feature_importance(model: PipelineModel, features: Sequence[str], spark) -> DataFrame:
    """(feature, importance), the highest first."""
    weights = model.stages[-1].featureImportances.toArray().tolist()
    return spark.createDataFrame(list(zip(features, weights)), "feature string, importance double").orderBy(F.desc("importance"), "feature")
