"""Metrics of forecasts by any group, and the tables behind the reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelkit.functions.special import normal_quantile
from panelkit.operators.ranks import numbered

SMAPE_MODES = ("zero", "drop", "eps")


def smape_term(actual: Column, predicted: Column, mode: str = "zero") -> Column:
    """One row's share of the symmetric error, in percent. Where both are 0: counted as 0 ('zero'), left out ('drop'), or damped by 1e-9 ('eps')."""
    if mode not in SMAPE_MODES:
        raise ValueError(f"mode must be one of {SMAPE_MODES}")
    size, error = F.abs(actual) + F.abs(predicted), 200 * F.abs(actual - predicted)
    if mode == "eps":
        return error / (size + 1e-9)
    return F.when(size > 0, F.try_divide(error, size)).otherwise(F.lit(0.0 if mode == "zero" else None))


def regression_metrics(rows: DataFrame, by: Sequence[str] = (), actual: str = "actual", predicted: str = "predicted", smape: str = "zero", clip: bool = False) -> DataFrame:
    """(by..., n, r2, rmse, mae, smape) of rows in which both values are there; r2 is null for a constant target."""
    rows = rows.dropna(subset=[actual, predicted])
    y, p = F.col(actual), F.greatest(F.col(predicted), F.lit(0.0)) if clip else F.col(predicted)
    sse, n = F.sum((y - p) * (y - p)), F.count("*")
    sst = F.var_pop(y) * n
    return rows.groupBy(*by).agg(
        n.alias("n"), F.when(sst > 0, 1 - F.try_divide(sse, sst)).alias("r2"), F.sqrt(F.try_divide(sse, n)).alias("rmse"),
        F.avg(F.abs(y - p)).alias("mae"), F.avg(smape_term(y, p, smape)).alias("smape"),
    )


def backtest_summary(by_month: DataFrame) -> DataFrame:
    """One row from the metrics by month: mean and population deviation of r2, months, predictions."""
    return by_month.agg(F.avg("r2").alias("mean_r2"), F.stddev_pop("r2").alias("std_r2"), F.count("*").alias("n_months"), F.sum("n").alias("n_predictions"))


def interval_mae(predictions: DataFrame, date: str = "date", actual: str = "actual", predicted: str = "predicted", default: float = 0.000877) -> DataFrame:
    """One row: the mean of the months' mean absolute errors, `default` without any month."""
    months = predictions.dropna(subset=[actual, predicted]).groupBy(date).agg(F.avg(F.abs(F.col(actual) - F.col(predicted))).alias("mae"))
    return months.agg(F.coalesce(F.avg("mae"), F.lit(default)).alias("mae"))


def monthly_rollup(rows: DataFrame, sums: Sequence[str] = (), means: Sequence[str] = (), date: str = "date") -> DataFrame:
    """(date, total_<column>..., mean_<column>...)."""
    return rows.groupBy(date).agg(*[F.sum(c).alias(f"total_{c}") for c in sums], *[F.avg(c).alias(f"mean_{c}") for c in means])


def panel_profile(rows: DataFrame, entity: str = "entity", market: str = "market", date: str = "date", approximate: bool = False) -> DataFrame:
    """One row: entities, markets, first and last date, rows."""
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    return rows.agg(distinct(entity).alias("n_entities"), distinct(market).alias("n_markets"), F.min(date).alias("first_date"), F.max(date).alias("last_date"), F.count("*").alias("n_rows"))


def residual_histogram(rows: DataFrame, residual: str = "residual", bins: int = 60) -> DataFrame:
    """(bin, n, overall_mean) of all equal bins from the least to the largest residual, which is in the last bin; equal residuals are all in the first."""
    edges = F.broadcast(rows.agg(F.min(residual).alias("__low"), F.max(residual).alias("__high"), F.avg(residual).alias("overall_mean")))
    inside = F.when(F.col("__high") > F.col("__low"), F.least(F.lit(bins), F.width_bucket(F.col(residual), F.col("__low"), F.col("__high"), F.lit(bins)))).otherwise(1)
    counted = rows.dropna(subset=[residual]).crossJoin(edges).groupBy(inside.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    every = rows.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("bin")).crossJoin(edges.select("overall_mean"))
    return every.join(counted, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), "overall_mean")


def qq_points(rows: DataFrame, residual: str = "residual") -> DataFrame:
    """(i, z, q): every residual in order with the normal quantile of its place; the places are Filliben's medians of order statistics."""
    i, n = F.col("i"), F.col("n")
    last = F.pow(F.lit(0.5), 1 / n)
    place = F.when(i == n, last).when(i == 1, 1 - last).otherwise((i - 0.3175) / (n + 0.365))
    return numbered(rows, residual).select("i", normal_quantile(place).alias("z"), "q")


def qq_fit(rows: DataFrame, residual: str = "residual") -> DataFrame:
    """One row: slope, intercept and correlation of the points of qq_points()."""
    return qq_points(rows, residual).agg(F.regr_slope("q", "z").alias("slope"), F.regr_intercept("q", "z").alias("intercept"), F.corr("q", "z").alias("r"))


def smooth_centered(by_date: DataFrame, value: str, date: str = "date", before: int = 3, after: int = 2, least: int = 3, name: str = "smoothed") -> DataFrame:
    """A monthly table with the mean over the rows before and after each, if `least` of them have a value."""
    rows = Window.orderBy(date).rowsBetween(-before, after)
    return by_date.withColumn(name, F.when(F.count(value).over(rows) >= least, F.avg(value).over(rows)))
