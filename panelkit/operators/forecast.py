"""Next month's features of every entity at once, and its forecast with an error band."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Transformer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.operators.alerts import with_interval
from panelkit.operators.audit import latest_n
from panelkit.operators.backtest import predict
from panelkit.operators.features import add_logs, add_seasonality
from panelkit.operators.panel import asof_last


def signal_features(combined: DataFrame, keywords: Sequence[str]) -> DataFrame:
    """(market, <keyword>_lag1, _lag2, _roll3, _momentum ...) from the last three months of each series (keyword, market, month, value)."""
    last = latest_n(combined, 3, ["keyword", "market"], "month")
    values = F.array_sort(F.collect_list(F.struct("month", "value")))
    x = F.reverse(F.transform(F.col("at"), lambda s: s["value"]))
    rows = last.groupBy("market", "keyword").agg(values.alias("at")).select("market", "keyword", x.alias("x"))
    valid = F.filter("x", lambda v: v.isNotNull())
    mean = F.aggregate(valid, F.lit(0.0), lambda a, b: a + b) / F.size(valid)
    rows = rows.select("market", "keyword", F.get("x", F.lit(0)).alias("lag1"), F.get("x", F.lit(1)).alias("lag2"), F.when(F.size(valid) >= 2, mean).alias("roll3"))
    rows = rows.withColumn("momentum", F.col("lag1") - F.col("lag2"))
    return rows.groupBy("market").agg(*[F.max(F.when(F.col("keyword") == k, F.col(c))).alias(f"{k}_{c}") for k in keywords for c in ("lag1", "lag2", "roll3", "momentum")])


def forecast_rows(dims: DataFrame, combined: DataFrame, rates: DataFrame, history: DataFrame, target: str, keywords: Sequence[str], default_income: float = 60_000.0) -> DataFrame:
    """One row of features for each entity of dims(entity, market, population, income) for the month `target`."""
    known = asof_last(rates, history, target).withColumnsRenamed({"asof_1": "unemployment_rate", "asof_2": "unemployment_rate_lag1"})
    rows = dims.withColumn("income", F.coalesce("income", F.lit(default_income))).join(signal_features(combined, keywords), "market", "left").join(known, "entity", "left")
    rows = add_seasonality(rows.withColumn("date", F.lit(target).cast("date")))
    return add_logs(rows, {"population": "log_population", "income": "log_income"})


def forecast_next(model: Transformer, rows: DataFrame, features: Sequence[str], mae: float) -> DataFrame:
    """(date, entity, market, predicted, predicted_apps, lower_bound, upper_bound, population) of the complete rows."""
    return scored(predict(model, rows, features), mae)


def scored(rows: DataFrame, mae: float) -> DataFrame:
    """forecast_next() of rows that have their `predicted` already."""
    return with_interval(rows, mae).select("date", "entity", "market", "predicted", "predicted_apps", "lower_bound", "upper_bound", "population")
