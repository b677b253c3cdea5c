"""Assembling the panel: lag-shifted joins to signals, dimensions, and rates known at the time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelkit.functions.columns import lag_key, normalize_key
from panelkit.operators.clean import add_rate


def assemble_panel(counts: DataFrame, markets: DataFrame, signals: DataFrame, population: DataFrame, income: DataFrame, drop_unmapped: bool = True) -> DataFrame:
    """counts(entity, date, apps) with market, signals of the month before, population, income, month and rate.

    markets(entity, market), signals(market, month, signal_* ...: all keywords side by side, so one join),
    population(entity, population), income(key, income) with keys free of blanks. Dimensions are small; the
    planner broadcasts them by their measured size.
    """
    wide = signals.withColumnRenamed("month", "__signal_month")
    panel = (
        counts.join(markets.select("entity", "market"), "entity", "left")
        .withColumn("__signal_month", lag_key(F.col("date")))
        .join(wide, ["market", "__signal_month"], "left")
        .join(population.select("entity", "population"), "entity", "left")
        .withColumn("__key", normalize_key(F.col("entity")))
        .join(income.select(F.col("key").alias("__key"), "income"), "__key", "left")
        .drop("__key", "__signal_month")
        .withColumn("month", F.month("date"))
    )
    panel = add_rate(panel)
    return panel.dropna(subset=["market"]) if drop_unmapped else panel


def join_lagged_rate(panel: DataFrame, rates: DataFrame, name: str = "unemployment_rate") -> DataFrame:
    """panel with the rate one and two rows earlier in the rate's own series: `name` and `name`_lag1.

    The shift is made before the join. A panel that has both columns stays as it is.
    """
    if name in panel.columns and f"{name}_lag1" in panel.columns:
        return panel
    by_date = Window.partitionBy("entity").orderBy("date")
    shifted = rates.select("entity", "date", F.lag("rate", 1).over(by_date).alias(name), F.lag("rate", 2).over(by_date).alias(f"{name}_lag1"))
    return panel.join(shifted, ["entity", "date"], "left")


def asof_last(rates: DataFrame, history: DataFrame, target: str, lags: tuple[int, ...] = (1, 2), value: str = "rate") -> DataFrame:
    """(entity, asof_1, asof_2 ...): the last rate known k months before `target`, for the entities of either table.

    Entities without one in `rates` get the last value of their own history(entity, date, rate).
    """
    month = F.lit(target).cast("date")
    in_time = lambda k: F.when((F.col("date") <= F.add_months(month, -k)) & F.col(value).isNotNull(), F.col("date"))
    known = [F.max_by(F.col(value), in_time(k)).alias(f"asof_{k}") for k in lags]
    found = rates.groupBy("entity").agg(*known)
    own = history.where(F.col(value).isNotNull()).groupBy("entity").agg(F.max_by(value, "date").alias("__own"))
    joined = found.join(own, "entity", "full")
    return joined.select("entity", *[F.coalesce(f"asof_{k}", "__own").alias(f"asof_{k}") for k in lags])
