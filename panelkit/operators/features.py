"""Features: lags, rolling means, momentum, season, logs, quintile; ranges and a registry of them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelkit.functions.columns import month_angle
from panelkit.operators.clean import null_shares
from panelkit.operators.ranks import percentiles


def _by_date(within: Sequence[str] = ("entity",), date: str = "date"):
    return Window.partitionBy(*within).orderBy(date)


def add_lags(panel: DataFrame, signals: Sequence[str], within: Sequence[str] = ("entity",)) -> DataFrame:
    """<signal>_lag1 is the aligned value, which is a month old already; <signal>_lag2 that of the entity's previous row."""
    new = {f"{s}_lag1": F.col(s) for s in signals} | {f"{s}_lag2": F.lag(s, 1).over(_by_date(within)) for s in signals}
    return panel.withColumns(new)


def add_rolling(panel: DataFrame, signals: Sequence[str], window: int = 3, least: int = 2, within: Sequence[str] = ("entity",)) -> DataFrame:
    """<signal>_roll<window>: the mean of the last rows, the present one among them, if `least` of them have a value."""
    rows = _by_date(within).rowsBetween(1 - window, 0)
    return panel.withColumns({f"{s}_roll{window}": F.when(F.count(s).over(rows) >= least, F.avg(s).over(rows)) for s in signals})


def add_momentum(panel: DataFrame, signals: Sequence[str]) -> DataFrame:
    """<signal>_momentum = lag1 - lag2; the lags have to be there."""
    missing = [c for s in signals for c in (f"{s}_lag1", f"{s}_lag2") if c not in panel.columns]
    if missing:
        raise ValueError(f"add_lags() comes first; missing: {', '.join(missing)}")
    return panel.withColumns({f"{s}_momentum": F.col(f"{s}_lag1") - F.col(f"{s}_lag2") for s in signals})


def add_seasonality(panel: DataFrame, date: str = "date") -> DataFrame:
    """month, quarter, month_sin and month_cos."""
    angle = month_angle(F.col(date))
    return panel.withColumns({"month": F.month(date), "quarter": F.quarter(date), "month_sin": F.sin(angle), "month_cos": F.cos(angle)})


def add_logs(panel: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """log10(max(x, 1)) of each column under its new name; null for null."""
    return panel.withColumns({new: F.when(F.col(c).isNotNull(), F.log10(F.greatest(F.col(c), F.lit(1)))) for c, new in columns.items()})


def add_quintile(panel: DataFrame, value: str, entity: str = "entity", name: str = "income_quintile") -> DataFrame:
    """1 to 5 by the fifths of one value per entity: edges are linear quantiles, closed on the right, the lowest value included.

    Equal edges are taken once, and the numbers stay 1, 2 and so on. An entity's value is its smallest; nulls have none.
    """
    per_entity = panel.groupBy(entity).agg(F.min(value).alias("__x"))
    edges = percentiles(per_entity, "__x", [0.2, 0.4, 0.6, 0.8, 1.0], "__edges").select(F.array_distinct("__edges").alias("__edges"))
    below = F.size(F.filter("__edges", lambda e: e < F.col("__x"))) + 1
    numbered = per_entity.crossJoin(F.broadcast(edges)).select(entity, F.when(F.col("__x").isNotNull(), below).cast("int").alias(name))
    return panel.join(numbered, entity, "left")


def feature_ranges(panel: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, min, max), in one pass."""
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.min(f).cast("double").alias("min"), F.max(f).cast("double").alias("max")) for f in features])
    return panel.agg(pairs.alias("ranges")).select(F.inline("ranges"))


def feature_registry(panel: DataFrame, registry: DataFrame) -> DataFrame:
    """registry(name, ...) with n_null, null_pct and present for each feature; absent ones have no counts."""
    names = [r["name"] for r in registry.select("name").collect()]
    counted = null_shares(panel, [n for n in names if n in panel.columns]).select(F.col("column").alias("name"), "n_null", F.col("pct").alias("null_pct"))
    return registry.join(counted, "name", "left").withColumn("present", F.col("n_null").isNotNull())
