"""Tests of two forecasts against each other on monthly losses. All are built-in functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelkit.functions.special import signed_rank_p, t_two_sided


def paired_monthly_losses(rows: DataFrame, a: str, b: str, actual: str = "actual", date: str = "date", by: Sequence[str] = ()) -> DataFrame:
    """(by..., date, n, se_a, se_b, ae_a, ae_b, squared_diff, absolute_diff): mean losses of a month; positive if b is better."""
    rows = rows.dropna(subset=[actual, a, b])
    y = F.col(actual)
    means = rows.groupBy(*by, date).agg(
        F.count("*").alias("n"), *[F.avg((y - F.col(m)) * (y - F.col(m))).alias(f"se_{x}") for x, m in (("a", a), ("b", b))], *[F.avg(F.abs(y - F.col(m))).alias(f"ae_{x}") for x, m in (("a", a), ("b", b))]
    )
    return means.withColumns({"squared_diff": F.col("se_a") - F.col("se_b"), "absolute_diff": F.col("ae_a") - F.col("ae_b")})


def _group(by: Sequence[str]) -> list[Column]:
    return [F.col(c) for c in by] or [F.lit(0)]


def diebold_mariano(losses: DataFrame, diff: str = "squared_diff", date: str = "date", by: Sequence[str] = (), hac_lags: int = 1, horizon: int = 1, p_value: bool = True) -> DataFrame:
    """(by..., n, mean_diff, dm_stat, p_value): the statistic with Bartlett weights and the small-sample factor.

    Null with fewer than three months, or where the long-run variance is not above 0. One row per month and group goes in.
    """
    group = _group(by)
    whole, ordered = Window.partitionBy(*group), Window.partitionBy(*group).orderBy(date)
    rows = losses.where(F.col(diff).isNotNull() & ~F.isnan(diff)).withColumn("__c", F.col(diff) - F.avg(diff).over(whole))
    rows = rows.withColumns({f"__c{k}": F.col("__c") * F.lag("__c", k).over(ordered) for k in range(1, hac_lags + 1)})
    n = F.count("*")
    top = F.least(F.lit(hac_lags), n - 1)
    lrv = F.sum(F.col("__c") * F.col("__c")) / n
    for k in range(1, hac_lags + 1):
        lrv = lrv + F.when(F.lit(k) <= top, 2 * (1 - F.lit(k) / (top + 1.0)) * F.coalesce(F.sum(f"__c{k}"), F.lit(0.0)) / n).otherwise(0.0)
    found = rows.groupBy(*by).agg(n.alias("n"), F.avg(diff).alias("mean_diff"), lrv.alias("lrv"))
    factor = F.sqrt((F.col("n") + 1 - 2 * horizon + horizon * (horizon - 1) / F.col("n")) / F.col("n"))
    stat = F.when((F.col("n") >= 3) & (F.col("lrv") > 0), F.col("mean_diff") / F.sqrt(F.col("lrv") / F.col("n")) * factor)
    found = found.select(*by, "n", "mean_diff", stat.alias("dm_stat"))
    return found.withColumn("p_value", t_two_sided(F.col("dm_stat"), F.col("n") - 1)) if p_value else found


def average_rank(value: Column, group: Sequence[Column]) -> Column:
    """Ranks from 1, equal values sharing the mean of their ranks."""
    return F.rank().over(Window.partitionBy(*group).orderBy(value)) + (F.count("*").over(Window.partitionBy(*group, value)) - 1) / 2


def wilcoxon_signed_rank(losses: DataFrame, diff: str = "absolute_diff", by: Sequence[str] = (), p_value: bool = True) -> DataFrame:
    """(by..., n, w_plus, stat, p_two_sided, p_greater) of monthly differences; zeros are dropped, stat is the smaller sum."""
    rows = losses.where(F.col(diff).isNotNull() & (F.col(diff) != 0)).withColumn("__size", F.abs(diff))
    rows = rows.withColumn("__rank", average_rank(F.col("__size"), _group(by)))
    same = F.count("*").over(Window.partitionBy(*_group(by), "__size"))
    rows = rows.withColumn("__ties", same * same - 1)
    plus, minus = (F.coalesce(F.sum(F.when(x, F.col("__rank"))), F.lit(0.0)) for x in (F.col(diff) > 0, F.col(diff) < 0))
    found = rows.groupBy(*by).agg(F.count("*").alias("n"), plus.alias("w_plus"), F.least(plus, minus).alias("stat"), F.coalesce(F.sum("__ties"), F.lit(0)).cast("double").alias("__ties"))
    if not p_value:
        return found.drop("__ties")
    tested = found.withColumn("__p", signed_rank_p(F.col("w_plus"), F.col("n"), F.col("__ties")))
    return tested.select(*by, "n", "w_plus", "stat", F.col("__p.two_sided").alias("p_two_sided"), F.col("__p.greater").alias("p_greater"))


def spearman(rows: DataFrame, x: str, y: str, by: Sequence[str] = (), p_value: bool = True) -> DataFrame:
    """(by..., n, rho, p_value) of a reduced table."""
    group = _group(by)
    ranked = rows.dropna(subset=[x, y]).withColumns({"__x": average_rank(F.col(x), group), "__y": average_rank(F.col(y), group)})
    found = ranked.groupBy(*by).agg(F.count("*").alias("n"), F.corr("__x", "__y").alias("rho"))
    if not p_value:
        return found
    t = F.col("rho") * F.sqrt((F.col("n") - 2) / F.nullif(1 - F.col("rho") * F.col("rho"), F.lit(0.0)))
    return found.withColumn("p_value", F.when(F.abs("rho") < 1, t_two_sided(t, F.col("n") - 2)).otherwise(F.when(F.col("rho").isNotNull(), F.lit(0.0))))
