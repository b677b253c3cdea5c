"""Cleaning: interpolation, outliers, priorities among duplicates, incomplete rows, a common shape."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelkit.functions.columns import at_least, percent, rate
from panelkit.operators.ranks import percentiles


def dedupe_by(rows: DataFrame, keys: Sequence[str], priority: Sequence[str | Column], keep: str = "first") -> DataFrame:
    """One row for each key: the first or the last by the given order, which should have no ties."""
    order = [F.col(p) if isinstance(p, str) else p for p in priority]
    if keep == "last":
        order = [p.desc() for p in order]
    return rows.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__rank = 1").drop("__rank")


def interpolate_series(rows: DataFrame, entity: str = "entity", date: str = "date", value: str = "apps", trailing: str = "carry") -> DataFrame:
    """rows with `value` filled in, and `fill`: observed, interpolated, carried, mean or missing.

    Gaps between observations are filled linearly by row position; those at the end carry the last value
    (or, with trailing='mean', join the leading ones); leading ones get the mean of the entity's series after that.
    Rows without an entity are dropped.
    """
    by_date = Window.partitionBy(entity).orderBy(date)
    back = by_date.rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(entity).orderBy(F.desc("__at")).rowsBetween(Window.unboundedPreceding, 0)  # running, where a frame that shrinks is read anew for each row
    x = F.col(value).cast("double")
    placed = rows.where(F.col(entity).isNotNull()).withColumn("__at", F.row_number().over(by_date)).withColumn("__x", x)
    seen = F.when(F.col("__x").isNotNull(), F.struct("__at", "__x"))
    placed = placed.withColumn("__before", F.last(seen, True).over(back)).withColumn("__after", F.last(seen, True).over(ahead))
    lined, fill = filled_lines(placed, value, trailing)
    mean = F.avg("__linear").over(Window.partitionBy(entity))
    return lined.withColumn(value, F.coalesce("__linear", mean)).withColumn("fill", fill).drop("__at", "__x", "__before", "__after", "__linear")


def filled_lines(placed: DataFrame, value: str, trailing: str) -> tuple[DataFrame, Column]:
    """placed (with a row's place and value __at, __x and the observations on both sides, __before and __after) with __linear, and the column `fill`."""
    a, b = F.col("__before"), F.col("__after")
    line = a["__x"] + (b["__x"] - a["__x"]) * (F.col("__at") - a["__at"]) / (b["__at"] - a["__at"])
    carried = a["__x"] if trailing == "carry" else F.lit(None).cast("double")
    linear = F.when(F.col("__x").isNotNull(), F.col("__x")).when(a.isNotNull() & b.isNotNull(), line).when(a.isNotNull(), carried)
    fill = (
        F.when(F.col("__x").isNotNull(), "observed").when(a.isNotNull() & b.isNotNull(), "interpolated").when(F.col("__linear").isNotNull(), "carried")
        .when(F.col(value).isNotNull(), "mean").otherwise("missing")
    )
    return placed.withColumn("__linear", linear), fill


def imputation_report(filled: DataFrame, entity: str = "entity") -> DataFrame:
    """(entity, n_missing, n_interpolated, n_mean, n_left) of the output of interpolate_series(); carried rows count as interpolated."""
    of = lambda *kinds: F.count_if(F.col("fill").isin(*kinds))
    return filled.groupBy(entity).agg(
        F.count_if(F.col("fill") != "observed").alias("n_missing"), of("interpolated", "carried").alias("n_interpolated"), of("mean").alias("n_mean"), of("missing").alias("n_left")
    )


def remove_outliers(rows: DataFrame, value: str, entity: str = "entity", factor: float = 5.0) -> DataFrame:
    """Rows with value <= factor x the entity's median; rows without a value or an entity are dropped too."""
    named = rows.where(F.col(entity).isNotNull())
    medians = percentiles(named, value, [0.5], "__median", [entity]).select(F.col(entity).alias("__entity"), F.get("__median", F.lit(0)).alias("__median"))
    return named.join(medians, F.col(entity) == F.col("__entity")).where(F.col(value) <= factor * F.col("__median")).drop("__entity", "__median")


def add_rate(rows: DataFrame, count: str = "apps", population: str = "population", name: str = "rate") -> DataFrame:
    """rows with count / population, not below 0."""
    return rows.withColumn(name, at_least(rate(F.col(count), F.col(population)), 0.0))


def drop_incomplete(rows: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """Rows complete in the target and in every feature that is not null throughout. One pass counts all features."""
    present = [f for f in features if f in rows.columns]
    counts = rows.agg(*[F.count(f).alias(f) for f in present]).first() if present else {}
    return rows.dropna(subset=[target, *[f for f in present if counts[f] > 0]])


def conform(rows: DataFrame, order: Sequence[str], numbers: Sequence[str] = ()) -> DataFrame:
    """The columns of `order` that rows has, in that order; those of `numbers` are added as nulls where absent."""
    missing = [F.lit(None).cast("double").alias(c) for c in numbers if c not in rows.columns]
    full = rows.select("*", *missing)
    return full.select([c for c in order if c in full.columns])


def exclude_period(rows: DataFrame, start: str, end: str, date: str = "date", flag: str | None = None) -> DataFrame:
    """Rows outside the period, both ends of which belong to it; or all rows with a column that says so."""
    inside = F.col(date).between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    return rows.withColumn(flag, inside) if flag else rows.where(~inside)


def null_shares(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, n_null, pct) in one pass over all columns."""
    wide = rows.agg(F.count("*").alias("__n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return wide.unpivot("__n", list(columns), "column", "n_null").select("column", "n_null", percent(F.col("n_null"), F.col("__n")).alias("pct"))
