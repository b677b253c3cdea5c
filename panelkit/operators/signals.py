"""Signals: stitching overlapping chunks, monthly means, scaling, filling and planning.

All keywords and markets are rows of one long table; nothing loops over them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelkit.functions.columns import at_least, month_start
from panelkit.operators.clean import dedupe_by

SERIES = ["keyword", "market"]
MIN_OVERLAP = 4


def order_chunks(chunks: DataFrame) -> DataFrame:
    """(keyword, market, chunk, seq): chunks of a series by their first date, then by name."""
    firsts = chunks.groupBy(*SERIES, "chunk").agg(F.min("date").alias("first_date"))
    return firsts.withColumn("seq", F.row_number().over(Window.partitionBy(*SERIES).orderBy("first_date", "chunk"))).drop("first_date")


def overlap_ratios(sequenced: DataFrame, min_overlap: int = MIN_OVERLAP) -> DataFrame:
    """(keyword, market, seq, n_shared, ratio): new mean / old mean on the dates that a chunk shares with the next one.

    The ratio is 1 with fewer shared dates than min_overlap, and where the old mean is not above 0.
    """
    new = sequenced.select(*SERIES, (F.col("seq") - 1).alias("seq"), "date", F.col("value").alias("new_value"))
    both = sequenced.join(new, [*SERIES, "seq", "date"])
    means = both.groupBy(*SERIES, "seq").agg(F.count("*").alias("n_shared"), F.avg("value").alias("old"), F.avg("new_value").alias("new"))
    ratio = F.when((F.col("n_shared") < min_overlap) | (F.col("old") <= 0), 1.0).otherwise(F.try_divide("new", "old"))
    return means.select(*SERIES, "seq", "n_shared", ratio.alias("ratio"))


def chunk_scales(order: DataFrame, ratios: DataFrame) -> DataFrame:
    """(keyword, market, seq, scale): the product of the ratios from a chunk up to the newest, whose scale is 1."""
    newest_first = Window.partitionBy(*SERIES).orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, 0)
    joined = order.select(*SERIES, "seq").join(ratios.select(*SERIES, "seq", "ratio"), [*SERIES, "seq"], "left")
    return joined.select(*SERIES, "seq", F.product(F.coalesce("ratio", F.lit(1.0))).over(newest_first).alias("scale"))


def stitch_signals(chunks: DataFrame, min_overlap: int = MIN_OVERLAP) -> DataFrame:
    """(keyword, market, date, value): one series per keyword and market, its highest value 100 (2 digits).

    chunks: keyword, market, chunk, date, value. Older chunks are rescaled onto the newest by their
    overlaps; on shared dates the newest chunk wins.
    """
    order = order_chunks(chunks)
    sequenced = chunks.join(order, [*SERIES, "chunk"])
    scaled = sequenced.join(chunk_scales(order, overlap_ratios(sequenced, min_overlap)), [*SERIES, "seq"])
    newest = scaled.groupBy(*SERIES, "date").agg(F.max_by(F.col("value") * F.col("scale"), "seq").alias("value"))
    top = F.max("value").over(Window.partitionBy(*SERIES))
    return newest.withColumn("value", F.when(top > 0, F.bround(F.col("value") / top * 100, 2)).otherwise(F.col("value")))


def monthly_mean(series: DataFrame) -> DataFrame:
    """(keyword, market, month, avg_value)."""
    return series.groupBy(*SERIES, month_start(F.col("date")).alias("month")).agg(F.avg("value").alias("avg_value"))


def scaling_params(monthly: DataFrame) -> DataFrame:
    """(keyword, market, train_avg): the mean of the monthly means, 4 digits."""
    return monthly.groupBy(*SERIES).agg(F.bround(F.avg("avg_value"), 4).alias("train_avg"))


def scale_prediction(monthly: DataFrame, params: DataFrame) -> DataFrame:
    """Monthly values of a new window brought to the frame of the training average: (keyword, market, month, scaled).

    Where the window's mean is 0 all its months are the training average; without parameters, null.
    """
    mean = F.avg("avg_value").over(Window.partitionBy(*SERIES))
    scaled = F.when(mean == 0, F.col("train_avg")).otherwise(F.col("avg_value") * F.col("train_avg") / mean)
    return monthly.join(params, SERIES, "left").select(*SERIES, "month", at_least(scaled, 0.0).alias("scaled"))


def scale_latest(monthly: DataFrame, params: DataFrame) -> DataFrame:
    """(keyword, market, scaled) of the latest month of each window."""
    return scale_prediction(monthly, params).groupBy(*SERIES).agg(F.max_by("scaled", "month").alias("scaled"))


def fill_missing_series(series: DataFrame, expected: DataFrame, params: DataFrame, default: float = 50.0) -> DataFrame:
    """series with rows for the expected (keyword, market) pairs that have none.

    They get every date that the keyword has anywhere, with the market's training average, else the mean of the
    keyword's averages, else `default`. Rows that are there stay as they are, zeros too.
    """
    dates = series.select("keyword", "date").distinct()
    empty = expected.select(*SERIES).distinct().join(series.select(*SERIES).distinct(), SERIES, "left_anti")
    means = params.groupBy("keyword").agg(F.avg("train_avg").alias("overall"))
    filled = empty.join(dates, "keyword").join(params, SERIES, "left").join(means, "keyword", "left")
    return series.select(*SERIES, "date", "value").unionByName(filled.select(*SERIES, "date", F.coalesce("train_avg", "overall", F.lit(default)).alias("value")))


def missing_chunks(keywords: DataFrame, markets: DataFrame, windows: DataFrame, present: DataFrame) -> DataFrame:
    """The (keyword, market, chunk) cells of the full plan for which no rows are present. The plan is the product of three short lists."""
    plan = keywords.select("keyword").distinct().crossJoin(markets.select("market").distinct()).crossJoin(windows.select("chunk").distinct())
    return plan.join(present.select("keyword", "market", "chunk").distinct(), ["keyword", "market", "chunk"], "left_anti")


def target_month(series: DataFrame, market: str, keywords: Sequence[str], otherwise: str | None = None) -> DataFrame:
    """One row: the month after the latest of the sample market, by the first of the keywords that has any; else `otherwise` or this month."""
    rank = F.array_position(F.array(*[F.lit(k) for k in keywords]), F.col("keyword"))
    latest = series.where((F.col("market") == market) & F.col("keyword").isin(*keywords)).groupBy(rank.alias("rank")).agg(F.max("date").alias("latest"))
    found = latest.agg(F.min_by("latest", "rank").alias("latest"))
    other = month_start(F.lit(otherwise)) if otherwise else month_start(F.current_date())
    return found.select(F.coalesce(F.add_months(month_start(F.col("latest")), 1), other).alias("target_month"))


def combine_history(history: DataFrame, predicted: DataFrame, last: str) -> DataFrame:
    """History and scaled window as one monthly series up to `last`; the window wins on months that both have."""
    both = history.select(*SERIES, "month", "value", F.lit(1).alias("rank")).unionByName(predicted.select(*SERIES, "month", "value", F.lit(0).alias("rank")))
    return dedupe_by(both.where(F.col("month") <= F.lit(last).cast("date")), [*SERIES, "month"], ["rank"]).drop("rank")


def pivot_signals(monthly: DataFrame, keywords: Sequence[str], value: str = "avg_value") -> DataFrame:
    """(market, month, signal_<keyword> ...): one wide row for each market and month."""
    picks = [F.max(F.when(F.col("keyword") == k, F.col(value))).alias(f"signal_{k}") for k in keywords]
    return monthly.groupBy("market", "month").agg(*picks)
