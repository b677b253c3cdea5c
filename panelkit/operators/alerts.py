"""Alerts: per-entity thresholds on deviations, their sweep and choice, labels and the fields that are shown."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelkit.functions.columns import alert_label, at_least, deviation, percent, strip_suffix
from panelkit.operators import ranks

PERCENTILES = tuple(range(50, 96, 5))
LABELS = ("Green", "Yellow", "Red")
NEVER = float("inf")


def add_deviation(rows: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    return rows.withColumn("deviation", deviation(F.col(actual), F.col(predicted)))


def entity_thresholds(rows: DataFrame, percentiles: Sequence[int] = PERCENTILES, least: int = 5, approximate: bool = False) -> DataFrame:
    """(entity, percentile, threshold): percentiles of an entity's positive deviations, all in one pass; infinite with fewer than `least`."""
    positive = F.when(F.col("deviation") > 0, F.col("deviation"))
    shares = [p / 100 for p in percentiles]
    if approximate:
        per_entity = rows.groupBy("entity").agg(F.count(positive).alias("n"), F.percentile_approx(positive, shares).alias("found"))
    else:
        found = ranks.percentiles(rows.select("entity", positive.alias("deviation")), "deviation", shares, by=["entity"])
        per_entity = rows.groupBy("entity").agg(F.count(positive).alias("n")).join(found, "entity", "left")
    wide = per_entity.select("entity", "n", "found", F.posexplode(F.array(*[F.lit(p) for p in percentiles])).alias("at", "percentile"))
    return wide.select("entity", "percentile", F.when(F.col("n") >= least, F.get("found", F.col("at"))).otherwise(NEVER).alias("threshold"))


def true_events(rows: DataFrame, percentile: float = 85, approximate: bool = False) -> DataFrame:
    """rows with true_event: a deviation above the percentile of all positive ones."""
    positive = rows.where("deviation > 0").select("deviation")
    if approximate:
        cut = positive.agg(F.percentile_approx("deviation", percentile / 100).alias("__cut"))
    else:
        cut = ranks.percentiles(positive, "deviation", [percentile / 100], "__cut").select(F.get("__cut", F.lit(0)).alias("__cut"))
    return rows.crossJoin(F.broadcast(cut)).withColumn("true_event", F.coalesce(F.col("deviation") > F.col("__cut"), F.lit(False))).drop("__cut")


def confusion(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., tp, fp, fn, tn, precision, recall, specificity, fpr, f1, youden_j), 3 digits; null on zero denominators."""
    t, p = F.col("true_event"), F.col("alert")
    counts = rows.groupBy(*by).agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn"))
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    precision, recall, specificity = F.try_divide(tp, tp + fp), F.try_divide(tp, tp + fn), F.try_divide(tn, tn + fp)
    shares = {
        "precision": precision, "recall": recall, "specificity": specificity, "fpr": F.try_divide(fp, fp + tn),
        "f1": F.try_divide(2 * precision * recall, precision + recall), "youden_j": recall + specificity - 1,
    }
    return counts.select("*", *[F.bround(x, 3).alias(name) for name, x in shares.items()])


def threshold_sweep(train: DataFrame, test: DataFrame, percentiles: Sequence[int] = PERCENTILES, event_percentile: float = 85) -> DataFrame:
    """confusion() for each percentile, with the prevalence of true events.

    Every test row meets its entity's thresholds as one array, so that the rows are not multiplied by a join.
    """
    arrays = entity_thresholds(train, percentiles).groupBy("entity").agg(F.array_sort(F.collect_list(F.struct("percentile", "threshold"))).alias("at"))
    none = F.array(*[F.struct(F.lit(p).alias("percentile"), F.lit(NEVER).alias("threshold")) for p in percentiles])
    rows = true_events(test, event_percentile).join(arrays, "entity", "left").select("deviation", "true_event", F.inline(F.coalesce("at", none)))
    rows = rows.withColumn("alert", F.coalesce(F.col("deviation") > F.col("threshold"), F.lit(False)))
    share = F.bround(F.try_divide((F.col("tp") + F.col("fn")).cast("double"), (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).cast("double")), 6)
    return confusion(rows, ["percentile"]).withColumn("prevalence", share)


def pick_thresholds(sweep: DataFrame) -> DataFrame:
    """One row: the percentiles with the best rounded f1 (red) and J; the lowest wins among equals; yellow is ten below red."""
    best = lambda c: F.max_by("percentile", F.when(F.col(c).isNotNull(), F.struct(F.col(c), -F.col("percentile"))))
    return sweep.agg(best("f1").alias("red"), best("youden_j").alias("best_j")).select("red", (F.col("red") - 10).alias("yellow"), "best_j")


def label_alerts(rows: DataFrame, red: DataFrame, yellow: DataFrame) -> DataFrame:
    """rows with `label` by thresholds (entity, threshold); an entity without any is never above."""
    named = rows.join(red.select("entity", F.col("threshold").alias("red")), "entity", "left").join(yellow.select("entity", F.col("threshold").alias("yellow")), "entity", "left")
    return named.withColumn("label", alert_label(F.col("deviation"), F.col("red"), F.col("yellow"))).drop("red", "yellow")


def label_distribution(rows: DataFrame, labels: Sequence[str] = LABELS) -> DataFrame:
    """(label, n, pct) for each of the given labels, zero where none; pct is of all rows with one of them."""
    listed = rows.sparkSession.createDataFrame([(x,) for x in labels], "label string")
    counted = listed.join(rows.groupBy("label").count(), "label", "left").select("label", F.coalesce("count", F.lit(0)).alias("n"))
    return counted.withColumn("pct", percent(F.col("n"), F.sum("n").over(Window.partitionBy(F.lit(0))), 2))


def lookup_labels(wanted: DataFrame, labels: DataFrame) -> DataFrame:
    """wanted(entity, date) with the label of that month, Gray where there is none."""
    return wanted.join(labels.select("entity", "date", "label"), ["entity", "date"], "left").withColumn("label", F.coalesce("label", F.lit("Gray")))


def recent_baseline(history: DataFrame, n: int = 12, value: str = "rate") -> DataFrame:
    """(entity, baseline): the mean of the last n valid values."""
    from panelkit.operators.audit import latest_n

    return latest_n(history.where(F.col(value).isNotNull()), n).groupBy("entity").agg(F.avg(value).alias("baseline"))


def label_forecast(forecast: DataFrame, baseline: DataFrame, red: DataFrame, yellow: DataFrame) -> DataFrame:
    """forecast(entity, predicted) with deviation from the baseline and label; Gray where the baseline is missing or not above 0."""
    base = F.when(F.col("baseline") > 0, F.col("baseline"))
    rows = forecast.join(baseline, "entity", "left").withColumn("deviation", (F.col("predicted") - base) / base)
    return label_alerts(rows, red, yellow)


def with_interval(rows: DataFrame, mae: float, predicted: str = "predicted", population: str = "population", applications: str = "predicted_apps") -> DataFrame:
    """Predicted rate (not below 0) as a count, with bounds one mean error away; counts are rounded half to even."""
    r, pop = at_least(F.col(predicted), 0.0), F.col(population).cast("double")
    return rows.withColumns({
        predicted: r, applications: F.bround(r * pop).cast("long"), "lower_bound": F.bround(at_least(r - mae, 0.0) * pop).cast("long"), "upper_bound": F.bround((r + mae) * pop).cast("long"),
    })


def attach_forecast(history: DataFrame, forecast: DataFrame, count: str = "predicted_applications") -> DataFrame:
    """history with the forecast of the entity's next month: next_month, next_count and shown_next ('No data' without one).

    forecast has one row for each entity, with its date; entities are matched by their cleaned names.
    """
    key = strip_suffix(F.col("entity"))
    ahead = forecast.select(key.alias("__key"), F.col("date").alias("next_month"), F.col(count).alias("next_count"))
    joined = history.withColumn("__key", key).join(ahead, "__key", "left").drop("__key")
    return joined.withColumn("shown_next", F.coalesce(F.format_number("next_count", 0), F.lit("No data")))


def display_columns(rows: DataFrame, dimension: DataFrame, names: Mapping[str, str], count: str = "apps") -> DataFrame:
    """rows with what is shown: the count with thousands commas or 'No data', the label's name, and a hover text.

    dimension(entity, population) is joined on the cleaned entity.
    """
    key = strip_suffix(F.col("entity"))
    joined = rows.withColumn("__key", key).join(dimension.select(strip_suffix(F.col("entity")).alias("__key"), "population"), "__key", "left").drop("__key")
    shown = F.coalesce(F.format_number(F.col(count), 0), F.lit("No data"))
    name = F.coalesce(F.create_map(*[F.lit(x) for p in names.items() for x in p])[F.col("label")], F.col("label"))
    return joined.withColumns({
        "shown_count": shown, "shown_label": name,
        "hover": F.concat_ws(" | ", F.col("entity"), F.date_format("date", "MMM yyyy"), F.concat(F.lit("count: "), shown), F.concat(F.lit("population: "), F.coalesce(F.format_number("population", 0), F.lit("No data"))), name),
    })
