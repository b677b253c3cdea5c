"""Audit: checks of a panel and its sources, all of which become rows of one issue table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelkit.functions.columns import percent, to_number
from panelkit.operators.clean import null_shares
from panelkit.operators.ranks import percentiles

ISSUE = ("severity", "category", "check", "entity", "detail", "value")


def latest_n(rows: DataFrame, n: int, keys: Sequence[str] = ("entity",), date: str = "date") -> DataFrame:
    """The last n rows of each key; of equal dates those with the lowest values in the other columns, from left to right."""
    others = [F.asc(f.name) for f in rows.schema.fields if f.name not in (*keys, date) and f.dataType.typeName() not in ("map", "variant")]
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(date), *others))).where(F.col("__n") <= n).drop("__n")


def top_k(rows: DataFrame, k: int, by: str, tie: str) -> DataFrame:
    """The k rows with the highest value; of equal ones those with the lowest key."""
    return rows.orderBy(F.desc(by), F.asc(tie)).limit(k)


def audit_missing(rows: DataFrame, columns: Sequence[str], error_pct: float = 20.0) -> DataFrame:
    """(column, n_null, pct, severity): ERROR above error_pct, WARNING above 0, else OK."""
    severity = F.when(F.col("pct") > error_pct, "ERROR").when(F.col("n_null") > 0, "WARNING").otherwise("OK")
    return null_shares(rows, columns).withColumn("severity", severity)


def audit_incomplete(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(entity, n_rows, n_null, pct): null cells of each entity that has any; pct is of its cells."""
    nulls = sum((F.count_if(F.col(c).isNull()) for c in columns[1:]), F.count_if(F.col(columns[0]).isNull()))
    found = rows.groupBy("entity").agg(F.count("*").alias("n_rows"), nulls.alias("n_null")).where("n_null > 0")
    return found.withColumn("pct", percent(F.col("n_null"), F.col("n_rows") * len(columns)))


def duplicate_rows(rows: DataFrame) -> DataFrame:
    """(n_copies, all columns) of rows that occur more than once, each once."""
    return rows.groupBy(*rows.columns).agg(F.count("*").alias("n_copies")).where("n_copies > 1")


def duplicate_keys(rows: DataFrame, keys: Sequence[str] = ("entity", "date")) -> DataFrame:
    """All rows whose key occurs more than once, with n_rows."""
    return rows.withColumn("n_rows", F.count("*").over(Window.partitionBy(*keys))).where("n_rows > 1")


def audit_coverage(rows: DataFrame, date: str = "date") -> DataFrame:
    """(entity, first_date, last_date, n_months, expected, missing, pct); expected months are those of the whole table's range."""
    bounds = rows.agg((F.months_between(F.max(date), F.min(date)).cast("int") + 1).alias("expected"))
    per = rows.groupBy("entity").agg(F.min(date).alias("first_date"), F.max(date).alias("last_date"), F.count_distinct(date).alias("n_months"))
    joined = per.crossJoin(F.broadcast(bounds))
    return joined.withColumn("missing", F.col("expected") - F.col("n_months")).withColumn("pct", percent(F.col("n_months"), F.col("expected")))


def audit_gaps(rows: DataFrame, date: str = "date", within: Sequence[str] = ("entity",), halo: str | None = None) -> DataFrame:
    """(entity, date, previous, days) where the step from an entity's previous row is not of 28 to 32 days; rows of which `halo` is true are only previous ones."""
    previous = F.lag(date).over(Window.partitionBy(*within).orderBy(date))
    stepped = rows.withColumn("previous", previous).withColumn("days", F.datediff(date, "previous"))
    stepped = stepped.where(~F.col("days").between(28, 32))
    return (stepped.where(~F.col(halo)) if halo else stepped).select("entity", date, "previous", "days")


def audit_mapping(rows: DataFrame, mapping: DataFrame) -> DataFrame:
    """(kind, entity): entities without a mapping, mapped ones without rows, and those whose market is another one (or not mapped)."""
    have, mapped = rows.select("entity").distinct(), mapping.select("entity").distinct()
    conflict = rows.select("entity", "market").distinct().join(mapping.select("entity", F.col("market").alias("mapped")), "entity", "left").where(~F.col("market").eqNullSafe(F.col("mapped")))
    return (
        have.join(mapped, "entity", "left_anti").select(F.lit("unmapped").alias("kind"), "entity")
        .unionByName(mapped.join(have, "entity", "left_anti").select(F.lit("unused").alias("kind"), "entity"))
        .unionByName(conflict.select(F.lit("conflict").alias("kind"), "entity").distinct())
    )


def audit_outliers_iqr(rows: DataFrame, value: str, factor: float = 3.0, least: int = 4) -> DataFrame:
    """(entity, date, value, median, ratio) of values beyond factor x the quartile range of their entity, if it has `least` values."""
    x = F.col(value)
    quartiles = percentiles(rows, value, [0.25, 0.5, 0.75], "__q", ["entity"]).join(rows.groupBy("entity").agg(F.count(x).alias("__n")), "entity")
    marked = rows.join(quartiles, "entity")
    spread = factor * (F.col("__q")[2] - F.col("__q")[0])
    beyond = (x < F.col("__q")[0] - spread) | (x > F.col("__q")[2] + spread)
    median = F.col("__q")[1]
    return marked.where((F.col("__n") >= least) & beyond).select("entity", "date", x.alias("value"), F.bround(median, 1).alias("median"), F.bround(F.try_divide(x, median), 2).alias("ratio"))


def audit_outliers_z(rows: DataFrame, value: str, limit: float = 4.0) -> DataFrame:
    """(entity, date, value, z) of values more than `limit` sample deviations from the mean of all."""
    moments = rows.agg(F.avg(value).alias("__m"), F.stddev_samp(value).alias("__s"))
    z = F.try_divide(F.col(value) - F.col("__m"), F.col("__s"))
    return rows.crossJoin(F.broadcast(moments)).withColumn("z", z).where(F.abs("z") > limit).select("entity", "date", F.col(value).alias("value"), "z")


def audit_values(rows: DataFrame, value: str, constant: str) -> DataFrame:
    """(kind, entity, n): zero and negative values, entities with more than one `constant`, and constants not above 0."""
    count = lambda kind, cond: rows.where(cond).groupBy("entity").agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "entity", "n")
    several = rows.groupBy("entity").agg(F.count_distinct(constant).alias("n")).where("n > 1").select(F.lit("several_constants").alias("kind"), "entity", "n")
    return count("zero", F.col(value) == 0).unionByName(count("negative", F.col(value) < 0)).unionByName(several).unionByName(count("no_constant", F.col(constant) <= 0))


def audit_suppressed(raw: DataFrame, count: str = "count", mark: str = "*") -> DataFrame:
    """(entity, n_suppressed, n_rows, pct, overall_pct) of entities with suppressed values."""
    hit = F.trim(count) == mark
    per = raw.groupBy("entity").agg(F.count_if(hit).alias("n_suppressed"), F.count("*").alias("n_rows"))
    overall = per.agg(percent(F.sum("n_suppressed"), F.sum("n_rows")).alias("overall_pct"))
    return per.where("n_suppressed > 0").withColumn("pct", percent(F.col("n_suppressed"), F.col("n_rows"))).crossJoin(F.broadcast(overall))


def audit_unparseable(raw: DataFrame, column: str) -> DataFrame:
    """(entity, text) of rows whose text is there but is no number."""
    text = F.trim(column)
    return raw.where((F.length(text) > 0) & to_number(F.col(column)).isNull()).select("entity", text.alias("text"))


def entities_per_market(mapping: DataFrame) -> DataFrame:
    return mapping.groupBy("market").agg(F.count_distinct("entity").alias("n_entities"))


def issues(found: DataFrame, severity: str | Column, category: str, check: str, entity: str | Column, detail: Column, value: str | Column) -> DataFrame:
    """The rows of a check in the shape of the issue table."""
    as_col = lambda x: F.col(x) if isinstance(x, str) else x
    level = F.lit(severity) if isinstance(severity, str) else severity
    return found.select(
        level.alias("severity"), F.lit(category).alias("category"), F.lit(check).alias("check"), as_col(entity).cast("string").alias("entity"), detail.cast("string").alias("detail"), as_col(value).cast("double").alias("value")
    )


def audit_all(
    panel: DataFrame, mapping: DataFrame, value: str = "apps", rate: str = "rate", constant: str = "population", raw: DataFrame | None = None, dimension: DataFrame | None = None, number: str = "income"
) -> DataFrame:
    """All findings about a panel as one issue table; raw(entity, count) adds suppressed counts, dimension(entity, <number> as text) those that can't be read."""
    missing = audit_missing(panel, [value, rate, constant]).where("n_null > 0")
    parts = [
        issues(missing, F.col("severity"), "missing", "null_share", "column", F.concat(F.col("pct"), F.lit(" % null")), "n_null"),
        issues(audit_coverage(panel).where("missing > 0"), "WARNING", "coverage", "missing_months", "entity", F.concat(F.col("missing"), F.lit(" months missing")), "missing"),
        issues(audit_gaps(panel), "WARNING", "coverage", "date_gap", "entity", F.concat(F.col("days"), F.lit(" days before "), F.date_format("date", "yyyy-MM-dd")), "days"),
        issues(duplicate_keys(panel), "ERROR", "duplicates", "entity_date", "entity", F.date_format("date", "yyyy-MM-dd"), "n_rows"),
        issues(audit_mapping(panel, mapping), "ERROR", "mapping", "market", "entity", F.col("kind"), F.lit(None)),
        issues(audit_outliers_iqr(panel, value), "WARNING", "outliers", "applications_iqr", "entity", F.date_format("date", "yyyy-MM-dd"), "value"),
        issues(audit_outliers_z(panel, rate), "WARNING", "outliers", "rate_zscore", "entity", F.date_format("date", "yyyy-MM-dd"), F.bround("value", 6)),
        issues(audit_values(panel, value, constant), "ERROR", "values", "invalid", "entity", F.col("kind"), "n"),
    ]
    copies = duplicate_rows(panel.select("entity", "date", value, rate, constant))
    parts += [
        issues(copies, "ERROR", "duplicates", "equal_rows", "entity", F.date_format("date", "yyyy-MM-dd"), "n_copies"),
        issues(audit_incomplete(panel, [value, rate]), "WARNING", "missing", "incomplete_entity", "entity", F.concat(F.col("pct"), F.lit(" % of cells null")), "n_null"),
    ]
    if raw is not None:
        found = audit_suppressed(raw)
        parts.append(issues(found, "WARNING", "raw_sources", "suppressed", "entity", F.concat(F.col("n_suppressed"), F.lit(" suppressed of "), F.col("n_rows")), "n_suppressed"))
    if dimension is not None:
        parts.append(issues(audit_unparseable(dimension, number), "WARNING", "raw_sources", "unparseable", "entity", F.col("text"), F.lit(None)))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def audit_summary(found: DataFrame) -> DataFrame:
    """(severity, category, n)."""
    return found.groupBy("severity", "category").agg(F.count("*").alias("n"))
