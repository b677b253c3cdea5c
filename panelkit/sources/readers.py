"""Sources: folders of signal chunks, exports with a preamble, headerless counts, dimensions, report layouts.

Every reader coerces text by itself (no schema inference), so that a bad cell is a null and not a failure.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from panelkit.functions.columns import lag_key, month_start, parse_count, parse_month, to_number

CHUNK_SCHEMA = "keyword string, market string, chunk string, date date, value double"
SERIES_SCHEMA = "keyword string, market string, date date, value double"


def read_or_empty(spark: SparkSession, schema: str | StructType, read) -> DataFrame:
    """read(), or an empty table of the schema if its path is not there."""
    try:
        return read()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def _path_part(from_end: int) -> Column:
    """A part of the file's path, counted from its end; the path in the metadata is percent-encoded."""
    return F.url_decode(F.element_at(F.split(F.regexp_replace("_metadata.file_path", r"\+", "%2B"), "/"), -from_end))


def coerce_signal(rows: DataFrame) -> DataFrame:
    """Text columns date and value to DATE and DOUBLE; rows in which either can't be read are dropped."""
    return rows.withColumn("date", F.try_to_date(F.trim("date"), "yyyy-MM-dd")).withColumn("value", to_number(F.col("value"))).dropna(subset=["date", "value"])


def read_signal_chunks(spark: SparkSession, root: str, folders: Mapping[str, str]) -> DataFrame:
    """All chunk files root/<folder>/<market>/<chunk>.csv of the mapped folders, in one read.

    The keyword comes from the folder, never from the header. Folders that are not mapped, and those whose
    names start with a dot, are not read.
    """
    names = F.create_map(*[F.lit(x) for pair in folders.items() for x in pair])

    def read() -> DataFrame:
        rows = spark.read.schema("date string, value string").option("header", True).csv([f"{root}/{f}/*/*.csv" for f in folders])
        return rows.select("date", "value", _path_part(3).alias("folder"), _path_part(2).alias("market"), F.regexp_replace(_path_part(1), r"\.csv$", "").alias("chunk"))

    rows = read_or_empty(spark, "date string, value string, folder string, market string, chunk string", read)
    return coerce_signal(rows.where(~F.col("market").startswith("."))).select(names[F.col("folder")].alias("keyword"), "market", "chunk", "date", "value")


def read_export_csv(spark: SparkSession, paths: str | Sequence[str], markers: Sequence[str] = ("Time", "Day")) -> DataFrame:
    """(market, date, value) of exports whose data start after the first line that begins with a marker.

    The market is the file's name. Files without such a line give no rows; unreadable rows, such as labels of
    metadata, are dropped.
    """

    def read() -> DataFrame:
        return spark.read.text(paths, wholetext=True).select("value", F.regexp_replace(_path_part(1), r"\.csv$", "").alias("market"))

    whole = read_or_empty(spark, "value string, market string", read)
    header = "^\"?(" + "|".join(markers) + ")\"?,"
    lines = whole.select("market", F.split("value", r"\r?\n").alias("lines"))
    lines = lines.withColumn("start", F.array_position(F.transform("lines", lambda x: x.rlike(header)), True)).where("start > 0")
    cells = lines.select("market", F.posexplode("lines").alias("pos", "line"), "start").where("pos >= start")
    parts = F.split(F.regexp_replace("line", '"', ""), ",")
    return coerce_signal(cells.select("market", F.get(parts, 0).alias("date"), F.get(parts, 1).alias("value")))


def read_prediction_signals(spark: SparkSession, root: str, folders: Mapping[str, str]) -> DataFrame:
    """(keyword, market, date, value) of the export files root/<folder>/<market>.csv."""
    parts = [read_export_csv(spark, f"{root}/{folder}/*.csv").select(F.lit(keyword).alias("keyword"), "market", "date", "value") for folder, keyword in folders.items()]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def clean_counts(rows: DataFrame) -> DataFrame:
    """(entity, date, trend_date, apps) of text columns entity, month and count; rows without a month are dropped."""
    date = parse_month(F.col("month"))
    return rows.select(F.trim("entity").alias("entity"), date.alias("date"), lag_key(date).alias("trend_date"), parse_count(F.col("count")).alias("apps")).dropna(subset=["date"])


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """Counts from a CSV without a header: entity, month, count."""
    schema = "entity string, month string, count string"
    return clean_counts(read_or_empty(spark, schema, lambda: spark.read.schema(schema).csv(path)))


def read_dimension(spark: SparkSession, path: str, columns: Mapping[str, str], numbers: Sequence[str] = ()) -> DataFrame:
    """A dimension with header: names are trimmed, `columns` renames and projects, `numbers` (new names) are parsed."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    rows = read_or_empty(spark, schema, lambda: spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).csv(path))
    rows = rows.toDF(*[c.strip() for c in rows.columns])
    return rows.select(*[(to_number(F.col(f"`{c}`")) if new in numbers else F.trim(F.col(f"`{c}`").cast("string"))).alias(new) for c, new in columns.items()])


def read_monthly_rate(spark: SparkSession, path: str, entity: str = "county", date: str = "date", value: str = "unemployment_rate") -> DataFrame:
    """(entity, date, rate) with dates at the first of the month."""
    rows = read_dimension(spark, path, {entity: "entity", date: "date", value: "rate"}, ["rate"])
    return rows.withColumn("date", month_start(F.try_to_date("date", "yyyy-MM-dd"))).dropna(subset=["entity", "date"])


@dataclass(frozen=True)
class Layout:
    """Where one layout of a report has its entity, date and value: column positions, and the pattern of its dates."""

    entity: int
    date: int
    value: int
    pattern: str = "MMM yyyy"


def union_layouts(tables: Sequence[tuple[DataFrame, Layout]], totals: Sequence[str] = ("Statewide",)) -> DataFrame:
    """(entity, date, apps) of tables with different layouts: totals and blank keys dropped, the first table wins per key.

    Of equal keys in one table the smallest count stays, so that the outcome does not hang on the order of rows.
    """
    out = None
    for k, (rows, at) in enumerate(tables):
        cells = [F.col(f"`{c}`").cast("string") for c in rows.columns]
        one = rows.select(F.trim(cells[at.entity]).alias("entity"), month_start(F.try_to_date(F.trim(cells[at.date]), at.pattern)).alias("date"), parse_count(cells[at.value]).alias("apps"), F.lit(k).alias("rank"))
        out = one if out is None else out.unionByName(one)
    from panelkit.operators.clean import dedupe_by

    return dedupe_by(drop_totals(out, "entity", totals).dropna(subset=["date"]), ["entity", "date"], ["rank", F.col("apps").asc_nulls_last()]).drop("rank")


def drop_totals(rows: DataFrame, entity: str, totals: Sequence[str] = ("Statewide",)) -> DataFrame:
    """rows whose key is neither null, nor blank, nor that of a total."""
    return rows.where(F.col(entity).isNotNull() & (F.length(F.trim(entity)) > 0) & ~F.trim(entity).isin(*totals))
