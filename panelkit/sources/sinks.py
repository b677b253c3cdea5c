"""Sinks: tables, series by market, parameter documents and model bundles."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, fields

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkit.operators.boosting import Settings, Trees


def write_table(df: DataFrame, path: str, entity: str = "entity", date: str = "date", kind: str = "parquet") -> None:
    """Write a panel partitioned by year, sorted by entity and date inside each file: a write by year sorts anew unless the year leads the order."""
    rows = df.withColumn("year", F.year(date)).repartition("year", F.pmod(F.xxhash64(entity), F.lit(16)))
    rows.sortWithinPartitions("year", entity, date).write.mode("overwrite").partitionBy("year").option("header", kind == "csv").format(kind).save(path)


def write_bucketed(df: DataFrame, table: str, path: str, entity: str = "entity", date: str = "date", buckets: int = 16, years: bool = False) -> None:
    """A panel that is read again and again, as a table bucketed by entity: joins by entity alone with tables of as many buckets, aggregations and
    windows need no exchange. With `years` it is also partitioned by year, so that replace_years() can exchange some of them."""
    rows = (df.withColumn("year", F.year(date)) if years else df).repartition(buckets, entity)
    writer = rows.write.mode("overwrite").format("parquet").bucketBy(buckets, entity).sortBy(entity, date).option("path", path)
    (writer.partitionBy("year") if years else writer).saveAsTable(table)


def replace_years(df: DataFrame, table: str, entity: str = "entity", date: str = "date") -> None:
    """Write the years of df over those of a table of write_bucketed(); its other years stay as they are."""
    spark, mode = df.sparkSession, "spark.sql.sources.partitionOverwriteMode"  # inserting into a table heeds the setting alone, no option
    rows, before = df.withColumn("year", F.year(date)).select(*spark.table(table).columns).repartition(entity), spark.conf.get(mode)
    spark.conf.set(mode, "dynamic")
    try:
        rows.write.insertInto(table, overwrite=True)
    finally:
        spark.conf.set(mode, before)


def write_series(df: DataFrame, path: str, market: str = "market") -> None:
    """Write date and value of each market to a folder of its own, in order of date, without header."""
    df.select(market, "date", "value").repartition(market).sortWithinPartitions(market, "date").write.mode("overwrite").partitionBy(market).csv(path, header=False)


def params_document(params: DataFrame, value: str = "train_avg") -> DataFrame:
    """(keyword, params MAP<market, value>): the nested form of a parameter table; infinite values become null."""
    finite = F.when(~F.col(value).isin(float("inf"), float("-inf")), F.col(value))
    entries = F.array_sort(F.collect_list(F.struct(F.col("market"), finite.alias("v"))))
    return params.groupBy("keyword").agg(F.map_from_entries(entries).alias("params"))


def write_params_json(params: DataFrame, path: str, value: str = "train_avg") -> None:
    params_document(params, value).write.mode("overwrite").json(path)


def read_params_json(spark: SparkSession, path: str, value: str = "train_avg") -> DataFrame:
    rows = spark.read.schema("keyword string, params map<string,double>").json(path)
    return rows.select("keyword", F.explode("params").alias("market", value))


def save_model_bundle(model: PipelineModel, path: str, features: Sequence[str], ranges: DataFrame, mae: float, params: dict) -> None:
    """The model, and beside it the order of its features, their ranges, its error and its parameters."""
    model.write().overwrite().save(f"{path}/model")
    spark = ranges.sparkSession
    meta = spark.createDataFrame([(list(features), float(mae), {k: str(v) for k, v in params.items()})], "features array<string>, mae double, params map<string,string>")
    meta.write.mode("overwrite").json(f"{path}/meta")
    ranges.write.mode("overwrite").parquet(f"{path}/ranges")


def load_model_bundle(spark: SparkSession, path: str) -> tuple[PipelineModel, dict, DataFrame]:
    meta = spark.read.schema("features array<string>, mae double, params map<string,string>").json(f"{path}/meta").first().asDict()
    return PipelineModel.load(f"{path}/model"), meta, spark.read.parquet(f"{path}/ranges")


def save_tree_bundle(model: Trees, path: str, ranges: DataFrame, mae: float) -> None:
    """Boosted trees as a table of nodes, and beside it the order of their features, their ranges, their error and their settings."""
    spark = ranges.sparkSession
    model.table(spark).write.mode("overwrite").parquet(f"{path}/trees")
    meta = spark.createDataFrame([(model.features, float(mae), float(model.base), {k: str(v) for k, v in asdict(model.settings).items()})], "features array<string>, mae double, base double, settings map<string,string>")
    meta.write.mode("overwrite").json(f"{path}/meta")
    ranges.write.mode("overwrite").parquet(f"{path}/ranges")


def load_tree_bundle(spark: SparkSession, path: str) -> tuple[Trees, dict, DataFrame]:
    meta = spark.read.schema("features array<string>, mae double, base double, settings map<string,string>").json(f"{path}/meta").first().asDict()
    settings = Settings(**{f.name: type(f.default)(meta["settings"][f.name]) for f in fields(Settings)})
    return Trees.from_table(spark.read.parquet(f"{path}/trees"), meta["features"], settings, meta["base"]), meta, spark.read.parquet(f"{path}/ranges")
