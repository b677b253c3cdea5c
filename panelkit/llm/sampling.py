"""Bounded samples of documents for fitting, chosen by a hash of the id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelkit.llm.text import held_out


def labelled_ids(labels: DataFrame, label: str, fold: tuple[int, int], bound: int, where: Column | None = None) -> DataFrame:
    """(doc_id, label) of at most `bound` labelled documents outside the held-out fold; of repeated rows the highest label counts.

    fold is (folds, held-out remainder). Rows whose id or label is null are left out. At most `bound` rows, so
    that the result may be broadcast.
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).dropna()
    rows = rows.where(~held_out(F.col("doc_id"), *fold)).groupBy("doc_id").agg(F.max("label").alias("label"))
    rows = rows.where(where) if where is not None else rows
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)


def unlabelled_ids(docs: DataFrame, fold: tuple[int, int], bound: int) -> DataFrame:
    """(doc_id) of at most `bound` documents outside the held-out fold, whatever their labels."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id")).dropna().where(~held_out(F.col("doc_id"), *fold)).distinct()
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
