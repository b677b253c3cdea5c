"""Rendezvous hashing of record keys over weighted shards.

Each record scores every shard by -weight / ln(u), where u in (0, 1) is a hash of the record's key and the
shard; the highest score wins. A new shard can only take records into itself, as the scores of the
others stay as they were.

Slots number the rows of a shard without gaps. Equal rows are counted before they are shuffled, the
rows of a shard are split over `buckets` ranges of a hash, and only the counts of the buckets are
summed up over a shard, so that no task has more than one bucket of it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 1024
#: Slots that are listed at once where equal rows are dealt out again.
RUN = 4096


def _digest(*parts: Column) -> Column:
    """52 bits of the md5 of the parts, which are joined by '/', as a long; a null part counts as ''."""
    text = F.concat_ws("/", *[F.coalesce(x.cast("string"), F.lit("")) for x in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def _unit(*parts: Column) -> Column:
    """A number in (0, 1) from the digest of the parts."""
    return (_digest(*parts).cast("double") + 0.5) / float(2**52)


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """The shard of a key: 0 to len(weights) - 1. Shards of weight 0 get nothing; null keys all go to one shard."""
    if not any(w > 0 for w in weights):
        raise ValueError("no shard has a weight above 0")
    scores = [F.struct((-float(w) / F.log(_unit(key, F.lit(k)))).alias("score"), F.lit(k).alias("shard")) for k, w in enumerate(weights) if w > 0]
    return F.array_max(F.array(*scores))["shard"]


def assign_shards(docs: DataFrame, weights: Sequence[float], key_col: str = "doc_id", name: str = "shard") -> DataFrame:
    """docs with the column `name`; equal keys, nulls among them, get equal shards. An empty table stays empty."""
    return docs.withColumn(name, shard_of(F.col(key_col), weights))


def number_slots(rows: DataFrame, shard_col: str, order: Sequence[str], buckets: int = BUCKETS) -> DataFrame:
    """rows (narrow ones) with a long `slot`, gapless from 0 in each shard, ordered by a hash and then by `order`.

    Rows that agree in all columns are counted first and dealt out again at the end; they get
    consecutive slots. Nulls in any column are values like others.
    """
    columns = rows.columns
    counted = rows.groupBy(*columns).agg(F.count("*").alias("__n"))
    counted = counted.withColumn("__h", _digest(*[F.col(c) for c in order])).withColumn("__bucket", F.pmod("__h", F.lit(buckets)))
    counted = counted.repartition(shard_col, "__bucket")
    inside = Window.partitionBy(shard_col, "__bucket").orderBy("__h", *order)
    totals = counted.groupBy(shard_col, "__bucket").agg(F.sum("__n").alias("__rows"))
    before = Window.partitionBy(shard_col).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        F.col(shard_col).alias("__s"), F.col("__bucket").alias("__b"), F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__start")
    )
    numbered = counted.withColumn(
        "__inside", F.coalesce(F.sum("__n").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ).join(starts, (F.col(shard_col) == F.col("__s")) & (F.col("__bucket") == F.col("__b")))
    first = F.col("__start") + F.col("__inside")
    last = first + F.col("__n") - 1
    runs = numbered.select(*columns, last.alias("__last"), F.explode(F.sequence(first, last, F.lit(RUN).cast("long"))).alias("__first"))  # no list holds more than one number in RUN of a row's copies, or RUN
    return runs.select(*columns, F.explode(F.sequence("__first", F.least(F.col("__first") + RUN - 1, "__last"))).alias("slot"))


def shard_report(docs: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The law is `key`: doc_id and the number of shards decide, and an added shard takes rows only into
    itself. A null text has size 1 and the checksum of no bytes; rows without an id share a shard.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    rows = rows.select(
        "*",
        F.lit("key").alias("law"),
        shard_of(F.col("doc_id"), [1.0] * n_shards).alias("shard"),
        shard_of(F.col("doc_id"), [1.0] * (n_shards + 1)).alias("grown_shard"),
    )
    return number_slots(rows, "shard", ["doc_id", "text_crc32", "size"])
