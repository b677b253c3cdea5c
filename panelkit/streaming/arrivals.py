"""Stitched signals that are kept up to date while chunk files arrive, in any order and in any number of lots.

A stream over the arrivals runs until all is read (availableNow). Each lot is added to the store of chunks, and the series that it has
chunks of are stitched anew from the store: a chunk changes the scales of all chunks before it and with them the highest value of
its series, so a series is the least that can be redone. Others are not read or written. A lot that is repeated after a failure
writes the same files again, so that nothing counts twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelkit.operators import signals
from panelkit.sources.readers import CHUNK_SCHEMA, SERIES_SCHEMA

SCALES_SCHEMA = "keyword string, market string, chunk string, seq int, scale double"


def stream_chunks(spark: SparkSession, path: str, files_at_once: int | None = None) -> DataFrame:
    """A stream of the chunk files (Parquet: keyword, market, chunk, date, value) that arrive in a folder."""
    reader = spark.readStream.schema(CHUNK_SCHEMA)
    return (reader.option("maxFilesPerTrigger", files_at_once) if files_at_once else reader).parquet(path)


class StitchedSeries:
    """The state under `root`: chunks/lot=<n> as they came, series and scales by keyword and market, and the stream's progress."""

    def __init__(self, spark: SparkSession, root: str, min_overlap: int = signals.MIN_OVERLAP) -> None:
        self.spark, self.root, self.min_overlap = spark, root, min_overlap

    def update(self, chunks: DataFrame) -> None:
        """Take in all that the stream of chunks has by now; rows without a date or a value are dropped."""
        query = chunks.writeStream.foreachBatch(self._add).option("checkpointLocation", f"{self.root}/progress").trigger(availableNow=True).start()
        query.awaitTermination()

    def _add(self, lot: DataFrame, number: int) -> None:
        lot.dropna(subset=["date", "value"]).write.mode("overwrite").parquet(f"{self.root}/chunks/lot={number}")
        spark = lot.sparkSession
        touched = spark.read.schema(CHUNK_SCHEMA).parquet(f"{self.root}/chunks/lot={number}").select(*signals.SERIES).distinct()
        known = self.chunks(spark).join(touched, signals.SERIES, "left_semi")
        order = signals.order_chunks(known)
        ratios = signals.overlap_ratios(known.join(order, [*signals.SERIES, "chunk"]), self.min_overlap)
        scales = signals.chunk_scales(order, ratios).join(order, [*signals.SERIES, "seq"])
        for rows, name in ((signals.stitch_signals(known, self.min_overlap), "series"), (scales.select(*signals.SERIES, "chunk", "seq", "scale"), "scales")):
            rows.repartition(*signals.SERIES).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*signals.SERIES).parquet(f"{self.root}/{name}")

    def chunks(self, spark: SparkSession | None = None) -> DataFrame:
        """All chunks; of one that came again, what came last."""
        rows = (spark or self.spark).read.schema(f"{CHUNK_SCHEMA}, lot long").parquet(f"{self.root}/chunks")
        last = F.max("lot").over(Window.partitionBy(*signals.SERIES, "chunk"))
        return rows.withColumn("last", last).where("lot = last").drop("lot", "last")

    def series(self) -> DataFrame:
        return self.spark.read.schema(SERIES_SCHEMA).parquet(f"{self.root}/series")

    def scales(self) -> DataFrame:
        """(keyword, market, chunk, seq, scale) of every chunk now."""
        return self.spark.read.schema(SCALES_SCHEMA).parquet(f"{self.root}/scales")
