"""Line deduplication by range-partitioned hashes, with keep bitmaps as the result.

Every line is reduced to a 128-bit hash of its key (blanks stripped, A-Z lower-cased). The hashes are
range-partitioned and sorted by document and position, so that the first occurrence of a key is the
first row of its run; a row whose document is not the run's first is a repeat. Only compressed
bitmaps go on from there: one 64-bit word for each 64 lines that hold a repeat.

A key found in a large share of all lines would make one run, and one task, of that size. A
frequent-items sketch (one row, of bounded size) names such keys beforehand; their first documents
come from an aggregation that is combined on the map side, and go to the lines by a broadcast of at
most `MAX_HOT` rows. Which keys take which way does not change the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelkit.llm.text import BLANKS, LAST, ascii_lower, documents_of, let
from panelkit.session import checkpointed

MIN_CHARS = 10
#: Most keys that are treated as hot, and the counters of the sketch that finds them.
MAX_HOT, SKETCH_ITEMS = 2048, 16384
#: A key with fewer lines than this is never hot.
HOT_LINES = 2000


def lines_of(text: Column) -> Column:
    """The lines of a text; a null or empty one has one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc, text_hash, pos, h1, h2) of every line whose key has min_chars code points or more.

    A null doc_id sorts last: all rows without an id count as one document that comes after the others.
    """
    lines = docs.select(
        F.coalesce("doc_id", F.lit(LAST)).alias("doc"),
        F.xxhash64("text").alias("text_hash"),
        F.posexplode(lines_of(F.col("text"))).alias("pos", "line"),
    )
    key = ascii_lower(F.btrim("line", F.lit(BLANKS)))
    return (
        lines.where(F.length("line") >= min_chars)
        .select("doc", "text_hash", "pos", key.alias("key"))
        .where(F.length("key") >= min_chars)
        .select("doc", "text_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))
    )


def hot_hashes(lines: DataFrame) -> list[int]:
    """The h1 of keys that may have HOT_LINES lines or more, at most MAX_HOT of them: one row of a sketch."""
    found = lines.select(F.expr(f"approx_top_k(h1, {MAX_HOT}, {SKETCH_ITEMS})").alias("top")).first()["top"]
    return [x["item"] for x in found or [] if x["count"] >= HOT_LINES]


def repeated_lines(lines: DataFrame) -> DataFrame:
    """(doc, text_hash, pos) of the lines whose key has an earlier document."""
    hot = hot_hashes(lines)
    run = Window.partitionBy("h1", "h2").orderBy("doc", "pos")
    cold = lines.where(~F.col("h1").isin(hot)) if hot else lines
    found = (
        cold.repartitionByRange("h1")
        .withColumn("first_doc", F.first("doc").over(run))
        .where("doc > first_doc")
        .select("doc", "text_hash", "pos")
    )
    if hot:
        of_hot = lines.where(F.col("h1").isin(hot))
        firsts = of_hot.groupBy("h1", "h2").agg(F.min("doc").alias("first_doc"))
        found = found.unionByName(
            of_hot.join(F.broadcast(firsts), ["h1", "h2"]).where("doc > first_doc").select("doc", "text_hash", "pos")
        )
    return found


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """One row for each document that loses lines: (doc, text_hash, n_dropped, keep).

    `keep` is array<struct<word int, bits bigint>>: word w holds the bits of lines 64w to 64w + 63, set
    where the line stays; a word in which every line stays is left out. `doc` is the doc_id, the largest
    long for null. Rows with equal doc_id and text share a bitmap; rows with equal doc_id but other texts
    count as one document and have a bitmap each. Null or empty texts and empty tables give no rows.
    """
    lines = checkpointed(line_hashes(documents_of(docs, id_col, text_col), min_chars))
    words = (
        repeated_lines(lines)
        .groupBy("doc", "text_hash", F.expr("pos div 64").cast("int").alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("dropped"))
    )
    return words.groupBy("doc", "text_hash").agg(
        F.sum(F.bit_count("dropped")).alias("n_dropped"),
        F.sort_array(F.collect_list(F.struct("word", F.bitwise_not("dropped").alias("bits")))).alias("keep"),
    )


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the columns kept_text, kept_lines_before, kept_lines_dropped and kept_bitmap (null where all lines stay); kept_text is never null."""
    maps = bitmaps.select(
        F.col("doc").alias("__doc"), F.col("text_hash").alias("__hash"), F.col("n_dropped").alias("__dropped"), F.col("keep").alias("__keep")
    )
    text = F.coalesce(F.col(text_col), F.lit(""))
    all_set = F.lit(-1).cast("long")

    def dense(mask: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.array_max(F.map_keys(mask))), lambda w: F.coalesce(F.element_at(mask, w), all_set))

    def kept(bits: Column) -> Column:
        return F.filter(
            F.split(text, "\n", -1),
            lambda _, i: F.coalesce(F.get(bits, (i / 64).cast("int")), all_set).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), i % 64)) != 0,
        )

    on = (F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)) == F.col("__doc")) & (F.xxhash64(F.col(text_col).cast("string")) == F.col("__hash"))
    cut = F.array_join(let(let(F.map_from_entries("__keep"), dense), kept), "\n")
    return (
        docs.join(maps, on, "left")
        .withColumn("kept_text", F.when(F.col("__keep").isNull(), text).otherwise(cut))
        .withColumn("kept_lines_before", F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1)
        .withColumn("kept_lines_dropped", F.coalesce("__dropped", F.lit(0)).cast("long"))
        .withColumnRenamed("__keep", "kept_bitmap")
        .drop("__doc", "__hash", "__dropped")
    )


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """docs with their text cut down to the lines that stay (see keep_bitmaps and apply_bitmaps)."""
    return apply_bitmaps(docs, keep_bitmaps(docs, id_col, text_col, min_chars), id_col, text_col)
