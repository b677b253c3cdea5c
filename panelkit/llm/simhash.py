"""SimHash near-duplicates: a grid join on segment bit counts, then exact verification.

A fingerprint of 64 bits is mapped to 32 segments of two bits; the bit counts of its segments (0 to 2
each) are its point. The Manhattan distance of two points is a lower bound of the Hamming distance of
the fingerprints. With the segments in `blocks` groups, two points at distance DISTANCE or less agree
in at least blocks - DISTANCE groups; every choice of that many groups is a grid, and the counts in
them are the cell. Pairs in a cell are checked by the lower bound and then exactly. The number of
blocks follows from the number of different fingerprints, so that each meets about PER_CELL unrelated ones in a cell.

Equal fingerprints are one node from the start. A cell of relatives does not emit its pairs: first all of its fingerprints
are compared with one leader, the one with most documents; then those that are not in one component by way of leaders
are compared with one another. So components are those of all pairs within the distance.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelkit.llm.components import connected_components
from panelkit.llm.skew import join_facts
from panelkit.llm.text import documents_of
from panelkit.session import written

SHINGLE, DISTANCE, SEED = 4, 4, 42
SEGMENTS, SEGMENT_BITS = 32, 2
#: Unrelated fingerprints that one of them may meet in a cell, on the average.
PER_CELL = 256
EVEN_BITS = 0x5555555555555555


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint as a signed integer; 0 for a text without words.

    Words are runs without ASCII blanks, A-Z lower-cased; a text with fewer words than a shingle has one
    shingle, the whole sequence. A bit is set if more than half of the shingles' hashes have it.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    else:
        hashes = [xxhash.xxh64_intdigest(b" ".join(x), SEED) for x in zip(*(words[i:] for i in range(shingle)))]
    ones = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 65536):
        part = np.array(hashes[start : start + 65536], "<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, text_id, fp) of every row; text_id is a hash of the text."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found = pa.array([fingerprint(t.as_py(), shingle) for t in part.column("text")], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_id"), found], ["doc_id", "text_id", "fp"])

    rows = documents_of(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("text_id"), "text")
    return rows.mapInArrow(batches, "doc_id long, text_id long, fp long")


def blocks_for(n: int, distance: int = DISTANCE, per_cell: int = PER_CELL) -> int:
    """The fewest blocks with which a fingerprint meets at most per_cell of n unrelated ones in a cell, on the average.

    The counts of two random segments are equal with probability 3/8.
    """
    blocks = distance + 2
    while blocks < SEGMENTS and n * 0.375 ** (SEGMENTS * (blocks - distance) / blocks) > per_cell:
        blocks += 1
    return blocks


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def _lit(x: int) -> Column:
    return F.lit(_signed(x)).cast("long")


def segment_counts(fp: Column) -> Column:
    """The point of a fingerprint: 32 bit counts in two bits each, packed into a long."""
    low, high = fp.bitwiseAND(_lit(EVEN_BITS)), F.shiftrightunsigned(fp, 1).bitwiseAND(_lit(EVEN_BITS))
    return F.shiftleft(low.bitwiseAND(high), 1).bitwiseOR(low.bitwiseXOR(high))


def manhattan(p: Column, q: Column) -> Column:
    """The Manhattan distance of two packed points. Counts 0, 1, 2 differ as 01 or 11 if by one, 10 if by two."""
    x = p.bitwiseXOR(q)
    low, high = x.bitwiseAND(_lit(EVEN_BITS)), F.shiftrightunsigned(x, 1).bitwiseAND(_lit(EVEN_BITS))
    return F.bit_count(low.bitwiseOR(high)) + F.bit_count(high.bitwiseAND(F.bitwise_not(low)))


def _cells(blocks: int, distance: int) -> list[int]:
    """The mask of a point's bits for every choice of blocks - distance groups of segments."""
    edge = [round(SEGMENTS * k / blocks) for k in range(blocks + 1)]
    masks = [sum(3 << (2 * s) for s in range(edge[k], edge[k + 1])) for k in range(blocks)]
    return [sum(chosen) for chosen in combinations(masks, blocks - distance)]


def fingerprint_links(nodes: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Edges (u, v) between different fingerprints of nodes(fp, n), whose components are those of all pairs within the distance.

    nodes has one row for each fingerprint, with the number of its documents. Every edge is a pair within the distance.
    """
    masks = _cells(blocks_for(nodes.count(), distance), distance)

    def placed(rows: DataFrame) -> DataFrame:
        cells = F.transform(F.array(*[_lit(m) for m in masks]), lambda m, i: F.struct(i.alias("grid"), m.bitwiseAND(F.col("point")).alias("at")))
        return rows.withColumn("point", segment_counts(F.col("fp"))).select("*", F.inline(cells)).drop("point")

    def near(x: str, y: str) -> Column:
        x, y = F.col(x), F.col(y)
        return (manhattan(segment_counts(x), segment_counts(y)) <= distance) & (F.bit_count(x.bitwiseXOR(y)) <= distance)

    members = placed(nodes)
    leaders = members.groupBy("grid", "at").agg(F.max_by("fp", F.struct("n", F.xxhash64("fp", "grid"))).alias("leader"), F.count("*").alias("size")).where("size > 1")
    led = members.join(leaders, ["grid", "at"]).where((F.col("fp") != F.col("leader")) & near("fp", "leader"))
    linked = written(led.select(F.greatest("fp", "leader").alias("u"), F.least("fp", "leader").alias("v")).distinct())
    roots = connected_components(linked).withColumnRenamed("node", "fp")
    members = placed(nodes.select("fp").join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    a, b = (members.select("grid", "at", F.col("fp").alias(x), F.col("root").alias(f"{x}_root")) for x in "vu")
    rest = a.join(b, ["grid", "at"]).where((F.col("v") < F.col("u")) & (F.col("v_root") != F.col("u_root")) & near("u", "v"))
    return linked.unionByName(rest.select("u", "v").distinct())


def _rooted(rows: DataFrame, distance: int) -> DataFrame:
    """(fp, n, root, component_id) of every fingerprint of rows(doc_id, fp)."""
    nodes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n")))
    roots = connected_components(fingerprint_links(nodes.select("fp", "n"), distance))
    rooted = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    of_root = rooted.groupBy("root").agg(F.min("first_doc").alias("component_id"), F.sum("n").alias("of_root"))
    return written(join_facts(rooted, of_root, "root", "of_root").select("fp", "n", "root", "component_id"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """One row for each row of docs: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id that can be reached over links, the document itself included; null
    ids are never the smallest, and a component of nothing else has none. Null and empty texts have
    fingerprint zero and link like others. Repeated rows come out repeated. An empty table gives no rows.
    """
    rows = written(fingerprints(docs, id_col, text_col, shingle))
    named = join_facts(rows, _rooted(rows, distance).drop("root"), "fp", "n")
    return named.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """The rows of docs that stay: of each component the one with the smallest doc_id.

    Where several rows of a component have that id, the one whose text has the smallest hash stays, and of rows with equal ids and texts one;
    unlinked texts of one id stay all. Rows without an id cannot be named as anyone's copy and stay.
    """
    rows = written(fingerprints(docs, id_col, text_col, shingle))
    rooted = join_facts(rows.where("doc_id is not null"), _rooted(rows, distance).drop("component_id"), "fp", "n")
    kept = rooted.groupBy("root").agg(F.min(F.struct("doc_id", "text_id")).alias("__kept")).select("__kept.*").toDF("__doc", "__text_id")
    named = docs.where(F.col(id_col).isNotNull()).withColumns({"__doc": F.col(id_col).cast("long"), "__text_id": F.xxhash64(F.col(text_col).cast("string"))})
    row = ["__doc", "__text_id"]  # the same in the join and after it, so that the texts are shuffled once
    return named.join(kept, row, "left_semi").dropDuplicates(row).drop(*row).unionByName(docs.where(F.col(id_col).isNull()))
