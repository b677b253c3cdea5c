"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next.

Every stage works on all that its predecessor kept. All but the last return the columns of documents; the
last returns the packed pieces. Rows without an id stay where a stage names documents by id; a table without n_chars is fine.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkit.llm import decontamination, line_dedup, packing, quality_classifier, simhash
from panelkit.llm.queries import tokenizer_path
from panelkit.session import checkpoint_dir, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier (3) rejects go."""
    return quality_classifier.keep_good(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document has (2) go; n_chars follows the text."""
    kept = line_dedup.dedup_lines(docs)
    text = F.col("kept_text")
    changed = {"text": text} | ({"n_chars": F.length(text).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return kept.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (4) the document with the smallest id stays."""
    return simhash.keep_one_of_each(docs)


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item (6) go."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces (5) with their checksums."""
    return packing.piece_report(packing.pack_documents(docs, tokenizer_path()))


STAGES = [
    ("quality", quality),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("contamination", contamination),
    ("packing", packed),
]

#: The classifier's scores and the tokenizer's ids can't be had in SQL; tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what lies between them goes to a new folder beside the checkpoints."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(path := f"{folder}/{k}-{name}")
        docs = spark.read.parquet(path)
    return docs
