"""Native expressions and helpers that several text operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = " \t\n\x0b\x0c\r"
LAST = 2**63 - 1


#: Rows in a batch that goes to Python: texts may be long, and an executor holds a few batches at once.
BATCH_ROWS = 1000


def with_small_batches(docs: DataFrame) -> DataFrame:
    """docs itself; its session from now on sends no more than BATCH_ROWS rows to Python at once."""
    conf, name = docs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return docs


def keep_where(docs: DataFrame, text_col: str, test: Callable[[list], list[bool]]) -> DataFrame:
    """The rows of docs whose text passes; test gets a list of texts, nulls among them."""
    k = docs.columns.index(text_col)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            yield part.filter(pa.array(test(part.column(k).to_pylist()), pa.bool_()))

    return with_small_batches(docs).mapInArrow(batches, docs.schema)


def documents_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only doc_id and text, so that no further column of the input can clash with a working column."""
    return with_small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone; the quick built-in does where the text is pure ASCII."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """True for the documents whose labels are never learnt from; a null id counts as the text ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds == fold


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once for the row, also where body uses it inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)
