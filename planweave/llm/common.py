"""What the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Only the named columns, so a table may carry others of any name."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def whole_text(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def split_of(doc_id: str | Column, parts: int) -> Column:
    """crc32 of the id as text, modulo `parts`; null ids count as the empty text."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % parts


def text_slices(batches: Iterable[pa.RecordBatch], most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about `most` bytes of their last column, so that long texts don't pile up."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.num_columns - 1)), 0).to_numpy(zero_copy_only=False)
        start = held = 0
        for i, size in enumerate(sizes):
            if held and held + size > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(size)
        if start < batch.num_rows:
            yield batch.slice(start)


def row_slices(batches: Iterable[pa.RecordBatch], most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about `most` bytes of all their texts, for rows that travel whole."""
    for batch in batches:
        sizes = np.zeros(batch.num_rows, np.int64)
        for c in batch.columns:
            if pa.types.is_string(c.type) or pa.types.is_binary(c.type):
                sizes += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False)
        start = held = 0
        for i, size in enumerate(sizes.tolist()):
            if held and held + size > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if start < batch.num_rows:
            yield batch.slice(start)


def read_along(docs: DataFrame, whole: bool) -> tuple[DataFrame, list[str]]:
    """What a scoring of texts sends to its tasks, the text last and once, and the columns that come back with the scores: all, or the id alone."""
    names = [c for c in docs.columns if c != "text"] if whole else ["doc_id"]
    return docs.select(*names, "text"), [*names, "text"] if whole else names


def texts_of(batch: pa.RecordBatch) -> list[str]:
    """The last column, null as empty."""
    return ["" if t is None else t for t in batch.column(batch.num_columns - 1).to_pylist()]


def with_fields(df: DataFrame, more: str) -> StructType:
    """The schema of `df` and what `more` adds to it."""
    return StructType([*df.schema.fields, *StructType.fromDDL(more).fields])
