"""Tables written to the shared folder of the cluster, and bounded batches inside tasks."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftscope.session import ensure_checkpoint_dir


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below ``spark.checkpoint.dir`` and read it back.

    Cuts the lineage: a lost executor costs its running tasks, never this table.  Unlike a
    checkpoint the re-read table has a known size, from which Spark picks its joins."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}/{name}"
    df.write.mode("error").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def row_key(text: str) -> Column:
    """Names a row by its id and text; rows that repeat both share it."""
    return F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.xxhash64(F.col(text).cast("string")).cast("string"))


def slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that ``column`` holds about ``max_bytes`` in each; one row is
    never cut, so a longer text makes a batch of its own."""
    for batch in batches:
        arr = batch.column(batch.schema.get_field_index(column))
        sizes = pc.fill_null(pc.binary_length(arr), 0).to_pylist()
        first, held = 0, 0
        for i, n in enumerate(sizes):
            if held and held + n > max_bytes:
                yield batch.slice(first, i - first)
                first, held = i, 0
            held += n
        if first < batch.num_rows:
            yield batch.slice(first)


def gathered(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """As :func:`slices`, and small neighbours are joined up to ``max_bytes``."""
    held: list[pa.RecordBatch] = []
    size = 0
    for piece in slices(batches, column, max_bytes):
        n = pc.sum(pc.binary_length(piece.column(piece.schema.get_field_index(column)))).as_py() or 0
        if held and size + n > max_bytes:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
        if piece.num_rows:
            held.append(piece)
            size += n
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
