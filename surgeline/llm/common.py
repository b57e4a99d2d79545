"""Helpers that several text operators share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
BROADCAST_ROWS = 1_000_000  # of one or two bigint columns: tens of megabytes at most
CHUNK_BYTES = 1 << 19


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def checked_broadcast(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a frame of a few numbers whose row count is known and small; beyond the limit the
    join shuffles as usual."""
    return F.broadcast(df) if rows <= limit else df


def without_ids(docs: DataFrame, ids: DataFrame, rows: int) -> DataFrame:
    """The documents whose id is not among `ids` (one column, doc_id). A null id always stays."""
    return docs.join(checked_broadcast(ids.select("doc_id"), rows), "doc_id", "left_anti").select(docs.columns)


def thinned(df: DataFrame, key: Column, rows: int) -> DataFrame:
    """About four times `rows` rows, or all of fewer, chosen by a hash: what a task then sends on for
    a bounded sample does not grow with the input."""
    share = min(1.0, 4 * rows / max(df.count(), 1))
    return df if share == 1.0 else df.where(F.pmod(key, F.lit(1 << 30)) < int(share * (1 << 30)))


_ascii_lower = {c: c + 32 for c in range(65, 91)}


def lowered(text: str) -> str:
    """In lower case, character by character: places in the result are places in the text."""
    low = text.lower()
    return low if len(low) == len(text) else text.translate(_ascii_lower)


def text_chunks(batches: Iterator[pa.RecordBatch], limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows whose last column, a text, holds about `limit` bytes; a longer text
    comes alone. Nothing is cut."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.num_columns - 1)), 0).to_numpy(zero_copy_only=False)
        first, held = 0, 0
        for i, size in enumerate(sizes.tolist()):
            if held and held + size > limit:
                yield batch.slice(first, i - first)
                first, held = i, 0
            held += size
        yield batch.slice(first)
        pa.default_memory_pool().release_unused()  # a worker outlives its tasks
