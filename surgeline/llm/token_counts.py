"""Token counts of sections by offset-mapped attribution.

A whole document is encoded once. Each token's bytes give its character span; an interval join by
binary search on the sorted token starts assigns tokens to sections. The rule for tokens that cross a
boundary: a token belongs to the section that holds the character its first byte is part of, and
`n_crossing` counts a section's tokens that reach beyond its end. Counts of sections that cover a text
without overlap therefore add up to the text's tokens.

Sections are spans of code points, end exclusive. By default they are the text's lines, each with its
newline; a null or empty text has none. Given sections may overlap or be empty; a span beyond the text
is cut at its ends, a null start is the text's first character, a null end its last, a null section is
empty and stands at 0. A null list means the lines. Repeated rows are counted each; other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Encoder, encoder_for, ship_vocabulary
from .common import text_chunks

SCHEMA = "doc_id long, section int, start long, end long, n_tokens long, n_crossing long"


def token_spans(encoder: Encoder, sizes: np.ndarray, text: str) -> tuple[np.ndarray, np.ndarray]:
    """First and last character of each token."""
    lengths = sizes[np.array(encoder.encode(text), np.int64)]
    ends = np.cumsum(lengths)
    data = np.frombuffer(text.encode(), np.uint8)
    character = np.cumsum((data & 0xC0) != 0x80) - 1
    return character[ends - lengths], character[ends - 1]


def lines(text: str) -> tuple[np.ndarray, np.ndarray]:
    breaks = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), np.uint32) == 10) + 1
    starts = np.concatenate([[0], breaks])
    ends = np.concatenate([breaks, [len(text)]])
    real = ends > starts
    return starts[real], ends[real]


def attribute(encoder: Encoder, sizes: np.ndarray, text: str, sections: list | None) -> list[np.ndarray]:
    """Columns start, end, n_tokens, n_crossing."""
    if sections is None:
        starts, ends = lines(text)
    else:
        given = [{"start": 0, "end": 0} if s is None else s for s in sections]
        starts = np.clip(np.array([s["start"] or 0 for s in given], np.int64), 0, len(text))
        ends = np.array([len(text) if s["end"] is None else s["end"] for s in given], np.int64)
        ends = np.maximum(np.minimum(ends, len(text)), starts)
    if not text:
        return [starts, ends, np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)]
    first, last = token_spans(encoder, sizes, text)
    low, high = np.searchsorted(first, starts), np.searchsorted(first, ends)
    # tokens are in order, so those that start before an end and reach it are the last ones before it
    within = np.searchsorted(last, ends)
    return [starts, ends, high - low, np.maximum(high - np.maximum(within, low), 0)]


def count_tokens(docs: DataFrame, sections: str | None = None, path: str | None = None) -> DataFrame:
    """Rows of SCHEMA. `sections` names a column of docs, array<struct<start, end>>; without it
    sections are lines."""
    vocabulary = ship_vocabulary(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(vocabulary.value)
        sizes = np.array([len(b) for b in encoder.bytes_of], np.int64)
        for batch in text_chunks(batches):
            ids, given, texts = (batch.column(i).to_pylist() for i in range(3))
            found = [attribute(encoder, sizes, t or "", s) for t, s in zip(texts, given, strict=True)]
            counts = [len(f[0]) for f in found]
            owner = pa.array(list(chain.from_iterable([i] * n for i, n in zip(ids, counts, strict=True))), pa.int64())
            number = pa.array(np.concatenate([np.arange(n, dtype=np.int32) for n in counts]), pa.int32())
            columns = [pa.array(np.concatenate([f[k] for f in found]).astype(np.int64)) for k in range(4)]
            yield pa.RecordBatch.from_arrays([owner, number, *columns], ["doc_id", "section", "start", "end", "n_tokens", "n_crossing"])

    spans = "array<struct<start: long, end: long>>"
    chosen = (F.col(sections) if sections else F.lit(None)).cast(spans).alias("sections")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), chosen, "text").mapInArrow(run, SCHEMA)
