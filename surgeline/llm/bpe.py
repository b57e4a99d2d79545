"""Byte-level BPE encoding and decoding with contiguous rank arrays.

A text is split by the vocabulary's pattern into words. A short word is an array of part boundaries
with the rank of each adjacent pair beside it: the smallest rank is found by a scan, its boundary is
deleted and the two neighbouring ranks are refreshed. Words of more than LONG bytes keep their pairs
in a heap instead, with the same merges in the same order, so that a word of n bytes takes n log n
steps. Words that occur again come from a cache of bounded size.

Special tokens of the vocabulary are found in the text before it is split. A null text is empty and
has no tokens. Decoding joins the tokens' bytes; bytes that are not UTF-8 become U+FFFD. Other columns
are not read; repeated rows give repeated results.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_chunks

LONG = 48
CACHE_WORDS = 100_000  # bounds memory; two generations of so many words are held
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
NO_RANK = 1 << 60


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary: printable Latin-1 for itself, the
    others in order from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Encoder(dict):
    """Maps a word to its token ids; itself the cache."""

    def __init__(self, vocabulary: str | bytes):
        super().__init__()
        spec = json.loads(vocabulary)
        vocab = spec["model"]["vocab"]
        letters = byte_letters()
        self.bytes_of = [b""] * (max([*vocab.values(), *[t["id"] for t in spec["added_tokens"]]], default=-1) + 1)
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for content, i in self.specials.items():
            self.bytes_of[i] = content.encode()
        self.byte_ids = [0] * 256
        for c, b in letters.items():
            self.byte_ids[b] = vocab[c]
        self.ranks, self.merged = {}, []
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            self.ranks[vocab[left], vocab[right]] = rank
            self.merged.append(vocab[left + right])
        self.older: dict[str, tuple[int, ...]] = {}
        self.words = regex.compile(PATTERN).findall
        self.split = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.specials, key=len, reverse=True)) + ")").split if self.specials else None

    def forget(self) -> None:
        self.clear()
        self.older = {}

    def __missing__(self, word: str) -> tuple[int, ...]:
        ids = self.older.get(word)
        if ids is None:
            parts = [self.byte_ids[b] for b in word.encode()]
            ids = tuple(self.merge_long(parts) if len(parts) > LONG else self.merge_short(parts))
        if len(word) <= LONG:
            if len(self) >= CACHE_WORDS:
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return ids

    def merge_short(self, parts: list[int]) -> list[int]:
        rank_of = self.ranks.get
        ranks = [rank_of(p, NO_RANK) for p in zip(parts, parts[1:], strict=False)]
        while ranks:
            best = min(ranks)
            if best == NO_RANK:
                break
            i = ranks.index(best)
            parts[i] = self.merged[best]
            del parts[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = rank_of((parts[i], parts[i + 1]), NO_RANK)
            if i:
                ranks[i - 1] = rank_of((parts[i - 1], parts[i]), NO_RANK)
        return parts

    def merge_long(self, parts: list[int]) -> list[int]:
        n, ranks = len(parts), self.ranks
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := ranks.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, left, right = heapq.heappop(heap)
            j = after[i]
            if j < 0 or parts[i] != left or parts[j] != right:
                continue  # one of the two parts has changed since
            parts[i], parts[j] = self.merged[rank], -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (r := ranks.get((parts[a], parts[b]))) is not None:
                    heapq.heappush(heap, (r, a, parts[a], parts[b]))
        return [p for p in parts if p >= 0]

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        pieces = self.split(text) if self.split and any(s in text for s in self.specials) else [text]
        for piece in pieces:
            if piece in self.specials:
                ids.append(self.specials[piece])
            else:
                ids.extend(chain.from_iterable(map(self.__getitem__, self.words(piece))))
        return ids

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


_encoders: dict[int, Encoder] = {}


def encoder_for(vocabulary: bytes) -> Encoder:
    """The worker's encoder; one of another vocabulary gives way."""
    key = hash(vocabulary)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(vocabulary)
    return _encoders[key]


def ship_vocabulary(docs: DataFrame, path: str | None):
    """The vocabulary file's content, read on the driver and sent to each executor once (a few MB)."""
    return docs.sparkSession.sparkContext.broadcast(Path(path or default_vocabulary()).read_bytes())


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids, decoded) for each row: the token ids of its text and the text they decode to."""
    vocabulary = ship_vocabulary(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(vocabulary.value)
        try:
            for batch in text_chunks(batches):
                found = [encoder.encode(t or "") for t in batch.column(1).to_pylist()]
                ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
                flat = np.fromiter(chain.from_iterable(found), np.int32, count=int(ends[-1]))
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
                yield pa.RecordBatch.from_arrays([batch.column(0), ids, pa.array(list(map(encoder.decode, found)), pa.string())], ["doc_id", "ids", "decoded"])
        finally:
            encoder.forget()  # the worker goes on to other stages

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of encoded documents."""
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
