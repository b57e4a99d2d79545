"""Document fingerprints by I-Match with randomised lexicons.

A term is a run of characters other than white space, A-Z in lower case. The lexicon keeps the terms
that between LOW and HIGH of all documents hold, a band of inverse document frequency. A lexicon so
chosen has at most (distinct terms of an average document) / LOW terms, however many documents there
are; that bound makes it small enough to broadcast as an array of 64-bit hashes.

Each of SUBSETS randomised lexicons keeps a share 2**-level of the terms. A document's sorted distinct
terms within one are hashed to a signature. A document with n terms of the lexicon uses LEVELS levels
from floor(log2 n) on, so that a subset holds about one of its terms or less at any length of text. The
fingerprint lists all signatures; likeness is the share of equal ones among the subsets in which
either document has a term, over the levels that both use (without a common one: 0). Equal fingerprints
have likeness 1.

A document without any term of the lexicon uses all its distinct terms instead; the first letter of
the fingerprint says which. A null text is empty, a text without terms has the fingerprint
`-`. Rows are taken in ascending order of (doc_id, hash of the text), nulls first; rows that repeat an
id are documents of their own. A single document is its own next one. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import text_chunks
from .wordscan import U, mix, scan

LOW, HIGH = 0.001, 0.3
SUBSETS, LEVELS = 40, 3
HELD_TERMS = 1 << 19  # a counting task sends its terms on when it holds so many
CANDIDATES = 1 << 22  # terms of 8 bytes to broadcast

_limits = np.array([(1 << 64 - level) - 1 for level in range(64)], np.uint64)  # largest hash in a subset of a level
_seeds = mix(np.arange(1, SUBSETS + 1, dtype=np.uint64) * U(0x9E3779B97F4A7C15))


def term_sets(texts: list[str | None]) -> list[np.ndarray]:
    """Sorted distinct term hashes of each text."""
    found = scan(pa.array(texts, pa.large_string()), lower=True)
    words, bounds = found.words(), found.first.tolist()
    return [np.unique(words[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def _count_batches(batches: Iterator[pa.RecordBatch], low: float, chosen: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """(term, documents) sums of what a task has read, sent on whenever they fill up: of the chosen
    terms, or else of those that `low` of the documents read hold."""
    terms, counts, read = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0
    fresh: list[np.ndarray] = []

    def packed() -> pa.RecordBatch:
        often = counts >= low * read
        return pa.RecordBatch.from_arrays([pa.array(terms[often].view(np.int64)), pa.array(counts[often])], ["term", "documents"])

    for batch in text_chunks(batches):
        found = term_sets(batch.column(0).to_pylist())
        fresh += found if chosen is None else [within(f, chosen) for f in found]
        read += len(found)
        if sum(map(len, fresh)) > HELD_TERMS:
            terms, counts = _merged(terms, counts, fresh)
            fresh = []
            if len(terms) > HELD_TERMS:
                yield packed()
                terms, counts, read = terms[:0], counts[:0], 0
    terms, counts = _merged(terms, counts, fresh)
    if len(terms):
        yield packed()


def _merged(terms: np.ndarray, counts: np.ndarray, fresh: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    every = np.concatenate([terms, *fresh])
    known, at = np.unique(every, return_inverse=True)
    weights = np.concatenate([counts, np.ones(len(every) - len(terms), np.int64)])
    return known, np.bincount(at, weights, len(known)).astype(np.int64)


def lexicon(docs: DataFrame, low: float = LOW, high: float = HIGH, candidates: int = CANDIDATES) -> np.ndarray:
    """Sorted hashes of the terms in the band; the frequencies count every document.

    Most terms are rare, so the text is read twice rather than all of them shuffled: a term that `low`
    of all documents hold is in as large a share of what at least one task has read at a time, which
    is all a first pass sends on; a second one counts those. If they are too many to broadcast, it
    counts all terms.
    """
    texts, counts = docs.select("text"), "term long, documents long"
    total = docs.count()
    often = materialize(texts.mapInArrow(partial(_count_batches, low=low, chosen=None), counts).select("term").distinct(), "candidates")
    shared = docs.sparkSession.sparkContext.broadcast(_hashes(often) if often.count() <= candidates else None)
    counted = texts.mapInArrow(lambda batches: _count_batches(batches, 0.0, shared.value), counts)
    frequency = counted.groupBy("term").agg(F.sum("documents").alias("documents"))
    return _hashes(frequency.where(F.col("documents").between(low * total, high * total)))  # average distinct terms / low at most


def _hashes(terms: DataFrame) -> np.ndarray:
    return np.sort(terms.select("term").toArrow().column(0).to_numpy().astype(np.int64).view(np.uint64))


def within(terms: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    if not len(chosen):
        return terms[:0]
    at = np.minimum(np.searchsorted(chosen, terms), len(chosen) - 1)
    return terms[chosen[at] == terms]


def signatures(drawn: np.ndarray, subset: np.ndarray) -> np.ndarray:
    """16 bits a subset, 0 where it holds none of the terms. `drawn` holds a hash for each term and
    subset it is in, in the order of the terms; each counts by its rank in its subset."""
    order = np.argsort(subset, kind="stable")
    drawn, subset = drawn[order], subset[order]
    held = np.bincount(subset, minlength=SUBSETS)
    rank = np.arange(len(subset)) - (np.cumsum(held) - held)[subset]
    total = np.zeros(SUBSETS, np.uint64)
    np.add.at(total, subset, mix(drawn + U(1)) * (U(2) * rank.astype(np.uint64) + U(1)))
    return np.where(held > 0, np.maximum(mix(total) >> U(48), U(1)), U(0)).astype(np.uint16)


def fingerprint(terms: np.ndarray, chosen: np.ndarray) -> str:
    """`-`, or b (terms of the band) or a (all terms), the first level in two digits, and the signatures
    at that level and the following ones, four hex digits each."""
    if not len(terms):
        return "-"
    own = within(terms, chosen)
    kind, used = ("b", own) if len(own) else ("a", terms)
    level = len(used).bit_length() - 1
    drawn = mix(used[:, None] ^ _seeds[None, :])
    term, subset = np.nonzero(drawn <= _limits[level])
    drawn = drawn[term, subset]
    found = [signatures(drawn[inside], subset[inside]) for inside in (drawn <= _limits[level + k] for k in range(LEVELS))]
    return f"{kind}{level:02d}{np.concatenate(found).astype('>u2').tobytes().hex()}"


def likeness(one: str, other: str) -> float:
    if one == other:
        return 1.0
    if "-" in (one, other) or one[0] != other[0]:
        return 0.0
    (a, first), (b, start) = ((np.frombuffer(bytes.fromhex(x[3:]), ">u2").reshape(LEVELS, SUBSETS), int(x[1:3])) for x in (one, other))
    low, high = max(first, start), min(first, start) + LEVELS
    a, b = a[low - first : max(high - first, 0)], b[low - start : max(high - start, 0)]
    used = (a > 0) | (b > 0)
    return float(((a == b) & used).sum() / used.sum()) if used.any() else 0.0


def edited(text: str, following: str) -> str:
    """The last quarter of a text replaced by the beginning of the following one."""
    cut = len(text) // 4
    return text[: len(text) - cut] + following[:cut]


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
#: What a partition leaves open: its first and its last row, whose neighbours lie elsewhere.
EDGES = "part int, edge string, text string"
NAMES = [c.split()[0] for c in f"{RESULT}, {EDGES}".split(", ")]
_types = {"long": pa.int64(), "string": pa.string(), "double": pa.float64(), "int": pa.int32()}
SCHEMA = pa.schema([(c.split()[0], _types[c.split()[1]]) for c in f"{RESULT}, {EDGES}".split(", ")])


def judged(rows: list[tuple], chosen: np.ndarray) -> list[dict]:
    """rows: (doc_id, text, following text, own fingerprint or None, following fingerprint)."""
    changed = [edited(text, following) for _, text, following, _, _ in rows]
    out = []
    for (doc_id, text, _, own, after), new, terms in zip(rows, changed, term_sets(changed), strict=True):
        print_of_new = own if new == text else fingerprint(terms, chosen)
        out.append(
            {
                "doc_id": doc_id,
                "n_chars": len(text),
                "edited_sha256": hashlib.sha256(new.encode()).hexdigest(),
                "fingerprint": own,
                "edited_fingerprint": print_of_new,
                "near_edited": likeness(own, print_of_new),
                "near_next": likeness(own, after),
            }
        )
    return out


def _judge_sorted(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """Rows of a partition in order: each is judged once its next one is seen."""
    chosen, part, last = shared.value, TaskContext.get().partitionId(), None
    for batch in text_chunks(batches):
        texts = [t or "" for t in batch.column(1).to_pylist()]
        own = [fingerprint(t, chosen) for t in term_sets(texts)]
        now = list(zip(batch.column(0).to_pylist(), texts, own, strict=True))
        out = []
        if last is None:
            out.append({"part": part, "edge": "first", "text": texts[0], "fingerprint": own[0]})
        before = ([last] if last else []) + now
        out += judged([(a[0], a[1], b[1], a[2], b[2]) for a, b in zip(before[:-1], before[1:], strict=True)], chosen)
        last = now[-1]
        yield pa.RecordBatch.from_pylist(out, SCHEMA)
    if last is not None:
        yield pa.RecordBatch.from_pylist([{"part": part, "edge": "last", "doc_id": last[0], "text": last[1], "fingerprint": last[2]}], SCHEMA)


def _judge_pairs(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    for batch in text_chunks(batches):
        rows = [(r["doc_id"], r["text"], r["after"], r["fingerprint"], r["after_fingerprint"]) for r in batch.to_pylist()]
        yield pa.RecordBatch.from_pylist(judged(rows, shared.value), pa.schema([SCHEMA.field(c) for c in NAMES[:7]]))


def fingerprints(docs: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """Rows of RESULT. The table is dealt out once, by ranges of doc_id; rows at the seams of the
    ranges, two a partition, meet in a second small join."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    shared = spark.sparkContext.broadcast(lexicon(rows, low, high))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    copies = F.monotonically_increasing_id()  # parts even equal rows, which any seam may divide
    dealt = rows.repartitionByRange(*order, copies).sortWithinPartitions(*order)
    found = materialize(dealt.mapInArrow(partial(_judge_sorted, shared=shared), f"{RESULT}, {EDGES}"), "fingerprints", compression="zstd")
    inner = found.where("edge is null").select(*NAMES[:7])

    firsts, lasts = found.where("edge = 'first'"), found.where("edge = 'last'")
    parts = sorted(r["part"] for r in lasts.select("part").collect())  # one number a partition
    ring = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1], strict=True)), "part int, next int")
    after = firsts.select(F.col("part").alias("next"), F.col("text").alias("after"), F.col("fingerprint").alias("after_fingerprint"))
    seams = lasts.join(F.broadcast(ring), "part").join(after, "next").select("doc_id", "fingerprint", "after_fingerprint", "after", "text")
    return inner.unionByName(seams.mapInArrow(partial(_judge_pairs, shared=shared), RESULT))
