"""Quality rules judged by an isolation forest.

`rule_statistics` measures each text in one pass. The forest isolates rows of the rules' ratios, none
cut at its rule's limit: a row that few random splits part from all others is anomalous, and its score
2**(-path / usual path) is high. Splits fall anywhere within a ratio's whole possible range, not only
among the rows the forest has seen, so a kind of text that neither the sample nor any label holds ends
on a short path too. The forest grows on good labelled rows, a bounded sample (TREES trees of at most
SUBSAMPLE rows, from at most SAMPLE rows); without labels on all rows.

The threshold is calibrated on all labelled rows: the lowest score that rejects at most `tolerance` of
the good ones; labelled bad rows then say how many of them it rejects (`Judge.caught`).

A null or empty text has no words and fails the base rule. Without labelled good rows nothing but the
base rule rejects. Rows are judged one by one, so repeated rows get equal verdicts. Other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import text_chunks, thinned
from .wordscan import Scan, scan, windows

TREES, SUBSAMPLE, SAMPLE = 100, 256, 4096
TOLERANCE = 0.005
BINS = 2000
STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_digits", "n_marks", "n_lines"]
SYMBOLS = b"#*$%&|<>"

_symbol = np.zeros(256, bool)
_symbol[list(SYMBOLS)] = True
_mark = np.zeros(256, bool)
_mark[[b for b in range(33, 127) if not chr(b).isalnum()]] = True


def _per_text(found: Scan, flags: np.ndarray) -> np.ndarray:
    running = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return running[found.offsets[1:]] - running[found.offsets[:-1]]


def _later_equal(keys: np.ndarray) -> int:
    return len(keys) - len(np.unique(keys))


def _covered(runs: np.ndarray, width: int, words: int) -> int:
    """Words inside a window that occurs at least twice."""
    if len(runs) < 2:
        return 0
    order = np.argsort(runs, kind="stable")
    same = runs[order][1:] == runs[order][:-1]
    if not same.any():
        return 0
    hit = np.zeros(len(runs), bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    edge = np.zeros(words + 1, np.int64)
    at = np.flatnonzero(hit)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return int((np.cumsum(edge)[:words] > 0).sum())


def measure(texts: pa.Array) -> dict[str, np.ndarray]:
    found = scan(texts, lower=False)
    data, offsets = found.data, found.offsets
    bounds = list(zip(found.first[:-1].tolist(), found.first[1:].tolist(), strict=True))
    triples = windows(found.words(), 3)
    newline = np.flatnonzero(data == 10)
    line_starts = np.sort(np.concatenate([offsets[:-1], newline + 1]))
    # a line ends at its newline or with its text; offsets and newlines together bound all of them
    line_ends = np.sort(np.concatenate([offsets[1:], newline]))
    worded = np.concatenate([[0], np.cumsum(~found.space, dtype=np.int64)])
    real = worded[line_ends] > worded[line_starts]
    keys = found.hashes(line_starts[real], line_ends[real])
    owner = np.searchsorted(offsets, line_starts[real], side="right") - 1
    cuts = np.searchsorted(owner, np.arange(len(offsets)))
    return {
        "n_words": np.diff(found.first),
        "word_chars": _per_text(found, ~found.space & ((data & 0xC0) != 0x80)),
        "n_symbols": _per_text(found, _symbol[data]),
        "n_dup_lines": np.array([_later_equal(keys[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], np.int64),
        "n_repeat_words": np.array([_covered(triples[a : max(a, b - 2)], 3, b - a) for a, b in bounds], np.int64),
        "n_upper": _per_text(found, (data >= 65) & (data <= 90)),
        "n_digits": _per_text(found, (data >= 48) & (data <= 57)),
        "n_marks": _per_text(found, _mark[data]),
        "n_lines": np.diff(cuts),
    }


def _statistic_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_chunks(batches):
        found = measure(batch.column(1))
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(found[c], pa.int64()) for c in STATISTICS]], ["doc_id", *STATISTICS])


def rule_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and STATISTICS of each row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_statistic_batches, "doc_id long, " + ", ".join(f"{c} long" for c in STATISTICS))


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < 50) | (100 * n_repeat_words > 50 * n_words)


#: Limits of the rules, per word, character or line; units of the ratios.
SYMBOLS_PER_WORD, MARKS_PER_WORD = 0.1, 0.6
UPPER_SHARE, DIGIT_SHARE = 0.3, 0.2
DUPLICATE_LINES, REPEATED_WORDS = 0.5, 0.4
#: Beyond these the unbounded ratios count as this much: marks a word, characters a word.
MOST_MARKS, MOST_CHARS = 20, 100


def features(stats: dict[str, np.ndarray]) -> np.ndarray:
    """Each share as a multiple of its rule's limit, and word length, on log scales."""
    s = {k: np.asarray(v, float) for k, v in stats.items()}
    words, chars, lines = np.maximum(s["n_words"], 1), np.maximum(s["word_chars"], 1), np.maximum(s["n_lines"], 1)
    shares = [
        s["n_symbols"] / words / SYMBOLS_PER_WORD,
        s["n_marks"] / words / MARKS_PER_WORD,
        s["n_upper"] / chars / UPPER_SHARE,
        s["n_digits"] / chars / DIGIT_SHARE,
        s["n_dup_lines"] / lines / DUPLICATE_LINES,
        s["n_repeat_words"] / words / REPEATED_WORDS,
        s["word_chars"] / words,
    ]
    return np.minimum(np.log1p(np.column_stack(shares)), HIGHEST)


HIGHEST = np.log1p([MOST_MARKS / SYMBOLS_PER_WORD, MOST_MARKS / MARKS_PER_WORD, 1 / UPPER_SHARE, 1 / DIGIT_SHARE, 1 / DUPLICATE_LINES, 1 / REPEATED_WORDS, MOST_CHARS])
LOWEST = np.zeros(len(HIGHEST))


def usual_path(n: float) -> float:
    """Average path length of an unsuccessful search among n points."""
    return 0.0 if n <= 1 else 2.0 * (np.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n


@dataclass
class Forest:
    """Trees as arrays: feature (-1: leaf), cut, left child (the right one follows), leaf path length."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    usual: float

    def scores(self, rows: np.ndarray) -> np.ndarray:
        total = np.zeros(len(rows))
        for feature, cut, left, path in self.trees:
            at = np.zeros(len(rows), np.int64)
            while True:
                inner = np.flatnonzero(feature[at] >= 0)
                if not len(inner):
                    break
                k = at[inner]
                at[inner] = left[k] + (rows[inner, feature[k]] >= cut[k])
            total += path[at]
        return 2.0 ** (-total / (max(1, len(self.trees)) * max(self.usual, 1e-9)))


def grow(rows: np.ndarray, low: np.ndarray, high: np.ndarray, seed: int = 7, trees: int = TREES, subsample: int = SUBSAMPLE) -> Forest:
    """Cuts fall anywhere within a node's bounds, those of the root being low and high, so that they
    also part the rows from what lies beside them."""
    rng = np.random.default_rng(seed)
    size = min(subsample, len(rows))
    depth = int(np.ceil(np.log2(max(size, 2))))
    made = []
    for _ in range(trees if len(rows) else 0):
        part = rows[rng.choice(len(rows), size, replace=False)]
        feature, cut, left, path = [-1], [0.0], [0], [0.0]
        stack = [(0, part, 0, low, high)]
        while stack:
            node, own, level, least, most = stack.pop()
            varied = np.flatnonzero(most > least)
            if level >= depth or len(own) <= 1 or not len(varied):
                path[node] = level + usual_path(len(own))
                continue
            f = int(rng.choice(varied))
            c = rng.uniform(least[f], most[f])
            feature[node], cut[node], left[node] = f, c, len(feature)
            below, above = most.copy(), least.copy()
            below[f] = above[f] = c
            for side in ((own[own[:, f] < c], level + 1, least, below), (own[own[:, f] >= c], level + 1, above, most)):
                stack.append((len(feature), *side))
                feature.append(-1), cut.append(0.0), left.append(0), path.append(float(level + 1))
        made.append((np.array(feature), np.array(cut), np.array(left), np.array(path)))
    return Forest(made, usual_path(size))


@dataclass
class Judge:
    """A forest with its threshold, and the share of labelled bad rows that this rejects."""

    forest: Forest
    threshold: float = 1.01
    caught: float = 0.0

    def scores(self, rows: np.ndarray) -> np.ndarray:
        return self.forest.scores(rows) if self.forest.trees else np.zeros(len(rows))


def score_column(forest: Judge) -> Column:
    @F.pandas_udf("double")
    def score(*stats: pd.Series) -> pd.Series:
        return pd.Series(forest.scores(features({c: s.to_numpy() for c, s in zip(STATISTICS, stats, strict=True)})))

    return score(*STATISTICS)


def fit(stats: DataFrame, labels: DataFrame, tolerance: float = TOLERANCE) -> Judge:
    """Forest and threshold. A row counts as good or bad by its label's quality; of repeated labels
    of one document the lowest holds."""
    quality = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    joined = stats.join(quality, "doc_id").where(~base_failed(F.col("n_words"), F.col("n_repeat_words")))
    known = materialize(joined.select("doc_id", *STATISTICS, "quality"), "labelled")  # numbers, read several times
    order = F.xxhash64("doc_id", *STATISTICS)

    def sample(rows: DataFrame) -> np.ndarray:
        taken = thinned(rows, order, SAMPLE).orderBy(order).limit(SAMPLE).toPandas()
        return features({c: taken[c].to_numpy() for c in STATISTICS})

    good = sample(known.where("quality = 1"))
    rows = good if len(good) else sample(stats.where("n_words > 0"))
    judge = Judge(grow(rows, LOWEST, HIGHEST))
    binned = F.floor(score_column(judge) * BINS).cast("int").alias("bin")
    counts = known.select("quality", binned).groupBy("bin").agg(F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") == 0).alias("bad"))
    judge.threshold, judge.caught = calibrate(counts.collect(), tolerance)  # at most BINS + 1 rows
    return judge


def calibrate(counts: list, tolerance: float) -> tuple[float, float]:
    """The lowest edge above which at most `tolerance` of the good rows lie, and the share of bad rows
    above it. It is midway from the end of the bin that would be too many to the next one taken, or to
    0.5, the score of a usual path, if that comes first. Without good rows 1.01, which rejects nothing."""
    rows = sorted(((r["bin"], r["good"], r["bad"]) for r in counts), reverse=True)
    good, bad = sum(r[1] for r in rows), sum(r[2] for r in rows)
    above = caught = 0
    last = None
    for at, g, b in rows:
        if good and above + g > tolerance * good:
            next_up = min(BINS // 2 if last is None else last, max(BINS // 2, at + 1))
            return (at + 1 + max(next_up, at + 1)) / 2 / BINS, caught / max(bad, 1)
        above, caught, last = above + g, caught + b, at
    return 1.01, 0.0


def judge(stats: DataFrame, forest: Judge) -> DataFrame:
    """stats with base_failed, score and kept."""
    failed = base_failed(F.col("n_words"), F.col("n_repeat_words"))
    scored = stats.withColumn("base_failed", failed).withColumn("score", score_column(forest))
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("score") < forest.threshold))


def keeps(forest: Judge) -> Column:
    """The verdict on a text, for a filter that moves no row."""
    trained = forest

    @F.arrow_udf("boolean")
    def verdict(texts: pa.Array) -> pa.Array:
        kept = []
        for chunk in text_chunks(iter([pa.RecordBatch.from_arrays([texts], ["text"])])):
            found = measure(chunk.column(0))
            failed = (found["n_words"] < 50) | (100 * found["n_repeat_words"] > 50 * found["n_words"])
            kept.append(~failed & (trained.scores(features(found)) < trained.threshold))
        return pa.array(np.concatenate(kept) if kept else np.zeros(0, bool))

    return verdict("text")
