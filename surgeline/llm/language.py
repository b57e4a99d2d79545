"""Language of words and documents by a linear-chain conditional random field.

A word (a run of letters, in lower case) has features: itself (lexicon), affixes of one to three
letters and its 2- and 3-grams, hashed. Feature weights and label transitions are learned together
from code-switched sequences made of pieces of labelled documents. The training sample is bounded: of
each language at most SAMPLE distinct texts, the first by a hash of their content, and of each text
TRAINING_CHARS characters, drawn as LINES pieces spread over it. Copies count once and each language is
drawn by itself, so neither repetition nor a rare language empties it at any size. Forward-backward
gives each word's probabilities; a document's language is the one with the highest average, the average
its score.

Long chains are cut into segments of SEGMENT words: a segment's product of step matrices carries the
forward and backward messages over it, which gives the same probabilities as one long walk. Segments are
worked off in groups of bounded size. A null text or one without a letter is `und` with score 0. Ties go to the first label in order. Without
training rows every text is `und`. Rows are handled one by one; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_chunks

BUCKETS = 1 << 17
SAMPLE = 300  # texts of a language
TRAINING_CHARS, LINES = 4000, 8
STEP_VALUES = 1 << 21  # numbers of step matrices held at once
PIECE, SEQUENCE, SEGMENT = 20, 60, 32
CACHE_WORDS = 400_000  # bounds memory
WORD = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"


def words_of(text: str | None) -> list[str]:
    """Runs of letters, in lower case. Superscripts, fractions and other numerals that count as word
    characters are no letters."""
    found = WORD.findall(text.lower()) if text else []
    if all(map(str.isalpha, found)):
        return found
    return [part for w in found for part in "".join(c if c.isalpha() else " " for c in w).split()]


def features(word: str) -> list[int]:
    framed = f"^{word}$"
    found = [framed, *(f"<{word[:k]}" for k in (1, 2, 3)), *(f">{word[-k:]}" for k in (1, 2, 3))]
    found += [framed[i : i + 2] for i in range(len(framed) - 1)]
    found += [framed[i : i + 3] for i in range(len(framed) - 2)]
    return [zlib.crc32(f.encode()) % BUCKETS for f in found]


def emissions(words: list[str], weights: np.ndarray) -> np.ndarray:
    grams = [features(w) for w in words]
    owner = np.repeat(np.arange(len(words)), [len(g) for g in grams])
    flat = np.fromiter((f for g in grams for f in g), np.int64, len(owner))
    return np.column_stack([np.bincount(owner, row[flat], len(words)) for row in weights]) if words else np.zeros((0, len(weights)))


@dataclass
class Crf:
    labels: list[str]
    weights: np.ndarray  # label, bucket
    moves: np.ndarray  # log potentials, from label to label
    known: dict[str, int] = field(default_factory=dict, repr=False)
    table: np.ndarray | None = field(default=None, repr=False)

    def __getstate__(self):
        return {"labels": self.labels, "weights": self.weights, "moves": self.moves, "known": {}, "table": None}

    def scores(self, words: list[str]) -> np.ndarray:
        """Emission of each word, relative to the word's best label."""
        if self.table is None or len(self.known) > CACHE_WORDS:
            self.known, self.table = {}, np.zeros((0, len(self.labels)))
        fresh = list(dict.fromkeys(w for w in words if w not in self.known))
        if fresh:
            e = emissions(fresh, self.weights)
            self.known.update(zip(fresh, range(len(self.known), len(self.known) + len(fresh)), strict=True))
            self.table = np.concatenate([self.table, np.exp(e - e.max(axis=1, keepdims=True))])
        known = self.known
        return self.table[np.fromiter((known[w] for w in words), np.int64, len(words))]

    def marginals(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Label probabilities of each word of each text."""
        lengths = np.array([len(t) for t in texts], np.int64)
        size, total = len(self.labels), int(lengths.sum())
        if not total or not size:
            return [np.zeros((len(t), size)) for t in texts]
        e = self.scores([w for t in texts for w in t])
        text_of = np.repeat(np.arange(len(texts)), lengths)
        place = np.arange(total) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        counts = -(-lengths // SEGMENT)
        first = np.cumsum(counts) - counts
        segment, slot = first[text_of] + place // SEGMENT, place % SEGMENT
        move, segments = np.exp(self.moves - self.moves.max()), int(counts.sum())
        group = max(1, STEP_VALUES // (SEGMENT * size * size))
        edges = np.searchsorted(segment, range(0, segments + group, group))  # of words, which come by segments

        def steps_of(g: int) -> np.ndarray:
            """Step matrices of a group of segments."""
            part = slice(edges[g], edges[g + 1])
            base, n = g * group, min(group, segments - g * group)
            steps = np.broadcast_to(np.eye(size), (n, SEGMENT, size, size)).copy()
            steps[segment[part] - base, slot[part]] = move[None] * e[part][:, None, :]
            first_words = np.flatnonzero(place[part] == 0) + edges[g]
            steps[segment[first_words] - base, slot[first_words]] = np.broadcast_to(e[first_words][:, None, :], (len(first_words), size, size))
            return steps

        groups, held = len(edges) - 1, {}
        products = []
        for g in range(groups):
            steps = steps_of(g)
            held = {g: steps} if groups == 1 else {}
            product = steps[:, 0]
            for k in range(1, SEGMENT):
                product = product @ steps[:, k]
            products.append(product / np.maximum(product.max(axis=(1, 2), keepdims=True), 1e-300))
        product = np.concatenate(products)

        entering = np.full((segments, size), 1.0 / size)
        leaving = np.ones((segments, size))
        for k in range(1, int(counts.max())):
            at = first[counts > k] + k
            carried = np.einsum("bi,bij->bj", entering[at - 1], product[at - 1])
            entering[at] = carried / carried.sum(axis=1, keepdims=True)
        for k in range(int(counts.max()) - 2, -1, -1):
            at = first[counts > k + 1] + k
            carried = np.einsum("bij,bj->bi", product[at + 1], leaving[at + 1])
            leaving[at] = carried / carried.sum(axis=1, keepdims=True)

        joint = np.empty((total, size))
        for g in range(groups):
            steps = held[g] if g in held else steps_of(g)
            mine, words = slice(g * group, g * group + len(steps)), slice(edges[g], edges[g + 1])
            alphas, betas = np.empty((SEGMENT, len(steps), size)), np.empty((SEGMENT, len(steps), size))
            alpha, beta = entering[mine, None, :], leaving[mine, :, None]
            for k in range(SEGMENT):
                alpha = alpha @ steps[:, k]
                alphas[k] = alpha[:, 0]
            for k in range(SEGMENT - 1, -1, -1):
                betas[k] = beta[:, :, 0]
                beta = steps[:, k] @ beta
            joint[words] = alphas[slot[words], segment[words] - g * group] * betas[slot[words], segment[words] - g * group]
        joint /= np.maximum(joint.sum(axis=1, keepdims=True), 1e-300)
        return np.split(joint, np.cumsum(lengths)[:-1])

    def language(self, marginals: np.ndarray) -> tuple[str, float]:
        if not len(marginals) or not self.labels:
            return UNKNOWN, 0.0
        mean = marginals.mean(axis=0)
        best = int(mean.argmax())
        return self.labels[best], float(min(1.0, mean[best]))


def sequences(samples: list[tuple[str, str]], labels: list[str], seed: int = 11) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Word types, and word and label numbers of code-switched sequences of equal length."""
    rng = np.random.default_rng(seed)
    number: dict[str, int] = {}
    pieces = []
    for text, lang in samples:
        own = [number.setdefault(w, len(number)) for w in words_of(text)]
        pieces += [(own[i : i + PIECE], labels.index(lang)) for i in range(0, len(own), PIECE)]
    order = rng.permutation(len(pieces))
    words = np.array([w for k in order for w in pieces[k][0]], np.int64)
    marks = np.array([pieces[k][1] for k in order for _ in pieces[k][0]], np.int64)
    full = len(words) // SEQUENCE * SEQUENCE
    if not full:
        return list(number), words[None, :], marks[None, :]
    return list(number), words[:full].reshape(-1, SEQUENCE), marks[:full].reshape(-1, SEQUENCE)


def train(samples: list[tuple[str, str]], rounds: int = 30, rate: float = 0.15, penalty: float = 1e-5) -> Crf:
    """Maximum conditional likelihood by full-batch gradient steps (Adam); deterministic."""
    labels = sorted({lang for _, lang in samples})
    size = len(labels)
    types, words, marks = sequences(samples, labels)
    if not types or not words.size:
        return Crf([], np.zeros((0, BUCKETS)), np.zeros((0, 0)))
    grams = [features(w) for w in types]
    owner = np.repeat(np.arange(len(types)), [len(g) for g in grams])
    flat = np.fromiter((f for g in grams for f in g), np.int64, len(owner))
    weights, moves = np.zeros((size, BUCKETS)), np.zeros((size, size))
    state = [np.zeros_like(weights), np.zeros_like(weights), np.zeros_like(moves), np.zeros_like(moves)]
    seen = np.zeros((len(types), size))
    np.add.at(seen, (words.ravel(), marks.ravel()), 1.0)
    seen_moves = np.zeros((size, size))
    np.add.at(seen_moves, (marks[:, :-1].ravel(), marks[:, 1:].ravel()), 1.0)
    count, length = words.shape
    for step in range(1, rounds + 1):
        e = np.column_stack([np.bincount(owner, row[flat], len(types)) for row in weights])
        e = np.exp(e - e.max(axis=1, keepdims=True))
        a = np.exp(moves - moves.max())
        seq = e[words]
        alpha, beta = np.empty((length, count, size)), np.ones((length, count, size))
        for t in range(length):
            value = (alpha[t - 1] @ a if t else 1.0) * seq[:, t]
            alpha[t] = value / value.sum(axis=1, keepdims=True)
        for t in range(length - 2, -1, -1):
            value = (seq[:, t + 1] * beta[t + 1]) @ a.T
            beta[t] = value / value.sum(axis=1, keepdims=True)
        joint = alpha * beta
        joint /= joint.sum(axis=2, keepdims=True)
        expected = np.column_stack([np.bincount(words.T.ravel(), joint[:, :, k].ravel(), len(types)) for k in range(size)])
        pair = alpha[:-1, :, :, None] * a[None, None] * (np.moveaxis(seq, 1, 0)[1:] * beta[1:])[:, :, None, :]
        pair /= pair.sum(axis=(2, 3), keepdims=True)
        slope = np.stack([np.bincount(flat, (seen - expected)[owner, k], BUCKETS) for k in range(size)]) / count - penalty * weights
        slope_moves = (seen_moves - pair.sum(axis=(0, 1))) / count - penalty * moves
        for value, gradient, m, v in ((weights, slope, state[0], state[1]), (moves, slope_moves, state[2], state[3])):
            m += 0.1 * (gradient - m)
            v += 0.01 * (gradient**2 - v)
            value += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Crf(labels, weights, moves)


def held_out() -> str:
    return "crc32(cast(doc_id AS string)) % 5 = 0"


def fit(docs: DataFrame, sample: int = SAMPLE) -> Crf:
    """Learns from documents that are not held out and have a text, an id and a language.

    Only hashes are shuffled to find the texts, of which each task passes on at most `sample` of a
    language (window group limit). The driver gets languages * sample * TRAINING_CHARS characters.
    """
    usable = docs.select("doc_id", "text", "lang").where(f"lang is not null and text is not null and doc_id is not null and not ({held_out()})")
    hashed = usable.select("lang", F.xxhash64("text").alias("_hash"), "text")
    ranked = hashed.select("lang", "_hash").distinct().withColumn("_rank", F.row_number().over(Window.partitionBy("lang").orderBy("_hash")))
    drawn = F.broadcast(ranked.where(F.col("_rank") <= sample).select("lang", "_hash"))  # languages * sample rows
    parts = hashed.join(drawn, ["lang", "_hash"]).groupBy("lang", "_hash").agg(F.min(pieces("text")).alias("text"))
    chosen = parts.orderBy("lang", "_hash").collect()
    return train([(r["text"], r["lang"]) for r in chosen])


def pieces(text: str) -> Column:
    """A text of at most TRAINING_CHARS characters, or LINES pieces spread evenly over a longer one."""
    size = TRAINING_CHARS // LINES
    starts = [F.floor(F.length(text) * k / LINES).cast("int") + 1 for k in range(LINES)]
    spread = F.concat_ws(" ", *[F.substring(F.col(text), at, F.lit(size)) for at in starts])
    return F.when(F.length(text) <= TRAINING_CHARS, F.col(text)).otherwise(spread)


def predict_languages(docs: DataFrame, model: Crf) -> DataFrame:
    """(doc_id, lang_pred, score) of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = shared.value
        for batch in text_chunks(batches):
            found = [crf.language(m) for m in crf.marginals([words_of(t) for t in batch.column(1).to_pylist()])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def language_runs(docs: DataFrame, model: Crf) -> DataFrame:
    """(doc_id, first_word, n_words, lang): runs of words whose most probable label is the same."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = shared.value
        for batch in text_chunks(batches):
            out = []
            for i, m in zip(batch.column(0).to_pylist(), crf.marginals([words_of(t) for t in batch.column(1).to_pylist()]), strict=True):
                best = m.argmax(axis=1) if len(m) and crf.labels else np.zeros(0, int)
                cuts = np.flatnonzero(np.diff(best)) + 1
                for a, b in zip([0, *cuts], [*cuts, len(best)], strict=True):
                    if b > a:
                        out.append({"doc_id": i, "first_word": int(a), "n_words": int(b - a), "lang": crf.labels[best[a]]})
            schema = pa.schema([("doc_id", pa.int64()), ("first_word", pa.int32()), ("n_words", pa.int32()), ("lang", pa.string())])
            yield pa.RecordBatch.from_pylist(out, schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, first_word int, n_words int, lang string")
