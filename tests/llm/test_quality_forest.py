"""The forest must reject kinds of text that no label holds, and leave ordinary ones alone."""

import numpy as np
import pyarrow as pa

from helpers import documents, text_of
from surgeline.llm import quality


def prose(seed, words):
    raw = text_of(seed, words).split()
    return "".join(w.capitalize() + " " if k % 12 == 0 else w + (".\n" if k % 12 == 11 else " ") for k, w in enumerate(raw))


KINDS = {
    "capitals": lambda t: t.upper(),
    "digits": lambda t: " ".join("8" * len(w) for w in t.split()),
    "marks": lambda t: " ".join(w + "..!?" for w in t.split()),
    "letters": lambda t: " ".join(w[0] for w in t.split()),
    "lines": lambda t: "\n".join(line for line in t.split("\n") for _ in range(2)),
    "all": lambda t: " ".join(w.upper() + "7.!" for w in t.split()),
    "symbols": lambda t: " ".join(w + "#" for w in t.split()),
    "joined": lambda t: " ".join(w * 12 for w in t.split()),
}


def test_kinds_without_a_label_are_rejected(spark):
    good = [(i, prose(i, 60 + 17 * (i % 40))) for i in range(400)]
    odd = [(1000 + k, f(prose(7000 + k, 300))) for k, f in enumerate(KINDS.values())]
    fresh = [(2000 + i, prose(9000 + i, 70 + 31 * i)) for i in range(60)]
    docs = documents(spark, [*good, *odd, *fresh])
    labels = spark.createDataFrame([(i, 1) for i in range(300)], "doc_id long, quality int")  # not one bad label
    stats = quality.rule_statistics(docs)
    judge = quality.fit(stats, labels)
    rows = {r.doc_id: r for r in quality.judge(stats, judge).collect()}
    assert not [list(KINDS)[i - 1000] for i in rows if 1000 <= i < 2000 and rows[i].kept and not rows[i].base_failed]
    assert sum(rows[i].kept for i, _ in fresh) >= 58 and sum(rows[i].kept for i, _ in good) >= 396


def test_threshold_rejects_the_share_allowed():
    counts = [{"bin": b, "good": g, "bad": x} for b, g, x in ((100, 900, 0), (300, 98, 1), (500, 2, 3), (700, 0, 6))]
    assert quality.calibrate(counts, 0.0) == ((501 + 700) / 2 / quality.BINS, 0.6)
    assert quality.calibrate(counts, 0.002) == ((301 + 500) / 2 / quality.BINS, 0.9)
    assert quality.calibrate(counts[:1], 0.0) == ((101 + 1000) / 2 / quality.BINS, 0.0) and quality.calibrate([], 0.1) == (1.01, 0.0)


def test_path_lengths_of_a_small_forest_by_hand():
    """One tree, one ratio: depth plus the usual path of what a leaf still holds."""
    rng = np.random.default_rng(3)
    rows = rng.uniform(0.4, 0.5, size=(64, 1))
    forest = quality.grow(rows, np.zeros(1), np.ones(1), trees=60, subsample=64)
    far, near = forest.scores(np.array([[0.95]])), forest.scores(np.array([[0.45]]))
    assert far > 0.6 > near and np.isclose(quality.usual_path(2), 2 * 0.5772156649015329 - 1)
    found = quality.measure(pa.array([None, "", "A b"]))
    assert quality.features(found).shape == (3, 7) and (quality.features(found) <= quality.HIGHEST).all()
