"""Fingerprints against plain Python over all documents."""

import hashlib
import re
from collections import Counter
from random import Random

import numpy as np
import pytest

from helpers import ODD, documents, text_of
from surgeline.llm import fingerprints as fp
from surgeline.llm.wordscan import mix

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return set(WORD.findall((text or "").translate(LOWER)))


def hashes(words):
    return np.sort(np.array([fp.term_sets([w])[0][0] for w in words], np.uint64))


def plain(rows, low, high):
    """rows: (doc_id, text) in order."""
    count = Counter(t for _, text in rows for t in terms(text))
    band = hashes([t for t, c in count.items() if low * len(rows) <= c <= high * len(rows)])
    out = {}
    for k, (i, text) in enumerate(rows):
        text, after = text or "", rows[(k + 1) % len(rows)][1] or ""
        cut = len(text) // 4
        new = text[: len(text) - cut] + after[:cut]
        prints = [fp.fingerprint(hashes(terms(t)), band) for t in (text, new, after)]
        out[i] = (len(text), hashlib.sha256(new.encode()).hexdigest(), *prints[:2], fp.likeness(prints[0], prints[1]), fp.likeness(prints[0], prints[2]))
    return out


def words(seed, n):
    rng = Random(seed)
    return " ".join(rng.choice(["Bal", "kor", "mi", "ta"]) + rng.choice(["no", "ri", "s."]) + str(int(rng.paretovariate(0.5)) % 500) for _ in range(n))


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_equal_to_plain_python_wherever_the_seams_lie(spark, partitions):
    rows = sorted([(i * 3, words(i, i % 90)) for i in range(120)] + [(i * 3 + 1, words(5, 60)) for i in range(4)], key=lambda r: r[0])
    rows = [(None, "no id at all"), *rows, (900, None), (901, ""), (902, " \t\n "), (903, "one"), (904, "ü" * 50_000)]
    want = plain(rows, 0.02, 0.5)
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = fp.fingerprints(documents(spark, rows), 0.02, 0.5).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {r.doc_id: tuple(r)[1:] for r in found} == want and len(found) == len(rows)


def test_lexicon_counts_each_document_once(spark, monkeypatch):
    monkeypatch.setattr(fp, "HELD_TERMS", 50)
    texts = [words(i, 40) + " twice twice" for i in range(60)]
    count = Counter(t for text in texts for t in terms(text))
    band = {t for t, c in count.items() if 0.05 * 60 <= c <= 0.4 * 60}
    assert fp.lexicon(documents(spark, list(enumerate(texts))), 0.05, 0.4).tolist() == hashes(band).tolist()
    batch = documents(spark, list(enumerate(texts))).select("text").toArrow().to_batches()
    assert fp.lexicon(documents(spark, list(enumerate(texts))), 0.05, 0.4, candidates=3).tolist() == hashes(band).tolist()
    parts = list(fp._count_batches(iter(batch * 3), 0.0, None))
    summed = Counter()
    for p in parts:
        summed.update(dict(zip(*p.to_pydict().values(), strict=True)))
    assert len(parts) > 1 and summed == {int(hashes([t]).view(np.int64)[0]): 3 * c for t, c in count.items()}


def test_likeness_follows_the_share_of_common_terms():
    rng = np.random.default_rng(1)
    pool = np.unique(mix(rng.integers(0, 1 << 62, 4000).astype(np.uint64)))
    last = 1.01
    for common in (1.0, 0.95, 0.8, 0.5, 0.2, 0.0):
        found = []
        for k in range(30):
            own = rng.choice(pool, 400, replace=False)
            a, b = np.sort(own[:200]), np.sort(np.concatenate([own[: int(200 * common)], own[200 : 400 - int(200 * common)]]))
            found.append(fp.likeness(fp.fingerprint(a, pool), fp.fingerprint(b, pool)))
        assert np.mean(found) < last
        last = np.mean(found) - 0.02
    assert np.mean(found) < 0.05


def test_levels_that_differ_and_texts_without_terms():
    pool = np.arange(1, 5000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    pool.sort()
    small, larger, other = (fp.fingerprint(pool[:n], pool) for n in (60, 70, 1000))
    assert fp.likeness(small, larger) > 0.5 and fp.likeness(larger, small) == fp.likeness(small, larger) and fp.likeness(small, other) == 0.0
    assert fp.likeness("-", "-") == 1.0 and fp.likeness("-", small) == fp.likeness(small, "-") == 0.0
    assert fp.fingerprint(pool[:0], pool) == "-" and fp.fingerprint(pool[:3], pool[9:])[0] == "a"


def test_empty_single_and_repeated_documents(spark):
    assert fp.fingerprints(documents(spark, [])).count() == 0
    row = fp.fingerprints(documents(spark, [(7, "A b c d e f g h")])).first()
    assert (row.n_chars, row.near_next) == (15, 1.0) and row.edited_sha256 == hashlib.sha256(b"A b c d e f A b").hexdigest()
    texts = [(i, text_of(3, 50)) for i in range(6)] + ODD
    rows = fp.fingerprints(documents(spark, texts)).collect()
    assert len(rows) == len(texts) and len({r.fingerprint for r in rows if r.doc_id is not None and r.doc_id < 6}) == 1
