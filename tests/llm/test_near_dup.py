import re
from collections import Counter, defaultdict
from random import Random

import numpy as np
import pytest

from helpers import ODD, documents, text_of
from surgeline.llm.near_dup import near_duplicates, sketches

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(texts, percent):
    sets = {}
    for i, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    where = defaultdict(list)
    for i, s in sets.items():
        for j, c in Counter(j for x in s for j in where[x]).items():
            if 100 * c >= percent * (len(s) + len(sets[j]) - c):
                a, b = sorted((find(i), find(j)))
                root[b] = a
        for x in s:
            where[x].append(i)
    return {i: (len(sets[i]), find(i)) for i in sets}


def edited(words, rate, rng):
    return " ".join(w if rng.random() > rate else f"new{rng.random()}" for w in words.split())


@pytest.mark.parametrize("percent", [80, 85])
def test_same_components_as_all_pairs(spark, percent):
    rng = Random(percent)
    base = [text_of(k, 120) for k in range(4)]
    texts = [(i, edited(base[i % 4], rng.choice([0, 0, 0.005, 0.01, 0.02, 0.04]), rng)) for i in range(160)]
    texts += [(200 + i, text_of(50 + i, 1 + i)) for i in range(12)] + [(300, text_of(50, 1).upper()), (301, "Wa\nwb  wc"), (302, "wa wb Wc")]
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(documents(spark, texts), percent / 100).collect()}
    assert found == brute(texts, percent)


def test_odd_rows_have_defined_results(spark):
    rows = near_duplicates(documents(spark, ODD)).collect()
    found = {r.doc_id: r for r in rows}
    assert len(rows) == len(found) == 6
    assert [found[i].n_shingles for i in (900, 901, 902, 903, 904, 905)] == [0, 0, 0, 1, 1, 1]
    assert all(r.kept and r.component_id == r.doc_id for r in rows)


def test_empty_table(spark):
    assert near_duplicates(documents(spark, [])).count() == 0


def test_sketch_estimates_similarity_and_fills_every_bin():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
    pairs = [(np.sort(pool[:800]), np.sort(pool[200:])), (pool[:1], pool[:1]), (pool[:3], np.sort(pool[1:4]))]
    for a, b in pairs:
        s = sketches([a, b], 140)
        assert (s != np.iinfo(np.uint64).max).all()
        truth = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((s[0] == s[1]).mean() - truth) < 0.17
