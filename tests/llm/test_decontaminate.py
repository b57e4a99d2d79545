import re
from collections import Counter
from random import Random

from helpers import ODD, documents, text_of
from surgeline.llm.decontaminate import contaminated, grid_suffices

ITEMS = "item_id long, text string"


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())


def grams(w, k):
    return Counter(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1)))


def brute(docs, items, threshold=0.8):
    found = set()
    for i, t in items:
        w = words(t)
        if not w:
            continue
        k = min(5, len(w))
        own = grams(w, k)
        for d, text in docs:
            v = words(text)
            for s in range(max(1, len(v) - len(w) + 1)) if len(v) >= k and d is not None else ():
                other = grams(v[s : s + len(w)], k)
                if sum((own & other).values()) >= threshold * sum((own | other).values()) - 1e-9:
                    found.add((d, i))
    return found


def test_same_matches_as_every_window(spark):
    items = [(k, text_of(500 + k, n)) for k, n in enumerate([1, 3, 4, 5, 7, 9, 13, 14, 20, 40, 59])] + [(50, None), (51, " "), (52, text_of(508, 20))]
    docs = []
    for k, (_, t) in enumerate(items[:11]):
        lead, tail = text_of(k, 3 + k), text_of(k + 40, 17)
        docs += [(k, f"{lead} {t} {tail}"), (20 + k, f"{lead}\n{t.upper()}\t {tail}"), (40 + k, t)]
        w = t.split()
        if len(w) > 30:
            docs += [(60 + k, f"{lead} {' '.join(w[:15])} changed {' '.join(w[16:])} {tail}"), (80 + k, " ".join(w[: len(w) // 2]))]
    docs += [(99, text_of(77, 300))]
    frame = spark.createDataFrame(items, ITEMS)
    found = contaminated(documents(spark, docs), frame).collect()
    assert {(r.doc_id, r.item_id) for r in found} == brute(docs, items)
    assert all(r.shared <= r.total for r in found)


def test_reordered_items_are_found(spark):
    """Halves or thirds swapped, pieces moved, and as much that falls just short."""
    rng = Random(6)
    items = [(k, text_of(500 + k, n)) for k, n in enumerate([40, 60, 80, 120, 200])]
    docs = []
    for k, (_, t) in enumerate(items):
        w = t.split()
        for cut in (2, 3, 5, 8):
            for _ in range(4):
                edges = sorted(rng.sample(range(1, len(w)), cut - 1))
                parts = [w[a:b] for a, b in zip([0, *edges], [*edges, len(w)], strict=True)]
                rng.shuffle(parts)
                docs.append((len(docs), " ".join([*text_of(k, rng.randrange(30)).split(), *[x for p in parts for x in p], *text_of(k + 9, rng.randrange(30)).split()])))
    w = items[2][1].split()
    docs.append((900, " ".join([*text_of(1, 20).split(), *w[40:], *w[:40], *text_of(2, 20).split()])))
    found = {(r.doc_id, r.item_id): r.start_word for r in contaminated(documents(spark, docs), spark.createDataFrame(items, ITEMS)).collect()}
    want = brute(docs, items)
    assert found.keys() == want and found[900, 2] == 20 and 20 < len(want) < len(docs)


def test_either_side_may_be_listed(spark):
    """More items than windows, and fewer."""
    items = [(k, text_of(500 + k, 20)) for k in range(30)]
    few = [(1, f"{text_of(1, 9)} {items[3][1]} {text_of(2, 9)}")]
    many = [(k, f"{text_of(k, 9)} {items[k % 2][1]} {text_of(k + 50, 9)}") for k in range(60)]
    for docs, listed in ((few, items), (many, items[:2])):
        found = contaminated(documents(spark, docs), spark.createDataFrame(listed, ITEMS)).collect()
        assert {(r.doc_id, r.item_id) for r in found} == brute(docs, listed)


def test_odd_rows_and_empty_tables(spark):
    items = spark.createDataFrame([(1, "same text here twice")], ITEMS)
    assert {(r.doc_id, r.item_id) for r in contaminated(documents(spark, ODD), items).collect()} == {(905, 1)}
    assert contaminated(documents(spark, []), items).count() == 0
    assert contaminated(documents(spark, ODD), items.where("false")).count() == 0


def test_one_lookup_in_five_is_enough_but_for_short_items():
    assert [n for n in range(5, 40) if not grid_suffices(n, 5, 0.8)] == [5, 6, 7, 8, 13]


def test_no_python_in_the_plan(spark):
    items = spark.createDataFrame([(1, text_of(3, 20))], ITEMS)
    plan = contaminated(documents(spark, [(1, text_of(3, 20))]), items)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
