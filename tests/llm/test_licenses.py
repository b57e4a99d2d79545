"""License scans against a search over every span of every text."""

from random import Random

from helpers import documents, text_of
from surgeline.llm import licenses as lc

SOME = {k: lc.TEMPLATES[k] for k in ("MIT", "Apache-2.0-header", "GPL-header", "LGPL-header", "CC-BY-4.0")}


def shingles(words, size=5):
    return [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)]


def plain(text, template, threshold=0.8):
    """(start, n, containment) of the best window as long as the operator's, else of the shortest span
    within three times the template that holds enough; by enumeration of all."""
    words, wanted = lc.template_words(text), lc.template_words(template)
    n, step = len(wanted), max(1, len(wanted) // 8)
    target, own = set(shingles(wanted)), shingles(words)
    windows = [(len(target & set(own[a : a + n + step - 5])) / len(target), -a) for a in range(0, len(words), step)]
    held, at = max(windows, default=(0, 0))
    if held >= threshold - 1e-9:
        return -at, n, round(held, 6)
    spans = []
    for a in range(len(own)):
        for b in range(a, min(len(own), a + int(n * 3) - 5 + 1)):
            share = len(target & set(own[a : b + 1])) / len(target)
            if share >= threshold - 1e-9:
                spans.append((b - a + 5, a, share))
                break
    return (min(spans)[1], min(spans)[0], round(min(spans)[2], 6)) if spans else None


def test_equal_to_all_spans(spark):
    rng = Random(5)
    docs = []
    for i in range(120):
        words = []
        for _ in range(rng.randint(1, 3)):
            notice = lc.template_words(rng.choice(list(SOME.values())))
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                at = rng.randrange(len(notice) + 1)
                if rng.random() < 0.5:
                    notice = notice[:at] + text_of(rng.randrange(999), rng.choice([1, 2, 6, 25])).split() + notice[at:]
                else:
                    notice = notice[: max(at, 1)] + notice[at + rng.randint(1, 4) :]
            words += text_of(rng.randrange(999), rng.randint(0, 40)).split() + notice
        docs.append((i, " ".join(words + ["license"] * rng.randint(0, 2))))
    found = {(r.doc_id, r.license): (r.start_word, r.n_words, r.containment) for r in lc.find_licenses(documents(spark, docs), SOME).collect()}
    want = {(i, k): p for i, text in docs for k, t in SOME.items() if (p := plain(text, t))}
    assert found == want and len(want) > 60 and any(n not in {len(lc.template_words(t)) for t in SOME.values()} for _, n, _ in want.values())


def test_halves_far_apart_are_no_passage(spark):
    notice = lc.template_words(lc.TEMPLATES["GPL-header"])
    far = text_of(8, 3000).split()
    docs = [(1, " ".join([*notice[:18], *far, *notice[10:]])), (2, " ".join([*notice[:14], "one", "two", *notice[14:], *far, *notice[:12], "and", *notice[12:]]))]
    found = {r.doc_id: (r.start_word, r.n_words) for r in lc.find_licenses(documents(spark, docs)).collect() if r.license == "GPL-header"}
    assert 1 not in found and found[2][1] < 40


def test_a_long_text_full_of_cues(spark):
    """20,000 words, every twentieth a cue: rows of hashes, none with the text."""
    words = text_of(3, 20_000).split()
    words[::20] = ["license"] * len(words[::20])
    words[9000:9000] = lc.template_words(lc.TEMPLATES["MPL-2.0"])
    df = lc.find_licenses(documents(spark, [(1, " ".join(words))]))
    assert [(r.license, 8950 < r.start_word <= 9000, r.containment) for r in df.collect()] == [("MPL-2.0", True, 1.0)]


def test_whole_licenses_are_listed():
    lengths = [len(lc.template_words(t)) for t in lc.TEMPLATES.values()]
    assert len(lengths) >= 20 and max(lengths) > 80 and sum(n > 25 for n in lengths) >= 9
