"""No text may stop a job or take more time than its length warrants; cases the training tables and
the given tables do not hold."""

import time
import zlib
from random import Random

import numpy as np
import pytest

from helpers import documents
from surgeline.llm import dom, html_text, language, pii, token_counts
from test_texts import LEXICON, base_spans, spoken

LONG = {
    "zeros": "0" * 5000 + ".1.1.1", "digits": "1" * 400_000, "dots": "1." * 100_000, "chain": "1.2.3.4." * 50_000, "card": "1 " * 100_000, "plus": "+1" * 100_000, "at": "a@" * 100_000,
    "streets": " Street" * 50_000, "names": "Abc Street " * 30_000, "numbers": "12 Rd " * 50_000, "calle": "Calle De " * 40_000, "rue": " rue " * 60_000, "cues": "token=ssn iban " * 20_000, "login": "a://b:" * 50_000,
}


@pytest.mark.parametrize("name", LONG)
def test_personal_data_in_proportion_to_length(name):
    took = []
    for part in (LONG[name][: len(LONG[name]) // 4], LONG[name]):
        start = time.process_time()
        pii.find_spans(part)
        took.append(time.process_time() - start)
    assert took[1] < 12 * took[0] + 0.3


def test_base_spans_of_runs_of_digits_and_dots():
    rng = Random(12)
    for _ in range(4000):
        text = "".join(rng.choice(["0", "00", "1", "25", "255", "256", ".", "..", ".", ".", " ", "999"]) for _ in range(rng.randrange(30)))
        assert [s for s in pii.find_spans(text) if s[0] in pii.BASE_KINDS] == base_spans(text)
    assert pii.find_spans("0" * 5000 + ".1.1.1") == [("ip", 0, 5006)]


@pytest.mark.parametrize(
    "text, kind, want",
    [
        ("he lives at 12 Old Mill St. now", "address", "12 Old Mill St."),
        ("at 1200345 Upper Saint Mary Magdalene Church Road", "address", "1200345 Upper Saint Mary Magdalene Church Road"),
        ("Sie wohnt Hauptstraße 12b, Berlin", "address", "Hauptstraße 12b"),
        ("in der Lindenallee 7", "address", "Lindenallee 7"),
        ("au 12 rue de la Paix, Paris", "address", "12 rue de la Paix"),
        ("au 3 bis, avenue de l'Opéra", "address", "3 bis, avenue de l'Opéra"),
        ("vive en Calle Mayor, 15 de Madrid", "address", "Calle Mayor, 15"),
        ("Api_Key = abcd1234efgh5678", "secret", "abcd1234efgh5678"),
        ("my PASSWORD: abcd1234efgh5678", "secret", "abcd1234efgh5678"),
        ("pay to FR76 3000 6000 0112 3456 7890 189 now", "account", "FR76 3000 6000 0112 3456 7890 189"),
        ("pay DE89370400440532013000.", "account", "DE89370400440532013000"),
        ("ftp://me:" + "k9" * 80 + "@host.org", "login", "ftp://me:" + "k9" * 80 + "@host.org"),
        ("Social Security number, as said before: 123-45-6789", "ssn", "123-45-6789"),
        ("İİ Api_Key = abcd1234efgh5678", "secret", "abcd1234efgh5678"),
    ],
)
def test_further_kinds(text, kind, want):
    assert [text[a:b] for k, a, b in pii.find_spans(text) if k == kind] == [want]


@pytest.mark.parametrize("text", ["the Street was long", "5 people on the road", "DE00 3704 0044 0532 0130 00", "rue the day 12 times", "ssn\n123-45-6789", "token = something-without-digits", "Platz da!", "see 12 new roads"])
def test_what_is_no_personal_data(text):
    assert pii.find_spans(text) == []


PAGES = {
    "open tags": "<a " * 30_000, "open quotes": '<a x="' * 20_000, "one end": "<a x='" * 20_000 + ">", "crossed": "<b>" * 20_000 + "</i>" * 20_000, "cells": "<table><tr>" + "<b>" * 10_000 + "<td>" * 10_000,
    "terms": "<dd><ul>" + "<b>" * 10_000 + "<dt></dt>" * 10_000, "comments": "<!--" * 30_000, "scripts": "<script>" * 20_000, "signs": "<" * 100_000, "lists": "<ul><li>" * 10_000,
}


@pytest.mark.parametrize("name", PAGES)
def test_pages_in_proportion_to_length(name):
    took = []
    for part in (PAGES[name][: len(PAGES[name]) // 4], PAGES[name]):
        start = time.process_time()
        dom.parse(part)
        took.append(time.process_time() - start)
    assert took[1] < 12 * took[0] + 0.3


@pytest.fixture(scope="module")
def node_model():
    return html_text.train()


@pytest.mark.parametrize(
    "page, want",
    [
        ('<body><nav><a href=/>Home</a></nav><article><p>See <a href="/x/">the link</a> here, it says a lot of things.</p></article></body>', "See the link here, it says a lot of things."),
        ("<body><nav><a href=/x/>Home</a></nav><h1>Title here</h1><p>A paragraph of text that is long enough, they say.</p><p>See <a href=/x/>the link</a> here.</p><footer>(c)</footer></body>", "Title here\nA paragraph of text that is long enough, they say.\nSee the link here."),
        ('<body><div class="menu-item-post"><h2>Post</h2><p>Some text that belongs to the post, of course.</p><p>More of it, and then some.</p></div></body>', "Some text that belongs to the post, of course.\nMore of it, and then some."),
        ("<body><article><p>a &lt;b&gt; &eacute;&#x41;\n\t c</p><script>if (a < b) {'</p>'}</script><p>Second, with <br/>a break.</p></article></body>", "a <b> éA c\nSecond, with a break."),
    ],
)
def test_pages_unlike_the_given_ones(node_model, page, want):
    assert html_text.extract_texts([page], node_model) == [want]


def test_runs_are_decided_as_one():
    page = dom.parse("<div>a <b>b <i>c</i></b> d<p>e <a>f</a></p>g</div>h")
    first = html_text.runs(page)
    names = {}
    for i, tag in enumerate(page.tag):
        if tag == "#text":
            names.setdefault(int(first[i]), []).append(page.text[i].strip())
    assert sorted(names.values()) == [["a", "b", "c", "d"], ["e", "f"], ["g"], ["h"]]
    keep = html_text.decode_page(page, np.random.default_rng(1).normal(size=len(page.tag)))
    assert all(keep[i] == keep[first[i]] for i in range(len(page.tag)))


def test_pages_empty_table_and_clashing_columns(spark, node_model):
    schema = "page_id long, url string, html string, text string, part string"
    assert html_text.extract_main_text(spark.createDataFrame([], schema), node_model).count() == 0
    rows = [(1, "u", "<article><p>Some text that belongs to it, of course.</p></article>", "x", "y")] * 2
    assert [tuple(r) for r in html_text.extract_main_text(spark.createDataFrame(rows, schema), node_model).collect()] == [(1, "u", "Some text that belongs to it, of course.")] * 2


def test_sections_with_nulls(spark):
    schema = "doc_id long, text string, parts array<struct<start: int, end: int>>, n_tokens int"
    df = spark.createDataFrame([(1, "one two three", [(None, 7), (4, None), None, (-5, 3), (9, 2)], 5), (2, None, [(0, 4), None], 5), (3, "", [], 5)], schema)
    rows = sorted((r.doc_id, r.section, r.start, r.end, r.n_tokens) for r in token_counts.count_tokens(df, "parts").collect())
    assert [r[:4] for r in rows] == [(1, 0, 0, 7), (1, 1, 4, 13), (1, 2, 0, 0), (1, 3, 0, 3), (1, 4, 9, 9), (2, 0, 0, 0), (2, 1, 0, 0)]
    assert rows[2][4] == rows[4][4] == rows[5][4] == 0 and rows[3][4] == 1
    assert token_counts.count_tokens(df.where("false"), "parts").count() == 0


def test_numerals_are_no_letters(spark):
    assert language.words_of("² ½ Ⅷ 12 _ \u0660") == [] and language.words_of("m² Abc½def 漢字") == ["m", "abc", "def", "漢字"]
    rng = Random(4)
    docs = documents(spark, [(i, spoken("xx", 20, rng)) for i in range(40)], lang="xx").unionByName(documents(spark, [(100 + i, spoken("yy", 20, rng)) for i in range(40)], lang="yy"))
    model = language.fit(docs)
    found = {r.doc_id: (r.lang_pred, r.score) for r in language.predict_languages(documents(spark, [(1, "² ½"), (2, "Ⅷ"), (3, "alba ²")]), model).collect()}
    assert found[1] == found[2] == ("und", 0.0) and found[3][0] == "xx"
    assert language.predict_languages(documents(spark, []), model).count() == 0


def test_sample_of_a_table_of_copies_and_of_a_rare_language(spark):
    """20,000 rows of two texts, and one language with two rows among them."""
    rng = Random(9)
    common = [spoken("xx", 50, rng) for _ in range(2)]
    rows = [(i, common[i % 2], "xx") for i in range(20_000)] + [(k, spoken("yy", 50, rng), "yy") for k in range(30_000, 30_200) if zlib.crc32(str(k).encode()) % 5][:2]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(df, sample=20)
    assert model.labels == ["xx", "yy"]
    found = {r.doc_id: r.lang_pred for r in language.predict_languages(df.where("doc_id < 5 or doc_id >= 30000"), model).collect()}
    assert {found[i] for i in range(5)} == {"xx"} and {v for k, v in found.items() if k >= 30_000} == {"yy"}


def test_many_labels_and_groups_of_segments(monkeypatch):
    """The same probabilities whether step matrices are held at once or in groups."""
    rng = Random(8)
    model = language.train([(spoken(lang, 40, rng), lang) for lang in ("xx", "yy") * 20])
    texts = [spoken("xx", n, rng).split() for n in (1, 40, 500, 3, 64)] + [[]]
    whole = model.marginals(texts)
    monkeypatch.setattr(language, "STEP_VALUES", language.SEGMENT * 4 * 3)
    assert all(np.allclose(a, b) for a, b in zip(whole, model.marginals(texts), strict=True))
    labels = [f"l{i:03d}" for i in range(60)]
    many = language.Crf(labels, np.random.default_rng(1).normal(size=(60, language.BUCKETS)) * 0.1, np.zeros((60, 60)))
    assert np.allclose(many.marginals([list(LEXICON["xx"]) * 40])[0].sum(axis=1), 1)
