"""Benchmark passages in documents, by SimHash of item-sized windows. DataFrame functions only.

A document window of as many words as a benchmark item matches it when the weighted Jaccard
similarity of their word shingles (weights are counts) reaches `threshold`. Steps:

1. Documents that can hold such a window: a window that similar shares all but a known number of its
   shingles, so that one of its shingles at every fifth word must be one of the benchmark's. Only one
   shingle in five is therefore looked up. Items too short for this bound switch the lookup to every
   word; nothing is lost either way.
2. In these documents, a window can match an item of its size only if so many of its shingles are
   among those of the items of this size as the similarity needs. The starts of all such windows follow
   from the sorted places of these shingles, whatever their order; every one is taken.
3. Each window gets a 64-bit SimHash. Multi-index Hamming blocks (four of 16 bits, each item of items
   and windows the smaller side is listed under every value within floor(radius / 4) bits) find all items of the window's size within
   `radius`. A similarity of 0.8 is 10 bits on average, 19 with a chance above 0.999.
4. The exact weighted similarity of the shingles decides; the best window of each pair is reported.

Words are runs of anything but white space, in lower case. An item of fewer than five words is one
shingle, found as that sequence of words. Items without words and rows with a null text or id match
nothing. Rows of one doc_id are one document, which matches if one of its texts does. Ties go to the
first window. Only the needed columns are read; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import checked_broadcast

SHINGLE, THRESHOLD, RADIUS = 5, 0.8, 19
BLOCKS, BLOCK_BITS = 4, 16


def normalized(text: Column) -> Column:
    """Lower case, words parted by one space."""
    return F.trim(F.regexp_replace(F.lower(text), r"[\x20\x09-\x0D]+", " "))


def word_count(text: Column) -> Column:
    return F.when(text == "", 0).otherwise(F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit(""))) + 1)


def grams(words: str, size: str) -> Column:
    """Runs of `size` words of an array; of fewer words the whole sequence."""
    return F.expr(
        f"transform(sequence(1, greatest(size({words}) - {size} + 1, 1)), i -> array_join(slice({words}, i, least({size}, size({words}))), ' '))"
    )


def benchmark_items(benchmark: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(item_id, words, n, size, shingles) of the items that have words."""
    clean = benchmark.select("item_id", normalized(F.col("text")).alias("clean")).where("item_id is not null and clean <> ''")
    sized = clean.select("item_id", F.split("clean", " ").alias("words")).withColumn("n", F.size("words"))
    return sized.withColumn("size", F.least(F.lit(shingle), F.col("n"))).withColumn("shingles", grams("words", "size"))


def grid_suffices(n: int, shingle: int, threshold: float) -> bool:
    """Whether an n-word window that matches must share a shingle that starts at a multiple of the
    shingle's size."""
    shingles = n - shingle + 1
    different = shingles - math.ceil(2 * threshold / (1 + threshold) * shingles - 1e-9)
    return shingles > 0 and shingles // shingle > different


def simhash(shingles: str) -> Column:
    """Bit b is set if it is in more than half of the shingles' hashes."""
    return F.expr(
        f"aggregate(sequence(0, 63), 0L, (sum, b) -> sum | if(2 * aggregate(transform({shingles}, s -> xxhash64(s)), 0L,"
        f" (set, h) -> set + (shiftrightunsigned(h, b) & 1L)) > size({shingles}), shiftleft(1L, b), 0L))"
    )


def block_values(fingerprint: str) -> Column:
    return F.expr(f"transform(sequence(0, {BLOCKS - 1}), k -> struct(k, shiftrightunsigned({fingerprint}, k * {BLOCK_BITS}) & {(1 << BLOCK_BITS) - 1}L as value))")


def masks_within(bits: int) -> Column:
    """All block masks of at most so many bits, as a constant array."""
    masks = [m for m in range(1 << BLOCK_BITS) if m.bit_count() <= bits]
    return F.from_json(F.lit(str(masks)), "array<bigint>")


def _listed(prints: DataFrame, fingerprint: str, radius: int) -> DataFrame:
    """Each row under the value of each of its blocks, or under all values within floor(radius / 4)
    bits of it."""
    rows = prints.withColumn("at", F.explode(block_values(fingerprint))).select(*prints.columns, "at.k", "at.value")
    if not radius:
        return rows
    masked = rows.withColumn("mask", F.explode(masks_within(radius // BLOCKS)))
    return masked.withColumn("value", F.col("value").bitwiseXOR(F.col("mask"))).drop("mask")


def window_starts(threshold: float) -> Column:
    """Starts of the windows of n words that hold enough of the places `at` of shingles, sorted, in a
    text of `length` words. With m shingles a window, two sets of which s are common are as similar
    as s / (2m - s); a text shorter than n words is one window.

    The i-th place is the first one of the windows that start behind the place before it, and at the
    place itself at the latest; they hold enough if they reach the place so many further on.
    """
    m = "(n - size + 1)"
    need = f"int(ceil({2 * threshold / (1 + threshold)!r}D * {m} - 1e-9))"
    first = f"greatest(if(i = 0, 0, element_at(at, i) + 1), element_at(at, i + {need}) - {m} + 1, 0)"
    last = "least(element_at(at, i + 1), length - n)"
    each = f"transform(sequence(0, size(at) - {need}), i -> if({first} <= {last}, sequence({first}, {last}), array()))"
    whole = f"size(at) >= {threshold / (1 + threshold)!r}D * ({m} + length - size + 1) - 1e-9"
    return F.expr(f"CASE WHEN length < n THEN if({whole}, array(0), array()) WHEN size(at) >= {need} THEN flatten({each}) ELSE array() END")


def counted(shingles: str) -> Column:
    """The shingles with a running number for equal ones, so that sets of them act as multisets."""
    return F.expr(f"transform({shingles}, (s, i) -> struct(s, size(filter(slice({shingles}, 1, i), t -> t = s)) as nth))")


def candidate_documents(docs: DataFrame, items: DataFrame, shingle: int, threshold: float) -> DataFrame:
    """Ids of the documents that can hold a match; a few more may be among them."""
    kinds = items.select("n", "size").distinct().collect()  # a number of words each, not the items
    plans = set()
    for n, size in kinds:
        whole = size == shingle and grid_suffices(n, shingle, threshold)
        plans |= {(size, 0)} if whole else {(size, k) for k in range(size)}
    wanted = items.select(F.explode("shingles").alias("gram")).distinct()
    wanted = checked_broadcast(wanted, wanted.count(), 200_000)
    found = None
    for size, skip in sorted(plans):
        text = F.regexp_replace("clean", f"^(?:[^ ]++ ){{{skip}}}", "") if skip else F.col("clean")
        pattern = f"(?:[^ ]++ ){{{size - 1}}}[^ ]++"
        cut = docs.where(word_count(F.col("clean")) >= size + skip) if skip else docs
        hits = cut.select("doc_id", F.explode(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).alias("gram")).join(wanted, "gram", "left_semi").select("doc_id")
        found = hits if found is None else found.unionByName(hits)
    return docs.select("doc_id").where("false") if found is None else found.distinct()


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, item_id, start_word, n_words, shared, total): the best window of each matching pair,
    with the sizes of the intersection and the union of the weighted shingle sets."""
    items = materialize(benchmark_items(benchmark, shingle), "items")
    clean = docs.select("doc_id", normalized(F.col("text")).alias("clean")).where("doc_id is not null and clean <> ''")
    ids = materialize(candidate_documents(clean, items, shingle, threshold), "suspects")
    some = clean.join(checked_broadcast(ids, ids.count()), "doc_id", "left_semi").select("doc_id", F.split("clean", " ").alias("words"))
    some = materialize(some, "suspect_words")

    lists = items.select("n", "size", F.explode("shingles").alias("gram")).distinct()
    sizes = [row[0] for row in items.select("size").distinct().collect()]  # at most five numbers
    places = None
    for size in sizes:
        one = some.where(F.size("words") >= size).select("doc_id", F.size("words").alias("length"), F.posexplode(grams("words", str(size))).alias("place", "gram")).withColumn("size", F.lit(size))
        places = one if places is None else places.unionByName(one)
    if places is None:  # no item has words
        places = some.select("doc_id", F.lit(0).alias("length"), F.lit(0).alias("place"), F.lit("").alias("gram"), F.lit(0).alias("size")).where("false")
    hits = places.join(lists, ["gram", "size"]).groupBy("doc_id", "length", "n", "size").agg(F.sort_array(F.collect_set("place")).alias("at"))  # of one text
    windows = hits.select("doc_id", "length", "n", "size", F.explode(window_starts(threshold)).alias("start"))
    cut = windows.join(some.withColumn("length", F.size("words")), ["doc_id", "length"]).withColumn("part", F.expr("slice(words, start + 1, n)")).where("size(part) > 0").distinct()
    cut = cut.select("doc_id", "n", "start", grams("part", "size").alias("shingles")).withColumn("print", simhash("shingles"))
    cut = materialize(cut, "windows")

    few_items = items.count() <= cut.count()
    keys = _listed(items.select("item_id", "n", simhash("shingles").alias("item_print")), "item_print", radius if few_items else 0)
    probes = _listed(cut.select("doc_id", "n", "start", "print"), "print", 0 if few_items else radius)
    near = probes.join(keys.hint("merge"), ["n", "k", "value"]).where(F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= radius)
    near = near.select("doc_id", "start", "n", "item_id").distinct()

    sides = near.join(cut.select("doc_id", "start", "n", "shingles"), ["doc_id", "start", "n"])
    sides = sides.join(items.select("item_id", F.col("shingles").alias("item_shingles")), "item_id")
    sides = sides.withColumn("a", counted("shingles")).withColumn("b", counted("item_shingles"))
    judged = sides.withColumn("shared", F.size(F.array_intersect("a", "b"))).withColumn("total", F.size("a") + F.size("b") - F.col("shared"))
    judged = judged.where(F.col("shared") >= F.lit(threshold) * F.col("total") - 1e-9)
    best = judged.groupBy("doc_id", "item_id").agg(
        F.max_by(F.struct("start", "n", "shared", "total"), F.struct(F.col("shared") / F.col("total"), -F.col("start"))).alias("w")
    )
    return best.select("doc_id", "item_id", F.col("w.start").alias("start_word"), F.col("w.n").alias("n_words"), "w.shared", "w.total")
