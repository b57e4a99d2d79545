"""Near-duplicate documents by fast similarity sketches, banding and exact verification.

Documents are linked when their sets of word shingles have a Jaccard similarity of at least
`threshold`; a component is what links connect. Steps:

1. One pass over the texts makes each document's set size, a 128-bit key of the set and the bands of
   its sketch. Documents with equal sets meet in an aggregate on the key; one of them, the
   representative, goes on. Copies are never expanded into pairs.
2. Representatives that share a band share a bucket. Similar documents share one of the bands with a
   chance of 1 - (1 - s**rows)**bands, which is above 0.99998 at a similarity of 0.8.
3. Pairs are verified on their full sets in three rounds, each only between documents that are not
   connected yet: a document with its smallest bucket centre, with the centres of all its buckets,
   and last every document outside the component of a bucket's centre with the bucket's other
   components. Two exact bounds rule out most of the last round's pairs: shingles found in no other
   document still in question cannot be shared, and Jaccard distance is a metric, so that distances
   to the centre bound those between members. After it no pair of a bucket is left open.
4. Connected components come from repeated minimum labels with pointer jumping, on tables.

A text without words (or null) is linked with nothing. Rows of one doc_id are one document: the
smallest of their texts stands for it. A null doc_id belongs to no document and gives no row. Other
columns are never touched. Empty input gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import checked_broadcast, text_chunks
from .wordscan import U, mix, scan, shingle_sets

SHINGLE, BANDS, ROWS = 5, 28, 5
EMPTY = np.iinfo(np.uint64).max


def sketches(sets: list[np.ndarray], size: int) -> np.ndarray:
    """Fast similarity sketch of each set, `size` coordinates (at most 255) a set.

    Round i throws every element into a bin drawn for that round; from round `size` on, round
    size + j throws all of them into bin j, so that after 2 * size rounds every coordinate is filled.
    A coordinate holds the smallest (round, hash) it got, so only bins that are still empty matter
    in a round and full sketches leave the loop.
    """
    n = len(sets)
    out = np.full((n, size), EMPTY, np.uint64)
    flat = out.ravel()
    lengths = np.array([len(s) for s in sets], np.int64)
    active = np.flatnonzero(lengths)
    for i in range(2 * size):
        if not len(active):
            break
        elements = np.concatenate([sets[k] for k in active])
        owner = np.repeat(active, lengths[active])
        h = mix(elements ^ mix(np.full(1, i + 1, np.uint64) * U(0x9E3779B97F4A7C15)))
        bins = ((h >> U(40)) * U(size) >> U(24)).astype(np.int64) if i < size else np.full(len(h), i - size)
        cell = owner * size + bins
        value = (mix(h) >> U(9)) | (U(i) << U(55))
        free = flat[cell] >> U(55) >= U(i)
        np.minimum.at(flat, cell[free], value[free])
        active = active[(out[active] == EMPTY).any(axis=1)]
    return out


def _band_keys(rows: np.ndarray, bands: int, per_band: int) -> np.ndarray:
    keys = np.zeros((len(rows), bands), np.uint64)
    for k in range(per_band):
        keys = mix(keys + rows[:, k::per_band][:, :bands])
    return mix(keys + np.arange(bands, dtype=np.uint64))


def _sketch_batches(shingle: int, bands: int, per_band: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches):
            sets = shingle_sets(scan(batch.column(1), lower=True), shingle)
            keys = _band_keys(sketches(sets, bands * per_band), bands, per_band)
            total = np.array([mix(s).sum(dtype=np.uint64) for s in sets], np.uint64)
            folded = np.array([np.bitwise_xor.reduce(mix(s + U(7))) if len(s) else 0 for s in sets], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(total.view(np.int64)),
                    pa.array(folded.view(np.int64)),
                    pa.array(list(keys.view(np.int64)), pa.list_(pa.int64())),
                ],
                ["doc_id", "n_shingles", "key_a", "key_b", "bands"],
            )

    return run


def sketch_documents(docs: DataFrame, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, key_a, key_b, bands) for each row with an id."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    return texts.mapInArrow(_sketch_batches(shingle, bands, rows), "doc_id long, n_shingles long, key_a long, key_b long, bands array<long>")


def _verify_batches(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches):
            left = shingle_sets(scan(batch.column(2), lower=True), shingle)
            right = shingle_sets(scan(batch.column(3), lower=True), shingle)
            common = [len(np.intersect1d(a, b, assume_unique=True)) for a, b in zip(left, right, strict=True)]
            union = [len(a) + len(b) - c for a, b, c in zip(left, right, common, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(common, pa.int64()), pa.array(union, pa.int64())], ["a", "b", "common", "total"])

    return run


def verify_pairs(pairs: DataFrame, texts: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """Size of intersection and union of the full sets of each pair (a, b); texts has (id, text)."""
    one = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    other = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    return (
        pairs.select("a", "b").join(one, "a").join(other, "b").select("a", "b", "text_a", "text_b")
        .mapInArrow(_verify_batches(shingle), "a long, b long, common long, total long")
    )


def _shingle_batches(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches):
            sets = shingle_sets(scan(batch.column(1), lower=True), shingle)
            owners = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), [len(s) for s in sets])
            flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(owners, pa.int64()), pa.array(flat.view(np.int64))], ["id", "shingle"])

    return run


def own_shingles(texts: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(id, own): how many shingles of a text are in no other one of `texts`."""
    rows = texts.select("id", "text").mapInArrow(_shingle_batches(shingle), "id long, shingle long")
    single = rows.groupBy("shingle").agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n = 1")
    return single.groupBy("id").agg(F.count("*").alias("own"))


def connected_components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable. nodes has (id, component), a labelling that is
    already valid; links has (a, b). Work grows with the labels that links join."""
    ends = links.join(nodes.select(F.col("id").alias("a"), F.col("component").alias("x")), "a").join(nodes.select(F.col("id").alias("b"), F.col("component").alias("y")), "b")
    edges = materialize(ends.where("x <> y").select("x", "y").distinct(), "edges")
    if edges.isEmpty():
        return nodes
    both = edges.union(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
    labels = materialize(both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("label")), "labels")
    while True:
        step = (
            both.join(labels.select(F.col("x").alias("y"), F.col("label").alias("reach")), "y")
            .select("x", "reach").unionByName(labels.select("x", F.col("label").alias("reach")))
            .groupBy("x").agg(F.min("reach").alias("label"))
        )
        step = materialize(step, "labels")
        jump = step.select(F.col("x").alias("label"), F.col("label").alias("further"))
        step = materialize(step.join(jump, "label").select("x", F.col("further").alias("label")), "labels")
        if step.join(labels.select("x", F.col("label").alias("before")), "x").where("label <> before").isEmpty():
            break
        labels = step
    moved = labels.where("x <> label")
    renamed = moved.select(F.col("x").alias("component"), F.col("label").alias("smaller"))
    return materialize(nodes.join(renamed, "component", "left").select("id", F.coalesce("smaller", "component").alias("component")), "components")


def _link(nodes: DataFrame, members: DataFrame, sketched: DataFrame, texts: DataFrame, percent: int, shingle: int) -> DataFrame:
    """Components of the candidates after the three rounds of verification."""
    linked = F.col("common") * 100 >= F.col("total") * percent

    def labelled(frame: DataFrame, key: str, name: str, labels: DataFrame) -> DataFrame:
        return frame.join(labels.select(F.col("id").alias(key), F.col("component").alias(name)), key)

    pairs = members.where("id <> centre").groupBy("id").agg(F.min("centre").alias("centre"))
    first = materialize(verify_pairs(pairs.select(F.col("centre").alias("a"), F.col("id").alias("b")), texts, shingle), "verified")
    nodes = connected_components(materialize(nodes, "components"), first.where(linked).select("a", "b"))

    outside = labelled(labelled(members, "id", "own", nodes), "centre", "hub", nodes).where("own <> hub")
    pairs = outside.select(F.col("centre").alias("a"), F.col("id").alias("b")).distinct().join(first.select("a", "b"), ["a", "b"], "left_anti")
    second = materialize(verify_pairs(pairs, texts, shingle), "verified")
    nodes = connected_components(nodes, second.where(linked).select("a", "b"))

    distance = F.lit(1.0) - F.col("common") / F.col("total")
    known = first.unionByName(second).select(F.col("a").alias("centre"), F.col("b").alias("id"), distance.alias("far"))
    placed = labelled(labelled(members, "id", "own_label", nodes), "centre", "hub", nodes)
    placed = materialize(placed.join(known, ["centre", "id"], "left").withColumn("outside", F.col("own_label") != F.col("hub")), "placed")
    open_buckets = placed.where("outside").select("bucket").distinct()
    placed = materialize(placed.join(open_buckets, "bucket", "left_semi"), "placed")
    own = own_shingles(texts.join(placed.select("id").distinct(), "id", "left_semi"), shingle)
    free = F.col("n_shingles") - F.coalesce("own", F.lit(0))  # the most it can share with another one
    placed = placed.join(own, "id", "left").withColumn("free", free).where(100 * F.col("free") >= percent * F.col("n_shingles"))
    bands = sketched.select(F.col("doc_id").alias("id"), "bands").join(placed.select("id").distinct(), "id", "left_semi")
    earlier = F.slice("bands", F.lit(1), F.col("band"))
    placed = materialize(placed.join(bands, "id").withColumn("earlier", earlier).drop("bands"), "placed")

    def side(frame: DataFrame, of: str) -> DataFrame:
        names = {"id": of, "own_label": f"own_{of}", "far": f"far_{of}", "n_shingles": f"n_{of}", "free": f"free_{of}", "earlier": f"earlier_{of}"}
        return frame.select("bucket", "outside", *[F.col(c).alias(n) for c, n in names.items()])

    slack = (100 - percent) / 100 + 1e-9
    most = F.least("free_a", "free_b")
    possible = (
        (F.col("own_a") != F.col("own_b"))
        & (~F.col("outside") | (F.col("a") < F.col("b")))
        & (100 * most >= percent * (F.col("n_a") + F.col("n_b") - most))
        & (F.col("far_a").isNull() | F.col("far_b").isNull() | (F.abs(F.col("far_a") - F.col("far_b")) <= slack))
        & ~F.arrays_overlap("earlier_a", "earlier_b")  # a pair comes from the first band it shares
    )
    one, other = side(placed.where("outside"), "a").drop("outside"), side(placed.where("id <> centre"), "b")
    pairs = one.join(other, "bucket").where(possible).select("a", "b").distinct()
    third = materialize(verify_pairs(pairs, texts, shingle), "verified")
    return connected_components(nodes, third.where(linked).select("a", "b"))


def near_duplicates(docs: DataFrame, threshold: float = 0.85, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row for each document."""
    percent = round(threshold * 100)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    sketched = materialize(sketch_documents(docs, shingle, bands, rows), "sketches")
    repeats = materialize(sketched.groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeats")
    repeated = repeats.count()
    marked = checked_broadcast(repeats, repeated)
    if repeated:
        merged = docs.join(marked, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
        docs = docs.join(marked, "doc_id", "left_anti").unionByName(merged)
        sketched = materialize(sketched.join(marked, "doc_id", "left_anti").unionByName(sketch_documents(merged, shingle, bands, rows)), "sketches")

    full = sketched.where("n_shingles > 0")
    key = ["key_a", "key_b", "n_shingles"]
    classes = materialize(full.groupBy(*key).agg(F.min("doc_id").alias("id")), "classes")
    chosen = full.join(classes.select("id"), full.doc_id == classes.id, "left_semi")
    buckets = chosen.select(F.col("doc_id").alias("id"), "n_shingles", F.posexplode("bands").alias("band", "bucket"))
    crowded = buckets.groupBy("bucket").agg(F.count("*").alias("size"), F.min("id").alias("centre")).where("size > 1").select("bucket", "centre")
    members = materialize(buckets.join(crowded, "bucket").select("bucket", "band", "centre", "id", "n_shingles"), "members")
    candidates = materialize(members.select("id").distinct(), "candidates")
    count = candidates.count()
    nodes = candidates.select("id", F.col("id").alias("component"))
    if count:
        wanted = checked_broadcast(candidates, count)
        texts = materialize(docs.select(F.col("doc_id").alias("id"), "text").join(wanted, "id", "left_semi"), "texts")
        nodes = _link(nodes, members, sketched, texts, percent, shingle)

    of_class = classes.join(nodes, "id", "left").select(*key, F.coalesce("component", "id").alias("component_id"))
    linked = full.select("doc_id", *key).join(of_class, key).select("doc_id", "n_shingles", "component_id")
    alone = sketched.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("doc_id") == F.col("component_id"))
