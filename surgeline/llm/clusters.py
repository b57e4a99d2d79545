"""Centroid clustering with ns-bounds.

Lloyd's rounds over integer vectors, exact in every step. For each vector the state holds its cluster,
an upper bound on the distance to that centroid and, for each of a few groups of centroids, a lower
bound on the distance to any other centroid in the group, each with the round in which it was last
evaluated. The centroids of all rounds are kept (CLUSTERS x rounds, broadcast), so a bound is loosened
by the norm of the centroids' whole displacement since its evaluation, not by the sum of what they
drifted round by round. A vector whose bounds still part the centroids keeps its cluster unseen; else
its own distance is computed anew, and then the groups whose bounds fail are rescanned exactly, in
integers. Bounds are rounded outwards, so a tie always leads to a rescan.

Vectors with another number of components, or with null, NaN or infinite ones, are left out; so is a
null vector. Components are floor(256 * x); beyond 2**26 they count as 2**26, since the squared
distance of larger ones fits no long. Of fewer vectors than clusters each one starts a centroid; an
empty table gives no row. A null id comes last among equal candidates for a first centroid, repeated
ids are told apart by their components. An inertia beyond a long is null. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

DIMENSIONS, CLUSTERS, ROUNDS = 64, 40, 5
GROUP = 8  # centroids that share a lower bound
LIMIT = 1 << 26
PAIRS = 1 << 13  # distances computed at once
COLUMNS = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def usable(vectors: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """(vec_id, x) with integer components."""
    doubles = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    finite = F.forall("e", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = F.transform("e", lambda c: F.floor(F.least(F.greatest(c * 256, F.lit(-float(LIMIT))), F.lit(float(LIMIT)))).cast("int"))
    return doubles.where((F.size("e") == dimensions) & finite).select("vec_id", whole.alias("x"))


def first_centroids(vectors: DataFrame, clusters: int, seed: int) -> np.ndarray:
    """The vectors with the smallest hashes of `seed:vec_id`: `clusters` rows on the driver."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.orderBy(name.asc_nulls_last(), "x").limit(clusters).collect()
    return np.array([r["x"] for r in rows], np.int64)


@dataclass
class History:
    """Centroids of every round so far, and how far each has moved since any of them."""

    rounds: list[np.ndarray]
    group: int = GROUP
    moved: np.ndarray = field(init=False)  # [round of evaluation, centroid], rounded up
    spread: np.ndarray = field(init=False)  # [round of evaluation, group, place left out]

    def __post_init__(self) -> None:
        now = self.rounds[-1].astype(float)
        self.moved = np.stack([np.sqrt(((now - c) ** 2).sum(axis=1)) for c in self.rounds]) * (1 + 1e-12)

        self.spread = np.stack([self._others(g) for g in self.groups], axis=1)

    def _others(self, members: range) -> np.ndarray:
        """[round, place left out]: the largest move of a group's other centroids; the last column
        leaves none out."""
        moved = self.moved[:, members.start : members.stop]
        out = np.repeat(moved.max(axis=1)[:, None], self.group + 1, axis=1)
        for k in range(len(members)):
            out[:, k] = np.delete(moved, k, axis=1).max(axis=1, initial=0.0)
        return out

    @property
    def now(self) -> int:
        return len(self.rounds) - 1

    @property
    def groups(self) -> list[range]:
        k = len(self.rounds[-1])
        return [range(g, min(g + self.group, k)) for g in range(0, k, self.group)]


def squared(x: np.ndarray, rows: np.ndarray, centroids: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Exact squared distances of x[rows] to centroids[which]."""
    out = np.empty(len(rows), np.int64)
    for at in range(0, len(rows), PAIRS):
        part = slice(at, at + PAIRS)
        out[part] = ((x[rows[part]] - centroids[which[part]]) ** 2).sum(axis=1)
    return out


@dataclass
class State:
    cluster: np.ndarray
    distance: np.ndarray  # to the own centroid when last evaluated, squared
    seen: np.ndarray  # round of that evaluation
    lower: np.ndarray  # [vector, group]
    lower_seen: np.ndarray


def start(x: np.ndarray, history: History) -> State:
    """All distances to the first centroids."""
    n, groups = len(x), len(history.groups)
    unknown = State(np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int8), np.full((n, groups), -1.0), np.zeros((n, groups), np.int8))
    unknown.distance[:] = squared(x, np.arange(n), history.rounds[0], unknown.cluster)
    return advance(x, unknown, history)


def advance(x: np.ndarray, state: State, history: History) -> State:
    """Nearest centroid of each vector in the newest round."""
    now, centroids, everyone = history.now, history.rounds[-1], np.arange(len(x))
    spread = history.spread
    own_group, own_place = state.cluster // history.group, state.cluster % history.group
    upper = np.sqrt(state.distance.astype(float)) * (1 + 1e-9) + history.moved[state.seen, state.cluster]
    lower = np.empty_like(state.lower)
    for g in range(len(history.groups)):
        place = np.where(own_group == g, own_place, history.group)
        lower[:, g] = state.lower[:, g] - spread[state.lower_seen[:, g], g, place]
    cluster, distance, seen = state.cluster.copy(), state.distance.copy(), state.seen.copy()
    bound, bound_seen = state.lower.copy(), state.lower_seen.copy()

    open_rows = everyone[(upper[:, None] >= lower).any(axis=1)]
    distance[open_rows] = squared(x, open_rows, centroids, cluster[open_rows])
    seen[open_rows] = now
    exact = np.sqrt(distance[open_rows].astype(float))
    upper[open_rows] = exact * (1 + 1e-9)
    failed = upper[open_rows, None] >= lower[open_rows]
    best, best_distance = cluster[open_rows].copy(), distance[open_rows].copy()
    least: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # of rescanned groups: places in open_rows, all distances
    for g, members in enumerate(history.groups):
        hit = np.flatnonzero(failed[:, g])
        rows = np.repeat(open_rows[hit], len(members))
        found = squared(x, rows, centroids, np.tile(np.array(members), len(hit))).reshape(len(hit), len(members))
        least[g] = (hit, found)
        place = found.argmin(axis=1) if len(hit) else np.zeros(0, np.int64)  # the smaller number of equal ones
        near, number = found[np.arange(len(hit)), place], members.start + place
        better = (near < best_distance[hit]) | ((near == best_distance[hit]) & (number < best[hit]))
        best[hit[better]], best_distance[hit[better]] = number[better], near[better]

    before = cluster[open_rows]
    cluster[open_rows], distance[open_rows] = best, best_distance
    for g, members in enumerate(history.groups):
        hit, found = least[g]
        rest = found.astype(float)
        mine = best[hit] - members.start
        inside = (mine >= 0) & (mine < len(members))
        rest[np.flatnonzero(inside), mine[inside]] = np.inf
        bound[open_rows[hit], g] = np.sqrt(rest.min(axis=1)) * (1 - 1e-9) if len(hit) else []
        bound_seen[open_rows[hit], g] = now
        # a vector that left a centroid of a group not rescanned: that centroid is one of the others now
        left = (before != best) & (before // history.group == g) & ~failed[:, g]
        rows = open_rows[left]
        bound[rows, g] = np.minimum(lower[rows, g], exact[left] * (1 - 1e-9))
        bound_seen[rows, g] = now
    return State(cluster, distance, seen, bound, bound_seen)


_state_types = [("vec_id", pa.int64()), ("x", pa.list_(pa.int32())), ("cluster", pa.int32()), ("distance", pa.int64()), ("seen", pa.int8()), ("lower", pa.list_(pa.float64())), ("lower_seen", pa.list_(pa.int8()))]
STATE = "vec_id long, x array<int>, cluster int, distance long, seen byte, lower array<double>, lower_seen array<byte>"


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), -1)


def _lists(matrix: np.ndarray, kind: pa.DataType) -> pa.Array:
    n, width = matrix.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(matrix.ravel(), kind))


def assigned(rows: DataFrame, history: History, last: bool = False) -> DataFrame:
    """rows: (vec_id, x) at the start, later STATE. The last time (vec_id, cluster, distance)."""
    shared = rows.sparkSession.sparkContext.broadcast(history)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1), np.int64)
            if batch.num_columns == 2:
                state = start(x, shared.value)
            else:
                cluster, distance, seen = (batch.column(k).to_numpy(zero_copy_only=False) for k in (2, 3, 4))
                old = State(cluster.astype(np.int64), distance, seen, _matrix(batch.column(5), float), _matrix(batch.column(6), np.int8))
                state = advance(x, old, shared.value)
            if last:
                exact = squared(x, np.arange(len(x)), shared.value.rounds[-1], state.cluster)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(state.cluster, pa.int32()), pa.array(exact)], ["vec_id", "cluster", "distance"])
                continue
            columns = [batch.column(0), batch.column(1), pa.array(state.cluster, pa.int32()), pa.array(state.distance), pa.array(state.seen, pa.int8())]
            columns += [_lists(state.lower, pa.float64()), _lists(state.lower_seen, pa.int8())]
            yield pa.RecordBatch.from_arrays([c.cast(t) for c, (_, t) in zip(columns, _state_types, strict=True)], [n for n, _ in _state_types])

    return rows.mapInArrow(run, "vec_id long, cluster int, distance long" if last else STATE)


def moved_centroids(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Floor of each cluster's mean; sums are combined before the shuffle, `clusters` rows reach the driver."""
    sums = state.groupBy("cluster").agg(F.count("*").alias("n"), *[F.sum(F.col("x")[i].cast("long")).alias(f"s{i}") for i in range(centroids.shape[1])])
    out = centroids.copy()
    for r in sums.collect():
        out[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(centroids.shape[1])]
    return out


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = 2, dimensions: int = DIMENSIONS) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each usable vector."""
    spark = vectors.sparkSession
    rows = usable(vectors, dimensions)
    shape = "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    first = first_centroids(rows, clusters, seed)
    if not len(first):
        return spark.createDataFrame([], f"vec_id long, distance long, {shape}").select(*COLUMNS)
    history, state = History([first]), rows
    for _ in range(rounds):
        state = materialize(assigned(state, history), "clusters")
        history = History([*history.rounds, moved_centroids(state, history.rounds[-1])])
    final = materialize(assigned(state, history, last=True), "clustered")
    sums = final.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("d")).collect()  # `clusters` rows
    whole = sum(int(r["d"]) for r in sums)
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in history.rounds[-1]]
    totals = [(r["cluster"], _long(int(r["d"])), _long(whole), digests[r["cluster"]]) for r in sums]
    return final.join(F.broadcast(spark.createDataFrame(totals, shape)), "cluster").select(*COLUMNS)


def _long(n: int) -> int | None:
    return n if n < 1 << 63 else None
