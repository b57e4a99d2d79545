"""Clusters against plain rounds over all distances."""

import hashlib

import numpy as np
import pytest

from surgeline.llm import clusters as cl

SCHEMA = "vec_id long, embedding array<double>, x string, cluster string"


def frame(spark, rows):
    return spark.createDataFrame([(i, e, "x", "y") for i, e in rows], SCHEMA).repartition(3)


def plain(rows, k, rounds, seed, dims):
    good = [(i, [int(np.floor(256 * c)) for c in e]) for i, e in rows if e is not None and len(e) == dims and all(c is not None and np.isfinite(c) for c in e)]
    first = sorted(good, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    centres = [list(e) for _, e in first]

    def nearest(e):
        return min((sum((a - b) ** 2 for a, b in zip(e, c, strict=True)), n) for n, c in enumerate(centres))

    for _ in range(rounds):
        own = [nearest(e)[1] for _, e in good]
        for n in range(len(centres)):
            part = [e for (_, e), o in zip(good, own, strict=True) if o == n]
            if part:
                centres[n] = [sum(v) // len(part) for v in zip(*part, strict=True)]
    found = [(i, *nearest(e)[::-1]) for i, e in good]
    whole = sum(d for _, _, d in found)
    sums = {n: sum(d for _, o, d in found if o == n) for _, n, _ in found}
    return sorted(((i, n, d, sums[n], whole, hashlib.sha256(",".join(map(str, centres[n])).encode()).hexdigest()) for i, n, d in found), key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_equal_to_plain_rounds(spark, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, 5)) * (0.05, 1, 30)[seed]
    rows = [(i, (centres[i % 6] + rng.normal(size=5) * 0.1).round(2).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(150)] + [(3, rows[9][1]), (None, rows[4][1]), (3, rows[9][1])]
    rows += [(2000, None), (2001, []), (2002, [1.0] * 4), (2003, [1.0, None, 1.0, 1.0, 1.0]), (2004, [float("nan")] * 5), (2005, [float("-inf")] + [0.0] * 4), (2006, [-0.0, -1e-9, 0.0, 0.5, -0.5])]
    found = cl.cluster(frame(spark, rows), clusters=11, rounds=5, seed=2, dimensions=5)
    assert found.columns == cl.COLUMNS
    assert sorted(map(tuple, found.collect()), key=repr) == plain(rows, 11, 5, 2, 5)


def test_bounds_hold_in_every_round_and_spare_distances():
    """Each stored bound, loosened by whole displacements, must bound the true distances."""
    rng = np.random.default_rng(4)
    homes = rng.integers(-4000, 4000, size=(12, 6))
    x = homes[rng.integers(0, 12, 900)] + rng.integers(-60, 60, size=(900, 6))
    history = cl.History([x[:12].copy()], group=5)
    state = cl.start(x, history)
    seen = []
    for _ in range(6):
        new = history.rounds[-1].copy()
        for k in range(12):
            if (state.cluster == k).any():
                new[k] = x[state.cluster == k].sum(axis=0) // (state.cluster == k).sum()
        history = cl.History([*history.rounds, new], group=5)
        assert np.allclose(history.moved[-1], 0) and np.allclose(history.moved[0], np.sqrt(((new - history.rounds[0]) ** 2).sum(axis=1)))
        state = cl.advance(x, state, history)
        true = np.sqrt(((x[:, None] - new[None]) ** 2).sum(axis=2).astype(float))
        assert (state.cluster == ((x[:, None] - new[None]) ** 2).sum(axis=2).argmin(axis=1)).all()
        upper = np.sqrt(state.distance) + history.moved[state.seen, state.cluster]
        assert (upper >= true[np.arange(900), state.cluster] - 1e-6).all()
        for g, members in enumerate(history.groups):
            others = np.where(np.arange(12)[None, members.start : members.stop] == state.cluster[:, None], np.inf, true[:, members.start : members.stop]).min(axis=1)
            place = np.where(state.cluster // 5 == g, state.cluster % 5, 5)
            assert (state.lower[:, g] - history.spread[state.lower_seen[:, g], g, place] <= others + 1e-6).all()
        seen.append((state.seen < history.now).mean())
    assert max(seen) > 0.3  # vectors whose distance no one looked at


def test_few_vectors_no_vectors_and_huge_components(spark):
    assert cl.cluster(frame(spark, []), 4, 2, 2, 3).count() == 0
    rows = [(1, [1.0, 2.0, 3.0]), (2, [1.0, 2.0, 3.0])]
    assert sorted((r.vec_id, r.distance) for r in cl.cluster(frame(spark, rows), 4, 2, 2, 3).collect()) == [(1, 0), (2, 0)]
    found = cl.cluster(frame(spark, [(i, [1e300 * (-1) ** i, 0.0, float(i)]) for i in range(9)]), 1, 2, 2, 3).collect()
    assert len(found) == 9 and all(r.distance > 0 for r in found)
