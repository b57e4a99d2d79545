"""Conversation repair against a search over all edits, with chunks of any size."""

import hashlib
import itertools
import re
import zlib
from random import Random

import pytest

from surgeline.llm import conversations as cv

SCHEMA = "conv_id long, turn long, role string, text string, chunk string, codes string"
LANGUAGE = re.compile(r"(s?(ua)+)?")


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(3)


def faults(rows):
    out, seen = [], set()
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def cheapest(rows, found):
    """Least (cost, audit) by a forward search over exact prefixes; shortest paths, no speculation."""
    prefixes = {"": (0, "", ())}  # automaton state by the last initials: "", s, u, a

    def follow(state, initial):
        return {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}.get((state, initial))

    def put(table, state, entry):
        if state is not None and (state not in table or entry[:2] < table[state][:2]):
            table[state] = entry

    def closed(table):
        for _ in range(3):
            for state, (cost, audit, lines) in list(table.items()):
                for role in ("user", "assistant"):
                    put(table, follow(state, role[0]), (cost + 3, audit + "I", (*lines, role + ":")))
        return table

    for (_, role, text), fault in zip(rows, found, strict=True):
        after = {}
        for state, (cost, audit, lines) in closed(prefixes).items():
            put(after, state, (cost + 4, audit + "D", lines))
            if fault not in ("blank", "duplicate"):
                extra = 3 * (fault == "truncated")
                for new in ("user", "assistant"):
                    put(after, follow(state, new[0]), (cost + 3 + extra, audit + "R", (*lines, f"{new}:{text}")))
                put(after, follow(state, role[:1]), (cost + extra, audit + "K", (*lines, f"{role}:{text}")))
        prefixes = after
    return min((v for k, v in closed(prefixes).items() if k in ("", "a")), key=lambda v: v[:2])


def plain(rows):
    """(turn, role, text) after damage, in any order, of one conversation."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    found = faults(rows)
    turns = [t for t, _, _ in rows if t is not None]
    pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(rows)]
    cost, audit, lines = cheapest(rows, found)
    assert LANGUAGE.fullmatch("".join(line[0] for line in lines))
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        *[found.count(k) for k in ("blank", "duplicate", "truncated")],
        sum(p not in ("su", "ua", "au") for p in pairs),
        cost,
        audit,
        hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    )


def check(spark, rows):
    """rows: (conv_id, turn, role, text)."""
    by_id = {}
    for i, turn, role, text in rows:
        by_id.setdefault(i, []).append((turn, " " if role is None else role, " " if text is None else text))
    found = cv.repair(frame(spark, rows)).collect()
    assert len(found) == len(by_id)
    for r in found:
        assert tuple(r)[1:] == plain(by_id[r.conv_id]), (r, by_id[r.conv_id][:20])


def random_rows(rng, conv_id, n, roles=("user", "assistant", "system", "user", "assistant", "tool", None)):
    texts = ["Yes.", "No!", "cut", "", " \n", None, "what?", "a. ", "ß…", "z.\x0b"]
    return [(conv_id, rng.choice([None, *range(n)]) if rng.random() < 0.3 else k, rng.choice(roles), rng.choice(texts) if rng.random() < 0.5 else f"text {k}.") for k in range(n)]


def test_conversations_within_partitions(spark):
    rng = Random(1)
    rows = [r for i in range(150) for r in random_rows(rng, i, rng.randint(1, 14))]
    rows += random_rows(rng, None, 9) + [(500, 1, "user", "Hi.")] * 7 + [(501, t, "user", "Hi.") for t in (3, 1, 9)] + [(502, None, "", ""), (503, 5, "User", "A."), (504, -3, "system", "B.")]
    check(spark, rows)


@pytest.mark.parametrize("partitions", ["5", "23"])
def test_conversations_over_many_partitions(spark, partitions):
    rng = Random(2)
    rows = [r for i in range(4) for r in random_rows(rng, i, 120)]
    rows += random_rows(rng, 9, 200, roles=("tool", None))  # two costs that never meet
    rows += [(10, t, "user", "") for t in range(80)] + [(11, t, ("user", "assistant")[t % 2], f"{t}.") for t in range(90)] + [(12, 7, "assistant", "same.")] * 60
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        check(spark, rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def codes_of(rng, n, kinds="suaoSUAOx"):
    return "".join(rng.choice(kinds) for _ in range(n))


def test_chunks_settle_to_the_vectors_of_one_walk(spark):
    """Random code strings, cut anywhere; with and without fix-up passes."""
    rng = Random(3)
    strings = [codes_of(rng, 60) for _ in range(6)] + [codes_of(rng, 60, "oO"), codes_of(rng, 60, "x"), codes_of(rng, 60, "ux"), "ua" * 30]
    rows = [(i, (i << 32) + k, s[a : a + 6]) for i, s in enumerate(strings) for k, a in enumerate(range(0, 60, 6))]
    chunks = spark.createDataFrame(rows, "conv_id long, chunk long, codes string")
    for fixups in (0, 2, 30):
        found = {r.chunk: r for r in cv._converged(chunks, fixups).collect()}
        assert len(found) == len(rows)
        for i, s in enumerate(strings):
            vector, total = cv.ENDING, 0
            for k in reversed(range(10)):
                r = found[(i << 32) + k]
                assert tuple(r.ending) == vector
                vector, c, _ = cv.sweep(s[6 * k : 6 * k + 6], vector)
                assert (tuple(r.start), r.total) == (vector, c)
                total += c
            assert (vector, total) == cv.sweep(s, cv.ENDING)[:2]


def test_reruns_stop_where_vectors_meet_and_agree_with_full_ones():
    rng = Random(5)
    for _ in range(300):
        codes, ending = codes_of(rng, rng.randint(0, 30)), tuple(rng.choice([0, 1, 3, 4]) for _ in range(4))
        ending = tuple(c - min(ending) for c in ending)
        start, total, _ = cv.sweep(codes, cv.ENDING)
        assert cv.resweep(codes, ending, cv.ENDING, start, total) == cv.sweep(codes, ending)[:2]
        costs = cv.between(codes)
        vector, total, _ = cv.sweep(codes, cv.ENDING)
        assert [min(costs[s][e] + cv.ENDING[e] for e in range(4)) for s in range(4)] == [c + total for c in vector]


def test_damage(spark):
    rows = [(i, t, "assistant", f"Hm. {t}!") for i in range(40) for t in range(6)] + [(None, None, None, None), (7, None, "user", "x?")]
    show = lambda v: " " if v is None else str(v)
    want = []
    for i, t, role, text in rows:
        kind = zlib.crc32(f"{show(i)}:{show(t)}".encode()) % 20
        role, text = "user" if kind == 4 else show(role), show(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        want.append((i, t, role, text, {0: 0, 3: 2}.get(kind, 1)))
    found = cv.damage(frame(spark, rows))
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(want, key=repr)
    ids = {r.conv_id: r for r in cv.repair(found).collect()}
    assert ids.keys() == {r[0] for r in rows}


def test_no_rows_left_and_no_rows_at_all(spark):
    assert cv.repair(frame(spark, [])).count() == 0
    row = cv.repair(spark.createDataFrame([(4, 1, "user", "a.", 0)], "conv_id long, turn long, role string, text string, copies int")).first()
    assert tuple(row) == (4, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
