"""Repair of a conversation's structure by a rank-convergence parallel Viterbi search.

Edits turn each conversation into one whose role initials read (s?(ua)+)?: keep a row (0), give it the
role user or assistant (3), delete it (4), insert an empty row of either role anywhere (3); a truncated
row that stays adds 3. Blank rows and rows that repeat an earlier one must go. Of the cheapest edits the
one whose letters K, R, D, I sort first is taken.

The search runs backwards over four states. Costs from a row to the end, less their minimum, are one of
few vectors, so a step is a lookup. A conversation that lies whole within a partition is solved there.
Others are cut into chunks. All chunks start at once, from the vector that holds at a conversation's
end; fix-up passes run a chunk again from what its successor found, until every chunk has started from
a vector that differs from its successor's only by a constant. A rerun stops at the first row where its
vector meets the earlier one's. Where FIXUPS passes do not settle (rows that keep two costs apart for
ever, as a long run of unknown roles does), chunks are reduced to the costs between any two states
and composed in order; the result is the same. The constants add up to the cost, and the stitched
costs tell each chunk its least edits from each state it may be entered in.

What passes through one task for one conversation are a few numbers a chunk, and at the end its text as
a stream into the digest; the audit itself, a letter a row, is a cell of the result.

Rows are taken by turn (nulls first), role and text; a null role or text counts as one space. A role
that does not start with s, u or a, an empty one included, cannot be kept. Rows of a null conv_id are
one conversation. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import text_chunks

SPACES = " \t\n\x0b\x0c\r"
CHUNK_ROWS, CHUNK_CHARS = 4096, 1 << 19
FIXUPS = 6

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: States: nothing yet, after the system row, after a user row, after an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
FOLLOWS = [USER, USER, ASSISTANT, USER]  # state after an inserted or renamed row
SPOKEN = ["user", "user", "assistant", "user"]  # its role
KEEPS = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}, "o": {}}
ENDING = (0, 2 * INSERT, INSERT, 0)  # cost of ending in each state
FAR = 1 << 20  # of a state that cannot be reached, against the least cost
NEVER = 1 << 50

Vector = tuple[int, ...]


# Codes: the initial of a row's role (o: any other), upper case if truncated; x: to be deleted.


@lru_cache(maxsize=1 << 16)
def _before(code: str, after: Vector) -> Vector:
    """Costs before a row from those after it."""
    costs = [DELETE + c for c in after]
    if code != "x":
        extra, kept = TRUNCATED * code.isupper(), KEEPS[code.lower()]
        for state in range(4):
            costs[state] = min(costs[state], REROLE + extra + after[FOLLOWS[state]])
            if state in kept:
                costs[state] = min(costs[state], KEEP + extra + after[kept[state]])
    for _ in range(2):
        costs = [min(c, INSERT + costs[FOLLOWS[state]]) for state, c in enumerate(costs)]
    return tuple(costs)


@lru_cache(maxsize=1 << 16)
def back(code: str, after: Vector) -> tuple[Vector, int]:
    """The vector before a row, its least cost 0, and the constant taken off."""
    costs = _before(code, after)
    least = min(costs)
    return tuple(c - least if c < FAR // 2 else FAR for c in costs), least


@lru_cache(maxsize=1 << 16)
def edits(code: str, after: Vector, state: int) -> tuple[str, int]:
    """Least letters of a cheapest way over a row, insertions before it first, and the state behind."""
    costs, letters = _before(code, after), ""
    extra, kept = TRUNCATED * code.isupper(), KEEPS.get(code.lower(), {})
    while True:
        if DELETE + after[state] == costs[state]:
            return letters + "D", state
        if INSERT + costs[FOLLOWS[state]] == costs[state]:
            letters, state = letters + "I", FOLLOWS[state]
        elif state in kept and KEEP + extra + after[kept[state]] == costs[state]:
            return letters + "K", kept[state]
        else:
            return letters + "R", FOLLOWS[state]


def sweep(codes: str, ending: Vector) -> tuple[Vector, int, list[Vector]]:
    """Vector before the first row, its constant, and the vector after each row."""
    vector, total, seen = ending, 0, []
    for code in reversed(codes):
        seen.append(vector)
        vector, c = back(code, vector)
        total += c
    return vector, total, seen[::-1]


def resweep(codes: str, ending: Vector, old: Vector, old_start: Vector, old_total: int) -> tuple[Vector, int]:
    """Sweep from another vector until it differs from the old one only by a constant."""
    new, total, passed = ending, 0, 0
    for code in reversed(codes):
        if new == old:
            return old_start, total + old_total - passed
        new, c = back(code, new)
        total += c
        old, c = back(code, old)
        passed += c
    return new, total


def trace(codes: str, vectors: list[Vector], state: int) -> tuple[list[str], int]:
    """Letters of each row, and the state after the last."""
    out = []
    for code, after in zip(codes, vectors, strict=True):
        letters, state = edits(code, after, state)
        out.append(letters)
    return out, state


def closing(state: int) -> str:
    return "I" * (ENDING[state] // INSERT)


def repaired_lines(letters: list[str], codes: str, said: list[tuple[str, str]], state: int) -> list[str]:
    """role:text of the rows that remain. `said` holds (role, text) of the rows whose code is not x."""
    lines, rows = [], iter(said)
    for group, code in zip(letters, codes, strict=True):
        role, text = next(rows) if code != "x" else ("", "")
        for letter in group:
            if letter in "IR":
                lines.append(f"{SPOKEN[state]}:{text if letter == 'R' else ''}")
                state = FOLLOWS[state]
            elif letter == "K":
                lines.append(f"{role}:{text}")
                state = KEEPS[code.lower()][state]
    return lines


def inserted(letters: str, state: int) -> list[str]:
    lines = []
    for _ in letters:
        lines.append(f"{SPOKEN[state]}:")
        state = FOLLOWS[state]
    return lines


LEGAL = {"su", "ua", "au"}
COUNTS = ["blank", "duplicate", "truncated", "illegal", "turns"]
RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_PIECE = (
    "chunk long, codes string, roles array<string>, texts array<string>, turns long, low_turn long, high_turn long, first_initial string, last_initial string"
)
FOUND = f"{RESULT}, {_PIECE}"
_arrow = {"long": pa.int64(), "string": pa.string(), "array<string>": pa.list_(pa.string()), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64())}


def arrow_schema(ddl: str) -> pa.Schema:
    return pa.schema([(c.split()[0], _arrow[c.split()[1]]) for c in ddl.split(", ")])


class Piece:
    """Consecutive rows of one conversation. Its texts are bounded by CHUNK_CHARS and one row."""

    def __init__(self, conv_id: int | None):
        self.conv_id = conv_id
        self.codes: list[str] = []
        self.said: list[tuple[str, str]] = []
        self.counts = dict.fromkeys(COUNTS, 0)
        self.low = self.high = self.first = self.last = None
        self.chars = 0

    def add(self, turn: int | None, role: str, text: str, copies: int, blank: bool, late: bool, cut: bool) -> None:
        initial = role[:1]
        if self.last is None:
            self.first = initial
        elif self.last + initial not in LEGAL:
            self.counts["illegal"] += 1
        self.counts["illegal"] += copies - 1  # a role never follows itself
        self.last = initial
        if turn is not None and turn != self.high:
            self.counts["turns"] += 1
            self.low, self.high = turn if self.low is None else self.low, turn
        gone = copies if blank or late else copies - 1
        self.counts["blank" if blank else "duplicate"] += gone
        if gone < copies:
            code = initial if initial in KEEPS and initial != "o" else "o"
            self.counts["truncated"] += cut
            self.codes.append(code.upper() if cut else code)
            self.said.append((role, text))
            self.chars += len(text)
        if gone:
            self.codes.append("x" * gone)

    @property
    def full(self) -> bool:
        return len(self.codes) >= CHUNK_ROWS or self.chars >= CHUNK_CHARS

    def solved(self) -> dict:
        """The result of a conversation that is this piece alone."""
        codes = "".join(self.codes)
        vector, total, seen = sweep(codes, ENDING)
        letters, state = trace(codes, seen, START)
        lines = repaired_lines(letters, codes, self.said, START) + inserted(closing(state), state)
        turns = self.counts.pop("turns")
        return self.counts | {
            "conv_id": self.conv_id,
            "gaps": 0 if self.low is None else self.high - self.low + 1 - turns,
            "cost": total + vector[START],
            "audit": "".join(letters) + closing(state),
            "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        }

    def chunk(self, number: int) -> dict:
        return self.counts | {
            "conv_id": self.conv_id, "chunk": number, "codes": "".join(self.codes), "roles": [r for r, _ in self.said], "texts": [t for _, t in self.said],
            "low_turn": self.low, "high_turn": self.high, "first_initial": self.first, "last_initial": self.last,
        }


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows to results, and to chunks of the conversations that may go on elsewhere."""
    schema = arrow_schema(FOUND)
    number = TaskContext.get().partitionId() << 32
    piece, open_ = None, True  # the first conversation may have begun in an earlier partition
    out: list[dict] = []
    for batch in text_chunks(batches):
        for conv_id, turn, role, copies, blank, late, cut, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if piece is None or piece.conv_id != conv_id:
                if piece is not None:
                    out.append(piece.chunk(number) if open_ else piece.solved())
                    number, open_ = number + open_, False
                piece = Piece(conv_id)
            elif piece.full:
                out.append(piece.chunk(number))
                number, open_ = number + 1, True
                piece = Piece(conv_id)
            if copies:
                piece.add(turn, role, text, copies, blank, late, cut)
        yield pa.RecordBatch.from_pylist(out, schema)
        out = []
    if piece is not None:
        yield pa.RecordBatch.from_pylist([piece.chunk(number)], schema)


def _ordered(rows: DataFrame) -> DataFrame:
    """Distinct rows with their number of copies and faults, in order, dealt out by ranges."""
    keys = ["conv_id", "turn", "role", "text"]
    distinct = rows.groupBy(*keys).agg(F.sum("copies").alias("copies"))
    bare = F.rtrim(F.col("text"), F.lit(SPACES))
    name = F.md5(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.length("role").cast("string"), "role", "text"))
    told = distinct.withColumn("blank", bare == "").withColumn("cut", ~F.right(bare, F.lit(1)).isin(".", "!", "?")).withColumn("name", name)
    several = told.where("copies > 0 and not blank").groupBy("name")
    several = several.agg(F.count("*").alias("places"), F.min("turn").alias("earliest"), F.bool_or(F.col("turn").isNull()).alias("unnumbered")).where("places > 1")
    first = F.when(F.col("unnumbered"), F.lit(None).cast("long")).otherwise(F.col("earliest"))
    late = F.col("places").isNotNull() & ~first.eqNullSafe(F.col("turn"))
    joined = told.join(several, "name", "left").select("conv_id", "turn", "role", "copies", "blank", late.alias("late"), "cut", "text")
    order = [F.col(k).asc_nulls_first() for k in keys]
    return joined.repartitionByRange(*order[:3], F.left("text", F.lit(32))).sortWithinPartitions(*order)


def repair(rows: DataFrame) -> DataFrame:
    """Rows of RESULT, one a conversation. `rows`: conv_id, turn, role, text and, optionally, `copies`,
    how many times a row stands there; one of 0 only names its conversation."""
    copies = F.col("copies").cast("long") if "copies" in rows.columns else F.lit(1).cast("long")
    there = copies > 0
    space = lambda c: F.when(there, F.coalesce(F.col(c), F.lit(" "))).otherwise("").alias(c)
    plain = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.when(there, F.col("turn").cast("long")).alias("turn"), space("role"), space("text"), copies.alias("copies"))
    found = materialize(_ordered(plain).mapInArrow(_pieces, FOUND), "conversations")
    names = [c.split()[0] for c in RESULT.split(", ")]
    whole = found.where("chunk is null").select(*names)
    return whole.unionByName(_stitched(found.where("chunk is not null")))


def _mapped(rows: DataFrame, f: Callable[[dict], dict], ddl: str) -> DataFrame:
    """One row for each, by itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 16):
                yield pa.RecordBatch.from_pylist([f(r) for r in batch.slice(at, 16).to_pylist()], arrow_schema(ddl))

    return rows.mapInArrow(run, ddl)


def _scanned(rows: DataFrame, f: Callable[[Iterator[dict]], Iterator[dict]], ddl: str, descending: bool = False) -> DataFrame:
    """Chunks of a conversation one after the other, as a stream; f sees all rows of a task."""
    by = F.col("chunk").desc() if descending else F.col("chunk").asc()
    sorted_ = rows.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = (r for batch in batches for at in range(0, batch.num_rows, 16) for r in batch.slice(at, 16).to_pylist())
        for row in f(each):
            yield pa.RecordBatch.from_pylist([row], arrow_schema(ddl))

    return sorted_.mapInArrow(run, ddl)


SWEPT = "conv_id long, chunk long, next long, ending array<int>, start array<int>, total long"


def _first_sweep(r: dict) -> dict:
    start, total, _ = sweep(r["codes"], ENDING)
    return {k: r[k] for k in ("conv_id", "chunk", "next")} | {"ending": ENDING, "start": start, "total": total}


def _fixed_sweep(r: dict) -> dict:
    start, total = resweep(r["codes"], tuple(r["wanted"]), tuple(r["ending"]), tuple(r["start"]), r["total"])
    return {k: r[k] for k in ("conv_id", "chunk", "next")} | {"ending": r["wanted"], "start": start, "total": total}


def _converged(chunks: DataFrame, fixups: int = FIXUPS) -> DataFrame:
    """SWEPT rows in which each chunk ends with the vector its successor starts with."""
    follow = Window.partitionBy("conv_id").orderBy("chunk")  # two numbers a chunk
    linked = chunks.select("conv_id", "chunk", F.lead("chunk").over(follow).alias("next"))
    codes = chunks.select("chunk", "codes")
    swept = materialize(_mapped(linked.join(codes, "chunk"), _first_sweep, SWEPT), "swept")
    for k in range(fixups + 1):
        after = swept.select(F.col("chunk").alias("next"), F.col("start").alias("wanted"))
        stale = swept.join(after, "next").where("ending <> wanted")
        if k == fixups and not stale.isEmpty():
            stale = swept.join(_composed(swept.join(codes, "chunk")), "chunk").where("ending <> wanted")
        again = materialize(_mapped(stale.join(codes, "chunk"), _fixed_sweep, SWEPT), "fixed")
        if again.isEmpty():
            break
        rest = swept.join(again.select("chunk"), "chunk", "left_anti").select(again.columns)
        swept = materialize(rest.unionByName(again), "swept")
    return swept


def between(codes: str) -> list[list[int]]:
    """Least costs from each state before the rows to each state after them."""
    columns = []
    for state in range(4):
        vector, total, _ = sweep(codes, tuple(0 if s == state else FAR for s in range(4)))
        columns.append([c + total if c < FAR else NEVER for c in vector])
    return [[columns[after][state] for after in range(4)] for state in range(4)]


def _composed(swept: DataFrame) -> DataFrame:
    """(chunk, wanted): the vector behind each chunk, by composition from the last chunk on."""
    reduced = _mapped(swept, lambda r: {"conv_id": r["conv_id"], "chunk": r["chunk"], "costs": [c for row in between(r["codes"]) for c in row]}, "conv_id long, chunk long, costs array<long>")

    def run(rows: Iterator[dict]) -> Iterator[dict]:
        of, vector = (), ENDING
        for r in rows:
            if (r["conv_id"],) != of:
                of, vector = (r["conv_id"],), ENDING
            yield {"chunk": r["chunk"], "wanted": vector}
            costs = [min(r["costs"][4 * state + after] + vector[after] for after in range(4)) for state in range(4)]
            vector = tuple(c - min(costs) for c in costs)

    return _scanned(reduced, run, "chunk long, wanted array<int>", descending=True)


def _exits(r: dict) -> dict:
    """State behind a chunk for each state it may be entered in."""
    _, _, seen = sweep(r["codes"], tuple(r["ending"]))
    return {k: r[k] for k in ("conv_id", "chunk", "low_turn", "high_turn", "first_initial", "last_initial")} | {"exits": [trace(r["codes"], seen, s)[1] for s in range(4)]}


def _entries(rows: Iterator[dict]) -> Iterator[dict]:
    """Entry state of each chunk, and what its first row adds to the counts beside the row before."""
    of, state, turn, initial = (), START, None, None
    for r in rows:
        if (r["conv_id"],) != of:
            of, state, turn, initial = (r["conv_id"],), START, None, None
        illegal = initial is not None and r["first_initial"] is not None and initial + r["first_initial"] not in LEGAL
        yield {"chunk": r["chunk"], "state": state, "same_turn": int(turn is not None and turn == r["low_turn"]), "broken": int(illegal)}
        state = r["exits"][state]
        turn = r["high_turn"] if r["high_turn"] is not None else turn
        initial = r["last_initial"] if r["last_initial"] is not None else initial


_PART = "conv_id long, chunk long, low_turn long, high_turn long, turns long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, lines string"


def _part(r: dict) -> dict:
    _, _, seen = sweep(r["codes"], tuple(r["ending"]))
    letters, state = trace(r["codes"], seen, r["state"])
    lines = repaired_lines(letters, r["codes"], list(zip(r["roles"], r["texts"], strict=True)), r["state"])
    end = closing(state) if r["next"] is None else ""
    return {k: r[k] for k in ("conv_id", "chunk", "low_turn", "high_turn", "blank", "duplicate", "truncated")} | {
        "turns": r["turns"] - r["same_turn"],
        "illegal": r["illegal"] + r["broken"],
        "cost": r["total"],
        "audit": "".join(letters) + end,
        "lines": "\n".join(lines + inserted(end, state)),
    }


def _joined(rows: Iterator[dict]) -> Iterator[dict]:
    """A conversation's parts, in order, to its result. The text passes through the digest."""
    now, digest, audit, low, high = None, hashlib.sha256(), [], None, None

    def result() -> dict:
        turns = now.pop("turns")
        return now | {"gaps": 0 if low is None else high - low + 1 - turns, "audit": "".join(audit), "repaired_sha256": digest.hexdigest()}

    sums = ["blank", "duplicate", "truncated", "illegal", "turns", "cost"]
    for r in rows:
        if now is None or now["conv_id"] != r["conv_id"]:
            if now is not None:
                yield result()
            now, digest, audit, low, high, begun = {"conv_id": r["conv_id"]} | dict.fromkeys(sums, 0), hashlib.sha256(), [], None, None, False
        for c in sums:
            now[c] += r[c]
        low, high = r["low_turn"] if low is None else low, high if r["high_turn"] is None else r["high_turn"]
        audit.append(r["audit"])
        if r["lines"]:
            digest.update((b"\n" if begun else b"") + r["lines"].encode())
            begun = True
    if now is not None:
        yield result()


def _stitched(chunks: DataFrame) -> DataFrame:
    swept = _converged(chunks)
    told = swept.select("chunk", "next", "ending", "total").join(chunks, "chunk")
    entries = materialize(_scanned(_mapped(told, _exits, "conv_id long, chunk long, low_turn long, high_turn long, first_initial string, last_initial string, exits array<int>"), _entries, "chunk long, state long, same_turn long, broken long"), "entries")
    parts = _mapped(told.join(entries, "chunk"), _part, _PART)
    first = swept.join(swept.select(F.col("next").alias("chunk")), "chunk", "left_anti").select(F.col("chunk"), F.col("start")[START].cast("long").alias("beginning"))
    costed = parts.join(first, "chunk", "left").withColumn("cost", F.col("cost") + F.coalesce("beginning", F.lit(0))).drop("beginning")
    return _scanned(costed, _joined, RESULT)


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies: the rows after a fixed damage chosen by a hash of
    `conv_id:turn`; nulls count as one space."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn"))) % 20

    def either(number: int, changed: Column, c: Column) -> Column:
        return F.when(F.col("_kind") == number, changed).otherwise(c)

    text = either(1, F.lit(""), either(2, F.regexp_replace(shown("text"), "[.!?]", ""), shown("text")))
    copies = F.when(F.col("_kind") == 0, 0).when(F.col("_kind") == 3, 2).otherwise(1)
    rows = conversations.select("conv_id", "turn", "role", "text", kind.alias("_kind"))
    return rows.select("conv_id", "turn", either(4, F.lit("user"), shown("role")).alias("role"), text.alias("text"), copies.alias("copies"))
