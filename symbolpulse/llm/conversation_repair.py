"""Repair of the turn structure of conversations by an auction for shortest paths.

A conversation is legal if the initials of its roles read ``(s?(ua)+)?``.  Its rows, in order, and the
four states of that expression span a lattice.  Arcs are edits of integer cost: keep a row (0), give
it the role user or assistant (1), delete it (2), insert an empty turn (5); a truncated row that
stays costs 5 more, blank and repeated rows have no arc but deletion.  The repair is a
shortest path through the lattice.

The auction holds a price for each node, at no time more than the cost of an arc plus the price at its end.
A path starts at the entry.  If its last node's price is below the best of its arcs, the price rises to
that and the path contracts by one node, else the path extends along the best arc.  When the path
reaches the end, the price of the entry is the shortest distance and every arc of every shortest
path is tight (price equals cost plus next price).  Tight arcs that lead to the end are traced
from the entry by the least initial (D, I, K, R), which gives the least of all cheapest edits.

Conversations are cut into blocks of bounded rows and bytes, which are the rows of all later steps:
a long conversation spreads over tasks.  Blocks of long conversations tell their costs between
states, these are folded from the end into prices behind each block, blocks are then
traced on their own for each entry state.  Only the few numbers of each block meet in
one task; they are less than the audit of the conversation, which the result holds in one row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..operators.storage import stored
from .common import BLANKS, map_texts

NONE = 1 << 60
#: Costs of edits.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: States: nothing yet, after s, after u, after a; what may follow in each.
STATES = 4
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
NAMES = {"u": "user", "a": "assistant"}
#: Prices behind the last row: turns still missing are inserted, as ``TAIL`` says.
END = (0, 2 * INSERT, INSERT, 0)
TAIL = ("", "ua", "a", "")
#: A block ends at so many rows or characters; an auction runs over so many rows.
BLOCK_ROWS, BLOCK_CHARS, LATTICE_ROWS = 512, 1 << 22, 64
HEAD = 256

BLOCK = """at long, whole boolean, marks string, roles array<string>, texts array<string>, first string, last string,
    low_turn long, high_turn long, n_turns long, n_blank long, n_duplicate long, n_truncated long, n_illegal long"""


# ---------------------------------------------------------------- lattice


def mark(initial: str, fault: str) -> str:
    """One letter for a row: ``x`` must go; s, u, a or o (other), in capitals if truncated."""
    if fault in ("blank", "duplicate"):
        return "x"
    letter = initial if initial in ("s", "u", "a") else "o"
    return letter.upper() if fault == "truncated" else letter


def _row_arcs(letter: str, state: int) -> list[tuple[str, int, int]]:
    """Edits of a row in a state: initial of the edit, cost, next state."""
    arcs = [("D", DELETE, state)]
    if letter != "x":
        own, more = letter.lower(), TRUNCATED if letter.isupper() else 0
        for follows, to in NEXT[state].items():
            if follows == own:
                arcs.append(("K", more, to))
            elif follows in NAMES:
                arcs.append(("R", more + REROLE, to))
    return arcs


ARCS = {letter: [_row_arcs(letter, q) for q in range(STATES)] for letter in "xsuaoSUAO"}
INSERTS = [[("I", INSERT, to) for follows, to in NEXT[q].items() if follows in NAMES] for q in range(STATES)]
LEAST = {letter: min(cost for arcs in ARCS[letter] for _, cost, _ in arcs) for letter in ARCS}


@lru_cache(maxsize=20_000)
def _auction(marks: str, ends: tuple[int, ...], starts: tuple[int, ...]) -> tuple[list[int], list[list[tuple[str, int, int]]], list[bool]]:
    """Prices, arcs and use of the nodes of a lattice; node ``4 * row + state``.

    ``ends`` are the prices behind the last row, ``NONE`` where no path may end.  A node is in use
    if tight arcs lead from it to an end.
    """
    rows = len(marks)
    price = [NONE] * (STATES * rows) + list(ends)
    arcs: list[list[tuple[str, int, int]]] = [[] for _ in range(STATES * rows)]
    floor = min(ends)
    for row in range(rows - 1, -1, -1):
        floor += LEAST[marks[row]]
        at = STATES * row
        for q in range(STATES):
            arcs[at + q] = [(e, c, at + STATES + to) for e, c, to in ARCS[marks[row]][q] if price[at + STATES + to] < NONE]
            if arcs[at + q]:
                price[at + q] = floor
        for q in (2, 3, 2, 1, 0):  # a state may also get on through turns put in before this row
            more = [(e, c, at + to) for e, c, to in INSERTS[q] if price[at + to] < NONE]
            arcs[at + q] = [a for a in arcs[at + q] if a[0] != "I"] + more
            if arcs[at + q]:
                price[at + q] = floor
    for start in starts:
        if price[start] >= NONE:
            continue
        path = [start]
        while (node := path[-1]) < STATES * rows:
            best, to = NONE, node
            for _, cost, end in arcs[node]:
                if cost + price[end] < best:
                    best, to = cost + price[end], end
            if price[node] < best:
                price[node] = best
                if len(path) > 1:
                    path.pop()
            else:
                path.append(to)
    used = [False] * (STATES * rows) + [p < NONE for p in ends]
    for row in range(rows - 1, -1, -1):
        for q in (2, 3, 2, 1, 0):
            node = STATES * row + q
            used[node] = used[node] or any(used[end] and price[node] == cost + price[end] for _, cost, end in arcs[node])
    return price, arcs, used


def _cuts(marks: str) -> list[str]:
    return [marks[i : i + LATTICE_ROWS] for i in range(0, len(marks), LATTICE_ROWS)]


def prices_before(marks: str, ends: tuple[int, ...], starts: tuple[int, ...] = (0, 1, 2, 3)) -> list[tuple[int, ...]]:
    """Prices before each lattice of ``marks``, and ``ends`` as the last."""
    found, cuts = [ends], _cuts(marks)
    for i in range(len(cuts) - 1, -1, -1):
        price, _, _ = _auction(cuts[i], found[0], starts if i == 0 else (0, 1, 2, 3))
        found.insert(0, tuple(price[:STATES]))
    return found


def trace(marks: str, found: list[tuple[int, ...]], state: int) -> tuple[str, int]:
    """The least of the cheapest edits from ``state``, and the state behind them."""
    edits = []
    cuts = _cuts(marks)
    for i, cut in enumerate(cuts):
        starts = (0, 1, 2, 3) if i or found[i][state] >= NONE else (state,)
        price, arcs, used = _auction(cut, found[i + 1], starts)
        node = state
        while node < STATES * len(cut):
            edit, _, node = min(a for a in arcs[node] if used[a[2]] and price[node] == a[1] + price[a[2]])
            edits.append(edit)
        state = node - STATES * len(cut)
    return "".join(edits), state


def between(marks: str) -> list[int]:
    """Cost from each state before to each state behind ``marks``; ``NONE`` where there is no way."""
    out = [NONE] * (STATES * STATES)
    for q in range(STATES):
        ends = tuple(0 if e == q else NONE for e in range(STATES))
        for start, cost in enumerate(prices_before(marks, ends)[0]):
            out[STATES * start + q] = min(cost, NONE)
    return out


def turns_left(edits: str, state: int, roles: list[str], texts: list[str]) -> list[tuple[str, str]]:
    """Role and text of the turns that ``edits`` leave or put in."""
    out, row = [], 0
    for edit in edits:
        if edit == "D":
            row += 1
            continue
        if edit == "K":
            role, text = roles[row], texts[row]
            state = NEXT[state][role[0]]
        else:
            follows = next(c for c in NEXT[state] if c in NAMES)
            role, text, state = NAMES[follows], texts[row] if edit == "R" else "", NEXT[state][follows]
        row += edit != "I"
        out.append((role, text))
    return out


# ---------------------------------------------------------------- rows into blocks


def _ordered(rows: DataFrame) -> DataFrame:
    """All rows with their fault, in order of ``conv_id``, turn, role and text.

    The rows are stored with a number first: it tells equal rows apart, and a group of
    equal rows may be cut anywhere.
    """
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    rest = F.rtrim(text, F.lit(BLANKS))
    rows = rows.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), F.sha2(text, 256).alias("same"),
        (rest == "").alias("blank"), (~F.right(rest, F.lit(1)).isin(".", "!", "?")).alias("truncated"), F.monotonically_increasing_id().alias("number"),
    )
    rows = stored(rows, "turns")
    key = ["conv_id", "role", "same"]
    first = rows.where("not blank").groupBy(*key).agg(F.min(F.struct("turn", "number")).alias("first"), F.count(F.lit(1)).alias("n"))
    first = stored(first.where("n > 1"), "repeated-turns")
    rows = _with_first(rows, first)
    repeated = F.col("first").isNotNull() & (F.struct("turn", "number") > F.col("first"))
    fault = F.when(F.col("blank"), "blank").when(repeated, "duplicate").when(F.col("truncated"), "truncated").otherwise("")
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "head", "same", "number"]
    rows = rows.select("conv_id", "turn", "role", "text", "same", "number", fault.alias("fault"), F.substring("text", 1, HEAD).alias("head"))
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "turn", "role", "text", "fault")


def _with_first(rows: DataFrame, first: DataFrame, hot_share: int = 1000) -> DataFrame:
    """``rows`` with the first row of their key, null if the key has one row.

    Keys that own more than one ``hot_share``-th of the repeats are fewer than ``hot_share``, which bounds
    their broadcast.  If all keys are that few, no row is shuffled here.
    """
    names = ["conv_id", "role", "same"]

    def meet(left: DataFrame, keyed: DataFrame, how: str) -> DataFrame:
        keyed = keyed.select(*(F.col(c).alias(f"key_{c}") for c in names), *(["first"] if how != "left_anti" else []))
        same = [left[c].eqNullSafe(keyed[f"key_{c}"]) for c in names]
        return left.join(keyed, same, how).drop(*(f"key_{c}" for c in names))

    keys, total = first.agg(F.count(F.lit(1)), F.sum("n")).first()
    if keys <= hot_share:
        return meet(rows, F.broadcast(first), "left")
    hot, cold = F.broadcast(first.where(F.col("n") > total // hot_share)), first.where(F.col("n") <= total // hot_share)
    return meet(rows, hot, "inner").unionByName(meet(meet(rows, hot, "left_anti"), cold.hint("shuffle_hash"), "left"))


def _fields(blocks: DataFrame, more: str) -> StructType:
    return StructType([blocks.schema["conv_id"], *StructType.fromDDL(more).fields])


def _blocks(ordered: DataFrame, block_rows: int) -> DataFrame:
    """Consecutive rows of one conversation as one row; ``at`` orders the blocks."""
    shape = _fields(ordered, BLOCK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_type

        schema = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in shape.fields])
        at = TaskContext.get().partitionId() << 40
        held: list[dict] = []
        chars, done, size = 0, [], 0
        apart = False  # no other task and no earlier block holds rows of this conversation

        def close(ends: bool) -> dict:
            nonlocal at
            at += 1
            initials = [r["role"][:1] for r in held]
            turns = [r["turn"] for r in held if r["turn"] is not None]
            faults = [r["fault"] for r in held]
            return {
                "conv_id": held[0]["conv_id"], "at": at, "whole": apart and ends, "marks": "".join(map(mark, initials, faults)),
                "roles": [r["role"] for r in held], "texts": [r["text"] for r in held], "first": initials[0], "last": initials[-1],
                "low_turn": turns[0] if turns else None, "high_turn": turns[-1] if turns else None, "n_turns": len(set(turns)),
                **{f"n_{f}": faults.count(f) for f in ("blank", "duplicate", "truncated")},
                "n_illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
            }

        for batch in batches:
            for row in batch.to_pylist():
                other = bool(held) and row["conv_id"] != held[0]["conv_id"]
                if other or len(held) >= block_rows or chars >= BLOCK_CHARS:
                    done.append(close(other))
                    size, chars, held, apart = size + chars, 0, [], other
                held.append(row)
                chars += len(row["text"])
                if len(done) >= 1000 or size >= BLOCK_CHARS:
                    yield pa.RecordBatch.from_pylist(done, schema)
                    done, size = [], 0
        if held:
            done.append(close(False))
        if done:
            yield pa.RecordBatch.from_pylist(done, schema)

    return map_texts(ordered, run, shape)


# ---------------------------------------------------------------- solution

COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
TURNS = "array<struct<role:string,text:string>>"


def _alone(blocks: DataFrame) -> DataFrame:
    """Conversations of one block, solved where they are."""
    shape = _fields(blocks, ", ".join(f"{c} long" for c in COUNTS) + f", audit string, turns {TURNS}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = [to_arrow_type(f.dataType) for f in shape.fields]
        for batch in batches:
            out: list[list] = [[] for _ in shape.fields[1:]]
            for b in batch.to_pylist():
                found = prices_before(b["marks"], END, (0,))
                edits, state = trace(b["marks"], found, 0)
                left = turns_left(edits, 0, b["roles"], b["texts"]) + [(NAMES[c], "") for c in TAIL[state]]
                gaps = b["high_turn"] - b["low_turn"] + 1 - b["n_turns"] if b["n_turns"] else 0
                row = (gaps, b["n_blank"], b["n_duplicate"], b["n_truncated"], b["n_illegal"], found[0][0], edits + "I" * len(TAIL[state]))
                for column, value in zip(out, (*row, [{"role": r, "text": t} for r, t in left])):
                    column.append(value)
            columns = [batch.column("conv_id"), *(pa.array(c, k) for c, k in zip(out, kinds[1:]))]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in shape.fields])

    return map_texts(blocks, run, shape)


def _prices_behind(steps: list) -> list[tuple[int, list[int]]]:
    """Prices behind each block of a conversation, folded from its end."""
    ends, out = list(END), []
    for step in reversed(steps):
        out.append((step["at"], ends))
        ends = [min(min(c + e for c, e in zip(step["costs"][STATES * q :], ends)), NONE) for q in range(STATES)]
    return out


def _ways(marks: str, ends: list[int]) -> list[tuple[str, int, int]]:
    """Edits of a block from each state before it, the state behind, and the cost from there to the end of all."""
    found = prices_before(marks, tuple(ends))
    return [(*trace(marks, found, q), found[0][q]) if found[0][q] < NONE else ("", -1, NONE) for q in range(STATES)]


def _composed(steps: list) -> tuple:
    """Report of a conversation from its blocks in order, and the state before each block."""
    state, edits, states, illegal = 0, [], [], 0
    low = high = None
    n = 0
    for i, s in enumerate(steps):
        states.append((s["at"], state))
        edits.append(s["ways"][state]["edits"])
        illegal += i > 0 and steps[i - 1]["last"] + s["first"] not in ("su", "ua", "au")
        if s["low_turn"] is not None:
            low = s["low_turn"] if low is None else low
            n += s["n_turns"] - (high == s["low_turn"])
            high = s["high_turn"]
        state = s["ways"][state]["state"]
    audit = "".join(edits) + "I" * len(TAIL[state])
    return high - low + 1 - n if n else 0, illegal, steps[0]["ways"][0]["cost"], audit, states, TAIL[state]


def _long(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Report and turns, block by block, of conversations of any number of blocks; see the head of this file."""

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            costs = pa.array([between(m) for m in batch.column("marks").to_pylist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("at"), costs], names=["conv_id", "at", "costs"])

    costs = blocks.select("conv_id", "at", "marks").mapInArrow(tell, _fields(blocks, "at long, costs array<long>"))
    fold = F.udf(_prices_behind, "array<struct<at:bigint,ends:array<bigint>>>")
    priced = costs.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("at", "costs"))).alias("steps"))
    priced = priced.select(F.explode(fold("steps")).alias("s")).select(F.col("s.at").alias("to"), F.col("s.ends").alias("ends"))
    known = blocks.join(priced.hint("shuffle_hash"), F.col("at") == F.col("to")).drop("to")
    follow = F.udf(_ways, "array<struct<edits:string,state:int,cost:bigint>>")
    traced = stored(known.withColumn("ways", follow("marks", "ends")), "traced-turns")

    step = F.struct("at", "first", "last", "low_turn", "high_turn", "n_turns", "ways")
    sums = [F.sum(f"n_{c}").alias(c) for c in ("blank", "duplicate", "truncated", "illegal")]
    compose = F.udf(_composed, "struct<gaps:bigint,edges:bigint,cost:bigint,audit:string,states:array<struct<at:bigint,state:int>>,tail:string>")
    whole = traced.groupBy("conv_id").agg(F.sort_array(F.collect_list(step)).alias("steps"), *sums)
    whole = stored(whole.withColumn("c", compose("steps")).drop("steps"), "repaired-turns")
    report = whole.select(
        "conv_id", "c.gaps", "blank", "duplicate", "truncated", (F.col("illegal") + F.col("c.edges")).alias("illegal"), "c.cost", "c.audit"
    )

    states = whole.select(F.explode("c.states").alias("s")).select(F.col("s.at").alias("to"), F.col("s.state").alias("state"))
    write = F.udf(lambda ways, state, roles, texts: turns_left(ways[state]["edits"], state, roles, texts), TURNS)
    turns = traced.join(states.hint("shuffle_hash"), F.col("at") == F.col("to"))
    turns = turns.select("conv_id", "at", write("ways", "state", "roles", "texts").alias("turns"))
    names = F.create_map(*(F.lit(x) for c in NAMES.items() for x in c))
    tail = F.transform(F.split("c.tail", ""), lambda c: F.struct(names[c].alias("role"), F.lit("").alias("text")))
    tails = whole.where("c.tail <> ''").select("conv_id", F.lit(1 << 62).alias("at"), tail.alias("turns"))
    return report, turns.unionByName(tails)


class Repair:
    """Conversations after repair.

    ``whole``: one row for each conversation of one block, its report and ``turns``.
    ``report`` and ``turns``: the same of all others, turns in several rows ordered by ``at``.
    A report is ``gaps, blank, duplicate, truncated, illegal, cost, audit``.
    """

    def __init__(self, whole: DataFrame, report: DataFrame, turns: DataFrame):
        self.whole, self.report, self.turns = whole, report, turns

    def reports(self) -> DataFrame:
        return self.whole.drop("turns").unionByName(self.report)

    def all_turns(self) -> DataFrame:
        """``conv_id, at, turns``; the rows of a conversation in order of ``at`` hold its turns."""
        return self.whole.select("conv_id", F.lit(0).cast("long").alias("at"), "turns").unionByName(self.turns)


def repair(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> Repair:
    """The cheapest legal form of the conversations of ``rows(conv_id, turn, role, text)``.

    Rows count in order of ``turn`` (null first), then role, then the first 256 characters of the
    text, then a hash of the text, so rows of the same turn and equal rows have a defined place.  A null role or text is one
    space.  A null ``conv_id`` is a conversation like any other.  An empty table gives no rows; other columns are left out, so no name can clash.
    """
    blocks = stored(_blocks(_ordered(rows), block_rows), "turn-blocks")
    return Repair(_alone(blocks.where("whole")), *_long(blocks.where("not whole")))


def line(turn: Column) -> Column:
    return F.concat(turn["role"], F.lit(":"), turn["text"])


def digests(repaired: Repair) -> DataFrame:
    """Reports with ``repaired_sha256`` over the lines ``role:text`` of a conversation.

    A digest has no parallel form: the lines of a long conversation pass through one task as a
    stream of blocks, one block in memory at a time.
    """
    joined = F.array_join(F.transform("turns", line), "\n")
    whole = repaired.whole.withColumn("repaired_sha256", F.sha2(joined, 256)).drop("turns")
    chunks = repaired.turns.where("size(turns) > 0").select("conv_id", "at", joined.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, now, digest = None, None, None

        def result() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], kind), pa.array([digest.hexdigest()])], names=["of", "repaired_sha256"])

        for batch in batches:
            kind = batch.schema.field("conv_id").type
            for conv, text in zip(batch.column("conv_id").to_pylist(), batch.column("text")):
                if digest is not None and conv == now:
                    digest.update(b"\n")
                else:
                    if digest is not None:
                        yield result()
                    now, digest = conv, hashlib.sha256()
                digest.update(text.as_buffer())
        if digest is not None:
            yield result()

    kind = repaired.report.schema["conv_id"].dataType
    shape = StructType([StructField("of", kind), *StructType.fromDDL("repaired_sha256 string").fields])
    of = map_texts(chunks.repartition("conv_id").sortWithinPartitions("conv_id", "at"), run, shape)
    report = repaired.report.join(of.hint("shuffle_hash"), F.col("conv_id").eqNullSafe(F.col("of")), "left").drop("of")
    return whole.unionByName(report.withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest()))))


def damage(rows: DataFrame) -> DataFrame:
    """``rows(conv_id, turn, role, text)`` with faults chosen by crc32 of ``conv_id:turn`` modulo 20.

    0 drops the row, 1 empties its text, 2 takes ``.``, ``!`` and ``?`` out of it, 3 repeats the row, 4 sets the
    role user.  Nulls in the key, role and text are one space.
    """
    key = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    k = F.crc32(F.concat_ws(":", *key)) % 20
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), k.alias("k")).where("k <> 0")
    return rows.select(
        "conv_id", "turn", F.when(F.col("k") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")
