"""Conversation structure repair by shortest paths over edits.

A conversation's turns are damaged by a seeded rule, faults are marked, and the cheapest edits are found that
bring its roles into the form `(s?(ua)+)?`: keep, rerole, delete, insert.  The states are (turns done, role that came
last); costs are small integers, so Dial's bucket queue gives the least cost from every state to the end.  Arcs on
which that cost falls by just their own are tight; walking them, the least letter first, gives the audit.

Conversations of any length: all rows are sorted over all partitions by conversation and turn.  What lies in one
partition whole is repaired there, one conversation at a time.  One that reaches over several partitions is a row of
*pieces*, at most two a partition: each piece gives its least costs from state to state, the driver chains those
few numbers, each piece tells where the walk leaves it, and then each walks its own part.
"""

from __future__ import annotations

import hashlib
import pickle
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby, islice, pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

from fieldledger.llm.base import SLICE_ROWS, cut, read_table

#: Fixed by the contract.
WHITE = " \t\n\x0b\x0c\r"
LEGAL_PAIRS = ("su", "ua", "au")
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: What came last: nothing, s, u, a.  The one role that may be inserted or rerolled to next, and the states where a conversation may end.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)
FINAL = (START, ASSISTANT)
ROLE = {USER: "user", ASSISTANT: "assistant"}
KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
FAR = 1 << 60
#: Least cost from each state after the last turn, by insertions only.
AT_END = (0, 2 * INSERT, INSERT, 0)
#: Wider than the dearest arc and than the spread of AT_END.
BUCKETS = 32
SHOWN = 32

Turn = tuple[str, bool, bool]  # role initial, must be deleted, truncated


def distances(turns: list[Turn], at_end) -> list[list[int]]:
    """costs[i][q]: the least cost from state q before turn i to the end, where state q costs ``at_end[q]``.  Dial's algorithm, backwards.

    Insertions stand before a turn; those after the last one are part of ``at_end``.
    """
    n = len(turns)
    cost = [[FAR] * 4 for _ in range(n)] + [list(at_end)]
    buckets: list[list[tuple[int, int]]] = [[] for _ in range(BUCKETS)]
    waiting, d = 0, min(at_end)
    for q in range(4):
        if at_end[q] < FAR:
            buckets[at_end[q] % BUCKETS].append((n, q))
            waiting += 1
    while waiting:
        bucket = buckets[d % BUCKETS]
        while bucket:
            i, q = bucket.pop()
            waiting -= 1
            if cost[i][q] != d:
                continue  # stale
            arcs = []
            if i:
                initial, forced, truncated = turns[i - 1]
                arcs.append((i - 1, q, DELETE))
                if not forced:
                    more = TRUNCATED if truncated else 0
                    arcs += [(i - 1, p, REROLE + more) for p in range(4) if NEXT[p] == q]
                    arcs += [(i - 1, p, KEEP + more) for p in range(4) if KEPT.get((p, initial)) == q]
            if i < n:
                arcs += [(i, p, INSERT) for p in range(4) if NEXT[p] == q]
            for j, p, c in arcs:
                if d + c < cost[j][p]:
                    cost[j][p] = d + c
                    buckets[(d + c) % BUCKETS].append((j, p))
                    waiting += 1
        d += 1
    return cost


def walk(turns: list[Turn], cost: list[list[int]], q: int) -> Iterator[tuple[int, str, int]]:
    """(turn, letter, state after it) along tight arcs from state q before the first turn, the least letter first."""
    i, n = 0, len(turns)
    while i < n:
        initial, forced, truncated = turns[i]
        more, d, kept = TRUNCATED if truncated else 0, cost[i][q], KEPT.get((q, turns[i][0]))
        if d == DELETE + cost[i + 1][q]:
            yield i, "D", q
            i += 1
        elif d == INSERT + cost[i][NEXT[q]]:
            q = NEXT[q]
            yield i, "I", q
        elif not forced and kept is not None and d == KEEP + more + cost[i + 1][kept]:
            q = kept
            yield i, "K", q
            i += 1
        else:
            q = NEXT[q]
            yield i, "R", q
            i += 1


def ending(q: int) -> list[int]:
    """The states that insertions after the last turn bring."""
    return {START: [], ASSISTANT: [], USER: [ASSISTANT], SYSTEM: [USER, ASSISTANT]}[q]


@dataclass
class Tally:
    """Counts over turns in order; those of two stretches add up to those of both."""

    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    rows: int = 0
    first_initial: str = ""
    last_initial: str = ""
    turns: int = 0  # different ones, not null
    first_turn: int | None = None
    last_turn: int | None = None

    def then(self, o: Tally) -> Tally:
        if not self.rows or not o.rows:
            return self if not o.rows else o
        joint = self.last_initial + o.first_initial not in LEGAL_PAIRS
        same = self.last_turn is not None and self.last_turn == o.first_turn
        return Tally(
            self.blank + o.blank, self.duplicate + o.duplicate, self.truncated + o.truncated, self.illegal + o.illegal + joint, self.rows + o.rows, self.first_initial, o.last_initial,
            self.turns + o.turns - same, self.first_turn if self.first_turn is not None else o.first_turn, o.last_turn if o.last_turn is not None else self.last_turn,
        )

    def gaps(self) -> int:
        return 0 if self.first_turn is None else self.last_turn - self.first_turn + 1 - self.turns


def tally_of(turn: int | None, initial: str, blank: bool, duplicate: bool, truncated: bool) -> Tally:
    return Tally(int(blank), int(duplicate and not blank), int(truncated and not (blank or duplicate)), 0, 1, initial, initial, int(turn is not None), turn, turn)


def damaged(rows: DataFrame) -> DataFrame:
    """The rows (conv_id, turn, role, text) after the contract's damage, those it drops marked ``gone``; role and text have no nulls.

    A repeated row stands twice.  ``row_no`` is distinct, for splits and joins.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    damage = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20
    out = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"), damage.alias("damage"))
    out = out.withColumn("role", F.when(F.col("damage") == 4, "user").otherwise(F.col("role")))
    out = out.withColumn("text", F.when(F.col("damage") == 1, "").when(F.col("damage") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")))
    out = out.withColumn("gone", F.col("damage") == 0)
    out = out.withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.when(F.col("damage") == 3, 2).otherwise(1)))).drop("damage", "copy")
    stripped = F.rtrim(F.col("text"), F.lit(WHITE))
    return out.withColumns(
        {
            "blank": stripped == "",
            "truncated": ~F.substring(stripped, -1, 1).isin(".", "!", "?"),
            "initial": F.substring("role", 1, 1),
            "shown": F.substring("text", 1, SHOWN),
            "text_key": F.unhex(F.sha2("text", 256)),
            "row_no": F.monotonically_increasing_id(),
        }
    )


def order() -> list[Column]:
    """Conversations together, rows by turn (nulls first), then by role and text; equal rows by their number, so no key is hot.

    Texts go by their first SHOWN characters, then by their hash: the sample that Spark draws for its bounds stays small.
    """
    return [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("shown"), F.col("text_key"), F.col("row_no")]


FIGURES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
RESULT = [*[(c, pa.int64()) for c in FIGURES], ("audit", pa.string()), ("repaired_sha256", pa.string())]
TURN = [("place", pa.int64()), ("role", pa.string()), ("text", pa.string())]
NOTHING = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
#: What is known of a row without its text.
MARKS = ["turn", "initial", "blank", "duplicate", "truncated"]


def figures(t: Tally, cost: int) -> tuple[int, ...]:
    return t.gaps(), t.blank, t.duplicate, t.truncated, t.illegal, cost


def edited(steps) -> Iterator[tuple[str, str | None, str]]:
    """(letter, role, text) of each edit, role null for a deleted turn; ``steps`` are (letter, state after it, role, text)."""
    q = START
    for letter, q, role, text in steps:
        yield letter, {"K": role, "D": None}.get(letter, ROLE.get(q)), "" if letter == "I" else text
    for q in ending(q):
        yield "I", ROLE[q], ""


def told(edits) -> tuple[str, str]:
    """(audit, SHA-256 of the repaired turns), one turn at a time."""
    letters, digest, first = [], hashlib.sha256(), True
    for letter, role, text in edits:
        letters.append(letter)
        if role is not None:
            digest.update(("" if first else "\n").encode() + f"{role}:{text}".encode())
            first = False
    return "".join(letters), digest.hexdigest()


def placed(edits) -> Iterator[tuple[int, str, str]]:
    place = 0
    for _, role, text in edits:
        if role is not None:
            yield place, role, text
            place += 1


def runs_of(batches, keys: list[str], columns: list[str]):
    """(key, iterator over the rows' values of ``columns``) for each run of rows with equal keys, over all batches; an iterator ends where the next is asked for."""
    rows = (row for b in batches for at in range(0, b.num_rows, SLICE_ROWS) for row in zip(*[b.column(c).slice(at, SLICE_ROWS).to_pylist() for c in (*keys, *columns)], strict=True))
    for key, run in groupby(rows, key=lambda row: row[: len(keys)]):
        yield key, (row[len(keys) :] for row in run)


def read_turns(rows) -> tuple[list[Turn], Tally]:
    """Of rows (turn, initial, blank, duplicate, truncated)."""
    turns, tally = [], Tally()
    for turn, initial, blank, duplicate, truncated in rows:
        turns.append((initial, blank or duplicate, truncated))
        tally = tally.then(tally_of(turn, initial, blank, duplicate, truncated))
    return turns, tally


def repaired(batches, as_turns: bool):
    """Sorted rows of whole conversations -> their result, or their turns; one conversation in memory at a time."""
    for (conv_id,), rows in runs_of(batches, ["conv_id"], ["turn", "initial", "blank", "truncated", "role", "text", "gone"]):
        marks, texts, seen = [], [], set()
        for turn, initial, blank, truncated, *said, gone in rows:
            if not gone:
                marks.append((turn, initial, blank, tuple(said) in seen, truncated))
                texts.append(tuple(said))
                seen.add(tuple(said))
        turns, tally = read_turns(marks)
        cost = distances(turns, AT_END)
        edits = edited((letter, q, *texts[i]) for i, letter, q in walk(turns, cost, START))
        if as_turns:
            for x in placed(edits):
                yield conv_id, *x
        else:
            yield conv_id, *figures(tally, cost[0][START]), *told(edits)


def in_batches(make, fields: list[tuple[str, pa.DataType]]):
    """A task function from ``make``, which gives tuples of the fields' values."""
    schema = pa.schema(fields)

    def run(batches):
        rows = make(batches)
        while part := list(islice(rows, SLICE_ROWS)):
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*part, strict=True), schema, strict=True)], schema=schema)

    return run


def mapped(df: DataFrame, make, fields: list[tuple[str, pa.DataType]]) -> DataFrame:
    return df.mapInArrow(in_batches(make, fields), from_arrow_schema(pa.schema(fields)))


def of_pieces(batches, tell):
    """One row of ``tell`` (key, turns, tally) for each piece."""
    for key, rows in runs_of(batches, ["conv_id", "piece"], MARKS):
        yield from tell(key, *read_turns(rows))


def costs_through(turns: list[Turn]) -> list[int]:
    """The least cost from each state before the turns to each after them (FAR: none), 16 numbers."""
    return [c for q in range(4) for c in distances(turns, [0 if p == q else FAR for p in range(4)])[0]]


def split_conversations(pieces: DataFrame) -> list:
    """The conversations in more than one piece: at most one for each end of a piece, so the driver may hold them."""
    ends = sorted(pieces.groupBy("piece").agg(F.min(F.struct("conv_id")).alias("low"), F.max(F.struct("conv_id")).alias("high")).collect(), key=lambda r: r["piece"])
    return sorted({b["low"][0] for a, b in pairwise(ends) if a["high"][0] == b["low"][0]}, key=lambda x: (x is not None, x))


def repair_split(rows: DataFrame, split: list, key: tuple[str, pa.DataType], as_turns: bool) -> DataFrame:
    """What ``repaired`` gives, for conversations in several pieces.

    Their texts are hashed by one task each, as a hash must be, but turn by turn; all else is done piece by piece.
    """
    rows = rows.filter(~F.col("gone"))
    first = rows.groupBy("conv_id", "role", "text_key").agg(F.min(F.struct("turn", "row_no"))["row_no"].alias("row_no")).select("row_no", F.lit(False).alias("later"))
    marks = rows.drop("text", "gone").join(first, "row_no", "left").withColumn("duplicate", F.coalesce("later", F.lit(True)))
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = cut(marks.repartition(n, "conv_id", "piece").sortWithinPartitions("piece", *order()).select("conv_id", "piece", "row_no", *MARKS))
    ids = [key, ("piece", pa.int32())]
    numbers = pa.list_(pa.int64())

    def summary(k, turns, tally):
        yield *k, costs_through(turns), pickle.dumps(tally)

    told_of: dict = {}
    for r in mapped(pieces, lambda b: of_pieces(b, summary), [*ids, ("costs", numbers), ("tally", pa.binary())]).collect():
        told_of.setdefault(r["conv_id"], []).append((r["piece"], r["costs"], pickle.loads(r["tally"])))
    at_end: dict = {}
    result: dict = dict.fromkeys(split, NOTHING[: len(FIGURES)])
    for conv_id, parts in told_of.items():
        d, tally = AT_END, Tally()
        for piece, costs, _ in sorted(parts, reverse=True, key=lambda x: x[0]):
            at_end[conv_id, piece] = d
            d = tuple(min(costs[4 * q + p] + d[q] for q in range(4)) for p in range(4))
        for *_, t in sorted(parts, key=lambda x: x[0]):
            tally = tally.then(t)
        result[conv_id] = figures(tally, d[START])

    def leaving(k, turns, tally):
        cost = distances(turns, at_end[k])
        last = lambda q: deque(((r for _, _, r in walk(turns, cost, q))), maxlen=1)
        yield *k, [(last(q) or [q])[0] for q in range(4)]

    out_of = {(r["conv_id"], r["piece"]): r["states"] for r in mapped(pieces, lambda b: of_pieces(b, leaving), [*ids, ("states", numbers)]).collect()}
    entry: dict = {}
    for conv_id, parts in told_of.items():
        q = START
        for piece in sorted(p for p, *_ in parts):
            entry[conv_id, piece] = q
            q = out_of[conv_id, piece][q]

    def steps(batches):
        for k, piece in runs_of(batches, ["conv_id", "piece"], ["row_no", *MARKS]):
            piece = list(piece)
            turns, _ = read_turns(r[1:] for r in piece)
            for at, (i, letter, q) in enumerate(walk(turns, distances(turns, at_end[k]), entry[k])):
                yield *k, at, piece[i][0], letter, q

    edits = mapped(pieces, steps, [*ids, ("at", pa.int64()), ("row_no", pa.int64()), ("letter", pa.string()), ("state", pa.int32())])
    with_texts = edits.join(rows.select("row_no", "role", "text"), "row_no").repartition(n, "conv_id").sortWithinPartitions("conv_id", "piece", "at")

    def finish(batches):
        for (conv_id,), rows in runs_of(batches, ["conv_id"], ["letter", "state", "role", "text"]):
            if as_turns:
                for x in placed(edited(rows)):
                    yield conv_id, *x
            else:
                yield conv_id, *result[conv_id], *told(edited(rows))

    done = mapped(with_texts, finish, [key, *(TURN if as_turns else RESULT)])
    none = [] if as_turns else [(k, *NOTHING) for k in split if k not in told_of]
    return done.unionByName(rows.sparkSession.createDataFrame(none, done.schema)) if none else done


def repair(conversations: DataFrame, as_turns: bool = False) -> DataFrame:
    """One row for each conv_id: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256; with ``as_turns`` its
    repaired turns instead (conv_id, place, role, text).

    Nulls in role and text count as one blank, null turns come first and leave gaps as they are, a null conv_id is a conversation.
    Rows of one turn go by role, then text; equal rows repeat.  A conversation whose rows are all dropped has zeros, an empty
    audit and the empty string's hash (and no turns).  Other columns are left out; texts of any length are taken whole; an
    empty table gives no rows.
    """
    rows = damaged(conversations)
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = cut(rows.repartitionByRange(n, *order()).sortWithinPartitions(*order()).withColumn("piece", F.spark_partition_id()))
    key = ("conv_id", to_arrow_schema(rows.select("conv_id").schema).field(0).type)
    split = split_conversations(rows)
    fields = [key, *(TURN if as_turns else RESULT)]
    if not split:
        return mapped(rows, lambda b: repaired(b, as_turns), fields)
    s = F.broadcast(rows.sparkSession.createDataFrame([(k,) for k in split], rows.select(F.col("conv_id").alias("s_id")).schema))
    same = F.col("conv_id").eqNullSafe(F.col("s_id"))
    whole = mapped(rows.join(s, same, "left_anti"), lambda b: repaired(b, as_turns), fields)
    return whole.unionByName(repair_split(rows.join(s, same, "left_semi"), split, key, as_turns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(read_table(spark, sf_dir, "conversations"))
