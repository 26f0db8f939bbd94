"""Conversation structure repair: the cheapest edits that give a conversation the role order ``(s?(ua)+)?``.

Rows are kept (0), get role user or assistant (2) or are deleted (3; a must for blank and duplicate rows), and turns
without text are inserted (2); a truncated row that stays costs 1 more. Of the cheapest ways the one whose audit, the
initials of its edits in order, comes first in ASCII order is taken.

A way's weight is one integer. Its high digits are the cost; its low digits are the audit, a field of two letters for each
row (an insertion or none, then the row's edit) and filled up with zero at the end. No field is the beginning of another
one, so the order of such integers is the order of cost, then audit, and fields have fixed places whatever was inserted
before. More than one insertion between two rows never pays: without them, or with the system turn before them deleted, the
conversation costs less. Ways are paths through a graph of (row, state), and the least integer is found by plain
dynamic programming.

Spread over a cluster: equal rows are counted first, rows are range-partitioned in conversation order, so that a conversation of
any size runs on over several partitions, and cut into chunks of ``CHUNK_ROWS`` rows or ``CHUNK_BYTES``. A chunk's effect is
the least integer for each pair of states before and after it; effects of ``FAN`` neighbours are composed in rounds up a tree, and
the states that the best way goes through are handed down again. Then every chunk is repaired on its own. What one
conversation yields as a single value (audit, hash) is put together by one task that reads its chunks in order, one at a time.

Defined cases: null roles and texts are one space, null turns come first, rows of a turn come in the order of role and
text; repeated rows are duplicates; null ``conv_id`` is a conversation like the others; an empty table gives no rows;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import ArrayType, StructType

from driftgate.session import WorkArea

CHUNK_ROWS = 256
CHUNK_BYTES = 4 << 20
FAN = 64

LETTERS = "\0DIKR"  # audit letters by digit
DELETE, INSERT, KEEP, REROLE = 1, 2, 3, 4
#: States: nothing yet, after a system turn, after a user turn, after an assistant turn.
STATES = range(4)
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
LEGAL = ("su", "ua", "au")
ROLES = {"u": "user", "a": "assistant"}
FIELD = 6  # bits: two letters of three
NEVER = None


def _edits(before: int, initial: str, fault: str) -> Iterator[tuple[int, int, int]]:
    """State behind a row, cost and field of all that can be done with it."""
    gaps = [(before, 0, 0)] + [(STEP[before, x], 2, INSERT) for x in "ua" if (before, x) in STEP]
    for state, cost, lead in gaps:
        for letter, price, role in ((DELETE, 3, ""), (KEEP, 0, initial), *((REROLE, 2, x) for x in "ua")):
            after = state if letter == DELETE else STEP.get((state, role))
            if after is None or letter != DELETE and fault in "bd":
                continue
            price += letter != DELETE and fault == "t"
            yield after, cost + price, (lead << 3 | letter) if lead else letter << 3


@lru_cache(4096)
def _moves(initial: str, fault: str) -> list[list[tuple[int, int, int]]]:
    return [list(_edits(q, initial, fault)) for q in STATES]


def _path(marks: str, enter: int) -> list[int | None]:
    """Least weight from ``enter`` to each state over the rows ``marks`` (initial and fault of each)."""
    n = len(marks) // 2
    best = [0 if q == enter else NEVER for q in STATES]
    for i in range(n):
        now: list[int | None] = [NEVER] * 4
        moves, place = _moves(marks[2 * i], marks[2 * i + 1]), FIELD * (n - 1 - i)
        for q in STATES:
            if best[q] is NEVER:
                continue
            for after, cost, field in moves[q]:
                weight = best[q] + (cost << FIELD * n) + (field << place)
                if now[after] is NEVER or weight < now[after]:
                    now[after] = weight
        best = now
    return best


_cached_path = lru_cache(50_000)(_path)


def effect(marks: str) -> list[list[int | None]]:
    path = _cached_path if len(marks) <= 32 else _path
    return [path(marks, q) for q in STATES]


def _append(a: int, b: int, wide: int, bits: int) -> int:
    """Weight of a way with ``wide`` low bits, then one with ``bits``."""
    return (a << bits) + (b >> bits << wide + bits) + (b & (1 << bits) - 1)


def compose(parts: list[tuple[int, list[list[int | None]]]], enter: int) -> tuple[list[int | None], list[list[int]]]:
    """Least weight over all parts (rows and effect) from ``enter`` to each state, and the states on that way."""
    best: list[int | None] = [0 if q == enter else NEVER for q in STATES]
    way: list[list[int]] = [[enter] for _ in STATES]
    wide = 0
    for rows, table in parts:
        now: list[int | None] = [NEVER] * 4
        via = [0] * 4
        for q in STATES:
            for after in STATES:
                if best[q] is NEVER or table[q][after] is NEVER:
                    continue
                weight = _append(best[q], table[q][after], wide, FIELD * rows)
                if now[after] is NEVER or weight < now[after]:
                    now[after], via[after] = weight, q
        way = [[*way[via[q]], q] for q in STATES]
        best, wide = now, wide + FIELD * rows
    return best, way


def ending(best: list[int | None], rows: int) -> int:
    """The state the cheapest way ends in; behind a user turn an assistant turn is inserted."""
    end = [(_append(best[q], 0, FIELD * rows, FIELD), q) for q in (0, 3) if best[q] is not NEVER]
    if best[2] is not NEVER:
        end.append((_append(best[2], 2 << FIELD | INSERT << 3, FIELD * rows, FIELD), 2))
    return min(end)[1]


def edit(marks: str, roles: list[str], texts: list[str], enter: int, leave: int, last: bool):
    """Audit, cost and repaired turns (role, text) of a chunk whose way goes from ``enter`` to ``leave``."""
    n = len(roles)
    weight = (_cached_path if n <= 16 else _path)(marks, enter)[leave]
    audit, turns, state = [], [], enter

    def put(role: str, text: str, initial: str) -> None:
        nonlocal state
        state = STEP[state, initial]
        turns.append((role, text))

    def due() -> str:
        return "a" if state == 2 else "u"

    for i in range(n):
        field = weight >> FIELD * (n - 1 - i) & (1 << FIELD) - 1
        for letter in (field >> 3, field & 7):
            if letter:
                audit.append(LETTERS[letter])
            if letter == INSERT:
                put(ROLES[due()], "", due())
            elif letter == KEEP:
                put(roles[i], texts[i], marks[2 * i])
            elif letter == REROLE:
                put(ROLES[due()], texts[i], due())
    cost = weight >> FIELD * n
    if last and leave == 2:
        audit.append("I")
        cost += 2
        put("assistant", "", "a")
    return "".join(audit), cost, turns


# -- rows to chunks -------------------------------------------------------------------------------

_CHUNK = (
    "seg int, no bigint, conv_id {id}, marks string, roles array<string>, texts array<string>, "
    "low bigint, high bigint, n_turns bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint"
)


class _Chunk:
    """Rows of one conversation in order."""

    def __init__(self, conv):
        self.conv, self.bytes = conv, 0
        self.marks, self.roles, self.texts = [], [], []
        self.low = self.high = None
        self.turns = 0

    def add(self, turn, initial: str, fault: str, role: str, text: str) -> None:
        self.marks.append(initial + fault)
        self.roles.append(role)
        self.texts.append(text)
        self.bytes += len(text)
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.turns += turn != self.high
            self.high = turn

    def full(self, rows: int) -> bool:
        return len(self.marks) >= rows or self.bytes >= CHUNK_BYTES

    def row(self, seg: int, no: int) -> tuple:
        initials = [m[0] for m in self.marks]
        faults = "".join(m[1] for m in self.marks)
        illegal = sum(a + b not in LEGAL for a, b in pairwise(initials))
        counts = (faults.count("b"), faults.count("d"), faults.count("t"))
        return (seg, no, self.conv, "".join(self.marks), self.roles, self.texts, self.low, self.high, self.turns, *counts, illegal)


def _cut(arrow_schema: pa.Schema, rows: int):
    """Sorted rows of a partition to chunks, one chunk in memory at a time."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg, no, chunk, out = TaskContext.get().partitionId(), 0, None, []

        def ready(force: bool = False) -> Iterator[pa.RecordBatch]:
            if out and (force or len(out) >= 1000 or sum(sum(map(len, r[5])) for r in out[-50:]) > CHUNK_BYTES):
                columns = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(columns, arrow_schema, strict=True)], schema=arrow_schema
                )
                out.clear()

        for batch in batches:
            for conv, turn, initial, fault, role, text, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for copy in range(n):
                    if chunk is None or chunk.conv != conv or chunk.full(rows):
                        if chunk is not None:
                            out.append(chunk.row(seg, no))
                            no += 1
                            yield from ready()
                        chunk = _Chunk(conv)
                    chunk.add(turn, initial, fault if not copy or fault == "b" else "d", role, text)
        if chunk is not None:
            out.append(chunk.row(seg, no))
        yield from ready(True)

    return apply


def _faulty(rows: DataFrame) -> DataFrame:
    """Rows with their count ``n`` and first fault: blank, duplicate, truncated or none."""
    word = r"[^\x20\x09-\x0D]"
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    copies = F.col("copies") if "copies" in rows.columns else F.lit(1)
    merged = rows.select("conv_id", F.col("turn").cast("bigint").alias("turn"), role.alias("role"), text.alias("text"), copies.alias("n"))
    merged = merged.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").cast("bigint").alias("n"))
    who = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("-"))
    merged = merged.withColumn("key", F.md5(F.concat(who, F.lit("|"), F.length("role"), F.lit("|"), "role", "text")))
    at = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    firsts = merged.groupBy("key").agg(F.min(at).alias("first"), F.count("*").alias("places")).filter("places > 1")
    marked = merged.join(firsts.select("key", "first"), "key", "left").withColumn("again", F.col("first") < at)
    ended = F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    fault = (
        F.when(~F.col("text").rlike(word), "b").when(F.coalesce("again", F.lit(False)), "d").when(~ended, "t").otherwise("-")
    )
    first = F.when(F.col("role") == "", "\0").otherwise(F.substring("role", 1, 1))
    return marked.select("conv_id", "turn", first.alias("initial"), fault.alias("fault"), "role", "text", "n")


def _chunks(rows: DataFrame, area: WorkArea, size: int) -> DataFrame:
    order = [F.asc_nulls_first(c) for c in ("conv_id", "turn", "role")]
    faulty = _faulty(rows)
    # the beginning of a text is enough to part rows of one turn; equal rows have been counted
    placed = faulty.repartitionByRange(*order, F.substring("text", 1, 32)).sortWithinPartitions(*order, "text")
    schema = _CHUNK.format(id=faulty.schema["conv_id"].dataType.simpleString())
    arrow = rows.sparkSession.createDataFrame([], schema).toArrow().schema
    return area.save(placed.mapInArrow(_cut(arrow, size), schema), "chunks")


# -- states before and behind each chunk ----------------------------------------------------------


def _pack(parts: list[tuple[int, list[list[int | None]]]]) -> tuple[int, str]:
    rows = sum(n for n, _ in parts)
    table = [compose(parts, q)[0] for q in STATES]
    return rows, " ".join("" if w is NEVER else format(w, "x") for row in table for w in row)


def _unpack(rows: int, packed: str) -> tuple[int, list[list[int | None]]]:
    flat = [int(w, 16) if w else NEVER for w in packed.split(" ")]
    return rows, [flat[4 * q : 4 * q + 4] for q in STATES]


def _parts(pdf: pd.DataFrame) -> list[tuple[int, list[list[int | None]]]]:
    if "marks" in pdf:
        return [(len(m) // 2, effect(m)) for m in pdf["marks"]]
    return [_unpack(n, p) for n, p in zip(pdf["rows"], pdf["packed"], strict=True)]


def _up(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    rows, packed = _pack(_parts(pdf.sort_values("m")))
    return pd.DataFrame({"talk": key[:1], "m": key[1:], "rows": [rows], "packed": [packed]})


def _down(children: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
    """States around each child on the least way between the parent's."""
    children = children.sort_values("m")
    parts = _parts(children)
    enter, leave = above["enter"].iloc[0], above["leave"].iloc[0]
    best, way = compose(parts, int(enter))
    if pd.isna(leave):
        leave = ending(best, sum(n for n, _ in parts))
    states = way[int(leave)]
    return pd.DataFrame({"talk": children["talk"], "m": children["m"], "enter": states[:-1], "leave": states[1:]})


def _ways(chunks: DataFrame, area: WorkArea, fan: int) -> DataFrame:
    """``seg, no, enter, leave, last, m`` for the chunks of conversations that have several."""
    several = chunks.groupBy("conv_id").agg(F.count("*").alias("parts"), F.min(F.struct("seg", "no")).alias("talk"))
    several = several.filter("parts > 1").select(F.col("conv_id").alias("whose"), "parts", "talk")
    own = chunks.select("seg", "no", "conv_id", "marks").join(several, F.col("conv_id").eqNullSafe(F.col("whose")))
    talk = F.format_string("%d:%d", "talk.seg", "talk.no")
    # light rows, one for each chunk; the window reads them one after the other
    nth = F.row_number().over(W.partitionBy("talk").orderBy("seg", "no")) - 1
    leaves = own.select("seg", "no", "marks", "parts", talk.alias("talk"))
    leaves = area.save(leaves.withColumn("m", nth.cast("bigint")), "leaves")
    most = leaves.agg(F.max("m")).first()[0]
    if most is None:
        return leaves.select("seg", "no", F.lit(0).alias("enter"), F.lit(0).alias("leave"), F.lit(True).alias("last"), "m")
    group = F.expr(f"m div {fan}")
    levels = [leaves.select("talk", "m", "marks")]
    while most >= fan:
        below = levels[-1].groupBy("talk", group.alias("parent")).applyInPandas(_up, "talk string, m bigint, rows bigint, packed string")
        levels.append(area.save(below, f"level{len(levels)}"))
        most //= fan
    above = levels[-1].select("talk", F.lit(0).cast("bigint").alias("parent"), F.lit(0).alias("enter"), F.lit(None).cast("int").alias("leave"))
    above = above.distinct()
    for i, level in enumerate(reversed(levels)):
        children = level.withColumn("parent", group).groupBy("talk", "parent")
        found = children.cogroup(above.groupBy("talk", "parent")).applyInPandas(_down, "talk string, m bigint, enter int, leave int")
        above = area.save(found, f"states{i}").withColumnRenamed("m", "parent")
    states = above.withColumnRenamed("parent", "m")
    return leaves.join(states, ["talk", "m"]).select(
        "seg", "no", "enter", "leave", (F.col("m") == F.col("parts") - 1).alias("last"), "m"
    )


# -- repaired chunks ------------------------------------------------------------------------------


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = ("marks", "roles", "texts", "enter", "leave", "last")
        audits, costs, turns = [], [], []
        for marks, roles, texts, enter, leave, last in zip(*(batch[c].to_pylist() for c in names), strict=True):
            if leave is None:  # the whole conversation
                best = (_cached_path if len(roles) <= 16 else _path)(marks, 0)
                enter, leave, last = 0, ending(best, len(roles)), True
            audit, cost, made = edit(marks, roles, texts, enter, leave, last)
            audits.append(audit)
            costs.append(cost)
            turns.append([{"role": r, "text": t} for r, t in made])
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(audits, pa.string()), pa.array(costs, pa.int64()), pa.array(turns, _TURNS)],
            names=[*batch.schema.names, "audit", "cost", "turns"],
        )


_TURNS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def repair(rows: DataFrame, area: WorkArea, chunk_rows: int = CHUNK_ROWS, fan: int = FAN) -> DataFrame:
    """Repaired chunks of ``rows (conv_id, turn, role, text)``, with ``copies`` if a row stands for several.

    ``seg, no`` give the order; ``turns`` are the repaired turns (role, text). See ``turns_of`` and ``report``.
    """
    chunks = _chunks(rows, area, chunk_rows)
    states = _ways(chunks, area, fan)
    joined = chunks.join(states, ["seg", "no"], "left")
    turn = StructType().add("role", "string").add("text", "string")
    schema = StructType(list(joined.schema)).add("audit", "string").add("cost", "long").add("turns", ArrayType(turn))
    made = joined.mapInArrow(_repaired, schema)
    return area.save(made.drop("roles", "texts"), "repaired")


def turns_of(repaired: DataFrame) -> DataFrame:
    """``conv_id, seg, no, place, role, text``: the repaired turns, in the order of ``seg, no, place``."""
    return repaired.select("conv_id", "seg", "no", F.posexplode("turns").alias("place", "turn")).select(
        "conv_id", "seg", "no", "place", "turn.role", "turn.text"
    )


def _joined() -> Column:
    return F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")


class _Report:
    """One conversation's values from its chunks in order."""

    def __init__(self, conv):
        self.conv, self.sha, self.some = conv, hashlib.sha256(), False
        self.sums = dict.fromkeys(("n_turns", "blank", "duplicate", "truncated", "illegal", "cost"), 0)
        self.low = self.high = self.initial = None
        self.audit: list[str] = []

    def add(self, chunk: dict) -> None:
        for key in self.sums:
            self.sums[key] += chunk[key]
        if chunk["low"] is not None:
            self.sums["n_turns"] -= chunk["low"] == self.high
            self.low = chunk["low"] if self.low is None else self.low
            self.high = chunk["high"]
        if self.initial is not None:
            self.sums["illegal"] += self.initial + chunk["marks"][0] not in LEGAL
        self.initial = chunk["marks"][-2]
        self.audit.append(chunk["audit"])
        if chunk["filled"]:
            self.sha.update((b"\n" if self.some else b"") + chunk["joined"].encode())
            self.some = True

    def row(self) -> tuple:
        n = self.sums
        gaps = 0 if self.low is None else self.high - self.low + 1 - n["n_turns"]
        return self.conv, gaps, *(n[c] for c in COUNTS[1:]), "".join(self.audit), self.sha.hexdigest()


def _assemble(arrow_schema: pa.Schema):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([v], f.type) for v, f in zip(now.row(), arrow_schema, strict=True)], schema=arrow_schema
            )

        for batch in batches:
            for i in range(batch.num_rows):  # one chunk at a time
                chunk = {name: column[i].as_py() for name, column in zip(batch.schema.names, batch.columns, strict=True)}
                if now is None or now.conv != chunk["conv_id"]:
                    if now is not None:
                        yield row()
                    now = _Report(chunk["conv_id"])
                now.add(chunk)
        if now is not None:
            yield row()

    return apply


def report(repaired: DataFrame) -> DataFrame:
    """One row for each conversation: counts, cost, audit and the hash of its repaired turns."""
    whole = F.col("leave").isNull()
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("n_turns"), F.lit(0).cast("bigint"))
    single = repaired.filter(whole).select(
        "conv_id", gaps.alias("gaps"), *COUNTS[1:], "audit", F.sha2(_joined(), 256).alias("repaired_sha256")
    )
    several = repaired.filter(~whole).select(
        "conv_id", "seg", "no", "marks", "low", "high", "n_turns", *COUNTS[1:], "audit", (F.size("turns") > 0).alias("filled"),
        _joined().alias("joined"),
    )
    ordered = several.repartition("conv_id").sortWithinPartitions("conv_id", "seg", "no")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in single.schema)
    arrow = repaired.sparkSession.createDataFrame([], schema).toArrow().schema
    return single.unionByName(ordered.mapInArrow(_assemble(arrow), schema))


def report_all(conversations: DataFrame, repaired: DataFrame) -> DataFrame:
    """A report for every ``conv_id`` of ``conversations``; those without rows have zeros and nothing."""
    known = conversations.select(F.col("conv_id").alias("asked")).distinct()
    found = known.join(report(repaired), F.col("asked").eqNullSafe(F.col("conv_id")), "left")
    counts = [F.coalesce(F.col(c), F.lit(0).cast("bigint")).alias(c) for c in COUNTS]
    nothing = hashlib.sha256().hexdigest()
    return found.select(
        F.col("asked").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"),
    )


def damage(conversations: DataFrame) -> DataFrame:
    """Rows damaged by the checksum of ``conv_id:turn``: dropped, emptied, without ends of sentences, repeated (as
    ``copies``), or with role user. Nulls are one space in role, text and the checksum."""
    named = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.crc32(F.concat(named[0], F.lit(":"), named[1])) % 20
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    broken = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    return conversations.filter(kind != 0).select(
        "conv_id",
        "turn",
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        broken.alias("text"),
        F.when(kind == 3, 2).otherwise(1).alias("copies"),
    )
