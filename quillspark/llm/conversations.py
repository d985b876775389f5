"""Conversation structure repair: the cheapest edits that make the roles of a conversation alternate and its turns whole.

A backward pass gives, before every row and for every state of the grammar ``(s?(ua)+)?``, the cost to go; a forward walk
takes the ASCII-least edit among those that keep to it, and rebuilds the turns. Long conversations are walked in
segments: a segment's costs are a 4 x 4 matrix of cheapest ways between states, and matrices add up by minimum.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from ._shared import HOT_PART, hot_join, saved, tasks_for

#: Rows, and characters, that a segment has at most (one row at least); rows of one sorted part.
SEGMENT_ROWS, SEGMENT_CHARS, PART_ROWS = 4096, 4 << 20, 50_000
#: Costs: a row that changes its role, goes, is put in; what a truncated row adds that stays.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Characters that separate words, and ends of whole texts.
BLANK, ENDS = " \t\n\x0b\x0c\r", ".!?"
#: States: nothing yet, after a system turn, after a user turn, after an assistant turn. The next user or assistant turn
#: leads on to ``NEXT``, a kept one by its initial to ``KEPT`` (None: not in this state).
NEXT = (2, 2, 3, 2)
KEPT = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}
NOWHERE = (None,) * 4
ROLE = {2: "user", 3: "assistant"}
LEGAL = {"su", "ua", "au"}
FAR = 1 << 60
#: Costs to go after the last row.
LAST = [0, 2 * INSERT, INSERT, 0]

#: (turn, role, text, seen earlier, how often in a row)
Row = tuple


def _fault(row: Row) -> str:
    _, _, text, again, _ = row
    words = text.rstrip(BLANK)
    return "blank" if not words else "duplicate" if again else "truncated" if words[-1] not in ENDS else ""


def cost_to_go(row: Row, fault: str, after: list[int]) -> list[int]:
    """Costs before a row, from those behind it."""
    _, role, _, _, times = row
    if fault in ("blank", "duplicate"):
        best = [DELETE * times + c for c in after]
    else:
        stays, kept, more = TRUNCATED * bool(fault), KEPT.get(role[:1], NOWHERE), DELETE * (times - 1)
        best = []
        for state in range(4):
            c = min(DELETE + after[state], REROLE + stays + after[NEXT[state]])
            if kept[state] is not None:
                c = min(c, stays + after[kept[state]])
            best.append(c + more)
    user, assistant = min(best[2], INSERT + best[3]), min(best[3], INSERT + best[2])
    return [min(best[0], INSERT + user), min(best[1], INSERT + user), user, assistant]


def costs(rows: list[Row], faults: list[str], end: list[int]) -> list[list[int]]:
    """Costs before each row, and ``end``."""
    out = [end]
    for row, fault in zip(reversed(rows), reversed(faults)):
        out.append(cost_to_go(row, fault, out[-1]))
    return out[::-1]


def ways(rows: list[Row]) -> list[int]:
    """Cheapest ways through the rows, from each state (rows of the matrix) to each state."""
    faults = [_fault(r) for r in rows]
    columns = [costs(rows, faults, [0 if s == out else FAR for s in range(4)])[0] for out in range(4)]
    return [columns[out][s] for s in range(4) for out in range(4)]


def through(matrix: list[int], end: list[int]) -> list[int]:
    """Costs before a segment, from its matrix and the costs behind it."""
    return [min(FAR, *(matrix[4 * s + out] + end[out] for out in range(4))) for s in range(4)]


class Walk:
    """The forward walk over one conversation, segment by segment."""

    def __init__(self) -> None:
        self.state, self.cost, self.audit, self.sha, self.lines = 0, 0, [], hashlib.sha256(), 0
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        self.least = self.most = self.turn = self.initial = None
        self.turns = 0

    def _say(self, role: str, text: str) -> tuple[int, str, str]:
        self.sha.update(b"\n" * bool(self.lines) + f"{role}:{text}".encode())
        self.lines += 1
        return self.lines - 1, role, text

    def _look(self, row: Row, fault: str) -> None:
        turn, role, _, _, times = row
        if fault == "blank":
            self.counts["blank"] += times
        else:
            self.counts["duplicate"] += times - (fault != "duplicate")
            self.counts["truncated"] += fault == "truncated"
        if turn is not None and turn != self.turn:
            self.least, self.most, self.turn = turn if self.least is None else self.least, turn, turn
            self.turns += 1
        self.counts["illegal"] += (self.initial is not None and self.initial + role[:1] not in LEGAL) + times - 1
        self.initial = role[:1]

    def take(self, rows: list[Row], end: list[int]) -> Iterator[tuple[int, str, str]]:
        """Walks through a segment behind which costs are ``end``; yields the repaired turns (place, role, text)."""
        faults = [_fault(r) for r in rows]
        go = costs(rows, faults, end)
        for i, (row, fault) in enumerate(zip(rows, faults)):
            self._look(row, fault)
            _, role, text, _, times = row
            after, more, stays = go[i + 1], DELETE * (times - 1), TRUNCATED * bool(fault)
            while True:
                left = go[i][self.state]
                if DELETE + more + after[self.state] == left:
                    self.audit.append("D" * times)
                    self.cost += DELETE + more
                    break
                following = NEXT[self.state]
                if INSERT + go[i][following] == left:
                    yield self._put(following)
                    continue
                kept = KEPT.get(role[:1], NOWHERE)[self.state]
                if kept is not None and stays + more + after[kept] == left:
                    edit, self.state, paid = "K", kept, stays
                else:
                    edit, self.state, paid, role = "R", following, REROLE + stays, ROLE[following]
                self.audit.append(edit + "D" * (times - 1))
                self.cost += paid + more
                yield self._say(role, text)
                break

    def _put(self, state: int) -> tuple[int, str, str]:
        self.audit.append("I")
        self.cost += INSERT
        self.state = state
        return self._say(ROLE[state], "")

    def close(self) -> Iterator[tuple[int, str, str]]:
        """Turns that are put in behind the last row."""
        while LAST[self.state]:
            yield self._put(NEXT[self.state])

    def digest(self) -> dict:
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.turns
        return {"gaps": gaps, **self.counts, "cost": self.cost, "audit": "".join(self.audit), "repaired_sha256": self.sha.hexdigest()}


DIGEST = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
TURN = "place long, role string, text string"
PART = "__pid int, __seq int, __ways array<long>, __turns array<long>, __roles array<string>, __texts array<string>, __again array<boolean>, __times array<long>"


def _batches(rows: Iterator[dict], schema: StructType, most: int = 500, chars: int = SEGMENT_CHARS) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of ``most`` rows, or some ``chars`` characters."""
    arrow, held, size = to_arrow_schema(schema), [], 0
    for row in rows:
        held.append(row)
        size += len(row.get("text") or "") + len(row.get("audit") or "") + sum(map(len, row.get("__texts") or ()))
        if len(held) >= most or size >= chars:
            yield pa.RecordBatch.from_pylist(held, arrow)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, arrow)


def _finished(named: dict, walk: Walk, segments: Iterator[tuple[list[Row], list[int]]], turns: bool) -> Iterator[dict]:
    """A conversation's output: its repaired turns, or their digest."""
    for rows, end in segments:
        for place, role, text in walk.take(rows, end):
            if turns:
                yield {**named, "place": place, "role": role, "text": text}
    for place, role, text in walk.close():
        if turns:
            yield {**named, "place": place, "role": role, "text": text}
    if not turns:
        yield {**named, **walk.digest()}


def _ordered(rows: DataFrame, conv_id: str, turn: str, role: str, text: str, copies: Column) -> DataFrame:
    """Rows (__k, id, turn, role, text, times, again), equal ones as one, sorted within parts that follow each other."""
    there = copies > 0
    one = rows.select(
        F.when(F.col(conv_id).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(conv_id).cast("string"))).alias("__k"),
        F.col(conv_id).alias("__id"),
        F.when(there, F.col(turn).cast("long")).alias("__turn"),
        F.when(there, F.coalesce(F.col(role), F.lit(" "))).otherwise("").alias("__role"),
        F.when(there, F.coalesce(F.col(text), F.lit(" "))).otherwise("").alias("__text"),
        copies.cast("long").alias("__times"),
    )
    met = saved(one.groupBy("__k", "__id", "__turn", "__role", "__text").agg(F.sum("__times").alias("__times")).withColumn("__h", F.md5("__text")))
    number = met.count()
    place = F.struct(F.col("__turn").isNotNull().alias("known"), F.col("__turn").alias("at"))
    firsts = met.groupBy("__k", "__role", "__h").agg(F.min(place).alias("__first"), F.count("*").alias("__c")).filter("__c > 1")
    firsts = saved(firsts)
    hot = firsts.filter(F.col("__c") > max(1.0, number * HOT_PART)).select("__k", "__role", "__h")
    joined = hot_join(met, firsts.drop("__c"), ["__k", "__role", "__h"], "left", hot)
    known = joined.select("__k", "__id", "__turn", "__role", "__text", "__times", (F.col("__first").isNotNull() & (place > F.col("__first"))).alias("__again"))
    order = ["__k", F.col("__turn").asc_nulls_first(), "__role"]
    return known.repartitionByRange(tasks_for(number, PART_ROWS), *order, F.substring("__text", 1, 256)).sortWithinPartitions(*order, "__text")


def _repaired(rows: DataFrame, conv_id: str, turn: str, role: str, text: str, copies: Column, turns: bool) -> DataFrame:
    ordered = _ordered(rows, conv_id, turn, role, text, copies)
    made = StructType([StructField("__id", ordered.schema["__id"].dataType), *StructType.fromDDL(TURN if turns else DIGEST).fields])
    first = StructType([StructField("__k", ordered.schema["__k"].dataType), *made.fields, *StructType.fromDDL(PART).fields])

    def read(batches) -> Iterator[tuple[str, object, Row]]:
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("__k", "__id", "__turn", "__role", "__text", "__again", "__times")]
            for k, known, *row in zip(*columns):
                yield k, known, tuple(row)

    def cut(batches) -> Iterator[dict]:
        """Conversations that lie whole inside a sorted part are finished; the others, and long ones, go on as segments."""
        pid, seq = TaskContext.get().partitionId(), 0
        now, held, size, whole = None, [], 0, False

        def segment() -> dict:
            turns, roles, texts, again, times = (list(c) for c in zip(*held)) if held else ([],) * 5
            return {"__k": now[0], "__id": now[1], "__pid": pid, "__seq": seq, "__ways": ways(held), "__turns": turns, "__roles": roles, "__texts": texts, "__again": again, "__times": times}

        for k, known, row in read(batches):
            if now is None or k != now[0]:
                if now is not None:
                    if whole:
                        yield from _finished({"__k": now[0], "__id": now[1]}, Walk(), iter([(held, LAST)]), turns)
                    else:
                        yield segment()
                        seq += 1
                whole, now, held, size = now is not None, (k, known), [], 0
            elif len(held) >= SEGMENT_ROWS or size >= SEGMENT_CHARS:
                yield segment()
                seq += 1
                whole, held, size = False, [], 0
            if row[-1]:
                held.append((row[0], row[1], row[2], row[3], row[4]))
                size += len(row[2])
        if now is not None:
            yield segment()

    done = saved(ordered.mapInArrow(lambda batches: _batches(cut(batches), first), first))
    whole = done.filter("__pid is null").select(made.names)
    parts = done.filter("__pid is not null").select("__k", "__id", *[f.name for f in StructType.fromDDL(PART).fields])
    ends = StructType.fromDDL("__k string, __pid int, __seq int, __end array<long>")

    def behind(batches) -> Iterator[dict]:
        """From a conversation's last segment to its first: the costs behind each."""
        now, end = None, LAST
        for batch in batches:
            for row in batch.to_pylist():
                if row["__k"] != now:
                    now, end = row["__k"], LAST
                yield {"__k": now, "__pid": row["__pid"], "__seq": row["__seq"], "__end": end}
                end = through(row["__ways"], end)

    back = parts.select("__k", "__pid", "__seq", "__ways").repartition("__k").sortWithinPartitions("__k", F.desc("__pid"), F.desc("__seq"))
    costed = saved(back.mapInArrow(lambda batches: _batches(behind(batches), ends), ends))

    def joined(batches) -> Iterator[dict]:
        """From the first segment to the last; a conversation's walk is all that is held."""
        now, walk = None, Walk()
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if now is None or row["__k"] != now[0]:
                    if now is not None:
                        yield from _finished({"__id": now[1]}, walk, iter(()), turns)
                    now, walk = (row["__k"], row["__id"]), Walk()
                rows = list(zip(row["__turns"], row["__roles"], row["__texts"], row["__again"], row["__times"]))
                for place, said, words in walk.take(rows, row["__end"]):
                    if turns:
                        yield {"__id": now[1], "place": place, "role": said, "text": words}
        if now is not None:
            yield from _finished({"__id": now[1]}, walk, iter(()), turns)

    follow = parts.drop("__ways").join(costed, ["__k", "__pid", "__seq"]).repartition("__k").sortWithinPartitions("__k", "__pid", "__seq")
    rest = follow.mapInArrow(lambda batches: _batches(joined(batches), made), made)
    return whole.union(rest).withColumnRenamed("__id", conv_id)


def repair_conversations(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", copies: Column | None = None) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256): one row for each conversation.

    A conversation's rows go by turn, nulls first, then by role and text. A null role or text reads as one space, a null id is
    an id like any other. Each row's first fault counts: blank, role and text seen earlier, last character no end.
    Edits: Keep 0, Rerole to user or assistant 1, Delete 2 (blank rows and repeats must go), Insert an empty user or
    assistant turn 5; a truncated row that stays adds 5. ``audit`` has the cheapest edits in order, the ASCII-least of
    equally cheap ones. Repeated rows are repeats like any. ``copies`` says how often a row stands there (default once);
    rows of 0 only name their conversation, and one without any row has zeros, an empty audit and the hash of nothing.
    An empty table gives none. Other columns are not read.

    Equal rows become one before they are shuffled. Rows are dealt by ranges of conversation and turn, so a conversation of any
    length is spread over parts; segments of it (``SEGMENT_ROWS``) give matrices, by which costs are known behind each. The
    last walk streams the segments of the few conversations that parts cut, as the hash of a text needs it in one order: it
    holds a segment at a time, and the audit.
    """
    return _repaired(rows, conv_id, turn, role, text, F.lit(1) if copies is None else copies, False)


def repaired_turns(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", copies: Column | None = None) -> DataFrame:
    """(conv_id, place, role, text): the turns that ``repair_conversations`` hashes, numbered from 0."""
    return _repaired(rows, conv_id, turn, role, text, F.lit(1) if copies is None else copies, True)


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations (conv_id, turn, role, text) with faults that follow from id and turn, and ``copies`` of each row.

    Of 20 rows one is dropped (0 copies), one emptied, one loses its ends of sentences, one stands twice, one becomes the
    user's. Nulls read as one space.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    lot = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20
    return rows.select(
        "conv_id",
        "turn",
        F.when(lot == 4, F.lit("user")).otherwise(blank("role")).alias("role"),
        F.when(lot == 1, F.lit("")).when(lot == 2, F.regexp_replace(blank("text"), "[.!?]", "")).otherwise(blank("text")).alias("text"),
        F.when(lot == 0, 0).when(lot == 3, 2).otherwise(1).alias("copies"),
    )
