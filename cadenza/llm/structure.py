"""Conversation structure: faults, the cheapest edits that repair them, and the repaired text.

A conversation's roles should read ``(s?(ua)+)?`` by their initials.  Rows may be kept (0),
given the role user or assistant (1) or deleted (2, and a must for blank and duplicate ones);
empty rows of either role may be inserted anywhere (5); a truncated row that stays adds 5.

This is a shortest path over nodes (rows done, state), where the four states are those of
the automaton of that pattern.  Costs are integers of at most 6, so Dial's queue of buckets, one
a distance modulo their number, gives all distances to the goal in linear time.  They are
recorded; then, from the start, the arcs on which distance drops by exactly the arc's cost
are walked, the one with the least letter first, which spells the least of the cheapest audits.

At scale: rows are sorted over all conversations at once, by ranges that may cut within one.  A
conversation that lies whole in a task, with at most ``ROWS`` rows, is repaired there as it streams
by.  Those cut by a range, or longer, go on as open rows in blocks of ``ROWS``: each block gives the
distances between its two ends by state (16 numbers), the blocks of a conversation are chained from its
end, each block then records its rows' distances, and rows stream once more, in order, for the walk and
the hash.  A block is the most that memory holds.  SHA-256 chains, so that one last pass of a long
conversation, a few steps and a hash a row, is sequential; nothing else is.

Edge cases: null texts and roles are read as one space, and so are null conv_id and turn in the
checksum; a null conv_id is a conversation, null turns come first and count for no gap; rows of one turn
are ordered by role, then by a hash of the text, so the result does not depend on partitions; an
empty role has no initial, which no kept row may have; repeated rows are duplicates; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby, islice

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .runtime import ship, table

ROWS = 2048
KEEP, REROLE, DELETE, INSERT, CUT = 0, 1, 2, 5, 5
#: States: nothing yet, after s, after u, after a.  The role that each may take next; the goal is nothing at all, or after a.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
FREE = {"u": "user", "a": "assistant"}
FAR = 1 << 60
_BUCKETS = 32  # distances in the queue differ by less: 6 an arc, and some 15 between the states of a block's end
BLANK, DUPLICATE, TRUNCATED, WHOLE = range(4)


def arcs(initial: str, fault: int, state: int) -> Iterator[tuple[str, int, int]]:
    """(letter, cost, next state) of the ways to deal with a row, letters rising."""
    yield "D", DELETE, state
    if fault in (BLANK, DUPLICATE):
        return
    more = CUT if fault == TRUNCATED else 0
    if initial in NEXT[state]:
        yield "K", KEEP + more, NEXT[state][initial]
    for role in FREE:
        if role in NEXT[state]:
            yield "R", REROLE + more, NEXT[state][role]


def inserts(state: int) -> Iterator[tuple[str, int, int]]:
    for role in FREE:
        if role in NEXT[state]:
            yield "I", INSERT, NEXT[state][role]


def distances(rows: list[tuple[str, int]], goal: list[int]) -> list[list[int]]:
    """dist[i][state]: the cost from there to the goal, whose distances after the last row are given by state; Dial's bucket queue over the arcs turned round."""
    n = len(rows)
    dist = [[FAR] * 4 for _ in range(n + 1)]
    into = {s: [(q, c) for q in range(4) for _, c, s2 in inserts(q) if s2 == s] for s in range(4)}
    before: dict[tuple[str, int], list[list[tuple[int, int]]]] = {}
    for row in set(rows):
        back = before[row] = [[] for _ in range(4)]
        for q in range(4):
            for _, c, s in arcs(*row, q):
                back[s].append((q, c))
    queue: list[list[tuple[int, int]]] = [[] for _ in range(_BUCKETS)]
    base = min(goal)
    waiting = 0
    for s, d in enumerate(goal):
        if d < FAR:
            dist[n][s] = d
            queue[d % _BUCKETS].append((n, s))
            waiting += 1
    d = base
    while waiting:
        here = queue[d % _BUCKETS]
        while here:
            i, s = here.pop()
            waiting -= 1
            if dist[i][s] != d:  # reached at less meanwhile
                continue
            for j, found in ((i, into[s]), (i - 1, before[rows[i - 1]][s] if i else ())):
                for q, c in found:
                    if d + c < dist[j][q]:
                        dist[j][q] = d + c
                        queue[(d + c) % _BUCKETS].append((j, q))
                        waiting += 1
        d += 1
    return dist


GOAL = [0, FAR, FAR, 0]


class Walk:
    """The tight arcs from the start, row by row: the audit and the SHA-256 of what is left."""

    def __init__(self):
        self.state, self.audit, self.hash, self.any = START, bytearray(), hashlib.sha256(), False

    def _step(self, letter: str, state: int, role: str = "", text: str = "") -> None:
        self.audit += letter.encode()
        self.state = state
        if letter != "D":
            role = role if letter == "K" else FREE["a" if state == ASSISTANT else "u"]
            self.hash.update(f"{'\n' if self.any else ''}{role}:{text}".encode())
            self.any = True

    def row(self, initial: str, fault: int, role: str, text: str, here: list[int], after: list[int]) -> None:
        """One row, with the inserts before it; here and after: the distances before and after the row."""
        letter = "I"
        while letter == "I":
            tight = [(x, s) for x, c, s in arcs(initial, fault, self.state) if after[s] + c == here[self.state]]
            tight += [(x, s) for x, c, s in inserts(self.state) if here[s] + c == here[self.state]]
            letter, state = min(tight)
            self._step(letter, state, role, "" if letter == "I" else text)

    def end(self, here: list[int]) -> tuple[str, str]:
        while here[self.state]:
            self._step(*next((x, s) for x, c, s in inserts(self.state) if here[s] + c == here[self.state]))
        return self.audit.decode(), self.hash.hexdigest()


def illegal_pairs(initials: list[str]) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))


def repair(rows: list[tuple]) -> tuple:
    """gaps, blank, duplicate, truncated, illegal, cost, audit and hash of one conversation's (turn, role, text, fault, live)."""
    rows = [r for r in rows if r[4]]
    seen, faults = set(), []
    for _, role, text, fault, _ in rows:
        faults.append(DUPLICATE if fault != BLANK and (role, text) in seen else fault)
        seen.add((role, text))
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    initials = [r[1][:1] for r in rows]
    dist = distances(list(zip(initials, faults, strict=True)), GOAL)
    walk = Walk()
    for i, (_, role, text, _, _) in enumerate(rows):
        walk.row(initials[i], faults[i], role, text, dist[i], dist[i + 1])
    return (gaps, *(faults.count(f) for f in (BLANK, DUPLICATE, TRUNCATED)), illegal_pairs(initials), dist[0][START], *walk.end(dist[-1]))


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and live of the rows after damage; a dropped row stays as one that is not live."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    text = F.when(code == 1, "").when(code == 2, F.regexp_replace(part("text"), "[.!?]", "")).otherwise(part("text"))
    times = F.explode(F.when(code == 3, F.array(F.lit(True), F.lit(True))).otherwise(F.array(code != 0)))
    return rows.select("conv_id", "turn", F.when(code == 4, "user").otherwise(part("role")).alias("role"), text.alias("text"), times.alias("live"))


def own_fault(text: Column) -> Column:
    """Blank, truncated or whole."""
    return F.when(~text.rlike(r"[^\x20\x09-\x0D]"), BLANK).when(~text.rlike(r"[.!?][\x20\x09-\x0D]*\z"), TRUNCATED).otherwise(WHOLE)


_RESULT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
_RESULT_TYPES = ", ".join(f"{c} {'string' if c in ('audit', 'repaired_sha256') else 'bigint'}" for c in _RESULT)
_KEY = ["conv_id", "part", "block"]


def _pass(rows: DataFrame, columns: list[str], by: list[str], order: list[Column | str], keys: int, work, schema: str) -> DataFrame:
    """mapInArrow over sorted rows dealt by some columns: work(runs) gets an iterator of runs with equal first columns, each an iterator of row tuples."""
    ship(rows.sparkSession)

    def run(batches):
        stream = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        results = work((k, r) for k, r in groupby(stream, key=lambda r: r[:keys]))
        while out := list(islice(results, ROWS)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), fields, strict=True)], schema=fields)

    kind = rows.sparkSession.createDataFrame([], schema).schema
    fields = to_arrow_schema(kind)
    dealt = rows if not by else rows.repartition(*by).sortWithinPartitions(*order)
    return dealt.select(*columns).mapInArrow(run, kind)


def repair_conversations(rows: DataFrame, block: int = ROWS) -> DataFrame:
    """conv_id and the columns of ``repair`` for every conversation of rows (conv_id, turn, role, text, live)."""
    conv, turn = (rows.schema[c].dataType.simpleString() for c in ("conv_id", "turn"))
    first = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "_hash", "_tie"]
    sorted_ = rows.withColumns({"_hash": F.xxhash64("text"), "_tie": F.monotonically_increasing_id(), "fault": own_fault(F.col("text"))}).repartitionByRange(*first).sortWithinPartitions(*first)

    def settle(runs):
        """A conversation between two others of its task is whole: its result.  The first, the last and long ones: their rows."""
        part, at, none = TaskContext.get().partitionId(), 0, (None,) * len(_RESULT)
        held: list[tuple] = []
        for n, (_, run) in enumerate(runs):
            if held:
                yield (held[0][0], *repair([r[1:] for r in held]), *(None,) * 7)
            held, whole = [], n > 0
            for r in run:
                if whole:
                    held.append(r)
                    if len(held) <= block:
                        continue
                    whole = False
                for x in held or [r]:
                    yield (x[0], *none, *x[1:], part, at)
                    at += 1
                held = []
        for x in held:
            yield (x[0], *none, *x[1:], part, at)
            at += 1

    placed = table(_pass(sorted_, ["conv_id", "turn", "role", "text", "fault", "live"], [], [], 1, settle, f"conv_id {conv}, {_RESULT_TYPES}, turn {turn}, role string, text string, fault int, live boolean, part int, at bigint"))
    return placed.where("part IS NULL").select("conv_id", *_RESULT).union(_chained(placed.where("part IS NOT NULL").drop(*_RESULT), conv, block))


def _chained(open_: DataFrame, conv: str, block: int) -> DataFrame:
    """The results of conversations given as rows of several tasks, (part, at) their order."""
    keyed = open_.withColumns({"block": F.floor(F.col("at") / block), "_sha": F.sha2("text", 256)})
    twice = table(keyed.where("live").groupBy("conv_id", "role", "_sha").agg(F.min(F.struct("part", "at")).alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n"))
    met = keyed.join(twice.withColumnRenamed("conv_id", "_conv").withColumnRenamed("role", "_role").withColumnRenamed("_sha", "_text"), F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("role") == F.col("_role")) & (F.col("_sha") == F.col("_text")), "left")
    again = F.col("_first").isNotNull() & (F.struct("part", "at") != F.col("_first")) & (F.col("fault") != BLANK)
    rows = table(met.withColumn("fault", F.when(again, DUPLICATE).otherwise(F.col("fault"))).select("conv_id", "part", "block", "at", "turn", "role", "text", "fault", "live"))
    live = lambda c: F.when(F.col("live"), c)
    is_ = lambda f: F.count_if(F.col("live") & (F.col("fault") == f))
    turns = live(F.col("turn"))
    facts = rows.groupBy("conv_id").agg(F.coalesce(F.max(turns) - F.min(turns) + 1 - F.count_distinct(turns), F.lit(0)).alias("gaps"), is_(BLANK).alias("blank"), is_(DUPLICATE).alias("duplicate"), is_(TRUNCATED).alias("truncated"))
    small = rows.select(*_KEY, "at", F.substring("role", 1, 1).alias("initial"), "fault", "live")
    order = [*_KEY, "at"]

    def ends(runs):
        """The 16 distances through a block (to each state of its end, from each of its start) and its outer initials."""
        for key, run in runs:
            own = [(r[3], r[4]) for r in run if r[5]]
            names = [x for x, _ in own]
            through = [x for s in range(4) for x in distances(own, [0 if q == s else FAR for q in range(4)])[0]]
            yield (*key, through, names[0] if names else None, names[-1] if names else None, illegal_pairs(names))

    blocks = table(_pass(small, [*_KEY, "initial", "fault", "live"], _KEY, order, 3, ends, f"conv_id {conv}, part int, block bigint, through array<bigint>, head string, tail string, illegal bigint"))

    def chain(runs):
        """From the last block to the first: the distances at each block's end, and with the first block the whole conversation's cost and illegal pairs."""
        for (key,), run in runs:
            here, illegal, head, last = distances([], GOAL)[0], 0, None, None
            for _, part, at, through, first, tail, inner in run:
                if last:
                    yield last
                illegal += inner
                if first is not None:
                    illegal += head is not None and tail + head not in ("su", "ua", "au")
                    head = first
                after, here = here, [min(through[4 * s + q] + here[s] for s in range(4)) for q in range(4)]
                last = (key, part, at, after, None, None)
            yield (*last[:4], here[START], illegal)

    back = [F.col("conv_id").asc(), F.col("part").desc(), F.col("block").desc()]
    ended = table(_pass(blocks, [*_KEY, "through", "head", "tail", "illegal"], ["conv_id"], back, 1, chain, f"conv_id {conv}, part int, block bigint, after array<bigint>, cost bigint, illegal bigint"))
    goals = ended.select(*(F.col(c).alias(f"_{c}") for c in _KEY), F.col("after").alias("goal"))

    def record(runs):
        """The distances before and after every live row."""
        for key, run in runs:
            own = list(run)
            dist = distances([(r[4], r[5]) for r in own], own[0][6])
            for i, r in enumerate(own):
                yield (key[0], key[1], r[3], dist[i], dist[i + 1])

    joined = table(small.where("live").join(goals, F.col("conv_id").eqNullSafe(F.col("_conv_id")) & (F.col("part") == F.col("_part")) & (F.col("block") == F.col("_block"))))  # so that no join stands for the exchange below
    marks = table(_pass(joined, [*_KEY, "at", "initial", "fault", "goal"], _KEY, order, 3, record, f"_conv_id {conv}, _part int, _at bigint, here array<bigint>, after array<bigint>"))

    def walk(runs):
        for (key,), run in runs:
            w, here = Walk(), GOAL
            for _, role, text, fault, live_, before, after in run:
                if live_:
                    w.row(role[:1], fault, role, text, before, after)
                    here = after
            yield (key, *w.end(here))

    told = rows.join(marks, F.col("conv_id").eqNullSafe(F.col("_conv_id")) & (F.col("part") == F.col("_part")) & (F.col("at") == F.col("_at")), "left")
    walked = _pass(told, ["conv_id", "role", "text", "fault", "live", "here", "after"], ["conv_id"], ["conv_id", "part", "at"], 1, walk, f"conv_id {conv}, audit string, repaired_sha256 string")
    costs = ended.where("cost IS NOT NULL").select("conv_id", "illegal", "cost")
    out = facts
    for other in (costs, walked):
        right = other.withColumnRenamed("conv_id", "_id")
        out = out.join(right, F.col("conv_id").eqNullSafe(F.col("_id"))).drop("_id")
    return out.select("conv_id", *_RESULT)


def op11_dial_structure_repair(spark, sf_dir: str) -> DataFrame:
    return repair_conversations(damage(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
