"""Repair of conversations by the cheapest edits, found by iterative-deepening A*.

The turns of a conversation, in order, should have the role initials (s?(ua)+)?. Keep costs 0, Rerole to user or assistant 2, Delete 3, Insert
of an empty user or assistant turn 2; a truncated turn that stays costs 1 more; blank and duplicate turns must be deleted. The audit is the
cheapest edit sequence, as letters; of several the one that is least in ASCII.

Search. Depth-first in the order D, I, K, R under a cost bound that starts at the estimate of the start and rises to the least cost that a failed
round had to cut. The transposition table holds, per place and state of the pattern, the least cost that a failed search proved necessary from there.
The estimate counts deletions and truncations that cannot be avoided and one for each illegal pair of neighbours: k edited neighbours cost at
least 2k and mend at most k + 1 pairs. The first accepting path has the least cost, and is the least in ASCII among those.

Scale. Conversations of more than STRETCH turns are searched in stretches, once for each pair of a state before and a state after, and the
stretches' answers composed in a tree. That is exact: for given states before and after, no cheapest audit of a stretch is a beginning of another (it
would cost less), so the least one can be chosen without what follows. Turns are sorted by range on (conversation, turn, ...),
so a conversation of any size is dealt over tasks. Only those that cross a task's edge, at most one an edge, are composed over tasks: one table of states a piece.
Then every piece is edited where it lies. Duplicates are found by a join on a digest with the first occurrence of what
occurs more than once, which Spark splits if it is skewed. A task holds the part of one conversation that lies in its partition. The report's digest
is of one text: where a conversation crosses tasks, its repaired turns pass one task in order, as a stream; its audit is one value.

Order and edge cases. By turn, nulls first; equal turns by role, then the first 256 characters of the text, then a digest. Null role or text: one
blank. A null conversation id is a conversation. Repeated rows are duplicates. Turns for which `present` is false only stand for their
conversation: without other turns its report has zeros, an empty audit and the digest of nothing. Very long texts are whole rows. Empty table: no rows. Further columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable

BLANKS = " \t\n\x0b\x0c\r"
STRETCH = 64
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
#: States: 0 nothing yet, 1 after s, 2 after u, 3 after a. INTO[state]: the state of a role that is put next. KEEPS[state][initial]: where a kept row leads.
INTO = (2, 2, 3, 2)
KEEPS = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ROLE = {2: "user", 3: "assistant"}
STATE = {"s": 1, "u": 2, "a": 3}
ENDS = (0, 3)
#: Bytes of texts that are handed on at once.
FLUSH = 4 << 20
NEVER = 1 << 60


class Search:
    """Iterative-deepening A* over one stretch. rows: (initial, fault) with fault '', 'truncated', 'blank' or 'duplicate'; ends: accepted states."""

    def __init__(self, rows: list[tuple[str, str]], ends: tuple[int, ...]):
        self.rows, self.ends, self.n = rows, ends, len(rows)
        self.forced = [fault in ("blank", "duplicate") for _, fault in rows]
        self.needed: dict[tuple[int, int], int] = {}
        # Costs that cannot be avoided from each place on; the next row that may stay, and the illegal pairs behind it.
        self.sure, self.following, self.pairs = [0] * (self.n + 1), [""] * (self.n + 1), [0] * (self.n + 1)
        for i in range(self.n - 1, -1, -1):
            initial, fault = rows[i]
            self.sure[i] = self.sure[i + 1] + (DELETE if self.forced[i] else TRUNCATED if fault else 0)
            self.following[i], self.pairs[i] = self.following[i + 1], self.pairs[i + 1]
            if not self.forced[i]:
                self.following[i] = initial or "?"
                self.pairs[i] += self.illegal(STATE.get(initial, -1), i + 1)

    def illegal(self, state: int, place: int) -> bool:
        """Whether a row with this state and the next that may stay, or the end, do not follow each other."""
        after = self.following[place]
        return state < 0 or (after not in KEEPS[state] if after else state not in self.ends)

    def estimate(self, place: int, state: int) -> int:
        return self.sure[place] + self.pairs[place] + self.illegal(state, place)

    def descend(self, place: int, state: int, budget: int, path: list[str]) -> int | None:
        """None and the path (last letter first) if an end is reached within the budget, else a cost above it that is needed from here."""
        if place == self.n and state in self.ends:
            return None
        least = self.needed.get((place, state))
        if least is None:
            least = self.estimate(place, state)
        if least > budget:
            return least
        steps = [("I", INSERT, place, INTO[state])]
        if place < self.n:
            initial, fault = self.rows[place]
            steps.insert(0, ("D", DELETE, place + 1, state))
            if not self.forced[place]:
                kept = TRUNCATED if fault else 0
                if initial in KEEPS[state]:
                    steps.append(("K", kept, place + 1, KEEPS[state][initial]))
                steps.append(("R", REROLE + kept, place + 1, INTO[state]))
        needed = NEVER
        for letter, cost, to, after in steps:
            if cost > budget:
                needed = min(needed, cost + self.estimate(to, after))
                continue
            more = self.descend(to, after, budget - cost, path)
            if more is None:
                path.append(letter)
                return None
            needed = min(needed, cost + more)
        self.needed[place, state] = needed
        return needed

    def answer(self, state: int) -> tuple[int, str]:
        """Least cost and audit from a state before the first row. The table serves all states before."""
        bound = self.estimate(0, state)
        while True:
            path: list[str] = []
            needed = self.descend(0, state, bound, path)
            if needed is None:
                return bound, "".join(reversed(path))
            bound = needed


Table = dict[tuple[int, int], tuple[int, str]]


def states(rows: list[tuple[str, str]]) -> Table:
    """Cost and audit of a stretch for each state before and after it that edits can join."""
    system = any(initial == "s" and fault in ("", "truncated") for initial, fault in rows)
    found = {}
    for end in range(4):
        search = Search(rows, (end,))
        for start in range(4):
            if start == 0 and end == 1 and system or (start, end) in ((0, 0), (1, 1)) or end >= 2:
                found[start, end] = search.answer(start)
    return found


def composed(one: Table, two: Table) -> Table:
    found: Table = {}
    for (start, middle), (cost, audit) in one.items():
        for (again, end), (cost2, audit2) in two.items():
            if again == middle:
                both = cost + cost2, audit + audit2
                found[start, end] = min(found.get((start, end), both), both)
    return found


def table(rows: list[tuple[str, str]]) -> Table:
    """states() of any number of rows, by stretches."""
    level = [states(rows[i : i + STRETCH]) for i in range(0, len(rows), STRETCH)] or [states([])]
    while len(level) > 1:
        level = [composed(*level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def audit(rows: list[tuple[str, str]], start: int = 0, ends: tuple[int, ...] = ENDS) -> str:
    """The cheapest edits of a conversation, or of a piece of one between given states."""
    if len(rows) <= STRETCH:
        return Search(rows, ends).answer(start)[1]
    return min(x for (a, b), x in table(rows).items() if a == start and b in ends)[1]


def _prepared(turns: DataFrame, id_col: str, present: Column) -> DataFrame:
    """Turns with initial, fault, partition and order, written to the shared folder."""
    text = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    slim = turns.select(F.col(id_col).alias("conv"), F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"), F.coalesce(present, F.lit(False)).alias("present"))
    bare = F.rtrim("text", F.lit(BLANKS))
    named = F.coalesce(F.concat(F.length(F.col("conv").cast("string")).cast("string"), F.lit(":"), F.col("conv").cast("string")), F.lit("-"))
    rows = durable(slim.withColumns({"row": F.monotonically_increasing_id(), "blank": bare == "", "cut": ~F.substring(bare, -1, 1).isin(".", "!", "?"), "digest": F.sha2(F.concat_ws("|", named, F.length("role").cast("string"), F.concat("role", "text")), 256)}))
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn", "row")
    twice = rows.where("present and not blank").groupBy("digest").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("digest").alias("key"), "first")
    # A row that cannot be a duplicate gets a key of its own, so that the left side has no hot key but true copies, which Spark splits.
    rows = rows.withColumn("key", F.when(F.expr("present and not blank"), F.col("digest")).otherwise(F.concat(F.lit("-"), F.col("row").cast("string")))).join(twice, "key", "left")
    fault = F.when(F.col("blank"), "blank").when(F.col("first").isNotNull() & (place > F.col("first")), "duplicate").when(F.col("cut"), "truncated").otherwise("")
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("head"), F.col("digest"), F.col("row")]
    known = rows.select("conv", "turn", "role", "text", "present", fault.alias("fault"), F.substring("text", 1, 256).alias("head"), "digest", "row")
    dealt = known.repartitionByRange(*order).sortWithinPartitions(*order)
    return durable(dealt.select("conv", "turn", "role", "text", "present", "fault", F.spark_partition_id().alias("part")))


def _conversations(batches, columns: int):
    """(conversation, its rows) of a partition, as its rows come. Holds one conversation's part of the partition."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(columns))):
            if rows and row[0] != key:
                yield key, rows
                rows = []
            key = row[0]
            rows.append(row)
    if rows:
        yield key, rows


def _codes(rows) -> list[tuple[str, str]]:
    return [(role[:1], fault) for _, _, role, _, present, fault, _ in rows if present]


_EDITS = "part int, place long, edit string, turn long, was string, fault string, role string, text string"


def _edited(rows: DataFrame, between: dict[tuple[int, str | None], tuple[int, tuple[int, ...]]]) -> DataFrame:
    """The edits of each turn. between: states before and after the pieces of conversations that lie in several partitions."""

    def run(batches):
        kind = None

        def made(out):
            types = [kind, pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 9, types)], names=["conv", *(x.split()[0] for x in _EDITS.split(", "))])

        def watched():
            nonlocal kind
            for batch in batches:
                kind = batch.schema.field(0).type
                yield batch

        out, held, place = [], 0, 0
        for conv, turns in _conversations(watched(), 7):
            part = turns[0][6]
            state, ends = between.get((part, None if conv is None else str(conv)), (0, ENDS))
            letters, here = iter(audit(_codes(turns), state, ends)), iter(turns)
            rows = [(conv, part, None, "", None, None, None, None, None)] if not any(r[4] for r in turns) else []
            real = (r for r in here if r[4])
            for letter in letters:
                if letter == "I":
                    state = INTO[state]
                    rows.append((conv, part, None, "I", None, None, None, ROLE[state], ""))
                    continue
                _, turn, role, text, _, fault, _ = next(real)
                was = role[:1]
                if letter == "D":
                    rows.append((conv, part, None, "D", turn, was, fault, None, None))
                    continue
                state = KEEPS[state][was] if letter == "K" else INTO[state]
                rows.append((conv, part, None, letter, turn, was, fault, role if letter == "K" else ROLE[state], text))
            for row in rows:
                out.append((*row[:2], place, *row[3:]))
                place, held = place + 1, held + len(row[8] or "")
                if held > FLUSH or len(out) >= 10_000:
                    yield made(out)
                    out, held = [], 0
        if out:
            yield made(out)

    return rows.mapInArrow(run, f"conv {rows.schema['conv'].dataType.simpleString()}, {_EDITS}")


_REPORT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


class _Report:
    """What a conversation's edits add up to, row by row."""

    def __init__(self):
        self.counts, self.letters, self.digest, self.empty = dict.fromkeys(_REPORT, 0), bytearray(), hashlib.sha256(), True
        self.first = self.last = self.was = None
        self.turns = 0

    def add(self, edit: str, turn: int | None, was: str | None, fault: str | None, role: str | None, text: str | None) -> None:
        self.letters += edit.encode()
        if was is not None:  # a turn that was there
            self.counts["illegal"] += self.was is not None and self.was + was not in ("su", "ua", "au")
            self.was = was
            if fault:
                self.counts[fault] += 1
            if turn is not None:
                self.first = turn if self.first is None else self.first
                self.turns += turn != self.last
                self.last = turn
        self.counts["cost"] += {"D": DELETE, "I": INSERT, "R": REROLE}.get(edit, 0) + (TRUNCATED if fault == "truncated" and edit != "D" else 0)
        if role is not None:
            self.digest.update((b"" if self.empty else b"\n") + f"{role}:{text}".encode())
            self.empty = False

    def row(self) -> tuple:
        self.counts["gaps"] = 0 if self.last is None else self.last - self.first + 1 - self.turns
        return *(int(self.counts[name]) for name in _REPORT), self.letters.decode(), self.digest.hexdigest()


def _reports(edits: DataFrame) -> DataFrame:
    """One row a conversation; its edits lie together and in order."""

    def run(batches):
        key, report = None, None
        for batch in batches:
            out, kind = [], batch.schema.field(0).type
            for conv, *row in zip(*(batch.column(i).to_pylist() for i in (0, 3, 4, 5, 6, 7, 8))):
                if report is None or conv != key:
                    if report is not None:
                        out.append((key, *report.row()))
                    key, report = conv, _Report()
                report.add(*row)
            yield made(out, kind)
        if report is not None:
            yield made([(key, *report.row())], kind)

    def made(out, kind):
        types = [kind, *[pa.int64()] * 6, pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 9, types)], names=["conv", *_REPORT, "audit", "repaired_sha256"])

    return edits.mapInArrow(run, f"conv {edits.schema['conv'].dataType.simpleString()}, {', '.join(f'{x} long' for x in _REPORT)}, audit string, repaired_sha256 string")


def _between(own: DataFrame) -> dict[tuple[int, str | None], tuple[int, tuple[int, ...]]]:
    """States before and after each piece of the conversations that lie in several partitions: two small numbers for at most two pieces a partition."""

    def tables(batches):
        for conv, turns in _conversations(batches, 7):
            starts, ends, costs, audits = zip(*((a, b, cost, letters) for (a, b), (cost, letters) in table(_codes(turns)).items()))
            columns = [pa.array([None if conv is None else str(conv)], pa.string()), pa.array([turns[0][6]], pa.int32()), pa.array([starts], pa.list_(pa.int32())), pa.array([ends], pa.list_(pa.int32())), pa.array([costs], pa.list_(pa.int64())), pa.array([audits], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, names=["name", "part", "starts", "ends", "costs", "audits"])

    def path(pieces):
        import pandas as pd

        pieces = pieces.sort_values("part")
        best: dict[int, tuple[int, str, tuple[int, ...]]] = {0: (0, "", ())}
        for row in pieces.itertuples():
            after: dict[int, tuple[int, str, tuple[int, ...]]] = {}
            for a, b, cost, letters in zip(row.starts, row.ends, row.costs, row.audits):
                if a in best:
                    x = best[a][0] + int(cost), best[a][1] + letters, (*best[a][2], int(b))
                    after[int(b)] = min(after.get(int(b), x), x)
            best = after
        ends = min(x for state, x in best.items() if state in ENDS)[2]
        return pd.DataFrame({"part": pieces["part"].to_numpy(), "name": pieces["name"].to_numpy(), "start": [0, *ends[:-1]], "end": ends})

    made = own.mapInArrow(tables, "name string, part int, starts array<int>, ends array<int>, costs array<long>, audits array<string>")
    found = made.groupBy("name").applyInPandas(path, "part int, name string, start int, end int")
    return {(r["part"], r["name"]): (r["start"], (r["end"],)) for r in found.collect()}


def repaired(turns: DataFrame, id_col: str = "conv_id", present: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Edited turns (id, part and place: their order; edit, turn, was: initial before, fault; role and text, null if deleted), and a report of each
    conversation (id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256). turns: id, turn, role, text."""
    rows = _prepared(turns, id_col, F.lit(True) if present is None else present)
    known = F.struct(F.col("conv").isNotNull().alias("known"), "conv")
    edges = sorted(rows.groupBy("part").agg(F.min(known)["conv"].alias("first"), F.max(known)["conv"].alias("last")).collect())  # one short row a partition
    cut = [*{b["first"]: None for a, b in zip(edges, edges[1:]) if a["last"] == b["first"]}]
    if not cut:
        edits = _edited(rows, {})
        return edits.withColumnRenamed("conv", id_col), _reports(edits).withColumnRenamed("conv", id_col)
    names = F.broadcast(rows.sparkSession.createDataFrame([(x,) for x in cut], f"__cut {rows.schema['conv'].dataType.simpleString()}"))  # fewer than partitions
    within = F.col("conv").eqNullSafe(F.col("__cut"))
    own = rows.join(names, within, "left_semi")
    edits = _edited(rows.join(names, within, "left_anti"), {})
    across = _edited(own, _between(own))
    ordered = across.repartition("conv").sortWithinPartitions("conv", "part", "place")
    return edits.unionByName(across).withColumnRenamed("conv", id_col), _reports(edits).unionByName(_reports(ordered)).withColumnRenamed("conv", id_col)
