"""Repair of conversations whose turns are blank, repeated, cut off or out of order, by the cheapest edits.

Rows of a conversation are taken by turn. Edits keep a row (K, cost 0), give it another role (R, 3), delete it (D, 4;
blank and repeated rows must go) or insert an empty turn of the user or the assistant (I, 3); a cut-off row that stays costs
3 more. The repaired roles are nothing, or an optional system turn and then user and assistant in turns. Of the cheapest lists of
edits the least one, letter by letter, is taken.

The lattice has a node for every number of rows done and every state: at the start, behind a system, a user or an
assistant turn. ``cheapest`` searches it from both ends with a heap each (bidirectional Dijkstra). Once the two
smallest costs add up to more than the best meeting, every cheapest path has an edge between a node settled from the
front and one settled from the back; all such crossings are compared by their whole list of edits. Nodes hold the
least list of letters among their cheapest, which is enough: two lists of one cost to a node are never one the beginning of the other,
since both do the same rows and an insertion costs something.

Conversations are cut into segments of bounded rows and bytes behind a range partitioning by (conversation, turn), so a
conversation of any size is spread over tasks. Most conversations are one segment and are solved where they are cut.
For the others a segment's cheapest edits are found for each state before and after it (with no insertion at its end:
that belongs to the next segment), ranked, and 256 segments at a time become one of the next level by the same search, over
costs and ranks in place of letters, until one is left. The choice then goes down the levels again. A level's rows have a
fixed size, so nothing grows with the conversation but the number of its segments.

Defined results
- Null conversations are one conversation; null turns come first; a null role or text is one space.
- Rows of one turn are ordered by role, then a hash of the text; equal rows are next to each other.
- Ties are broken by the least letters (D, I, K, R). Repeated rows are repeats. An empty table gives empty results.
- Columns other than the four are not read.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from spectral_topics.functions.storage import materialize
from spectral_topics.llm.common import arrow_map, forget, quoted

KEEP, REROLE, DELETE, INSERT = 0, 3, 4, 3
CUT_OFF = 3
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
#: The state that a turn of the next role leads to, and that role.
NEXT = {START: (USER, "user"), SYSTEM: (USER, "user"), USER: (ASSISTANT, "assistant"), ASSISTANT: (USER, "user")}
#: Where a kept row leads from a state, by the first letter of its role.
KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
LEGAL = ("su", "ua", "au")
#: Insertions that end a conversation well, by its last state.
ENDS = {START: "", ASSISTANT: "", USER: "I", SYSTEM: "II"}
WHITE = " \t\n\v\f\r"
#: Rows and bytes of a segment (a longer row is a segment of its own), and binary digits of places merged in a level.
SEGMENT_ROWS, SEGMENT_BYTES, LEVEL_BITS = 256, 1 << 20, 8

Edge = tuple[int, int, int, str]  # state before, state after, cost, letter


class Step:
    """What may be done at one place of the lattice, by the state before and by the state after."""

    def __init__(self, edges: Sequence[Edge]) -> None:
        self.out: list[list[tuple[int, int, str]]] = [[] for _ in STATES]
        self.back: list[list[tuple[int, int, str]]] = [[] for _ in STATES]
        for before, after, cost, letter in edges:
            self.out[before].append((after, cost, letter))
            self.back[after].append((before, cost, letter))


def row_step(initial: str, must_go: bool, cut_off: bool) -> Step:
    edges = [(s, s, DELETE, "D") for s in STATES]
    if not must_go:
        more = CUT_OFF if cut_off else 0
        edges += [(s, NEXT[s][0], REROLE + more, "R") for s in STATES]
        edges += [(s, t, KEEP + more, "K") for (s, letter), t in KEPT.items() if letter == initial]
    return Step(edges)


ROW_STEPS = {(i, g, c): row_step(i, g, c) for i in ("s", "u", "a", "") for g in (False, True) for c in (False, True)}
INSERTION = Step([(s, NEXT[s][0], INSERT, "I") for s in STATES])


def cheapest(steps: Sequence[Step], start: int, ends: Sequence[int], insert_before: int) -> tuple[int, str] | None:
    """Least cost of a path through all steps, and the least letters of such a path; None if there is none.

    Turns may be inserted before the steps numbered below ``insert_before``.
    """
    n = len(steps)
    front, back = [(0, 0, start, "")], [(0, 0, end, "") for end in ends]
    ahead: dict[tuple[int, int], tuple[int, str]] = {}
    behind: dict[tuple[int, int], tuple[int, str]] = {}
    best: tuple[int, str] | None = None
    while front or back:
        if best and (not front or not back or front[0][0] + back[0][0] > best[0]):
            break
        if front and (not back or front[0][0] <= back[0][0]):
            # Of one cost the node with fewer rows done comes first: only insertions, which cost something, do no row.
            cost, at, state, letters = heapq.heappop(front)
            if (at, state) in ahead:
                continue
            ahead[at, state] = cost, letters
            edges = [(at + 1, *e) for e in steps[at].out[state]] if at < n else []
            if at < insert_before:
                edges += [(at, *e) for e in INSERTION.out[state]]
            if at == n and state in ends and (best is None or (cost, letters) < best):
                best = cost, letters
            for to, after, more, letter in edges:
                rest = behind.get((to, after))
                if rest is not None:
                    whole = cost + more + rest[0], letters + letter + rest[1]
                    best = whole if best is None or whole < best else best
                if (to, after) not in ahead:
                    heapq.heappush(front, (cost + more, to, after, letters + letter))
        else:
            cost, done, state, letters = heapq.heappop(back)
            at = n - done
            if (at, state) in behind:
                continue
            behind[at, state] = cost, letters
            edges = [(at - 1, *e) for e in steps[at - 1].back[state]] if at else []
            if at < insert_before:
                edges += [(at, *e) for e in INSERTION.back[state]]
            if at == 0 and state == start and (best is None or (cost, letters) < best):
                best = cost, letters
            for to, before, more, letter in edges:
                rest = ahead.get((to, before))
                if rest is not None:
                    whole = rest[0] + more + cost, rest[1] + letter + letters
                    best = whole if best is None or whole < best else best
                if (to, before) not in behind:
                    heapq.heappush(back, (cost + more, n - to, before, letter + letters))
    return best


@dataclass
class Segment:
    """Some rows of a conversation next to each other."""

    turns: list
    roles: list[str]
    texts: list[str]

    def faults(self, seen: Sequence[bytes] = ()) -> list[str]:
        """Each row's first fault, or "". ``seen`` are digests of rows of earlier segments."""
        before, found = set(seen), []
        for role, text, digest in zip(self.roles, self.texts, self.digests()):
            bare = text.rstrip(WHITE)
            if not bare:
                found.append("blank")
            elif digest in before:
                found.append("duplicate")
            else:
                found.append("" if bare[-1] in ".!?" else "truncated")
            before.add(digest)
        return found

    def digests(self) -> list[bytes]:
        return [hashlib.sha256(f"{len(r)}:{r}{t}".encode()).digest() for r, t in zip(self.roles, self.texts)]

    def steps(self, faults: list[str]) -> list[Step]:
        return [
            ROW_STEPS[r[:1] if r[:1] in ("s", "u", "a") else "", f in ("blank", "duplicate"), f == "truncated"]
            for r, f in zip(self.roles, faults)
        ]

    def counts(self, faults: list[str]) -> dict:
        known = [t for t in self.turns if t is not None]
        initials = [r[:1] for r in self.roles]
        return {
            "blank": faults.count("blank"),
            "duplicate": faults.count("duplicate"),
            "truncated": faults.count("truncated"),
            "illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])),
            "first": initials[0],
            "last": initials[-1],
            "least_turn": min(known, default=None),
            "greatest_turn": max(known, default=None),
            "turns": len(set(known)),
        }

    def edited(self, state: int, letters: str) -> list[dict[str, str]]:
        """The turns that the edits leave."""
        out, row = [], 0
        for letter in letters:
            if letter == "I":
                state, role = NEXT[state]
                out.append({"role": role, "text": ""})
                continue
            if letter == "K":
                state = KEPT[state, self.roles[row][:1]]
                out.append({"role": self.roles[row], "text": self.texts[row]})
            elif letter == "R":
                state, role = NEXT[state]
                out.append({"role": role, "text": self.texts[row]})
            row += 1
        return out


COUNTS = (
    "struct<blank: long, duplicate: long, truncated: long, illegal: long, first: string, last: string, "
    "least_turn: long, greatest_turn: long, turns: long>"
)
TURNS = "array<struct<role: string, text: string>>"


def merged(parts: list[dict]) -> dict:
    """Counts of segments that follow each other."""
    out = dict(parts[0])
    for p in parts[1:]:
        for name in ("blank", "duplicate", "truncated"):
            out[name] += p[name]
        out["illegal"] += p["illegal"] + (out["last"] + p["first"] not in LEGAL)
        out["last"] = p["last"]
        out["turns"] += p["turns"] - (p["turns"] > 0 and p["least_turn"] == out["greatest_turn"])
        if p["turns"]:
            out["greatest_turn"] = p["greatest_turn"]
            if out["least_turn"] is None:
                out["least_turn"] = p["least_turn"]
    return out


def options(steps: Sequence[Step], insert_before: int) -> tuple[list[int | None], list[int | None], list[str | None]]:
    """Cost, rank and letters of the cheapest path from each state to each state (16 of each, None where there is no path)."""
    found = [cheapest(steps, s, [t], insert_before) for s in STATES for t in STATES]
    order = {letters: i for i, letters in enumerate(sorted({f[1] for f in found if f}))}
    return [f and f[0] for f in found], [f and order[f[1]] for f in found], [f and f[1] for f in found]


def segment_steps(children: list[dict]) -> list[Step]:
    """Steps over whole segments: their costs, and their ranks as letters."""
    pairs = [(s, t) for s in STATES for t in STATES]
    return [
        Step([(s, t, cost, chr(65 + rank)) for (s, t), cost, rank in zip(pairs, c["costs"], c["ranks"]) if cost is not None]) for c in children
    ]


def arrow_rows(function):
    """``function`` from and to rows as dictionaries, as a function of Arrow batches; ``schema`` is that of its rows."""

    def apply(df: DataFrame, schema: StructType) -> DataFrame:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            forget()
            for batch in batches:
                for at in range(0, len(batch), 64):
                    out = [r for row in batch.slice(at, 64).to_pylist() for r in function(row)]
                    yield pa.RecordBatch.from_pylist(out, schema=target)

        return arrow_map(df, run, schema)

    return apply


def schema_of(df: DataFrame, key: Sequence[str], rest: str) -> StructType:
    return StructType([StructField(k, df.schema[k].dataType) for k in key] + list(StructType.fromDDL(rest).fields))


def cut_segments(rows: DataFrame) -> DataFrame:
    """``(conv, part, number, alone, turns, roles, texts, counts, cost, audit, repaired, digests)``: a row for each segment.

    A conversation is ``alone`` if one segment surely holds it all: others stand before and behind it in its
    partition. It's solved here, and its rows aren't passed on. Those of others are.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    rest = (
        "part long, number long, alone boolean, turns array<long>, roles array<string>, texts array<string>, "
        f"counts {COUNTS}, cost long, audit string, repaired {TURNS}, digests array<binary>"
    )
    schema = schema_of(rows, ["conv"], rest)
    target = to_arrow_schema(schema)
    spread = rows.repartitionByRange("conv", "turn", "role", "tie", "salt").sortWithinPartitions("conv", "turn", "role", "tie")

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        part = TaskContext.get().partitionId()
        conv, number, size, first, held = None, 0, 0, True, Segment([], [], [])

        def closed(alone: bool) -> dict:
            row = {"conv": conv, "part": part, "number": number, "alone": alone}
            if not alone:
                return row | {"turns": held.turns, "roles": held.roles, "texts": held.texts, "digests": list(set(held.digests()))}
            faults = held.faults()
            cost, audit = cheapest(held.steps(faults), START, [START, ASSISTANT], len(held.roles) + 1)
            return row | {"counts": held.counts(faults), "cost": cost, "audit": audit, "repaired": held.edited(START, audit)}

        for batch in batches:
            for row in batch.to_pylist():
                if held.roles and row["conv"] != conv:
                    yield closed(alone=number == 0 and not first)
                    number, size, first, held = 0, 0, False, Segment([], [], [])
                elif len(held.roles) == SEGMENT_ROWS or (held.roles and size + len(row["text"]) > SEGMENT_BYTES):
                    yield closed(alone=False)
                    number, size, held = number + 1, 0, Segment([], [], [])
                conv = row["conv"]
                held.turns.append(row["turn"])
                held.roles.append(row["role"])
                held.texts.append(row["text"])
                size += len(row["text"])
        if held.roles:
            yield closed(alone=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        out, size = [], 0
        for row in segments(batches):
            out.append(row)
            size += sum(map(len, row.get("texts") or [t["text"] for t in row["repaired"]]))
            if len(out) == 500 or size > SEGMENT_BYTES:
                yield pa.RecordBatch.from_pylist(out, schema=target)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=target)

    return arrow_map(spread.select("conv", "turn", "role", "text"), run, schema)


def earlier_digests(segments: DataFrame) -> DataFrame:
    """``(conv, place, seen)``: digests of a segment's rows that an earlier segment of the conversation has."""
    each = segments.select("conv", "place", F.explode("digests").alias("digest"))
    first = each.groupBy(F.col("conv").alias("its_conv"), F.col("digest").alias("its_digest")).agg(F.min("place").alias("first"))
    again = each.join(first, F.col("conv").eqNullSafe(F.col("its_conv")) & (F.col("digest") == F.col("its_digest"))).where("place > first")
    return again.groupBy(F.col("conv").alias("its_conv"), F.col("place").alias("its_place")).agg(F.collect_list("digest").alias("seen"))


@arrow_rows
def solve_segment(row: dict) -> Iterator[dict]:
    held = Segment(row["turns"], row["roles"], row["texts"])
    faults = held.faults(row["seen"] or ())
    costs, ranks, audits = options(held.steps(faults), len(faults))
    yield {k: row[k] for k in ("conv", "place", "turns", "roles", "texts")} | {
        "counts": held.counts(faults),
        "costs": costs,
        "ranks": ranks,
        "audits": audits,
    }


@arrow_rows
def solve_level(row: dict) -> Iterator[dict]:
    costs, ranks, _ = options(segment_steps(row["children"]), 0)
    counts = merged([c["counts"] for c in row["children"]])
    yield {"conv": row["conv"], "place": row["up"], "counts": counts, "costs": costs, "ranks": ranks}


@arrow_rows
def choose_children(row: dict) -> Iterator[dict]:
    children, state = row["children"], row["entry"]
    _, letters = cheapest(segment_steps(children), row["entry"], [row["leave"]], 0)
    for i, (child, letter) in enumerate(zip(children, letters)):
        after = next(t for t in STATES if child["ranks"][4 * state + t] == ord(letter) - 65)
        tail = row["tail"] if i == len(children) - 1 else ""
        yield {"conv": row["conv"], "place": child["place"], "entry": state, "leave": after, "tail": tail}
        state = after


@arrow_rows
def edit_segment(row: dict) -> Iterator[dict]:
    letters = row["audits"][4 * row["entry"] + row["leave"]] + row["tail"]
    repaired = Segment(row["turns"], row["roles"], row["texts"]).edited(row["entry"], letters)
    yield {"conv": row["conv"], "place": row["place"], "audit": letters, "repaired": repaired}


def joined(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
    """``a`` with the row of ``b(its_conv, its_place, ...)`` for its conversation and place."""
    on = F.col("conv").eqNullSafe(F.col("its_conv")) & (F.col("place") == F.col("its_place"))
    return a.join(b, on, how).drop("its_conv", "its_place")


def keyed(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({"conv": "its_conv", "place": "its_place"})


def solve_many(segments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(conv, counts, cost)`` and ``(conv, place, audit, repaired)`` of conversations in several segments."""
    digits = (segments.agg(F.max("number")).first()[0] or 0).bit_length()
    segments = segments.withColumn("place", F.shiftleft("part", digits) + F.col("number"))
    known = joined(segments, earlier_digests(segments), "left").select("conv", "place", "turns", "roles", "texts", "seen")
    solved = f"place long, counts {COUNTS}, costs array<long>, ranks array<int>"
    held = "turns array<long>, roles array<string>, texts array<string>, audits array<string>"
    leaves = materialize(solve_segment(known, schema_of(segments, ["conv"], f"{solved}, {held}")), "conversation-segments")
    level, families = leaves.select("conv", "place", "counts", "costs", "ranks"), []
    left = (leaves.agg(F.max("place")).first()[0] or 0).bit_length()
    while left > 0:
        child = F.struct("place", "counts", "costs", "ranks")
        family = level.groupBy("conv", F.shiftright("place", LEVEL_BITS).alias("up")).agg(F.array_sort(F.collect_list(child)).alias("children"))
        families.append(materialize(family, "conversation-level"))
        level = solve_level(families[-1], schema_of(segments, ["conv"], solved))
        left -= LEVEL_BITS
    level = materialize(level, "conversation-level")
    ends = [
        F.struct((F.col("costs")[t] + INSERT * len(tail)).alias("cost"), F.col("ranks")[t].alias("rank"), F.lit(t).alias("leave"), F.lit(tail).alias("tail"))
        for t, tail in ENDS.items()
    ]
    # From the start, the costs of the four states after come first.
    end = F.array_min(F.filter(F.array(*ends), lambda e: e["cost"].isNotNull()))
    top = level.withColumn("end", end)
    chosen = top.select("conv", "place", F.lit(START).alias("entry"), "end.leave", "end.tail")
    choice = "place long, entry int, leave int, tail string"
    for family in reversed(families):
        both = joined(family.withColumnRenamed("up", "place"), keyed(chosen))
        chosen = choose_children(both, schema_of(segments, ["conv"], choice))
    pieces = edit_segment(joined(leaves, keyed(chosen)), schema_of(segments, ["conv"], f"place long, audit string, repaired {TURNS}"))
    return top.select("conv", "counts", "end.cost"), materialize(pieces, "conversation-pieces")


def repair_conversations(
    conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """What was wrong with each conversation, and its repaired turns.

    The first result has a row for each: ``(conv, gaps, blank, duplicate, truncated, illegal, cost)``. The second has a
    row for each piece of one: ``(conv, place, whole, audit, repaired)``, edits and turns in order of ``place``;
    ``whole`` where the piece is all of the conversation.
    """
    space = F.lit(" ")
    rows = conversations.select(
        quoted(conv_col).alias("conv"),
        quoted(turn_col).cast("long").alias("turn"),
        F.coalesce(quoted(role_col).cast("string"), space).alias("role"),
        F.coalesce(quoted(text_col).cast("string"), space).alias("text"),
    )
    # Equal rows may go to several partitions: any order of them is the same.
    rows = rows.withColumn("tie", F.xxhash64("text")).withColumn("salt", F.monotonically_increasing_id())
    cut = materialize(cut_segments(rows), "conversations")
    counts, pieces = solve_many(cut.where("not alone").select("conv", "part", "number", "turns", "roles", "texts", "digests"))
    alone = cut.where("alone")
    counts = alone.select("conv", "counts", "cost").unionByName(counts)
    whole = alone.select("conv", F.lit(0).cast("long").alias("place"), F.lit(True).alias("whole"), "audit", "repaired")
    gaps = F.when(F.col("counts.turns") > 0, F.expr("counts.greatest_turn - counts.least_turn + 1 - counts.turns")).otherwise(0)
    faults = [f"counts.{n}" for n in ("blank", "duplicate", "truncated", "illegal")]
    return (
        counts.select("conv", gaps.cast("long").alias("gaps"), *faults, "cost"),
        whole.unionByName(pieces.withColumn("whole", F.lit(False))),
    )


def conversation_digests(pieces: DataFrame) -> DataFrame:
    """``(conv, audit, sha256)``: all edits, and the digest of the repaired turns as ``role:text`` lines.

    A digest of more than one piece is taken over the pieces one after the other, as they come from a sort; a
    conversation's text isn't held in memory, but it passes through one task, because a digest can't be split.
    """
    lines = F.array_join(F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    text = pieces.select("conv", "place", "whole", "audit", lines.alias("text"), (F.size("repaired") > 0).alias("some"))
    alone = text.where("whole").select("conv", "audit", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))
    schema = schema_of(pieces, ["conv"], "audit string, sha256 string")
    parts = text.where("not whole").repartition("conv").sortWithinPartitions("conv", "place")

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        forget()
        target = to_arrow_schema(schema)
        conv, audits, digest, lines = None, [], None, False
        for batch in batches:
            for row in batch.to_pylist():
                if digest is None or row["conv"] != conv:
                    if digest is not None:
                        yield pa.RecordBatch.from_pylist([{"conv": conv, "audit": "".join(audits), "sha256": digest.hexdigest()}], schema=target)
                    conv, audits, digest, lines = row["conv"], [], hashlib.sha256(), False
                audits.append(row["audit"])
                if row["some"]:
                    digest.update((b"\n" if lines else b"") + row["text"].encode())
                    lines = True
        if digest is not None:
            yield pa.RecordBatch.from_pylist([{"conv": conv, "audit": "".join(audits), "sha256": digest.hexdigest()}], schema=target)

    return alone.unionByName(arrow_map(parts.select("conv", "audit", "text", "some"), digested, schema))
