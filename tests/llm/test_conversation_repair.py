"""Conversation repair against trying all edits, the search against a plain one, long conversations in many segments."""

import hashlib
import random
import re
import zlib

import pytest

from spectral_topics.llm import conversation_repair as repair
from spectral_topics.llm.queries import QUERIES, damaged

NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}
NAMES = {"u": "user", "a": "assistant"}


def faults_by_hand(rows):
    seen, found = set(), []
    for _, role, text in rows:
        kind = ""
        if not re.search(r"[^\x20\x09-\x0D]", text):
            kind = "blank"
        elif (role, text) in seen:
            kind = "duplicate"
        elif re.findall(r"[^\x20\x09-\x0D]", text)[-1] not in ".!?":
            kind = "truncated"
        seen.add((role, text))
        found.append(kind)
    return found


def cheapest_by_hand(rows):
    """Table of the cheapest (cost, audit) by rows done and last role, insertions tried twice before each row and at the end."""
    faults = faults_by_hand(rows)
    best = {"": (0, "")}

    def better(table, state, entry):
        if state not in table or entry < table[state]:
            table[state] = entry

    def inserted(table):
        for _ in range(3):
            for state, (cost, audit) in list(table.items()):
                better(table, NEXT[state], (cost + 3, audit + "I"))
        return table

    for (_, role, _), fault in zip(rows, faults):
        after = {}
        for state, (cost, audit) in inserted(best).items():
            better(after, state, (cost + 4, audit + "D"))
            if fault in ("", "truncated"):
                more = 3 if fault else 0
                better(after, NEXT[state], (cost + 3 + more, audit + "R"))
                if role[:1] and (role[:1] == NEXT[state] or (role[:1] == "s" and state == "")):
                    better(after, role[:1], (cost + more, audit + "K"))
        best = after
    best = inserted(best)
    return min(best[s] for s in ("", "a") if s in best)


def repaired_by_hand(rows, audit):
    state, at, out = "", 0, []
    for letter in audit:
        if letter == "I":
            state = NEXT[state]
            out.append((NAMES[state], ""))
            continue
        _, role, text = rows[at]
        at += 1
        if letter == "K":
            state = role[0]
            out.append((role, text))
        elif letter == "R":
            state = NEXT[state]
            out.append((NAMES[state], text))
    assert at == len(rows) and re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in out))
    return out


def answer_by_hand(rows):
    """gaps, blank, duplicate, truncated, illegal, cost, audit, digest of rows (turn, role, text) in order."""
    faults = faults_by_hand(rows)
    turns = {t for t, _, _ in rows if t is not None}
    initials = [r[:1] for _, r, _ in rows]
    cost, audit = cheapest_by_hand(rows)
    lines = "\n".join(f"{r}:{t}" for r, t in repaired_by_hand(rows, audit))
    return (
        max(turns) - min(turns) + 1 - len(turns) if turns else 0,
        *(faults.count(k) for k in ("blank", "duplicate", "truncated")),
        sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
        cost,
        audit,
        hashlib.sha256(lines.encode()).hexdigest(),
    )


def some_rows(rng, n):
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", " "]
    texts = ["yes.", "no!", "what", "", " \n", "so?  ", "é.", "a", "b.", "c.", "d.", "e."]
    turns = sorted(rng.choice([*range(2 * n + 1)]) for _ in range(n))
    return [(None if rng.random() < 0.1 and not i else t, rng.choice(roles), rng.choice(texts)) for i, t in enumerate(turns)]


def found_rows(spark, conversations, **names):
    """Whole answers of the operator for ``{conv: rows}``."""
    flat = [(c, *r, "x", "y") for c, rows in conversations.items() for r in rows]
    df = spark.createDataFrame(flat, "conv_id long, turn long, role string, text string, conv string, place string").repartition(3)
    counts, pieces = repair.repair_conversations(df)
    digests = {r["conv"]: (r["audit"], r["sha256"]) for r in repair.conversation_digests(pieces).collect()}
    found = {r["conv"]: tuple(r)[1:] + digests[r["conv"]] for r in counts.collect()}
    assert len(found) == len(digests)
    return found


def in_order(rows):
    """Rows that are all of different turns, or equal."""
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))


def test_search_against_the_table():
    rng = random.Random(2)
    for _ in range(3000):
        rows = some_rows(rng, rng.randrange(9))
        held = repair.Segment(*(list(c) for c in zip(*rows))) if rows else repair.Segment([], [], [])
        faults = held.faults()
        assert faults == faults_by_hand(rows)
        found = repair.cheapest(held.steps(faults), repair.START, [repair.START, repair.ASSISTANT], len(rows) + 1)
        assert found == cheapest_by_hand(rows)
        assert [(t["role"], t["text"]) for t in held.edited(repair.START, found[1])] == repaired_by_hand(rows, found[1])


def distinct_turns(rng, n):
    return [(None if i == 0 and rng.random() < 0.3 else 2 * i + rng.randrange(2), r, t) for i, (_, r, t) in enumerate(some_rows(rng, n))]


@pytest.mark.parametrize("size, bits", [(256, 8), (3, 2), (1, 1)])
def test_operator(spark, monkeypatch, size, bits):
    """With small segments and levels, one long conversation among short ones goes through several levels."""
    monkeypatch.setattr(repair, "SEGMENT_ROWS", size)
    monkeypatch.setattr(repair, "LEVEL_BITS", bits)
    rng = random.Random(size)
    conversations = {c: distinct_turns(rng, rng.randrange(1, 9)) for c in range(40)}
    conversations[None] = distinct_turns(rng, 5)
    conversations[17] = distinct_turns(rng, 120)
    found = found_rows(spark, conversations)
    assert found == {c: answer_by_hand(rows) for c, rows in conversations.items()}


def test_a_third_of_all_rows_in_one_turn(spark, monkeypatch):
    """Equal rows of one turn, more than a segment holds: all but one are repeats."""
    monkeypatch.setattr(repair, "SEGMENT_ROWS", 16)
    conversations = {1: [(0, "user", "hello.")] * 300 + [(1, "assistant", "hi.")], 2: [(0, "user", "hello."), (1, "assistant", "hi.")]}
    found = found_rows(spark, conversations)
    assert found == {c: answer_by_hand(rows) for c, rows in conversations.items()}
    assert found[1][2] == 299 and found[1][5] == 4 * 299


def test_nulls_blanks_and_no_rows(spark):
    schema = "conv_id string, turn int, role string, text string"
    rows = [("a", None, None, None), ("b", 3, "user", " "), ("c", 1, "system", "s."), ("c", 1, "system", "s.")]
    counts, pieces = repair.repair_conversations(spark.createDataFrame(rows, schema))
    found = {r["conv"]: tuple(r)[1:] for r in counts.collect()}
    expected = {"a": [(None, " ", " ")], "b": [(3, "user", " ")], "c": [(1, "system", "s.")] * 2}
    assert found == {c: answer_by_hand(r)[:6] for c, r in expected.items()}
    counts, pieces = repair.repair_conversations(spark.createDataFrame([], schema))
    assert counts.collect() == [] and repair.conversation_digests(pieces).collect() == []


def damaged_by_hand(conv, rows):
    out = []
    for turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 1:
            text = ""
        elif kind == 2:
            text = re.sub("[.!?]", "", text)
        elif kind == 4:
            role = "user"
        out += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def test_damage_of_nulls(spark):
    rows = [(c, t, None if t == 3 else "user", None if t == 5 else "One. Two!") for c in (None, 4) for t in (None, *range(40))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = sorted((tuple(r) for r in damaged(df).collect()), key=str)
    expected = [(c, *r) for c in (None, 4) for r in damaged_by_hand(c, [x[1:] for x in rows if x[0] == c])]
    assert found == sorted(expected, key=str)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_on_a_whole_table(spark, sf):
    rows = spark.read.parquet(f"/root/testdata/{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    conversations = {}
    for conv, *row in rows:
        conversations.setdefault(conv, []).append(tuple(row))
    found = {r["conv_id"]: tuple(r)[1:] for r in QUERIES["op12_conversation_repair"](spark, f"/root/testdata/{sf}").collect()}
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    expected = {}
    for conv, turns in conversations.items():
        turns = damaged_by_hand(conv, in_order(turns))
        expected[conv] = answer_by_hand(turns) if turns else empty
    assert found == expected
