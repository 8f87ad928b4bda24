"""Conversation repair against a plain search."""

import hashlib
import heapq
import os
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F
from siltworks.llm import repair

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
LEGAL = re.compile(r"(s?(ua)+)?")
HASH = hashlib.sha256(b"").hexdigest()


def damage(rows):
    out, ids = [], []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        ids.append(conv)
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub(r"[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out, set(ids)


def mend(rows):
    """rows: (turn, role, text) of a conversation in order. The least (cost, audit) by search over prefixes of edits."""
    faults, seen = [], set()
    for _, role, text in rows:
        body = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
        fault = "b" if not body else "d" if (role, text) in seen else "t" if body[-1] not in ".!?" else ""
        faults.append(fault)
        seen.add((role, text))
    step = {"": {"u": "u", "s": "s"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, at, state, turns = heapq.heappop(heap)
        if (at, state) in done:
            continue
        done.add((at, state))
        if at == len(rows) and state in ("", "a"):
            break
        new = "u" if "u" in step[state] else "a"
        word = {"u": "user", "a": "assistant"}[new]
        heapq.heappush(heap, (cost + 5, audit + "I", at, new, (*turns, f"{word}:")))
        if at < len(rows):
            _, role, text = rows[at]
            heapq.heappush(heap, (cost + 2, audit + "D", at + 1, state, turns))
            if faults[at] not in ("b", "d"):
                extra = 5 if faults[at] == "t" else 0
                heapq.heappush(heap, (cost + 1 + extra, audit + "R", at + 1, new, (*turns, f"{word}:{text}")))
                if role[:1] in step[state]:
                    heapq.heappush(heap, (cost + extra, audit + "K", at + 1, role[0], (*turns, f"{role}:{text}")))
    known = [t for t, _, _ in rows if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    return gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, hashlib.sha256("\n".join(turns).encode()).hexdigest()


def expected(rows):
    spoilt, ids = damage(rows)
    by = {i: [] for i in ids}
    for conv, turn, role, text in spoilt:
        by[conv].append((turn, role, text))
    return {i: mend(sorted(r, key=lambda x: (x[0] is not None, x[0] or 0))) for i, r in by.items()}


def got(frame):
    rows = frame.collect()
    out = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in rows}
    assert len(out) == len(rows)
    return out


def conversations(seed, convs=60, most=14):
    r = random.Random(seed)
    rows = []
    for c in range(convs):
        for turn in range(r.randint(1, most)):
            role = r.choices(["user", "assistant", "system", "tool", None, ""], [9, 9, 2, 1, 1, 1])[0]
            text = r.choices([f"w{turn} {c}.", "Same thing!", "no end", "", " \t\n", None, "fine? ", "x.\x0b"], [9, 3, 3, 1, 1, 1, 2, 2])[0]
            rows.append((c, turn + (turn > 5) * r.randint(0, 2) * 3, role, text))
    rows.append((None, 3, "user", "Hi there."))
    rows.append((None, 4, "assistant", "Hello."))
    unique = {(c, t): (c, t, role, text) for c, t, role, text in rows}
    return list(unique.values())


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize(("seed", "ranges", "piece_rows"), [(1, 1, 4096), (2, 5, 4096), (3, 7, 2), (4, 40, 3)])
def test_like_search(spark, seed, ranges, piece_rows):
    rows = conversations(seed)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert got(repair.repair_report(repair.damaged(frame), ranges, piece_rows)) == expected(rows)


def test_table_like_search(spark):
    frame = spark.read.parquet(f"{FOLDER}/conversations.parquet")
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in frame.collect()]
    assert got(repair.repair_report(repair.damaged(frame))) == expected(rows)


def test_one_conversation_over_many_ranges(spark):
    """Half of all rows are one conversation, whose texts recur far apart."""
    r = random.Random(9)
    rows = [(7, t, r.choice(["user", "assistant"]), r.choice([f"t{t}.", f"t{t % 40}.", "t"])) for t in range(400)]
    rows += conversations(5, 30)
    rows = list({(c, t): (c, t, role, text) for c, t, role, text in rows}.values())
    frame = spark.createDataFrame(rows, SCHEMA)
    report = repair.repair_report(repair.damaged(frame), 9, 16)
    assert got(report) == expected(rows)


def test_turns_are_those_hashed(spark):
    rows = conversations(6)
    frame = repair.damaged(spark.createDataFrame(rows, SCHEMA))
    turns = repair.repaired_turns(frame, 6, 3).collect()
    by = {}
    for t in sorted(turns, key=lambda t: (t.conv_id is not None, t.conv_id, t.chunk, t.place) if t.conv_id is not None else (False, -1, t.chunk, t.place)):
        by.setdefault(t.conv_id, []).append((t.role, t.text))
    want = expected(rows)
    for conv, w in want.items():
        mine = by.get(conv, [])
        assert hashlib.sha256("\n".join(f"{r}:{t}" for r, t in mine).encode()).hexdigest() == w[-1]
        assert LEGAL.fullmatch("".join(r[0] for r, _ in mine))


def test_null_turns_ties_copies_and_long_texts(spark):
    long = "word " * 200_000 + "end."
    rows = [(1, None, "user", "First."), (1, 2, "assistant", long), (1, 2, "assistant", long), (2, None, "user", "A."), (2, None, "user", "A."), (3, 5, "user", long), (3, 5, "user", long)]
    frame = spark.createDataFrame(rows, SCHEMA).withColumns({"cost": F.lit("x"), "audit": F.lit(1), "fault": F.lit(None)})
    out = got(repair.repair_report(frame, 3, 2))
    assert out[1][:7] == (0, 0, 1, 0, 1, 2, "KKD") and out[2][:7] == (0, 0, 1, 0, 1, 4, "DD") and out[3][2] == 1
    assert out[2][7] == HASH


def test_nothing_left_and_no_rows(spark):
    gone = next(i for i in range(1000) if all(zlib.crc32(f"{i}:{t}".encode()) % 20 == 0 for t in (0,)))
    frame = spark.createDataFrame([(gone, 0, "user", "Hi.")], SCHEMA)
    assert got(repair.repair_report(repair.damaged(frame))) == {gone: (0, 0, 0, 0, 0, 0, "", HASH)}
    assert repair.repair_report(repair.damaged(spark.createDataFrame([], SCHEMA))).collect() == []
