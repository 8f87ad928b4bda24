"""Repair of conversation structure by cheapest edits.

A conversation should run system?, then user and assistant in turn. Rows are kept, given another role, deleted, or missing ones inserted, each at
a cost; among the cheapest edits the least string of initials is taken. Four states say what was emitted last, so the whole search is a table of
four costs per turn. Conversations of like length form one tensor, turn by state by conversation: costs are filled from the last turn back, a
turn of all conversations at a time, kept, and traced forward the same way.

Rows are sorted in ranges, so a long conversation spreads over many tasks. A conversation that lies inside a range is repaired there. One that
reaches a range's end, or has more rows than one piece may hold, is cut into pieces: a piece's costs between all states are a 4 by 4 matrix, and
the matrices chain (min, +) from the last piece back; then each piece traces its edits from every state it could begin in, and one stream over
the pieces in order picks the edits, writes the turns and hashes them. Only that stream sees a whole conversation, a piece at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from siltworks.session import scratch, ship_package

# What edits cost, and the characters that end a sentence.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
ENDS = ".!?"
SPACE = " \t\n\x0b\x0c\r"

#: Rows and bytes of text of one piece, rows of a tensor, rows of a range, and ranges at most (a range streams, so more rows cost time alone).
PIECE_ROWS, PIECE_BYTES, TENSOR_ROWS, RANGE_ROWS, MOST_RANGES = 4096, 4 << 20, 1 << 17, 16_384, 20_000

#: States: nothing emitted, system, user, assistant. AFTER is the state that an emitted user or assistant leads to, WORD the role it then is.
STATES, AFTER, WORD = 4, np.array([2, 2, 3, 2]), ("user", "user", "assistant", "user")
NEVER = 1 << 30
FINAL = np.array([0, NEVER, NEVER, 0])
#: Classes of roles by initial, and faults; a row's code is 4 * class + fault, PAD is no row.
CLASSES, NO_CLASS = {"u": 0, "a": 1, "s": 2}, 3
SOUND, BLANK, DUPLICATE, CUT = range(4)
PAD = 16


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code and state: what keeping costs, the state it leads to, and what giving another role costs."""
    leads = np.full((STATES, 4), -1)
    leads[0] = [2, -1, 1, -1]
    leads[1] = leads[3] = [2, -1, -1, -1]
    leads[2] = [-1, 3, -1, -1]
    keep, to, rerole = (np.full((PAD + 1, STATES), v) for v in (NEVER, 0, NEVER))
    for code in range(PAD):
        kind, fault = divmod(code, 4)
        if fault in (BLANK, DUPLICATE):
            continue
        extra = TRUNCATED if fault == CUT else 0
        fits = leads[:, kind] >= 0
        keep[code][fits] = extra
        to[code] = np.where(fits, leads[:, kind], 0)
        rerole[code] = REROLE + extra
    return keep, to, rerole


KEEP, KEEP_TO, RE = _tables()


def _with_inserts(costs: np.ndarray) -> np.ndarray:
    """Costs of each state (rows), where up to two turns may be inserted first; a third would only come back."""
    for _ in range(2):
        costs = np.minimum(costs, INSERT + costs[AFTER])
    return costs


def backward(codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Costs[t, state, conversation] of what is left from turn t on. codes: turn by conversation, filled up with PAD; ends: state by conversation."""
    turns, many = codes.shape
    costs = np.empty((turns + 1, STATES, many), np.int64)
    costs[turns] = ends
    which = np.arange(many)
    for t in range(turns - 1, -1, -1):
        code, later = codes[t], costs[t + 1]
        best = np.minimum(DELETE + later, RE[code].T + later[AFTER])
        best = np.minimum(best, KEEP[code].T + later[KEEP_TO[code].T, which])
        costs[t] = np.where(code == PAD, later, np.minimum(_with_inserts(best), NEVER))
    return costs


def forward(codes: np.ndarray, costs: np.ndarray, state: np.ndarray, closing: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """Least initials of the cheapest edits of each conversation from its state on, and the states they end in. Where closing holds, turns may be
    inserted after the last row, too."""
    turns, many = codes.shape
    out = np.zeros((turns + 1, 3, many), np.uint8)
    which = np.arange(many)
    state = state.copy()
    for t in range(turns + 1):
        if t < turns:
            code, later = codes[t], costs[t + 1]
            real = code != PAD
        else:
            code, later, real = None, None, closing
        for step in range(2):
            here = costs[t][state, which]
            stay = (DELETE + later[state, which] == here) if t < turns else (FINAL[state] == here)
            inserts = real & ~stay & (INSERT + costs[t][AFTER[state], which] == here) & (here < NEVER)
            out[t, step][inserts] = ord("I")
            state = np.where(inserts, AFTER[state], state)
        if t == turns:
            break
        here = costs[t][state, which]
        delete = real & (DELETE + later[state, which] == here)
        kept = real & ~delete & (KEEP[code, state] + later[KEEP_TO[code, state], which] == here)
        given = real & ~delete & ~kept
        out[t, 2] = np.select([delete, kept, given], [ord("D"), ord("K"), ord("R")], 0)
        state = np.select([kept, given], [KEEP_TO[code, state], AFTER[state]], state)
    flat = out.reshape(-1, many)
    return [column[column > 0].tobytes() for column in flat.T], state


def tensor(codes: list[bytes]) -> np.ndarray:
    """Turn by conversation, short ones filled up at their ends."""
    out = np.full((max(map(len, codes), default=0), len(codes)), PAD, np.uint8)
    for i, row in enumerate(codes):
        out[: len(row), i] = np.frombuffer(row, np.uint8)
    return out


def _replay(audit: bytes, roles: list[str], texts: list[str], state: int) -> Iterator[tuple[str, str]]:
    """The repaired turns."""
    at = 0
    for edit in audit:
        if edit == ord("I"):
            yield WORD[state], ""
            state = int(AFTER[state])
            continue
        if edit == ord("K"):
            yield roles[at], texts[at]
            state = int(KEEP_TO[4 * _class(roles[at]), state])
        elif edit == ord("R"):
            yield WORD[state], texts[at]
            state = int(AFTER[state])
        at += 1


def _class(role: str) -> int:
    return CLASSES.get(role[:1], NO_CLASS)


def _digest(role: str, text: str) -> bytes:
    r = role.encode("utf-8", "surrogatepass")
    return hashlib.blake2b(len(r).to_bytes(8, "little") + r + text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


class Tally:
    """What is counted over the rows of a conversation, fed in order, piece by piece."""

    def __init__(self):
        self.first = self.last = None
        self.distinct = self.illegal = 0
        self.faults = [0, 0, 0, 0]
        self.initial = None

    def feed(self, turns: list, roles: list[str], codes: bytes) -> None:
        for turn in turns:
            if turn is not None and (self.last is None or turn != self.last):
                self.first = turn if self.first is None else self.first
                self.last = turn
                self.distinct += 1
        for fault, n in enumerate(np.bincount(np.frombuffer(codes, np.uint8) % 4, minlength=4).tolist()):
            self.faults[fault] += n
        initials = ([] if self.initial is None else [self.initial]) + [r[:1] for r in roles]
        self.illegal += sum(a + b not in ("su", "ua", "au") for a, b in pairwise(initials))
        self.initial = initials[-1] if initials else None

    def counts(self) -> tuple[int, int, int, int, int]:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.distinct
        return gaps, self.faults[BLANK], self.faults[DUPLICATE], self.faults[CUT], self.illegal


REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
REPORT_NAMES = [c.split()[0] for c in REPORT.split(", ")]
TURNS = "array<struct<role:string,text:string>>"


class Writer:
    """Hashes the repaired turns of one conversation as they come."""

    def __init__(self):
        self.hash, self.begun = hashlib.sha256(), False

    def put(self, turns: list[tuple[str, str]]) -> None:
        if turns:
            lines = "\n".join(f"{r}:{t}" for r, t in turns)
            self.hash.update((("\n" if self.begun else "") + lines).encode("utf-8", "surrogatepass"))
            self.begun = True


def _codes(roles: list[str], texts: list[str], faults: list[int]) -> bytes:
    """Codes of the rows of a whole conversation: native faults, and rows seen before."""
    seen, out = set(), bytearray()
    for role, text, fault in zip(roles, texts, faults, strict=True):
        if fault != BLANK:
            if (role, text) in seen:
                fault = DUPLICATE
            seen.add((role, text))
        out.append(4 * _class(role) + fault)
    return bytes(out)


# ---------------------------------------------------------------------------------------------------------------- rows


def fault_of(text: Column) -> Column:
    """BLANK or CUT where a text by itself is; duplicates need the conversation."""
    body = F.rtrim(text, F.lit(SPACE))
    return F.when(body == "", BLANK).when(F.right(body, F.lit(1)).isin(*ENDS), SOUND).otherwise(CUT)


def prepared(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, alive, fault, tie): nulls in role and text become a space. Rows that are not alive only name a conversation."""
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    alive = F.col("alive") if "alive" in rows.columns else F.lit(True)
    picked = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), alive.alias("alive"))
    return picked.withColumn("fault", fault_of(F.col("text"))).withColumn("tie", F.xxhash64("role", "text"))


class _Conversation:
    __slots__ = ("conv_id", "faults", "opens", "roles", "size", "texts", "turns")

    def __init__(self, conv_id, opens: bool):
        self.conv_id, self.opens = conv_id, opens
        self.turns, self.roles, self.texts, self.faults, self.size = [], [], [], [], 0


def _repaired(group: list[_Conversation], with_turns: bool) -> Iterator[tuple]:
    """(conv_id, report..., turns) of whole conversations of like length."""
    rows = [_codes(c.roles, c.texts, c.faults) for c in group]
    codes = tensor(rows)
    ends = np.repeat(_with_inserts(FINAL)[:, None], len(group), axis=1)
    costs = backward(codes, ends)
    audits, _ = forward(codes, costs, np.zeros(len(group), np.int64), np.ones(len(group), bool))
    for c, row, audit, cost in zip(group, rows, audits, costs[0, 0].tolist(), strict=True):
        tally, writer = Tally(), Writer()
        tally.feed(c.turns, c.roles, row)
        turns = list(_replay(audit, c.roles, c.texts, 0))
        writer.put(turns)
        yield c.conv_id, *tally.counts(), cost, audit.decode(), writer.hash.hexdigest(), turns if with_turns else None


def _first_pass(rows: DataFrame, ranges: int, piece_rows: int, with_turns: bool) -> DataFrame:
    """Reports of the conversations that lie inside a range (whole), and the pieces of all others."""
    types = dict(rows.dtypes)
    fields = f"conv_id {types['conv_id']}, whole boolean, {REPORT}, repaired {TURNS}, part int, piece long, turns array<{types['turn']}>, roles array<string>, texts array<string>, faults binary"
    names = ["conv_id", "whole", *REPORT_NAMES, "repaired", "part", "piece", "turns", "roles", "texts", "faults"]

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, piece = TaskContext.get().partitionId(), 0
        buckets: dict[int, list[_Conversation]] = {}
        held = 0
        now: _Conversation | None = None
        out: list[tuple] = []

        def as_piece(c: _Conversation) -> None:
            nonlocal piece
            out.append((c.conv_id, False, *[None] * 9, part, piece, c.turns, c.roles, c.texts, bytes(c.faults)))
            piece += 1

        def settle(c: _Conversation) -> None:
            nonlocal held
            buckets.setdefault(len(c.turns).bit_length(), []).append(c)
            held += c.size
            bucket = buckets[len(c.turns).bit_length()]
            if len(bucket) << len(c.turns).bit_length() >= TENSOR_ROWS:
                repair_all([len(c.turns).bit_length()])
            elif held > PIECE_BYTES:
                repair_all(list(buckets))

        def repair_all(keys: list[int]) -> None:
            nonlocal held
            for key in keys:
                group = buckets.pop(key)
                held -= sum(c.size for c in group)
                out.extend((r[0], True, *r[1:], *[None] * 6) for r in _repaired(group, with_turns))

        def flush() -> Iterator[pa.RecordBatch]:
            if out:
                yield _batch(out, names, fields_type)
                out.clear()

        for batch in batches:
            for slice_at in range(0, batch.num_rows, 1000):
                columns = [batch.slice(slice_at, 1000).column(n).to_pylist() for n in ("conv_id", "turn", "role", "text", "alive", "fault")]
                for conv_id, turn, role, text, alive, fault in zip(*columns, strict=True):
                    if now is None or conv_id != now.conv_id:
                        if now is not None:
                            (as_piece if now.opens else settle)(now)
                        now = _Conversation(conv_id, now is None)
                    elif len(now.turns) >= piece_rows or now.size > PIECE_BYTES:
                        as_piece(now)
                        now = _Conversation(conv_id, True)
                    if alive:
                        now.turns.append(turn)
                        now.roles.append(role)
                        now.texts.append(text)
                        now.faults.append(fault)
                        now.size += len(text) + len(role) + 64
                yield from flush()
        if now is not None:
            as_piece(now)
        repair_all(list(buckets))
        yield from flush()

    fields_type = _arrow_types(fields)
    ship_package(rows.sparkSession)
    # The salt parts rows that are equal throughout; which of them lies where does not matter.
    salted = rows.withColumn("salt", F.rand(7))
    ordered = salted.repartitionByRange(ranges, "conv_id", "turn", "tie", "salt").sortWithinPartitions("conv_id", "turn", "tie")
    return ordered.select("conv_id", "turn", "role", "text", "alive", "fault").mapInArrow(convert, fields)


def _arrow_types(schema: str) -> list[pa.DataType]:
    return [f.type for f in to_arrow_schema(StructType.fromDDL(schema))]


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    arrays = []
    for values, kind in zip(columns, types, strict=True):
        if pa.types.is_list(kind) and pa.types.is_struct(kind.value_type):
            keys = [kind.value_type.field(i).name for i in range(kind.value_type.num_fields)]
            values = [None if v is None else [dict(zip(keys, x, strict=True)) for x in v] for v in values]
        arrays.append(pa.array(values, kind))
    return pa.RecordBatch.from_arrays(arrays, names)


# -------------------------------------------------------------------------------------------------------------- pieces


def _mapped(frame: DataFrame, each: Callable[[dict], tuple | None], schema: str, slices: int = 16) -> DataFrame:
    """One row out per row in, or none; a few rows are Python objects at a time."""
    types = _arrow_types(schema)
    names = [c.split(" ")[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, slices):
                got = [x for x in map(each, batch.slice(at, slices).to_pylist()) if x is not None]
                yield _batch(got, names, types)

    return frame.mapInArrow(run, schema)


def _later_copies(pieces: DataFrame) -> DataFrame:
    """(part, piece, later): places in each piece whose role and text an earlier piece of the conversation has. A piece names each text once, so
    however often a text is repeated, it counts for a row a piece here."""

    schema = f"conv_id {dict(pieces.dtypes)['conv_id']}, part int, piece long, at array<int>, digest array<binary>"

    def each(row: dict) -> tuple:
        seen: dict[bytes, int] = {}
        for at, (role, text, fault) in enumerate(zip(row["roles"], row["texts"], row["faults"], strict=True)):
            if fault != BLANK:
                seen.setdefault(_digest(role, text), at)
        return row["conv_id"], row["part"], row["piece"], list(seen.values()), list(seen)

    named = _mapped(pieces.select("conv_id", "part", "piece", "roles", "texts", "faults"), each, schema)
    rows = named.select("conv_id", "part", "piece", F.explode(F.arrays_zip("at", "digest")).alias("z")).select("conv_id", "part", "piece", "z.at", "z.digest")
    rows = scratch(rows, "digests")
    place = F.struct("part", "piece")
    firsts = rows.groupBy(F.col("conv_id").alias("c"), F.col("digest").alias("d")).agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    late = rows.join(firsts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d"))).where(place > F.col("first"))
    return late.groupBy("part", "piece").agg(F.collect_list("at").alias("later"))


def _unit_matrix(codes: bytes) -> list[int]:
    """Least costs from each state (rows) to each state over a piece."""
    four = np.repeat(np.frombuffer(codes, np.uint8)[:, None], STATES, axis=1)
    ends = np.where(np.eye(STATES, dtype=bool), 0, NEVER)
    return backward(four, ends)[0].reshape(-1).tolist() if len(codes) else ends.reshape(-1).tolist()


def _chained(frame: DataFrame, order: list, step: Callable, schema: str) -> DataFrame:
    """Streams rows of each conversation in order through step(state, row, last) -> (state, [rows out]); a row comes when it is known to be the
    last of its conversation or not. state is None at a conversation's start."""
    types = _arrow_types(schema)
    names = [c.split(" ")[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state = None, None
        out: list[tuple] = []
        for batch in batches:
            for at in range(0, batch.num_rows, 16):
                for row in batch.slice(at, 16).to_pylist():
                    if held is not None:
                        last = held["conv_id"] != row["conv_id"]
                        state, made = step(state, held, last)
                        out.extend(made)
                        state = None if last else state
                    held = row
                if out:
                    yield _batch(out, names, types)
                    out.clear()
        if held is not None:
            out.extend(step(state, held, True)[1])
            yield _batch(out, names, types)

    return frame.repartition("conv_id").sortWithinPartitions("conv_id", *order).mapInArrow(run, schema)


def _ends(pieces: DataFrame) -> DataFrame:
    """(part, piece, ends, closing): what is left to pay after each piece, by state, from the last piece of a conversation back."""

    def step(after, row, last):
        # In descending order the first row is the conversation's last piece.
        ends = _with_inserts(FINAL) if after is None else after
        costs = np.array(row["matrix"], np.int64).reshape(STATES, STATES) + ends[None, :]
        return np.minimum(costs.min(axis=1), NEVER), [(row["part"], row["piece"], ends.tolist(), after is None)]

    order = [F.desc("part"), F.desc("piece")]
    return _chained(pieces.select("conv_id", "part", "piece", "matrix"), order, step, "part int, piece long, ends array<long>, closing boolean")


def _joined(pieces: DataFrame, with_turns: bool) -> DataFrame:
    """Reports of the conversations that lie in pieces; with turns, a row per piece, of which only the last has a report."""
    kind = dict(pieces.dtypes)["conv_id"]
    late = _later_copies(pieces)

    def coded(row: dict) -> tuple:
        seen, codes, later = set(), bytearray(), set(row["later"] or ())
        for at, (role, text, fault) in enumerate(zip(row["roles"], row["texts"], row["faults"], strict=True)):
            if fault != BLANK:
                if at in later or (role, text) in seen:
                    fault = DUPLICATE
                seen.add((role, text))
            codes.append(4 * _class(role) + fault)
        return row["conv_id"], row["part"], row["piece"], bytes(codes), _unit_matrix(bytes(codes))

    with_codes = _mapped(
        pieces.select("conv_id", "part", "piece", "roles", "texts", "faults").join(late, ["part", "piece"], "left"),
        coded,
        f"conv_id {kind}, part int, piece long, codes binary, matrix array<long>",
    )
    with_codes = scratch(with_codes, "matrices")

    def traced(row: dict) -> tuple:
        four = np.repeat(np.frombuffer(row["codes"], np.uint8)[:, None], STATES, axis=1)
        costs = backward(four, np.repeat(np.array(row["ends"], np.int64)[:, None], STATES, axis=1))
        audits, ends = forward(four, costs, np.arange(STATES), np.full(STATES, row["closing"]))
        return row["part"], row["piece"], row["codes"], [a.decode() for a in audits], ends.tolist(), int(costs[0, 0, 0])

    traces = _mapped(
        with_codes.join(_ends(with_codes), ["part", "piece"]),
        traced,
        "part int, piece long, codes binary, audits array<string>, exits array<long>, cost long",
    )

    def step(state, row, last):
        if state is None:
            state = {"at": 0, "tally": Tally(), "writer": Writer(), "cost": row["cost"], "audit": [], "chunk": 0}
        audit = row["audits"][state["at"]]
        state["tally"].feed(row["turns"], row["roles"], row["codes"])
        turns = list(_replay(audit.encode(), row["roles"], row["texts"], state["at"]))
        state["writer"].put(turns)
        state["audit"].append(audit)
        state["at"] = row["exits"][state["at"]]
        state["chunk"] += 1
        report = (*state["tally"].counts(), state["cost"], "".join(state["audit"]), state["writer"].hash.hexdigest()) if last else (None,) * 8
        if not last and not with_turns:
            return state, []
        return state, [(row["conv_id"], state["chunk"] - 1, last, *report, turns if with_turns else None)]

    whole = pieces.select("conv_id", "part", "piece", "turns", "roles", "texts").join(traces, ["part", "piece"])
    return _chained(whole, ["part", "piece"], step, f"conv_id {kind}, chunk long, last boolean, {REPORT}, repaired {TURNS}")


def _repair(rows: DataFrame, with_turns: bool, ranges: int | None, piece_rows: int) -> DataFrame:
    ready = prepared(rows)
    if ranges is None:
        ranges = max(1, min(MOST_RANGES, -(-rows.count() // RANGE_ROWS)))
    first = scratch(_first_pass(ready, ranges, piece_rows, with_turns), "conversations")
    inside = first.where("whole").select("conv_id", F.lit(0).cast("long").alias("chunk"), F.lit(True).alias("last"), *REPORT_NAMES, "repaired")
    pieces = first.where("NOT whole").select("conv_id", "part", "piece", "turns", "roles", "texts", "faults")
    return inside.unionByName(_joined(pieces, with_turns))


def repair_report(rows: DataFrame, ranges: int | None = None, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """One row per conversation: faults found, what the cheapest edits cost, their initials, and the digest of the repaired turns.

    rows: conv_id, turn, role, text and, if rows that only name a conversation are among them, alive (true for real rows). A null role or text is a
    space; a null conv_id is a conversation of its own; null turns come first. Rows of equal turn come by a hash of role and text, so copies are
    adjacent. A role without initial fits nowhere and is given another role or deleted. Repeated rows are rows and count as duplicates after the
    first. Texts are read whole. A conversation without real rows has zeros, an empty audit and the digest of the empty string; an empty table gives
    no rows. Other columns are ignored, whatever their names.

    A conversation of any length is repaired; its audit is one value, and its digest is taken by one task that streams its pieces, as SHA-256
    goes through its input in order.
    """
    return _repair(rows, False, ranges, piece_rows).where("last").select("conv_id", *REPORT_NAMES)


def repaired_turns(rows: DataFrame, ranges: int | None = None, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """(conv_id, chunk, place, role, text): the repaired turns of each conversation, in order of chunk and place. Conversations that lose all rows
    have none. All else as in repair_report."""
    chunks = _repair(rows, True, ranges, piece_rows)
    return chunks.select("conv_id", "chunk", F.posexplode("repaired").alias("place", "turn")).select("conv_id", "chunk", "place", "turn.role", "turn.text")


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations with planted faults, by crc32(conv_id:turn) % 20: 0 drops the row (it stays as one that is not alive), 1 empties its text, 2 takes
    the sentence ends out, 3 repeats it, 4 makes the user its role. Nulls are one space."""
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    kind = F.crc32(key.cast("binary")) % 20
    marked = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("kind"))
    k = F.col("kind")
    spoilt = marked.select(
        "conv_id",
        "turn",
        F.when(k == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(k.isin(0, 1), "").when(k == 2, F.translate("text", ENDS, "")).otherwise(F.col("text")).alias("text"),
        (k != 0).alias("alive"),
        F.when(k == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))).alias("copies"),
    )
    return spoilt.withColumn("copy", F.explode("copies")).select("conv_id", "turn", "role", "text", "alive")
