"""Removal of passages that an earlier document holds, by automata of confirmed passages.

1. Every whole text is cut into windows of WINDOW words; each window is stood for by its least hash of ANCHOR words, so that
   equal windows have equal anchors. Anchors of two documents or more mark where passages may recur.
2. Windows of recurring anchors are grouped by hash, in segments where all documents agree, else one by one. A window found in two
   documents is a recurring window; its least document is its home.
3. The recurring windows of a home are its passages, cut into chunks of CHUNK windows that overlap by a window less a word, so each window lies whole
   in one chunk. A group of documents gets the chunks in which some of its documents' windows lie.
4. Each group compiles its chunks' pieces of PIECE words into one Aho-Corasick automaton over word numbers (any window of a chunk holds a whole
   piece) and streams its documents through it. A hit is extended to both sides word by word, so what is removed is confirmed on the words themselves.

Groups are the shards of the automata: what one holds is bounded by what DOCS_PER_GROUP documents hold. A chunk goes to a group once however many of
its documents hold it, as a row of its own, and no row or task gathers the groups of a chunk or of a home.

All documents are streamed in step 1; steps 2 to 4 need only those that share an anchor with another document. No other document can lose a word: a
window that recurs has equal words in both documents, hence equal hashes of ANCHOR words, hence an equal least one, so both hold its anchor.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltworks.llm.wordhash import Words, blocks, encoded, mix, slices, spans, windows
from siltworks.session import drop_scratch_since, scratch, scratch_paths, ship_package

WINDOW = 50
ANCHOR = 16
#: Any run of WINDOW words holds a whole piece, as pieces start every WINDOW - PIECE + 1 words.
PIECE = 25
#: Windows of one chunk of a passage.
CHUNK = 128
#: Documents of one group, which shares one automaton: what an automaton holds is bounded by what so few documents hold.
DOCS_PER_GROUP = 500
#: Tasks of the last step at most; beyond that a task goes through several groups in turn, one automaton after the other.
MOST_TASKS = 20_000
#: What names a segment.
SEGMENT = ["anchor", "segment", "n"]
_SALT = np.uint64(0x5851F42D4C957F2D)


def _span_min(values: np.ndarray, span: int) -> np.ndarray:
    """Least value of each run of span values, by doubling."""
    out, width = values, 1
    while width < span:
        step = min(width, span - width)
        out = np.minimum(out[: len(out) - step], out[step:])
        width += step
    return out


def anchors_of(hashes: np.ndarray, width: int = WINDOW) -> np.ndarray:
    """The anchor of each window of a block of words."""
    if len(hashes) < width:
        return np.empty(0, np.uint64)
    return _span_min(windows(hashes, ANCHOR), width - ANCHOR + 1)


def _texts(column: pa.Array) -> list[bytes]:
    return encoded(column.to_pylist())


def survey(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, kept_sha256 of all words, distinct anchors) per row."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            counts, digests, marks = [], [], []
            for _, block in blocks(_texts(batch.column("text"))):
                words = Words(block)
                found = anchors_of(words.hashes, width)
                bounds = words.bounds.tolist()
                for text, a, b in zip(block, bounds[:-1], bounds[1:], strict=True):
                    counts.append(b - a)
                    digests.append(hashlib.sha256(b" ".join(text.split())).hexdigest())
                    marks.append(np.unique(found[a : b - width + 1]).view(np.int64) if b - a >= width else [])
            arrays = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(marks, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_words", "kept_sha256", "anchors"])

    ship_package(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(scan, "doc_id long, n_words long, kept_sha256 string, anchors array<long>")


def group_of(doc_id: Column, groups: int) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(groups)).cast("int")


def segments(texts: DataFrame, groups: int, width: int = WINDOW) -> DataFrame:
    """From (doc_id, text, anchors that recur): segments of each group of documents (anchor, segment, n, group, home, windows, latest).

    A segment is a run of windows with one anchor. Documents that share a passage share the segments inside it, so most windows need no row
    of their own. windows holds 12 bytes of hash for each window of the segment; home is its least document and where it starts there."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, marks = batch.column("doc_id").to_pylist(), batch.column("anchors").to_pylist()
            for first, block in blocks(_texts(batch.column("text"))):
                words = Words(block)
                found = anchors_of(words.hashes, width)
                whole, other = windows(words.hashes, width), windows(mix(words.hashes ^ _SALT), width)
                packed = np.empty((len(whole), 3), np.uint32)
                packed[:, 0], packed[:, 1], packed[:, 2] = whole & np.uint64(0xFFFFFFFF), whole >> np.uint64(32), other >> np.uint64(32)
                out: list[tuple] = []
                bounds = words.bounds.tolist()
                for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
                    if b - a < width:
                        continue
                    own = found[a : b - width + 1]
                    hit = np.isin(own, np.array(marks[first + i], np.int64).view(np.uint64))
                    edge = np.flatnonzero(np.concatenate(([True], (own[1:] != own[:-1]), [True])))
                    starts, ends = edge[:-1], edge[1:]
                    keep = hit[starts]
                    starts, ends = starts[keep], ends[keep]
                    keys = spans(words.hashes, a + starts, a + ends + width - 1).view(np.int64)
                    for s, e, key in zip(starts.tolist(), ends.tolist(), keys.tolist(), strict=True):
                        out.append((int(own[s].view(np.int64)), key, ids[first + i], s, e - s, packed[a + s : a + e].tobytes()))
                columns = zip(*out, strict=True) if out else [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds.values(), strict=True)], list(kinds))

    kinds = {"anchor": pa.int64(), "segment": pa.int64(), "doc_id": pa.int64(), "place": pa.int32(), "n": pa.int32(), "windows": pa.binary()}
    rows = texts.select("doc_id", "text", "anchors").mapInArrow(cut, "anchor long, segment long, doc_id long, place int, n int, windows binary")
    grouped = rows.withColumn("group", group_of(F.col("doc_id"), groups)).groupBy(*SEGMENT, "group")
    return grouped.agg(F.min(F.struct("doc_id", "place")).alias("home"), F.first("windows").alias("windows"), F.max("doc_id").alias("latest"))


def recurring_spans(by_group: DataFrame) -> DataFrame:
    """(anchor, segment, n, home, first, last): where windows of a segment start that two documents or more hold, in the least of those documents.

    Where an anchor has one segment only, that segment's documents are all that hold its windows. Where it has several, their windows are
    compared one by one."""
    found = scratch(by_group.groupBy(*SEGMENT).agg(F.min("home").alias("home"), F.first("windows").alias("windows"), F.max("latest").alias("latest")), "distinct")
    several = found.groupBy("anchor").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("anchor")
    alone = found.join(several, "anchor", "left_anti").where("home.doc_id < latest")
    alone = alone.select(*SEGMENT, F.col("home.doc_id").alias("home"), F.col("home.place").alias("first"), (F.col("home.place") + F.col("n") - 1).alias("last"))
    one = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.struct(i.alias("i"), F.substring("windows", i * 12 + 1, F.lit(12)).alias("h")))
    flat = found.join(several, "anchor").select(*SEGMENT, "home", "latest", F.explode(one).alias("w")).select(*SEGMENT, "home", "latest", "w.i", "w.h")
    least = F.min(F.struct(F.col("home.doc_id").alias("doc_id"), (F.col("home.place") + F.col("i")).alias("place")))
    held = flat.groupBy("h").agg(least.alias("at"), F.max("latest").alias("latest")).where("at.doc_id < latest").select("h", "at")
    met = flat.select(*SEGMENT, "i", "h").join(held, "h").select(*SEGMENT, F.col("at.doc_id").alias("home"), F.col("at.place").alias("place"), "i")
    runs = met.groupBy(*SEGMENT, "home", (F.col("place") - F.col("i")).alias("line")).agg(F.min("place").alias("first"), F.max("place").alias("last"))
    return alone.unionByName(runs.drop("line"))


def passages(by_group: DataFrame, texts: DataFrame, width: int = WINDOW) -> DataFrame:
    """(group, home, passage): the chunks of home documents in which windows of the group's documents lie."""
    spans_of = recurring_spans(by_group)
    chunks = F.explode(F.sequence(F.expr(f"first DIV {CHUNK}"), F.expr(f"last DIV {CHUNK}")))
    cut_up = spans_of.withColumn("chunk", chunks).select(
        *SEGMENT, "home", "chunk", F.greatest("first", F.col("chunk") * CHUNK).alias("first"), F.least("last", F.col("chunk") * CHUNK + CHUNK - 1).alias("last")
    )
    cut_up = scratch(cut_up, "spans")
    places = cut_up.groupBy("home", "chunk").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    # One row per home: its chunks are fewer than its words.
    per_home = places.groupBy("home").agg(F.collect_list(F.struct("chunk", "first", "last")).alias("wanted"))
    joined = per_home.join(texts.select(F.col("doc_id").alias("home"), "text"), "home")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            homes, numbers, found = [], [], []
            for home, text, wanted in zip(batch.column("home").to_pylist(), _texts(batch.column("text")), batch.column("wanted").to_pylist(), strict=True):
                words = text.split()
                for want in wanted:
                    if want["last"] + width <= len(words):
                        homes.append(home)
                        numbers.append(want["chunk"])
                        found.append(b" ".join(words[want["first"] : want["last"] + width]).decode("utf-8", "surrogatepass"))
                if len(found) > 2000:
                    yield _chunk_batch(homes, numbers, found)
                    homes, numbers, found = [], [], []
            yield _chunk_batch(homes, numbers, found)

    kind = dict(cut_up.dtypes)["chunk"]
    texts_of = joined.select("home", "text", "wanted").mapInArrow(cut, "home long, chunk long, passage string").withColumn("chunk", F.col("chunk").cast(kind))
    asked = by_group.select(*SEGMENT, "group").join(cut_up.select(*SEGMENT, "home", "chunk"), SEGMENT).select("group", "home", "chunk").distinct()
    return asked.join(texts_of, ["home", "chunk"]).select("group", "home", "passage")


def _chunk_batch(homes: list, numbers: list, found: list) -> pa.RecordBatch:
    arrays = [pa.array(homes, pa.int64()), pa.array(numbers, pa.int64()), pa.array(found, pa.string())]
    return pa.RecordBatch.from_arrays(arrays, ["home", "chunk", "passage"])


class PassageAutomaton:
    """Finds the parts of a text that are WINDOW words or more of one of its passages."""

    def __init__(self, width: int = WINDOW):
        import ahocorasick

        self.width = width
        self.numbers: dict[bytes, int] = {}
        self.passages: list[tuple[int, array]] = []
        self.pieces: dict[tuple[int, ...], list[tuple[int, int]]] = {}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)

    def add(self, home: int, passage: bytes) -> None:
        numbers = self.numbers
        words = array("I", [numbers.setdefault(w, len(numbers) + 1) for w in passage.split()])
        number = len(self.passages)
        self.passages.append((home, words))
        for at in range(0, len(words) - PIECE + 1, self.width - PIECE + 1):
            self.pieces.setdefault(tuple(words[at : at + PIECE]), []).append((number, at))

    def compile(self) -> None:
        for piece, at in self.pieces.items():
            self.automaton.add_word(piece, at)
        if self.pieces:
            self.automaton.make_automaton()
        self.pieces = dict.fromkeys(list(self.pieces)[:1])  # the automaton holds them now

    def covered(self, doc_id: int, words: list[bytes]) -> np.ndarray:
        """Which words lie in a window of an earlier home's passage."""
        cover = np.zeros(len(words) + 1, np.int64)
        if not self.pieces or len(words) < self.width:
            return np.zeros(len(words), bool)
        get = self.numbers.get
        text = tuple([get(w, 0) for w in words])
        done: dict[tuple[int, int], int] = {}
        for end, places in self.automaton.iter(text):
            first = end - PIECE + 1
            for number, at in places:
                home, passage = self.passages[number]
                line = first - at
                if home >= doc_id or done.get((number, line), -1) >= end:
                    continue
                low, high = first, end + 1
                while low > 0 and low > line and text[low - 1] == passage[low - 1 - line]:
                    low -= 1
                top = min(len(text), line + len(passage))
                while high < top and text[high] == passage[high - line]:
                    high += 1
                done[number, line] = high - 1
                if high - low >= self.width:
                    cover[low] += 1
                    cover[high] -= 1
        return np.cumsum(cover[:-1]) > 0


def _streamed(docs: DataFrame, found: DataFrame, groups: int, width: int, emit, schema: str, columns: list[str]) -> DataFrame:
    """Deal passages and documents out by group and stream the documents through the group's automaton. emit(row, words, covered) makes a
    row of the result; columns are those of docs that it needs besides doc_id and text."""
    shape = [F.col("group"), F.lit(0).alias("kind"), F.col("home").alias("doc_id"), F.col("passage").alias("text")]
    shape += [F.lit(None).cast(docs.schema[c].dataType).alias(c) for c in columns]
    mine = docs.select(group_of(F.col("doc_id"), groups).alias("group"), F.lit(1).alias("kind"), "doc_id", "text", *columns)
    both = found.select(*shape).unionByName(mine).repartition(min(groups, MOST_TASKS), "group").sortWithinPartitions("group", "kind")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, automaton, ready = None, PassageAutomaton(width), False
        for batch in slices(batches):
            names, out = batch.schema.names, []
            for values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                row = dict(zip(names, values, strict=True))
                if row["group"] != group:
                    group, automaton, ready = row["group"], PassageAutomaton(width), False
                text = encoded([row["text"]])[0]
                if row["kind"] == 0:
                    automaton.add(row["doc_id"], text)
                    continue
                if not ready:
                    automaton.compile()
                    ready = True
                words = text.split()
                if made := emit(row, text, words, automaton.covered(row["doc_id"], words)):
                    out.append(made)
            yield pa.RecordBatch.from_pylist(out, arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))
    ship_package(docs.sparkSession)
    return both.mapInArrow(stream, schema)


def suspects_of(surveyed: DataFrame) -> DataFrame:
    """(doc_id, anchors): documents that share an anchor with another one, and which."""
    marks = surveyed.where("doc_id IS NOT NULL").select("doc_id", F.explode("anchors").alias("anchor"))
    twice = marks.groupBy("anchor").agg(F.min("doc_id").alias("x"), F.max("doc_id").alias("y")).where("x < y").select("anchor")
    return marks.join(twice, "anchor").groupBy("doc_id").agg(F.collect_set("anchor").alias("anchors"))


def located_passages(texts: DataFrame, groups: int, width: int = WINDOW) -> DataFrame:
    """Passages by group from (doc_id, text, anchors)."""
    before = scratch_paths()
    found = scratch(passages(scratch(segments(texts, groups, width), "segments"), texts, width), "passages")
    drop_scratch_since(before, found)
    return found


def groups_for(n_docs: int) -> int:
    return max(1, -(-n_docs // DOCS_PER_GROUP))


_RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def repeated_passages(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) per row of docs.

    A word goes if a window of width words over it also starts in a document of smaller doc_id; windows are judged on the input. Null and empty
    texts have no words. Rows with a null doc_id lose nothing and are no evidence. Rows of equal doc_id, repeated rows among them, are no evidence
    against each other and are judged each by itself. Texts are taken whole, however long; an empty table gives no rows. Other columns of
    docs are ignored, whatever their names.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    surveyed = scratch(survey(rows, width), "survey")
    suspects = scratch(suspects_of(surveyed), "suspects")
    texts = scratch(rows.join(suspects, "doc_id"), "texts")
    groups = groups_for(surveyed.count())
    found = located_passages(texts, groups, width)
    plain = surveyed.join(suspects.select("doc_id"), "doc_id", "left_anti")
    plain = plain.select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256")

    def emit(row: dict, text: bytes, words: list[bytes], covered: np.ndarray) -> dict:
        kept = [w for w, gone in zip(words, covered.tolist(), strict=True) if not gone]
        digest = hashlib.sha256(b" ".join(kept)).hexdigest()
        return {"doc_id": row["doc_id"], "n_words": len(words), "n_removed": len(words) - len(kept), "kept_sha256": digest}

    return plain.unionByName(_streamed(texts, found, groups, width, emit, _RESULT, []))


def without_words(text: bytes, words: list[bytes], covered: np.ndarray) -> str:
    """text without the covered words and the white space before each; what is left starts and ends as words do."""
    out, at, gone = [], 0, False
    for word, drop in zip(words, covered.tolist(), strict=True):
        start = text.index(word, at)
        if not drop:
            out.append(text[at:start] + word)
        at = start + len(word)
        gone = gone or drop
    out.append(text[at:])
    whole = b"".join(out)
    return (whole.strip(b" \t\n\r\x0b\x0c") if gone else whole).decode("utf-8", "surrogatepass")


def cut_documents(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """docs with repeated passages cut out of text and n_chars counted anew. A document all of whose words go is dropped; one that loses nothing
    is unchanged. Other columns are carried, whatever their names; repeated_passages() states the other cases."""
    names = docs.columns
    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *[F.col(n).alias(f"d_{n}") for n in names if n != "text"])
    surveyed = scratch(survey(held, width), "survey")
    groups = groups_for(surveyed.count())
    marked = scratch(held.join(suspects_of(surveyed), "doc_id", "left"), "texts")
    plain, texts = marked.where("anchors IS NULL"), marked.where("anchors IS NOT NULL")
    found = located_passages(texts, groups, width)
    columns = [f"d_{n}" for n in names if n != "text"]

    def emit(row: dict, text: bytes, words: list[bytes], covered: np.ndarray) -> dict | None:
        if not covered.any():
            return {c: row[c] for c in ("text", *columns)}
        if covered.all():
            return None
        return {c: row[c] for c in columns} | {"text": without_words(text, words, covered)}

    kinds = dict(held.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in ("text", *columns))
    cut = _streamed(texts, found, groups, width, emit, schema, columns)
    rows = plain.select("text", *columns).unionByName(cut)
    made = {"text": F.col("text"), "n_chars": F.when(F.col("text").isNull(), F.col("d_n_chars")).otherwise(F.length("text").cast("long"))} if "n_chars" in names else {"text": F.col("text")}
    return rows.select(*[made[n].alias(n) if n in made else F.col(f"d_{n}").alias(n) for n in names])
