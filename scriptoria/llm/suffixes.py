"""Exact removal of repeated 100-byte strings with a logarithmic family of sparse suffix arrays.

Only suffixes at anchors are indexed. A string's anchor is the leftmost of its 32-byte grams with the least hash, so equal
strings have equal anchors, and neighbouring strings mostly share one: about one suffix in 35 is indexed. A suffix stands
for the run of strings that share its anchor. Suffixes are in order of their bytes to a depth of 32, the least common
prefix that a match can have; those that agree so far are ordered by the hash of all bytes of their run, which begins
before the anchor and ends behind the gram.

Each task reads its documents in batches. A batch gets a suffix array, which is merged with each level of the task's index
to find where suffixes agree to that depth: of equal runs the earliest stays. Then the array becomes a level, and levels
of like size merge. The levels of all tasks meet in a shuffle, sorted by suffix, where neighbours are scanned as one
stream. Runs with a common gram that differ elsewhere may share some strings: their bytes are fetched, and the runs of a
gram are compared string by string in order of document. Where a gram has many runs they are dealt in parts to different
tasks; the earliest strings of each part are indexed in the same levelled way, by a hash of all 100 bytes. What is found are removed strings by document; bytes come last.

Equal runs have equal grams and a hash of 64 bits in common; strings have equal bytes or a hash of 128 bits in common.
Positions are bytes of UTF-8. A null text is empty. Rows that share an id are one document where their texts are equal,
each getting its result; with different texts they are ordered by start. Rows without an id come first, each text of them
a document of its own. Other columns are ignored, so their names cannot clash. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptoria.llm.common import table, written

#: A positional hash is a sum of bytes times powers of an odd number, which has an inverse modulo 2**64.
FACTOR = 0x9E3779B97F4A7C15 | 1



@dataclass(frozen=True)
class Repeats:
    """length: bytes of a string that may not repeat. gram: of an anchor. batch: bytes indexed at a time. held: suffixes that a task's index holds before it is passed on. group: runs of a gram that are compared in one part."""

    length: int = 100
    gram: int = 32
    batch: int = 1_000_000
    held: int = 2_000_000
    group: int = 500


class Powers:
    """Powers of FACTOR and of its inverse, as far as needed."""

    def __init__(self) -> None:
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            by_up = np.uint64(pow(FACTOR, len(self.up), 2**64))
            by_down = np.uint64(pow(FACTOR, -len(self.down), 2**64))
            self.up = np.concatenate([self.up, self.up * by_up])
            self.down = np.concatenate([self.down, self.down * by_down])
        return self.up, self.down


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def runs(data: np.ndarray, ends: np.ndarray, powers: Powers, rules: Repeats) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first, shape, suffix, run hash) of each run of strings with one anchor. ends: where each document's bytes end in data.

    A suffix is its gram's bytes, each greater by one: UTF-8 has no byte 255, and numpy's strings may not end in a zero.
    A run's shape is its number of strings, below 256, and 256 times the anchor's distance from its first byte.
    """
    n, L, K = len(data), rules.length, rules.gram
    empty = np.zeros(0, np.int64)
    if n < L:
        return empty, empty, np.zeros(0, f"S{K}"), empty.view(np.uint64)
    up, down = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    grams = _mix((total[K:] - total[:-K]) * down[: n - K + 1])
    low = (grams & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(grams), dtype=np.uint64)
    width, have = L - K + 1, 1
    while 2 * have <= width:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if width > have:
        low = np.minimum(low[: len(low) - (width - have)], low[width - have :])
    anchor = (low & np.uint64(0xFFFFFF)).astype(np.int64)
    inside = np.ones(len(anchor), bool)
    for e in ends[:-1]:
        inside[max(0, e - L + 1) : e] = False
    new = np.flatnonzero(np.diff(anchor, prepend=-1) != 0)
    # A run is broken where strings would cross the end of a document.
    broken = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0) == 1)
    first = np.union1d(new, broken)
    first = first[inside[first]]
    stop = np.append(first[1:], len(anchor))
    outside = np.flatnonzero(~inside)
    if len(outside):
        k = np.searchsorted(outside, first)
        stop = np.where(k < len(outside), np.minimum(stop, outside[np.minimum(k, len(outside) - 1)]), stop)
    count = stop - first
    last = first + count - 1 + L
    whole = _mix((total[last] - total[first]) * down[first] + count.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + (anchor[first] - first).astype(np.uint64))
    suffix = np.lib.stride_tricks.sliding_window_view(data, K)[anchor[first]] + np.uint8(1)
    return first, count + 256 * (anchor[first] - first), suffix.view(f"S{K}").ravel(), whole


Entries = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


class LevelledIndex:
    """Levels of entries (suffix, run, doc, at, n), sorted by suffix and run, the earliest doc and at of equal ones.

    add() takes a batch, returns the entries that lose to an earlier one, (doc, at, n), and keeps the others.
    """

    def __init__(self) -> None:
        self.levels: list[list[np.ndarray]] = []

    def __len__(self) -> int:
        return sum(len(x[0]) for x in self.levels)

    @staticmethod
    def _first(e: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Sorted, the first of equal runs apart from the rest. The same document and place twice is one entry."""
        order = np.lexsort((e[3], e[2], e[1], e[0]))
        e = [x[order] for x in e]
        same = np.zeros(len(order), bool)
        same[1:] = (e[0][1:] == e[0][:-1]) & (e[1][1:] == e[1][:-1])
        lead = np.maximum.accumulate(np.where(same, 0, np.arange(len(same))))
        again = same & (e[2] == e[2][lead]) & (e[3] == e[3][lead])
        return [x[~same] for x in e], [x[same & ~again] for x in e[2:]]

    @staticmethod
    def _places(level: list[np.ndarray], own: list[np.ndarray]) -> np.ndarray:
        """Where own entries stand in a level's order, before equal ones."""
        place = np.searchsorted(level[0], own[0])
        todo = np.flatnonzero(place < len(level[0]))
        todo = todo[level[0][place[todo]] == own[0][todo]]
        # Runs of one gram stand side by side, in order: a search by halves among them.
        low, high = place[todo], np.searchsorted(level[0], own[0][todo], side="right")
        while (low < high).any():
            half = np.minimum((low + high) // 2, len(level[0]) - 1)
            less = (low < high) & (level[1][half] < own[1][todo])
            high = np.where((low < high) & ~less, half, high)
            low = np.where(less, half + 1, low)
        place[todo] = low
        return place

    def add(self, batch: Entries) -> list[np.ndarray]:
        own, lost = self._first(list(batch))
        out = [lost]
        for level in self.levels:
            place = self._places(level, own)
            hit = np.flatnonzero(place < len(level[0]))
            hit = hit[(level[0][place[hit]] == own[0][hit]) & (level[1][place[hit]] == own[1][hit])]
            k = place[hit]
            later = (own[2][hit] > level[2][k]) | ((own[2][hit] == level[2][k]) & (own[3][hit] > level[3][k]))
            equal = (own[2][hit] == level[2][k]) & (own[3][hit] == level[3][k])
            out.append([x[hit[later]] for x in own[2:]])
            first, displaced = hit[~later & ~equal], k[~later & ~equal]
            out.append([x[displaced].copy() for x in level[2:]])
            for x, y in zip(level[2:], own[2:], strict=True):
                x[displaced] = y[first]
            keep = np.ones(len(own[0]), bool)
            keep[hit] = False
            own = [x[keep] for x in own]
        self.levels.append(own)
        while len(self.levels) > 1 and 2 * len(self.levels[-1][0]) >= len(self.levels[-2][0]):
            new, old = self.levels.pop(), self.levels.pop()
            place = self._places(old, new)
            self.levels.append([np.insert(x, place, y) for x, y in zip(old, new, strict=True)])
        return [np.concatenate(x) for x in zip(*out, strict=True)]

    def take(self) -> list[list[np.ndarray]]:
        out, self.levels = self.levels, []
        return out


SCANNED = "doc long, at long, n int, part int, open boolean"
ENTRY = "lost boolean, suffix binary, run long, doc long, at long, n int"


def _to_arrow(suffix: np.ndarray) -> pa.Array:
    ends = np.arange(len(suffix) + 1, dtype=np.int32) * np.int32(suffix.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(suffix), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(suffix).tobytes())])


def _from_arrow(column: pa.Array) -> np.ndarray:
    """Binary values of one length."""
    column = column.cast(pa.binary())
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(f"S{ends[1] - ends[0]}")


def _entries(lost: bool, suffix: np.ndarray, run: np.ndarray, doc: np.ndarray, at: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    cols = [pa.array(np.full(len(doc), lost)), _to_arrow(suffix), pa.array(run.astype(np.uint64).view(np.int64)), *(pa.array(x.astype(np.int64)) for x in (doc, at)), pa.array(n.astype(np.int32))]
    return pa.RecordBatch.from_arrays(cols, names=["lost", "suffix", "run", "doc", "at", "n"])


def _given_up(found: list[np.ndarray]) -> pa.RecordBatch:
    """Lost entries pass the shuffle by their document."""
    doc = found[0].astype(np.int64)
    return _entries(True, doc.view("S8"), doc.view(np.uint64), *found)


def _mark(data: bytes) -> int:
    return xxhash.xxh32_intdigest(data)


def _key(i: int | None, data: bytes) -> int:
    """A document's number: its id, or a number from the lowest quarter by its text."""
    return xxhash.xxh64_intdigest(data) // 4 - 2**63 if i is None else i


def index_texts(batches: Iterator[pa.RecordBatch], rules: Repeats) -> Iterator[pa.RecordBatch]:
    """(id, text) to entries: the tasks' levels and the runs that lost in them."""
    powers, index = Powers(), LevelledIndex()
    docs: list[int] = []
    texts: list[bytes] = []
    shifts: list[int] = []
    size = 0

    def build() -> Iterator[pa.RecordBatch]:
        ends = np.cumsum([len(t) for t in texts])
        first, count, suffix, run = runs(np.frombuffer(b"".join(texts), np.uint8), ends, powers, rules)
        owner = np.searchsorted(ends, first, side="right")
        start = first - (ends - [len(t) for t in texts])[owner] + np.array(shifts)[owner]
        mark = np.array(marks, np.int64)[owner]
        lost = index.add((suffix, run, np.array(docs, np.int64)[owner], start << 32 | mark, count))
        if len(lost[0]):
            yield _given_up(lost)
        if len(index) > rules.held:
            for level in index.take():
                yield _entries(False, *level)

    marks: list[int] = []
    for batch in batches:
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            data = (text.as_py() or "").encode()
            mark, key = _mark(data), _key(i, data)
            for shift in range(0, max(1, len(data) - rules.length + 1), 8 * rules.batch):
                piece = data[shift : shift + 8 * rules.batch + rules.length - 1]
                docs.append(key)
                texts.append(piece)
                shifts.append(shift)
                marks.append(mark)
                size += len(piece)
                if size >= rules.batch:
                    yield from build()
                    docs, texts, shifts, size = [], [], [], 0
                    marks.clear()
    if docs:
        yield from build()
    for level in index.take():
        yield _entries(False, *level)


def scan(batches: Iterator[pa.RecordBatch], group: int | None = None) -> Iterator[pa.RecordBatch]:
    """Sorted entries to (doc, at, n, part, open): lost runs, and, open, runs that share a gram with another one, in parts of group runs."""
    last = None  # the run that leads: its five values, and which run of its gram it is

    def out(doc, at, n, part=None) -> pa.RecordBatch:
        open_ = part is not None
        part = part if open_ else np.zeros(len(doc), np.int32)
        return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(at), pa.array(n, pa.int32()), pa.array(part, pa.int32()), pa.array(np.full(len(doc), open_))], names=["doc", "at", "n", "part", "open"])

    for batch in batches:
        lost = batch.column(0).to_numpy(zero_copy_only=False)
        if lost.any():
            yield out(*(batch.column(k).to_numpy()[lost] for k in (3, 4, 5)))
            batch = batch.filter(pa.array(~lost))
        if not batch.num_rows:
            continue
        e = [_from_arrow(batch.column(1)), *(batch.column(k).to_numpy() for k in range(2, 6))]
        if last is not None:
            e = [np.concatenate([np.array([y], x.dtype), x]) for x, y in zip(e, last[0], strict=True)]
        same = np.zeros(len(e[0]), bool)
        same[1:] = (e[0][1:] == e[0][:-1]) & (e[1][1:] == e[1][:-1])
        lead = np.maximum.accumulate(np.where(same, 0, np.arange(len(same))))
        gone = same & ~((e[2] == e[2][lead]) & (e[3] == e[3][lead]))
        yield out(*(x[gone] for x in e[2:]))
        heads = np.flatnonzero(~same)
        new = np.ones(len(heads), bool)
        new[1:] = e[0][heads][1:] != e[0][heads][:-1]
        if last is not None:
            new[0] = last[1] == 0
        here = np.arange(len(heads))
        rank = here - np.maximum.accumulate(np.where(new, here, 0))
        if not new[0]:
            rank[: np.argmax(new) if new.any() else len(new)] += last[1]
        if group is not None:
            shared = ~new
            shared[:-1] |= new[:-1] & ~new[1:]
            if last is not None:  # the carried one, if not the first of its gram, has been told before
                shared[0] &= new[0]
            k = heads[shared]
            yield out(*(x[k] for x in e[2:]), rank[shared] // group)
        last = ([x[heads[-1]] for x in e], int(rank[-1]))


def contexts(batches: Iterator[pa.RecordBatch], rules: Repeats) -> Iterator[pa.RecordBatch]:
    """(doc, packed text, open runs) to (gram, part, doc, at, n, bytes): each open run with all bytes of its strings."""
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        rows: list[list] = [[], [], [], [], [], []]
        for doc, packed, places in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
            data = unpack.decompress(packed.as_py())
            mark = _mark(data)
            for place in places:
                if place["at"] & 0xFFFFFFFF == mark:
                    first, count, far = place["at"] >> 32, place["n"] & 255, place["n"] >> 8
                    run = data[first : first + count + rules.length - 1]
                    for held, x in zip(rows, (run[far : far + rules.gram], place["part"], doc, place["at"], place["n"], run), strict=True):
                        held.append(x)
        kinds = (pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows, kinds, strict=True)], names=["gram", "part", "doc", "at", "n", "bytes"])


def compare(batches: Iterator[pa.RecordBatch], rules: Repeats) -> Iterator[pa.RecordBatch]:
    """Open runs by gram, part, document and place, to entries: lost strings, and, of grams with many runs, the earliest strings of each part, to be scanned."""
    L, digest, index = rules.length, xxhash.xxh3_128_hexdigest, LevelledIndex()
    lost: list[tuple[int, int, int]] = []
    many: list[tuple[str, int, int]] = []
    held: list[tuple[int, int, int, bytes]] = []
    now, over = None, False

    def resolve() -> None:
        """Strings at the same distance from the anchor are equal if their bytes are. The earliest may have equals in other parts."""
        seen: dict[tuple[int, bytes], tuple[int, int]] = {}
        for doc, at, shape, data in held:
            n, far = shape & 255, shape >> 8
            since = None
            for j in range(n + 1):
                again = False
                if j < n:
                    place = (doc, at + (j << 32))
                    again = seen.setdefault((far - j, data[j : j + L]), place) != place
                if again and since is None:
                    since = j
                elif not again and since is not None:
                    lost.append((doc, at + (since << 32), j - since))
                    since = None
        if over:
            many.extend((digest(data), *place) for (_, data), place in seen.items())
        held.clear()

    def out() -> Iterator[pa.RecordBatch]:
        if many:
            key = np.array([x[0] for x in many], "S32")
            doc, at = (np.array([x[k] for x in many], np.int64) for k in (1, 2))
            gone = index.add((key, np.zeros(len(doc), np.uint64), doc, at, np.ones(len(doc), np.int64)))
            if len(gone[0]):
                yield _given_up(gone)
            many.clear()
        if lost:
            yield _given_up([np.array(x, np.int64) for x in zip(*lost, strict=True)])
            lost.clear()
        if len(index) > rules.held:
            for level in index.take():
                yield _entries(False, *level)

    for batch in batches:
        for gram, part, *run in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
            if (gram, part) != now:
                resolve()
                now, over = (gram, part), part > 0
            held.append(tuple(run))
            if len(held) >= rules.group:  # a full part: there may be others
                over = True
                resolve()
        yield from out()
    resolve()
    yield from out()
    for level in index.take():
        yield _entries(False, *level)


def union_of(places: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """Bytes covered by runs (start, n) of strings, as maximal intervals."""
    out: list[list[int]] = []
    for start, n in sorted(places):
        end = start + n + length - 1
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Repeats = Repeats(), keep_text: bool = False) -> DataFrame:
    """Per row: the id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept: the remaining bytes."""
    kind = dict(docs.dtypes)[id_col]
    given = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    arrays = given.mapInArrow(lambda b: index_texts(b, rules), ENTRY)
    found = _sorted(arrays).mapInArrow(lambda b: scan(b, rules.group), SCANNED)
    found = written(found)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            key, mark, packed = [], [], []
            for i, text in zip(batch.column(0).cast(pa.int64()).to_pylist(), batch.column(1), strict=True):
                data = (text.as_py() or "").encode()
                for held, x in zip((key, mark, packed), (_key(i, data), _mark(data), tool.compress(data)), strict=True):
                    held.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(mark, pa.int64()), batch.column(0), pa.array(packed, pa.binary())], names=["key", "mark", "id", "packed"])

    packed = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(pack, f"key long, mark long, id {kind}, packed binary")
    # By id and text, so that rows which share an id do not share a key; no more places than a document has bytes.
    of_text = F.col("at").bitwiseAND(0xFFFFFFFF).alias("of")
    by_doc = lambda x, *c: x.groupBy("doc", of_text).agg(F.collect_list(F.struct("at", "n", *c)).alias("places"))
    own = (F.col("key") == F.col("doc")) & (F.col("mark") == F.col("of"))
    opened = packed.join(by_doc(found.where("open"), "part"), own).select("doc", "packed", "places")
    near = opened.mapInArrow(lambda b: contexts(b, rules), "gram binary, part int, doc long, at long, n int, bytes binary")
    strings = near.repartition("gram", "part").sortWithinPartitions("gram", "part", "doc", "at").mapInArrow(lambda b: compare(b, rules), ENTRY)
    strings = written(strings)
    single = _sorted(strings.where("not lost")).mapInArrow(scan, SCANNED)
    gone = found.where("not open").select("doc", "at", "n").union(strings.where("lost").select("doc", "at", "n")).union(single.select("doc", "at", "n"))
    gone = by_doc(gone)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            for data, places in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                data = unpack.decompress(data.as_py())
                spans = []
                if places:
                    mark = _mark(data)
                    spans = union_of([(x["at"] >> 32, x["n"] & 255) for x in places if x["at"] & 0xFFFFFFFF == mark], rules.length)
                edges = [0, *(x for s in spans for x in s), len(data)]
                kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                for held, x in zip(rows, (len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept if keep_text else None), strict=True):
                    held.append(x)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, k) for x, k in zip(rows, kinds, strict=True))], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    out = packed.join(gone, own, "left").select("id", "packed", "places")
    out = out.mapInArrow(finish, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return (out if keep_text else out.drop("kept")).withColumnRenamed("id", id_col)


def _sorted(entries: DataFrame) -> DataFrame:
    return entries.repartition("suffix").sortWithinPartitions("suffix", "run", "doc", "at")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
