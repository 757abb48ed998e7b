"""Best-fit packing of token sequences by bin completion.

Texts become ids; longer ones are cut into pieces, the first of which may be shorter. Only how many pieces of each length
there are matters for packing: at most as many numbers as a sequence has tokens, however large the corpus. On the driver
bin completion fills a sequence around the largest piece left with the fillings that no other one dominates, best first,
repeats it as often as pieces allow, and backtracks while a waste bound lets a better packing be hoped for. Best-fit
decreasing gives the first incumbent. The plan then tells each piece its place from its rank among those of its length.

A null or empty text is one piece, the end id. Equal rows are packed each for itself. Other columns are ignored, so their
names cannot clash. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptoria.llm.common import checkpoint, table

#: Unicode white space, as the tokenizer's pattern has it.
SPACE = "\t-\r \x85\xa0  -     　"
#: The tokenizer's pattern never joins what these chunks separate, so a chunk's ids do not depend on its neighbours.
CHUNK = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
PIECES = "doc_id {}, piece int, start long, length long, ids_crc32 long"


@dataclass(frozen=True)
class Packing:
    """capacity: tokens of a sequence. end: id after each text. nodes: fillings tried before the incumbent is taken.

    fillings: most fillings kept per node. tries: most pairs of pieces beside the largest for which a third is looked for.
    group: pieces of one length that one task ranks, about.
    """

    capacity: int = 1024
    end: int = 2
    nodes: int = 3_000
    fillings: int = 6
    tries: int = 500
    group: int = 50_000


class TokenIds:
    """Ids as little-endian bytes. Chunks of a text are looked up; new ones are encoded and kept, up to a bound.

    The BPE file and the rank file hold the same vocabulary; ranks are quicker for single chunks. A text with the special
    token's string, which is one id wherever it stands, goes to the tokenizer whole.
    """

    def __init__(self, tokenizer: str, ranks: str, pattern: str, bound: int = 400_000):
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(tokenizer)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        with open(ranks, "rb") as f:
            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding("chunks", pat_str=pattern, mergeable_ranks=merges, special_tokens={}).encode_ordinary
        self.bound, self.known = bound, {}

    def __call__(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        known, out = self.known, []
        for chunk in CHUNK.findall(text):
            ids = known.get(chunk)
            if ids is None:
                ids = np.array(self.encode(chunk), "<u4").tobytes()
                if len(chunk) <= 40:
                    if len(known) >= self.bound:
                        known.clear()
                    known[chunk] = ids
            out.append(ids)
        return b"".join(out)


def default_encoder() -> tuple[str, str, str]:
    import public_tokenizers as public

    return public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN


def cut(docs: DataFrame, encoder: tuple[str, str, str], packing: Packing = Packing(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of each document."""
    schema = PIECES.format(dict(docs.dtypes)[id_col])
    size, end = packing.capacity, np.array([packing.end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = TokenIds(*encoder)
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for k, text in enumerate(batch.column(1)):
                ids = ids_of(text.as_py() or "") + end
                n = len(ids) // 4
                at, to = 0, n % size or size
                while at < n:
                    row.append(k)
                    piece.append(-(-at // size))
                    start.append(at)
                    length.append(to - at)
                    crc.append(zlib.crc32(ids[4 * at : 4 * to]))
                    at, to = to, to + size
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def best_fit_decreasing(counts: list[int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Fillings and how often each is used: always the largest piece that still fits."""
    left, out = list(counts), []
    for largest in range(capacity, 0, -1):
        while left[largest]:
            filling, room = [largest], capacity - largest
            left[largest] -= 1
            x = min(room, capacity)
            while room and x:
                x = min(x, room)
                while x and not left[x]:
                    x -= 1
                if x:
                    filling.append(x)
                    left[x] -= 1
                    room -= x
            use = {x: filling.count(x) for x in filling}
            times = 1 + min(left[x] // k for x, k in use.items())
            for x, k in use.items():
                left[x] -= k * (times - 1)
            out.append((tuple(filling), times))
    return out


def least_bins(counts: list[int], capacity: int) -> int:
    """No packing has fewer: by total length, and by pieces of over half the capacity together with what cannot join them."""
    total = sum(x * n for x, n in enumerate(counts))
    best = -(-total // capacity)
    over = [0] * (capacity + 2)
    for x in range(capacity, 0, -1):
        over[x] = over[x + 1] + counts[x]
    half = capacity // 2
    weight = [0] * (half + 2)
    for x in range(half, 0, -1):
        weight[x] = weight[x + 1] + x * counts[x]
    large = sum(x * counts[x] for x in range(half + 1, capacity + 1))
    for low in range(1, half + 1):
        alone = over[capacity - low + 1]
        paired = over[half + 1] - alone
        room = paired * capacity - (large - sum(x * counts[x] for x in range(capacity - low + 1, capacity + 1)))
        best = max(best, alone + paired + max(0, -(-(weight[low] - room) // capacity)))
    return best


def fillings(left: list[int], largest: int, capacity: int, most: int, tries: int = Packing.tries) -> list[tuple[int, ...]]:
    """Undominated fillings of the room beside the largest piece, least waste first.

    A filling is dominated if another one replaces some of its pieces by one that is as long as they are together, or if
    one more piece fits. Up to three pieces are enumerated; a filling that leaves no waste with one piece dominates all.
    """
    room = capacity - largest
    have = lambda x, used: left[x] - used.count(x) > 0

    def longest(y: int, used: tuple[int, ...]) -> int:
        y = min(y, capacity)
        while y > 0 and not have(y, used):
            y -= 1
        return max(y, 0)

    base = (largest,)
    one = longest(room, base)
    if not one:
        return [base]
    if one == room:
        return [(largest, one)]
    found: dict[int, tuple[int, ...]] = {one: (largest, one)}
    a = one
    while a > 0:
        b = longest(min(a, room - a), (*base, a))
        if b and a + b > one:
            found.setdefault(a + b, (largest, a, b))
            if a + b == room:
                break
        if 2 * a < one:
            break
        a = longest(a - 1, base)
    if max(found) < room:
        a, tried = one, 0
        while a > 0 and 3 * a > max(found) and room not in found and tried < tries:
            b = longest(min(a, room - a), (*base, a))
            while b > 0 and a + 2 * b > max(found) and room not in found and tried < tries:
                tried += 1
                c = longest(min(b, room - a - b), (*base, a, b))
                if c and a + b + c > max(found):
                    found[a + b + c] = (largest, a, b, c)
                b = longest(b - 1, (*base, a))
            a = longest(a - 1, base)

    def filled_up(filling: tuple[int, ...]) -> tuple[int, ...]:
        while x := longest(capacity - sum(filling), filling):
            filling = (*filling, x)
        return filling

    out = list(dict.fromkeys(filled_up(found[s]) for s in sorted(found, reverse=True)[:most]))
    return sorted(out, key=lambda f: capacity - sum(f))


def plan(counts: list[int], packing: Packing = Packing()) -> list[tuple[tuple[int, ...], int]]:
    """Fillings and how often each is used, by depth-first bin completion with a bound on nodes.

    counts: number of pieces by length, up to the capacity.
    """
    capacity = packing.capacity
    incumbent = best_fit_decreasing(counts, capacity)
    bins = sum(n for _, n in incumbent)
    goal = least_bins(counts, capacity)
    total = sum(x * n for x, n in enumerate(counts))
    spare = lambda: (bins - 1) * capacity - total  # noqa: E731  waste that a better packing may have
    left, path, nodes = list(counts), [], 0
    stack: list[tuple[list, int]] = []

    def down(waste: int) -> None:
        largest = next((x for x in range(path[-1][0][0] if path else capacity, 0, -1) if left[x]), 0)
        stack.append((fillings(left, largest, capacity, packing.fillings, packing.tries)[::-1] if largest else [], waste))

    if bins > goal:
        down(0)
    while stack and nodes < packing.nodes and bins > goal:
        options, waste = stack[-1]
        if len(path) >= len(stack):  # back from below
            filling, times = path.pop()
            for x in filling:
                left[x] += times
        if not options:
            stack.pop()
            continue
        filling = options.pop()
        nodes += 1
        times = min(left[x] // filling.count(x) for x in set(filling))
        more = waste + times * (capacity - sum(filling))
        if more > spare():
            # Repeated less often it might still lead somewhere, but fillings come by rising waste: others waste more.
            times = min(times, (spare() - waste) // max(1, capacity - sum(filling)))
            if times < 1:
                options.clear()
                continue
            more = waste + times * (capacity - sum(filling))
        for x in filling:
            left[x] -= times
        path.append((filling, times))
        if any(left):
            down(more)
        else:
            incumbent, bins = list(path), sum(n for _, n in path)
            stack.append(([], more))
    return incumbent


def pack(docs: DataFrame, encoder: tuple[str, str, str] | None = None, packing: Packing = Packing(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of all documents with their sequence and place in it."""
    size = packing.capacity
    pieces = checkpoint(cut(docs, encoder or default_encoder(), packing, id_col, text_col))
    counts = [0] * (size + 1)
    for r in pieces.where(F.col("length") < size).groupBy("length").agg(F.count("*").alias("n")).collect():
        counts[r["length"]] = r["n"]
    chosen = plan(counts, packing)

    # For each length: ranks from `low` on belong to sequences from `first` on, at `offset`.
    places: dict[int, list[tuple[int, int, int]]] = {}
    used, first = [0] * (size + 1), 0
    for filling, times in chosen:
        at = 0
        for x in filling:
            places.setdefault(x, []).append((used[x], first, at))
            used[x] += times
            at += x
        first += times
    tables = {x: np.array(rows, np.int64).T for x, rows in places.items()}

    # Ranks within a length: a window per group of a length, and the groups' sizes summed up before it.
    sizes = ",".join(str(max(1, -(-n // packing.group))) for n in counts[1:])
    groups = F.element_at(F.split(F.lit(sizes), ",").cast("array<long>"), F.col("length").cast("int"))
    short = pieces.where(F.col("length") < size).withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), groups))
    sums = short.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = sums.select("length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece", "start", "ids_crc32"))
    ranked = short.withColumn("rank", rank.cast("long")).join(before, ["length", "part"])
    kind = dict(pieces.dtypes)["doc_id"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank_ = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for x in np.unique(length):
                low, start, at = tables[int(x)]
                rows = np.flatnonzero(length == x)
                k = np.searchsorted(low, rank_[rows], side="right") - 1
                sequence[rows] = start[k] + rank_[rows] - low[k]
                offset[rows] = at[k]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(5)), pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    placed = ranked.select(*columns, (F.col("rank") + F.col("before") - 1).alias("rank")).mapInArrow(place, PIECES.format(kind) + ", sequence_id long, offset long")
    alone = pieces.where(F.col("length") == size).select(*columns, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return placed.unionByName(alone).withColumnRenamed("doc_id", id_col)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
