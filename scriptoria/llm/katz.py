"""Language-model scores: a Katz trigram model with Good-Turing discounts and exactly normalised backoff weights.

Texts are packed in chunks of documents; within a chunk equal n-grams count once, whatever texts they come from. Chunks
are made anew whenever they are needed, since texts are quicker read than stored: the input must read the same each time,
which a mark of each chunk's words proves, or the query fails. Each
level of the model is a partitioned table that chunks ask and that answers by chunk. The table of words, by hash, gives
training counts as word ids: ids are dealt by falling count, so a short list of counts tells each id's count. The table
of trigrams is dealt by the middle word, where all it needs meets: counts of trigrams, of the bigrams they end in, and of
both contexts. A middle word with more tokens than a slot should hold is spread by the trigram's last word; what its
slots know of a context is then added up in a third table, dealt by whole contexts, which the chunks ask as well. What
all must know (discounts, weights of spread middle words) is as short as the list of counts or of spread words.

A trigram seen r times in training has probability d(r) * r / c(its context). An unseen one has its context's weight times
the bigram's probability, and that, if unseen too, the weight of the one-word context times the word's own, discounted
again, with what Good-Turing leaves for all unknown words together. The weights make each context's probabilities add up
to 1. After a context that training texts do not have the weight is 1.

A null text is empty: one token, the end, which is also the context of a text's first word and, twice, of the whole text.
Equal rows are separate texts. A null id counts as training. Other columns are ignored, so their names cannot clash. An
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptoria.llm.common import checkpoint, crc32_of, table


@dataclass(frozen=True)
class KatzRules:
    """discounted: counts up to this are discounted. slot_bytes: of text for each slot of the tables, about. partitions: of a
    shuffle, at most; beyond that a partition has several slots, one after the other. spread: tokens of a middle word above
    which it is spread over more slots. chunk_docs, chunk_bytes: documents and bytes of a chunk, about."""

    discounted: int = 5
    slot_bytes: int = 6_000_000
    partitions: int = 10_000
    spread: int = 500_000
    chunk_docs: int = 50_000
    chunk_bytes: int = 6_000_000


def pack(x: np.ndarray) -> bytes:
    """Numbers as compressed planes of their bytes, as many as the largest needs."""
    x = np.ascontiguousarray(x).astype("<f8").view("<u8") if x.dtype.kind == "f" else x.astype("<u8")
    planes = (int(x.max(initial=0)).bit_length() + 7) // 8
    if planes == 2 or planes == 3:  # most are small: bytes, and what does not fit into one apart
        large = x >= 255
        small = zstandard.ZstdCompressor(level=3).compress(np.minimum(x, 255).astype(np.uint8).tobytes())
        return bytes([255]) + len(x).to_bytes(4, "little") + len(small).to_bytes(4, "little") + small + _planes(x[large] - 255)
    return _planes(x)


def _planes(x: np.ndarray) -> bytes:
    planes = (int(x.max(initial=0)).bit_length() + 7) // 8
    body = np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :planes].T).tobytes()
    return bytes([planes]) + len(x).to_bytes(4, "little") + (zstandard.ZstdCompressor(level=3).compress(body) if planes else b"")


def unpack(data: bytes, kind: str = "<i8") -> np.ndarray:
    planes, n = data[0], int.from_bytes(data[1:5], "little")
    if planes == 255:
        to = 9 + int.from_bytes(data[5:9], "little")
        all_ = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[9:to]), np.uint8).astype(np.int64)
        all_[all_ == 255] += unpack(data[to:])
        return all_.view(kind)
    out = np.zeros((n, 8), np.uint8)
    if planes:
        out[:, :planes] = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[5:]), np.uint8).reshape(planes, n).T
    return out.view(kind).ravel()


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, starts) if len(starts) else np.zeros(0, values.dtype)


def _new(*keys: np.ndarray) -> np.ndarray:
    """Whether a row of sorted keys differs from the one before."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return new


def _by(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """The order of pairs of numbers from 0 on; equal ones stand in any order. One number is sorted faster than two, where both fit into it."""
    bits = int(two.max(initial=0)).bit_length()
    if int(one.max(initial=0)).bit_length() + bits < 64:
        return np.argsort((one << bits) | two)
    return np.lexsort((two, one))


def _runs(*keys: np.ndarray) -> list[tuple[int, int]]:
    """Where rows of equal keys begin and end."""
    cuts = [*np.flatnonzero(_new(*keys)).tolist(), len(keys[0])]
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def discounts(n: np.ndarray, k: int) -> np.ndarray:
    """Katz's d(r) for r = 0 to k + 1 from counts of counts n(0) to n(k + 1); d(k + 1) = 1 stands for all larger counts.

    Where counts of counts are too irregular for a ratio between 0 and 1, half an occurrence is taken off.
    """
    d = np.ones(k + 2)
    top = (k + 1) * n[k + 1] / n[1] if n[1] else 1.0
    for r in range(1, k + 1):
        x = ((r + 1) * n[r + 1] / (r * n[r]) - top) / (1 - top) if n[r] and top < 1 else 0.0
        d[r] = x if 0 < x < 1 else 1 - 0.5 / r
    return d


class Words:
    """What ids tell: counts, slots of the trigram table, and the probabilities of single words.

    Of each count the ids begin at first; there are no more counts than the root of twice the tokens. Id 0 stands for all
    words that training texts do not have.
    """

    def __init__(self, sizes: list[tuple[int, int]], slots: int, rules: KatzRules):
        """sizes: (count, words that have it)."""
        sizes = sorted(sizes, reverse=True)
        self.slots, self.spread, k = slots, rules.spread, rules.discounted
        self.count = np.array([c for c, _ in sizes] + [0], np.int64)
        self.first = np.cumsum([1, *(n for _, n in sizes)])
        self.tokens, self.types = sum(c * n for c, n in sizes), sum(n for _, n in sizes)
        low = np.zeros(k + 2)
        for c, n in sizes:
            if c < k + 2:
                low[c] = n
        self.d = discounts(low, k)
        left = sum(low[r] * r * (1 - self.d[r]) for r in range(1, k + 1)) / max(self.tokens, 1)
        if left <= 0:  # no rare words: one more token, unknown
            left = 1 / (self.tokens + 1)
            self.d = self.d * (1 - left)
        self.unknown = left

    def counts(self, ids: np.ndarray) -> np.ndarray:
        return np.where(ids > 0, self.count[np.searchsorted(self.first, ids, side="right") - 1], 0)

    def p(self, ids: np.ndarray) -> np.ndarray:
        c = self.counts(ids)
        return np.where(c > 0, self.d[np.minimum(c, len(self.d) - 1)] * c / max(self.tokens, 1), self.unknown)

    def pieces(self, ids: np.ndarray) -> np.ndarray:
        """Over how many slots a middle word is spread."""
        return 1 + self.counts(ids) // self.spread

    def slot(self, *ids: np.ndarray) -> np.ndarray:
        h = np.full(len(ids[0]), 0x9E3779B97F4A7C15, np.uint64)
        for x in ids:
            h = (h ^ x.astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(32)
        return (h % np.uint64(self.slots)).astype(np.int64)


def _bounds(slots: int) -> np.ndarray:
    """Word hashes are dealt to slots by these."""
    return np.arange(1, slots, dtype=np.uint64) * np.uint64(2**64 // slots)


def _words(text: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All words of some texts, how many each has, and their bytes with a blank each. Arrow's ASCII functions change A-Z only and split at exactly the contract's white space."""
    words = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(text, "")))
    of, flat = pc.list_parent_indices(words).to_numpy(), words.flatten()
    size = pc.binary_length(flat).to_numpy()
    some = size > 0  # white space at either end leaves an empty one
    of = of[some]
    return flat.filter(pa.array(some)), np.bincount(of, minlength=len(text)), np.bincount(of, size[some] + 1.0, len(text)).astype(np.int64)


def _chunks(batches: Iterator[pa.RecordBatch], rules: KatzRules):
    """(ids, train, lengths, codes, words): codes are numbers into words, 0 is the end, which closes each document."""
    parts, n, size = [], 0, 0

    def made():
        ids, train, counts, flat = zip(*parts, strict=True)
        flat, lengths = pa.concat_arrays(flat).dictionary_encode(), np.concatenate(counts) + 1
        codes = np.zeros(lengths.sum(), np.int64)
        word = np.ones(len(codes), bool)
        word[np.cumsum(lengths) - 1] = False
        codes[word] = flat.indices.to_numpy() + 1
        return sum(ids, []), sum(train, []), lengths, codes, [b"", *flat.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False)]

    for batch in (b.slice(at, 1000) for b in batches for at in range(0, b.num_rows, 1000)):
        flat, counts, sizes = _words(batch.column(1))
        ids, train, ends, upto = batch.column(0).to_pylist(), batch.column(2).to_pylist(), np.cumsum(counts), np.cumsum(sizes)
        a = 0
        while a < len(ids):
            before, begin = (int(x[a - 1]) if a else 0 for x in (upto, ends))
            full = min(int(np.searchsorted(upto, before + rules.chunk_bytes - size)), a + rules.chunk_docs - n - 1)  # the document that fills the chunk
            b = min(full + 1, len(ids))
            parts.append((ids[a:b], train[a:b], counts[a:b], flat.slice(begin, int(ends[b - 1]) - begin)))
            n, size = n + b - a, size + int(upto[b - 1]) - before
            if full < len(ids):
                yield made()
                parts, n, size = [], 0, 0
            a = b
    if parts:
        yield made()


CHUNK = "chunk long, ids array<{}>, train binary, lengths binary, codes binary, counts binary, others binary, mark long"


def _counted(batches: Iterator[pa.RecordBatch], rules: KatzRules):
    """(chunk, ids, train, lengths, codes, words, counts, others, mark) of each chunk.

    words: hashes, sorted; counts, others: of each in training and elsewhere; mark: hash of words; codes: each token's place
    in the words by falling count.
    """
    for k, (ids, train, lengths, codes, number) in enumerate(_chunks(batches, rules)):
        train, lengths = np.array(train, np.int64), np.array(lengths, np.int64)
        words = np.fromiter(map(xxhash.xxh64_intdigest, number), np.uint64, len(number))
        order = np.argsort(words)
        learned = np.repeat(train, lengths) == 1
        n, others = (np.bincount(codes[x], minlength=len(words))[order] for x in (learned, ~learned))
        place = np.empty(len(words), np.int64)
        place[order[_by_count(n, others)]] = np.arange(len(words))
        mark = xxhash.xxh64_intdigest(words[order].tobytes()) - 2**63
        yield (TaskContext.get().partitionId() << 24) + k, ids, train, lengths, place[codes], words[order], n, others, mark


def chunk_table(docs: DataFrame, kind: str, rules: KatzRules) -> DataFrame:
    """A row per chunk, without its words."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    out = to_arrow_schema(_parse_datatype_string(CHUNK.format(kind)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, ids, train, lengths, codes, _, n, others, mark in _counted(batches, rules):
            row = [chunk, ids, *map(pack, (train, lengths, codes, n, others)), mark]
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, out, strict=True)], schema=out)

    return docs.mapInArrow(run, CHUNK.format(kind))


def _by_count(n: np.ndarray, others: np.ndarray) -> np.ndarray:
    return np.argsort(-(n + others), kind="stable")


ASKED = "slot int, chunk long, words binary, counts binary, mark long"
TOLD = "chunk long, kind int, slot int, payload array<binary>"
IDS, TRIGRAMS, CONTEXTS = 0, 1, 2


def _table(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.Table:
    return pa.table([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)


def _told(rows: list[tuple]) -> pa.Table:
    return _table(rows, ["chunk", "kind", "slot", "payload"], [pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.binary())])


def asked_words(docs: DataFrame, slots: int, rules: KatzRules) -> DataFrame:
    """What each chunk asks each slot of the table of words: hashes as differences, and their counts in training."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, _, _, _, _, words, counts, _, mark in _counted(batches, rules):
            # Words are sorted, so those of a slot are neighbours; slots without any are not looked at.
            where = np.searchsorted(_bounds(slots), words, side="right")
            rows = [(int(where[lo]), chunk, pack(np.diff(words[lo:hi], prepend=np.uint64(0))), pack(counts[lo:hi]), mark) for lo, hi in _runs(where)]
            yield from _table(rows, ["slot", "chunk", "words", "counts", "mark"], [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64()]).to_batches()

    return docs.mapInArrow(run, ASKED).repartition(min(slots, rules.partitions), "slot")


def _totals(t: pa.Table) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Distinct words of a slot, their counts, and of each asking chunk the places of its words."""
    each = [np.cumsum(unpack(x, "<u8"), dtype=np.uint64) for x in t.column("words").to_pylist()]
    w, at = np.unique(np.concatenate(each), return_inverse=True)
    n = np.bincount(at, np.concatenate([unpack(x) for x in t.column("counts").to_pylist()]), len(w)).astype(np.int64)
    return w, n, np.split(at, np.cumsum([len(x) for x in each])[:-1])


def word_sizes(asked: DataFrame) -> DataFrame:
    """(slot, count, n): how many words of a slot have a count."""

    def run(t: pa.Table) -> pa.Table:
        count, n = np.unique(_totals(t)[1], return_counts=True)
        slot = np.full(len(n), t.column("slot")[0].as_py(), np.int32)
        return pa.table([slot[count > 0], count[count > 0], n[count > 0]], names=["slot", "count", "n"])

    return asked.groupBy("slot").applyInArrow(run, "slot int, count long, n long")


def word_ids(asked: DataFrame, sizes: DataFrame, words: Words, parts: int) -> DataFrame:
    """Each chunk's word ids, slot by slot. Words of one count are numbered by slot, then by hash."""
    shared = asked.sparkSession.sparkContext.broadcast(words)
    before = F.coalesce(F.sum("n").over(Window.partitionBy("count").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begin = sizes.select("slot", "count", before.alias("before")).repartition(parts, "slot")

    def run(t: pa.Table, begin: pa.Table) -> pa.Table:
        if not t.num_rows:
            return _told([])
        m, slot = shared.value, t.column("slot")[0].as_py()
        w, n, places = _totals(t)
        order = np.argsort(-n, kind="stable")  # words are sorted
        n = n[order]
        begin = begin.sort_by([("count", "descending")])
        count, before = (np.append(begin.column(x).to_numpy(), 0) for x in ("count", "before"))
        first = m.first[np.searchsorted(-m.count, -n)] + before[np.searchsorted(-count, -n)]
        rank = np.arange(len(w)) - np.maximum.accumulate(np.where(_new(n), np.arange(len(w)), 0))
        ids = np.empty(len(w), np.int64)
        ids[order] = np.where(n > 0, first + rank, 0)
        return _told([(c, IDS, slot, [pack(ids[at]), mark.to_bytes(8, "little", signed=True)]) for c, mark, at in zip(t.column("chunk").to_pylist(), t.column("mark").to_pylist(), places, strict=True)])

    return asked.groupBy("slot").cogroup(begin.groupBy("slot")).applyInArrow(run, TOLD)


def _steps(one: np.ndarray, two: np.ndarray) -> list[bytes]:
    """Two sorted numbers of each row as steps from the row before, of the second where the first one stays."""
    step = np.diff(one, prepend=0)
    return [pack(step), pack(np.where((step == 0) & (np.arange(len(one)) > 0), np.diff(two, prepend=0), two))]


def _stepped(one: bytes, two: bytes) -> tuple[np.ndarray, np.ndarray]:
    step, two = unpack(one), unpack(two)
    one = np.cumsum(step)
    first = np.flatnonzero(_new(one))
    sums = np.cumsum(two)
    return one, sums - np.repeat(sums[first] - two[first], np.diff(np.append(first, len(one))))


class Chunk:
    """A chunk's tokens by word id and its distinct trigrams, in the order in which it asks for them.

    Local numbers of words are in order of their ids. context, word, slot: of each distinct trigram; of_token: each
    token's trigram. heads: where a context's trigrams of one slot begin; of_head: each trigram's head.
    """

    def __init__(self, row: dict, told: list[dict], words: Words):
        told = [x["payload"] for x in told if x["kind"] == IDS]
        if {int.from_bytes(x[1], "little", signed=True) for x in told} != {row["mark"]}:
            raise RuntimeError("the documents were not read in the same order as before")
        self.lengths, self.train, codes, n, others = (unpack(row[x]) for x in ("lengths", "train", "codes", "counts", "others"))
        self.ids, local = np.unique(np.concatenate([unpack(x[0]) for x in told])[_by_count(n, others)], return_inverse=True)
        token = local[codes]
        ends = np.cumsum(self.lengths)
        starts, end = ends - self.lengths, token[ends[0] - 1]
        one, two = np.roll(token, 1), np.roll(token, 2)
        one[starts], two[starts] = end, end
        two[starts[self.lengths > 1] + 1] = end
        self.token, n = token.astype(np.int32), len(self.ids)
        two += one * n
        del one, codes, local
        contexts, at = np.unique(two, return_inverse=True)
        del two
        trigrams, at = np.unique(at * n + token, return_inverse=True)
        context, word = np.divmod(trigrams, n)
        del trigrams
        self.one, self.two = np.divmod(contexts, n)
        pieces = words.pieces(self.ids)
        self.wide = pieces > 1
        middle = self.one[context]
        slot = words.slot(self.ids[middle], self.ids[word] % pieces[middle])
        order = np.argsort(slot.astype(np.uint16) if words.slots <= 2**16 else slot, kind="stable")
        self.context, self.word, self.slot = context[order], word[order], slot[order]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.of_token = place[at].astype(np.int32)
        del at, slot, context, word, middle, place
        self.seen = np.bincount(self.of_token, np.repeat(self.train, self.lengths), len(order)).astype(np.int64)
        new = _new(self.slot, self.context)
        self.heads, self.of_head = np.flatnonzero(new), np.cumsum(new) - 1
        # Contexts of spread middle words, in the order in which they are asked for.
        mine = np.flatnonzero(self.wide[self.one])
        where = words.slot(self.ids[self.one[mine]], self.ids[self.two[mine]], np.ones(len(mine), np.int64))
        order = np.argsort(where, kind="stable")
        self.spread, self.spread_slot = mine[order], where[order]

    def asked(self, chunk: int) -> Iterator[tuple]:
        """Of each slot: middle and first word of each head, trigrams of it, their last words and training counts."""
        ids, context = self.ids, self.context[self.heads]
        sizes = np.diff(np.append(self.heads, len(self.word)))
        for lo, hi in _runs(self.slot[self.heads]):
            a, b = self.heads[lo], self.heads[hi] if hi < len(self.heads) else len(self.word)
            yield chunk, TRIGRAMS, int(self.slot[a]), [*_steps(ids[self.one[context[lo:hi]]], ids[self.two[context[lo:hi]]]), pack(sizes[lo:hi]), pack(ids[self.word[a:b]]), pack(self.seen[a:b])]
        for lo, hi in _runs(self.spread_slot):
            c = self.spread[lo:hi]
            yield chunk, CONTEXTS, int(self.spread_slot[lo]), _steps(ids[self.one[c]], ids[self.two[c]])


def asked_trigrams(chunks: DataFrame, ids: DataFrame, words: Words, parts: int) -> DataFrame:
    shared = chunks.sparkSession.sparkContext.broadcast(words)

    def run(rows: pa.Table, told: pa.Table) -> pa.Table:
        row = rows.to_pylist()[0]
        return _told(list(Chunk(row, told.sort_by("slot").to_pylist(), shared.value).asked(row["chunk"])))

    rows = chunks.select("chunk", "lengths", "train", "codes", "counts", "others", "mark").repartition(parts, "chunk")
    return rows.groupBy("chunk").cogroup(ids.repartition(parts, "chunk").groupBy("chunk")).applyInArrow(run, TOLD).repartition(parts, "slot")


#: A slot's answers to chunks; (key, stats) of spread middle words, and with key -1 the counts of counts.
ANSWERED = TOLD + ", key long, stats array<double>"


def answered(t: pa.Table, words: Words, rules: KatzRules) -> pa.Table:
    """Answers of one slot of the trigram table.

    Of each trigram: its count, and where that is 0 the bigram's. Of each head, if its middle word is not spread: its count,
    how many tokens of it are of trigrams that were seen more than once, how many trigrams were seen 2 to k times, and the
    same for the bigrams these trigrams end in, only where an unseen trigram needs them. Of middle words, where needed: how
    many bigrams were seen 1 to k times, and the probabilities of the words seen after it.
    """
    k, slot = rules.discounted, t.column("slot")[0].as_py()
    rows = t.to_pylist()
    asks, passed = [r for r in rows if r["kind"] == TRIGRAMS], [(r["chunk"], CONTEXTS, slot, r["payload"], None, None) for r in rows if r["kind"] == CONTEXTS]
    names, kinds = ["chunk", "kind", "slot", "payload", "key", "stats"], [pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.binary()), pa.int64(), pa.list_(pa.float64())]
    if not asks:
        return _table(passed, names, kinds)
    parts = [[*_stepped(*r["payload"][:2]), *map(unpack, r["payload"][2:])] for r in asks]
    head_one, head_two, size, w, seen = (np.concatenate(x) for x in zip(*parts, strict=True))
    sizes = [p[2] for p in parts]
    del rows, parts
    head = np.repeat(np.arange(len(size)), size)
    one, two = head_one[head], head_two[head]
    by = _by(head_one, head_two)
    context = np.empty(len(by), np.int64)
    context[by] = np.cumsum(_new(head_one[by], head_two[by])) - 1
    order = _by(context[head], w)
    one, two, w = (x[order] for x in (one, two, w))
    new = _new(one, two, w)
    of_record = np.empty(len(order), np.int32)
    of_record[order] = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    c3 = _sums(seen[order], first)
    one, two, w = (x[first] for x in (one, two, w))
    del order, context, by, head, head_two, size, seen, new, first
    # Bigrams of the middle word and the last.
    by = _by(one, w)
    new = _new(one[by], w[by])
    starts = np.flatnonzero(new)
    pair_one, pair_w, pair_c = one[by][starts], w[by][starts], _sums(c3[by], starts)
    c2 = np.empty(len(by), np.int64)
    c2[by] = pair_c[np.cumsum(new) - 1]
    del by, new, w

    def low(counts: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
        return [_sums((counts == r).astype(np.int64), starts) for r in range(1, k + 1)]

    new = _new(one, two)
    contexts, of_context = np.flatnonzero(new), np.cumsum(new) - 1
    below = np.where(c3 > 0, c2, 0)
    context_stats = []
    for x in (c3, below):
        total, (once, *more) = _sums(x, contexts), low(x, contexts)
        context_stats += [total, total - once, *more]
    new = _new(pair_one)
    middles = np.flatnonzero(new)
    middle_stats = [*low(pair_c, middles), _sums(np.where(pair_c > 0, words.p(pair_w), 0.0), middles)]
    wide = words.pieces(pair_one[middles]) > 1
    low_counts = lambda c: np.bincount(c[(c > 0) & (c < k + 2)], minlength=k + 2).astype(float)
    stats = [(None, None, None, None, -1, np.concatenate([low_counts(pair_c), low_counts(c3)]).tolist())]
    stats += [(None, None, None, None, int(pair_one[middles[j]]), [float(x[j]) for x in middle_stats]) for j in np.flatnonzero(wide)]
    # What is known here of contexts of spread middle words goes on to their slots.
    mine = contexts[words.pieces(one[contexts]) > 1]
    at = of_context[mine]
    to = words.slot(one[mine], two[mine], np.ones(len(mine), np.int64))
    order = np.argsort(to, kind="stable")
    mine, at, to = mine[order], at[order], to[order]
    known = [(None, CONTEXTS, int(to[lo]), [*_steps(one[mine[lo:hi]], two[mine[lo:hi]]), *(pack(x[at[lo:hi]]) for x in context_stats)], None, None) for lo, hi in _runs(to)]
    answers, done, heads_done = [], 0, 0
    for r, size in zip(asks, sizes, strict=True):
        n, heads = int(size.sum()), len(size)
        mine = of_record[done : done + n]
        begin = np.cumsum(size) - size
        own_one = head_one[heads_done : heads_done + heads]
        done, heads_done = done + n, heads_done + heads
        unseen = c3[mine] == 0
        some = np.logical_or.reduceat(unseen, begin)
        c = of_context[mine[begin]]
        narrow = words.pieces(own_one) == 1
        of_heads = [np.where(narrow & (some if j > k else True), x[c], 0) for j, x in enumerate(context_stats)]
        first = np.flatnonzero(_new(own_one))
        m = np.searchsorted(pair_one[middles], own_one[first])
        needed = narrow[first] & np.logical_or.reduceat(some, first)
        new_pair = narrow[first] & np.logical_or.reduceat(np.logical_or.reduceat(unseen & (c2[mine] == 0), begin), first)
        of_middles = [np.where(new_pair if j == k else needed, x[m], 0) for j, x in enumerate(middle_stats)]
        answers.append((r["chunk"], TRIGRAMS, slot, [*map(pack, (c3[mine], np.where(unseen, c2[mine], 0), *of_heads, *of_middles))], None, None))
    return _table(passed + stats + known + answers, names, kinds)


def context_answers(rows: DataFrame, parts: int) -> DataFrame:
    """Adds up what slots know of contexts of spread middle words, and tells the chunks that ask."""

    def run(t: pa.Table) -> pa.Table:
        rows = [(r["chunk"], [*_stepped(*r["payload"][:2]), *map(unpack, r["payload"][2:])]) for r in t.to_pylist()]
        slot = t.column("slot")[0].as_py()
        one = np.concatenate([p[0] for _, p in rows])
        two = np.concatenate([p[1] for _, p in rows])
        order = _by(one, two)
        new = _new(one[order], two[order])
        at = np.empty(len(order), np.int64)
        at[order] = np.cumsum(new) - 1
        places = np.split(at, np.cumsum([len(p[0]) for _, p in rows])[:-1])
        known = [(p, x) for (c, p), x in zip(rows, places, strict=True) if c is None]
        stats = [np.bincount(np.concatenate([x for _, x in known]), np.concatenate([p[2 + j] for p, _ in known]), new.sum()).astype(np.int64) for j in range(len(known[0][0]) - 2)] if known else []
        return _told([(c, CONTEXTS, slot, [pack(s[x]) for s in stats]) for (c, _), x in zip(rows, places, strict=True) if c is not None])

    return rows.repartition(parts, "slot").groupBy("slot").applyInArrow(run, TOLD)


@dataclass
class Model:
    """All that chunks need besides their answers. spread: statistics of spread middle words by id."""

    words: Words
    d2: np.ndarray
    d3: np.ndarray
    spread: dict[int, list[float]]


def _weights(total: np.ndarray, off: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Factor of seen counts and weight of unseen ones, by a context's count, what discounts take off it, and the lower order's probability of what was seen."""
    mass = 1 - off / np.maximum(total, 1)
    # Where discounts leave nothing, one more occurrence of the context is left to unseen words.
    most = 1 - 1 / (total + 1)
    scale = np.where(mass > most, most / np.maximum(mass, 1e-300), 1.0)
    return scale, np.where(total > 0, (1 - mass * scale) / np.maximum(1 - below, 1e-12), 1.0)


def trigram_scores(c: Chunk, told: list[dict], model: Model, k: int) -> np.ndarray:
    """log10 of the probability of each distinct trigram of a chunk."""
    trigrams, contexts = ([r["payload"] for r in told if r["kind"] == x] for x in (TRIGRAMS, CONTEXTS))
    column = lambda rows, j, kind="<i8": np.concatenate([unpack(r[j], kind) for r in rows])
    head_context = c.context[c.heads]
    head_one = c.one[head_context]
    narrow = ~c.wide[head_one]

    def of_contexts(j: int) -> np.ndarray:
        """Each context's statistic stands at one head, or comes from the table of contexts."""
        x = np.zeros(len(c.one), np.int64)
        x[head_context[narrow]] = column(trigrams, 2 + j)[narrow]
        if contexts:
            x[c.spread] = column(contexts, j)
        return x

    def taken_off(j: int, total: np.ndarray, d: np.ndarray) -> np.ndarray:
        out = (1 - d[1]) * (total - of_contexts(j + 1))
        for r in range(2, k + 1):
            out += (1 - d[r]) * r * of_contexts(j + r)
        return out

    first = np.flatnonzero(_new(c.slot[c.heads], head_one))
    of_middle = head_one[first]
    mine = ~c.wide[of_middle]
    middles = np.zeros((k + 1, len(c.ids)))
    for j, x in enumerate(middles):
        x[of_middle[mine]] = column(trigrams, 4 + 2 * k + j, "<f8" if j == k else "<i8")[mine]
    for j in np.flatnonzero(c.wide):
        middles[:, j] = model.spread.get(int(c.ids[j]), [0.0] * (k + 1))
    total2 = model.words.counts(c.ids)
    scale2, back2 = _weights(total2, sum((1 - model.d2[r]) * r * middles[r - 1] for r in range(1, k + 1)), middles[k])
    total3, seen = of_contexts(0), of_contexts(1 + k)
    below = (seen - taken_off(1 + k, seen, model.d2)) * (scale2 / np.maximum(total2, 1))[c.one]
    scale3, back3 = _weights(total3, taken_off(0, total3, model.d3), below)
    del seen, below
    d = lambda table, n: table[np.minimum(n, k + 1)] * n
    middle, c3, c2 = c.one[c.context], column(trigrams, 0), column(trigrams, 1)
    p = model.words.p(c.ids)[c.word] * back2[middle]
    p = np.where(c2 > 0, scale2[middle] * d(model.d2, c2) / np.maximum(total2[middle], 1), p)
    p = np.where(c3 > 0, scale3[c.context] * d(model.d3, c3) / np.maximum(total3[c.context], 1), back3[c.context] * p)
    return np.log10(p)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train: F.Column | None = None, rules: KatzRules = KatzRules()) -> DataFrame:
    """Per row: the id, held_out, n_tokens, n_known, train_tokens, base_score and score. train: which rows to learn from."""
    sc, kind, k = docs.sparkSession.sparkContext, dict(docs.dtypes)[id_col], rules.discounted
    train = F.coalesce(crc32_of(id_col) % 10 != 0, F.lit(True)) if train is None else train
    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), train.alias("train"))
    chunks = chunk_table(given, kind, rules)
    slots = max(2 * sc.defaultParallelism, -(-(docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0) // rules.slot_bytes))
    parts = min(slots, rules.partitions)
    asked = asked_words(given, slots, rules).persist(StorageLevel.MEMORY_AND_DISK)
    sizes = checkpoint(word_sizes(asked))
    words = Words([tuple(r) for r in sizes.groupBy("count").agg(F.sum("n")).collect()], slots, rules)
    ids = checkpoint(word_ids(asked, sizes, words, parts))
    asked.unpersist()
    shared = sc.broadcast(words)
    answers = checkpoint(asked_trigrams(chunks, ids, words, parts).groupBy("slot").applyInArrow(lambda t: answered(t, shared.value, rules), ANSWERED))
    # As many rows as there are spread middle words, and one.
    sums = answers.where(F.col("key").isNotNull()).groupBy("key").agg(F.array(*[F.sum(F.get("stats", F.lit(j))) for j in range(2 * k + 4)]).alias("stats"))
    stats = {r["key"]: r["stats"] for r in sums.collect()}
    low = stats.pop(-1, [0.0] * (2 * k + 4))
    model = sc.broadcast(Model(words, discounts(np.array(low[: k + 2]), k), discounts(np.array(low[k + 2 :]), k), {w: x[: k + 1] for w, x in stats.items()}))
    told = ids.union(answers.where(F.col("kind") == TRIGRAMS).select(*ids.columns))
    if stats:
        told = told.union(context_answers(answers.where(F.col("kind") == CONTEXTS).select(*ids.columns), parts))
    columns = ["id", "held_out", "n_tokens", "n_known", "base_score", "score"]

    def finish(rows: pa.Table, told: pa.Table) -> pa.Table:
        m, told = model.value, told.sort_by([("kind", "ascending"), ("slot", "ascending")]).to_pylist()
        row = rows.drop_columns(["ids"]).to_pylist()[0]
        c = Chunk(row, told, m.words)
        starts = np.cumsum(c.lengths) - c.lengths
        count = m.words.counts(c.ids)
        base = np.log10((count + 0.1) / (m.words.tokens + 0.1 * (m.words.types + 1)))
        sums = [_sums(x, starts) for x in ((count > 0).astype(np.int64)[c.token], base[c.token], trigram_scores(c, told, m, k)[c.of_token])]
        return pa.table([rows.column("ids").combine_chunks()[0].values, c.train == 0, c.lengths, *sums], names=columns)

    rows = chunks.select("chunk", "ids", "lengths", "train", "codes", "counts", "others", "mark").repartition(parts, "chunk")
    done = rows.groupBy("chunk").cogroup(told.repartition(parts, "chunk").groupBy("chunk"))
    done = done.applyInArrow(finish, f"id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return done.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(words.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op7_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
