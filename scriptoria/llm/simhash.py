"""SimHash near-duplicates: 64-bit fingerprints of 3-word shingles, compared exactly, tile by tile.

Equal fingerprints count once. A cell holds the fingerprints with the same four population counts (of 16 bits each);
cells whose counts differ by more than the radius in sum are never compared, since their fingerprints cannot be
within it. A cell is cut into tiles of bounded size by a hash. Within a pair of tiles numpy compares all against all by
exclusive-or and bit counts, in order of the whole fingerprint's population count, so that blocks further apart than the
radius are skipped too. Of the links found in a pair of tiles a spanning forest is kept: enough for the components, and
never more than the fingerprints compared.

A text without words, empty or null, has fingerprint zero and is linked like any other. Equal rows fall into one
component. Other columns of the input are ignored, so their names cannot clash. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptoria.llm.common import checkpoint, map_rows, small_or_shuffled, table, words_of
from scriptoria.llm.components import components

#: Fixed by the contract: words of a shingle, and the hash's seed.
SHINGLE, SEED = 3, 42
#: Lanes of a byte's bits: the bits of 0..255 as eight bytes of a 64-bit word, lowest bit first.
LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").copy().view(np.uint64).ravel()


@dataclass(frozen=True)
class Tiling:
    """radius: most differing bits of a link. tile: most fingerprints in a tile, about. block: rows compared in one step."""

    radius: int = 2
    tile: int = 20_000
    block: int = 512


def shingle_hashes(text: str | None, size: int = SHINGLE) -> list[int]:
    words = words_of(text, lower=True)
    if not words:
        return []
    if len(words) < size:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    digest = xxhash.xxh64_intdigest
    return [digest(b" ".join(words[k : k + size]), SEED) for k in range(len(words) - size + 1)]


def fingerprints(texts: list[str | None]) -> np.ndarray:
    """A bit is set if it is set in over half of a text's shingle hashes."""
    each = [np.array(shingle_hashes(t), np.uint64) for t in texts]
    n = np.array([len(h) for h in each], np.int64)
    out = np.zeros(len(texts), np.uint64)
    some = np.flatnonzero(n)
    if len(some):
        octets = np.concatenate([each[k] for k in some]).view(np.uint8).reshape(-1, 8)
        # Eight counters of a byte each are added at a time, so pieces stay below 256 hashes.
        cuts = [np.arange(0, n[k], 255) for k in some]
        first = np.concatenate([[0], np.cumsum(n[some])[:-1]])
        starts = np.concatenate([c + f for c, f in zip(cuts, first, strict=True)])
        owner = np.concatenate([[0], np.cumsum([len(c) for c in cuts])[:-1]])
        ones = np.empty((len(some), 64), np.int64)
        for k in range(8):
            sums = np.add.reduceat(LANES[octets[:, k]], starts)
            ones[:, 8 * k : 8 * k + 8] = np.add.reduceat(sums.view(np.uint8).reshape(-1, 8).astype(np.int64), owner, axis=0)
        bits = (2 * ones > n[some][:, None]).astype(np.uint8)
        out[some] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


class Forest:
    """Union-find over positions 0 to n-1."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


def tile_links(left: np.ndarray, right: np.ndarray | None, tiling: Tiling) -> list[tuple[int, int]]:
    """A spanning forest of the links between two tiles of fingerprints, or within one (right is None)."""
    a = left[np.argsort(np.bitwise_count(left), kind="stable")]
    b = a if right is None else right[np.argsort(np.bitwise_count(right), kind="stable")]
    pa_, pb = np.bitwise_count(a).astype(int), np.bitwise_count(b).astype(int)
    forest, out = Forest(len(a) + (0 if right is None else len(b))), []
    shift = 0 if right is None else len(a)
    for at in range(0, len(a), tiling.block):
        rows = slice(at, at + tiling.block)
        lo = np.searchsorted(pb, pa_[rows][0] - tiling.radius, side="left")
        hi = np.searchsorted(pb, pa_[rows][-1] + tiling.radius, side="right")
        if right is None:
            lo = max(lo, at)
        for to in range(lo, hi, 4 * tiling.block):
            part = b[to : min(to + 4 * tiling.block, hi)]
            near = np.bitwise_count(a[rows][:, None] ^ part[None, :]) <= tiling.radius
            for x, y in zip(*np.nonzero(near), strict=True):
                if forest.join(x + at, y + to + shift):
                    out.append((a[x + at], b[y + to]))
    return out


def links(prints: DataFrame, tiling: Tiling = Tiling()) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints within the radius, enough of them to connect all that are linked.

    prints: distinct fingerprints, column fp (long).
    """
    counts = [F.bit_count(F.shiftrightunsigned("fp", 16 * k).bitwiseAND(65535)) for k in range(4)]
    cells = checkpoint(prints.select("fp", *[c.alias(f"c{k}") for k, c in enumerate(counts)]))
    sizes = cells.groupBy("c0", "c1", "c2", "c3").agg(F.count("*").alias("n"))
    parts = F.greatest(F.lit(1), F.ceil(F.col("n") / tiling.tile)).cast("int")
    # 17**4 cells at most, about half of which can be neighbours: small however many documents there are.
    crowded = sizes.where(F.col("n") > tiling.tile).select("c0", "c1", "c2", "c3", parts.alias("parts"))
    crowded = {tuple(r)[:4]: r["parts"] for r in crowded.collect()}
    near = [
        (i, j, k, m)
        for i in range(-tiling.radius, tiling.radius + 1)
        for j in range(-tiling.radius, tiling.radius + 1)
        for k in range(-tiling.radius, tiling.radius + 1)
        for m in range(-tiling.radius, tiling.radius + 1)
        if abs(i) + abs(j) + abs(k) + abs(m) <= tiling.radius and (i, j, k, m) >= (0, 0, 0, 0)
    ]
    names = ["c0", "c1", "c2", "c3"]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each fingerprint goes to its own tile pairs and those with the tiles of neighbouring cells."""
        for batch in batches:
            fp = batch.column(0).to_numpy()
            c = np.stack([batch.column(k + 1).to_numpy() for k in range(4)], axis=1).astype(np.int64)
            packed = ((c[:, 0] * 32 + c[:, 1]) * 32 + c[:, 2]) * 32 + c[:, 3]
            many = np.ones(len(fp), np.int64)
            if crowded:
                known = {((i * 32 + j) * 32 + k) * 32 + m: p for (i, j, k, m), p in crowded.items()}
                many = np.array([known.get(x, 1) for x in packed.tolist()], np.int64)
            tile = (fp.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % many
            for d in near:
                for sign in (1,) if d == (0, 0, 0, 0) else (1, -1):
                    other = c + sign * np.array(d)
                    ok = ((other >= 0) & (other <= 16)).all(axis=1)
                    to = ((other[:, 0] * 32 + other[:, 1]) * 32 + other[:, 2]) * 32 + other[:, 3]
                    theirs = np.ones(len(fp), np.int64)
                    if crowded:
                        theirs = np.array([known.get(x, 1) for x in to.tolist()], np.int64)
                    for k in range(int(theirs[ok].max(initial=0))):
                        rows = np.flatnonzero(ok & (theirs > k))
                        if d == (0, 0, 0, 0):  # tiles of the same cell: the smaller number is the left one
                            left_tile, right_tile = np.minimum(tile[rows], k), np.maximum(tile[rows], k)
                            left_cell = right_cell = packed[rows]
                            side = (tile[rows] > k).astype(np.int8)
                        elif sign == 1:
                            left_cell, left_tile, right_cell, right_tile, side = packed[rows], tile[rows], to[rows], np.full(len(rows), k), np.zeros(len(rows), np.int8)
                        else:
                            left_cell, left_tile, right_cell, right_tile, side = to[rows], np.full(len(rows), k), packed[rows], tile[rows], np.ones(len(rows), np.int8)
                        if len(rows):
                            yield pa.RecordBatch.from_arrays([pa.array(x) for x in ((left_cell << 20) | right_cell, (left_tile << 24) | right_tile, side, fp[rows])], names=["cells", "tiles", "side", "fp"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by pair of tiles; a pair is held until it is complete, two tiles at most."""
        key, held = None, ([], [])

        def close():
            left, right = (np.concatenate(x).view(np.uint64) if x else np.zeros(0, np.uint64) for x in held)
            within = key is not None and (key[0] >> 20) == (key[0] & 0xFFFFF) and (key[1] >> 24) == (key[1] & 0xFFFFFF)
            found = tile_links(left, None if within else right, tiling) if len(left) and (within or len(right)) else []
            return pa.RecordBatch.from_arrays([pa.array(np.array([x[k] for x in found], np.uint64).view(np.int64)) for k in range(2)], names=["a", "b"])

        for batch in batches:
            cells_, tiles, side, fp = (batch.column(k).to_numpy() for k in range(4))
            cuts = np.flatnonzero((np.diff(cells_) != 0) | (np.diff(tiles) != 0)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(fp)], strict=True):
                if lo == hi:
                    continue
                now = (int(cells_[lo]), int(tiles[lo]))
                if now != key:
                    if key is not None:
                        yield close()
                    key, held = now, ([], [])
                for k in range(2):
                    own = fp[lo:hi][side[lo:hi] == k]
                    if len(own):
                        held[k].append(own)
        if key is not None:
            yield close()

    rows = cells.select("fp", *names).mapInArrow(spread, "cells long, tiles long, side tinyint, fp long")
    return rows.repartition("cells", "tiles").sortWithinPartitions("cells", "tiles").mapInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tiling: Tiling = Tiling()) -> DataFrame:
    """Per row: the id, its fingerprint fp (long) and component_id, the smallest id of those linked to it directly or through others.

    component_fp, the smallest fingerprint of the component, tells components apart even if ids repeat.
    """
    kind = dict(docs.dtypes)[id_col]
    prints = map_rows(docs, [id_col, text_col], f"id {kind}, fp long", lambda ids, texts: {"id": ids, "fp": fingerprints(texts).view(np.int64)})
    prints = checkpoint(prints)
    classes = checkpoint(prints.groupBy("fp").agg(F.min("id").alias("first")))
    found = components(links(classes.select("fp"), tiling))
    # Components are of fingerprints; their smallest id is the least of their classes' first ids.
    named = classes.join(found, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    named = named.join(least, "component").select("fp", F.col("component").alias("component_fp"), "component_id")
    return prints.join(named, "fp").select(F.col("id").alias(id_col), "fp", "component_id", "component_fp")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tiling: Tiling = Tiling()) -> DataFrame:
    """docs with one row of each component: that of the smallest id, of equal ids that of the smallest fingerprint, of equal rows one."""
    return keep_chosen(docs, near_duplicates(docs, id_col, text_col, tiling), fingerprints, id_col, text_col)


def keep_chosen(docs: DataFrame, found: DataFrame, prints: Callable[[list[str | None]], np.ndarray], id_col: str, text_col: str, ids: int = 1_000_000) -> DataFrame:
    """keep_one by found: of each row the id, fp and component_fp. prints makes fp of texts.

    Rows that are alone in their component stay where they are; only the others are shuffled. Up to so many ids of these
    are sent to all tasks, more are joined by shuffling.
    """
    found = checkpoint(found)
    several = found.groupBy("component_fp").agg(F.count("*").alias("n")).where("n > 1")
    mixed = checkpoint(found.join(several, "component_fp").select(F.col(id_col).alias("mixed_id")).distinct())
    mixed = small_or_shuffled(mixed, ids)
    chosen = found.groupBy("component_fp").agg(F.min(F.struct(id_col, "fp")).alias("x")).select(F.col(f"x.{id_col}").alias("chosen_id"), F.col("x.fp").alias("chosen_fp"))
    names = [f"c{k}" for k in range(len(docs.columns))]
    marked = docs.select(*[F.col(c).alias(n) for c, n in zip(docs.columns, names, strict=True)])
    own_id, own_text = (names[docs.columns.index(c)] for c in (id_col, text_col))
    order = [n for n, (_, kind) in zip(names, docs.dtypes, strict=True) if not kind.startswith("map")]
    one_of = F.col(own_id).eqNullSafe(F.col("mixed_id"))
    alone, marked = marked.join(mixed, one_of, "left_anti"), marked.join(mixed, one_of, "left_semi")
    # Ids first, so that fingerprints are made again only for rows that may stay.
    marked = marked.join(chosen, F.col(own_id).eqNullSafe(F.col("chosen_id"))).select(*names, "chosen_fp")
    kinds = ", ".join(f"{n} {kind}" for n, (_, kind) in zip(names, docs.dtypes, strict=True))

    def same(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index(own_text)
        for batch in batches:
            fp = prints(batch.column(at).to_pylist()).view(np.int64)
            yield batch.filter(pa.array(fp == batch.column(len(names)).to_numpy()))

    kept = marked.mapInArrow(same, f"{kinds}, chosen_fp long")
    kept = kept.withColumn("n", F.row_number().over(Window.partitionBy(own_id, "chosen_fp").orderBy(*[n for n in order if n != own_text]))).where(F.col("n") == 1)
    kept = alone.select(*names).union(kept.select(*names))
    return kept.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)])


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
