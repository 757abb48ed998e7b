"""Near-duplicate embeddings: navigable small-world graphs per shard, every shard queried, links verified.

Rows with the same label and vector count once. A label's distinct vectors are dealt into shards by a hash, as many as
keep a shard below its size; each shard is one graph, held by one task. Every vector is a query to every shard of its
label. A beam that holds nothing but links may have left some out: such queries scan their shard instead. Each shard
audits its beam: queries, its own members' and other shards' alike, are answered by a scan as well, until enough links
are seen, then one block of queries in some; while too few of all links seen, other than those of vectors with themselves,
are found by the beam, it is doubled. Scanned queries keep the scan's links. The share that all beams found is a column
of the result. Found pairs are verified in double precision. A query tells how many vectors it is linked to, and pairs
enough to connect them.

Vectors that are null, zero or have null or non-finite components, and rows without a label, link with nothing: each is
its own component. Equal rows are separate vectors, linked to each other. Vectors of different length do not link. Other
columns are ignored, so their names cannot clash. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptoria.llm.common import checkpoint, table
from scriptoria.llm.components import components
from scriptoria.llm.simhash import Forest


@dataclass(frozen=True)
class Beams:
    """cosine: of a link. shard: vectors of a shard, about. links: neighbours per node above the ground layer, twice as
    many on it. build, search: beam widths; search is doubled up to the shard's size until of the audited links the share
    recall is found. batch: queries answered side by side. audit: links that a shard audits before it goes on to one batch
    in every; tries: queries after which it does so anyway."""

    cosine: float = 0.98
    shard: int = 20_000
    links: int = 12
    build: int = 48
    search: int = 32
    audit: int = 64
    tries: int = 2_048
    every: int = 16
    recall: float = 0.98
    batch: int = 512


class Graph:
    """A hierarchical navigable small-world graph over rows of unit vectors, built and searched in batches."""

    def __init__(self, x: np.ndarray, beams: Beams = Beams()):
        self.x, self.beams = x, beams
        n = len(x)
        draw = np.random.default_rng(n).random(n)
        self.level = np.minimum((-np.log(np.maximum(draw, 1e-12)) / np.log(beams.links)).astype(int), 6)
        if n:
            self.level[0] = self.level.max()
        self.moves = [np.full((n, beams.links * (1 if k else 2)), -1, np.int32) for k in range(self.level.max(initial=0) + 1)]
        at = 1
        while at < n:
            to = min(n, at + min(max(at, 16), 1024))
            self._insert(np.arange(at, to))
            at = to

    def _insert(self, new: np.ndarray) -> None:
        start = np.zeros(len(new), np.int64)
        for k in range(len(self.moves) - 1, -1, -1):
            mine = np.flatnonzero(self.level[new] >= k)
            over = np.flatnonzero(self.level[new] < k)
            if len(over):
                start[over] = self.search(k, self.x[new[over]], start[over], 1)[0][:, 0]
            if not len(mine):
                continue
            ids, sims = self.search(k, self.x[new[mine]], start[mine], self.beams.build)
            start[mine] = ids[:, 0]
            peers = new[mine]
            own = self.x[peers] @ self.x[peers].T
            own[np.arange(len(peers)), np.arange(len(peers))] = -2
            most = min(self.beams.build, len(peers))
            near = np.argpartition(-own, most - 1, axis=1)[:, :most]
            ids = np.concatenate([ids, np.where(np.take_along_axis(own, near, 1) > -2, peers[near], -1)], axis=1)
            sims = np.concatenate([sims, np.take_along_axis(own, near, 1)], axis=1)
            picked = self._select(peers, ids, sims, self.beams.links)
            self.moves[k][peers, : picked.shape[1]] = picked
            u, v = np.repeat(peers, picked.shape[1]), picked.ravel()
            self._back(k, u[v >= 0], v[v >= 0])

    def _select(self, base: np.ndarray, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """Of each row's candidates those nearer to the base than to any one picked before; then the nearest of the rest."""
        order = np.argsort(-sims, axis=1, kind="stable")[:, : 3 * most]
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        ids = np.where((sims > -2) & (ids != base[:, None]), ids, -1)
        b, c = ids.shape
        out, n, taken = np.full((b, most), -1, np.int64), np.zeros(b, np.int64), np.zeros((b, c), bool)
        for diverse in (True, False):
            for j in range(c):
                ok = (ids[:, j] >= 0) & (n < most) & ~taken[:, j] & ~(out == ids[:, j : j + 1]).any(axis=1)
                rows = np.flatnonzero(ok)
                if diverse and len(rows):
                    to_picked = np.einsum("ijk,ik->ij", self.x[out[rows]], self.x[ids[rows, j]])
                    nearest = np.where(out[rows] >= 0, to_picked, -2).max(axis=1)
                    rows = rows[sims[rows, j] > nearest]
                out[rows, n[rows]] = ids[rows, j]
                n[rows] += 1
                taken[rows, j] = True
        return out

    def _back(self, k: int, u: np.ndarray, v: np.ndarray) -> None:
        """Adds moves from v to u; full lists keep the best of both."""
        sims = np.einsum("ij,ij->i", self.x[u], self.x[v])
        order = np.lexsort((-sims, v))
        u, v, sims = u[order], v[order], sims[order]
        nodes, first, count = np.unique(v, return_index=True, return_counts=True)
        place = np.arange(len(v)) - np.repeat(first, count)
        width = self.moves[k].shape[1]
        keep = place < width
        added = np.full((len(nodes), width), -1, np.int64)
        row = np.repeat(np.arange(len(nodes)), count)
        added[row[keep], place[keep]] = u[keep]
        have = np.concatenate([self.moves[k][nodes].astype(np.int64), added], axis=1)
        room = (have >= 0).sum(axis=1) <= width
        easy = np.sort(have[room], axis=1)[:, ::-1][:, :width]
        self.moves[k][nodes[room]] = easy
        full = np.flatnonzero(~room)
        for at in range(0, len(full), 512):
            rows = full[at : at + 512]
            s = np.where(have[rows] >= 0, np.einsum("ijk,ik->ij", self.x[have[rows]], self.x[nodes[rows]]), -2)
            self.moves[k][nodes[rows]] = self._select(nodes[rows], have[rows], s, width)

    def search(self, k: int, q: np.ndarray, start: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and cosines of the best `width` nodes that a beam finds on layer k, best first; -1 where there are fewer."""
        n, m = len(q), len(self.x)
        ids, sims, done = np.full((n, width), -1, np.int64), np.full((n, width), -2, np.float32), np.ones((n, width), bool)
        ids[:, 0], sims[:, 0], done[:, 0] = start, np.einsum("ij,ij->i", self.x[start], q), False
        seen = np.zeros((n, m), bool)
        seen[np.arange(n), start] = True
        active, many = np.arange(n), min(4, width)
        while len(active):
            s = np.where(done[active], -3, sims[active])
            top = np.argpartition(-s, many - 1, axis=1)[:, :many]
            ok = np.take_along_axis(s, top, 1) > -3
            some = ok.any(axis=1)
            active, top, ok = active[some], top[some], ok[some]
            if not len(active):
                break
            done[active[:, None], top] = True
            near = np.where(ok[:, :, None], self.moves[k][ids[active[:, None], top]], -1).reshape(len(active), -1).astype(np.int64)
            near.sort(axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            fresh = (near >= 0) & ~seen[active[:, None], near]
            r, c = np.nonzero(fresh)
            seen[active[r], near[r, c]] = True
            s = np.full(near.shape, -2, np.float32)
            s[r, c] = np.einsum("ij,ij->i", self.x[near[r, c]], q[active[r]])
            all_ids, all_sims = np.concatenate([ids[active], near], axis=1), np.concatenate([sims[active], s], axis=1)
            all_done = np.concatenate([done[active], ~fresh], axis=1)
            best = np.argpartition(-all_sims, width - 1, axis=1)[:, :width]
            ids[active], sims[active], done[active] = (np.take_along_axis(x, best, 1) for x in (all_ids, all_sims, all_done))
        order = np.argsort(-sims, axis=1, kind="stable")
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        return np.where(sims > -2, ids, -1), sims

    def query(self, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        start = np.zeros(len(q), np.int64)
        for k in range(len(self.moves) - 1, 0, -1):
            start = self.search(k, q, start, 1)[0][:, 0]
        return self.search(0, q, start, min(width, len(self.x)))


class Shard:
    """A graph with its vectors in double precision."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, copies: np.ndarray, beams: Beams):
        self.ids, self.copies, self.beams = ids, copies, beams
        self.unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        self.graph = Graph(self.unit.astype(np.float32), beams)
        self.width = beams.search
        self.forest = Forest(len(ids))
        self.wanted = self.found = self.tried = self.turn = 0

    def _scan(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows, cols = [], []
        for at in range(0, len(unit), 256):
            r, c = np.nonzero(unit[at : at + 256] @ self.unit.T >= self.beams.cosine - 1e-9)
            rows.append(r + at)
            cols.append(c)
        return np.concatenate([np.zeros(0, np.int64), *rows]), np.concatenate([np.zeros(0, np.int64), *cols])

    def _beam(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ids, sims = self.graph.query(unit.astype(np.float32), self.width)
        near = (ids >= 0) & (sims >= self.beams.cosine - 1e-3)
        full = np.flatnonzero(near.all(axis=1))
        near[full] = False
        r, c = np.nonzero(near)
        again, found = self._scan(unit[full])
        return np.concatenate([r, full[again]]), np.concatenate([ids[r, c], found])

    def audited(self, ids: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of query row and member by a scan. The beam is widened while it finds too few of all links audited so far."""
        r, c = self._scan(unit)
        other = ids[r] != self.ids[c]
        wanted = set(zip(r[other].tolist(), c[other].tolist(), strict=True))
        self.wanted, self.tried = self.wanted + len(wanted), self.tried + len(unit)
        while True:
            found = len(wanted & set(zip(*(x.tolist() for x in self._beam(unit)), strict=True)))
            if self.found + found >= self.beams.recall * self.wanted or self.width >= len(self.ids):
                break
            self.width *= 2
        self.found += found
        return r, c

    def links(self, ids: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Verified pairs of query row and member."""
        early = self.wanted < self.beams.audit and self.tried < self.beams.tries
        r, c = self.audited(ids, unit) if early or self.turn % self.beams.every == 0 else self._beam(unit)
        self.turn += 1
        cosine = np.einsum("ij,ij->i", unit[r], self.unit[c])
        return r[cosine >= self.beams.cosine], c[cosine >= self.beams.cosine]


def answers(batches: Iterator[pa.RecordBatch], beams: Beams = Beams()) -> Iterator[pa.RecordBatch]:
    """Rows (shard, is_query, id, copies, vector) by shard, members first.

    Out: (a, b, n): n links of a, or a pair if b is not null; if a is null, the audit wanted b links and found n of them.
    """
    shard, now, count = None, None, [[], [], []]

    def batch_of(a, b, n) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64())], names=["a", "b", "n"])

    def answer(ids: np.ndarray, vectors: np.ndarray) -> Iterator[pa.RecordBatch]:
        unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        for at in range(0, len(ids), beams.batch):
            mine = ids[at : at + beams.batch]
            r, c = shard.links(mine, unit[at : at + beams.batch])
            r, c = r[mine[r] != shard.ids[c]], c[mine[r] != shard.ids[c]]
            n = np.bincount(r, shard.copies[c], len(mine)).astype(np.int64)
            some = np.flatnonzero(n)
            yield batch_of(mine[some], [None] * len(some), n[some])
            order = np.argsort(r, kind="stable")
            r, c = r[order], c[order]
            first = np.flatnonzero(np.diff(np.concatenate([[-1], r])))
            a, b = mine[r[first]].tolist(), shard.ids[c[first]].tolist()
            for lo, hi in zip(first, np.append(first[1:], len(r))[: len(first)], strict=True):
                roots = {shard.forest.root(x): x for x in np.unique(shard.forest.up[c[lo:hi]]).tolist()}
                one = c[lo]
                for x in roots.values():
                    if shard.forest.join(one, x):
                        a.append(int(shard.ids[one]))
                        b.append(int(shard.ids[x]))
            yield batch_of(a, b, [0] * len(a))

    def close() -> None:
        """The members are complete."""
        nonlocal shard
        if count[0]:
            shard = Shard(np.concatenate(count[0]), np.concatenate(count[2]), np.concatenate(count[1]), beams)
        for x in count:
            x.clear()

    for batch in batches:
        key, query, ids, copies = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
        cuts = [0, *(np.flatnonzero((np.diff(key) != 0) | (np.diff(query.astype(int)) != 0)) + 1), batch.num_rows]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if lo == hi:
                continue
            x = np.array(batch.column(4).slice(lo, hi - lo).to_pylist(), np.float64)
            if key[lo] != now:
                if shard is not None:
                    yield batch_of([None], [shard.wanted], [shard.found])
                now, shard = key[lo], None
                for y in count:
                    y.clear()
            if not query[lo]:
                for y, z in zip(count, (ids[lo:hi], copies[lo:hi], x), strict=True):
                    y.append(z)
            else:
                if shard is None:
                    close()
                if shard is not None:
                    yield from answer(ids[lo:hi], x)
    if shard is not None:
        yield batch_of([None], [shard.wanted], [shard.found])


def near_duplicates(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", beams: Beams = Beams()) -> DataFrame:
    """Per row: the id, n_links, component_id, kept and recall: the share of audited links that beams found, null if there were none."""
    x = F.col("v")
    kind = "array<float>" if dict(rows.dtypes)[vector_col] == "array<float>" else "array<double>"
    given = rows.select(F.col(id_col).alias("id"), F.col(vector_col).cast(kind).alias("v"), F.col(label_col).alias("label"))
    number = lambda y: y.isNotNull() & ~F.isnan(y) & (F.abs(y) < float("inf"))
    fit = F.coalesce(F.col("label").isNotNull() & (F.size(x) > 0) & F.forall(x, number) & F.exists(x, lambda y: y != 0), F.lit(False))
    given = given.withColumn("key", F.when(fit, F.xxhash64("label", "v")))
    usable = given.where(fit)
    distinct = checkpoint(usable.groupBy("label", "v", "key").agg(F.min("id").alias("first"), F.count("*").alias("copies")))
    sized = distinct.withColumn("d", F.size("v"))
    dealt = sized.join(sized.groupBy("label", "d").agg(F.ceil(F.count("*") / beams.shard).cast("int").alias("shards")), ["label", "d"])
    name = lambda s: F.xxhash64("label", "d", s)
    members = dealt.select(name(F.pmod(F.hash("key"), F.col("shards"))).alias("shard"), F.lit(False).alias("is_query"), F.col("key").alias("id"), "copies", "v")
    queries = dealt.select("label", "d", "key", "copies", "v", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("s"))
    queries = queries.select(name(F.col("s")).alias("shard"), F.lit(True), "key", "copies", "v")
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * rows.sparkSession.sparkContext.defaultParallelism)
    asked = members.union(queries).repartition(parts, "shard").sortWithinPartitions("shard", "is_query", "id")
    found = checkpoint(asked.mapInArrow(lambda b: answers(b, beams), "a long, b long, n long"))
    audit = found.where(F.col("a").isNull()).agg(F.sum("b").alias("wanted"), F.sum("n").alias("found")).first()
    recall = F.lit(audit["found"] / audit["wanted"] if audit["wanted"] else None).cast("double")
    counts = found.where(F.col("b").isNull()).groupBy("a").agg(F.sum("n").alias("n"))
    joined = components(found.where(F.col("a").isNotNull() & F.col("b").isNotNull()).select("a", "b"))
    named = distinct.select("key", "first", "copies").join(joined, F.col("key") == F.col("node"), "left").withColumn("component", F.coalesce("component", "key"))
    least = named.groupBy("component").agg(F.min("first").alias("least"))
    named = named.join(least, "component").join(counts, F.col("key") == F.col("a"), "left")
    named = named.select(F.col("key").alias("of"), "least", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = given.select("id", "key").join(named, F.col("key") == F.col("of"), "left")
    out = out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("least", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True))).withColumn("recall", recall)


def op9_hnsw_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
