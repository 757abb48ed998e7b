"""Embedding whitening: principal components by a randomised range finder, and vectors projected on them at unit variance.

Entries become integers, x = floor(scale * c) + shift, so that sums per dimension are exact and vectors are centred before
anything is multiplied: n * x - S is an integer. A block of random directions is multiplied by the covariance in passes over
all centred rows; tasks send sums of a block only. Rayleigh-Ritz on the last pass gives the components. If a residual shows
that the block has not found them to double precision, the block grows to all dimensions, where they are exact. Where
eigenvalues are equal, any basis of their space is right.

Rows with a null vector, a null or non-finite entry, or one whose integer does not fit a long are dropped, and so are vectors
whose length is not the commonest (of equally common ones the longest): they are no points of this space. A null id stays.
Equal rows count each. Components without variance (a constant direction, fewer rows than dimensions) have a null whitened value
and no part in identity_error. An empty table, or one in which no row remains, gives no rows. deviation is null where it is no
long; deviation_exact has it always. Other columns are ignored, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptoria.llm.common import table

#: Integers from here on are dropped with their rows.
WIDE = 2.0**62
#: Sums of tasks are added up in so many groups before the driver adds those.
GROUPS = 8


@dataclass(frozen=True)
class Finder:
    """components: how many, at most. over: more directions than that in the block. passes: over the rows before Rayleigh-Ritz.
    tolerance: of a residual against the distance to the next eigenvalue. scale, shift: of the integers, fixed by the contract."""

    components: int = 8
    over: int = 8
    passes: int = 2
    tolerance: float = 1e-12
    seed: int = 12
    scale: int = 1024
    shift: int = 100_000


def _values(column: pa.ListArray, rules: Finder) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All entries as floor(scale * c) + shift, NaN where null, with each row's length (-1: null) and first place."""
    flat = column.flatten().cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    lengths = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    with np.errstate(all="ignore"):
        values = np.floor(rules.scale * flat) + rules.shift
    held = np.maximum(lengths, 0)
    return values, lengths, np.cumsum(held) - held


def integers(column: pa.ListArray, d: int, rules: Finder) -> tuple[np.ndarray, np.ndarray]:
    """The rows that remain among those of d entries, and their integers."""
    values, lengths, starts = _values(column, rules)
    rows = np.flatnonzero(lengths == d)
    x = values[starts[rows][:, None] + np.arange(d)]
    fine = (np.abs(x) < WIDE).all(axis=1)
    return rows[fine], x[fine].astype(np.int64)


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - S, as integers that are exact: 64 bits where they fit, else Python's."""
    most = n * (int(np.abs(x).max(initial=0)) + 1) + max((abs(int(s)) for s in sums), default=0)
    return n * x - sums.astype(np.int64) if most < 2**62 else n * x.astype(object) - sums


def _squares(d: np.ndarray) -> list[int]:
    """Sums of the squares of each row, exact."""
    most = max(int(np.abs(d).max(initial=0)), 1) if d.dtype != object else 2**63
    if most < 2**31 and d.shape[1] * most**2 < 2**62:
        return (d * d).sum(axis=1).tolist()
    return [sum(v * v for v in row) for row in d.astype(object).tolist()]


def _summed(vectors: DataFrame, size: int, per_batch: Callable[[pa.ListArray], np.ndarray | None]) -> np.ndarray | None:
    """The sum over all rows of what per_batch makes of them, size doubles: tasks add up their own, then groups of tasks theirs."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            made = per_batch(batch.column(0))
            if made is not None:
                total = made if total is None else total + made
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], names=["part"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            block = batch.column(0).flatten().to_numpy().reshape(-1, size).sum(axis=0)
            total = block if total is None else total + block
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], names=["part"])

    schema = "part array<double>"
    # One array a task, however many rows it reads; groups of tasks by hash, so that the driver gets few arrays.
    rows = vectors.mapInArrow(part, schema).repartition(GROUPS, F.xxhash64("part")).mapInArrow(added, schema).collect()
    return sum(np.array(r["part"]) for r in rows).astype(np.float64) if rows else None


def moments(vectors: DataFrame, rules: Finder = Finder()) -> tuple[int, np.ndarray] | None:
    """n and the sums S per dimension, exact, of the rows that remain; None if none does."""

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Halves of 32 bits are added up, so that no sum of a task overflows.
        seen: dict[int, list] = {}
        for batch in batches:
            for d in np.unique(_values(batch.column(0), rules)[1]).tolist():
                if d < 0:
                    continue
                _, x = integers(batch.column(0), d, rules)
                mine = seen.setdefault(d, [0, np.zeros(d, np.int64), np.zeros(d, np.int64)])
                mine[0], mine[1], mine[2] = mine[0] + len(x), mine[1] + (x >> 32).sum(axis=0), mine[2] + (x & 0xFFFFFFFF).sum(axis=0)
        rows = [(d, n, high.tolist(), low.tolist()) for d, (n, high, low) in seen.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())))], names=["d", "n", "high", "low"])

    parts = vectors.mapInArrow(sizes, "d long, n long, high array<long>, low array<long>")
    lengths = parts.groupBy("d").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    if not lengths or not lengths[0]["d"]:
        return None
    d, n = lengths[0]["d"], lengths[0]["n"]
    each = parts.where(F.col("d") == d).select(F.posexplode(F.arrays_zip("high", "low")).alias("at", "x"))
    wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c.split(".")[1])
    rows = each.groupBy("at").agg(wide("x.high"), wide("x.low")).collect()
    sums = np.zeros(d, object)
    for r in rows:
        sums[r["at"]] = int(r["high"]) * 2**32 + int(r["low"])
    return n, sums


def _multiplied(vectors: DataFrame, n: int, sums: np.ndarray, block: np.ndarray, rules: Finder) -> tuple[np.ndarray, float]:
    """Covariance times block, and the trace of the covariance, from one pass over all centred rows."""
    d = len(sums)

    def per_batch(column: pa.ListArray) -> np.ndarray | None:
        _, x = integers(column, d, rules)
        if not len(x):
            return None
        c = deviations(x, n, sums).astype(np.float64) / n
        return np.append(c.T @ (c @ block), (c * c).sum())

    total = _summed(vectors, block.size + 1, per_batch) / n
    return total[:-1].reshape(block.shape), float(total[-1])


def find_components(vectors: DataFrame, n: int, sums: np.ndarray, rules: Finder = Finder()) -> tuple[np.ndarray, np.ndarray, float]:
    """Components (as columns), their eigenvalues, falling, and the trace of the covariance."""
    d = len(sums)
    k, width = min(rules.components, d), min(rules.components + rules.over, d)
    random = np.random.default_rng(rules.seed).standard_normal((d, d))
    basis = np.linalg.qr(random[:, :width])[0]
    for _ in range(rules.passes if width < d else 0):
        basis = np.linalg.qr(_multiplied(vectors, n, sums, basis, rules)[0])[0]
    while True:
        image, trace = _multiplied(vectors, n, sums, basis, rules)
        small = basis.T @ image
        values, turned = np.linalg.eigh((small + small.T) / 2)
        values, turned = values[::-1], turned[:, ::-1]
        found = basis @ turned
        if width == d:
            break
        residual = np.linalg.norm(image @ turned - found * values, axis=0)[:k]
        steps = np.concatenate([[np.inf], np.abs(np.diff(values)), [0.0]])  # the value after the block's last is not known
        gaps = np.minimum(steps[:k], steps[1 : k + 1])
        if (residual <= rules.tolerance * gaps).all():
            break
        # The block grows to all dimensions, from what it has found.
        basis, width = np.linalg.qr(np.hstack([basis, random[:, width:]]))[0], d
    return np.linalg.qr(found[:, :k])[0], np.maximum(values[:k], 0.0), trace


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", rules: Finder = Finder()) -> DataFrame:
    """A row per vector that remains and component: the id, component, n, deviation, whitened, explained, identity_error, deviation_exact."""
    kind = dict(vectors.dtypes)[id_col]
    schema = f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact decimal(38,0)"
    only = vectors.select(vec_col)
    known = moments(only, rules)
    if known is None:
        return vectors.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_col)
    n, sums = known
    d = len(sums)
    axes, values, trace = find_components(only, n, sums, rules)
    real = values > max(trace, 0.0) * d * 1e-13
    turn = np.where(real, axes, 0.0) / np.sqrt(np.where(real, values, 1.0))

    def projected(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows, x = integers(column, d, rules)
        c = deviations(x, n, sums)
        return rows, c, (c.astype(np.float64) / n) @ turn

    def seconds(column: pa.ListArray) -> np.ndarray | None:
        rows, _, white = projected(column)
        return np.append((white.T @ white).ravel(), white.sum(axis=0)) if len(rows) else None

    # Rows are centred, and so are their projections, but for what rounding leaves: that is taken off.
    total = _summed(only, len(values) * (len(values) + 1), seconds) / n
    means = total[len(values) ** 2 :]
    covariance = total[: len(values) ** 2].reshape(len(values), -1) - np.outer(means, means)
    error = float(np.abs(covariance - np.eye(len(values)))[np.ix_(real, real)].max(initial=0.0))
    explained = (values / trace if trace > 0 else np.zeros(len(values))).tolist()

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(values)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                rows, c, white = projected(part.column(1))
                exact = np.repeat(np.array(_squares(c), object), k)
                m = len(rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(np.repeat(rows, k))), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array(np.full(m * k, n), pa.int64()),
                        pa.array([v if v < 2**63 else None for v in exact], pa.int64()), pa.array(white.ravel(), pa.float64(), mask=np.tile(~real, m)), pa.array(explained * m, pa.float64()),
                        pa.array(np.full(m * k, error), pa.float64()), pa.array(exact.tolist(), pa.decimal128(38, 0)),
                    ],
                    names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_exact"],
                )

    return vectors.select(F.col(id_col).alias("id"), vec_col).mapInArrow(rows_of, schema).withColumnRenamed("id", id_col)


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
