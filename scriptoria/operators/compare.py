"""Ordered comparison of two texts: what leaves and what comes, line by line, so that applying it gives the other text (SET-6)."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EDIT = "struct<at:int,gone:int,come:array<string>>"


def _rising(values: list[int]) -> list[int]:
    """Places of a longest rising subsequence."""
    ends: list[int] = []
    tails: list[int] = []
    before = [-1] * len(values)
    for k, v in enumerate(values):
        at = bisect_left(tails, v)
        before[k] = ends[at - 1] if at else -1
        if at == len(tails):
            tails.append(v)
            ends.append(k)
        else:
            tails[at], ends[at] = v, k
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(k)
        k = before[k]
    return out[::-1]


def _common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence."""
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def matched(a: list[str], b: list[str], cells: int = 250_000) -> list[tuple[int, int]]:
    """Places of lines that both have in the same order, once equal ends are off: a longest common subsequence where a table of
    so many cells holds it; in larger parts lines that stand once on either side, in their longest common order, part them."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, m, j, n = todo.pop()
        while i < m and j < n and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < m and j < n and a[m - 1] == b[n - 1]:
            m, n = m - 1, n - 1
            out.append((m, n))
        if i == m or j == n:
            continue
        if (m - i) * (n - j) <= cells:
            out += [(i + x, j + y) for x, y in _common(a[i:m], b[j:n])]
            continue
        once = Counter(a[i:m])
        there = Counter(b[j:n])
        at = {x: k for k, x in enumerate(b[j:n], j) if there[x] == 1}
        unique = [(k, at[x]) for k, x in enumerate(a[i:m], i) if once[x] == 1 and x in at]
        anchors = [unique[k] for k in _rising([y for _, y in unique])]
        # A large part without such lines is changed as a whole.
        for (p, q), (r, s) in zip([(i - 1, j - 1), *anchors], [*anchors, (m, n)], strict=True):
            if anchors:
                todo.append((p + 1, r, q + 1, s))
        out += anchors
    return sorted(set(out))


def edits(a: list[str], b: list[str]) -> list[dict]:
    """What turns a into b: at line `at` of a, `gone` lines leave and the lines `come` take their place."""
    out, i, j = [], 0, 0
    for p, q in [*matched(a, b), (len(a), len(b))]:
        if p > i or q > j:
            out.append({"at": i, "gone": p - i, "come": b[j:q]})
        i, j = p + 1, q + 1
    return out


def text_edits(pairs: DataFrame, keys: list[str], old: str, new: str) -> DataFrame:
    """(*keys, edits: array of EDIT) of pairs of texts; a null text has no lines. One pair is held at a time."""
    kinds = dict(pairs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("at", pa.int32()), ("gone", pa.int32()), ("come", pa.list_(pa.string()))]))
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                lines = [(x.as_py() or "").split("\n") if x.is_valid else [] for x in (one.column(len(keys))[0], one.column(len(keys) + 1)[0])]
                yield pa.RecordBatch.from_arrays([*one.columns[: len(keys)], pa.array([edits(*lines)], kind)], names=[*keys, "edits"])

    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), f"edits array<{EDIT}>"])
    return pairs.select(*keys, old, new).mapInArrow(run, schema)


def applied(old: Column, changes: Column) -> Column:
    """The new text: lines of the old one that no edit takes, with those that come between them."""
    lines = F.when(old.isNull(), F.array().cast("array<string>")).otherwise(F.split(old, "\n", -1))
    none = F.array().cast("array<string>")

    def built(kept_lines: Column) -> Column:
        last = F.array(F.named_struct(F.lit("at"), F.size(kept_lines), F.lit("gone"), F.lit(0), F.lit("come"), none))
        every = F.concat(changes, last)
        starts = F.concat(F.array(F.lit(0)), F.transform(changes, lambda e: e["at"] + e["gone"]))
        return F.flatten(F.zip_with(starts, every, lambda s, e: F.concat(F.slice(kept_lines, s + 1, e["at"] - s), e["come"])))

    # An array of one binds the lines, so that they are split once.
    return F.array_join(F.element_at(F.transform(F.array(lines), built), 1), "\n")
