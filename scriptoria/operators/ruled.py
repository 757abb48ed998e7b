"""Tables with ruled lines: rules in page images, grids of cells from rules, words in their cells (LAY-1 to 4 and 8, AGG-6, 15 to 18).

Dark runs are found line by line in each image; all that follows are joins, windows and components over the runs, rules and
words of all pages: runs of neighbouring lines that overlap become rules, rules that cross become grids, cells without a
border between them become one, and words are found by the rows and columns that hold their centres.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptoria.operators.algebra import crossings
from scriptoria.operators.corpus import components, kept
from scriptoria.operators.layout import lines_of
from scriptoria.operators.state import in_order

NEAR = 6  # pixels within which rules meet, and coordinates are one


def paper_level(g: np.ndarray) -> int:
    """Of every seventh pixel the brightest level that half of them reach."""
    n = np.bincount(g.ravel()[::7], minlength=256)
    reached = np.cumsum(n[::-1])
    return int(255 - np.searchsorted(reached, 0.5 * reached[-1]))


def dark_mask(g: np.ndarray, boxes: np.ndarray | None = None) -> np.ndarray:
    """Pixels darker than paper. Where words are known (x0, y0, x1, y1), they are wiped and fainter lines count."""
    paper = paper_level(g)
    mask = g < (min(170, paper - 60) if boxes is None else max(paper - 110, paper - 16))
    for x0, y0, x1, y1 in boxes if boxes is not None else ():
        mask[max(0, int(np.floor(y0))) : int(np.ceil(y1)) + 1, max(0, int(np.floor(x0))) : int(np.ceil(x1)) + 1] = False
    return mask


def runs(mask: np.ndarray, least: float) -> np.ndarray:
    """(line, first, last) of runs of at least that length along each line; up to two pixels may be missing at a time, 6 % in all."""
    line, at = np.nonzero(mask)
    if not len(line):
        return np.zeros((0, 3), np.int64)
    first = np.flatnonzero(np.concatenate([[True], (np.diff(line) != 0) | (np.diff(at) > 3)]))
    last = np.append(first[1:], len(line)) - 1
    size = at[last] - at[first] + 1
    # Pixels looked at after the run's last one are missing ones, too.
    holes = size - (last - first + 1) + np.minimum(2, mask.shape[1] - 1 - at[last])
    ok = (size >= least) & (holes <= 0.06 * size)
    return np.stack([line[first], at[first], at[last]], axis=1)[ok]


def _named(df: DataFrame, name: str, *columns: str) -> DataFrame:
    """df with a name made of the columns."""
    return df.withColumn(name, F.concat_ws(":", *[F.col(c).cast("string") for c in columns]))


def _together(things: DataFrame, pairs: DataFrame, name: str, group: str) -> DataFrame:
    """things with the group of each: the smallest name among those it is joined to by pairs (a, b)."""
    found = components(pairs, "a", "b").select(F.col("node").alias("_node"), F.col("component").alias("_component"))
    return things.join(found, F.col(name) == F.col("_node"), "left").withColumn(group, F.coalesce("_component", name)).drop("_node", "_component")


def page_runs(images: DataFrame) -> DataFrame:
    """(page, down, thickest, line, a, b): dark runs of images (page, w, h, pixels), along lines and down columns."""
    names = ["page", "down", "thickest", "line", "a", "b"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for page, w, h, data in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                mask, thickest = dark_mask(np.frombuffer(data, np.uint8).reshape(h, w)), max(5, int(np.floor(min(w, h) * 0.006 + 0.5)))
                for down, m, least in ((False, mask, max(40, w * 0.05)), (True, mask.T, max(24, h * 0.018))):
                    found = runs(m, least)
                    n = len(found)
                    yield pa.RecordBatch.from_arrays([pa.array([page] * n, pa.int64()), pa.array([down] * n, pa.bool_()), pa.array([thickest] * n, pa.int32()), *(pa.array(found[:, k], pa.int64()) for k in range(3))], names=names)

    return images.select(F.col("page").cast("long"), "w", "h", "pixels").mapInArrow(run, "page long, down boolean, thickest int, line long, a long, b long")


def rules_of(found: DataFrame) -> DataFrame:
    """(page, down, pos, a, b, thick) of runs: those of neighbouring lines that overlap by more than 60 % of the shorter one are
    one rule, unless it gets too thick; rules on one line, up to 8 pixels apart, are one."""
    own = kept(_named(found, "id", "page", "down", "line", "a"))
    below = own.select("page", "down", (F.col("line") - 1).alias("line"), F.col("a").alias("a2"), F.col("b").alias("b2"), F.col("id").alias("id2"))
    overlap = F.least("b", "b2") - F.greatest("a", "a2") > 0.6 * F.least(F.col("b") - F.col("a"), F.col("b2") - F.col("a2"))
    pairs = own.join(below, ["page", "down", "line"]).where(overlap).select(F.col("id").alias("a"), F.col("id2").alias("b"))
    thick = (F.max("line") - F.min("line") + 1).cast("int")
    rules = _together(own, pairs, "id", "rule").groupBy("page", "down", "rule").agg(((F.min("line") + F.max("line")) / 2).alias("pos"), F.min("a").alias("a"), F.max("b").alias("b"), thick.alias("thick"), F.max("thickest").alias("most"))
    rules = kept(rules.where("thick <= most").select("page", "down", "rule", "pos", "a", "b", "thick"))
    # Positions up to 2 apart lie in one strip of 4 or in neighbouring ones.
    strip = lambda c: F.floor(c / 4)
    left = rules.withColumn("strip", F.explode(F.sequence(strip(F.col("pos") - 2), strip(F.col("pos") + 2))))
    right = rules.select("page", "down", strip(F.col("pos")).alias("strip"), *[F.col(c).alias(f"{c}2") for c in ("rule", "pos", "a", "b")])
    near = (F.col("rule") < F.col("rule2")) & (F.abs(F.col("pos") - F.col("pos2")) <= 2) & (F.col("a") <= F.col("b2") + 8) & (F.col("b") >= F.col("a2") - 8)
    pairs = left.join(right, ["page", "down", "strip"]).where(near).select(F.col("rule").alias("a"), F.col("rule2").alias("b"))
    first = F.struct("pos", "a")
    whole = _together(rules, pairs, "rule", "line").groupBy("page", "down", "line")
    return whole.agg(F.min_by("pos", first).alias("pos"), F.min("a").alias("a"), F.max("b").alias("b"), F.min_by("thick", first).alias("thick")).drop("line")


def page_rules(images: DataFrame) -> DataFrame:
    return rules_of(page_runs(images))


def grids_of(rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Grids (page, grid, label, xs, ys), numbered top down, and their rules (label, down, k, pos, a, b), k: which coordinate.

    Rules that meet belong together; a grid has two rules and two coordinates each way at least.
    """
    own = kept(_named(rules.select("page", "down", "pos", "a", "b"), "id", "page", "down", "pos", "a"))
    across = own.where(~F.col("down")).select("page", F.col("pos").alias("y"), F.col("a").alias("x0"), F.col("b").alias("x1"), F.col("id").alias("h"))
    upright = own.where("down").select("page", F.col("pos").alias("x"), F.col("a").alias("y0"), F.col("b").alias("y1"), F.col("id").alias("v"))
    pairs = crossings(across, upright, "page", NEAR).select(F.col("h").alias("a"), F.col("v").alias("b"))
    w = Window.partitionBy("label", "down").orderBy("pos")
    apart = F.coalesce((F.col("pos") - F.lag("pos").over(w) > NEAR).cast("int"), F.lit(0))
    members = kept(_together(own, pairs, "id", "label").withColumn("_new", apart).withColumn("k", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new", "id"))
    places = members.groupBy("page", "label", "down", "k").agg(F.avg("pos").alias("at"), F.count("*").alias("n"))
    side = lambda down: F.array_sort(F.collect_list(F.when(F.col("down") == down, F.col("at"))))
    grids = places.groupBy("page", "label").agg(side(True).alias("xs"), side(False).alias("ys")).where((F.size("xs") >= 2) & (F.size("ys") >= 2))
    number = F.row_number().over(Window.partitionBy("page").orderBy(F.element_at("ys", 1), "label")) - 1
    return grids.withColumn("grid", number), members.drop("page")


def _cells(grids: DataFrame, members: DataFrame) -> DataFrame:
    """(label, r, c, cell): each place of a grid with the cell it belongs to. Where a border is missing two places are one cell."""
    middle = lambda xs, k: (F.element_at(xs, k + 1) + F.element_at(xs, k + 2)) / 2
    each = grids.select("label", "xs", "ys", F.explode(F.sequence(F.lit(0), F.size("ys") - 2)).alias("r")).withColumn("c", F.explode(F.sequence(F.lit(0), F.size("xs") - 2)))
    each = kept(_named(each, "id", "label", "r", "c"))
    borders = []
    for down, at, other, lines in ((True, "c", "r", "xs"), (False, "r", "c", "ys")):
        inner = each.where(F.col(at) + 2 < F.size(lines)).select("label", "r", "c", "id", (F.col(at) + 1).cast("long").alias("k"), F.element_at(lines, F.col(at) + 2).alias("edge"), middle("ys" if down else "xs", F.col(other)).alias("mid"))
        drawn = members.where(F.col("down") == down).select(F.col("label").alias("of"), F.col("k").alias("line"), "pos", "a", "b")
        there = (F.col("label") == F.col("of")) & (F.col("k") == F.col("line")) & (F.abs(F.col("pos") - F.col("edge")) <= NEAR) & F.col("mid").between(F.col("a") - NEAR, F.col("b") + NEAR)
        beside = [F.col(x) + 1 if x == at else F.col(x) for x in ("r", "c")]
        borders.append(inner.join(drawn, there, "left_anti").select(F.col("id").alias("a"), F.concat_ws(":", "label", *[x.cast("string") for x in beside]).alias("b")))
    return _together(each.select("label", "r", "c", "id"), borders[0].union(borders[1]), "id", "cell")


def _intervals(grids: DataFrame, edges: str, number: str, low: str, high: str, strip: str) -> DataFrame:
    """Rows or columns of grids, put into each strip of 64 pixels that they touch."""
    each = grids.select("page", "grid", "label", F.posexplode(F.zip_with(F.slice(edges, 1, F.size(edges) - 1), F.slice(edges, 2, F.size(edges)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias(number, "x"))
    return each.select("page", "grid", "label", number, F.col("x.a").alias(low), F.col("x.b").alias(high)).withColumn(strip, F.explode(F.sequence(F.floor(F.col(low) / 64), F.floor(F.col(high) / 64))))


def _placed(words: DataFrame, grids: DataFrame) -> DataFrame:
    """words with label, r and c of the first grid that holds their centres."""
    middle = lambda a, b: (F.col(a) + F.col(b)) / 2
    own = words.select(F.col("page").cast("long").alias("page"), "t", "x0", "y0", "x1", "y1", "b", middle("x0", "x1").alias("cx"), middle("y0", "y1").alias("cy"))
    own = own.withColumn("sx", F.floor(F.col("cx") / 64)).withColumn("sy", F.floor(F.col("cy") / 64))
    within = lambda v, low, high: (F.col(v) >= F.col(low)) & (F.col(v) < F.col(high))
    hit = own.join(_intervals(grids, "ys", "r", "ya", "yb", "sy"), ["page", "sy"]).where(within("cy", "ya", "yb"))
    hit = hit.join(_intervals(grids, "xs", "c", "xa", "xb", "sx"), ["page", "grid", "label", "sx"]).where(within("cx", "xa", "xb"))
    first = Window.partitionBy("page", "t", "x0", "y0", "x1", "y1", "b").orderBy("grid")
    return hit.withColumn("_r", F.rank().over(first)).where("_r = 1").select("label", "r", "c", "t", "x0", "y0", "x1", "y1", "b")


def grid_cells(rules: DataFrame, words: DataFrame) -> DataFrame:
    """(page, grid, r1, c1, r2, c2, text, bold): cells with the words (page, t, x0, y0, x1, y1, b) whose centres they hold.

    Rows without text go, and merged cells close up with them.
    """
    grids, members = grids_of(rules)
    grids = kept(grids)
    places = kept(_cells(grids, members))
    boxes = places.groupBy("label", "cell").agg(F.min("r").alias("r1"), F.min("c").alias("c1"), F.max("r").alias("r2"), F.max("c").alias("c2"))

    def fold(rows: Iterator[dict]) -> Iterator[dict]:
        held = list(rows)  # a cell's words
        yield {"cell": held[0]["cell"], "text": "\n".join(" ".join(x["t"] for x in line) for line in lines_of(held, 0.55)), "bold": all(x["b"] for x in held)}

    said = in_order(_placed(words, grids).join(places, ["label", "r", "c"]).drop("id"), "cell", ["y0", "x0", "t"], fold, "cell string, text string, bold boolean")
    filled = boxes.join(said.withColumnRenamed("cell", "of"), F.col("cell") == F.col("of"), "left").drop("of")
    full = filled.where("text IS NOT NULL").groupBy("label").agg(F.array_sort(F.collect_set("r1")).alias("full"))
    rank = lambda c: F.size(F.filter("full", lambda x: x <= F.col(c))) - 1
    out = filled.join(full, "label").where(F.array_contains("full", F.col("r1"))).join(grids.select("label", "page", "grid"), "label")
    return out.select("page", "grid", rank("r1").alias("r1"), "c1", rank("r2").alias("r2"), "c2", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("bold", F.lit(False)).alias("bold"))


def recut(g: np.ndarray, tokens: int, x0: float, y0: float, x1: float, y1: float) -> list[tuple[int, int]] | None:
    """Where the tokens of one piece of text stand, by the widest gaps between ink; None unless each is wider than all others.

    Columns that are dark from top to bottom are rules, not ink.
    """
    h, w = g.shape
    left, right, top, bottom = max(0, int(np.floor(x0)) - 1), min(w - 1, int(np.ceil(x1)) + 1), max(0, int(np.floor(y0))), min(h - 1, int(np.ceil(y1)))
    height = bottom - top + 1
    if right - left < 2 or height < 3:
        return None
    dark = (g[top : bottom + 1, left : right + 1] < 200).sum(axis=0)
    ink = np.flatnonzero((dark > 0) & (dark < height * 0.92))
    if not len(ink):
        return None
    at = np.flatnonzero(np.diff(ink) > 1)
    gaps = sorted(((int(ink[k + 1] - ink[k] - 1), -int(ink[k])) for k in at), reverse=True)
    if len(gaps) < tokens - 1 or (len(gaps) > tokens - 1 > 0 and gaps[tokens - 2][0] <= gaps[tokens - 1][0]):
        return None
    cuts = sorted((-x, n) for n, x in gaps[: tokens - 1])
    starts = [int(ink[0]), *(x + n + 1 for x, n in cuts)]
    ends = [*(x for x, _ in cuts), int(ink[-1])]
    return [(left + a, left + b + 1) for a, b in zip(starts, ends, strict=True)]
