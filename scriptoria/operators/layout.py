"""Positioned words to lines, phrases, columns and typed tables; grids from rules; merged cells of files (LAY, XL, AGG-3, 11 to 14).

A page is the unit of work: its words are few, and what happens to one depends on those before it, so each page is one
group of a grouped map. A word is (page, t, x0, y0, x1, y1, b, conf).
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptoria.functions.values import cell_range, typed
from scriptoria.operators import flat_layout
from scriptoria.operators.geometry import bound
from scriptoria.operators.state import dealt

WORD = "page long, t string, x0 double, y0 double, x1 double, y1 double, b boolean, conf double"


def usable_words(words: DataFrame) -> DataFrame:
    """Without words read with little confidence, and without those that are rules read as text."""
    return words.where((F.coalesce("conf", F.lit(100.0)) >= 15) & ~F.col("t").rlike(r"^[|_\-–—=~]+$") & (F.trim("t") != ""))


def confidence(words: DataFrame) -> DataFrame:
    """(page, mean, doubtful): mean confidence, rounded, and how many words are below 70."""
    return words.groupBy("page").agg(F.floor(F.avg("conf") + 0.5).cast("long").alias("mean"), F.count_if(F.col("conf") < 70).alias("doubtful"))


def page_source(chars: Column, forced: Column) -> Column:
    """Pages are read by machine if that is asked for or they have fewer than 25 characters of text."""
    return F.when(forced | (chars < 25), "ocr").otherwise("text")


def lines_of(words: list[dict], near: float = 0.5) -> list[list[dict]]:
    """Words by vertical centre join the first line whose first word's centre is near; lines top down, words left to right."""
    if not words:
        return []
    heights = sorted(w["y1"] - w["y0"] for w in words)
    height = heights[len(heights) // 2] or 1.0
    found: list[tuple[float, list[dict]]] = []
    for w in sorted(words, key=lambda w: ((w["y0"] + w["y1"]) / 2, w["x0"])):
        center = (w["y0"] + w["y1"]) / 2
        for seed, line in found:
            if abs(center - seed) < near * height:
                line.append(w)
                break
        else:
            found.append((center, [w]))
    return [sorted(line, key=lambda w: w["x0"]) for _, line in sorted(found, key=lambda f: f[0])]


@dataclass(frozen=True)
class Measures:
    """What a page's words measure: height and width of a character, and from which gap words are apart in a table and in text."""

    height: float
    char: float
    gap: float
    wide: float
    pitch: float


def _middle(values: list[float]) -> float:
    """The upper median, 0 of none."""
    return sorted(values)[len(values) // 2] if values else 0.0


def center(line: list[dict]) -> float:
    """A line's height on the page is that of its first word from above."""
    return min((w["y0"] + w["y1"]) / 2 for w in line)


def measured(lines: list[list[dict]]) -> Measures:
    words = [w for line in lines for w in line]
    height = _middle([w["y1"] - w["y0"] for w in words]) or 10.0
    char = _middle([(w["x1"] - w["x0"]) / max(1, len(w["t"])) for w in words]) or height * 0.5
    gaps = sorted(b["x0"] - a["x1"] for line in lines for a, b in pairwise(line) if b["x0"] > a["x1"])
    space = gaps[int(0.3 * len(gaps))] if gaps else char * 0.5
    pitch = _middle([center(b) - center(a) for a, b in pairwise(lines)]) or height * 1.4
    return Measures(height, char, max(space * 1.8, char * 0.75), max(char * 2.4, height * 0.9), pitch)


def phrases_of(line: list[dict], gap: float, height: float) -> list[dict]:
    """Neighbouring words without a wide gap between them as one, bold if all are; tall words allow wider gaps."""
    out: list[dict] = []
    for w in line:
        near = out and w["x0"] - out[-1]["x1"] < gap * max(1.0, (w["y1"] - w["y0"]) / height)
        if near:
            p = out[-1]
            out[-1] = {"words": [*p["words"], w], "x0": p["x0"], "x1": max(p["x1"], w["x1"]), "b": p["b"] and bool(w["b"])}
        else:
            out.append({"words": [w], "x0": w["x0"], "x1": w["x1"], "b": bool(w["b"])})
    return out


def _said(words: list[dict]) -> str:
    return " ".join(w["t"] for w in words)


def blocks_of(lines: list[list[dict]], phrases: list[list[dict]], m: Measures) -> list[tuple[bool, list[int]]]:
    """Runs of line numbers, each a table or a line of text.

    A table begins with a line of two phrases. It ends at a distance of 2.6 pitches, and at a line of one phrase, unless that
    one is close to the line above or a line of two phrases follows.
    """
    y, parted = [center(x) for x in lines], [len(p) >= 2 for p in phrases]
    far = [k > 0 and y[k] - y[k - 1] > 2.6 * m.pitch for k in range(len(lines))] + [True]
    out: list[tuple[bool, list[int]]] = []
    for k in range(len(lines)):
        close = k > 0 and y[k] - y[k - 1] < 1.9 * m.height
        leads = k + 1 < len(lines) and parted[k + 1] and y[k + 1] - y[k] < 2.6 * m.pitch
        if out and out[-1][0] and not far[k] and (parted[k] or close or leads):
            out[-1][1].append(k)
        else:
            out.append((parted[k], [k]))
    return out


def _stretches(free: np.ndarray) -> list[tuple[int, int]]:
    """First and last place of each run of true."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], free, [False]]).astype(np.int8)))
    return [(int(a), int(b) - 1) for a, b in zip(edges[::2], edges[1::2], strict=True)]


def _covered(spans: list[tuple[float, float]], left: int, width: int) -> np.ndarray:
    """How many spans lie over each pixel from left on."""
    ends = np.zeros(width + 1, np.int64)
    for x0, x1 in spans:
        ends[max(0, math.floor(x0) - left)] += 1
        ends[min(width, math.ceil(x1) - left + 1)] -= 1
    return np.cumsum(ends)[:width]


def gutters_of(phrases: list[list[dict]], m: Measures) -> list[tuple[int, int]]:
    """Pixels between columns, from and to: where few phrases lie.

    What lies in such a stretch must cross it whole, as a title does. If something ends in it, a sparse column does; then
    those parts are gutters in which nothing lies.
    """
    every = [(p["x0"], p["x1"]) for line in phrases for p in line]
    left, right = math.floor(min(x for x, _ in every)), math.ceil(max(x for _, x in every))
    over, n = _covered(every, left, right - left + 1), len(phrases)
    few, least = (n // 10 if n >= 8 else 1 if n >= 4 else 0), (1.0 if n >= 3 else 1.5 * m.char)
    out = []
    for a, b in _stretches(over <= few):
        if b - a + 1 < least:
            continue
        x, y = a + left, b + left
        if all(x0 < x - m.char and x1 > y + m.char for x0, x1 in every if x1 >= x and x0 <= y):
            out.append((x, y))
        else:
            out += [(c + x, d + x) for c, d in _stretches(over[a : b + 1] == 0) if d - c + 1 >= max(least, 0.6 * m.char)]
    return out


def cuts_of(phrases: list[list[dict]], gutters: list[tuple[int, int]]) -> list[float]:
    """The middle of each gutter's longest part on which no word lies."""
    words = [(w["x0"], w["x1"]) for line in phrases for p in line for w in p["words"]]
    out = []
    for a, b in gutters:
        empty = _stretches(_covered([s for s in words if s[1] >= a and s[0] <= b], a, b - a + 1) == 0)
        c, d = max(empty, key=lambda s: s[1] - s[0], default=(0, b - a))
        out.append(a + (c + d) / 2)
    return out


def _dealt(phrase: dict, cuts: list[float], early: bool) -> Iterator[tuple[int, list[dict]]]:
    """(column, words): the phrase whole if it lies in one column; by word if cuts fall between its words.

    A title whose words a cut would cut, bold or in one of the first two lines, goes whole where most of it lies.
    """
    first, last = bisect_left(cuts, phrase["x0"]), bisect_left(cuts, phrase["x1"])
    words = phrase["words"]
    if first == last:
        yield first, words
        return
    between = all(any(a["x1"] <= c <= b["x0"] for a, b in pairwise(words)) for c in cuts[first:last])
    if not between and (phrase["b"] or early):
        bounds = [-math.inf, *cuts, math.inf]
        share = lambda k: min(bounds[k + 1], phrase["x1"]) - max(bounds[k], phrase["x0"])
        yield max(range(first, last + 1), key=share), words
        return
    for w in words:
        yield bisect_left(cuts, (w["x0"] + w["x1"]) / 2), [w]


def cells_of(phrases: list[list[dict]], cuts: list[float]) -> list[list[list[dict]]]:
    """The words of each line's cells."""
    out = []
    for k, line in enumerate(phrases):
        cells: list[list[dict]] = [[] for _ in range(len(cuts) + 1)]
        for p in line:
            for column, words in _dealt(p, cuts, k < 2):
                cells[column] += words
        out.append(cells)
    return out


def row_starts(cells: list[list[list[dict]]], y: list[float], bands: list[float], height: float) -> list[bool]:
    """Which lines begin a row.

    With three rules or more across the block, lines between the same two are one row. Else the anchor tells: the column,
    of those filled in 35 % of lines, that is least often filled in two lines close to each other, then most often, then
    leftmost. A line without it goes on with the row above if it is nearer than lines with it use to be.
    """
    n = len(cells)
    if len(bands) >= 3:
        band = [bisect_left(bands, v) for v in y]
        return [k == 0 or band[k] != band[k - 1] for k in range(n)]
    full = [[bool(c) for c in line] for line in cells]
    near = [k > 0 and y[k] - y[k - 1] < 1.9 * height for k in range(n)]
    ranked = []
    for c in range(len(cells[0])):
        count = sum(f[c] for f in full)
        if count >= 0.35 * n:
            ranked.append((sum(full[k][c] and full[k - 1][c] and near[k] for k in range(1, n)), -count, c))
    if not ranked:
        return [True] * n
    anchor = min(ranked)[2]
    held = [y[k] for k in range(n) if full[k][anchor]]
    usual = _middle([b - a for a, b in pairwise(held)]) or 2 * height
    return [k == 0 or full[k][anchor] or y[k] - y[k - 1] >= min(0.85 * usual, 2 * height) for k in range(n)]


def table_of(lines: list[list[dict]], phrases: list[list[dict]], rules: list[dict], m: Measures) -> list[list[list[dict]]] | None:
    """Rows of cells, each its words, or None where there are no columns. rules: y, x0, x1 of horizontal ones."""
    gutters = gutters_of(phrases, m) if len(lines) >= 2 else []
    if not gutters:
        return None
    x0, x1 = min(p["x0"] for line in phrases for p in line), max(p["x1"] for line in phrases for p in line)
    reach = 0.25 * (math.ceil(x1) - math.floor(x0))
    across = sorted(r["y"] for r in rules if r["x0"] <= math.floor(x0) + reach and r["x1"] >= math.ceil(x1) - reach)
    top, foot = min(w["y0"] for w in lines[0]) - m.height, max(w["y1"] for w in lines[-1]) + m.height
    cells = cells_of(phrases, cuts_of(phrases, gutters))
    rows: list[list[list[dict]]] = []
    starts = row_starts(cells, [center(x) for x in lines], [v for v in across if top < v < foot], m.height)
    for new, line in zip(starts, cells, strict=True):
        if new:
            rows.append([[] for _ in line])
        for have, more in zip(rows[-1], line, strict=True):
            have += more
    return rows


def blocks(words: list[dict], rules: list[dict]) -> Iterator[tuple[int, str, int, int, str, bool]]:
    """(block, kind, row, col, text, bold) of a page: cells of its tables, and lines of its texts."""
    lines = lines_of(words)
    if not lines:
        return
    m = measured(lines)
    phrases = [phrases_of(x, m.gap, m.height) for x in lines]
    number = 0
    for tabular, members in blocks_of(lines, phrases, m):
        rows = table_of([lines[k] for k in members], [phrases[k] for k in members], rules, m) if tabular else None
        if rows:
            for r, row in enumerate(rows):
                yield from ((number, "rows", r, c, _said(x), all(bool(w["b"]) for w in x)) for c, x in enumerate(row) if x)
            number += 1
            continue
        for k in members:
            text = "   ".join(_said(p["words"]) for p in phrases_of(lines[k], m.wide, m.height))
            yield number, "text", 0, 0, text, all(bool(w["b"]) for w in lines[k])
            number += 1


def _by_page(words: DataFrame, one, schema: str) -> DataFrame:
    """(page, …): one() of each page's words. Pages come one after the other in a sorted partition, each held alone."""
    names = ["page", *(x.split()[0] for x in schema.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records = (r for batch in batches for r in batch.to_pylist())
        out: list[tuple] = []
        for page, held in groupby(records, key=lambda r: r["page"]):
            out += [(page, *x) for x in one(list(held))]
            if len(out) >= 5000:
                yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*out, strict=True)), strict=True)), schema=made)
                out = []
        if out:
            yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*out, strict=True)), strict=True)), schema=made)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    made = to_arrow_schema(_parse_datatype_string(f"page long, {schema}"))
    return dealt(usable_words(words), "page").sortWithinPartitions("page", "y0", "x0").mapInArrow(run, f"page long, {schema}")


#: What a piece of a page holds beside its words' texts, six numbers a word, and of rules, three numbers each: few vectors, since Spark measures each after every row.
PLACE, RULE = ("x0", "y0", "x1", "y1", "b", "conf"), ("y", "x0", "x1")
#: A word that is a rule read as text, as rlike has it: a line end may follow.
DRAWN = r"^[|_\-–—=~]+(?:\r\n|[\n\r\x{85}\x{2028}\x{2029}])?$"
#: Pages wider than so many pixels are laid out one by one.
WIDEST = 100_000


def _by_whole_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The same rows, in tables that end where a page ends."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        page = batch.column("page")
        last = pc.equal(page, page[-1]).fill_null(False) if page[-1].is_valid else pc.is_null(page)
        others = np.flatnonzero(~last.to_numpy(zero_copy_only=False))
        cut = int(others[-1]) + 1 if len(others) else 0
        if held and (cut or held[-1].column("page")[-1] != page[-1]):
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        elif cut:
            yield pa.Table.from_batches([batch.slice(0, cut)])
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def _rows_of_pages(pieces: pa.Table) -> Iterator[list[pa.Array]]:
    """page, block, kind, row, cells, bold of whole pages (page, ts, places, rules)."""
    pieces = pieces.combine_chunks()
    column = lambda name: pieces.column(name).chunk(0)
    key = column("page")
    number = lambda v, null=np.nan: v.fill_null(null).to_numpy(zero_copy_only=False)
    of_piece = np.cumsum(flat_layout.changes(number(key, 0)) | flat_layout.changes(number(key.is_null(), False))) - 1
    lists, rules = column("ts"), column("rules")
    owner = np.repeat(of_piece, number(pc.list_value_length(lists), 0))
    rule_owner = np.repeat(of_piece, number(pc.list_value_length(rules), 0) // len(RULE))
    t, across = lists.flatten(), list(number(rules.flatten()).reshape(-1, len(RULE)).T)
    places = number(column("places").flatten()).reshape(-1, len(PLACE))
    usable = pc.and_(pc.not_equal(pc.utf8_trim(t, " "), ""), pc.invert(pc.match_substring_regex(t, DRAWN))).fill_null(False)
    usable = number(usable, False) & ~(places[:, 5] < 15)
    t, owner = t.filter(pa.array(usable)), owner[usable]
    if not len(t):
        return
    x0, y0, x1, y1, b, conf = places[usable].T
    b = b == 1
    odd = ~((x1 >= x0) & (y1 >= y0))
    page = np.cumsum(flat_layout.changes(owner)) - 1
    begin = np.flatnonzero(flat_layout.changes(owner))
    odd[begin] |= ~(np.maximum.reduceat(x1, begin) - np.minimum.reduceat(x0, begin) <= WIDEST)
    alone = np.logical_or.reduceat(odd, begin)
    name = key.take(pa.array(np.searchsorted(of_piece, owner[begin])))
    most = ~alone[page]
    if most.any():
        kept = np.cumsum(~alone) - 1
        place = np.full(len(key) + 1, -1)
        place[owner[begin[~alone]]] = kept[~alone]
        own = place[rule_owner] >= 0
        some = t if most.all() else t.filter(pa.array(most))
        p, number_, table, row, cells, bold = flat_layout.rows_of(
            kept[page[most]], some, x0[most], y0[most], x1[most], y1[most], b[most], (place[rule_owner[own]], *(v[own] for v in across)), _dealt
        )
        yield [name.filter(pa.array(~alone)).take(pa.array(p)), pa.array(number_, pa.int32()), pa.array(np.where(table, "rows", "text")), pa.array(row, pa.int32()), cells, bold]
    for k in np.flatnonzero(alone):
        at = page == k
        held = [dict(zip(("t", *PLACE), w, strict=True)) for w in zip(t.filter(pa.array(at)).to_pylist(), *(v[at].tolist() for v in (x0, y0, x1, y1, b, conf)), strict=True)]
        held.sort(key=lambda w: (w["y0"], w["x0"]))
        drawn = [dict(zip(("y", "x0", "x1"), v, strict=True)) for v in zip(*(v[rule_owner == owner[begin[k]]].tolist() for v in across), strict=True)]
        for (block, kind, row), found in groupby(blocks(held, drawn), key=lambda x: x[:3]):
            own = {c: (text, bold) for *_, c, text, bold in found}
            filled = [own.get(c, (None, None)) for c in range(max(own) + 1)]
            yield [name[int(k) : int(k) + 1], *(pa.array([v]) for v in (block, kind, row, [x for x, _ in filled], [x for _, x in filled]))]


def page_rows(words: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """(page, block, kind, row, cells, bold): rows of each page's borderless tables (kind rows), cells and whether they are bold by column, null where empty; a line of text is one cell.

    words: one a row, or pieces of pages (page, ts, places, rules), any number a page: texts, six numbers for each (see PLACE;
    b is 1 if bold), three numbers for each rule (see RULE); pieces that lie by page already are not dealt anew. rules:
    horizontal rules (page, y, x0, x1), if there are any.
    """
    pieces, numbers = words, lambda names: F.array(*[F.col(c).cast("double") for c in names])
    empty = lambda of: F.array().cast(f"array<{of}>")
    if "ts" not in words.columns:
        pieces = words.select("page", F.array("t").alias("ts"), numbers(PLACE).alias("places"), empty("double").alias("rules"))
    # The window deals and sorts by page, each only where that is not so yet.
    if rules is None:
        pieces = pieces.select("page", "ts", "places", "rules", F.row_number().over(Window.partitionBy("page").orderBy("page")).alias("_k"))
    else:
        drawn = rules.select("page", empty("string").alias("ts"), empty("double").alias("places"), numbers(RULE).alias("rules"))
        pieces = dealt(pieces.unionByName(drawn), "page", mixed=True).sortWithinPartitions("page")
    schema = "page long, block int, kind string, row int, cells array<string>, bold array<boolean>"

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    made = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _by_whole_pages(batches):
            for columns in _rows_of_pages(table):
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, made, strict=True)], schema=made)

    return pieces.mapInArrow(run, schema)


def page_blocks(words: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """(page, block, kind, row, col, text, b): filled cells of page_rows, one a row."""
    cells = page_rows(words, rules).select("page", "block", "kind", "row", F.posexplode(F.arrays_zip("cells", "bold")).alias("col", "z"))
    return cells.where("z.cells IS NOT NULL").select("page", "block", "kind", "row", "col", F.col("z.cells").alias("text"), F.col("z.bold").alias("b"))


def page_tables(words: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """(page, block, row, col, text, v): typed cells; a line of text is a row of one cell."""
    return page_blocks(words, rules).select("page", "block", "row", "col", "text", typed(F.col("text")).alias("v"))


def page_lines(words: DataFrame) -> DataFrame:
    """(page, line, text): the words of each line with blanks between."""

    return _by_page(words, lambda w: [(k, " ".join(x["t"] for x in line)) for k, line in enumerate(lines_of(w))], "line int, text string")


def paragraphs(lines: DataFrame) -> DataFrame:
    """(page, para, text) of lines (page, line, text, x0, x1, y0, b, right): a line goes on with the one before if that one
    reaches the right margin, ends no list head, is as bold and is near; hyphens at ends go."""
    w = Window.partitionBy("page").orderBy("line")
    before = lambda c: F.lag(c).over(w)
    pitch = F.percentile(F.col("y0") - F.col("_y"), 0.5).over(Window.partitionBy("page"))
    near = lines.withColumn("_y", before("y0")).withColumn("_pitch", pitch)
    goes_on = (F.col("y0") - F.col("_y") <= 1.35 * F.col("_pitch")) & (before("x1") >= F.col("right") * 0.88) & ~before("text").rlike(":$") & (before("b") == F.col("b"))
    marked = near.withColumn("_new", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).withColumn("para", F.sum("_new").over(w))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n")
    return marked.groupBy("page", "para").agg(F.regexp_replace(F.regexp_replace(joined, r"(\p{L})-\n(\p{L})", "$1$2"), "\n", " ").alias("text"))


def _upper_median(values: Column) -> Column:
    """Of an array, nulls apart: the value whose rank is half their number, rounded down, from 0."""
    return bound(F.sort_array(F.filter(values, lambda v: v.isNotNull())), lambda vs: F.get(vs, F.floor(F.size(vs) / 2).cast("int")))


def _record(**fields: Column) -> Column:
    """A struct by names; inside nested lambdas F.struct loses those of aliases."""
    return F.named_struct(*[x for name, value in fields.items() for x in (F.lit(name), value)])


#: What styled paragraphs need of a line; page and line tell its place.
STYLED = ("line", "text", "x0", "x1", "y0", "h", "b", "width")


def styled_paragraphs(lines: DataFrame) -> DataFrame:
    """(page, para, tag, align, bold, interline, text) of text lines (page, line, text, x0, x1, y0, h, b, width) (TXT-5, AGG-28).

    Lines are centred, right or left by where they lie in what the page's lines cover. A line goes on with the one before if
    both are left, no headings and as bold, it is near, and that one reaches the right margin and ends no list head. Letters
    1.3, 1.4 and 1.75 times as high as most make headings of level 3, 2 and 1. A paragraph all of whose lines but the last
    reach the margin is justified. Hyphens at ends go. interline: of the page, from pitch and height, 1 to 2.4. Lines without
    text or place are left out.
    """
    return styled_pages(lines.groupBy("page").agg(F.collect_list(F.struct(*STYLED)).alias("lines")))


def styled_pages(pages: DataFrame) -> DataFrame:
    """styled_paragraphs of whole pages (page, lines: array of structs as STYLED has them): each row by itself, nothing is shuffled or sorted."""
    given = F.filter("lines", lambda x: x["text"].isNotNull() & x["x0"].isNotNull() & x["x1"].isNotNull() & x["y0"].isNotNull())
    own = F.sort_array(F.transform(given, lambda x: _record(**{c: x[c] for c in STYLED})))
    each = lambda ls, c: F.transform(ls, lambda x: x[c])

    def page(ls: Column) -> Column:
        gaps = F.transform(ls, lambda x, i: x["y0"] - F.get(ls, i - 1)["y0"])
        high = F.coalesce(_upper_median(F.filter(each(ls, "h"), lambda h: h > 0)), F.lit(12.0))
        return bound(_record(gaps=gaps, h=high, l=F.array_min(each(ls, "x0")), r=F.array_max(each(ls, "x1"))), lambda z: bound(_record(pitch=_upper_median(z["gaps"]), cover=F.greatest(z["r"] - z["l"], F.lit(1.0))), lambda y: marked(ls, z, y)))

    def marked(ls: Column, z: Column, y: Column) -> Column:
        pitch, cover = F.when(y["pitch"] != 0, y["pitch"]).otherwise(z["h"] * 1.5), y["cover"]

        def line(x: Column, i: Column) -> Column:
            centred = (x["x1"] - x["x0"] < cover * 0.85) & (F.abs((x["x0"] + x["x1"] - z["l"] - z["r"]) / 2) < x["width"] * 0.035) & (x["x0"] > z["l"] + x["width"] * 0.04)
            right = (x["x0"] > z["l"] + cover * 0.35) & (z["r"] - x["x1"] < x["width"] * 0.03)
            high = F.coalesce(F.when(x["h"] > 0, x["h"]), z["h"]) / z["h"]
            align = F.when(centred, "center").when(right, "right").otherwise("left")
            return _record(line=x["line"], text=x["text"], b=x["b"], align=align, head=F.when(high >= 1.3, high).otherwise(F.lit(0.0)), short=z["r"] - x["x1"], gap=F.get(z["gaps"], i))

        return bound(F.transform(ls, line), lambda a: bound(starts(a, pitch, cover), lambda at: _record(pitch=pitch, cover=cover, h=z["h"], paras=parts(a, at))))

    def starts(a: Column, pitch: Column, cover: Column) -> Column:
        def new(i: Column) -> Column:
            x, before = F.get(a, i), F.get(a, i - 1)
            # Inside a paragraph all lines are left, no headings and as bold, so the line before tells of the paragraph.
            alike = (x["align"] == "left") & (before["align"] == "left") & (x["head"] == 0) & (before["head"] == 0) & x["b"].eqNullSafe(before["b"])
            goes_on = alike & (x["gap"] <= pitch * 1.35) & (before["short"] < cover * 0.12) & ~F.rtrim(before["text"]).endswith(":")
            return (i == 0) | ~F.coalesce(goes_on, F.lit(False))

        return F.filter(F.sequence(F.lit(0), F.size(a) - 1), new)

    def parts(a: Column, at: Column) -> Column:
        return F.transform(at, lambda s, k: F.slice(a, s + 1, F.coalesce(F.get(at, k + 1), F.size(a)) - s))

    laid = pages.select("page", own.alias("own")).where(F.size("own") > 0).select("page", bound(F.col("own"), page).alias("z"))
    paras = laid.select("page", F.col("z.pitch").alias("pitch"), F.col("z.cover").alias("cover"), F.col("z.h").alias("h"), F.posexplode("z.paras").alias("para", "p"))
    said = F.array_join(F.transform("p", lambda x: F.trim(F.regexp_replace(x["text"], r"\s{2,}", " "))), "\n")
    said = F.regexp_replace(F.regexp_replace(said, r"(?<=[A-Za-zÁÉÍÓÚÑáéíóúñ])-\n", ""), "\n", " ")
    last = F.element_at("p", -1)["line"]
    full = (F.size("p") > 1) & F.forall("p", lambda x: (x["line"] == last) | (x["short"] < F.col("cover") * 0.06))
    head, first = F.array_max(each(F.col("p"), "head")), F.element_at("p", 1)
    interline = F.greatest(F.lit(1.0), F.least(F.lit(2.4), F.floor(F.col("pitch") / (F.col("h") / 1.02) * 100 + 0.5) / 100))
    return paras.select(
        "page", F.col("para").cast("long").alias("para"), F.when(head > 1.75, "h1").when(head > 1.4, "h2").when(head > 0, "h3").otherwise("p").alias("tag"),
        F.when(full & (first["align"] == "left"), "justify").otherwise(first["align"]).alias("align"), F.coalesce(first["b"], F.lit(False)).alias("bold"), interline.alias("interline"), said.alias("text"),
    )


def vertical_merges(cells: DataFrame) -> DataFrame:
    """(sheet, c, r0, r1) from flags (sheet, r, c, flag) 'restart' and 'continue' down each column; what continues nothing is no merge."""
    w = Window.partitionBy("sheet", "c").orderBy("r")
    new = (F.coalesce("flag", F.lit("")) != "continue").cast("int")
    runs = cells.withColumn("_run", F.sum(new).over(w)).where("flag IS NOT NULL")
    return runs.groupBy("sheet", "c", "_run").agg(F.min("r").alias("r0"), F.max("r").alias("r1"), F.min_by("flag", "r").alias("_flag")).where("r1 > r0 AND _flag = 'restart'").drop("_run", "_flag")


def without_empty_rows(cells: DataFrame) -> DataFrame:
    """Cells (sheet, r, c, v) with rows closed up where all cells are empty."""
    full = cells.where(F.trim(F.coalesce("v", F.lit(""))) != "").select("sheet", "r").distinct()
    dense = full.withColumn("new_r", F.row_number().over(Window.partitionBy("sheet").orderBy("r")))
    return cells.join(dense, ["sheet", "r"]).select("sheet", F.col("new_r").alias("r"), "c", "v")


def used_range(cells: DataFrame, merges: DataFrame) -> DataFrame:
    """(sheet, r0, c0, r1, c1) that holds all cells and merges."""
    both = cells.select("sheet", F.col("r").alias("r0"), F.col("c").alias("c0"), F.col("r").alias("r1"), F.col("c").alias("c1")).unionByName(merges.select("sheet", "r0", "c0", "r1", "c1"))
    return both.groupBy("sheet").agg(F.min("r0").alias("r0"), F.min("c0").alias("c0"), F.max("r1").alias("r1"), F.max("c1").alias("c1"))


def merge_borders(cells: DataFrame, merges: DataFrame) -> DataFrame:
    """(sheet, r1, c1, right, bottom) of merges (sheet, r1, c1, r2, c2): borders of their last cells (sheet, r, c, right, bottom)."""
    last = cells.select("sheet", F.col("r").alias("r2"), F.col("c").alias("c2"), "right", "bottom")
    return merges.join(last, ["sheet", "r2", "c2"], "left").select("sheet", "r1", "c1", "right", "bottom")


def anchored(images: DataFrame, page_rows: DataFrame) -> DataFrame:
    """Images (sheet, at: rows from the top, from 0) with the page of (sheet, r, page, repeated) that has their row.

    Of a row that is repeated on every page only the first page shows them.
    """
    own = images.withColumn("r", F.floor("at") + 1).join(page_rows, ["sheet", "r"])
    return own.where(~(F.col("repeated") & (F.col("page") > 0)))


def pitch(lines: DataFrame, key: str, y: str) -> DataFrame:
    """(key, pitch): the upper median of distances between neighbouring lines, by rank, so that no group is collected."""
    from scriptoria.operators.aggregates import histogram

    gaps = lines.withColumn("_gap", F.col(y) - F.lag(y).over(Window.partitionBy(key).orderBy(y))).where("_gap IS NOT NULL")
    return histogram(gaps, key, "_gap").where(F.col("upto") > F.floor(F.col("total") / 2)).groupBy(key).agg(F.min("v").alias("pitch"))


def visible_cells(cells: DataFrame, hidden_rows: DataFrame, hidden_cols: DataFrame) -> DataFrame:
    """Cells that no hidden row (sheet, r) or column (sheet, c) has. What a sheet hides is sent to its cells as two sets, so cells that lie by sheet stay where they are."""
    found = cells
    for hidden, c in ((hidden_rows, "r"), (hidden_cols, "c")):
        sets = hidden.groupBy(F.col("sheet").alias("_of")).agg(F.collect_set(c).alias("_set"))
        found = found.join(sets, F.col("sheet") == F.col("_of"), "left").where(~F.coalesce(F.array_contains("_set", F.col(c)), F.lit(False))).drop("_of", "_set")
    return found


def shown_cells(cells: DataFrame, sheets: DataFrame, hidden_rows: DataFrame, hidden_cols: DataFrame) -> DataFrame:
    """Cells (sheet, r, c, …) of each sheet's area that no hidden row or column has.

    sheets: (sheet, asked, printed), ranges as A1 texts. A range that is asked for beats the print area, and that the used
    range; a text that is no range counts as none. A sheet that sheets lacks shows its used range.
    """
    w = Window.partitionBy("sheet")
    used = F.struct(*[f(c).over(w).alias(n) for f, c, n in ((F.min, "r", "r1"), (F.min, "c", "c1"), (F.max, "r", "r2"), (F.max, "c", "c2"))])
    named = sheets.select(F.col("sheet").alias("_sheet"), F.coalesce(cell_range(F.col("asked")), cell_range(F.col("printed"))).alias("_named"))
    each = cells.where("sheet IS NOT NULL").withColumn("_used", used).join(named, F.col("sheet") == F.col("_sheet"), "left").withColumn("_area", F.coalesce("_named", "_used"))
    inside = F.col("r").between(F.col("_area.r1"), F.col("_area.r2")) & F.col("c").between(F.col("_area.c1"), F.col("_area.c2"))
    return visible_cells(each.where(inside).drop("_used", "_sheet", "_named", "_area"), hidden_rows, hidden_cols)


def fit_scale(width: Column, height: Column, room_w: Column, room_h: Column, mode: Column) -> Column:
    """Scale of a sheet on a page: by width or page, or a percentage of at least 10; never enlarged."""
    one = F.lit(1.0)
    return F.when(mode == "width", F.least(one, room_w / width)).when(mode == "page", F.least(one, room_w / width, room_h / height)).otherwise(F.greatest(F.lit(0.1), F.least(one, mode.try_cast("double") / 100)))
