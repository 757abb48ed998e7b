"""Borderless tables of many pages at once: what scriptoria.operators.layout says of one page, as array operations over a batch of pages.

Words lie in flat arrays, sorted by page, line and place; lines, phrases, blocks, gutters and rows are runs of them. Texts
stay in Arrow and are joined there. Only phrases that a cut crosses, and lines whose heights overlap in a chain, are taken
one by one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def upper_medians(values: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """The upper median of each of n groups, 0 of none."""
    return at_share(values, of, n, lambda count: count // 2)


def at_share(values: np.ndarray, of: np.ndarray, n: int, place) -> np.ndarray:
    """Of each of n groups the value at place(count) in order, 0 of none."""
    count = np.bincount(of, minlength=n)
    have = count > 0
    out = np.zeros(n)
    out[have] = values[np.lexsort((values, of))][(np.cumsum(count) - count + place(count))[have]]
    return out


def changes(of: np.ndarray) -> np.ndarray:
    """Where another group begins."""
    out = np.ones(len(of), bool)
    out[1:] = of[1:] != of[:-1]
    return out


def ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of each, so many, one after the other."""
    return np.arange(count.sum()) + np.repeat(first - np.cumsum(count) + count, count)


def runs(free: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last place of each run of true."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], free, [False]]).astype(np.int8)))
    return edges[::2], edges[1::2] - 1


def before(values: np.ndarray) -> np.ndarray:
    return np.concatenate([values[:1], values[:-1]])


def line_breaks(center: np.ndarray, page: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """Where a line begins among words by page and centre: at a word too far from the line's first one."""
    first = changes(page) | (center - before(center) >= reach[page])
    begin = np.flatnonzero(first)
    end = np.append(begin[1:], len(first))
    for a, b in zip(*(x[center[end - 1] - center[begin] >= reach[page[begin]]] for x in (begin, end)), strict=True):
        seed = center[a]
        for k in range(a + 1, b):
            if center[k] - seed >= reach[page[a]]:
                first[k], seed = True, center[k]
    return first


def most_so_far(values: np.ndarray, line: np.ndarray) -> np.ndarray:
    """The largest value of the line up to each word."""
    out, longest, step = values.copy(), np.bincount(line).max(), 1
    while step < longest:
        out[step:] = np.where(line[step:] == line[:-step], np.maximum(out[step:], out[:-step]), out[step:])
        step *= 2
    return out


class Blocks:
    """Blocks of lines that may be tables, and their gutters and cuts on a row of pixels for each block."""

    def __init__(self, lines: np.ndarray, char: np.ndarray, block: np.ndarray, px0: np.ndarray, px1: np.ndarray, x0: np.ndarray, x1: np.ndarray, word_block: np.ndarray):
        """lines, char: of each block. block, px0, px1: of phrases, by block. x0, x1, word_block: of words."""
        n = len(lines)
        self.begin = np.flatnonzero(changes(block))
        self.count = np.bincount(block, minlength=n)
        self.x0, self.x1 = np.minimum.reduceat(px0, self.begin), np.maximum.reduceat(px1, self.begin)
        self.left = np.floor(self.x0).astype(np.int64)
        width = np.ceil(self.x1).astype(np.int64) - self.left + 2  # the last place is beyond the block
        self.base = np.cumsum(width) - width - self.left
        self.size = width.sum()
        of_pixel = np.repeat(np.arange(n), width)
        real = np.ones(self.size, bool)
        real[np.cumsum(width) - 1] = False
        over = self.covered(px0, px1, block)
        few = np.where(lines >= 8, lines // 10, np.where(lines >= 4, 1, 0))
        least = np.where(lines >= 3, 1.0, 1.5 * char)
        a, b = runs((over <= few[of_pixel]) & real)
        k = of_pixel[a]
        wide = b - a + 1 >= least[k]
        touched = np.cumsum(over > 0)
        mixed = wide & (touched[b] - touched[a] + (over[a] > 0) > 0)
        at = np.flatnonzero(mixed)
        ended = np.zeros(len(a), bool)
        if len(at):
            rep = self.count[k[at]]
            p, s = ranges(self.begin[k[at]], rep), np.repeat(at, rep)
            x, y, c = a[s] - self.base[k[s]], b[s] - self.base[k[s]], char[k[s]]
            bad = (px1[p] >= x) & (px0[p] <= y) & ~((px0[p] < x - c) & (px1[p] > y + c))
            ended[s[bad]] = True
        whole = wide & ~ended
        za, zb = runs((over == 0) & real) if ended.any() else (a[:0], b[:0])
        if len(za):
            inside = ended[np.searchsorted(a, za, "right") - 1] & (zb - za + 1 >= np.maximum(least, 0.6 * char)[of_pixel[za]])
            za, zb = za[inside], zb[inside]
        ga, gb = np.concatenate([a[whole], za]), np.concatenate([b[whole], zb])
        order = np.argsort(ga, kind="stable")
        ga, gb = ga[order], gb[order]
        self.gutter_block = of_pixel[ga]
        self.cuts_in = np.bincount(self.gutter_block, minlength=n)
        self.cuts = np.full((n, self.cuts_in.max(initial=0)), np.inf)
        if len(ga):
            self.cuts[self.gutter_block, np.arange(len(ga)) - (np.cumsum(self.cuts_in) - self.cuts_in)[self.gutter_block]] = self.middles(ga, gb, x0, x1, word_block)

    def covered(self, x0: np.ndarray, x1: np.ndarray, block: np.ndarray) -> np.ndarray:
        first, end = np.floor(x0).astype(np.int64) + self.base[block], np.ceil(x1).astype(np.int64) + self.base[block] + 1
        return np.cumsum(np.bincount(first, minlength=self.size + 1) - np.bincount(end, minlength=self.size + 1))[: self.size]

    def middles(self, ga: np.ndarray, gb: np.ndarray, x0: np.ndarray, x1: np.ndarray, block: np.ndarray) -> np.ndarray:
        """The middle of each gutter's longest part on which no word lies. A word that ends before the gutter's first pixel, or begins after its last, doesn't count."""
        low, high = np.floor(x0), np.ceil(x1)
        at = lambda place, some: np.bincount(place[some].astype(np.int64) + self.base[block[some]], minlength=self.size)
        ends, begins = at(high, x1 < high), at(low, x0 > low)
        width = gb - ga + 1
        pixel, gutter = ranges(ga, width), np.repeat(np.arange(len(ga)), width)
        over = self.covered(x0, x1, block)[pixel]
        first = np.cumsum(width) - width
        over[first] -= ends[ga]
        over[first + width - 1] -= begins[gb]
        free = over == 0
        new = free & (changes(gutter) | ~before(free))
        c = np.flatnonzero(new)
        n = np.bincount((np.cumsum(new) - 1)[free], minlength=len(c))
        order = np.lexsort((c, -n, gutter[c]))
        best = order[changes(gutter[c][order])]
        from_, to = np.zeros(len(ga), np.int64), width - 1
        from_[gutter[c[best]]] = c[best] - first[gutter[c[best]]]
        to[gutter[c[best]]] = from_[gutter[c[best]]] + n[best] - 1
        return ga - self.base[self.gutter_block] + (from_ + to) / 2

    def column(self, x: np.ndarray, block: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.int64)
        for k in range(self.cuts.shape[1]):
            out += self.cuts[block, k] < x
        return out


def bands_below(y: np.ndarray, of: np.ndarray, bands: np.ndarray, band_of: np.ndarray) -> np.ndarray:
    """How many bands of its own or an earlier group lie above each line; lines are in order."""
    tag = np.concatenate([np.zeros(len(y), bool), np.ones(len(bands), bool)])
    order = np.lexsort((tag, np.concatenate([y, bands]), np.concatenate([of, band_of])))
    return np.cumsum(tag[order])[~tag[order]]


def row_starts(full: np.ndarray, y: np.ndarray, block: np.ndarray, height: np.ndarray, bands: np.ndarray, band_of: np.ndarray) -> np.ndarray:
    """Which lines of tables begin a row, as in layout.row_starts. full: lines by columns. height: of each block."""
    n, first = len(height), changes(block)
    begin = np.flatnonzero(first)
    count = np.bincount(block, minlength=n)
    step = y - before(y)
    near = ~first & (step < 1.9 * height[block])
    filled = np.add.reduceat(full, begin, axis=0, dtype=np.int64)
    above = np.concatenate([full[:1], full[:-1]])
    wrapped = np.add.reduceat(full & above & near[:, None], begin, axis=0, dtype=np.int64)
    anchor, most, least = np.full(n, -1), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for c in range(full.shape[1]):
        better = (filled[:, c] >= 0.35 * count) & ((anchor < 0) | (wrapped[:, c] < least) | ((wrapped[:, c] == least) & (filled[:, c] > most)))
        anchor[better], least[better], most[better] = c, wrapped[better, c], filled[better, c]
    holds = full[np.arange(len(y)), anchor[block]] & (anchor[block] >= 0)
    held = np.flatnonzero(holds)
    same = ~changes(block[held])
    usual = upper_medians((y[held] - before(y[held]))[same], block[held][same], n)
    usual = np.where(usual == 0, 2 * height, usual)
    starts = first | holds | (step >= np.minimum(0.85 * usual, 2 * height)[block]) | (anchor < 0)[block]
    ruled = np.bincount(band_of, minlength=n) >= 3
    if ruled.any():
        band = bands_below(y, block, bands, band_of)
        starts = np.where(ruled[block], first | (band != before(band)), starts)
    return starts


def rows_of(page: np.ndarray, t: pa.Array, x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray, b: np.ndarray, rules: tuple, dealt) -> tuple:
    """Rows of tables and lines of text of pages 0, 1, ...: (page, block, tabular, row, cells, bold), the last two as lists by column.

    Every page has a word, and no word ends before it begins. rules: (page, y, x0, x1). dealt: layout's, for phrases that cuts cross.
    """
    n = page.max() + 1
    center, high = (y0 + y1) / 2, y1 - y0
    usual = upper_medians(high, page, n)
    order = np.lexsort((y0, x0, center, page))
    first = line_breaks(center[order], page[order], 0.5 * np.where(usual == 0, 1.0, usual))
    line = np.cumsum(first) - 1
    y, line_page = center[order][first], page[order][first]
    order = order[np.lexsort((x0[order], line))]
    page, x0, y0, x1, y1, b, high = (v[order] for v in (page, x0, y0, x1, y1, b, high))
    t = t.take(pa.array(order))
    # Measures of each page.
    height = np.where(usual == 0, 10.0, usual)
    char = upper_medians((x1 - x0) / np.maximum(1, pc.utf8_length(t).to_numpy(zero_copy_only=False)), page, n)
    char = np.where(char == 0, height * 0.5, char)
    inner = ~changes(line)
    gaps = x0 - before(x1)
    some = inner & (x0 > before(x1))
    with_gap = np.bincount(page[some], minlength=n) > 0
    space = np.where(with_gap, at_share(gaps[some], page[some], n, lambda c: (0.3 * c).astype(np.int64)), char * 0.5)
    top_line = changes(line_page)
    down = y - before(y)
    pitch = upper_medians(down[~top_line], line_page[~top_line], n)
    pitch = np.where(pitch == 0, height * 1.4, pitch)
    gap, wide = np.maximum(space * 1.8, char * 0.75), np.maximum(char * 2.4, height * 0.9)
    # Phrases, narrow for tables and wide for text.
    reached = most_so_far(x1, line)
    apart, tall = x0 - before(reached), np.maximum(1.0, high / height[page])
    new = ~inner | ~(apart < gap[page] * tall)
    far_apart = inner & ~(apart < wide[page] * tall)
    phrase = np.cumsum(new) - 1
    ph = np.flatnonzero(new)
    ph_end = np.append(ph[1:], len(new))
    px0, px1, pline, pbold = x0[ph], reached[ph_end - 1], line[ph], np.logical_and.reduceat(b, ph)
    # Blocks.
    parted = np.bincount(pline, minlength=len(y)) >= 2
    below = ~np.append(top_line[1:], True)
    leads = below & np.append(parted[1:], False) & (np.append(down[1:], 0.0) < 2.6 * pitch[line_page])
    goes_on = ~top_line & ~(down > 2.6 * pitch[line_page]) & (parted | (down < 1.9 * height[line_page]) | leads)
    number = np.arange(len(y))
    tabular = np.maximum.accumulate(np.where(parted, number, -1)) >= np.maximum.accumulate(np.where(goes_on, -1, number))
    block = np.cumsum(~(goes_on & before(tabular))) - 1
    begin = np.flatnonzero(changes(block))
    lines_in = np.bincount(block)
    # Tables: blocks of two lines or more with a gutter.
    maybe = tabular[begin] & (lines_in >= 2)
    table, column, columns = np.zeros(len(begin), bool), np.zeros(len(x0), np.int64), np.ones(len(begin), np.int64)
    starts = np.ones(len(y), bool)
    if maybe.any():
        own = np.cumsum(maybe) - 1
        own_page = line_page[begin[maybe]]
        pm, wm = maybe[block[pline]], maybe[block[line]]
        found = Blocks(lines_in[maybe], char[own_page], own[block[pline[pm]]], px0[pm], px1[pm], x0[wm], x1[wm], own[block[line[wm]]])
        table[maybe] = found.cuts_in > 0
        columns[maybe] = found.cuts_in + 1
        p = np.flatnonzero(table[block[pline]])
        of = own[block[pline[p]]]
        left, right = found.column(px0[p], of), found.column(px1[p], of)
        column = np.zeros(len(ph), np.int64)
        column[p] = left
        column = column[phrase]
        for k in np.flatnonzero(left != right):
            at, where = p[k], of[k]
            words = [{"x0": float(x0[w]), "x1": float(x1[w]), "at": w} for w in range(ph[at], ph_end[at])]
            early = pline[at] - begin[block[pline[at]]] < 2
            cuts = found.cuts[where, : found.cuts_in[where]].tolist()
            for c, part in dealt({"x0": float(px0[at]), "x1": float(px1[at]), "b": bool(pbold[at]), "words": words}, cuts, early):
                for w in part:
                    column[w["at"]] = c
        if table.any():
            in_table = table[block]
            dense = np.cumsum(table) - 1
            own_of = own[np.flatnonzero(table)]
            tl = np.cumsum(in_table) - 1
            tw = in_table[line]
            full = np.zeros((in_table.sum(), columns.max()), bool)
            full[tl[line[tw]], column[tw]] = True
            bands = _across(rules, found, own_of, line_page[begin[table]], height, begin[table], lines_in[table], line, y0, y1)
            starts[in_table] = row_starts(full, y[in_table], dense[block[in_table]], height[line_page[begin[table]]], *bands)
    in_table = table[block]
    starts |= ~in_table
    row = np.cumsum(starts) - 1
    fresh = np.where(in_table, changes(block), True)
    head = np.flatnonzero(starts)
    counted = np.cumsum(fresh)
    first_line = np.flatnonzero(top_line)
    number = counted - np.repeat(counted[first_line], np.diff(np.append(first_line, len(y))))
    within = row - row[begin][block]
    # Cells, their texts joined.
    text_gap = far_apart & ~in_table[line]
    if text_gap.any():
        t = pc.binary_join_element_wise(pa.array(np.where(text_gap, "  ", "")), t, "")
    word_row = row[line]
    order = np.lexsort((column, word_row))
    word_row, column = word_row[order], column[order]
    cell = np.flatnonzero(changes(word_row) | changes(column))
    said = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(cell, len(order)), pa.int32()), t.take(pa.array(order))), " ")
    bold = np.logical_and.reduceat(b[order], cell)
    width = columns[block[head]] * in_table[head] + ~in_table[head]
    offsets = np.append(0, np.cumsum(width))
    place = np.full(offsets[-1], -1)
    place[offsets[word_row[cell]] + column[cell]] = np.arange(len(cell))
    pick = pa.array(place, mask=place < 0)
    as_list = lambda values: pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values.take(pick))
    return line_page[head], number[head], in_table[head], np.where(in_table[head], within[head], 0), as_list(said), as_list(pa.array(bold))


def _across(rules: tuple, found: Blocks, own: np.ndarray, page: np.ndarray, height: np.ndarray, begin: np.ndarray, lines: np.ndarray, line: np.ndarray, y0: np.ndarray, y1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(y, table) of rules that reach across a table and lie in its height."""
    rule_page, ry, rx0, rx1 = rules
    if not len(rule_page):
        return np.zeros(0), np.zeros(0, np.int64)
    order = np.argsort(rule_page, kind="stable")
    rule_page, ry, rx0, rx1 = (v[order] for v in (rule_page, ry, rx0, rx1))
    from_, to = np.searchsorted(rule_page, page), np.searchsorted(rule_page, page, "right")
    r, k = ranges(from_, to - from_), np.repeat(np.arange(len(page)), to - from_)
    left, right = np.floor(found.x0[own]), np.ceil(found.x1[own])
    reach = 0.25 * (right - left)
    word = np.flatnonzero(changes(line))
    least, most = np.minimum.reduceat(y0, word), np.maximum.reduceat(y1, word)
    top, foot = least[begin] - height[page], most[begin + lines - 1] + height[page]
    good = (rx0[r] <= (left + reach)[k]) & (rx1[r] >= (right - reach)[k]) & (top[k] < ry[r]) & (ry[r] < foot[k])
    return ry[r][good], k[good]
