"""Medians, clusters, islands, intervals, histograms and thresholds (AGG)."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptoria.operators.state import in_order


def upper_median(values: Column) -> Column:
    """The upper of the two middle values, not their mean; 0 of none."""
    s = F.array_sort(values)
    return F.coalesce(F.try_element_at(s, F.floor(F.size(s) / 2).cast("int") + 1), F.lit(0))


def gap_clusters(df: DataFrame, key: str, value: str, tolerance: float) -> DataFrame:
    """(key, cluster, n, center): a value joins the cluster below it if it is no more than the tolerance above its greatest."""
    w = Window.partitionBy(key).orderBy(value)
    gap = F.coalesce((F.col(value) - F.lag(value).over(w) > tolerance).cast("int"), F.lit(0))
    marked = df.withColumn("_gap", gap).withColumn("cluster", F.sum("_gap").over(w.rangeBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(key, "cluster").agg(F.count("*").alias("n"), F.avg(value).alias("center"))


def runs_with_holes(df: DataFrame, key: str, at: str, gap: int = 2, holes: float = 0.06, least: int = 1) -> DataFrame:
    """(key, first, last, filled): runs of positions, broken where more than gap are missing, with few holes in all."""
    w = Window.partitionBy(key).orderBy(at)
    new = F.coalesce((F.col(at) - F.lag(at).over(w) > gap + 1).cast("int"), F.lit(0))
    marked = df.select(key, at).distinct().withColumn("_new", new).withColumn("_run", F.sum("_new").over(w))
    found = marked.groupBy(key, "_run").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("filled")).drop("_run")
    length = F.col("last") - F.col("first") + 1
    return found.where((length >= least) & (length - F.col("filled") <= holes * length))


def merged_intervals(df: DataFrame, key: str, start: str, end: str, gap: float = 0) -> DataFrame:
    """(key, first, last, n): intervals of a key that overlap or are no more than gap apart, as one."""
    w = Window.partitionBy(key).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("_new", F.coalesce((F.col(start) > before + gap).cast("int"), F.lit(0))).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(key, "_run").agg(F.min(start).alias("first"), F.max(end).alias("last"), F.count("*").alias("n")).drop("_run")


def gutters(words: DataFrame, page: str, x0: str, x1: str) -> DataFrame:
    """(page, first, last): stretches of x, within what a page's words cover, that at most a few of them cross.

    How many may cross depends on their number: a tenth from 8 on, one from 4 on, else none.
    """
    events = words.select(page, F.col(x0).alias("x"), F.lit(1).alias("d")).union(words.select(page, F.col(x1).alias("x"), F.lit(-1).alias("d")))
    steps = events.groupBy(page, "x").agg(F.sum("d").alias("d"))
    w = Window.partitionBy(page).orderBy("x")
    cover = steps.withColumn("cover", F.sum("d").over(w)).withColumn("to", F.lead("x").over(w)).where("to IS NOT NULL")
    n = words.groupBy(page).agg(F.count("*").alias("n"))
    most = F.when(F.col("n") >= 8, F.floor(F.col("n") * 0.1)).when(F.col("n") >= 4, 1).otherwise(0)
    low = cover.join(n, page).where(F.col("cover") <= most)
    new = F.coalesce((F.col("x") > F.lag("to").over(w)).cast("int"), F.lit(0))
    marked = low.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w))
    return marked.groupBy(page, "_run").agg(F.min("x").alias("first"), F.max("to").alias("last")).drop("_run")


def histogram(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, v, n, upto, total): counts by value, running and in all."""
    h = df.groupBy(key, F.col(value).alias("v")).agg(F.count("*").alias("n"))
    return h.withColumn("upto", F.sum("n").over(Window.partitionBy(key).orderBy("v"))).withColumn("total", F.sum("n").over(Window.partitionBy(key)))


def levels(df: DataFrame, key: str, value: str, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """(key, mean, p_low, p_high): each level is the largest value with less than that share at or below it; 0 and 255 if none."""
    h = histogram(df, key, value)
    cut = lambda p, none: F.coalesce(F.max(F.when(F.col("upto") < F.col("total") * p, F.col("v"))), F.lit(none))
    return h.groupBy(key).agg((F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("mean"), cut(low, 0).alias("p_low"), cut(high, 255).alias("p_high"))


def otsu(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, threshold, apart): the least threshold that separates best, and how far the two means are apart."""
    h = histogram(df, key, value)
    w = Window.partitionBy(key).orderBy("v")
    s = h.withColumn("sum", F.sum(F.col("v") * F.col("n")).over(w)).withColumn("all", F.sum(F.col("v") * F.col("n")).over(Window.partitionBy(key)))
    back, fore = F.col("upto"), F.col("total") - F.col("upto")
    apart = (F.col("all") - F.col("sum")) / fore - F.col("sum") / back
    s = s.where(fore > 0).withColumn("apart", apart).withColumn("score", back.cast("double") * fore * apart * apart)
    best = F.max(F.struct("score", (-F.col("v")).alias("least"), "apart"))
    return s.groupBy(key).agg(best.alias("b")).select(key, (-F.col("b.least")).alias("threshold"), F.col("b.apart").alias("apart"))


def laplacian_variance(pixels: DataFrame, key: str) -> DataFrame:
    """(key, blur, std): of pixels (y, x, v); blur is the variance of the Laplacian inside, std of all values."""
    across, down = Window.partitionBy(key, "y").orderBy("x"), Window.partitionBy(key, "x").orderBy("y")
    side = lambda f, w: f("v").over(w)
    lap = side(F.lag, across) + side(F.lead, across) + side(F.lag, down) + side(F.lead, down) - 4 * F.col("v")
    each = pixels.withColumn("lap", lap)
    return each.groupBy(key).agg((F.avg(F.col("lap") * F.col("lap")) - F.avg("lap") * F.avg("lap")).alias("blur"), F.stddev_pop("v").alias("std"))


def darkest_column(pixels: DataFrame, key: str, near: float = 0.2) -> DataFrame:
    """(key, spine, mean): of pixels (x, y, v) the column with the least mean, no farther from the centre than that share of the width; of equal ones the most central."""
    columns, all_of = pixels.groupBy(key, "x").agg(F.avg("v").alias("mean")), Window.partitionBy(key)
    low, high = F.min("x").over(all_of), F.max("x").over(all_of)
    columns = columns.select(key, "x", "mean", F.abs(2 * F.col("x") - low - high).alias("off"), (high - low + 1).alias("width"))
    best = F.min(F.struct("mean", "off", "x")).alias("b")
    return columns.where(F.col("off") <= 2 * near * F.col("width")).groupBy(key).agg(best).select(key, F.col("b.x").alias("spine"), F.col("b.mean").alias("mean"))


def greedy_pages(rows: DataFrame, key: str, order: list[str], height: str, room: float, header: float = 0.0) -> DataFrame:
    """(key, *order, page): rows fill pages in order; each page repeats a header. A row that is too tall gets its own page.

    A page's fill depends on all rows before it, so a key's rows are taken in order.
    """

    def fold(held: Iterator[dict]) -> Iterator[dict]:
        page, full = 1, None
        for r in held:
            h = r.pop("_h")
            if full is not None and full + h > room + 0.5:
                page, full = page + 1, None
            full = (header if full is None else full) + h
            yield {**r, "page": page}

    kinds = dict(rows.dtypes)
    given = rows.select(key, *order, F.col(height).cast("double").alias("_h"))
    return in_order(given, key, [*order, "_h"], fold, ", ".join(f"{c} {kinds[c]}" for c in (key, *order)) + ", page int")


def column_width(text: Column) -> Column:
    """Of a cell: its longest line and two more, from 6 to 60."""
    return F.least(F.lit(60), F.greatest(F.lit(6), F.array_max(F.transform(F.split(text, "\n"), F.length)) + 2))
