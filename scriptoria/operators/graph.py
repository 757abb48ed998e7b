"""Reachability with a bound, neighbours, and communities of weighted graphs (GR-4 to 6, AGG-21, 22)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptoria.operators.corpus import kept


def reachable(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """(start, node, steps): nodes that each start reaches over edges (src, dst) in at most so many steps, and in how few; a start reaches itself in none.

    Only what the last step found is joined to the edges, and only what is new goes on. Null nodes reach nothing.
    """
    ways = kept(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct())
    last = kept(starts.select(F.col("start"), F.col("start").alias("node"), F.lit(0).alias("steps")).where("start IS NOT NULL").distinct())
    found = last
    for step in range(1, depth + 1):
        ahead = last.join(ways, F.col("node") == F.col("src")).select("start", F.col("dst").alias("node")).distinct()
        last = kept(ahead.join(found.select("start", "node"), ["start", "node"], "left_anti").withColumn("steps", F.lit(step)))
        if last.isEmpty():
            break
        found = found.union(last)
    return found


def neighbours(e: DataFrame, key: str, most: int = 12) -> DataFrame:
    """(node, sends, cited): neighbours in both directions in text order, the first so many; nodes without any are left out.

    Neighbours are ranked within their node, so that only those that count are collected.
    """
    name = lambda c: F.concat_ws(":", F.col(key), F.col(c))
    pairs = e.select(name("src").alias("src"), name("dst").alias("dst"))
    both = pairs.select(F.col("src").alias("node"), F.lit(True).alias("out"), F.col("dst").alias("other")).union(pairs.select("dst", F.lit(False), "src")).distinct()
    first = both.withColumn("r", F.row_number().over(Window.partitionBy("node", "out").orderBy("other"))).where(F.col("r") <= most)
    side = lambda out: F.array_sort(F.collect_list(F.when(F.col("out") == out, F.col("other"))))
    return first.groupBy("node").agg(side(True).alias("sends"), side(False).alias("cited"))


def modularity(edges: DataFrame, labels: DataFrame) -> float:
    """Of labels (node, community) on a graph of both directions (u, v, w), where a loop stands once with twice its weight."""
    a = labels.select(F.col("node").alias("u"), F.col("community").alias("cu"))
    b = labels.select(F.col("node").alias("v"), F.col("community").alias("cv"))
    rows = edges.join(a, "u").join(b, "v").groupBy(F.col("cu").alias("c")).agg(F.sum("w").alias("all"), F.sum(F.when(F.col("cu") == F.col("cv"), F.col("w")).otherwise(0.0)).alias("inside"))
    got = rows.agg(F.sum("all").alias("m"), F.sum("inside").alias("inside"), F.sum(F.col("all") * F.col("all")).alias("squares")).first()
    return got["inside"] / got["m"] - got["squares"] / got["m"] ** 2 if got["m"] else 0.0


def _seen(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(u, mine, k, to, ties, size): what each node sees of its own community and of those of its neighbours. labels: (node, community, k)."""
    sized = labels.groupBy("community").agg(F.sum("k").alias("size"))
    theirs = labels.select(F.col("node").alias("v"), F.col("community").alias("to"))
    ties = edges.where("u <> v").join(theirs, "v").select("u", "to", "w").union(labels.select("node", "community", F.lit(0.0)))
    ties = ties.groupBy("u", "to").agg(F.sum("w").alias("ties"))
    own = labels.select(F.col("node").alias("u"), F.col("community").alias("mine"), "k")
    return kept(ties.join(own, "u").join(sized, F.col("to") == F.col("community")).drop("community"))


def _moved(seen: DataFrame, total: float, up: bool) -> DataFrame:
    """(node, community, k) after each node went to the community that gains most, if that is a gain; of equals the smallest.

    In one round nodes move to smaller names only, in the next to larger ones, so that two don't change places for ever.
    """
    own = F.col("to") == F.col("mine")
    # A node's own community is looked at as if it had left it.
    gain = F.round(F.col("ties") - F.col("k") * (F.col("size") - F.when(own, F.col("k")).otherwise(0.0)) / total, 9)
    allowed = own | (F.col("to") > F.col("mine") if up else F.col("to") < F.col("mine"))
    most = Window.partitionBy("u").orderBy(F.desc("gain"), F.desc("same"), "to")
    ranked = seen.where(allowed).select("u", "k", "to", gain.alias("gain"), own.alias("same")).withColumn("r", F.row_number().over(most))
    return ranked.where("r = 1").select(F.col("u").alias("node"), F.col("to").alias("community"), "k")


def _labels(seen: DataFrame) -> DataFrame:
    return seen.where(F.col("to") == F.col("mine")).select(F.col("u").alias("node"), F.col("mine").alias("community"), "k")


def _modularity(seen: DataFrame, loops: float, total: float) -> float:
    own = F.col("to") == F.col("mine")
    inside = F.sum(F.when(own, F.col("ties")).otherwise(0.0))
    # Each member brings its degree times its community's: together the square of the latter.
    squares = F.sum(F.when(own, F.col("k") * F.col("size")).otherwise(0.0))
    got = seen.agg(inside.alias("inside"), squares.alias("squares")).first()
    return (got["inside"] + loops) / total - got["squares"] / total**2


def communities(pairs: DataFrame, a: str, b: str, weight: Column | None = None, rounds: int = 6, levels: int = 5, least: float = 1e-4) -> DataFrame:
    """(node, community) of each node of a pair; community is its smallest node (AGG-21).

    Modularity moves: nodes join neighbouring communities while that raises modularity; communities become the nodes of the
    next level, with the weights between and within them added up, until a level raises it no more. Repeated pairs add their
    weights, pairs with a null count nowhere. A round that would lower modularity, as simultaneous moves may, isn't taken; a
    level ends when rounds in both directions gain less than least. Each round is one job and one number.
    """
    w = F.lit(1.0) if weight is None else weight.cast("double")
    flat = pairs.select(F.col(a).alias("u"), F.col(b).alias("v"), w.alias("w")).where("u IS NOT NULL AND v IS NOT NULL AND w > 0")
    edges = kept(flat.union(flat.select("v", "u", "w")).groupBy("u", "v").agg(F.sum("w").alias("w")))
    whole = kept(edges.select(F.col("u").alias("node")).distinct().select("node", F.col("node").alias("community")))
    total = edges.agg(F.sum("w")).first()[0]
    if not total:
        return whole
    for _ in range(levels):
        labels = edges.groupBy("u").agg(F.sum("w").alias("k")).select(F.col("u").alias("node"), F.col("u").alias("community"), "k")
        loops = edges.where("u = v").agg(F.sum("w")).first()[0] or 0.0
        seen = _seen(edges, labels)
        start = at = _modularity(seen, loops, total)
        idle = 0
        for turn in range(rounds):
            now = _seen(edges, _moved(seen, total, up=bool(turn % 2)))
            gained = _modularity(now, loops, total) - at
            idle = 0 if gained >= least else idle + 1
            if gained > 0:
                seen, at = now, at + gained
            if idle == 2:
                break
        if at < start + least:
            break
        labels = _labels(seen)
        names = labels.groupBy("community").agg(F.min("node").alias("name"))
        labels = kept(labels.join(names, "community").select("node", F.col("name").alias("community")))
        whole = kept(whole.withColumnRenamed("community", "old").join(labels.withColumnRenamed("node", "old"), "old").select("node", "community"))
        cu, cv = (labels.select(F.col("node").alias(c), F.col("community").alias(f"c{c}")) for c in ("u", "v"))
        edges = kept(edges.join(cu, "u").join(cv, "v").groupBy(F.col("cu").alias("u"), F.col("cv").alias("v")).agg(F.sum("w").alias("w")))
    names = whole.groupBy("community").agg(F.min("node").alias("name"))
    return whole.join(names, "community").select("node", F.col("name").alias("community"))
