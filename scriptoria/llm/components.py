"""Connected components of pairs in Spark: those of the core, for pairs of any names, with nulls and loops ignored.

Each round's pairs are written to the shared checkpoint folder. Work per round is a few aggregations by node, which
combine before they shuffle; the number of rounds grows with the log of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptoria.llm.common import checkpoint
from scriptoria.operators import corpus


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for each node of a pair; component is the smallest node reachable."""
    pairs = checkpoint(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b"))
    if pairs.isEmpty():
        return pairs.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return corpus.components(pairs, "a", "b")
