"""Mixing sources to target weights by Pareto order sampling.

Each source has a target of words. Every document of a source gets the whole copies that the target allows all of them
for certain; what remains of the target is drawn without replacement. Documents are ranked by their random odds divided
by their inclusion odds, and taken from the top until the remainder is reached, the last one if that brings the sum
nearer. The random numbers come from a digest of the id, so reruns agree.

Sizes are words; a null text has 0 and takes part like any other. Sources by code point, null last and a source of its
own. Equal rows are drawn each for itself; they share a random number. An empty table gives no rows. Other columns of
the input are ignored, so their names cannot clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptoria.llm.common import WORD, checkpoint, table


@dataclass(frozen=True)
class Mixture:
    """weights: repeat over the sources in order. share: of all words. most: copies of a document, and of a source's words.

    bins: how finely documents are counted by rank before the one bin is sorted in which a source's sample ends.
    broadcast: sources up to which the table of targets is sent to all tasks; with more of them it is joined by shuffling.
    """

    weights: tuple[int, ...] = (5, 2, 1)
    share: float = 1.5
    most: int = 2
    bins: int = 4096
    broadcast: int = 100_000
    seed: str = "mix"


def targets(sources: DataFrame, mix: Mixture = Mixture()) -> DataFrame:
    """Adds target to (source, source_size): least of `most` times the size and a level times the weight, the level such that all add up.

    The order in which sources reach their limit is that of limit / weight, so the level comes from running sums.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weights = F.array(*[F.lit(w) for w in mix.weights])
    s = sources.withColumn("weight", F.element_at(weights, ((F.row_number().over(order) - 1) % len(mix.weights) + 1).cast("int")))
    s = s.withColumn("limit", F.col("source_size") * mix.most)
    by = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    s = s.withColumn("full", F.coalesce(F.sum("limit").over(by), F.lit(0))).withColumn("open", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(by), F.lit(0)))
    # If this source and all after it in the order are below their limits, the level is what is left by weight.
    s = s.withColumn("level", (F.sum("source_size").over(every) * F.lit(mix.share) - F.col("full")) / F.col("open"))
    s = s.withColumn("below", F.col("level") * F.col("weight") <= F.col("limit"))
    # Levels fall until the first source that stays below its limit and that one is right for all after it.
    level = F.min(F.when(F.col("below"), F.struct("limit_rank", "level"))).over(every)["level"]
    s = s.withColumn("limit_rank", F.row_number().over(Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())))
    return s.withColumn("common", level).select("source", "source_size", F.least(F.col("limit").cast("double"), F.coalesce(F.col("common") * F.col("weight"), F.col("limit").cast("double"))).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: list[str] = [], rules: Mixture = Mixture()) -> DataFrame:  # noqa: B006
    """Per row: the id, size, source_size, target, copies (how often the mix takes it) and the columns named in keep, as keep_0, keep_1 and so on."""
    digest = F.md5(F.concat_ws("/", F.lit(rules.seed), F.col(id_col).cast("string")))
    u = (F.conv(F.substring(digest, 1, 12), 16, 10).cast("long").cast("double") + 0.5) / float(2**48)
    rows = checkpoint(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long").alias("size"), u.alias("u"), *[F.col(c).alias(f"keep_{k}") for k, c in enumerate(keep)]))
    sources = checkpoint(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), rules))
    sources = sources.withColumn("all", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    sources = sources.withColumn("rest", F.col("target") - F.col("all") * F.col("source_size"))
    small = sources.count() <= rules.broadcast
    hint = F.broadcast if small else (lambda x: x)
    known = sources.withColumnRenamed("source", "of")
    rows = rows.join(hint(known), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    # Inclusion probability of the copy that is not certain, and the rank variable as a number from 0 to 1.
    p = F.when(F.col("source_size") > 0, F.col("rest") / F.col("source_size")).otherwise(0.0)
    odds = (F.col("u") / (1 - F.col("u"))) / (p / (1 - p))
    rows = rows.withColumn("rank", F.when(p > 0, odds).otherwise(F.lit(None)))
    rows = rows.withColumn("bin", F.floor(F.col("rank") / (1 + F.col("rank")) * rules.bins))
    sums = rows.where(F.col("rank").isNotNull()).groupBy("source", "bin").agg(F.sum("size").alias("in_bin"), F.first("rest").alias("rest"))
    upto = F.sum("in_bin").over(Window.partitionBy("source").orderBy("bin"))
    ends = sums.withColumn("before", upto - F.col("in_bin")).where((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("in_bin")))
    ends = ends.select(F.col("source").alias("of"), F.col("bin").alias("last_bin"), "before")
    rows = rows.join(hint(ends), F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
    # Whole bins before the last are in; within it documents are taken while that brings the sum nearer.
    within = (F.col("bin") == F.col("last_bin")) & F.col("rank").isNotNull()
    far = rows.where(~F.coalesce(within, F.lit(False)))
    far = far.withColumn("extra", F.when(F.col("rank").isNull(), 0).when(F.col("last_bin").isNull() | (F.col("bin") < F.col("last_bin")), 1).otherwise(0))
    run = F.sum("size").over(Window.partitionBy("source").orderBy("rank", "id", "size").rowsBetween(Window.unboundedPreceding, 0))
    edge = rows.where(F.coalesce(within, F.lit(False))).withColumn("extra", F.when(F.col("before") + run - F.col("size") / 2 <= F.col("rest"), 1).otherwise(0))
    both = far.unionByName(edge)
    return both.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("all") + F.col("extra")).cast("int").alias("copies"), *[F.col(f"keep_{k}") for k in range(len(keep))])


def mixed(docs: DataFrame, rules: Mixture = Mixture()) -> DataFrame:
    """docs as the mix takes them: each row as often as it has copies."""
    found = mix(docs, keep=docs.columns, rules=rules)
    found = found.where(F.col("copies") > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return found.select(*[F.col(f"keep_{k}").alias(c) for k, c in enumerate(docs.columns)])


def op6_pareto_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


ORACLE = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
  (('0x' || substr(md5('mix/' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0::DOUBLE AS u FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
a AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight, 2 * source_size AS lim, sum(source_size) OVER () AS total FROM s),
b AS (SELECT *, row_number() OVER (ORDER BY lim / weight::DOUBLE, source NULLS LAST) AS r,
  coalesce(sum(lim) OVER (ORDER BY lim / weight::DOUBLE, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
  sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY lim / weight::DOUBLE, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS open FROM a),
c AS (SELECT *, (total::DOUBLE * 1.5::DOUBLE - capped::DOUBLE) / open::DOUBLE AS lev FROM b),
t AS (SELECT source, source_size, least(lim::DOUBLE, coalesce((SELECT lev FROM c WHERE lev * weight <= lim ORDER BY r LIMIT 1) * weight, lim::DOUBLE)) AS target FROM c),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t),
f AS (SELECT *, target - whole * source_size AS rest, CASE WHEN source_size > 0 THEN (target - whole * source_size) / source_size ELSE 0 END AS p FROM e),
g AS (SELECT d.*, f.source_size, f.target, f.whole, f.rest, CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS q FROM d JOIN f ON d.source IS NOT DISTINCT FROM f.source),
h AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY q NULLS LAST, doc_id, size ROWS UNBOUNDED PRECEDING) AS run FROM g)
SELECT doc_id, size, source_size, target, (size * (whole + CASE WHEN q IS NOT NULL AND run - size / 2.0::DOUBLE <= rest THEN 1 ELSE 0 END))::BIGINT AS taken FROM h
"""
