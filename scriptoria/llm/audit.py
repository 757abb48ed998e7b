"""Filter interaction audit: what each filter removes in every order of the filters, from edges of the lattice of subsets.

With five filters a document takes part in 80 edges (filters already applied, next filter): it arrives at an edge if it
fails none of the applied ones, and is removed there if it fails the next. Documents that fail alike count as one class
before they reach the edges, so edges see 128 classes a part at most. Each of the 600 steps of the 120 orders is an edge:
an order is a path through the lattice, and steps are joined to edges, not to documents.

The filters: A too few words, B too few different words, C too many capitals, D holds a symbol, E a copy of the text of a
smaller id. A null text is empty; a null source is the part ''. An id that is null is smaller than none and has none
smaller, so it never fails E. Rows that repeat an id count each; with the same text neither is the copy of the other. A
document is good or toxic if any row of labels for its id says so; labels without a document count nowhere. An empty table
gives no rows. Other columns of both tables are ignored, so their names cannot clash.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptoria.llm.common import table

FILTERS = "ABCDE"
#: Fixed by the contract: white space between words, and what filter D looks for.
BLANKS = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#$%&*|]"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
COPY = 1 << FILTERS.index("E")


@dataclass(frozen=True)
class Limits:
    """A fails under words words; B under distinct percent of different words; C over capitals percent of code points."""

    words: int = 50
    distinct: int = 65
    capitals: int = 5


def failures(text: Column, words: Column, limits: Limits = Limits()) -> Column:
    """Bits of the filters A to D that the text fails."""
    n, low = F.size(words), F.translate(text, CAPITALS, "")
    fails = (
        n < limits.words,
        100 * F.size(F.array_distinct(words)) < limits.distinct * n,
        100 * (F.length(text) - F.length(low)) > limits.capitals * F.length(text),
        text.rlike(SYMBOLS),
    )
    return sum((F.when(f, F.lit(1 << k)).otherwise(F.lit(0)) for k, f in enumerate(fails)), F.lit(0))


def classes(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", limits: Limits = Limits()) -> DataFrame:
    """Documents that fail alike, counted: part, mask (bits of failed filters), good, toxic, n."""
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(F.col(part_col), F.lit("")).alias("part"))
    own = own.select("id", "text", "part", F.array_remove(F.split("text", BLANKS), "").alias("words"))
    # Ids that are null meet no label; their texts deal them to different tasks.
    rows = own.select("id", "part", F.sha2("text", 256).alias("copy"), failures(F.col("text"), F.col("words"), limits).alias("mask"), F.when(F.col("id").isNull(), F.xxhash64("text")).otherwise(F.lit(0)).alias("deal"))
    says = labels.select(F.col(id_col).alias("of"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))
    says = says.groupBy("of").agg(F.coalesce(F.bool_or("good"), F.lit(False)).alias("good"), F.coalesce(F.bool_or("toxic"), F.lit(False)).alias("toxic"))
    known = rows.join(says, (F.col("id") == F.col("of")) & (F.col("deal") == 0), "left")
    known = known.select("id", "deal", "part", "copy", "mask", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")])

    # Copies of a text in a part, with the smallest id among them and how many rows have just that one.
    alike = ("copy", "part", "mask", "good", "toxic")
    ids = known.groupBy("id", "deal", *alike).agg(F.count("*").alias("n"))
    groups = ids.groupBy(*alike).agg(F.sum("n").alias("n"), F.min("id").alias("low"), F.min_by("n", "id").alias("lowest"), F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col("n"))), F.lit(0)).alias("nameless"))
    first = groups.groupBy("copy").agg(F.min("low").alias("least"))
    groups = groups.join(first.withColumnRenamed("copy", "of"), F.col("copy") == F.col("of"))
    kept = F.col("nameless") + F.when(F.col("low") == F.col("least"), F.col("lowest")).otherwise(F.lit(0))
    split = F.array(F.struct(F.col("mask").alias("mask"), kept.alias("n")), F.struct((F.col("mask") + COPY).alias("mask"), (F.col("n") - kept).alias("n")))
    return groups.select("part", "good", "toxic", F.explode(split).alias("x")).groupBy("part", "x.mask", "good", "toxic").agg(F.sum("x.n").alias("n"))


def edges(counts: DataFrame, filters: int = len(FILTERS)) -> DataFrame:
    """Per part, subset of applied filters and next filter: arrived, removed, good_lost, toxic_lost, fails, unique_fails, and shapley."""
    every = [(s, f) for f in range(filters) for s in range(1 << filters) if not s >> f & 1]
    lattice = F.array(*[F.struct(F.lit(s).alias("applied"), F.lit(f).alias("next")) for s, f in every])
    at = counts.select("part", "mask", "good", "toxic", "n", F.explode(lattice).alias("e")).select("*", "e.applied", "e.next")
    bit = F.expr("shiftleft(1, next)")
    fails, arrives = F.col("mask").bitwiseAND(bit) != 0, F.col("mask").bitwiseAND(F.col("applied")) == 0
    total = lambda condition: F.sum(F.when(condition, F.col("n")).otherwise(F.lit(0)))
    out = at.groupBy("part", "next", "applied").agg(
        total(arrives).alias("arrived"), total(arrives & fails).alias("removed"), total(arrives & fails & F.col("good")).alias("good_lost"), total(arrives & fails & F.col("toxic")).alias("toxic_lost"),
        total(fails).alias("fails"), total(F.col("mask") == bit).alias("unique_fails"),
    )
    # So many orders have just these filters before the next one.
    ways = F.element_at(F.array(*[F.lit(factorial(k) * factorial(filters - 1 - k)) for k in range(filters)]), F.bit_count("applied") + 1)
    weighed = out.groupBy(F.col("part").alias("of"), F.col("next").alias("filter")).agg(F.sum(F.col("removed") * ways).alias("shapley"))
    return out.join(weighed, (F.col("part") == F.col("of")) & (F.col("next") == F.col("filter"))).drop("of", "filter")


def paths(spark: SparkSession, letters: str = FILTERS) -> DataFrame:
    """The steps of all orders of the filters as edges: filter_order, step, applied, next. As many as there are orders times filters."""
    rows = []
    for order in permutations(range(len(letters))):
        for k, f in enumerate(order):
            rows.append(("".join(letters[x] for x in order), k + 1, sum(1 << x for x in order[:k]), f))
    return spark.createDataFrame(rows, "filter_order string, step int, applied int, next int")


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", limits: Limits = Limits()) -> DataFrame:
    """One row per part, order and step, zeros included."""
    found = edges(classes(docs, labels, id_col, text_col, part_col, limits))
    steps = F.broadcast(paths(docs.sparkSession))  # 600 rows, whatever the input
    return found.join(steps, ["applied", "next"]).select(
        "part", "filter_order", "step", (F.col("arrived") - F.col("removed")).alias("kept"), "removed", (F.col("fails") - F.col("removed")).alias("redundant"),
        "unique_fails", "good_lost", "toxic_lost", "shapley",
    )


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS part FROM documents),
     w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
     l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
     m AS (SELECT part, coalesce(good, false) AS good, coalesce(l.toxic, false) AS toxic,
                  CASE WHEN len(ws) < 50 THEN 1 ELSE 0 END
                  + CASE WHEN 100 * len(list_distinct(ws)) < 65 * len(ws) THEN 2 ELSE 0 END
                  + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 4 ELSE 0 END
                  + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
                  + CASE WHEN w.doc_id > min(w.doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask
           FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
     c AS (SELECT part, mask, good, toxic, count(*) AS n FROM m GROUP BY ALL),
     f(letter, b) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
     o AS (SELECT v.letter || w.letter || x.letter || y.letter || z.letter AS filter_order, [v.b, w.b, x.b, y.b, z.b] AS bits
           FROM f v, f w, f x, f y, f z WHERE v.b + w.b + x.b + y.b + z.b = 31 AND len(list_distinct([v.b, w.b, x.b, y.b, z.b])) = 5),
     s AS (SELECT filter_order, k AS step, bits[k] AS bit, coalesce(list_sum(bits[1:k - 1]), 0)::INT AS applied FROM o, range(1, 6) AS r(k)),
     a AS (SELECT part, filter_order, step, bit,
                  sum(CASE WHEN mask & (applied | bit) = 0 THEN n ELSE 0 END) AS kept,
                  sum(CASE WHEN mask & applied = 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS removed,
                  sum(CASE WHEN mask & applied <> 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS redundant,
                  sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
                  sum(CASE WHEN mask & applied = 0 AND mask & bit <> 0 AND good THEN n ELSE 0 END) AS good_lost,
                  sum(CASE WHEN mask & applied = 0 AND mask & bit <> 0 AND toxic THEN n ELSE 0 END) AS toxic_lost
           FROM c, s GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
       good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM a
"""
