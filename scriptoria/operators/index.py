"""A stored inverted index: postings by term in partitions, renewed by version, questions answered from asked terms alone (IR-1, 2, 5).

An entry is (key, version, term, tf, dl): how often a document has a term, and its length in terms. A document also has one
entry of the empty term, so that those without words are known. Stored entries lie in folders by a hash of the term, sorted
by term within files; a question reads the folders of its terms only. Beside them stand, for each term, in how many
documents it is and the most that it can add to a score, and one row with the number of documents and their mean length.

A null text has no terms. Rows that share key and version are one document if they are equal in length, else entries of each
count. Questions and texts are folded, cut to stems, and synonyms stand in for each other when a question is asked.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptoria.functions.text import lower_words, stem_of, stems
from scriptoria.operators.retrieval import K1, LEAST, B

#: The term of which each document has one entry, and its folder.
WHOLE, APART = "", -1
#: Words whose terms are counted together, about; words whose stems a task keeps; keys that are sent to all tasks, at most.
PART, KNOWN, SENT = 1_000_000, 200_000, 1_000_000


@dataclass(frozen=True)
class Index:
    """Where an index lies, the name of its documents' key, and in how many folders its terms are."""

    path: str
    key: str
    folders: int = 64

    def part(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.read.parquet(f"{self.path}/{name}")


def _counted(batches: Iterator[pa.RecordBatch], names: list[str], folders: int) -> Iterator[pa.RecordBatch]:
    """Entries of each row (key, version, words), in parts of PART words: a word is cut to its stem once a part, not once a place.

    A part's terms come in the order in which they are stored, so what is sorted later is a few runs.
    """
    stem = lru_cache(KNOWN)(stem_of)
    for batch in (b for b in batches if b.num_rows):
        ends = batch.column(2).offsets.to_numpy()
        part = (ends[1:] - ends[0]) // PART
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            dl, n = np.diff(ends[a : b + 1]), b - a
            own = batch.column(2).values.slice(ends[a], ends[b] - ends[a]).dictionary_encode()
            term = pa.array([WHOLE, *map(stem, own.dictionary.to_numpy(zero_copy_only=False))], pa.string()).dictionary_encode()
            named = term.dictionary.to_numpy(zero_copy_only=False)
            folder = np.fromiter((xxhash.xxh64_intdigest(t, 42) for t in named), np.uint64, len(named)).view(np.int64) % folders
            folder[0] = APART
            order = pc.sort_indices(pa.table([folder, term.dictionary], ["folder", "term"]), [("folder", "ascending"), ("term", "ascending")]).to_numpy()
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            code = place[term.indices.to_numpy()[1:]][own.indices.to_numpy()]
            pairs = np.concatenate([np.arange(n), code * n + np.repeat(np.arange(n), dl)])  # WHOLE comes first
            pairs, tf = np.unique(pairs, return_counts=True)
            at, doc = np.divmod(pairs, n)
            key, version = (batch.column(k).slice(a, n).take(pa.array(doc)) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([key, version, pa.array(dl[doc].astype(np.int32)), term.dictionary.take(pa.array(order[at])), pa.array(tf.astype(np.int64))], names)


def repeated(docs: DataFrame, key: str, version: str) -> DataFrame | None:
    """Keys and versions of several rows, if there are any."""
    found = docs.groupBy(key, version).agg(F.count("*").alias("_n")).where("_n > 1").select(F.col(key).alias("_k"), F.col(version).alias("_v"))
    n = found.count()
    return None if n == 0 else F.broadcast(found) if n <= SENT else found


def entries(docs: DataFrame, key: str, version: str, text: Column, of: DataFrame | None = None, folders: int = Index.folders) -> DataFrame:
    """Only rows that share key and version with another one are shuffled, to be added up.

    of: rows of which docs are some, if docs are dear to read. folders: of the index, for the order of entries only.
    """
    names, kinds = [key, version, "dl", "term", "tf"], dict(docs.dtypes)
    schema = f"`{key}` {kinds[key]}, `{version}` {kinds[version]}, dl int, term string, tf long"

    def made(some: DataFrame) -> DataFrame:
        own = some.select(key, version, F.coalesce(lower_words(text), F.array().cast("array<string>")).alias("_w"))
        return own.mapInArrow(lambda batches: _counted(batches, names, folders), schema)

    several = repeated(docs if of is None else of, key, version)
    if several is None:
        return made(docs)
    same = F.col(key).eqNullSafe(F.col("_k")) & F.col(version).eqNullSafe(F.col("_v"))
    added = made(docs.join(several, same, "left_semi")).groupBy(key, version, "dl", "term").agg(F.sum("tf").alias("tf"))
    return made(docs.join(several, same, "left_anti")).unionByName(added)


def _folder(term: Column, folders: int) -> Column:
    return F.when(term == WHOLE, F.lit(APART)).otherwise(F.pmod(F.xxhash64(term), F.lit(folders)).cast("int"))


def gain(tf: Column, dl: Column, mean: Column) -> Column:
    """What a term's number in a document adds, before its rarity counts."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / mean))


def rarity(docs: Column, df: Column) -> Column:
    return F.log(1 + (docs - df + 0.5) / (df + 0.5))


def store(made: DataFrame, index: Index) -> Index:
    """Writes entries, and what is known of terms and of the whole. Folders of frequent terms are split into several files."""
    spark = made.sparkSession
    dealt = made.withColumn("folder", _folder(F.col("term"), index.folders)).hint("rebalance", F.col("folder"))
    dealt.sortWithinPartitions("folder", "term").write.partitionBy("folder").parquet(f"{index.path}/entries")
    stored = index.part(spark, "entries")
    stored.where(F.col("folder") == APART).agg(F.count("*").alias("docs"), F.avg("dl").alias("mean")).write.parquet(f"{index.path}/whole")
    whole = F.broadcast(index.part(spark, "whole"))  # one row
    terms = stored.where(F.col("folder") != APART).crossJoin(whole)
    terms = terms.groupBy("folder", "term").agg(F.count("*").alias("df"), F.max(gain(F.col("tf"), F.col("dl"), F.col("mean"))).alias("most"))
    terms.hint("rebalance", F.col("folder")).sortWithinPartitions("folder", "term").write.partitionBy("folder").parquet(f"{index.path}/terms")
    return index


def renew(old: Index, docs: DataFrame, version: str, text: Column, path: str) -> Index:
    """A new generation at path: entries of documents whose version is the same are taken over, others are made anew, those of documents that are gone leave."""
    spark, key = docs.sparkSession, old.key
    had = old.part(spark, "entries")
    # Each document has one entry of the empty term: the others are read once, to be taken over.
    known = had.where(F.col("folder") == APART).select(key, version).distinct()
    same = known.join(docs.select(key, version), [key, version], "left_semi")
    same = F.broadcast(same) if known.count() <= SENT else same.hint("shuffle_hash")
    kept = had.drop("folder").join(same, [key, version], "left_semi")
    new = docs.join(same, [key, version], "left_anti")
    return store(kept.unionByName(entries(new, key, version, text, docs, old.folders)), Index(path, key, old.folders))


def asked_terms(questions: DataFrame, synonyms: DataFrame, folders: int) -> DataFrame:
    """(q, concept, term, folder): a concept is a stem of the question, its terms are that and its synonyms'. synonyms: (word, also), in both directions."""
    own = questions.select("q", F.explode(F.array_distinct(stems(F.col("q")))).alias("concept"))
    one = lambda c: F.element_at(stems(F.col(c)), 1)
    pairs = synonyms.select(one("word").alias("concept"), one("also").alias("term"))
    pairs = pairs.union(pairs.select(F.col("term"), F.col("concept"))).where("concept IS NOT NULL AND term IS NOT NULL").distinct()
    both = own.select("q", "concept", F.col("concept").alias("term")).union(own.join(pairs, "concept").select("q", "concept", "term")).distinct()
    return both.withColumn("folder", _folder(F.col("term"), folders))


def _hits(index: Index, terms: DataFrame, entries_of: DataFrame) -> DataFrame:
    """(q, concept, key, dl, tf): a concept's terms count together."""
    return entries_of.join(terms, ["folder", "term"]).groupBy("q", "concept", index.key, "dl").agg(F.sum("tf").alias("tf"))


def _read(spark: SparkSession, index: Index, terms: DataFrame, name: str) -> DataFrame:
    """Only the folders of the terms are read: no more numbers than there are folders come to the driver."""
    folders = sorted(r["folder"] for r in terms.select("folder").distinct().collect())
    return index.part(spark, name).where(F.col("folder").isin(folders))


def scores(index: Index, questions: DataFrame, synonyms: DataFrame) -> DataFrame:
    """(q, key, score) of all documents with a term of the question (BM25)."""
    spark = questions.sparkSession
    terms = asked_terms(questions, synonyms, index.folders)
    hits = _hits(index, terms, _read(spark, index, terms, "entries"))
    return _scored(index, hits, spark)


def _scored(index: Index, hits: DataFrame, spark: SparkSession, df: DataFrame | None = None) -> DataFrame:
    df = hits.groupBy("q", "concept").agg(F.count("*").alias("df")) if df is None else df
    whole = F.broadcast(index.part(spark, "whole"))  # one row
    part = rarity(F.col("docs"), F.col("df")) * gain(F.col("tf"), F.col("dl"), F.col("mean"))
    return hits.join(df, ["q", "concept"]).crossJoin(whole).groupBy("q", index.key).agg(F.sum(part).alias("score"))


def top(index: Index, question: str, synonyms: DataFrame, n: int) -> DataFrame:
    """(key, score) of the n best documents for one question; of equal ones those with the smallest keys.

    The rarest concept alone gives a score that n documents reach at least. Concepts that together cannot reach it count
    only for documents that have another one: their entries are filtered by those documents before they are grouped.
    """
    spark = synonyms.sparkSession
    terms = asked_terms(spark.createDataFrame([(question,)], "q string"), synonyms, index.folders)
    known = terms.join(_read(spark, index, terms, "terms"), ["folder", "term"])
    # As many rows as the question has terms. A concept of several terms can add no more than any does.
    each = known.groupBy("concept").agg(F.max("df").alias("df"), F.when(F.count("*") > 1, F.lit(K1 + 1)).otherwise(F.max("most")).alias("most"))
    bounds = each.crossJoin(F.broadcast(index.part(spark, "whole"))).select("concept", (rarity(F.col("docs"), F.col("df")) * F.col("most")).alias("bound")).collect()
    order = sorted(((r["bound"], r["concept"]) for r in bounds), reverse=True)
    hits = _hits(index, terms, _read(spark, index, terms, "entries"))
    df = hits.groupBy("q", "concept").agg(F.count("*").alias("df"))
    if len(order) > 1:
        reached = _scored(index, hits.where(F.col("concept") == order[0][1]), spark, df).orderBy(F.desc("score")).limit(n).agg(F.min("score").alias("s"), F.count("*").alias("n")).first()
        least = reached["s"] if reached["n"] == n else 0.0
        rest = len(order)
        while rest > 1 and sum(b for b, _ in order[rest - 1 :]) < least:
            rest -= 1
        needed = [c for _, c in order[:rest]]
        if rest < len(order):
            some = hits.where(F.col("concept").isin(needed))
            hits = some.unionByName(hits.where(~F.col("concept").isin(needed)).join(some.select(index.key).distinct(), index.key, "left_semi"))
    best = _scored(index, hits, spark, df)
    return best.orderBy(F.round("score", 9).desc(), index.key).limit(n).select(index.key, "score")


def answers(index: Index, questions: DataFrame, synonyms: DataFrame, n: int, least: float = LEAST) -> DataFrame:
    """(q, rank, key, score): the n best documents of each question that score enough; a question without any has rank 0 and no key."""
    from pyspark.sql import Window

    best = Window.partitionBy("q").orderBy(F.round("score", 9).desc(), index.key)
    found = scores(index, questions, synonyms).where(F.col("score") >= least).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n)
    return questions.select("q").distinct().join(found, "q", "left").select("q", F.coalesce("rank", F.lit(0)).alias("rank"), index.key, "score")
