"""Lexical retrieval: postings, BM25, rejection, passages under a budget, highlights, lookups (IR)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptoria.functions.text import folded, words
from scriptoria.operators.corpus import kept

#: Our choice of constants: saturation, length normalisation, least score of an answer.
K1, B, LEAST = 1.2, 0.75, 0.5


def postings(docs: DataFrame, keys: list[str], text: Column) -> DataFrame:
    """(*keys, term, tf, dl): how often each term occurs in a document, and the document's length in terms."""
    tokens = docs.select(*keys, words(text).alias("_w")).select(*keys, F.size("_w").alias("dl"), F.explode("_w").alias("term"))
    return tokens.groupBy(*keys, "dl", "term").agg(F.count("*").alias("tf"))


def bm25(docs: DataFrame, keys: list[str], text: Column, query: str, k1: float = K1, b: float = B) -> DataFrame:
    """(*keys, score) of documents with a term of the query.

    Only terms of the query are counted; what is needed of all documents is their number and mean length.
    """
    terms = sorted(set(query.split()))
    sized = docs.select(*keys, words(text).alias("_w")).select(*keys, F.size("_w").alias("dl"), F.filter("_w", lambda x: x.isin(*terms)).alias("_hits"))
    sized = kept(sized)  # texts are read once; what is kept of each is its length and hits
    whole = sized.agg(F.count("*").alias("docs"), F.avg("dl").alias("mean"))
    tf = sized.select(*keys, "dl", F.explode("_hits").alias("term")).groupBy(*keys, "dl", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    joined = tf.join(F.broadcast(df), "term").crossJoin(F.broadcast(whole))  # as many rows as the query has terms, and one
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("mean")))
    return joined.groupBy(*keys).agg(F.sum(part).alias("score"))


def best_or_none(scores: DataFrame, key: str, least: float = LEAST) -> DataFrame:
    """One row: the best key, or null where nothing scores enough."""
    best = scores.agg(F.max_by(key, F.struct("score", -F.col(key))).alias("best"), F.max("score").alias("score"))
    return best.select(F.when(F.col("score") >= least, F.col("best")).alias("answer"), F.when(F.col("score") >= least, F.lit("confirmed")).otherwise("no confirmed information").alias("label"))


def within_budget(passages: DataFrame, key: str, order: list[Column], size: str, budget: int) -> DataFrame:
    """Best passages of each key whose sizes add up to no more than the budget."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return passages.withColumn("upto", F.sum(size).over(w)).where(F.col("upto") <= budget)


def contains_folded(text: Column, needle: str) -> Column:
    return F.contains(folded(text), folded(F.lit(needle)))


def highlighted(text: Column, terms: list[str]) -> Column:
    return F.regexp_replace(text, "(?i)(" + "|".join(rf"\Q{t}\E" for t in terms) + ")", "<mark>$1</mark>")


def resolve_alias(questions: DataFrame, aliases: DataFrame) -> DataFrame:
    """(q, law): the longest alias whose words the question has one after the other; of equals one law, always the same.

    Runs of a question's words, as long as aliases have words, are joined to the aliases: any number of either will do.
    """
    named = aliases.select("law", "alias", F.array_join(words(F.col("alias")), " ").alias("name"), F.size(words(F.col("alias"))).alias("n")).where("n > 0")
    lengths = named.agg(F.array_sort(F.collect_set("n")).alias("ns"))  # one row, as short as aliases are
    own = questions.select("q", words(F.col("q")).alias("w")).distinct()
    runs = own.join(F.broadcast(lengths)).select("q", F.explode(F.flatten(F.transform("ns", lambda n: F.transform(
        F.when(F.size("w") >= n, F.sequence(F.lit(1), F.size("w") - n + 1)).otherwise(F.array().cast("array<int>")), lambda k: F.array_join(F.slice("w", k, n), " "))))).alias("name"))
    hits = runs.distinct().join(named, "name").groupBy("q").agg(F.max_by("law", F.struct(F.length("alias"), -F.xxhash64("law"))).alias("law"))
    return own.select("q").join(hits, "q", "left")


def article_lookup(questions: DataFrame, aliases: DataFrame, articles: DataFrame) -> DataFrame:
    """(q, outcome, text): found, not found, or ask which law; the number is the first one after 'art'."""
    number = F.regexp_extract(folded(F.col("q")), r"art(?:iculo|\.)?\s*(\d+(?: bis| ter)?)", 1)
    asked = resolve_alias(questions, aliases).withColumn("n", number)
    joined = asked.join(articles.select("law", "n", F.col("t").alias("text")), ["law", "n"], "left")
    outcome = F.when(F.col("n") == "", "topic").when(F.col("law").isNull(), "ask").when(F.col("text").isNull(), "not found").otherwise("found")
    return joined.select("q", outcome.alias("outcome"), "text")


def intent(question: Column) -> Column:
    """Drafting and actions come before questions about articles; the first rule that fits decides."""
    q = folded(question)
    return (
        F.when(q.rlike(r"^/\w+"), "command")
        .when(q.rlike(r"\b(redacta|redactame|escribi|escribime|arma|armame|prepara)\b"), "draft")
        .when(q.rlike(r"^(abri|borra|elimina|movee?|compart\w+|exporta)\b"), "action")
        .when(q.rlike(r"\bart(iculo|\.)?\s*\d+"), "article")
        .when(q.rlike(r"\?$|^(que|cual|como|cuando|donde|quien|cuant\w+)\b"), "question")
        .otherwise("chat")
    )


def similar_question(questions: DataFrame, known: DataFrame, least: float = 0.6) -> DataFrame:
    """(q, answer): the known question (k, answer, good) that shares the largest part of its words, if it is large enough and not marked bad."""
    a = questions.select("q", F.array_distinct(words(F.col("q"))).alias("w")).select("q", F.size("w").alias("n"), F.explode("w").alias("t"))
    b = known.where("good").select("k", "answer", F.array_distinct(words(F.col("k"))).alias("w")).select("k", "answer", F.size("w").alias("m"), F.explode("w").alias("t"))
    shared = a.join(b, "t").groupBy("q", "n", "k", "m", "answer").agg(F.count("*").alias("c"))
    alike = shared.withColumn("s", F.col("c") / (F.col("n") + F.col("m") - F.col("c"))).where(F.col("s") >= least)
    best = alike.groupBy("q").agg(F.max_by("answer", F.struct("s", "k")).alias("answer"))
    return questions.select("q").join(best, "q", "left")
