"""Questions to a stored index of the documents (IR-1, 2 and 5, CA-2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptoria.functions import text as T
from scriptoria.operators import index as I
from scriptoria.operators.retrieval import LEAST
from scriptoria.plans import as_sql, query, rows, shared, table

#: Questions to the corpus: one whose words stand in many documents, inflected ones, one answered by a synonym only, one by nothing.
QUESTIONS = [("all rights reserved",), ("relying on worthless mentions",), ("licensing und threading",), ("postcodes",), ("xylophone quixotic",)]
SYNONYMS = [("postcodes", "address"), ("und", "and")]


def stemmed_sql(text: str) -> str:
    folded = f"translate(lower({text}), '{T.ACCENTS[0]}', '{T.ACCENTS[1]}')"
    return rf"list_transform(regexp_extract_all({folded}, '[\p{{L}}\p{{N}}]+'), lambda x: regexp_replace(x, '{T.STEM}', '\1'))"


#: Scores by a full scan: no index, every text read for every question.
SCORED = rf"""w AS (SELECT doc_id, {stemmed_sql("coalesce(text, '')")} AS w FROM documents), m AS (SELECT count(*) AS docs, avg(len(w)) AS mean FROM w),
qs AS (SELECT q, unnest(list_distinct({stemmed_sql("q")})) AS concept FROM {as_sql("q", QUESTIONS)}),
sy AS (SELECT DISTINCT {stemmed_sql("word")}[1] AS a, {stemmed_sql("also")}[1] AS b FROM {as_sql("word, also", SYNONYMS)}),
t AS (SELECT q, concept, concept AS term FROM qs UNION SELECT q, concept, b FROM qs JOIN sy ON a = concept UNION SELECT q, concept, a FROM qs JOIN sy ON b = concept),
z AS (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM w), f AS (SELECT q, concept, doc_id, dl, count(*) AS tf FROM z JOIN t USING (term) GROUP BY ALL), d AS (SELECT q, concept, count(*) AS df FROM f GROUP BY ALL),
s AS (SELECT q, doc_id, sum(ln(1 + (docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / mean))) AS score FROM f JOIN d USING (q, concept), m GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s WHERE score >= {LEAST}::DOUBLE)"""


def document_index(spark: SparkSession, sf_dir: str) -> I.Index:
    docs = table(spark, sf_dir, "documents").withColumn("version", F.lit(1))
    return I.store(I.entries(docs, "doc_id", "version", F.col("text")), I.Index(shared(spark, "index"), "doc_id"))


@query(f"WITH {SCORED} SELECT v.q AS q, coalesce(rank, 0)::INT AS rank, doc_id, round(score, 6) AS score FROM {as_sql('q', QUESTIONS)} LEFT JOIN (SELECT * FROM r WHERE rank <= 10) AS x ON x.q = v.q")
def indexed_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IR-1, 2 and 5: several questions answered from the stored index, with stems and synonyms; one finds nothing."""
    questions, synonyms = rows(spark, "q string", QUESTIONS), rows(spark, "word string, also string", SYNONYMS)
    return I.answers(document_index(spark, sf_dir), questions, synonyms, 10).withColumn("score", F.round("score", 6))


@query(f"WITH {SCORED} SELECT doc_id, round(score, 6) AS score FROM s WHERE q = '{QUESTIONS[1][0]}' ORDER BY round(s.score, 9) DESC, doc_id LIMIT 20")
def indexed_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IR-1: the twenty best for one question; bounds of terms leave out entries that cannot matter."""
    synonyms = rows(spark, "word string, also string", SYNONYMS)
    return I.top(document_index(spark, sf_dir), QUESTIONS[1][0], synonyms, 20).withColumn("score", F.round("score", 6))


@query(rf"""WITH w AS (SELECT doc_id, CASE WHEN lang = 'en' THEN 1 ELSE 2 END AS version, {stemmed_sql("CASE WHEN lang = 'en' THEN text ELSE concat('renewed ', text) END")} AS w FROM documents WHERE lang IS NOT NULL)
SELECT term, count(*) AS df, sum(n)::BIGINT AS tf FROM (SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest(w) AS term FROM w) GROUP BY ALL) GROUP BY term""")
def renewed_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CA-2, SRC-5: an index after documents without a language left and all but English ones got a new version: every term's documents and occurrences."""
    docs = table(spark, sf_dir, "documents").where("lang IS NOT NULL").withColumn("version", F.when(F.col("lang") == "en", 1).otherwise(2))
    docs = docs.withColumn("text", F.when(F.col("lang") == "en", F.col("text")).otherwise(F.concat(F.lit("renewed "), "text")))
    new = I.renew(document_index(spark, sf_dir), docs, "version", F.col("text"), shared(spark, "index"))
    return new.part(spark, "entries").where(F.col("folder") >= 0).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))
