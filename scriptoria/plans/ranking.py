"""Retrieval and extraction over pages, conversations and documents (IR, EX)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptoria.functions import text as T
from scriptoria.operators import extract as E
from scriptoria.operators import retrieval as R
from scriptoria.plans import query, rows, table

FOLD = "translate(lower({}), '" + T.ACCENTS[0] + "', '" + T.ACCENTS[1] + "')"
#: Character references that the tables' pages have; SQL has no table of all of them.
REFERENCES = [("&nbsp;", " "), ("&#160;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&eacute;", "é"), ("&#233;", "é"), ("&mdash;", "—"), ("&hellip;", "…"), ("&amp;", "&")]
PLAIN = (
    "regexp_replace(regexp_replace(regexp_replace(replace(" + "replace(" * len(REFERENCES)
    + r"regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', ' ', 'g'), '(?i)<br\s*/?>|</p>|</div>|</h\d>|</li>|</tr>', chr(10), 'g'), '<[^>]+>', ' ', 'g')"
    + "".join(", '" + a.replace("'", "''") + "', '" + b.replace("'", "''") + "')" for a, b in REFERENCES)
    + r", chr(160), ' '), '[ \t]+', ' ', 'g'), '\n\s*\n+', chr(10), 'g'), '^\s+|\s+$', '', 'g')"
)


def bm25_sql(source: str, keys: str, terms: list[str]) -> str:
    """Scores as SQL: source gives keys and t."""
    chosen = ", ".join(f"'{t}'" for t in terms)
    return rf"""w AS (SELECT {keys}, regexp_extract_all({FOLD.format("t")}, '[\p{{L}}\p{{N}}]+') AS w FROM ({source})),
z AS (SELECT {keys}, len(w) AS dl, unnest(list_filter(w, lambda x: x IN ({chosen}))) AS term FROM w),
f AS (SELECT {keys}, dl, term, count(*) AS tf FROM z GROUP BY ALL), d AS (SELECT term, count(*) AS df FROM f GROUP BY term), m AS (SELECT count(*) AS docs, avg(len(w)) AS mean FROM w),
s AS (SELECT {keys}, sum(ln(1 + (docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / mean))) AS score FROM f JOIN d USING (term), m GROUP BY {keys})"""


@query(f"SELECT page_id, {PLAIN} AS text FROM pages")
def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-1: pages as plain text."""
    return table(spark, sf_dir, "pages").select("page_id", T.html_to_text(F.col("html")).alias("text"))


@query(f"WITH {bm25_sql(f'SELECT page_id, {PLAIN} AS t FROM pages', 'page_id', ['tion', 'with', 'nicht'])} SELECT page_id, round(score, 6) AS score FROM s ORDER BY s.score DESC, page_id LIMIT 10")
def bm25_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IR-1: the ten best pages for a question, over whole pages as text."""
    scored = R.bm25(table(spark, sf_dir, "pages"), ["page_id"], T.html_to_text(F.col("html")), "tion with nicht")
    return scored.orderBy(F.col("score").desc(), "page_id").limit(10).select("page_id", F.round("score", 6).alias("score"))


@query("""SELECT * FROM (VALUES ('absent', NULL::BIGINT, 'no confirmed information')) AS v(asked, answer, label)
UNION ALL SELECT 'present', answer, 'confirmed' FROM (WITH """ + bm25_sql("SELECT doc_id, text AS t FROM documents", "doc_id", ["all", "rights", "reserved"]) + """ SELECT max_by(doc_id, (score, -doc_id)) AS answer FROM s)""")
def bm25_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IR-2 and 3: a question that nothing answers gets no source."""
    d, text = table(spark, sf_dir, "documents"), F.col("text")
    ask = lambda name, q: R.best_or_none(R.bm25(d, ["doc_id"], text, q), "doc_id").select(F.lit(name).alias("asked"), "answer", "label")
    return ask("absent", "xylophone quixotic").union(ask("present", "all rights reserved"))


@query("WITH " + bm25_sql("SELECT conv_id, turn, text AS t FROM conversations", "conv_id, turn", ["the", "and", "with"]) + " SELECT conv_id, max_by(turn, (round(score, 9), -turn)) AS turn, round(max(score), 6) AS score FROM s GROUP BY conv_id")
def passage_top_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IR-7: the passage of each conversation that answers best."""
    s = R.bm25(table(spark, sf_dir, "conversations"), ["conv_id", "turn"], F.col("text"), "the and with")
    return s.groupBy("conv_id").agg(F.max_by("turn", F.struct(F.round("score", 9), -F.col("turn"))).alias("turn"), F.round(F.max("score"), 6).alias("score"))


@query("""SELECT source, doc_id, upto::BIGINT AS upto FROM (SELECT source, doc_id, sum(n_chars) OVER (PARTITION BY source ORDER BY len(regexp_extract_all(lower(text), 'tion')) DESC, doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM documents) WHERE upto <= 22000""")
def budget_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IR-8: the most relevant documents of each source under a budget of characters."""
    d = table(spark, sf_dir, "documents").withColumn("hits", F.regexp_count(F.lower("text"), F.lit("tion")))
    return R.within_budget(d, "source", [F.col("hits").desc(), F.col("doc_id")], "n_chars", 22000).select("source", "doc_id", "upto")


@query(f"SELECT doc_id FROM documents WHERE contains({FOLD.format('text')}, {FOLD.format(chr(39) + 'Étre' + chr(39))})")
def fulltext_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IR-10 and TXT-16: search without regard to case and accents."""
    return table(spark, sf_dir, "documents").where(R.contains_folded(F.col("text"), "Étre")).select("doc_id")


@query("SELECT conv_id, turn, regexp_replace(text, '(?i)(tion|with)', '<mark>\\1</mark>', 'g') AS shown FROM conversations")
def highlight_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IR-11."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", R.highlighted(F.col("text"), ["tion", "with"]).alias("shown"))


ENTITY_SQL = " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, unnest(list_distinct(regexp_extract_all(text, '{E.ENTITIES[k]}'))) AS value FROM documents" for k in ("email", "phone", "ip", "amount"))


@query(ENTITY_SQL)
def extract_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EX-1: e-mail addresses, phones, addresses and amounts, one row each."""
    d = table(spark, sf_dir, "documents").select("doc_id", E.entities(F.col("text"), "email", "phone", "ip", "amount").alias("m"))
    return d.select("doc_id", F.explode("m").alias("kind", "v")).select("doc_id", "kind", F.explode("v").alias("value"))


@query(rf"""WITH s AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '[^.!?\n]+[.!?]?'), lambda x: trim(x, ' ')), lambda x: length(x) > 0) AS a FROM documents),
e AS (SELECT doc_id, i - 1 AS pos, a[i] AS sentence FROM s, unnest(generate_series(1, len(a))) AS g(i)),
t AS (SELECT doc_id, pos, unnest(regexp_extract_all({FOLD.format("sentence")}, '[\p{{L}}\p{{N}}]{{4,}}')) AS t FROM e),
f AS (SELECT doc_id, t, count(*) AS n FROM t GROUP BY ALL), m AS (SELECT doc_id, pos, avg(n) AS mean FROM t JOIN f USING (doc_id, t) GROUP BY ALL),
w AS (SELECT e.*, round(coalesce(mean, 0) * CASE WHEN regexp_matches(sentence, '{E.ORDERS}') THEN 1.5::DOUBLE ELSE 1 END + CASE WHEN pos < 2 THEN 1 ELSE 0 END - CASE WHEN regexp_matches(sentence, '{E.GREETINGS}') THEN 2 ELSE 0 END, 9) AS weight FROM e LEFT JOIN m USING (doc_id, pos)),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, pos) AS r FROM w)
SELECT doc_id, string_agg(sentence, ' ' ORDER BY pos) AS summary FROM r WHERE r <= 4 GROUP BY doc_id""")
def extractive_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EX-6 and 7."""
    return E.summary(table(spark, sf_dir, "documents"), "doc_id", "text")


LETTERS = [
    (1, "OFICIO N° 123/24\nJuzgado de Familia N° 3\nExpte N° 4567/2023\n5 de marzo de 2024\nSe fija audiencia para el 12/04/2024.", "Documento 1"),
    (2, "Nota N° 9\nInforma que se hizo.\n01/02/24", "Mi nota"),
    (3, "PEREZ, Juan\nDNI 30.123.456", None),
]
LETTERS_SQL = "(VALUES (1, 'Oficio N° 123/24 · Juzgado de Familia N° 3 · Expte N° 4567/2023 · 05/03/2024', 'Oficio', '12/04/2024'), (2, 'Mi nota', 'x', NULL), (3, NULL, 'x', NULL)) AS v(id, name, folder, hearing)"


@query(f"SELECT * FROM {LETTERS_SQL}")
def organise_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EX-2 to 5 and 11: names, folders and deadlines of written-out letters; names given by hand stay."""
    d = rows(spark, "id int, text string, name string", LETTERS).withColumn("folder", F.lit("x"))
    due = E.deadlines(d, "id", "text").select("id", F.col("day").alias("hearing"))
    return E.organised(d).join(due, "id", "left").select("id", "name", "folder", "hearing")


CARD = "Lucía Ferreyra Paz\nDirectora Comercial\nEmpresa Norte S.A.\nTel: 3874 420-123\nCel: +54 3874 555-999\nlucia@norte.example\nwww.norte.example\nAv. Belgrano 1200"


@query("SELECT 'Lucía Ferreyra Paz' AS name, 'Directora Comercial' AS title, 'Empresa Norte S.A.' AS org, 2 AS phones, 'lucia@norte.example' AS email, 'www.norte.example' AS url, 'Av. Belgrano 1200' AS address, 'BEGIN:VCARD' AS first_line")
def business_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EX-8 and SNK-6: a card's fields, and the card as vCard."""
    from scriptoria.sources.sinks import vcard

    c = rows(spark, "t string", [(CARD,)]).select(E.business_card(F.col("t")).alias("c")).select("c.*")
    return c.select("name", "title", "org", F.size("phones").alias("phones"), "email", "url", "address", F.element_at(F.split(vcard(F.col("name"), F.col("org"), F.col("phones"), F.col("email")), "\r\n"), 1).alias("first_line"))


ASKED = [("¿Qué dice el artículo 12 del código penal?",), ("art 99 cp",), ("artículo 12",), ("redactame una nota sobre el artículo 12",), ("/ayuda",), ("borra el último",), ("¿cuántos hay?",)]
ASKED_SQL = "(VALUES ('¿Qué dice el artículo 12 del código penal?', 'article', 'found'), ('art 99 cp', 'article', 'not found'), ('artículo 12', 'article', 'ask'), ('redactame una nota sobre el artículo 12', 'draft', 'ask'), ('/ayuda', 'command', 'topic'), ('borra el último', 'action', 'topic'), ('¿cuántos hay?', 'question', 'topic')) AS v(q, intent, outcome)"


@query(f"SELECT * FROM {ASKED_SQL}")
def route_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IR-4 to 6 and 13, JOIN-5: what a question wants, which law it means, whether the article is there."""
    q = rows(spark, "q string", ASKED)
    aliases = rows(spark, "law string, alias string", [("cp", "código penal"), ("cp", "cp"), ("cpp", "código procesal penal")])
    articles = rows(spark, "law string, n string, t string", [("cp", "12", "La reclusión …"), ("cpp", "99", "Las partes …")])
    return R.article_lookup(q, aliases, articles).select("q", R.intent(F.col("q")).alias("intent"), "outcome")


KNOWN = [("dónde están las carpetas", "En el menú", True), ("cómo exporto un pdf", "Con exportar", True), ("qué hora es", "no sé", False)]


@query("SELECT * FROM (VALUES ('donde estan mis carpetas', 'En el menú'), ('como exporto un PDF', 'Con exportar'), ('qué hora es', NULL)) AS v(q, answer)")
def learned_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IR-9 and 12: a similar question's answer, unless it was marked bad."""
    return R.similar_question(rows(spark, "q string", [("donde estan mis carpetas",), ("como exporto un PDF",), ("qué hora es",)]), rows(spark, "k string, answer string, good boolean", KNOWN))


@query("SELECT * FROM (VALUES (1, 'teach', 'quién sos', 'tu ayudante'), (2, 'name', 'Ana', 'Anita'), (3, 'remind', 'pagar', '5/6'), (4, NULL, NULL, NULL)) AS v(id, kind, a, b)")
def command_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EX-9."""
    c = rows(spark, "id int, t string", [(1, "si te preguntan quién sos, respondé tu ayudante"), (2, "llamame Ana y no Anita"), (3, "recordame pagar el 5/6"), (4, "hola")])
    return c.select("id", E.command(F.col("t")).alias("c")).select("id", "c.*")


@query(r"""SELECT lang, doc_id, 'Señor ' || coalesce(nullif(regexp_extract(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}'), ''), '{email}') AS letter FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id DESC) AS r FROM documents) WHERE r = 1""")
def template_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EX-10: a template filled from the latest document of each kind."""
    d = table(spark, sf_dir, "documents")
    last = d.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.col("doc_id").desc()))).where("r = 1")
    return last.select("lang", "doc_id", E.filled_template(F.lit("Señor {email}"), E.entities(F.col("text"))).alias("letter"))


@query("""SELECT doc_id, CASE WHEN quality >= 1 AND toxic = 0 THEN 'good' WHEN quality >= 1 THEN 'fair' ELSE 'poor' END AS grade FROM labels""")
def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EX-12: measures as grades."""
    return table(spark, sf_dir, "labels").select("doc_id", E.graded(F.col("quality") * (2 - F.col("toxic")), 2, 1).alias("grade"))
